"""Queries over the test tables: inputs derived from table columns, and the SQL that checks them."""
