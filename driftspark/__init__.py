"""Drift analysis of SQL routine scripts, catalog snapshots, dump listings and settings, on Spark."""

__version__ = "0.1.0"
