"""Layered settings and connection strings as whole jobs."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftspark.operators.settings import layered_merge, parse_kv, resolve_placeholders


def effective_settings(layers: DataFrame, dictionary_layers: DataFrame) -> DataFrame:
    """Merged settings (section, key) with placeholders resolved from the merged dictionary."""
    dictionary = layered_merge(dictionary_layers, ("key",)).select("key", "value")
    merged = layered_merge(layers).select("section", "key", "value")
    return resolve_placeholders(merged, dictionary, "value")


def connection_fields(
    connections: DataFrame, dictionary: DataFrame, col: str = "conn"
) -> DataFrame:
    """Connection strings with placeholders -> one row per connection and key."""
    resolved = resolve_placeholders(connections, dictionary, col).drop("unresolved")
    return parse_kv(resolved, "resolved")


# Fields of a connection and what they are where a string leaves them out.
CONNECTION_DEFAULTS = {"host": "localhost", "port": "5432", "database": "", "username": "", "password": ""}


def connections(df: DataFrame, col: str = "conn") -> DataFrame:
    """Connection strings -> one row each with all fields, stated ones and defaults, without a shuffle.

    Keys compare without case; the last entry of a key counts.
    """
    others = [c for c in df.columns if c != col]
    entries = F.transform(
        F.filter(F.split(col, ";", -1), lambda part: F.instr(part, "=") > 1),
        lambda part: F.struct(
            F.lower(F.btrim(F.substring_index(part, "=", 1))).alias("key"),
            F.btrim(F.substring(part, F.instr(part, "=") + 1, F.length(part))).alias("value"),
        ),
    )
    rows = df.select(*others, entries.alias("_entries"))
    fields = [
        F.coalesce(F.try_element_at(F.filter("_entries", lambda e: e["key"] == k), F.lit(-1))["value"], F.lit(v)).alias(k)
        for k, v in CONNECTION_DEFAULTS.items()
    ]
    return rows.select(*others, *fields)
