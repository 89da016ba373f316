"""Readers and the one writer. Whole-text files become one row each; `ranges` reads large ones by many tasks."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftspark.functions.text import parse_pg_array
from driftspark.operators.jsondocs import checked_jsonc, split_jsonc
from driftspark.schemas import CATALOG_COLUMNS
from driftspark.sources.ranges import export_records, numbered_lines

BOOLEANS = ["return_setof", "strict", "security_definer", "leakproof"]
NUMBERS = {"routine_oid": "long", "param_ord": "int", "cost": "double", "rows": "double"}
OPTIONAL = ["param_name", "param_type", "return_type", "body", "comment"]


def _whole_files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_script_corpus(spark: SparkSession, path: str) -> DataFrame:
    """SQL files below `path` as rows (path, text). `script_pieces` splits files too large for one row."""
    return _whole_files(spark, path)


def read_catalog_rows(
    spark: SparkSession, path: str, fmt: str = "csv", catalog: str | None = None, split: bool = False
) -> DataFrame:
    """Flat catalog rows from an export: ``|``-separated quoted CSV without header, or parquet.

    In CSV, ``t`` is true, an empty field is NULL, numbers that cannot be read are NULL, and config
    is an array literal. Values may hold line ends, so a CSV file is read by one task; with `split`, a large
    one is read by many, at the cost of reading it twice more to find where its records begin.

    Exports of several catalogs need `catalog`, the name of a column that tells them apart (the `by` of
    the operators): a column or partition of that name, or else the name of a CSV file without its
    ending, or of the folder that holds a file of another format.
    """
    source = r"([^/]+?)(?:\.[^./]*)?$" if fmt == "csv" else r"([^/]+)/[^/]*$"

    def named(df, file="_metadata.file_path"):
        if catalog is None or catalog in df.columns:
            return df
        return df.withColumn(catalog, F.regexp_extract(file, source, 1))

    kept = CATALOG_COLUMNS if catalog is None else [*CATALOG_COLUMNS, catalog]
    if fmt != "csv":
        return named(spark.read.format(fmt).load(path)).select(*kept)
    schema = ", ".join(f"`{c}` string" for c in CATALOG_COLUMNS)
    options = {"sep": "|", "quote": '"', "escape": '"', "nullValue": "", "emptyValue": ""}
    if split:
        records = export_records(spark, path).select("file", F.from_csv("text", schema, options).alias("r"))
        text = named(records.select("file", "r.*"), "file")
    else:
        text = named(spark.read.schema(schema).options(multiLine="true", **options).csv(path))
    empty = {c: F.nullif(F.col(c), F.lit("")) for c in [*OPTIONAL, *NUMBERS]}
    return text.withColumns(
        {
            **{c: F.coalesce(F.col(c) == "t", F.lit(False)) for c in BOOLEANS},
            **{c: empty[c] for c in OPTIONAL},
            **{c: empty[c].try_cast(to) for c, to in NUMBERS.items()},
            "config": parse_pg_array(F.col("config")),
        }
    ).select(*kept)


def read_toc(spark: SparkSession, path: str) -> DataFrame:
    """Listing files as lines (file, pos, line); the position is the line number from 0. A large file is read by many tasks."""
    return numbered_lines(spark, path)


def read_jsonc(spark: SparkSession, path: str, checked: bool = False) -> DataFrame:
    """JSON-with-comments files as (path, header, json, data); `checked` adds (valid, error_at) and reads repeated keys."""
    return (checked_jsonc if checked else split_jsonc)(_whole_files(spark, path))


def write_routine_scripts(
    df: DataFrame, path: str, name: str = "name", order: str = "pos", text: str = "text"
) -> None:
    """One folder per routine name, its texts in order; other names' folders stay untouched.

    Rows are range-partitioned by (name, order): a name that holds most rows spreads over several
    tasks and ends up in several files, in order by file name.
    """
    (
        df.repartitionByRange(name, order)
        .sortWithinPartitions(name, order)
        .select(name, F.col(text).alias("value"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(name)
        .text(path)
    )
