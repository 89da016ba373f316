"""Catalog side: joins over the system tables, and flat rows folded into nested routines."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftspark.schemas import CATALOG_COLUMNS

# One-letter codes of the system tables.
ROUTINE_KINDS = {"f": "function", "p": "procedure"}
VOLATILITY_CODES = {"i": "immutable", "s": "stable", "v": "volatile"}
# The class oid of routines in descriptions.
PROC_CLASS = 1255
PARALLEL_CODES = {"s": "safe", "r": "restricted", "u": "unsafe"}


def _decode(codes: dict[str, str], code: Column, default: str | None) -> Column:
    decoded = F.lit(default)
    for letter, word in codes.items():
        decoded = F.when(code == letter, word).otherwise(decoded)
    return decoded


def _input_names(proc: DataFrame) -> Column:
    """Argument names by input position. With modes at hand, OUT and TABLE columns are left out."""
    if "proargmodes" not in proc.columns:
        return F.col("proargnames")
    inputs = F.filter(
        F.arrays_zip("proargnames", "proargmodes"), lambda z: z["proargmodes"].isin("i", "b", "v")
    )
    return F.when(F.col("proargmodes").isNull(), F.col("proargnames")).otherwise(
        F.transform(inputs, lambda z: z["proargnames"])
    )


def catalog_metadata(
    proc: DataFrame,
    namespace: DataFrame,
    language: DataFrame,
    types: DataFrame,
    description: DataFrame,
    schemas: DataFrame | None = None,
    ordered: bool = True,
) -> DataFrame:
    """Flat catalog rows, one per routine x input argument (one row with NULLs for none).

    The small system tables are broadcast by Spark where their measured size allows it. Beyond
    that every join keeps the routine side on the left, which AQE may split where one schema,
    language or type holds most rows. Descriptions are joined before the arguments fan out.
    """
    spaces = namespace.select(
        F.col("oid").alias("pronamespace"), F.col("nspname").alias("schema")
    )
    if schemas is not None:
        spaces = select_schemas(spaces, schemas)
    languages = language.select(F.col("oid").alias("prolang"), F.col("lanname").alias("language"))
    # Other classes of objects, and columns, may have a routine's oid.
    described = description
    if "classname" in description.columns:
        described = described.where(F.col("classname") == "pg_proc")
    elif "classoid" in description.columns:
        described = described.where(F.col("classoid") == PROC_CLASS)
    if "objsubid" in description.columns:
        described = described.where(F.col("objsubid") == 0)
    remarks = described.select(
        F.col("objoid").alias("oid"), F.col("description").alias("comment")
    )
    return_types = types.select(
        F.col("oid").alias("prorettype"), F.col("type_name").alias("return_type")
    )
    argument_types = types.select(
        F.col("oid").alias("type_oid"), F.col("type_name").alias("param_type")
    )
    routines = (
        proc.withColumn("_names", _input_names(proc))
        .join(spaces, "pronamespace")
        .join(languages, "prolang")
        .join(return_types, "prorettype", "left")
        .join(remarks, "oid", "left")
    )
    arguments = routines.select(
        "*", F.posexplode_outer("proargtypes").alias("_at", "type_oid")
    ).join(argument_types, "type_oid", "left")
    flat = arguments.select(
        "schema",
        F.col("proname").alias("name"),
        _decode(ROUTINE_KINDS, F.col("prokind"), None).alias("type"),
        F.col("oid").cast("long").alias("routine_oid"),
        (F.col("_at") + 1).cast("int").alias("param_ord"),
        F.nullif(F.get("_names", F.col("_at")), F.lit("")).alias("param_name"),
        "param_type",
        "return_type",
        F.col("proretset").alias("return_setof"),
        F.col("prosrc").alias("body"),
        "language",
        F.col("provolatile").alias("volatility"),
        F.col("proisstrict").alias("strict"),
        F.col("prosecdef").alias("security_definer"),
        F.col("proparallel").alias("parallel"),
        F.col("proleakproof").alias("leakproof"),
        F.col("procost").cast("double").alias("cost"),
        F.col("prorows").cast("double").alias("rows"),
        F.col("proconfig").alias("config"),
        "comment",
    ).select(*CATALOG_COLUMNS)
    return flat.orderBy("schema", "name", "routine_oid", "param_ord") if ordered else flat


def user_schemas(namespace: DataFrame, name: str = "nspname") -> DataFrame:
    """Schema names that are not the system's own, in order.

    ``_`` is a wildcard in LIKE, so any name of ``pg`` plus one character is left out as well.
    """
    col = F.col(name)
    own = ~col.like("pg_%") & (F.left(col, F.lit(1)) != "_") & (col != "information_schema")
    return namespace.where(own).orderBy(name)


def select_schemas(df: DataFrame, chosen: DataFrame, column: str = "schema") -> DataFrame:
    """Rows of `df` in one of the chosen schemas (first column of `chosen`); none chosen, none kept."""
    names = chosen.select(F.col(chosen.columns[0]).alias(column)).distinct()
    return df.join(names, column, "left_semi")


def decode_catalog_codes(rows: DataFrame) -> DataFrame:
    """Codes to words; unknown codes take the default; procedures return nothing; config never NULL."""
    return rows.withColumns(
        {
            "volatility": _decode(VOLATILITY_CODES, F.col("volatility"), "volatile"),
            "parallel": _decode(PARALLEL_CODES, F.col("parallel"), "unsafe"),
            "returns": F.when(
                F.coalesce(F.col("type") != "procedure", F.lit(True)),
                F.struct(
                    F.col("return_setof").alias("setof"), F.col("return_type").alias("type")
                ),
            ),
            "config": F.coalesce("config", F.array().cast("array<string>")),
        }
    ).drop("return_setof", "return_type")


def fold_catalog_rows(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Flat rows -> one row per routine with its parameters in order.

    `by` names the columns that tell catalogs apart (oids are unique within one database only). A
    group is one routine's argument list, which the catalog itself limits (100 by default).
    `unfoldable_rows` returns what can't be folded: rows without an oid, and oids of two routines.
    """
    keys = [*by, "routine_oid"]
    rows = rows.where(F.col("routine_oid").isNotNull())
    parameter = F.struct(
        F.col("param_ord").alias("ord"), F.col("param_name").alias("name"),
        F.col("param_type").alias("type"),
    )
    fields = [
        c for c in rows.columns if c not in keys and not c.startswith("param_")
    ]
    folded = rows.groupBy(*keys).agg(
        F.min_by(F.struct(*fields), F.coalesce("param_ord", F.lit(0))).alias("_routine"),
        F.sort_array(
            F.collect_list(F.when(F.col("param_ord").isNotNull(), parameter))
        ).alias("parameters"),
    )
    flat = folded.select(*keys, "_routine.*", "parameters")
    return decode_catalog_codes(flat).withColumnRenamed("type", "kind")


def unfoldable_rows(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows without an oid, and rows whose (catalog, oid) names two routines, each with its reason.

    The second kind shows that several catalogs were read as one: `by` lacks their column.
    """
    keys = [*by, "routine_oid"]
    label = F.struct("schema", "name", "type")
    named = (
        rows.where(F.col("routine_oid").isNotNull()).groupBy(*keys)
        .agg(F.min(label).alias("_low"), F.max(label).alias("_high"))
        .where(~F.col("_low").eqNullSafe(F.col("_high"))).drop("_low", "_high")
    )
    lone = rows.where(F.col("routine_oid").isNull()).withColumn("reason", F.lit("no oid"))
    twice = rows.join(named, keys, "left_semi").withColumn("reason", F.lit("two names for one oid"))
    return lone.unionByName(twice)
