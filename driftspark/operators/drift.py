"""Desired (scripted) against actual (deployed) routines: pairing and field-by-field differences."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftspark.functions.text import fingerprint, literal_safe_fingerprint
from driftspark.operators.routines import resolve_attributes

# Other spellings of built-in type names.
TYPE_ALIASES = {
    "int": "integer", "int4": "integer", "int8": "bigint", "int2": "smallint",
    "bool": "boolean", "varchar": "character varying", "char": "character",
    "float": "double precision", "float8": "double precision", "float4": "real",
    "decimal": "numeric", "varbit": "bit varying",
    "timestamptz": "timestamp with time zone", "timestamp": "timestamp without time zone",
    "timetz": "time with time zone", "time": "time without time zone",
}

ATTRIBUTE_FIELDS = [
    "language", "volatility", "strict", "security_definer", "parallel", "leakproof",
    "cost", "rows", "config",
]
STATE_FIELDS = [
    "kind", "param_names", "param_types", "returns", "body_hash", *ATTRIBUTE_FIELDS, "comment",
]


def _type_name(name: Column, canonical: bool) -> Column:
    """Type names compare as lower-case text; `canonical` also folds aliases and drops modifiers."""
    text = F.regexp_replace(F.lower(name), r"\s+", " ")
    if not canonical:
        return text
    plain = F.regexp_replace(text, r" ?\([\d ,]*\)", "")
    base = F.regexp_replace(plain, r"(?:\[\])+$", "")
    aliases = F.create_map(*[F.lit(x) for pair in TYPE_ALIASES.items() for x in pair])
    return F.concat(
        F.coalesce(F.try_element_at(aliases, base), base), F.regexp_extract(plain, r"(?:\[\])+$", 0)
    )


def _with_signature(df: DataFrame) -> DataFrame:
    return df.withColumn("signature", F.array_join("param_types", ","))


def desired_state(
    routines: DataFrame,
    by: tuple[str, ...] = (),
    default_schema: str = "public",
    canonical_types: bool = False,
) -> DataFrame:
    """Parsed routines as comparable rows, bodies as fingerprints.

    Only input parameters count: a catalog's argument types hold no others. RETURNS TABLE is a set
    of records there, and output parameters without RETURNS are a return type of their own.
    """
    inputs = F.filter(
        "parameters", lambda p: ~F.coalesce(p["dir"], F.lit("in")).isin("out")
    )
    returned = F.col("returns")
    table = returned["table"].isNotNull()
    outputs = F.filter("parameters", lambda p: p["dir"].isin("out", "inout"))
    implied = F.when(
        (F.col("kind") == "function") & (F.size(outputs) > 0),
        F.struct(
            F.lit(False).alias("setof"),
            F.when(F.size(outputs) > 1, "record")
            .otherwise(_type_name(F.get(outputs, F.lit(0))["type"], canonical_types))
            .alias("type"),
        ),
    )
    stated = F.when(
        returned.isNotNull(),
        F.struct(
            (table | returned["setof"]).alias("setof"),
            F.when(table, "record")
            .otherwise(_type_name(returned["type"], canonical_types))
            .alias("type"),
        ),
    )
    returns = F.coalesce(stated, implied)
    hashed = "body_hash" in routines.columns
    body_hash = F.col("body_hash") if hashed else fingerprint(F.col("body"))
    comment = F.col("comment") if "comment" in routines.columns else F.lit(None).cast("string")
    state = resolve_attributes(routines).select(
        *by,
        F.coalesce("schema", F.lit(default_schema)).alias("schema"),
        "name",
        "kind",
        F.transform(inputs, lambda p: p["name"]).alias("param_names"),
        F.transform(inputs, lambda p: _type_name(p["type"], canonical_types)).alias("param_types"),
        returns.alias("returns"),
        body_hash.alias("body_hash"),
        *ATTRIBUTE_FIELDS,
        comment.alias("comment"),
        "atomic",
    )
    return _with_signature(state)


def actual_state(
    catalog: DataFrame, by: tuple[str, ...] = (), canonical_types: bool = False
) -> DataFrame:
    """Folded catalog routines in the same shape as `desired_state`."""
    returned = F.col("returns")
    returns = F.when(
        returned.isNotNull(),
        F.struct(
            returned["setof"].alias("setof"),
            _type_name(returned["type"], canonical_types).alias("type"),
        ),
    )
    state = catalog.select(
        *by,
        "schema",
        "name",
        "kind",
        F.transform("parameters", lambda p: p["name"]).alias("param_names"),
        F.transform("parameters", lambda p: _type_name(p["type"], canonical_types)).alias(
            "param_types"
        ),
        returns.alias("returns"),
        fingerprint(F.col("body")).alias("body_hash"),
        *ATTRIBUTE_FIELDS,
        "comment",
    )
    return _with_signature(state)


def match_routines(desired: DataFrame, actual: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Pair both states: by exact signature first, then what is left over 1:1 by name.

    Returns the key columns, `match` (signature / name / missing / extra) and both sides as structs.
    A signature is unique within one catalog, which `by` has to tell apart; the desired side may
    repeat, and each of its rows is kept. All pairing is decided on one row per signature. Rows that
    may repeat meet it in an inner join at the end, of which AQE can split either side.

    Each side is worked out once: both joins that read the desired rows are merge joins by the same keys
    and need whole rows, so the second one reads the shuffle that the first one has written.
    """
    names = [*by, "schema", "name"]
    keys = [*names, "signature"]
    # A row without a name or schema pairs with nothing; saying so here gives both joins the same input.
    known = reduce(Column.__and__, [F.col(c).isNotNull() for c in keys])
    wanted = desired.where(known).select(
        *keys, F.struct(*[c for c in desired.columns if c not in keys]).alias("desired")
    )
    found = actual.where(known).select(
        *keys, F.struct(*[c for c in actual.columns if c not in keys]).alias("actual")
    )
    # The hash has no other use than to read whole rows, as the join at the end does.
    defined = (
        wanted.hint("merge").join(found.select(*keys, F.xxhash64("actual").alias("_found")), keys, "left")
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("definitions"), F.max(F.xxhash64("desired", "_found")).alias("_whole"))
        .where("_whole is not null")
    )
    sides = defined.hint("merge").join(found, keys, "full_outer")
    lone_desired, lone_actual = F.col("actual").isNull(), F.col("definitions").isNull()
    renamed = (
        sides.where(lone_desired | lone_actual)
        .groupBy(*names)
        .agg(
            F.sum("definitions").alias("n_desired"),
            F.count("actual").alias("n_actual"),
            F.first("actual", ignorenulls=True).alias("partner"),
        )
        .where("n_desired = 1 and n_actual = 1")
        .select(*names, "partner")
    )
    has_partner = F.col("partner").isNotNull()
    decided = sides.join(renamed, names, "left").select(
        *keys,
        (~lone_actual).alias("wanted"),
        F.when(lone_actual, F.when(~has_partner, "extra"))
        .when(~lone_desired, "signature")
        .otherwise(F.when(has_partner, "name").otherwise("missing"))
        .alias("match"),
        F.coalesce("actual", "partner").alias("actual"),
    )
    paired = wanted.hint("merge").join(decided.where("wanted"), keys).select(*keys, "match", "desired", "actual")
    extra = decided.where("not wanted and match is not null").select(*keys, "match", "actual")
    return paired.unionByName(extra, allowMissingColumns=True)


def _differs(field: str) -> Column:
    return ~F.col(f"desired.{field}").eqNullSafe(F.col(f"actual.{field}"))


def diff_routines(matched: DataFrame) -> DataFrame:
    """Status and changed fields of each matched pair.

    Bodies of BEGIN ATOMIC routines have no source text in the catalog, so they are not compared
    but reported as `body_unverified`. A changed comment is its own column: it needs no re-creation.
    """
    changes = {
        "kind": _differs("kind"),
        "parameters": _differs("param_names") | _differs("param_types"),
        "returns": _differs("returns"),
        "body": ~F.col("desired.atomic") & _differs("body_hash"),
        **{field: _differs(field) for field in ATTRIBUTE_FIELDS},
    }
    fields = F.array_compact(F.array(*[F.when(c, F.lit(f)) for f, c in changes.items()]))
    both = F.col("match").isin("signature", "name")
    status = (
        F.when(~both, F.col("match")).when(F.size(fields) == 0, "same").otherwise("changed")
    )
    keys = [c for c in matched.columns if c not in ("match", "desired", "actual")]
    return matched.select(
        F.coalesce("desired.kind", "actual.kind").alias("kind"),
        *keys,
        status.alias("status"),
        F.when(both, fields).otherwise(F.array().cast("array<string>")).alias("changed_fields"),
        F.when(both, _differs("comment")).alias("comment_changed"),
        F.when(both, F.col("desired.atomic")).alias("body_unverified"),
    )


def diff_comments(matched: DataFrame) -> DataFrame:
    """Pairs whose comments differ, NULL being equal to NULL only."""
    keys = [c for c in matched.columns if c not in ("match", "desired", "actual")]
    return matched.where(
        F.col("match").isin("signature", "name") & _differs("comment")
    ).select(
        *keys,
        F.col("desired.comment").alias("desired_comment"),
        F.col("actual.comment").alias("actual_comment"),
    )


def duplicate_bodies(df: DataFrame, key: str, body: str, literals: bool = False) -> DataFrame:
    """Groups of rows whose bodies have the same fingerprint: count and smallest key.

    With `literals`, case and blanks within literals and quoted names count.

    The hash is taken before the shuffle and counts are combined map-side, so a body that a third
    of all rows share costs one row per task.
    """
    return (
        df.where(F.col(body).isNotNull())
        .select(F.col(key), (literal_safe_fingerprint if literals else fingerprint)(F.col(body)).alias("fingerprint"))
        .groupBy("fingerprint")
        .agg(F.count(F.lit(1)).alias("copies"), F.min(key).alias("first_key"))
        .where("copies > 1")
    )
