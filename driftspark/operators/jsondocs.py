"""JSON with comments, and JSON-Schema documents as VARIANT."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftspark.functions.jsontext import read_json_text

# Leading run of blank and // lines.
HEADER = r"^((?:[^\S\n]*+(?://[^\n]*+)?\n)*+(?:[^\S\n]*+//[^\n]*+\z)?)"
# String literals are kept as group 1; an open comment or string runs to the end of the text.
STRING_OR_COMMENT = (
    r'("(?:[^"\\]|\\[\s\S])*+(?:"|\z))|//[^\n]*+|/\*[\s\S]*?(?:\*/|\z)'
)


def strip_json_comments(text: Column) -> Column:
    """Drop ``//`` and ``/* */`` comments outside string literals."""
    return F.regexp_replace(text, STRING_OR_COMMENT, "$1")


def split_jsonc(df: DataFrame, col: str = "text") -> DataFrame:
    """Header comment, clean JSON and parsed VARIANT (NULL where the text is not JSON)."""
    found = F.regexp_extract(col, HEADER, 1)
    ended = F.when(found.endswith("\n"), found).otherwise(F.concat(found, F.lit("\n")))
    header = F.when(found.isin("", "\n"), "").otherwise(ended)
    split = df.withColumns(
        {"header": header, "json": strip_json_comments(F.regexp_replace(col, HEADER, ""))}
    )
    return split.withColumn("data", F.try_parse_json("json")).drop(col)


def checked_jsonc(df: DataFrame, col: str = "text") -> DataFrame:
    """`split_jsonc` as a script reads it, with `valid` and `error_at`.

    Of repeated keys the last value counts, at any depth. `error_at` is where in `json` the reader gives up, in
    characters from 0, also behind the end of a document that others would take for whole; text that is nested too
    deeply for the reader gives up at 0. `data` is NULL where `valid` is false, and all but `header` where the text is.
    """
    split = split_jsonc(df, col).withColumn("_read", read_json_text("json"))
    return split.withColumns(
        {
            "data": F.try_parse_json("_read.json"),
            "valid": F.col("_read.error_at").isNull() & F.when(F.col("json").isNotNull(), True),
            "error_at": F.col("_read.error_at"),
        }
    ).drop("_read")


def _truthy(value: Column) -> Column:
    """What a script would take for true: there, and not null, false, 0 or ''."""
    return F.coalesce(
        ~F.is_variant_null(value) & ~F.to_json(value).isin("false", "0", '""'), F.lit(False)
    )


def _types(node: Column) -> Column:
    listed = F.try_variant_get(node, "$.type", "array<string>")
    return F.coalesce(listed, F.array(F.try_variant_get(node, "$.type", "string")))


def property_class(node: Column, types: Column) -> Column:
    """Class of one JSON-Schema property with its list of types; the order of the tests matters."""

    def has(*names):
        wanted = F.array(*[F.lit(name) for name in names])
        return F.coalesce(F.arrays_overlap(types, wanted), F.lit(False))

    def field(path):
        return F.try_variant_get(node, path, "variant")

    item_object = F.coalesce(
        F.try_variant_get(node, "$.items.type", "string") == "object", F.lit(False)
    ) | _truthy(field("$.items.properties"))
    children = F.map_keys(F.try_variant_get(node, "$.properties", "map<string,variant>"))
    childless = F.coalesce(F.size(children), F.lit(0)) <= 0
    return (
        F.when(_truthy(field("$.enum")), "enum")
        .when(has("boolean"), "boolean")
        .when(has("integer", "number"), "number")
        .when(has("array"), F.when(item_object, "array-object").otherwise("array-scalar"))
        .when(
            has("object"),
            F.when(_truthy(field("$.additionalProperties")) & childless, "dictionary").otherwise(
                "object"
            ),
        )
        .otherwise("string")
    )


def classify_json_property(df: DataFrame, col: str) -> DataFrame:
    """Add the `class` of a property and whether its list of types has ``null``."""
    listed = F.try_variant_get(col, "$.type", "array<string>")
    typed = df.withColumn("_types", _types(F.col(col)))
    return typed.withColumns(
        {
            "class": property_class(F.col(col), F.col("_types")),
            "nullable": F.coalesce(F.array_contains(listed, "null"), F.lit(False)),
        }
    ).drop("_types")


def _depth(json: Column) -> Column:
    """How deep the objects of a JSON text are nested: one pass over its braces outside of strings."""
    bare = F.regexp_replace(json, r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^{}"]++', "")
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(state, brace):
        now = state["now"] + F.when(brace == "{", 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(state["most"], now).alias("most"))

    return F.aggregate(F.split(bare, ""), zero, step)["most"]


def flatten_json(df: DataFrame, col: str) -> DataFrame:
    """Nested ``properties`` of schema documents -> dotted paths with description, default, class, nullable.

    The walk goes level by level inside the row, as many levels as the document is deep, so any depth is
    read whole and nothing shuffles. Every level is built once and kept as one array of the levels.
    """
    others = [c for c in df.columns if c != col]
    nodes = "array<struct<path: string, node: variant>>"
    # two objects open on the way from a node to its children
    steps = F.floor(_depth(F.to_json(col)) / 2).cast("int")
    sized = df.select(*others, F.col(col).alias("_doc"), steps.alias("_steps"))

    def children(parent):
        entries = F.map_entries(
            F.try_variant_get(parent["node"], "$.properties", "map<string,variant>")
        )
        named = F.transform(
            entries,
            lambda e: F.struct(
                F.when(parent["path"] == "", e["key"])
                .otherwise(F.concat_ws(".", parent["path"], e["key"]))
                .alias("path"),
                e["value"].alias("node"),
            ),
        )
        return F.coalesce(named, F.array().cast(nodes))

    def step(levels, _):
        last = F.element_at(levels, -1)
        below = F.transform(F.array(last), lambda level: F.flatten(F.transform(level, children)))
        return F.when(F.size(last) > 0, F.concat(levels, below)).otherwise(levels)

    root = F.array(F.struct(F.lit("").alias("path"), F.col("_doc").alias("node"))).cast(nodes)
    rounds = F.when(F.col("_steps") > 0, F.sequence(F.lit(1), "_steps"))
    found = F.aggregate(
        rounds, F.array(root), step, lambda levels: F.flatten(F.slice(levels, 2, F.size(levels)))
    )
    rows = classify_json_property(sized.select(*others, F.inline(found)), "node")
    return rows.select(
        *others,
        "path",
        F.try_variant_get("node", "$.description", "string").alias("description"),
        F.to_json(F.try_variant_get("node", "$.default", "variant")).alias("default"),
        "class",
        "nullable",
    )
