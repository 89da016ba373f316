"""Settings work: key/value strings, placeholders, layers, file references, versions."""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftspark.functions.text import is_newer, trim_blanks, version_core


def parse_kv(df: DataFrame, col: str) -> DataFrame:
    """``a=1;b=2`` -> one row per key: pos of its first entry, key, value of its last entry.

    All inside the row (sort the entries, keep the first and last of each run of equal keys), so
    there is no shuffle.
    """
    others = [c for c in df.columns if c != col]
    parts = F.filter(F.split(col, ";", -1), lambda part: F.instr(part, "=") > 1)

    def entry(part, i):
        eq = F.instr(part, "=")
        return F.struct(
            trim_blanks(F.left(part, eq - 1)).alias("key"),
            i.alias("pos"),
            trim_blanks(F.substring(part, eq + 1, F.length(part))).alias("value"),
        )

    entries = df.select(*others, F.sort_array(F.transform(parts, entry)).alias("_kv"))
    kv = F.col("_kv")
    firsts = F.filter(kv, lambda e, i: ~F.get(kv, i - 1)["key"].eqNullSafe(e["key"]))
    lasts = F.filter(kv, lambda e, i: ~F.get(kv, i + 1)["key"].eqNullSafe(e["key"]))
    runs = entries.select(*others, F.arrays_zip(firsts.alias("f"), lasts.alias("l")).alias("_run"))
    rows = F.transform(
        "_run",
        lambda r: F.struct(
            r["f"]["pos"].alias("pos"), r["f"]["key"].alias("key"), r["l"]["value"].alias("value")
        ),
    )
    return runs.select(*others, F.inline(rows))


def extract_file_refs(df: DataFrame, col: str) -> DataFrame:
    """``*.json`` tokens of command text with an optional flag, set by the ``--optional`` before them.

    Any other ``--x`` or a ``.json`` token clears the flag and other tokens leave it, so only the
    previous token of those two sorts matters.
    """
    others = [c for c in df.columns if c != col]
    tokens = F.filter(
        F.split(trim_blanks(F.col(col)), r"\s+", -1),
        lambda t: t.startswith("--") | t.endswith(".json"),
    )
    marked = df.select(*others, tokens.alias("_tokens"))
    before = F.transform(
        "_tokens",
        lambda t, i: F.struct(
            t.alias("path"),
            F.coalesce(F.get("_tokens", i - 1) == "--optional", F.lit(False)).alias("optional"),
        ),
    )
    refs = F.filter(before, lambda ref: ~ref["path"].startswith("--"))
    return marked.select(*others, F.posexplode(refs).alias("pos", "_ref")).select(
        *others, "pos", "_ref.*"
    )


def resolve_placeholders(templates: DataFrame, dictionary: DataFrame, col: str) -> DataFrame:
    """Replace ``{NAME}`` from the dictionary (key, value), once; list what it does not have.

    Each distinct text is resolved once and joined back by its hash. Only the distinct names of a text
    meet the dictionary, and what they say comes back as one map per text, so literal text never enters
    a join. The dictionary holds one row per key. In every join the side without repeats is on the
    right, so AQE may split a hot key on the left. Templates without a brace skip all of it.
    """
    others = [c for c in templates.columns if c != col]
    none = F.array().cast("array<string>")
    braced = F.coalesce(F.contains(F.col(col), F.lit("{")), F.lit(False))
    plain = templates.where(~braced).select(
        *others, F.col(col).alias("resolved"), none.alias("unresolved")
    )
    keyed = templates.where(braced).withColumn("_id", F.sha2(F.col(col), 256))
    token = F.lit(r"\{[^}]+\}|[^{]+|\{")
    texts = keyed.groupBy("_id").agg(F.any_value(col).alias("_text")).select(
        "_id", F.regexp_extract_all("_text", token, F.lit(0)).alias("_tokens")
    )

    def is_name(t):
        return t.startswith("{") & t.endswith("}") & (F.length(t) > 2)

    def name_of(t):
        return F.substring(t, F.lit(2), F.length(t) - 2)

    names = F.array_distinct(F.transform(F.filter("_tokens", is_name), name_of))
    known = dictionary.select(F.col("key").alias("_name"), F.col("value").alias("_value"))
    said = (
        texts.select("_id", F.explode(names).alias("_name")).join(known, "_name")
        .groupBy("_id").agg(F.map_from_entries(F.collect_list(F.struct("_name", "_value"))).alias("_said"))
    )

    def known_name(t):
        return is_name(t) & F.coalesce(F.map_contains_key("_said", name_of(t)), F.lit(False))

    pieces = F.transform(
        "_tokens", lambda t: F.when(known_name(t), F.try_element_at("_said", name_of(t))).otherwise(t)
    )
    missing = F.transform(F.filter("_tokens", lambda t: is_name(t) & ~known_name(t)), name_of)
    resolved = texts.join(said, "_id", "left").select(
        "_id", F.array_join(pieces, "").alias("resolved"), missing.alias("unresolved")
    )
    back = keyed.join(resolved, "_id").select(*others, "resolved", "unresolved")
    return back.unionByName(plain)


def layered_merge(layers: DataFrame, by: tuple[str, ...] = ("section", "key")) -> DataFrame:
    """Per key, the value of the highest layer that has the key, be it empty; of several in one layer the largest."""
    ranked = F.when(F.col("layer_rank").isNotNull(), F.struct("layer_rank", "value"))
    return layers.groupBy(*by).agg(
        F.max_by("value", ranked).alias("value"), F.max("layer_rank").alias("layer_rank")
    )


def missing_keys(
    expected: DataFrame, existing: DataFrame, by: tuple[str, ...] = ("section", "key")
) -> DataFrame:
    """Expected keys that do not exist, as rows. Existing keys are made distinct before the join."""
    return expected.join(existing.select(*by).distinct(), list(by), "left_anti")


def first_seen(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Distinct by key, keeping all columns of the first row by `order`; of equal ones the least by the other columns.

    Columns that have no order (maps, variants, and what holds them) do not decide.
    """
    rest = [c for c in df.columns if c not in keys]
    ordered = [c for c in rest if c != order and not re.search(r"\b(?:map|variant)\b", df.schema[c].dataType.simpleString())]
    ranked = F.when(F.col(order).isNotNull(), F.struct(order, *ordered))
    first = F.min_by(F.struct(*rest), ranked).alias("_first")
    return df.groupBy(*keys).agg(first).select(*keys, "_first.*")


def outdated(installed: DataFrame, latest: DataFrame) -> DataFrame:
    """Installed versions (name, installed) with the latest release and a status.

    `latest` where the first three parts are equal, `update` where the release is newer, else NULL.
    """
    have, want = F.col("installed"), F.col("latest")
    status = F.when(version_core(have) == version_core(want), "latest").when(
        is_newer(have, want), "update"
    )
    return installed.join(latest, "name", "left").withColumn("status", status)


def env_entries(documents: DataFrame, text: str = "text") -> DataFrame:
    """Lines ``KEY=value`` of env documents as rows (key, value), the last of a key.

    Blank lines, lines that start with ``#`` and lines without a key go. The first ``=`` parts them, both
    sides are trimmed, and one pair of quotes around the value goes. `layered_merge` and
    `resolve_placeholders` take the rows as a dictionary.
    """
    others = [c for c in documents.columns if c != text]
    lines = documents.select(*others, F.posexplode(F.split(text, r"\r?\n", -1)).alias("_pos", "_line"))
    line = trim_blanks(F.col("_line"))
    at = F.locate("=", line)
    entry = lines.where((at > 1) & ~line.startswith("#")).select(
        *others,
        "_pos",
        trim_blanks(F.substring(line, F.lit(1), at - 1)).alias("key"),
        trim_blanks(F.substring(line, at + 1, F.length(line))).alias("_value"),
    )
    value = F.regexp_replace("_value", r"""(?s)^(["'])(.*)\1$""", "$2")
    return entry.where("key <> ''").groupBy(*others, "key").agg(F.max_by(value, "_pos").alias("value"))


def write_kv(pairs: Column, first: list[str]) -> Column:
    """Map -> ``key=value;...``, the inverse of `parse_kv`: the `first` keys in their order, then the others by name.

    Keys compare without case; NULL and empty values are left out.
    """
    entries = F.filter(F.map_entries(pairs), lambda e: F.coalesce(e["value"], F.lit("")) != "")
    places = F.array(*[F.lit(k.lower()) for k in first])

    def placed(e):
        known = F.array_position(places, F.lower(e["key"])).cast("int")
        return F.struct(
            F.when(known > 0, known).otherwise(len(first) + 1).alias("place"),
            F.lower(e["key"]).alias("low"),
            F.concat(e["key"], F.lit("="), e["value"]).alias("text"),
        )

    return F.array_join(F.transform(F.array_sort(F.transform(entries, placed)), lambda e: e["text"]), ";")
