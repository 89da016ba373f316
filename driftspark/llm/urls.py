"""URL filters: rules by host and path, and for all other URLs two character models.

The models are Markov models of variable order, one of URLs that rules allow, one of URLs that rules block: the
probability of a character mixes all contexts from the longest one seen down to none (Witten-Bell). The difference of
their mean log-likelihoods per character decides, against a threshold calibrated on URLs left out of the counts.
Counting, scoring and calibration are joins and aggregates over all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftspark.llm.common import staged

#: Stands for what is before a URL; no URL holds it.
PAD = "\u0002"
END = "\u0003"
#: Characters of a URL that one row holds while it is cut up.
RUN = 1024


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """Rule and verdict of the longest rule that fits; null if none does. `rules`: (verdict, host/path), such as ("block", "net/")."""
    rule = verdict = F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _grams(texts: DataFrame, order: int, *kept: Column) -> DataFrame:
    """(long, kept): every character of `text` and of its end, each behind its `order` characters before it.

    A text is first cut into runs of `RUN` characters with what is before them, so that no row holds more than a run.
    """
    padded = F.concat(F.lit(PAD * order), "text", F.lit(END))
    run = F.transform(F.sequence(F.lit(1), F.length("text") + 1, F.lit(RUN)), lambda i: F.substr(padded, i, F.lit(RUN + order)))
    runs = texts.select(F.explode(run).alias("run"), *kept)
    gram = F.transform(F.sequence(F.lit(1), F.length("run") - order), lambda i: F.substr("run", i, F.lit(order + 1)))
    return runs.select(F.explode(gram).alias("long"), *[c for c in runs.columns if c != "run"])


def _key(text: Column) -> list[Column]:
    """128 bits that stand for a text, so that rows of characters need not carry it."""
    return [F.xxhash64(text).alias("key_1"), F.xxhash64(F.lit(1), text).alias("key_2")]


def _suffixes(gram: Column, order: int) -> Column:
    """The last character behind contexts of 0 to `order` characters."""
    return F.array(*[F.substr(gram, F.lit(order + 1 - k), F.lit(k + 1)) for k in range(order + 1)])


def train(texts: DataFrame, order: int) -> tuple[DataFrame, DataFrame]:
    """Counts of (gram, a, b) and (context, a, a_kinds, b, b_kinds) from distinct (text, a, b): how often each model saw it."""
    counts = staged(
        _grams(texts, order, F.col("a"), F.col("b"))
        .groupBy("long").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        .select(F.explode(_suffixes(F.col("long"), order)).alias("gram"), "a", "b")
        .groupBy("gram").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    )
    kinds = lambda c: F.sum((F.col(c) > 0).cast("long")).alias(f"{c}_kinds")
    contexts = counts.groupBy(F.substr("gram", F.lit(1), F.length("gram") - 1).alias("context")).agg(
        F.sum("a").alias("all_a"), kinds("a"), F.sum("b").alias("all_b"), kinds("b")
    )
    return counts, contexts


def _log_probability(levels: Column, model: str, alphabet: int) -> Column:
    """From the shortest context to the longest: (seen + kinds * shorter) / (all + kinds)."""

    def mixed(p: Column, x: Column) -> Column:
        total, kinds = F.coalesce(x[f"all_{model}"], F.lit(0)), F.coalesce(x[f"{model}_kinds"], F.lit(0))
        return F.when(total == 0, p).otherwise((F.coalesce(x[model], F.lit(0)) + kinds * p) / (total + kinds))

    return F.log(F.aggregate(levels, F.lit(1.0 / alphabet), mixed))


def scored(texts: DataFrame, counts: DataFrame, contexts: DataFrame, order: int, alphabet: int = 128) -> DataFrame:
    """(key_1, key_2, score): mean difference of log-likelihoods per character. Each distinct gram is looked up once."""
    grams = _grams(texts, order, *_key(F.col("text")))
    parts = grams.select("long").distinct().select("long", F.posexplode(_suffixes(F.col("long"), order)).alias("k", "gram"))
    # by distinct grams, few of which share a short context
    level = (
        parts.select("gram").distinct().join(counts, "gram", "left")
        .withColumn("context", F.substr("gram", F.lit(1), F.length("gram") - 1))
        .join(contexts, "context", "left")
        .select("gram", F.struct("a", "all_a", "a_kinds", "b", "all_b", "b_kinds").alias("x"))
    )
    single = (
        parts.join(level, "gram").groupBy("long").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("levels"))
        .select("long", F.transform("levels", lambda x: x["x"]).alias("levels"))
        .select("long", (_log_probability(F.col("levels"), "a", alphabet) - _log_probability(F.col("levels"), "b", alphabet)).alias("gain"))
    )
    return grams.join(single, "long").groupBy("key_1", "key_2").agg(F.round(F.avg("gain"), 9).alias("score"))


def threshold(calibration: DataFrame, width: float = 0.01) -> float | None:
    """The score with the least balanced error over (score, allowed, n); None if either kind is missing.

    Only counts by bin of the score come to the driver. A context takes at most the logarithm of its count off a
    score, so there are some thousand bins at most, whatever the input.
    """
    rows = calibration.groupBy(F.floor(F.col("score") / width).alias("at")).agg(
        F.sum(F.when(F.col("allowed"), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("allowed"), 0).otherwise(F.col("n"))).alias("b")
    ).orderBy("at").collect()
    all_a, all_b = sum(r["a"] for r in rows), sum(r["b"] for r in rows)
    if not all_a or not all_b:
        return None
    best = (1.0, rows[0]["at"] * width)  # all are allowed: none of a lost, all of b left
    lost = left = 0
    for r in rows:
        lost, left = lost + r["a"], left + r["b"]
        best = min(best, (lost / all_a + (all_b - left) / all_b, (r["at"] + 1) * width))
    return best[1]


def url_verdicts(
    pages: DataFrame, rules: list[tuple[str, str]], *, id_col: str = "page_id", url_col: str = "url", order: int = 4, left_out: int = 5,
) -> DataFrame:
    """(id, host, path, rule, verdict, score) of every row.

    URLs are host and path; a fifth of those that a rule decides (by hash, `left_out`) calibrates, the others are
    counted. Without URLs of both kinds there is no model: what no rule decides is then allowed with a null score.
    Null URLs and those without `://` have an empty host and path, no score, and are blocked. Equal URLs share a score;
    repeated rows come back repeated; other columns are not read.
    """
    rows = pages.select(F.col(id_col).alias(id_col), host_of(F.col(url_col).cast("string")).alias("host"), path_of(F.col(url_col).cast("string")).alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "by_rule": verdict})
    text = F.concat("host", "path")
    distinct = rows.where(text != "").groupBy(text.alias("text"), "by_rule").agg(F.count(F.lit(1)).alias("n"))
    held = F.pmod(F.xxhash64("text"), F.lit(left_out)) == 0
    is_a = F.col("by_rule") == "allow"
    counted = distinct.where(F.col("by_rule").isNotNull() & ~held).select(
        "text", F.when(is_a, F.col("n")).otherwise(0).alias("a"), F.when(is_a, 0).otherwise(F.col("n")).alias("b")
    )
    counts, contexts = train(counted, order)
    asked = distinct.where(F.col("by_rule").isNull() | held)
    scores = staged(scored(asked.select("text").distinct(), counts, contexts, order))
    known = asked.where(F.col("by_rule").isNotNull()).select(*_key(F.col("text")), is_a.alias("allowed"), "n")
    limit = threshold(known.join(scores, ["key_1", "key_2"]).select("score", "allowed", "n"))
    open_rows = rows.where(F.col("by_rule").isNull()).select("*", text.alias("text"), *_key(text)).join(scores, ["key_1", "key_2"], "left")
    passes = F.lit(True) if limit is None else F.col("score") >= limit
    judged = open_rows.select(
        id_col, "host", "path", "rule",
        F.when(F.col("text") == "", "block").when(passes, "allow").otherwise("block").alias("verdict"),
        (F.lit(None).cast("double") if limit is None else F.col("score")).alias("score"),
    )
    ruled = rows.where(F.col("by_rule").isNotNull()).select(id_col, "host", "path", "rule", F.col("by_rule").alias("verdict"), F.lit(None).cast("double").alias("score"))
    return ruled.unionByName(judged)
