"""Secrets in texts: three fixed patterns, and strings that look random.

Long strings of a letter-and-digit encoding go through a battery of tests: chi-squared uniformity over the encoding's
alphabet, runs of character classes, and serial correlation of neighbours. What written language or identifiers show
gives each string a p-value, and the share of false discoveries over the whole table is held under a limit, longer
strings weighing more. All of it is built-in column functions; only counts by p-value reach the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftspark.llm.common import staged
from driftspark.llm.rules import let

#: The patterns, what must be in a text for them to match, and the fewest characters of their group.
KINDS = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", ("password", "passwd", "secret", "token", "api"), 2, 12),
    ("access", r"AKIA[A-Z0-9]+", ("akia",), 0, 18),
    ("hex", r"[0-9a-f]{16,}", (), 0, 16),
]
#: Alphabets of the encodings, in the order in which they are tried.
ENCODINGS = [
    ("base16", r"^[0-9a-f]+$|^[0-9A-F]+$", "0123456789abcdef", 16),
    ("base32", r"^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 32),
    ("base64", r"", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", 64),
]
_CHUNK = 256


def _running(values: Column) -> Column:
    """Sums of an array's values up to each of them. Chunks keep the work close to linear for long arrays."""
    zero = F.struct(F.array().cast("array<int>").alias("all"), F.lit(0).alias("sum"))
    grow = lambda done, x: F.struct(F.concat(done["all"], F.array(done["sum"] + x)).alias("all"), (done["sum"] + x).alias("sum"))
    fold = lambda part: F.aggregate(part, zero, grow)
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _CHUNK).cast("int")), lambda c: fold(F.slice(values, c * _CHUNK + 1, _CHUNK)))
    shifted = lambda parts: let(
        F.aggregate(F.transform(parts, lambda p: p["sum"]), zero, grow)["all"],
        lambda ends: F.flatten(F.transform(parts, lambda p, i: F.transform(p["all"], lambda x: x + F.get(ends, i) - p["sum"]))),
    )
    return F.when(F.size(values) == 0, F.array().cast("array<int>")).otherwise(let(chunks, shifted))


def located(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost matches that don't overlap: array of (s, e, size), in code points; size is that of the group."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sized = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda m: F.length(m))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))

    return let(F.struct(F.transform(matches, lambda m: F.length(m)).alias("n"), gaps.alias("g"), sized.alias("z")), lambda x: let(
        _running(F.zip_with(x["n"], F.slice(x["g"], 1, F.size(x["n"])), lambda n, g: n + g)),
        lambda ends: F.transform(ends, lambda e, i: F.struct((e - F.get(x["n"], i)).alias("s"), e.alias("e"), F.get(x["z"], i).alias("size"))),
    ))


def _none(kind: str) -> Column:
    return F.array().cast(kind)


def base_spans(text: Column) -> Column:
    """Array of (s, k, e) of the fixed patterns, sorted; k is the place of the kind in KINDS."""
    found = []
    low = F.lower(text)
    for k, (_, pattern, hints, group, fewest) in enumerate(KINDS):
        may = low.contains(hints[0]) if hints else text.rlike(pattern)
        for h in hints[1:]:
            may = may | low.contains(h)
        spans = F.transform(F.filter(located(text, pattern, group), lambda m: m["size"] >= fewest), lambda m: F.struct(m["s"].alias("s"), F.lit(k).alias("k"), m["e"].alias("e")))
        found.append(F.when(may, spans).otherwise(_none("array<struct<s:int,k:int,e:int>>")))
    return F.array_sort(F.concat(*found))


def _normal_tail(z: Column) -> Column:
    """Upper tail of the normal distribution (Abramowitz and Stegun 26.2.17)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def battery(token: Column) -> Column:
    """(p, passes) of one string: how likely language or an identifier looks this random, and whether randomness stands.

    Uniformity: chi-squared over the alphabet, in units of its spread under randomness and under letters as frequent as
    in text (sum of squared shares 0.055). Runs: changes between lower case, upper case, digits and signs; identifiers
    change at 15 % of places. Serial correlation: of alphabet places of neighbours.
    """
    size = F.lit(ENCODINGS[-1][3])
    alphabet = F.lit(ENCODINGS[-1][2])
    text = F.rtrim(token, F.lit("="))
    for _, pattern, letters, n in reversed(ENCODINGS[:-1]):
        size, alphabet = F.when(token.rlike(pattern), F.lit(n)).otherwise(size), F.when(token.rlike(pattern), F.lit(letters)).otherwise(alphabet)
    text = F.when(token.rlike(ENCODINGS[0][1]), F.lower(text)).otherwise(text)

    def tests(x: Column) -> Column:
        chars, n, a = F.split(x["t"], ""), F.length(x["t"]), x["a"]
        squares = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda s, c: s + F.pow((n - F.length(F.replace(x["t"], c, F.lit("")))).cast("double"), F.lit(2.0)))
        chi, free = a / n * squares - n, a - 1
        uniform = (F.cbrt(F.greatest(chi, F.lit(0.0)) / free) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
        extra = F.greatest(a * 0.055 - 1, F.lit(0.5)) * n
        worded = (free + extra - chi) / F.sqrt(2 * free + 8 * extra)
        kind = lambda c: F.when(c.rlike("[a-z]"), 0).when(c.rlike("[A-Z]"), 1).when(c.rlike("[0-9]"), 2).otherwise(3)
        zero = F.struct(*[F.lit(v).alias(c) for c, v in (("k", -1), ("v", -1.0), ("runs", 0), ("s", 0.0), ("ss", 0.0), ("sp", 0.0))])

        def step(d: Column, c: Column) -> Column:
            v = F.call_function("position", c, x["abc"]).cast("double")
            return F.struct(
                kind(c).alias("k"), v.alias("v"), (d["runs"] + F.when((d["k"] >= 0) & (d["k"] != kind(c)), 1).otherwise(0)).alias("runs"),
                (d["s"] + v).alias("s"), (d["ss"] + v * v).alias("ss"), (d["sp"] + F.when(d["v"] >= 0, v * d["v"]).otherwise(F.lit(0.0))).alias("sp"),
            )

        def judge(d: Column) -> Column:
            changes = (d["runs"] - 0.15 * (n - 1)) / F.sqrt(0.1275 * (n - 1))
            spread = d["ss"] - d["s"] * d["s"] / n
            serial = F.when(spread > 0, (d["sp"] - d["s"] * d["s"] / n) / spread).otherwise(F.lit(1.0)) * F.sqrt(n)
            return F.struct(
                _normal_tail((worded + changes) / math.sqrt(2)).alias("p"), ((uniform < 2.6) & (F.abs(serial) < 3.5) & (d["runs"] >= 0.25 * n)).alias("passes")
            )

        return let(F.aggregate(chars, zero, step), judge)

    return let(F.struct(text.alias("t"), size.alias("a"), alphabet.alias("abc")), tests)


def random_looking(text: Column, fewest: int = 20) -> Column:
    """Array of (s, e, p) of all long strings with digits and letters, or both cases; p is 1 where randomness is refuted."""
    pattern = f"[A-Za-z0-9+/_-]{{{fewest},}}={{0,2}}"
    kind = "array<struct<s:int,e:int,p:double>>"
    is_code = lambda t: t.rlike("[0-9]") & t.rlike("[A-Za-z]") | t.rlike("[a-z][A-Z]")

    def tested(m: Column) -> Column:
        token = F.substr(text, m["s"] + 1, m["e"] - m["s"])
        return let(token, lambda t: F.when(is_code(t), let(battery(t), lambda b: F.struct(m["s"].alias("s"), m["e"].alias("e"), F.when(b["passes"], b["p"]).otherwise(1.0).alias("p")))))

    spans = F.filter(F.transform(located(text, pattern), tested), lambda m: m["p"].isNotNull())
    return F.when(text.rlike(f"[A-Za-z0-9+/_-]{{{fewest}}}"), spans).otherwise(_none(kind))


def _weighted(m: Column) -> Column:
    """-10 log10 of the p-value over a weight that grows with length, in whole steps from 0 to 400."""
    weight = F.least(F.lit(4.0), (m["e"] - m["s"]) / 32.0)
    return F.least(F.lit(400), F.greatest(F.lit(0), F.floor(-10 * F.log10(F.greatest(m["p"], F.lit(1e-39)) / weight)))).cast("int")


def discovery_limit(found: DataFrame, rate: float) -> int:
    """Least step at which the expected share of false discoveries is at most `rate` (Benjamini and Hochberg, by steps).

    `found` has (tests, steps): strings tested in each row and the steps of those that pass. At most 401 counts and one
    sum reach the driver.
    """
    total = found.agg(F.sum("tests").alias("n")).first()["n"] or 0
    counts = {r["step"]: r["n"] for r in found.select(F.explode("steps").alias("step")).groupBy("step").agg(F.count(F.lit(1)).alias("n")).collect()}
    limit, seen = 401, 0
    for step in sorted(counts, reverse=True):
        seen += counts[step]
        if total * 10 ** (-step / 10) <= rate * seen:
            limit = step
    return limit


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """`text` with `mark` in place of each span, or of each group of overlapping ones. `spans` are sorted."""
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    cut = lambda d, x: F.struct(
        F.when(x["s"] >= d["at"], F.concat(d["out"], F.substr(text, d["at"] + 1, x["s"] - d["at"]), F.lit(mark))).otherwise(d["out"]).alias("out"),
        F.greatest(d["at"], x["e"]).alias("at"),
    )
    whole = let(F.aggregate(spans, zero, cut), lambda d: F.concat(d["out"], F.substr(text, d["at"] + 1, F.length(text))))
    return F.when(F.size(spans) == 0, text).otherwise(whole)


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.01, keep: list[str] | None = None, out: str = "spans") -> DataFrame:
    """(id, [kept columns], spans) of every row; `out` names the spans, where a kept column has that name. They are an array of (s, k, e), sorted, ends exclusive, in code points.

    k is the place in KINDS, or len(KINDS) for strings that only the battery found; those overlap no fixed span. Null and
    empty texts have no spans; repeated rows come back repeated; other columns are passed on only if `keep` names them.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    others = [id_col, *(c for c in keep or [] if c != id_col)]
    given = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(others)])  # their names may be any
    rows = docs.select(given.alias("given"), base_spans(text).alias("base"), random_looking(text).alias("random"))
    free = lambda m: ~F.exists("base", lambda b: (b["s"] < m["e"]) & (m["s"] < b["e"]))
    rows = staged(rows.withColumn("random", F.filter("random", free)))
    limit = discovery_limit(rows.select(F.size("random").alias("tests"), F.transform("random", _weighted).alias("steps")), rate)
    added = F.transform(F.filter("random", lambda m: _weighted(m) >= limit), lambda m: F.struct(m["s"].alias("s"), F.lit(len(KINDS)).alias("k"), m["e"].alias("e")))
    named = [F.col(f"given.c{i}").alias(c) for i, c in enumerate(others)]
    return rows.select(*named, F.array_sort(F.concat("base", added)).alias(out))
