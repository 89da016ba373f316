"""Quality rules that look at lines first: lines that fail a rule go, and documents that lose too much go with them.

All of it is built-in column functions; nothing leaves the JVM and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space between words, and the symbols that are counted.
BLANK = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
SEPARATORS = "|»›·"
#: Phrases of lines that many sites repeat, in lower case.
BOILERPLATE = (
    "all rights reserved", "licensed under", "terms of use", "terms of service", "privacy policy", "cookie policy",
    "cookie notice", "cookie settings", "we use cookies", "subscribe to our", "sign up for our", "click here to",
    "skip to content", "skip to main content", "back to top", "copyright ©",
)
#: A line that ends a sentence or a quotation.
SENTENCE_END = r"[.!?…:;\"'”’»)\]][\x20\x09-\x0D]*$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once, also where `body` uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, BLANK), lambda w: w != "")


def without(text: Column, characters: str) -> Column:
    """`text` without these characters. One search for each is far faster than a pattern or a translation table."""
    return reduce(lambda rest, c: F.replace(rest, F.lit(c), F.lit("")), characters, text)


def _count_of(line: Column, characters: str) -> Column:
    return F.length(line) - F.length(without(line, characters))


def solid(text: Column) -> Column:
    """Characters that are no white space."""
    return F.length(without(text, BLANKS))


def line_passes(line: Column, *, short: int = 60, footer: int = 200, symbol_share: float = 0.15) -> Column:
    """Whether a line passes all rules. Blank lines pass.

    Navigation: two separators or more. Punctuation: more than `symbol_share` of the characters are symbols or
    exclamation marks, or a line under `short` characters ends no sentence. Boilerplate: a line under `footer`
    characters holds a phrase of the list.
    """
    length = F.length(line)
    phrase = let(F.lower(line), lambda x: reduce(Column.__or__, [x.contains(p) for p in BOILERPLATE]))
    return ~(
        (_count_of(line, SEPARATORS) >= 2)
        | (_count_of(line, SYMBOLS + "!") > symbol_share * solid(line))
        | ((length < short) & ~line.rlike(SENTENCE_END) & (solid(line) > 0))
        | ((length < footer) & phrase)
    )


def repeated_words(words: Column, width: int = 8) -> Column:
    """Words that lie in windows of `width` words found twice or more, the first ones included; null if there are none.

    Windows are compared by 64-bit hashes of their words. Texts without two equal windows, nearly all, end at one set.
    """
    starts = F.sequence(F.lit(1), F.size(words) - (width - 1))
    hashes = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.transform(starts, lambda i: F.xxhash64(F.slice(h, i, width))))

    def spread(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def positions(s: Column) -> Column:
            same = lambda e, j, d: F.coalesce(F.get(s, j + d)["x"] == e["x"], F.lit(False))
            return F.array_sort(F.filter(F.transform(s, lambda e, j: F.when(same(e, j, -1) | same(e, j, 1), e["i"])), lambda p: p.isNotNull()))

        steps = lambda p: F.transform(p, lambda x, j: F.least(F.lit(width), F.coalesce(F.get(p, j + 1) - x, F.lit(width))))
        total = lambda a: F.aggregate(a, F.lit(0), lambda n, x: n + x)
        return let(ordered, lambda s: let(positions(s), lambda p: total(steps(p))))

    return F.when(
        F.size(words) > width,
        let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), spread(h)).otherwise(F.lit(0))),
    )


def quality_rules(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
    fewest_words: int = 20, most_repeated: int = 30, most_lost: float = 0.5,
) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, clean_text, lost, kept) of every row.

    `clean_text` holds the lines that pass, `lost` the share of characters in words that went with the others. A
    document is kept unless it has too few words, too many repeated ones, or lost more than `most_lost`. Null and empty
    texts have no words, lose nothing and are not kept; repeated rows come back repeated; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    lines = F.split(F.col("text"), "\n")
    full = F.filter(lines, lambda x: solid(x) > 0)
    counted = rows.select(
        id_col,
        "text",
        let(words_of(F.col("text")), lambda w: F.struct(F.size(w).alias("n"), F.coalesce(repeated_words(w), F.lit(0)).alias("r"))).alias("words"),
        solid(F.col("text")).alias("word_chars"),
        _count_of(F.col("text"), SYMBOLS).alias("n_symbols"),
        let(full, lambda x: F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"),
        F.array_join(F.filter(lines, lambda x: line_passes(x)), "\n").alias("clean_text"),
    )
    n, repeated = F.col("words.n"), F.col("words.r")
    lost = F.when(F.col("word_chars") > 0, 1 - solid(F.col("clean_text")) / F.col("word_chars")).otherwise(F.lit(0.0))
    failed = (n < fewest_words) | (100 * repeated > most_repeated * n)
    return counted.select(
        id_col, n.cast("long").alias("n_words"), F.col("word_chars").cast("long"), F.col("n_symbols").cast("long"),
        F.col("n_dup_lines").cast("long"), repeated.cast("long").alias("n_repeat_words"), failed.alias("base_failed"),
        "clean_text", lost.alias("lost"),
    ).withColumn("kept", ~F.col("base_failed") & (F.col("lost") <= most_lost))
