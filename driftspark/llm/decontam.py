"""Benchmark decontamination by winnowing.

Of every `window` words in a row, a text keeps the k-gram of the least hash. Two texts that share such a span keep the
same k-gram of it, so a join of kept k-grams finds every shared span; hits are then extended word by word. Items shorter
than a window are looked up whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftspark.llm.common import Words, alphanumeric, bitmap, in_bitmap, lower_ascii, mix, slices, split, staged

_ROW = "fp long, mid string, before array<string>, after array<string>"
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _grams(key: np.ndarray, k: int) -> np.ndarray:
    """A hash of every `k` neighbours, by their first position; the last k - 1 positions have none."""
    n = len(key) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = key[:n].copy()
    for j in range(1, k):
        total = total * _STEP + key[j : j + n]
    return mix(total + np.uint64(k))


class Fingerprints:
    """Kept k-grams of a batch of texts, and where runs of `length` words start."""

    def __init__(self, column: pa.Array, window: int, k: int):
        self.words = words = Words(column, alphanumeric(), lower_ascii())
        self.key = words.hashes()
        self.left = words.first[words.doc + 1] - np.arange(len(words.doc))  # words from here to the end of the text
        self.window, self.k = window, k

    def kept(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of the k-grams that a window keeps: the least, of equal ones the last."""
        grams, span = _grams(self.key, self.k), self.window - self.k + 1
        n = len(grams) - span + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        least = grams[:n].copy()
        for j in range(1, span):
            np.minimum(least, grams[j : j + n], out=least)
        keep = np.zeros(len(grams), bool)
        done = self.left[:n] < self.window
        for j in range(span - 1, -1, -1):
            here = ~done & (grams[j : j + n] == least)
            keep[j : j + n] |= here
            done |= here
        at = np.flatnonzero(keep)
        return at, grams[at]

    def runs(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        grams = _grams(self.key, length)
        at = np.flatnonzero(self.left[: len(grams)] >= length)
        return at, mix(grams[at] ^ _STEP)

    def text(self, first: int, stop: int) -> list[str]:
        w = self.words
        return [w.data[w.start[i] : w.end[i]].tobytes().decode() for i in range(first, stop)]

    def around(self, at: int) -> tuple[str, list[str], list[str]]:
        """The k-gram, the words before it (nearest first) and after it, as far as a window that holds it reaches."""
        w, reach = self.words, self.window - self.k
        low, high = w.first[w.doc[at]], w.first[w.doc[at] + 1]
        return (
            " ".join(self.text(at, at + self.k)),
            self.text(max(low, at - reach), at)[::-1],
            self.text(at + self.k, min(high, at + self.k + reach)),
        )


def item_fingerprints(items: DataFrame, window: int, k: int, id_col: str, text_col: str) -> DataFrame:
    """(item, length, fp, mid, before, after): length is that of an item shorter than a window, else 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                prints = Fingerprints(part.column(1), window, k)
                first, ids, rows = prints.words.first, part.column(0).to_pylist(), []
                for at, fp in zip(*(x.tolist() for x in prints.kept())):
                    rows.append((ids[prints.words.doc[at]], 0, fp, *prints.around(at)))
                for length in range(1, window):
                    for at, fp in zip(*(x.tolist() for x in prints.runs(length))):
                        doc = prints.words.doc[at]
                        if first[doc + 1] - first[doc] == length:
                            rows.append((ids[doc], length, fp, " ".join(prints.text(at, at + length)), [], []))
                columns = list(zip(*rows)) or [[]] * 6
                types = [pa.string(), pa.int32(), pa.uint64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]
                arrays = [pa.array(c, t) for c, t in zip(columns, types)]
                arrays[2] = pa.array(np.array(columns[2], np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays(arrays, ["item", "length", "fp", "mid", "before", "after"])

    rows = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"item string, length int, {_ROW}")


def _row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col).cast("string"), F.col(text_col).cast("string"), F.length(F.col(text_col).cast("string")))


def document_candidates(docs: DataFrame, bits: np.ndarray, lengths: list[int], window: int, k: int, id_col: str, text_col: str) -> DataFrame:
    """(id, row, n_words, found): a row per document, with what the bitmap lets pass, equal ones of a document once."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        kind = pa.struct([("length", pa.int32()), ("fp", pa.int64()), ("mid", pa.string()), ("before", pa.list_(pa.string())), ("after", pa.list_(pa.string())), ("at", pa.list_(pa.int32()))])
        for batch in batches:
            for part in slices(batch, "text"):
                prints = Fingerprints(part.column(2), window, k)
                words, found = prints.words, [{} for _ in range(part.num_rows)]
                for length in [0, *lengths]:
                    at, fp = prints.runs(length) if length else prints.kept()
                    ok = in_bitmap(bits, fp)
                    for i, x in zip(at[ok].tolist(), fp[ok].view(np.int64).tolist()):
                        doc = words.doc[i]
                        mid, before, after = prints.around(i) if not length else (" ".join(prints.text(i, i + length)), [], [])
                        found[doc].setdefault((length, x, mid, tuple(before), tuple(after)), []).append(int(i - words.first[doc]))
                rows = [[dict(zip(("length", "fp", "mid", "before", "after", "at"), (*key, at))) for key, at in d.items()] for d in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(np.diff(words.first).astype(np.int64)), pa.array(rows, pa.list_(kind))], ["id", "row", "n_words", "found"]
                )

    rows = docs.select(F.col(id_col).alias("id"), _row_key(id_col, text_col).alias("row"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, row long, n_words long, found array<struct<length:int,fp:long,mid:string,before:array<string>,after:array<string>,at:array<int>>>"
    return rows.mapInArrow(run, schema)


def _shared_run(a: Column, b: Column) -> Column:
    """How many values two arrays have in common at their beginnings."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    at = F.array_position(same, False)
    return F.when(at == 0, F.size(same)).otherwise(at - 1).cast("int")


def _covered(spans: Column) -> Column:
    """Positions that spans (s, e), in order of s, cover together."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda done, x: F.struct(
        F.greatest(done["end"], x["e"]).alias("end"), (done["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], done["end"]))).alias("n")
    )
    return F.aggregate(spans, start, step)["n"].cast("long")


def contamination(
    docs: DataFrame, items: DataFrame, *, window: int = 10, k: int = 5, bits: int = 23,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """(id, row, n_words, n_hit, spans, items) of every row of `docs`.

    A word is hit if it lies in `window` words in a row that an item holds too, or in a whole item of fewer words.
    `spans` are the (s, e) of hit words, `items` the sorted ids, as strings, of items found; `row` tells rows apart that
    differ in id or text. Null and empty texts have no words and are never hit; so are all where there are no items.
    Repeated rows come back repeated; a null item id hits words and is not listed; other columns are not read.
    """
    prints = staged(item_fingerprints(items, window, k, item_col, item_text_col))
    lengths = [r["length"] for r in prints.where("length > 0").select("length").distinct().orderBy("length").collect()]  # under `window` numbers
    contexts = prints.groupBy("length", "fp", "mid", "before", "after").agg(F.collect_set("item").alias("items")).withColumnsRenamed({"before": "b", "after": "a", "mid": "m"})
    base = staged(document_candidates(docs, bitmap(prints, F.col("fp"), bits), lengths, window, k, id_col, text_col))
    found = base.select("row", F.explode("found").alias("x")).select("row", "x.*").dropDuplicates(["row", "length", "fp", "mid", "before", "after"])
    left, right = F.when(F.col("length") == 0, _shared_run(F.col("before"), F.col("b"))).otherwise(0), F.when(F.col("length") == 0, _shared_run(F.col("after"), F.col("a"))).otherwise(0)
    size = F.when(F.col("length") == 0, F.lit(k)).otherwise(F.col("length"))
    hits = (
        found.join(contexts, ["length", "fp"]).where("mid = m")
        .select("row", "at", "items", left.alias("left"), (size + right).alias("right"), "length")
        .where((F.col("length") > 0) | (F.col("left") + F.col("right") >= window))
    )
    spans = hits.select("row", F.explode("at").alias("p"), "left", "right").groupBy("row").agg(
        F.array_sort(F.collect_set(F.struct((F.col("p") - F.col("left")).alias("s"), (F.col("p") + F.col("right")).alias("e")))).alias("spans")
    )
    listed = hits.select("row", F.explode("items").alias("item")).groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    none = lambda name, kind: F.coalesce(F.col(name), F.array().cast(kind)).alias(name)
    return (
        base.select("id", "row", "n_words").join(spans, "row", "left").join(listed, "row", "left")
        .select(F.col("id").alias(id_col), "row", "n_words", F.coalesce(_covered(F.col("spans")), F.lit(0)).cast("long").alias("n_hit"),
                none("spans", "array<struct<s:int,e:int>>"), none("items", "array<string>"))
    )


def without_contaminated(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` without a hit word, all columns as they are, whatever their names.

    Null and empty texts are never hit and stay, as do all rows where there are no items; rows equal in id and text stay
    or go together, and repeated rows stay repeated; rows with a null id are judged like others; an empty table stays empty.
    """
    hit = contamination(docs, items, id_col=id_col, text_col=text_col, **options).where("n_hit > 0").select("row").distinct()
    return split(docs, _row_key(id_col, text_col), hit)[0]
