"""Quality scores from statistics of documents.

Random Fourier features approximate a Gaussian kernel over the statistics. Each partition adds up its part of the
normal equations; the sums are solved for ridge weights, and scores are calibrated by isotonic regression.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftspark.llm.common import Words, blank_separated, buffers, labelled, slices

STATISTICS = (
    "log_words", "word_length", "distinct_words", "repeated_neighbours", "distinct_triples", "upper", "digits",
    "symbols", "exclamations", "bars", "stops", "log_lines", "line_words", "distinct_lines",
)


def _classes() -> np.ndarray:
    """One row for each class of bytes: upper case, digits, symbols, exclamation marks, bars, sentence ends."""
    out = np.zeros((6, 256), np.uint8)
    for k, chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#*$%&<>{}[]\\^~=_@", "!", "|", ".,;:?")):
        out[k, [ord(c) for c in chars]] = 1
    return out


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _distinct(doc: np.ndarray, key: np.ndarray, n_docs: int) -> np.ndarray:
    order = np.lexsort((key, doc))
    d, k = doc[order], key[order]
    first = np.ones(len(d), bool)
    first[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1])
    return np.bincount(d[first], minlength=n_docs)


def statistics(column: pa.Array) -> np.ndarray:
    """A row of STATISTICS for each text; empty and null texts have zeros."""
    words = Words(column, blank_separated())
    data, offsets = buffers(column)
    n = words.n_docs
    n_words = np.diff(words.first)
    some = np.maximum(n_words, 1)
    size = np.maximum(_sums((data & 0xC0) != 0x80, offsets), 1)
    key, doc = words.hashes(), words.doc
    beside = np.zeros(len(key), bool)
    beside[1:] = (key[1:] == key[:-1]) & (doc[1:] == doc[:-1])
    triple = np.zeros(len(key), np.uint64)
    if len(key) > 2:
        triple[2:] = key[2:] * np.uint64(3) + key[1:-1] * np.uint64(0x9E3779B97F4A7C15) + key[:-2] * np.uint64(0xC2B2AE3D27D4EB4F)
    in_doc = np.arange(len(key)) - words.first[doc] >= 2
    lines = Words(column, np.arange(256) != 10)
    per_line = np.maximum(np.diff(lines.first), 1)
    letters = np.zeros(n)
    np.add.at(letters, doc, words.end - words.start)
    shares = [_sums(c[data], offsets) / size for c in _classes()]
    return np.column_stack([
        np.log1p(n_words), letters / some / 5, _distinct(doc, key, n) / some, np.bincount(doc[beside], minlength=n) / some,
        _distinct(doc[in_doc], triple[in_doc], n) / np.maximum(n_words - 2, 1), *shares, np.log1p(np.diff(lines.first)),
        np.log1p(n_words / per_line), _distinct(lines.doc, lines.hashes(), n) / per_line,
    ])


@dataclass
class Model:
    centre: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -6, 6)
        waves = np.cos(z @ self.frequencies + self.phases) * np.sqrt(2 / len(self.phases))
        return np.c_[waves, np.ones(len(x))]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.features(x) @ self.weights, self.knots, self.values)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means of pooled neighbours (pool adjacent violators), at the means of their `x`; between them scores are interpolated."""
    order = np.lexsort((y, x))
    pools: list[list[float]] = []
    for a, b in zip(x[order].tolist(), y[order].tolist()):
        pools.append([a, b, 1.0])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last)]
    at = np.array([p[0] / p[2] for p in pools])
    # a pool of n rows without an exception is not proof: one row of each kind is added to what it is drawn to
    mean = np.array([(p[1] + 0.5) / (p[2] + 1) for p in pools])
    return at, np.clip(np.maximum.accumulate(mean), 0, 1)


def _normal_equations(sample: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all rows of z z' and z y. A partition sends one matrix, by rows; each row is added up in a group of its own."""
    size = len(model.phases) + 1

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            for piece in slices(batch, "text"):
                z = model.features(statistics(piece.column(0)))
                y = piece.column(1).to_numpy(zero_copy_only=False).astype(float)
                total += np.c_[z.T @ z, z.T @ y]
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "v"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": [group["i"].iloc[0]], "v": [np.sum(np.stack(sorted(group["v"].tolist(), key=lambda v: v.tolist())), axis=0)]})

    rows = sample.select("text", "y").mapInArrow(part, "i int, v array<double>").groupBy("i").applyInPandas(add, "i int, v array<double>").collect()
    full = np.array([r["v"] for r in sorted(rows, key=lambda r: r["i"])])
    return full[:, :-1], full[:, -1]


def fit(docs: DataFrame, labels: DataFrame, *, most: int = 12_000, waves: int = 192, width: float = 3.0, ridge: float = 1e-3, seed: int = 7) -> Model | None:
    """Fit on about `most` labelled documents; one in four of them, by a hash of the text, calibrates. None without both labels."""
    sample = labelled(docs, labels, "quality", most).withColumn("part", F.pmod(F.xxhash64("text"), F.lit(4)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                x = statistics(piece.column(0))
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), piece.column(1)], ["x", "y"])

    learn, rest = sample.where("part > 0").select("text", "y"), sample.where("part = 0").select("text", "y")
    moments = learn.mapInArrow(read, "x array<double>, y int").select(F.posexplode("x").alias("k", "v"), "y").groupBy("k").agg(
        F.avg("v").alias("centre"), F.stddev_pop("v").alias("scale"), F.min("y").alias("low"), F.max("y").alias("high")
    ).orderBy("k").collect()
    if not moments or moments[0]["low"] == moments[0]["high"]:
        return None
    random = np.random.default_rng(seed)
    model = Model(
        np.array([r["centre"] for r in moments]), np.array([max(r["scale"], 1e-3) for r in moments]),
        random.normal(size=(len(STATISTICS), waves)) / width, random.uniform(0, 2 * np.pi, waves), np.zeros(waves + 1), np.zeros(1), np.zeros(1),
    )
    left, right = _normal_equations(learn, model)
    model.weights = np.linalg.solve(left + ridge * max(left[-1, -1], 1) * np.eye(waves + 1), right)
    held = rest.mapInArrow(read, "x array<double>, y int").collect()  # a fourth of the sample
    if not held:
        held = learn.mapInArrow(read, "x array<double>, y int").collect()
    held.sort(key=lambda r: (r["x"], r["y"]))
    x, y = np.array([r["x"] for r in held]), np.array([r["y"] for r in held], float)
    model.knots, model.values = isotonic(model.features(x) @ model.weights, y)
    return model


def quality(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every whole text, from 0 to 1.

    Null and empty texts have statistics of zero and a score like any other; without a model all scores are 0.5;
    repeated rows come back repeated; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for piece in slices(batch, "text"):
                scores = np.full(len(piece), 0.5) if model is None else np.clip(model.scores(statistics(piece.column(1))), 0, 1)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(scores, pa.float64())], ["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)
