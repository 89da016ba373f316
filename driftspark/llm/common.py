"""Helpers that several operators share: reading Arrow batches, words as arrays of positions and hashes, staging."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Byte values of the words' hash, and odd weights of places within a word; any fixed random numbers do.
_VALUES = np.random.default_rng(20240501).integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_WEIGHTS = np.random.default_rng(20240502).integers(1, 2**64, 4096, dtype=np.uint64) | np.uint64(1)
#: Bytes whose hashes are worked out together, whatever the length of a text.
_BLOCK = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, eager: bool = True) -> DataFrame:
    """`df` written to the folder that the session names in spark.checkpoint.dir, and read from there.

    Where the session names none, as in tests, one is made beside the warehouse.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        context.setCheckpointDir(folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints-{uuid.uuid4().hex}")
    return df.checkpoint(eager)


def held_out(doc_id: Column) -> Column:
    """Whether labels of this document may not be learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def training_labels(labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, y): about `most` labelled documents at most, chosen by a hash of the id; repeated rows count once, by their maximum."""
    rows = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max((F.col(label) > 0).cast("int")).alias("y"))
    )
    n = rows.count()
    if n <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * most / n))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values in one array, and where each value starts (one more than there are values). Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every bit of the result depends on every bit of `x`."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of a batch of texts: `start` and `end` bytes, `doc` they are in, and `first` word of each document.

    `is_word` tells the bytes that belong to words, `lower` maps bytes before that. A word never spans two texts.
    """

    def __init__(self, column: pa.Array, is_word: np.ndarray, lower: np.ndarray | None = None):
        data, offsets = buffers(column)
        self.data = data = lower[data] if lower is not None else data
        inside = np.zeros(len(data) + 1, bool)
        inside[:-1] = is_word[data]
        edge = inside.copy()
        edge[1:] &= ~inside[:-1]  # first byte of a run
        starts_text = offsets[:-1][offsets[:-1] < len(data)]
        edge[starts_text] = inside[starts_text]
        self.start = np.flatnonzero(edge[:-1])
        stop = inside[:-1].copy()
        stop[:-1] &= ~inside[1:-1]
        ends_text = offsets[1:][offsets[1:] > 0] - 1
        stop[ends_text] = inside[ends_text]
        self.end = np.flatnonzero(stop) + 1
        self.doc = np.searchsorted(offsets[1:], self.start, side="right")
        self.first = np.searchsorted(self.doc, np.arange(len(offsets)))
        self.n_docs = len(offsets) - 1

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word; equal words have equal hashes. Worked out block by block, so that a long text
        takes no more memory than its words' places do."""
        total = np.zeros(len(self.start), np.uint64)
        i = 0
        while i < len(total):
            j = max(i + 1, int(np.searchsorted(self.end, self.start[i] + _BLOCK, "right")))
            if j == i + 1:  # a word that may be longer than a block
                for at in range(int(self.start[i]), int(self.end[i]), _BLOCK):
                    part = self.data[at : min(at + _BLOCK, int(self.end[i]))]
                    total[i:j] += (_VALUES[part] * _weights(np.arange(at, at + len(part)) - self.start[i])).sum(dtype=np.uint64)
            else:
                low, high = int(self.start[i]), int(self.end[j - 1])
                place = np.arange(low, high) - np.repeat(self.start[i:j], np.diff(np.append(self.start[i:j], high)))
                value = np.append(_VALUES[self.data[low:high]] * _weights(place), np.uint64(0))
                cuts = np.stack([self.start[i:j], self.end[i:j]], axis=1).ravel() - low
                total[i:j] = np.add.reduceat(value, cuts)[::2]
            i = j
        return mix(total + (self.end - self.start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _weights(place: np.ndarray) -> np.ndarray:
    """An odd number for each place within a word."""
    near = _WEIGHTS[place & 4095]
    return near if not len(place) or int(place.max()) < 4096 else near * (mix(_WEIGHTS[0] * (place >> 12).astype(np.uint64)) | np.uint64(1))


def lower_ascii() -> np.ndarray:
    """A-Z to a-z, all other bytes as they are."""
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    return out


def blank_separated() -> np.ndarray:
    """Bytes of words `[^\\x20\\x09-\\x0D]+`."""
    out = np.ones(256, bool)
    out[[0x20, *range(0x09, 0x0E)]] = False
    return out


def alphanumeric() -> np.ndarray:
    """Bytes of words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`: digits, a-z, and all that isn't ASCII."""
    out = np.zeros(256, bool)
    out[0x30:0x3A] = out[0x61:0x7B] = out[0x80:] = True
    return out


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20):
    """Parts of a batch whose texts take about `most` bytes together, so that work arrays stay small. A long text is a part."""
    sizes = np.diff(buffers(batch.column(batch.schema.get_field_index(column)))[1])
    begin = total = 0
    for i, size in enumerate(sizes.tolist()):
        if total and total + size > most:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += size
    if begin < len(sizes):
        yield batch.slice(begin)


def _least_of_each(batches):
    """Rows (doc_id, h, text, y) with a lesser h than all rows of that document before them in the partition."""
    least: dict = {}
    for batch in batches:
        kept = []
        for i, (one, h) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            if one not in least or h < least[one]:
                least[one] = h
                kept.append(i)
        if kept:
            yield batch.take(pa.array(kept, pa.int64()))


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(text, y) of the documents that `training_labels` chooses, staged in a few partitions: one row for each of them.

    Of a document's rows the one whose text has the least hash counts, whatever their number; each partition sends few.
    The broadcast side is a sample of about `most` rows of 12 bytes, whatever the size of the tables.
    """
    chosen = F.broadcast(training_labels(labels, label, most))
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(chosen, "doc_id")
    rows = rows.select("doc_id", F.xxhash64("text").alias("h"), "text", "y")
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = rows.mapInArrow(_least_of_each, f"doc_id {kind}, h long, text string, y int")
    return staged(rows.groupBy("doc_id").agg(F.min(F.struct("h", "text", "y")).alias("one")).select("one.text", "one.y"))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 40):
    """Logistic regression by Newton steps over a small matrix. Gives centre, scale and weights (the constant last)."""
    centre, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - centre) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return centre, scale, w


def bitmap(rows: DataFrame, hashed: Column, bits: int = 23) -> np.ndarray:
    """2**bits bits, packed, with those of all hashes set. It has that size whatever the number of rows, so it can be
    broadcast; what it lets pass has to be joined exactly.
    """
    bucket = rows.select(F.pmod(hashed, F.lit(1 << bits)).alias("b"))
    groups = bucket.groupBy(F.shiftright("b", 12).alias("high")).agg(F.collect_set(F.col("b").bitwiseAND(4095).cast("int")).alias("low"))
    out = np.zeros(1 << bits, bool)
    for r in groups.toLocalIterator():
        out[(r["high"] << 12) + np.array(r["low"])] = True
    return np.packbits(out)


def in_bitmap(packed: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bit of each 64-bit hash is set."""
    at = hashes.view(np.uint64) & np.uint64(8 * len(packed) - 1)
    return (packed[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & 1 == 1


def split(rows: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is not among `keys` (one column), and rows whose key is. Rows with a null key are not.

    Plain joins: Spark broadcasts few keys, and shuffles the rows once for many.
    """
    name = "key of split"
    keyed, keys = rows.withColumn(name, key), keys.toDF(name).distinct()
    return keyed.join(keys, name, "left_anti").select(rows.columns), keyed.join(keys, name, "left_semi").select(rows.columns)
