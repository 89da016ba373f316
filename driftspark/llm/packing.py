"""Packing of documents into sequences of at most `capacity` tokens.

Linear grouping: lengths of large pieces are rounded up to the largest of their group, groups holding equally many.
Configurations of the few rounded lengths are optimised by column generation; real pieces take the places of their
group, and the small ones then fill what is left, best fit first. All of this is decided on counts by length, which are
bounded by `capacity`; pieces find their places by their rank among pieces of equal length.
"""

from __future__ import annotations

import bisect
import gc
import json
import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftspark.llm.common import staged

REMEMBERED = 600_000
_PIECE = "id {}, piece int, start long, length long, ids_crc32 long, part int, nth long"


class WordEncoder:
    """Ids of texts as the file's own library gives them, as little-endian bytes.

    White space always ends a word for such a tokenizer, so words are encoded once and remembered. Plain words take the
    merges directly; words with digits, apostrophes, special strings or letters that normalisation changes go through
    the library itself.
    """

    def __init__(self, model: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(model)
        self.known: dict[str, bytes] = {}
        read = json.loads(model)["model"]
        names = {chr(b): b for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
        names |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in names.values())}
        self.suffix = read["end_of_word_suffix"]
        self.merger = None
        if self.suffix:
            # the end of a word is a byte that no text holds; joined to a word's last byte before all merges
            end = b"\xff"
            raw = lambda t: bytes(names[c] for c in t.removesuffix(self.suffix)) + end * t.endswith(self.suffix)
            order = [bytes([b]) for b in range(256)] + [bytes([b]) + end for b in range(256)]
            order += [raw(a) + raw(b) for a, b in (m.split(" ") if isinstance(m, str) else m for m in read["merges"])]
            ids = {raw(t): i for t, i in read["vocab"].items()}
            ranks: dict[bytes, int] = {}
            for token in order:
                ranks.setdefault(token, len(ranks))
            self.ids = np.array([ids.get(t, 0) for t in ranks], "<u4")
            self.merger = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def _plain(self, word: str) -> bytes:
        return self.ids[self.merger(word.encode() + b"\xff")].tobytes()

    def word(self, chunk: str) -> bytes:
        if self.merger and (chunk.isascii() or "Σ" not in chunk and unicodedata.is_normalized("NFC", chunk)):
            low = chunk.lower()
            body = low.rstrip(".,")
            if body.isalpha():
                return self._plain(body) + (self._plain(low[len(body) :]) if len(body) < len(low) else b"")
        return np.array(self.library.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        known = self.known
        # these count as blanks for Python alone
        chunks = text.split() if not any(c in text for c in "\x1c\x1d\x1e\x1f") else [c for c in _blank_split(text) if c]
        try:
            return b"".join([known[c] for c in chunks])
        except KeyError:
            if len(known) > REMEMBERED:
                known.clear()
            for c in set(chunks):
                if c not in known:
                    known[c] = self.word(c)
            return b"".join([known[c] for c in chunks])


def _blank_split(text: str) -> list[str]:
    for blank in "\t\n\v\f\r":
        text = text.replace(blank, " ")
    return text.split(" ")


def token_pieces(docs: DataFrame, model: str, capacity: int, end_id: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, part, nth): every document with `end_id` behind it, cut after each `capacity` tokens.

    `nth` counts the pieces of equal length within the task `part`, and so tells them apart without a shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one tokenizer file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordEncoder(shared.value)
        gc.freeze()
        tail, seen, part = np.array([end_id], "<u4").tobytes(), Counter(), TaskContext.get().partitionId()
        for batch in batches:
            rows = []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = encode(text or "") + tail
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    data = ids[at : at + 4 * capacity]
                    n = len(data) // 4
                    rows.append((i, k, at // 4, n, zlib.crc32(data), part, seen[n]))
                    seen[n] += 1
            columns = list(zip(*rows)) or [[]] * 7
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            arrays[0] = batch.column(0).take(arrays[0])
            yield pa.RecordBatch.from_arrays(arrays, ["id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, _PIECE.format(docs.schema[id_col].dataType.simpleString()))


def ranked(rows: DataFrame, length: str) -> DataFrame:
    """`rank` from 0 among the rows of equal length: what earlier parts hold, from counts by part, and `nth` in its own."""
    before = Window.partitionBy(length).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(length, "part").agg(F.count(F.lit(1)).alias("n")).select(length, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    return rows.join(counts, [length, "part"]).withColumn("rank", F.col("earlier") + F.col("nth")).drop("earlier")


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 400) -> list[tuple[int, list[int]]]:
    """(how many, places of each size): sequences that together have a place for all of `demand`.

    Gilmore and Gomory's column generation on the few sizes, rounded down; first fit for the places still wanted.
    """
    k = len(sizes)
    if not k:
        return []
    basis = np.diag([capacity // s for s in sizes]).astype(float)
    want = np.array(demand, float)
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        prices = inverse.sum(axis=0)
        pattern = _best_pattern(sizes, prices, capacity)
        if prices @ pattern <= 1 + 1e-7:
            break
        direction, amounts = inverse @ pattern, inverse @ want
        ratios = np.where(direction > 1e-9, np.maximum(amounts, 0) / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(np.argmin(ratios))
        if not np.isfinite(ratios[out]):
            break
        basis[:, out] = pattern
    amounts = np.linalg.solve(basis, want)
    left, found = list(demand), []
    for j, amount in enumerate(amounts):
        places = [int(x) for x in basis[:, j]]
        n = min([int(amount + 1e-9)] + [left[g] // p for g, p in enumerate(places) if p])
        if n > 0:
            found.append((n, places))
            left = [x - n * p for x, p in zip(left, places)]
    while any(left):  # each turn uses up a size or more, as often as the same sequence can be made
        places, room = [0] * k, capacity
        for g in range(k):
            places[g] = min(left[g], room // sizes[g])
            room -= places[g] * sizes[g]
        n = min(left[g] // p for g, p in enumerate(places) if p)
        found.append((n, places))
        left = [x - n * p for x, p in zip(left, places)]
    return found


def _best_pattern(sizes: list[int], prices: np.ndarray, capacity: int) -> np.ndarray:
    """The places of the greatest total price in one sequence: a knapsack over sums of rounded sizes."""
    worth, size = prices.clip(0), np.array(sizes)
    use = np.flatnonzero(worth > 1e-12)
    best, chosen = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = use[np.argsort(-worth[use] / size[use])]
    # one more place each turn; a sequence holds few large pieces
    total = np.full(capacity + 1, -np.inf)
    total[0] = 0.0
    steps = []
    for _ in range(capacity // int(size.min())):
        after, what = np.full(capacity + 1, -np.inf), np.full(capacity + 1, -1)
        for g in order:
            moved = total[: capacity + 1 - size[g]] + worth[g]
            better = moved > after[size[g] :]
            after[size[g] :][better] = moved[better]
            what[size[g] :][better] = g
        if not np.isfinite(after).any():
            break
        steps.append(what)
        improved = after > best
        best[improved], chosen[improved] = after[improved], len(steps)
        total = after
    at = int(np.argmax(best))
    pattern = np.zeros(len(sizes))
    for level in range(chosen[at], 0, -1):
        g = steps[level - 1][at]
        pattern[g] += 1
        at -= int(size[g])
    return pattern


def large_places(histogram: dict[int, int], capacity: int, groups: int) -> tuple[np.ndarray, int]:
    """Rows (first rank, one past the last, first sequence) over large pieces ranked from the longest; number of sequences."""
    lengths = sorted(histogram, reverse=True)
    total = sum(histogram.values())
    sizes, demand, done, edge = [], [], 0, 0
    for n in lengths:  # equally many in each group; a length may belong to two
        stop = done + histogram[n]
        while done < stop:
            if done >= edge:
                sizes.append(n)
                demand.append(0)
                edge = max(done + 1, -(-total * len(sizes) // groups))
            take = min(stop, edge) - done
            demand[-1] += take
            done += take
    starts = np.cumsum([0, *demand]).tolist()
    rows, sequences = [], 0
    for n, places in configurations(sizes, demand, capacity):
        for g, p in enumerate(places):
            for _ in range(p):
                rows.append((starts[g], starts[g] + n, sequences))
                starts[g] += n
        sequences += n
    return np.array(sorted(rows), np.int64).reshape(-1, 3), sequences


def small_places(histogram: dict[int, int], room: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, one past the last, room, first sequence of that room), longest pieces first into the least room that holds them.

    Sequences with equal room are moved together, so the work depends on the number of lengths, not of pieces. New
    sequences have the room -1.
    """
    parts: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # by what is left: room, first, one past the last
    for r, n in room.items():
        if n and r:
            parts[r].append((r, 0, n))
    levels = sorted(parts)
    rows, fresh = [], 0
    for size in sorted(histogram, reverse=True):
        rank, left = 0, histogram[size]
        while left:
            at = bisect.bisect_left(levels, size)
            if at == len(levels):
                n = -(-left // (capacity // size))
                parts[capacity].append((-1, fresh, fresh + n))
                fresh += n
                levels.append(capacity)
                continue
            level = levels[at]
            source, first, stop = parts[level].pop()
            n = min(left, stop - first)
            if first + n < stop:
                parts[level].append((source, first + n, stop))
            elif not parts[level]:
                levels.pop(at)
            rows.append((size, rank, rank + n, source, first))
            rank, left = rank + n, left - n
            if level > size:
                if not parts[level - size]:
                    bisect.insort(levels, level - size)
                parts[level - size].append((source, first, first + n))
    return np.array(rows, np.int64).reshape(-1, 5)


def _histogram(rows: DataFrame, column: str) -> dict[int, int]:
    """Counts by a number of at most `capacity` values."""
    return {int(r[column]): r["n"] for r in rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")).collect()}


def pack(
    docs: DataFrame, model: str, *, capacity: int = 4096, end_id: int = 1, large_from: int = 640, groups: int = 40,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every row.

    Null and empty texts are one piece of the end id alone. Rows are packed each for itself, repeated ones too; an empty
    table gives no sequence; other columns are not read.
    """
    spark = docs.sparkSession
    pieces = staged(token_pieces(docs, model, capacity, end_id, id_col=id_col, text_col=text_col))
    counts = _histogram(pieces, "length")
    full = counts.get(capacity, 0)
    large = {n: c for n, c in counts.items() if large_from <= n < capacity}
    small = {n: c for n, c in counts.items() if n < large_from}
    places, sequences = large_places(large, capacity, groups)
    above = {}  # large pieces longer than a length
    for n in sorted(large, reverse=True):
        above[n] = sum(c for m, c in large.items() if m > n)
    shift = np.zeros(capacity + 1, np.int64)
    for n, c in above.items():
        shift[n] = c
    table = spark.sparkContext.broadcast((places, shift))  # a few places for each of `groups` sizes

    @F.arrow_udf("long")
    def sequence_of(length: pa.Array, rank: pa.Array) -> pa.Array:
        places, shift = table.value
        n, at = np.asarray(length), np.asarray(rank)
        at = at + shift[n]
        k = np.searchsorted(places[:, 0], at, side="right") - 1
        return pa.array(places[k, 2] + at - places[k, 0] + full)

    ordered = ranked(pieces, "length")
    is_large = (F.col("length") >= large_from) & (F.col("length") < capacity)
    columns = ["id", "piece", "start", "length", "ids_crc32", "sequence_id"]
    placed = [ordered.where(F.col("length") == capacity).withColumn("sequence_id", F.col("rank")).select(columns)]
    if large:
        placed.append(ordered.where(is_large).withColumn("sequence_id", sequence_of("length", "rank")).select(columns))
    if small:
        rooms = _rooms(placed[-1], capacity) if large else None
        steps = small_places(small, _histogram(rooms, "room") if large else {}, capacity)
        filled = spark.sparkContext.broadcast(steps[np.lexsort((steps[:, 1], steps[:, 0]))])

        @F.arrow_udf("room long, number long")
        def target(length: pa.Array, rank: pa.Array) -> pa.Array:
            rows = filled.value
            wide = np.int64(1) << 48
            n, at = np.asarray(length), np.asarray(rank)
            k = np.searchsorted(rows[:, 0] * wide + rows[:, 1], n * wide + at, side="right") - 1
            return pa.StructArray.from_arrays([pa.array(rows[k, 3]), pa.array(rows[k, 4] + at - rows[k, 1])], ["room", "number"])

        rest = ordered.where(F.col("length") < large_from).withColumn("t", target("length", "rank")).select("*", "t.room", "t.number")
        placed.append(rest.where("room = -1").withColumn("sequence_id", F.col("number") + (full + sequences)).select(columns))
        if large:
            numbered = ranked(rooms, "room").select("room", F.col("rank").alias("number"), "sequence_id")
            placed.append(rest.where("room >= 0").join(numbered, ["room", "number"]).select(columns))
    out = placed[0]
    for more in placed[1:]:
        out = out.unionByName(more)
    before = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "id", "piece", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")).withColumnRenamed("id", id_col)


def _rooms(placed: DataFrame, capacity: int) -> DataFrame:
    """(sequence_id, room, part, nth) of each sequence with large pieces, staged."""
    used = placed.groupBy("sequence_id").agg((capacity - F.sum("length")).alias("room"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, part = Counter(), TaskContext.get().partitionId()
        for batch in batches:
            nth = []
            for r in batch.column(1).to_pylist():
                nth.append(seen[r])
                seen[r] += 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([part] * len(nth), pa.int32()), pa.array(nth, pa.int64())], ["sequence_id", "room", "part", "nth"]
            )

    return staged(used.mapInArrow(run, "sequence_id long, room long, part int, nth long"))
