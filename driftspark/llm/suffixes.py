"""Removal of repeated byte strings by suffix arrays.

A byte goes if a string of `length` bytes that covers it also starts anywhere else. Every window of `length` bytes picks
its gram of the least hash; windows that pick the same gram in a row are one context. Equal strings pick equal grams, so
only contexts of grams that occur twice can hold a repeat, and they meet by their gram. A gram with one context repeats as
a whole. The others are sorted as suffixes: two-stage sorting orders the suffixes smaller than their successors directly,
induces the rest by scans over buckets, and adjacent common prefixes tell what repeats.

A gram with more contexts than a task should hold is split exactly: a string of `length` bytes around it reaches at least
half of the missing bytes to the left or to the right, so contexts are dealt by those bytes, clipped to the strings that
hold them, and so on; after some ten rounds all contexts of a group are equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftspark.llm.common import buffers, mix, staged

_VALUES = np.random.default_rng(77).integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_ODD = np.random.default_rng(78).integers(1, 2**64, 64, dtype=np.uint64) | np.uint64(1)
#: Bytes that are looked at together; longer texts are cut into such blocks, which overlap by a window.
_BLOCK = 1 << 18
_PLACE = np.uint64((1 << 20) - 1)


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the `gram` bytes (a power of two) from each position on."""
    h, width = _VALUES[data], 1
    while width < gram:
        h = h[: max(0, len(h) - width)] * _ODD[width.bit_length()] + h[width:]
        width *= 2
    return mix(h)


def _least(v: np.ndarray, span: int) -> np.ndarray:
    """The least of each `span` neighbours, by doubling."""
    if len(v) < span:
        return v[:0]
    width = 1
    while 2 * width <= span:
        v = np.minimum(v[:-width], v[width:])
        width *= 2
    rest = span - width
    return np.minimum(v[:-rest], v[rest:]) if rest else v


def contexts(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows that pick the same gram: text, first window, last window, place of the gram (all but the text as
    bytes of the whole buffer) and the gram's hash. Of equal hashes the first one is picked."""
    span = length - gram + 1
    h = _gram_hashes(data, gram)
    picked = _least((h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), span)
    if not len(picked):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    picked = (picked & _PLACE).astype(np.int64)
    edge = np.zeros(len(data) + 1, np.int32)
    starts, ends = offsets[:-1], offsets[1:]
    long = ends - starts >= length
    np.add.at(edge, starts[long], 1)
    np.add.at(edge, ends[long] - length + 1, -1)
    inside = np.cumsum(edge)[: len(picked)] > 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | (picked[1:] != picked[:-1])
    begins[np.minimum(starts[long], len(picked) - 1)] = True  # texts of one window have no gap between them
    first = np.flatnonzero(begins)
    stops = np.append(first[1:], len(picked))
    text = np.searchsorted(offsets, first, "right") - 1
    last = np.minimum(stops - 1, ends[text] - length)
    place = picked[first]
    return text, first, last, place, h[place].view(np.int64)


def _blocks(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """Parts of a buffer: first text, byte to begin at, byte to end before, and where its texts begin. A text that is
    longer than a block is cut at the same places wherever it is; each part has all of its windows that begin in it."""
    n, i = len(offsets) - 1, 0
    while i < n:
        size = int(offsets[i + 1] - offsets[i])
        if size > _BLOCK:
            for at in range(0, size - length + 1, _BLOCK):
                begin, stop = int(offsets[i]) + at, int(offsets[i]) + min(size, at + _BLOCK + length - 1)
                yield i, begin, stop, np.array([0, stop - begin])
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + _BLOCK, "right")) - 1)
        yield i, int(offsets[i]), int(offsets[j]), offsets[i : j + 1] - offsets[i]
        i = j


def _marks(length: int, gram: int):
    """Of each text: its contexts as (gram's hash, digest of the context, place packed in one number). A text that a task
    has met twice adds nothing any more: it repeats as a whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[tuple[int, int], int] = {}
        for batch in batches:
            keep = []
            k1, k2 = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, key in enumerate(zip(k1, k2)):
                met[key] = n = met.get(key, 0) + 1
                if n <= 2:
                    keep.append(i)
            data, offsets = buffers(batch.column(2).take(pa.array(keep, pa.int64())))
            found: dict[int, list] = {}
            for i, begin, stop, inner in _blocks(data, offsets, length):
                text, first, last, place, fp = contexts(part := data[begin:stop], inner, length, gram)
                view = memoryview(part)
                digest = [hashlib.blake2b(view[a:b], digest_size=8).digest() for a, b in zip(first.tolist(), (last + length).tolist())]
                digest = np.frombuffer(b"".join(digest), np.int64)
                # where the first window begins in its text, how far the gram is from it, and how many windows follow
                at = first - inner[text] + (begin - int(offsets[i]) if len(inner) == 2 else 0)
                packed = at << 24 | (place - first) << 12 | (last - first)
                edges = np.flatnonzero(np.diff(text, prepend=-1, append=-1)) if len(text) else []
                for a, b in zip(edges[:-1], edges[1:]):
                    found.setdefault(i + int(text[a]), []).append((fp[a:b], digest[a:b], packed[a:b]))
            if found:
                lists = [[np.concatenate([p[c] for p in parts]) for parts in found.values()] for c in range(3)]
                at = [keep[i] for i in found]
                kind = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k1[i] for i in at], pa.int64()), pa.array([k2[i] for i in at], pa.int64()), *[pa.array(x, kind) for x in lists]],
                    ["k1", "k2", "fp", "ctx", "place"],
                )

    return run


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as a number that compares like them; zeros follow the end."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    out = np.zeros(len(text), np.uint64)
    for j in range(8):
        out |= padded[j : j + len(text)].astype(np.uint64) << np.uint64(56 - 8 * j)
    return out


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes of a byte array, in order by their first `depth` bytes at least, by two-stage sorting.

    A suffix smaller than its successor is sorted directly, by eight bytes a round, and only groups whose next bytes
    differ are sorted again. Any other one is larger than its successor, so a scan over the buckets in order meets the
    successor first and puts it behind those of its bucket that it has put there already.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    # Whether a suffix is smaller than its successor: the end of its run of equal bytes decides; the last one is larger.
    differs = np.append(text[1:] != text[:-1], True)
    ends = np.flatnonzero(differs)
    rises = np.append(text[ends[:-1]] < text[ends[:-1] + 1], False)
    small = np.repeat(rises, np.diff(ends, prepend=-1))
    direct = _sorted_directly(text, np.flatnonzero(small), depth)
    starts = np.searchsorted(text[direct], np.arange(257))
    larger: list[list[np.ndarray]] = [[] for _ in range(256)]
    larger[text[n - 1]].append(np.array([n - 1]))  # the successor of the last one is empty, the least of all
    out: list[np.ndarray] = []
    for c in range(256):
        waves = []
        wave = np.concatenate(larger[c]) if larger[c] else None
        larger[c] = []
        while wave is not None and len(wave):  # members of the bucket whose successor is in it too
            waves.append(wave)
            before = wave[wave > 0] - 1
            wave = before[text[before] == c]
        order = np.concatenate([*waves, direct[starts[c] : starts[c + 1]]])
        out.append(order)
        before = order[order > 0] - 1
        before = before[~small[before] & (text[before] != c)]
        if len(before):
            bucket = text[before]
            by = np.argsort(bucket, kind="stable")
            before, bucket = before[by], bucket[by]
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=256).astype(bool))
            for a, b in zip(cuts[:-1], cuts[1:]):
                larger[bucket[a]].append(before[a:b])
    return np.concatenate(out)


def _sorted_directly(text: np.ndarray, suffixes: np.ndarray, depth: int) -> np.ndarray:
    words = _words(text)
    word = lambda at: np.where(at < len(words), words[np.minimum(at, len(words) - 1)], 0)
    key = words[suffixes]
    by = np.argsort(key, kind="stable")
    order, key = suffixes[by], key[by]
    # groups of suffixes equal so far, as positions in `order` and the group's number
    where, group = _tied(np.arange(len(order)), np.zeros(len(order), np.int64), key)
    for at in range(8, depth, 8):
        if not len(where):
            break
        key = word(order[where] + at)
        first = np.flatnonzero(np.diff(group, prepend=-1))
        sizes = np.diff(np.append(first, len(group)))
        unlike = np.add.reduceat(key != np.repeat(key[first], sizes), first) > 0
        if not unlike.any():
            continue
        moved = np.repeat(unlike, sizes)
        part, part_key, part_group = where[moved], key[moved], group[moved]
        by = np.lexsort((part_key, part_group))
        order[part] = order[part][by]
        key[moved] = part_key[by]
        where, group = _tied(where, group, key)
    return order


def _tied(where: np.ndarray, group: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions that still share group and key with a neighbour, and new numbers of their groups."""
    if not len(where):
        return where, group
    new = np.ones(len(where), bool)
    new[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
    alone = new & np.append(new[1:], True)
    return where[~alone], np.cumsum(new)[~alone]


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Of each neighbours in `order`: how many bytes they share from their beginnings, in steps of eight below `depth`."""
    words = _words(text)
    a, b = order[:-1], order[1:]
    shared = np.zeros(len(a), np.int64)
    going = np.arange(len(a))
    for at in range(0, depth, 8):
        x, y = a[going] + at, b[going] + at
        ok = (x < len(text)) & (y < len(text))
        going, x, y = going[ok], x[ok], y[ok]
        unlike = words[x] ^ words[y]
        if depth - at < 8:
            unlike >>= np.uint64(8 * (8 - (depth - at)))
        equal = unlike == 0
        shared[going[equal]] = min(at + 8, depth)
        going = going[equal]
        if not len(going):
            break
    return shared


def repeated(bodies: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """Of each body the spans that strings of `length` bytes cover which start elsewhere in it or another one as well.

    Bodies are UTF-8 or cut out of it, so a byte that is never in it keeps them apart.
    """
    text = np.frombuffer(b"\xff".join(bodies), np.uint8)
    sizes = np.array([len(b) for b in bodies])
    begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    order = suffix_array(text, length)
    owner = np.repeat(np.arange(len(bodies)), sizes + 1)[: len(text)]
    order = order[order + length <= (begins + sizes)[owner[order]]]
    same = common_prefixes(text, order, length) >= length
    hit = np.zeros(len(order), bool)
    hit[:-1] |= same
    hit[1:] |= same
    starts = np.sort(order[hit])
    spans: list[list[tuple[int, int]]] = [[] for _ in bodies]
    for body, at in zip(owner[starts].tolist(), (starts - begins[owner[starts]]).tolist()):
        mine = spans[body]
        if mine and at <= mine[-1][1]:
            mine[-1] = mine[-1][0], at + length
        else:
            mine.append((at, at + length))
    return spans


def _by_suffixes(length: int, together: int = 4 << 20):
    """Rows (key, ctx, body) in order of key to (key, ctx, s, e): groups are sorted together, some MB at a time."""

    def solve(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        bodies = [body for _, _, body in rows]
        out = [(key, ctx, s, e) for (key, ctx, _), spans in zip(rows, repeated(bodies, length)) for s, e in spans]
        columns = list(zip(*out)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["key", "ctx", "s", "e"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, bytes]] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if rows and row[:2] == rows[-1][:2]:
                    continue  # another copy of the text brought it
                if size > together and row[0] != rows[-1][0]:
                    yield solve(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[2])
        if rows:
            yield solve(rows)

    return run


def _sorted_groups(bodies: DataFrame, length: int) -> DataFrame:
    """(key, ctx, s, e) of contexts (key, ctx, body); all of a key meet in one task, which takes keys one after the other."""
    partitions = int(bodies.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = bodies.select("key", "ctx", "body").repartition(partitions, "key").sortWithinPartitions("key", "ctx")
    return rows.mapInArrow(_by_suffixes(length), "key long, ctx long, s int, e int")


def _cut_out(length: int):
    """Contexts of each text (k1, k2, text, wanted), once for each text in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = set()
        for batch in batches:
            k1, k2, wanted = (batch.column(i).to_pylist() for i in (0, 1, 3))
            out = []
            for i, key in enumerate(zip(k1, k2)):
                if key in met:
                    continue
                met.add(key)
                text = batch.column(2)[i].as_py().encode()
                for w in wanted[i]:
                    at, gram, more = w["place"] >> 24, w["place"] >> 12 & 4095, w["place"] & 4095
                    out.append((w["fp"], w["ctx"], w["n"], w["hot"], gram, text[at : at + more + length]))
            columns = list(zip(*out)) or [[]] * 6
            types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["fp", "ctx", "n", "hot", "at", "body"])

    return run


def _split(rows: DataFrame, length: int, gram: int, reach: int) -> DataFrame:
    """Each context by the `reach` bytes before what its group shares and by those behind, clipped to the strings that hold them.

    `at` is where the gram begins in the body; the group shares it and `l` and `r` bytes around it.
    """
    size = F.length("body")
    stop = F.least(size - length, F.col("at") - F.col("l") - reach)
    left = rows.withColumn("stop", stop).where("stop >= 0").select(
        F.xxhash64("key", F.lit("l"), F.substring("body", F.col("at") - F.col("l") - reach + 1, F.lit(reach))).alias("key"),
        "fp", "ctx", "n", "at", "shift", (F.col("l") + reach).alias("l"), "r", F.substring("body", F.lit(1), F.col("stop") + length).alias("body"),
    )
    begin = F.greatest(F.lit(0), F.col("at") + gram + F.col("r") + reach - length)
    right = rows.withColumn("begin", begin).where(F.col("begin") <= size - length).select(
        F.xxhash64("key", F.lit("r"), F.substring("body", F.col("at") + gram + F.col("r") + 1, F.lit(reach))).alias("key"),
        "fp", "ctx", "n", (F.col("at") - F.col("begin")).alias("at"), (F.col("shift") + F.col("begin")).alias("shift"),
        "l", (F.col("r") + reach).alias("r"), F.substring("body", F.col("begin") + 1, size).alias("body"),
    )
    return left.unionByName(right)


def _hot_groups(rows: DataFrame, length: int, gram: int, most: int) -> DataFrame:
    """(fp, ctx, s, e) of contexts (fp, ctx, n, at, body) whose grams have too many of them for one task."""
    missing = length - gram
    none = F.lit(0)
    rows = rows.select(F.col("fp").alias("key"), "fp", "ctx", "n", "at", none.alias("shift"), none.alias("l"), none.alias("r"), "body")
    found = []
    while missing:
        reach = (missing + 1) // 2
        missing -= reach
        uses = staged(_split(rows, length, gram, reach).withColumn("cut", F.xxhash64("body")))
        per = uses.groupBy("key", "cut").agg(F.sum("n").alias("copies"))
        groups = staged(per.groupBy("key").agg(F.sum("copies").alias("all"), F.count(F.lit(1)).alias("kinds")).where("all > 1"))
        judged = staged(per.join(groups, "key").select("key", "cut", "copies", "kinds"))
        of = lambda spans: uses.join(spans, ["key", "cut"]).select("fp", "ctx", (F.col("shift") + F.col("s")).alias("s"), (F.col("shift") + F.col("e")).alias("e"))
        whole = uses.join(judged.where("copies > 1").select("key", "cut"), ["key", "cut"])
        found.append(whole.select("fp", "ctx", F.col("shift").alias("s"), (F.col("shift") + F.length("body")).alias("e")))
        few = uses.join(judged.where((F.col("kinds") > 1) & (F.col("kinds") <= most)).select("key", "cut"), ["key", "cut"])
        few = _sorted_groups(few.select("key", F.col("cut").alias("ctx"), "body"), length)
        found.append(of(few.withColumnRenamed("ctx", "cut")))
        hot = judged.where(F.col("kinds") > most).select("key").distinct()
        rows = staged(uses.join(hot, "key").drop("cut"))
        if rows.isEmpty():
            break
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def repeated_spans(docs: DataFrame, *, length: int = 400, gram: int = 128, most: int = 2048, text_col: str = "text") -> DataFrame:
    """(k1, k2, spans) of each different text with a repeated string: k1 and k2 are `text_keys` of it, spans the (s, e) of
    bytes that repeated strings cover, unsorted and overlapping. Null and empty texts have none.
    """
    if gram & (gram - 1) or not 0 < gram <= length < 4096:
        raise ValueError("gram must be a power of two, and length from it to 4,095")
    text = F.col(text_col).cast("string")
    rows = docs.select(*text_keys(text_col), text.alias("text")).where(F.length(F.col("text").cast("binary")) >= length)
    marks = staged(rows.mapInArrow(_marks(length, gram), "k1 long, k2 long, fp array<long>, ctx array<long>, place array<long>"))
    marks = marks.select("k1", "k2", F.explode(F.arrays_zip("fp", "ctx", "place")).alias("x")).select("k1", "k2", "x.*")
    # What rows may repeat in is joined with staged sums, so that Spark can split a hot key of theirs.
    twice = marks.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), (F.min("ctx") != F.max("ctx")).alias("contested")).where("n > 1")
    again = staged(marks.join(staged(twice.select("fp", "contested")), "fp"))
    first, end = F.expr("shiftright(place, 24)"), F.expr("shiftright(place, 24) + (place & 4095)") + length
    whole = again.where("not contested").select("k1", "k2", first.alias("s"), end.alias("e"))
    disputed = again.where("contested")
    kinds = staged(disputed.groupBy("fp", "ctx").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "place")).alias("one")))
    hot = staged(kinds.groupBy("fp").agg((F.count(F.lit(1)) > most).alias("hot")))
    wanted = kinds.join(hot, "fp").select("one.k1", "one.k2", F.struct("fp", "ctx", "n", "hot", F.col("one.place").alias("place")).alias("w"))
    wanted = staged(wanted.groupBy("k1", "k2").agg(F.collect_list("w").alias("wanted")))  # no more than a text has contexts
    bodies = rows.join(wanted, ["k1", "k2"]).select("k1", "k2", "text", "wanted")
    bodies = staged(bodies.mapInArrow(_cut_out(length), "fp long, ctx long, n long, hot boolean, at int, body binary"))
    spans = _sorted_groups(bodies.where("not hot").withColumnRenamed("fp", "key"), length).withColumnRenamed("key", "fp")
    many = bodies.where("hot").dropDuplicates(["fp", "ctx"])
    if not many.isEmpty():
        spans = spans.union(_hot_groups(many, length, gram, most))
    copied = kinds.where("n > 1").select("fp", "ctx", F.lit(0).alias("s"), F.lit(-1).alias("e"))  # to the end of the context
    spans = staged(spans.union(copied).distinct().groupBy("fp", "ctx").agg(F.collect_list(F.struct("s", "e")).alias("x")))
    spans = disputed.join(spans, ["fp", "ctx"]).select("k1", "k2", F.explode("x").alias("x"), first.alias("s"), end.alias("e"))
    spans = spans.select("k1", "k2", (F.col("s") + F.col("x.s")).alias("s"), F.when(F.col("x.e") < 0, F.col("e")).otherwise(F.col("s") + F.col("x.e")).alias("e"))
    return staged(whole.union(spans).distinct().groupBy("k1", "k2").agg(F.collect_list(F.struct("s", "e")).alias("spans")))


def text_keys(text_col: str) -> list[Column]:
    """Two numbers that name a text."""
    text = F.col(text_col).cast("string")
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("text"), text).alias("k2")]


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, spans) to (id, n_bytes, n_removed, spans, kept)."""
    kind = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sizes, removed, merged, kept = [], [], [], []
            for text, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                raw, done, union, left = (text or "").encode(), 0, [], []
                for s, e in sorted((x["s"], x["e"]) for x in spans or []):
                    if union and s <= union[-1]["e"]:
                        union[-1]["e"] = max(e, union[-1]["e"])
                    else:
                        union.append({"s": s, "e": e})
                for x in union:
                    left.append(raw[done : x["s"]])
                    done = x["e"]
                left.append(raw[done:])
                sizes.append(len(raw))
                removed.append(sum(x["e"] - x["s"] for x in union))
                merged.append(union)
                kept.append(b"".join(left))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(merged, kind), pa.array(kept, pa.binary())],
                ["id", "n_bytes", "n_removed", "spans", "kept"],
            )


def without_repeats(docs: DataFrame, *, length: int = 400, gram: int = 128, most: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, spans, kept) of every row of `docs`.

    `spans` are the maximal (s, e) of bytes that go, `kept` the bytes that stay, which need not be whole characters. All
    occurrences go, the first one too; they may overlap, and lie in one text. Null and empty texts have no bytes, texts
    shorter than `length` lose none. Repeated rows are other documents: from `length` bytes on they go whole, and come
    back repeated. A null id stays null. Other columns are not read, whatever their names. Texts are named by 128 bits
    and contexts by 128 bits of gram and content; what is compared by suffixes is compared byte by byte.
    """
    spans = repeated_spans(docs, length=length, gram=gram, most=most, text_col=text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *text_keys(text_col))
    kind = docs.schema[id_col].dataType.simpleString()
    joined = rows.join(spans, ["k1", "k2"], "left").select("id", "text", "spans")
    out = joined.mapInArrow(_without, f"id {kind}, n_bytes long, n_removed long, spans array<struct<s:long,e:long>>, kept binary")
    return out.withColumnRenamed("id", id_col)
