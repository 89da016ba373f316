"""Hard negatives by an R-tree packed by sort-tile-recursive.

Rows are dealt into ranges of the coordinate that varies most, and each range is packed into trees of some thousand rows:
sorted and cut by one coordinate after the other into leaves, whose bounding boxes are joined into larger ones. A box
gives every coordinate of its rows an interval, so the inner product with an anchor lies in the sum of those intervals
times the anchor's coordinates. Each block of anchors goes through the trees with a queue, best bound first, and leaves
out boxes outside all score windows or strictly below what it has found already.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftspark.llm.common import staged

#: Rows of a leaf, boxes of an upper node, rows of a tree, anchors that are searched together.
LEAF, FAN, TREE, TOGETHER = 256, 8, 8192, 512
#: Components beyond take no part, so that a product of 2,048 of them fits a long.
LIMIT = 1 << 26
_NONE = -(1 << 62)
_LAST = (1 << 63) - 1


def points(rows: DataFrame, scale: float, anchors: Column, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(uid, id, label, v, anchor): rows that take part, their components as floor(scale * x)."""
    scaled = F.transform(F.col("x"), lambda x: F.floor(x.cast("double") * scale))
    fine = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) * scale <= LIMIT)
    chosen = rows.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("x"), F.coalesce(anchors, F.lit(False)).alias("anchor")
    )
    chosen = chosen.where(F.col("label").isNotNull() & F.col("x").isNotNull()).where(F.forall("x", fine))
    return staged(chosen.select(F.monotonically_increasing_id().alias("uid"), "id", "label", F.transform(scaled, lambda x: x.cast("int")).alias("v"), "anchor"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones are filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    out = np.zeros((len(column), width), np.int32)
    out[np.repeat(np.arange(len(column)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _tiles(v: np.ndarray, rows: np.ndarray, leaves: int, axes: list[int]) -> list[np.ndarray]:
    """Sort-tile-recursive: cut into slabs by the first axis, each slab by the next ones, the last cut gives `leaves` leaves."""
    if leaves <= 1:
        return [rows]
    rows = rows[np.argsort(v[rows, axes[0]], kind="stable")]
    slabs = leaves if len(axes) == 1 else max(2, round(leaves ** (1 / len(axes))))
    out = []
    for slab in np.array_split(rows, min(slabs, leaves)):
        out += _tiles(v, slab, -(-len(slab) // LEAF), axes[1:] or axes)
    return out


def _pack_trees(width: int):
    """Rows in order of the widest coordinate to trees: rows leaf by leaf, where leaves begin, and boxes of leaves."""

    def tree(batch: pa.Table) -> tuple:
        v = _matrix(batch["v"], width)
        spread = np.ptp(v, axis=0) if len(v) and width else np.zeros(0)
        axes = np.argsort(-spread, kind="stable")[:3].tolist() or [0]
        tiles = _tiles(v, np.arange(len(v)), -(-len(v) // LEAF), axes) if width else [np.arange(len(v))]
        order = np.concatenate(tiles)
        cuts = np.cumsum([0, *map(len, tiles)])
        low = np.array([v[t].min(axis=0) for t in tiles], np.int32)
        high = np.array([v[t].max(axis=0) for t in tiles], np.int32)
        of = lambda name: batch[name].to_numpy()[order].astype(np.int64).tobytes()
        return int(batch["uid"][0].as_py()), v[order].tobytes(), of("uid"), of("id"), of("label"), cuts.astype(np.int64).tobytes(), low.tobytes(), high.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _gathered(batches, TREE):
            columns = list(zip(tree(group)))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *[pa.array(c, pa.binary()) for c in columns[1:]]], ["tree", "v", "uids", "ids", "labels", "cuts", "low", "high"])

    return run


def _gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """The rows of a partition in tables of `most` rows."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        while n + batch.num_rows >= most:
            yield pa.Table.from_batches([*held, batch.slice(0, most - n)])
            batch, held, n = batch.slice(most - n), [], 0
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
    if n:
        yield pa.Table.from_batches(held)


def _pack_anchors(width: int, windows: int):
    """Anchors to blocks. Each has `windows` score windows, with what they belong to, or one that takes all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _gathered(batches, TOGETHER):
            of = lambda name: group[name].to_numpy().astype(np.int64).tobytes()
            about = np.full((group.num_rows, max(windows, 1), 2), _NONE, np.int64)
            if windows:
                for i, given in enumerate(group["positives"].to_pylist()):
                    for j, p in enumerate(given):
                        about[i, j] = p["score"], p["id"]
            row = [group["uid"][0].as_py(), _matrix(group["v"], width).tobytes(), of("uid"), of("id"), of("label"), about.tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64() if i == 0 else pa.binary()) for i, x in enumerate(row)], ["block", "qv", "quids", "qids", "qlabels", "about"])

    return run


class _Search:
    """What one block of anchors has found so far: of each anchor and window the `k` best scores and their ids."""

    def __init__(self, row: dict, width: int, windows: int, k: int, low: int):
        read = lambda name: np.frombuffer(row[name], np.int64)
        self.v = np.frombuffer(row["qv"], np.int32).reshape(-1, width)
        self.uids, self.ids, self.labels = read("quids"), read("qids"), read("qlabels")
        self.about = read("about").reshape(len(self.uids), -1, 2)
        self.same, m = not windows, max(windows, 1)
        shape = (len(self.uids), m)
        if windows:
            self.high = self.about[:, :, 0]
            self.low = -((-low * self.high) // 100)  # the least n with 100 * n >= low * p
            gone = self.high == _NONE
            self.low = np.where(gone, _LAST, self.low)
        else:
            self.high, self.low = np.full(shape, _LAST), np.full(shape, _NONE + 1)
        self.scores, self.found = np.full((*shape, k), _NONE), np.full((*shape, k), _LAST)

    def products(self, rows: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Inner products, exact: by floating point where all sums stay below 2**53."""
        most = (int(np.abs(rows).max(initial=0)) + 1) * (int(np.abs(of).max(initial=0)) + 1) * max(1, rows.shape[1])
        if most < 1 << 53:
            return (rows.astype(np.float64) @ of.T.astype(np.float64)).astype(np.int64)
        return rows.astype(np.int64) @ of.T.astype(np.int64)

    def bounds(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest inner product of each anchor with anything in each box."""
        up, down = np.maximum(self.v, 0), np.minimum(self.v, 0)
        return self.products(up, low) + self.products(down, high), self.products(up, high) + self.products(down, low)

    def wanting(self, least: np.ndarray, largest: np.ndarray) -> np.ndarray:
        """Which anchors a box may have something for: in a window, and not strictly below the k-th found."""
        enough = np.maximum(self.low, self.scores[:, :, -1])
        return ((largest[:, None] >= enough) & (least[:, None] <= self.high)).any(axis=1)

    def through(self, row: dict, width: int) -> None:
        """One tree, best bound first."""
        read = lambda name: np.frombuffer(row[name], np.int64)
        v, cuts = np.frombuffer(row["v"], np.int32).reshape(-1, width), read("cuts")
        uids, ids, labels = read("uids"), read("ids"), read("labels")
        boxes = [tuple(np.frombuffer(row[c], np.int32).reshape(-1, width) for c in ("low", "high"))]
        while len(boxes[-1][0]) > 1:  # the levels above the leaves
            at = np.arange(0, len(boxes[-1][0]), FAN)
            boxes.append((np.minimum.reduceat(boxes[-1][0], at), np.maximum.reduceat(boxes[-1][1], at)))
        bounds = [self.bounds(*b) for b in boxes]
        queue = [(0, len(boxes) - 1, 0)]
        while queue:
            _, level, node = heapq.heappop(queue)
            least, largest = (b[:, node] for b in bounds[level])
            who = np.flatnonzero(self.wanting(least, largest))
            if not len(who):
                continue
            if level:
                for child in range(node * FAN, min((node + 1) * FAN, len(boxes[level - 1][0]))):
                    least, largest = (b[:, child] for b in bounds[level - 1])
                    some = self.wanting(least, largest)
                    if some.any():
                        heapq.heappush(queue, (-int(largest[some].max()), level - 1, child))
            else:
                a, b = cuts[node], cuts[node + 1]
                self.take(who, v[a:b], uids[a:b], ids[a:b], labels[a:b])

    def take(self, who: np.ndarray, v: np.ndarray, uids: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        score = self.products(self.v[who], v)
        fit = (labels == self.labels[who][:, None]) == self.same
        if self.same:
            fit &= uids != self.uids[who][:, None]
        k = self.scores.shape[2]
        for j in range(self.scores.shape[1]):
            enough = np.maximum(self.low[who, j], self.scores[who, j, -1])
            ok = fit & (score >= enough[:, None]) & (score <= self.high[who, j][:, None])
            some = np.flatnonzero(ok.any(axis=1))
            if not len(some):
                continue
            scores = np.concatenate([self.scores[who[some], j], np.where(ok[some], score[some], _NONE)], axis=1)
            found = np.concatenate([self.found[who[some], j], np.where(ok[some], ids, _LAST)], axis=1)
            best = np.lexsort((found, -scores), axis=1)[:, :k]
            self.scores[who[some], j] = np.take_along_axis(scores, best, axis=1)
            self.found[who[some], j] = np.take_along_axis(found, best, axis=1)

    def rows(self) -> pa.RecordBatch:
        """(uid, id, window, positive_id, positive_score, found_id, score)."""
        i, j, x = np.nonzero(self.scores > _NONE)
        columns = [self.uids[i], self.ids[i], j, self.about[i, j, 1], self.about[i, j, 0], self.found[i, j, x], self.scores[i, j, x]]
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["uid", "id", "window", "positive_id", "positive_score", "found_id", "score"])


def _searched(trees: DataFrame, blocks: DataFrame, width: int, windows: int, k: int, low: int) -> DataFrame:
    """The `k` best of each anchor and window over all trees. The anchors are the query set: each block of them goes to
    every slice of the trees. A task sends the best of the trees it has met, and the best of those are taken."""
    slices = int(trees.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = trees.withColumn("slice", F.pmod(F.xxhash64("tree"), F.lit(slices)).cast("int"))
    asked = blocks.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    pairs = asked.join(dealt, "slice").drop("slice")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, search = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(c)[i].as_py() for c, name in enumerate(batch.schema.names)}
                if row["block"] != block:
                    if search:
                        yield search.rows()
                    block, search = row["block"], _Search(row, width, windows, k, low)
                search.through(row, width)
        if search:
            yield search.rows()

    found = pairs.mapInArrow(run, "uid long, id long, window long, positive_id long, positive_score long, found_id long, score long")
    order = F.row_number().over(Window.partitionBy("uid", "window").orderBy(F.desc("score"), "found_id"))
    return found.withColumn("rank", order).where(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame, anchors: Column, *, positives: int = 5, negatives: int = 5, low: int = 80, scale: float = 256.0,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each anchor and each of its positives.

    A row's score is its inner product with the anchor, of components floor(scale * x); higher ones come first, of equal
    ones the smaller id, a null id last. An anchor's positives are its first `positives` other rows of its label. Negatives
    are the first of other labels with low * positive_score <= 100 * negative_score <= 100 * positive_score, `negatives` of
    them. Rows with a null label, a null vector, or a component that is null, not finite or beyond 2**26 once scaled
    take no part. Repeated rows are other rows, and each repeated anchor brings its own rows. Vectors are filled up with zeros
    to the longest one; without a row there is no result. A pair without a negative has no row. Other columns are not read.
    """
    all_of = points(rows, scale, anchors, id_col, vector_col, label_col)
    all_of = all_of.withColumn("id", F.coalesce("id", F.lit(_LAST)))
    width = all_of.agg(F.max(F.size("v"))).first()[0] or 0
    if width:
        spread = all_of.agg(*[F.var_pop(F.get("v", F.lit(i))).alias(str(i)) for i in range(width)]).first()
        widest = max(range(width), key=lambda i: spread[i] or 0)
    else:
        widest = 0
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = all_of.withColumn("c", F.get("v", F.lit(widest))).repartitionByRange(partitions, "c", "uid").sortWithinPartitions("c", "uid")
    point = ["uid", "id", "label", "v"]
    binary = ", ".join(f"{c} binary" for c in ("v", "uids", "ids", "labels", "cuts", "low", "high"))
    trees = staged(sorted_rows.select(point).mapInArrow(_pack_trees(width), f"tree long, {binary}"))
    binary = "block long, " + ", ".join(f"{c} binary" for c in ("qv", "quids", "qids", "qlabels", "about"))
    asking = all_of.where("anchor").select(point).repartition(partitions, "uid")
    near = _searched(trees, asking.mapInArrow(_pack_anchors(width, 0), binary), width, 0, positives, low)
    given = near.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("rank", "score", F.col("found_id").alias("id")))).alias("positives"))
    asking = asking.join(given, "uid").select(*point, "positives").repartition(partitions, "uid")
    far = _searched(trees, asking.mapInArrow(_pack_anchors(width, positives), binary), width, positives, negatives, low)
    known = lambda name: F.when(F.col(name) != _LAST, F.col(name))
    return far.select(
        known("id").alias("anchor_id"), known("positive_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
        known("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
    )
