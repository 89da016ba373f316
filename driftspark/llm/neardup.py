"""Near-duplicate documents by an LSH forest of MinHash signatures.

Texts with equal shingle sets become one node first. Every node has a key in each of several trees, made of its own
minima; nodes are sorted by key, and neighbours with a long common prefix are candidates. Regions where many nodes share
the least prefix are descended deeper: there only the nearest neighbours are taken, and what they leave apart is compared
in blocks. Candidates are confirmed on full sets, every node's best first, and pairs that are already connected are not
compared, so large groups of near copies cost a few comparisons for each member.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftspark.llm.common import Words, bitmap, blank_separated, in_bitmap, lower_ascii, mix, slices, split, staged

TREES = 20
DEPTH = 6
#: Minima that two nodes share at the beginning of a key, at least, to be candidates.
LEAST = 4
#: Neighbours on one side that are candidates in a region of any size.
NEAREST = 8
#: Those of them that are, where a region goes on beyond the nearest on both ends.
FEW = 3

_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xC2B2AE3D27D4EB4F)
_MULTIPLIERS = np.random.default_rng(99).integers(1, 2**64, TREES * DEPTH, dtype=np.uint64) | np.uint64(1)


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of 2-word shingles of each text, one after the other, and where each text's begin."""
    words = Words(column, blank_separated(), lower_ascii())
    key, doc, first = words.hashes(), words.doc, words.first
    n = np.diff(first)
    pair = doc[:-1] == doc[1:]
    both = mix(key[:-1][pair] * _A + key[1:][pair] * _B)
    alone = first[:-1][n == 1]
    shingle = np.concatenate([both, mix(key[alone] ^ _B)])
    owner = np.concatenate([doc[:-1][pair], doc[alone]])
    order = np.lexsort((shingle, owner))
    shingle, owner = shingle[order], owner[order]
    keep = np.ones(len(owner), bool)
    keep[1:] = (owner[1:] != owner[:-1]) | (shingle[1:] != shingle[:-1])
    shingle, owner = shingle[keep], owner[keep]
    return shingle, np.searchsorted(owner, np.arange(words.n_docs + 1))


def _identities(shingle: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums over each set; equal sets have equal sums. The first one names the node."""

    def sums(values: np.ndarray) -> np.ndarray:
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values, out=total[1:])
        return (total[starts[1:]] - total[starts[:-1]]).view(np.int64)

    return sums(mix(shingle ^ _A)), sums(mix(shingle ^ _B))


def _minima(shingle: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """16-bit minima, one column for each hash function, for each set that isn't empty."""
    begin = starts[:-1][np.diff(starts) > 0]
    out = np.empty((len(begin), TREES * DEPTH), ">u2")
    for t, a in enumerate(_MULTIPLIERS):
        least = np.minimum.reduceat(((shingle * a) >> np.uint64(32)).astype(np.uint32), begin) if len(begin) else np.zeros(0, np.uint32)
        out[:, t] = mix(least.astype(np.uint64)) & np.uint64(0xFFFF)
    return out


def nodes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, node, twin, sig) for each row; node, twin and sig are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                shingle, starts = shingle_sets(part.column(1))
                n = np.diff(starts)
                node, twin = _identities(shingle, starts)
                minima = iter([r.tobytes() for r in _minima(shingle, starts)])
                sig = [next(minima) if k else None for k in n.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n.astype(np.int64)), pa.array(node, mask=n == 0), pa.array(twin, mask=n == 0), pa.array(sig, pa.binary())],
                    ["id", "n", "node", "twin", "sig"],
                )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, n long, node long, twin long, sig binary")


def _tree_rows(reps: DataFrame) -> DataFrame:
    width = 2 * DEPTH
    keys = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(t.alias("tree"), F.substr("sig", t * width + 1, F.lit(width)).alias("key")))
    return reps.select("node", F.explode(keys).alias("x")).select("x.tree", "x.key", "node")


def candidates(reps: DataFrame, partitions: int) -> DataFrame:
    """(a, b, shared) from all trees; shared is the length of the common prefix. Where a region goes on beyond the nearest
    neighbours, (a, a, tree) marks its members. `left_apart` compares marked ones with all of their region, so of
    neighbours that are both marked only the first few are candidates, which join most of them. Ranges of a tree are
    sorted apart, so a region of any size may be split; neighbours on either side of a split meet in other trees.
    """
    ordered = _tree_rows(reps).repartitionByRange(partitions, "tree", "key", "node").sortWithinPartitions("tree", "key", "node")
    beyond = NEAREST + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, key, node = np.zeros(0, np.int32), np.zeros((0, DEPTH), ">u2"), np.zeros(0, np.int64)
        begin = 0  # rows before this one have met all behind them
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                new = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u2").reshape(-1, DEPTH)
                tree, key, node = np.concatenate([tree, batch.column(0).to_numpy()]), np.concatenate([key, new]), np.concatenate([node, batch.column(2).to_numpy()])
            # a neighbour is marked by one as far behind it
            end = len(node) if batch is None else len(node) - NEAREST - beyond
            if end <= begin:
                continue
            region = lambda i, step: (tree[i] == tree[i + step]) & (key[i, :LEAST] == key[i + step, :LEAST]).all(axis=1)
            far = np.arange(max(0, len(node) - beyond))
            far = far[region(far, beyond)]
            marked = np.zeros(len(node), bool)
            marked[far] = marked[far + beyond] = True
            far = far[(far >= begin) & (far < end)]
            pairs = [(node[x], node[x], tree[x]) for x in (far, far + beyond)]
            for step in range(1, beyond):
                i = np.arange(begin, min(end, len(node) - step))
                i = i[region(i, step)]
                if step > FEW:
                    i = i[~(marked[i] & marked[i + step])]
                equal = key[i] == key[i + step]
                shared = np.where(equal.all(axis=1), DEPTH, np.argmin(equal, axis=1)) if len(i) else np.zeros(0, int)
                a, b = node[i], node[i + step]
                pairs.append((np.minimum(a, b), np.maximum(a, b), shared))
            a, b, s = (np.concatenate(x) for x in zip(*pairs))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s.astype(np.int32))], ["a", "b", "shared"])
            keep = max(0, end - beyond)
            tree, key, node, begin = tree[keep:], key[keep:], node[keep:], end - keep

    return ordered.mapInArrow(run, "a long, b long, shared int")


def full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, bits: int = 23) -> DataFrame:
    """(node, items): the full sets of the wanted (node, id), as sorted 64-bit hashes. Texts are read once more; a bitmap
    keeps those of other nodes from the shuffle. The id of a node that only rows with null ids hold is null; as all of its
    rows have that key, each partition sends one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(wanted, F.col("node"), bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                shingle, starts = shingle_sets(part.column(1))
                node, _ = _identities(shingle, starts)
                keep = in_bitmap(shared.value, node) & (np.diff(starts) > 0)
                for i in np.flatnonzero(keep & part.column(0).is_null().to_numpy(zero_copy_only=False)).tolist():
                    keep[i] = (name := int(node[i])) not in sent
                    sent.add(name)
                at = np.flatnonzero(keep)
                items = [shingle[starts[i] : starts[i + 1]].tobytes() for i in at]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), pa.array(node[at]), pa.array(items, pa.binary())], ["id", "node", "items"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    sets = rows.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, node long, items binary")
    same = F.expr("sets.node = wanted.node AND sets.id <=> wanted.id")
    return sets.alias("sets").join(wanted.alias("wanted"), same, "left_semi").dropDuplicates(["node"]).select("node", "items")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those (a, b) whose sets share `percent` per cent of their union."""
    joined = (
        pairs.select("a", "b").join(sets.withColumnsRenamed({"node": "a", "items": "x"}), "a")
        .join(sets.withColumnsRenamed({"node": "b", "items": "y"}), "b").select("a", "b", "x", "y")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [_linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return joined.mapInArrow(run, "a long, b long")


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one partition as stars: each node but the least of a connected part points at the least."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := root.get(top, top)) != top:
            top = up
        while x != top:
            root[x], x = top, root.get(x, x)
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    nodes = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["a", "b"])


def components(links: DataFrame, together: int = 1 << 17) -> DataFrame:
    """(node, root): the least node reachable over links (a, b).

    Partitions turn their edges into stars first. Up to `together` edges of these are joined by one task, which ends the
    work. More are dealt by their upper end, about `together` to a task, so a node has one edge in each at most and no
    node is hot; then every edge moves on to where its lower end points. Both are repeated until nothing changes.
    """
    edges = staged(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").mapInArrow(_forest, "a long, b long"))
    tasks = -(-edges.count() // together)
    if tasks <= 1:
        return staged(edges.coalesce(1).mapInArrow(_forest, "a long, b long")).toDF("node", "root")
    mark = None
    while True:
        stars = staged(edges.repartition(tasks, "a").mapInArrow(_forest, "a long, b long"))
        now = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return stars.toDF("node", "root")
        mark = now
        further = stars.select(F.col("a").alias("b"), F.col("b").alias("c"))
        edges = stars.join(further, "b", "left").select("a", F.coalesce("c", "b").alias("b"))


def _as_links(roots: DataFrame) -> DataFrame:
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b"))


def _rooted(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs with the roots of both ends, ra and rb; a node without links is its own."""
    side = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    out = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return out.withColumns({"ra": F.coalesce("ra", "a"), "rb": F.coalesce("rb", "b")})


def _likely(pairs: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """Pairs whose sizes allow a link and whose minima agree in a share of `least`, far below what linked ones show."""
    of = lambda c: reps.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("sig").alias(f"s{c}"))
    joined = pairs.join(of("a"), "a").join(of("b"), "b").where("5 * na >= 4 * nb and 5 * nb >= 4 * na")

    @F.arrow_udf("boolean")
    def agree(x: pa.Array, y: pa.Array) -> pa.Array:
        table = lambda s: np.frombuffer(b"".join(s.to_pylist()), ">u2").reshape(-1, TREES * DEPTH)
        return pa.array((table(x) == table(y)).mean(axis=1) >= least) if len(x) else pa.array([], pa.bool_())

    return joined.where(agree("sa", "sb")).select("a", "b")


def _items(values: list) -> list[np.ndarray]:
    return [np.frombuffer(v, np.uint64) if v is not None else None for v in values]


def _links_to(one: np.ndarray, many: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets of `many` are linked with `one`, by one search for all of them."""
    if not many:
        return np.zeros(0, bool)
    sizes = np.array([len(m) for m in many])
    at = np.searchsorted(one, all_items := np.concatenate(many))
    hit = np.zeros(len(all_items) + 1, np.int64)
    np.cumsum(one[np.minimum(at, len(one) - 1)] == all_items, out=hit[1:])
    ends = np.cumsum(sizes)
    both = hit[ends] - hit[ends - sizes]
    return 100 * both >= percent * (sizes + len(one) - both)


def left_apart(dense: DataFrame, reps: DataFrame, roots: DataFrame, sets: DataFrame, percent: int, least: float, block: int = 1024) -> DataFrame:
    """(a, b) links that nearest neighbours missed in regions beyond them; `dense` has (node, trees), a bit for each tree.

    In each such region (nodes of a tree with the same least prefix), the nodes outside the region's largest component
    are compared with one another and, if minima agree with some member's, with all of that component. Regions and
    components are cut into blocks of about `block` nodes on either side, so no task takes a whole one, and only links
    come out.
    """
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    in_block = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")
    blocks = lambda n: F.ceil(n / block).cast("int")
    prefix = F.substr("sig", F.col("tree") * (2 * DEPTH) + 1, F.lit(2 * LEAST))
    rooted = reps.select("node", "n", "sig").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    members = (
        dense.join(rooted, "node").withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))))
        .where(F.expr("shiftright(trees, tree) & 1 = 1")).withColumn("prefix", prefix)
    )
    sizes = members.groupBy("tree", "prefix", "root").agg(F.count(F.lit(1)).alias("size"))
    regions = sizes.groupBy("tree", "prefix").agg(F.sum("size").alias("all"), F.max(F.struct("size", "root")).alias("top")).where("all > top.size")
    regions = regions.select("tree", "prefix", F.col("top.root").alias("top"), blocks(F.col("all")).alias("m"), blocks(F.col("all") - F.col("top.size")).alias("k"))
    inside = staged(members.join(regions, ["tree", "prefix"]))
    outside = inside.where("root <> top").select("node").distinct().join(sets, "node")
    columns = ["tree", "prefix", "row", "col", "role", "node", "root", "top", "n", "sig", "trees", "items"]
    whole = inside.join(outside, "node", "left")
    one = whole.withColumns({"row": in_block("m", 1), "role": F.lit(0)}).withColumn("col", every("k")).select(columns)
    other = whole.where("root <> top").withColumns({"col": in_block("k", 2), "role": F.lit(1)}).withColumn("row", every("m")).select(columns)

    def compare(group: pa.Table) -> pa.Table:
        tree, role, top = group["tree"][0].as_py(), group["role"].to_numpy(), group["top"][0].as_py()
        node, root, n, dense_in = (group[c].to_numpy() for c in ("node", "root", "n", "trees"))
        sig = np.frombuffer(b"".join(group["sig"].to_pylist()), ">u2").reshape(len(node), TREES * DEPTH)
        items = _items(group["items"].to_pylist())
        left, a, b, asks = np.flatnonzero(role == 0), [], [], []
        for i in np.flatnonzero(role == 1):
            same = sig[left] == sig[i]
            # met already in an earlier tree, where both are in one such region
            alike = same[:, : tree * DEPTH].reshape(len(left), tree, DEPTH)[:, :, :LEAST].all(axis=2)
            earlier = (alike & ((dense_in[left][:, None] & dense_in[i]) >> np.arange(tree) & 1 == 1)).any(axis=1)
            ok = left[(same.mean(axis=1) >= least) & (root[left] != root[i]) & ~earlier & (5 * n[left] >= 4 * n[i]) & (5 * n[i] >= 4 * n[left])]
            near = ok[root[ok] != top]
            linked = near[_links_to(items[i], [items[j] for j in near], percent)]
            if len(linked) < len(ok) and (root[ok] == top).any():
                asks.append(node[i])
            near = linked[np.unique(root[linked], return_index=True)[1]]  # one link to a component is enough
            a.append(np.full(len(near), node[i]))
            b.append(node[near])
        none = np.zeros(0, np.int64)
        a, b, asks = np.concatenate([none, *a]), np.concatenate([none, *b]), np.array(asks, np.int64)
        return pa.table({"a": np.concatenate([a, asks]), "b": np.concatenate([b, np.full(len(asks), top)]), "ask": np.arange(len(a) + len(asks)) >= len(a)})

    found = staged(one.union(other).groupBy("tree", "prefix", "row", "col").applyInArrow(compare, "a long, b long, ask boolean"))
    asked = found.where("ask").select(F.col("a").alias("node"), F.col("b").alias("root")).distinct()
    large = dense.select("node").join(rooted.select("node", "root"), "node").join(asked.select("root").distinct(), "root", "left_semi")
    counts = large.groupBy("root").agg(blocks(F.count(F.lit(1))).alias("m")).join(asked.groupBy("root").agg(blocks(F.count(F.lit(1))).alias("k")), "root")
    columns = ["root", "row", "col", "role", "node", "items"]
    one = large.join(counts, "root").join(sets, "node").withColumns({"row": in_block("m", 1), "role": F.lit(0)}).withColumn("col", every("k")).select(columns)
    other = asked.join(counts, "root").join(sets, "node").withColumns({"col": in_block("k", 2), "role": F.lit(1)}).withColumn("row", every("m")).select(columns)

    def connect(group: pa.Table) -> pa.Table:
        role, node, items = group["role"].to_numpy(), group["node"].to_numpy(), _items(group["items"].to_pylist())
        members, a, b = [i for i, r in enumerate(role) if not r], [], []
        sets = [items[i] for i in members]
        for i in np.flatnonzero(role == 1):
            linked = _links_to(items[i], sets, percent)
            if linked.any():  # one link to the component is enough
                a.append(node[i])
                b.append(node[members[int(np.argmax(linked))]])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    joined = one.union(other).groupBy("root", "row", "col").applyInArrow(connect, "a long, b long")
    return found.where("not ask").select("a", "b").union(joined)


def _joined(pairs: DataFrame, reps: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Roots once all candidates that lie between two components are decided, in two rounds, each of them once.

    The first looks at the best candidate of each two components, which joins nearly all that belong together; what has
    become inner need not be looked at any more. The second looks at all others that still lie between two components.
    """
    between = Window.partitionBy(F.least("ra", "rb"), F.greatest("ra", "rb")).orderBy(F.desc("shared"), "a", "b")
    apart = staged(_rooted(pairs, roots).where("ra <> rb").select("a", "b", (F.row_number().over(between) == 1).alias("best")))
    first = confirmed(_likely(apart.where("best").select("a", "b"), reps, percent / 100 - 0.15), sets, percent)
    roots = components(_as_links(roots).union(first))
    still = _rooted(apart.where("not best").select("a", "b"), roots).where("ra <> rb").select("a", "b")
    second = confirmed(_likely(still, reps, percent / 100 - 0.15), sets, percent)
    return components(_as_links(roots).union(second))


def near_duplicates(docs: DataFrame, *, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row.

    Rows are linked if their sets of 2-word shingles share `percent` per cent of their union; a component is what links
    connect, named by its least id. Null, empty and blank texts have empty sets and are linked with nothing, not even
    each other. Repeated rows and equal texts are one node. Rows with a null id take part and name no component; if all
    of one have none, it is null. Sets are of 64-bit hashes: at a thousand million texts, two of them have equal names
    with a probability of some per cent. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = staged(nodes(docs, id_col, text_col))
    some = rows.where("n > 0")
    reps = staged(some.groupBy("node", "twin").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sig").alias("sig")).dropDuplicates(["node"]))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    in_tree = F.bit_or(F.when(F.col("a") == F.col("b"), F.expr("shiftleft(1, shared)"))).alias("trees")
    found = staged(candidates(reps, partitions).groupBy("a", "b").agg(F.sum("shared").alias("shared"), in_tree))
    pairs = found.where("a <> b")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(reps.select("node", "id"), "node")
    sets = staged(full_sets(docs, wanted, id_col, text_col))
    ends = pairs.select(F.col("a").alias("u"), F.col("b").alias("v"), "shared").union(pairs.select("b", "a", "shared"))
    nearest = ends.groupBy("u").agg(F.max(F.struct("shared", "v")).alias("x")).select(F.least("u", "x.v").alias("a"), F.greatest("u", "x.v").alias("b")).distinct()
    roots = components(confirmed(nearest, sets, percent))
    roots = _joined(pairs, reps, roots, sets, percent)
    dense = found.where("a = b").select(F.col("a").alias("node"), "trees")
    rest = staged(left_apart(dense, reps, roots, sets, percent, percent / 100 - 0.15))
    if not rest.isEmpty():
        roots = components(_as_links(roots).union(rest))
    names = (
        some.select("node", "id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        .groupBy("root").agg(F.min("id").alias("component"))
    )
    rooted = reps.select("node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(names, "root").select("node", "component")
    return rows.select("id", "n", "node").join(rooted, "node", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component")).alias("component_id")
    )


def one_of_each(docs: DataFrame, *, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose id names their component, all columns as they are. Of rows equal in id and text one stays.

    Rows without a word are linked with nothing and all stay, as do rows with a null id.
    """
    found = staged(near_duplicates(docs, percent=percent, id_col=id_col, text_col=text_col).where("n_shingles > 0"))
    key = F.col(id_col)
    rest, _ = split(docs, key, found.where(key != F.col("component_id")).select(id_col).distinct())
    repeated = found.where(key.isNotNull()).groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(id_col)
    if repeated.isEmpty():
        return rest
    single, several = split(rest, key, repeated)
    words = F.coalesce(F.col(text_col).cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return single.unionByName(several.where(~words)).unionByName(several.where(words).dropDuplicates([id_col, text_col]))
