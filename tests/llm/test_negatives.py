"""Hard negatives against all inner products."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from driftspark.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, score string, uid int, v int"


def brute(rows, positives=5, negatives_=5, low=80):
    """rows: (id, vector or None, label). Anchors are ids divisible by 10."""
    fine = lambda x: x is not None and math.isfinite(x) and abs(x) * 256 <= negatives.LIMIT
    points = [(i, [math.floor(256 * float(np.float32(x))) for x in v], y) for i, v, y in rows if v is not None and y is not None and all(map(fine, v))]
    first = lambda i: (i is None, i)
    out = []
    for a, (anchor, va, ya) in enumerate(points):
        if anchor is None or anchor % 10:
            continue
        score = [(sum(x * y for x, y in zip(va, vb)), i, yb) for b, (i, vb, yb) in enumerate(points) if b != a]
        ordered = sorted(score, key=lambda r: (-r[0], first(r[1])))
        for p, pid, _ in [r for r in ordered if r[2] == ya][:positives]:
            hits = [r for r in ordered if r[2] != ya and low * p <= 100 * r[0] <= 100 * p][:negatives_]
            out += [(anchor, pid, k, n, p, s) for k, (s, n, _) in enumerate(hits, 1)]
    return out


def check(spark, rows, **options):
    df = spark.createDataFrame([(i, v, y, "s", 0, 0) for i, v, y in rows], SCHEMA).repartition(5)
    got = negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, **options)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    order = lambda r: tuple((x is None, x) for x in r)
    got, want = sorted(map(tuple, got.collect()), key=order), sorted(brute(rows), key=order)
    assert got == want
    return got


def test_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0.3, 0.3) for _ in range(6)], rng.randrange(4)) for i in range(400)]
    rows += [(i, None, 1) for i in (1000, 1001)] + [(1010, [0.1] * 6, None), (1020, [float("nan")] * 6, 1), (1030, [0.1, None, 0.1], 2)]
    rows += [(1040, [float("inf")] * 6, 1), (1050, [1e9] * 6, 1), (1060, [], 1), (1070, [0.5, 0.5], 2), (None, [0.4] * 6, 1), (None, [0.4] * 6, 0)]
    rows += [rows[20], rows[20], rows[3]]  # repeated rows are other rows
    assert check(spark, rows)


def test_ties_and_one_vector_for_most_rows(spark, monkeypatch):
    monkeypatch.setattr(negatives, "TREE", 64)
    monkeypatch.setattr(negatives, "LEAF", 8)
    monkeypatch.setattr(negatives, "TOGETHER", 7)
    rng = random.Random(5)
    rows = [(i, [0.5, 0.25, 0.125], i % 3) for i in range(150)]
    rows += [(150 + i, [rng.choice([-0.5, 0.0, 0.5]) for _ in range(3)], i % 3) for i in range(250)]
    assert check(spark, rows)


def test_large_components_are_exact(spark):
    rng = random.Random(6)
    rows = [(i, [rng.uniform(-200_000, 200_000) for _ in range(40)], i % 2) for i in range(120)]
    assert check(spark, rows)


def test_nothing_to_find(spark):
    assert check(spark, []) == []
    assert check(spark, [(0, [0.5], 1)]) == []
    assert check(spark, [(0, [0.5], 1), (1, [0.5], 1), (10, [], 2)]) == []


def test_boxes_hold_their_rows_and_bounds_hold():
    rng = np.random.default_rng(7)
    v = rng.integers(-100, 100, (3000, 5)).astype(np.int32)
    tiles = negatives._tiles(v, np.arange(len(v)), -(-len(v) // negatives.LEAF), [2, 0, 1])
    assert sorted(np.concatenate(tiles).tolist()) == list(range(len(v))) and max(map(len, tiles)) <= negatives.LEAF
