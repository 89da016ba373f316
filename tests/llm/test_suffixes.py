"""Suffix arrays against sorting, removal of repeats against all strings of the length."""

import random

import numpy as np
import pytest

from driftspark.llm import suffixes


def covered(texts, length):
    seen = {}
    for d, t in enumerate(texts):
        for i in range(len(t) - length + 1):
            seen.setdefault(t[i : i + length], []).append((d, i))
    out = [bytearray(len(t)) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                out[d][i : i + length] = b"\1" * length
    return out


def test_suffix_array():
    rng = random.Random(1)
    for trial in range(200):
        text = bytes(rng.choice(b"ab\xff" if trial % 3 else b"aab") for _ in range(rng.randrange(0, 200)))
        order = suffixes.suffix_array(np.frombuffer(text, np.uint8), 10_000)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def test_only_rising_suffixes_are_sorted(monkeypatch):
    sorted_ones = []
    plain = suffixes._sorted_directly
    monkeypatch.setattr(suffixes, "_sorted_directly", lambda text, which, depth: sorted_ones.extend(which.tolist()) or plain(text, which, depth))
    text = b"mississippi" * 3
    suffixes.suffix_array(np.frombuffer(text, np.uint8), 100)
    assert sorted(sorted_ones) == [i for i in range(len(text) - 1) if text[i:] < text[i + 1 :]]


def test_common_prefixes():
    rng = random.Random(2)
    text = bytes(rng.choice(b"ab") for _ in range(300))
    raw = np.frombuffer(text, np.uint8)
    order = suffixes.suffix_array(raw, 400)
    for depth in (5, 8, 13, 16):
        for a, b, n in zip(order[:-1], order[1:], suffixes.common_prefixes(raw, order, depth)):
            same = next((k for k in range(depth) if text[a + k : a + k + 1] != text[b + k : b + k + 1] or a + k >= len(text)), depth)
            assert (n >= depth) == (same >= depth)


def test_repeated_bodies():
    rng = random.Random(3)
    for _ in range(100):
        texts = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(0, 60))) for _ in range(rng.randrange(1, 8))]
        for want, spans in zip(covered(texts, 5), suffixes.repeated(texts, 5)):
            got = bytearray(len(want))
            for s, e in spans:
                got[s:e] = b"\1" * (e - s)
            assert got == want


def texts_with_repeats():
    rng = random.Random(5)
    word = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    common = word("abcdefgh é", 30)
    texts = [None, "", "abc"] + [word("ab", rng.randrange(0, 80)) for _ in range(40)]
    texts += [word("abcdefghé", rng.randrange(0, 60)) + common[rng.randrange(0, 4) :] + word("abcdefghé", rng.randrange(0, 60)) for _ in range(60)]
    base = texts[60]
    for _ in range(30):  # near copies
        i = rng.randrange(len(base))
        texts.append(base[:i] + rng.choice("xyz") + base[i + 1 :])
    return texts + [texts[50]] * 3 + ["z" * 500]


@pytest.mark.parametrize("length, gram, most", [(20, 8, 1000), (20, 8, 3), (40, 16, 2)])
def test_removal_against_all_strings(spark, monkeypatch, length, gram, most):
    """With a small `most` the groups are split round by round, with small blocks long texts are cut."""
    if most == 3:
        monkeypatch.setattr(suffixes, "_BLOCK", 64)
    texts = texts_with_repeats()
    rows = [(i or None, t, "k", 7, 8) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string, spans int, k1 int").repartition(3)
    got = {r["doc_id"] or 0: r for r in suffixes.without_repeats(df, length=length, gram=gram, most=most).collect()}
    for i, hit in enumerate(covered([(t or "").encode() for t in texts], length)):
        raw = (texts[i] or "").encode()
        edges = np.flatnonzero(np.diff(np.frombuffer(bytes(1) + bytes(hit) + bytes(1), np.uint8).astype(int)))
        assert [(s["s"], s["e"]) for s in got[i]["spans"]] == list(zip(edges[::2].tolist(), edges[1::2].tolist()))
        assert bytes(got[i]["kept"]) == bytes(b for b, gone in zip(raw, hit) if not gone)
        assert (got[i]["n_bytes"], got[i]["n_removed"]) == (len(raw), sum(hit))


def test_no_rows_and_bad_sizes(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.without_repeats(empty).collect() == []
    with pytest.raises(ValueError):
        suffixes.without_repeats(empty, length=100, gram=48)


def test_a_long_text_that_repeats_in_itself(spark):
    rng = random.Random(8)
    half = "".join(rng.choice("abcdefghijklmnop ") for _ in range(400_000))
    df = spark.createDataFrame([(1, half + "-" + half), (2, half[1000:1399]), (3, half[2000:2400])], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], [tuple(s) for s in r["spans"]]) for r in suffixes.without_repeats(df).collect()}
    assert got == {1: (800_000, [(0, 400_000), (400_001, 800_001)]), 2: (0, []), 3: (400, [(0, 400)])}
