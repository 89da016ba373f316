"""Words and their hashes: equal for equal words wherever they are, in memory bounded by the words."""

import random
import tracemalloc

import pyarrow as pa

from driftspark.llm import common


def test_hashes_name_words():
    rng = random.Random(1)
    words = ["".join(rng.choice("abc") for _ in range(rng.choice([1, 2, 3, 9, 5000, 20_000]))) for _ in range(200)] + ["x" * 900_000, "x" * 900_001]
    words += words[::3]
    found = common.Words(pa.array([" ".join(words[:150]), None, "", " ".join(words[150:])]), common.blank_separated())
    names = {}
    hashes = found.hashes().tolist()
    assert len(hashes) == len(words) and all(names.setdefault(w, h) == h for w, h in zip(words, hashes))
    assert len(set(names.values())) == len(names)


def test_a_long_text_takes_a_bounded_multiple_of_memory():
    column = pa.array(["some words of a text " * 1_000_000])
    tracemalloc.start()
    common.Words(column, common.blank_separated(), common.lower_ascii()).hashes()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 16 * 21_000_000
