"""Token counts and packing against the tokenizers library and brute force."""

import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from driftspark.llm import packing, tokens

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", " ", "Hello world", "a  b\n\n c's it'll '  x\t\t　 y\xa0\xa0 z", "<|endoftext|>a <|endoftext|> b<|endo<|endoftext|>", "x" * 3000,
    "日本語 \U0001f389 \x1c\x1d a\x85b", "!!'re '''s 12 345 ½", "ΑΣ İstanbul ﬁ <|ENDOFTEXT|> Don't I'LL",
]


@pytest.fixture(scope="module")
def counter():
    return tokens.PrefixCounter(Path(BYTES).read_text())


@pytest.fixture(scope="module")
def encoder():
    return packing.WordEncoder(Path(WORDS).read_text())


def count(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("text", TEXTS[1:])
def test_every_prefix(counter, text):
    library = Tokenizer.from_file(BYTES)
    text = text[:300]
    assert counter.prefixes(text).tolist() == [count(library, text[:i]) for i in range(1, len(text) + 1)]
    assert counter.count(text) == count(library, text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=" \n\t\xa0'sterdvlm<|>ofaxZ09.,éİΣ日\x1ć", max_size=40))
def test_any_text(text):
    counter, encoder = KEPT
    assert counter.count(text) == count(LIBRARIES[0], text)
    assert counter.prefixes(text).tolist() == [count(LIBRARIES[0], text[:i]) for i in range(1, len(text) + 1)]
    assert np.frombuffer(encoder(text), "<u4").tolist() == LIBRARIES[1].encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["abcé" * 40, "the quick" * 30, "日本語" * 30, "'" * 90, " " * 150 + "x", "\n \t" * 60, "a" + "9" * 200 + "!?" * 70])
def test_every_prefix_of_long_pieces(counter, text):
    library = Tokenizer.from_file(BYTES)
    assert counter.prefixes(text).tolist() == [count(library, text[:i]) for i in range(1, len(text) + 1)]
    assert counter.count(text) == count(library, text)


def test_one_word_of_200000_letters(counter):
    """Memory grows with the word, not with its square, and nothing of it stays."""
    import tracemalloc

    word = "".join("abcdefghijklmnopqrstuvwxyz"[i * i % 26] for i in range(200_000))
    kept = len(counter.prefix)
    tracemalloc.start()
    got = counter.count(word + " end")
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == count(Tokenizer.from_file(BYTES), word + " end")
    assert most < 30 * len(word) and len(counter.prefix) < kept + 100
    table = counter.prefixes(word)
    assert len(table) == len(word) and table[-1] == counter.count(word)


LIBRARIES = [Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS)]
KEPT = (tokens.PrefixCounter(Path(BYTES).read_text()), packing.WordEncoder(Path(WORDS).read_text()))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(2, " ", "x", 1), (None, "null id", "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, offset int")


def test_counts_of_rows(spark, docs):
    got = tokens.token_counts(docs, Path(BYTES).read_text(), prefixes=True).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        if r.doc_id is not None:
            text = TEXTS[r.doc_id] or ""
            assert (r.n_bytes, r.n_tokens, len(r.prefix_tokens)) == (len(text.encode()), count(LIBRARIES[0], text), len(text))
    assert tokens.token_counts(docs.limit(0), Path(BYTES).read_text()).count() == 0


def test_questions_about_prefixes(spark, docs):
    got = tokens.token_counts(docs.where("doc_id = 3"), Path(BYTES).read_text(), prefixes=True)
    row = got.select(tokens.tokens_at(5).alias("five"), tokens.tokens_at(0).alias("none"), tokens.tokens_at(99).alias("whole"), tokens.prefix_within(1).alias("fits")).first()
    assert (row.five, row.none, row.whole) == (1, 0, 2)
    assert row.fits == 5


def places(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append(r)
    for group in by.values():
        at = 0
        for r in sorted(group, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by)


def test_packing(spark, docs):
    got = packing.pack(docs, Path(WORDS).read_text(), capacity=64, large_from=12, groups=4).collect()
    places(got, 64)
    found = defaultdict(set)
    for r in got:
        found[r.doc_id].add((r.piece, r.start, r.length, r.ids_crc32))
    for i, text in enumerate(TEXTS):
        ids = np.array(LIBRARIES[1].encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        assert found[i] == {(k, at, len(ids[at : at + 64]), zlib.crc32(ids[at : at + 64].tobytes())) for k, at in enumerate(range(0, len(ids), 64))}
    assert sum(r.doc_id == 2 for r in got) == 2
    assert packing.pack(docs.limit(0), Path(WORDS).read_text()).count() == 0


def test_few_sequences(spark):
    docs = spark.range(600).selectExpr("id AS doc_id", "repeat('w ', cast(pow(1.5, id % 13) as int) + cast(id % 7 as int)) AS text")
    got = packing.pack(docs, Path(WORDS).read_text(), capacity=256, large_from=40, groups=8).collect()
    assert len(got) == 600
    bound = -(-sum(r.length for r in got) // 256)
    assert places(got, 256) <= 1.03 * bound + 1


def test_equal_lengths(spark):
    docs = spark.range(500).selectExpr("id AS doc_id", "repeat('w ', 99) AS text")
    got = packing.pack(docs, Path(WORDS).read_text(), capacity=256, large_from=40, groups=8).collect()
    assert places(got, 256) == 250


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 63), st.integers(1, 30), min_size=1, max_size=25))
def test_plans_hold_all(histogram):
    large = {n: c for n, c in histogram.items() if n >= 12}
    small = {n: c for n, c in histogram.items() if n < 12}
    rows, sequences = packing.large_places(large, 64, 5)
    order = [n for n in sorted(large, reverse=True) for _ in range(large[n])]
    used = np.zeros(sequences, int)
    taken = np.zeros(len(order), int)
    for first, stop, at in rows:
        stop = min(stop, len(order))
        used[at : at + stop - first] += order[first:stop]
        taken[first:stop] += 1
    assert (taken == 1).all() and (used <= 64).all()
    room = defaultdict(int)
    for u in used.tolist():
        room[64 - u] += 1
    left = {}
    for size, first, stop, source, at in packing.small_places(small, dict(room), 64).tolist():
        for k in range(stop - first):
            key = (source, at + k)
            left[key] = left.get(key, 64 if source < 0 else source) - size
            assert left[key] >= 0
        small[size] -= stop - first
    assert not any(small.values())
