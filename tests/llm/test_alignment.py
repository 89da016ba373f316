"""Token alignment against a plain walk over both token lists."""

import random
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from driftspark.llm import alignment

MODEL_A = Path(public_tokenizers.path("byte_bpe_50k.json")).read_text()
MODEL_B = Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes()
ODD = [
    "a b", "a  b ", "a", "  ", " ", "a ", "x\n y", "x \n  y\t z", "▁x", "a▁b", "\x00 a", "é è ﬁ 中文 字 <|endoftext|> <s>", "don't can't I'll",
    "a　 b", "\x1c a", "\x85 b", "a" * 3000, "ab " * 300, " 's", "é ́a", "🙂 🙂🙂", None, "",
]


def brute_cuts(a, b):
    both = set(a) & set(b)
    return [i + 1 for i, e in enumerate(a) if e in both], [i + 1 for i, e in enumerate(b) if e in both]


def test_groups_against_common_ends():
    rng = random.Random(2)
    for _ in range(500):
        last = rng.randrange(1, 120)
        share = rng.choice([0.02, 0.3, 0.9, 1.0])
        a, b = ({last, *(e for e in range(1, last) if rng.random() < share)} for _ in range(2))
        if rng.random() < 0.3:
            b |= {e for e in a if rng.random() < 0.97}
        a, b = sorted(a), sorted(b)
        got = alignment.groups(np.array(a), np.array(b))
        assert tuple(x.tolist() for x in got) == brute_cuts(a, b)
    assert [len(x) for x in alignment.groups(np.zeros(0, int), np.zeros(0, int))] == [0, 0]


def test_repeated_words_are_aligned_once(monkeypatch):
    words, ends, groups = alignment.Words(MODEL_A, MODEL_B), [], alignment.groups
    monkeypatch.setattr(alignment, "groups", lambda a, b: ends.append(len(a)) or groups(a, b))
    codes = words.codes_of(["unlikely", "\U0001f642x", "words"] * 500)
    aligned = alignment.Aligned(words, codes)
    words.codes_of(["words", "unlikely"])
    assert sum(ends) * 500 == len(aligned.a)
    ends_a, ends_b = np.cumsum(words.size_a[aligned.a]), np.cumsum(words.size_b[aligned.b])
    assert [x.tolist() for x in (aligned.cut_a, aligned.cut_b)] == [x.tolist() for x in groups(ends_a, ends_b)]


def spelt(words, side):
    data, starts = words.spelt[side]
    return [data[x:y].tobytes() for x, y in zip(starts[:-1], starts[1:])]


def brute(texts):
    """Of each text the columns of `align` without the id."""
    whole_a, whole_b = Tokenizer.from_str(MODEL_A), sentencepiece.SentencePieceProcessor(model_proto=MODEL_B)
    whole_a.encode_special_tokens = True
    words = alignment.Words(MODEL_A, MODEL_B)
    raw_a, raw_b = spelt(words, 0), spelt(words, 1)

    def spans(ids, raw):
        at, out = 0, []
        for i in ids:
            out.append((at, at + len(raw[i]), i))
            at = out[-1][1]
        return out

    docs, count = [], Counter()
    for text in texts:
        a, b, links = [], [], []
        if text:
            ids_a, ids_b = whole_a.encode(" " + text, add_special_tokens=False).ids, whole_b.encode(text)
            if b"".join(raw_a[i] for i in ids_a) == (" " + text).encode() == b"".join(raw_b[i] for i in ids_b):
                a, b = spans(ids_a, raw_a), spans(ids_b, raw_b)
                first = 0
                for s, e, x in a:
                    while b[first][1] <= s:
                        first += 1
                    j = first
                    while j < len(b) and b[j][0] < e:
                        links.append((x, b[j][2]))
                        j += 1
        count.update(links)
        docs.append((a, b, links))
    best = {}
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for a, b, links in docs:
        cut_a, cut_b = brute_cuts([e for _, e, _ in a], [e for _, e, _ in b])
        listed = lambda side, x, y: ",".join(str(i) for _, _, i in side[x:y])
        parts = [listed(a, x, y) + "|" + listed(b, u, v) for x, y, u, v in zip([0, *cut_a], cut_a, [0, *cut_b], cut_b)]
        best_links = sum(count[link] == best[link[1]] for link in links)
        out.append((len(a), len(b), len(parts), len(links), ";".join(parts), best_links, sum(count[link] for link in links)))
    return out


@pytest.mark.parametrize("most_pairs", [4_000_000, 0])
def test_align_against_brute_force(spark, most_pairs):
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("ab'  \n\t1.,中é▁ ́🙂\x1f") for _ in range(rng.randrange(1, 25))) for _ in range(150)]
    texts += [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(60).collect()]
    texts += texts[-3:]  # repeated rows count each time
    df = spark.createDataFrame([(i if i else None, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_a int, groups string")
    got = {r["doc_id"] or 0: tuple(r)[1:] for r in alignment.align(df.repartition(4), MODEL_A, MODEL_B, most_pairs=most_pairs).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_forgetting_words_changes_nothing(spark, monkeypatch):
    texts = [f"word{i} and wörd{i % 7}" for i in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    want = sorted(map(tuple, alignment.align(df, MODEL_A, MODEL_B).collect()))
    monkeypatch.setattr(alignment, "_WORDS", 3)
    monkeypatch.setattr(alignment, "slices", lambda batch, column, most: (batch.slice(i, 20) for i in range(0, batch.num_rows, 20)))
    assert sorted(map(tuple, alignment.align(df, MODEL_A, MODEL_B).collect())) == want


def test_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(empty, MODEL_A, MODEL_B).collect() == []
