"""Toxicity by a weighted lexicon.

Texts are folded (case, look-alike letters, digits in place of letters) and read once by an Aho-Corasick automaton.
Entries are words and beginnings of words; their weights are log odds between labelled documents. Matches inside
exception phrases don't count. The sum of weights, plain and per length, gives a probability by logistic regression.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftspark.llm.common import fit_logistic, labelled

#: Cyrillic, Greek and other letters that look like Latin ones, and digits and signs written for letters.
LOOK_ALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t",
    "у": "y", "х": "x", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t",
    "υ": "u", "χ": "x", "ɑ": "a", "ɡ": "g", "ı": "i", "ⅼ": "l",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
INVISIBLE = "​‌‍⁠﻿­"
#: Phrases in which a word of insult insults nobody; the fit adds those that it finds.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "class clown", "clown fish", "pond scum", "soap scum")

_LETTERS = str.maketrans(LOOK_ALIKES | {chr(0xFF41 + i): chr(97 + i) for i in range(26)} | dict.fromkeys(INVISIBLE))
_WRITTEN = re.compile(r"[013457@$]++(?:[^\W\d_]++[013457@$]++)*+[^\W\d_]*+")
_RUN = re.compile(r"[013457@$]+")
_WORD = re.compile(r"[^\W\d_]+")
_SIGNS = str.maketrans(DIGITS)
#: The automaton reads i and l as one letter; matches are compared letter by letter.
_ONE = str.maketrans("i", "l")


class Folded(str):
    """A folded text. At `either` a '1' stands for i, and may be l. At `soft` places a word may begin or end though letters
    go on: beside and inside runs of signs at either end of a word, or of three or more, which may be no letters.
    """

    either: frozenset[int] = frozenset()
    soft: frozenset[int] = frozenset()

    def readings(self) -> list[str]:
        """The text, with each '1' as i or as l, and with runs that may be no letters as letters or as blanks."""
        out = [str(self)]
        if self.either:
            out.append("".join("l" if i in self.either else c for i, c in enumerate(self)))
        if self.soft:
            out += ["".join(" " if i in self.soft and i + 1 in self.soft else c for i, c in enumerate(t)) for t in out]
        return out


def fold(text: str) -> Folded:
    """Lower case, look-alikes and signs as letters; signs (runs of any length) only in words that have a letter."""
    text = text.lower()
    if not text.isascii():
        text = text.translate(_LETTERS)
    parts, either, soft, done = [], set(), set(), 0
    for m in _WRITTEN.finditer(text):
        begin, end = m.span()
        inside = _WORD.match(text, begin - 1) is not None if begin else False
        if not inside and _RUN.fullmatch(m[0]):
            continue
        parts += text[done:begin], m[0].translate(_SIGNS)
        done = end
        for run in _RUN.finditer(text, begin, end):
            a, b = run.span()
            if a == begin and not inside or b == end or b - a > 2:
                soft.update(range(a, b + 1))
        either.update(i for i in range(begin, end) if text[i] == "1")
    if not done:
        return Folded(text)
    folded = Folded("".join((*parts, text[done:])))
    folded.either, folded.soft = frozenset(either), frozenset(soft)
    return folded


@dataclass
class Lexicon:
    """`entries` end in a blank where the whole word must match; weights are log odds."""

    entries: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    model: tuple | None = None
    _automaton: object = field(default=None, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}

    def _ready(self):
        if self._automaton is None:
            words: dict[str, list] = {}
            for e in self.entries:
                word = e.rstrip(" ")
                words.setdefault(word, [None, None, False])[int(e == word)] = self.entries[e]
            for phrase in self.exceptions:
                words[str(fold(phrase))] = [None, None, True]
            alike: dict[str, list] = {}
            for word, values in words.items():
                alike.setdefault(word.translate(_ONE), []).append((word, *values))
            automaton = ahocorasick.Automaton()
            for form, readings in alike.items():
                automaton.add_word(form, (len(form), readings))
            automaton.make_automaton()
            self._automaton = automaton
        return self._automaton

    def hits(self, folded: Folded) -> list[tuple[int, int, float]]:
        """Start, end and weight of each word that matches: of its entries the whole word, else the longest beginning.

        Of matches that overlap, as readings of one written word may, the best stays.
        """
        if not self.entries:
            return []
        either, soft = getattr(folded, "either", ()), getattr(folded, "soft", ())
        found: dict[int, tuple[bool, int, float]] = {}
        spared: list[tuple[int, int]] = []
        for last, (n, readings) in self._ready().iter(folded.translate(_ONE)):
            start, end = last + 1 - n, last + 1
            if start and folded[start - 1].isalpha() and start not in soft:
                continue
            ends = end == len(folded) or not folded[end].isalpha() or end in soft
            here = folded[start:end]
            for word, whole, part, exception in readings:
                if word != here and not all(a == b or i in either for i, (a, b) in enumerate(zip(word, here), start)):
                    continue
                if exception:
                    if ends:
                        spared.append((start, end))
                    continue
                weight = whole if ends and whole is not None else part
                if weight is not None:
                    candidate = (ends and whole is not None, n, weight)
                    if candidate > found.get(start, (False, 0, 0.0)):
                        found[start] = candidate
        if soft and len(found) > 1:
            best, until = {}, -1
            for s in sorted(found):  # overlapping ones follow each other
                if s < until and found[s] <= found[kept]:
                    continue
                if s < until:
                    del best[kept]
                best[s], kept, until = found[s], s, s + found[s][1]
            found = best
        return [(s, s + n, w) for s, (_, n, w) in found.items() if not any(a <= s and s + n <= b for a, b in spared)]

    def features(self, text: str) -> tuple[float, float, float, float]:
        """Sum of weights, by length, per 1,000 words, and the largest weight. All are zero where nothing matches."""
        folded = fold(text)
        found = self.hits(folded)
        if not found:
            return 0.0, 0.0, 0.0, 0.0
        total, n = sum(w for _, _, w in found), len(_WORD.findall(folded))
        return math.log1p(total), math.log1p(total) / (1 + math.log1p(n / 50)), math.log1p(1000 * total / (n + 50)), max(w for _, _, w in found)

    def scores(self, rows: list[tuple]) -> np.ndarray:
        if self.model is None:
            return np.zeros(len(rows))
        centre, scale, w = self.model
        z = np.c_[(np.array(rows).reshape(-1, 4) - centre) / scale, np.ones(len(rows))]
        return 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))


def _terms(text: str, shortest: int = 4, longest: int = 8) -> set[str]:
    """Whole words from two letters on, and beginnings of `shortest` to `longest` letters."""
    out = set()
    for w in {w for reading in fold(text).readings() for w in _WORD.findall(reading)}:
        if len(w) > 1:
            out.add(w + " ")
            out.update(w[:k] for k in range(shortest, min(len(w), longest + 1)))
    return out


def _count(sample: DataFrame, terms_of, wanted: set[str] | None = None) -> DataFrame:
    """(term, n): documents that hold a term, added up in each batch first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter[str] = Counter()
            for text in batch.column(0).to_pylist():
                found = terms_of(text)
                counts.update(found if wanted is None else found & wanted)
            yield pa.RecordBatch.from_pydict({"term": pa.array(counts.keys(), pa.string()), "n": pa.array(counts.values(), pa.int64())})

    return sample.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, labels: DataFrame, *, most: int = 12_000, fewest: int = 4, log_odds: float = 2.0, evidence: float = 20.0, entries: int = 2_000) -> Lexicon:
    """Learn weights, exceptions and the logistic model from about `most` labelled documents.

    A term is an entry if `fewest` toxic documents hold it, its log odds reach `log_odds` and twice its log likelihood
    ratio reaches `evidence`; the `entries` best stay. A beginning is one only if it catches clearly more than its best
    longer form. Without documents of both labels nothing is learnt and all scores are zero.
    """
    sample = labelled(docs, labels, "toxic", most)
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return Lexicon({})
    toxic = {r["term"]: r["n"] for r in _count(sample.where("y = 1"), _terms).where(F.col("n") >= fewest).collect()}
    clean = {r["term"]: r["n"] for r in _count(sample.where("y = 0"), _terms, set(toxic)).collect()}
    odds, weight = {}, {}
    for term, a in toxic.items():
        b = clean.get(term, 0)
        expected = (a + b) * n1 / (n1 + n0)
        odds[term] = math.log((a + 0.5) / (n1 + 1)) - math.log((b + 0.5) / (n0 + 1))
        weight[term] = 2 * (a * math.log(a / expected) + (b * math.log(b / (a + b - expected)) if b else 0))
    longer: dict[str, int] = {}
    for term, a in toxic.items():
        for k in range(1, len(term)):
            longer[term[:k]] = max(longer.get(term[:k], 0), a)
    good = [t for t in toxic if odds[t] >= log_odds and weight[t] >= evidence and (t.endswith(" ") or toxic[t] >= 1.3 * longer.get(t, 0))]
    lexicon = Lexicon({t: odds[t] for t in sorted(good, key=lambda t: (-weight[t], t))[:entries]})

    def phrases(text: str) -> set[str]:
        folded = fold(text)
        words = [(m.start(), m.end()) for m in _WORD.finditer(folded)]
        at = {s: i for i, (s, _) in enumerate(words)}
        out = set()
        for s, _, _ in lexicon.hits(folded):
            i = at.get(s)
            if i is not None:
                out.update(folded[words[a][0] : words[b][1]] for a, b in ((i - 1, i), (i, i + 1)) if a >= 0 and b < len(words))
        return out

    harmless = {r["term"] for r in _count(sample.where("y = 0"), phrases).where(F.col("n") >= 5).collect()}
    if harmless:
        harmless -= {r["term"] for r in _count(sample.where("y = 1"), phrases, harmless).collect()}
    lexicon = Lexicon(lexicon.entries, EXCEPTIONS + tuple(sorted(harmless)))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([lexicon.features(t) for t in batch.column(0).to_pylist()]).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([*(pa.array(rows[:, k]) for k in range(4)), batch.column(1)], ["a", "b", "c", "d", "y"])

    # five numbers for each document of the sample
    table = np.array(sorted(tuple(r) for r in sample.mapInArrow(features, "a double, b double, c double, d double, y int").collect()))
    lexicon.model = fit_logistic(table[:, :4], table[:, 4])
    return lexicon


def toxicity(docs: DataFrame, lexicon: Lexicon, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every whole text: `score` is the probability of label 1.

    Null and empty texts match nothing and get the score of all texts that match nothing; repeated rows come back
    repeated; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # at most `entries` words and the exceptions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lexicon.scores([lexicon.features(t or "") for t in texts]), pa.float64())], ["id", "score"]
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)


def without_toxic(docs: DataFrame, lexicon: Lexicon, *, limit: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that score under `limit`, all columns as they are, whatever their names.

    Null and empty texts score as all texts that match nothing; equal texts stay or go together, and repeated rows stay
    repeated; a null id changes nothing, as ids are not read; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    @F.arrow_udf("boolean")
    def passes(texts: pa.Array) -> pa.Array:
        lexicon = shared.value
        return pa.array(lexicon.scores([lexicon.features(t or "") for t in texts.to_pylist()]) < limit, pa.bool_())

    return docs.where(passes(F.col(text_col).cast("string")))
