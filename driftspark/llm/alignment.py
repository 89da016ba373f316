"""Alignment of two tokenizers' tokens by diagonal run skipping.

Both cut the same bytes, so tokens align where both have an end. Ends are compared at the present shift of indices: as
long as they are equal, tokens go one to one, and exponential probing compares ever longer stretches of both arrays at
once. Where ends differ, the smaller one moves on until they meet; that group is irregular, and the shift is updated.

Neither tokenizer joins bytes across a space that follows something other than white space, so a text is cut there, and
words that repeat are encoded and aligned once in a task. That is checked: a text whose tokens do not give its bytes has none.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftspark.llm.common import slices, staged

#: Fixed value: the pattern that cuts a text before the merges of the byte-level tokenizer.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CUT = re.compile(r"(?<=\S) ")
_BLANKS = re.compile(r"\s ")
#: Words and tokens that a task remembers before it forgets all.
_WORDS, _TOKENS = 400_000, 4_000_000


def groups(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of either side each group reaches to, in order: after groups of 1 and 1, 2 and 1 tokens these are
    1, 3 and 1, 2. Both arrays rise and have the same last end."""
    ends_a, ends_b = np.ascontiguousarray(ends_a, np.int64), np.ascontiguousarray(ends_b, np.int64)
    a, b, raw_a, raw_b = memoryview(ends_a), memoryview(ends_b), ends_a.tobytes(), ends_b.tobytes()
    n, m = len(a), len(b)
    at_a, at_b, sizes = [], [], []  # groups of one token each in a row: where the first one ends, and how many there are
    i = j = 0
    while i < n:
        x, y = a[i], b[j]
        if x != y:  # an irregular group: the smaller end moves on until both meet
            while x != y:
                if x < y:
                    i += 1
                    x = a[i]
                else:
                    j += 1
                    y = b[j]
            i += 1
            j += 1
            at_a.append(i)
            at_b.append(j)
            sizes.append(1)
            continue
        # One to one at shift j - i: twice as many tokens with every probe, then half as many, from the last that agreed.
        # Ends are compared as they lie in memory, eight bytes each.
        most = 8 * (n - i if n - i < m - j else m - j)
        p, q = 8 * i, 8 * j
        k = step = 8
        while k + step <= most and raw_a[p + k : p + k + step] == raw_b[q + k : q + k + step]:
            k += step
            step += step
        step >>= 1
        while step > 7:
            if k + step <= most and raw_a[p + k : p + k + step] == raw_b[q + k : q + k + step]:
                k += step
            step >>= 1
        k >>= 3
        at_a.append(i + 1)
        at_b.append(j + 1)
        sizes.append(k)
        i += k
        j += k
    sizes = np.array(sizes, np.int64)
    more = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.repeat(np.array(at_a, np.int64), sizes) + more, np.repeat(np.array(at_b, np.int64), sizes) + more


def _joined(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, values), np.int64, len(values)))])
    return np.frombuffer(b"".join(values), np.uint8), starts


def _byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class _Codes(dict):
    """Numbers of words in order of their first occurrence; `new` are the words not learnt yet."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = code = len(self)
        self.new.append(word)
        return code


def _gathered(starts: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the values of words lie, one word after the other, and how many each word has."""
    n = starts[codes + 1] - starts[codes]
    before = np.cumsum(n) - n
    return np.repeat(starts[codes] - before, n) + np.arange(int(n.sum())), n


class Words:
    """Tokens of words by both tokenizers. A word is a space and what follows it up to the next one that is a cut."""

    def __init__(self, model_a: str, model_b: bytes):
        import sentencepiece

        read = json.loads(model_a)
        special = {t["content"] for t in read["added_tokens"]}
        names = _byte_names()
        ids = {bytes(names[c] for c in t): i for t, i in read["model"]["vocab"].items() if t not in special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in read["model"]["merges"]]
        vocab = read["model"]["vocab"]
        made = [vocab[x + y] for x, y in merges]
        if read["normalizer"] or read["pre_tokenizer"]["type"] != "ByteLevel" or read["pre_tokenizer"]["add_prefix_space"] or made != sorted(made):
            raise ValueError("a byte-level BPE without normalizer is needed, with ids in order of merges")
        # Ids are in order of merges, so they serve as ranks; special strings are ordinary text.
        self.a = tiktoken.Encoding("a", pat_str=PIECES, mergeable_ranks=ids, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model_b)
        bytes_a = {i: t for t, i in ids.items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for i, p in enumerate(pieces) if not self.b.is_control(i)):
            raise ValueError("a piece goes on behind a space")
        raw = lambda i, p: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
        #: Bytes of all tokens of either side, one after the other, and where each one's begin.
        self.spelt = [_joined([bytes_a.get(i, b"") for i in range(max(bytes_a) + 1)]), _joined([raw(i, p) for i, p in enumerate(pieces)])]
        self.size_a, self.size_b = (np.diff(starts) for _, starts in self.spelt)
        self.forget()

    def forget(self) -> None:
        self.codes = _Codes()
        self.fine = np.zeros(0, bool)
        self.tokens = [np.zeros(0, np.int32), np.zeros(0, np.int32)]
        self.starts = [np.zeros(1, np.int64), np.zeros(1, np.int64)]
        #: Of each word the tokens of A and B that its groups reach to, and those that its links hold.
        self.groups = [np.zeros(0, np.int32), np.zeros(0, np.int32)]
        self.links = [np.zeros(0, np.int32), np.zeros(0, np.int32)]
        self.group_starts, self.link_starts = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def crowded(self) -> bool:
        return len(self.codes) > _WORDS or len(self.tokens[0]) + len(self.tokens[1]) > _TOKENS

    def cut(self, text: str) -> list[str]:
        """Words without the space that begins each of them."""
        whole = " " + text
        if not _BLANKS.search(whole):
            return text.split(" ")
        parts = _CUT.split(whole)
        parts[0] = parts[0][1:]
        return parts

    def codes_of(self, parts: list[str]) -> np.ndarray:
        codes = np.fromiter(map(self.codes.__getitem__, parts), np.int64, len(parts))
        if self.codes.new:
            self.learn(self.codes.new)
            self.codes.new = []
        return codes

    def learn(self, new: list[str]) -> None:
        encode = self.a.encode_ordinary
        tokens_a = [encode(" " + p) for p in new]
        tokens_b = self.b.encode(new, num_threads=1)
        behind = len(self.b.encode("a"))
        for i, p in enumerate(new):
            if not p or p[0] == " " and not p.strip(" "):  # spaces alone are what they are behind a letter
                tokens_b[i] = self.b.encode("a " + p)[behind:]
        raw, starts = _joined([b" " + p.encode() for p in new])
        fine = np.ones(len(new), bool)
        for side, lists in enumerate((tokens_a, tokens_b)):
            n = np.fromiter(map(len, lists), np.int64, len(lists))
            flat = np.fromiter(itertools.chain.from_iterable(lists), np.int32, int(n.sum()))
            fine &= self._spell(side, flat, n, raw, starts)
            self.tokens[side] = np.concatenate([self.tokens[side], flat])
            self.starts[side] = np.concatenate([self.starts[side], self.starts[side][-1] + np.cumsum(n)])
        self._align(np.flatnonzero(fine) + len(self.fine), len(self.fine) + len(new))
        self.fine = np.concatenate([self.fine, fine])

    def _align(self, codes: np.ndarray, total: int) -> None:
        """Groups and links of new words that their tokens spell; the others have none."""
        (a, n_a), (b, n_b) = self.expanded(codes, 0), self.expanded(codes, 1)
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        cut_a, cut_b = groups(ends_a, ends_b)
        # A link is a stretch of bytes without an end inside: it lies in one token of either side.
        size = int(ends_a[-1]) if len(ends_a) else 0
        mark_a, mark_b = np.zeros(size, bool), np.zeros(size, bool)
        mark_a[ends_a - 1] = True
        mark_b[ends_b - 1] = True
        last = np.flatnonzero(mark_a | mark_b)
        link_a, link_b = (np.cumsum(mark_a) - mark_a)[last], (np.cumsum(mark_b) - mark_b)[last]
        before_a, before_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        owner_a = np.repeat(np.arange(len(codes)), n_a)
        for kept, starts, x, y, owner in (
            (self.groups, "group_starts", cut_a, cut_b, owner_a[cut_a - 1]), (self.links, "link_starts", link_a, link_b, owner_a[link_a]),
        ):
            kept[0] = np.concatenate([kept[0], (x - before_a[owner]).astype(np.int32)])
            kept[1] = np.concatenate([kept[1], (y - before_b[owner]).astype(np.int32)])
            n = np.bincount(codes[owner] - len(self.fine), minlength=total - len(self.fine))
            setattr(self, starts, np.concatenate([getattr(self, starts), getattr(self, starts)[-1] + np.cumsum(n)]))

    def _spell(self, side: int, flat: np.ndarray, n: np.ndarray, raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Which words' tokens, `n` of each, spell the word."""
        spelt, begin = self.spelt[side]
        size = begin[flat + 1] - begin[flat]
        sizes = np.diff(np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(n)])])
        fine = sizes == np.diff(starts)
        # bytes of the words that are as long as they should be
        size, at = size[keep := np.repeat(fine, n)], begin[flat][keep]
        got = spelt[np.repeat(at - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        owner = np.repeat(np.arange(len(n)), np.diff(starts))
        inside = fine[owner]
        unlike = got != raw[inside]
        if unlike.any():
            fine[owner[inside][unlike]] = False
        return fine

    def expanded(self, codes: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of words one after the other, and how many each word has."""
        at, n = _gathered(self.starts[side], codes)
        return self.tokens[side][at], n


class Aligned:
    """Words in a row, aligned: tokens, groups and links of both sides."""

    def __init__(self, words: Words, codes: np.ndarray):
        self.a, self.n_a = words.expanded(codes, 0)
        self.b, self.n_b = words.expanded(codes, 1)
        before_a, before_b = np.cumsum(self.n_a) - self.n_a, np.cumsum(self.n_b) - self.n_b
        at, n = _gathered(words.group_starts, codes)
        self.cut_a, self.cut_b = words.groups[0][at] + np.repeat(before_a, n), words.groups[1][at] + np.repeat(before_b, n)
        at, n = _gathered(words.link_starts, codes)
        self.link_a, self.link_b = words.links[0][at] + np.repeat(before_a, n), words.links[1][at] + np.repeat(before_b, n)

    def pairs(self) -> np.ndarray:
        """Both ids of each link in one number."""
        return self.a[self.link_a].astype(np.int64) << 32 | self.b[self.link_b]

    def written(self, names: list[np.ndarray], a_cuts: np.ndarray, b_cuts: np.ndarray) -> list[str]:
        """The groups of each part; `a_cuts` and `b_cuts` are the tokens before each part, and all of them at the end.
        `names` are the ids of A with a comma and a bar behind them, of B with a comma and a semicolon."""
        n_a, n_b = len(self.a), len(self.b)
        last_a, last_b = np.zeros(n_a, bool), np.zeros(n_b, bool)
        last_a[self.cut_a - 1] = True
        last_b[self.cut_b - 1] = True
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        out = np.empty(n_a + n_b, object)
        b_before = np.concatenate([[0], self.cut_b])
        out[np.arange(n_a) + b_before[group_a]] = np.where(last_a, names[1][self.a], names[0][self.a])
        out[np.arange(n_b) + self.cut_a[group_b]] = np.where(last_b, names[3][self.b], names[2][self.b])
        cuts = (a_cuts + b_cuts).tolist()
        flat = out.tolist()
        return ["".join(flat[x:y])[:-1] for x, y in zip(cuts[:-1], cuts[1:])]


def _texts(words: Words, part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all words of texts that have tokens, how many each text has, and which texts those are."""
    texts = part.column(part.num_columns - 1).to_pylist()
    if words.crowded():
        words.forget()
    cut = [words.cut(t) if t else [] for t in texts]
    n = np.array([len(c) for c in cut], np.int64)
    codes = words.codes_of([w for c in cut for w in c])
    owner = np.repeat(np.arange(len(texts)), n)
    ok = n > 0
    ok[owner[~words.fine[codes]]] = False
    return codes[ok[owner]], np.where(ok, n, 0), ok


def _pair_counts(models):
    """(pair, n) of a partition: each different word is aligned once, and counts as often as it occurs."""

    def flushed(words: Words, times: np.ndarray) -> pa.RecordBatch:
        codes = np.flatnonzero(times)
        aligned = Aligned(words, codes)
        weight = np.repeat(times[codes], aligned.n_a)[aligned.link_a]
        pair, at = np.unique(aligned.pairs(), return_inverse=True)
        n = np.zeros(len(pair), np.int64)
        np.add.at(n, at, weight)
        return pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], ["pair", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, times = Words(*models.value), np.zeros(0, np.int64)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                if words.crowded():
                    yield flushed(words, times)
                    words.forget()
                    times = times[:0]
                codes, _, _ = _texts(words, part)
                times = np.concatenate([times, np.zeros(len(words.codes) - len(times), np.int64)])
                times += np.bincount(codes, minlength=len(times))
        yield flushed(words, times)

    return run


def _aligned_texts(models, counts, with_pairs: bool):
    """Rows (id, n_a, n_b, n_groups, n_links, groups), and either n_best and count_sum or all pairs of the text's links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(*models.value)
        written = lambda size, mark: np.array([f"{i}{mark}" for i in range(size)], object)
        names = [written(len(words.size_a), ","), written(len(words.size_a), "|"), written(len(words.size_b), ","), written(len(words.size_b), ";")]
        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                codes, n, ok = _texts(words, part)
                aligned = Aligned(words, codes)
                word_cuts = np.concatenate([[0], np.cumsum(n)])
                before = lambda per_word: np.concatenate([[0], np.cumsum(per_word)])[word_cuts]
                a, b = before(aligned.n_a), before(aligned.n_b)
                group = np.searchsorted(aligned.cut_a, a, "right")
                link = np.searchsorted(aligned.link_a, a, "left")
                per = [pa.array(np.diff(x).astype(np.int64)) for x in (a, b, group, link)]
                texts = pa.array(aligned.written(names, a, b), pa.large_string())
                pairs = aligned.pairs()
                if with_pairs:
                    more = [pa.array([pairs[x:y] for x, y in zip(link[:-1], link[1:])], pa.list_(pa.int64()))]
                    labels = ["pairs"]
                else:
                    keys, count, best = counts.value
                    at = np.searchsorted(keys, pairs)
                    total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x[at])])[link])
                    more = [pa.array(total(best.astype(np.int64))), pa.array(total(count))]
                    labels = ["n_best", "count_sum"]
                yield pa.RecordBatch.from_arrays([part.column(0), *per, texts.cast(pa.string()), *more], ["id", "n_a", "n_b", "n_groups", "n_links", "groups", *labels])

    return run


def pair_counts(docs: DataFrame, model_a: str, model_b: bytes, *, text_col: str = "text") -> DataFrame:
    """(pair, n, best): how many links of the corpus hold each pair of ids (that of A times 2**32, plus that of B), and
    whether that is the most that any pair of its B id has."""
    models = docs.sparkSession.sparkContext.broadcast((model_a, model_b))  # two tokenizer files, whatever the input
    rows = docs.select(F.col(text_col).cast("string").alias("text")).where(F.length("text") > 0)
    counts = staged(rows.mapInArrow(_pair_counts(models), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    side_b = F.col("pair").bitwiseAND((1 << 32) - 1).alias("b")
    most = counts.groupBy(side_b).agg(F.max("n").alias("most"))
    return counts.withColumn("b", side_b).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, model_a: str, model_b: bytes, *, id_col: str = "doc_id", text_col: str = "text", most_pairs: int = 4_000_000) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups, n_best, count_sum) of every row of `docs`.

    `model_a` is the text of a byte-level BPE tokenizer file, which gets a space and the text, `model_b` a sentencepiece
    model, which gets the text and adds the space. `groups` has the ids of each group, `a1,a2|b1;a3|b2,b3`. Links are pairs
    of tokens that share bytes; `n_best` counts those whose pair is the most frequent one of its B id in the corpus,
    ties included, `count_sum` sums their pairs' counts. Null and empty texts, and those that a tokenizer does not give
    back byte by byte, have no tokens: zeros, and no groups. Repeated rows come back repeated and count each time; a null
    id stays null; other columns are not read, whatever their names.

    Counts of pairs go to the executors where there are no more than `most_pairs` (16 bytes each), else links are joined.
    """
    spark = docs.sparkSession
    models = spark.sparkContext.broadcast((model_a, model_b))
    counts = staged(pair_counts(docs, model_a, model_b, text_col=text_col))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups string, "
    columns = ["n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"]
    if counts.count() <= most_pairs:
        known = counts.toArrow().sort_by("pair")
        known = spark.sparkContext.broadcast(tuple(known[c].to_numpy() for c in ("pair", "n", "best")))
        out = rows.mapInArrow(_aligned_texts(models, known, False), schema + "n_best long, count_sum long")
        return out.select(F.col("id").alias(id_col), *columns)
    base = staged(rows.mapInArrow(_aligned_texts(models, None, True), schema + "pairs array<long>").withColumn("key", F.sha2("groups", 256)))
    links = base.select("key", F.explode("pairs").alias("pair")).groupBy("key", "pair").agg(F.count(F.lit(1)).alias("times"))
    # Texts with equal groups have equal links: what several of them have together is divided by how many they are.
    alike = base.groupBy("key").agg(F.count(F.lit(1)).alias("alike"))
    sums = links.join(counts, "pair").groupBy("key").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")
    )
    sums = sums.join(alike, "key").select("key", F.expr("n_best div alike").alias("n_best"), F.expr("count_sum div alike").alias("count_sum"))
    out = base.join(sums, "key", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return out.select(F.col("id").alias(id_col), *columns[:5], zero("n_best"), zero("count_sum"))
