"""Token counts of byte-level BPE by dynamic programming over prefixes.

`last[i]` is the last token of the encoding of the first i bytes of a piece. It is the one token that ends at i and
stays beside the last token of what is before it, so a table over prefixes gives the exact number of tokens of every
prefix in one pass. Questions about truncation or budgets then read the table; nothing is encoded again.
"""

from __future__ import annotations

import gc
import itertools
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The pattern that cuts a text before the merges, and Unicode's white space.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLANK = "\t-\r \x85\xa0  -     　"
#: Chunks that a worker remembers at most; it forgets them all beyond that.
REMEMBERED = 500_000
#: Longer pieces and chunks are worked out each time, and no table keeps them or their prefixes.
LONG = 64


def _byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class PrefixCounter:
    """Counts tokens of every prefix. `model` is the text of a byte-level BPE tokenizer file without normalizer."""

    def __init__(self, model: str):
        read = json.loads(model)
        if read["normalizer"] or read["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError("a byte-level BPE without normalizer is needed")
        names = _byte_names()
        raw = lambda token: bytes(names[c] for c in token)
        self.special = [t["content"] for t in read["added_tokens"]]
        skip = set(self.special)
        self.ids = {raw(t): i for t, i in read["model"]["vocab"].items() if t not in skip}
        merges = [m.split(" ") if isinstance(m, str) else m for m in read["model"]["merges"]]
        at = {t: i for t, i in read["model"]["vocab"].items()}
        self.made_at = [-1] * (1 + max(at.values()))  # rank of the merge that makes a token; single bytes have none
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[int, int] = {}
        for rank, (x, y) in enumerate(merges):
            made = at[x + y]
            if made not in self.halves:
                self.made_at[made] = rank
                self.halves[made] = at[x], at[y]
            self.joined[at[x] << 16 | at[y]] = rank
        if max(self.ids.values()) > 65535:
            raise ValueError("at most 65,536 tokens")
        self.cut = regex.compile(PIECES)
        self.chunks = re.compile(f"[{BLANK}]*[^{BLANK}]+|[{BLANK}]+")
        self.blanks = re.compile(f"[{BLANK}]*")
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.stays: dict[int, bool] = {}
        self.prefix: dict[bytes, int] = {}
        self.counts: dict[str, int] = {}
        self.ends: dict = {}
        for token, i in self.ids.items():
            node = self.ends
            for byte in reversed(token):
                node = node.setdefault(byte, {})
            node[-1] = i
        self.longest = max(map(len, self.ids))
        self.known: dict[str, tuple[int, np.ndarray]] = {}

    def _beside(self, key: int) -> bool:
        """Whether both stay tokens when one follows the other.

        Merges happen by rank. The two are undone from the latest merge back, inner halves only; if two halves that
        touch would have been merged before the merges that hide them, the tokens don't stay.
        """
        a, b = key >> 16, key & 65535
        joins, made_at, halves = self.joined, self.made_at, self.halves
        found, hidden = True, 1 << 60  # rank of the merge that takes a or b from the other's sight
        while True:
            joined = joins.get(a << 16 | b)
            if joined is not None and joined < hidden:
                found = False
                break
            ra, rb = made_at[a], made_at[b]
            if ra < 0 and rb < 0:
                break
            if ra >= rb:  # of two ranks alike, the left one is merged first: the right one is then undone first
                if ra == rb:
                    hidden = rb + 1
                    b = halves[b][0]
                else:
                    hidden = ra
                    a = halves[a][1]
            else:
                hidden = rb + 1
                b = halves[b][0]
        if len(self.stays) > 4 * REMEMBERED:
            self.stays.clear()
        self.stays[key] = found
        return found

    def _piece(self, piece: bytes) -> array:
        """Number of tokens of each prefix of one piece, by bytes; the empty one first."""
        if len(piece) > LONG:
            return array("l", itertools.chain((0,), (state >> 16 for state in self._states(piece))))
        self._whole(piece)
        return array("l", [0, *(self.prefix[piece[:i]] >> 16 for i in range(1, len(piece) + 1))])

    def _states(self, piece: bytes) -> Iterator[int]:
        """Number of tokens and last token of every prefix of a long piece, of which as many are held as a token is long."""
        stays, beside, root, size = self.stays, self._beside, self.ends, self.longest + 1
        recent = [0] * size
        for i in range(1, len(piece) + 1):
            node, j, fits = root, i, []
            while j:
                j -= 1
                node = node.get(piece[j])
                if node is None:
                    break
                token = node.get(-1)
                if token is not None:
                    fits.append((token, j))
            for token, j in reversed(fits):
                before = recent[j % size]
                key = (before & 65535) << 16 | token
                if not j or stays.get(key) or key not in stays and beside(key):
                    state = recent[i % size] = (before >> 16) + 1 << 16 | token
                    break
            else:
                raise ValueError("no token ends here: the vocabulary lacks a byte")
            yield state

    def _whole(self, piece: bytes) -> int:
        """Number of tokens of a piece. The table `prefix` holds, for every prefix of a piece it has met, that number
        and the last token; pieces that begin alike share it, so only the new end of a piece is worked out."""
        if len(piece) > LONG:
            for state in self._states(piece):
                pass
            return state >> 16
        prefix = self.prefix
        found = prefix.get(piece)
        if found is not None:
            return found >> 16
        if len(prefix) >= 2 * REMEMBERED:
            prefix.clear()
        known = len(piece) - 1
        while known and piece[:known] not in prefix:
            known -= 1
        stays, beside, root = self.stays, self._beside, self.ends
        for i in range(known + 1, len(piece) + 1):
            node, j, fits = root, i, []
            while j:  # tokens that end at i, short ones first
                j -= 1
                node = node.get(piece[j])
                if node is None:
                    break
                token = node.get(-1)
                if token is not None:
                    fits.append((token, j))
            for token, j in reversed(fits):
                if not j:
                    state = 1 << 16 | token
                    break
                before = prefix[piece[:j]]
                key = (before & 65535) << 16 | token
                ok = stays.get(key)
                if ok or ok is None and beside(key):
                    state = (before >> 16) + 1 << 16 | token
                    break
            else:
                raise ValueError("no token ends here: the vocabulary lacks a byte")
            prefix[piece[:i]] = state
        return state >> 16 if piece else 0

    def chunk(self, chunk: str) -> tuple[int, np.ndarray]:
        """Tokens of a chunk, and of each of its prefixes by characters, the empty one left out.

        A prefix may be cut into other pieces than the whole: all white space before a word and the start of a
        contraction are cut anew, all else keeps its pieces.
        """
        found = self.known.get(chunk)
        if found is None:
            counts = array("i")
            before = 0
            for m in self.cut.finditer(chunk):
                piece = m[0]
                by_byte = self._piece(piece.encode())
                if piece[0] == "'" and len(piece) <= 3:  # a contraction
                    for k in range(1, len(piece) + 1):
                        counts.append(before + sum(self._piece(x.encode())[-1] for x in self.cut.findall(chunk[m.start() : m.start() + k])))
                else:
                    at = 0
                    for c in piece:
                        at += len(c.encode())
                        counts.append(before + by_byte[at])
                before += by_byte[-1]
            blanks = self.blanks.match(chunk).end()
            if blanks > 1:  # the last blank goes with the word only once the word is there
                counts[blanks - 1] = sum(self._piece(x.encode())[-1] for x in self.cut.findall(chunk[:blanks]))
            if len(self.known) >= REMEMBERED // 4:
                self.known.clear()
            found = before, np.array(counts, np.int32)
            if len(chunk) <= LONG:
                self.known[chunk] = found
        return found

    def _segments(self, text: str) -> list[str]:
        return self.specials.split(text) if self.specials and "<" in text else [text]

    def _cut(self, chunk: str) -> list[str]:
        """Pieces of a chunk; the common ones, a word and perhaps a mark behind it, without the pattern."""
        word = chunk[1:] if chunk[0] == " " else chunk
        if word.isalpha():
            return [chunk]
        if word[:-1].isalpha() and word[-1] in ".,":
            return [chunk[:-1], chunk[-1]]
        return self.cut.findall(chunk)

    def count(self, text: str) -> int:
        """Tokens of the whole text, which is its longest prefix."""
        total, known = 0, self.counts
        for k, segment in enumerate(self._segments(text)):
            if k % 2:
                total += 1
                continue
            chunks = self.chunks.findall(segment)
            try:
                total += sum([known[c] for c in chunks])
            except KeyError:
                for chunk in chunks:
                    found = known.get(chunk)
                    if found is None:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        found = sum([self._whole(p.encode()) for p in self._cut(chunk)])
                        if len(chunk) <= LONG:
                            known[chunk] = found
                    total += found
        return total

    def prefixes(self, text: str) -> np.ndarray:
        """Tokens of text[:1], text[:2] and so on to the whole text."""
        out: list[np.ndarray] = []
        before = 0
        for k, segment in enumerate(self._segments(text)):
            if k % 2:  # a part of a special string is ordinary text; together with what is before it
                head = self._tail(out, text)
                for n in range(1, len(segment)):
                    out.append(np.array([self.count(text[head[0] : head[1] + n]) + head[2]], np.int32))
                before += 1
                out.append(np.array([before], np.int32))
                continue
            for chunk in self.chunks.findall(segment):
                total, counts = self.chunk(chunk)
                out.append(counts + before)
                before += total
        return np.concatenate(out) if out else np.zeros(0, np.int32)

    def _tail(self, out: list[np.ndarray], text: str) -> tuple[int, int, int]:
        """Start of the last chunk so far, the end of all so far, and the tokens before that start."""
        end = sum(map(len, out))
        start = end - len(out[-1]) if out else 0
        before = int(out[-2][-1]) if len(out) > 1 else 0
        return start, end, before


def token_counts(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text", prefixes: bool = False) -> DataFrame:
    """(id, n_bytes, n_tokens[, prefix_tokens]) of every whole text. `model` is the text of a tokenizer file.

    Null and empty texts have no bytes and no tokens; repeated rows come back repeated; a null id stays null; other
    columns are not read, whatever their names. `prefix_tokens` is an array with the number of tokens of each prefix,
    from one character on: element n answers a cut after n characters, and `prefix_within` answers a budget.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one tokenizer file, of a few MB whatever the input
    fields = "n_bytes long, n_tokens long" + (", prefix_tokens array<int>" if prefixes else "")
    id_type = docs.schema[id_col].dataType

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PrefixCounter(shared.value)
        gc.freeze()  # the vocabulary stays; the collector need not walk through it again and again
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64())]
            if prefixes:
                tables = [counter.prefixes(t) for t in texts]
                columns += [pa.array([int(t[-1]) if len(t) else 0 for t in tables], pa.int64()), pa.array(tables, pa.list_(pa.int32()))]
            else:
                columns.append(pa.array([counter.count(t) for t in texts], pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_bytes", "n_tokens", "prefix_tokens"][: len(columns)])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(count, f"id {id_type.simpleString()}, {fields}").withColumnRenamed("id", id_col)


def tokens_at(n_chars, prefix_tokens="prefix_tokens"):
    """Tokens of the first `n_chars` characters, or of the whole text if it is shorter."""
    column = F.col(prefix_tokens) if isinstance(prefix_tokens, str) else prefix_tokens
    n = F.least(F.lit(n_chars), F.size(column))
    return F.when(n <= 0, F.lit(0)).otherwise(F.try_element_at(column, n))


def prefix_within(budget: int, prefix_tokens="prefix_tokens"):
    """Characters of the longest prefix of at most `budget` tokens. Counts may fall again as a prefix grows, so all are asked."""
    column = F.col(prefix_tokens) if isinstance(prefix_tokens, str) else prefix_tokens
    fits = F.transform(column, lambda n, i: F.when(n <= budget, i + 1).otherwise(F.lit(0)))
    return F.coalesce(F.array_max(fits), F.lit(0))
