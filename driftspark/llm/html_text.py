"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is read into blocks of text, each with the elements above it. Features are those elements (tags, words of class,
id and role) and the look of the text. The field is trained on pages whose mark-up labels their blocks, on copies of
them without that mark-up, and on laid-out pages with texts of the corpus; Viterbi decodes.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of HTML: elements that end a line of text, that hold none, that are empty, and what closes what.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
SILENT = frozenset("script style template noscript head title svg math textarea iframe object canvas audio video".split())
RAW = frozenset("script style title textarea".split())
IN_HEAD = frozenset("head base basefont bgsound link meta noframes noscript script style template title".split())
INLINE = frozenset("a abbr b big cite code em font i label q s small span strong sub sup u".split())
#: Elements that cannot be in svg or math and end them, and those in which other elements can be.
BREAKS = frozenset("b big blockquote br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 hr i img li menu ol p pre s small span strong sub sup table u ul".split())
HOLDS = frozenset("foreignobject desc annotation-xml mi mo mn ms mtext".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol menu dl table select body html article section div main".split())
SEMANTIC = frozenset("article main nav header footer aside section form".split())
_TOKEN = re.compile(r"[a-z]+")


class Element:
    """An open element, its words of class, id and role, and the one around it; blocks below it share it."""

    __slots__ = ("tag", "words", "around", "depth")

    def __init__(self, tag: str, words: tuple[str, ...], around: Element | None):
        self.tag, self.words, self.around = tag, words, around
        self.depth = around.depth + 1 if around else 1

    def names(self, plain: bool = False) -> list[str]:
        """Features of every block below it."""
        return ([] if plain and self.tag in SEMANTIC else ["in " + self.tag]) + ["as " + w for w in self.words]


@dataclass
class Block:
    text: str
    within: Element | None
    linked: int

    def above(self) -> list[Element]:
        """Elements around it, outermost first."""
        out, element = [], self.within
        while element:
            out.append(element)
            element = element.around
        return out[::-1]


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.above: list[Element] = []
        self.open: Counter[str] = Counter()  # of the elements above, by tag
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.linked = self.links = 0
        self.silent: list[str] = []
        self.inside: list[str] = []  # elements open in the silent ones
        self.inline = dict.fromkeys(INLINE, 0)

    def _speak(self):
        self.silent, self.inside = [], []

    def _flush(self):
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append(Block(text, self.above[-1] if self.above else None, self.linked))
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if tag == "body" or (self.silent == ["head"] and tag not in IN_HEAD):
            self._speak()
        if self.silent and self.silent[-1] in ("svg", "math") and tag in BREAKS and HOLDS.isdisjoint(self.inside):
            self._speak()
        if tag in SILENT:
            self.silent.append(tag)
        if self.silent:
            if tag in HOLDS or tag in INLINE or (tag in BLOCK and tag not in EMPTY):
                self.inside.append(tag)
            return
        if tag in INLINE:
            self.inline[tag] += 1
        if tag == "br":
            self.parts.append("\n")
        elif tag in BLOCK:
            self._flush()
            if tag not in ("button", "option"):
                self._close("p")
            ends = CLOSES.get(tag, ())
            for k in range(len(self.above) - 1 if any(self.open[t] for t in ends) else -1, -1, -1):
                name = self.above[k].tag
                if name in ends:
                    self._cut(k)
                    if tag != "tr":
                        break
                elif name in SCOPE:
                    break
            if tag not in EMPTY:
                words = " ".join(v for k, v in attrs if v and k in ("class", "id", "role")).lower()
                named = tuple(dict.fromkeys(w for w in _TOKEN.findall(words) if len(w) > 1))
                self.above.append(Element(tag, named, self.above[-1] if self.above else None))
                self.open[tag] += 1
        elif tag == "a":
            self.links += 1

    def _cut(self, k):
        self.open.subtract(e.tag for e in self.above[k:])
        del self.above[k:]

    def _close(self, tag):
        if self.open[tag]:
            k = len(self.above) - 1
            while self.above[k].tag != tag:
                k -= 1
            self._cut(k)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in EMPTY:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in self.silent:
            del self.silent[self.silent.index(tag) :]
            if not self.silent:
                self.inside = []
            return
        if self.silent:
            if self.silent[-1] in RAW:
                return
            if tag in self.inside:
                while self.inside.pop() != tag:
                    pass
                return
            if not self.inline.get(tag) and not self.open[tag]:
                return
            self._speak()  # the end of an element around the silent one, which has no end tag
        if self.inline.get(tag):
            self.inline[tag] -= 1
        if tag in BLOCK:
            self._flush()
            self._close(tag)
        elif tag == "a" and self.links:
            self.links -= 1

    def handle_data(self, data):
        if self.silent == ["head"] and data.strip():
            self._speak()
        if not self.silent:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)


def blocks_of(html: str | None) -> list[Block]:
    """Leaf blocks in page order: character references decoded, white space made one blank, empty ones left out."""
    reader = _Reader()
    reader.feed(html or "")
    if reader.rawdata and not reader.silent:  # a tag or reference that the end of the page cuts
        rest, reader.rawdata = reader.rawdata, ""
        if not rest.startswith("<"):
            reader.feed(rest + " ")
    reader.close()
    reader._flush()
    return reader.blocks


def _own(b: Block, i: int, total: int, plain: bool) -> list[str]:
    """Names of the features of block i of a page that are not of the elements around it."""
    n = b.text.count(" ") + 1
    names = ["", f"words{min(n.bit_length(), 6)}", f"at{4 * i // total}", f"linked{min(2, 3 * b.linked // max(1, len(b.text)))}"]
    if b.text[-1] in ".!?\"'”’»":
        names.append("ends")
    if "©" in b.text:
        names.append("copyright")
    if b.within:
        parent = "div" if plain and b.within.tag in SEMANTIC else b.within.tag
        names.append(f"of {parent}")
        names.append(f"of {parent} words{min(n.bit_length(), 6)}")
    return names


def features(blocks: list[Block], plain: bool = False) -> list[list[str]]:
    """Names of each block's features. `plain` leaves out tags that say by themselves what is main text."""
    around = [[name for e in b.above() for name in e.names(plain)] for b in blocks]
    return [_own(b, i, len(blocks), plain) + names for i, (b, names) in enumerate(zip(blocks, around))]


#: Words of class, id and role that name what is no main text, and kinds of page parts for laid-out pages.
PARTS = {
    "menu": "nav navigation navbar menu topnav breadcrumb breadcrumbs pagination pager tabs toc links",
    "head": "header masthead topbar banner branding logo site",
    "foot": "footer foot colophon copyright legal credits bottom",
    "side": "sidebar side secondary widget widgets related recommended trending popular archive tags",
    "note": "cookie cookies consent notice alert gdpr popup modal overlay message announcement",
    "ad": "ad ads advert advertisement sponsored sponsor promo promotion banner adsense",
    "form": "form search newsletter subscribe signup login contact share social",
    "talk": "comments comment responses replies reply discussion disqus respond feedback thread",
}
MAIN = "content main article post entry story body text page single primary"


def laid_out(texts: list[str], pages: int, seed: int = 5) -> list[tuple[list[Block], np.ndarray]]:
    """Labelled pages: the usual parts in usual places, with texts of the corpus."""
    random = np.random.default_rng(seed)
    texts = texts or ["A page tells what happened, to whom, and why it matters to those who read it."]
    pick = lambda options: options[int(random.integers(len(options)))]

    def block(text: str, above: tuple, linked: int) -> Block:
        within = None
        for tag, words in above:
            within = Element(tag, words, within)
        return Block(text, within, linked)

    def some(low: int, high: int) -> str:
        words = pick(texts).split()
        n = int(random.integers(low, high + 1))
        at = int(random.integers(max(1, len(words) - n + 1)))
        return " ".join(words[at : at + n]) or "More"

    def part(kind: str, out: list, above: tuple) -> None:
        names = PARTS[kind].split()
        tag = {"menu": "nav", "head": "header", "foot": "footer", "side": "aside", "form": "form"}.get(kind, "div")
        words = (pick(names),) if random.random() < 0.85 else ()
        tag = tag if not words or random.random() < 0.6 else pick(["div", "section", "ul"])
        if not words and tag == "div":
            words = (pick(names),)
        here = (*above, (tag, words))
        for _ in range(int(random.integers(2, 7)) if kind in ("menu", "side", "talk") else int(random.integers(1, 3))):
            if kind in ("menu", "side"):
                text = some(1, 6)
                out.append((block(text, (*here, *((("ul", ()),) if tag != "ul" else ()), ("li", ())), len(text) if random.random() < 0.9 else 0), 0))
            elif kind == "talk":
                inner = (*here, (pick(["div", "li"]), ("comment",) if random.random() < 0.6 else ()))
                out.append((block(some(2, 5), inner, 0), 0))
                out.append((block(some(4, 60), (*inner, ("p", ())), 0), 0))
            elif kind == "form":
                out.append((block(some(1, 8), (*here, *(((pick(["p", "button", "fieldset"]), ()),) if random.random() < 0.5 else ())), 0), 0))
            elif kind == "foot":
                out.append((block(("© " if random.random() < 0.6 else "") + some(2, 14), (*here, *((("p", ()),) if random.random() < 0.5 else ())), 0), 0))
            else:
                text = some(2, 18)
                out.append((block(text, (*here, *((("p", ()),) if random.random() < 0.5 else ())), len(text) if kind == "head" and random.random() < 0.5 else 0), 0))

    made = []
    for _ in range(pages):
        out: list = []
        root = (("html", ()), ("body", ()))
        for kind in ("head", "menu", "note", "ad"):
            if random.random() < 0.7:
                part(kind, out, root)
        hull = root if random.random() < 0.5 else (*root, ("div", (pick(["wrapper", "container", "page", "site", "row"]),)))
        style = random.random()
        words = (pick(MAIN.split()),)
        main = (*hull, ("article", words if random.random() < 0.4 else ())) if style < 0.35 else (*hull, ("main", ())) if style < 0.5 else (*hull, (pick(["div", "div", "section", "td"]), words))
        out.append((block(some(2, 12), (*main, *((("header", ()),) if random.random() < 0.15 else ()), ("h1", ())), 0), 1))
        for _ in range(int(random.integers(1, 9))):
            kind = random.random()
            if kind < 0.75:
                out.append((block(some(1, 6) if random.random() < 0.2 else some(8, 120), (*main, ("p", ())), 0), 1))
            elif kind < 0.82:
                out.append((block(some(1, 8), (*main, (pick(["h2", "h3"]), ())), 0), 1))
            elif kind < 0.88:
                for _ in range(3):
                    out.append((block(some(3, 20), (*main, ("ul", ()), ("li", ())), 0), 1))
            elif kind < 0.92:
                out.append((block(some(5, 40), (*main, (pick(["blockquote", "pre", "figcaption"]), ())), 0), 1))
            else:
                part(pick(["ad", "side", "form", "note"]), out, main)
        for kind in ("talk", "side", "form", "ad", "note", "menu", "foot"):
            if random.random() < (0.9 if kind == "foot" else 0.45):
                part(kind, out, hull if random.random() < 0.5 else root)
        made.append(([b for b, _ in out], np.array([y for _, y in out])))
    return made


def labels_by_markup(blocks: list[Block]) -> np.ndarray | None:
    """1 inside the page's article (or main) but for parts of it that are something else; None if no tag tells."""
    for tag in ("article", "main"):
        if any(e.tag == tag for b in blocks for e in b.above()):
            other = set(" ".join(PARTS.values()).split())
            out = []
            for b in blocks:
                names = [e.tag for e in b.above()]
                below = b.above()[names.index(tag) + 1 :] if tag in names else None
                out.append(int(below is not None and not any(e.tag in ("nav", "footer", "aside", "form") or other & set(e.words) for e in below)))
            return np.array(out)
    return None


@dataclass
class Field:
    index: dict[str, int]
    weights: np.ndarray
    step: np.ndarray
    start: np.ndarray

    def scores(self, names: list[list[str]]) -> np.ndarray:
        """Of each block, for label 1 against label 0."""
        index, w = self.index, self.weights
        return np.array([sum([w[index[f]] for f in row if f in index]) for row in names])

    def scores_of(self, blocks: list[Block]) -> np.ndarray:
        """`scores` of `features`, adding up each element's weights once for all blocks below it."""
        index, w, sums, out = self.index, self.weights, {None: 0.0}, []
        weight = lambda names: sum([w[index[f]] for f in names if f in index])
        for i, b in enumerate(blocks):
            path, element = [], b.within
            while element not in sums:
                path.append(element)
                element = element.around
            for inner in reversed(path):
                sums[inner] = sums[inner.around] + weight(inner.names())
            out.append(sums[b.within] + weight(_own(b, i, len(blocks), False)))
        return np.array(out)

    def decode(self, scores: np.ndarray) -> list[int]:
        """The likeliest labels (Viterbi)."""
        (s00, s01), (s10, s11) = self.step.tolist()
        zero, one, back = self.start[0], self.start[1] + scores[0], []
        for x in scores[1:].tolist():
            from_zero, from_one = zero + s00 >= one + s10, zero + s01 >= one + s11
            back.append((from_zero, from_one))
            zero, one = max(zero + s00, one + s10), max(zero + s01, one + s11) + x
        label = int(one > zero)
        out = [label]
        for choice in reversed(back):
            label = 0 if choice[label] else 1
            out.append(label)
        return out[::-1]


def train(pages: list[tuple[list[list[str]], np.ndarray]], rounds: int = 150, ridge: float = 1e-3, rate: float = 0.5) -> Field:
    """Maximum likelihood by forward and backward sums over all pages at once; Adagrad steps."""
    index: dict[str, int] = {}
    for names, _ in pages:
        for row in names:
            for f in row:
                index.setdefault(f, len(index))
    longest, count = max(len(y) for _, y in pages), len(pages)
    mask, y = np.zeros((longest, count), bool), np.zeros((longest, count), int)
    at, cell = [], []
    for p, (names, labels) in enumerate(pages):
        mask[: len(labels), p], y[: len(labels), p] = True, labels
        for t, row in enumerate(names):
            at.extend(index[f] for f in row)
            cell.extend([t * count + p] * len(row))
    at, cell = np.array(at), np.array(cell)
    w, step, start = np.zeros(len(index)), np.zeros((2, 2)), np.zeros(2)
    sums = [np.full_like(v, 1e-8) for v in (w, step, start)]
    pairs = mask[1:]
    seen = np.array([[(pairs & (y[:-1] == a) & (y[1:] == b)).sum() for b in (0, 1)] for a in (0, 1)], float)
    log_add = np.logaddexp
    for _ in range(rounds):
        x = np.bincount(cell, w[at], longest * count).reshape(longest, count)
        score = np.stack([np.zeros_like(x), x], axis=2)
        ahead, behind = np.zeros((longest, count, 2)), np.zeros((longest, count, 2))
        ahead[0] = score[0] + start
        for t in range(1, longest):
            moved = log_add(ahead[t - 1][:, :1] + step[0], ahead[t - 1][:, 1:] + step[1]) + score[t]
            ahead[t] = np.where(mask[t][:, None], moved, ahead[t - 1])
        for t in range(longest - 2, -1, -1):
            right = score[t + 1] + behind[t + 1]
            moved = log_add(step[:, 0] + right[:, :1], step[:, 1] + right[:, 1:])
            behind[t] = np.where(mask[t + 1][:, None], moved, 0.0)
        whole = log_add(ahead[-1][:, 0], ahead[-1][:, 1])
        one = np.exp(np.clip(ahead[:, :, 1] + behind[:, :, 1] - whole, -50, 0)) * mask
        both = np.exp(np.clip(ahead[:-1, :, :, None] + step + (score + behind)[1:, :, None, :] - whole[:, None, None], -50, 0)) * pairs[:, :, None, None]
        errors = (one - (y * mask)).reshape(-1)
        slopes = (
            np.bincount(at, errors[cell], len(w)) / count + ridge * w,
            (both.sum(axis=(0, 1)) - seen) / count + ridge * step,
            np.array([(1 - one[0]).sum() - (1 - y[0]).sum(), one[0].sum() - y[0].sum()]) / count + ridge * start,
        )
        for value, slope, total in zip((w, step, start), slopes, sums):
            total += slope**2
            value -= rate * slope / np.sqrt(total)
    return Field(index, w, step, start)


def _first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each hash in a partition, so that a page of many rows is not shuffled or sorted with all of them."""
    seen: set[int] = set()
    for batch in batches:
        kept = []
        for i, h in enumerate(batch.column(0).to_pylist()):
            if h not in seen:
                seen.add(h)
                kept.append(i)
        if kept:
            yield batch.take(pa.array(kept, pa.int64()))


def fit(pages: DataFrame, *, most: int = 300, laid: int = 600, id_col: str = "page_id", html_col: str = "html", longest: int = 400, deepest: int = 200) -> Field:
    """Train on at most `most` distinct pages of the table, those with the least hashes of id and html, and on `laid`
    laid-out ones.

    Pages whose mark-up names an article or main part are labelled by it; each is used as it is and without such tags.
    Of pages with over `longest` blocks a run of that many, drawn by the hash, is used for training, and runs with a
    block in more than `deepest` elements are not; extraction takes all blocks of all pages.
    """
    rows = pages.select(F.col(id_col).cast("string").alias("id"), F.col(html_col).cast("string").alias("html")).where(F.col("html").isNotNull())
    rows = rows.select(F.xxhash64("id", "html").alias("h"), "html")
    least = [r["h"] for r in rows.select("h").distinct().orderBy("h").limit(most).collect()]  # `most` numbers
    rows = rows.where(F.col("h") <= (least[-1] if least else 0)).mapInArrow(_first_of_each, "h long, html string").dropDuplicates(["h"])
    labelled, texts = [], []
    for r in rows.orderBy("h").toLocalIterator():  # at most `most` pages
        blocks = blocks_of(r["html"])
        first = r["h"] % max(1, len(blocks) - longest + 1)
        blocks = blocks[first : first + longest]
        shallow = all(b.within is None or b.within.depth <= deepest for b in blocks)
        labels = labels_by_markup(blocks) if blocks and shallow else None
        if labels is not None:
            labelled += [(features(blocks), labels), (features(blocks, plain=True), labels)]
            texts += [b.text for b, y in zip(blocks, labels) if y]
    return train(labelled + [(features(b), y) for b, y in laid_out(texts, laid)])


def main_text(html: str | None, field: Field) -> str:
    blocks = blocks_of(html)
    if not blocks:
        return ""
    return " ".join(b.text for b, y in zip(blocks, field.decode(field.scores_of(blocks))) if y)


def extract(pages: DataFrame, field: Field, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page, from the whole html.

    Null and empty pages, and those without main text, have an empty text; broken mark-up is read as far as it goes;
    repeated rows come back repeated; other columns are not read.
    """
    shared = pages.sparkSession.sparkContext.broadcast(field)  # a weight for each feature of the training pages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, shared.value) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"]
            )

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    kind = pages.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, url string, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})
