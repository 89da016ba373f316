"""Quality, toxicity and main text: held-out accuracy and defined results for odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftspark.llm import html_text, quality, toxicity
from driftspark.llm.common import held_out, labelled

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet"), spark.read.parquet(f"{SF_DIR}/labels.parquet")


@pytest.fixture(scope="module")
def lexicon(spark):
    return toxicity.fit(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))


@pytest.fixture(scope="module")
def model(tables):
    return quality.fit(*tables)


def held(scores, labels, label, limit):
    rows = scores.where(held_out(F.col("doc_id"))).join(labels, "doc_id").select((F.col("score") >= limit).cast("int").alias("p"), label).collect()
    return [(r.p, r[label]) for r in rows]


def test_held_out_quality(tables, model):
    rows = held(quality.quality(tables[0], model), tables[1], "quality", 0.7)
    assert len(rows) > 50 and np.mean([p == y for p, y in rows]) >= 0.95


def test_held_out_toxicity(spark, lexicon):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = held(toxicity.toxicity(docs, lexicon), labels, "toxic", 0.3)
    assert np.mean([p == y for p, y in rows]) >= 0.95
    assert sum(p for p, y in rows if y) >= 0.9 * sum(y for _, y in rows)


def odd(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, " \n ", "c"), (3, " \n ", "c"), (None, "word", "d"), (4, "long " * 50_000, "e")]
    return spark.createDataFrame(rows, "doc_id long, text string, score string")


def test_odd_rows(spark, model, lexicon):
    docs = odd(spark)
    for scores in (quality.quality(docs, model), toxicity.toxicity(docs, lexicon)):
        rows = scores.collect()
        assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1
    assert toxicity.without_toxic(docs, lexicon).columns == docs.columns
    assert quality.quality(docs.limit(0), model).count() == toxicity.toxicity(docs.limit(0), lexicon).count() == 0


def test_nothing_to_learn(spark, tables):
    docs, none = tables[0].limit(20), tables[1].limit(0)
    assert {r.score for r in quality.quality(docs, quality.fit(docs, none)).collect()} == {0.5}
    assert {r.score for r in toxicity.toxicity(docs, toxicity.fit(docs, none)).collect()} == {0.0}


def test_folding_and_exceptions():
    lexicon = toxicity.Lexicon({"idiot ": 5.0, "scum ": 5.0, "trash ": 4.0, "worth": 2.0})
    words = lambda text: [toxicity.fold(text)[s:e] for s, e, _ in lexicon.hits(toxicity.fold(text))]
    assert words("an 1D10T, іdiot; id​iot! idiots") == ["idiot", "idiot", "idiot"]
    assert words("pond scum and scum") == ["scum"]
    assert words("a trash can, trash") == ["trash"]
    assert words("worthy unworthy") == ["worth"]
    assert words("") == []


def test_every_way_of_writing():
    entries = {"idiot ": 5.0, "clown ": 5.0, "loser ": 5.0, "losers ": 5.0, "worthless ": 5.0, "ass ": 3.0, "imbecile ": 5.0, "fail ": 2.0, "moron": 2.0}
    lexicon = toxicity.Lexicon(entries)
    n = lambda text: len(lexicon.hits(toxicity.fold(text)))
    for text in ("c1own", "1oser", "worth1ess", "l053r", "w0r7hl355", "idio7", "worthle55", "1mbec11e", "a55", "@$$", "1053r5", "m0r0n1c"):
        assert n(text) == (0 if text == "@$$" else 1), text  # a word needs a letter
    for text in ("idiot$$$", "idio7$$$", "$$$idiot", "@idiot", "idiot1", "5 idiot 5", "idiot!!1", "idiot2"):
        assert n(text) == 1, text
    assert n("idiot100idiot") == 2
    assert [n(t) for t in ("fall", "fa11", "f4il", "foil", "13 455 1055", "4th 1st $100k", "classy a5sorted", "c10wning")] == [0, 1, 1, 0, 0, 0, 0, 0]
    assert n("cla55 c1own") == 0  # an exception
    assert toxicity._terms("an ox, id1 $$$") >= {"an ", "ox ", "idi ", "idl "} and "i " not in toxicity._terms("i")


def test_short_words_are_learnt(spark):
    rows = [(i, f"you {'dum' if i % 2 else 'fine'} person, writes number {i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    learnt = toxicity.fit(docs, docs.selectExpr("doc_id", "doc_id % 2 AS toxic"))
    assert "dum " in learnt.entries
    low, high = (learnt.scores([learnt.features(t)])[0] for t in ("a fine person", "a dum person"))
    assert low < 0.3 <= high


def test_isotonic_rises():
    random = np.random.default_rng(1)
    x = random.normal(size=400)
    knots, values = quality.isotonic(x, (random.random(400) < 1 / (1 + np.exp(-3 * x))).astype(float))
    assert (np.diff(knots) > 0).all() and (np.diff(values) >= 0).all() and 0 <= values[0] < values[-1] <= 1


def test_normal_equations_are_sums(spark, tables, model):
    import pyarrow as pa

    sample = tables[0].limit(60).select("text", (F.col("doc_id") % 2).cast("int").alias("y")).repartition(5).cache()
    left, right = quality._normal_equations(sample, model)
    rows = sample.collect()
    z = model.features(quality.statistics(pa.array([r.text for r in rows])))
    assert np.allclose(left, z.T @ z) and np.allclose(right, z.T @ np.array([r.y for r in rows]))


@pytest.fixture(scope="module")
def field(spark):
    return html_text.fit(spark.read.parquet(f"{SF_DIR}/pages.parquet"))


PAGE = """<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href="/">Home</a></li><li><a href="/x">News</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><%s><h1>The  title</h1><p>First &amp; <b>bold</b>&nbsp;text with some words in it.<script>var a = "</p>";</script>
<p>Second one, of more words than the first.</%s><div class="comments"><p>I do not agree with this at all, said a reader.</p></div>
<aside class="sidebar"><ul><li><a href="/">More</a></li></ul></aside><footer>&copy; someone</footer></body></html>"""


@pytest.mark.parametrize("tag", ["article", "main", 'div class="post-content"', 'div class="article-body"'])
def test_page(field, tag):
    assert html_text.main_text(PAGE % (tag, tag.split()[0]), field) == "The title First & bold text with some words in it. Second one, of more words than the first."


def test_held_out_layouts(field):
    pages = html_text.laid_out(["Some words of a text that goes on for a while, and then some more of it."] * 3, 100, seed=11)
    wrong = sum(int((np.array(field.decode(field.scores(html_text.features(b)))) != y).sum()) for b, y in pages)
    assert wrong <= 0.05 * sum(len(y) for _, y in pages)


def test_training_beats_no_training():
    pages = [(html_text.features(b), y) for b, y in html_text.laid_out([], 40, seed=3)]
    field = html_text.train(pages, rounds=30)
    right = sum(int((np.array(field.decode(field.scores(n))) == y).sum()) for n, y in pages)
    assert right >= 0.95 * sum(len(y) for _, y in pages)


def test_viterbi_is_best():
    import itertools

    random = np.random.default_rng(4)
    field = html_text.Field({}, np.zeros(0), random.normal(size=(2, 2)), random.normal(size=2))
    for _ in range(20):
        x = random.normal(size=6)
        worth = lambda y: field.start[y[0]] + sum(field.step[a, b] for a, b in zip(y, y[1:])) + sum(v for v, k in zip(x, y) if k)  # noqa: B023, E731
        assert worth(field.decode(x)) == pytest.approx(max(map(worth, itertools.product((0, 1), repeat=6))))


def test_odd_pages(spark, field):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (3, "u", "<", "x"), (3, "u", "<", "x"), (4, "u", "<article><p>" + "word " * 60_000, "x"), (5, "u", "<script>a", "x"), (None, "u", "<p", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_text.extract(pages, field).collect()}
    assert html_text.extract(pages, field).count() == 7 and got[1].text == got[2].text == got[5].text == ""
    assert got[4].n_chars == len(got[4].text) == 5 * 60_000 - 1
    assert html_text.extract(pages.limit(0), field).count() == 0


@pytest.mark.parametrize(
    ("html", "texts"),
    [
        ("<html><head><title>x</title><link rel=a><h1>T</h1><p>Body text.</p></html>", ["T", "Body text."]),
        ("<head><meta charset=a><noscript><img src=a></noscript><style>p{}</style>Text", ["Text"]),
        ("<head><title>x</title></head><p>One</p>", ["One"]),
        *[(f"<body><div>One<{tag}><x></div><p>Two</p></body>", ["One", "Two"]) for tag in ("svg", "object", "canvas", "template", "video")],
        ("<body><p>One <span><svg><path d=a></span>two</p>three</body>", ["One two", "three"]),
        ("<body><svg><path d=a><p>One</p></body>", ["One"]),
        ("<body><svg><foreignObject><div>no</div></foreignObject><a><text>no</text></a></svg>One</body>", ["One"]),
        ("<body><div><object><div><p>no</div>no<a>no</a></object>One</div></body>", ["One"]),
        ("<body><div><textarea>no</div>no</textarea>One</div></body>", ["One"]),
    ],
)
def test_silent_elements_without_an_end(html, texts):
    assert [b.text for b in html_text.blocks_of(html)] == texts


def test_nested_elements(field):
    """Time and memory grow with the page, not with its depth times its blocks; scores are those of the named features."""
    import time
    import tracemalloc

    for tag in ("div", "center", "dd"):
        html = "<body><article>" + "".join(f'<{tag} class="c{i % 7}">word {i}' for i in range(20_000)) + f"</{tag}>" * 20_000 + "</article>"
        tracemalloc.start()
        began = time.monotonic()
        text = html_text.main_text(html, field)
        taken, most = time.monotonic() - began, tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert taken < 20 and most < 60_000_000
        assert set(text.split()) <= {"word", *map(str, range(20_000))}
    for blocks, _ in html_text.laid_out([], 20, seed=9):
        assert field.scores_of(blocks) == pytest.approx(field.scores(html_text.features(blocks)))
    blocks = html_text.blocks_of("<div class=a><p>one<ul class=b><li>two<li><b>three</b></ul></div>four")
    assert [[e.tag for e in b.above()] for b in blocks] == [["div", "p"], ["div", "ul", "li"], ["div", "ul", "li"], []]


def test_slopes_of_training():
    """The gradient is that of the log-likelihood: a step of training from nothing follows differences of the likelihood."""
    import itertools

    pages = [(html_text.features(b)[:4], y[:4]) for b, y in html_text.laid_out([], 6, seed=2)]
    field = html_text.train(pages, rounds=400, ridge=0.05)

    def loss(w, step, start):
        total = 0.0
        for names, y in pages:
            x = [sum(w[field.index[f]] for f in row) for row in names]
            worth = lambda z: start[z[0]] + sum(step[a, b] for a, b in zip(z, z[1:])) + sum(v for v, k in zip(x, z) if k)  # noqa: B023, E731
            total += np.logaddexp.reduce([worth(z) for z in itertools.product((0, 1), repeat=len(y))]) - worth(list(y))
        return total / len(pages) + 0.05 * ((w**2).sum() + (step**2).sum() + (start**2).sum()) / 2

    # where training ends, no direction leads down
    at = loss(field.weights, field.step, field.start)
    for part in range(3):
        values = [field.weights, field.step, field.start]
        for place in list(np.ndindex(values[part].shape))[:25]:
            for by in (1e-3, -1e-3):
                moved = [v.copy() for v in values]
                moved[part][place] += by
                assert loss(*moved) > at - 2e-5


def test_sample_of_pages_is_bounded(spark, monkeypatch):
    """Null ids, one page in many rows, and one id of many pages: no more than `most` pages, each once, reach the driver."""
    read, blocks_of = [], html_text.blocks_of
    monkeypatch.setattr(html_text, "blocks_of", lambda html: read.append(html) or blocks_of(html))
    page = "<body><article><p>Text {} of a page.</p></article><footer>foot</footer></body>"
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, page.format(i)) for i in range(600)] + [(1000, page.format("same"))] * 300 + [(None, None)] * 9
    pages = spark.createDataFrame(rows, "page_id long, html string").repartition(4)
    html_text.fit(pages, most=20, laid=5)
    assert len(read) == len(set(read)) == 20
    first = read.copy()
    html_text.fit(pages.repartition(3), most=20, laid=5)
    assert read[20:] == first
    read.clear()
    html_text.fit(pages, most=5000, laid=5)
    assert len(read) == len(set(read)) == 601
    html_text.fit(pages.limit(0), laid=5)
    assert len(read) == 601


def test_labelled_rows_are_bounded(spark):
    """One row for each labelled document, whatever the number of its rows and texts."""
    rows = [(i, f"text {i}") for i in range(40)] + [(1, "text 1")] * 300 + [(2, f"other {i}") for i in range(300)] + [(3, None), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(1, 1)], "doc_id long, toxic int")
    expected = [r.doc_id for r in labels.where(~held_out(F.col("doc_id")) & (F.col("doc_id") < 40)).select("doc_id").distinct().collect()]
    got = sorted(tuple(r) for r in labelled(docs, labels, "toxic", 12_000).collect())
    assert len(got) == len(expected) and {(f"text {i}", i % 2) for i in expected if i not in (2, 3)} <= set(got)
    assert got == sorted(tuple(r) for r in labelled(docs.repartition(7), labels, "toxic", 12_000).collect())
