"""Near duplicates, decontamination and the pipeline against brute force."""

import re
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from driftspark.llm import decontam, neardup
from driftspark.llm.common import split

LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
BLANK = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(text):
    words = BLANK.findall((text or "").translate(LOW))
    return frozenset(zip(words, words[1:])) if len(words) > 1 else frozenset(map(tuple, [words])) if words else frozenset()


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)].append(doc_id)
    return [(len(sets[i]), min(least[find(i)])) for i in range(len(rows))]


def edited(words, n, source):
    out = list(words)
    for _ in range(n):
        out[source.randrange(len(out))] = f"e{source.randrange(10**6)}"
    return out


def copies():
    source = random.Random(3)
    rows = [(0, None), (1, ""), (2, " \t"), (3, "One"), (4, "one"), (5, "one two"), (6, "one two one two"), (7, "ONE  two\n")]
    for g in range(12):
        base = [f"w{g}x{source.randrange(400)}" for _ in range(source.choice([12, 60, 300]))]
        for k in range(source.choice([2, 5, 9])):
            rows.append((100 * (g + 1) + k, " ".join(edited(base, source.randrange(1 + len(base) // 12), source))))
    hub = [f"hub{k}" for k in range(150)]
    rows += [(5000 + k, " ".join(edited(hub, 7, source))) for k in range(300)]
    rows += [(6000 + k, rows[40][1]) for k in range(50)] + [rows[30]]
    return rows


def test_components(spark):
    rows = copies()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, node string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs).collect())
    assert got == sorted((i, n, c) for (i, _), (n, c) in zip(rows, brute_components(rows)))


def test_regions_beyond_the_nearest_are_finished(spark):
    """A chain that nearest neighbours can't see whole: many alike, few linked, some only to one other."""
    source = random.Random(8)
    hub = [f"hub{k}" for k in range(150)]
    rows = [(k, " ".join(edited(hub, 9, source))) for k in range(220)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()}
    assert got == {i: c for (i, _), (_, c) in zip(rows, brute_components(rows))}


def test_no_candidate_is_judged_twice(spark, monkeypatch):
    source = random.Random(8)
    hub = [f"hub{k}" for k in range(150)]
    docs = spark.createDataFrame([(k, " ".join(edited(hub, 9, source))) for k in range(220)], "doc_id long, text string")
    judged, likely = [], neardup._likely

    def seen(pairs, reps, least):
        judged.extend((r.a, r.b) for r in pairs.collect())
        return likely(pairs, reps, least)

    monkeypatch.setattr(neardup, "_likely", seen)
    neardup.near_duplicates(docs).count()
    assert judged and len(judged) == len(set(judged))


def test_few_links_take_few_jobs(spark):
    links = spark.createDataFrame([(k + 1, k) for k in range(300)] + [(900, 800)], "a long, b long").repartition(8)
    spark.sparkContext.setJobGroup("few links", "")
    try:
        got = {r.node: r.root for r in neardup.components(links).collect()}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {k: 0 for k in range(1, 301)} | {900: 800}
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few links")) <= 6
    rounds = {r.node: r.root for r in neardup.components(links, together=64).where("node <> root").distinct().collect()}
    assert rounds == got


def test_null_ids_take_part(spark):
    """Near copies that only rows without an id hold: a pair, a bridge between two documents, a group of 30."""
    source = random.Random(12)
    long = [f"p{k}" for k in range(200)]
    bridge = [f"b{k}" for k in range(120)]
    hub = [f"h{k}" for k in range(150)]
    apart = lambda at: " ".join(f"x{k}" if at <= k < at + 8 else w for k, w in enumerate(bridge))
    rows = [(None, " ".join(long)), (None, " ".join(edited(long, 3, source))), (7, " ".join(edited(long, 3, source)))]
    rows += [(20, apart(10)), (None, " ".join(bridge)), (None, " ".join(bridge)), (21, apart(90))]
    rows += [(None, " ".join(edited(hub, 7, source))) for _ in range(30)] + [(40, " ".join(edited(hub, 7, source)))]
    rows += [(None, " ".join(f"n{k}" for k in range(50))), (None, " ".join(f"n{k}" for k in range(49)))]
    rows += [(None, None), (None, "alone here"), (50, "by itself")]
    parts = brute_components([(i, t) for i, (_, t) in enumerate(rows)])
    least = {c: min((d for (d, _), (_, x) in zip(rows, parts) if x == c and d is not None), default=None) for _, c in parts}
    assert least[parts[3][1]] == least[parts[6][1]] == 20
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs).collect()), key=str)
    assert got == sorted(((d, n, least[c]) for (d, _), (n, c) in zip(rows, parts)), key=str)


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.near_duplicates(docs).count() == neardup.one_of_each(docs).count() == 0


def test_one_of_each(spark):
    rows = [(1, "a b c", 1), (2, "A b c", 2), (1, "a b c", 1), (3, "", 3), (3, "", 3), (None, "a b c", 4), (4, "q r s t", 5)]
    got = neardup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, n long"))
    assert got.columns == ["doc_id", "text", "n"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "a b c", 1), (3, "", 3), (3, "", 3), (None, "a b c", 4), (4, "q r s t", 5)], key=str)


def brute_hits(docs, items, window=10):
    index, sizes = defaultdict(set), set()
    for i, t in items:
        words = WORD.findall((t or "").translate(LOW))
        n = min(window, len(words))
        if n:
            sizes.add(n)
            for p in range(len(words) - n + 1):
                index[tuple(words[p : p + n])].add(i)
    out = []
    for i, t in docs:
        words, hit, found = WORD.findall((t or "").translate(LOW)), set(), set()
        for n in sizes:
            for p in range(len(words) - n + 1):
                if tuple(words[p : p + n]) in index:
                    hit.update(range(p, p + n))
                    found |= index[tuple(words[p : p + n])]
        out.append((i, len(words), len(hit), sorted(str(x) for x in found if x is not None)))
    return sorted(out, key=str)


def test_contamination(spark):
    source = random.Random(5)
    word = lambda n: [f"v{source.randrange(n)}" for _ in range(40)]
    items = [(k, " ".join(word(500))) for k in range(8)] + [(20, "Two Words"), (21, "solo"), (22, ""), (23, None), (20, "another of the same id, one two three four five six"), (None, "item without an id has more than ten words in its text, you see")]
    items += [(30, " ".join(["same"] * 25)), (31, " ".join(["same"] * 12))]
    docs = [(1, None), (2, ""), (3, "two words and solo"), (4, items[0][1]), (5, items[1][1][:60]), (4, items[0][1]), (6, "Two-words é solo."), (None, "solo")]
    docs += [(7, items[-3][1].upper()), (8, "same " * 11), (9, "same " * 40)]
    for k in range(40):
        a = items[source.randrange(8)][1].split()
        n, p = source.randrange(6, 16), source.randrange(25)
        docs.append((100 + k, " ".join(word(500)[:7] + a[p : p + n] + word(500)[:9])))
    frames = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit(1)), spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in decontam.contamination(*frames).collect()), key=str)
    assert got == brute_hits(docs, items)
    clean = decontam.without_contaminated(*frames)
    assert clean.columns == ["doc_id", "text", "items"]
    assert clean.count() == sum(n == 0 for _, _, n, _ in got)
    assert decontam.contamination(frames[0], frames[1].limit(0)).where("n_hit > 0").count() == 0
    assert decontam.contamination(frames[0].limit(0), frames[1]).count() == 0


def test_split(spark):
    rows = spark.range(1000).selectExpr("id", "if(id = 7, null, id % 100) AS k")
    others, those = split(rows, F.col("k"), spark.range(3).union(spark.range(3)))
    assert sorted(r.id for r in those.collect()) == [i for i in range(1000) if i % 100 < 3]
    assert others.count() + those.count() == 1000


def test_pipeline_steps(spark, tmp_path):
    """Each stage does its work on what the one before kept, and keeps the columns of documents."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns, before = docs.columns, docs.count()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        out = stage(spark, docs, "/root/testdata/sf0.001")
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if name != "packing":
            assert docs.columns == columns
        kept = {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "near_duplicates":
            assert kept == {i for (i, _), (_, c) in zip(rows, brute_components(rows)) if i == c}
        if name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
            assert kept == {i for i, _, n, _ in brute_hits(rows, items) if not n}
        if name == "secrets":
            assert kept == {i for i, _ in rows}
            assert not docs.where(F.col("text").rlike("AKIA[A-Z0-9]{14}|[0-9a-f]{16}")).count()
        if name == "packing":
            assert kept == {i for i, _ in rows}
    assert before >= len(kept) > 0.5 * before


def test_stages_are_worked_out_once(spark, monkeypatch, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    spark.range(5).write.parquet(f"{tmp_path}/documents.parquet")
    stages = [("count", lambda _, docs, __: docs.mapInArrow(count, "id long")), *[("thrice", lambda _, docs, __: docs.union(docs).union(docs))] * 2]
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 45 and seen.value == 5
