from driftspark.operators import toc as ops

SAMPLE = """
;
; Listing of a nightly archive
;     has the word FUNCTION in a header line
;
7; 2615 100 SCHEMA - depot owner1
8; 0 0 COMMENT - SCHEMA depot owner1
90; 0 0 COMMENT depot FUNCTION weigh(real, text) owner1
11; 1255 200 FUNCTION depot load_crate(bigint) owner1
91; 0 0 COMMENT depot FUNCTION load_crate(crate bigint) owner1
12; 1255 201 PROCEDURE depot unload(bigint, date) owner1
92; 0 0 COMMENT depot PROCEDURE unload(IN crate bigint, IN due date) owner1
13; 1255 202 FUNCTION depot is_full(text) owner1
14; 1255 203 FUNCTION depot weigh(real, text) owner1
15; 1255 204 FUNCTION scale weigh(real, text, boolean) owner1
93; 0 0 ACL scale FUNCTION weigh(real, text, boolean) owner1
94; 0 0 ACL scale FUNCTION never_defined() owner1
16; 1259 300 TABLE depot crates owner1
""".split("\n")


def lines(spark, texts=SAMPLE):
    return spark.createDataFrame([("f", i, t) for i, t in enumerate(texts)], "file string, pos int, line string")


def groups(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.first_pos, r.pos)):
        out.setdefault(r.name, []).append(r.kind)
    return out


def test_classify(spark):
    kinds = {r.pos: (r.kind, r.schema, r.name) for r in ops.classify_toc(lines(spark)).collect()}
    assert kinds[8] == ("routine", "depot", "load_crate")
    assert kinds[9] == ("comment", "depot", "load_crate")
    assert kinds[15] == ("acl", "scale", "weigh")
    assert [kinds[i][0] for i in (0, 1, 4, 5, 6, 17)] == [None] * 6


def test_group(spark):
    found = groups(ops.group_toc(lines(spark)))
    assert list(found) == ["load_crate", "unload", "is_full", "weigh"]
    assert found["weigh"] == ["routine", "routine", "acl"]
    assert found["load_crate"] == ["routine", "comment"]
    by_schema = ops.group_toc(lines(spark), by_schema=True)
    assert by_schema.where("name = 'weigh'").select("schema").distinct().count() == 2


def test_no_routines(spark):
    assert ops.group_toc(lines(spark, ["; header", "", "7; 2615 5 SCHEMA - depot x"])).count() == 0


def test_exclude(spark):
    kept = [r.pos for r in ops.exclude_routine_toc(lines(spark)).collect()]
    assert sorted(kept) == [0, 1, 2, 4, 5, 6, 17, 18]
