import json
import random
from contextlib import contextmanager
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from driftspark import sources
from driftspark.operators import catalog, routines
from driftspark.operators.routines import extract_routines
from driftspark.plans import export_routines, split_listing
from driftspark.schemas import CATALOG_COLUMNS
from driftspark.sources.ranges import export_records


def test_script_corpus_and_toc(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.sql").write_text("create\nfunction")
    (tmp_path / "sub" / "b.sql").write_text("x;\n")
    rows = {Path(r.path).name: r.text for r in sources.read_script_corpus(spark, str(tmp_path)).collect()}
    assert rows == {"a.sql": "create\nfunction", "b.sql": "x;\n"}
    lines = sources.read_toc(spark, str(tmp_path)).collect()
    assert sorted((Path(r.file).name, r.pos, r.line) for r in lines) == [
        ("a.sql", 0, "create"), ("a.sql", 1, "function"), ("b.sql", 0, "x;"), ("b.sql", 1, ""),
    ]


SCRIPT_LINES = [
    "CREATE FUNCTION s.f{i}(_a int, comment text) RETURNS int LANGUAGE sql AS $b$", "CREATE FUNCTION ghost() -- it's", "$$ ; /* $b$;",
    "/* a /* nested", "CREATE FUNCTION hidden() RETURNS int", "*/ still */ COMMENT ON FUNCTION s.f{i}(int, text) IS 'one", "CREATE PROCEDURE no() ''two';",
    'CREATE PROCEDURE "q{i}', 'COMMENT ON FUNCTION x"(_n numeric(10,2)) LANGUAGE sql AS E\'a\\\'', "CREATE FUNCTION inside() ' -- not kept", ";", "",
    "CREATE FUNCTION g{i}() RETURNS int", "BEGIN ATOMIC", "SELECT 1; SELECT $${i}$$;", "END;", "comment on function g{i}() is $t$x", "$$", "$t$;",
]


def many_ranges(spark, size):
    return {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "0"}


@contextmanager
def configured(spark, options):
    old = {k: spark.conf.get(k, None) for k in options}
    for k, v in options.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture()
def checkpoints(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "checkpoints"))


@pytest.mark.parametrize("size", [97, 1 << 20])
def test_pieces_hold_the_statements_of_whole_scripts(spark, tmp_path, checkpoints, size):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    text = "\n".join(line.replace("{i}", str(i)) for i in range(3) for line in SCRIPT_LINES)
    (tmp_path / "in" / "a.sql").write_text(text + "\n")
    (tmp_path / "in" / "sub" / "b.sql").write_text("select 1;\n" + text)
    (tmp_path / "in" / "open.sql").write_text(text + "\nselect 'never closed;\n" + text.replace("'", "").replace("$", ""))
    (tmp_path / "in" / "empty.sql").write_text("")
    (tmp_path / "in" / "small.sql").write_text("CREATE FUNCTION h() RETURNS int LANGUAGE c;")
    whole = sources.read_script_corpus(spark, str(tmp_path / "in"))
    with configured(spark, many_ranges(spark, size)):
        pieces = sources.script_pieces(spark, str(tmp_path / "in"), most=100).cache()
        assert spark.read.text(str(tmp_path / "in"), recursiveFileLookup=True).rdd.getNumPartitions() >= 3 * (size < 2000)
        for extract in (routines.extract_routines, routines.extract_comments):
            got = routines.renumbered(extract(pieces), ["path"])
            want = extract(whole).select(got.columns)
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        got = routines.attach_comments(routines.extract_routines(pieces), routines.extract_comments(pieces), ["path"])
        want = routines.parse_routines(whole)
        named = lambda df: sorted(map(str, df.select("path", "name", "body", "comment").collect()))
        assert named(got) == named(want)
        texts = {}
        for r in sorted(pieces.collect(), key=lambda r: (r.path, r.piece)):
            texts.setdefault(r.path, []).append(r.text)
        pieces.unpersist()
    assert {p: "\n".join(t) for p, t in texts.items()} == {r.path: r.text.removesuffix("\n") for r in whole.collect() if r.text}
    if size < 2000:
        assert sum(map(len, texts.values())) > 15


def test_a_body_over_many_ranges(spark, tmp_path, checkpoints):
    body = "\n".join(f"line {i} 'it /*" for i in range(60))
    (tmp_path / "a.sql").write_text(f"CREATE FUNCTION f() RETURNS int LANGUAGE sql AS $x$\n{body}$x$;\nCREATE FUNCTION g() RETURNS int LANGUAGE c;")
    with configured(spark, many_ranges(spark, 300)):
        pieces = sources.script_pieces(spark, str(tmp_path / "a.sql"), most=0)
        rows = {r.name: r.body for r in routines.extract_routines(pieces).collect()}
    assert rows == {"f": f"\n{body}", "g": None}


@pytest.mark.parametrize("size", [7, 1 << 20])
def test_lines_of_ranges(spark, tmp_path, size):
    rng = random.Random(3)
    texts = {"empty": "", "end": "a\n", "ends": "\n\n\n", "none": "one", "cr": "a\r\nb\r\n", "long": "\n".join("é" * rng.randrange(9) for _ in range(200))}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    with configured(spark, many_ranges(spark, size)):
        rows = sources.read_toc(spark, str(tmp_path)).collect()
    want = {(name, i, line) for name, text in texts.items() if text for i, line in enumerate(text.split("\n"))}
    assert {(Path(r.file).name, r.pos, r.line) for r in rows} == want and len(rows) == len(want)


@pytest.mark.parametrize("size", [60, 1 << 20])
def test_records_of_ranges(spark, tmp_path, checkpoints, size):
    """Equal to what Spark reads from whole files."""
    rng = random.Random(4)
    field = lambda: '"' + "".join(rng.choice(["a", "|", "\n", '""', " ", "é", ";"]) for _ in range(rng.randrange(12))) + '"'
    row = lambda: "|".join(rng.choice([field(), str(rng.randrange(99)), "", 'a"b', "t"]) for _ in CATALOG_COLUMNS)
    (tmp_path / "in").mkdir()
    for name in "xyz":
        (tmp_path / "in" / f"{name}.csv").write_text("\n".join(row() for _ in range(12)) + rng.choice(["", "\n"]))
    schema = ", ".join(f"`{c}` string" for c in CATALOG_COLUMNS)
    options = dict(sep="|", quote='"', escape='"', nullValue="", emptyValue="")
    whole = spark.read.schema(schema).options(multiLine="true", **options).csv(str(tmp_path / "in"))
    with configured(spark, many_ranges(spark, size)):
        got = export_records(spark, str(tmp_path / "in")).select(F.from_csv("text", schema, options).alias("r")).select("r.*").collect()
    assert sorted(map(str, got)) == sorted(map(str, whole.collect())) and len(got) == 36


CSV = (
    's|f|function|4294967295|1|_a|integer|text|f|"select ""x|y"";\nselect 2;"|sql|i|t|f|s|f|100|0|{a=1,b=2}|said\n'
    's|p|procedure|12||||void|f||plpgsql|v|f|t|u|f|1.5|0||\n'
)


def test_catalog_rows(spark, tmp_path):
    (tmp_path / "rows.csv").write_text(CSV)
    df = sources.read_catalog_rows(spark, str(tmp_path / "rows.csv"))
    f, p = sorted(df.collect(), key=lambda r: r.name)
    assert (f.routine_oid, f.param_ord, f.param_name, f.param_type) == (4294967295, 1, "_a", "integer")
    assert f.body == 'select "x|y";\nselect 2;'
    assert (f.return_setof, f.strict, f.config, f.comment, f.cost) == (False, True, ["a=1", "b=2"], "said", 100.0)
    assert (p.param_ord, p.param_name, p.body, p.comment, p.config) == (None, None, None, None, [])
    assert (p.security_definer, p.cost) == (True, 1.5)
    df.write.parquet(str(tmp_path / "rows.parquet"))
    with configured(spark, many_ranges(spark, 40)):
        split = sources.read_catalog_rows(spark, str(tmp_path / "rows.csv"), split=True)
        assert sorted(split.collect(), key=lambda r: r.name) == [f, p]
    again = sources.read_catalog_rows(spark, str(tmp_path / "rows.parquet"), "parquet")
    assert sorted(again.collect(), key=lambda r: r.name) == [f, p]


def test_jsonc(spark, tmp_path):
    (tmp_path / "c.json").write_text('// head\n{"a": "x // y" /* c */} // z')
    (row,) = sources.read_jsonc(spark, str(tmp_path)).withColumn("data", F.to_json("data")).collect()
    assert row.header == "// head\n" and json.loads(row.data) == {"a": "x // y"}
    (tmp_path / "c.json").write_text('{"a": 1, "a": 2}')
    (row,) = sources.read_jsonc(spark, str(tmp_path), checked=True).withColumn("data", F.to_json("data")).collect()
    assert row.valid and json.loads(row.data) == {"a": 2}


def read_back(folder):
    return "".join(p.read_text() for p in sorted(folder.glob("part-*")))


def test_write_routine_scripts(spark, tmp_path):
    out = str(tmp_path / "routines")
    first = spark.createDataFrame([("old", 1, "kept"), ("f", 1, "gone")], "name string, pos int, text string")
    sources.write_routine_scripts(first, out)
    rows = [("f", i, f"line {i}") for i in range(200)] + [("g", 0, "g0")]
    df = spark.createDataFrame(rows, "name string, pos int, text string").orderBy(F.rand(1))
    sources.write_routine_scripts(df, out)
    assert read_back(tmp_path / "routines" / "name=f") == "".join(f"line {i}\n" for i in range(200))
    assert read_back(tmp_path / "routines" / "name=g") == "g0\n"
    assert read_back(tmp_path / "routines" / "name=old") == "kept\n"


def test_stateless_operators_on_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.sql").write_text("CREATE FUNCTION f(_a int) RETURNS int LANGUAGE sql AS $$ 1 $$;")
    scripts = spark.readStream.option("wholetext", "true").text(str(tmp_path / "in"))
    query = (
        extract_routines(scripts, "value").writeStream.format("memory").queryName("found")
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    query.awaitTermination(60)
    assert [r.name for r in spark.table("found").collect()] == ["f"]


def test_catalogs_are_told_apart(spark, tmp_path):
    for name in ("north", "south"):
        (tmp_path / f"{name}.csv").write_text(CSV)
    rows = sources.read_catalog_rows(spark, str(tmp_path), catalog="catalog")
    assert {(r.catalog, r.name) for r in rows.collect()} == {(c, n) for c in ("north", "south") for n in ("f", "p")}
    rows.write.partitionBy("catalog").parquet(str(tmp_path / "rows"))
    again = sources.read_catalog_rows(spark, str(tmp_path / "rows"), "parquet", catalog="catalog")
    folded = catalog.fold_catalog_rows(again, by=("catalog",))
    assert sorted((r.catalog, r.name) for r in folded.collect()) == [("north", "f"), ("north", "p"), ("south", "f"), ("south", "p")]
    assert catalog.unfoldable_rows(again, ("catalog",)).count() == 0
    mixed = again.withColumn("name", F.concat("name", "catalog"))
    assert {r.reason for r in catalog.unfoldable_rows(mixed).collect()} == {"two names for one oid"}


LISTING = """;
1; 1255 16401 FUNCTION s f(integer) owner
2; 1259 16402 TABLE s t owner
3; 0 0 COMMENT s FUNCTION f(integer) owner
4; 1255 16403 PROCEDURE s g() owner"""


def test_listing_and_export(spark, tmp_path):
    lines = spark.createDataFrame([("x", i, t) for i, t in enumerate(LISTING.split("\n"))], "file string, pos int, line string")
    schema, groups = split_listing(lines)
    assert [r.line for r in schema.orderBy("pos").collect()] == [LISTING.split("\n")[0], LISTING.split("\n")[2]]
    assert {r.name for r in groups.collect()} == {"f", "g"}
    restored = spark.createDataFrame([("f", 0, "SET x = 1;"), ("f", 1, "CREATE FUNCTION"), ("g", 0, "select 1")], "name string, pos int, text string")
    export_routines(restored, str(tmp_path / "out"))
    assert "CREATE FUNCTION" in read_back(tmp_path / "out" / "name=f") and "SET x" not in read_back(tmp_path / "out" / "name=f")
