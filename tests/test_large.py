"""Whole large texts: no prefix, no depth or stack limit."""

import json
import pickle

from pyspark.sql import functions as F

from driftspark.functions import clean_dump_text, mask_secret, normalize_text, strip_sql_comments
from driftspark.functions.scan import routine_statements
from driftspark.operators import jsondocs, routines, settings


def test_one_script_with_many_routines(spark):
    n = 5000
    text = "".join(
        f"CREATE FUNCTION s.f_{i}(_a int, _b numeric(10,2)) RETURNS int LANGUAGE sql AS $$ {i} $$;\n"
        f"COMMENT ON FUNCTION s.f_{i}(int, numeric(10,2)) IS 'c{i}';\n"
        for i in range(n)
    )
    df = spark.createDataFrame([(1, text)], "script_id int, text string")
    rows = routines.parse_routines(df).select("pos", "name", "body", "comment").collect()
    assert {tuple(r) for r in rows} == {(i, f"f_{i}", f" {i} ", f"c{i}") for i in range(n)}


def recreated(n):
    return "".join(
        f"CREATE OR REPLACE FUNCTION s.f(_a int, _b text) RETURNS int LANGUAGE sql AS $$ {i} $$;\n"
        f"COMMENT ON FUNCTION s.f(int, text) IS 'c{i}';\n"
        for i in range(n)
    )


def test_one_routine_re_created_again_and_again(spark):
    """A definition carries one remark, so a script's rows grow with its length."""
    sizes = []
    for n in (2000, 4000):
        found = routine_statements(recreated(n))
        sizes.append(len(pickle.dumps([row[1:] for row in found])))
        assert {row[5] for row in found if row[0] == "create"} == {(f"'c{n - 1}'", False)}
    assert sizes[1] < 2.2 * sizes[0]
    df = spark.createDataFrame([(1, recreated(4000))], "script_id int, text string")
    assert {r.comment for r in routines.parse_routines(df).select("comment").collect()} == {"c3999"}


def test_long_parts(spark):
    long = "select 1; -- it''s\n" * 100_000
    many = ", ".join(f"_p{i} integer DEFAULT {'(' * 50}{i}{')' * 50}" for i in range(2000))
    text = (
        f"CREATE FUNCTION a() RETURNS int LANGUAGE sql AS $x$ {long} $x$;"
        f"CREATE FUNCTION b() RETURNS int LANGUAGE sql AS '{long}';"
        f"CREATE FUNCTION c() RETURNS int BEGIN ATOMIC {'SELECT f(1, (2)); ' * 50_000}END;"
        f"CREATE FUNCTION d({many}) RETURNS int LANGUAGE c;"
        f"/* {'/* ' * 5000} {'*/' * 5000} {long} */ CREATE FUNCTION e() RETURNS int LANGUAGE c;"
    )
    df = spark.createDataFrame([(text,)], "text string")
    rows = {r.name: r for r in routines.extract_routines(df).collect()}
    assert list(rows) == ["a", "b", "c", "d", "e"]
    assert rows["a"].body == f" {long} " and rows["b"].body == long.replace("''", "'")
    assert rows["c"].body.count("SELECT f(1, (2));") == 50_000
    assert len(rows["d"].parameters) == 2000 and rows["d"].parameters[1999].type == "integer"
    (plain,) = strip_sql_comments(df).collect()
    assert long in plain.stripped and plain.stripped.endswith("CREATE FUNCTION e() RETURNS int LANGUAGE c;")


def test_long_json(spark):
    header = "// line\n\n" * 50_000
    value = 'x \\" // ' * 100_000
    text = header + '{"a": "' + value + '", /*' + "*" * 500_000 + '*/ "b": 1}'
    (row,) = jsondocs.split_jsonc(spark.createDataFrame([(text,)], "text string")).select(
        "header", F.try_variant_get("data", "$.a", "string").alias("a")
    ).collect()
    assert row.header == header and row.a == json.loads(f'"{value}"')


def test_long_settings(spark):
    conn = ";".join(f"k{i % 5000}={i}" for i in range(20_000)) + ";Password=x"
    df = spark.createDataFrame([(conn,)], "conn string")
    rows = {r.key: (r.pos, r.value) for r in settings.parse_kv(df, "conn").collect()}
    assert len(rows) == 5001 and rows["k7"] == (7, "15007")
    (masked,) = df.select(mask_secret(F.col("conn")).alias("m")).collect()
    assert masked.m.endswith(";Password=****")
    template = "{A}-{B}" * 50_000
    (out,) = settings.resolve_placeholders(
        spark.createDataFrame([(1, template)], "id int, t string"),
        spark.createDataFrame([("A", "x")], "key string, value string"),
        "t",
    ).collect()
    assert out.resolved == "x-{B}" * 50_000 and len(out.unresolved) == 50_000


def test_long_lines(spark):
    text = "SET a = 1;\nkeep\n" * 100_000
    df = spark.createDataFrame([(text,)], "t string")
    (row,) = df.select(clean_dump_text(F.col("t")).alias("x"), normalize_text(F.col("t")).alias("n")).collect()
    assert row.x == "keep\n" * 100_000
    assert row.n == " ".join(["set a = 1; keep"] * 100_000)
