import hashlib
import re

from pyspark.sql import functions as F

from driftspark.functions import (
    extract_version,
    fingerprint,
    is_newer,
    mask_bodies,
    mask_secret,
    normalize_text,
    parse_pg_array,
    strip_sql_comments,
)
from driftspark.functions.text import literal_safe_text
from driftspark.operators.toc import clean_dump_lines


def column(spark, values, fn, names=("t",)):
    rows = [(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)]
    schema = "i int, " + ", ".join(f"{n} string" for n in names)
    df = spark.createDataFrame(rows, schema).select("i", fn(*[F.col(n) for n in names]).alias("x"))
    return [r.x for r in sorted(df.collect(), key=lambda r: r.i)]


def test_normalize_and_fingerprint(spark):
    texts = ["SELECT 1", "select   _a\n\t+  _b;", "  \n select 1;  \n", "select\x001", "É x", "", None]
    want = [
        None if t is None else re.sub(r"\s+", " ", re.sub(r"[^\x20-\x7e]", " ", t.lower())).strip()
        for t in texts
    ]
    assert column(spark, texts, normalize_text) == want
    hashes = column(spark, ["  SELECT\n    _a + _b;\n", "select _a + _b;", "select 2"], fingerprint)
    assert hashes[0] == hashes[1] != hashes[2]
    assert hashes[0] == hashlib.sha256(b"select _a + _b;").hexdigest()


def test_mask_secret(spark):
    values = ["x;PASSWORD = abc;Password=d", "Host=a", "password=", "a\nPassword=x\ny;b", None]
    assert column(spark, values, mask_secret) == [
        "x;PASSWORD = ****;Password=d", "Host=a", "password=****", "a\nPassword=****;b", None,
    ]


def test_parse_pg_array(spark):
    assert column(spark, ["{a,b=1}", "{}", "", None, "{x}"], parse_pg_array) == [
        ["a", "b=1"], [], [], [], ["x"],
    ]


def test_extract_version(spark):
    values = ["psql (PostgreSQL) 16.10 (Ubuntu 16.10-1)", "v3.10.0.0", "17", ""]
    assert column(spark, values, extract_version) == [
        "16.10", "3.10.0.0", "unknown output", "unknown output",
    ]


def test_is_newer(spark):
    pairs = [
        ("3.9.12", "v3.10.0"), ("3.10.0", "3.9.9"), ("1.2.3", "1.2.3"), ("1.2.3", "1.2.4"),
        ("1.2.3.9", "1.2.3.10"), ("x.1.0", "x.2.0"), ("1.2", "1.2.1"), ("1", "2"), ("v1.0.0", None),
        ("1.x.0", "2.0.0"),
    ]
    assert column(spark, pairs, is_newer, ("a", "b")) == [
        True, False, False, True, False, False, False, True, False, True,
    ]


def test_strip_sql_comments(spark):
    texts = {
        "a -- b\nc": "a \nc",
        "a /* x /* y */ z */ b": "a  b",
        "$t$ -- kept /* $t$ /* gone */": "$t$ -- kept /* $t$ ",
        "$open$ a -- gone": "$open$ a ",
        "'a--b' /* 'x */ \"c--d\" E'it\\'s --'": "'a--b'  \"c--d\" E'it\\'s --'",
        "/*/ still */ x": " x",
        "don't -- gone": "don't ",
        "f((1), (2 /* c */), [3])": "f((1), (2 ), [3])",
        "a /* open": "a ",
    }
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert {r.text: r.stripped for r in strip_sql_comments(df).collect()} == texts


def test_mask_bodies(spark):
    text = "f($$a -- b$$, 'x $$ y', ((1, $q$c$q$))) -- z"
    df = spark.createDataFrame([(text,), ("$a$$b$ x $b$$a$ $n$",), (None,)], "text string")
    rows = {r.text: (r.masked, r.bodies) for r in mask_bodies(df).collect()}
    assert rows[text] == ("f($$$$, 'x $$ y', ((1, $q$$q$))) ", ["a -- b", "c"])
    assert rows["$a$$b$ x $b$$a$ $n$"] == ("$a$$a$ $n$", ["$b$ x $b$"])


def test_clean_dump_lines(spark):
    sql = "\n".join(
        [
            "\\restrict abc", "SET statement_timeout = 0;", "SELECT pg_catalog.set_config('a', '', false);",
            "CREATE FUNCTION f()", "  SET x = 1", "ALTER FUNCTION s.f(integer) OWNER TO me;",
            "ALTER TABLE t OWNER TO me;", "\\unrestrict abc", "",
        ]
    )
    (row,) = clean_dump_lines(spark.createDataFrame([(sql,)], "text string")).collect()
    assert row.text.split("\n") == ["CREATE FUNCTION f()", "  SET x = 1", "ALTER TABLE t OWNER TO me;", ""]


def test_literal_safe_fingerprint(spark):
    """Case and blanks count within literals, quoted names and dollar quotes, and nowhere else."""
    texts = ["SELECT  'A  b' FROM T -- It's\n;", "select 'A  b' from t -- it's\n\n ;", "select 'a  b' from t -- it's\n;", 'select "A"', 'SELECT\t"A"', 'select "a"',
             "do $x$ A $x$", "DO  $x$ A $x$", "do $x$ a $x$", "select E'A\\' B'", "SELECT E'A\\' B'", "select 'open A", "SELECT 'open a", "a/* It's */b", "", None]
    got = column(spark, texts, literal_safe_text)
    assert got[0] == got[1] == "select 'A  b' from t -- it's ;" and got[2] == "select 'a  b' from t -- it's ;"
    assert got[3] == got[4] != got[5] and got[6] == got[7] != got[8] and got[9] == got[10] == "select E'A\\' B'"
    assert got[11] == got[12] == "select 'open a" and got[13:] == ["a/* it's */b", "", None]
