"""Extraction cases, read in one job and checked one by one."""

import pytest
from cases import CASES

from driftspark.functions.scan import routine_statements
from driftspark.operators import routines as ops

@pytest.fixture(scope="module")
def parsed(spark):
    scripts = spark.createDataFrame(list(CASES.items()), "script_id string, text string")
    found = {name: [] for name in CASES}
    rows = ops.resolve_attributes(ops.parse_routines(scripts)).collect()
    for row in sorted(rows, key=lambda r: r.pos):
        found[row.script_id].append(row.asDict(True))
    return found


def params(routine):
    return [(p["dir"], p["name"], p["type"]) for p in routine["parameters"]]


def names(routines):
    return [(r["kind"], r["schema"], r["name"]) for r in routines]


@pytest.mark.parametrize(
    "case", ["empty", "blank", "not_sql", "table_only", "null"]
)
def test_nothing_found(parsed, case):
    assert parsed[case] == []


def test_names(parsed):
    assert names(parsed["qualified"]) == [("function", "depot", "load_crate")]
    assert names(parsed["unqualified"]) == [("function", None, "tick")]
    assert names(parsed["overloads"]) == [("function", "s", "weigh")] * 2
    assert [len(r["parameters"]) for r in parsed["overloads"]] == [2, 3]
    assert names(parsed["commented_out"]) == [("procedure", "depot", "seen")]
    assert names(parsed["open_comment"]) == [("function", None, "a")]
    assert names(parsed["dynamic"]) == [("function", "t", "maker")]
    assert parsed["dynamic"][0]["comment"] is None


def test_words_without_blanks_between(parsed):
    assert names(parsed["close_words"]) == [
        ("function", None, "f"), ("function", None, "g"), ("function", None, "Foo"), ("procedure", "s", "P"),
    ]
    assert [r["comment"] for r in parsed["close_words"]] == ["one", "two", None, "four"]
    assert [r["body"] for r in parsed["close_words"]] == [" 1 ", " 2 ", " 3 ", " 4 "]


@pytest.fixture(scope="module")
def counted(spark):
    """Of each case: how many routines, comments, rejects and statements."""
    scripts = spark.createDataFrame(list(CASES.items()), "script_id string, text string")
    kinds = (ops.extract_routines(scripts), ops.extract_comments(scripts), ops.rejects(scripts))
    counts = [{r.script_id: r["count"] for r in df.groupBy("script_id").count().collect()} for df in kinds]
    return {name: ([c.get(name, 0) for c in counts], len(routine_statements(text or ""))) for name, text in CASES.items()}


def test_every_statement_is_somewhere(counted):
    for name, (counts, statements) in counted.items():
        assert sum(counts) == statements, name


def test_comment_index_agrees_with_the_join(spark, parsed):
    """The scanner's index and the join by name and types give every routine the same comment."""
    scripts = spark.createDataFrame(list(CASES.items()), "script_id string, text string")
    joined = ops.attach_comments(ops.extract_routines(scripts), ops.extract_comments(scripts), ["script_id"])
    got = {(r.script_id, r.pos): r.comment for r in joined.collect()}
    assert got == {(name, r["pos"]): r["comment"] for name, found in parsed.items() for r in found}


def test_parameters(parsed):
    assert params(parsed["modes"][0]) == [
        ("in", "_a", "integer"), ("out", "_b", "numeric"), ("inout", "_c", "text"),
        ("variadic", "_d", "text[]"), ("in", None, "integer"),
    ]
    assert params(parsed["unnamed"][0]) == [(None, None, "integer")] * 2
    assert params(parsed["defaults"][0]) == [
        (None, "_a", "integer"), (None, "_b", "text"), (None, "_c", "jsonb"), ("in", "_d", "text"),
        (None, "_e", "numeric"), (None, "_f", "text[]"), (None, "_g", "text"),
        (None, "_h", "integer[]"), (None, "_i", "text"), (None, "_j", "int"), (None, "_k", "text"),
    ]
    assert params(parsed["multi_word"][0]) == [
        (None, None, "character varying"), (None, "_a", "double precision"),
        (None, None, "timestamp without time zone"), (None, "_b", "timestamp with time zone"),
        (None, None, "bit varying(5)[]"), (None, "_c", "numeric(10,2)"),
    ]
    assert params(parsed["deep_default"][0]) == [(None, "_a", "int"), (None, "_b", "text")]
    assert [p["pos"] for p in parsed["modes"][0]["parameters"]] == [1, 2, 3, 4, 5]
    assert params(parsed["unqualified"][0]) == []
    assert params(parsed["quoted_type"][0]) == [(None, "_a", '"My Type"')]


def test_returns(parsed):
    def returns(case, i=0):
        return parsed[case][i]["returns"]

    assert returns("qualified") == {"setof": False, "type": "void", "table": None}
    assert returns("setof") == {"setof": True, "type": "record", "table": None}
    assert returns("returns_array") == {"setof": False, "type": "integer[]", "table": None}
    assert returns("returns_table") == {
        "setof": False, "type": None,
        "table": [
            {"name": "id", "type": "integer"}, {"name": "tags", "type": "text[]"},
            {"name": "at", "type": "timestamp with time zone"}, {"name": "n", "type": "numeric(8,2)"},
        ],
    }
    assert returns("returns_line")["type"] == "trigger"
    assert returns("null_input_only") is None
    assert returns("modes") is None
    assert returns("atomic") == {"setof": False, "type": "int", "table": None}
    assert returns("no_returns_first") is None
    assert returns("no_returns_first", 1)["type"] == "text"
    assert returns("no_body")["type"] == "void"
    assert returns("quoted_type")["type"] == '"My Type"'


def test_attributes(parsed):
    assert parsed["attributes"][0]["attributes"] == [
        "ROWS 70", "COST 8", "STRICT", "PARALLEL RESTRICTED", "STABLE", "LANGUAGE sql", "WINDOW",
        "NOT LEAKPROOF", "TRANSFORM FOR TYPE hstore", "SUPPORT depot.s", "RETURNS NULL ON NULL INPUT",
        "CALLED ON NULL INPUT", "EXTERNAL SECURITY DEFINER", "SECURITY INVOKER",
        "SET search_path = depot", "SET lock_timeout TO '5s'", "SET a FROM CURRENT",
        "SET b = 'x, y'", "LEAKPROOF",
    ]
    assert parsed["lower_attributes"][0]["attributes"] == ["language plpgsql", "security definer"]
    assert parsed["c_function"][0]["attributes"] == ["LANGUAGE c", "WINDOW"]
    assert parsed["no_body"][0]["attributes"] == ["LANGUAGE c"]
    assert parsed["atomic"][0]["attributes"] == ["IMMUTABLE", "PARALLEL SAFE"]
    assert parsed["returns_table"][0]["attributes"] == ["LANGUAGE sql"]


def test_resolved_attributes(parsed):
    full = parsed["attributes"][0]
    assert (full["language"], full["volatility"], full["parallel"]) == ("sql", "stable", "restricted")
    assert (full["strict"], full["security_definer"], full["leakproof"]) == (True, True, True)
    assert (full["cost"], full["rows"]) == (8.0, 70.0)
    assert full["config"] == [
        "search_path=depot", "lock_timeout=5s", "SET a FROM CURRENT", "b=x, y",
    ]
    plain = parsed["atomic"][1]
    assert (plain["language"], plain["volatility"], plain["parallel"]) == ("sql", "volatile", "unsafe")
    assert (plain["strict"], plain["security_definer"], plain["leakproof"]) == (False,) * 3
    assert (plain["cost"], plain["rows"], plain["config"]) == (100.0, 0.0, [])
    assert parsed["setof"][0]["rows"] == 1000.0
    assert parsed["returns_table"][0]["rows"] == 1000.0
    assert parsed["ragged"][0]["language"] == "sql"


def test_bodies(parsed):
    def body(case, i=0):
        return parsed[case][i]["body"]

    assert "$re$[\\t]+z$re$" in body("tags") and "-- has $$ and /* in it" in body("tags")
    assert body("tags", 1) == " 2 "
    assert body("tags", 2) == "$b$ 'it $b$"
    assert body("unnamed") == "SELECT $2 - $1 * 3"
    assert body("quoted") == "SELECT '\"' || _n || '\"'"
    assert body("quoted", 1) == "SELECT E'one\ntwo'"
    assert body("quoted", 2) == "a--b"
    assert body("c_function") == "the_symbol"
    assert body("no_body") is None and body("no_body", 1) == " 1 "
    assert "INSERT INTO depot.log VALUES (f(g($1)), 'x;y');" in body("atomic")
    assert "SELECT CASE WHEN $1 > 0 THEN 1 END;" in body("atomic")
    assert body("atomic", 1) == " SELECT 2; "
    assert [r["atomic"] for r in parsed["atomic"]] == [True] * 3
    assert [b[1] for b in (body("long_bodies", i) for i in range(3))] == ["0", "1", "2"]
    assert body("no_returns_first") == " a " and body("no_returns_first", 1) == " b "
    assert body("control_chars") == " \x010\x02 "


def test_ragged_layout(parsed):
    (routine,) = parsed["ragged"]
    assert names([routine]) == [("function", "depot", "ragged")]
    assert params(routine) == [(None, "_n", "BIGINT"), (None, "_word", "TEXT")]
    assert routine["returns"]["type"] == "date"
    assert routine["attributes"] == ["Language SQL", "Immutable", "Parallel Safe"]


def test_garbage_does_not_fail(parsed):
    (routine,) = parsed["garbage"]
    assert params(routine)[-2:] == [(None, "a", "b c d"), (None, '"q"', '"t"')]


def test_control_characters(parsed):
    assert params(parsed["control_chars_outside"][0]) == [
        (None, "_a", "\x03int"), (None, "_b", "\x017\x02"),
    ]


def test_comments(parsed):
    assert [(r["name"], r["comment"]) for r in parsed["comments"]] == [
        ("plus", "It's ; new"), ("one", None), ("one", "proc"), ("bare", None),
    ]


def test_quoted_and_dollar_names(parsed):
    assert names(parsed["quoted_name"]) == [("function", "depot", "Odd Name")]
    assert names(parsed["quoted_names"]) == [
        ("function", "Big Depot", 'Odd "N"ame'), ("procedure", "plain", "h$1"), ("function", None, "a$b$c"),
    ]
    assert [r["comment"] for r in parsed["quoted_names"]] == ["odd", "tag", None]
    assert [r["language"] for r in parsed["quoted_names"]] == ["plpgsql", "sql", "sql"]
    assert [r["body"] for r in parsed["quoted_names"]] == [" 1 ", " 2 ", " 3 "]


def test_comment_forms(parsed):
    assert [(r["name"], r["comment"]) for r in parsed["comment_forms"]] == [
        ("k", "by inputs"), ("l", "one\n'two'\\"), ("m", None),
    ]


def test_lists_types_and_bodies(parsed):
    f, g, h, w = parsed["lists"]
    assert f["config"] == ['search_path=public, "$user", pg_temp', "lock_timeout=5s", "b=one, it's two"]
    assert (f["returns"]["type"], f["leakproof"], f["security_definer"], f["cost"]) == ("int", True, True, 7.0)
    assert (g["returns"]["type"], g["strict"], g["cost"], g["body"]) == ("bigint", True, 1.0, "int8in")
    assert (h["returns"]["type"], h["atomic"], h["body"], h["attributes"]) == ("int", True, "RETURN 1 + 2", [])
    assert (w["returns"]["type"], w["body"], w["cost"], w["attributes"]) == ("int", "w_symbol", 1.0, ["WINDOW", "LANGUAGE c"])


def test_no_statement_is_lost(spark, parsed):
    from driftspark.functions.scan import routine_statements

    scripts = spark.createDataFrame(list(CASES.items()), "script_id string, text string")
    counts = [
        df.groupBy("script_id").count().collect()
        for df in (ops.extract_routines(scripts), ops.extract_comments(scripts), ops.rejects(scripts))
    ]
    read = {}
    for rows in counts:
        for r in rows:
            read[r.script_id] = read.get(r.script_id, 0) + r["count"]
    assert read == {c: n for c, t in CASES.items() if (n := len(routine_statements(t or "")))}
    unread = {(r.script_id, r.verb, r.pos): r for r in ops.rejects(scripts).collect()}
    assert unread["unread", "create", 0].head.startswith("CREATE FUNCTION (a int)")
    assert unread["unread", "comment", 0].reason == "no routine signature or no text"


def test_comment_right_behind_the_word(parsed):
    assert names(parsed["comment_behind_word"]) == [("function", "app", "f")]
    assert names(parsed["line_comment_behind_word"]) == [("procedure", "app", "p")]


def test_stray_brackets(parsed):
    assert params(parsed["unbalanced_before"][0]) == [(None, "_a", "numeric(1,2)")]
    assert params(parsed["open_before"][0]) == [(None, "_a", "numeric(1,2)"), (None, "_b", "int")]
    assert names(parsed["rule_before"]) == [("function", None, "f")]


def test_separate_operators_agree_with_parse(spark, parsed):
    scripts = spark.createDataFrame(list(CASES.items()), "script_id string, text string")
    joined = ops.attach_comments(
        ops.extract_routines(scripts), ops.extract_comments(scripts), ["script_id"]
    ).collect()
    got = sorted((r.script_id, r.pos, r.name, r.comment or "") for r in joined)
    want = sorted(
        (case, r["pos"], r["name"], r["comment"] or "") for case, rs in parsed.items() for r in rs
    )
    assert got == want


def test_exploded_views(spark):
    scripts = spark.createDataFrame([("x", CASES["returns_table"]), ("y", CASES["modes"])], "script_id string, text string")
    routines = ops.extract_routines(scripts)
    assert ops.extract_parameters(routines).count() == 5
    assert [r.column.name for r in ops.extract_returns(routines).orderBy("column_pos").collect()] == [
        "id", "tags", "at", "n",
    ]
    assert ops.extract_attributes(routines).count() == 2
    assert ops.extract_bodies(routines).count() == 2


def test_no_shuffle_in_extraction(spark):
    scripts = spark.createDataFrame([("x", CASES["modes"])], "script_id string, text string")
    plan = ops.extract_routines(scripts)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1
    whole = ops.parse_routines(scripts)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in whole and whole.count("ArrowEvalPython") == 1
