import pytest
from pyspark.sql import functions as F

from driftspark.operators import catalog, drift, routines
from driftspark.plans import drift_report
from driftspark.schemas import CATALOG_COLUMNS, CATALOG_ROWS

PROC = """oid long, proname string, pronamespace long, prolang long, prokind string,
    proargnames array<string>, proargtypes array<long>, prorettype long, proretset boolean,
    prosrc string, provolatile string, proisstrict boolean, prosecdef boolean, proparallel string,
    proleakproof boolean, procost float, prorows float, proconfig array<string>"""
TYPES = {20: "bigint", 23: "integer", 25: "text", 16: "boolean", 2249: "record", 2278: "void", 1043: "character varying"}


def proc(oid, name, args=(), names=None, kind="f", ret=25, retset=False, src=" x ", lang=14, vol="v",
         strict=False, secdef=False, par="u", leak=False, cost=100.0, rows=0.0, config=None, ns=1):
    return (oid, name, ns, lang, kind, names, list(args), ret, retset, src, vol, strict, secdef, par,
            leak, cost, rows, config)


def system_tables(spark, procs, remarks=()):
    return (
        spark.createDataFrame(procs, PROC),
        spark.createDataFrame([(1, "s"), (2, "other"), (3, "pg_x")], "oid long, nspname string"),
        spark.createDataFrame([(14, "sql"), (13, "plpgsql")], "oid long, lanname string"),
        spark.createDataFrame(list(TYPES.items()), "oid long, type_name string"),
        spark.createDataFrame(list(remarks), "objoid long, description string"),
    )


def test_catalog_metadata_and_fold(spark):
    tables = system_tables(
        spark,
        [
            proc(7, "b", [23, 25, 16], ["_first", "", "_third"], vol="i", par="s"),
            proc(5, "a", kind="p", ret=2278, config=["x=1"]),
            proc(6, "agg", kind="a", ns=2),
            proc(8, "z", [99], ns=3),
        ],
        [(7, "said")],
    )
    rows = catalog.catalog_metadata(*tables).collect()
    assert [(r.schema, r.name, r.param_ord, r.param_name, r.param_type) for r in rows] == [
        ("other", "agg", None, None, None), ("pg_x", "z", 1, None, None), ("s", "a", None, None, None),
        ("s", "b", 1, "_first", "integer"), ("s", "b", 2, None, "text"), ("s", "b", 3, "_third", "boolean"),
    ]
    assert [r.type for r in rows][:3] == [None, "function", "procedure"]
    chosen = spark.createDataFrame([("s",), ("nowhere",)], "schema string")
    some = catalog.catalog_metadata(*tables, schemas=chosen)
    assert {r.name for r in some.collect()} == {"a", "b"}
    none = catalog.catalog_metadata(*tables, schemas=chosen.where("false"))
    assert none.count() == 0

    folded = {r.name: r.asDict(True) for r in catalog.fold_catalog_rows(some).collect()}
    assert [(p["ord"], p["name"], p["type"]) for p in folded["b"]["parameters"]] == [
        (1, "_first", "integer"), (2, None, "text"), (3, "_third", "boolean"),
    ]
    assert folded["b"]["returns"] == {"setof": False, "type": "text"}
    assert (folded["b"]["volatility"], folded["b"]["parallel"], folded["b"]["config"]) == ("immutable", "safe", [])
    assert folded["b"]["comment"] == "said"
    assert folded["a"]["returns"] is None and folded["a"]["parameters"] == []
    assert (folded["a"]["kind"], folded["a"]["config"]) == ("procedure", ["x=1"])


def test_argument_modes_shift(spark):
    tables = system_tables(spark, [proc(1, "f", [23, 25], ["_o", "_a", "_b"])])
    modes = tables[0].withColumn("proargmodes", F.array(F.lit("o"), F.lit("i"), F.lit("i")))
    rows = catalog.catalog_metadata(modes, *tables[1:]).collect()
    assert [r.param_name for r in rows] == ["_a", "_b"]


def test_codes(spark):
    df = spark.createDataFrame([], CATALOG_ROWS)
    row = {c: None for c in CATALOG_COLUMNS} | {"type": "function", "volatility": "q", "parallel": "r"}
    df = spark.createDataFrame([tuple(row[c] for c in CATALOG_COLUMNS)], CATALOG_ROWS)
    (out,) = catalog.decode_catalog_codes(df).collect()
    assert (out.volatility, out.parallel, out.config) == ("volatile", "restricted", [])


def test_user_schemas(spark):
    names = ["public", "pg_catalog", "pgdata", "_own", "information_schema", "app", "page", "pg"]
    df = spark.createDataFrame([(n,) for n in names], "nspname string")
    assert [r.nspname for r in catalog.user_schemas(df).collect()] == ["app", "page", "pg", "public"]


SCRIPTS = {
    "same": ("CREATE FUNCTION s.same(_a integer, text) RETURNS text LANGUAGE sql AS $$ SELECT\n 1; $$;", {}),
    "defaults": (
        "CREATE FUNCTION s.defaults(_a int) RETURNS integer LANGUAGE sql VOLATILE CALLED ON NULL INPUT"
        " NOT LEAKPROOF PARALLEL UNSAFE COST 100 SECURITY INVOKER AS $$ x $$;", {}),
    "scrambled": (
        "CREATE FUNCTION s.scrambled() RETURNS SETOF integer STABLE ROWS 70 PARALLEL RESTRICTED COST 8 STRICT"
        " SET search_path = depot LANGUAGE sql SET lock_timeout TO '5s' AS $$ x $$;", {}),
    "tabular": ("CREATE FUNCTION s.tabular() RETURNS TABLE(a int) LANGUAGE sql AS $$ x $$;", {}),
    "proc": ("CREATE PROCEDURE s.proc(IN _a integer, OUT _b text) LANGUAGE sql AS $$ x $$;", {}),
    "atomic": ("CREATE FUNCTION s.atomic() RETURNS integer BEGIN ATOMIC SELECT 1; END;", {}),
    "public_one": ("CREATE FUNCTION s.body() RETURNS text LANGUAGE sql AS $$ changed $$;", {}),
    "attrs": ("CREATE FUNCTION s.attrs() RETURNS text LANGUAGE plpgsql STABLE STRICT AS $$ x $$;", {}),
    "renamed": ("CREATE FUNCTION s.renamed(_b integer) RETURNS text LANGUAGE sql AS $$ x $$;", {}),
    "retyped": ("CREATE FUNCTION s.retyped(_a boolean) RETURNS text LANGUAGE sql AS $$ x $$;", {}),
    "kind": ("CREATE PROCEDURE s.kind() LANGUAGE sql AS $$ x $$;", {}),
    "missing": ("CREATE FUNCTION s.missing() RETURNS text LANGUAGE sql AS $$ x $$;", {}),
    "over": ("CREATE FUNCTION s.over(integer) RETURNS text LANGUAGE sql AS $$ x $$;"
             "CREATE FUNCTION s.over(integer, integer) RETURNS text LANGUAGE sql AS $$ x $$;"
             "CREATE FUNCTION s.over(boolean) RETURNS text LANGUAGE sql AS $$ x $$;", {}),
    "twice": ("CREATE FUNCTION s.same(_a integer, text) RETURNS text LANGUAGE sql AS $$ other $$;", {}),
    "remark": ("CREATE FUNCTION s.remark() RETURNS text LANGUAGE sql AS $$ x $$;"
               "COMMENT ON FUNCTION s.remark() IS 'new';", {}),
}
PROCS = [
    proc(1, "same", [23, 25], ["_a", ""], src="select 1;"),
    proc(2, "defaults", [23], ["_a"], ret=23),
    proc(3, "scrambled", ret=23, retset=True, cost=8.0, rows=70.0, strict=True, par="r", vol="s",
         config=["search_path=depot", "lock_timeout=5s"]),
    proc(4, "tabular", ret=2249, retset=True, rows=1000.0),
    proc(5, "proc", [23], ["_a"], kind="p", ret=2249),
    proc(6, "atomic", ret=23, src=""),
    proc(7, "body"),
    proc(8, "attrs"),
    proc(9, "renamed", [23], ["_a"]),
    proc(10, "retyped", [23], ["_a"]),
    proc(11, "kind"),
    proc(12, "extra"),
    proc(13, "over", [23]),
    proc(14, "over", [25]),
    proc(15, "over", [20]),
    proc(16, "remark"),
]


@pytest.fixture(scope="module")
def matched(spark):
    scripts = spark.createDataFrame([(k, v[0]) for k, v in SCRIPTS.items()], "script_id string, text string")
    desired = drift.desired_state(routines.parse_routines(scripts))
    rows = catalog.catalog_metadata(*system_tables(spark, PROCS, [(16, "old")]), ordered=False)
    actual = drift.actual_state(catalog.fold_catalog_rows(rows))
    return drift.match_routines(desired, actual).cache()


def test_drift(matched):
    rows = {}
    for r in drift.diff_routines(matched).collect():
        rows.setdefault(r.name, []).append((r.signature, r.status, r.changed_fields))
    rows = {k: sorted(v) for k, v in rows.items()}
    assert rows == {
        "same": [("integer,text", "changed", ["body"]), ("integer,text", "same", [])],
        "defaults": [("int", "changed", ["parameters"])],
        "scrambled": [("", "same", [])],
        "tabular": [("", "same", [])],
        "proc": [("integer", "same", [])],
        "atomic": [("", "same", [])],
        "body": [("", "changed", ["body"])],
        "attrs": [("", "changed", ["language", "volatility", "strict"])],
        "renamed": [("integer", "changed", ["parameters"])],
        "retyped": [("boolean", "changed", ["parameters"])],
        "kind": [("", "changed", ["kind", "returns"])],
        "missing": [("", "missing", [])],
        "extra": [("", "extra", [])],
        "over": [
            ("bigint", "extra", []), ("boolean", "missing", []), ("integer", "same", []),
            ("integer,integer", "missing", []), ("text", "extra", []),
        ],
        "remark": [("", "same", [])],
    }


def test_flags(matched):
    rows = {(r.name, r.status): r for r in drift.diff_routines(matched).collect()}
    assert rows["remark", "same"].comment_changed is True
    assert rows["scrambled", "same"].comment_changed is False
    assert rows["missing", "missing"].comment_changed is None
    assert rows["atomic", "same"].body_unverified is True
    assert rows["attrs", "changed"].body_unverified is False
    assert rows["extra", "extra"].kind == "function"


def test_diff_comments(matched):
    rows = [tuple(r) for r in drift.diff_comments(matched).collect()]
    assert rows == [("s", "remark", "", "new", "old")]


def test_canonical_types(spark):
    script = "CREATE FUNCTION s.defaults(_a int4, _b varchar(10)[]) RETURNS int LANGUAGE sql AS $$ x $$;"
    scripts = spark.createDataFrame([("x", script)], "script_id string, text string")
    (row,) = drift.desired_state(routines.parse_routines(scripts), canonical_types=True).collect()
    assert row.signature == "integer,character varying[]" and row.returns.type == "integer"


def test_scope_keeps_catalogs_apart(spark):
    script = "CREATE FUNCTION s.f() RETURNS text LANGUAGE sql AS $$ x $$;"
    scripts = spark.createDataFrame([("one", script), ("two", script)], "db string, text string")
    desired = drift.desired_state(routines.parse_routines(scripts), by=("db",))
    rows = catalog.catalog_metadata(*system_tables(spark, [proc(1, "f")]), ordered=False)
    flat = rows.withColumn("db", F.lit("one"))
    actual = drift.actual_state(catalog.fold_catalog_rows(flat, by=("db",)), by=("db",))
    found = drift.diff_routines(drift.match_routines(desired, actual, by=("db",))).collect()
    assert sorted((r.db, r.status) for r in found) == [("one", "same"), ("two", "missing")]


def test_duplicate_bodies(spark):
    df = spark.createDataFrame([(3, "A  b"), (2, "a\nb "), (1, "c"), (4, None), (5, None)], "id int, t string")
    (row,) = drift.duplicate_bodies(df, "id", "t").collect()
    assert (row.copies, row.first_key) == (2, 2)


SAME = """CREATE FUNCTION s.lists(_a int, OUT _b text) LANGUAGE 'sql' SET search_path = public, pg_temp AS $$ x $$;
    CREATE FUNCTION s.native(internal) RETURNS internal LEAKPROOF LANGUAGE c AS 'obj', 'link';
    CREATE FUNCTION s.escaped() RETURNS SETOF int LANGUAGE sql AS E'a\\nb';
    CREATE FUNCTION s.two(OUT _a int, OUT _b int) LANGUAGE sql RETURNS NULL ON NULL INPUT AS $$ x $$;
    CREATE FUNCTION s."Odd"() RETURNS int RETURN 1;"""


def same_rows():
    base = dict.fromkeys(CATALOG_COLUMNS)
    base |= dict(schema="s", type="function", return_setof=False, body="x", language="sql", volatility="v", strict=False,
                 security_definer=False, parallel="u", leakproof=False, cost=100.0, rows=0.0, config=[])
    return [
        base | dict(name="lists", routine_oid=1, param_ord=1, param_name="_a", param_type="int", return_type="text", config=["search_path=public, pg_temp"]),
        base | dict(name="native", routine_oid=2, param_ord=1, param_type="internal", return_type="internal", language="c", cost=1.0, body="link", leakproof=True),
        base | dict(name="escaped", routine_oid=3, return_type="int", return_setof=True, rows=1000.0, body="a\nb"),
        base | dict(name="two", routine_oid=4, return_type="record", strict=True),
        base | dict(name="Odd", routine_oid=5, return_type="int", body=""),
    ]


def test_faithful_deployments_are_the_same(spark):
    scripts = spark.createDataFrame([(SAME,)], "text string")
    rows = spark.createDataFrame([tuple(r[c] for c in CATALOG_COLUMNS) for r in same_rows()], CATALOG_ROWS)
    found = {r.name: r for r in drift_report(scripts, rows).collect()}
    assert {n: (r.status, r.changed_fields) for n, r in found.items()} == {n: ("same", []) for n in ("lists", "native", "escaped", "two", "Odd")}
    assert [n for n, r in found.items() if r.body_unverified] == ["Odd"]


FIELDS = {
    "type": ("procedure", {"kind"}), "param_name": ("_z", {"parameters"}), "return_type": ("int", {"returns"}), "body": ("y", {"body"}),
    "language": ("plpgsql", {"language"}), "volatility": ("i", {"volatility"}), "strict": (True, {"strict"}), "security_definer": (True, {"security_definer"}),
    "parallel": ("s", {"parallel"}), "leakproof": (True, {"leakproof"}), "cost": (5.0, {"cost"}), "rows": (9.0, {"rows"}), "config": (["a=b"], {"config"}),
}


@pytest.mark.parametrize("field", FIELDS)
def test_each_field_is_compared(spark, field):
    value, changed = FIELDS[field]
    scripts = spark.createDataFrame([(SAME.split(";")[0] + ";",)], "text string")
    row = same_rows()[0] | {field: value}
    rows = spark.createDataFrame([tuple(row[c] for c in CATALOG_COLUMNS)], CATALOG_ROWS)
    (found,) = drift_report(scripts, rows).collect()
    # a procedure returns nothing
    assert (found.status, set(found.changed_fields)) == ("changed", changed | ({"returns"} if field == "type" else set()))
