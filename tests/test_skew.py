"""Hot keys: results stay whole, and the plans split or pre-aggregate what is hot."""

from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from driftspark.operators import drift, routines, settings, toc

SPLITTING = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@contextmanager
def settings_of(spark, options):
    old = {k: spark.conf.get(k, None) for k in options}
    for k, v in options.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_split(spark, build):
    """Rows and final plan with broadcasts off and small skew thresholds."""
    with settings_of(spark, SPLITTING):
        df = build()
        rows = df.collect()
        return rows, df._jdf.queryExecution().executedPlan().toString()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_listing_name(spark):
    n = 6000
    lines = spark.range(0, n, 1, 8).select(
        F.lit("f").alias("file"),
        F.col("id").cast("int").alias("pos"),
        F.expr(
            """id || CASE WHEN id % 4 = 0 THEN '; 1255 1 FUNCTION s ' ELSE '; 0 0 ACL s FUNCTION ' END
            || CASE WHEN id % 3 = 0 THEN 'hot' ELSE 'f_' || id % 500 END || '(integer) me'"""
        ).alias("line"),
    )
    rows, plan = run_split(spark, lambda: toc.group_toc(lines))
    assert "skew=true" in plan
    first, want = {}, set()
    for i in range(n):
        name = "hot" if i % 3 == 0 else f"f_{i % 500}"
        if i % 4 == 0:
            first.setdefault(name, i)
        if name in first:
            want.add((name, first[name], i))
    assert {(r.name, r.first_pos, r.pos) for r in rows} == want and len(rows) == len(want)


def test_hot_template_and_name(spark):
    n = 6000
    templates = spark.range(0, n, 1, 8).selectExpr(
        "id % 7 AS group", "CASE WHEN id % 3 = 0 THEN 'same {HOT}' ELSE '{HOT}/{' || id || '}' END AS text"
    )
    dictionary = spark.createDataFrame([("HOT", "x"), ("4", "four")], "key string, value string")
    rows, plan = run_split(
        spark, lambda: settings.resolve_placeholders(templates, dictionary, "text")
    )
    assert "skew=true" in plan
    got = sorted((r.group, r.resolved) for r in rows)
    want = sorted(
        (i % 7, "same x" if i % 3 == 0 else "x/four" if i == 4 else f"x/{{{i}}}") for i in range(n)
    )
    assert got == want


def test_hot_signature(spark):
    n = 3000
    scripts = spark.range(0, n, 1, 8).selectExpr(
        "id AS script_id",
        "'CREATE FUNCTION s.' || CASE WHEN id % 3 = 0 THEN 'hot' ELSE 'f_' || id END ||"
        " '() RETURNS text LANGUAGE sql AS $$ ' || id % 2 || ' $$;' AS text",
    )
    actual = drift.desired_state(
        routines.extract_routines(
            spark.createDataFrame(
                [("CREATE FUNCTION s.hot() RETURNS text LANGUAGE sql AS $$ 1 $$;",)], "text string"
            )
        )
    ).drop("atomic")
    desired = drift.desired_state(routines.extract_routines(scripts))
    rows, plan = run_split(spark, lambda: drift.diff_routines(drift.match_routines(desired, actual)))
    assert "skew=true" in plan
    status = [r.status for r in rows]
    assert (status.count("same"), status.count("changed"), status.count("missing")) == (500, 500, 2000)
    assert len(rows) == n


def test_hot_comment_key(spark):
    n = 3000
    text = "CREATE FUNCTION hot() RETURNS int LANGUAGE c; COMMENT ON FUNCTION hot() IS 'said';"
    scripts = spark.range(0, n, 1, 8).select(F.lit("one source").alias("source"), F.lit(text).alias("text"))
    build = lambda: routines.attach_comments(
        routines.extract_routines(scripts), routines.extract_comments(scripts), ["source"]
    )
    rows, plan = run_split(spark, build)
    assert len(rows) == n and {r.comment for r in rows} == {"said"}
    parsed = routines.parse_routines(scripts).collect()
    assert len(parsed) == n and {r.comment for r in parsed} == {"said"}


def test_comments_are_not_broadcast(spark):
    scripts = spark.createDataFrame([("s", "CREATE FUNCTION f() RETURNS int LANGUAGE c; COMMENT ON FUNCTION f() IS 'said';")], "source string, text string")
    found = routines.attach_comments(routines.extract_routines(scripts), routines.extract_comments(scripts), ["source"])
    assert [r.comment for r in found.collect()] == ["said"]
    assert "Broadcast" not in plan_of(found)


@pytest.mark.parametrize("operator", ["duplicate_bodies", "last_comment", "layered_merge", "first_seen", "missing_keys"])
def test_combined_before_the_shuffle(spark, operator):
    rows = spark.range(100).selectExpr(
        "id", "'x' AS text", "1 AS pos", "'k' AS kind", "'s' AS schema", "'n' AS name", "array('t') AS arg_types",
        "'c' AS comment", "1 AS layer_rank", "'s' AS section", "'k' AS key", "'v' AS value",
    )
    df = {
        "duplicate_bodies": lambda: drift.duplicate_bodies(rows, "id", "text"),
        "last_comment": lambda: routines.last_comment(rows, []),
        "layered_merge": lambda: settings.layered_merge(rows),
        "first_seen": lambda: settings.first_seen(rows.select("key", "id", "text"), ["key"], "id"),
        "missing_keys": lambda: settings.missing_keys(rows, rows),
    }[operator]()
    plan = plan_of(df)
    below = plan[plan.index("Exchange hashpartitioning"):]
    assert "Aggregate" in below


def test_small_tables_are_broadcast_only_by_size(spark):
    from driftspark.workload import inputs
    from driftspark.operators import catalog

    tables = inputs.system_tables(spark, "/root/testdata/sf0.001")
    assert "BroadcastHashJoin" in plan_of(catalog.catalog_metadata(**tables))
    with settings_of(spark, SPLITTING):
        assert "Broadcast" not in plan_of(catalog.catalog_metadata(**tables))


def test_filters_and_columns_reach_the_scan(spark):
    from driftspark.workload import queries

    plan = plan_of(queries.QUERIES["duplicate_bodies"](spark, "/root/testdata/sf0.001"))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    assert "IsNotNull(text)" in plan


def test_scripts_are_scanned_once(spark):
    """Pairing reads the scripts' compact rows twice, the second time from the first one's shuffle."""
    from driftspark.workload import queries

    df = queries.QUERIES["drift_report"](spark, "/root/testdata/sf0.001")
    df.collect()
    final = plan_of(df).split("== Initial Plan ==")[0]
    assert final.count("ArrowEvalPython") == 1 and "ReusedExchange" in final
