"""One query per operator, each over whole tables. Results are flat, so that values compare."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
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
from driftspark.operators import catalog, drift, jsondocs, routines, settings, toc
from driftspark.plans import connection_fields, connections, drift_report, effective_settings, shared_bodies
from driftspark.workload import inputs
from driftspark.workload.inputs import dealt, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    """Register under the operator's name; a trailing underscore only avoids an imported name."""
    QUERIES[fn.__name__.rstrip("_")] = fn
    return fn


def joined(items: Column, sep: str = "|") -> Column:
    return F.array_join(items, sep)


# Text functions


@query
def normalize_text_(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", normalize_text(F.col("text")).alias("normalized")
    )


@query
def fingerprint_(spark, sf):
    return table(spark, sf, "documents").select("doc_id", fingerprint(F.col("text")).alias("hash"))


@query
def duplicate_bodies(spark, sf):
    return drift.duplicate_bodies(table(spark, sf, "documents"), "doc_id", "text")


@query
def duplicate_bodies_by_literals(spark, sf):
    return drift.duplicate_bodies(inputs.bodies(spark, sf), "p_partkey", "body", literals=True)


@query
def mask_secret_(spark, sf):
    conn = F.expr(
        "'Host=h' || c_nationkey || ';PASSWORD = ' || c_name || ';Port=' || c_custkey || ';password=' || c_mktsegment"
    )
    return table(spark, sf, "customer").select("c_custkey", mask_secret(conn).alias("masked"))


@query
def parse_pg_array_(spark, sf):
    literal = F.expr(
        "CASE WHEN c_acctbal < 0 THEN '{}' ELSE '{' || c_name || ',seg=' || c_mktsegment || ',}' END"
    )
    elements = parse_pg_array(literal)
    return table(spark, sf, "customer").select(
        "c_custkey", joined(elements).alias("elements"), F.size(elements).alias("n")
    )


@query
def extract_version_(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", extract_version(F.col("text")).alias("version")
    )


@query
def is_newer_(spark, sf):
    current = F.expr("'v' || l_linenumber || '.' || l_suppkey || '.' || CAST(l_quantity AS INT) || '.7'")
    latest = F.expr("l_linenumber % 3 + 2 || '.' || l_orderkey % 40 || '.' || CAST(l_quantity AS INT) % 9")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", is_newer(current, latest).alias("newer")
    )


@query
def outdated(spark, sf):
    installed = table(spark, sf, "part").selectExpr(
        "'tool_' || p_partkey AS name", "p_size || '.' || p_partkey % 10 || '.3.0' AS installed"
    )
    latest = table(spark, sf, "customer").selectExpr(
        "'tool_' || c_custkey AS name", "'v' || (c_nationkey * 2) || '.' || c_custkey % 10 || '.3' AS latest"
    )
    return settings.outdated(installed, latest)


# Script text


@query
def strip_sql_comments_(spark, sf):
    return strip_sql_comments(inputs.scripts(spark, sf)).select("script_id", "stripped")


@query
def mask_bodies_(spark, sf):
    masked = mask_bodies(inputs.scripts(spark, sf))
    return masked.select("script_id", "masked", joined("bodies").alias("bodies"))


@query
def extract_routines(spark, sf):
    found = routines.extract_routines(inputs.scripts(spark, sf))
    return found.select(
        "script_id", "pos", "kind", "schema", "name", F.size("parameters").alias("n_parameters"),
        F.size("attributes").alias("n_attributes"), F.col("returns").isNotNull().alias("has_returns"),
        "atomic",
    )


@query
def extract_parameters(spark, sf):
    found = routines.extract_parameters(routines.extract_routines(inputs.scripts(spark, sf)))
    return found.select("script_id", "pos", "param_pos", "param_dir", "param_name", "param_type")


@query
def extract_returns(spark, sf):
    found = routines.extract_returns(routines.extract_routines(inputs.scripts(spark, sf)))
    return found.select(
        "script_id", "pos", "setof", "return_type", F.col("column.name").alias("column_name"),
        F.col("column.type").alias("column_type"),
    )


@query
def extract_attributes(spark, sf):
    found = routines.extract_attributes(routines.extract_routines(inputs.scripts(spark, sf)))
    return found.select("script_id", "pos", "attribute_pos", "attribute")


@query
def extract_bodies(spark, sf):
    found = routines.extract_bodies(routines.extract_routines(inputs.scripts(spark, sf)))
    return found.select("script_id", "pos", "body")


@query
def resolve_attributes(spark, sf):
    found = routines.resolve_attributes(routines.extract_routines(inputs.scripts(spark, sf)))
    return found.select(
        "script_id", "pos", "language", "volatility", "strict", "security_definer", "parallel",
        "leakproof", "cost", "rows", joined("config").alias("config"),
    )


@query
def extract_comments(spark, sf):
    found = routines.extract_comments(inputs.scripts(spark, sf))
    return found.select(
        "script_id", "pos", "kind", "schema", "name", joined("arg_types").alias("arg_types"), "comment"
    )


@query
def last_comment(spark, sf):
    said = routines.extract_comments(inputs.scripts(spark, sf))
    found = routines.last_comment(said, ["script_id"])
    return found.select("script_id", "kind", "name", joined("arg_types").alias("arg_types"), "comment")


@query
def attach_comments(spark, sf):
    texts = inputs.scripts(spark, sf)
    found = routines.attach_comments(
        routines.extract_routines(texts), routines.extract_comments(texts), ["script_id"]
    )
    return found.select("script_id", "pos", "name", "comment")


@query
def parse_routines(spark, sf):
    found = routines.parse_routines(inputs.scripts(spark, sf))
    return found.select(
        "script_id", "pos", "kind", "schema", "name", "comment",
        joined(F.transform("parameters", lambda p: p["type"])).alias("types"),
        joined("attributes").alias("attributes"), fingerprint(F.col("body")).alias("body_hash"),
    )


@query
def shared_bodies_(spark, sf):
    return shared_bodies(inputs.scripts(spark, sf))


# Catalog


def _flat_catalog(spark, sf, **options):
    return catalog.catalog_metadata(**inputs.system_tables(spark, sf), **options)


@query
def catalog_metadata(spark, sf):
    return _flat_catalog(spark, sf).withColumn("config", joined("config"))


@query
def select_schemas(spark, sf):
    chosen = table(spark, sf, "nation").where("n_regionkey = 2").select("n_name")
    flat = _flat_catalog(spark, sf, schemas=chosen, ordered=False)
    return flat.select("schema", "name", "param_ord", "param_type")


@query
def user_schemas(spark, sf):
    names = table(spark, sf, "part").selectExpr(
        "CASE p_type WHEN 'PROMO' THEN 'pg_' WHEN 'LARGE' THEN '_' WHEN 'SMALL' THEN 'pga' ELSE 'app_' END"
        " || p_partkey AS nspname"
    )
    return catalog.user_schemas(names)


@query
def decode_catalog_codes(spark, sf):
    decoded = catalog.decode_catalog_codes(_flat_catalog(spark, sf, ordered=False))
    return decoded.select(
        "routine_oid", "param_ord", "volatility", "parallel", F.col("returns.setof").alias("setof"),
        F.col("returns.type").alias("return_type"), F.size("config").alias("n_config"),
    )


@query
def fold_catalog_rows(spark, sf):
    folded = catalog.fold_catalog_rows(_flat_catalog(spark, sf, ordered=False))
    named = F.transform("parameters", lambda p: F.concat_ws(" ", p["ord"], p["name"], p["type"]))
    return folded.select(
        "routine_oid", "schema", "name", "kind", joined(named).alias("parameters"),
        F.col("returns.type").alias("return_type"), "body", "language", "volatility", "strict",
        "security_definer", "parallel", "leakproof", "cost", "rows", joined("config").alias("config"),
        "comment",
    )


# Drift


def _states(spark, sf):
    desired = drift.desired_state(routines.parse_routines(inputs.desired_scripts(spark, sf)))
    actual = drift.actual_state(catalog.fold_catalog_rows(inputs.actual_rows(spark, sf)))
    return desired, actual


@query
def match_routines(spark, sf):
    return drift.match_routines(*_states(spark, sf)).select("schema", "name", "signature", "match")


def _flat_report(report):
    return report.withColumn("changed_fields", joined("changed_fields"))


@query
def diff_routines(spark, sf):
    return _flat_report(drift.diff_routines(drift.match_routines(*_states(spark, sf))))


@query
def diff_comments(spark, sf):
    return drift.diff_comments(drift.match_routines(*_states(spark, sf)))


@query
def drift_report_(spark, sf):
    return _flat_report(
        drift_report(inputs.desired_scripts(spark, sf), inputs.actual_rows(spark, sf))
    )


# Archive listings


@query
def classify_toc(spark, sf):
    return toc.classify_toc(inputs.toc_lines(spark, sf)).select("file", "pos", "kind", "schema", "name")


@query
def group_toc(spark, sf):
    return toc.group_toc(inputs.toc_lines(spark, sf))


@query
def exclude_routine_toc(spark, sf):
    return toc.exclude_routine_toc(inputs.toc_lines(spark, sf))


@query
def clean_dump_lines(spark, sf):
    restored = F.expr(
        r"""'\\restrict ' || lang || '\nSET statement_timeout = 0;\n' || text
        || '\nSELECT pg_catalog.set_config(\'search_path\', \'\', false);\nALTER FUNCTION s.f(integer) OWNER TO '
        || source || ';\nALTER TABLE t OWNER TO ' || source || ';\n\\unrestrict ' || lang"""
    )
    texts = table(spark, sf, "documents").select("doc_id", restored.alias("text"))
    return toc.clean_dump_lines(texts)


# Settings


@query
def parse_kv(spark, sf):
    conn = """'Host=' || c_name || '; Port = ' || c_nationkey || ';bad;=x;Password=a=' || c_mktsegment
        || CASE WHEN c_acctbal < 2000 THEN ';Host=last_' || c_custkey ELSE '' END"""
    conns = table(spark, sf, "customer").selectExpr("c_custkey", f"{conn} AS conn")
    return settings.parse_kv(conns, "conn")


def _templates(spark, sf):
    return table(spark, sf, "customer").selectExpr(
        "c_custkey",
        "'Host={NATION_' || c_nationkey || '}.{' || c_mktsegment || '};User={NATION_0}{};Port={' AS conn",
    )


def _dictionary(spark, sf):
    return table(spark, sf, "nation").selectExpr("n_name AS key", "'region' || n_regionkey AS value")


@query
def resolve_placeholders(spark, sf):
    resolved = settings.resolve_placeholders(_templates(spark, sf), _dictionary(spark, sf), "conn")
    return resolved.withColumn("unresolved", joined("unresolved"))


@query
def connection_fields_(spark, sf):
    return connection_fields(_templates(spark, sf), _dictionary(spark, sf))


@query
def layered_merge(spark, sf):
    return settings.layered_merge(inputs.settings_layers(spark, sf))


@query
def effective_settings_(spark, sf):
    layers = inputs.settings_layers(spark, sf).withColumn("value", F.expr("value || ' in {' || section || '}'"))
    words = table(spark, sf, "events").selectExpr(
        "CAST(event_id AS INT) AS layer_rank", "'section_' || user_id % 12 AS key", "event_type AS value"
    )
    resolved = effective_settings(layers, words)
    return resolved.withColumn("unresolved", joined("unresolved"))


@query
def missing_keys(spark, sf):
    expected = table(spark, sf, "documents").selectExpr("source AS section", "'doc_' || doc_id AS key", "lang AS raw")
    existing = table(spark, sf, "labels").selectExpr("'doc_' || doc_id AS key")
    return settings.missing_keys(expected, existing, ("key",))


@query
def first_seen(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_id", "event_type", "value")
    return settings.first_seen(events, ["user_id"], "event_id")


@query
def extract_file_refs(spark, sf):
    commands = table(spark, sf, "orders").selectExpr(
        "o_orderkey",
        """' serve ./base_' || o_custkey || '.json ' || CASE o_orderstatus WHEN 'F' THEN '--optional'
            WHEN 'O' THEN '--verbose' ELSE 'word' END
            || '  ./mid_' || o_orderkey || '.json  x --optional y ./last.json --log.json' AS command""",
    )
    return settings.extract_file_refs(commands, "command")


# JSON documents


def _jsonc(spark, sf):
    return dealt(table(spark, sf, "events"), "event_id").selectExpr(
        "event_id",
        r"""'// event ' || event_id || '\n\n  // ' || event_type || '\n{ // open\n  "url": "http://x/*' || user_id
        || '*/", /* "k": 0, */ "props": ' || props || ' }\n// end' AS text""",
    )


@query
def read_jsonc(spark, sf):
    docs = jsondocs.split_jsonc(_jsonc(spark, sf))
    return docs.select(
        "event_id", "header",
        F.try_variant_get("data", "$.url", "string").alias("url"),
        F.try_variant_get("data", "$.props.k", "int").alias("k"),
    )


@query
def checked_jsonc(spark, sf):
    docs = dealt(table(spark, sf, "events"), "event_id").selectExpr(
        "event_id",
        r"""'// head\n{"k": 0, "props": ' || props || ', "n": [{"u": "//", "u": ' || user_id || '}], /* k */"k": "' || event_type || '"'
        || CASE WHEN value > 50 THEN '}' WHEN value > 30 THEN '} x' ELSE '' END AS text""",
    )
    return jsondocs.checked_jsonc(docs).select(
        "event_id", "valid", "error_at",
        F.try_variant_get("data", "$.k", "string").alias("k"),
        F.try_variant_get("data", "$.n[0].u", "string").alias("u"),
    )


def _schema_docs(spark, sf):
    return dealt(table(spark, sf, "events"), "event_id").selectExpr(
        "event_id",
        """parse_json('{"type": "object", "properties": {'
        || '"k": {"type": "integer", "description": "' || event_type || '", "default": ' || get_json_object(props, '$.k') || '},'
        || '"u' || user_id || '": {"type": ["object", "null"], "properties": {'
        || '"on": {"type": ["boolean", "null"], "default": ' || CASE WHEN value > 50 THEN 'true' ELSE 'false' END || '},'
        || '"tags": {"type": "array", "items": {"type": "' || CASE WHEN value > 20 THEN 'object' ELSE 'string' END || '"}},'
        || '"deep": {"type": "object", "properties": {"leaf": {"enum": ["' || event_type || '"]}}},'
        || '"map": {"type": "object", "additionalProperties": true}}}}}') AS doc""",
    )


@query
def flatten_json(spark, sf):
    return jsondocs.flatten_json(_schema_docs(spark, sf), "doc")


@query
def classify_json_property(spark, sf):
    docs = _schema_docs(spark, sf)
    nodes = docs.select(
        "event_id",
        F.explode(F.map_entries(F.try_variant_get("doc", "$.properties", "map<string,variant>"))).alias("e"),
    ).select("event_id", F.col("e.key").alias("name"), F.col("e.value").alias("node"))
    return jsondocs.classify_json_property(nodes, "node").drop("node")


# What other templates hold


@query
def quoted_routines(spark, sf):
    parsed = routines.parse_routines(inputs.odd_scripts(spark, sf))
    read = routines.resolve_attributes(parsed)
    outputs = F.filter("parameters", lambda p: p["dir"] == "out")
    returned = F.coalesce(F.col("returns.type"), F.get(outputs, F.lit(0))["type"])
    return read.select(
        "s_suppkey", "pos", "kind", "schema", "name", "language", joined(F.col("config")).alias("config"), "cost",
        returned.alias("return_type"), "body", "atomic", "comment",
    )


@query
def rejects(spark, sf):
    return routines.rejects(inputs.odd_scripts(spark, sf)).select("s_suppkey", "verb", "pos", "reason")


@query
def close_routines(spark, sf):
    parsed = routines.parse_routines(inputs.close_scripts(spark, sf))
    return parsed.select("s_suppkey", "pos", "kind", "schema", "name", "body", "comment")


@query
def statement_census(spark, sf):
    scripts = inputs.close_scripts(spark, sf)
    census = (
        routines.extract_routines(scripts).select("s_suppkey", F.lit("routine").alias("is"))
        .unionByName(routines.extract_comments(scripts).select("s_suppkey", F.lit("comment").alias("is")))
        .unionByName(routines.rejects(scripts).select("s_suppkey", F.concat(F.lit("rejected "), "verb").alias("is")))
    )
    return census.groupBy("s_suppkey", "is").agg(F.count(F.lit(1)).alias("n"))


@query
def fold_two_catalogs(spark, sf):
    folded = catalog.fold_catalog_rows(inputs.two_catalogs(spark, sf).drop("p_size"), by=("catalog",))
    return folded.select("routine_oid", "catalog", "name", F.size("parameters").alias("n_parameters"))


@query
def unfoldable_rows(spark, sf):
    rows = inputs.two_catalogs(spark, sf)
    rows = rows.withColumn("routine_oid", F.expr("CASE WHEN p_size >= 10 THEN routine_oid END")).drop("p_size")
    return catalog.unfoldable_rows(rows).groupBy("routine_oid", "catalog", "reason").agg(F.count(F.lit(1)).alias("n"))


@query
def env_entries(spark, sf):
    newline, quote = F.lit("\n"), F.lit('"')
    lines = F.concat(
        F.lit("# NAME=no\nNAME=first\n\n NAME = "), quote, F.col("c_name"), quote, F.lit(" \r\n"),
        F.lit("SEGMENT='a="), F.col("c_mktsegment"), F.lit(" b'"), newline, F.lit("=x\nword\nEMPTY="),
    )
    return settings.env_entries(table(spark, sf, "customer").select("c_custkey", lines.alias("text")))


@query
def write_kv(spark, sf):
    pairs = F.expr(
        "map('zeta', '1', 'Port', CAST(c_custkey AS STRING), 'none', CAST(NULL AS STRING), 'alpha', c_mktsegment,"
        " 'host', 'h' || c_nationkey, 'empty', '')"
    )
    return table(spark, sf, "customer").select("c_custkey", settings.write_kv(pairs, ["Host", "Port"]).alias("conn"))


@query
def connection_defaults(spark, sf):
    conn = F.expr("CASE WHEN c_acctbal < 0 THEN '' ELSE 'Host=h' || c_nationkey || ';' END || 'Database=' || c_mktsegment")
    return connections(table(spark, sf, "customer").select("c_custkey", conn.alias("conn")), "conn")
