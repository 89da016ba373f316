"""Inputs for the operators, derived by Spark from every row of the test tables.

The tables hold no SQL scripts, so script-shaped text is put together from table columns. The checking
SQL can then state the expected fields from the same columns and needs no reading of text.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows by key over the session's shuffle partitions, at every size: they are small, but not what is made of each."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


# Four routines and up to three comments per part; {..} are SQL expressions over `part`.
SCRIPT = """\
-- part {p_partkey}: CREATE FUNCTION fake.line_{p_partkey}() RETURNS void
/* outer /* CREATE FUNCTION fake.block() RETURNS void */ it's '{p_name}' */
CREATE OR REPLACE FUNCTION s{p_size}.fn_{p_partkey}(_id integer, IN _label text DEFAULT 'a,b--{p_name}',
  _amt numeric(10,2) = ({p_size} + (1)), VARIADIC _tags text[] = array['x','y'])
RETURNS SETOF integer
LANGUAGE plpgsql {volatility} PARALLEL Safe COST {p_size} ROWS 1{p_size}
SET search_path = 'p, {p_name}' SET work_mem TO {p_type}
AS $t{p_size}$
  -- kept {p_name}
  SELECT '{p_brand}', $$inner$$; /* kept */
$t{p_size}$;

CREATE PROCEDURE proc_{p_partkey}(INOUT _n integer, OUT character varying) LANGUAGE sql Security Definer -- gone
AS 'SELECT ''{p_name}'' || {p_size}';

create function s{p_size}.fn_{p_partkey}(double precision)
returns table(id integer, price numeric(8,2), at timestamp with time zone) strict
BEGIN ATOMIC SELECT CASE WHEN $1 > {p_size} THEN ';' END; SELECT {p_partkey}; END;

CREATE FUNCTION ext_{p_partkey}(integer) RETURNS bigint LANGUAGE c;

COMMENT ON PROCEDURE s{p_size}.proc_{p_partkey}(integer, character varying) IS 'of another schema';
{comments}"""
FIRST_COMMENT = (
    "COMMENT ON FUNCTION s{p_size}.fn_{p_partkey}(_id integer, text, numeric(10,2), text[])"
    " IS 'It''s part {p_name}';\n"
)
SECOND_COMMENT = (
    "comment on function s{p_size}.fn_{p_partkey}(integer, text, numeric(10,2), VARIADIC text[])"
    " is 'now {p_brand}';\n"
)
VOLATILITY = "CASE WHEN p_size < 20 THEN 'IMMUTABLE' WHEN p_size < 35 THEN 'stable' ELSE 'Volatile' END"
HAS_FIRST = "p_type IN ('PROMO', 'LARGE', 'SMALL')"
HAS_SECOND = "p_type IN ('PROMO', 'ECONOMY')"


def _pieces(template: str) -> list[str]:
    """Text, name, text, name, ... of a template with {names}."""
    return template.replace("{", "\0").replace("}", "\0").split("\0")


def filled(template: str, **parts: str) -> str:
    """A template as SQL text; {names} are columns, or the expressions in `parts`."""
    terms = []
    for i, piece in enumerate(_pieces(template)):
        if i % 2:
            terms.append(f"CAST({parts.get(piece, piece)} AS VARCHAR)")
        elif piece:
            terms.append("'" + piece.replace("'", "''") + "'")
    return " || ".join(terms)


def filled_column(template: str, **parts: Column) -> Column:
    """The same as a column."""
    return F.concat(
        *[
            (parts[piece] if piece in parts else F.col(piece)).cast("string") if i % 2 else F.lit(piece)
            for i, piece in enumerate(_pieces(template))
        ]
    )


COMMENTS = (
    f"CASE WHEN {HAS_FIRST} THEN {filled(FIRST_COMMENT)} ELSE '' END"
    f" || CASE WHEN {HAS_SECOND} THEN {filled(SECOND_COMMENT)} ELSE '' END"
)


def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(script_id, text), one script of four routines per part."""
    comments = F.concat(
        F.when(F.expr(HAS_FIRST), filled_column(FIRST_COMMENT)).otherwise(""),
        F.when(F.expr(HAS_SECOND), filled_column(SECOND_COMMENT)).otherwise(""),
    )
    text = filled_column(SCRIPT, volatility=F.expr(VOLATILITY), comments=comments)
    parts = dealt(table(spark, sf_dir, "part"), "p_partkey")
    return parts.select(F.col("p_partkey").alias("script_id"), text.alias("text"))


DESIRED = """\
CREATE FUNCTION app.f_{p_partkey}(_id integer, _label character varying DEFAULT '{p_name}')
RETURNS SETOF text
LANGUAGE plpgsql Stable COST {p_size}
SET search_path TO 'app'
AS $body$
begin
  return query select '{p_brand}' || _label;  -- {p_name}
end;
$body$;
COMMENT ON FUNCTION app.f_{p_partkey}(integer, character varying) IS '{p_brand}';
"""


def desired_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = dealt(table(spark, sf_dir, "part"), "p_partkey")
    return parts.select(F.col("p_partkey").alias("script_id"), filled_column(DESIRED).alias("text"))


# What the deployed state has otherwise than the scripts, by properties of the part.
NOT_DEPLOYED = "p_type = 'PROMO'"
BODY_CHANGED = "p_size > 40"
COST_CHANGED = "p_size < 5"
COMMENT_GONE = "p_brand = 'Brand#7'"
TYPE_CHANGED = "p_brand = 'Brand#3'"


def actual_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat catalog rows: most parts, some of them changed, and the suppliers as extra routines."""
    parameters = (
        f"stack(2, 1, '_id', 'integer', 2, '_label',"
        f" CASE WHEN {TYPE_CHANGED} THEN 'text' ELSE 'character varying' END)"
        " AS (param_ord, param_name, param_type)"
    )
    deployed = (
        table(spark, sf_dir, "part")
        .where(f"NOT ({NOT_DEPLOYED})")
        .selectExpr("*", parameters)
        .selectExpr(
            "'app' AS schema",
            "'f_' || p_partkey AS name",
            "'function' AS type",
            "p_partkey + 16384 AS routine_oid",
            "param_ord",
            "param_name",
            "param_type",
            "'text' AS return_type",
            "true AS return_setof",
            f"""'BEGIN return query
                 select ' || char(39) || upper(p_brand) || char(39) || ' || _label; -- ' || p_name
                 || CASE WHEN {BODY_CHANGED} THEN ' !' ELSE '' END || ' end;' AS body""",
            "'plpgsql' AS language",
            "'s' AS volatility",
            "false AS strict",
            "false AS security_definer",
            "'u' AS parallel",
            "false AS leakproof",
            f"CAST(p_size + CASE WHEN {COST_CHANGED} THEN 1 ELSE 0 END AS DOUBLE) AS cost",
            "1000D AS rows",
            "array('search_path=app') AS config",
            f"CASE WHEN {COMMENT_GONE} THEN NULL ELSE p_brand END AS comment",
        )
    )
    extra = table(spark, sf_dir, "supplier").selectExpr(
        "'app' AS schema", "'extra_' || s_suppkey AS name", "'procedure' AS type",
        "s_suppkey + 1000000000 AS routine_oid", "CAST(NULL AS INT) AS param_ord",
        "CAST(NULL AS STRING) AS param_name", "CAST(NULL AS STRING) AS param_type",
        "'void' AS return_type", "false AS return_setof", "s_name AS body", "'sql' AS language",
        "'v' AS volatility", "false AS strict", "false AS security_definer", "'u' AS parallel",
        "false AS leakproof", "100D AS cost", "0D AS rows", "CAST(NULL AS ARRAY<STRING>) AS config",
        "CAST(NULL AS STRING) AS comment",
    )
    return deployed.unionByName(extra)


def system_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """System tables: part as routines, nation as schemas and types, region as languages."""
    arguments = "CASE WHEN p_size % 4 = 0 THEN array() ELSE sequence(1, p_size % 4) END"
    proc = table(spark, sf_dir, "part").selectExpr(
        "p_partkey + 100000 AS oid",
        "'fn_' || p_partkey AS proname",
        "CAST(p_partkey % 25 AS LONG) AS pronamespace",
        "CAST(p_size % 5 AS LONG) AS prolang",
        "CASE p_type WHEN 'PROMO' THEN 'p' WHEN 'LARGE' THEN 'a' ELSE 'f' END AS prokind",
        f"""CASE WHEN p_size % 7 > 0
            THEN transform({arguments}, i -> CASE WHEN i = 2 THEN '' ELSE 'a' || i END) END
            AS proargnames""",
        f"transform({arguments}, i -> CAST(1000 + (p_partkey + i) % 25 AS LONG)) AS proargtypes",
        "CAST(1000 + p_size % 25 AS LONG) AS prorettype",
        "p_size > 25 AS proretset",
        "p_name AS prosrc",
        "CASE WHEN p_size < 10 THEN 'i' WHEN p_size < 20 THEN 's' WHEN p_size < 45 THEN 'v' ELSE 'x' END AS provolatile",
        "p_brand = 'Brand#1' AS proisstrict",
        "p_brand = 'Brand#2' AS prosecdef",
        "CASE WHEN p_size < 10 THEN 's' WHEN p_size < 20 THEN 'r' ELSE 'u' END AS proparallel",
        "p_brand = 'Brand#3' AS proleakproof",
        "CAST(p_size AS FLOAT) AS procost",
        "CAST(p_size * 10 AS FLOAT) AS prorows",
        "CASE WHEN p_size > 30 THEN array('x=' || p_size, 'y=1') END AS proconfig",
    )
    nation = table(spark, sf_dir, "nation")
    return {
        "proc": proc,
        "namespace": nation.selectExpr("CAST(n_nationkey AS LONG) AS oid", "n_name AS nspname"),
        "language": table(spark, sf_dir, "region").selectExpr(
            "CAST(r_regionkey AS LONG) AS oid", "lower(r_name) AS lanname"
        ),
        "types": nation.selectExpr("CAST(1000 + n_nationkey AS LONG) AS oid", "lower(n_name) AS type_name"),
        "description": table(spark, sf_dir, "customer").selectExpr(
            "c_custkey + 100000 AS objoid", "c_mktsegment AS description"
        ),
    }


def toc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing lines from orders: a file per status, a routine name per customer.

    Lines come out of a generator, as they do when listing files are read.
    """
    line = """o_orderkey || CASE o_orderpriority
        WHEN '1-URGENT' THEN '; 1255 ' || o_orderkey || ' FUNCTION app fn_' || o_custkey || '(integer, text) owner'
        WHEN '5-LOW' THEN '; 1255 ' || o_orderkey || ' PROCEDURE app fn_' || o_custkey || '() owner'
        WHEN '2-HIGH' THEN '; 0 0 COMMENT app FUNCTION fn_' || o_custkey || '(_id integer, _t text) owner'
        WHEN '3-MEDIUM' THEN '; 0 0 ACL app PROCEDURE fn_' || o_custkey || '() owner'
        ELSE '; 1259 ' || o_orderkey || ' TABLE app t_' || o_custkey || ' owner' END"""
    return table(spark, sf_dir, "orders").selectExpr(
        "'dump_' || o_orderstatus AS file",
        f"inline(array(named_struct('pos', o_orderkey, 'line', {line})))",
    )


def settings_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three layers of one key space: part (lowest), customer, supplier (highest, some values empty)."""
    def layer(rank, name, key, value):
        return table(spark, sf_dir, name).selectExpr(
            f"{rank} AS layer_rank",
            f"'section_' || {key} % 10 AS section",
            f"'key_' || {key} AS key",
            f"{value} AS value",
        )

    return (
        layer(0, "part", "p_partkey", "p_name")
        .unionByName(layer(1, "customer", "c_custkey", "c_mktsegment"))
        .unionByName(
            layer(2, "supplier", "s_suppkey", "CASE WHEN s_acctbal < 2000 THEN '' ELSE s_name END")
        )
    )


# Names in quotes, dollar signs, lists of values, escapes, NULL comments, and one statement of each kind that can't be read.
ODD_SCRIPT = r'''Create Function "App ""{s_nationkey}"""."Fn.{s_name}" ( "A b" integer , out _o integer ) Language 'plpgsql'
  Set search_path = public , "N{s_nationkey}" Set work_mem To 'it''s' As E'line {s_suppkey}\nit''s' ;
COMMENT ON FUNCTION "App ""{s_nationkey}"""."Fn.{s_name}"(integer) IS 'first';
COMMENT ON FUNCTION "App ""{s_nationkey}"""."Fn.{s_name}"("A b" integer) IS {said};
create function h${s_suppkey}(int8) returns bigint returns null on null input language internal as 'lib{s_nationkey}', 'sym{s_nationkey}';
create function app.ret{s_suppkey}(_a text, out _b text) returns text leakproof cost 3 return 'a' || {s_suppkey};
comment on function app.ret{s_suppkey}(text) is $c$by inputs$c$;
create function (a integer) returns integer;
comment on function nobody is 'no list';
'''
ODD_SAID = "CASE WHEN s_acctbal < 0 THEN 'NULL' ELSE 'E''now ' || s_name || '''' END"


def odd_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s_suppkey, text), one script of three routines and two unreadable statements per supplier."""
    text = filled_column(ODD_SCRIPT, said=F.expr(ODD_SAID))
    return dealt(table(spark, sf_dir, "supplier"), "s_suppkey").select("s_suppkey", text.alias("text"))


# Comments and quotes where a blank would stand, and a routine created again with other comments.
CLOSE_SCRIPT = r"""CREATE FUNCTION/**/app.c1_{s_suppkey}(_a integer) RETURNS integer LANGUAGE sql AS $$ 1 $$;
CREATE/* {s_name} */FUNCTION app.c2_{s_suppkey}() RETURNS integer LANGUAGE sql AS $$ 2 $$;
CREATE FUNCTION"C3 {s_suppkey}"(text) RETURNS integer LANGUAGE sql AS $$ 3 $$;
CREATE OR/**/REPLACE--{s_name}
PROCEDURE"App"."C4 {s_nationkey}"(_n numeric(10,2)) LANGUAGE sql AS $$ 4 $$;
COMMENT ON/**/FUNCTION app.c1_{s_suppkey}(integer) IS 'first';
COMMENT ON FUNCTION/**/app.c2_{s_suppkey}()IS'of {s_name}';
COMMENT ON FUNCTION"C3 {s_suppkey}"(text) IS 'three';
COMMENT/**/ON/**/PROCEDURE"App"."C4 {s_nationkey}"(numeric(10,2)) IS 'four';
CREATE OR REPLACE FUNCTION app.c1_{s_suppkey}(_b integer) RETURNS integer LANGUAGE sql AS $$ 5 $$;
COMMENT ON FUNCTION app.c1_{s_suppkey}(_b integer)/* {s_nationkey} */IS 'again {s_nationkey}';
CREATE/**/FUNCTION/**/(integer) RETURNS integer;
COMMENT ON/**/FUNCTION nobody IS 'no list';
"""


def close_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s_suppkey, text), one script of five routines, five comments and two unreadable statements per supplier."""
    return dealt(table(spark, sf_dir, "supplier"), "s_suppkey").select("s_suppkey", filled_column(CLOSE_SCRIPT).alias("text"))


# Bodies alike but for the case of code, blanks and comments' case, and some also within a literal.
BODY = "{word} {p_brand}.\"Total {p_size}\"  FROM\tt -- {word}   \n WHERE x = '{said}  it''s' AND y = $q${said}$q$"
BODY_WORD = "CASE WHEN p_partkey % 2 = 0 THEN 'SELECT' ELSE 'select' END"
BODY_SAID = "CASE WHEN p_partkey % 3 = 0 THEN upper(p_type) ELSE lower(p_type) END"


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_partkey, body)."""
    body = filled_column(BODY, word=F.expr(BODY_WORD), said=F.expr(BODY_SAID))
    return table(spark, sf_dir, "part").select("p_partkey", body.alias("body"))


def two_catalogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat rows of two catalogs with equal oids, two parameters for each routine."""
    parts = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_size", "explode(array('a', 'b')) AS catalog")
    return parts.selectExpr(
        "*", "stack(2, 1, '_x', 'integer', 2, '_y', 'text') AS (param_ord, param_name, param_type)"
    ).selectExpr(
        "catalog", "'s' AS schema", "'fn_' || p_partkey || catalog AS name", "'function' AS type", "p_partkey AS routine_oid",
        "p_size", "CAST(param_ord AS INT) AS param_ord", "param_name", "param_type", "'integer' AS return_type",
        "false AS return_setof", "'b' AS body", "'sql' AS language", "'v' AS volatility", "false AS strict",
        "false AS security_definer", "'u' AS parallel", "false AS leakproof", "100.0D AS cost", "0.0D AS rows",
        "CAST(NULL AS ARRAY<STRING>) AS config", "CAST(NULL AS STRING) AS comment",
    )
