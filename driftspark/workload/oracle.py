"""The SQL that checks each query, stated over the table columns the inputs were made from."""

from driftspark.workload.inputs import (
    BODY_CHANGED,
    COMMENT_GONE,
    COMMENTS,
    COST_CHANGED,
    HAS_FIRST,
    HAS_SECOND,
    NOT_DEPLOYED,
    SCRIPT,
    TYPE_CHANGED,
    VOLATILITY,
    filled,
)


def sql_text(template: str) -> str:
    return filled(template, volatility=VOLATILITY, comments=f"({COMMENTS})")


# The script without its three comments, and with its dollar body emptied.
STRIPPED = (
    SCRIPT.replace("-- part {p_partkey}: CREATE FUNCTION fake.line_{p_partkey}() RETURNS void", "")
    .replace("/* outer /* CREATE FUNCTION fake.block() RETURNS void */ it's '{p_name}' */", "")
    .replace("-- gone", "")
)
BODY = "\n  -- kept {p_name}\n  SELECT '{p_brand}', $$inner$$; /* kept */\n"
MASKED = STRIPPED.replace(BODY, "")
BODIES = {
    0: filled(BODY),
    1: filled("SELECT '{p_name}' || {p_size}"),
    2: filled(" SELECT CASE WHEN $1 > {p_size} THEN ';' END; SELECT {p_partkey}; "),
}


def squeezed(text: str) -> str:
    return (
        rf"trim(regexp_replace(regexp_replace(lower({text}), '[^\x20-\x7e]', ' ', 'g'), '\s+', ' ', 'g'))"
    )


ROUTINES = f"""
    SELECT p_partkey AS script_id, pos, part.*,
        CASE WHEN pos = 1 THEN 'procedure' ELSE 'function' END AS kind,
        CASE WHEN pos IN (0, 2) THEN 's' || p_size END AS schema,
        CASE pos WHEN 1 THEN 'proc_' WHEN 3 THEN 'ext_' ELSE 'fn_' END || p_partkey AS name,
        CASE pos WHEN 0 THEN {BODIES[0]} WHEN 1 THEN {BODIES[1]} WHEN 2 THEN {BODIES[2]} END AS body,
        CASE WHEN pos = 0 AND {HAS_SECOND} THEN 'now ' || p_brand
             WHEN pos = 0 AND {HAS_FIRST} THEN 'It''s part ' || p_name END AS comment
    FROM part, (VALUES (0), (1), (2), (3)) AS r(pos)"""

ATTRIBUTES = f"""(VALUES
    (0, 0, 'LANGUAGE plpgsql'), (0, 1, NULL), (0, 2, 'PARALLEL Safe'), (0, 3, 'COST '), (0, 4, 'ROWS 1'),
    (0, 5, 'SET search_path = ''p, '), (0, 6, 'SET work_mem TO '),
    (1, 0, 'LANGUAGE sql'), (1, 1, 'Security Definer'), (2, 0, 'strict'), (3, 0, 'LANGUAGE c')
    ) AS a(pos, attribute_pos, stem)"""
ATTRIBUTE = f"""CASE WHEN pos > 0 THEN stem ELSE CASE attribute_pos
    WHEN 1 THEN {VOLATILITY} WHEN 3 THEN stem || p_size WHEN 4 THEN stem || p_size
    WHEN 5 THEN stem || p_name || '''' WHEN 6 THEN stem || p_type ELSE stem END END"""

SAID = f"""
    SELECT p_partkey AS script_id, 0 AS pos, 'procedure' AS kind, 's' || p_size AS schema,
        'proc_' || p_partkey AS name, 'integer|character varying' AS arg_types,
        'of another schema' AS comment FROM part
    UNION ALL SELECT p_partkey, 1, 'function', 's' || p_size, 'fn_' || p_partkey,
        'integer|text|numeric(10,2)|text[]', 'It''s part ' || p_name FROM part WHERE {HAS_FIRST}
    UNION ALL SELECT p_partkey, CASE WHEN {HAS_FIRST} THEN 2 ELSE 1 END, 'function', 's' || p_size,
        'fn_' || p_partkey, 'integer|text|numeric(10,2)|text[]', 'now ' || p_brand FROM part WHERE {HAS_SECOND}"""

# System tables as made by inputs.system_tables, one row per routine and argument.
FLAT = """
    SELECT n.n_name AS schema, 'fn_' || p_partkey AS name,
        CASE p_type WHEN 'PROMO' THEN 'procedure' WHEN 'LARGE' THEN NULL ELSE 'function' END AS type,
        p_partkey + 100000 AS routine_oid, CAST(o.ord AS INTEGER) AS param_ord,
        CASE WHEN p_size % 7 > 0 AND o.ord <> 2 THEN 'a' || o.ord END AS param_name,
        lower(t.n_name) AS param_type, lower(rt.n_name) AS return_type, p_size > 25 AS return_setof,
        p_name AS body, lower(r_name) AS language,
        CASE WHEN p_size < 10 THEN 'i' WHEN p_size < 20 THEN 's' WHEN p_size < 45 THEN 'v' ELSE 'x' END AS volatility,
        p_brand = 'Brand#1' AS strict, p_brand = 'Brand#2' AS security_definer,
        CASE WHEN p_size < 10 THEN 's' WHEN p_size < 20 THEN 'r' ELSE 'u' END AS parallel,
        p_brand = 'Brand#3' AS leakproof, CAST(p_size AS DOUBLE) AS cost, CAST(p_size * 10 AS DOUBLE) AS rows,
        CASE WHEN p_size > 30 THEN 'x=' || p_size || '|y=1' END AS config, c_mktsegment AS comment
    FROM part
    JOIN nation n ON n.n_nationkey = p_partkey % 25
    JOIN region ON r_regionkey = p_size % 5
    LEFT JOIN nation rt ON rt.n_nationkey = p_size % 25
    LEFT JOIN customer ON c_custkey = p_partkey
    LEFT JOIN (VALUES (1), (2), (3)) AS o(ord) ON o.ord <= p_size % 4
    LEFT JOIN nation t ON t.n_nationkey = (p_partkey + o.ord) % 25"""

PAIRED = f"""
    SELECT 'app' AS schema, 'f_' || p_partkey AS name, 'integer,character varying' AS signature,
        CASE WHEN {NOT_DEPLOYED} THEN 'missing' WHEN {TYPE_CHANGED} THEN 'name' ELSE 'signature' END AS match,
        concat_ws('|', CASE WHEN {TYPE_CHANGED} THEN 'parameters' END, CASE WHEN {BODY_CHANGED} THEN 'body' END,
            CASE WHEN {COST_CHANGED} THEN 'cost' END) AS changes, p_brand
    FROM part"""
EXTRA = """SELECT 'app' AS schema, 'extra_' || s_suppkey AS name, '' AS signature FROM supplier"""
REPORT = f"""
    SELECT 'function' AS kind, schema, name, signature,
        CASE WHEN match = 'missing' THEN match WHEN changes = '' THEN 'same' ELSE 'changed' END AS status,
        CASE WHEN match = 'missing' THEN '' ELSE changes END AS changed_fields,
        CASE WHEN match <> 'missing' THEN {COMMENT_GONE} END AS comment_changed,
        CASE WHEN match <> 'missing' THEN false END AS body_unverified
    FROM ({PAIRED})
    UNION ALL SELECT 'procedure', schema, name, signature, 'extra', '', NULL, NULL FROM ({EXTRA})"""

TOC = """
    SELECT 'dump_' || o_orderstatus AS file, o_orderkey AS pos, 'fn_' || o_custkey AS fn,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'routine' WHEN '5-LOW' THEN 'routine'
            WHEN '2-HIGH' THEN 'comment' WHEN '3-MEDIUM' THEN 'acl' END AS kind,
        o_orderkey || CASE o_orderpriority
            WHEN '1-URGENT' THEN '; 1255 ' || o_orderkey || ' FUNCTION app fn_' || o_custkey || '(integer, text) owner'
            WHEN '5-LOW' THEN '; 1255 ' || o_orderkey || ' PROCEDURE app fn_' || o_custkey || '() owner'
            WHEN '2-HIGH' THEN '; 0 0 COMMENT app FUNCTION fn_' || o_custkey || '(_id integer, _t text) owner'
            WHEN '3-MEDIUM' THEN '; 0 0 ACL app PROCEDURE fn_' || o_custkey || '() owner'
            ELSE '; 1259 ' || o_orderkey || ' TABLE app t_' || o_custkey || ' owner' END AS line
    FROM orders"""

CURRENT = "(l_linenumber, l_suppkey, CAST(l_quantity AS INTEGER))"
LATEST = "(l_linenumber % 3 + 2, l_orderkey % 40, CAST(l_quantity AS INTEGER) % 9)"

MERGED = """
    SELECT 'section_' || k % 10 AS section, 'key_' || k AS key,
        CASE WHEN s_suppkey IS NOT NULL THEN CASE WHEN s_acctbal < 2000 THEN '' ELSE s_name END
            ELSE coalesce(c_mktsegment, p_name) END AS value,
        CASE WHEN s_suppkey IS NOT NULL THEN 2 WHEN c_custkey IS NOT NULL THEN 1 ELSE 0 END AS layer_rank
    FROM (SELECT p_partkey AS k FROM part UNION SELECT c_custkey FROM customer UNION SELECT s_suppkey FROM supplier)
    LEFT JOIN part ON p_partkey = k LEFT JOIN customer ON c_custkey = k LEFT JOIN supplier ON s_suppkey = k"""

ORACLE = {
    "normalize_text": f"SELECT doc_id, {squeezed('text')} AS normalized FROM documents",
    "fingerprint": f"SELECT doc_id, sha256({squeezed('text')}) AS hash FROM documents",
    "duplicate_bodies": f"""
        SELECT sha256({squeezed('text')}) AS fingerprint, count(*) AS copies, min(doc_id) AS first_key
        FROM documents GROUP BY 1 HAVING count(*) > 1""",
    "mask_secret": """
        SELECT c_custkey, 'Host=h' || c_nationkey || ';PASSWORD = ****;Port=' || c_custkey
            || ';password=' || c_mktsegment AS masked FROM customer""",
    "parse_pg_array": """
        SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '' ELSE c_name || '|seg=' || c_mktsegment || '|' END AS elements,
            CASE WHEN c_acctbal < 0 THEN 0 ELSE 3 END AS n FROM customer""",
    "extract_version": r"""
        SELECT doc_id, coalesce(nullif(regexp_extract(text, '\d+(?:\.\d+)+'), ''), 'unknown output') AS version
        FROM documents""",
    "is_newer": f"""
        SELECT l_orderkey, l_linenumber, l_partkey, {CURRENT} < {LATEST} AS newer FROM lineitem""",
    "outdated": """
        SELECT 'tool_' || p_partkey AS name, p_size || '.' || p_partkey % 10 || '.3.0' AS installed,
            'v' || (c_nationkey * 2) || '.' || c_custkey % 10 || '.3' AS latest,
            CASE WHEN p_size = c_nationkey * 2 THEN 'latest' WHEN p_size < c_nationkey * 2 THEN 'update' END AS status
        FROM part LEFT JOIN customer ON c_custkey = p_partkey""",
    "strip_sql_comments": f"SELECT p_partkey AS script_id, {sql_text(STRIPPED)} AS stripped FROM part",
    "mask_bodies": f"""
        SELECT p_partkey AS script_id, {sql_text(MASKED)} AS masked, {BODIES[0]} AS bodies FROM part""",
    "extract_routines": f"""
        SELECT script_id, pos, kind, schema, name, CASE pos WHEN 0 THEN 4 WHEN 1 THEN 2 ELSE 1 END AS n_parameters,
            CASE pos WHEN 0 THEN 7 WHEN 1 THEN 2 ELSE 1 END AS n_attributes, pos <> 1 AS has_returns, pos = 2 AS atomic
        FROM ({ROUTINES})""",
    "extract_parameters": f"""
        SELECT script_id, pos, param_pos, param_dir, param_name, param_type FROM ({ROUTINES}) JOIN (VALUES
            (0, 1, NULL, '_id', 'integer'), (0, 2, 'in', '_label', 'text'), (0, 3, NULL, '_amt', 'numeric(10,2)'),
            (0, 4, 'variadic', '_tags', 'text[]'), (1, 1, 'inout', '_n', 'integer'),
            (1, 2, 'out', NULL, 'character varying'), (2, 1, NULL, NULL, 'double precision'),
            (3, 1, NULL, NULL, 'integer')) AS v(pos, param_pos, param_dir, param_name, param_type) USING (pos)""",
    "extract_returns": f"""
        SELECT script_id, pos, setof, return_type, column_name, column_type FROM ({ROUTINES}) JOIN (VALUES
            (0, true, 'integer', NULL, NULL), (2, false, NULL, 'id', 'integer'), (2, false, NULL, 'price', 'numeric(8,2)'),
            (2, false, NULL, 'at', 'timestamp with time zone'), (3, false, 'bigint', NULL, NULL)
            ) AS v(pos, setof, return_type, column_name, column_type) USING (pos)""",
    "extract_attributes": f"""
        SELECT script_id, pos, attribute_pos, {ATTRIBUTE} AS attribute FROM ({ROUTINES}) JOIN {ATTRIBUTES} USING (pos)""",
    "extract_bodies": f"SELECT script_id, pos, body FROM ({ROUTINES}) WHERE body IS NOT NULL",
    "resolve_attributes": f"""
        SELECT script_id, pos, CASE pos WHEN 0 THEN 'plpgsql' WHEN 3 THEN 'c' ELSE 'sql' END AS language,
            CASE WHEN pos = 0 THEN lower({VOLATILITY}) ELSE 'volatile' END AS volatility, pos = 2 AS strict,
            pos = 1 AS security_definer, CASE WHEN pos = 0 THEN 'safe' ELSE 'unsafe' END AS parallel,
            false AS leakproof, CAST(CASE WHEN pos = 0 THEN p_size WHEN pos = 3 THEN 1 ELSE 100 END AS DOUBLE) AS cost,
            CAST(CASE pos WHEN 0 THEN CAST('1' || p_size AS INTEGER) WHEN 2 THEN 1000 ELSE 0 END AS DOUBLE) AS rows,
            CASE WHEN pos = 0 THEN 'search_path=p, ' || p_name || '|work_mem=' || p_type ELSE '' END AS config
        FROM ({ROUTINES})""",
    "extract_comments": SAID,
    "last_comment": f"""
        SELECT script_id, kind, name, arg_types, arg_max(comment, pos) AS comment FROM ({SAID}) GROUP BY 1, 2, 3, 4""",
    "attach_comments": f"SELECT script_id, pos, name, comment FROM ({ROUTINES})",
    "parse_routines": f"""
        SELECT script_id, pos, kind, schema, name, comment,
            CASE pos WHEN 0 THEN 'integer|text|numeric(10,2)|text[]' WHEN 1 THEN 'integer|character varying'
                WHEN 2 THEN 'double precision' ELSE 'integer' END AS types,
            (SELECT string_agg({ATTRIBUTE.replace('pos > 0', 'a.pos > 0')}, '|' ORDER BY attribute_pos)
                FROM {ATTRIBUTES} WHERE a.pos = q.pos) AS attributes,
            sha256({squeezed('body')}) AS body_hash
        FROM ({ROUTINES}) AS q""",
    "shared_bodies": f"""
        SELECT sha256({squeezed('body')}) AS fingerprint, count(*) AS copies,
            min(concat_ws('.', schema, name)) AS first_key
        FROM ({ROUTINES}) WHERE body IS NOT NULL GROUP BY 1 HAVING count(*) > 1""",
    "catalog_metadata": FLAT + " ORDER BY schema, name, routine_oid, param_ord",
    "select_schemas": f"""
        SELECT schema, name, param_ord, param_type FROM ({FLAT})
        WHERE schema IN (SELECT n_name FROM nation WHERE n_regionkey = 2)""",
    "user_schemas": """
        SELECT nspname FROM (SELECT CASE p_type WHEN 'PROMO' THEN 'pg_' WHEN 'LARGE' THEN '_' WHEN 'SMALL' THEN 'pga'
            ELSE 'app_' END || p_partkey AS nspname FROM part)
        WHERE nspname NOT LIKE 'pg_%' AND left(nspname, 1) <> '_' AND nspname <> 'information_schema'
        ORDER BY nspname""",
    "decode_catalog_codes": f"""
        SELECT routine_oid, param_ord,
            CASE volatility WHEN 'i' THEN 'immutable' WHEN 's' THEN 'stable' ELSE 'volatile' END AS volatility,
            CASE parallel WHEN 's' THEN 'safe' WHEN 'r' THEN 'restricted' ELSE 'unsafe' END AS parallel,
            CASE WHEN type IS DISTINCT FROM 'procedure' THEN return_setof END AS setof,
            CASE WHEN type IS DISTINCT FROM 'procedure' THEN return_type END AS return_type,
            CASE WHEN config IS NULL THEN 0 ELSE 2 END AS n_config
        FROM ({FLAT})""",
    "fold_catalog_rows": f"""
        SELECT routine_oid, schema, name, type AS kind,
            coalesce(string_agg(CASE WHEN param_ord IS NOT NULL THEN concat_ws(' ', param_ord, param_name, param_type) END,
                '|' ORDER BY param_ord), '') AS parameters,
            CASE WHEN type IS DISTINCT FROM 'procedure' THEN return_type END AS return_type, body, language,
            CASE volatility WHEN 'i' THEN 'immutable' WHEN 's' THEN 'stable' ELSE 'volatile' END AS volatility,
            strict, security_definer,
            CASE parallel WHEN 's' THEN 'safe' WHEN 'r' THEN 'restricted' ELSE 'unsafe' END AS parallel,
            leakproof, cost, rows, coalesce(config, '') AS config, comment
        FROM ({FLAT}) GROUP BY ALL""",
    "match_routines": f"""
        SELECT schema, name, signature, match FROM ({PAIRED})
        UNION ALL SELECT schema, name, signature, 'extra' FROM ({EXTRA})""",
    "diff_routines": REPORT,
    "drift_report": REPORT,
    "diff_comments": f"""
        SELECT schema, name, signature, p_brand AS desired_comment, CAST(NULL AS VARCHAR) AS actual_comment
        FROM ({PAIRED}) WHERE match <> 'missing' AND {COMMENT_GONE}""",
    "classify_toc": f"""
        SELECT file, pos, kind, CASE WHEN kind IS NOT NULL THEN 'app' END AS schema,
            CASE WHEN kind IS NOT NULL THEN fn END AS name FROM ({TOC})""",
    "group_toc": f"""
        SELECT file, fn AS name, first_pos, pos, kind, line FROM (
            SELECT *, min(pos) FILTER (kind = 'routine') OVER (PARTITION BY file, fn) AS first_pos
            FROM ({TOC}) WHERE kind IS NOT NULL)
        WHERE pos >= first_pos""",
    "exclude_routine_toc": f"SELECT file, pos, line FROM ({TOC}) WHERE kind IS NULL",
    "clean_dump_lines": r"""
        SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda l: NOT regexp_matches(l, '^SET\s+\w')),
            chr(10)) || chr(10) || 'ALTER TABLE t OWNER TO ' || source || ';' AS text FROM documents""",
    "parse_kv": """
        SELECT c_custkey, 0 AS pos, 'Host' AS key,
            CASE WHEN c_acctbal < 2000 THEN 'last_' || c_custkey ELSE c_name END AS value FROM customer
        UNION ALL SELECT c_custkey, 1, 'Port', CAST(c_nationkey AS VARCHAR) FROM customer
        UNION ALL SELECT c_custkey, 2, 'Password', 'a=' || c_mktsegment FROM customer""",
    "resolve_placeholders": """
        SELECT c_custkey, 'Host=region' || n_regionkey || '.{' || c_mktsegment || '};User=region'
            || (SELECT n_regionkey FROM nation WHERE n_nationkey = 0) || '{};Port={' AS resolved,
            c_mktsegment AS unresolved FROM customer JOIN nation ON n_nationkey = c_nationkey""",
    "connection_fields": """
        SELECT c_custkey, 0 AS pos, 'Host' AS key, 'region' || n_regionkey || '.{' || c_mktsegment || '}' AS value
        FROM customer JOIN nation ON n_nationkey = c_nationkey
        UNION ALL SELECT c_custkey, 1, 'User', 'region' || (SELECT n_regionkey FROM nation WHERE n_nationkey = 0) || '{}'
        FROM customer
        UNION ALL SELECT c_custkey, 2, 'Port', '{' FROM customer""",
    "layered_merge": MERGED,
    "effective_settings": f"""
        SELECT section, m.key, value || ' in ' || coalesce(word, '{{' || section || '}}') AS resolved,
            CASE WHEN word IS NULL THEN section ELSE '' END AS unresolved
        FROM ({MERGED}) AS m LEFT JOIN (
            SELECT 'section_' || user_id % 12 AS key, arg_max(event_type, event_id) AS word FROM events GROUP BY 1
        ) AS w ON w.key = section""",
    "missing_keys": """
        SELECT source AS section, 'doc_' || doc_id AS key, lang AS raw FROM documents d
        WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = d.doc_id)""",
    "first_seen": """
        SELECT user_id, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type,
            arg_min(value, event_id) AS value FROM events GROUP BY user_id""",
    "extract_file_refs": """
        SELECT o_orderkey, 0 AS pos, './base_' || o_custkey || '.json' AS path, false AS optional FROM orders
        UNION ALL SELECT o_orderkey, 1, './mid_' || o_orderkey || '.json', o_orderstatus = 'F' FROM orders
        UNION ALL SELECT o_orderkey, 2, './last.json', true FROM orders""",
    "read_jsonc": """
        SELECT event_id, '// event ' || event_id || chr(10) || chr(10) || '  // ' || event_type || chr(10) AS header,
            'http://x/*' || user_id || '*/' AS url, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events""",
    "checked_jsonc": """
        WITH docs AS (
            SELECT event_id, event_type, user_id, value > 50 AS valid, value > 30 AS longer, length('{"k": 0, "props": ' || props
                || ', "n": [{"u": "//", "u": ' || user_id || '}], "k": "' || event_type || '"') AS size FROM events)
        SELECT event_id, valid, CASE WHEN valid THEN NULL WHEN longer THEN size + 2 ELSE size END AS error_at,
            CASE WHEN valid THEN event_type END AS k, CASE WHEN valid THEN CAST(user_id AS VARCHAR) END AS u FROM docs""",
    "flatten_json": """
        SELECT event_id, 'k' AS path, event_type AS description, CAST(json_extract(props, '$.k') AS VARCHAR) AS "default",
            'number' AS class, false AS nullable FROM events
        UNION ALL SELECT event_id, 'u' || user_id, NULL, NULL, 'object', true FROM events
        UNION ALL SELECT event_id, 'u' || user_id || '.on', NULL, CASE WHEN value > 50 THEN 'true' ELSE 'false' END, 'boolean', true
            FROM events
        UNION ALL SELECT event_id, 'u' || user_id || '.tags', NULL, NULL,
            CASE WHEN value > 20 THEN 'array-object' ELSE 'array-scalar' END, false FROM events
        UNION ALL SELECT event_id, 'u' || user_id || '.deep', NULL, NULL, 'object', false FROM events
        UNION ALL SELECT event_id, 'u' || user_id || '.deep.leaf', NULL, NULL, 'enum', false FROM events
        UNION ALL SELECT event_id, 'u' || user_id || '.map', NULL, NULL, 'dictionary', false FROM events""",
    "classify_json_property": """
        SELECT event_id, 'k' AS name, 'number' AS class, false AS nullable FROM events
        UNION ALL SELECT event_id, 'u' || user_id, 'object', true FROM events""",
    "quoted_routines": """
        SELECT s_suppkey, 0 AS pos, 'function' AS kind, 'App "' || s_nationkey || '"' AS schema, 'Fn.' || s_name AS name,
            'plpgsql' AS language, 'search_path=public, "N' || s_nationkey || '"|work_mem=it''s' AS config, 100.0 AS cost,
            'integer' AS return_type, 'line ' || s_suppkey || chr(10) || 'it''s' AS body, false AS atomic,
            CASE WHEN s_acctbal < 0 THEN NULL ELSE 'now ' || s_name END AS comment FROM supplier
        UNION ALL SELECT s_suppkey, 1, 'function', NULL, 'h$' || s_suppkey, 'internal', '', 1.0, 'bigint', 'sym' || s_nationkey,
            false, NULL FROM supplier
        UNION ALL SELECT s_suppkey, 2, 'function', 'app', 'ret' || s_suppkey, 'sql', '', 3.0, 'text',
            'return ''a'' || ' || s_suppkey, true, 'by inputs' FROM supplier""",
    "rejects": """
        SELECT s_suppkey, 'create' AS verb, 3 AS pos, 'no name and argument list' AS reason FROM supplier
        UNION ALL SELECT s_suppkey, 'comment', 3, 'no routine signature or no text' FROM supplier""",
    "close_routines": """
        SELECT s_suppkey, 0 AS pos, 'function' AS kind, 'app' AS schema, 'c1_' || s_suppkey AS name, ' 1 ' AS body,
            'again ' || s_nationkey AS comment FROM supplier
        UNION ALL SELECT s_suppkey, 1, 'function', 'app', 'c2_' || s_suppkey, ' 2 ', 'of ' || s_name FROM supplier
        UNION ALL SELECT s_suppkey, 2, 'function', NULL, 'C3 ' || s_suppkey, ' 3 ', 'three' FROM supplier
        UNION ALL SELECT s_suppkey, 3, 'procedure', 'App', 'C4 ' || s_nationkey, ' 4 ', 'four' FROM supplier
        UNION ALL SELECT s_suppkey, 4, 'function', 'app', 'c1_' || s_suppkey, ' 5 ', 'again ' || s_nationkey FROM supplier""",
    "statement_census": """
        SELECT s_suppkey, c.kind AS "is", c.n AS n
        FROM supplier, (VALUES ('routine', 5), ('comment', 5), ('rejected create', 1), ('rejected comment', 1)) AS c(kind, n)""",
    "duplicate_bodies_by_literals": """
        SELECT sha256('select ' || lower(p_brand) || '."Total ' || p_size || '" from t -- select where x = ' || chr(39) || said
                || '  it' || chr(39) || chr(39) || 's' || chr(39) || ' and y = $q$' || said || '$q$')
                AS fingerprint, count(*) AS copies, min(p_partkey) AS first_key
        FROM (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN upper(p_type) ELSE lower(p_type) END AS said FROM part)
        GROUP BY p_brand, p_size, said HAVING count(*) > 1""",
    "fold_two_catalogs": """
        SELECT p_partkey AS routine_oid, c.catalog AS catalog, 'fn_' || p_partkey || c.catalog AS name, 2 AS n_parameters
        FROM part, (VALUES ('a'), ('b')) AS c(catalog)""",
    "unfoldable_rows": """
        SELECT CASE WHEN p_size < 10 THEN NULL ELSE p_partkey END AS routine_oid, c.catalog AS catalog,
            CASE WHEN p_size < 10 THEN 'no oid' ELSE 'two names for one oid' END AS reason, count(*) * 2 AS n
        FROM part, (VALUES ('a'), ('b')) AS c(catalog) GROUP BY ALL""",
    "env_entries": """
        SELECT c_custkey, 'NAME' AS key, c_name AS value FROM customer
        UNION ALL SELECT c_custkey, 'SEGMENT', 'a=' || c_mktsegment || ' b' FROM customer
        UNION ALL SELECT c_custkey, 'EMPTY', '' FROM customer""",
    "write_kv": """
        SELECT c_custkey, 'host=h' || c_nationkey || ';Port=' || c_custkey || ';alpha=' || c_mktsegment || ';zeta=1' AS conn
        FROM customer""",
    "connection_defaults": """
        SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'localhost' ELSE 'h' || c_nationkey END AS host, '5432' AS port,
            c_mktsegment AS database, '' AS username, '' AS password FROM customer""",
}
