"""Input and output schemas, as DDL strings."""

PARAMETER = "struct<pos int, dir string, name string, type string>"
TABLE_COLUMN = "struct<name string, type string>"

SCRIPTS = "script_id long, path string, text string"

# One row per routine x parameter, as a catalog export delivers it.
CATALOG_ROWS = """
    schema string, name string, type string, routine_oid long,
    param_ord int, param_name string, param_type string,
    return_type string, return_setof boolean, body string,
    language string, volatility string, strict boolean, security_definer boolean,
    parallel string, leakproof boolean, cost double, rows double,
    config array<string>, comment string
"""

CATALOG_COLUMNS = [
    "schema", "name", "type", "routine_oid", "param_ord", "param_name", "param_type",
    "return_type", "return_setof", "body", "language", "volatility", "strict",
    "security_definer", "parallel", "leakproof", "cost", "rows", "config", "comment",
]

TOC_LINES = "file string, pos int, line string"
SETTINGS_LAYERS = "layer_rank int, section string, key string, value string"
