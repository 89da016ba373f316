"""Routine extraction: script text -> one row per CREATE FUNCTION / PROCEDURE statement.

`scan_script` masks literals, comments and inner bracket groups once per script and cuts it at
statement starts. Everything after it is native: statements become rows and are read with regular
expressions, each of them evaluated once per statement.
"""

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftspark.functions.scan import (
    CLOSE,
    NAMED_TYPE,
    OPEN,
    PARAMETER_TEXT,
    PLACEHOLDER,
    dollar_body,
    escaped_body,
    quoted_body,
    restore_literals,
    scan_script,
)
from driftspark.functions.text import fingerprint, group, regexp_groups, trim_blanks
from driftspark.schemas import PARAMETER, TABLE_COLUMN

# Keywords, type names, clauses and defaults of the SQL dialect.
SET_VALUE = rf"(?:{OPEN}\d+{CLOSE}|[^\s,]+)"
ATTRIBUTE_CLAUSES = [
    "RETURNS NULL ON NULL INPUT",
    "CALLED ON NULL INPUT",
    "EXTERNAL SECURITY (?:INVOKER|DEFINER)",
    "SECURITY (?:INVOKER|DEFINER)",
    r"TRANSFORM FOR TYPE \S+",
    "NOT LEAKPROOF",
    "PARALLEL (?:UNSAFE|RESTRICTED|SAFE)",
    r"SET \S+ FROM CURRENT",
    rf"SET \S+ ?(?:=|TO) ?{SET_VALUE}(?: ?, ?{SET_VALUE})*",
    r"LANGUAGE \S+",
    r"SUPPORT \S+",
    r"COST \S+",
    r"ROWS \S+",
    "IMMUTABLE",
    "STABLE",
    "VOLATILE",
    "LEAKPROOF",
    "STRICT",
    "WINDOW",
]
# A return type ends at the first word of a clause, or where the body begins.
RETURN_TYPE_ENDS = sorted(
    {re.match(r"\w+", clause)[0] for clause in ATTRIBUTE_CLAUSES} | {"AS", r"BEGIN\s+ATOMIC", "RETURN"}
)
ATTRIBUTE_DEFAULTS = {
    "language": "sql", "volatility": "volatile", "parallel": "unsafe",
    "cost": 100.0, "cost_native": 1.0, "rows_set": 1000.0, "rows_scalar": 0.0,
}

# A word, or a quoted identifier, which is a masked part.
_WORD = rf"(?:[\p{{L}}_][\p{{L}}\p{{N}}_$]*|{OPEN}\d+{CLOSE})"
_NAME = rf"(?:({_WORD})\s*\.\s*)?({_WORD})\s*\(([^()]*)\)"
# Behind the word is a blank, or a name in quotes.
_KIND = rf"(FUNCTION|PROCEDURE)(?:\s+|(?={OPEN}))"
# Patterns for `regexp_groups`. Groups: kind, schema, name, arguments, rest of the statement.
# Literals are masked, so the first semicolon ends it, save for BEGIN ATOMIC bodies.
CREATE_ROUTINE = (
    rf"(?is)^CREATE\s+(?:OR\s+REPLACE\s+)?{_KIND}{_NAME}([^;]*).*\z"
)
# Groups: kind, schema, name, argument types, E of an escape literal, number of the literal (NULL has none).
COMMENT_ON = rf"(?is)^COMMENT\s+ON\s+{_KIND}{_NAME}\s*IS\s*(?:(E?){PLACEHOLDER}|NULL)\s*(?:;.*)?\z"
_TYPE_END = rf"\b(?:{'|'.join(RETURN_TYPE_ENDS)})\b"
_RETURNS = r"\bRETURNS\s+(?!NULL\s+ON\s+NULL\s+INPUT)"
# Groups: TABLE, its columns, SETOF, type up to a keyword, or else up to the line end.
RETURNS_CLAUSE = (
    rf"(?is)^.*?{_RETURNS}(?:(TABLE)\s*\(([^()]*)\)"
    rf"|(SETOF\s+)?(?:(.*?)(?={_TYPE_END})|([^\n]*))).*\z"
)
# What is not attributes in the rest of a statement: the RETURNS clause and all from the body on.
NOT_ATTRIBUTES = (
    rf"(?is){_RETURNS}(?:TABLE\s*\([^()]*\)|(?:SETOF\s+)?.*?(?={_TYPE_END}|\z))"
    rf"|\bAS(?=[\s{OPEN}]).*\z|\bBEGIN\s+ATOMIC\b.*\z|\bRETURN\b.*\z"
)
# Groups: number of the literal; for the second one, of the link symbol behind a library's name.
BODY_LITERAL = rf"(?i)\bAS\s*E?{PLACEHOLDER}"
BODY_SYMBOL = rf"(?i)\bAS\s*E?{OPEN}\d+{CLOSE}\s*,\s*E?{PLACEHOLDER}"
BODY_ESCAPES = rf"(?i)\bAS\s*(?:E?{OPEN}\d+{CLOSE}\s*,\s*)?E{OPEN}\d+{CLOSE}(?!\s*,)"
BODY_RETURN = r"(?is)\b(RETURN\b.*?)\s*\z"
ATOMIC = r"(?i)\bBEGIN\s+ATOMIC\b"
BODY_ATOMIC = r"(?is)\bBEGIN\s+ATOMIC(?:\s*;)?((?:.*?;)?\s*)\bEND\b\s*(?:;|\z)"
ATTRIBUTE = rf"(?i)(?<!\S)(?:{'|'.join(ATTRIBUTE_CLAUSES)})"


def _empty_as_null(text: Column) -> Column:
    return F.when(text != "", text)


def _unquoted(name: Column) -> Column:
    """A name as the catalog holds it: without its quotes, doubled ones undone; '' as NULL."""
    inner = F.replace(F.substring(name, F.lit(2), F.length(name) - 2), F.lit('""'), F.lit('"'))
    return F.when(name.startswith('"'), inner).otherwise(_empty_as_null(name))


def _statements(scripts: DataFrame, text: str) -> DataFrame:
    """One row per routine statement, with only its own literals as `parts`.

    Texts without the words of such a statement need no scan; a comment may stand right behind the word.
    """
    others = [c for c in scripts.columns if c != text]
    found = F.explode(scan_script(text)).alias("_statement")
    likely = scripts.where(F.col(text).rlike("(?i)FUNCTION|PROCEDURE"))
    return likely.select(*others, found).select(*others, "_statement.*")


def _parameters(content: Column, parts: Column, base: Column) -> Column:
    """Parameter list text (top-level commas only) -> array of parameters."""
    items = F.filter(
        F.transform(F.split(content, ",", -1), trim_blanks), lambda item: item != ""
    )
    moded = F.transform(items, lambda item: regexp_groups(item, PARAMETER_TEXT, 2))

    def typed(p):
        words = regexp_groups(group(p, 1), NAMED_TYPE, 3)
        return F.struct(group(p, 0).alias("mode"), words.alias("words"))

    def parameter(p, i):
        unnamed, name, named = (F.coalesce(group(p["words"], k), F.lit("")) for k in range(3))
        return F.struct(
            (i + 1).cast("int").alias("pos"),
            F.when(p["mode"] != "", F.lower(p["mode"])).alias("dir"),
            _empty_as_null(restore_literals(name, parts, base)).alias("name"),
            restore_literals(F.concat(unnamed, named), parts, base).alias("type"),
        )

    return F.transform(F.transform(moded, typed), parameter).cast(f"array<{PARAMETER}>")


def _returns(clause: Column, parts: Column, base: Column) -> Column:
    """RETURNS_CLAUSE groups -> nested return; NULL where there is no clause."""
    table = group(clause, 0) != ""
    items = F.transform(
        F.split(group(clause, 1), ",", -1), lambda item: trim_blanks(restore_literals(item, parts, base))
    )
    columns = F.transform(
        F.filter(items, lambda item: item != ""),
        lambda item: F.struct(
            F.regexp_extract(item, r"^\S+", 0).alias("name"),
            F.regexp_extract(item, r"(?s)^\S+\s+(.*)$", 1).alias("type"),
        ),
    ).cast(f"array<{TABLE_COLUMN}>")
    type_text = trim_blanks(F.concat(group(clause, 3), group(clause, 4)))
    return F.when(
        F.size(clause) == 5,
        F.struct(
            (group(clause, 2) != "").alias("setof"),
            F.when(~table, restore_literals(type_text, parts, base)).alias("type"),
            F.when(table, columns).alias("table"),
        ),
    )


def extract_routines(scripts: DataFrame, text: str = "text") -> DataFrame:
    """One row per routine definition: kind, schema, name, parameters, returns, attributes, body.

    The other columns of `scripts` are kept; `pos` numbers the definitions within a script.
    A narrow job: one Arrow hop, no shuffle.
    """
    others = [c for c in scripts.columns if c != text]
    statements = _statements(scripts, text).where("verb = 'create'")
    return _read_definitions(statements).where("name is not null").select(*others, *ROUTINE_COLUMNS)


ROUTINE_COLUMNS = [
    "pos", "kind", "schema", "name", "parameters", "returns", "attributes", "body", "atomic",
]


def _read_definitions(statements: DataFrame) -> DataFrame:
    """Each step names what the next one reads more than once, so nothing is computed twice."""
    parts, base = F.col("parts"), F.col("base")
    heads = statements.withColumn("head", regexp_groups(F.col("text"), CREATE_ROUTINE, 5))
    tails = heads.select(
        *statements.columns,
        group(F.col("head"), 3).alias("arguments"),
        group(F.col("head"), 4).alias("tail"),
        F.when(F.size("head") == 5, F.lower(group(F.col("head"), 0))).alias("kind"),
        _unquoted(restore_literals(group(F.col("head"), 1), parts, base)).alias("schema"),
        _unquoted(restore_literals(group(F.col("head"), 2), parts, base)).alias("name"),
    )
    number = F.coalesce(
        _empty_as_null(F.regexp_extract("tail", BODY_SYMBOL, 1)),
        _empty_as_null(F.regexp_extract("tail", BODY_LITERAL, 1)),
    ).cast("int")
    zones = tails.withColumns(
        {
            "clause": regexp_groups(F.col("tail"), RETURNS_CLAUSE, 5),
            "zone": F.regexp_replace(F.regexp_replace("tail", NOT_ATTRIBUTES, ""), r"\s+", " "),
            "literal": F.get(parts, number - base),
        }
    )
    atomic_text = F.when(
        F.col("literal").isNull(),
        F.coalesce(
            _empty_as_null(F.regexp_extract("text", BODY_ATOMIC, 1)),
            F.when(~F.col("tail").rlike(ATOMIC), _empty_as_null(F.regexp_extract("tail", BODY_RETURN, 1))),
        ),
    )
    texts = zones.withColumn("atomic_text", atomic_text)
    literal = F.col("literal")
    body = (
        F.when(literal.startswith("$"), dollar_body(literal))
        .when(literal.startswith("'") & F.col("tail").rlike(BODY_ESCAPES), escaped_body(literal))
        .when(literal.startswith("'"), quoted_body(literal))
        .otherwise(restore_literals(F.col("atomic_text"), parts, base))
    )
    found = F.regexp_extract_all("zone", F.lit(ATTRIBUTE), F.lit(0))
    return texts.withColumns(
        {
            "parameters": _parameters(F.col("arguments"), parts, base),
            "returns": _returns(F.col("clause"), parts, base),
            "attributes": F.transform(found, lambda a: restore_literals(a, parts, base)),
            "body": body,
            "atomic": literal.isNull() & F.col("tail").rlike(rf"{ATOMIC}|(?i)\bRETURN\b"),
        }
    )


def renumbered(found: DataFrame, by: list[str], piece: str = "piece") -> DataFrame:
    """`pos` counted over the pieces of a script, of which `by` names the columns, instead of within each; `piece` goes.

    Works on what `extract_routines` or `extract_comments` found in pieces; counts are one row per piece.
    """
    before = Window.partitionBy(*by).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    counts = found.groupBy(*by, piece).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    columns = [(F.col("pos") + F.col("_before")).cast("int").alias("pos") if c == "pos" else F.col(c) for c in found.columns if c != piece]
    return found.join(counts, [*by, piece]).select(*columns)


def extract_parameters(routines: DataFrame) -> DataFrame:
    """One row per parameter of extracted routines."""
    return routines.select(
        *[c for c in routines.columns if c not in _NESTED], F.inline("parameters").alias(
            "param_pos", "param_dir", "param_name", "param_type"
        )
    )


def extract_returns(routines: DataFrame) -> DataFrame:
    """One row per routine with a RETURNS clause, or per column for RETURNS TABLE."""
    columns = F.posexplode_outer("returns.table").alias("column_pos", "column")
    return routines.where(F.col("returns").isNotNull()).select(
        *[c for c in routines.columns if c not in _NESTED],
        F.col("returns.setof").alias("setof"),
        F.col("returns.type").alias("return_type"),
        columns,
    )


def extract_attributes(routines: DataFrame) -> DataFrame:
    """One row per attribute clause, in source order and spelling."""
    return routines.select(
        *[c for c in routines.columns if c not in _NESTED],
        F.posexplode("attributes").alias("attribute_pos", "attribute"),
    )


def extract_bodies(routines: DataFrame) -> DataFrame:
    """Routines that have a body, with the body verbatim."""
    return routines.where(F.col("body").isNotNull()).select(
        *[c for c in routines.columns if c not in _NESTED], "body"
    )


_NESTED = ["parameters", "returns", "attributes", "body", "atomic"]


def extract_comments(scripts: DataFrame, text: str = "text") -> DataFrame:
    """One row per ``COMMENT ON FUNCTION/PROCEDURE ... IS`` a literal or NULL, with lower-cased argument types."""
    others = [c for c in scripts.columns if c != text]
    statements = _statements(scripts, text).where("verb = 'comment'")
    return _read_comments(statements).where("kind is not null").select(
        *others, "pos", "kind", "schema", "name", "arg_types", "comment"
    )


def _comment_head(text: Column) -> Column:
    return regexp_groups(text, COMMENT_ON, 6)


def _comment_types(said: Column, parts: Column, base: Column) -> Column:
    return argument_types(_parameters(group(said, 3), parts, base), F.lower(group(said, 0)))


def _comment_text(said: Column, parts: Column, base: Column) -> Column:
    literal = F.get(parts, _empty_as_null(group(said, 5)).cast("int") - base)
    return _literal_text(literal, group(said, 4) != "")


def _literal_text(literal: Column, escaped: Column) -> Column:
    return (
        F.when(literal.startswith("$"), dollar_body(literal))
        .when(literal.startswith("'") & escaped, escaped_body(literal))
        .when(literal.startswith("'"), quoted_body(literal))
    )


def _read_comments(statements: DataFrame) -> DataFrame:
    parts, base, head = F.col("parts"), F.col("base"), F.col("said")
    said = statements.withColumn("said", _comment_head(F.col("text")))
    return said.where(F.size("said") == 6).select(
        *statements.columns,
        F.lower(group(head, 0)).alias("kind"),
        _unquoted(restore_literals(group(head, 1), parts, base)).alias("schema"),
        _unquoted(restore_literals(group(head, 2), parts, base)).alias("name"),
        _comment_types(head, parts, base).alias("arg_types"),
        _comment_text(head, parts, base).alias("comment"),
    )


def rejects(scripts: DataFrame, text: str = "text") -> DataFrame:
    """Statements that read like one for a routine and can't be read as one: verb, pos, head and reason.

    Every statement is a routine, a comment, or a row here.
    """
    others = [c for c in scripts.columns if c != text]
    statements = _statements(scripts, text)
    created = F.size(regexp_groups(F.col("text"), CREATE_ROUTINE, 5)) == 5
    said = F.size(_comment_head(F.col("text"))) == 6
    unread = statements.where(~F.when(F.col("verb") == "create", created).otherwise(said))
    reason = F.when(F.col("verb") == "create", "no name and argument list").otherwise(
        F.when(~F.col("text").rlike(r"(?i)\bIS\b"), "no IS").otherwise("no routine signature or no text")
    )
    head = F.left(restore_literals(F.col("text"), F.col("parts"), F.col("base")), F.lit(200))
    return unread.select(*others, "verb", "pos", head.alias("head"), reason.alias("reason"))


def argument_types(parameters: Column, kind: Column) -> Column:
    """Lower-cased parameter types that comments are matched by: a function's input ones, all of a procedure."""
    named = F.filter(parameters, lambda p: (kind != "function") | ~F.coalesce(p["dir"], F.lit("in")).isin("out"))
    return F.transform(named, lambda p: F.lower(p["type"]))


def last_comment(comments: DataFrame, by: list[str]) -> DataFrame:
    """The last comment of each routine; `by` names the columns that identify a script."""
    return comments.groupBy(*by, "kind", "schema", "name", "arg_types").agg(
        F.max_by("comment", "pos").alias("comment")
    )


def attach_comments(routines: DataFrame, comments: DataFrame, by: list[str]) -> DataFrame:
    """Left join of routines with their last comment in the same script.

    The comment side is one row per key, so a hot key can only sit on the routine side, which
    AQE splits. That side grows with the scripts, and sizes estimated from what texts are made of
    would broadcast it: both are merged instead.
    """
    said = last_comment(comments, by).select(
        *[F.col(c).alias(f"_{c}") for c in [*by, "kind", "schema", "name", "arg_types"]], "comment"
    )
    same = F.lit(True)
    for c in [*by, "kind", "schema", "name"]:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    same = same & (F.col("_types") == F.col("_arg_types"))
    typed = routines.withColumn("_types", argument_types(F.col("parameters"), F.col("kind")))
    return typed.join(said.hint("merge"), same, "left").select(*routines.columns, "comment")


def parse_routines(scripts: DataFrame, text: str = "text", hashed: bool = False) -> DataFrame:
    """`extract_routines` with the last comment of the same script, in one scan and without a shuffle.

    The scanner keeps an index of the script's comments by kind, name and argument types, and hands every
    definition the last one on it, also if it says NULL. With `hashed`, bodies become `body_hash`.
    """
    others = [c for c in scripts.columns if c != text]
    statements = _statements(scripts, text).where("verb = 'create'")
    body = fingerprint(F.col("body")).alias("body_hash") if hashed else F.col("body")
    columns = [body if c == "body" else F.col(c) for c in ROUTINE_COLUMNS]
    defined = _read_definitions(statements).where("name is not null")
    comment = _literal_text(F.col("remark.literal"), F.col("remark.escaped"))
    return defined.select(*others, *columns, comment.alias("comment"))


# A value of a comma list: quoted in either way, or a word.
LISTED = r"'[^']*+(?:''[^']*+)*+'|\"[^\"]*+(?:\"\"[^\"]*+)*+\"|[^\s,]+"


def _setting_value(value: Column) -> Column:
    inner = F.replace(F.substring(value, F.lit(2), F.length(value) - 2), F.lit("''"), F.lit("'"))
    return F.when(value.startswith("'"), inner).otherwise(value)


def resolve_attributes(routines: DataFrame) -> DataFrame:
    """Attribute clauses -> typed columns, with the dialect's defaults for what is not stated."""
    attributes = F.col("attributes")

    def stated(pattern):
        return F.exists(attributes, lambda a: a.rlike(rf"(?i)^(?:{pattern})$"))

    def value(word):
        clause = F.get(F.filter(attributes, lambda a: a.rlike(rf"(?i)^{word}\s")), F.lit(0))
        return F.get(F.split(clause, r"\s+", 3), F.lit(1))

    def choice(prefix, words, default):
        picked = F.lit(default)
        for word in reversed(words):
            picked = F.when(stated(prefix + word), word).otherwise(picked)
        return picked

    def setting(clause):
        text = r"(?is)^SET\s+(\S+?)\s*(?:=|\bTO\b)\s*(.+)$"
        values = F.regexp_extract_all(F.regexp_extract(clause, text, 2), F.lit(LISTED), F.lit(0))
        plain = F.array_join(F.transform(values, _setting_value), ", ")
        return F.when(
            clause.rlike(text), F.concat(F.regexp_extract(clause, text, 1), F.lit("="), plain)
        ).otherwise(clause)

    stated_language = F.regexp_replace(F.lower(value("LANGUAGE")), "^'(.*)'$", "$1")
    language = F.coalesce(stated_language, F.lit(ATTRIBUTE_DEFAULTS["language"]))
    cost = F.when(language.isin("c", "internal"), ATTRIBUTE_DEFAULTS["cost_native"]).otherwise(ATTRIBUTE_DEFAULTS["cost"])
    returns_set = F.col("returns.setof") | F.col("returns.table").isNotNull()
    rows = F.when(returns_set, ATTRIBUTE_DEFAULTS["rows_set"]).otherwise(
        ATTRIBUTE_DEFAULTS["rows_scalar"]
    )
    return routines.withColumns(
        {
            "language": language,
            "volatility": choice(
                "", ["immutable", "stable", "volatile"], ATTRIBUTE_DEFAULTS["volatility"]
            ),
            "strict": stated("STRICT|RETURNS NULL ON NULL INPUT"),
            "security_definer": stated("(?:EXTERNAL )?SECURITY DEFINER"),
            "parallel": choice(
                "parallel ", ["safe", "restricted", "unsafe"], ATTRIBUTE_DEFAULTS["parallel"]
            ),
            "leakproof": stated("LEAKPROOF"),
            "cost": F.coalesce(value("COST").try_cast("double"), cost),
            "rows": F.coalesce(value("ROWS").try_cast("double"), rows),
            "config": F.transform(
                F.filter(attributes, lambda a: a.rlike(r"(?i)^SET\s")), setting
            ),
        }
    )
