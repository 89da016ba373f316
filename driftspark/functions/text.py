"""Scalar text functions. All of them return native columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lines a restored dump carries that say nothing about the schema itself.
DUMP_NOISE = (
    r"^\\(?:un)?restrict\b"
    r"|^SET\s+\w+"
    r"|^SELECT\s+pg_catalog\.set_config\b"
    r"|^ALTER\s+(?:FUNCTION|PROCEDURE)\s+.+\s+OWNER\s+TO\b"
)


# Between the groups of `regexp_groups`. The script scanner masks it in its input.
GROUP_BREAK = "\x03"


def regexp_groups(text: Column, pattern: str, n: int) -> Column:
    """All `n` groups of a pattern that spans the whole text, by one evaluation of it.

    An unmatched group is ''. Where the pattern does not match, the array holds the text alone.
    """
    groups = GROUP_BREAK.join(f"${i + 1}" for i in range(n))
    return F.split(F.regexp_replace(text, pattern, groups), GROUP_BREAK, -1)


def group(groups: Column, i: int) -> Column:
    """Group `i` (from 0) of `regexp_groups`; NULL where the pattern did not match."""
    return F.get(groups, F.lit(i))


def trim_blanks(text: Column) -> Column:
    """Trim blanks, tabs and line ends; Spark's own trim() only knows blanks."""
    return F.btrim(text, F.lit(" \t\n\r\f\x0b"))


def normalize_text(text: Column) -> Column:
    """Lower-case, every run of blanks and non-printable characters as one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\x21-\x7e]+", " "))


def fingerprint(text: Column) -> Column:
    """SHA-256 (64 hex characters) of the normalised text; equal for bodies that differ in layout only."""
    return F.sha2(normalize_text(text), 256)


# Comments, then what keeps its case and blanks: escape literals, literals, quoted names, dollar quotes; then code.
_KEPT = r"""(?<![\w$])[eE]'[^'\\]*+(?:(?:\\[\s\S]|'')[^'\\]*+)*+'|'[^']*+(?:''[^']*+)*+'|"[^"]*+(?:""[^"]*+)*+"|(?<![\w$])(\$(?:[A-Za-z_]\w*+)?\$)[\s\S]*?\1"""
_PIECE = rf"""--[^\n]*+\s*+|/\*[\s\S]*?\*/|{_KEPT}|[^-/$'"eE]++|[\s\S]"""


def literal_safe_text(text: Column) -> Column:
    """`normalize_text` outside of literals, quoted names and dollar quotes, which stay as they are."""
    pieces = F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0))
    kept = lambda piece: piece.rlike(rf"^(?:{_KEPT})$")
    folded = lambda piece: F.regexp_replace(F.lower(piece), r"[^\x21-\x7e]+", " ")
    return F.trim(F.array_join(F.transform(pieces, lambda piece: F.when(kept(piece), piece).otherwise(folded(piece))), ""))


def literal_safe_fingerprint(text: Column) -> Column:
    """SHA-256 of `literal_safe_text`: bodies that differ within a literal differ, other than by `fingerprint`."""
    return F.sha2(literal_safe_text(text), 256)


def mask_secret(conn: Column) -> Column:
    """Replace the value of the first ``Password=`` of a connection string by ``****``."""
    return F.regexp_replace(conn, r"(?is)^(.*?)(Password\s*=\s*)([^;]*)", "$1$2****")


# An element of an array literal, behind its comma: quoted with backslash escapes, or plain.
_ELEMENT = r'(?:^|,)("[^"\\]*+(?:\\.[^"\\]*+)*+"|[^,]*+)'


def parse_pg_array(literal: Column) -> Column:
    """``{a,b}`` -> array; NULL, '' and ``{}`` -> empty array.

    Commas inside quoted elements don't part them; the quotes go and escapes are undone.
    """
    inner = F.regexp_replace(literal, r"^\{|\}$", "")
    empty = literal.isNull() | literal.isin("", "{}")

    def plain(element):
        quoted = F.substring(element, F.lit(2), F.length(element) - 2)
        return F.when(
            element.startswith('"'), F.regexp_replace(quoted, r"(?s)\\(.)", "$1")
        ).otherwise(element)

    elements = F.transform(F.regexp_extract_all(inner, F.lit(_ELEMENT), F.lit(1)), plain)
    return F.when(empty, F.array().cast("array<string>")).otherwise(elements)


def extract_version(text: Column) -> Column:
    """First dotted number in free text, else ``unknown output``."""
    found = F.regexp_extract(text, r"\d+(?:\.\d+)+", 0)
    return F.when(found != "", found).otherwise("unknown output")


def version_core(version: Column) -> Column:
    """Drop a leading ``v`` and everything after the third part."""
    return F.substring_index(F.regexp_replace(version, "^v", ""), ".", 3)


def is_newer(current: Column, latest: Column) -> Column:
    """True if `latest` is ahead of `current`, by major, minor and patch as integers.

    The first differing part decides. A part that is missing or not a number decides as "not newer",
    hence the fillers: nothing is ahead of the one, and the other is ahead of nothing. An empty part, as in
    ``1..3``, is not a number either.
    """

    def parts(version, filler):
        # the texts are bound once, and their three parts read from them
        texts = F.array(F.split(version_core(version), r"\.", 3))
        numbers = F.transform(
            texts, lambda t: F.array(*[F.coalesce(F.get(t, F.lit(i)).try_cast("long"), F.lit(filler)) for i in range(3)])
        )
        return F.get(numbers, F.lit(0))

    newer = parts(current, 2**63 - 1) < parts(latest, -1)
    return newer & current.isNotNull() & latest.isNotNull()


def clean_dump_text(sql: Column) -> Column:
    """Drop session settings, restrict markers and routine owner lines from restored SQL; keep the order."""
    lines = F.split(sql, "\n", -1)
    return F.array_join(F.filter(lines, lambda line: ~line.rlike(DUMP_NOISE)), "\n")
