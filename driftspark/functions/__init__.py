from .scan import mask_bodies, restore_literals, scan_script, strip_sql_comments
from .text import (
    clean_dump_text,
    extract_version,
    fingerprint,
    is_newer,
    mask_secret,
    normalize_text,
    parse_pg_array,
    trim_blanks,
)

__all__ = [
    "clean_dump_text",
    "extract_version",
    "fingerprint",
    "is_newer",
    "mask_bodies",
    "mask_secret",
    "normalize_text",
    "parse_pg_array",
    "restore_literals",
    "scan_script",
    "strip_sql_comments",
    "trim_blanks",
]
