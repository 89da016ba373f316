from .files import (
    read_catalog_rows,
    read_jsonc,
    read_script_corpus,
    read_toc,
    write_routine_scripts,
)
from .ranges import script_pieces

__all__ = [
    "read_catalog_rows",
    "read_jsonc",
    "read_script_corpus",
    "read_toc",
    "script_pieces",
    "write_routine_scripts",
]
