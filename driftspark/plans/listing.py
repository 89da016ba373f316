"""From an archive listing and restored text to a schema script and routine scripts."""

from pyspark.sql import DataFrame

from driftspark.operators.toc import clean_dump_lines, exclude_routine_toc, group_toc
from driftspark.sources.files import write_routine_scripts


def split_listing(lines: DataFrame, by_schema: bool = False) -> tuple[DataFrame, DataFrame]:
    """Lines of the schema script, and routine lines in their groups."""
    return exclude_routine_toc(lines), group_toc(lines, by_schema)


def export_routines(restored: DataFrame, path: str) -> None:
    """Clean restored SQL (name, pos, text) and write it by routine name."""
    write_routine_scripts(clean_dump_lines(restored), path)
