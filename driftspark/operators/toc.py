"""Archive listings: classify, filter and group table-of-contents lines."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftspark.functions.text import clean_dump_text, group, regexp_groups

# Line layouts of an archive listing.
# Groups: 1255 for a definition and its schema, COMMENT or ACL and its schema, routine name.
ROUTINE_LINE = (
    r"(?s)^\d+;\s+"
    r"(?:(1255)\s+\d+\s+(?:FUNCTION|PROCEDURE)\s+(\S+)"
    r"|0\s+0\s+(COMMENT|ACL)\s+(\S+)\s+(?:FUNCTION|PROCEDURE))"
    r"\s+([^\s(]+)\(.*\z"
)
ROUTINE_WORD = r"\bFUNCTION\b|\bPROCEDURE\b"


def classify_toc(lines: DataFrame) -> DataFrame:
    """Add `kind` (routine, comment, acl or NULL), `schema` and routine `name` to listing lines."""
    read = lines.withColumn("_toc", regexp_groups(F.col("line"), ROUTINE_LINE, 5))
    groups = F.col("_toc")
    found = F.size(groups) == 5
    kind = F.when(group(groups, 0) != "", "routine").otherwise(F.lower(group(groups, 2)))
    return read.withColumns(
        {
            "kind": F.when(found, kind),
            "schema": F.when(found, F.concat(group(groups, 1), group(groups, 3))),
            "name": F.when(found, group(groups, 4)),
        }
    ).drop("_toc")


def group_toc(lines: DataFrame, by_schema: bool = False) -> DataFrame:
    """Listing lines by routine name, one row per line: order by file, first_pos, pos.

    Overloads share a group. A comment or ACL line belongs to it only if a definition of that name
    came earlier in the file. Lines stay rows instead of one array per group, and each group's start
    is found by a map-side combined minimum, so no group has to fit into a task.
    """
    keys = ["file", "schema", "name"] if by_schema else ["file", "name"]
    line = F.col("line")
    spoken = line.contains("FUNCTION") | line.contains("PROCEDURE")
    relevant = classify_toc(lines.where(spoken)).where("kind is not null")
    starts = relevant.where("kind = 'routine'").groupBy(*keys).agg(F.min("pos").alias("first_pos"))
    return (
        relevant.join(starts, keys)
        .where("pos >= first_pos")
        .select(*keys, "first_pos", "pos", "kind", "line")
    )


def exclude_routine_toc(lines: DataFrame) -> DataFrame:
    """Lines that do not speak of a function or procedure; headers stay."""
    return lines.where(~F.col("line").rlike(ROUTINE_WORD))


def clean_dump_lines(df: DataFrame, col: str = "text") -> DataFrame:
    """Drop session settings and owner lines from restored SQL text, also inside bodies."""
    return df.withColumn(col, clean_dump_text(F.col(col)))
