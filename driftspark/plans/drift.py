"""Whole jobs over script corpora and catalog rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftspark.operators.catalog import fold_catalog_rows
from driftspark.operators.drift import (
    actual_state,
    desired_state,
    diff_routines,
    duplicate_bodies,
    match_routines,
)
from driftspark.operators.routines import extract_routines, parse_routines


def drift_report(
    scripts: DataFrame,
    catalog_rows: DataFrame,
    by: tuple[str, ...] = (),
    default_schema: str = "public",
    canonical_types: bool = False,
    staged: bool = False,
) -> DataFrame:
    """Scripts and flat catalog rows -> status and changed fields per routine.

    Script text shrinks to comparable rows (bodies to fingerprints) before the first shuffle. Pairing
    reads these rows and the folded catalog more than once; with `staged`, both are checkpointed in the
    session's checkpoint folder first, so that the text is scanned once. Several catalogs need `by`, the
    columns that scripts and rows name them by.
    """
    desired = desired_state(parse_routines(scripts, hashed=True), by, default_schema, canonical_types)
    actual = actual_state(fold_catalog_rows(catalog_rows, by), by, canonical_types)
    if staged:
        desired, actual = desired.checkpoint(), actual.checkpoint()
    return diff_routines(match_routines(desired, actual, by))


def shared_bodies(scripts: DataFrame) -> DataFrame:
    """Bodies that several routines of a corpus have in common."""
    routines = extract_routines(scripts).select(
        F.concat_ws(".", "schema", "name").alias("routine"), "body"
    )
    return duplicate_bodies(routines, "routine", "body")
