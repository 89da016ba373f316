"""Registered queries: their columns, and those that SQL can express against it."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from check import compare, connect  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from driftspark.llm.oracle import ORACLE  # noqa: E402
from driftspark.llm.queries import QUERIES  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": "doc_id n_bytes n_tokens over_limit", "op2": "doc_id held_out score predicted", "op3": "doc_id n_shingles component_id kept",
    "op4": "page_id url text n_chars", "op5": "doc_id n_assign n_access n_hex base_sha256 spans", "op6": "doc_id held_out score predicted",
    "op7": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op8": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "op9": "page_id host path rule verdict",
    "op10": "doc_id piece start length ids_crc32 sequence_id offset",
    "op11": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256",
    "op12": "anchor_id positive_id rank negative_id positive_score negative_score", "op13": "doc_id n_bytes n_removed n_spans kept_sha256",
}


def test_all_are_registered():
    assert {*QUERIES, "pipeline"} <= set(entry.queries())
    assert [n.split("_")[0] for n in sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == list(COLUMNS)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, name):
    assert compare(spark, connect(SF_DIR), SF_DIR, name) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_columns_and_rows(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    assert df.columns[: len(COLUMNS[name.split("_")[0]].split())] == COLUMNS[name.split("_")[0]].split()
    key = df.columns[0]
    source = spark.read.parquet(f"{SF_DIR}/{'pages' if key == 'page_id' else 'documents'}.parquet")
    assert df.select(key).distinct().count() == source.select(key).distinct().count()
