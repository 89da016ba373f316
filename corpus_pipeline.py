"""Documents to training sequences: five stages, each an operator of driftspark.llm.

Toxic documents go, one document of each group of near duplicates stays, documents with passages of the benchmark go,
secrets are cut out of texts, and what is left is packed.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftspark.llm import decontam, neardup, packing, secret_scan, toxicity
from driftspark.llm.common import staged


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.3; the lexicon is learnt from the labels of those that came in.

    Null and empty texts match nothing; repeated rows stay or go together; rows with a null id are scored and not learnt
    from.
    """
    return toxicity.without_toxic(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document that names its component; of repeated rows of it one.

    Documents without a word, null and empty texts among them, are linked with nothing and all stay, as do rows with a
    null id.
    """
    return neardup.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word that a window of the benchmark covers.

    Null and empty texts have no words and stay; with an empty benchmark all stay; repeated rows stay or go together.
    """
    return decontam.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark; n_chars follows the text. Other columns may have any names.

    Null and empty texts have no secrets and stay as they are, as does n_chars of every text without one; repeated rows
    stay repeated; ids are not read.
    """
    spans = "secret spans"
    while spans in docs.columns:
        spans += "_"
    found = secret_scan.scan_secrets(docs, keep=docs.columns, out=spans).withColumn("text", secret_scan.redacted(F.col("text"), F.col(spans)))
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        found = found.withColumn("n_chars", F.when(F.size(spans) > 0, length).otherwise(F.col("n_chars")))
    return found.select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of at most 4,096 tokens.

    Null and empty texts are one piece of the end id alone; every row is packed for itself, repeated ones and those with
    a null id too; without documents there is no sequence. Other columns are not read.
    """
    model = Path(public_tokenizers.path("word_bpe_49k.json")).read_text()
    return packing.pack(docs, model)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("packing", packed),
]

#: Tokenizers and learnt scores are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what each gives the next is staged, so that no stage is worked out again by later ones."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
