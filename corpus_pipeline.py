"""Training-data pipeline over ``documents``: each stage calls one operator.

Language ID keeps the wanted languages; SimHash near-dedup keeps one
document of each group; decontamination drops documents that hold benchmark
items; BPE encoding returns what the rest encodes and decodes to.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from driftledger.llm import bpe, decontaminate, langid, simhash
from driftledger.llm.shared import stored

#: Share of an item's words that a document must hold to be dropped.
COVERAGE = 0.8
#: Languages that are wanted.
WANTED = ("de", "en", "es", "fr")
#: The least cosine of a prediction: three times the standard deviation of unrelated vectors' cosine.
LEAST_SCORE = 3 / langid.DIMENSIONS**0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents predicted to be in a wanted language, at a score that chance doesn't reach.

    Prototypes are learned from all labelled rows; predictions see texts alone.  A
    null text or one without a letter is ``und`` and goes; without any labels all go.
    Null ids and repeated rows are judged by their texts; all columns are kept.
    """
    found = langid.predict(docs.select(F.struct(*docs.columns).alias("__row"), "text"), langid.learn(docs))
    return found.where(F.col("lang_pred").isin(*WANTED) & (F.col("score") >= LEAST_SCORE)).select("__row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose five-word shingles are 0.8 or more alike, the one with the smallest id stays."""
    return simhash.deduplicate(docs, words=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose text holds a benchmark item; null texts and ids stay, as do all columns."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), COVERAGE)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text."""
    return bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontamination", decontamination), ("encoding", encoding)]
#: The stages can't be expressed in SQL; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``encoding``'s rows of what the other stages keep of ``documents``; an empty table gives none."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
