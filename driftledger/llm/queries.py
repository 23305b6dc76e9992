"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, decontaminate, html, kdshards, langid, licenses, media, periods, ranking, simhash, tokencount, toxicity, warc

WORD_BPE = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(docs: DataFrame, folds: int = 3, fold: int = 1) -> DataFrame:
    """``docs`` with ``held_out``: crc32 of the id as text leaves ``fold`` modulo ``folds``."""
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))
    return docs.withColumn("held_out", F.coalesce(rest == fold, F.lit(False)))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archive_pages(_table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), words=3, radius=3)
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = held_out(_table(spark, sf_dir, "documents"))
    prototypes = langid.learn(docs.where("not held_out"))
    return langid.predict(docs.select("doc_id", "held_out", "text"), prototypes).select("doc_id", "held_out", "lang_pred", "score")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_facts(_table(spark, sf_dir, "documents"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op9_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdshards.shard_documents(_table(spark, sf_dir, "documents"), 8)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranking.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), top=50)
    return found.select("item_id", "rank", "doc_id", "score")


def op12_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.digests(periods.periodic_runs(periods.with_planted_runs(_table(spark, sf_dir, "documents"))))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = held_out(_table(spark, sf_dir, "documents"), 4, 2)
    lexicon = toxicity.learn(docs.where("not held_out"), _table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select("doc_id", "held_out", "text"), lexicon).select("doc_id", "held_out", F.col("toxicity").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_license_scan, op2_warc, op3_bpe, op4_simhash, op5_language, op6_token_counts, op7_media, op8_html, op9_kd_shards, op10_decontaminate, op11_search, op12_periods, op13_toxicity)
}
SQL: dict[str, str] = {"op1_license_scan": licenses.sql(), "op2_warc": warc.SQL, "op11_search": ranking.SQL}
