"""One query for each operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard, licenses, lines, mixing, oracles, quality, secrets, sharding, topk, warc
from .common import table

Query = Callable[[SparkSession, str], DataFrame]
SHARDS = tuple(f"shard-{k:03d}" for k in range(64))
SLOTS = 8191


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"), secrets.train(spark), path_col="source")
    return found.select("doc_id", "start", "end", F.sha2("value", 256).alias("value_sha256"), F.round("score", 6).alias("score"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages")).drop("record_id")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.weighted_fair_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, sf_dir, "documents"))


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.summary(lines.later_lines(table(spark, sf_dir, "documents")))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents").select("doc_id"), SHARDS, size=SLOTS)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), with_text=False)
    return decontaminate.report(found).drop("hit_spans", "items")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")), with_text=False).select("doc_id", "quality_score", "keep")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.report(licenses.license_scan(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_secrets, op2_warc, op3_topk, op4_mixing, op5_jaccard, op6_lines, op7_sharding, op8_decontaminate, op9_quality, op10_licenses)}
ORACLES: dict[str, str] = {
    "op2_warc": oracles.WARC,
    "op3_topk": oracles.TOP_K,
    "op5_jaccard": oracles.JACCARD,
    "op7_sharding": oracles.sharding(SHARDS, SLOTS),
    "op8_decontaminate": oracles.DECONTAMINATION,
    "op10_licenses": oracles.LICENSES,
}
