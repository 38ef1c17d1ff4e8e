"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import decontaminate, jaccard, mixing, quality, sharding
from marginalia.llm.common import table, written
from marginalia.llm.queries import SHARDS, SLOTS

#: Words in a shingle and least similarity in percent of the near-duplicate stage.
SHINGLE, SIMILAR = 5, 80
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def spared(*taken: str) -> Callable[[Stage], Stage]:
    """The stage sees columns of its input that bear names which it or its operator makes under other names; they come back as they were."""

    def around(stage: Stage) -> Stage:
        @functools.wraps(stage)
        def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            meanwhile = {c: f"{c} of the documents" for c in docs.columns if c in taken}
            out = stage(spark, docs.withColumnsRenamed(meanwhile), sf_dir)
            return out.withColumnsRenamed({new: c for c, new in meanwhile.items()})

        return run

    return around


@spared("quality_score", "keep", "trained")
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go; without labels of both classes none do. Nulls in any column count as empty
    or as a value of their own; repeated rows share their fate; an empty table stays empty; texts count whole."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).where("keep").select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one with the smallest id stays; documents without words or id stay, and of rows that
    repeat an id one. Whole texts count; an empty table stays empty; further columns of any name are kept.

    What goes is looked up, not what stays: it is the smaller side."""
    similar = jaccard.similar_documents(docs.select("doc_id", "text"), k=SHINGLE, percent=SIMILAR).where("doc_id is not null")
    ids = similar.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.max(F.col("doc_id") == F.col("component_id")).alias("first"))
    ids = written(ids.where("rows > 1 or not first"), "pipeline-similar")
    kept = docs.join(ids.select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    repeated = docs.join(ids.where("first").select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    return kept.unionByName(repeated.dropDuplicates(["doc_id"]))


@spared("n_words", "hit_spans", "items")
def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten words in a row of a benchmark item, or a whole shorter one, go. Null text holds nothing; repeated rows
    share their fate; an empty table stays empty; texts count whole."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("hit_spans") == 0).select(*docs.columns)


@spared("row", "copies", "copy")
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Null text has no words, a null source is one of its own; repeated rows are documents
    of their own; an empty table stays empty; texts count whole."""
    rows = docs.withColumn("row", F.monotonically_increasing_id())
    copies = mixing.weighted_fair_mix(rows, keep=("row",)).where("copies > 0").select("row", "copies")
    mixed = rows.join(copies, "row").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return mixed.select(*docs.columns)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with its slot and shard, which take the place of columns of these names. A null id counts as the empty text;
    repeated rows share a shard; an empty table stays empty."""
    return sharding.shard(docs, SHARDS, size=SLOTS)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", benchmark_stage),
    ("mixing sources to target weights", mixing_stage),
    ("sharding", sharding_stage),
]

#: SQL can't express the classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
