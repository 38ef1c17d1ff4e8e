"""The pipeline's stages against brute force, on the smallest tables."""

from __future__ import annotations

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipe
from marginalia.llm import quality, sharding
from tests.llm.test_operators import brute_components, brute_hits

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    extra = docs.where("doc_id < 3").unionByName(docs.limit(1).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), "lang", F.lit(None).cast("string").alias("source"), "n_chars"))
    docs = docs.unionByName(extra)
    for name, stage in pipe.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / "out")
        stage(spark, docs, SF).write.parquet(path)
        out.append((name, docs, spark.read.parquet(path)))
        docs = out[-1][2]
    return {name: (before, after) for name, before, after in out}


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_columns_and_order(steps):
    assert [n for n, _ in pipe.STAGES] == list(steps)
    for name, (before, after) in steps.items():
        assert after.columns == before.columns + (["slot", "shard"] if name == "sharding" else [])
        assert after.count() > 100


def test_quality_stage(spark, steps):
    before, after = steps["quality classifier"]
    want = quality.score(before, quality.train(before, spark.read.parquet(f"{SF}/labels.parquet"))).where("keep")
    assert collections.Counter(pairs(after)) == collections.Counter(pairs(want))
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {d for d, _ in pairs(after)}
    assert sum((d in kept) == bool(q) for d, q in labels.items()) / len(labels) > 0.97


def test_near_duplicate_stage(steps):
    before, after = steps["n-gram Jaccard join"]
    rows = pairs(before)
    first = {d for d, _, c in brute_components(rows, pipe.SHINGLE, pipe.SIMILAR) if d == c and d is not None}
    assert collections.Counter(d for d, _ in pairs(after)) == collections.Counter([*first, *[d for d, _ in rows if d is None]])


def test_benchmark_stage(spark, steps):
    before, after = steps["benchmark decontamination"]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [d for (d, *_, bad), n in brute_hits(pairs(before), items, 10).items() if not bad for _ in range(n)]
    assert collections.Counter(clean) == collections.Counter(d for d, _ in pairs(after))


def test_mixing_and_sharding_stages(steps):
    before, after = steps["mixing sources to target weights"]
    texts, mixed = dict(pairs(before)), collections.Counter(pairs(after))
    assert all(n <= 3 and texts[d] == t for (d, t), n in mixed.items())
    size = lambda df: sum(len((t or "").split()) for _, t in pairs(df))
    assert abs(size(after) - size(before)) < 0.05 * size(before)
    before, after = steps["sharding"]
    assert collections.Counter(pairs(before)) == collections.Counter(pairs(after))
    table = sharding.lookup_table(pipe.SHARDS, pipe.SLOTS)
    assert all(r["shard"] == pipe.SHARDS[table[r["slot"]]] for r in after.collect())


def test_columns_of_any_name_and_empty_tables(spark):
    """Columns that bear the names which stages make come back unchanged, and an empty table stays one."""
    names = ["keep", "trained", "n_words", "items", "row", "copies", "copy", "rows", "first", "component_id", "cls", "key"]
    rows = [(i, f"alpha beta {i} gamma delta epsilon zeta eta theta " * 3, "en", "s", 9, *[f"{c}{i}" for c in names]) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in names))
    for name, stage in pipe.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert all(r[c] == f"{c}{r['doc_id']}" for r in out.collect() for c in names), name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
