"""Queries that compare two datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compare
from .registry import Registry, table

REG = Registry()


def halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents with an even and an odd id, as (id, hash)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"), "source")
    return docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")


_EVEN, _ODD = (f"(SELECT doc_id, sha256(text) AS hash, source FROM documents WHERE doc_id % 2 = {k})" for k in (0, 1))


@REG("""SELECT (SELECT count(*) FROM documents) AS left_rows, (SELECT count(DISTINCT doc_id) FROM documents) AS left_keys, 0::BIGINT AS left_repeats,
        (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS missing, (SELECT count(*) FROM labels) AS right_rows, (SELECT count(DISTINCT doc_id) FROM labels) AS right_keys,
        (SELECT count(*) - count(DISTINCT doc_id) FROM labels) AS right_repeats, (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS extra""")
def identity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.identity_summary(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@REG(f"SELECT count(*) AS matches FROM (SELECT hash FROM {_EVEN} INTERSECT ALL SELECT hash FROM {_ODD})")
def multiset_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.multiset_matches(*halves(spark, sf_dir), "hash")


@REG(f"SELECT count(*) AS matches FROM (SELECT hash, source FROM {_EVEN} INTERSECT ALL SELECT hash, source FROM {_ODD})")
def whole_row_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = halves(spark, sf_dir)
    return compare.whole_row_matches(a.select("hash", "source"), b)


@REG(f"""SELECT hash, left_id, right_id FROM (SELECT hash, min(doc_id) AS left_id FROM {_EVEN} GROUP BY 1 HAVING count(*) = 1) JOIN (SELECT hash, min(doc_id) AS right_id FROM {_ODD} GROUP BY 1 HAVING count(*) = 1) USING (hash)""")
def one_to_one_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.one_to_one(*halves(spark, sf_dir), "hash", "doc_id", "doc_id")


@REG(f"""SELECT source, sum(n)::BIGINT AS left_rows, sum(n * coalesce(m, 0))::BIGINT AS pairs FROM (SELECT source, hash, count(*) AS n FROM {_EVEN} GROUP BY ALL) LEFT JOIN (SELECT hash, count(*) AS m FROM {_ODD} GROUP BY 1) USING (hash)
         GROUP BY source HAVING sum(n) <> 1 OR sum(n * coalesce(m, 0)) <> 1""")
def ambiguous_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = halves(spark, sf_dir)
    return compare.ambiguous(a, b, "source", "hash")


@REG("""SELECT count(*) FILTER (l = r) AS equal, count(*) FILTER (l <> r AND r = p) AS explained, count(*) FILTER (l <> r AND r <> p) AS unexplained, count(*) FILTER (l <> r AND r <> p) = 0 AS semantic_equal
        FROM (SELECT sha256(text) AS l, CASE WHEN doc_id % 10 = 3 THEN sha256(text || '!') WHEN doc_id % 50 = 7 THEN sha256(text || '?') ELSE sha256(text) END AS r, sha256(text || '!') AS p FROM documents)""")
def explained_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second route that changes some texts as pinned and some otherwise."""
    h = lambda s: F.sha2(F.concat("text", F.lit(s)), 256)
    changed = F.when(F.col("doc_id") % 10 == 3, h("!")).when(F.col("doc_id") % 50 == 7, h("?")).otherwise(h(""))
    pairs = table(spark, sf_dir, "documents").select(h("").alias("l"), changed.alias("r"), h("!").alias("p"))
    return compare.explained(pairs, "l", "r", "p")


@REG(f"""SELECT *, 'left' AS side FROM (SELECT hash FROM {_EVEN} EXCEPT ALL SELECT hash FROM {_ODD}) UNION ALL SELECT *, 'right' FROM (SELECT hash FROM {_ODD} EXCEPT ALL SELECT hash FROM {_EVEN})""")
def inventory_except_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = halves(spark, sf_dir)
    return compare.inventory_difference(a.select("hash"), b)


@REG("SELECT lang, source, sha256(string_agg(h, chr(10) ORDER BY h)) AS digest FROM (SELECT lang, source, sha256(text) AS h FROM documents) GROUP BY ALL")
def set_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of each group's set of texts. Digests of digests keep a group's list small: 64 signs a text."""
    from ..functions.ids import set_digest as digest

    docs = table(spark, sf_dir, "documents").select("lang", "source", F.sha2("text", 256).alias("h"))
    return docs.groupBy("lang", "source").agg(digest(F.collect_list("h")).alias("digest"))


_ROW = "sha256(concat_ws(chr(31), c_custkey::VARCHAR, c_name, c_nationkey::VARCHAR, c_mktsegment))"
_PART = ", ".join(f"coalesce(sum(('0x' || substr(d, {1 + 15 * k}, 15))::HUGEINT), 0)::VARCHAR" for k in range(4))


@REG(f"SELECT count(*) AS n, sha256(concat_ws(',', {_PART})) AS digest FROM (SELECT {_ROW} AS d FROM customer)")
def table_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.table_fingerprint(table(spark, sf_dir, "customer"), ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])
