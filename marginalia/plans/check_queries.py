"""Queries through the checks, selections and reconciliations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..operators import checks
from .registry import Registry, table

REG = Registry()


def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as notes in their nations; nations with an even number are folders, the others tags."""
    kind = F.when(F.col("n_nationkey") % 2 == 0, schema.FOLDER).otherwise(schema.TAG)
    nations = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.lit("").alias("parent_id"), kind.alias("type_"))
    notes = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("parent_id"), F.lit(schema.NOTE).alias("type_"))
    return nations.unionByName(notes)


@REG("SELECT 'c' || c_custkey AS id FROM customer WHERE c_nationkey % 2 = 1 OR c_nationkey NOT IN (SELECT n_nationkey FROM nation)")
def misplaced_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.misplaced(staged(spark, sf_dir)).select("id")


@REG("""SELECT o_orderkey FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = o_orderkey % 30 WHERE c_custkey IS NULL OR n_nationkey IS NULL OR n_nationkey % 2 = 0""")
def broken_memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as relations of a customer and a tag."""
    relations = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("c"), "o_custkey").alias("note_id"), F.concat(F.lit("n"), F.col("o_orderkey") % 30).alias("tag_id"))
    return checks.broken_targets(relations, staged(spark, sf_dir), {"note_id": schema.NOTE, "tag_id": schema.TAG}).select("o_orderkey")


@REG("SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'O' AND l_quantity >= 50)")
def unreached_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that no open order names in a line of fifty."""
    refs = table(spark, sf_dir, "lineitem").where("l_quantity >= 50").select(F.col("l_orderkey").alias("owner"), F.col("l_partkey").alias("target"))
    owners = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("id"))
    return checks.unreached(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")), refs, owners)


@REG("""SELECT l_orderkey AS key, min(l_returnflag) AS source_title, min(l_linestatus) AS route_title FROM lineitem GROUP BY 1 HAVING count(*) = 1 AND min(l_linestatus) = upper(min(l_linestatus)) AND min(l_returnflag) <> min(l_linestatus)""")
def title_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of one line: the flag on one side, the status, as pinned, on the other."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_returnflag").alias("title"), F.upper("l_linestatus").alias("pinned"), "l_linestatus")
    return checks.title_rule_matches(lines, lines.select("key", F.col("l_linestatus").alias("title")), key="key", title="title", pinned="pinned")


@REG("""SELECT d.doc_id AS id, md5(coalesce(text, '')) AS body, source, coalesce(tags, '') AS tags FROM documents d LEFT JOIN (SELECT doc_id, string_agg(tag, ',' ORDER BY tag) AS tags FROM (SELECT doc_id, 'q' || quality AS tag FROM labels UNION SELECT doc_id, 't' || toxic FROM labels) GROUP BY 1) l ON l.doc_id = d.doc_id WHERE source IS NOT NULL""")
def producer_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their revision, source and the tags of their labels."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    tags = labels.select(F.col("doc_id").alias("id"), F.explode(F.array(F.concat(F.lit("q"), "quality"), F.concat(F.lit("t"), "toxic"))).alias("tag"))
    rows = checks.producer_rows(docs.select(F.col("doc_id").alias("id"), F.concat(F.lit("r"), "doc_id").alias("revision_id")), docs.select(F.concat(F.lit("r"), "doc_id").alias("revision_id"), F.md5(F.coalesce("text", F.lit(""))).alias("body")), docs.where("source is not null").select(F.col("doc_id").alias("id"), "source"), tags)
    return rows.select("id", "body", "source", F.array_join("tags", ",").alias("tags"))


@REG("""SELECT CASE WHEN l_tax > 0.05 THEN 'tax' WHEN l_discount > 0.05 THEN 'discount' ELSE 'quantity' END AS name, count(*) AS cases FROM lineitem WHERE l_tax > 0.05 OR l_discount > 0.05 OR l_quantity > 40 GROUP BY 1""")
def first_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by the first of three checks that refuses them."""
    tests = (("tax", F.col("l_tax") > 0.05), ("discount", F.col("l_discount") > 0.05), ("quantity", F.col("l_quantity") > 40))
    rows = table(spark, sf_dir, "lineitem").withColumn("key", F.monotonically_increasing_id())
    rows = rows.select("key", F.explode(F.array(*[F.struct(F.lit(i).alias("nth"), F.lit(n).alias("name"), t.alias("failed")) for i, (n, t) in enumerate(tests)])).alias("c")).select("key", "c.*")
    return checks.refusal_census(rows, key="key", order="nth", name="name", failed="failed")


@REG("SELECT count(DISTINCT t)::BIGINT AS n FROM (SELECT lang AS t FROM documents UNION SELECT source FROM documents)")
def explicit_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.distinct_tags(table(spark, sf_dir, "documents").select(F.array("lang", "source").alias("tags")))


_PATH = "o_orderpriority || '/' || CASE WHEN o_orderkey % 2 = 0 THEN upper(o_orderstatus) ELSE lower(o_orderstatus) END || o_custkey || '.md'"


@REG(f"""WITH p AS (SELECT o_orderkey, {_PATH} AS path FROM orders), n AS (SELECT *, row_number() OVER (PARTITION BY lower(path) ORDER BY o_orderkey) AS nth FROM p),
         m AS (SELECT *, row_number() OVER (PARTITION BY path, nth > 1 ORDER BY nth) AS again FROM n)
         SELECT o_orderkey, CASE WHEN nth = 1 THEN path ELSE regexp_replace(path, '[.]md$', '') || '-' || substr(sha256(path), 1, 12) || CASE WHEN again > 1 THEN '-' || again ELSE '' END || '.md' END AS output_path FROM m""")
def output_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' paths by priority, status in either case and customer."""
    status = F.when(F.col("o_orderkey") % 2 == 0, F.upper("o_orderstatus")).otherwise(F.lower("o_orderstatus"))
    paths = table(spark, sf_dir, "orders").select("o_orderkey", F.concat("o_orderpriority", F.lit("/"), status, F.col("o_custkey").cast("string"), F.lit(".md")).alias("path"))
    return checks.output_paths(paths, path="path", order=["o_orderkey"]).select("o_orderkey", "output_path")


@REG("SELECT doc_id AS id FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 100")
def bounded_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred documents that aren't deleted, which all but English ones are."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("lang") != "en", F.lit("2024-01-01")).alias("deleted_at"), "lang")
    return checks.first_live(docs.where("lang is not null"), 100).select("id")


@REG("SELECT n_name AS id FROM nation UNION SELECT r_name FROM region UNION SELECT c_mktsegment FROM customer")
def selected_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda t, c: table(spark, sf_dir, t).select(F.col(c).alias("id"))
    return checks.selected_ids(pick("nation", "n_name"), pick("region", "r_name"), pick("customer", "c_mktsegment"))


@REG("""SELECT p_partkey AS page, p_size AS target, replace(lower(p_type), ' ', '-') AS anchor FROM part WHERE NOT EXISTS (SELECT 1 FROM part h WHERE h.p_size = part.p_size AND h.p_type = part.p_type AND h.p_retailprice > 995)""")
def broken_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts link to the heading of their type on the page of their size; dear parts alone make headings."""
    parts = table(spark, sf_dir, "part")
    links = parts.select(F.col("p_partkey").alias("page"), F.col("p_size").alias("target"), checks.anchor(F.col("p_type")).alias("anchor"))
    return checks.broken_anchors(links, parts.where("p_retailprice > 995").select(F.col("p_size").alias("page"), F.col("p_type").alias("heading"))).select("page", "target", "anchor")


@REG("""SELECT c_custkey AS key, 'missing' AS side FROM customer WHERE c_custkey NOT IN (SELECT o_orderkey FROM orders) UNION SELECT o_orderkey, 'unregistered' FROM orders WHERE o_orderkey NOT IN (SELECT c_custkey FROM customer)""")
def reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' numbers against orders' numbers."""
    return checks.reconciled(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key")), "key")


@REG("SELECT doc_id FROM documents WHERE coalesce(lower(lang) = 'fr', false) OR coalesce(lower(source) = 'src3', false)")
def origin_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Either of two places of the metadata says where a document comes from."""
    bag = F.create_map(F.lit("language"), F.upper("lang"), F.lit("source"), F.col("source"))
    return table(spark, sf_dir, "documents").where(checks.from_origin(bag, {"language": "FR", "source": "src3", "other": "x"})).select("doc_id")


@REG("SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents")
def digest_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An older table has digests of a part of its rows; the rest get theirs."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    old = table(spark, sf_dir, "documents").select("doc_id", text.alias("raw"), F.when(F.col("lang") == "en", F.unhex(F.sha2(text, 256))).alias("digest"))
    return checks.backfilled(old, "raw", "digest").select("doc_id", F.lower(F.hex("digest")).alias("digest"))
