"""Queries through the operators of the note model, the import and the publication checks, on rows made of the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..operators import graph, ingest, model, relational
from ..sources import publications, raw_items
from .registry import Registry, table

REG = Registry()
_HEX = "md5('{0}' || {1})"


def hexed(kind: str, key: str) -> Column:
    return F.md5(F.concat(F.lit(kind), F.col(key).cast("string")))


def raw_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as items: the text, an empty line and properties, one of them twice."""
    text = F.concat_ws("\n", F.col("text"), F.lit(""), F.concat(F.lit("id: "), hexed("d", "doc_id")), F.lit("source_url: first"), F.concat(F.lit("source_url: "), "source"), F.lit("type_: 1"))
    docs = table(spark, sf_dir, "documents").where("text is not null and source is not null")
    return raw_items.parse(docs.select(F.concat(F.col("doc_id").cast("string"), F.lit(".MD")).alias("name"), F.encode(text, "UTF-8").alias("raw")))


@REG("""SELECT md5('d' || doc_id) AS id, 'note' AS note_type, source AS source_url, md5(text || chr(10)) AS body, 4::INTEGER AS n_properties FROM documents WHERE text IS NOT NULL AND source IS NOT NULL""")
def raw_item_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Body and properties come apart, and the last of equal names holds."""
    return raw_documents(spark, sf_dir).select("id", "note_type", "source_url", F.md5(F.encode("body", "UTF-8")).alias("body"), F.size("properties").alias("n_properties"))


@REG("""SELECT md5('d' || doc_id) AS id, md5(text || chr(10) || chr(10) || 'id: ' || md5('d' || doc_id) || chr(10) || 'source_url: first' || chr(10) || 'source_url: moved' || chr(10) || 'type_: 1') AS bytes
        FROM documents WHERE text IS NOT NULL AND source IS NOT NULL""")
def raw_item_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A changed property is written at its last place, all else as it was."""
    return raw_items.serialised(raw_documents(spark, sf_dir), {"source_url": F.lit("moved")}).select("id", F.md5("bytes").alias("bytes"))


@REG("""SELECT title, depth, count(*) AS folders FROM (SELECT DISTINCT source AS title, 1 AS depth, source AS dir FROM documents WHERE source IS NOT NULL UNION SELECT DISTINCT lang, 2, source || '/' || lang FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL) GROUP BY ALL""")
def folder_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("source is not null and lang is not null")
    paths = docs.select(F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("path"))
    return model.folder_rows(paths, "ns").groupBy("title", "depth").agg(F.count(F.lit(1)).alias("folders"))


@REG("""SELECT title, count(*) AS notes FROM (SELECT DISTINCT doc_id, lang AS title FROM documents WHERE lang IS NOT NULL UNION SELECT DISTINCT doc_id, source FROM documents WHERE source IS NOT NULL) GROUP BY 1""")
def tag_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags that differ in nothing, or are blank, count once or not at all."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.array_compact(F.array("lang", "source", "lang", F.lit(" "))).alias("tags"))
    tags, relations = model.tag_rows(docs, "ns")
    return relations.join(tags.select(F.col("id").alias("tag_id"), "title"), "tag_id").groupBy("title").agg(F.count(F.lit(1)).alias("notes"))


@REG("""SELECT n AS title, n IN (SELECT r_name FROM region) AS is_new, CASE WHEN n NOT IN (SELECT r_name FROM region) THEN (SELECT md5('n' || min(n_nationkey)) FROM nation WHERE n_name = n) END AS stored
        FROM (SELECT n_name AS n FROM nation UNION SELECT r_name FROM region)""")
def folder_find_or_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    items = nations.select(F.col("n_nationkey").alias("note_id"), hexed("n", "n_nationkey").alias("id"), F.col("n_name").alias("title"), F.lit(schema.FOLDER).alias("type_"))
    wanted = nations.select(F.col("n_name").alias("title")).union(regions.select("r_name")).distinct()
    return model.find_or_create_folder(items, wanted, "ns").select("title", "is_new", F.when(~F.col("is_new"), F.col("id")).alias("stored"))


@REG("SELECT l_orderkey, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) ELSE 'mixed' END AS l_returnflag FROM lineitem GROUP BY 1")
def single_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.single_candidate(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag", F.lit("mixed"))


@REG("""SELECT l_suppkey AS note_id, l_quantity AS ordinal, l_returnflag AS kind, l_partkey AS resource_id FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity, l_returnflag, l_partkey) AS n FROM lineitem) WHERE n = 1""")
def first_attachment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each supplier the line of least quantity, flag and part."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("note_id"), F.col("l_quantity").alias("ordinal"), F.col("l_returnflag").alias("kind"), F.col("l_partkey").alias("resource_id"))
    return model.first_attachment(lines)


@REG("""SELECT l_orderkey AS note, l_linenumber AS start, CASE WHEN s_acctbal > 5000 THEN 'converted' WHEN s_nationkey < 10 THEN 'failed' ELSE 'untried' END AS outcome FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey""")
def localised_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines are images, suppliers the resources of their destinations."""
    images = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("note"), F.col("l_linenumber").alias("start"), F.col("l_suppkey").alias("destination"))
    known = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("destination"), F.when(F.col("s_acctbal") > 5000, hexed("s", "s_suppkey")).alias("resource_id"), F.when(F.col("s_nationkey") < 10, F.lit("status")).alias("problem"))
    return model.localised_images(images, known).select("note", "start", "outcome")


_ATTACHED = "SELECT DISTINCT l_orderkey AS note_id, md5('p' || l_partkey) AS resource_id FROM lineitem WHERE l_partkey {0} IN (SELECT p_partkey FROM part WHERE p_size > 10)"


def linked_notes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as notes that link to their parts, in upper case now and then; larger parts are there."""
    part = F.when(F.col("l_linenumber") > 2, F.upper(hexed("p", "l_partkey"))).otherwise(hexed("p", "l_partkey"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat(F.lit("[part](:/"), part, F.lit(")")).alias("link"))
    notes = lines.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_join(F.collect_list("link"), " and ").alias("body"))
    return model.reachable_attachments(notes, table(spark, sf_dir, "part").where("p_size > 10").select(F.upper(hexed("p", "p_partkey")).alias("id")))


@REG(_ATTACHED.format(""))
def attachments_there(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_notes(spark, sf_dir)[0]


@REG(_ATTACHED.format("NOT"))
def attachments_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_notes(spark, sf_dir)[1]


@REG("""SELECT md5('n' || n_nationkey) AS id FROM nation WHERE n_regionkey < 2 UNION SELECT md5('r' || n_regionkey) FROM nation WHERE n_regionkey < 2 UNION SELECT md5('s' || s_suppkey) FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey < 2""")
def dependency_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations are notes that refer to their regions, suppliers relations that nations own: what the nations of two regions need."""
    entry = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    item = lambda df, own, kind, *more: df.select(own.alias("id"), F.lit(kind).alias("type_"), F.array(entry("id", own), *more).alias("properties"))
    nations = table(spark, sf_dir, "nation")
    items = item(nations, hexed("n", "n_nationkey"), schema.NOTE, entry("source", hexed("r", "n_regionkey")))
    items = items.unionByName(item(table(spark, sf_dir, "region"), hexed("r", "r_regionkey"), schema.TAG)).unionByName(item(table(spark, sf_dir, "supplier"), hexed("s", "s_suppkey"), schema.RELATION, entry("note_id", hexed("n", "s_nationkey"))))
    return model.dependency_closure(items, nations.where("n_regionkey < 2").select(hexed("n", "n_nationkey").alias("id"))).select("id")


@REG("""SELECT conv_id, turn, CASE WHEN n = 1 THEN 'new' WHEN role = first THEN 'skip' ELSE 'collision' END AS outcome FROM (SELECT *, row_number() OVER w AS n, first_value(role) OVER w AS first FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))""")
def in_run_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.first_in_run(table(spark, sf_dir, "conversations"), key="conv_id", digest="role", order=["turn"]).select("conv_id", "turn", "outcome")


@REG("""SELECT o_orderkey, CASE WHEN n IS NULL THEN 'new' WHEN list_contains(flags, o_orderstatus) THEN 'skip' ELSE 'collision' END AS outcome
        FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, list(DISTINCT l_linestatus) AS flags FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def import_classify_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An item skips if its digest is one of those stored."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("digest"))
    stored = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linestatus").alias("digest"))
    return ingest.classify(orders, stored, key="o_orderkey", digest="digest", any_of=True).select("o_orderkey", "outcome")


@REG("SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def import_new_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers come in twice; those whose numbers are suppliers' too are stored."""
    own = table(spark, sf_dir, "customer").select("c_custkey", hexed("c", "c_custkey").alias("digest"))
    stored = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"), hexed("c", "s_suppkey").alias("digest"))
    return ingest.new_items(own.union(own), stored, key="c_custkey", digest="digest", order=["digest"]).select("c_custkey")


@REG("SELECT n_nationkey AS id, CASE WHEN n_regionkey = 1 THEN lower(n_name) ELSE n_name END AS name FROM nation UNION ALL SELECT r_regionkey + 1000, r_name FROM region")
def merge_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), "n_regionkey")
    changes = nations.where("n_regionkey = 1").select(F.lower("name").alias("name"), "id").unionByName(table(spark, sf_dir, "region").select((F.col("r_regionkey") + 1000).alias("id"), F.col("r_name").alias("name")))
    return ingest.merge(nations.select("id", "name"), changes, "id")


@REG("SELECT o_orderkey AS owner, o_custkey AS target FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)")
def publication_graph_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose customer isn't among those published."""
    refs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("owner"), F.lit("o_custkey").alias("column"), F.lit("customer").alias("kind"), F.col("o_custkey").alias("target"))
    ids = table(spark, sf_dir, "customer").where("c_acctbal >= 0").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"))
    return publications.graph_faults(refs, ids).select("owner", "target")


@REG("""SELECT sha256(text) AS sha256, CASE WHEN count(*) > 1 THEN 'repeated' ELSE 'size' END AS fault FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1 OR min(n_chars) < 100""")
def publication_index_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the texts' hashes, their size less a hundred: copies repeat an entry, short texts have a bad size."""
    entries = table(spark, sf_dir, "documents").where("text is not null").select(F.sha2("text", 256).alias("sha256"), (F.col("n_chars") - 100).alias("size_bytes"))
    return publications.index_faults(entries)


@REG("""WITH f AS (SELECT l_orderkey AS object, l_returnflag AS type, count(*) AS found, count(*) FILTER (l_tax < 0.05) AS declared FROM lineitem GROUP BY 1, 2)
        SELECT object::VARCHAR AS object, type, nullif(declared, 0) AS declared, found FROM f WHERE declared <> found""")
def publication_count_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are objects, lines their records by flag; only lines of low tax are declared."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("object"), F.col("l_returnflag").alias("type"), "l_tax")
    counts = lines.where("l_tax < 0.05").groupBy("object", "type").count().groupBy(F.col("object").alias("sha256")).agg(F.map_from_entries(F.collect_list(F.struct("type", "count"))).alias("record_counts"))
    return publications.count_faults(lines, counts).select("object", "type", "declared", "found")


@REG("""SELECT l_orderkey AS owner, l_partkey AS sha256 FROM lineitem LEFT JOIN part ON p_partkey = l_partkey WHERE p_partkey IS NULL OR l_returnflag <> 'R' OR l_linenumber <> p_size""")
def publication_blob_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("owner"), F.col("l_partkey").alias("sha256"), F.col("l_returnflag").alias("kind"), F.col("l_linenumber").alias("size_bytes"))
    objects = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sha256"), F.lit("R").alias("kind"), F.col("p_size").alias("size_bytes"))
    return publications.blob_faults(refs, objects).select("owner", "sha256")


@REG("""SELECT key, min(id) AS id FROM (SELECT c_mktsegment AS key, c_custkey AS id FROM customer UNION SELECT c_name, c_custkey FROM customer) GROUP BY 1 HAVING count(DISTINCT id) = 1""")
def disjunctive_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and segments that stand for one customer alone."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_name", "c_mktsegment")
    keys = customers.select(F.explode(F.array("c_name", "c_mktsegment")).alias("key")).distinct()
    return relational.disjunctive_lookup(keys, customers, "key", ["c_name", "c_mktsegment"], "id")


@REG("""SELECT c_custkey AS url, coalesce(c.final, CASE WHEN s_suppkey IS NOT NULL THEN s_nationkey ELSE c_custkey END) AS final FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey LEFT JOIN (SELECT NULL AS final) c ON false""")
def redirect_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hop: customers' numbers lead to the nation of the supplier of that number; a repeated hop changes nothing."""
    hops = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("src"), F.col("s_nationkey").cast("long").alias("dst"))
    return graph.redirect_ends(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("url")), hops.union(hops), most=1)
