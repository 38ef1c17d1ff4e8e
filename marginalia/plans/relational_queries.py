"""Queries over the note table's maintenance, folders and import."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.links import ancestor_dirs as directories
from ..operators import graph, ingest, relational
from .registry import Registry, table

REG = Registry()


@REG("SELECT doc_id, sha256(text) AS note_hash FROM documents WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY sha256(text))")
def dedup_keep_min_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("note_hash"), F.lit("note").alias("kind"))
    return relational.drop_duplicate_notes(notes, id_col="doc_id", kind_col="kind").drop("kind")


@REG("SELECT sha256(text) AS note_hash, count(*) AS copies, min(doc_id) AS lowest_id, max(doc_id) AS highest_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.duplicate_groups(table(spark, sf_dir, "documents").withColumn("note_hash", F.sha2("text", 256)), "note_hash", "doc_id")


@REG("SELECT source, lang, count(*) AS n, coalesce(max(doc_id), 0) AS highest_id FROM documents GROUP BY source, lang")
def note_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("doc_id"), F.lit(0)).alias("highest_id"))


@REG("""SELECT conv_id, turn, (SELECT text FROM conversations p WHERE p.conv_id = c.conv_id ORDER BY p.turn LIMIT 1) AS note_folder FROM conversations c""")
def parent_title_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    children = turns.select("conv_id", "turn", F.lit(None).cast("string").alias("note_folder"))
    return relational.with_parent_title(children, turns, parent_key="conv_id", key="conv_id", title="text", order="turn")


@REG("SELECT o_custkey AS note, string_agg(p, ',' ORDER BY p) AS tags FROM (SELECT o_custkey, trim(o_orderpriority) AS p FROM orders WHERE trim(o_orderpriority) <> '') GROUP BY 1")
def note_tags_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as notes, orders as relations, priorities as tags; repeats stay."""
    orders = table(spark, sf_dir, "orders")
    relations = orders.select(F.col("o_custkey").alias("note"), F.trim("o_orderpriority").alias("tag"))
    tags = relations.select(F.col("tag").alias("key"), F.col("tag").alias("title")).distinct()
    lists = relational.tag_lists(relations, tags, note="note", tag="tag", key="key", title="title")
    return lists.select("note", F.array_join("tags", ",").alias("tags"))


def folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region > nation > customer as one folder table (id, parent_id, name)."""
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    region = table(spark, sf_dir, "region").select(text("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("name"))
    nation = table(spark, sf_dir, "nation").select(text("n", "n_nationkey"), text("r", "n_regionkey"), "n_name")
    return region.unionAll(nation).unionAll(table(spark, sf_dir, "customer").select(text("c", "c_custkey"), text("n", "c_nationkey"), "c_name"))


_FOLDERS = """SELECT 'r' || r_regionkey AS id, NULL::VARCHAR AS parent_id, r_name AS name FROM region
    UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name FROM customer"""


@REG(f"""WITH RECURSIVE f AS ({_FOLDERS}), d AS (SELECT id FROM f WHERE name = (SELECT min(r_name) FROM region) OR id = 'n3'
         UNION SELECT f.id FROM f JOIN d ON f.parent_id = d.id) SELECT id FROM d""")
def folder_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "region").agg(F.min("r_name")).first()[0]
    nation = table(spark, sf_dir, "nation").where("n_nationkey = 3").first()["n_name"]
    return graph.folder_closure(folders(spark, sf_dir), [first, nation], title="name")


@REG(f"""WITH RECURSIVE f AS ({_FOLDERS}), w AS (SELECT id, name AS path, 1 AS depth FROM f WHERE parent_id IS NULL
         UNION ALL SELECT f.id, w.path || '/' || f.name, w.depth + 1 FROM f JOIN w ON f.parent_id = w.id) SELECT id, path, depth FROM w""")
def folder_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.folder_paths(folders(spark, sf_dir))


@REG("""SELECT DISTINCT array_to_string(parts[1:i], '/') AS dir FROM (SELECT parts, unnest(range(1, len(parts))) AS i FROM (
          SELECT list_filter(string_split(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://', ''), '/'), lambda p: p <> '') AS parts FROM pages))""")
def ancestor_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), r"^[a-z]+://", "")
    return table(spark, sf_dir, "pages").select(F.explode(directories(path)).alias("dir")).distinct()


_CHAIN = """SELECT l_partkey AS id, min(l_suppkey) + 1000000 AS parent_id FROM lineitem GROUP BY 1
    UNION ALL SELECT s_suppkey + 1000000, CASE WHEN s_suppkey % 5 = 0 THEN s_suppkey + 1000000 WHEN s_suppkey % 5 = 1 THEN s_suppkey + 1000001 WHEN s_suppkey % 5 = 2 THEN s_suppkey + 999999 END FROM supplier"""


@REG(f"""WITH RECURSIVE t AS ({_CHAIN}), up(id, nxt, seen, fault) AS (SELECT id, parent_id, [id], NULL::VARCHAR FROM t WHERE parent_id IS NOT NULL
         UNION ALL SELECT u.id, t.parent_id, list_append(u.seen, t.id), CASE WHEN list_contains(u.seen, t.parent_id) OR t.parent_id = t.id THEN 'cycle' WHEN len(u.seen) >= 32 THEN 'depth' END
         FROM up u JOIN t ON t.id = u.nxt WHERE u.fault IS NULL AND u.nxt IS NOT NULL) SELECT DISTINCT id, fault FROM up WHERE fault IS NOT NULL""")
def cycle_depth_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts under suppliers; suppliers that are their own parent, or each other's."""
    return graph.chain_faults(chain(spark, sf_dir, table(spark, sf_dir, "lineitem")))


def chain(spark: SparkSession, sf_dir: str, lines: DataFrame) -> DataFrame:
    parts = lines.groupBy(F.col("l_partkey").alias("id")).agg((F.min("l_suppkey") + 1000000).alias("parent_id"))
    s = F.col("s_suppkey")
    up = F.when(s % 5 == 0, s + 1000000).when(s % 5 == 1, s + 1000001).when(s % 5 == 2, s + 999999)
    return parts.unionAll(table(spark, sf_dir, "supplier").select(s + 1000000, up))


_EDGES = """SELECT 'o' || l_orderkey AS src, 'p' || l_partkey AS dst FROM lineitem UNION SELECT 'p' || l_partkey, 's' || l_suppkey FROM lineitem
    UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation"""


@REG(f"""WITH RECURSIVE e AS ({_EDGES}), r AS (SELECT 'o' || o_orderkey AS id FROM orders
         UNION SELECT e.dst FROM e JOIN r ON e.src = r.id) SELECT id FROM r""")
def reachable_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all orders reach through their lines, parts' suppliers, nations and regions."""
    return reached(spark, sf_dir, table(spark, sf_dir, "orders"))


def reached(spark: SparkSession, sf_dir: str, orders: DataFrame) -> DataFrame:
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    lines = table(spark, sf_dir, "lineitem")
    edges = lines.select(key("o", "l_orderkey").alias("src"), key("p", "l_partkey").alias("dst")).unionAll(lines.select(key("p", "l_partkey"), key("s", "l_suppkey")).distinct())
    edges = edges.unionAll(table(spark, sf_dir, "supplier").select(key("s", "s_suppkey"), key("n", "s_nationkey"))).unionAll(table(spark, sf_dir, "nation").select(key("n", "n_nationkey"), key("r", "n_regionkey")))
    return graph.reachable(orders.select(key("o", "o_orderkey").alias("id")), edges)


@REG("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def dangling_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.dangling(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id", "doc_id").select("doc_id")


@REG("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def unreferenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.unreferenced(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey").select("o_orderkey")


@REG("""SELECT o_orderkey, c_custkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE (o_orderstatus = 'F') <> (c_mktsegment = 'BUILDING')""")
def ownership_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose status and owner's segment disagree."""
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.where((F.col("o_orderstatus") == "F") != (F.col("c_mktsegment") == "BUILDING")).select("o_orderkey", "c_custkey")


@REG("""WITH s AS (SELECT doc_id, list_sort(list(DISTINCT d)) AS ds FROM (SELECT doc_id, sha256(text) AS d FROM documents WHERE doc_id % 3 <> 0
           UNION ALL SELECT doc_id, sha256(text || 'x') FROM documents WHERE doc_id % 6 = 1) GROUP BY doc_id)
         SELECT i.doc_id, CASE WHEN s.doc_id IS NULL THEN 'new' WHEN ds = [sha256(text)] THEN 'skip' ELSE 'collision' END AS outcome FROM documents i LEFT JOIN s USING (doc_id)""")
def import_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents come in; two thirds are stored, some with a second content."""
    docs = table(spark, sf_dir, "documents")
    stored = docs.where("doc_id % 3 <> 0").select("doc_id", F.sha2("text", 256).alias("digest")).unionAll(docs.where("doc_id % 6 = 1").select("doc_id", F.sha2(F.concat("text", F.lit("x")), 256)))
    return ingest.classify(docs.select("doc_id", F.sha2("text", 256).alias("digest")), stored, key="doc_id", digest="digest").select("doc_id", "outcome")


@REG("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def in_run_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.duplicate_keys(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@REG("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def property_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bag as a property list in which the last of equal keys holds."""
    pairs = F.map_entries(F.from_json("props", "map<string,string>"))
    pairs = F.concat(F.transform(pairs, lambda p: F.struct(p["key"].alias("k"), F.lit("old").alias("v"))), F.transform(pairs, lambda p: F.struct(p["key"].alias("k"), p["value"].alias("v"))))
    return table(spark, sf_dir, "events").select("event_id", relational.last_values(pairs)["k"].alias("k"))


@REG("SELECT event_id, TRY_CAST(nullif(trim(json_extract_string(props, '$.k')), '') AS BIGINT) AS k, round(value, 3)::VARCHAR AS value FROM events")
def typed_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", relational.strict_long(F.get_json_object("props", "$.k")).alias("k"), F.round("value", 3).cast("string").alias("value"))


@REG("SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn)::INTEGER AS occurrence FROM conversations")
def occurrence_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.occurrence_number(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id", "role"], ["turn"])


@REG("""SELECT p_partkey, CASE WHEN n = 1 THEN p_name ELSE p_name || ' ' || n END AS unique_name
        FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_brand, lower(p_name) ORDER BY p_partkey) AS n FROM part)""")
def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = relational.unique_names(table(spark, sf_dir, "part"), directory=["p_brand"], name="p_name", order=["p_partkey"])
    return named.select("p_partkey", "unique_name")


@REG("""SELECT doc_id, CASE WHEN lag(h) OVER (ORDER BY doc_id) < h THEN 'rising' ELSE 'falling' END AS order_check FROM (SELECT doc_id, doc_id * 7919 % 1000 AS h FROM documents)""")
def order_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strictly rising keys by lag; the ids are dealt in ranges first, and each range looks back one row."""
    from ..operators.tagindex import with_prior

    rows = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") * 7919 % 1000).alias("h"))
    return with_prior(rows, ["doc_id", "h"], "h").select("doc_id", F.when(F.col("prior") < F.col("h"), "rising").otherwise("falling").alias("order_check"))


@REG("""SELECT doc_id, rn FROM (SELECT doc_id, (row_number() OVER (ORDER BY lower(lang), doc_id) - 1)::BIGINT AS rn FROM documents)""")
def scan_order_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids from 0 in scan order."""
    from ..operators.tagindex import ordered_ids

    return ordered_ids(table(spark, sf_dir, "documents").select(F.lower("lang").alias("l"), "doc_id"), ["l", "doc_id"], "rn").select("doc_id", "rn")


@REG("""SELECT c.conv_id, c.turn, coalesce(t.total, 0)::BIGINT AS earlier FROM conversations c LEFT JOIN (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS total FROM conversations) t USING (conv_id, turn)""")
def attachment_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each part begins in the whole that its parts make."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)).alias("earlier"))
