"""Full-text search queries over documents and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search
from .registry import Registry, table

REG = Registry()
_TOKEN = r"[\p{L}\p{M}\p{N}_]+(?:[.''’][\p{L}\p{M}\p{N}_]+)*"
_TOKENS = f"regexp_extract_all(lower(text), '{_TOKEN}')"
_BASE = f"(SELECT doc_id AS id, source, lang, {_TOKENS} AS body, regexp_extract_all(lower(lang || ' ' || source), '{_TOKEN}') AS title FROM documents)"


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return search.index(docs.select(F.col("doc_id").alias("id"), F.concat(F.lit("/"), F.col("doc_id").cast("string")).alias("url"), F.concat_ws(" ", "lang", "source").alias("title"), F.lit(None).cast("string").alias("date"), F.col("text").alias("body"), F.lit("").alias("summary"), F.col("source").alias("category"), F.array("lang").alias("tags"), F.lit(1).alias("readingTime")))


def term(value: str) -> dict:
    return {"type": "term", "value": value}


def found(spark: SparkSession, sf_dir: str, node: dict) -> DataFrame:
    search.validate(node)
    return search.hits(corpus(spark, sf_dir), search.Request(expr=node)).select("id")


@REG(f"SELECT id FROM {_BASE} WHERE list_contains(body, 'this') OR list_contains(title, 'this')")
def search_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir, term("This"))


def _has(word: str) -> str:
    """A term may stand in any field."""
    return f"(list_contains(body, '{word}') OR list_contains(title, '{word}'))"


def _says(words: str) -> str:
    return "(" + " OR ".join(f"contains(' ' || array_to_string({f}, ' ') || ' ', ' {words} ')" for f in ("body", "title")) + ")"


@REG(f"SELECT id FROM {_BASE} WHERE {_says('of the')}")
def search_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir, {"type": "phrase", "value": "of The"})


@REG(f"""SELECT id FROM {_BASE} WHERE ({_has('this')} OR {_has('que')}) AND {_has('de')} AND NOT {_has('las')} AND NOT ({_says('de la')} AND lang = 'fr')""")
def search_bool_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    no = lambda n: {"type": "not", "node": n}
    both = {"type": "and", "nodes": [{"type": "phrase", "value": "de la"}, {"type": "field", "field": "tag", "value": "fr"}]}
    return found(spark, sf_dir, {"type": "and", "nodes": [{"type": "or", "nodes": [term("this"), term("que")]}, term("de"), no(term("las")), no(both)]})


@REG(f"SELECT id FROM {_BASE} WHERE {_has('thing')} OR NOT {_has('the')}")
def search_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a OR -b: all without b, and a."""
    return found(spark, sf_dir, {"type": "or", "nodes": [term("thing"), {"type": "not", "node": term("the")}]})


@REG(f"SELECT id FROM {_BASE} WHERE (list_contains(body, 'the') AND list_contains(body, 'src3')) OR (list_contains(title, 'the') AND list_contains(title, 'src3')) OR (list_contains(body, 'en') AND list_contains(body, 'src3')) OR (list_contains(title, 'en') AND list_contains(title, 'src3'))")
def search_flat_same_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of a flat request in one field: 'the src3' finds nothing, 'en src3' the titles."""
    table_ = corpus(spark, sf_dir)
    a, b = (search.predicate(search.request({"q": [q]})) for q in ("the src3", "en src3"))
    return table_.where(a | b).select("id")


@REG("SELECT doc_id AS id FROM documents WHERE source = 'src7' AND lang = 'en'")
def search_tag_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.hits(corpus(spark, sf_dir), search.request({"category": ["src7"], "tag": ["EN"]})).select("id")


def event_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    empty = F.lit("")
    return search.index(events.select(F.col("event_id").alias("id"), empty.alias("url"), F.col("event_type").alias("title"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("date"), empty.alias("body"), empty.alias("summary"), F.col("event_type").alias("category"), F.array().cast("array<string>").alias("tags"), F.lit(1).alias("readingTime")))


@REG("SELECT event_id AS id FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20'")
def search_date_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.hits(event_corpus(spark, sf_dir), search.request({"since": ["2024-01-10"], "until": ["2024-01-20"]})).select("id")


@REG("SELECT event_id AS id, strftime(ts, '%Y-%m-%d') AS date FROM events ORDER BY ts DESC, event_id LIMIT 25 OFFSET 50")
def search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of 25, newest first."""
    page, _ = search.search(event_corpus(spark, sf_dir), search.request({"per": ["25"], "page": ["3"]}))
    return page.select("id", "date")


@REG("SELECT event_type, count(*) AS total FROM events WHERE event_type IN (SELECT min(event_type) FROM events) GROUP BY 1")
def search_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of hits doesn't depend on the page."""
    kind = table(spark, sf_dir, "events").agg(F.min("event_type")).first()[0]
    return search.hits(event_corpus(spark, sf_dir), search.request({"category": [kind]})).groupBy(F.col("category").alias("event_type")).agg(F.count(F.lit(1)).alias("total"))
