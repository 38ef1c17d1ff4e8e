"""Queries over text, tags, links and times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, links, text
from ..operators import tagindex
from .registry import Registry, table

REG = Registry()
#: The word pattern and stop words for the oracles.
_WORD = r"[\p{L}][\p{L}\p{N}\p{M}_''’\-]*"
_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in text.STOP_WORDS)
_TAGS = f"""
    SELECT DISTINCT doc_id AS note_id, lower(regexp_replace(w, '^[-''’]+|[-''’]+$', '', 'g')) AS tag
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_WORD}')) AS w FROM documents)"""
_TAGS = f"SELECT * FROM ({_TAGS}) WHERE length(tag) >= 3 AND tag NOT IN ({_STOP})"
_SPACE = r"[ \t\n\r\x0b\x0c]+"
_WORDS = f"list_filter(regexp_split_to_array(text, '{_SPACE}'), lambda w: w <> '')"
_HOST = "split_part(split_part(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END, '/', 1), '?', 1)"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def note_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (note_id, tag) rows of the documents' words."""
    return documents(spark, sf_dir).select(F.col("doc_id").alias("note_id"), F.explode(text.word_tags(F.col("text"))).alias("tag"))


@REG("SELECT doc_id, sha256(text) AS sha256_hex, length(text) AS n FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("sha256_hex"), F.length("text").cast("long").alias("n"))


@REG()
def note_hash_sha512(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DuckDB has no SHA-512."""
    return documents(spark, sf_dir).select("doc_id", ids.note_hash(F.col("text")).alias("note_hash"))


@REG(f"SELECT tag, count(*) AS notes FROM ({_TAGS}) GROUP BY tag")
def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagindex.tag_counts(note_tags(spark, sf_dir))


@REG(f"""SELECT tag, count(*) AS notes FROM ({_TAGS}) WHERE note_id IN (SELECT min(doc_id) FROM documents GROUP BY sha256(text))
         GROUP BY tag ORDER BY notes DESC, tag LIMIT 20""")
def top_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of documents that differ, the lowest id stays; then the 20 tags that most of them have."""
    first = documents(spark, sf_dir).groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("note_id")).select("note_id")
    return tagindex.top_tags(note_tags(spark, sf_dir).join(first, "note_id", "left_semi"), 20)


@REG(f"""WITH t AS ({_TAGS}), top AS (SELECT tag FROM t GROUP BY tag ORDER BY count(*) DESC, tag
           LIMIT (SELECT greatest(200, least(5000, count(*) // 10)) FROM documents))
         SELECT note_id, count(*) AS demoted FROM t WHERE tag NOT IN (SELECT tag FROM top) GROUP BY note_id""")
def taxonomy_promote_demote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagindex.demoted_notes(note_tags(spark, sf_dir), tagindex.taxonomy_cap(documents(spark, sf_dir).count()))


_FNV = "list_reduce(list_prepend(2166136261::UBIGINT, list_transform(range(1, length(hex(encode(tag))) // 2 + 1), lambda i: ('0x' || substr(hex(encode(tag)), CAST(2 * i - 1 AS BIGINT), 2))::UBIGINT)), lambda a, b: (xor(a, b) * 16777619) & 4294967295)"


@REG(f"SELECT ({_FNV} & 4095)::INTEGER AS bucket, tag, array_to_string(list_sort(notes), ',') AS notes FROM (SELECT tag, list(note_id) AS notes FROM ({_TAGS}) GROUP BY tag)")
def tag_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagindex.postings(note_tags(spark, sf_dir)).withColumn("notes", F.array_join(F.transform("notes", lambda x: x.cast("string")), ","))


@REG(f"SELECT ({_FNV} & 4095)::INTEGER AS bucket, count(*) AS tags FROM (SELECT DISTINCT tag FROM ({_TAGS})) GROUP BY 1")
def tag_posting_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = note_tags(spark, sf_dir).select("tag").distinct()
    return tags.groupBy(ids.posting_bucket(F.col("tag")).alias("bucket")).agg(F.count(F.lit(1)).alias("tags"))


@REG("SELECT (doc_id // 512)::BIGINT AS chunk, count(*) AS notes, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY 1")
def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = tagindex.document_chunks(documents(spark, sf_dir), "doc_id").groupBy("chunk")
    return chunks.agg(F.count(F.lit(1)).alias("notes"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


@REG(f"SELECT note_id, array_to_string(list_sort(list(tag)), ' ') AS tags FROM ({_TAGS}) GROUP BY note_id")
def word_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = documents(spark, sf_dir).select(F.col("doc_id").alias("note_id"), text.word_tags(F.col("text")).alias("t"))
    return found.where(F.size("t") > 0).select("note_id", F.array_join("t", " ").alias("tags"))


@REG(f"SELECT doc_id, ceil(len({_WORDS}) / 213.0)::INTEGER AS minutes FROM documents")
def reading_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", text.reading_minutes(F.col("text")).alias("minutes"))


_TRIM = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@REG(f"""SELECT doc_id, CASE WHEN t = '' THEN 'Untitled' ELSE t END AS title FROM (
           SELECT doc_id, trim(ltrim(trim(split_part(trim(text, {_TRIM}), chr(10), 1), {_TRIM}), '# ' || chr(10) || chr(9) || '*`-'), {_TRIM}) AS t FROM documents)""")
def note_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", text.title_from_body(F.col("text")).alias("title"))


@REG(f"SELECT doc_id, substr(array_to_string({_WORDS}, ' '), 1, 700) AS summary FROM documents")
def summary_700(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", text.summary(F.col("text")).alias("summary"))


_HREFS = """SELECT page_id, unnest(regexp_extract_all(html, '(?i)[\\s/]href\\s*=\\s*"([^"]*)"', 1)) AS target FROM pages"""


@REG(f"SELECT page_id, target, count(*) AS n FROM ({_HREFS}) GROUP BY ALL")
def href_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "pages").where(F.col("html").contains("href")).select("page_id", F.explode(links.hrefs(F.col("html"))).alias("target"))
    return found.groupBy("page_id", "target").agg(F.count(F.lit(1)).alias("n"))


@REG(f"""SELECT page_id, array_to_string(list_slice(labels, i, len(labels)), '.') AS host FROM (
           SELECT page_id, labels, unnest(range(2, len(labels))) AS i FROM (SELECT page_id, string_split({_HOST}, '.') AS labels FROM pages) WHERE len(labels) > 2)""")
def host_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.explode(links.host_aliases(F.col("url"))).alias("host"))


_CLASS = r"""CASE WHEN target IS NULL OR target = '' OR starts_with(target, '#') OR starts_with(target, '//') THEN NULL
    WHEN regexp_matches(target, '^[A-Za-z]:[\\/]') THEN 'unreachable/drive-letter path' WHEN starts_with(target, '\\') THEN 'unreachable/UNC path'
    WHEN regexp_matches(target, '(?i)^(?::/[0-9a-f]{32}|(?:document|resource)://)') THEN 'unreachable/unresolved internal link'
    WHEN s = '' THEN 'unreachable/unresolved link' WHEN s = 'https' THEN NULL WHEN s = 'http' THEN 'insecure/http: link'
    WHEN s IN ('mailto', 'tel') THEN 'verify/' || s || ': link' WHEN s = 'data' THEN 'data/data: link' WHEN s = 'file' THEN 'unreachable/file: URL'
    ELSE 'unreachable/' || s || ': link' END"""
_LINKS = f"""SELECT page_id, target, lower(regexp_extract(target, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS s FROM (
    SELECT page_id, url AS target FROM pages UNION ALL SELECT * FROM ({_HREFS})
    UNION ALL SELECT page_id, unnest(['mailto:a@b.example', 'C:\\notes\\x.md', '\\\\host\\share', ':/0123456789abcdef0123456789abcdef', '#top', '//cdn.example/x', 'data:text/plain,x', 'file:///tmp/x', 'ftp://h/x', 'TEL:1']) FROM pages WHERE page_id < 5)"""
_SAMPLES = ["mailto:a@b.example", "C:\\notes\\x.md", "\\\\host\\share", ":/0123456789abcdef0123456789abcdef", "#top", "//cdn.example/x", "data:text/plain,x", "file:///tmp/x", "ftp://h/x", "TEL:1"]


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    samples = pages.where("page_id < 5").select("page_id", F.explode(F.array(*[F.lit(x) for x in _SAMPLES])).alias("target"))
    return pages.select("page_id", F.col("url").alias("target")).unionAll(pages.select("page_id", F.explode(links.hrefs(F.col("html"))))).unionAll(samples)


@REG(f"SELECT page_id, target, finding, count(*) AS n FROM (SELECT page_id, target, {_CLASS} AS finding FROM ({_LINKS})) WHERE finding IS NOT NULL GROUP BY ALL")
def link_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = page_links(spark, sf_dir).withColumn("f", links.classify_kept(F.col("target"))).where("f is not null")
    return found.groupBy("page_id", "target", F.concat_ws("/", "f.category", "f.reason").alias("finding")).agg(F.count(F.lit(1)).alias("n"))


@REG(f"SELECT split_part(finding, '/', 1) AS category, count(*) AS n FROM (SELECT {_CLASS} AS finding FROM ({_LINKS})) WHERE finding IS NOT NULL GROUP BY 1")
def insecure_link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_links(spark, sf_dir).select(links.classify_kept(F.col("target")).alias("f")).where("f is not null").groupBy("f.category").agg(F.count(F.lit(1)).alias("n"))


@REG(f"""SELECT page_id, CASE WHEN h = 'example.com' OR ends_with(h, '.example.com') THEN 'example.com' ELSE 'example.org' END AS domain
         FROM (SELECT page_id, rtrim(lower(split_part({_HOST}, '#', 1)), '.') AS h FROM pages)
         WHERE h = 'example.com' OR ends_with(h, '.example.com') OR h = 'example.org' OR ends_with(h, '.example.org')""")
def domain_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.split_part(links.host_of(F.col("url")), F.lit("#"), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", links.matched_domain(host, ["example.com", "example.org"]).alias("domain")).where("domain is not null")


@REG(r"SELECT page_id, len(regexp_extract_all(html, '(?i)<(script|style)[\s/>]')) AS n FROM pages")
def raw_text_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", links.raw_text_elements(F.col("html")).cast("long").alias("n"))


#: Literal rows for syntax that the tables don't hold.
_EMOJI = ("happy 😃 day", "😃😡😃", "none © ® here", "👍🏽 and 👍", "☀ sun")


@REG("SELECT k, array_to_string(list_distinct_in_order, '') AS emoji FROM (VALUES (0, ['😃']), (1, ['😃', '😡']), (2, []), (3, ['👍']), (4, ['☀'])) v(k, list_distinct_in_order)")
def emoji_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(list(enumerate(_EMOJI)), "k int, t string")
    return rows.select("k", F.array_join(text.emoji_symbols(F.col("t")), "").alias("emoji"))


@REG(r"""SELECT k, array_to_string(regexp_extract_all(t, '(?i)<img\b[^>]*?\bsrc\s*=\s*["'']?:/([0-9a-f]{32})', 1), ',') AS found, array_to_string(regexp_extract_all(t, '!?\[[^\]]*\]\(:/([0-9a-fA-F]{32})(?:\s+"[^"]*")?\)', 1), ',') AS linked
         FROM (VALUES (0, '<img alt=x src=":/0123456789abcdef0123456789abcdef">'), (1, '![a](:/ABCDEF0123456789abcdef0123456789) and [b](:/0123456789abcdef0123456789abcdef "t")'), (2, 'nothing')) v(k, t)""")
def html_image_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(0, '<img alt=x src=":/0123456789abcdef0123456789abcdef">'), (1, '![a](:/ABCDEF0123456789abcdef0123456789) and [b](:/0123456789abcdef0123456789abcdef "t")'), (2, "nothing")]
    out = spark.createDataFrame(rows, "k int, t string")
    return out.select("k", F.array_join(text.html_image_resources(F.col("t")), ",").alias("found"), F.array_join(text.resource_links(F.col("t")), ",").alias("linked"))


@REG("""SELECT k, mime FROM (VALUES (0, 'image/png'), (1, 'image/jpeg'), (2, 'image/gif'), (3, 'image/webp'), (4, 'image/avif'), (5, 'image/heic'), (6, 'image/bmp'),
        (7, 'image/tiff'), (8, 'image/svg+xml'), (9, 'image/vnd.microsoft.icon'), (10, NULL)) v(k, mime)""")
def magic_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = ["89504E470D0A1A0A00", "FFD8FFE000", "47494638396100", "524946460000000057454250", "000000206674797061766966", "000000206674797068656963", "424D00", "49492A000000000000000000", "EFBBBF3C3F786D6C3F3E3C7376673E", "0000010000", "00"]
    rows = spark.createDataFrame(list(enumerate(heads)), "k int, h string")
    return rows.select("k", links.sniff_mime(F.unhex("h")).alias("mime"))


@REG("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') AS iso, epoch_ms(o_orderdate) AS ms, strftime(o_orderdate, '%b %d, %Y') AS shown FROM orders""")
def timestamp_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times through their archive form `EEE MMM dd HH:mm:ss Z yyyy` and back, epoch milliseconds, and display."""
    orders = table(spark, sf_dir, "orders")
    raw = F.concat(F.lit("Wed "), F.date_format("o_orderdate", "MMM dd HH:mm:ss"), F.lit(" +0000 "), F.date_format("o_orderdate", "yyyy"))
    at = F.to_timestamp(F.substr(raw, F.lit(5)), "MMM dd HH:mm:ss Z yyyy")
    return orders.select("o_orderkey", F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("iso"), F.unix_millis(at).alias("ms"), F.date_format(at, "MMM dd, yyyy").alias("shown"))


@REG("""SELECT event_id, '[' || ltrim(strftime(ts, '%I:%M %p · %b %d, %Y'), '0') || '](https://x.com/i/web/status/' || event_id || ') 🔁 ' || format('{:,}', user_id) || ' 💙 ' || format('{:,}', event_id) AS footer FROM events""")
def tweet_footer(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.ltrim(F.date_format("ts", "hh:mm a · MMM dd, yyyy"), F.lit("0"))
    count = lambda c: F.format_number(F.col(c), 0)
    footer = F.concat(F.lit("["), shown, F.lit("](https://x.com/i/web/status/"), F.col("event_id").cast("string"), F.lit(") 🔁 "), count("user_id"), F.lit(" 💙 "), count("event_id"))
    return table(spark, sf_dir, "events").select("event_id", footer.alias("footer"))
