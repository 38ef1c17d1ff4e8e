"""Vaults (folders of Markdown files), attachments and stop words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scanners, text
from ..operators.tagindex import ordered_ids

#: Folders that a site leaves out.
IGNORED = (".git", ".hg", ".svn", ".obsidian", ".trash", ".Trash", "node_modules")

BATCH = 1000


def _relative(path: Column, root: str) -> Column:
    clean = F.regexp_replace(path, r"^[a-z]+:/+", "/")
    return F.substr(clean, F.lit(len(root) + 2))


def all_files(spark: SparkSession, root: str, bundle: str | None = None) -> DataFrame:
    """path, size, raw of every file below root but those in its folder `bundle`.

    Spark's file index skips what has a leading dot or underscore. Folders of such names are read by the paths of their files; the
    files of such names, few as a rule, are read on the driver, BATCH at a time."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(conf)
    base = fs.makeQualified(top).toUri().getPath().rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    inside, named, listing = [], [], fs.listFiles(top, True)
    while listing.hasNext():
        where = listing.next().getPath()
        parts = where.toUri().getPath()[len(base) + 1 :].split("/")
        if parts[-1][:1] in "._":
            named.append(where)
        elif any(p[:1] in "._" for p in parts):
            inside.append(where.toString())
    for at in range(0, len(inside), BATCH):
        found = found.unionByName(spark.read.format("binaryFile").load(inside[at : at + BATCH]))
    out = found.select(_relative(F.col("path"), base).alias("path"), F.col("length").alias("size"), F.col("content").alias("raw"))
    for at in range(0, len(named), BATCH):
        rows = []
        for where in named[at : at + BATCH]:
            stream = fs.open(where)
            raw = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
            stream.close()
            rows.append((where.toUri().getPath()[len(base) + 1 :], len(raw), bytearray(raw)))
        out = out.unionByName(spark.createDataFrame(rows, "path string, size long, raw binary"))
    return out if bundle is None else out.where(~F.col("path").startswith(f"{bundle}/"))


def visible(files: DataFrame, include_hidden: bool = False) -> DataFrame:
    """Files of which no folder is ignored and, unless asked for, no part is hidden."""
    parts = F.split("path", "/")
    keep = ~F.exists(parts, lambda p: p.isin(*IGNORED))
    return files.where(keep if include_hidden else keep & ~F.exists(parts, lambda p: p.startswith(".")))


def is_markdown(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(md|markdown)$")


def notes(files: DataFrame, stop_words: Column | None = None) -> DataFrame:
    """note_id from 0 in scan order, path, frontmatter (JSON), body, prose, title, explicit and all tags, urls, reading minutes, summary."""
    own = files.where(is_markdown(F.col("path"))).withColumn("whole", F.decode("raw", "UTF-8"))
    own = own.withColumn("frontmatter", scanners.frontmatter_json("whole")).withColumn("body", scanners.body_of("whole"))
    own = own.withColumn("prose", scanners.prose(F.col("body"))).withColumn("links", scanners.found_links(F.col("body")))
    urls = F.array_distinct(F.transform(F.filter("links", lambda x: x["target"].rlike("(?i)^https?://")), lambda x: x["target"]))
    tags = F.transform(F.from_json(F.get_json_object("frontmatter", "$.tags"), "array<string>"), lambda t: F.lower(F.ltrim(F.trim(t), F.lit("#"))))
    explicit = text.explicit_tags(F.col("prose"), F.coalesce(tags, F.array().cast("array<string>")))
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    heading = F.regexp_extract("body", r"(?m)\A\s*#[ \t]+(.+?)[ \t]*#*[ \t]*$", 1)
    own = own.withColumn("title", F.coalesce(F.get_json_object("frontmatter", "$.title"), F.nullif(heading, F.lit("")), stem))
    own = own.withColumn("explicit_tags", explicit).withColumn("tags", F.array_sort(F.array_union("explicit_tags", text.word_tags(F.col("prose"), stop_words))))
    own = own.withColumn("urls", urls).withColumn("reading_minutes", text.reading_minutes(F.col("prose"))).withColumn("summary", text.summary(F.col("prose")))
    order = own.select(scanners.casefold("path").alias("fold"), "path")
    numbers = ordered_ids(order, ["fold", "path"], "note_id").select("path", "note_id")
    return own.drop("raw", "whole").join(numbers, "path")


def category(path: Column, fixed: str | None = None, by_folder: bool = True) -> Column:
    """The top folder, or a fixed name, or none."""
    if fixed is not None:
        return F.lit(fixed)
    return F.when(F.lit(by_folder) & (F.size(F.split(path, "/")) > 1), F.split_part(path, F.lit("/"), F.lit(1)))


def search_corpus(notes_table: DataFrame, url: Column | None = None) -> DataFrame:
    """The corpus rows of notes()."""
    from ..functions.links import search_body

    url = F.concat(F.lit("/"), F.regexp_replace("path", r"\.[^.]*$", ".html")) if url is None else url
    day = F.coalesce(F.get_json_object("frontmatter", "$.date"), F.get_json_object("frontmatter", "$.created"))
    return notes_table.select(F.col("note_id").alias("id"), url.alias("url"), "title", normalised_time(day).alias("date"), search_body(F.col("prose"), F.col("urls")).alias("body"), "summary", category(F.col("path")).alias("category"), "tags", F.col("reading_minutes").alias("readingTime"))


def normalised_time(value: Column, fallback: Column | None = None) -> Column:
    """RFC 3339 in UTC from epoch seconds or milliseconds (beyond 1e10), ISO or a plain date; else the fallback."""
    number = value.try_cast("double")
    seconds = F.when(number > 1e10, number / 1000).otherwise(number)
    plain = F.trim(F.regexp_replace(value, "^['\"]|['\"]$", ""))
    moment = F.coalesce(F.timestamp_seconds(seconds), *[F.try_to_timestamp(plain, F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd")])
    moment = moment if fallback is None else F.coalesce(moment, fallback)
    micros = F.date_format(moment, "SSSSSS")
    return F.concat(F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(""), F.lit("Z"))


def floored_millis(value: Column) -> Column:
    """RFC 3339 with any number of digits, floored to milliseconds as text."""
    digits = F.regexp_extract(value, r"^.{19}\.([0-9]*)", 1)
    return F.concat(F.substring(value, 1, 19), F.lit("."), F.substring(F.concat(digits, F.lit("000")), 1, 3), F.lit("Z"))


def attachments(files: DataFrame) -> DataFrame:
    """id (the name before its first dot) and its sorted file names."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.groupBy(F.split_part(name, F.lit("."), F.lit(1)).alias("id")).agg(F.array_sort(F.collect_list(name)).alias("files"))


def orphans(attachment_index: DataFrame, bodies: DataFrame, column: str = "body", include_html: bool = False) -> DataFrame:
    """Attachments that no body links to. HTML images count only if asked for."""
    linking = bodies.where(F.instr(column, "(:/") > 0) if not include_html else bodies
    used = F.transform(text.resource_links(F.col(column)), F.lower)
    used = F.array_union(used, F.transform(text.html_image_resources(F.col(column)), F.lower)) if include_html else used
    ids = linking.select(F.explode(used).alias("_used")).distinct()
    return attachment_index.join(ids, F.lower("id") == F.col("_used"), "left_anti")


def stop_words(spark: SparkSession, path: str) -> list[str]:
    """The built-in stop words and those of a file: divided by white space or commas, # starts a comment."""
    lines = spark.read.text(path).select(F.split_part(F.col("value"), F.lit("#"), F.lit(1)).alias("v"))
    more = lines.select(F.explode(F.split(F.lower("v"), r"[,\s]+")).alias("w")).where("w <> ''").distinct().collect()
    return sorted({*text.STOP_WORDS, *(r["w"] for r in more)})
