"""Writers."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..operators import tagindex


def append(items: DataFrame, path: str) -> None:
    items.write.mode("append").parquet(path)


def write_files(files: DataFrame, root: str, *, name: str = "name", content: str = "bytes") -> int:
    """One file a row below a folder that all executors share; each is written beside its place and renamed. Names that repeat, whatever
    their case, are refused before anything is written, as are names that leave the folder."""
    from ..functions.links import safe_path

    rows = files.select(F.col(name).alias("name"), F.col(content).alias("bytes"))
    bad = rows.where(~safe_path(F.col("name"))).select("name").limit(3).collect()
    bad += rows.groupBy(F.lower("name").alias("name")).count().where("count > 1").select("name").limit(3).collect()
    if bad:
        raise FileExistsError(", ".join(r["name"] for r in bad))

    def put(part: Iterator[Row]) -> None:
        for row in part:
            path = os.path.join(root, row["name"])
            os.makedirs(os.path.dirname(path), exist_ok=True)
            staged = f"{path}.{os.getpid()}.part"
            with open(staged, "wb") as out:
                out.write(row["bytes"])
            os.replace(staged, path)

    rows.foreachPartition(put)
    return rows.count()


def copy_set(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """name and outcome (new or skip) of files to copy (name, sha256); a name with another content on either side refuses the set."""
    both = incoming.select("name", F.col("sha256").alias("_new")).join(existing.select("name", F.col("sha256").alias("_old")), "name", "left")
    clash = both.where("_old is not null and _old <> _new").select("name").limit(5).collect()
    if clash:
        raise FileExistsError(", ".join(r["name"] for r in clash))
    return both.select("name", F.when(F.col("_old").isNull(), "new").otherwise("skip").alias("outcome"))


def write_corpus(rows: DataFrame, path: str) -> None:
    rows.write.option("ignoreNullFields", "false").json(path)


def write_tag_index(tags: DataFrame, path: str, prefix: str = "prefix") -> None:
    """tag, notes by prefix of the tag, the most frequent 500, and postings by bucket."""
    counts = tagindex.tag_counts(tags)
    from ..functions.scanners import tag_prefix_bucket

    counts.withColumn(prefix, tag_prefix_bucket("tag")).repartition(prefix).sortWithinPartitions("tag").write.partitionBy(prefix).json(f"{path}/tags")
    tagindex.top_tags(tags, 500).coalesce(1).write.json(f"{path}/top")
    tagindex.postings(tags).repartition("bucket").sortWithinPartitions("bucket", "tag").write.partitionBy("bucket").json(f"{path}/postings")


def write_link_report(findings: DataFrame, path: str) -> None:
    """A CSV in note order."""
    findings.orderBy("note_id", "line", "column").write.option("header", "true").csv(path)


def problem_report(issues: DataFrame) -> DataFrame:
    """The lines of a report in order, by category, note and line, with a checkbox and the issue's id."""
    entry = F.concat(F.lit("- [ ] "), F.col("note"), F.lit(":"), F.col("line").cast("string"), F.lit(" "), F.col("reason"), F.lit(" <!-- "), F.col("issue_id"), F.lit(" -->"))
    heads = issues.select("category").distinct().select("category", F.lit("").alias("note"), F.lit(0).alias("line"), F.concat(F.lit("## "), F.col("category")).alias("text"))
    return heads.unionByName(issues.select("category", "note", "line", entry.alias("text"))).orderBy("category", "note", "line").select("text")


def inventory(files: DataFrame) -> DataFrame:
    """path, size_bytes, sha256 of files (path, raw)."""
    return files.select("path", F.length("raw").cast("long").alias("size_bytes"), F.sha2("raw", 256).alias("sha256"))
