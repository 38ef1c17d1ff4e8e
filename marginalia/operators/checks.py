"""Checks of a staged import, selections, and reconciliations: mostly joins that leave what is wrong."""

from __future__ import annotations

import threading
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema

Result = TypeVar("Result")


def _kinds(items: DataFrame, name: str) -> DataFrame:
    return items.select(F.col("id").alias(f"_{name}"), F.col("type_").alias(f"_{name}_type"))


def misplaced(items: DataFrame) -> DataFrame:
    """Items (id, parent_id, type_) whose parent isn't there or is no folder."""
    up = items.where(F.coalesce("parent_id", F.lit("")) != "").join(_kinds(items, "up"), F.col("parent_id") == F.col("_up"), "left")
    return up.where(~F.col("_up_type").eqNullSafe(F.lit(schema.FOLDER))).drop("_up", "_up_type")


def broken_targets(relations: DataFrame, items: DataFrame, targets: dict[str, int]) -> DataFrame:
    """Relations of which a column doesn't name an item of the kind that `targets` gives for it; a missing target is a wrong one."""
    wrong = F.lit(False)
    out = relations
    for column, kind in targets.items():
        out = out.join(_kinds(items, column), F.col(column) == F.col(f"_{column}"), "left")
        wrong = wrong | ~F.col(f"_{column}_type").eqNullSafe(F.lit(kind))
    return out.where(wrong).select(*relations.columns)


def unreached(targets: DataFrame, references: DataFrame, owners: DataFrame, *, key: str = "id", target: str = "target", owner: str = "owner") -> DataFrame:
    """Targets that no reference of one of the owners names."""
    named = references.join(owners.select(F.col(key).alias(owner)), owner, "left_semi").select(F.col(target).alias(key))
    return targets.join(named, key, "left_anti")


def title_rule_matches(source: DataFrame, route: DataFrame, *, key: str, title: str, pinned: str) -> DataFrame:
    """key, source and route title where both sides hold the key once, the route has the pinned title, and the source another one."""
    once = lambda df, *columns: df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *[F.min(c).alias(n) for c, n in columns]).where("_n = 1").drop("_n")
    both = once(source, (title, "source_title"), (pinned, "_pinned")).join(once(route, (title, "route_title")), key)
    return both.where((F.col("route_title") == F.col("_pinned")) & (F.col("source_title") != F.col("route_title"))).drop("_pinned")


def producer_rows(documents: DataFrame, revisions: DataFrame, sources: DataFrame, tags: DataFrame) -> DataFrame:
    """Documents (id, revision_id) with their current revision (revision_id, body), source (id, source) and sorted tags (id, tag)."""
    listed = tags.groupBy("id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    out = documents.join(revisions, "revision_id").join(sources, "id").join(listed, "id", "left")
    return out.withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def refusal_census(checks: DataFrame, *, key: str, order: str, name: str, failed: str) -> DataFrame:
    """name and cases: how many keys each check refuses first."""
    first = checks.where(F.col(failed)).groupBy(key).agg(F.min(F.struct(order, name)).alias("_first"))
    return first.groupBy(F.col(f"_first.{name}").alias(name)).agg(F.count(F.lit(1)).alias("cases"))


def distinct_tags(notes: DataFrame, tags: str = "tags") -> DataFrame:
    """One row, n: the tags that differ, exactly."""
    return notes.select(F.explode(tags).alias("_tag")).agg(F.countDistinct("_tag").alias("n"))


def output_paths(notes: DataFrame, *, path: str, order: list[str], out: str = "output_path") -> DataFrame:
    """Paths that differ whatever their case: the first keeps its own, others get twelve digits of the path's SHA-256 before the
    extension, and a counter from 2 where the very path repeats."""
    nth = F.row_number().over(Window.partitionBy(F.lower(path)).orderBy(*order))
    stem, suffix = F.regexp_extract(path, r"^(.*?)(\.[^./]*)?$", 1), F.regexp_extract(path, r"(\.[^./]*)$", 1)
    marked = F.concat(stem, F.lit("-"), F.substring(F.sha2(path, 256), 1, 12))
    rows = notes.withColumn("_nth", nth).withColumn("_marked", marked)
    again = F.row_number().over(Window.partitionBy(F.lower("_marked"), F.col("_nth") > 1).orderBy("_nth"))
    rows = rows.withColumn("_again", again)
    name = F.when(F.col("_nth") == 1, F.col(path)).otherwise(F.concat("_marked", F.when(F.col("_again") > 1, F.concat(F.lit("-"), F.col("_again").cast("string"))).otherwise(""), suffix))
    return rows.withColumn(out, name).drop("_nth", "_marked", "_again")


def first_live(documents: DataFrame, n: int, *, key: str = "id", deleted: str = "deleted_at") -> DataFrame:
    """The n lowest keys of documents that aren't deleted: the feature is the bound."""
    return documents.where(F.col(deleted).isNull()).orderBy(key).limit(n)


def roots(folders: DataFrame, parent: str = "parent_id") -> DataFrame:
    return folders.where(F.coalesce(F.col(parent).cast("string"), F.lit("")) == "")


def selected_ids(*selections: DataFrame) -> DataFrame:
    """The ids of all selections, each once."""
    out = selections[0]
    for more in selections[1:]:
        out = out.union(more)
    return out.distinct()


def anchor(heading: Column) -> Column:
    """A heading's anchor: lower case, letters, digits, blanks and hyphens alone, blanks as hyphens."""
    return F.translate(F.regexp_replace(F.lower(F.trim(heading)), r"[^\p{L}\p{N}\s_-]", ""), " ", "-")


def broken_anchors(links: DataFrame, headings: DataFrame) -> DataFrame:
    """Links (page, target, anchor) whose target has no heading (page, heading) with that anchor."""
    there = headings.select(F.col("page").alias("target"), anchor(F.col("heading")).alias("anchor")).distinct()
    return links.join(there, ["target", "anchor"], "left_anti")


def reconciled(registry: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """key and side of entries that stand in the registry or in what was found alone."""
    both = registry.select(key).distinct().withColumn("_r", F.lit(True)).join(found.select(key).distinct().withColumn("_f", F.lit(True)), key, "full_outer")
    return both.where("_r is null or _f is null").select(key, F.when(F.col("_r").isNull(), "unregistered").otherwise("missing").alias("side"))


def from_origin(metadata: Column, places: dict[str, str]) -> Column:
    """Whether one of the places in the metadata (a map) says the origin that is given for it, whatever its case."""
    out = F.lit(False)
    for place, origin in places.items():
        out = out | F.coalesce(F.lower(F.try_element_at(metadata, F.lit(place))) == origin.lower(), F.lit(False))
    return out


def backfilled(items: DataFrame, raw: str, digest: str) -> DataFrame:
    """Items with the digest of their source where an older table has none, or no such column."""
    have = F.col(digest) if digest in items.columns else F.lit(None).cast("binary")
    return items.withColumn(digest, F.coalesce(have, F.unhex(F.sha2(raw, 256))))


def of_kind(records: DataFrame, kind: str) -> DataFrame:
    """All records of a kind by key."""
    return records.where(F.col("kind") == kind).orderBy("id")


def freshness(spark: SparkSession, path: str) -> DataFrame:
    """One row, stamp and files: changes with the name, size or time of any file. Contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    one = F.sha2(F.concat_ws("|", "path", F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string")), 256)
    total = F.sum(F.conv(F.substring(one, 1, 15), 16, 10).cast("decimal(38,0)"))
    return files.agg(F.count(F.lit(1)).alias("files"), F.sha2(F.coalesce(total, F.lit(0)).cast("string"), 256).alias("stamp"))


def within(spark: SparkSession, label: str, seconds: float, action: Callable[[], Result]) -> Result:
    """The action's result; its jobs bear the label, and are cancelled once the time is over."""
    spark.sparkContext.setJobGroup(label, label, interruptOnCancel=True)
    clock = threading.Timer(seconds, spark.sparkContext.cancelJobGroup, [label])
    clock.start()
    try:
        return action()
    finally:
        clock.cancel()
        for name in ("spark.jobGroup.id", "spark.job.description"):
            spark.sparkContext.setLocalProperty(name, None)
