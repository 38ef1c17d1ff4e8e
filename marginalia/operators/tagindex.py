"""The inverted tag index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import posting_bucket

#: Bounds of the taxonomy cap, notes per tag, documents in a chunk.
LEAST_TAGS, MOST_TAGS, NOTES_PER_TAG, CHUNK = 200, 5000, 10, 512


def taxonomy_cap(notes: int) -> int:
    return max(LEAST_TAGS, min(MOST_TAGS, notes // NOTES_PER_TAG))


def tag_counts(tags: DataFrame, *, note: str = "note_id", tag: str = "tag") -> DataFrame:
    """tag and its number of notes, from distinct (note, tag) rows."""
    return tags.groupBy(tag).agg(F.count(note).alias("notes"))


def top_tags(tags: DataFrame, limit: int, *, note: str = "note_id", tag: str = "tag") -> DataFrame:
    """The most frequent tags, ties by name; 0: all."""
    counts = tag_counts(tags, note=note, tag=tag).orderBy(F.desc("notes"), tag)
    return counts.limit(limit) if limit else counts


def demoted_notes(tags: DataFrame, limit: int, *, note: str = "note_id", tag: str = "tag") -> DataFrame:
    """Notes with a tag that isn't among the top ones, and how many such tags they have."""
    return tags.join(top_tags(tags, limit, note=note, tag=tag).select(tag), tag, "left_anti").groupBy(note).agg(F.count(tag).alias("demoted"))


def postings(tags: DataFrame, *, note: str = "note_id", tag: str = "tag") -> DataFrame:
    """bucket, tag and its sorted note ids."""
    return tags.groupBy(tag).agg(F.array_sort(F.collect_list(note)).alias("notes")).select(posting_bucket(F.col(tag)).alias("bucket"), tag, "notes")


def document_chunks(documents: DataFrame, note: str = "note_id", size: int = CHUNK) -> DataFrame:
    return documents.withColumn("chunk", F.floor(F.col(note) / size).cast("long"))


def posting_page(lists: DataFrame, tag: str, per: int, page: int) -> DataFrame:
    return lists.where(F.col("tag") == tag).select("tag", F.explode(F.slice("notes", (page - 1) * per + 1, per)).alias("note_id"))


def ordered_ids(items: DataFrame, order: list[str], name: str = "note_id") -> DataFrame:
    """Ids from 0 in the given order. Ranges of the order are counted first, so no task sorts everything."""
    parts = items.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).persist()
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    nth = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return parts.join(F.broadcast(starts.select("_p", "_start")), "_p").withColumn(name, F.col("_start") + nth).drop("_p", "_start")  # a row per partition


def with_prior(items: DataFrame, order: list[str], value: str, name: str = "prior") -> DataFrame:
    """Adds the value of the row before in the given order, nulls last. Ranges of the order look back by themselves; the last row of each goes to the next that has rows."""
    ascending = [F.col(c).asc_nulls_last() for c in order]
    parts = items.repartitionByRange(*ascending).withColumn("_p", F.spark_partition_id()).persist()
    place = F.struct(*[x for k, c in enumerate(order) for x in (F.col(c).isNull().alias(f"n{k}"), F.col(c).alias(f"c{k}"))])
    ends = parts.groupBy("_p").agg(F.max_by(value, place).alias("_end")).select("_p", F.lag("_end").over(Window.orderBy("_p")).alias("_carried"))
    within = Window.partitionBy("_p").orderBy(*ascending)
    prior = F.when(F.row_number().over(within) == 1, F.col("_carried")).otherwise(F.lag(value).over(within))
    return parts.join(F.broadcast(ends), "_p").withColumn(name, prior).drop("_p", "_carried")  # a row per partition
