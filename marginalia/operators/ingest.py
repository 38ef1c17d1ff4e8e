"""Idempotent import."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class ImportCollision(Exception):
    """An incoming item has the id of a stored one with another content."""


def classify(incoming: DataFrame, existing: DataFrame, *, key: str, digest: str, any_of: bool = False) -> DataFrame:
    """Adds `outcome`: new, skip or collision, by the set of digests stored under the id.

    An item skips if the stored set is its digest alone, or with any_of if it is one of the set. A stored item without a digest
    still reserves its id."""
    stored = existing.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "").groupBy(F.col(key).alias("_key"))
    stored = stored.agg(F.collect_set(digest).alias("_set"), F.count_if(F.col(digest).isNull()).alias("_none"))
    found = incoming.join(stored, F.col(key) == F.col("_key"), "left")
    same = F.array_contains("_set", F.col(digest)) if any_of else (F.size("_set") == 1) & F.array_contains("_set", F.col(digest)) & (F.col("_none") == 0)
    outcome = F.when(F.col("_key").isNull(), "new").when(F.coalesce(same, F.lit(False)), "skip").otherwise("collision")
    return found.withColumn("outcome", outcome).drop("_key", "_set", "_none")


def first_in_run(incoming: DataFrame, *, key: str, digest: str, order: list[str]) -> DataFrame:
    """Adds `outcome` for repeats within one import: the first of an id is new, later ones skip or collide with it."""
    by = Window.partitionBy(key).orderBy(*order)
    nth, first = F.row_number().over(by), F.first(digest).over(by)
    return incoming.withColumn("outcome", F.when(nth == 1, "new").when(F.col(digest).eqNullSafe(first), "skip").otherwise("collision"))


def new_items(incoming: DataFrame, existing: DataFrame, *, key: str, digest: str, order: list[str]) -> DataFrame:
    """The items to add. Any collision, with what is stored or within the import, refuses all of it."""
    own = first_in_run(incoming, key=key, digest=digest, order=order)
    both = classify(own.where("outcome <> 'skip'").withColumnRenamed("outcome", "_own"), existing, key=key, digest=digest)
    clash = both.where("outcome = 'collision' or _own = 'collision'").select(key).limit(5).collect()
    if clash:
        raise ImportCollision(", ".join(str(r[0]) for r in clash))
    return both.where("outcome = 'new'").drop("outcome", "_own")


def merge(existing: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of changes replace those of the same key, or join them."""
    changes = changes.select(*existing.columns)
    return existing.join(changes, key, "left_anti").unionByName(changes)


def publish(df: DataFrame, path: str, **options: str) -> None:
    """Writes beside the path and renames: readers see all of it or nothing. An existing path is refused."""
    spark = df.sparkSession
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target):
        raise FileExistsError(path)
    staged = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.{uuid.uuid4().hex}.staged")  # each writer has its own
    df.write.options(**options).parquet(staged.toString())
    if not fs.rename(staged, target):
        raise FileExistsError(path)
