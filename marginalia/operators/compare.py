"""Comparison of two independently made datasets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counted(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def identity_summary(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: rows, distinct keys and repeats of both sides, missing and extra rows; null keys are always missing or extra."""
    def side(rows: DataFrame, other: DataFrame, name: str, gone: str) -> DataFrame:
        own = counted(rows, key).alias("o")
        there = counted(other, key).select(F.col(key).alias("_k"), F.lit(True).alias("_there"))
        own = own.join(there, F.col(key) == F.col("_k"), "left")
        return own.agg(F.coalesce(F.sum("n"), F.lit(0)).alias(f"{name}_rows"), F.count(key).alias(f"{name}_keys"), F.coalesce(F.sum(F.when(F.col(key).isNotNull() & (F.col("n") > 1), F.col("n") - 1).otherwise(0)), F.lit(0)).alias(f"{name}_repeats"), F.coalesce(F.sum(F.when(F.col("_there").isNull(), F.col("n"))), F.lit(0)).alias(gone))

    a, b = side(left, right, "left", "missing"), side(right, left, "right", "extra")
    return a.withColumn("_one", F.lit(1)).join(b.withColumn("_one", F.lit(1)), "_one").drop("_one")  # one row each


def multiset_matches(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """One row, `matches`: how many rows pair off, repeats counted; rows with a null key don't."""
    a, b = counted(left.dropna(subset=list(keys)), *keys), counted(right.dropna(subset=list(keys)), *keys).withColumnRenamed("n", "m")
    return a.join(b, list(keys)).agg(F.coalesce(F.sum(F.least("n", "m")), F.lit(0)).alias("matches"))


def whole_row_matches(left: DataFrame, right: DataFrame) -> DataFrame:
    """As multiset_matches() over all columns, null equal to null."""
    return left.intersectAll(right.select(*left.columns)).agg(F.count(F.lit(1)).alias("matches"))


def one_to_one(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str) -> DataFrame:
    """key and both ids where the key occurs once on either side."""
    a = left.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min(left_id).alias("left_id")).where("_n = 1").drop("_n")
    b = right.groupBy(key).agg(F.count(F.lit(1)).alias("_m"), F.min(right_id).alias("right_id")).where("_m = 1").drop("_m")
    return a.join(b, key)


def ambiguous(left: DataFrame, right: DataFrame, group: str, key: str) -> DataFrame:
    """Groups whose keys don't pair off one to one: the left rows aren't one, or the products with the right rows don't sum to one."""
    a, b = counted(left, group, key), counted(right, key).withColumnRenamed("n", "m")
    sums = a.join(b, key, "left").groupBy(group).agg(F.sum("n").alias("left_rows"), F.sum(F.col("n") * F.coalesce("m", F.lit(0))).alias("pairs"))
    return sums.where("left_rows <> 1 or pairs <> 1")


def explained(pairs: DataFrame, left: str, right: str, pinned: str) -> DataFrame:
    """One row: equal, explained (the right value is the pinned one) and unexplained pairs, and whether all is equal or explained."""
    same = F.col(left).eqNullSafe(F.col(right))
    by_rule = ~same & F.col(right).eqNullSafe(F.col(pinned))
    sums = pairs.agg(F.count_if(same).alias("equal"), F.count_if(by_rule).alias("explained"), F.count_if(~same & ~by_rule).alias("unexplained"))
    return sums.withColumn("semantic_equal", F.col("unexplained") == 0)


def inventory_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one side has more often, with `side`."""
    right = right.select(*left.columns)
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def table_fingerprint(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row, digest and n: equal for tables with the same rows in any order. Row digests are summed in 4 parts, so nothing is gathered."""
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)
    parts = [F.coalesce(F.sum(F.conv(F.substring("_d", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string") for k in range(4)]
    sums = rows.select(row.alias("_d")).agg(F.count(F.lit(1)).alias("n"), *[p.alias(f"p{k}") for k, p in enumerate(parts)])
    return sums.select("n", F.sha2(F.concat_ws(",", "p0", "p1", "p2", "p3"), 256).alias("digest"))


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)
