"""The search corpus and other small inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """The search corpus in JSON lines; a line that is no record is an error."""
    return spark.read.schema(schema.CORPUS).option("mode", "FAILFAST").json(path)


def unchecked(spark: SparkSession, report: str) -> DataFrame:
    """category, line and checked state of a problem report: `## ` starts a category, `- [ ] ` or `- [x] ` an entry."""
    lines = spark.read.text(report, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line", "text"))
    heads = lines.where(F.col("text").startswith("## ")).select(F.col("line").alias("head"), F.substr("text", F.lit(4)).alias("category"))
    entries = lines.where(F.col("text").rlike(r"^- \[[ xX]\] "))
    above = entries.join(heads, F.col("head") < F.col("line"), "left").groupBy("line", "text").agg(F.max_by("category", "head").alias("category"))  # a report has a few headings
    return above.select("category", "line", F.lower(F.substring("text", 4, 1)).eqNullSafe("x").alias("checked"), F.substr("text", F.lit(7)).alias("entry"))
