"""Small helpers that the training-data operators share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the mixing and similarity operators: a run of anything but ASCII white space.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
#: A word of the decontamination and license operators: ASCII letters and digits, and everything outside ASCII.
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ARROW_BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir; a local one only where that is unset (tests)."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"{tempfile.gettempdir()}/checkpoints"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Cuts the lineage: df as Parquet in the shared folder, read again, so that a lost executor costs no earlier stage."""
    path = shared_dir(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, **options: str) -> DataFrame:
    """Like written(), in buckets by key, as many as a shuffle has partitions: joins on key leave these rows where they are. The catalog
    knows the table only while it is made; its files stay in the shared folder."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    table_name = "written_" + path.rpartition("-")[2]
    buckets = min(int(spark.conf.get("spark.sql.shuffle.partitions")), int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
    df.write.format("parquet").options(**options).bucketBy(buckets, key).option("path", path).saveAsTable(table_name)
    out = spark.table(table_name)
    spark.sql(f"DROP TABLE {table_name}")
    return out


def discard(df: DataFrame) -> None:
    """Deletes the folder that written() made for df, once nothing reads it any more."""
    spark = df.sparkSession
    for name in {f.rpartition("/")[0] for f in df.inputFiles()[:1]}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner take the shuffle files of queries that nothing refers to any more; else they stay until the driver happens
    to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches are bounded by bytes as well as rows, so long texts don't pile up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def hex_fraction(hexes: Column) -> Column:
    """A hex digest as a number in [0, 1) that keeps the digest's order."""
    return F.conv(F.substring(hexes, 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
