"""Schemas of the note model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Item kinds and their codes.
KINDS = {1: "note", 2: "folder", 4: "resource", 5: "tag"}
NOTE, FOLDER, RESOURCE, TAG, RELATION = 1, 2, 4, 5, 6
VERSION = 5
PROPERTY = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])
PROPERTIES = T.ArrayType(PROPERTY)
#: Properties with a column of their own, by type.
TEXT = "id parent_id title created_time updated_time user_created_time user_updated_time source source_url source_application application_data author note_id tag_id item_id item_type mime filename file_extension share_id conflict_original_id master_key_id user_data deleted_time".split()
WHOLE = "type_ is_todo todo_due todo_completed is_conflict size markup_language is_shared encryption_applied encryption_blob_encrypted ocr_status blob_updated_time".split()
REAL = "latitude longitude altitude order".split()

ITEMS = T.StructType(
    [T.StructField("source_filename", T.StringType()), T.StructField("source_raw", T.BinaryType()), T.StructField("source_sha256", T.BinaryType()), T.StructField("properties", PROPERTIES), T.StructField("body", T.StringType())]
    + [T.StructField(c, T.StringType()) for c in TEXT]
    + [T.StructField(c, T.LongType()) for c in WHOLE]
    + [T.StructField(c, T.DoubleType()) for c in REAL]
    + [T.StructField(c, T.StringType()) for c in ("note_type", "note_title", "note_hash", "note_folder", "note_url")]
    + [T.StructField("internal_date", T.TimestampType())]
)
CORPUS = T.StructType([T.StructField("id", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("url", "title", "date", "body", "summary", "category")], T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("readingTime", T.IntegerType())])


def kind_name(code: Column) -> Column:
    out = F.lit("")
    for number, name in KINDS.items():
        out = F.when(code == number, name).otherwise(out)
    return out


def upgraded(rows: DataFrame) -> DataFrame:
    """Rows of an older version with all columns, and fingerprints where the raw source is there without one."""
    empty = rows.sparkSession.createDataFrame([], ITEMS)
    out = empty.unionByName(rows, allowMissingColumns=True)
    return out.withColumn("source_sha256", F.coalesce("source_sha256", F.unhex(F.sha2("source_raw", 256))))
