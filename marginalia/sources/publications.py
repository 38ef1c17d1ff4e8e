"""Publications: a manifest, index and record files in JSON lines, and blobs named by their SHA-256."""

from __future__ import annotations

import json
import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scanners import Refused, strict_json, strictly_json

SCHEMA_VERSIONS = range(12, 29)
INDEX = "sha256 string, kind string, media_type string, size_bytes long, location struct<layout:string,path:string>, records long, record_counts map<string,long>"
_HEX = re.compile(r"[0-9a-f]{64}\Z")


def canonical_json(value: Any) -> bytes:
    """Compact JSON in key order with <, >, & and the line separators escaped."""
    text = json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True)
    for c in "<>&  ":
        text = text.replace(c, f"\\u{ord(c):04x}")
    return text.encode()


def manifest(text: str, required: dict[str, type]) -> dict:
    """A manifest read strictly: all required fields with their types, a known schema version, lists of ids sorted and distinct."""
    value = strict_json(text)
    if not isinstance(value, dict):
        raise Refused("manifest is no object")
    for name, kind in required.items():
        if not isinstance(value.get(name), kind) or isinstance(value.get(name), bool) and kind is int:
            raise Refused(f"manifest field {name}")
    if "schema_version" in value and value["schema_version"] not in SCHEMA_VERSIONS:
        raise Refused("manifest schema version")
    for name, own in value.items():
        if name.endswith("_ids") and isinstance(own, list) and own != sorted(set(own)):
            raise Refused(f"manifest order of {name}")
    return value


def read_lines(spark: SparkSession, path: str, schema: str, nth: str = "line") -> DataFrame:
    """JSON lines, each read strictly: a repeated key, a lone surrogate or a number beyond 64 bits is an error."""
    rows = spark.read.text(path).where("value <> ''")
    good = F.when(strictly_json("value"), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("refused: "), F.substring("value", 1, 80))).cast("string"))
    return rows.select(F.from_json(good, schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return read_lines(spark, path, INDEX)


def index_faults(index: DataFrame) -> DataFrame:
    """sha256 and fault of entries whose hash isn't one, is repeated, or whose size is below zero."""
    n = index.groupBy("sha256").agg(F.count(F.lit(1)).alias("n"), F.min("size_bytes").alias("least"))
    fault = F.when(~F.col("sha256").rlike("^[0-9a-f]{64}$"), "hash").when(F.col("n") > 1, "repeated").when(F.coalesce("least", F.lit(-1)) < 0, "size")
    return n.select("sha256", fault.alias("fault")).where("fault is not null")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """object (the file's name), type and payload as JSON text."""
    rows = spark.read.text(path).where("value <> ''").select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("object"), "value")
    good = F.when(strictly_json("value"), F.col("value")).otherwise(F.raise_error(F.lit("refused record")).cast("string"))
    rows = rows.withColumn("value", good)
    return rows.select("object", F.get_json_object("value", "$.type").alias("type"), F.get_json_object("value", "$.payload").alias("payload"))


def count_faults(records: DataFrame, index: DataFrame) -> DataFrame:
    """object, type, declared and found where an object's records of a type aren't as many as its index entry says."""
    found = records.groupBy("object", "type").agg(F.count(F.lit(1)).alias("found"))
    declared = index.where("record_counts is not null").select(F.col("sha256").alias("object"), F.explode("record_counts").alias("type", "declared"))
    both = declared.join(found, ["object", "type"], "full_outer")
    return both.where(~F.coalesce("declared", F.lit(0)).eqNullSafe(F.coalesce("found", F.lit(0).cast("long"))))


def verified_blobs(spark: SparkSession, root: str, declared: DataFrame) -> DataFrame:
    """sha256, content and fault (missing, size or hash) of the declared blobs (sha256, size_bytes)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("sha256"), F.col("length").alias("_n"), "content", F.sha2("content", 256).alias("_h"))
    both = declared.join(files, "sha256", "left")
    fault = F.when(F.col("_h").isNull(), "missing").when(F.col("_n") != F.col("size_bytes"), "size").when(F.col("_h") != F.col("sha256"), "hash")
    return both.select("sha256", F.when(fault.isNull(), F.col("content")).alias("content"), fault.alias("fault"))


def graph_faults(references: DataFrame, ids: DataFrame) -> DataFrame:
    """References (owner, column, kind, target) to ids (kind, id) that aren't there."""
    known = ids.select(F.col("kind"), F.col("id").alias("target"))
    return references.where("target is not null").join(known, ["kind", "target"], "left_anti")


def unreferenced_blobs(blobs: DataFrame, references: DataFrame) -> DataFrame:
    return blobs.join(references.select("sha256"), "sha256", "left_anti")


def blob_faults(references: DataFrame, objects: DataFrame) -> DataFrame:
    """Blob references (owner, sha256, kind, size_bytes) without an object of the same kind and size."""
    own = objects.select("sha256", F.col("kind").alias("_kind"), F.col("size_bytes").alias("_size"))
    both = references.join(own, "sha256", "left")
    return both.where(~F.col("_kind").eqNullSafe(F.col("kind")) | ~F.col("_size").eqNullSafe(F.col("size_bytes"))).drop("_kind", "_size")


def is_hash(text: str) -> bool:
    return bool(_HEX.match(text))
