"""RAW item archives: one Markdown file an item, a body and a property block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import ids, text

#: A property line: a name, a colon, at most one blank that belongs to neither, the value.
PROPERTY = r"^([A-Za-z_][A-Za-z0-9_]*):(?: (.*)|(.*))$"
_NAME = r"^[A-Za-z_][A-Za-z0-9_]*:.*$"
ENDS = "\r\n|\r|\n"


def files(spark: SparkSession, path: str) -> DataFrame:
    """name, raw of the .md files of a folder, whatever the extension's case; in scan order by (lower-case name, name)."""
    found = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("content").alias("raw"))
    return found.where(F.lower("name").endswith(".md"))


def effective(properties: Column, key: str) -> Column:
    """The value of the last property of that name."""
    return F.get(F.reverse(F.filter(properties, lambda p: p["key"] == key)), F.lit(0))["value"]


def parse(items: DataFrame) -> DataFrame:
    """Items of name and raw. The text is UTF-8 with or without a byte order mark; lines end at CR, LF or both and at nothing else.

    The properties are the longest run of property lines at the end, after an empty line or alone. Anything else is an error, as is
    text in a numeric property. Properties keep their order and repeats; the last of a name holds."""
    decoded = F.regexp_replace(F.decode("raw", "UTF-8"), "^﻿", "")
    items = items.withColumn("whole", decoded).withColumn("lines", F.split(F.regexp_replace("whole", f"({ENDS})$", ""), ENDS))
    # places of lines that end the block, seen from the bottom: empty, or no property
    stop = F.array_max(F.filter(F.transform("lines", lambda x, i: F.when(~x.rlike(_NAME), i)), lambda i: i.isNotNull()))
    items = items.withColumn("stop", F.coalesce(stop, F.lit(-1)))
    at_empty = (F.col("stop") < 0) | (F.get("lines", F.col("stop")) == "")
    items = items.withColumn("block", F.when(at_empty, F.slice("lines", F.col("stop") + 2, F.size("lines"))).otherwise(F.raise_error(F.concat(F.lit("no property block in "), F.col("name"))).cast("array<string>")))
    pair = lambda x: F.struct(F.regexp_extract(x, PROPERTY, 1).alias("key"), F.concat(F.regexp_extract(x, PROPERTY, 2), F.regexp_extract(x, PROPERTY, 3)).alias("value"))
    items = items.withColumn("properties", F.transform("block", pair))
    # the body is the text before the block, with its own line ends: as many ends as lines stand before the empty one
    items = items.withColumn("body", F.when(F.size("block") >= 0, _head("whole", "stop")))  # so that a missing block shows whatever is read
    value = lambda c: effective(F.col("properties"), c)
    number = lambda c, kind: F.nullif(F.trim(value(c)), F.lit("")).cast(kind)
    out = items.select(
        F.col("name").alias("source_filename"), F.col("raw").alias("source_raw"), ids.source_fingerprint(F.col("raw")).alias("source_sha256"), "properties", "body",
        *[F.trim(value(c)).alias(c) for c in schema.TEXT], *[number(c, "long").alias(c) for c in schema.WHOLE], *[number(c, "double").alias(c) for c in schema.REAL],
    )
    created = F.col("created_time")
    moment = F.when(created.rlike(r"^-?\d+$"), F.timestamp_millis(F.expr("try_cast(created_time as bigint)"))).otherwise(F.try_to_timestamp(created))
    return (
        out.withColumn("id", F.coalesce(F.nullif("id", F.lit("")), F.regexp_replace("source_filename", r"(?i)\.md$", "")))
        .withColumn("note_type", schema.kind_name(F.col("type_")))
        .withColumn("note_title", text.title_from_body(F.split(F.col("body"), ENDS)[0]))
        .withColumn("note_hash", ids.note_hash(F.col("body")))
        .withColumn("note_folder", F.lit(None).cast("string"))
        .withColumn("note_url", F.col("source_url"))
        .withColumn("internal_date", moment)
    )


def _head(whole: str, lines: str) -> Column:
    """The first so many lines of a text with their line ends."""
    parts = F.regexp_extract_all(whole, F.lit(f"([^\\r\\n]*(?:{ENDS}))"), F.lit(1))
    return F.array_join(F.slice(parts, 1, F.greatest(F.col(lines), F.lit(0))), "")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The parsed items of a folder, with scan_order from 1."""
    order = Window.orderBy(F.lower("source_filename"), "source_filename")  # names alone are sorted: one short row a file
    items = parse(files(spark, path))
    numbers = items.select("source_filename").withColumn("scan_order", F.row_number().over(order))
    return items.join(numbers, "source_filename")


def line_of(key: Column, value: Column) -> Column:
    return F.concat(key, F.lit(": "), value)


def serialised(items: DataFrame, changes: dict[str, Column] | None = None) -> DataFrame:
    """Adds `bytes`: the exact source where nothing has changed, else the body, an empty line and the properties in order, those named
    in `changes` with their new value at their last place."""
    changes = changes or {}
    different = F.lit(False)
    props = F.col("properties")
    for key, new in changes.items():
        last = _last_place(props, key)
        different = different | ~new.eqNullSafe(effective(F.col("properties"), key))
        props = F.transform(props, _substitute(last, new))
    block = F.array_join(F.transform(props, lambda p: line_of(p["key"], p["value"])), "\n")
    own = F.when(F.col("body") == "", block).otherwise(F.concat(F.regexp_replace("body", f"({ENDS})$", ""), F.lit("\n\n"), block))
    return items.withColumn("bytes", F.when(F.col("source_raw").isNotNull() & ~different, F.col("source_raw")).otherwise(F.encode(own, "UTF-8")))


def _last_place(props: Column, key: str) -> Column:
    return F.size(props) - F.array_position(F.reverse(F.transform(props, lambda p: p["key"])), key).cast("int")


def _substitute(place: Column, new: Column):  # noqa: ANN202
    return lambda p, i: F.when(i == place, F.struct(p["key"].alias("key"), F.coalesce(new.cast("string"), F.lit("")).alias("value"))).otherwise(F.struct(p["key"].alias("key"), p["value"].alias("value")))
