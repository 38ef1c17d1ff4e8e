"""Rows of the note model made from other records: properties, folders, tags, relations, images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import ids, text

#: The order of the properties that an item of each kind is written with.
PROPERTY_ORDER = {
    schema.NOTE: "id parent_id created_time updated_time is_conflict latitude longitude altitude author source_url is_todo todo_due todo_completed source source_application application_data order user_created_time user_updated_time encryption_applied markup_language is_shared type_".split(),
    schema.FOLDER: "id created_time updated_time user_created_time user_updated_time encryption_applied parent_id is_shared type_".split(),
    schema.RESOURCE: "id mime filename created_time updated_time user_created_time user_updated_time file_extension encryption_applied size is_shared type_".split(),
    schema.TAG: "id created_time updated_time user_created_time user_updated_time encryption_applied is_shared parent_id type_".split(),
    schema.RELATION: "id note_id tag_id created_time updated_time user_created_time user_updated_time encryption_applied is_shared type_".split(),
}


def property_list(items: DataFrame) -> Column:
    """The ordered properties of each item by its kind; a missing value is an empty one."""
    have = set(items.columns)
    out = F.lit(None).cast(schema.PROPERTIES)
    for kind, names in PROPERTY_ORDER.items():
        pairs = F.array(*[F.struct(F.lit(c).alias("key"), (F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("")).alias("value")) for c in names])
        out = F.when(F.col("type_") == kind, pairs).otherwise(out)
    return out


def with_properties(items: DataFrame) -> DataFrame:
    return items.withColumn("properties", property_list(items))


def folder_rows(paths: DataFrame, namespace: str, path: str = "path") -> DataFrame:
    """One folder for each directory above the paths: id, parent_id, title, type_, depth; shallow first when sorted by (depth, title)."""
    from ..functions.links import ancestor_dirs

    dirs = paths.select(F.explode(ancestor_dirs(F.col(path))).alias("dir")).distinct()
    parts = F.split("dir", "/")
    parent = F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")
    own = lambda c: ids.vault_id(namespace, F.lit("folder"), c)
    return dirs.select(own(F.col("dir")).alias("id"), F.when(F.size(parts) > 1, own(parent)).alias("parent_id"), F.element_at(parts, -1).alias("title"), F.lit(schema.FOLDER).alias("type_"), F.size(parts).alias("depth"))


def tag_rows(notes: DataFrame, namespace: str, *, note: str = "id", tags: str = "tags") -> tuple[DataFrame, DataFrame]:
    """Tags (id, title, type_) and their relations to notes (id, note_id, tag_id, type_), each once, with ids from their names."""
    pairs = notes.select(F.col(note).alias("note_id"), F.explode(F.array_distinct(F.filter(tags, lambda t: F.trim(t) != ""))).alias("title"))
    pairs = pairs.withColumn("tag_id", ids.vault_id(namespace, F.lit("tag"), F.lower("title")))
    own = pairs.groupBy("tag_id").agg(F.min("title").alias("title")).select(F.col("tag_id").alias("id"), "title", F.lit(schema.TAG).alias("type_"))
    relation = ids.vault_id(namespace, F.lit("note-tag"), F.concat_ws("/", "note_id", "tag_id"))
    return own, pairs.select("note_id", "tag_id").distinct().select(relation.alias("id"), "note_id", "tag_id", F.lit(schema.RELATION).alias("type_"))


def find_or_create_folder(items: DataFrame, wanted: DataFrame, namespace: str) -> DataFrame:
    """title, id and is_new of folders by title: the stored one with the lowest note_id, or a new id from the title."""
    have = items.where(F.col("type_") == schema.FOLDER).groupBy("title").agg(F.min_by("id", "note_id").alias("_id"))
    found = wanted.join(have, "title", "left")
    return found.select("title", F.coalesce("_id", ids.vault_id(namespace, F.lit("folder"), F.col("title"))).alias("id"), F.col("_id").isNull().alias("is_new"))


def single_candidate(candidates: DataFrame, key: str, value: str, fallback: Column) -> DataFrame:
    """key and its one value; the fallback where the values differ or none is there."""
    sets = candidates.groupBy(key).agg(F.countDistinct(value).alias("_n"), F.min(value).alias("_v"))
    return sets.select(key, F.when(F.col("_n") == 1, F.col("_v")).otherwise(fallback).alias(value))


def first_attachment(relations: DataFrame, note: str = "note_id") -> DataFrame:
    """The relation of each note with the least (ordinal, kind, resource_id)."""
    rest = [c for c in relations.columns if c != note]
    least = F.min(F.struct("ordinal", "kind", "resource_id", *[c for c in rest if c not in ("ordinal", "kind", "resource_id")]))
    return relations.groupBy(note).agg(least.alias("r")).select(note, "r.*")


def select_problems(images: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of images (note, start, line, raw) those asked for by (note, fingerprint, occurrence), and requests that match none."""
    from .relational import occurrence_number

    numbered = occurrence_number(images.withColumn("fingerprint", ids.image_fingerprint(F.col("raw"))), ["note", "fingerprint"], ["line", "start"])
    keys = ["note", "fingerprint", "occurrence"]
    return numbered.join(wanted, keys, "left_semi"), wanted.join(numbered, keys, "left_anti")


def localised_images(images: DataFrame, resources: DataFrame) -> DataFrame:
    """Images (note, start, destination) with the resource of their URL (destination, resource_id, problem): each URL is resolved once;
    outcome says whether it was converted, failed or never tried."""
    known = resources.groupBy("destination").agg(F.min("resource_id").alias("resource_id"), F.min("problem").alias("problem"))
    outcome = F.when(F.col("resource_id").isNotNull(), "converted").when(F.col("problem").isNotNull(), "failed").otherwise("untried")
    return images.join(known, "destination", "left").withColumn("outcome", outcome)


def reachable_attachments(notes: DataFrame, resources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(note_id, resource_id) of attachments that notes link to and that are there, and of those that are missing."""
    linked = notes.select(F.col("id").alias("note_id"), F.explode(F.array_distinct(F.transform(text.resource_links(F.col("body")), F.lower))).alias("resource_id"))
    there = resources.select(F.lower("id").alias("resource_id"))
    return linked.join(there, "resource_id", "left_semi"), linked.join(there, "resource_id", "left_anti")


def frontmatter_block(title: Column, created: Column, updated: Column, tags: Column) -> Column:
    """A frontmatter with JSON scalars; empty values are left out."""
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    line = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}: "), quoted(c)))
    listed = F.when(F.size(tags) > 0, F.concat(F.lit("tags:\n"), F.array_join(F.transform(tags, lambda t: F.concat(F.lit("  - "), quoted(t))), "\n")))
    return F.concat(F.lit("---\n"), F.concat_ws("\n", line("title", title), line("created", created), line("updated", updated), listed), F.lit("\n---\n"))


def dependency_closure(items: DataFrame, selected: DataFrame) -> DataFrame:
    """Items that a selection of ids needs. Items refer to the ids in their properties, but not back to what owns them; relations come
    with their owner, the first of note_id, item_id, parent_id and resource_id that they have."""
    from .graph import reachable

    hexes = lambda c: F.transform(F.regexp_extract_all(c, F.lit("([a-fA-F0-9]{32})"), F.lit(1)), F.lower)
    props = items.select(F.lower("id").alias("id"), F.col("type_").isin(schema.NOTE, schema.FOLDER, schema.RESOURCE, schema.TAG).alias("primary"), F.explode("properties").alias("p"))
    refs = props.select("id", "primary", F.col("p.key").alias("key"), F.explode(hexes(F.col("p.value"))).alias("ref"))
    out = refs.where(~F.col("key").isin("id", "note_id", "item_id", "parent_id")).select(F.col("id").alias("src"), F.col("ref").alias("dst"))
    rank = F.array_position(F.array(*[F.lit(k) for k in ("note_id", "item_id", "parent_id", "resource_id")]), F.col("key"))
    owners = refs.where(~F.col("primary")).withColumn("rank", rank).where("rank > 0")
    first = owners.groupBy(F.col("id").alias("_id")).agg(F.min("rank").alias("_rank"))
    owned = owners.join(first, (F.col("id") == F.col("_id")) & (F.col("rank") == F.col("_rank"))).select(F.col("ref").alias("src"), F.col("id").alias("dst"))
    needed = reachable(selected.select(F.lower("id").alias("id")), out.unionByName(owned).distinct())
    return items.join(needed.withColumnRenamed("id", "_need"), F.lower("id") == F.col("_need"), "left_semi")
