"""Rows of the note model and the remaining scanners."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia import schema
from marginalia.functions import scanners as sc
from marginalia.operators import model


def test_rows(spark):
    paths = spark.createDataFrame([("a/b/x.md",), ("a/y.md",), ("z.md",)], "path string")
    rows = {r["title"]: r for r in model.folder_rows(paths, "ns").collect()}
    assert set(rows) == {"a", "b"} and rows["b"]["parent_id"] == rows["a"]["id"] and rows["a"]["parent_id"] is None and rows["b"]["depth"] == 2
    notes = spark.createDataFrame([("n1", ["X", "y", "X", " "]), ("n2", ["x"])], "id string, tags array<string>")
    tags, relations = model.tag_rows(notes, "ns")
    assert sorted(r["title"].lower() for r in tags.collect()) == ["x", "y"] and relations.count() == 3 and relations.select("id").distinct().count() == 3
    items = spark.createDataFrame([("i", 1, "t", 5)], "id string, type_ int, title string, size long")
    props = model.with_properties(items).first()["properties"]
    assert [p["key"] for p in props] == model.PROPERTY_ORDER[schema.NOTE] and props[0]["value"] == "i" and props[-1]["value"] == "1"
    stored = spark.createDataFrame([(2, "b", "T", 2), (1, "a", "T", 2), (0, "c", "U", 1)], "note_id long, id string, title string, type_ int")
    got = {r["title"]: (r["id"], r["is_new"]) for r in model.find_or_create_folder(stored, spark.createDataFrame([("T",), ("U",)], "title string"), "ns").collect()}
    assert got["T"] == ("a", False) and got["U"][1] and len(got["U"][0]) == 32
    cand = spark.createDataFrame([("k", "v"), ("k", "v"), ("m", "v"), ("m", "w")], "key string, value string")
    assert {tuple(r) for r in model.single_candidate(cand, "key", "value", F.lit("f")).collect()} == {("k", "v"), ("m", "f")}
    rel = spark.createDataFrame([("n", 2, "a", "r1"), ("n", 1, "b", "r2")], "note_id string, ordinal int, kind string, resource_id string")
    assert model.first_attachment(rel).first()["resource_id"] == "r2"
    block = spark.range(1).select(model.frontmatter_block(F.lit('A "q"'), F.lit("2020"), F.lit(None).cast("string"), F.array(F.lit("x")))).first()[0]
    assert block == '---\ntitle: "A \\"q\\""\ncreated: "2020"\ntags:\n  - "x"\n---\n' and sc.frontmatter(sc.split_frontmatter(block)[0]) == {"title": 'A "q"', "created": "2020", "tags": ["x"]}


def test_images_and_attachments(spark):
    images = spark.createDataFrame([("n", 0, 1, "![](u)", "u"), ("n", 9, 3, "![](u)", "u"), ("n", 20, 4, "![](v)", "v")], "note string, start int, line int, raw string, destination string")
    import hashlib

    fp = hashlib.sha256(b"![](u)").hexdigest()
    hit, miss = model.select_problems(images, spark.createDataFrame([("n", fp, 2), ("n", fp, 3)], "note string, fingerprint string, occurrence int"))
    assert [r["start"] for r in hit.collect()] == [9] and [r["occurrence"] for r in miss.collect()] == [3]
    known = spark.createDataFrame([("u", "r1", None)], "destination string, resource_id string, problem string")
    assert sorted(r["outcome"] for r in model.localised_images(images, known).collect()) == ["converted", "converted", "untried"]
    notes = spark.createDataFrame([("n", "[a](:/" + "A" * 32 + ") [b](:/" + "b" * 32 + ")")], "id string, body string")
    there, missing = model.reachable_attachments(notes, spark.createDataFrame([("a" * 32,)], "id string"))
    assert there.count() == 1 and missing.first()["resource_id"] == "b" * 32


def test_dependency_closure(spark):
    h = lambda c: c * 32
    p = lambda **k: list(k.items())
    rows = [(h("1"), 1, p(id=h("1"), parent_id=h("f"), source=h("4"))), (h("f"), 2, p(id=h("f"))), (h("4"), 4, p(id=h("4"))), (h("5"), 5, p(id=h("5"))), (h("6"), 6, p(id=h("6"), note_id=h("1"), tag_id=h("5"))), (h("7"), 6, p(id=h("7"), note_id=h("2"), tag_id=h("5"))), (h("2"), 1, p(id=h("2")))]
    items = spark.createDataFrame(rows, "id string, type_ int, properties array<struct<key:string,value:string>>")
    got = model.dependency_closure(items, spark.createDataFrame([(h("1"),)], "id string"))
    assert {r["id"][0] for r in got.collect()} == {"1", "4", "6", "5"}


def test_more_scanners():
    assert sc.block_anchors("text ^a-1\n`x ^no`\n```\n^no2\n```\n^b") == ["a-1", "b"]
    assert sc.without_repeated_heading("\n# The  Title #\n\nbody", "the title") == "body" and sc.without_repeated_heading("T\n===\nb", "t") == "b" and sc.without_repeated_heading("# Other\n", "t") == "# Other\n"
    assert sc.escaped_raw_text("<script>x</script> `<style>` <svg><title>t</title></svg><Title>") == "&lt;script>x&lt;/script> `<style>` <svg><title>t</title></svg>&lt;Title>"
    assert sc.bare_url_links("[http://a/b](http://a/b) `[http://a](http://a)` ![http://a](http://a)") == "http://a/b `[http://a](http://a)` ![http://a](http://a)"
    assert sc.linked_mentions("hi @me, a@b `@no`", "https://h/") == "hi [@me](https://h/me), a@b `@no`"
    assert sc.has_shape({"a": 1}, {"a": int}, {"b": str}) and not sc.has_shape({"a": True}, {"a": int}) and not sc.has_shape({"a": 1, "c": 1}, {"a": int})
