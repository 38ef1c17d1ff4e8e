"""The note engine's operators on small literal cases."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from marginalia.functions import ids, links, text
from marginalia.functions import scanners as sc
from marginalia.operators import compare, graph, ingest, relational, search, tagindex
from marginalia.sources import corpus, messages, publications, raw_items, sinks, vaults
from marginalia.streaming import imports


def one(spark, expr, *values):
    schema = ", ".join(f"c{k} {'binary' if isinstance(v, bytes) else 'long' if isinstance(v, int) else 'array<string>' if isinstance(v, list) else 'string'}" for k, v in enumerate(values))
    return spark.createDataFrame([tuple(bytearray(v) if isinstance(v, bytes) else v for v in values)], schema).select(expr.alias("x")).first()["x"]


C = F.col


@pytest.mark.parametrize(("body", "title"), [("# Head\nrest", "Head"), ("\n\n** bold", "bold"), ("", "Untitled"), (None, "Untitled"), ("---", "Untitled"), ("- `x` y", "x` y"), ("a b", "a b")])
def test_titles(spark, body, title):
    assert one(spark, text.title_from_body(C("c0")), body) == title


def test_text_functions(spark):
    assert one(spark, text.reading_minutes(C("c0")), "w " * 214) == 2 and one(spark, text.reading_minutes(C("c0")), " ") == 0
    assert one(spark, text.word_tags(C("c0")), "The Café can't re-use x2 Don't 12ab ÉCOLE école it's") == ["12ab"[:0] or "café", "re-use", "école"]
    assert one(spark, text.explicit_tags(C("c0")), "#Café/x-1 a#b #two/ x/#no") == ["café/x-1", "two"]
    assert one(spark, text.emoji_symbols(C("c0")), "a 😃 © 😡😃") == ["😃", "😡"]
    assert one(spark, text.is_emoji_term(C("c0")), "👍🏽") and not one(spark, text.is_emoji_term(C("c0")), "a😃")
    assert one(spark, text.sanitised_name(C("c0")), 'Q1/Q2: Plan?* . ') == "Q1 Q2 Plan" and one(spark, text.sanitised_name(C("c0")), "con") == "_con"
    assert one(spark, text.resource_links(C("c0")), '![a](:/' + "A" * 32 + ') [b](:/' + "b" * 32 + ' "t")') == ["A" * 32, "b" * 32]
    assert one(spark, text.without_title_line(C("c0"), C("c1")), "# T\n\nbody", "T") == "body"
    assert one(spark, text.remove_line_breakers(C("c0")), "a\nb\u2028c\x85d") == "a b c d"


def test_ids(spark):
    import hashlib

    assert one(spark, ids.posting_bucket(C("c0")), "canadian") == 2872
    assert one(spark, ids.fnv1a(C("c0")), "") == ids.FNV_OFFSET
    parts = [b"mapper", "db-é".encode(), b"note", b"x"]
    want = hashlib.sha256(b"MNID\0" + len(parts).to_bytes(4, "big") + b"".join(len(p).to_bytes(4, "big") + p for p in parts)).hexdigest()[:32]
    assert one(spark, ids.framed_id(C("c0"), C("c1"), C("c2"), C("c3")), "mapper", "db-é", "note", "x") == want
    assert one(spark, ids.vault_id("ns", F.lit("note"), C("c0")), "a/b.md") == hashlib.sha256(b"ns\0note\0a/b.md").hexdigest()[:32]
    assert one(spark, ids.issue_id(C("c0"), C("c1"), F.lit(2), F.lit("k")), "n", "f") == hashlib.sha256(b"n\0f\0002\0k").hexdigest()[:20]


def test_links(spark):
    assert one(spark, links.host_aliases(C("c0")), "https://a.b.kqed.org/x?y") == ["b.kqed.org", "kqed.org"]
    body = one(spark, links.search_body(C("c0"), C("c1")), "prose", ["https://www.s.com/a", "https://x.s.com"])
    assert body == "prose https://www.s.com/a https://x.s.com s.com"
    got = {t: one(spark, links.classify_kept(C("c0")), t) for t in ("#a", "C:/x", "x.md", "https://h", "http://h", "mailto:a", "data:x", "file:///a", "foo:1", ":/" + "a" * 32)}
    assert {t: x and tuple(x) for t, x in got.items()} == {"#a": None, "C:/x": ("unreachable", "drive-letter path"), "x.md": ("unreachable", "unresolved link"), "https://h": None, "http://h": ("insecure", "http: link"), "mailto:a": ("verify", "mailto: link"), "data:x": ("data", "data: link"), "file:///a": ("unreachable", "file: URL"), "foo:1": ("unreachable", "foo: link"), ":/" + "a" * 32: ("unreachable", "unresolved internal link")}
    assert one(spark, links.matched_domain(C("c0"), ["b.org", "a.com"]), "x.A.com.") == "a.com" and one(spark, links.matched_domain(C("c0"), ["a.com"]), "xa.com") is None
    assert one(spark, links.ancestor_dirs(C("c0")), "a/b/c.md") == ["a", "a/b"]
    assert [one(spark, links.safe_path(C("c0")), p) for p in ("a/b", "../a", "/a", "a//b", "a\\b", "")] == [True, False, False, False, False, False]


def test_scanners(spark):
    body = "a `![x](y)` ![alt](u(1).png \"t\") ![b](<c d>)\n```\n![no](no)\n```\n![z](data:image/png;base64,AA\n"
    got = sc.image_links(body)
    assert [(x["destination"], x["line"], x["malformed"]) for x in got] == [("u(1).png", 1, False), ("c d", 1, False), ("", 5, True)]
    assert [(x["kind"], x["target"], x["column"]) for x in sc.text_links("[l](http://a) <http://b> see http://c/(d). @me x@y [[N|al]] ![i](p)")] == [("markdown", "http://a", 1), ("angle", "http://b", 15), ("bare", "http://c/(d)", 30), ("mention", "me", 44), ("wiki", "N", 52), ("image", "p", 61)]
    assert sc.trailing_split("http://a/(b))).") == ("http://a/(b)", ")).")
    assert sc.repaired_url("HTTP://Bücher.example/a b?q=%zz#ü") == "http://xn--bcher-kva.example/a%20b?q=%25zz#%C3%BC"
    assert sc.repaired_url("http://") is None and sc.repaired_url("ftp://h") is None and sc.repaired_url("http://h:99999999/") is None
    assert sc.tag_prefix("Éa") == "ea" and sc.tag_prefix("日本") == "u65e5" and sc.tag_prefix("--") == "__" and sc.tag_prefix("x") == "x_"
    assert sc.prose_of("see [label](http://x/y) and `code` [[Dir/Note#h]] http://z <b>t</b>").split() == "see label and Note t".split()
    assert sc.split_frontmatter("---\na: 1\n---\nbody") == ("a: 1\n", "body") and sc.split_frontmatter("--- x\n") == ("", "--- x\n") and sc.split_frontmatter("﻿---\n...\nb") == ("", "b")
    assert sc.frontmatter("title: 'T'\ntags:\n  - a\n  - 2\nn: null\nb: true\nl: [1, 2]\n") == {"title": "T", "tags": ["a", "2"], "n": None, "b": True, "l": [1, 2]}
    for bad in ('{"a":1,"a":2}', "NaN", "9223372036854775808", '"\\ud800"', "[" * 70 + "]" * 70, "{"):
        with pytest.raises(sc.Refused):
            sc.strict_json(bad)
    assert sc.strict_json('{"a":[1,{"b":"\\ud83d\\ude03"}]}') == {"a": [1, {"b": "😃"}]}
    assert sc.unpacked(sc.packed(b"x" * 1000)) == b"x" * 1000 and sc.unpacked("!!") is None and sc.unpacked(sc.packed(b"x" * 1000), 10) is None
    assert sc.data_uri("data:image/png;base64,iVBORw0K")["content"] == b"\x89PNG\r\n" and sc.data_uri("data:image/png;base64,@")["problem"] == "invalid base64" and sc.data_uri("data:text/x,a")["problem"] == "not an image"
    assert sc.replace_spans("abcdef", [(4, 5, "X"), (0, 1, "")]) == "bcdXf"
    with pytest.raises(ValueError):
        sc.replace_spans("abc", [(0, 2, ""), (1, 3, "")])
    assert sc.project_bytes("aéb".encode(), [(1, 3, "é".encode(), b"E"), (0, 1, b"z", b"")]) == b"aEb"
    assert sc.cut_utf8("aé", 2) == "a" and sc.slug("Crème Brûlée!") == "creme-brulee" and sc.non_public("10.0.0.1") and not sc.non_public("8.8.8.8")
    df = spark.createDataFrame([("Straße ΣΑΣ",), (None,)], "s string")
    assert [r[0] for r in df.select(sc.casefold("s")).collect()] == ["strasse σασ", None]
    assert spark.createDataFrame([(body,)], "s string").select(F.size(sc.images("s"))).first()[0] == 3


def test_relational(spark):
    items = spark.createDataFrame([(1, "h", "folder"), (2, "h", "note"), (3, None, "note"), (4, None, "note"), (5, "k", "note"), (6, "k", "tag")], "note_id long, note_hash string, note_type string")
    assert sorted(r[0] for r in relational.drop_duplicate_notes(items).collect()) == [1, 3, 5, 6]
    parents = spark.createDataFrame([("p", "B", 2), ("p", "A", 1), ("", "E", 3)], "id string, title string, n long")
    kids = spark.createDataFrame([(1, "p", None), (2, "q", None), (3, "p", "own"), (4, "", None), (5, None, None)], "k long, parent string, note_folder string")
    got = relational.with_parent_title(kids, parents, parent_key="parent", key="id", title="title", order="n")
    assert {r["k"]: r["note_folder"] for r in got.collect()} == {1: "A", 2: None, 3: "own", 4: None, 5: None}
    rel = spark.createDataFrame([("n", "t1"), ("n", "t1"), ("n", "t2"), ("m", "t3")], "note string, tag string")
    tags = spark.createDataFrame([("t1", "b"), ("t2", "a"), ("t3", "")], "id string, title string")
    assert [tuple(r) for r in relational.tag_lists(rel, tags, note="note", tag="tag", key="id", title="title").collect()] == [("n", ["a", "b", "b"])]
    pairs = spark.createDataFrame([([("a", "1"), ("b", "2"), ("a", "3")],)], "p array<struct<k:string,v:string>>")
    assert pairs.select(relational.last_values(C("p"))).first()[0] == {"a": "3", "b": "2"}
    items = spark.createDataFrame([(1, "a", "x"), (2, "b", "b"), (3, "c", "a")], "id long, u string, v string")
    keys = spark.createDataFrame([("a",), ("b",), ("z",)], "key string")
    assert {tuple(r) for r in relational.disjunctive_lookup(keys, items, "key", ["u", "v"], "id").collect()} == {("b", 2)}
    cand = spark.createDataFrame([(1, "a/x", 0), (1, "x", 1), (2, "y", 0)], "link long, name string, rank long")
    targets = spark.createDataFrame([("x", "T1"), ("y", "T2"), ("y", "T3")], "key string, target string")
    got = relational.resolve_names(cand, targets, link="link", name="name", priority="rank", key="key", target="target")
    assert {tuple(r) for r in got.collect()} == {(1, "T1"), (2, None)}


def test_graph(spark):
    tree = spark.createDataFrame([("a", None, "A"), ("b", "a", "B"), ("c", "b", "C"), ("d", "x", "D"), ("e", "f", "E"), ("f", "e", "F"), ("g", "g", "G")], "id string, parent_id string, name string")
    assert {r[0] for r in graph.folder_closure(tree, ["B"], title="name").collect()} == {"b", "c"}
    assert {r[0] for r in graph.folder_closure(tree, ["E"], title="name").collect()} == {"e", "f"}
    with pytest.raises(ValueError, match="Nope"):
        graph.folder_closure(tree, ["Nope"], title="name")
    paths = {r["id"]: r["path"] for r in graph.folder_paths(tree).collect()}
    assert paths["c"] == "A/B/C" and paths["d"] == "D" and paths["g"] == "G" and set(paths) == set("abcdefg")
    faults = {tuple(r) for r in graph.chain_faults(tree).collect()}
    assert faults == {("e", "cycle"), ("f", "cycle"), ("g", "cycle")}
    long = spark.createDataFrame([(i, i - 1 if i else None) for i in range(40)], "id long, parent_id long")
    assert {r["fault"] for r in graph.chain_faults(long, limit=32).collect()} == {"depth"}
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "src long, dst long")
    assert {r[0] for r in graph.reachable(spark.createDataFrame([(1,)], "id long"), edges).collect()} == {1, 2, 3}
    hops = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    assert [r["final"] for r in graph.redirect_ends(spark.createDataFrame([("a",), ("z",)], "url string"), hops).orderBy("url").collect()] == ["c", "z"]


def test_compare(spark):
    a = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "k string")
    b = spark.createDataFrame([("x",), ("z",), (None,)], "k string")
    got = compare.identity_summary(a, b, "k").first().asDict()
    assert got == {"left_rows": 4, "left_keys": 2, "left_repeats": 1, "missing": 2, "right_rows": 3, "right_keys": 2, "right_repeats": 0, "extra": 2}
    assert compare.multiset_matches(a, b, "k").first()[0] == 1 and compare.whole_row_matches(a, b).first()[0] == 2
    assert compare.inventory_difference(a, b).count() == 3
    same = [compare.table_fingerprint(x, ["k"]).first()["digest"] for x in (a, a.orderBy(F.desc("k")), b)]
    assert same[0] == same[1] != same[2]


def test_ingest(spark, tmp_path):
    stored = spark.createDataFrame([("a", "1"), ("b", "1"), ("b", "2"), ("c", None)], "id string, digest string")
    new = spark.createDataFrame([("a", "1", 1), ("b", "1", 2), ("c", "1", 3), ("d", "1", 4)], "id string, digest string, n long")
    outcome = lambda **k: {r["id"]: r["outcome"] for r in ingest.classify(new, stored, key="id", digest="digest", **k).collect()}
    assert outcome() == {"a": "skip", "b": "collision", "c": "collision", "d": "new"}
    assert outcome(any_of=True) == {"a": "skip", "b": "skip", "c": "collision", "d": "new"}
    with pytest.raises(ingest.ImportCollision, match="b|c"):
        ingest.new_items(new, stored, key="id", digest="digest", order=["n"])
    good = new.where("id in ('a', 'd')").unionByName(new.where("id = 'd'"))
    assert [r["id"] for r in ingest.new_items(good, stored, key="id", digest="digest", order=["n"]).collect()] == ["d"]
    ingest.publish(stored, str(tmp_path / "p"))
    with pytest.raises(FileExistsError):
        ingest.publish(stored, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 4


def test_stream_import(spark, tmp_path):
    rows = spark.createDataFrame([("a", "1", 1), ("a", "1", 2), ("b", "2", 3)], "id string, digest string, n long")
    rows.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        imports.import_stream(stream, str(tmp_path / "store"), str(tmp_path / f"check{_}"), key="id", digest="digest", order=["n"]).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "store")).collect()) == ["a", "b"]


RAW = "Title\r\n\r\nbody line\n\nid: {id}\nparent_id: \ntype_: 1\ntitle: x\ntitle: Last: one\ncreated_time: 2020-01-02T03:04:05.678Z\nlatitude: 6e-323\nocr_text: a\x0cb\nis_todo: "


def test_raw_items(spark, tmp_path):
    (tmp_path / "B.MD").write_bytes(b"\xef\xbb\xbf" + RAW.format(id="1" * 32).encode())
    (tmp_path / "a.md").write_bytes(b"id: x\nnote_id: n\ntype_: 6")
    (tmp_path / "c.txt").write_bytes(b"no")
    got = {r["source_filename"]: r for r in raw_items.read(spark, str(tmp_path)).collect()}
    assert {n: r["scan_order"] for n, r in got.items()} == {"a.md": 1, "B.MD": 2}
    note = got["B.MD"]
    assert note["body"] == "Title\r\n\r\nbody line\n" and note["note_title"] == "Title" and note["title"] == "Last: one" and note["note_type"] == "note"
    assert [p["key"] for p in note["properties"]].count("title") == 2 and note["latitude"] == 6e-323 and note["is_todo"] is None
    assert dict((p["key"], p["value"]) for p in note["properties"])["ocr_text"] == "a\x0cb"
    assert got["a.md"]["body"] == "" and got["a.md"]["type_"] == 6 and got["a.md"]["note_id"] == "n"
    same = raw_items.serialised(raw_items.read(spark, str(tmp_path)), {"title": F.col("title")}).where("type_ = 1").first()
    assert bytes(same["bytes"]) == (tmp_path / "B.MD").read_bytes()
    new = raw_items.serialised(raw_items.read(spark, str(tmp_path)), {"title": F.lit("New")}).where("type_ = 1").first()
    assert b"title: x\ntitle: New\n" in bytes(new["bytes"])
    (tmp_path / "bad.md").write_bytes(b"text\nno block here")
    with pytest.raises(Exception, match="no property block"):
        raw_items.read(spark, str(tmp_path)).select("body").collect()


def test_messages(spark, tmp_path):
    tweet = {"id_str": "12", "created_at": "Wed Oct 10 20:19:24 +0000 2018", "full_text": "a &amp; b https://t.co/x", "retweet_count": "1234", "favorite_count": "5", "in_reply_to_status_id_str": "9", "in_reply_to_screen_name": "me", "entities": {"urls": [{"url": "https://t.co/x", "expanded_url": "https://e.org/"}]}}
    (tmp_path / "tweets.js").write_text("window.YTD.tweets.part0 = " + json.dumps([{"tweet": tweet}, {**tweet, "id_str": "13", "full_text": "w" * 50 + " " + "v" * 50}]))
    (tmp_path / "account.js").write_text('window.YTD.account.part0 = [{"account": {"username": "me"}}]')
    got = {r["id"]: r for r in messages.notes(messages.read(spark, str(tmp_path / "tweets.js"))).collect()}
    assert got["12"]["body"] == "In reply to: [@me](https://x.com/i/web/status/9)\n\na & b https://e.org/\n\n[8:19 PM · Oct 10, 2018](https://x.com/i/web/status/12) 🔁 1,234 💙 5"
    assert got["13"]["note_title"] == "w" * 50 + "…"
    assert messages.username(spark, str(tmp_path / "account.js")) == "me" and messages.username(spark, str(tmp_path / "none.js")) is None


def test_vault(spark, tmp_path):
    files = {"A/Dup.md": "---\ntitle: One\ntags: [x, '#Y']\ndate: 2020-01-02\n---\nSee #inline and https://a.b.org/p words", "b.markdown": "# Two\nnothing [l](:/" + "a" * 32 + ")", ".hidden/x.md": "h", "_u.md": "under", ".obsidian/c.md": "no", "pic.png": "p"}
    for name, body in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(body)
    every = vaults.all_files(spark, str(tmp_path))
    assert sorted(r["path"] for r in every.collect()) == sorted(files)
    shown = vaults.visible(every)
    assert sorted(r["path"] for r in shown.collect()) == ["A/Dup.md", "_u.md", "b.markdown", "pic.png"]
    notes = vaults.notes(shown)
    got = {r["path"]: r for r in notes.collect()}
    assert {p: r["note_id"] for p, r in got.items()} == {"_u.md": 0, "A/Dup.md": 1, "b.markdown": 2}
    assert got["A/Dup.md"]["title"] == "One" and got["A/Dup.md"]["explicit_tags"] == ["inline", "x", "y"] and got["b.markdown"]["title"] == "Two"
    rows = {r["id"]: r for r in vaults.search_corpus(notes).collect()}
    assert rows[1]["date"] == "2020-01-02T00:00:00Z" and rows[1]["category"] == "A" and rows[1]["body"].endswith("https://a.b.org/p b.org") and rows[1]["url"] == "/A/Dup.html"
    att = vaults.attachments(spark.createDataFrame([("r/" + "a" * 32 + ".pdf",), ("r/" + "b" * 32 + ".png",)], "path string"))
    assert [r["id"] for r in vaults.orphans(att, notes).collect()] == ["b" * 32]
    (tmp_path / "stop.txt").write_text("foo, Bar # no\nbaz")
    assert {"foo", "bar", "baz", "the"} <= set(vaults.stop_words(spark, str(tmp_path / "stop.txt")))
    t = lambda v: one(spark, vaults.normalised_time(C("c0")), v)
    assert [t(v) for v in ("1600000000", "1600000000000", "2020-01-02T03:04:05+02:00", "2020/01/02", "x")] == ["2020-09-13T12:26:40Z", "2020-09-13T12:26:40Z", "2020-01-02T01:04:05Z", "2020-01-02T00:00:00Z", None]
    assert one(spark, vaults.floored_millis(C("c0")), "2020-01-02T03:04:05.6789Z") == "2020-01-02T03:04:05.678Z"


def test_publication(spark, tmp_path):
    import hashlib

    blob = b"hello"
    sha = hashlib.sha256(blob).hexdigest()
    (tmp_path / "objects" / sha[:2]).mkdir(parents=True)
    (tmp_path / "objects" / sha[:2] / sha).write_bytes(blob)
    declared = spark.createDataFrame([(sha, 5), ("0" * 64, 1)], "sha256 string, size_bytes long")
    assert {r["fault"] for r in publications.verified_blobs(spark, str(tmp_path / "objects"), declared).collect()} == {None, "missing"}
    (tmp_path / "index.jsonl").write_text("\n".join(json.dumps({"sha256": h, "kind": "blob", "size_bytes": n}) for h, n in ((sha, 5), (sha, 5), ("x", 1), ("1" * 64, -1))))
    faults = {r["sha256"]: r["fault"] for r in publications.index_faults(publications.read_index(spark, str(tmp_path / "index.jsonl"))).collect()}
    assert faults == {sha: "repeated", "x": "hash", "1" * 64: "size"}
    (tmp_path / "r.jsonl").write_text('{"type":"note","payload":{"id":"a"}}\n{"type":"note","payload":{}}\n')
    records = publications.read_records(spark, str(tmp_path / "r.jsonl"))
    index = spark.createDataFrame([("r.jsonl", {"note": 3})], "sha256 string, record_counts map<string,long>")
    assert [tuple(r) for r in publications.count_faults(records, index).collect()] == [("r.jsonl", "note", 3, 2)]
    (tmp_path / "bad.jsonl").write_text('{"type":"a","type":"b"}')
    with pytest.raises(Exception, match="refused"):
        publications.read_records(spark, str(tmp_path / "bad.jsonl")).collect()
    good = {"format": "f", "schema_version": 12, "note_ids": ["a", "b"]}
    assert publications.manifest(json.dumps(good), {"format": str, "schema_version": int}) == good
    for bad in ({**good, "schema_version": 99}, {**good, "note_ids": ["b", "a"]}, {"format": 1}):
        with pytest.raises(sc.Refused):
            publications.manifest(json.dumps(bad), {"format": str})
    assert publications.canonical_json({"b": "<é>", "a": 1}) == '{"a":1,"b":"\\u003cé\\u003e"}'.encode()


def test_sinks(spark, tmp_path):
    files = spark.createDataFrame([("a/x.md", bytearray(b"1")), ("b.md", bytearray(b"2"))], "name string, bytes binary")
    assert sinks.write_files(files, str(tmp_path / "out")) == 2 and (tmp_path / "out/a/x.md").read_bytes() == b"1"
    for bad in ([("A.md", b"1"), ("a.md", b"2")], [("../x", b"1")]):
        with pytest.raises(FileExistsError):
            sinks.write_files(spark.createDataFrame([(n, bytearray(b)) for n, b in bad], "name string, bytes binary"), str(tmp_path / "no"))
    a, b = spark.createDataFrame([("x", "1"), ("y", "2")], "name string, sha256 string"), spark.createDataFrame([("x", "1")], "name string, sha256 string")
    assert {tuple(r) for r in sinks.copy_set(a, b).collect()} == {("x", "skip"), ("y", "new")}
    with pytest.raises(FileExistsError):
        sinks.copy_set(a, b.withColumn("sha256", F.lit("9")))
    tags = spark.createDataFrame([(1, "cat"), (2, "cat"), (1, "dog")], "note_id long, tag string")
    sinks.write_tag_index(tags, str(tmp_path / "tags"))
    back = spark.read.json(str(tmp_path / "tags/postings"))
    assert {r["tag"]: list(r["notes"]) for r in back.collect()} == {"cat": [1, 2], "dog": [1]}
    issues = spark.createDataFrame([("remote", "n.md", 3, "timeout", "id1"), ("data", "n.md", 1, "bad", "id2")], "category string, note string, line int, reason string, issue_id string")
    report = [r["text"] for r in sinks.problem_report(issues).collect()]
    assert report == ["## data", "- [ ] n.md:1 bad <!-- id2 -->", "## remote", "- [ ] n.md:3 timeout <!-- id1 -->"]
    (tmp_path / "report.md").write_text("\n".join(report).replace("- [ ] n.md:3", "- [x] n.md:3"))
    assert {(r["category"], r["checked"]) for r in corpus.unchecked(spark, str(tmp_path / "report.md")).collect()} == {("data", False), ("remote", True)}


def test_tag_index(spark):
    tags = spark.createDataFrame([(n, f"t{k}") for n in range(4) for k in range(n + 1)], "note_id long, tag string")
    assert [tuple(r) for r in tagindex.top_tags(tags, 2).collect()] == [("t0", 4), ("t1", 3)]
    assert {tuple(r) for r in tagindex.demoted_notes(tags, 2).collect()} == {(2, 1), (3, 2)}
    assert tagindex.taxonomy_cap(10) == 200 and tagindex.taxonomy_cap(30_000) == 3000 and tagindex.taxonomy_cap(10**6) == 5000
    counts = {r["tag"]: r["notes"] for r in tagindex.tag_counts(tags).collect()}
    assert {r["tag"]: len(r["notes"]) for r in tagindex.postings(tags).collect()} == counts
    assert [r["note_id"] for r in tagindex.posting_page(tagindex.postings(tags), "t0", 2, 2).collect()] == [2, 3]


CORPUS = [
    {"id": 0, "url": "/a", "title": "Climate report", "date": "2020-01-02T10:00:00Z", "body": "The ice sheet melts. https://globalnews.ca/news/100/more-canadians", "summary": "ice", "category": "Science", "tags": ["Ice", "News"], "readingTime": 1},
    {"id": 1, "url": "/b", "title": "Ice cream", "date": "2021-05-06T00:00:00Z", "body": "sheet of vanilla 😃", "summary": "dessert", "category": "Food", "tags": ["Food"], "readingTime": 2},
    {"id": 2, "url": "/c", "title": "Nothing", "date": "", "body": "plain text 😃😡", "summary": "", "category": "Food", "tags": None, "readingTime": 1},
]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus") / "c.jsonl"
    path.write_text("\n".join(map(json.dumps, CORPUS)))
    return search.index(corpus.read_corpus(spark, str(path))).persist()


T = lambda v: {"type": "term", "value": v}
N = lambda n: {"type": "not", "node": n}


@pytest.mark.parametrize(
    ("params", "want"),
    [
        ({"q": "ice"}, "ab"), ({"q": "ice sheet"}, "a"), ({"q": "cream vanilla"}, ""), ({"q": "globalnews.ca canadians"}, "a"), ({"q": "canad"}, ""), ({"phrase": "ice sheet"}, "a"), ({"phrase": "sheet ice"}, ""),
        ({"category": "Food"}, "bc"), ({"category": "food"}, ""), ({"tag": "ICE"}, "a"), ({"since": "2021-01-01"}, "b"), ({"since": "2020-01-02", "until": "2020-01-03"}, "a"), ({"until": "2021-05-06"}, "a"), ({"q": "😃"}, "bc"), ({"q": "😃😡"}, "c"), ({"q": "plain 😡"}, "c"), ({}, "abc"),
        ({"expr": {"type": "and", "nodes": [T("cream"), T("vanilla")]}}, "b"), ({"expr": {"type": "or", "nodes": [T("cream"), N(T("sheet"))]}}, "bc"), ({"expr": N(T("ice"))}, "c"), ({"expr": {"type": "and", "nodes": [N(T("cream")), N(T("plain"))]}}, "a"),
        ({"expr": {"type": "field", "field": "tag", "value": "News"}}, "a"), ({"expr": {"type": "phrase", "value": "of vanilla"}}, "b"), ({"expr": T("...")}, ""),
    ],
)
def test_search(table, params, want):
    request = search.request({k: [json.dumps(v) if k == "expr" else v] for k, v in params.items()})
    page, total = search.search(table, request)
    assert sorted(r["url"][1] for r in page.collect()) == [*want] and total == len(want)


def test_search_pages(table):
    page, total = search.search(table, search.request({"per": ["2"]}))
    got = page.collect()
    assert [r["url"] for r in got] == ["/b", "/a"] and total == 3 and got[1]["date"] == "2020-01-02" and got[1]["tags"] == ["Ice", "News"]
    assert [r["url"] for r in search.search(table, search.request({"per": ["2"], "page": ["2"]}))[0].collect()] == ["/c"]
    r = search.request({"limit": ["1000"], "offset": ["250"], "sort": ["relevance"]})
    assert (r.per, r.page, r.offset, r.by_date) == (100, 3, 250, False)
    assert search.request({"per": ["x"], "page": ["-3"]}).page == 1
    for bad in ({"since": ["2020-02-30"]}, {"since": ["2020-01-02"], "until": ["2020-01-02"]}, {"expr": ["{"]}, {"expr": ['{"type":"and","nodes":[]}']}, {"expr": ['{"type":"term"}']}, {"expr": ['{"type":"field","field":"x","value":"y"}']}, {"expr": ['{"type":"zap"}']}, {"expr": ['{"type":"not"}']}, {"expr": [" " * 9000 + "{}"[:0] + '"' + "x" * 9000 + '"']}):
        with pytest.raises(search.BadQuery):
            search.request(bad)
    deep = T("a")
    for _ in range(40):
        deep = N(deep)
    with pytest.raises(search.BadQuery):
        search.validate(deep)
    tree = {"type": "and", "nodes": [{"type": "or", "nodes": [T("a"), T("b c")]}, N({"type": "phrase", "value": "x y"}), {"type": "field", "field": "tag", "value": "t"}]}
    assert search.echo(tree) == '(a OR "b c") -"x y" tag:t'


def sequential_names(rows):
    """Each row's name in turn, as unique_names states it."""
    used, out = set(), {}
    for i, d, name in rows:
        made, k = name, 2
        while (d, made.lower()) in used:
            made, k = f"{name} {k}", k + 1
        used.add((d, made.lower()))
        out[i] = made
    return out


def test_unique_names_are_unique(spark):
    names = ["a", "A", "a 2", "a", "b", "B 2", "b", "a 2", "2024", "2024", "", "a 2 2", "c 7", "c 7", "x" * 60, "X" * 60, "x" * 60 + " 2", "d"]
    rows = [(i, "k" if i % 7 else "m", n) for i, n in enumerate(names * 3)]
    items = spark.createDataFrame(rows, "i long, d string, n string").repartition(5)
    got = relational.unique_names(items, directory=["d"], name="n", order=["i"]).collect()
    assert {r["i"]: r["unique_name"] for r in got} == sequential_names(rows) and len(got) == len(rows)
    long = spark.createDataFrame([(i, "d", "é" * 130) for i in range(3)], "i long, d string, n string")
    made = [r["unique_name"] for r in relational.unique_names(long, directory=["d"], name="n", order=["i"]).orderBy("i").collect()]
    assert made == ["é" * 120, "é" * 119 + " 2", "é" * 119 + " 3"]


def test_folder_paths_on_cycles_selections_and_equal_names(spark):
    tree = spark.createDataFrame([(1, 2, "x"), (2, 1, "y"), (3, 2, "z"), (5, None, "r"), (6, 5, "s"), (7, 5, "S"), (8, 7, "t"), (0, 6, "u"), (20, 21, "p"), (21, 22, "q"), (22, 21, "w")], "id long, parent_id long, name string")
    paths = {r["id"]: (r["path"], r["depth"]) for r in graph.folder_paths(tree).collect()}
    assert paths == {2: ("y", 1), 1: ("y/x", 2), 3: ("y/z", 2), 5: ("r", 1), 6: ("r/s", 2), 7: ("r/S 2", 2), 8: ("r/S 2/t", 3), 0: ("r/s/u", 3), 22: ("w", 1), 21: ("w/q", 2), 20: ("w/q/p", 3)}
    some = spark.createDataFrame([(7,), (8,), (6,)], "id long")
    assert {r["id"]: r["path"] for r in graph.folder_paths(tree, selected=some).collect()} == {6: "s", 7: "S 2", 8: "S 2/t"}


def test_null_tags_and_combining_marks(spark):
    rows = [(1, "caf\u00e9", ["fr", None]), (2, "cafe\u0301 noir", [None]), (3, "tea", None)]
    corpus = spark.createDataFrame(rows, "id long, body string, tags array<string>").selectExpr("id", "'' url", "'' title", "cast(null as string) date", "body", "'' summary", "'' category", "tags", "1 readingTime")
    ids = lambda node: {r["id"] for r in search.hits(search.index(corpus), search.Request(expr=node)).collect()}
    tag = {"type": "field", "field": "tag", "value": "fr"}
    assert ids(tag) == {1} and ids({"type": "not", "node": tag}) == {2, 3}
    assert ids({"type": "term", "value": "cafe\u0301"}) == {2} and ids({"type": "term", "value": "caf\u00e9"}) == {1}


def test_faults_of_a_tree():
    good = {"type": "not", "node": {"type": "field", "field": "since", "value": "2024-01-31"}}
    search.validate({"type": "and", "nodes": [good, {"type": "term", "value": "x"}]})
    for node, said in ((None, "empty"), ({"type": "not"}, "empty"), ({"type": "and", "nodes": []}, "no operands"), ({"type": "term"}, "no value"), ({"type": "field", "field": "x", "value": "y"}, "unknown field"), ({"type": "?"}, "unknown node"), ({"type": "not", "node": {"type": "field", "field": "until", "value": "2024-02-30"}}, "YYYY-MM-DD")):
        with pytest.raises(search.BadQuery, match=said):
            search.validate(node)


def test_checks_of_files_and_time(spark, tmp_path):
    import time

    from marginalia.operators import checks

    (tmp_path / "a.md").write_text("x")
    first = checks.freshness(spark, str(tmp_path)).first()
    assert first["files"] == 1 and checks.freshness(spark, str(tmp_path)).first() == first
    (tmp_path / "b.md").write_text("y")
    assert checks.freshness(spark, str(tmp_path)).first()["stamp"] != first["stamp"]
    assert checks.within(spark, "count", 60, spark.range(10).count) == 10
    began = time.time()
    slow = spark.range(8).repartition(4).selectExpr("id", "java_method('java.lang.Thread', 'sleep', cast(20000 as bigint))")
    with pytest.raises(Exception, match="(?i)cancel"):
        checks.within(spark, "slow", 2, slow.collect)
    assert time.time() - began < 20
    rows = spark.createDataFrame([(1, "A/x.md"), (2, "a/X.md"), (3, "a/X.md"), (4, "b"), (5, "B")], "i long, path string")
    got = [r["output_path"] for r in checks.output_paths(rows, path="path", order=["i"]).orderBy("i").collect()]
    assert got[0] == "A/x.md" and got[1].startswith("a/X-") and got[2] == got[1].replace(".md", "-2.md") and got[3] == "b" and got[4].startswith("B-") and len({g.lower() for g in got}) == 5
    kept = spark.createDataFrame([("k", 1, b"x")], "kind string, id long, raw binary")
    assert checks.backfilled(kept, "raw", "digest").first()["digest"] == __import__("hashlib").sha256(b"x").digest() and checks.of_kind(kept, "k").count() == 1 and checks.of_kind(kept, "l").count() == 0
