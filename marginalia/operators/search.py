"""Boolean full-text search: a query tree becomes one Column over token arrays."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import date, datetime
from functools import reduce
from typing import Any

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import emoji_symbols

#: Bounds of a request.
MAX_BYTES, MAX_DEPTH, PER_PAGE, MAX_PER_PAGE, MAX_OFFSET, MAX_PAGE, DISPLAY_TAGS = 8 << 10, 32, 20, 100, 10_000_000, 1 << 20, 8
FIELDS = ("title", "summary", "body")
WEIGHTS = {"title": 4, "summary": 2, "body": 1}
#: A token: letters, digits and underscores, joined by dots or apostrophes.
TOKEN = r"[\p{L}\p{M}\p{N}_]+(?:[.'’][\p{L}\p{M}\p{N}_]+)*"
EMOJI_FROM = 0x2000


class BadQuery(ValueError):
    """The request isn't a query; the text says why."""


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1))


def index(corpus: DataFrame) -> DataFrame:
    """The search table of a corpus (id, url, title, date, body, summary, category, tags, readingTime): token arrays of the three text
    fields, lower-cased tags, emoji and the date as a timestamp. Phrases are looked up in the text of the tokens, a blank to each side."""
    text = lambda f: F.coalesce(F.col(f), F.lit(""))
    out = corpus
    for f in FIELDS:
        out = out.withColumn(f"{f}_tokens", tokens(text(f)))
    tags = F.array_compact(F.transform(F.coalesce("tags", F.array().cast("array<string>")), F.lower))  # a null tag would make NOT null
    emoji = emoji_symbols(F.concat_ws(" ", *[text(f) for f in FIELDS]))
    return out.withColumn("tag_terms", tags).withColumn("emoji", emoji).withColumn("at", F.try_to_timestamp("date"))


def query_tokens(text: str) -> list[str]:
    """The tokens of a request, by the pattern that the index uses."""
    return regex.findall(TOKEN, text.lower())


def emoji_of(text: str) -> list[str]:
    import unicodedata

    return list(dict.fromkeys(c for c in text if ord(c) >= EMOJI_FROM and unicodedata.category(c) == "So"))


def is_emoji_term(text: str) -> bool:
    import unicodedata

    rest = [c for c in text if not (c in "\u200d\ufe0f" or unicodedata.category(c) == "Sk")]
    return bool(emoji_of(text)) and all(ord(c) >= EMOJI_FROM and unicodedata.category(c) == "So" for c in rest)


#: The node types of a request and what each must hold; the fields that can be asked for, and those of them that are days.
NODE_PARTS = {"and": "nodes", "or": "nodes", "not": "node", "term": "value", "phrase": "value", "field": "value"}
ASKED_FIELDS, DAY_FIELDS = ("category", "tag", "since", "until"), ("since", "until")
#: The messages.
EMPTY, DEEP, NO_OPERANDS, NO_VALUE, BAD_FIELD, BAD_TYPE = (
    "expr: empty node", f"expr: nested deeper than {MAX_DEPTH}", "expr: {0} with no operands", "expr: {0} with no value", "expr: unknown field {0!r}", "expr: unknown node type {0!r}",
)


def faults(node: Any) -> Iterator[str]:
    """What is wrong with a tree, from the top down."""
    todo: list[tuple[Any, int]] = [(node, 0)]
    while todo:
        here, depth = todo.pop()
        kind = here.get("type") if isinstance(here, Mapping) else None
        part = NODE_PARTS.get(kind) if isinstance(kind, str) else None
        held = here.get(part) if part else None
        if not isinstance(here, Mapping):
            yield EMPTY
        elif depth > MAX_DEPTH:
            yield DEEP
        elif part is None:
            yield BAD_TYPE.format(kind)
        elif kind == "field" and here.get("field") not in ASKED_FIELDS:
            yield BAD_FIELD.format(here.get("field"))
        elif part == "node":
            todo.append((held, depth + 1))
        elif not held:
            yield (NO_OPERANDS if part == "nodes" else NO_VALUE).format(kind)
        elif part == "nodes":
            todo += [(child, depth + 1) for child in reversed(held)]


def days_of(node: Mapping[str, Any]) -> Iterator[tuple[str, str]]:
    """The days that a sound tree names, with their fields."""
    if node.get("field") in DAY_FIELDS and node["type"] == "field":
        yield node["value"], node["field"]
    for child in [*node.get("nodes", ()), *([node["node"]] if node["type"] == "not" else [])]:
        yield from days_of(child)


def validate(node: Any) -> None:
    if fault := next(faults(node), None):
        raise BadQuery(fault)
    for text, name in days_of(node):
        day(text, name)


def parse(raw: str) -> dict | None:
    """The tree of a JSON request; None if it is blank."""
    if len(raw.encode()) > MAX_BYTES:
        raise BadQuery(f"expr: larger than {MAX_BYTES} bytes")
    try:
        node = json.loads(raw) if raw.strip() else None
    except ValueError as fault:
        raise BadQuery("expr: not valid JSON") from fault
    if raw.strip():
        validate(node)
    return node


def day(text: str, name: str) -> date:
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        raise BadQuery(f"{name}: expected YYYY-MM-DD")
    try:
        return datetime.strptime(text, "%Y-%m-%d").date()
    except ValueError:
        raise BadQuery(f"{name}: expected YYYY-MM-DD") from None


def _any(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def _all(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests) if tests else F.lit(True)


def words_match(value: str, fields: Sequence[str] = FIELDS) -> Column:
    """All words in one of the fields; words without a token match nothing."""
    own = list(dict.fromkeys(query_tokens(value)))
    if not own:
        return F.lit(False)
    return _any([_all([F.array_contains(f"{f}_tokens", w) for w in own]) for f in fields])


def phrase_match(value: str, fields: Sequence[str] = FIELDS) -> Column:
    """The words in a row in one of the fields."""
    own = query_tokens(value)
    if not own:
        return F.lit(False)
    text = lambda f: F.concat(F.lit(" "), F.array_join(f"{f}_tokens", " "), F.lit(" "))
    # the cheap test of the first word goes before the text of the tokens is made
    return _any([F.array_contains(f"{f}_tokens", own[0]) & F.contains(text(f), F.lit(f" {' '.join(own)} ")) for f in fields])


def emoji_match(value: str) -> Column:
    return _all([F.array_contains("emoji", s) for s in emoji_of(value)])


def compile_tree(node: Mapping[str, Any]) -> Column:
    """The tree as a predicate on the search table. A missing date is outside every date range."""
    kind = node["type"]
    if kind == "and":
        return _all([compile_tree(n) for n in node["nodes"]])
    if kind == "or":
        return _any([compile_tree(n) for n in node["nodes"]])
    if kind == "not":
        return ~compile_tree(node["node"])
    value = node["value"]
    if kind == "term":
        return emoji_match(value) if is_emoji_term(value) else words_match(value)
    if kind == "phrase":
        return phrase_match(value)
    if node["field"] == "category":
        return F.coalesce(F.col("category") == value, F.lit(False))
    if node["field"] == "tag":
        return F.array_contains("tag_terms", value.lower())
    bound = F.lit(str(day(value, node["field"]))).cast("timestamp")
    return F.coalesce(F.col("at") >= bound if node["field"] == "since" else F.col("at") < bound, F.lit(False))


@dataclass
class Request:
    """A flat request, or a tree in `expr`, with its page."""

    terms: str = ""
    phrases: list[str] = field(default_factory=list)
    categories: list[str] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    since: date | None = None
    until: date | None = None
    expr: dict | None = None
    per: int = PER_PAGE
    page: int = 1
    offset: int = 0
    by_date: bool = True


def _bounded(raw: str | None, default: int, least: int, most: int) -> int:
    try:
        return max(least, min(most, int(raw or "")))
    except ValueError:
        return default


def request(values: Mapping[str, Sequence[str]]) -> Request:
    """The request of URL parameters: q, phrase, category, tag, since, until, expr, per or limit, page or offset, sort."""
    one = lambda name: (values.get(name) or [""])[0].strip()
    many = lambda name: [v.strip() for v in values.get(name, ()) if v.strip()]
    out = Request(one("q"), many("phrase"), many("category"), many("tag"), expr=parse(one("expr")))
    for name in ("since", "until"):
        if one(name):
            setattr(out, name, day(one(name), name))
    if out.since and out.until and out.since >= out.until:
        raise BadQuery("since: must be earlier than until:")
    out.per = _bounded(one("per") or one("limit"), PER_PAGE, 1, MAX_PER_PAGE)
    if one("offset"):
        out.offset = _bounded(one("offset"), 0, 0, MAX_OFFSET)
        out.page = out.offset // out.per + 1
    else:
        out.page = _bounded(one("page"), 1, 1, MAX_PAGE)
        out.offset = (out.page - 1) * out.per
    out.by_date = one("sort") not in ("score", "relevance")
    return out


def predicate(r: Request) -> Column:
    """All clauses of a flat request, or the tree. All of a flat request's words must stand in one field."""
    if r.expr is not None:
        return compile_tree(r.expr)
    words = r.terms.split()
    clauses = [F.coalesce(F.col("category") == c, F.lit(False)) for c in r.categories] + [F.array_contains("tag_terms", t.lower()) for t in r.tags]
    clauses += [emoji_match(w) for w in words if is_emoji_term(w)]
    text = " ".join(w for w in words if not is_emoji_term(w))
    clauses += [words_match(text)] if text else []
    clauses += [phrase_match(p) for p in r.phrases]
    clauses += [compile_tree({"type": "field", "field": n, "value": str(d)}) for n, d in (("since", r.since), ("until", r.until)) if d]
    return _all(clauses)


def score(r: Request) -> Column:
    """Best effort: the weights of the fields that hold each word, summed."""
    own = [t for w in r.terms.split() if not is_emoji_term(w) for t in query_tokens(w)]
    parts = [F.array_contains(f"{f}_tokens", w).cast("int") * WEIGHTS[f] for f in FIELDS for w in own]
    return reduce(lambda a, b: a + b, parts) if parts else F.lit(0)


def hits(table: DataFrame, r: Request) -> DataFrame:
    return table.where(predicate(r))


def search(table: DataFrame, r: Request) -> tuple[DataFrame, int]:
    """The page, newest first or by score, ids break ties; and the number of all hits."""
    found = hits(table, r)
    order = [F.desc_nulls_last("at"), F.desc("score")] if r.by_date else [F.desc("score"), F.desc_nulls_last("at")]
    page = found.withColumn("score", score(r)).orderBy(*order, "id").offset(r.offset).limit(r.per)
    return results(page), found.count()


def results(page: DataFrame) -> DataFrame:
    tags = F.slice(F.filter(F.transform("tags", F.trim), lambda t: t != ""), 1, DISPLAY_TAGS)
    return page.select("id", "url", "title", F.substring("date", 1, 10).alias("date"), "summary", "category", F.array_sort(tags).alias("tags"), "readingTime")


def echo(node: Mapping[str, Any], inside: str = "") -> str:
    """The tree in the grammar: OR in capitals, - for not, parentheses where needed, field:value, quotes."""
    kind = node["type"]
    if kind in ("and", "or"):
        parts = (" OR " if kind == "or" else " ").join(echo(n, kind) for n in node["nodes"])
        return f"({parts})" if len(node["nodes"]) > 1 and (inside == "not" or inside == "and" and kind == "or") else parts
    if kind == "not":
        return "-" + echo(node["node"], "not")
    value = node["value"]
    if kind == "phrase":
        return f'"{value}"'
    quoted = f'"{value}"' if re.search(r"\s", value) else value
    return quoted if kind == "term" else f"{node['field']}:{quoted}"
