"""Operator 8. Benchmark decontamination by winnowing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches
from .shingles import Words, grams, hashed

#: Lower-cases A-Z and turns every ASCII byte but letters and digits into a space.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: Shared words that always give a hit; words in a hashed k-gram. The winnowing window has SPAN - K + 1 k-grams.
SPAN, K = 10, 5
#: Benchmark words in one broadcast block, about 30 bytes each. A larger benchmark goes through the documents in further blocks.
BLOCK_WORDS = 1_000_000
EMPTY = np.empty(0, np.int64)
NEW = {"n_words": T.LongType(), "hit_spans": T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])), "items": T.ArrayType(T.StringType())}
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def word_hashes(text: str | None, known: Words) -> np.ndarray:
    return hashed((text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split(), known)


def winnow(h: np.ndarray, w: int) -> np.ndarray:
    """Places of the smallest hash of each run of w hashes, the rightmost of equal ones; of all hashes if they are fewer than w."""
    if len(h) <= w:
        return np.array([len(h) - 1 - int(np.argmin(h[::-1]))]) if len(h) else EMPTY
    windows = np.lib.stride_tricks.sliding_window_view(h[::-1], w)
    return np.unique(len(h) - 1 - (np.arange(len(windows)) + windows.argmin(1)))


class Benchmark:
    """A block of items: words, fingerprints of the items with at least `span` words, whole hashes of the shorter ones by length."""

    def __init__(self, items: list[tuple[str, str | None]], span: int, k: int) -> None:
        known = Words()
        self.span, self.k = span, k
        self.ids = [i for i, _ in items]
        self.words = [word_hashes(t, known) for _, t in items]
        found: list[tuple[np.ndarray, int]] = []
        self.short: dict[int, dict[int, list[int]]] = {}
        for j, words in enumerate(self.words):
            if len(words) >= span:
                h = grams(words, k)
                at = winnow(h, span - k + 1)
                found.append((np.stack([h[at], np.full(len(at), j, np.uint64), at.astype(np.uint64)]), j))
            elif len(words):
                self.short.setdefault(len(words), {}).setdefault(int(grams(words, len(words))[0]), []).append(j)
        table = np.concatenate([x for x, _ in found], 1) if found else np.empty((3, 0), np.uint64)
        order = np.argsort(table[0], kind="stable")
        self.prints, self.item, self.at = table[0][order], table[1][order].astype(np.int64), table[2][order].astype(np.int64)

    def hits(self, words: np.ndarray) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans [from, to) of document words and the items that they come from."""
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        if len(self.prints) and len(words) >= self.span:
            h = grams(words, self.k)
            at = winnow(h, self.span - self.k + 1)
            lo, hi = np.searchsorted(self.prints, h[at], "left"), np.searchsorted(self.prints, h[at], "right")
            reached: dict[tuple[int, int], int] = {}  # up to where each diagonal has been extended
            for p, a, b in zip(at[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                for j, q in zip(self.item[a:b].tolist(), self.at[a:b].tolist(), strict=True):
                    if reached.get((j, p - q), -1) >= p + self.k:
                        continue
                    other = self.words[j]
                    if not (words[p : p + self.k] == other[q : q + self.k]).all():
                        continue
                    back, on = min(p, q), min(len(words) - p, len(other) - q)
                    differ = words[p - back : p][::-1] != other[q - back : q][::-1]
                    left = int(differ.argmax()) if differ.any() else back
                    differ = words[p : p + on] != other[q : q + on]
                    right = int(differ.argmax()) if differ.any() else on
                    reached[j, p - q] = p + right
                    if left + right >= self.span:
                        spans.append((p - left, p + right))
                        items.add(j)
        for length, by in self.short.items():
            h = grams(words, length)
            for p in np.flatnonzero(np.isin(h, np.fromiter(by, np.uint64, len(by)))).tolist():
                for j in by[int(h[p])]:
                    if (words[p : p + length] == self.words[j]).all():
                        spans.append((p, p + length))
                        items.add(j)
        return spans, items


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[str, str | None]]]:
    """The items, a bounded block at a time."""
    block, size = [], 0
    for row in benchmark.select(F.col(id_col).cast("string"), text_col).toLocalIterator():
        block.append((row[0], row[1]))
        size += 1 + len(row[1] or "") // 2
        if size >= block_words:
            yield block
            block, size = [], 0
    if block:
        yield block


def contamination(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", span: int = SPAN, k: int = K, block_words: int = BLOCK_WORDS, with_text: bool = True) -> DataFrame:
    """Adds to each document n_words long, hit_spans array<struct<start,end>> (word places, end exclusive, apart and in order) and
    items array<string>, sorted and distinct: the items of which `span` words in a row, or all if fewer, stand in the document.

    Both sides keep the smallest k-gram hash of each window of span - k + 1 k-grams, so every shared run of span words shares a
    fingerprint at the same place of it; a hit is extended to both sides word by word and counts if it reaches span words. Items of
    fewer words are looked up whole. The documents stay where they are: the benchmark goes to them in blocks of bounded size, one
    after another in the same tasks, whatever its size, and nothing is shuffled or gathered.

    Null or wordless text has no words and no hits; a null item_id counts as an item named ''; repeated rows each get their result;
    an empty benchmark hits nothing; columns of the docs that bear the new names are replaced, all others kept, the
    text unless with_text is off."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.drop(*NEW)
    todo = blocks(benchmark, item_col, item_text_col, block_words)
    block: list[tuple[str, str | None]] | None = next(todo, [])
    first = True
    while block is not None:
        after = next(todo, None)
        last = after is None
        kept = [f for f in docs.schema.fields if f.name not in NEW and (with_text or not last or f.name != text_col)]
        schema = T.StructType([*kept, *[T.StructField(c, t) for c, t in NEW.items()]])
        docs = docs.mapInArrow(_scan(spark.sparkContext.broadcast(block), [f.name for f in kept], text_col, first, span, k), schema)
        block, first = after, False
    return docs


def _scan(broadcast, kept: list[str], text_col: str, first: bool, span: int, k: int):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bench = Words(), Benchmark(broadcast.value, span, k)
        for batch in batches:
            n, spans, items = [], [], []
            before = None if first else (batch.column("hit_spans").to_pylist(), batch.column("items").to_pylist())
            for i, text in enumerate(batch.column(text_col)):
                words = word_hashes(text.as_py(), known)
                s, j = bench.hits(words)
                names = {bench.ids[x] or "" for x in j}
                if before:
                    s += [(x["start"], x["end"]) for x in before[0][i]]
                    names |= set(before[1][i])
                n.append(len(words))
                spans.append([{"start": a, "end": b} for a, b in union(s)])
                items.append(sorted(names))
            new = [pa.array(n, pa.int64()), pa.array(spans, SPANS), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *new], [*kept, *NEW])

    return run


def report(found: DataFrame) -> DataFrame:
    """n_words, n_hit, n_items, items_sha256 and contaminated from contamination()'s columns."""
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return found.withColumn("n_hit", n_hit).withColumn("n_items", F.size("items").cast("long")).withColumn("items_sha256", F.sha2(F.concat_ws(",", "items"), 256)).withColumn("contaminated", F.col("n_hit") > 0)
