"""Operator 6. Line deduplication by an exact set-similarity join. Native: DataFrame functions alone; only the driver keeps a table of a
megabyte in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bucketed, discard, release, written

#: Least similarity in percent; counters of the rarity sketch.
PERCENT, COUNTERS = 80, 1 << 20
#: Tokens in a signature: lines meet first by the smallest and by the largest token hashes.
SIGNED = 2
#: White space that is neither a blank nor ends a line.
ODD_WHITE = r"[\x09\x0B-\x0D]"
#: A token's number: its frequency level above so many bits of its hash.
HASH_BITS = 57
#: Tables of texts are written small, at the least price in CPU.
PACKED = {"compression": "zstd", "parquet.compression.codec.zstd.level": "1"}


def _lines(text: Column) -> Column:
    """The lines in lower case, with blanks as their only white space: a split at one sign is cheap, one at a pattern is not."""
    plain = F.when(text.rlike(ODD_WHITE), F.regexp_replace(text, ODD_WHITE, " ")).otherwise(text)
    return F.split(F.lower(plain), "\n")


def rarity_levels(texts: DataFrame) -> DataFrame:
    """One row `levels`: for each of COUNTERS hash buckets, how many bits the number of the bucket's tokens has, over all texts, which are
    lines as _lines() gives them. A sketch of the tokens' frequency of fixed size, a megabyte."""
    tokens = texts.select(F.explode(F.split("text", " ")).alias("t")).where("t <> ''")
    counts = tokens.groupBy(_bucket(_hash(F.col("t"))).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("b", F.length(F.bin("n")).cast("tinyint").alias("level")).toArrow()  # COUNTERS rows at most, whatever the number of lines
    levels = np.zeros(COUNTERS, np.int8)
    levels[counts.column("b").to_numpy()] = counts.column("level").to_numpy()
    one = pa.table({"levels": pa.array([levels], pa.list_(pa.int8()))})
    return written(texts.sparkSession.createDataFrame(one), "line-levels")


def _bucket(h: Column) -> Column:
    return h.bitwiseAND(F.lit(COUNTERS - 1).cast("long")).cast("int")


def token_hashes(line: Column) -> Column:
    """The distinct tokens of a line from _lines() as numbers of HASH_BITS, in order."""
    return F.sort_array(F.array_distinct(_hashes(line)))


def _hashes(line: Column) -> Column:
    return F.transform(F.array_remove(F.split(line, " "), ""), _hash)


def _hash(token: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(token), 64 - HASH_BITS)


def by_rarity(sets: DataFrame, line: str, levels: DataFrame, name: str, own: str | None = None) -> DataFrame:
    """Adds the distinct tokens of the column `line` in order of rarity: the frequency level above HASH_BITS of hash, sorted as numbers.
    A null line has no row. With `own`, adds its token_hashes() under that name. The sketch comes as a scalar subquery; as a column it
    would be a megabyte copied into every row. It is none: the optimizer puts it where it is the argument of a function around the one
    over tokens (not inside such a function), and the filter keeps it out of an aggregate below. The tokens are such an argument as well,
    since a column of theirs that is used twice would hold the sketch back."""
    level = lambda sketch, h: F.shiftleft(F.get(sketch, _bucket(h)).cast("long"), HASH_BITS)
    both = lambda sketch, own: F.struct(own.alias("own"), F.transform(own, lambda h: level(sketch, h).bitwiseOR(h)).alias("ids"))
    sets = sets.where(F.col(line).isNotNull()).withColumn("levels", levels.scalar())
    sets = sets.withColumn(name, F.zip_with(F.array("levels"), F.array(token_hashes(F.col(line))), both)[0]).drop("levels")
    return sets.withColumns(({own: F.col(name)["own"]} if own else {}) | {name: F.sort_array(F.col(name)["ids"])})


def own_hashes(ids: Column) -> Column:
    """token_hashes() of the line that by_rarity() gave these for."""
    return F.sort_array(F.transform(ids, lambda x: x.bitwiseAND(F.lit((1 << HASH_BITS) - 1))))


def parity(own: Column, shift: int) -> Column:
    """64 parity bits of a set, from six bits of each member: two sets differ in as many members at least as their parities differ in bits."""
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(x, shift).bitwiseAND(F.lit(63).cast("long")).cast("int"))
    return F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(bit(x)))


def signatures(own: Column) -> Column:
    """Of sorted token hashes."""
    return F.array(F.xxhash64(F.slice(own, 1, SIGNED)), F.xxhash64(F.slice(F.reverse(own), 1, SIGNED), F.lit(1)))


def least_overlap(n: Column, m: Column, percent: int) -> Column:
    """The smallest intersection of sets of n and m with 100 * intersection >= percent * union, in whole numbers."""
    return F.call_function("div", percent * (n + m) + (99 + percent), F.lit(100 + percent))


def may_match(a: str, b: str, percent: int) -> Column:
    """Length, positional and parity filters on two postings of one token."""
    n, m = F.shiftright(f"{a}.npos", 32), F.shiftright(f"{b}.npos", 32)
    left = lambda x, size: size - F.col(f"{x}.npos").bitwiseAND(F.lit((1 << 32) - 1))  # noqa: E731  tokens from the place on
    need = least_overlap(n, m, percent)
    differ = lambda c: F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) <= n + m - 2 * need
    return (100 * n >= percent * m) & (100 * m >= percent * n) & (F.least(left(a, n), left(b, m)) >= need) & differ("odd") & differ("even")


def later_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, row_col: str | None = None) -> DataFrame:
    """row (a number for each document, row_col if given), doc_id, line_no (from 0), removed: of each line, whether an earlier line, by
    (id, line number), has a token set with a Jaccard similarity of percent / 100 at least.

    1. Equal lines (white space of one sort, lower case) are one class, which stands at its first place; the others are removed. Classes
       and their lines lie in buckets, so that no later step deals them again.
    2. Tokens are ordered by rarity among classes and each class posts its rarest n - ceil(percent / 100 * n) + 1; similar classes share a
       posting. A token whose bucket of the sketch counts one is in one class alone and isn't posted.
    3. By the hashes of its SIGNED smallest and largest token hashes, and by its rarest posting, a class first meets the earliest class
       that has the same. What matches is settled: a line needs one earlier match and not all, so a group of near copies, most of which
       share one of these, doesn't yield its pairs. Classes with equal sets share all.
    4. All postings are joined with those of classes not settled; length, position and parity leave few pairs, which are verified on
       the whole sets, unless the later class is settled. The later class of a pair goes.

    Letters compare in lower case; tokens end at ASCII white space. Lines without tokens are kept, null texts have no lines, null ids
    come first, equal places of repeated ids are ordered by row; an empty table gives no rows; further columns are ignored; lines and
    texts of any length count whole. Token sets are compared by 57-bit token hashes and lines named by 64-bit ones."""
    row = F.monotonically_increasing_id() if row_col is None else F.col(row_col)
    texts = docs.select(row.alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    lines = texts.select("row", "doc_id", F.posexplode(_lines(F.col("text"))).alias("line_no", "line"))
    has = lambda c: F.when(F.ltrim("line") != "", c)
    lines = written(lines.select("row", "doc_id", "line_no", has(F.xxhash64("line")).alias("cls"), has(F.col("line")).alias("line")), "line-rows", **PACKED)
    classes = lines.where("cls is not null").groupBy("cls").agg(F.min(F.struct("doc_id", "line_no", "row")).alias("first"), F.any_value("line").alias("line"))
    classes = bucketed(classes, "line-classes", "cls", **PACKED)
    places = written(lines.select("row", "doc_id", "line_no", "cls"), "line-places", **PACKED)
    discard(lines)
    release(docs.sparkSession)

    levels = rarity_levels(classes.select(F.col("line").alias("text")))
    release(docs.sparkSession)
    sets = by_rarity(classes, "line", levels, "ids", "own")
    n, unshared = F.size("ids"), F.lit(2 << HASH_BITS)  # the least number of a token that counts two
    prefix = F.slice("ids", 1, n - F.call_function("div", percent * n + 99, F.lit(100)).cast("int") + 1)
    sets = sets.select("cls", "first", n.cast("long").alias("n"), parity(F.col("ids"), 0).alias("odd"), parity(F.col("ids"), 6).alias("even"), signatures(F.col("own")).alias("signs"), F.sort_array(F.array_append(prefix, unshared)).alias("prefix"))
    sets = sets.withColumn("skipped", F.array_position("prefix", unshared) - 1)
    sets = sets.withColumn("shared", F.slice("prefix", F.col("skipped").cast("int") + 2, F.size("prefix"))).drop("prefix")
    sets = bucketed(sets, "line-postings", "cls", **PACKED)

    def verified(pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b) of classes of n tokens in sum, each once, those that hold on the whole sets, if the later class isn't done: it,
        as cls."""
        pairs = written(pairs.distinct(), "line-pairs")
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
        found = written(wanted.join(classes, "cls"), "line-sets", **PACKED)
        side = lambda c: found.select(F.col("cls").alias(c), F.col("line").alias(f"line_{c}"), F.col("first").alias(f"first_{c}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        later = lambda a, b: F.when(F.col("first_a") < F.col("first_b"), F.col(b)).otherwise(F.col(a))
        # each set once in the condition: the optimizer moves it to the joins, with whatever it is made of
        same = F.size(F.array_intersect(_hashes(F.col("line_a")), _hashes(F.col("line_b"))))
        both = both.where((later("done_a", "done_b") == 0) & ((100 + percent) * same >= percent * F.col("n")))
        out = written(both.select(later("a", "b").alias("cls")).distinct(), "line-matches")
        for used in (pairs, found):
            discard(used)
        release(docs.sparkSession)
        return out

    def pair(a: str, b: str, done_a: Column, done_b: Column) -> list[Column]:
        size = F.shiftright(f"{a}.npos", 32) + F.shiftright(f"{b}.npos", 32)
        return [F.col(f"{a}.cls").alias("a"), F.col(f"{b}.cls").alias("b"), size.alias("n"), done_a.alias("done_a"), done_b.alias("done_b")]

    meeting = F.array(F.get("signs", F.lit(0)), F.get("signs", F.lit(1)), F.get("shared", F.lit(0)))
    meeting = sets.select(F.struct("first", "cls", F.shiftleft("n", 32).alias("npos"), "odd", "even").alias("own"), F.explode(meeting).alias("key")).where("key is not null")
    led = meeting.withColumn("lead", F.first("own").over(Window.partitionBy("key").orderBy("own.first")))
    led = led.where((F.col("lead.cls") != F.col("own.cls")) & may_match("lead", "own", percent))
    settled = verified(led.select(*pair("lead", "own", F.lit(0), F.lit(0))))

    posts = sets.join(settled.withColumn("done", F.lit(1)), "cls", "left").select("cls", F.coalesce("done", F.lit(0)).alias("done"), "odd", "even", "n", "skipped", F.posexplode("shared").alias("pos", "key"))
    posts = posts.select("key", (F.shiftleft("n", 32) + F.col("skipped") + F.col("pos")).alias("npos"), "cls", "done", "odd", "even")
    # a test on both sides stays in the join, so that one exchange of the postings serves both
    met = posts.alias("a").join(posts.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.cls") < F.col("b.cls")) & (F.col("a.done") + F.col("b.done") < 2) & may_match("a", "b", percent))
    settled = settled.unionByName(verified(met.select(*pair("a", "b", F.col("a.done"), F.col("b.done")))))
    gone = settled.distinct().withColumn("gone", F.lit(True))
    out = places.join(sets.select("cls", "first").join(gone, "cls", "left"), "cls", "left")
    removed = F.col("cls").isNotNull() & (F.coalesce("gone", F.lit(False)) | ~F.col("first").eqNullSafe(F.struct("doc_id", "line_no", "row")))
    return out.select("row", "doc_id", F.col("line_no").cast("long").alias("line_no"), removed.alias("removed"))


def summary(lines: DataFrame) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed, removed_lines (their numbers in order)."""
    numbers = F.array_sort(F.collect_list(F.when(F.col("removed"), F.col("line_no"))))
    return lines.groupBy("row", "doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.col("removed").cast("long")).alias("n_removed"), numbers.alias("removed_lines")).drop("row")


def without_later_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The documents with their later lines taken out. They are written first, so that rows keep the number that they get. Columns of any
    name come back as they were."""
    numbered = written(docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row")), "line-docs")
    lines = later_lines(numbered.select("row", F.col(f"doc.{id_col}").alias("doc_id"), F.col(f"doc.{text_col}").alias("text")), percent=percent, row_col="row")
    gone = lines.where("removed").groupBy("row").agg(F.collect_set("line_no").alias("gone"))
    text = F.col(f"doc.{text_col}")
    parts = F.transform(F.split(text, "\n"), lambda x, i: F.struct(x.alias("x"), i.cast("long").alias("i")))
    kept = F.filter(parts, lambda s: ~F.array_contains("gone", s["i"]))
    text = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(F.transform(kept, lambda s: s["x"]), "\n"))
    return numbered.join(gone, "row", "left").select(*[text.alias(c) if c == text_col else F.col(f"doc.`{c}`") for c in docs.columns])
