"""Operator 4. Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_WORD, hex_fraction, written

#: Documents in one window of the distributed running sum, about; buckets of the virtual clock's histogram per unit of virtual time.
ROWS_PER_BUCKET, CLOCK_BUCKETS = 2048, 1 << 15


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, max_repeats: int) -> DataFrame:
    """One row per source (skey, source_size, n_docs, target). Sources by code point, null last, weigh as `weights` says, over and over.

    Water-filling: with caps c = max_repeats * size the targets are min(c, level * weight); the level is what is left of the
    budget, once the sources with the lowest c / weight have their caps, per weight of the others."""
    by = sizes.groupBy("skey").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    place = F.row_number().over(Window.orderBy("skey")) - 1
    by = by.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int")))
    by = by.withColumn("cap", F.col("source_size") * float(max_repeats)).withColumn("budget", F.sum("source_size").over(Window.partitionBy()) * float(share))
    filled = Window.orderBy(F.col("cap") / F.col("weight"), "skey")
    upto = filled.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    by = by.withColumn("caps", F.sum("cap").over(upto) - F.col("cap"))
    by = by.withColumn("left", F.sum("weight").over(Window.partitionBy()) - F.sum("weight").over(upto) + F.col("weight"))
    by = by.withColumn("level", (F.col("budget") - F.col("caps")) / F.col("left"))
    # the first source that the level, set without the caps below, doesn't fill to its cap
    by = by.withColumn("open", F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.row_number().over(filled).alias("at"), F.col("level").alias("level"))))
    by = by.withColumn("final", F.min("open").over(Window.partitionBy())["level"])
    target = F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("final") * F.col("weight")))
    return by.select("skey", "source_size", "n_docs", "weight", "budget", target.alias("target"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """Orders as the source does by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def weighted_fair_mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (1, 2, 3), share: float = 1.0, max_repeats: int = 3, seed: str = "mix", keep: Sequence[str] = ()) -> DataFrame:
    """Adds to each document how often the mix takes it.

    Each source is a queue. Its documents, shuffled by a digest of id and seed, repeat up to max_repeats times; a document's
    virtual finish time is the source's words up to it divided by the source's target, so every source reaches time 1 with its
    target served. All entries are range-sorted by that time and the order is cut where the total budget is used up. Documents
    stay whole: both the order and the cut count a document at its middle, which rounds to the nearest document; at last each source
    that its own cut at time 1 serves better takes that, and adds or gives back the one document that brings it nearest to its target.

    Nothing is gathered: the running sum in a source runs within digest ranges of about ROWS_PER_BUCKET documents plus the sums of
    the ranges before; the cut comes from a histogram of fixed size over virtual time, and only its one crossing bucket is sorted.

    Null text counts 0 words; null source is a source of its own, last; null ids sort by the digest of the empty text; rows that
    repeat are separate documents; an empty table gives no rows; a source without words has target 0 and takes nothing. Other
    columns are ignored unless named in `keep`. Returns id, size, source_size, target, virtual_finish, copies, taken."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    docs = docs.select(F.col(id_col).alias("id"), source_key(F.col(source_col)).alias("skey"), word_count(F.col(text_col)).alias("size"), digest.alias("h"), F.struct(*[F.col(c) for c in keep] or [F.lit(0)]).alias("rest"))
    docs = written(docs, "mix-sizes")
    targets = written(source_targets(docs, weights, share, max_repeats), "mix-targets")
    docs = docs.join(targets, "skey").withColumn("bucket", F.floor(hex_fraction(F.col("h")) * F.ceil(F.col("n_docs") / ROWS_PER_BUCKET)))
    sums = docs.groupBy("skey", "bucket").agg(F.sum("size").alias("in_bucket"))
    before = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("skey", "bucket", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("skey", "bucket").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    docs = written(docs.join(sums, ["skey", "bucket"]).withColumn("served", F.col("offset") + F.sum("size").over(within)).drop("offset", "bucket").withColumn("row", F.monotonically_increasing_id()), "mix-served")

    rounds = F.sequence(F.lit(0), F.lit(max_repeats - 1))
    middle = lambda e: (e * F.col("source_size") + F.col("served") - F.col("size") / 2.0) / F.col("target")
    entries = docs.where((F.col("target") > 0) & (F.col("size") > 0)).select("id", "h", "size", "budget", "source_size", "served", "target", F.explode(rounds).alias("e"))
    entries = entries.withColumn("at", middle(F.col("e"))).withColumn("clock", F.least(F.floor(F.col("at") * CLOCK_BUCKETS), F.lit(4 * CLOCK_BUCKETS)))
    ticks = entries.groupBy("clock").agg(F.sum("size").alias("words"), F.min("budget").alias("budget"))
    upto = Window.orderBy("clock").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # at most 4 * CLOCK_BUCKETS rows
    ticks = ticks.withColumn("upto", F.sum("words").over(upto))
    crossing = ticks.where(F.col("upto") > F.col("budget")).orderBy("clock").limit(1).collect()
    copies = F.when((F.col("target") > 0) & (F.col("size") > 0), F.lit(max_repeats)).otherwise(0)
    if crossing:
        clock, done = crossing[0]["clock"], crossing[0]["upto"] - crossing[0]["words"]
        order = Window.orderBy("at", "h", "id", "e").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one bucket of the clock
        last = entries.where(F.col("clock") == clock).withColumn("total", F.sum("size").over(order) + F.lit(done))
        last = last.where(F.col("total") - F.col("size") / 2.0 <= F.col("budget")).orderBy(F.desc("total")).limit(1).select("at", "h", "e").collect()
        cut = last[0] if last else None
        early = lambda e: F.least(F.floor(middle(e) * CLOCK_BUCKETS), F.lit(4 * CLOCK_BUCKETS)) < clock
        up = lambda e: early(e) if cut is None else early(e) | (F.struct(middle(e), F.col("h"), e) <= F.struct(F.lit(cut["at"]), F.lit(cut["h"]), F.lit(cut["e"])))
        taken = [F.when(up(F.lit(e)), 1).otherwise(0) for e in range(max_repeats)]
        copies = F.when((F.col("target") > 0) & (F.col("size") > 0), sum(taken[1:], taken[0])).otherwise(0)
    # Whole documents miss targets by their rounding, and one source's miss moves the common cut of all. A source that its own cut at
    # time 1 serves better takes that; then each takes one document more, or one less, if that brings it nearer.
    own = [F.when(middle(F.lit(e)) <= 1, 1).otherwise(0) for e in range(max_repeats)]
    docs = docs.withColumn("copies", copies).withColumn("own", F.when((F.col("target") > 0) & (F.col("size") > 0), sum(own[1:], own[0])).otherwise(0))
    short = lambda c: F.min("target") - F.sum(F.col("size") * F.col(c))
    sums = docs.groupBy("skey").agg(short("copies").alias("short"), short("own").alias("own_short"))
    sums = sums.withColumn("alone", F.abs("own_short") < F.abs("short")).withColumn("short", F.when(F.col("alone"), F.col("own_short")).otherwise(F.col("short")))
    # a row per source, written: small ones broadcast by their size, so that documents aren't dealt by source
    docs = docs.join(written(sums, "mix-short"), "skey").withColumn("copies", F.when(F.col("alone"), F.col("own")).otherwise(F.col("copies")))
    fit = F.when(F.col("short") > 0, F.col("copies") < max_repeats).otherwise(F.col("copies") > 0) & (F.col("size") > 0) & (F.abs(F.abs("short") - F.col("size")) < F.abs("short"))
    best = docs.where(fit).groupBy("skey").agg(F.min(F.struct(F.abs(F.abs("short") - F.col("size")).alias("off"), "h", "row")).alias("x"), F.min(F.signum("short")).alias("change"))
    docs = docs.join(written(best.select("skey", F.col("x.row").alias("fix"), "change"), "mix-fix"), "skey", "left")
    copies = F.col("copies") + F.when(F.col("row") == F.col("fix"), F.col("change")).otherwise(0)
    # documents without words cost nothing: they stay once where their source is served at all
    copies = F.when((F.col("size") == 0) & (F.col("target") > 0), 1).otherwise(copies)
    kept = [F.col("rest")[c].alias(c) for c in keep if c != id_col]
    return docs.select(F.col("id").alias(id_col), *kept, "size", "source_size", "target", (F.col("served") / F.when(F.col("target") > 0, F.col("target"))).alias("virtual_finish"), copies.cast("int").alias("copies"), (F.col("size") * copies).cast("long").alias("taken"))
