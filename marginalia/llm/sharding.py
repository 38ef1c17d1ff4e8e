"""Operator 7. Sharding by a permutation-filled lookup table."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup_table(shards: Sequence[str], size: int) -> list[int]:
    """For each slot the position of its shard. `size` must be a prime above the number of shards.

    Every shard prefers the slots offset, offset + skip, offset + 2 * skip ... modulo the prime, which visits each slot once. The
    shards take turns; at its turn a shard claims the first free slot that it prefers. So shards hold equal numbers of slots, give
    or take one, and a shard that leaves moves few slots of the others."""
    if not shards or len(set(shards)) < len(shards) or size <= len(shards) or any(size % p == 0 for p in range(2, int(size**0.5) + 1)):
        raise ValueError("shards must be distinct and the table's size a prime above their number")
    digests = [hashlib.md5(s.encode()).digest() for s in shards]
    at = [int.from_bytes(d[:8], "big") % size for d in digests]
    skip = [int.from_bytes(d[8:], "big") % (size - 1) + 1 for d in digests]
    slots, free = [-1] * size, size
    while free:
        for k in range(len(shards)):
            while slots[at[k]] >= 0:
                at[k] = (at[k] + skip[k]) % size
            slots[at[k]] = k
            free -= 1
            if not free:
                break
    return slots


def slot_of(key: Column, size: int) -> Column:
    """A key's slot: 60 bits of its MD5, modulo the table's size. A null key counts as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long") % size


def shard(docs: DataFrame, shards: Sequence[str], *, size: int = 65537, key: str = "doc_id", slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """Adds each row's slot and shard: one hash and one look-up in a constant array of `size` numbers that goes with the plan.

    A narrow projection: no shuffle, no join, so a frequent source or group of copies can't heat a task. Equal keys share a shard
    and null keys go where the empty text goes; an empty table stays empty; a text column of any length isn't read; existing columns
    of the two names are replaced."""
    table = F.split(F.lit(",".join(map(str, lookup_table(shards, size)))), ",").cast("array<int>")
    names = F.split(F.lit("\n".join(shards)), "\n")
    docs = docs.withColumn(slot_col, slot_of(F.col(key), size))
    return docs.withColumn(shard_col, F.element_at(names, F.element_at(table, (F.col(slot_col) + 1).cast("int")) + 1))
