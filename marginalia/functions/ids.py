"""Identities and fingerprints as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 32-bit FNV-1a, and the number of posting buckets.
FNV_OFFSET, FNV_PRIME, POSTING_BUCKETS = 2166136261, 16777619, 4096


def note_hash(body: Column) -> Column:
    return F.sha2(body, 512)


def source_fingerprint(raw: Column) -> Column:
    return F.unhex(F.sha2(raw, 256))


def vault_id(namespace: str, kind: Column, path: Column) -> Column:
    """32 hex digits of the SHA-256 of namespace, kind and path with zero bytes between them."""
    zero = F.lit("\0")
    return F.substring(F.sha2(F.concat(F.lit(namespace), zero, kind, zero, path), 256), 1, 32)


def media_id(content: Column, collision: Column | None = None, marker: str = "collision") -> Column:
    if collision is not None:
        content = F.when(collision > 0, F.concat(content, F.lit(f"\0{marker}\0").cast("binary"), collision.cast("string").cast("binary"))).otherwise(content)
    return F.substring(F.sha2(content, 256), 1, 32)


def framed_id(*parts: Column, magic: str = "MNID\0") -> Column:
    """32 hex digits of the SHA-256 of the parts, each led by its length as four bytes, after the magic and their number."""
    framed = [F.unhex(F.lpad(F.hex(F.octet_length(p)), 8, "0")) if k == 0 else p.cast("binary") for p in parts for k in (0, 1)]
    return F.substring(F.sha2(F.concat(F.lit(magic).cast("binary"), F.unhex(F.lit(f"{len(parts):08X}")), *framed), 256), 1, 32)


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes, as a long."""
    hexes = F.hex(F.encode(text, "UTF-8"))
    places = F.when(F.length(hexes) > 0, F.sequence(F.lit(1), F.length(hexes), F.lit(2))).otherwise(F.expr("cast(array() as array<int>)"))
    one = lambda i: F.conv(F.substr(hexes, i, F.lit(2)), 16, 10).cast("long")
    return F.aggregate(places, F.lit(FNV_OFFSET).cast("long"), lambda h, i: (h.bitwiseXOR(one(i)) * FNV_PRIME).bitwiseAND(F.lit(4294967295)))


def posting_bucket(tag: Column) -> Column:
    return fnv1a(tag).bitwiseAND(F.lit(POSTING_BUCKETS - 1)).cast("int")


def image_fingerprint(raw_link: Column) -> Column:
    return F.sha2(raw_link, 256)


def issue_id(note: Column, fingerprint: Column, occurrence: Column, kind: Column) -> Column:
    zero = F.lit("\0")
    return F.substring(F.sha2(F.concat(note, zero, fingerprint, zero, occurrence.cast("string"), zero, kind), 256), 1, 20)


def set_digest(lines: Column) -> Column:
    """SHA-256 of an array's sorted lines: the same for any order."""
    return F.sha2(F.array_join(F.array_sort(lines), "\n"), 256)
