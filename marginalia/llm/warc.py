"""Operator 2. WARC archives: written with revisits and segments, read back, reassembled, decoded and verified."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, shared_dir, written

#: Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32_DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"
#: Longest block of a record and of a chunk in it, in bytes; records in one archive file.
#: (A file holds some 64 MB at most.)
SEGMENT_BYTES, CHUNK_BYTES, RECORDS_PER_FILE = 32 << 10, 8 << 10, 2_000

RECORD = "record_id string, record_type string, page_id long, refers_to_id string, digest string, payload_length long, segment int, origin_id string, total_length long, block binary"
PAGE = "record_id string, page_id long, record_type string, refers_to_id string, refers_to long, payload_bytes long, payload_digest string"


def sha1_base32(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 160 bits are 8 times 5 hex digits, or 4 base32 digits each."""
    hexes = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(hexes, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.upper(F.concat(*parts)), BASE32_DIGITS, BASE32)


def _bytes(*parts: Column) -> Column:
    return F.concat(*[p.cast("binary") for p in parts])


def with_revisits(pages: DataFrame, min_bytes: int) -> DataFrame:
    """Adds record_id, digest, bytes and original, the record_id of the response that holds this payload (null for a response).

    Of equal payloads of at least min_bytes the one with the largest page_id is the response; rows that share that page_id too are
    told apart by their place in the input."""
    pages = pages.withColumn("tie", F.monotonically_increasing_id())
    pages = pages.withColumn("record_id", F.concat_ws("-", *[F.substring(F.md5(F.concat_ws("/", F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.col("tie").cast("string"))), a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]))
    pages = pages.withColumn("bytes", F.length("payload").cast("long")).withColumn("digest", sha1_base32(F.col("payload")))
    first = pages.where(F.col("bytes") >= min_bytes).groupBy("digest", "bytes").agg(F.max(F.struct("page_id", "tie", "record_id")).alias("first"), F.count(F.lit(1)).alias("n"))
    first = first.where("n > 1").select("digest", "bytes", F.col("first.record_id").alias("original"))
    pages = pages.join(first, ["digest", "bytes"], "left").drop("tie")  # AQE splits the partition of a hot payload
    return pages.withColumn("original", F.when(F.col("original") != F.col("record_id"), F.col("original")))


def records(pages: DataFrame, segment_bytes: int, chunk_bytes: int) -> DataFrame:
    """The text of each record without the closing blank lines, as binary `value`: an HTTP response in chunked transfer framing, cut
    into a first record and continuations where it is longer than segment_bytes; or a revisit, with the HTTP header alone."""
    http = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n")
    n, payload = F.col("bytes"), F.col("payload")
    starts = F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1, F.lit(chunk_bytes).cast("long"))).otherwise(F.expr("array(0L)"))
    chunk = lambda at: _bytes(F.lower(F.hex(F.least(n - at, F.lit(chunk_bytes).cast("long")))), F.lit(CRLF), F.substring(payload, (at + 1).cast("int"), F.lit(chunk_bytes)), F.lit(CRLF))
    # joined as text, which casts leave byte for byte as they are: all chunks at once, not one after another to a growing body
    body = F.when(n > 0, F.array_join(F.transform(starts, lambda at: chunk(at).cast("string")), "")).otherwise(F.lit("")).cast("binary")
    block = F.when(F.col("original").isNull(), _bytes(http, body, F.lit("0\r\n\r\n"))).otherwise(_bytes(http))
    pages = pages.withColumn("block", block).withColumn("block_bytes", F.length("block").cast("long"))
    cuts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("block_bytes") - 1, F.lit(0)), F.lit(segment_bytes).cast("long"))
    pages = pages.select("record_id", "page_id", "url", "digest", "bytes", "original", "block", "block_bytes", F.size(cuts).alias("n_segments"), F.posexplode(cuts).alias("k", "cut"))
    part = F.substring(F.col("block"), (F.col("cut") + 1).cast("int"), F.lit(segment_bytes))
    first, segmented, last = F.col("k") == 0, F.col("n_segments") > 1, F.col("k") == F.col("n_segments") - 1
    kind = F.when(~first, "continuation").when(F.col("original").isNull(), "response").otherwise("revisit")
    own_id = F.when(first, F.col("record_id")).otherwise(F.concat("record_id", F.lit("."), (F.col("k") + 1).cast("string")))
    line = lambda name, value, when=None: F.when(F.lit(True) if when is None else when, F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF))).otherwise(F.lit(""))
    urn = lambda x: F.concat(F.lit("<urn:uuid:"), x, F.lit(">"))
    safe_url = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\x00-\x20\x7f]", "%20")
    head = [
        F.lit(VERSION + CRLF), line("WARC-Type", kind), line("WARC-Record-ID", urn(own_id)), line("WARC-Date", F.lit("2024-01-01T00:00:00Z")), line("WARC-Target-URI", safe_url),
        line("Content-Type", F.lit("application/http;msgtype=response"), first), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")), first), line("X-Page-ID", F.coalesce(F.col("page_id").cast("string"), F.lit("-"))), line("X-Payload-Length", F.col("bytes"), first),
        line("WARC-Refers-To", urn(F.col("original")), F.col("original").isNotNull()), line("WARC-Profile", F.lit(PROFILE), F.col("original").isNotNull()),
        line("WARC-Segment-Number", F.col("k") + 1, segmented), line("WARC-Segment-Origin-ID", urn(F.col("record_id")), segmented & ~first), line("WARC-Segment-Total-Length", F.col("block_bytes"), segmented & last),
        line("Content-Length", F.length(part)), F.lit(CRLF),
    ]
    return pages.select(_bytes(F.concat(*head), part).alias("value"))


def write_archives(pages: DataFrame, path: str, *, min_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES, compression: str = "gzip") -> None:
    """Writes pages (page_id, url, payload binary) as WARC/1.1 archives to the folder `path`.

    Spark's own text sink writes the bytes, with the blank lines between records as its line separator: it works on every file system
    that Spark knows and commits task by task, so a lost executor leaves no half archive. Null payloads count as empty."""
    pages = pages.select("page_id", "url", F.coalesce("payload", F.lit(b"")).alias("payload"))
    out = records(with_revisits(pages, min_bytes), segment_bytes, chunk_bytes)
    # the cast keeps the bytes as they are; the sink doesn't look at them
    out.select(F.col("value").cast("string")).write.option("lineSep", CRLF + CRLF).option("maxRecordsPerFile", RECORDS_PER_FILE).option("compression", compression).text(path)


def parse_records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields, by lower-case name, and block of each record, one after another. Content-Length alone says where a block ends."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record before byte {stream.tell()}")
        fields: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        length = int(fields["content-length"])
        block = stream.read(length)
        if len(block) < length or stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"the record that ends at byte {stream.tell()} is cut or longer than it says")
        yield fields, block


def opened(content: bytes) -> BinaryIO:
    """An archive's bytes as a stream, unpacked while it is read where they are gzip, whatever its number of members."""
    return gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)


def dechunk(data: bytes) -> bytes:
    """Takes chunked transfer framing off, chunk extensions and trailers included."""
    out, at = [], 0
    while True:
        end = data.index(b"\r\n", at)
        size = int(data[at:end].split(b";")[0].strip(), 16)
        if not size:
            break
        out.append(data[end + 2 : end + 2 + size])
        if len(out[-1]) < size or data[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk is cut")
        at = end + 4 + size
    return b"".join(out)


def http_payload(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunk(body) if re.search(rb"(?im)^transfer-encoding:[^\r\n]*chunked", head) else body


def _uuid(x: str | None) -> str | None:
    return x and x.removeprefix("<urn:uuid:").removesuffix(">")


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for content in batch["content"]:
            rows, held = [], 0
            for f, block in parse_records(opened(bytes(content))):
                number = int(f["warc-segment-number"]) if "warc-segment-number" in f else None
                page = f.get("x-page-id", "-")
                digest, length, own = f.get("warc-payload-digest", "").removeprefix("sha1:") or None, f.get("x-payload-length"), _uuid(f["warc-record-id"])
                if number is None and f["warc-type"] == "response":  # whole: verified here, its block goes no further
                    _check(payload := http_payload(block), digest, length)
                    length, block = len(payload), None
                elif number is None:
                    block = None
                rows.append((own, f["warc-type"], None if page == "-" else int(page), _uuid(f.get("warc-refers-to")), digest, None if length is None else int(length), number, _uuid(f.get("warc-segment-origin-id")) or own, int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None, block))
                held += len(block or b"")
                if held > 4 << 20 or len(rows) > 5000:
                    yield _frame(rows)
                    rows, held = [], 0
            yield _frame(rows)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[x.split()[0] for x in RECORD.split(", ")])
    return out.astype({c: "Int64" for c in ("page_id", "payload_length", "total_length")} | {"segment": "Int32"})


def _check(payload: bytes, digest: str | None, length: object) -> None:
    if digest and digest != base64.b32encode(hashlib.sha1(payload).digest()).decode():
        raise ValueError("a payload doesn't have the digest that its record states")
    if length is not None and len(payload) != int(length):  # type: ignore[call-overload]
        raise ValueError("a payload doesn't have the length that its record states")


def _reassemble(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for parts in batch["parts"]:
            first = parts[0]
            if [p["segment"] for p in parts] != [*range(1, len(parts) + 1)] or parts[-1]["total_length"] is None:
                raise ValueError(f"segments of {first['record_id']} are missing")
            block = b"".join(bytes(p["block"]) for p in parts)
            if len(block) != parts[-1]["total_length"]:
                raise ValueError(f"the segments of {first['record_id']} don't have their total length")
            _check(payload := http_payload(block), first["digest"], first["payload_length"])
            rows.append((first["record_id"], first["page_id"], first["record_type"], None, None, len(payload), first["digest"]))
        out = pd.DataFrame(rows, columns=[x.split()[0] for x in PAGE.split(", ")])
        yield out.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64"})


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per response or revisit: record_id, page_id, record_type, refers_to_id, refers_to (the response's page_id),
    payload_bytes, payload_digest.

    Records that aren't segmented are decoded and verified where their file is read. Segments are grouped by their origin's id,
    which spreads evenly, as an origin has no more segments than its one payload needs; ordered by number, checked for gaps and the
    total length, joined and decoded. A revisit takes its length and digest from the response that it refers to, and fails if that
    is missing or states another digest. Bad framing, a missing segment, a wrong length or digest raise an error."""
    bounded_batches(spark)
    files = spark.read.format("binaryFile").load(path).select("content")
    rows = written(files.mapInPandas(_read, RECORD), "warc-records")  # the archives are parsed once
    whole = rows.where("segment is null")
    plain = whole.where("record_type = 'response'").select("record_id", "page_id", "record_type", F.lit(None).cast("string").alias("refers_to_id"), F.lit(None).cast("long").alias("refers_to"), F.col("payload_length").alias("payload_bytes"), F.col("digest").alias("payload_digest"))
    parts = F.array_sort(F.collect_list(F.struct("segment", "record_id", "page_id", "record_type", "digest", "payload_length", "total_length", "block")))
    joined = rows.where("segment is not null").groupBy("origin_id").agg(parts.alias("parts")).select("parts").mapInPandas(_reassemble, PAGE)
    responses = plain.unionByName(joined)
    revisits = whole.where("record_type = 'revisit'").alias("v")
    of = responses.select(F.col("record_id").alias("of_id"), F.col("page_id").alias("of_page"), F.col("payload_bytes").alias("of_bytes"), F.col("payload_digest").alias("of_digest"))
    found = revisits.join(of, F.col("refers_to_id") == F.col("of_id"), "left")
    good = F.when(F.col("of_digest") == F.col("digest"), F.col("of_bytes")).otherwise(F.raise_error(F.concat(F.lit("no response for the revisit "), F.col("record_id"))).cast("long"))
    return responses.unionByName(found.select("record_id", "page_id", "record_type", "refers_to_id", F.col("of_page").alias("refers_to"), good.alias("payload_bytes"), F.col("of_digest").alias("payload_digest")))


def archive_round_trip(pages: DataFrame, *, min_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Writes pages (page_id, url, html) to archives in the shared folder and reads them back: page_id, payload_bytes,
    payload_digest, record_type, refers_to (page_id of the response), record_id.

    Null html is an empty payload; null page_id makes a record without a page number, the smallest in its group; repeated page_ids
    are separate records, one of them the response; an empty table gives no rows; pages of any length are segmented; further
    columns are ignored."""
    spark = pages.sparkSession
    path = shared_dir(spark, "warc")
    write_archives(pages.select("page_id", "url", F.encode(F.col("html"), "UTF-8").alias("payload")), path, min_bytes=min_bytes, segment_bytes=segment_bytes, chunk_bytes=chunk_bytes)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id")
