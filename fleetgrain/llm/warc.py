"""Deterministic sharded WARC writer and reader.

Records are sorted by (page_id, payload digest, url) and cut into ranges. A task writes a range and rolls to its next file when the
compressed size passes roll_bytes; every record is a gzip member of its own, with header
lines, block and payload digests and a record id made anew from its content. How many ranges there are follows the bytes of all
payloads (one for RANGE_BYTES, MOST_RANGES at most), and their bounds are quantiles of the records whose hash is small
enough, so names and bytes of the files depend on the pages alone: not on their partitions, on the number of tasks or on retries.

Of records with equal payloads the first by (page_id, url), nulls last, is a response; the others are revisits that refer to it
(record id, target URI, date and page) and carry no payload. Of rows alike in all three columns one is taken as the first.

Commit: tasks write under temporary names that no other attempt has, and return a row per file. These rows are a table written by Spark,
so exactly the files of attempts that Spark accepted are in it. A second job gives them their final names (a repeated attempt
finds the work done) and its rows are the manifest. Readers open only what the manifest names and check size and digest, so
leftovers of lost executors are never read. Files are reached through pyarrow's file systems by URI.

Nulls: null html is an empty payload; a null url is written as `about:blank`; a null page_id sorts last, and revisits of its
response refer to null. Empty tables give no files and an empty result. Other columns are not read.

Scale: payloads are shuffled once. A payload that very many pages share is joined by broadcast (common.by_key), and null page ids
are spread by digest; only rows alike in page_id and payload are always of one range.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ROLL_BYTES = 32 << 20
#: Payloads of at least so many bytes are written once.
REVISIT_BYTES = 0
#: Payload bytes of a range of records, and how many ranges there are at most.
RANGE_BYTES = 1 << 20
MOST_RANGES = 20_000
#: Records per range of which the bounds are quantiles; with MOST_RANGES this bounds what the driver holds.
SAMPLE = 16
DATE = "2024-01-01T00:00:00Z"
LEVEL = 6
_FILES = "name string, temp string, bytes long, sha256 string, records long"
_NONE = "-"


def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _uri(url: str | None) -> str:
    return " ".join((url or "about:blank").split()) or "about:blank"


def _record_id(page_id: int | None, url: str | None, digest: str, copy: int = 0) -> str:
    """The id of a page's record; copy tells rows alike apart."""
    key = f"{page_id}|{_uri(url)}|{digest}|{copy}"
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(key.encode()).digest()[:16], version=4)}>"


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, copy: int, first: tuple[int | None, str | None] | None) -> bytes:
    """A WARC record, as a gzip member; first is the page that a revisit refers to."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if first else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if first else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id, url, digest, copy)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_uri(url)}",
        f"WARC-Page-ID: {_NONE if page_id is None else page_id}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
        f"WARC-Block-Digest: sha1:{_digest(block)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if first:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {_record_id(*first, digest)}",
            f"WARC-Refers-To-Target-URI: {_uri(first[1])}",
            f"WARC-Refers-To-Date: {DATE}",
            f"WARC-Refers-To-Page: {_NONE if first[0] is None else first[0]}",
        ]
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def _bounds(narrow: DataFrame, range_bytes: int) -> list[tuple]:
    """Ascending keys (page_id is null, page_id, digest) at which the ranges after the first begin."""
    whole = narrow.agg(F.count("*").alias("rows"), F.sum("n").alias("bytes")).first()
    ranges = min(MOST_RANGES, -(-(whole.bytes or 0) // range_bytes))
    if ranges < 2:
        return []
    share = min(1.0, ranges * SAMPLE / whole.rows)
    small = F.pmod(F.xxhash64("page_id", "sha1", F.lit("warc")), F.lit(1 << 30)) < int(share * (1 << 30))
    # about ranges * SAMPLE rows: a proven bound in expectation
    keys = sorted((r.page_id is None, r.page_id or 0, r.sha1) for r in narrow.where(small).select("page_id", "sha1").distinct().collect())
    return sorted({keys[k * len(keys) // ranges] for k in range(1, ranges)}) if keys else []


def _ranged(rows: DataFrame, bounds: list[tuple]) -> DataFrame:
    """rows with the number of their range."""
    if not bounds:
        return rows.withColumn("range", F.lit(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = (common.col(batch, c).to_pylist() for c in ("page_id", "sha1"))
            at = [bisect_right(bounds, (i is None, i or 0, k)) for i, k in zip(ids, keys, strict=True)]
            yield batch.append_column("range", pa.array(at, pa.int32()))

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, ddl + ", range int")


def write_warc(pages: DataFrame, path: str, roll_bytes: int = ROLL_BYTES, revisit_bytes: int = REVISIT_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Writes pages (page_id, url, html) as WARC files under path (a URI); returns the manifest, read back from path/manifest.

    What decides revisits is found from digests alone and comes to the writer as a row of its own, sorted before the page it
    concerns.
    """
    spark = pages.sparkSession
    common.small_batches(spark)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    page = F.col("page_id").cast("long").alias("page_id")
    narrow = common.stored(pages.select(page, "url", F.sha1(payload).alias("sha1"), F.octet_length(payload).cast("long").alias("n")), "warc-pages")
    bounds = _bounds(narrow, range_bytes)
    place = F.struct(F.col("page_id").isNull().alias("a"), F.col("page_id").alias("b"), F.col("url").isNull().alias("c"), F.col("url").alias("d"))
    long = narrow.where(F.col("n") >= revisit_bytes)
    twice = long.groupBy("sha1").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
    twice = common.stored(twice.select("sha1", "n", F.struct(F.col("first.b").alias("page_id"), F.col("first.d").alias("url")).alias("first")), "warc-first")
    notes = common.by_key(long.select("page_id", "sha1").distinct(), twice, "sha1", narrow.count())
    nothing = [F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload")]
    notes = notes.select("page_id", F.lit(0).alias("kind"), "sha1", *nothing, "first")
    no_first = F.lit(None).cast("struct<page_id:bigint,url:string>").alias("first")
    records = pages.select(page, F.lit(1).alias("kind"), F.sha1(payload).alias("sha1"), "url", payload.alias("payload"), no_first)
    order = ["range", F.col("page_id").asc_nulls_last(), "sha1", "kind", F.col("url").asc_nulls_last()]
    # a task for each range, so that tasks don't grow with the pages
    ordered = _ranged(records.unionByName(notes), bounds).repartitionById(len(bounds) + 1, "range").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = uuid.uuid4().hex
        fs, root = pafs.FileSystem.from_uri(path)
        fs.create_dir(f"{root}/temp", recursive=True)
        done: list[tuple] = []
        out, number, files = None, -1, 0

        def close() -> None:
            out.close()
            done.append((name, temp, size, digest.hexdigest(), count))

        noted = first = last = None
        copy = 0
        for batch in batches:
            columns = [common.col(batch, c) for c in ("range", "page_id", "kind", "sha1", "url", "payload", "first")]
            for part, page_id, kind, key, url, data, given in zip(*(c if i == 5 else c.to_pylist() for i, c in enumerate(columns)), strict=True):
                if kind == 0:
                    noted, first = (page_id, key), (given["page_id"], given["url"])
                    continue
                copy = copy + 1 if (page_id, key, url) == last else 0
                last = (page_id, key, url)
                shared = (page_id, key) == noted
                refers = first if shared and ((page_id, url) != first or copy) else None
                record = _record(page_id, url, data.as_py(), base64.b32encode(bytes.fromhex(key)).decode(), copy, refers)
                if out is not None and (part != number or size >= roll_bytes):
                    close()
                    out, files = None, files + 1
                if part != number:
                    number, files = part, 0
                if out is None:
                    name, temp = f"range-{part:05d}-{files:05d}.warc.gz", f"temp/{part:05d}-{files:05d}-{attempt}"
                    size, count, digest = 0, 0, hashlib.sha256()
                    out = fs.open_output_stream(f"{root}/{temp}", compression=None)
                out.write(record)
                digest.update(record)
                size, count = size + len(record), count + 1
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["name", "temp", "bytes", "sha256", "records"])

    ordered.mapInArrow(run, _FILES).write.parquet(f"{path}/written")
    written = spark.read.schema(_FILES).parquet(f"{path}/written")

    def publish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(path)
        for batch in batches:
            for name, temp, size in zip(*(common.col(batch, c).to_pylist() for c in ("name", "temp", "bytes")), strict=True):
                there = fs.get_file_info(f"{root}/{name}")
                if there.type == pafs.FileType.NotFound:
                    fs.move(f"{root}/{temp}", f"{root}/{name}")
                elif there.size != size:
                    raise ValueError(f"{name} is there with another size")
            yield batch

    written.mapInArrow(publish, _FILES).write.parquet(f"{path}/manifest")
    return spark.read.schema(_FILES).parquet(f"{path}/manifest")


def _members(fs: pafs.FileSystem, name: str, size: int, sha256: str) -> Iterator[bytes]:
    """The records of a file, one gzip member at a time; at the end, size and digest are compared with the manifest's."""
    digest, read, rest, unpack, out = hashlib.sha256(), 0, b"", None, []
    with fs.open_input_stream(name, compression=None) as stream:
        while True:
            if not rest:
                rest = stream.read(1 << 20)
                if not rest:
                    break
                digest.update(rest)
                read += len(rest)
            if unpack is None:
                unpack, out = zlib.decompressobj(31), []
            out.append(unpack.decompress(rest))
            rest = unpack.unused_data
            if unpack.eof:
                yield b"".join(out)
                unpack = None
    if unpack is not None or read != size or digest.hexdigest() != sha256:
        raise ValueError(f"{name} isn't what the manifest says")


def _parse(record: bytes) -> dict:
    """page_id, url, type, refers_to, payload digest and length as the headers say, and the payload (None for a revisit); all checked."""
    head, _, block = record.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    block = block[: int(fields["Content-Length"])]
    if first != "WARC/1.1" or fields["WARC-Block-Digest"] != f"sha1:{_digest(block)}":
        raise ValueError("a damaged WARC record")
    number = lambda name: None if fields.get(name, _NONE) == _NONE else int(fields[name])
    payload = block.partition(b"\r\n\r\n")[2] if fields["WARC-Type"] == "response" else None
    length, digest = int(fields["WARC-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if payload is not None and (len(payload) != length or _digest(payload) != digest):
        raise ValueError("a payload differs from its digest")
    return {"page_id": number("WARC-Page-ID"), "url": fields["WARC-Target-URI"], "payload_bytes": length, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number("WARC-Refers-To-Page"), "payload": payload}


def read_warc(manifest: DataFrame, path: str, payloads: bool = False) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload, null for a revisit) of every record."""
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), *([("payload", pa.binary())] if payloads else [])]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(path)
        for batch in batches:
            for name, size, sha in zip(*(common.col(batch, c).to_pylist() for c in ("name", "bytes", "sha256")), strict=True):
                rows, held = [], 0
                for record in _members(fs, f"{root}/{name}", size, sha):
                    row = _parse(record)
                    rows.append({k: row[k] for k in schema.names})
                    held += len(record)
                    if len(rows) == 1000 or payloads and held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    ddl = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", payload binary" if payloads else "")
    # one task for each file, in a number given, which adaptive execution doesn't merge
    return manifest.repartition(max(1, min(MOST_RANGES, manifest.count()))).mapInArrow(run, ddl)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    path = common.fresh_path(spark, "warc")
    manifest = write_warc(pages, path)
    return read_warc(manifest, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base32 in SQL: five hexadecimal digits are four of base 32.
OP5_SQL = """
with p as (select page_id, url, coalesce(html, '') as html from pages),
d as (select page_id, strlen(html)::bigint as payload_bytes, sha1(html) as hex, row_number() over w as nth, first_value(page_id) over w as first from p
  window w as (partition by html order by page_id nulls last, url nulls last))
select page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, 5 * (k // 4) + 1, 5))::bigint >> (15 - 5 * (k % 4))) & 31) + 1, 1)), '') as payload_digest,
  case when nth = 1 then 'response' else 'revisit' end as record_type, case when nth > 1 then first end as refers_to
from d
"""
