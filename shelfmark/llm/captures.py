"""Web archives: records written by Spark, a two-level capture index, and range reads.

``write_archives`` writes WARC/1.1 records as text files whose line end is the record end, in any
store that Spark writes to. A file is compressed as a whole, so offsets count its uncompressed
bytes, and holds records of one class of size, as many as ``FILE_BYTES`` have room for. Of captures with equal payloads the one with the largest page id is a
response, the others are revisits that refer to it and carry headers only. ``build_index`` reads
the archives back and sorts the captures by reversed-host URL key into compressed blocks; the
first keys of the blocks form a sparse directory by shard, and the first keys of the shards, at
most ``SHARDS`` of them, the directory above it. ``look_up`` finds a key by binary search in both,
opens one block, and reads the byte range of the record.

Defined cases: null html is an empty payload (all payloads count, of 0 bytes and more); a null url
has an empty key; white space around a url, and tabs and line breaks in it, are left out of its
record and its key; rows that repeat an id and a payload are written
each, and each row finds one of them; a null page id is written
as empty and read as null; payloads of any length are written whole; an empty table writes no
record; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.session import ensure_checkpoint_dir, stored

#: Payload bytes of an archive file, about (a larger payload is alone in its file), and its records,
#: at most, by class of size; captures of an index block; shards, at most.
FILE_BYTES = 64 << 20
FILE_RECORDS = (5000, 512, 64, 8, 1)
BLOCK_LINES = 1000
SHARDS = 4096

_DATE = "2024-01-01T00:00:00Z"


def target_uri(url: str | None) -> str:
    """The url as a record names it: no white space around it, no tabs and line breaks, quoted.
    What is a target already stays as it is, so that archives and look-ups derive equal keys."""
    return quote((url or "").translate(dict.fromkeys(b"\t\n\r")).strip(), safe="!#$%&'()*+,/:;=?@[]~")


def url_key(url: str | None) -> str:
    """The host reversed by its labels, then port, path and query: ``org,example)/a?b``."""
    target = target_uri(url)
    if not target:
        return ""
    try:
        parts = urlsplit(target)
        host, port = unquote(parts.hostname or "").lower(), parts.port
    except ValueError:
        return quote(target.lower(), safe="/:?&=%)(,")
    host = host.removeprefix("www.")
    path = parts.path or "/"
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "") + ")" + path
    return quote(key + (f"?{parts.query}" if parts.query else ""), safe="/:?&=%),(")


def capture_key(url: str | None, page_id: int | None, digest: str) -> str:
    """A key for one capture: captures of one URL stand together, by page id."""
    return f"{url_key(url)} {'-' if page_id is None else f'{page_id + (1 << 63):020d}'} {digest}"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def captures(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, payload_bytes, payload_digest, key`` for each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, urls = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            payloads = [b"" if x is None else x for x in batch.column(2).cast(pa.large_binary()).to_pylist()]
            digests = [payload_digest(x) for x in payloads]
            keys = [capture_key(u, i, d) for u, i, d in zip(urls, ids, digests)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(x) for x in payloads], pa.int64()), pa.array(digests, pa.string()), pa.array(keys, pa.string())],
                names=["page_id", "url", "payload_bytes", "payload_digest", "key"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col), F.col(html_col))
    return rows.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, key string")


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}>"


def record(url: str | None, page_id: int | None, html: str | None, size: int, digest: str, refers_to: int | None, revisit: bool) -> str:
    """One record up to its last byte; the two line ends after it are the file's line end."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    body = "" if revisit else html or ""
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id, digest)}",
        f"WARC-Date: {_DATE}", f"WARC-Target-URI: {target_uri(url)}", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to, digest)}"]
    lines.append(f"Content-Length: {len(http) + (0 if revisit else size)}")
    return "\r\n".join(lines) + "\r\n\r\n" + http + body


def write_archives(pages: DataFrame, found: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write a record for each capture; ``found`` is ``captures(pages)``."""
    one = found.select("page_id", "payload_digest", "key").distinct()
    first = one.groupBy("payload_digest").agg(F.max("page_id").alias("response_id"))
    revisits = one.join(first, "payload_digest").where("page_id <> response_id")
    revisits = stored(revisits.select(F.col("key").alias("revisit"), "response_id"))

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = [b"" if x is None else x for x in batch.column(2).cast(pa.large_binary()).to_pylist()]
            digests = [payload_digest(x) for x in payloads]
            keys = [capture_key(u, i, d) for i, u, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), digests)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([len(x) for x in payloads], pa.int64()), pa.array(digests, pa.string()), pa.array(keys, pa.string())],
                names=["page_id", "url", "html", "payload_bytes", "digest", "key"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def pages_of(wanted: Column) -> DataFrame:
        keyed = rows.where(wanted).mapInArrow(digested, "page_id long, url string, html string, payload_bytes long, digest string, key string")
        # few revisits are sent to the pages; many make the optimiser shuffle both by key
        joined = keyed.join(revisits, F.col("key") == F.col("revisit"), "left")
        return joined.select("page_id", "url", "html", "payload_bytes", "digest", "response_id")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [
                record(url, page_id, html, size, digest, response, response is not None)
                for page_id, url, html, size, digest, response in zip(*[c.to_pylist() for c in batch.columns])]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    def size_class(size: Column) -> Column:
        return sum((F.when(size > FILE_BYTES // most, 1).otherwise(0) for most in FILE_RECORDS[:-1]), F.lit(0))

    # usually one class holds all pages
    used = found.select(size_class(F.col("payload_bytes")).alias("c")).distinct().collect()
    for c in sorted(r["c"] for r in used) or [0]:
        records = pages_of(size_class(F.coalesce(F.octet_length("html"), F.lit(0))) == c).mapInArrow(write, "value string")
        records.write.mode("append").option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS[c]).text(path)


_LENGTH = re.compile(rb"\r\nContent-Length: (\d+)")


def records_of(content: bytes) -> Iterator[tuple[int, int]]:
    """Offset and length of each record of an archive file."""
    at = 0
    while at < len(content):
        head = content.index(b"\r\n\r\n", at)
        size = head + 4 - at + int(_LENGTH.search(content, at, head)[1])
        yield at, size
        at += size + 4


def parse(record: bytes) -> dict:
    """Headers of a record, its payload, and the length that the payload has in full."""
    head, _, block = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = block.partition(b"\r\n\r\n")
    full = int(_LENGTH.search(b"\r\n" + http)[1])
    number = lambda uri: int(x) if (x := uri.split(":")[2]) else None
    return {
        "type": fields["WARC-Type"], "url": fields["WARC-Target-URI"] or None, "page_id": number(fields["WARC-Record-ID"]),
        "digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "payload": payload, "payload_bytes": full,
        "refers_to": number(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None}


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def build_index(spark: SparkSession, path: str) -> DataFrame:
    """``shard, block, first_key, lines``: captures of the archives in order of key, compressed by
    blocks; a line holds key, file, offset and length."""
    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                content = zlib.decompress(content.as_py(), 31)
                places = list(records_of(content))
                keys = [capture_key(r["url"], r["page_id"], r["digest"]) for r in (parse(content[a : a + n]) for a, n in places)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.string()), pa.array([file] * len(keys), pa.string()), pa.array([a for a, _ in places], pa.int64()), pa.array([n for _, n in places], pa.int64())],
                    names=["key", "file", "offset", "length"])

    rows = stored(read_files(spark, path).mapInArrow(entries, "key string, file string, offset long, length long"))
    n = min(SHARDS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.repartitionByRange(n, "key").sortWithinPartitions("key")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, held = TaskContext.get().partitionId(), 0, []

        def row() -> pa.RecordBatch:
            lines = zlib.compress("\n".join("\t".join(map(str, x)) for x in held).encode())
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([held[0][0]]), pa.array([lines], pa.binary())],
                names=["shard", "block", "first_key", "lines"])

        for batch in batches:
            for entry in zip(*[c.to_pylist() for c in batch.columns]):
                held.append(entry)
                if len(held) == BLOCK_LINES:
                    yield row()
                    block, held = block + 1, []
        if held:
            yield row()

    return stored(ordered.mapInArrow(blocks, "shard int, block int, first_key string, lines binary"))


def look_up(index: DataFrame, keys: DataFrame) -> DataFrame:
    """``key, file, offset, length`` for each row of ``keys`` (column ``key``) that the index holds."""
    shards = index.groupBy("shard").agg(F.min("first_key").alias("first_key"))
    top = sorted((r["first_key"], r["shard"]) for r in shards.collect())  # at most SHARDS rows

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = [k for k, _ in top]
        for batch in batches:
            at = [bisect_right(firsts, k) - 1 for k in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([top[i][1] if i >= 0 else -1 for i in at], pa.int32())], names=["key", "shard"])

    def find(blocks: pa.Table, asked: pa.Table) -> pa.Table:
        directory = sorted((k, i) for i, k in enumerate(blocks.column("first_key").to_pylist()))
        firsts = [k for k, _ in directory]
        out, opened, lines, starts = [], None, [], []
        for key in sorted(asked.column("key").to_pylist()):
            at = bisect_right(firsts, key) - 1
            if at < 0:
                continue
            if opened != at:
                raw = zlib.decompress(blocks.column("lines")[directory[at][1]].as_py()).decode()
                opened, lines = at, [x.split("\t") for x in raw.split("\n")]
                starts = [x[0] for x in lines]
            i = bisect_right(starts, key) - 1
            if i >= 0 and starts[i] == key:
                out.append((key, lines[i][1], int(lines[i][2]), int(lines[i][3])))
        columns = list(zip(*out)) if out else [(), (), (), ()]
        types = (pa.string(), pa.string(), pa.int64(), pa.int64())
        return pa.table([pa.array(list(c), t) for c, t in zip(columns, types)], names=["key", "file", "offset", "length"])

    dealt = keys.select("key").mapInArrow(choose, "key string, shard int")
    return index.groupBy("shard").cogroup(dealt.groupBy("shard")).applyInArrow(find, "key string, file string, offset long, length long")


def read_ranges(files: DataFrame, places: DataFrame) -> DataFrame:
    """The record at each of ``places`` (``file, offset, length``): what ``parse`` finds in it."""
    def read(content: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if content.num_rows:
            data = memoryview(zlib.decompress(content.column("content")[0].as_py(), 31))
            for a, n in zip(asked.column("offset").to_pylist(), asked.column("length").to_pylist()):
                r = parse(bytes(data[a : a + n]))
                out.append((r["page_id"], r["url"], r["payload_bytes"], r["digest"], r["type"], r["refers_to"], r["payload"]))
        columns = list(zip(*out)) if out else [()] * 7
        types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        names = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
        return pa.table([pa.array(list(c), t) for c, t in zip(columns, types)], names=list(names))

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    asked = places.withColumnRenamed("file", "path")
    return files.groupBy("path").cogroup(asked.groupBy("path")).applyInArrow(read, schema)


def archive(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write the archives of ``pages``, index them, and read every capture back through the index."""
    spark = pages.sparkSession
    ensure_checkpoint_dir(spark)
    path = path or f"{spark.sparkContext.getCheckpointDir()}/tables/archives-{uuid.uuid4().hex}"
    found = stored(captures(pages))
    write_archives(pages, found, path)
    index = build_index(spark, path)
    places = stored(look_up(index, found.select("key")))
    if (held := places.count()) != (asked := found.count()):
        raise RuntimeError(f"the index holds {held} of {asked} captures")
    return read_ranges(read_files(spark, path), places)


#: DuckDB SQL of the query. Base32 of a digest: eight 5-bit groups of each of four 40-bit parts.
ORACLE = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, list_aggregate(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + ((('0x' || substr(h, 1 + (i // 8) * 10, 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INTEGER, 1)), 'string_agg', '') AS payload_digest
  FROM p
), r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS response_id FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = response_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> response_id THEN response_id END AS refers_to
FROM r
"""
