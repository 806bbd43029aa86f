"""Operator 5, WARC archives with segmented records, written and read back.

Writing: each page is a record whose block is an HTTP response with its payload in
chunked transfer framing.  Of pages with equal payloads of at least ``LEAST`` bytes
the one with the smallest page_id is the response and the others revisit it.  A
block of more than ``SEGMENT`` bytes is cut into a first record and continuation
records.  Spark's text writer puts the records into gzipped files, with the end mark of a
WARC record as its line separator, so a lost executor leaves no half-written file.

Reading: a file is parsed once, record by record by Content-Length.  Continuation
records are grouped by their origin's id, ordered by segment number and held
against the total length; then the chunk framing is decoded.  What is grouped is
one record's segments and never more than one record; whole records aren't shuffled.

Defined cases: a null page is an empty payload; a null page_id has no header and
comes back as null; equal rows each have a record, and where they hold the
smallest page_id of their payload they are all responses; an empty table gives no record.
A file is one row of Spark's binary reader, which holds up to 2 GB; the writer ends
a file after ``FILE_RECORDS`` records, each of ``SEGMENT`` bytes and a header at most,
so before 70 MB as long as URLs are no longer than a kilobyte.
"""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keysift.llm.scratch import place, stash, tidy
from keysift.ship import ship

LEAST = 100
SEGMENT = 16 << 10
CHUNK = 4 << 10
FILE_RECORDS = 4_000
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


class Malformed(ValueError):
    """An archive that breaks the format."""


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """A payload in chunked transfer framing."""
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise Malformed("a chunk has no size line")
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        at = end + 2 + size
        if body[at : at + 2] != b"\r\n":
            raise Malformed("a chunk is shorter than its size")
        out.append(body[end + 2 : at])
        at += 2


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without the two line ends that follow it."""
    lines = [f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", len(block))] if v is not None]
    return b"WARC/1.1\r\n" + "".join(lines).encode() + b"\r\n" + block


def _name(page_id: int | None, digest: str, row: int) -> str:
    return f"<urn:uuid:{hashlib.md5(f'{page_id}/{digest}/{row}'.encode()).hexdigest()}>"


def records(page: dict) -> Iterator[bytes]:
    """The records of a page (page_id, row, url, again, refers_to, refers_row, payload, digest): one, or a first segment and its continuations."""
    digest, kind = page["digest"], "revisit" if page["again"] else "response"
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", page["url"])  # a line end would begin another header
    own = _name(page["page_id"], digest, page["row"])
    common = [("WARC-Date", DATE), ("WARC-Target-URI", url)]
    head = [("WARC-Type", kind), ("WARC-Record-ID", own), *common, ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Page-ID", page["page_id"])]
    if page["again"]:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        first = _name(page["refers_to"], digest, page["refers_row"])
        yield record([*head, ("WARC-Profile", profile), ("WARC-Refers-To", first), ("X-Refers-To-Page-ID", page["refers_to"])], HTTP)
        return
    block = HTTP + chunked(page["payload"])
    parts = [block[i : i + SEGMENT] for i in range(0, len(block), SEGMENT)]
    if len(parts) == 1:
        yield record(head, block)
        return
    yield record([*head, ("WARC-Segment-Number", 1)], parts[0])
    for i, part in enumerate(parts[1:], 2):
        last = ("WARC-Segment-Total-Length", len(block) if i == len(parts) else None)
        name = f"<urn:uuid:{hashlib.md5(f'{own}/{i}'.encode()).hexdigest()}>"
        yield record(
            [("WARC-Type", "continuation"), ("WARC-Record-ID", name), *common, ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", i), last], part
        )


def unzipped(raw: bytes) -> bytes:
    """A file's bytes, whether it is gzipped (as a whole or record by record) or plain."""
    return gzip.decompress(raw) if raw.startswith(b"\x1f\x8b") else raw


def parse(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The (headers, block) of each record of a file; header names in lower case."""
    at = 0
    while at < len(raw):
        if raw.startswith(b"\r\n", at):
            at += 2
            continue
        end = raw.find(b"\r\n\r\n", at)
        if not raw.startswith(b"WARC/", at) or end < 0:
            raise Malformed(f"no record at byte {at}")
        lines = raw[at:end].decode().split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        begin = end + 4
        at = begin + int(headers["content-length"])
        if at > len(raw):
            raise Malformed("a record is shorter than its length")
        yield headers, raw[begin:at]


def payload_of(block: bytes) -> bytes:
    """The payload of a whole HTTP response block."""
    head, mark, body = block.partition(b"\r\n\r\n")
    if not mark:
        raise Malformed("an HTTP response has no end of its head")
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def write(pages: DataFrame, path: str) -> None:
    """Writes (page_id, url, html) as gzipped WARC files."""
    html = F.coalesce("html", F.lit("")).cast("binary")
    # The place of a row in the table tells equal rows apart.
    df = pages.select(F.monotonically_increasing_id().alias("row"), "page_id", F.coalesce("url", F.lit("")).alias("url"), html.alias("payload"))
    df = df.withColumn("digest", F.sha2("payload", 256))
    # Which pages revisit which is found without the payloads; these are dealt once, to meet the answer.
    narrow = df.filter(F.octet_length("payload") >= LEAST).select("page_id", "digest", "row")
    firsts = narrow.groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    later = narrow.select("page_id", "digest").distinct().join(firsts, "digest").filter(~F.col("page_id").eqNullSafe(F.col("first.page_id")))
    later = later.select(
        F.col("page_id").alias("_p"), F.col("digest").alias("_d"), F.col("first.page_id").alias("refers_to"), F.col("first.row").alias("refers_row"), F.lit(True).alias("again")
    )
    df = df.join(later, F.col("page_id").eqNullSafe(F.col("_p")) & (F.col("digest") == F.col("_d")), "left").drop("_p", "_d")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in (batch.slice(i, 64) for i in range(0, batch.num_rows, 64)):
                out: list[bytes] = []
                size = 0
                for x in b.to_pylist():
                    for r in records(x):
                        out.append(r)
                        size += len(r)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    ship(pages.sparkSession)
    lines = df.select("page_id", "row", "url", "again", "refers_to", "refers_row", "payload", "digest").mapInArrow(run, "value binary")
    (
        lines.select(F.col("value").cast("string"))
        .write.option("lineSep", "\r\n\r\n")
        .option("maxRecordsPerFile", FILE_RECORDS)
        .option("compression", "gzip")
        .text(path)
    )


def _whole(kind: str, block: bytes, digests: bool) -> tuple[bytes | None, int | None, str | None]:
    """The payload of a whole block, or its size and digest instead; nothing of a revisit."""
    if kind == "revisit":
        return None, None, None
    payload = payload_of(block)
    return (None, len(payload), hashlib.sha256(payload).hexdigest()) if digests else (payload, len(payload), None)


def read(spark: SparkSession, path: str, *, digests: bool = False) -> DataFrame:
    """(record_id, page_id, record_type, refers_to, digest, payload_bytes, payload) of each record, segments put together; a revisit has no payload.

    ``digest`` is the header's.  With ``digests``, ``payload_digest`` of the payload as it was read stands in for
    ``payload``, which then goes no further than the task that parsed it.
    """
    last = ("payload_digest", "string") if digests else ("payload", "binary")
    fields = "origin string, segment bigint, total bigint, record_type string, page_id bigint, refers_to bigint, digest string, payload_bytes bigint"
    names = [x.split()[0] for x in fields.split(", ")]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string() if digests else pa.binary(), pa.binary()]
        number = lambda h, k: int(h[k]) if k in h else None
        for b in batches:
            for raw in b.column(0):
                out, size = [], 0
                for h, block in parse(unzipped(raw.as_py())):
                    kind, segment = h.get("warc-type"), number(h, "warc-segment-number")
                    if kind not in ("response", "revisit", "continuation"):
                        continue
                    payload, n, digest = _whole(kind, block, digests) if segment is None else (None, None, None)
                    out.append((
                        h.get("warc-segment-origin-id") or h["warc-record-id"], segment, number(h, "warc-segment-total-length"), kind,
                        number(h, "x-page-id"), number(h, "x-refers-to-page-id"), h.get("warc-payload-digest", "").rpartition(":")[2],
                        n, digest if digests else payload, None if segment is None else block,
                    ))
                    size += len(block)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=[*names, last[0], "block"])
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=[*names, last[0], "block"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in (batch.slice(i, 16) for i in range(0, batch.num_rows, 16)):
                sizes, out = [], []
                for x in b.to_pylist():
                    parts = sorted(x["parts"], key=lambda p: p["segment"])
                    block = b"".join(p["block"] for p in parts)
                    if [p["segment"] for p in parts] != list(range(1, len(parts) + 1)):
                        raise Malformed(f"{x['origin']}: segments {[p['segment'] for p in parts]}")
                    if parts[-1]["total"] != len(block):
                        raise Malformed(f"{x['origin']}: {len(block)} bytes of {parts[-1]['total']}")
                    payload, n, digest = _whole("response", block, digests)
                    sizes.append(n)
                    out.append(digest if digests else payload)
                keep = [b.column(b.schema.get_field_index(c)) for c in columns]
                yield pa.RecordBatch.from_arrays([*keep, pa.array(sizes, pa.int64()), pa.array(out, pa.string() if digests else pa.binary())], names=[*columns, "payload_bytes", last[0]])

    ship(spark)
    columns = ["origin", "page_id", "record_type", "refers_to", "digest"]
    files = spark.read.format("binaryFile").load(path).select("content")
    # Kept in the shared folder, so that the archive is parsed once.
    found = stash(files.mapInArrow(split, f"{fields}, {last[0]} {last[1]}, block binary"), "records")
    single = found.filter("segment is null").select(*columns, "payload_bytes", last[0])
    head = lambda c: F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c)
    grouped = found.filter("segment is not null").groupBy("origin").agg(
        *[head(c) for c in columns[1:]], F.collect_list(F.struct("segment", "total", "block")).alias("parts")
    )
    joined = grouped.mapInArrow(join, f"origin string, page_id bigint, record_type string, refers_to bigint, digest string, payload_bytes bigint, {last[0]} {last[1]}")
    return single.unionByName(joined).withColumnRenamed("origin", "record_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    with tidy(spark) as paths:
        path = place(spark, "warc")
        paths.append(path)
        write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
        # Of the payload as it was read; a revisit has what its digest refers to.
        found = read(spark, path, digests=True)
        found = found.select("page_id", "record_type", "refers_to", "payload_bytes", F.coalesce("payload_digest", "digest").alias("payload_digest"))
        found = stash(found, "pages", keep=True)
    sources = found.filter("record_type = 'response'").groupBy("page_id", "payload_digest").agg(F.max("payload_bytes").alias("size"))
    sources = sources.withColumnsRenamed({"page_id": "_p", "payload_digest": "_d"})
    found = found.join(sources, (F.col("refers_to") == F.col("_p")) & (F.col("payload_digest") == F.col("_d")), "left")
    return found.select("page_id", F.coalesce("payload_bytes", "size").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


SQL = f"""
with p as (select page_id, coalesce(html, '') as t from pages),
d as (select page_id, octet_length(encode(t)) as payload_bytes, sha256(t) as payload_digest from p),
f as (select *, min(page_id) over (partition by payload_digest) as first from d)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= {LEAST} and page_id is distinct from first then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= {LEAST} and page_id is distinct from first then first end as refers_to
from f
"""
