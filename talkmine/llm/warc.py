"""WARC archives: pages written as records, long ones in segments, and read back whole.

A response holds an HTTP message whose body is in chunked transfer framing. A record longer than
a segment goes on in continuation records that name its origin, their number and, the last one,
the total length. Reading groups these by origin, puts them in order, checks the total and
only then takes the framing off, since a chunk may lie in two segments.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmine.session import cut_lineage, fresh_dir

#: bytes of a record's block in one segment, of a body in one chunk, records in one file
SEGMENT, CHUNK, RECORDS = 16 * 1024, 4096, 4000
#: payloads from this size on are looked up among equal ones
LEAST_BYTES = 0
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
#: what ends a record
_GAP = "\r\n\r\n"
_DATE = "2024-01-01T00:00:00Z"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """A body in chunked transfer framing."""
    out = []
    for a in range(0, len(payload), size):
        part = payload[a:a + size]
        out += [b"%X\r\n" % len(part), part, b"\r\n"]
    return b"".join([*out, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The payload of a body in chunked framing; chunk extensions and trailers are left out."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        at = end + 2
        if len(body) < at + size + 2:
            raise ValueError("a chunk ends before its length")
        out.append(body[at:at + size])
        at += size + 2


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block


def _header_safe(url: str | None) -> str:
    """A URL without characters that would end a header line."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 0x21 else c for c in url or "")


def page_records(record_id: str, url: str | None, payload: bytes | None, digest: str, refers_to: str | None,
                 segment: int = SEGMENT) -> list[bytes]:
    """Records of one page without the gap after them: a revisit, or a response in segments."""
    shared = [("WARC-Target-URI", _header_safe(url)), ("WARC-Date", _DATE), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if refers_to:
        return [_record([("WARC-Type", "revisit"), ("WARC-Record-ID", record_id), *shared, ("WARC-Refers-To", refers_to),
                         ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")], b"")]
    block = _HTTP + chunked(payload or b"")
    parts = [block[a:a + segment] for a in range(0, len(block), segment)]
    first = [("WARC-Type", "response"), ("WARC-Record-ID", record_id), *shared,
             ("Content-Type", "application/http; msgtype=response")]
    out = [_record(first + [("WARC-Segment-Number", "1")] * (len(parts) > 1), parts[0])]
    for i, part in enumerate(parts[1:], 2):
        fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{record_id[:-1]}:segment-{i}>"), *shared[:2],
                  ("WARC-Segment-Origin-ID", record_id), ("WARC-Segment-Number", str(i))]
        out.append(_record(fields + [("WARC-Segment-Total-Length", str(len(block)))] * (i == len(parts)), part))
    return out


def record_id(page_id, digest: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}>"


def write(pages: DataFrame, path: str, segment: int = SEGMENT, least_bytes: int = LEAST_BYTES) -> None:
    """Write ``pages`` (page_id, url, html) as gzipped WARC files of at most ``RECORDS`` records.

    Of pages with equal payloads of at least ``least_bytes`` bytes the one with the largest
    page_id is a response and the others revisit it. Spark's text writer puts the gap of the
    format after each record, so any store that Spark writes to will do.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("sha1", F.sha1("payload"))
    leaders = cut_lineage(rows.filter(F.octet_length("payload") >= least_bytes).groupBy("sha1").agg(
        F.max("page_id").alias("leader"), F.count("*").alias("n")).filter("n > 1").select("sha1", "leader"))
    rows = rows.join(leaders, "sha1", "left").withColumn("revisits", F.coalesce(
        F.col("leader").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("leader")), F.lit(False)))
    rows = rows.withColumn("payload", F.when(~F.col("revisits"), F.col("payload")))

    def make(batches):
        for batch in batches:
            out = []
            for page in batch.to_pylist():
                digest = base64.b32encode(bytes.fromhex(page["sha1"])).decode()
                out += page_records(record_id(page["page_id"], digest), page["url"], page["payload"], digest,
                                    record_id(page["leader"], digest) if page["revisits"] else None, segment)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    rows.select("page_id", "url", "payload", "sha1", "leader", "revisits").mapInArrow(make, "record binary").select(
        F.col("record").cast("string").alias("value")).write.option("lineSep", _GAP).option(
        "compression", "gzip").option("maxRecordsPerFile", RECORDS).text(path)


def parse(data: bytes):
    """Header fields and block of each record of an archive, by its stated lengths."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data))
    while line := stream.readline():
        if line.strip() == b"":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("no record where one should begin")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            fields[name.lower()] = value.strip()
        block = stream.read(int(fields["content-length"]))
        if len(block) != int(fields["content-length"]):
            raise ValueError("a record ends before its length")
        yield fields, block


def records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives below ``path``: record_id, type, digest, refers_to, origin (its
    own id unless it continues another record), segment, total (of a last segment) and block."""
    names = ["record_id", "type", "digest", "refers_to", "origin", "segment", "total", "block"]
    kinds = [pa.string()] * 5 + [pa.int64(), pa.int64(), pa.binary()]

    def read(batches):
        for batch in batches:
            for content in batch.column("content"):
                rows, held = [], 0
                for f, block in parse(content.as_py()):
                    own = f["warc-record-id"]
                    rows.append((own, f["warc-type"], f.get("warc-payload-digest", "").removeprefix("sha1:"),
                                 f.get("warc-refers-to"), f.get("warc-segment-origin-id", own),
                                 int(f["warc-segment-number"]) if "warc-segment-number" in f else None,
                                 int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None, block))
                    held += len(block)
                    if held > 8 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
                yield _batch(rows)

    def _batch(rows):
        columns = list(zip(*rows)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(read, "record_id string, type string, digest string, refers_to string, origin string, "
                                  "segment long, total long, block binary")


def reassembled(found: DataFrame) -> DataFrame:
    """record_id, digest and whole block of each response: those in segments are grouped by origin
    and ordered by number. A missing segment or a wrong total length stops the job."""
    whole = found.filter("segment is null and type = 'response'").select("record_id", "digest", "block")
    parts = found.filter("segment is not null").groupBy("origin").agg(
        F.max("digest").alias("digest"), F.max("total").alias("total"),
        F.array_sort(F.collect_set(F.struct("segment", "block"))).alias("parts"))
    complete = (F.element_at("parts", -1)["segment"] == F.size("parts")) & (F.element_at("parts", 1)["segment"] == 1)
    length = F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + F.octet_length(p["block"]))
    block = F.array_join(F.transform("parts", lambda p: p["block"].cast("string")), "").cast("binary")
    checked = F.when(complete & (length == F.col("total")), block).otherwise(
        F.raise_error(F.concat(F.lit("segments missing or of another total length: "), "origin")).cast("binary"))
    return whole.union(parts.select(F.col("origin").alias("record_id"), "digest", checked.alias("block")))


def payloads(responses: DataFrame) -> DataFrame:
    """record_id, payload and payload_digest of whole responses, framing taken off and checked."""

    def decode(batches):
        for batch in batches:
            out, sums = [], []
            for block, digest in zip(batch.column("block"), batch.column("digest").to_pylist()):
                payload = dechunked(block.as_py().partition(b"\r\n\r\n")[2])
                own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                if digest and digest != own:
                    raise ValueError("a payload doesn't have its digest")
                out.append(payload)
                sums.append(own)
            yield pa.RecordBatch.from_arrays(
                [batch.column("record_id"), pa.array(out, pa.binary()), pa.array(sums, pa.string())],
                names=["record_id", "payload", "payload_digest"])

    return responses.mapInArrow(decode, "record_id string, payload binary, payload_digest string")


def _page(column: str) -> Column:
    """The page_id in a record id; null if it has none."""
    return F.expr(f"try_cast(regexp_extract({column}, '^<urn:page:(-?[0-9]*):', 1) as bigint)")


def round_trip(pages: DataFrame, segment: int = SEGMENT, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each row of ``pages``,
    as its archives tell after they were written and read.

    A null html is an empty payload. Rows that repeat a page_id and a payload are alike: all
    responses, or all revisits. A null page_id is smaller than any other; of pages that all have
    none, all are responses. An empty table gives no rows.
    """
    spark = pages.sparkSession
    path = fresh_dir(spark, "warc")
    write(pages, path, segment, least_bytes)
    found = records(spark, path)
    own = cut_lineage(payloads(reassembled(found)).select(
        "record_id", "payload_digest", F.octet_length("payload").cast("long").alias("payload_bytes")).distinct())
    first = found.filter("type in ('response', 'revisit')").select(
        "record_id", "type", "digest", "refers_to", F.coalesce("refers_to", "record_id").alias("holder"))
    holder = own.select(F.col("record_id").alias("holder"), "payload_bytes")
    return first.join(holder, "holder", "left").select(
        _page("record_id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"), _page("refers_to").alias("refers_to"))


ORACLE = """
with p as (
  select page_id, coalesce(html, '') html, sha1(coalesce(html, '')) h from pages),
d as (
  select page_id, octet_length(encode(html))::bigint payload_bytes,
    max(page_id) over (partition by h) leader,
    list_aggregate(list_transform(range(0, 8), lambda i:
      list_aggregate(list_transform([15, 10, 5, 0], lambda s:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (1 + 5 * i)::int, 5))::bigint >> s) & 31)::int + 1, 1)),
        'string_agg', '')), 'string_agg', '') payload_digest
  from p)
select page_id, payload_bytes, payload_digest,
  case when page_id = leader then 'response' else 'revisit' end record_type,
  case when page_id <> leader then leader end refers_to
from d
"""
