"""WARC archives: writing records in segments, and reassembling them.

A page becomes a response record whose block is an HTTP message with a chunked body. A block longer than a segment is
split: the first part stays in the response record (WARC-Segment-Number 1), the rest goes to continuation records that
name the first as their origin; the last states the whole length. A page whose payload another has too becomes a revisit
record, whose block has only HTTP headers.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import shared_folder

END = b"\r\n\r\n"
PARTS = "record_id string, origin_id string, kind string, segment int, total long, head string, block binary"


def chunked(body: bytes, size: int) -> bytes:
    """The body in chunks of at most size bytes."""
    out = [b"%x\r\n%b\r\n" % (len(x), x) for x in (body[i : i + size] for i in range(0, len(body), size))]
    return b"".join(out) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError if the framing is broken or cut short."""
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        n = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if not n:
            return b"".join(out)
        if len(body) < at + n + 2 or body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("a chunk is cut short")
        out.append(body[at : at + n])
        at += n + 2


def _record(kind: str, rid: str, block: bytes, **more: object) -> bytes:
    named = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{rid}>", "WARC-Date": "2020-01-01T00:00:00Z"}
    named |= {k.replace("_", "-"): v for k, v in more.items() if v is not None}
    lines = "".join(f"{k}: {v}\r\n" for k, v in named.items())
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block


def _named(page_id: object) -> object:
    """An id as a header's value."""
    return quote(page_id, safe="") if isinstance(page_id, str) else page_id


def page_records(page_id: object, url: str | None, html: bytes, digest: str, refers_to: object, rid: str, segment: int, chunk: int) -> list[bytes]:
    """A page's records, each without the two empty lines that end it."""
    uri = "".join(c for c in (url or "about:blank") if c.isprintable() and c != " ") or "about:blank"
    common = {"WARC_Target_URI": uri, "WARC_Payload_Digest": f"sha256:{digest}", "X_Page_ID": _named(page_id)}
    if refers_to is not None:
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        return [_record("revisit", rid, head, WARC_Profile=profile, X_Refers_To_Page=_named(refers_to), **common)]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(html, chunk)
    if len(block) <= segment:
        return [_record("response", rid, block, **common)]
    cut = [block[i : i + segment] for i in range(0, len(block), segment)]
    out = [_record("response", rid, cut[0], WARC_Segment_Number=1, **common)]
    for k, part in enumerate(cut[1:], 2):
        own = uuid.uuid5(uuid.UUID(rid), str(k))
        out.append(_record("continuation", str(own), part, WARC_Segment_Origin_ID=f"<urn:uuid:{rid}>", WARC_Segment_Number=k, WARC_Segment_Total_Length=len(block) if k == len(cut) else None))
    return out


def with_revisits(pages: DataFrame, page_id: str, url: str, html: str, least: int = 100) -> DataFrame:
    """page_id, url, html, digest and refers_to (the smallest page_id of those with the same payload, null for itself).

    Only payloads of at least `least` bytes are revisited. Null html counts as empty. Rows that share the smallest
    page_id are all responses. A null page_id is no revisit and is never referred to.
    """
    rows = pages.select(pages[page_id].alias("page_id"), pages[url].alias("url"), F.coalesce(pages[html], F.lit("")).cast("binary").alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    long = rows.where((F.length("html") >= least) & F.col("page_id").isNotNull())
    first = long.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where(F.col("first") < F.col("last")).select(F.col("digest").alias("same"), "first")
    keys = long.select("page_id", "digest")
    later = keys.join(first, keys["digest"] == first["same"]).where(F.col("page_id") > F.col("first")).select(F.col("page_id").alias("later"), F.col("digest").alias("later_digest"), F.col("first").alias("refers_to")).distinct()
    return rows.join(later, (rows["page_id"] == later["later"]) & (rows["digest"] == later["later_digest"]), "left").select("page_id", "url", "html", "digest", "refers_to")


def write(pages: DataFrame, path: str, segment: int = 4096, chunk: int = 1024, per_file: int = 20_000) -> None:
    """Writes with_revisits's rows as gzip-compressed WARC files of at most per_file records each under path."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            out: list[bytes] = []
            for row in batch.to_pylist():
                rid = str(uuid.UUID(hashlib.md5(f"{part}|{k}|{row['page_id']}|{row['digest']}".encode()).hexdigest()))
                k += 1
                out += page_records(row["page_id"], row["url"], row["html"], row["digest"], row["refers_to"], rid, segment, chunk)
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_pydict({"record": pa.array(out, pa.binary())})
                    out = []
            yield pa.RecordBatch.from_pydict({"record": pa.array(out, pa.binary())})

    made = pages.mapInArrow(records, "record binary").select(F.col("record").cast("string").alias("value"))
    made.write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def parse(data: bytes) -> Iterator[dict]:
    """An archive's records; ValueError if it is cut short or a record doesn't begin as it should."""
    at = 0
    while at < len(data):
        end = data.index(END, at)
        head = data[at:end].decode("utf-8", "replace")
        lines = head.split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        named = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        n = int(named["content-length"])
        block = data[end + 4 : end + 4 + n]
        at = end + 4 + n + 4
        if len(block) < n or data[at - 4 : at] != END:
            raise ValueError("a record is cut short")
        rid = named["warc-record-id"]
        yield {"record_id": rid, "origin_id": named.get("warc-segment-origin-id", rid), "kind": named["warc-type"], "segment": int(named.get("warc-segment-number", 0)), "total": int(named["warc-segment-total-length"]) if "warc-segment-total-length" in named else None, "head": head, "block": block}


def read(spark: SparkSession, path: str, ids: str = "long") -> DataFrame:
    """The archives' logical records: page_id, url, record_type, payload (null for revisits), payload_bytes,
    payload_digest, refers_to.

    Records in one segment pass straight on. Segments are grouped by origin, put in order by number, checked for gaps
    and against the stated total, and joined once; then chunked framing is taken off and the digest verified. Broken
    archives raise ValueError. A file is read by one task; write() bounds its records. ids: long or string, what
    page_id is; a record without one has null.
    """

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_id", pa.string()), ("origin_id", pa.string()), ("kind", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("head", pa.string()), ("block", pa.binary())])
        for batch in batches:
            for data in batch.column("content"):
                out: list[dict] = []
                for x in parse(zlib.decompress(data.as_py(), 31)):
                    out.append(x)
                    if len(out) >= 1000:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out = []
                yield pa.RecordBatch.from_pylist(out, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    parts = files.mapInArrow(records, PARTS)
    part = F.struct("segment", "total", "kind", "head", "block")
    whole = parts.where("segment = 0").select(F.array(part).alias("parts"))
    cut = parts.where("segment > 0").groupBy("origin_id").agg(F.sort_array(F.collect_list(part)).alias("parts")).select("parts")

    def joined(own: list[dict]) -> bytes:
        """The block of a record from its segments in order."""
        if own[0]["segment"] == 0:
            return own[0]["block"]
        block = b"".join(x["block"] for x in own)
        if [x["segment"] for x in own] != list(range(1, len(own) + 1)) or own[0]["kind"] == "continuation" or own[-1]["total"] != len(block):
            raise ValueError("segments are missing")
        return block

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.string() if ids == "string" else pa.int64()
        schema = pa.schema([("page_id", kind), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", kind)])
        name = lambda x: None if x is None else unquote(x) if ids == "string" else int(x)
        for batch in batches:
            out = []
            for own in batch.column("parts"):
                own = own.as_py()
                named = {k.lower(): v for k, _, v in (y.partition(": ") for y in own[0]["head"].split("\r\n")[1:])}
                top, _, body = joined(own).partition(END)
                http = {k.lower(): v for k, _, v in (y.partition(": ") for y in top.decode("latin-1").split("\r\n")[1:])}
                digest, payload = named["warc-payload-digest"].removeprefix("sha256:"), None
                if own[0]["kind"] == "response":
                    payload = dechunked(body) if http.get("transfer-encoding") == "chunked" else body
                    if hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError("a payload doesn't have the stated digest")
                out.append({"page_id": name(named.get("x-page-id")), "url": named.get("warc-target-uri"), "record_type": own[0]["kind"], "payload": payload, "payload_bytes": len(payload) if payload is not None else int(http["content-length"]), "payload_digest": digest, "refers_to": name(named.get("x-refers-to-page"))})
            yield pa.RecordBatch.from_pylist(out, schema)

    return whole.unionByName(cut).mapInArrow(pages, f"page_id {ids}, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to {ids}")


def archive_and_read(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", segment: int = 4096, chunk: int = 1024) -> DataFrame:
    """Writes the pages to archives in the shared folder and reads them back; see with_revisits and read.

    Null html is an empty payload, a null url about:blank; repeated rows each get records of their own, an empty table
    gives an empty result, other columns are ignored. page_id may be a number or a string, and null.
    """
    spark = pages.sparkSession
    ids = "string" if pages.schema[page_id].dataType.simpleString() == "string" else "long"
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write(with_revisits(pages, page_id, url, html), path, segment, chunk)
    return read(spark, path, ids)
