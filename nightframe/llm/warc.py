"""WARC archives with revisit resolution (operator 10).

Headers (id, URL, payload digest and size) are shuffled by digest; of equal
payloads of at least ``MIN_BYTES`` the one with the least id is the response and
the others become revisit records that refer to it, without a payload. Archives
are written with fresh headers, one gzip member for each record, one file for
each task. Reading parses the archives, checks the digests of responses, and
joins revisits to their responses.

Payloads meet the decisions in a join on the digest; only digests with several
records take part as its other side, and adaptive execution splits a hot digest.

Null payloads are empty; null ids make responses; of rows with the same payload
and the same least id all are responses; an empty table gives no archives and an
empty result; other columns are left alone.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import scratch

MIN_BYTES = 100
#: WARC-Date of fresh records.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
HEADERS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def decide(pages: DataFrame, min_bytes: int = MIN_BYTES, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """(page_id, url, payload, payload_digest, record_type, refers_to) of every page."""
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), body.alias("payload"), F.sha2(body, 256).alias("payload_digest"))
    headers = rows.filter(F.length("payload") >= min_bytes).select("payload_digest", "page_id")
    several = headers.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).filter("last > first").drop("last")
    again = F.col("page_id") > F.col("first")
    return rows.join(several, "payload_digest", "left").select(
        "page_id", "url", "payload", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to")
    )


def record(page_id, url, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    """One WARC/1.1 record."""
    block = HTTP + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response"]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write(decided: DataFrame, folder: str) -> DataFrame:
    """Archives below ``folder``; the manifest (path, records)."""

    def run(batches):
        batches = (b for b in batches if b.num_rows)
        part = next(batches, None)
        if part is None:
            return
        file, n = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.gz", 0
        with scratch.committed(file) as sink:
            while part is not None:
                for row in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "payload", "payload_digest", "record_type", "refers_to"))):
                    z = zlib.compressobj(1, wbits=31)
                    sink.write(z.compress(record(*row)) + z.flush())
                    n += 1
                part = next(batches, None)
        yield pa.RecordBatch.from_pydict({"path": [file], "records": [n]})

    manifest = decided.select("page_id", "url", "payload", "payload_digest", "record_type", "refers_to").mapInArrow(run, "path string, records long")
    return scratch.written(manifest, "manifest")


class _Stream:
    """Plain bytes of a file of gzip members, read piece by piece."""

    def __init__(self, source):
        self.source, self.z, self.buffer, self.rest = source, zlib.decompressobj(31), bytearray(), b""

    def fill(self) -> bool:
        data = self.rest or self.source.read(1 << 18)
        if not data:
            return False
        self.buffer += self.z.decompress(data)
        self.rest = self.z.unused_data
        if self.z.eof:
            self.z = zlib.decompressobj(31)
        return True

    def until(self, mark: bytes) -> bytes | None:
        at = 0
        while (end := self.buffer.find(mark, at)) < 0:
            at = max(0, len(self.buffer) - len(mark))
            if not self.fill():
                return None
        return self.take(end + len(mark))

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self.fill():
                raise ValueError("an archive ends within a record")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out


def records(source):
    """(header fields, block) of every record of an archive."""
    stream = _Stream(source)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        version, *lines = head.decode().rstrip("\r\n").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("no WARC record")
        fields = dict(x.split(": ", 1) for x in lines)
        block = stream.take(int(fields["Content-Length"]))
        stream.take(4)
        yield fields, block


def read(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """Header rows of all records of the archives (with payloads if asked for); wrong digests raise."""
    spark = manifest.sparkSession
    schema = HEADERS + (", payload binary" if payloads else "")

    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, size = [], 0
                with scratch.reader(path) as source:
                    for fields, block in records(source):
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
                        if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"wrong payload digest in {path}")
                        page, refers = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page-Id")
                        row = {"page_id": page and int(page), "url": fields.get("WARC-Target-URI"), "record_type": kind, "refers_to": refers and int(refers), "payload_bytes": len(payload) if kind == "response" else None, "payload_digest": digest}
                        rows.append(row | ({"payload": payload if kind == "response" else None} if payloads else {}))
                        size += len(payload)
                        if len(rows) >= 2000 or payloads and size > 1 << 22:
                            yield batch_of(rows)
                            rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())] + ([("payload", pa.binary())] if payloads else [])

    def batch_of(rows):
        return pa.RecordBatch.from_pylist(rows, pa.schema(kinds))

    return manifest.select("path").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path").mapInArrow(run, schema)


def resolve(headers: DataFrame) -> DataFrame:
    """Revisit headers with the payload size of the response they refer to, beside all responses."""
    headers = scratch.written(headers, "headers")
    originals = headers.filter("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("original_bytes"))
    revisits = headers.filter("record_type = 'revisit'").join(originals, ["refers_to", "payload_digest"], "left").withColumn("payload_bytes", F.col("original_bytes")).drop("original_bytes")
    return headers.filter("record_type = 'response'").unionByName(revisits)
