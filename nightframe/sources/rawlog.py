"""Binary sensor logs: concatenated records, each a map {seq, data} whose data holds frames.

Files are read by Spark's ``binaryFile`` source and decoded in tasks; a file is a
bounded piece of log. A damaged stretch is skipped to the next record marker and
reported in ``corrupt_bytes`` of the file's first row after it.
"""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

MARK = 0xA2
MAX_DATA = 1_000_000
SCHEMA = "file string, seq long, type string, ts double, frame string, corrupt_bytes long"


class Malformed(ValueError):
    """Bytes that are no record."""


class Incomplete(ValueError):
    """A record that the bytes end within."""


def item(raw: bytes, at: int, depth: int = 0):
    """(value, next offset) of one item of the concise binary object representation."""
    if depth > 32:
        raise Malformed("nested too deeply")
    if at >= len(raw):
        raise Incomplete
    major, info = raw[at] >> 5, raw[at] & 31
    at += 1
    size = {24: 1, 25: 2, 26: 4, 27: 8}.get(info, 0)
    if info > 27 and not (info == 31 and major in (4, 5, 7)):
        raise Malformed("unsupported length")
    if at + size > len(raw):
        raise Incomplete
    n = int.from_bytes(raw[at : at + size], "big") if size else info
    bits, at = raw[at : at + size], at + size
    if major == 0:
        return n, at
    if major == 1:
        return -1 - n, at
    if major in (2, 3):
        if at + n > len(raw):
            raise Incomplete
        part = raw[at : at + n]
        return (bytes(part) if major == 2 else part.decode("utf-8", "replace")), at + n
    if major in (4, 5):
        out, left = [], (n if info != 31 else -1)
        while left:
            if left < 0 and at < len(raw) and raw[at] == 0xFF:
                at += 1
                break
            value, at = item(raw, at, depth + 1)
            if major == 5:
                key, (value, at) = value, item(raw, at, depth + 1)
                value = (key, value)
            out.append(value)
            left -= 1
        return (dict(out) if major == 5 else out), at
    if major == 6:
        return item(raw, at, depth + 1)
    if info in (25, 26, 27):
        return struct.unpack({25: ">e", 26: ">f", 27: ">d"}[info], bits)[0], at
    return {20: False, 21: True}.get(info), at


def records(raw: bytes):
    """(seq, data, bytes skipped before) of the records of a log; empty data is passed over."""
    at = skipped = 0
    while at < len(raw):
        try:
            if raw[at] != MARK:
                raise Malformed("no marker")
            value, end = item(raw, at)
            if not isinstance(value, dict) or set(value) != {"seq", "data"} or not isinstance(value["data"], bytes) or len(value["data"]) > MAX_DATA:
                raise Malformed("no record")
        except Incomplete:
            after = raw.find(bytes([MARK]), at + 1)
            if after < 0:  # the tail may still be written
                return
            skipped, at = skipped + after - at, after
            continue
        except (Malformed, TypeError):
            after = raw.find(bytes([MARK]), at + 1)
            after = len(raw) if after < 0 else after
            skipped, at = skipped + after - at, after
            continue
        at = end
        if value["data"]:
            yield value["seq"], value["data"], skipped
            skipped = 0


def frames(data: bytes):
    """All frames of a record; values without a type are dropped."""
    at = 0
    while at < len(data):
        try:
            value, at = item(data, at)
        except ValueError:
            return
        if isinstance(value, dict) and isinstance(value.get("type"), str):
            yield value


def read(spark: SparkSession, path: str, glob: str = "*.RAW") -> DataFrame:
    """A row for each frame; ``frame`` is JSON, byte buffers as little-endian 32-bit numbers."""
    import json

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).filter(~F.col("path").endswith("SEQNO.RAW"))

    def plain(x):
        if isinstance(x, bytes):
            return list(struct.unpack(f"<{len(x) // 4}i", x[: len(x) // 4 * 4]))
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, list) else x

    def run(batches):
        for batch in batches:
            for file, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                rows = [{"file": file, "seq": seq, "type": f["type"], "ts": float(f["ts"]) if isinstance(f.get("ts"), (int, float)) else None, "frame": json.dumps(plain(f)), "corrupt_bytes": skipped} for seq, data, skipped in records(raw or b"") for f in frames(data)]
                for a in range(0, len(rows), 5000):
                    yield pa.RecordBatch.from_pylist(rows[a : a + 5000], pa.schema([("file", pa.string()), ("seq", pa.int64()), ("type", pa.string()), ("ts", pa.float64()), ("frame", pa.string()), ("corrupt_bytes", pa.int64())]))

    return files.select("path", "content").mapInArrow(run, SCHEMA)
