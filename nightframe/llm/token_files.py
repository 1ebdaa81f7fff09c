"""Token ids in length-delimited binary record files (operator 8).

A record is: length (unsigned 64-bit), masked CRC-32C of the length, the ids,
masked CRC-32C of the ids; all little-endian. Ids take two bytes where the
vocabulary fits, else four. Documents are range-partitioned and sorted by id,
each partition is one shard file, and beside it lies an index file with a fixed
row for each record: key, whether the key is set, byte offset of the record,
number of ids. A shuffled read draws index rows and seeks.

Words (between blanks and line feeds, which no token or normal form spans) are
encoded by the tokenizers library once for each worker's bounded table; a
document's ids are those of its words, one after the other. Stops and commas at
the end of a word, behind an ASCII letter or digit, are a word of their own, and
words that differ in ASCII case share an entry, as the vocabulary's rules treat
them alike (words with ``<`` are kept apart: special tokens have a case).

Nulls are empty texts; null keys sort first; equal keys sort by text; an empty
table gives no files and an empty result; other columns are left alone.
"""

from __future__ import annotations

import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import scratch
from .bpe import TABLE_LIMIT, WordTable
from .crc32c import crc32c, masked
from .textbytes import LOWER, SpanHash, mix, slices, word_spans

INDEX = np.dtype([("key", "<i8"), ("set", "<i8"), ("offset", "<i8"), ("ids", "<i8")])
CHUNK = 2 << 20
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, 0x0A]] = True
STOPS = np.zeros(256, bool)
STOPS[[ord(c) for c in ".,!?:;"]] = True
PLAIN = np.zeros(256, bool)
PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def split_words(data: np.ndarray, offsets: np.ndarray):
    """(starts, ends, hashes, first word of each row) of words and the stops behind them."""
    starts, ends, _ = word_spans(data, offsets, BLANKS)
    tail = np.flatnonzero(STOPS[data[ends - 1]])
    at = ends[tail] - 1
    for _ in range(3):
        at = np.where((at > starts[tail]) & STOPS[data[at - 1]], at - 1, at)
    cut = (at > starts[tail]) & PLAIN[data[at - 1]]
    tail, at = tail[cut], at[cut]
    ends, starts = np.insert(ends, tail, at), np.insert(starts, tail + 1, at)
    h = SpanHash(data, LOWER).of(starts, ends)
    if (odd := np.append(0, np.cumsum(data == 0x3C)))[-1]:
        odd = np.flatnonzero(odd[ends] > odd[starts])
        h[odd] = mix(SpanHash(data).of(starts[odd], ends[odd]))
    return starts, ends, h, np.searchsorted(starts, offsets)


class WordEncoder:
    """Whole texts by the tokenizers library, one new word at a time."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.width = 2 if self.lib.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.table = WordTable(TABLE_LIMIT)

    def learn(self, data: np.ndarray, h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        whole = data.tobytes()
        for at in range(0, len(h), 20_000):
            words = [whole[a:b].decode("utf-8", "replace") for a, b in zip(starts[at : at + 20_000].tolist(), ends[at : at + 20_000].tolist())]
            ids = [e.ids for e in self.lib.encode_batch_fast(words, add_special_tokens=False)]
            self.table.add(h[at : at + 20_000], np.array([i for x in ids for i in x], np.int32), np.array([len(x) for x in ids], np.int64))

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int | None):
        """(ids of all texts, id offsets of each text)."""
        starts, ends, h, first = split_words(data, offsets)
        table = self.table
        word = table.find(h)
        new = np.flatnonzero(word < 0)
        if len(new):
            if len(table.begin) + len(new) > table.limit and len(table.begin):
                table.clear()
                new = np.arange(len(h))
            new = new[np.unique(h[new], return_index=True)[1]]
            if len(new) > 2 * table.limit:
                table.limit = len(new)
                table.clear()
            self.learn(data, h[new], starts[new], ends[new])
            word = table.find(h)
        rows = len(offsets) - 1
        count = table.count[word].astype(np.int64) if len(word) else np.zeros(0, np.int64)
        begin = table.begin[word] if len(word) else np.zeros(0, np.int64)
        total = np.append(0, np.cumsum(count))
        ids = table.pool[np.repeat(begin - total[:-1], count) + np.arange(total[-1])]
        at = total[first]
        if end_id is not None:
            ids = np.insert(ids, at[1:], end_id)
            at = at + np.arange(rows + 1)
        return ids, at


@lru_cache(1)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def frames(raw: np.ndarray, at: np.ndarray):
    """Framed records of the rows of ``raw`` (bytes), as one bytes object."""
    size = np.diff(at)
    head = np.ascontiguousarray(size.astype("<u8")).view(np.uint8)
    head_crc = masked(crc32c(head, np.arange(len(size) + 1) * 8)).astype("<u4").tobytes()
    body_crc = masked(crc32c(raw, at)).astype("<u4").tobytes()
    head, body, rows = head.tobytes(), memoryview(np.ascontiguousarray(raw)), at.tolist()
    out = []
    for k in range(len(size)):
        out += [head[8 * k : 8 * k + 8], head_crc[4 * k : 4 * k + 4], body[rows[k] : rows[k + 1]], body_crc[4 * k : 4 * k + 4]]
    return b"".join(out)


def write(df: DataFrame, folder: str, path: str, end_id: int | None = None, shards: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write all texts' ids below ``folder`` in key order; the manifest (shard, path, records, ids, width)."""
    spark = df.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    rows = rows.repartitionByRange(shards, "key").sortWithinPartitions("key", "text")

    def run(batches):
        tokens = encoder(path)
        kind = "<u2" if tokens.width == 2 else "<u4"
        part = next(batches, None)
        while part is not None and not part.num_rows:
            part = next(batches, None)
        if part is None:
            return

        def all_batches():
            yield part
            yield from batches

        shard = TaskContext.get().partitionId()
        file, records, total, offset = f"{folder}/part-{shard:06d}", 0, 0, 0
        with scratch.committed(f"{file}.idx") as index, scratch.committed(f"{file}.rec") as sink:
            for batch, data, offsets in slices(all_batches(), "text"):
                ids, at = tokens.encode(data, offsets, end_id)
                raw = np.ascontiguousarray(ids.astype(kind)).view(np.uint8)
                sink.write(frames(raw, at * tokens.width))
                keys = batch.column("key")
                row = np.zeros(len(at) - 1, INDEX)
                row["key"] = keys.fill_null(0).to_numpy(zero_copy_only=False)
                row["set"] = keys.is_valid().to_numpy(zero_copy_only=False)
                row["ids"] = np.diff(at)
                size = np.diff(at) * tokens.width + 16
                row["offset"] = offset + np.cumsum(size) - size
                index.write(row.tobytes())
                offset += int(size.sum())
                records += len(row)
                total += len(ids)
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [file], "records": [records], "ids": [total], "width": pa.array([tokens.width], pa.int32())})

    manifest = rows.mapInArrow(run, "shard int, path string, records long, ids long, width int")
    return scratch.written(manifest, "manifest")


def _index(file: str) -> np.ndarray:
    with scratch.reader(f"{file}.idx") as f:
        return np.frombuffer(f.read(), INDEX)


def _checked(data: np.ndarray, offsets: np.ndarray, counts: np.ndarray, width: int):
    """Bodies of framed records at ``offsets``; raises where a length or checksum is wrong."""
    size = counts * width
    head = data[(offsets[:, None] + np.arange(12)).ravel()].reshape(-1, 12)
    length = np.ascontiguousarray(head[:, :8]).view("<u8").ravel()
    start = np.append(0, np.cumsum(size))
    body = data[np.repeat(offsets + 12 - start[:-1], size) + np.arange(start[-1])]
    tail = data[((offsets + 12 + size)[:, None] + np.arange(4)).ravel()].reshape(-1, 4)
    crc = masked(crc32c(np.ascontiguousarray(head[:, :8]).ravel(), np.arange(len(size) + 1) * 8))
    if (length != size).any() or (np.ascontiguousarray(head[:, 8:]).view("<u4").ravel() != crc).any() or (np.ascontiguousarray(tail).view("<u4").ravel() != masked(crc32c(body, start))).any():
        raise ValueError("a record's length or checksum is wrong")
    return np.ascontiguousarray(body).view("<u2" if width == 2 else "<u4"), start // width


def _records(file: str, width: int):
    """(index rows, ids, id offsets) of a shard, in bounded chunks."""
    index = _index(file)
    ends = index["offset"] + index["ids"] * width + 16
    with scratch.reader(f"{file}.rec") as f:
        row = 0
        while row < len(index):
            stop = max(row + 1, int(np.searchsorted(ends, index["offset"][row] + CHUNK, "right")))
            begin = int(index["offset"][row])
            f.seek(begin)
            data = np.frombuffer(f.read(int(ends[stop - 1]) - begin), np.uint8)
            part = index[row:stop]
            yield part, *_checked(data, part["offset"] - begin, part["ids"], width)
            row = stop


def _key_column(part: np.ndarray):
    return pa.array(part["key"], pa.int64(), mask=part["set"] == 0)


def read(manifest: DataFrame, digest: bool = False) -> DataFrame:
    """Records of the shards: (key, start, n_tokens, ids array<int>), or with ``digest`` (.., ids_crc32) instead of ids.

    ``start`` counts the ids of all records before; shards are few, so their running sum is a window over the manifest.
    """
    before = F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.withColumn("before", F.coalesce(before, F.lit(0))).select("path", "width", "before")
    shards = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                at = row["before"]
                for part, ids, first in _records(row["path"], row["width"]):
                    out = {"key": _key_column(part), "start": pa.array(at + first[:-1]), "n_tokens": pa.array(part["ids"].astype(np.int64))}
                    if digest:
                        raw, cut = memoryview(np.ascontiguousarray(ids.astype("<u4")).view(np.uint8)), (first * 4).tolist()
                        out["ids_crc32"] = pa.array([zlib.crc32(raw[a:b]) for a, b in zip(cut, cut[1:])], pa.int64())
                    else:
                        out["ids"] = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids.astype(np.int32)))
                    at += len(ids)
                    yield pa.RecordBatch.from_pydict(out)

    return files.repartition(shards, "path").mapInArrow(run, "key long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids array<int>"))


def read_shuffled(manifest: DataFrame, seed: int, partitions: int | None = None) -> DataFrame:
    """(key, ids) in an order drawn by ``seed``: index rows are shuffled, records are read by seeks."""
    spark: SparkSession = manifest.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def rows(batches):
        for batch in batches:
            for row in batch.to_pylist():
                index = _index(row["path"])
                for a in range(0, len(index), 50_000):
                    part = index[a : a + 50_000]
                    yield pa.RecordBatch.from_pydict({"path": pa.array([row["path"]] * len(part)), "width": pa.array([row["width"]] * len(part), pa.int32()), "key": _key_column(part), "offset": pa.array(part["offset"].astype(np.int64)), "ids": pa.array(part["ids"].astype(np.int64))})

    def fetch(batches):
        for batch in batches:
            at, keys, ids = 0, [], []
            files: dict[str, object] = {}
            for row in batch.to_pylist():
                if row["path"] not in files:
                    if len(files) >= 64:
                        files.pop(next(iter(files))).close()
                    files[row["path"]] = scratch.reader(row["path"] + ".rec")
                f = files[row["path"]]
                f.seek(row["offset"])
                data = np.frombuffer(f.read(row["ids"] * row["width"] + 16), np.uint8)
                keys.append(row["key"])
                ids.append(_checked(data, np.zeros(1, np.int64), np.array([row["ids"]]), row["width"])[0].astype(np.int32))
            for f in files.values():
                f.close()
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.int64()), "ids": pa.array(ids, pa.list_(pa.int32()))})

    index = manifest.select("path", "width").repartition(partitions, "path").mapInArrow(rows, "path string, width int, key long, offset long, ids long")
    drawn = index.withColumn("draw", F.xxhash64(F.lit(seed), "path", "offset"))
    return drawn.repartition(partitions, "draw").sortWithinPartitions("draw").drop("draw").mapInArrow(fetch, "key long, ids array<int>")
