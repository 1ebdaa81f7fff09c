"""Which of a document's fingerprints also occur in another document.

Map tasks pack fingerprints of bounded chunks of documents into one row for each
range of fingerprints; a range's rows meet in one group. Within a chunk a
fingerprint of several documents is known to be shared at once, and only one
entry of it goes on, so a fingerprint that a third of all documents have adds
one entry for each chunk and not one for each document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .textbytes import give_back, mix, text_bytes

#: Entries of a chunk.
CHUNK = 1 << 20
#: The part of a fingerprint that is compared: a chance meeting only lets a document through to exact steps.
KEPT = np.uint64(0xFFFFFFFFFFFF0000)
#: Class of fingerprints that several documents of one chunk have; below ``NUMBER``, the count of documents.
HOT = np.uint64(255)
#: Class of entries that carry a document's own number instead of a fingerprint.
NUMBER = np.uint64(254)
#: Stands for several documents of one chunk.
SEVERAL = np.int64(-(2**63))


def squeeze(hashes: np.ndarray, docs: np.ndarray) -> bytes:
    """Entries as bytes: seven bytes of each hash and the differences of the sorted documents."""
    order = np.argsort(docs, kind="stable")
    hashes, docs = hashes[order], docs[order]
    several = int(np.searchsorted(docs, SEVERAL, "right"))
    steps = np.diff(docs[several:])
    kind = 2 if len(steps) and int(steps.min()) < 0 else int(bool(len(steps)) and int(steps.max()) >= 1 << 32)
    head = np.array([len(docs), several, kind, docs[several] if several < len(docs) else 0], np.int64)
    seven = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 1:]
    tail = docs[several:].astype("<i8") if kind == 2 else steps.astype("<i8" if kind else "<u4")
    return head.tobytes() + seven.tobytes() + tail.tobytes()


def unsqueeze(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, several, kind, first = np.frombuffer(raw, np.int64, 4).tolist()
    full = np.zeros((n, 8), np.uint8)
    full[:, 1:] = np.frombuffer(raw, np.uint8, 7 * n, 32).reshape(n, 7)
    tail = np.frombuffer(raw, "<i8" if kind else "<u4", offset=32 + 7 * n).astype(np.int64)
    docs = np.full(n, SEVERAL)
    if n > several:
        docs[several:] = tail if kind == 2 else first + np.append(0, np.cumsum(tail))
    return full.view("<u8").ravel(), docs


def _groups(hashes: np.ndarray, docs: np.ndarray):
    """Entries sorted by hash: (hashes, docs, group of each entry, whether the group has several documents)."""
    order = np.lexsort((docs, hashes))
    hashes, docs = hashes[order], docs[order]
    new = np.append(True, hashes[1:] != hashes[:-1])
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(hashes)) - 1
    return hashes, docs, group, first, (docs[first] != docs[last]) | (docs[first] == SEVERAL)


def _hits(docs: np.ndarray, edge: list, hashes: np.ndarray, _):
    """The default result: all hashes of a document as bytes."""
    raw = hashes.tobytes()
    return {"doc_id": pa.array(docs, pa.int64()), "hits": pa.array([raw[8 * a : 8 * b] for a, b in zip(edge, edge[1:])], pa.binary())}


def shared(df: DataFrame, entries, key: str = "doc_id", text: str = "text", finish=_hits, schema: str = "doc_id long, hits binary") -> DataFrame:
    """What ``finish`` makes of the hashes (cut to ``KEPT``) that each document shares with another.

    The second lowest byte of a hash is its class: ``HOT``, or else its number of documents. All documents that have a
    hash are told the same class.

    ``entries(batches)`` yields arrays (document ids, hashes), one entry for each distinct hash of a document, and after
    them, if wanted, (document ids, a number below 2^48 of each). Documents without an id take no part.
    ``finish(documents, edges, hashes, numbers)`` gets a group of documents with ``hashes[edges[i]:edges[i + 1]]`` those
    of the i-th in no order, and the least number given for it (-1 without any).
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = 2 * partitions

    def pack(batches):
        def flush(docs, hashes, whole, numbers):
            h, d, group, first, several = _groups(np.concatenate(hashes) & KEPT, np.concatenate(docs))
            told = several[group] & (d != SEVERAL)
            spread = n + (TaskContext.get().partitionId() * 31 + flushed) % n
            through = (np.concatenate([h[told] | HOT << np.uint64(8), *numbers]), np.concatenate([d[told], *whole]))
            rows = [(spread, squeeze(*through))] if len(through[0]) else []
            h, d = h[first], np.where(several, SEVERAL, d[first])
            cut = np.searchsorted((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32), np.arange(n + 1, dtype=np.uint64)).tolist()
            rows += [(k, squeeze(h[a:b], d[a:b])) for k, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary()))], ["part", "entries"])

        parts, size, flushed = ([], [], [], []), 0, 0
        for d, h, *own in entries(batches):
            parts[0].append(d)
            parts[1].append(h)
            if own:
                parts[2].append(own[0])
                parts[3].append(own[1].astype(np.uint64) << np.uint64(16) | NUMBER << np.uint64(8))
            size += len(h)
            if size >= CHUNK:
                yield flush(*parts)
                parts, size, flushed = ([], [], [], []), 0, flushed + 1
        if size:
            yield flush(*parts)
        parts = None
        give_back()

    def meet(table):
        give_back()
        part = table.column("part")[0].as_py()
        h, d = (np.concatenate(x) for x in zip(*map(unsqueeze, table.column("entries").to_pylist())))
        if part < n:
            h, d, group, first, several = _groups(h, d)
            count = np.diff(np.append(first, len(h)))
            order = np.where(d[first] == SEVERAL, HOT, np.minimum(count, int(NUMBER) - 1).astype(np.uint64)).astype(np.uint64)
            told = several[group] & (d != SEVERAL)
            h, d = h[told] | order[group[told]] << np.uint64(8), d[told]
        # on to the documents' own groups, again as one row for each
        to = (mix(d.view(np.uint64)) % np.uint64(partitions)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        to, h, d = to[order], h[order], d[order]
        cut = np.flatnonzero(np.append(True, to[1:] != to[:-1])) if len(to) else np.zeros(0, np.int64)
        edge = np.append(cut, len(to)).tolist()
        return pa.table({"part": pa.array(to[cut], pa.int32()), "entries": pa.array([squeeze(h[a:b], d[a:b]) for a, b in zip(edge, edge[1:])], pa.binary())})

    def gather(table):
        give_back()
        h, d = (np.concatenate(x) for x in zip(*map(unsqueeze, table.column("entries").to_pylist())))
        is_number = h >> np.uint64(8) & np.uint64(255) == NUMBER
        whole, number = d[is_number], (h[is_number] >> np.uint64(16)).astype(np.int64)
        h, d = h[~is_number], d[~is_number]
        order = np.argsort(d, kind="stable")
        h, d = h[order], d[order]
        first = np.flatnonzero(np.append(True, d[1:] != d[:-1])) if len(d) else np.zeros(0, np.int64)
        docs = d[first]
        order = np.lexsort((number, whole))
        whole, number = whole[order], number[order]
        at = np.searchsorted(whole, docs)
        own = np.where(np.append(whole, 0)[at] == docs, np.append(number, -1)[at], -1) if len(whole) else np.full(len(docs), -1)
        return pa.table(finish(docs, np.append(first, len(d)).tolist(), h, own))

    packed = df.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(pack, "part int, entries binary")
    met = packed.groupBy("part").applyInArrow(meet, "part int, entries binary")
    return met.groupBy("part").applyInArrow(gather, schema)


def hit_lists(column) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of all entries of a column of ``hits``."""
    data, offsets = text_bytes(column)
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets) // 8), np.frombuffer(data.tobytes(), np.uint64)
