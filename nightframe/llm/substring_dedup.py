"""Substring dedup by prefix-partitioned suffix trees over words (operator 9).

A window is ``width`` consecutive words of one document. A word goes if a window
over it has a word sequence that also starts in a document with a smaller id.

1. Anchors. Of the runs of ``gram`` words in a window the one with the least hash
   is its anchor; equal windows have equal anchors, and about a quarter of all
   positions are anchors. Windows whose anchor is in no other document repeat
   nowhere; they never leave their task.
2. Suffixes. Every window that is left begins a suffix. Its code is made of bits
   of its words in order, so a range of codes is a set of prefixes, short for
   rare ones and long for frequent ones; a range partitioner that samples the
   codes cuts them into groups of equal size. Suffixes with the same window in
   one task are reduced to the one of the least document first.
3. Subtrees. A group in the order of its codes and window fingerprints is the
   leaf order of its subtree, in which the edge below the prefix is held by the
   fingerprint of its words (the words themselves would be ``width`` times the
   text). An internal node at depth ``width`` or more is a run of leaves with
   one fingerprint; its least document is where the sequence begins first.
   Overlapping marks join to maximal repeats, whatever their length.

Fingerprints have 64 bits. Null ids and null texts: a document without an id is
kept whole and is no source; a null text has no words. Rows of the same id do
not repeat each other (they are told apart by 30 bits of a hash of their text); an empty table gives an empty result; other columns are
left alone.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import scratch
from .sharing import KEPT, hit_lists, shared
from .textbytes import SpanHash, mix, runs, slices, windows, word_spans

WIDTH = 13
GRAM = 7
CHUNK = 1 << 20


def _windows(data, offsets, width: int, gram: int):
    """(words' hashes, first word of each row, window starts, rows, anchors): all windows of a slice."""
    starts, ends, first = word_spans(data, offsets)
    words = SpanHash(data).of(starts, ends)
    grams = windows(words, gram)
    count = np.maximum(0, np.diff(first) - width + 1)
    row = np.repeat(np.arange(len(count)), count)
    at = np.repeat(first[:-1], count) + runs(count)
    anchor = np.full(len(at), ~np.uint64(0))
    for k in range(width - gram + 1):
        if len(at):
            np.minimum(anchor, grams[at + k], out=anchor)
    return words, first, at, row, anchor


def _anchor_entries(width: int, gram: int):
    def entries(batches):
        for batch, data, offsets in slices(batches, "text"):
            _, _, _, row, anchor = _windows(data, offsets, width, gram)
            new = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]))) if len(row) else row
            row, anchor = row[new], anchor[new]
            order = np.lexsort((anchor, row))
            row, anchor = row[order], anchor[order]
            keep = np.append(True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])) if len(row) else np.zeros(0, bool)
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            yield ids[row[keep]], anchor[keep]

    return entries


def _suffixes(width: int, gram: int):
    """Rows with hits -> suffixes, and marks that are certain within the task (fingerprint null).

    ``at`` holds the window's start in its low 32 bits and a tag of the row's version above them.
    """
    names = ["code", "print", "doc_id", "at"]

    def flush(parts):
        code, print_, doc, at = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((doc, print_))
        code, print_, doc, at = code[order], print_[order], doc[order], at[order]
        new = np.append(True, print_[1:] != print_[:-1])
        told = doc > doc[np.flatnonzero(new)][np.cumsum(new) - 1]
        # marks only pass through: any group will do
        code[told] = mix(print_[told] + at[told].view(np.uint64) + doc[told].view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(print_.view(np.int64), mask=told), pa.array(doc), pa.array(at)], names)

    def run(batches):
        parts, size = [], 0
        for batch, data, offsets in slices((b.filter(b.column("hits").is_valid()) for b in batches), "text"):
            words, first, at, row, anchor = _windows(data, offsets, width, gram)
            hit_row, hit = hit_lists(batch.column("hits"))
            salt = lambda r: mix(r.astype(np.uint64) + np.uint64(1))
            keep = np.isin(anchor & KEPT ^ salt(row), hit & KEPT ^ salt(hit_row))
            at, row = at[keep], row[keep]
            code = np.zeros(len(at), np.uint64)
            for k in range(8):
                code = code << np.uint64(8) | words[at + min(k, width - 1)] >> np.uint64(56)
            ids = batch.column("__id").to_numpy(zero_copy_only=False).astype(np.int64)
            tags = _tags(batch)
            parts.append((code, windows(words, width)[at], ids[row], (at - first[row]) | tags[row] << 32))
            size += len(at)
            if size >= CHUNK:
                yield flush(parts)
                parts, size = [], 0
        if size:
            yield flush(parts)

    return run, ", ".join(f"{n} long" for n in names)


def _tags(batch) -> np.ndarray:
    """30 bits that tell rows of one id apart."""
    return batch.column("__version").to_numpy(zero_copy_only=False) & 0x3FFFFFFF


def _deep_nodes(batches):
    """Marks of a group in leaf order: leaves of a deep node whose document isn't the least below it."""
    last, least = None, 0
    for batch in batches:
        print_ = batch.column("print")
        told = print_.is_null().to_numpy(zero_copy_only=False)
        h = print_.fill_null(0).to_numpy(zero_copy_only=False)
        doc = batch.column("doc_id").to_numpy(zero_copy_only=False)
        marks = told.copy()
        leaves = np.flatnonzero(~told)
        if len(leaves):
            x, d = h[leaves], doc[leaves]
            new = np.append(last is None or x[0] != last, x[1:] != x[:-1])
            group = np.cumsum(new)
            low = np.append(least, d[np.flatnonzero(new)])[group]
            marks[leaves] = d > low
            last, least = x[-1], low[-1]
        if marks.any():
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(marks)) for c in ("doc_id", "at")], ["doc_id", "at"])


def _rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """The text, an id, a version, and all other columns as one, whatever their names.

    Both joins below read this, so its shuffle by id is made once.
    """
    rest = F.struct(*(F.col(f"`{c}`") for c in df.columns if c != text))
    return df.select(F.col(key).cast("long").alias("__id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("__version"), F.col(text).alias("text"), rest.alias("rest"))


def _marks(rows: DataFrame, width: int, gram: int) -> DataFrame:
    """(__id, starts array<long>): window starts, tagged by version, that begin in a smaller document."""
    gram = min(gram, width)
    hits = scratch.written(shared(rows, _anchor_entries(width, gram), "__id", "text"), "anchors").withColumnRenamed("doc_id", "__id")
    run, schema = _suffixes(width, gram)
    suffixes = rows.join(hits, "__id", "left").mapInArrow(run, schema)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leaves = suffixes.repartitionByRange(n, "code").sortWithinPartitions("code", "print", "doc_id")
    return leaves.mapInArrow(_deep_nodes, "doc_id long, at long").groupBy(F.col("doc_id").alias("__id")).agg(F.collect_set("at").alias("starts"))


def _removed(batch, first: np.ndarray, width: int) -> np.ndarray:
    """Whether each word of the slice goes."""
    cover = np.zeros(int(first[-1]) + 1, np.int64)
    lists = batch.column("starts")
    size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = lists.drop_null().flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(batch.num_rows), size)
    own = flat >> 32 == _tags(batch)[row]
    at = first[row[own]] + (flat[own] & 0xFFFFFFFF)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + width, -1)
    return np.cumsum(cover)[:-1] > 0


def _kept(data, starts, ends, first, gone):
    """(bytes, row ends): the kept words of each row, a blank behind each."""
    keep = np.flatnonzero(~gone)
    size = (ends - starts)[keep] + 1
    stop = np.cumsum(size)
    total = int(stop[-1]) if len(stop) else 0
    index = np.repeat(starts[keep] - (stop - size), size) + np.arange(total)
    out = np.append(data, np.uint8(0x20))[index] if total else np.zeros(0, np.uint8)
    out[stop - 1] = 0x20
    return out, np.append(0, stop)[np.searchsorted(keep, first)]


def dedup(df: DataFrame, width: int = WIDTH, gram: int = GRAM, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """The documents without their repeats.

    All columns of ``df``, the text rebuilt from the kept words where any goes; with ``digest`` instead
    (doc_id, n_words, n_removed, kept_sha256) of every row.
    """
    rows = _rows(df.select(key, text) if digest else df, key, text)
    found = _marks(rows, width, gram)
    joined = rows.join(found, "__id", "left")
    names = [key, text] if digest else df.columns
    schema = f"{key} {df.schema[key].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string" if digest else df.schema

    def run(batches):
        for batch, data, offsets in slices(batches, "text"):
            starts, ends, first = word_spans(data, offsets)
            rest = dict(zip((c for c in names if c != text), batch.column("rest").flatten()))
            gone = _removed(batch, first, width)
            removed = np.diff(np.append(0, np.cumsum(gone))[first])
            out, at = _kept(data, starts, ends, first, gone)
            raw, cut = memoryview(out), at.tolist()
            if digest:
                sha = [hashlib.sha256(raw[a : max(a, b - 1)]).hexdigest() for a, b in zip(cut, cut[1:])]
                yield pa.RecordBatch.from_arrays([rest[key], pa.array(np.diff(first)), pa.array(removed), pa.array(sha, pa.string())], [key, "n_words", "n_removed", "kept_sha256"])
            else:
                texts = batch.column("text").to_pylist()
                for k in np.flatnonzero(removed):
                    texts[k] = bytes(raw[cut[k] : max(cut[k], cut[k + 1] - 1)]).decode()
                yield pa.RecordBatch.from_arrays([pa.array(texts, batch.column("text").type) if c == text else rest[c] for c in names], names)

    return joined.mapInArrow(run, schema)


def maximal_repeats(df: DataFrame, width: int = WIDTH, gram: int = GRAM, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, n_words): stretches of at least ``width`` words whose windows begin in smaller documents."""
    found = _marks(_rows(df, key, text), width, gram)
    at = found.select(F.col("__id").alias("doc_id"), F.explode("starts").alias("s")).select("doc_id", F.expr("s >> 32").alias("version"), F.expr("s & 4294967295L").alias("at"))
    # windows that touch or overlap belong to one stretch
    w = Window.partitionBy("doc_id", "version").orderBy("at")
    new = (F.col("at") > F.lag("at").over(w) + width).cast("int")
    return at.withColumn("stretch", F.sum(F.coalesce(new, F.lit(0))).over(w)).groupBy("doc_id", "version", "stretch").agg(F.min("at").alias("start"), (F.max("at") + width - F.min("at")).alias("n_words")).select("doc_id", "start", "n_words")
