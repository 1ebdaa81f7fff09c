"""Product-quantisation codes by Lloyd rounds over partition-local cover trees (operator 11).

Vectors become integers (components times 4096, rounded down) and are cut into equal consecutive parts, each with a
codebook of its own. A task packs its vectors in chunks; over each part of a chunk it builds a cover tree: the balls of
a level cover the points of the ball above with half its radius. Points are stored in the order of the leaves, so
a subtree is a range of them, and its sum the difference of two cumulative sums. The trees are written once to the
shared folder.

A round reads the trees and walks them from the root. An entry whose distance from a ball's centre exceeds the
nearest entry's by more than twice the radius is not the nearest of any point of the ball; where one entry is left, the
whole subtree is its own and adds one sum. Balls of one place and the leaves that stay ambiguous are compared exactly, in
integers, ties going to the lower index. Each task adds up a sum for each entry, Spark adds up those, and the driver sees the
codebooks alone.

Dropped are rows whose vector is null, holds a null or a number that isn't finite, can't be cut into equal parts, or has
another length than that of the smallest kept id. Scaled components beyond 2^26 count as 2^26, so distances fit 64
bits. Null ids come last; rows of one id are ordered by their vectors. With fewer vectors than entries the codebook
is shorter. Null labels are one label. Columns other than id, vector and label are not read; an empty table gives no
row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import scratch

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
LIMIT = 1 << 26
#: Vectors of a chunk, and points of a ball that is no longer split.
CHUNK, LEAF = 4096, 16
NODE = np.dtype([("start", "i4"), ("end", "i4"), ("centre", "i4"), ("lo", "i4"), ("hi", "i4"), ("radius", "f8")])


def scaled(values: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(values.astype(np.float64) * SCALE), -LIMIT, LIMIT).astype(np.int32)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances along the last axis."""
    d = a.astype(np.int64) - b
    return np.einsum("...i,...i->...", d, d)


def cover_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, nodes) of the points ``x``: a node's points are ``x[order[start:end]]``, its children the nodes lo to hi.

    All balls of a level are split together: each takes its first point that isn't covered yet as the next centre until
    every point is.
    """
    order = np.arange(len(x))
    far = squared(x, x[0])
    levels = [np.array([(0, len(x), 0, 0, 0, np.sqrt(far.max()))], NODE)]
    made = 1
    while True:
        level = levels[-1]
        wide = np.flatnonzero((level["end"] - level["start"] > LEAF) & (level["radius"] > 0))
        if not len(wide):
            return order.astype(np.int32), np.concatenate(levels)
        sizes = level["end"][wide] - level["start"][wide]
        at = np.repeat(level["start"][wide] - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum())
        points, ball = order[at], np.repeat(np.arange(len(wide)), sizes)
        reach = (level["radius"][wide] / 2) ** 2
        child, centre, away = np.full(len(at), -1), np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        left, k = np.arange(len(at)), 0
        while len(left):
            g = ball[left]
            first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            c = np.repeat(points[left[first]], np.diff(np.append(first, len(left))))
            d = squared(x[points[left]], x[c])
            inside = d <= reach[g]
            took = left[inside]
            child[took], centre[took], away[took] = k, c[inside], d[inside]
            left, k = left[~inside], k + 1
        by = np.lexsort((child, ball))
        order[at] = points[by]
        new = np.flatnonzero(np.append(True, (ball[by][1:] != ball[by][:-1]) | (child[by][1:] != child[by][:-1])))
        nodes = np.zeros(len(new), NODE)
        nodes["start"], nodes["end"] = at[new], at[np.append(new[1:], len(at)) - 1] + 1
        nodes["centre"], nodes["radius"] = centre[by][new], np.sqrt(np.maximum.reduceat(away[by], new))
        edge = np.searchsorted(ball[by][new], np.arange(len(wide) + 1))
        level["lo"][wide], level["hi"][wide] = made + edge[:-1], made + edge[1:]
        levels.append(nodes)
        made += len(nodes)


def walk(x: np.ndarray, order: np.ndarray, nodes: np.ndarray, book: np.ndarray):
    """Ranges of ``order`` of one code, as (start, end, code), and single places of it with theirs, as (place, code)."""
    at, live = np.zeros(1, np.int64), np.ones((1, len(book)), bool)
    ranges, singles = [], []
    while len(at):
        node = nodes[at]
        exact = squared(x[node["centre"]][:, None], book[None])
        d = np.sqrt(exact)
        best = np.where(live, d, np.inf).min(axis=1)
        live = live & (d <= ((best + 2 * node["radius"]) * (1 + 1e-9) + 1e-6)[:, None])
        alone = (live.sum(axis=1) == 1) | (node["radius"] == 0)
        ranges.append((node["start"][alone], node["end"][alone], np.where(live, exact, np.iinfo(np.int64).max).argmin(axis=1)[alone]))
        leaf = ~alone & (node["hi"] == node["lo"])
        if leaf.any():
            sizes = node["end"][leaf] - node["start"][leaf]
            place = np.repeat(node["start"][leaf] - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum())
            near = squared(x[order[place]][:, None], book[None])
            singles.append((place, np.where(np.repeat(live[leaf], sizes, axis=0), near, np.iinfo(np.int64).max).argmin(axis=1)))
        down = ~alone & (node["hi"] > node["lo"])
        n = (node["hi"] - node["lo"])[down]
        at = np.repeat(node["lo"][down] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        live = np.repeat(live[down], n, axis=0)
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*ranges)), tuple(np.concatenate(c) for c in zip(*singles)) if singles else (none, none)


def entry_sums(x: np.ndarray, order: np.ndarray, nodes: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Number of points and sum of each component, for each entry: subtrees by their cumulative sums."""
    (start, end, code), (place, own) = walk(x, order, nodes, book)
    cumulative = np.zeros((len(x) + 1, x.shape[1] + 1), np.int64)
    cumulative[1:, 0] = np.arange(1, len(x) + 1)
    np.cumsum(x[order], axis=0, out=cumulative[1:, 1:])
    out = np.zeros((len(book), x.shape[1] + 1), np.int64)
    np.add.at(out, code, cumulative[end] - cumulative[start])
    np.add.at(out, own, np.concatenate([np.ones((len(place), 1), np.int64), x[order[place]]], axis=1))
    return out


def codes_of(x: np.ndarray, order: np.ndarray, nodes: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The code of every point, in the points' own order."""
    (start, end, code), (place, own) = walk(x, order, nodes, book)
    out = np.zeros(len(x), np.int64)
    by = np.argsort(start)
    gone = np.repeat(code[by], (end - start)[by])
    held = np.ones(len(x), bool)
    held[place] = False
    out[order[held]] = gone
    out[order[place]] = own
    return out


def usable(vectors: DataFrame, key: str, vector: str, label: str, parts: int) -> tuple[DataFrame, np.ndarray]:
    """Rows with a sound vector, as (id, label, vector), and the scaled vectors of the smallest ids."""
    x = F.col("vector")
    rows = vectors.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    # not a number is above infinity
    sound = F.forall(x, lambda c: c.isNotNull() & (F.abs(c) < float("inf")))
    rows = rows.filter(x.isNotNull() & (F.size(x) > 0) & (F.size(x) % parts == 0) & sound)
    first = rows.orderBy(F.asc_nulls_last("id"), "vector").select("vector").limit(1).collect()
    if not first:
        return rows, np.zeros((0, 0), np.int32)
    rows = rows.filter(F.size(x) == len(first[0][0]))
    least = rows.orderBy(F.asc_nulls_last("id"), "vector").select("vector").limit(ENTRIES).collect()
    return rows, scaled(np.array([r[0] for r in least]))


def trees(rows: DataFrame, parts: int = PARTS) -> DataFrame:
    """A row for each chunk: ids, labels, scaled vectors, and order and nodes of each part's cover tree."""

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        x = scaled(np.asarray(table["vector"].chunk(0).flatten())).reshape(len(table), -1)
        built = [cover_tree(part) for part in np.split(x, parts, axis=1)]
        whole = lambda c: pa.ListArray.from_arrays(pa.array([0, len(table)], pa.int32()), table[c].chunk(0))
        return pa.RecordBatch.from_arrays([whole("id"), whole("label"), pa.array([x.tobytes()]), pa.array([[o.tobytes() for o, _ in built]]), pa.array([[n.tobytes() for _, n in built]])], ["ids", "labels", "x", "orders", "nodes"])

    def pack(batches):
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                held.append(batch.slice(0, CHUNK - n))
                batch = batch.slice(CHUNK - n)
                n += held[-1].num_rows
                if n == CHUNK:
                    yield flush(held)
                    held, n = [], 0
        if n:
            yield flush(held)

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "label")}
    return rows.mapInArrow(pack, f"ids array<{kinds['id']}>, labels array<{kinds['label']}>, x binary, orders array<binary>, nodes array<binary>")


def _chunks(batches, parts: int):
    """(ids, labels, parts' points, orders, nodes) of each stored chunk."""
    for batch in batches:
        for i in range(batch.num_rows):
            ids, labels = batch.column("ids").slice(i, 1).flatten(), batch.column("labels").slice(i, 1).flatten()
            x = np.frombuffer(batch.column("x")[i].as_py(), np.int32).reshape(len(ids), -1)
            orders, nodes = ([np.frombuffer(b, kind) for b in batch.column(c)[i].as_py()] for c, kind in (("orders", np.int32), ("nodes", NODE)))
            yield ids, labels, np.split(x, parts, axis=1), orders, nodes


def refined(stored: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one more round; an entry that no part chose stays."""
    parts, entries, width = books.shape

    def add_up(batches):
        sums = np.zeros((parts, entries, width + 1), np.int64)
        for _, _, x, orders, nodes in _chunks(batches, parts):
            for p in range(parts):
                sums[p] += entry_sums(x[p], orders[p], nodes[p], books[p])
        if sums[:, :, 0].any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums.size), pa.int32()), pa.array(sums.ravel())], ["cell", "total"])

    found = stored.mapInArrow(add_up, "cell int, total bigint").groupBy("cell").agg(F.sum("total")).collect()
    sums = np.zeros(parts * entries * (width + 1), np.int64)
    for cell, total in found:
        sums[cell] = total
    sums = sums.reshape(parts, entries, width + 1)
    n = sums[:, :, :1]
    return np.where(n > 0, sums[:, :, 1:] // np.maximum(n, 1), books)


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(stored: DataFrame, books: np.ndarray) -> DataFrame:
    """(id, label, code, error): the parts' entries as two hex digits each, and the squared distance from them."""
    parts = len(books)

    def tell(batches):
        for ids, labels, x, orders, nodes in _chunks(batches, parts):
            codes = np.stack([codes_of(x[p], orders[p], nodes[p], books[p]) for p in range(parts)], axis=1)
            error = sum(squared(x[p], books[p][codes[:, p]]) for p in range(parts))
            text = codes.astype(np.uint8).tobytes().hex()
            yield pa.RecordBatch.from_arrays([ids, labels, pa.array([text[k : k + 2 * parts] for k in range(0, len(text), 2 * parts)], pa.string()), pa.array(error)], ["id", "label", "code", "error"])

    kinds = {c: stored.schema[f"{c}s"].dataType.elementType.simpleString() for c in ("id", "label")}
    return stored.mapInArrow(tell, f"id {kinds['id']}, label {kinds['label']}, code string, error bigint")


def product_codes(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, rounds: int = ROUNDS) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of every kept vector."""
    rows, least = usable(vectors, key, vector, label, parts)
    stored = scratch.written(trees(rows, parts), "cover-trees")
    books = np.stack(np.split(least, parts, axis=1)).astype(np.int64) if len(least) else np.zeros((parts, 0, 0), np.int64)
    for _ in range(rounds if len(least) else 0):
        books = refined(stored, books)
    coded = scratch.written(encode(stored, books), "codes")
    by_label = coded.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error"))
    out = coded.join(by_label, F.col("label").eqNullSafe(F.col("__label")))
    return out.select(F.col("id").alias(key), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
