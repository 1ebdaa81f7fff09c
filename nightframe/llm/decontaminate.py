"""Benchmark decontamination by latent semantic retrieval (operator 6).

1. Passages are runs of ``SIZE`` words of each whole text (the last one may be
   shorter); their TF-IDF vectors have a feature for each of at most 2^16 word
   hashes. Features that no item has add nothing to a product with an item and
   are left out. Document frequencies are counted over all passages.
2. A randomised SVD in one pass over all passages: with a Gaussian test matrix W,
   tasks add up A'(AW) in fixed-size partial sums; its orthonormal basis spans
   the leading right singular vectors (one power iteration), singular values
   follow from W'(A'A)W by the Nystroem form. A sum has at most 2^16 x RANK
   numbers, whatever the input.
3. Search: each passage with its next one (their latent vectors add up) meets
   every item in the latent space; candidates have a cosine of at least
   ``COSINE``. Items come in blocks of ``BLOCK``; those of a large benchmark are
   files that each batch of documents meets in turn, so that it costs time, not
   memory. Rows and results are the same for any blocks.
   Items of more than ``LONG`` words are searched by parts of at most ``PART``: an
   item that is covered to some share has a part that is covered to it at least.
   Those of at most ``FEW`` words are candidates wherever the bound lets them.
4. Bound: a candidate that holds fewer of the part's features, first of its rare
   ones, than a match that spans four passages must have in two neighbours is
   dropped.
5. Checks: the longest common subsequence of words between an item and the
   passages with their surroundings must cover ``COVER`` of the item (first asked of
   the part alone); and the item's answer, its last ``ANSWER`` words, must be there but for one of them, or
   the cover be nearly full.

Words are lower-cased (A-Z) and split at ASCII white space, stops, quotes and
brackets. Nulls and texts without words hold nothing; items without
words or id match nothing; rows with null ids are judged like others; repeated
rows get equal results; empty tables give empty results.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import scratch
from .textbytes import LOWER, WORD_BREAKS, SpanHash, runs, slices, text_bytes, word_spans

SIZE = 24
#: Bits of the hashed features, and dimensions of the latent space.
BITS, RANK, SEED = 16, 64, 7
#: Columns of the test matrix beyond the rank.
MORE = 16
COSINE = 0.4
#: Share of passages up to which a feature is rare.
RARE = 0.002
COVER, NEARLY, ANSWER = 0.7, 0.9, 4
BLOCK = 1024
LONG, PART = 64, 48
#: Words up to which an item is too small a part of two passages for a cosine: the bound alone selects.
FEW = 6
BREAKS = WORD_BREAKS.copy()
BREAKS[[ord(c) for c in ".,;:!?\"'()[]"]] = True


def words_of(data: np.ndarray, offsets: np.ndarray):
    """(hashes, first word of each row)."""
    starts, ends, first = word_spans(data, offsets, BREAKS)
    return SpanHash(data, LOWER).of(starts, ends), first


def passages(first: np.ndarray):
    """(row, first word, end) of the passages of each row's words."""
    n = np.diff(first)
    count = -(-n // SIZE)
    row = np.repeat(np.arange(len(n)), count)
    begin = first[row] + runs(count) * SIZE
    return row, begin, np.minimum(begin + SIZE, first[row + 1])


def features_of(h: np.ndarray, begin: np.ndarray, numbers: np.ndarray):
    """(feature, passage) of the words that have a feature, by passage."""
    f = numbers[(h >> np.uint64(64 - BITS)).astype(np.int64)]
    at = np.flatnonzero(f >= 0)
    return f[at], np.searchsorted(begin, at, "right") - 1


def _by_passage(table: np.ndarray, f: np.ndarray, passage: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows ``f`` of ``table`` for each of ``n`` passages (which come in order): first words, second words and so on."""
    out = np.zeros((n, table.shape[1]), table.dtype)
    if len(f):
        cut = np.flatnonzero(np.append(True, passage[1:] != passage[:-1]))
        long = np.diff(np.append(cut, len(f)))
        place = runs(long)
        order = np.argsort(place.astype(np.uint16) if long.max() < 1 << 16 else place, kind="stable")
        edges = np.append(0, np.cumsum(np.bincount(place))).tolist()
        for a, b in zip(edges, edges[1:]):
            out[passage[order[a:b]]] += table[f[order[a:b]]]
    return out


def _by_feature(f: np.ndarray, passage: np.ndarray):
    """(order of the words by feature and then passage, first word of each feature in it)."""
    order = np.argsort(f.astype(np.uint16), kind="stable")
    return order, np.flatnonzero(np.append(True, np.diff(f[order]) > 0))


def _summed(df: DataFrame, run, width: int) -> np.ndarray:
    """Column sums of fixed-size partial sums: tasks give 64 slices each, slices meet by number and are added one by one."""
    parts = 64

    def tasks(batches):
        total = run(batches)
        for k, x in enumerate(np.array_split(total.astype(np.float64).ravel(), parts)):
            yield pa.RecordBatch.from_pydict({"part": pa.array([k], pa.int32()), "sums": pa.array([x.tobytes()], pa.binary())})

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column("part").to_pylist(), batch.column("sums")):
                x = np.frombuffer(raw.as_buffer())
                total[k] = total[k] + x if k in total else x.copy()
        for k, x in total.items():
            yield pa.RecordBatch.from_pydict({"part": pa.array([k], pa.int32()), "sums": pa.array([x.tobytes()], pa.binary())})

    schema = "part int, sums binary"
    got = {r["part"]: r["sums"] for r in df.mapInArrow(tasks, schema).repartition(parts, "part").mapInArrow(add, schema).collect()}
    return np.concatenate([np.frombuffer(got[k]) for k in range(parts)]) if got else np.zeros(width)


@dataclass
class Latent:
    """Numbers of the features (-1: none), inverse document frequencies, an orthonormal basis, and singular values."""

    numbers: np.ndarray
    idf: np.ndarray
    basis: np.ndarray
    singular: np.ndarray


def _numbers(items) -> np.ndarray:
    """The features that the items' words have, numbered; seen item by item."""
    seen = np.zeros(1 << BITS, bool)
    while part := list(islice(items, BLOCK)):
        h, _ = words_of(*text_bytes(pa.array([r["text"] for r in part], pa.string())))
        seen[(h >> np.uint64(64 - BITS)).astype(np.int64)] = True
    return np.where(seen, np.cumsum(seen) - 1, -1).astype(np.int32)


def fit(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> Latent:
    """Two passes over all passages: document frequencies, then the randomised SVD."""
    only = docs.select(F.col(text).alias("text"))
    numbers = _numbers(_items(benchmark, item_key, item_text).toLocalIterator())
    width = int(numbers.max()) + 1

    def frequencies(batches):
        total = np.zeros(width + 1)
        for _, data, offsets in slices(batches, "text"):
            h, first = words_of(data, offsets)
            _, begin, _ = passages(first)
            f, p = features_of(h, begin, numbers)
            if len(f):
                order, _ = _by_feature(f, p)
                f, p = f[order], p[order]
                total[:-1] += np.bincount(f[np.append(True, (np.diff(f) > 0) | (np.diff(p) > 0))], minlength=width)
            total[-1] += len(begin)
        return total

    df = _summed(only, frequencies, width + 1)
    idf = np.log((1 + df[-1]) / (1 + df[:-1])).astype(np.float32) + np.float32(0.01)
    columns = min(RANK + MORE, width)
    test = np.random.default_rng(SEED).standard_normal((width, columns)).astype(np.float32)

    def range_finder(batches):
        total = np.zeros((width, columns), np.float32)
        weighted = test * idf[:, None]
        for _, data, offsets in slices(batches, "text"):
            h, first = words_of(data, offsets)
            _, begin, _ = passages(first)
            f, p = features_of(h, begin, numbers)
            if len(f):
                order, cut = _by_feature(f, p)
                # turned, so that what is added up lies together
                rows = np.ascontiguousarray(_by_passage(weighted, f, p, len(begin)).T)
                total[f[order[cut]]] += np.add.reduceat(np.take(rows, p[order], axis=1), cut, axis=1).T
        return total * idf[:, None]

    g = _summed(only, range_finder, width * columns).reshape(width, columns)
    basis, _ = np.linalg.qr(g)
    small = basis.T @ g @ np.linalg.pinv(basis.T @ test)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-values)[:RANK]
    return Latent(numbers, idf, (basis @ turn[:, order]).astype(np.float32), np.sqrt(np.maximum(values[order], 0)))


def lcs(a: list, b: list) -> int:
    """Longest common subsequence by bit vectors: one step for each element of ``b``."""
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        if m := where.get(x):
            u = row & m
            row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def holds(item: list, region: list) -> tuple[bool, float]:
    """(whether the region holds the item, share of the item that it covers)."""
    cover = lcs(item, region) / len(item)
    if cover < COVER:
        return False, cover
    answer = item[-ANSWER:]
    return cover >= NEARLY or lcs(answer, region) >= max(1, len(answer) - 1), cover


def _items(benchmark: DataFrame, key: str, text: str) -> DataFrame:
    return benchmark.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))


def matches(docs: DataFrame, benchmark: DataFrame, model: Latent | None = None, keep: list[str] | None = None, text: str = "text", item_key: str = "item_id", item_text: str = "text", names: tuple[str, str] = ("items", "cover")) -> DataFrame:
    """(kept columns, items array<long>, cover double): the benchmark items that each document holds; all rows."""
    keep = keep or ["doc_id"]
    model = model or fit(docs, benchmark, text, item_key, item_text)
    items = _items(benchmark, item_key, item_text)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    many = items.count() > BLOCK
    folder = scratch.new_folder(docs.sparkSession, "items") if many else None
    return _search(docs, _blocks(items.toLocalIterator() if many else items.collect(), model, folder), model, keep, text, schema, names)


def _rare(model: Latent) -> np.ndarray:
    return model.idf >= -np.log(RARE)


def _stored(x: dict, uri: str) -> str:
    with scratch.committed(uri) as sink:
        sink.write(pickle.dumps(x))
    return uri


def _loaded(x: dict | str) -> dict:
    if isinstance(x, dict):
        return x
    with scratch.reader(x) as source:
        return pickle.loads(source.read())


def _parts(size: np.ndarray, begin: np.ndarray):
    """(item, first word, words) of the parts that items of ``size`` words from ``begin`` on are searched by."""
    count = np.where(size > LONG, -(-size // PART), 1)
    item, k = np.repeat(np.arange(len(size)), count), runs(count)
    lo, hi = (k * size[item] // count[item], (k + 1) * size[item] // count[item])
    return item, begin[item] + lo, hi - lo


def _blocks(rows, model: Latent, folder: str | None) -> list:
    """Blocks of at most BLOCK parts of items with their latent vectors; with a folder as files of it. The driver holds one block."""
    out, rows = [], iter(rows)
    while part := list(islice(rows, BLOCK)):
        h, first = words_of(*text_bytes(pa.array([r["text"] for r in part], pa.string())))
        some = np.flatnonzero(np.diff(first) > 0)
        if not len(some):
            continue
        size, begin = np.diff(first)[some], first[:-1][some]
        vocabulary, places = np.unique(h, return_inverse=True)
        whole = {"ids": np.array([part[k]["id"] for k in some], np.int64), "flat": h, "vocabulary": vocabulary, "places": places, "begin": begin, "size": size}
        item, lo, words = _parts(size, begin)
        for k in range(0, len(item), BLOCK):
            x = whole | _searched(h, item[k : k + BLOCK], lo[k : k + BLOCK], words[k : k + BLOCK], model)
            out.append(_stored(x, f"{folder}/block-{len(out)}") if folder else x)
    return out


def _searched(h: np.ndarray, item: np.ndarray, lo: np.ndarray, words: np.ndarray, model: Latent) -> dict:
    """What the search needs of parts of items: latent vectors, features, and how many of them a match must have."""
    n, a, b = len(item), int(lo[0]), int(lo[-1] + words[-1])
    f, of = features_of(h[a:b], lo - a, model.numbers)
    vectors = _by_passage(model.basis * model.idf[:, None], f, of, n)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    pairs = np.unique(of * len(model.idf) + f)
    own, of = pairs % len(model.idf), pairs // len(model.idf)
    distinct = np.bincount(of, minlength=n)
    # at most (1 - COVER) of a part's words may be missing; of four passages two neighbours hold half of the rest at least
    need = np.maximum(1, np.floor((distinct - (1 - COVER) * words) / 2)).astype(np.int16)
    rare = np.bincount(of[_rare(model)[own]], minlength=n)
    need_rare = np.maximum(0, np.floor((rare - (1 - COVER) * words) / 2)).astype(np.int16)
    return {"part_of": item, "part_begin": lo, "part_size": words, "vectors": vectors, "own": own, "of": of, "need": need, "need_rare": need_rare, "least": np.where(words > FEW, COSINE, -2).astype(np.float32)}


def _search(docs: DataFrame, blocks: list, model: Latent, keep: list[str], text: str, schema: str, columns: tuple[str, str]) -> DataFrame:
    def run(batches):
        weighted = model.basis * model.idf[:, None]
        for batch, data, offsets in slices(batches, text):
            h, first = words_of(data, offsets)
            row, begin, _ = passages(first)
            held = [([], []) for _ in range(batch.num_rows)]
            f, p = features_of(h, begin, model.numbers) if len(h) and blocks else (np.zeros(0, np.int32), np.zeros(0, np.int64))
            if len(f):
                latent = _by_passage(weighted, f, p, len(begin))
                both = np.flatnonzero(row[1:] == row[:-1])
                latent[both] += latent[both + 1]
                latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
                edge = np.searchsorted(p, np.arange(len(begin) + 1))
                joined = np.zeros(len(begin), bool)
                joined[both] = True
                few = np.flatnonzero(_rare(model)[f])
            for block in blocks if len(f) else ():
                x = _loaded(block)
                n = len(x["part_of"])
                near = latent @ x["vectors"].T >= x["least"]
                has = np.zeros((len(model.idf), n), np.uint8)
                has[x["own"], x["of"]] = 1
                # the bound: rare features of the pair that each part has, then all distinct ones
                common = _by_passage(has, f[few], p[few], len(begin))
                common[both] += common[both + 1]
                near &= common >= x["need_rare"]
                at = np.flatnonzero(near.any(1))
                if not len(at):
                    continue
                known = _known(x, h, model.numbers)
                for a in range(0, len(at), 1024):
                    some = at[a : a + 1024]
                    stop = np.where(joined[some], edge[np.minimum(some + 2, len(begin))], edge[some + 1])
                    long = stop - edge[some]
                    which = np.repeat(np.arange(len(some)), long)
                    pairs = np.unique(which * len(model.idf) + f[np.repeat(edge[some], long) + runs(long)])
                    common = _by_passage(has, pairs % len(model.idf), pairs // len(model.idf), len(some))
                    _check(x, h, known, first, row, begin, held, *_found(some, near[some] & (common >= x["need"])))
            found = [sorted(i) for i, _ in held]
            cover = [max(c, default=0.0) for _, c in held]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(found, pa.list_(pa.int64())), pa.array(cover, pa.float64())], [*keep, *columns])

    wanted = list(dict.fromkeys([*keep, text]))
    return docs.select(*wanted).mapInArrow(run, f"{schema}, {columns[0]} array<long>, {columns[1]} double")


def _found(some: np.ndarray, mask: np.ndarray):
    k, j = np.nonzero(mask)
    return some[k], j


def _known(x: dict, h: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """For each word its place among the block's distinct words, or their number where it is none of them."""
    out = np.full(len(h), len(x["vocabulary"]), np.int32)
    some = np.flatnonzero(numbers[(h >> np.uint64(64 - BITS)).astype(np.int64)] >= 0)
    at = np.minimum(np.searchsorted(x["vocabulary"], h[some]), len(x["vocabulary"]) - 1)
    same = x["vocabulary"][at] == h[some]
    out[some[same]] = at[same]
    return out


def _covers(x: dict, known: np.ndarray, lo: np.ndarray, hi: np.ndarray, items: np.ndarray) -> np.ndarray:
    """``lcs`` of candidates (regions, parts of at most 64 words), all of them at once: one step for each word of the longest region."""
    none = len(x["vocabulary"])
    long = int((hi - lo).max())
    position = lo[:, None] + np.arange(long)
    words = np.where(position < hi[:, None], known[np.minimum(position, len(known) - 1)], none)
    order = np.argsort(items, kind="stable")
    cut = np.flatnonzero(np.append(True, np.diff(items[order]) > 0))
    masks = np.empty((long, len(items)), np.uint64)
    where = np.zeros(none + 1, np.uint64)
    for group in np.split(order, cut[1:]):
        start, size = (int(x[c][items[group[0]]]) for c in ("begin", "size"))
        own = x["places"][start : start + size]
        np.bitwise_or.at(where, own, np.uint64(1) << np.arange(size, dtype=np.uint64))
        masks[:, group] = where[words[group]].T
        where[own] = 0
    full = ~np.uint64(0) >> (64 - x["size"][items]).astype(np.uint64)
    row = full.copy()
    for m in masks:
        u = row & m
        row = (row + u | row - u) & full
    return x["size"][items] - np.bitwise_count(row)


def _check(x: dict, h, known, first, row, begin, held: list, at: np.ndarray, parts: np.ndarray) -> None:
    """Adds the items that hold around candidate passages: first their parts, then they."""
    items = x["part_of"][parts]
    size = x["size"][items]
    lo = np.maximum(first[row[at]], begin[at] - size)
    hi = np.minimum(first[row[at] + 1], begin[at] + 2 * SIZE + size)
    asked = x | {"begin": x["part_begin"], "size": x["part_size"]}
    maybe = np.zeros(len(at), bool)
    order = np.argsort(hi - lo, kind="stable")
    a = 0
    while a < len(order):
        # long regions are taken fewer at a time
        k = order[a : a + 4096]
        k = k[: max(1, (1 << 20) // int((hi - lo)[k[-1]]))]
        maybe[k] = _covers(asked, known, lo[k], hi[k], parts[k]) / x["part_size"][parts[k]] >= COVER
        a += len(k)
    for p, j in np.unique(np.stack([at[maybe], items[maybe]], 1), axis=0).tolist():
        r, item, start, long = int(row[p]), int(x["ids"][j]), int(x["begin"][j]), int(x["size"][j])
        if item in held[r][0]:
            continue
        region = h[max(int(first[r]), int(begin[p]) - long) : min(int(first[r + 1]), int(begin[p]) + 2 * SIZE + long)]
        sure, cover = holds(x["flat"][start : start + long].tolist(), region.tolist())
        if sure:
            held[r][0].append(item)
            held[r][1].append(cover)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents that hold no benchmark item, with their own columns."""
    found = matches(docs, benchmark, keep=docs.columns, text=text, names=("__items", "__cover"))
    return found.filter(F.size("__items") == 0).select(*docs.columns)
