"""BPE encoding and decoding with a contiguous rank array (operator 2).

Every distinct short word is a row of two contiguous arrays: its parts (token
ids between the boundaries that are left) and the merge rank of each adjacent
pair. One round finds the least rank of every row, deletes that boundary by
closing the gap, and looks up the two ranks beside it; rows without a mergeable
pair leave. Words of like byte length share a matrix, so a round costs a few
numpy passes. Words over ``SHORT`` bytes use a heap over linked parts, which
gives the same merges without the quadratic scan.

Words are cut from the bytes of a whole slice of documents at once, by runs of
character classes. Each Python worker keeps a bounded table from a word's
64-bit hash to its ids; only words that are not in it are encoded (two words of
one hash would share ids; at 5 million words a worker that has a chance below
one in a million).

Inputs: nulls are empty texts (no tokens); repeated rows give repeated results;
an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .textbytes import SpanHash, runs, slices, text_bytes

#: Longest word, in bytes, that the rank array takes.
SHORT = 48
#: Words of a worker's table; beyond, it starts anew.
TABLE_LIMIT = 1 << 19
NONE = np.int32(0x7FFFFFFF)
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
#: Endings after an apostrophe that are words of their own (fixed values of the public pattern
#: 's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+).
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of every code point."""
    points = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000])
    text = "".join(map(chr, points))
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, text):
            out[points[m.start() : m.end()]] = kind
    return out


def byte_classes(data: np.ndarray) -> np.ndarray:
    """Class of the character that each byte of valid UTF-8 belongs to."""
    table = classes()
    out = table[:256][data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int32)
        b = [padded[lead + k] & 0x3F for k in range(4)]
        width = 2 + (data[lead] >= 0xE0).astype(np.int64) + (data[lead] >= 0xF0)
        point = np.where(width == 2, (b[0] & 0x1F) << 6 | b[1], np.where(width == 3, (b[0] & 0x0F) << 12 | b[1] << 6 | b[2], (b[0] & 0x07) << 18 | b[1] << 12 | b[2] << 6 | b[3]))
        kind = table[np.minimum(point, 0x10FFFF)]
        for k in range(4):
            at = lead[width > k] + k
            inside = at < len(out)
            out[at[inside]] = kind[width > k][inside]
    return out


class WordTable:
    """Open-addressed table from word hash to a span of the id pool."""

    def __init__(self, limit: int):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.bits = (4 * self.limit - 1).bit_length()
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.word = np.full(1 << self.bits, -1, np.int32)
        self.begin = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int32)
        self.pool = np.zeros(1 << 16, np.int32)
        self.used = 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """Word number of each hash, or -1."""
        mask = (1 << self.bits) - 1
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        out = self.word[at]
        todo = np.flatnonzero((out >= 0) & (self.keys[at] != h))
        at = at[todo]
        while len(todo):
            at = (at + 1) & mask
            out[todo] = w = self.word[at]
            go = (w >= 0) & (self.keys[at] != h[todo])
            todo, at = todo[go], at[go]
        return out

    def add(self, h: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Distinct new hashes with their ids, one word after the other."""
        mask = (1 << self.bits) - 1
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(len(ids) + self.used, np.int32)])
        self.pool[self.used : self.used + len(ids)] = ids
        number = np.arange(len(self.begin), len(self.begin) + len(h), dtype=np.int32)
        self.begin = np.concatenate([self.begin, self.used + np.cumsum(counts) - counts])
        self.count = np.concatenate([self.count, counts.astype(np.int32)])
        self.used += len(ids)
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        todo = np.arange(len(h))
        while len(todo):
            free = np.flatnonzero(self.word[at] < 0)
            put = free[np.unique(at[free], return_index=True)[1]]
            self.keys[at[put]], self.word[at[put]] = h[todo[put]], number[todo[put]]
            left = np.ones(len(todo), bool)
            left[put] = False
            todo, at = todo[left], (at[left] + 1) & mask


class ByteBPE:
    """Encoder and decoder of a byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        symbols = byte_symbols()
        value = {s: b for b, s in enumerate(symbols)}
        self.special = {t["content"].encode(): t["id"] for t in spec.get("added_tokens", [])}
        self.first = np.array([vocab[s] for s in symbols], np.int32)
        size = max([*vocab.values(), *self.special.values()]) + 1
        pieces = [b""] * size
        for token, i in vocab.items():
            pieces[i] = bytes(map(value.__getitem__, token))
        for token, i in self.special.items():
            pieces[i] = token
        #: Bytes that each id stands for.
        self.widths = np.array([len(p) for p in pieces], np.int64)
        self.piece_at = np.cumsum(self.widths) - self.widths
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)
        a = np.array([vocab[m[0]] for m in merges], np.int64)
        b = np.array([vocab[m[1]] for m in merges], np.int64)
        self.made = np.array([*(vocab[m[0] + m[1]] for m in merges), 0], np.int32)
        self.pairs = {(int(x), int(y)): r for r, (x, y) in enumerate(zip(a, b))}
        self._index(a << 32 | b)
        self.table = WordTable(TABLE_LIMIT)

    def _index(self, keys: np.ndarray) -> None:
        """Open-addressed pair table, a quarter full, probed by whole arrays."""
        self.mask = (1 << (len(keys) * 4 - 1).bit_length()) - 1
        self.slots = np.full(self.mask + 1, -1, np.int64)
        self.slot_rank = np.full(self.mask + 1, NONE, np.int32)
        todo, at = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = np.flatnonzero(self.slots[at] < 0)
            put = free[np.unique(at[free], return_index=True)[1]]
            self.slots[at[put]], self.slot_rank[at[put]] = keys[todo[put]], todo[put]
            left = np.ones(len(todo), bool)
            left[put] = False
            todo, at = todo[left], (at[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(40)).astype(np.int64) & self.mask

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge rank of each pair; ``NONE`` where there is no merge."""
        keys = a.astype(np.int64) << 32 | b
        at = self._slot(keys)
        found = self.slots[at]
        out = np.where(found == keys, self.slot_rank[at], NONE)
        todo = np.flatnonzero((found != keys) & (found >= 0))
        at = at[todo]
        while len(todo):
            at = (at + 1) & self.mask
            found = self.slots[at]
            hit = found == keys[todo]
            out[todo[hit]] = self.slot_rank[at[hit]]
            go = ~hit & (found >= 0)
            todo, at = todo[go], at[go]
        return out

    def _short(self, raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(parts, number of parts) of words given as rows of bytes with padding."""
        width = raw.shape[1]
        parts = self.first[raw]
        left = sizes.copy()
        if width > 1:
            ranks = self.ranks(parts[:, :-1].ravel(), parts[:, 1:].ravel()).reshape(len(raw), -1)
            column = np.arange(width)
            ranks[column[1:] >= sizes[:, None]] = NONE
            live, p, r = np.arange(len(raw)), parts.copy(), ranks
            while len(live):
                at = r.argmin(1)
                rows = np.arange(len(live))
                best = r[rows, at]
                if (stop := best == NONE).any():
                    parts[live[stop]] = p[stop]
                    keep = ~stop
                    live, p, r, at, best = live[keep], p[keep], r[keep], at[keep], best[keep]
                    rows = rows[: len(live)]
                    if not len(live):
                        break
                # delete the boundary: part at + 1 and rank at leave, the rest closes up
                move = np.minimum(column + (column > at[:, None]), width - 1)
                p = p[rows[:, None], move]
                move = np.minimum(column[:-1] + (column[:-1] >= at[:, None]), width - 2)
                r = r[rows[:, None], move]
                left[live] -= 1
                n = left[live]
                p[rows, at] = self.made[best]
                r[rows, n - 1] = NONE
                # refresh the neighbouring ranks
                k = np.flatnonzero(at > 0)
                r[k, at[k] - 1] = self.ranks(p[k, at[k] - 1], p[k, at[k]])
                k = np.flatnonzero(at < n - 1)
                r[k, at[k]] = self.ranks(p[k, at[k]], p[k, at[k] + 1])
        return parts, left

    def _long(self, word: bytes) -> list[int]:
        """Ids of a long word: least rank first, then leftmost, by a heap."""
        ids = self.first[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.pairs.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = int(self.made[r]), -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (q := self.pairs.get((ids[i], ids[k]))) is not None:
                    heapq.heappush(heap, (q, i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (q := self.pairs.get((ids[h], ids[i]))) is not None:
                heapq.heappush(heap, (q, h, ids[h], ids[i]))
        return [i for i in ids if i >= 0]

    def learn(self, data: np.ndarray, h: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        """Put new distinct words into the table."""
        step = np.minimum((sizes + 3) // 4, SHORT // 4 + 1)
        for k in np.unique(step):
            at = np.flatnonzero(step == k)
            if k > SHORT // 4:
                for i in at:
                    ids = np.array(self._long(data[starts[i] : starts[i] + sizes[i]].tobytes()), np.int32)
                    self.table.add(h[i : i + 1], ids, np.array([len(ids)]))
                continue
            for at in np.array_split(at, len(at) // 50_000 + 1):
                width = int(sizes[at].max())
                column = np.arange(width)
                inside = column < sizes[at, None]
                raw = data[np.where(inside, starts[at, None] + column, 0)]
                parts, left = self._short(raw, sizes[at])
                self.table.add(h[at], parts[column < left[:, None]], left)

    def pretokens(self, data: np.ndarray, offsets: np.ndarray):
        """(starts, ends, special id or -1) of all words of a slice, in order."""
        edges, specials = np.unique(offsets), []
        whole = data.tobytes() if self.special else b""
        for token, number in self.special.items():
            at = whole.find(token)
            while at >= 0:
                end = at + len(token)
                if np.searchsorted(edges, at, "right") == np.searchsorted(edges, end, "left"):
                    specials.append((at, end, number))
                    at = whole.find(token, end)
                else:
                    at = whole.find(token, at + 1)
        if specials:
            edges = np.unique(np.concatenate([edges, [x for s in specials for x in s[:2]]]))
        kind = byte_classes(data)
        n = len(data)
        cut = np.zeros(n + 1, bool)
        cut[1:n] = kind[1:] != kind[:-1]
        cut[edges] = True
        edge = np.zeros(n + 1, bool)
        edge[edges] = True
        begin = np.flatnonzero(cut[:n])
        run_kind = kind[begin]
        stop = np.append(begin[1:], n) if len(begin) else begin
        # the last character of blanks before something else leads it (a blank 0x20) or stands alone
        s = np.flatnonzero((run_kind == SPACE) & ~edge[stop])
        last = stop[s] - 1
        for _ in range(3):
            last = np.where((data[last] & 0xC0) == 0x80, last - 1, last)
        cut[last] = True
        lead = data[last] == 0x20
        cut[stop[s][lead]] = False
        # an apostrophe with an ending behind a letter, a number or the start
        o = np.flatnonzero((run_kind == OTHER) & (stop - begin == 1) & ~edge[stop])
        o = o[(data[begin[o]] == 0x27) & cut[begin[o]]]
        if len(o):
            after = stop[o]
            room = np.append(stop[1:], n)[o] - after
            padded = np.concatenate([data, np.zeros(2, np.uint8)])
            c = padded[after].astype(np.int32), np.where(room > 1, padded[after + 1], 0).astype(np.int32)
            size = np.zeros(len(o), np.int64)
            for e in ENDINGS:
                hit = (c[0] == ord(e[0])) & ((len(e) == 1) | (c[1] == ord(e[-1])))
                size[hit & (size == 0)] = len(e)
            at = size > 0
            cut[after[at]] = False
            cut[after[at] + size[at]] = True
        starts = np.flatnonzero(cut[:n])
        ends = np.append(starts[1:], n) if len(starts) else starts
        marks = np.full(len(starts), -1, np.int64)
        if specials:
            spans_ = np.array(sorted(specials))
            inner = np.searchsorted(spans_[:, 0], starts, "right") - 1
            inside = (inner >= 0) & (starts < spans_[inner, 1])
            head = np.flatnonzero(inside & (starts == spans_[inner, 0]))
            marks[head] = spans_[inner[head], 2]
            ends[head] = spans_[inner[head], 1]
            keep = ~inside
            keep[head] = True
            starts, ends, marks = starts[keep], ends[keep], marks[keep]
        return starts, ends, marks

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, id offsets of each text)."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        starts, ends, marks = self.pretokens(data, offsets)
        h = SpanHash(data).of(starts, ends)
        table = self.table
        word = table.find(h)
        new = np.flatnonzero((word < 0) & (marks < 0))
        if len(new):
            if len(table.begin) + len(new) > table.limit and len(table.begin):
                table.clear()
                new = np.flatnonzero(marks < 0)
            new = new[np.unique(h[new], return_index=True)[1]]
            if len(new) > 2 * table.limit:
                table.limit = len(new)
                table.clear()
            self.learn(data, h[new], starts[new], ends[new] - starts[new])
            word = table.find(h)
        word[marks >= 0] = 0
        count = table.count[word].astype(np.int64) if len(table.count) else np.zeros(len(word), np.int64)
        begin = table.begin[word] if len(table.begin) else np.zeros(len(word), np.int64)
        count[marks >= 0] = 1
        total = np.cumsum(count)
        ids = table.pool[np.repeat(begin - (total - count), count) + np.arange(total[-1])]
        if (at := np.flatnonzero(marks >= 0)).size:
            ids[(total - count)[at]] = marks[at]
        first = np.searchsorted(starts, offsets)
        return ids, np.append(0, total)[first]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The UTF-8 bytes that the ids stand for (special tokens kept)."""
        width = self.widths[ids]
        total = np.cumsum(width)
        if not len(ids):
            return np.zeros(0, np.uint8)
        return self.piece_bytes[np.repeat(self.piece_at[ids] - (total - width), width) + np.arange(total[-1])]


@lru_cache(1)
def coder(path: str) -> ByteBPE:
    """One coder for each worker."""
    return ByteBPE(path)


def encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) of every whole text."""

    def run(batches):
        bpe = coder(path)
        for batch, data, offsets in slices(batches, text):
            ids, at = bpe.encode(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids))], [key, "ids"])

    return df.select(key, text).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, ids array<int>")


def decode(df: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) of id arrays; ids that cut a character give U+FFFD. Null arrays give empty texts."""

    def run(batches):
        bpe = coder(path)
        for batch in batches:
            texts = [bpe.decode(np.array(x or [], np.int64)).tobytes().decode("utf-8", "replace") for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(texts, pa.string())], [key, "text"])

    return df.select(key, ids).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, text string")


def round_trip(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): each whole text encoded, and decoded from those ids.

    One pass: the ids of a slice of documents are hashed, decoded and dropped.
    """

    def run(batches):
        bpe = coder(path)
        for batch, data, offsets in slices(batches, text):
            ids, at = bpe.encode(data, offsets)
            texts = memoryview(bpe.decode(ids))
            size = np.append(0, np.cumsum(bpe.widths[ids]))[at].tolist()
            raw = memoryview(ids.astype("<u4").view(np.uint8))
            rows = at.tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(key),
                    pa.array(np.diff(at)),
                    pa.array([hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(rows, rows[1:])], pa.string()),
                    pa.array([hashlib.sha256(texts[a:b]).hexdigest() for a, b in zip(size, size[1:])], pa.string()),
                ],
                [key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return df.select(key, text).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
