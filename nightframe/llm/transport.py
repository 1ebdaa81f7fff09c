"""Media columns as MPEG transport streams (operator 1).

``mux`` stores a payload losslessly as 8-bit samples in a transport stream of
188-byte packets: a program association and a program map table, then one
elementary stream of packetised units. A unit has 3658 sample bytes (20 packets,
the last unit is stuffed), a time stamp of 3600 ticks of 90 kHz after the one
before, and every eighth unit is a random-access point with a clock reference.

``parse`` takes any such column: it reads the program tables (with their
checksums, over several packets too) and, for each elementary stream of each
program, checks its continuity counters, reassembles the units, and gives their
time stamps and random-access points, a row for each stream. Packets without a
sync byte or with the error flag count as lost. Repeated packets count once,
announced discontinuities are no errors. Units of length 0 end where the next
one starts. A unit that lacks its header or some of its bytes is listed in
``broken``; its samples are those received, ``unit_bytes`` tells where they lie.
Packets before the first unit start belong to no unit.

Nulls and empty texts give one block of 64 zero bytes; equal texts give equal
streams; repeated rows give repeated results; an empty table an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textbytes import slices

PACKET, BLOCK, PER_UNIT, GOP, TICKS = 188, 64, 20, 8, 3600
PMT_PID, STREAM_PID, STREAM_TYPE, STREAM_ID = 0x1000, 0x0100, 0x06, 0xBD
#: Sample bytes of a unit: its first packet has 8 bytes of adaptation and 14 of unit header.
FIRST = PACKET - 4 - 8 - 14
UNIT = FIRST + (PER_UNIT - 1) * (PACKET - 4)


@lru_cache(1)
def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint64) << np.uint64(24)
    for _ in range(8):
        t = np.where(t & np.uint64(0x80000000), t << np.uint64(1) ^ np.uint64(0x04C11DB7), t << np.uint64(1)) & np.uint64(0xFFFFFFFF)
    return t


def section_crc(data: bytes) -> int:
    """CRC-32 of program tables (most significant bit first)."""
    c, table = 0xFFFFFFFF, _crc_table()
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ int(table[c >> 24 ^ b])
    return c


@lru_cache(1)
def _tables() -> bytes:
    """The two table packets."""

    def packet(pid: int, table_id: int, body: bytes) -> bytes:
        head = bytes([table_id]) + (0xB000 | len(body) + 4).to_bytes(2, "big")
        section = head + body
        section += section_crc(section).to_bytes(4, "big")
        return (b"\x47" + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00" + section).ljust(PACKET, b"\xff")

    program = b"\x00\x01\xc1\x00\x00\x00\x01" + (0xE000 | PMT_PID).to_bytes(2, "big")
    streams = b"\x00\x01\xc1\x00\x00" + (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00"
    return packet(0, 0x00, program) + packet(PMT_PID, 0x02, streams)


def _stamps(units: np.ndarray) -> np.ndarray:
    """The five time-stamp bytes of each unit."""
    t = units * TICKS
    return np.stack([0x21 | t >> 29 & 0x0E, t >> 22 & 0xFF, 1 | t >> 14 & 0xFE, t >> 7 & 0xFF, 1 | t << 1 & 0xFE], 1).astype(np.uint8)


def stream(payload: bytes) -> bytes:
    """A payload as a transport stream."""
    n = len(payload)
    full, rest = divmod(n, UNIT)
    packets = 0 if not rest else 1 + max(0, -(-(rest - FIRST) // (PACKET - 4)))
    units = full + (rest > 0)
    out = np.full((2 + full * PER_UNIT + packets, PACKET), 0xFF, np.uint8)
    out[:2] = np.frombuffer(_tables(), np.uint8).reshape(2, PACKET)
    es = out[2:]
    data = np.frombuffer(payload, np.uint8)
    count = np.arange(len(es))
    es[:, 0], es[:, 1], es[:, 2], es[:, 3] = 0x47, STREAM_PID >> 8, STREAM_PID & 0xFF, 0x10 | count & 15
    heads = np.arange(units) * PER_UNIT
    es[heads, 1] |= 0x40
    es[heads, 3] |= 0x20
    unit = np.arange(units)
    es[heads, 4] = 7
    es[heads, 5] = 0
    key = heads[::GOP]
    es[key, 5] = 0x50
    clock = unit[::GOP] * TICKS
    for k, b in enumerate((clock >> 25, clock >> 17, clock >> 9, clock >> 1, clock << 7 & 0x80 | 0x7E, clock & 0)):
        es[key, 6 + k] = b & 0xFF
    size = np.full(units, UNIT)
    if rest:
        size[-1] = rest
    es[heads, 12:15] = (0, 0, 1)
    es[heads, 15] = STREAM_ID
    es[heads, 16], es[heads, 17] = (size + 8) >> 8, (size + 8) & 0xFF
    es[heads, 18:21] = (0x80, 0x80, 5)
    es[heads, 21:26] = _stamps(unit)
    if full:
        body = es[: full * PER_UNIT].reshape(full, PER_UNIT, PACKET)
        samples = data[: full * UNIT].reshape(full, UNIT)
        body[:, 0, 26:] = samples[:, :FIRST]
        body[:, 1:, 4:] = samples[:, FIRST:].reshape(full, PER_UNIT - 1, PACKET - 4)
    if rest:
        tail, samples = es[full * PER_UNIT :], data[full * UNIT :]
        if packets == 1:  # all in one packet: a longer adaptation field pushes the unit to the end
            short = FIRST - rest
            row = tail[0].copy()
            tail[0, 4] = 7 + short
            tail[0, 12 : 12 + short] = 0xFF
            tail[0, 12 + short : 26 + short] = row[12:26]
            tail[0, 26 + short :] = samples
        else:
            tail[0, 26:] = samples[:FIRST]
            middle = samples[FIRST : FIRST + (packets - 2) * (PACKET - 4)]
            tail[1:-1, 4:] = middle.reshape(-1, PACKET - 4)
            last = samples[FIRST + len(middle) :]
            short = PACKET - 4 - len(last)
            if short:
                tail[-1, 3] |= 0x20
                tail[-1, 4] = short - 1
                if short > 1:
                    tail[-1, 5] = 0
                    tail[-1, 6 : 4 + short] = 0xFF
            tail[-1, 4 + short :] = last
    return out.tobytes()


@lru_cache(1024)
def _sound(section: bytes) -> bool:
    return section_crc(section) == 0


def _sections(packets: np.ndarray, table_id: int) -> list[bytes]:
    """The sound current table sections in the packets of one PID, each once."""
    out: dict[bytes, None] = {}
    held, before = None, b""
    for row in packets:
        raw = row.tobytes()
        if not raw[3] & 0x10 or raw == before:
            continue
        if before and raw[3] & 15 != before[3] + 1 & 15:
            held = None
        before = raw
        body = raw[4 + (1 + raw[4] if raw[3] & 0x20 else 0) :]
        parts = [body]
        if raw[1] & 0x40 and body:
            start = 1 + body[0]
            parts = [body[1:start], body[start:]]
        for k, part in enumerate(parts):
            held = part if k else held and held + part
            while held and len(held) >= 3 and held[0] != 0xFF:
                size = 3 + (int.from_bytes(held[1:3], "big") & 0x0FFF)
                if len(held) < size:
                    break
                section, held = held[:size], held[size:]
                if section[0] == table_id and size >= 12 and section[5] & 1 and _sound(section):
                    out[section] = None
            if held is not None and held[:1] in (b"", b"\xff"):
                held = None  # filled up to the next section start
    return list(out)


#: Stream ids whose units have no optional header.
PLAIN = {0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF}


def _same(a: bytes, b: bytes) -> bool:
    """Whether a packet repeats the one before; only its clock reference may be another."""
    if a[3] & 0x20 and a[4] >= 7 and a[5] & 0x10:
        return a[:6] + a[12:] == b[:6] + b[12:]
    return a == b


def _elementary(packets: np.ndarray) -> dict:
    """Counts, stamps, access points and samples of the packets of one PID; ``whole``: no header and no byte is missing."""
    adapted = (packets[:, 3] & 0x20) > 0
    flags = np.where(adapted & (packets[:, 4] > 0), packets[:, 5], 0)
    at = np.flatnonzero(packets[:, 3] & 0x10)
    # a discontinuity may be announced in a packet without payload before
    announced = np.cumsum(flags & 0x80 > 0)[at]
    es = packets[at]
    counter = es[:, 3].astype(np.int16) & 15
    step = np.diff(counter) & 15
    keep = np.ones(len(es), bool)
    bad = np.append(False, (step != 1) & (np.diff(announced) == 0)) if len(es) else keep
    for k in np.flatnonzero(step == 0) + 1:
        if _same(es[k].tobytes(), es[k - 1].tobytes()):
            keep[k] = False
            # a packet may come twice, not more often
            bad[k] = k > 1 and not keep[k - 1]
    errors = int(bad.sum())
    es, bad, flags = es[keep], bad[keep], flags[at][keep]
    begin = np.minimum(4 + np.where(es[:, 3] & 0x20, es[:, 4].astype(np.int32) + 1, 0), PACKET)
    ends = np.append(0, np.cumsum(PACKET - begin))
    data = es[np.arange(PACKET) >= begin[:, None]].tobytes()
    head = np.flatnonzero(es[:, 1] & 0x40)
    stop = np.append(head[1:], len(es)).astype(np.int64)
    stamps, broken, sizes, samples, whole = [], [], [], [], len(head) > 0
    gaps = np.append(0, np.cumsum(bad))
    for k, (a, b) in enumerate(zip(head.tolist(), stop.tolist())):
        unit = data[ends[a] : ends[b]]
        size, stamp, skip = int.from_bytes(unit[4:6], "big"), None, 6
        sound = len(unit) >= 6 and unit[:3] == b"\0\0\1"
        if sound and unit[3] not in PLAIN:
            sound = len(unit) >= 9 and unit[6] & 0xC0 == 0x80 and len(unit) >= 9 + unit[8]
            if sound:
                skip = 9 + unit[8]
                if unit[7] & 0x80 and unit[8] >= 5:
                    stamp = (unit[9] >> 1 & 7) << 30 | unit[10] << 22 | unit[11] >> 1 << 15 | unit[12] << 7 | unit[13] >> 1
        full = sound and (not size or len(unit) == 6 + size)
        # without a length, packets can be missing up to the next start
        lost = gaps[b] > gaps[a + 1] or sound and not size and b < len(es) and bad[b]
        whole = whole and full and (size > 0 or not lost)
        if not full or lost:
            broken.append(k)
        stamps.append(stamp)
        samples.append(unit[skip:] if sound else b"")
        sizes.append(len(samples[-1]))
    return {"continuity_errors": errors, "time_stamps": stamps, "random_access": np.flatnonzero(flags[head] & 0x40).tolist(), "payload": b"".join(samples), "unit_bytes": sizes, "broken": broken, "whole": bool(whole)}


def parse_streams(media: bytes) -> list[dict]:
    """Program, stream, units and samples of each elementary stream; none where the bytes are no transport stream."""
    if not media or len(media) < PACKET:
        return []
    p = np.frombuffer(media, np.uint8, len(media) // PACKET * PACKET).reshape(-1, PACKET)
    total = len(p)
    sound = (p[:, 0] == 0x47) & (p[:, 1] & 0x80 == 0)
    p = p if sound.all() else p[sound]
    pid = (p[:, 1].astype(np.int32) & 0x1F) << 8 | p[:, 2]
    maps: dict[int, int] = {}
    for section in _sections(p[pid == 0], 0x00):
        for i in range(8, len(section) - 7, 4):
            if program := int.from_bytes(section[i : i + 2], "big"):
                maps.setdefault(program, int.from_bytes(section[i + 2 : i + 4], "big") & 0x1FFF)
    streams: dict[tuple[int, int], int] = {}
    for program, map_pid in maps.items():
        for section in _sections(p[pid == map_pid], 0x02):
            if int.from_bytes(section[3:5], "big") != program:
                continue
            at = 12 + (int.from_bytes(section[10:12], "big") & 0x0FFF)
            while at + 5 <= len(section) - 4:
                streams.setdefault((program, int.from_bytes(section[at + 1 : at + 3], "big") & 0x1FFF), section[at])
                at += 5 + (int.from_bytes(section[at + 3 : at + 5], "big") & 0x0FFF)
    return [{"program": program, "stream_type": kind, "pid": k, "packets": total, **_elementary(p[pid == k])} for (program, k), kind in streams.items()]


def parse_stream(media: bytes) -> dict | None:
    """The first elementary stream; None where there is none, or where a packet, a unit's header or some of its bytes are missing."""
    if not media or len(media) % PACKET or (np.frombuffer(media, np.uint8)[::PACKET] != 0x47).any():
        return None
    found = next(iter(parse_streams(media)), None)
    return found if found and found["whole"] else None


def mux(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media): every whole text, padded to a positive multiple of 64 bytes, as a transport stream."""

    def run(batches):
        for batch, data, offsets in slices(batches, text):
            media, rows = [], offsets.tolist()
            whole = memoryview(np.ascontiguousarray(data))
            for a, b in zip(rows, rows[1:]):
                media.append(stream(bytes(whole[a:b]).ljust(max(BLOCK, -(-(b - a) // BLOCK) * BLOCK), b"\0")))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(np.diff(offsets)), pa.array(media, pa.binary())], [key, "n_bytes", "media"])

    return df.select(key, text).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, n_bytes long, media binary")


PARSED = "program int, stream_type int, pid int, packets int, continuity_errors int, time_stamps array<long>, random_access array<int>, payload binary, unit_bytes array<int>, broken array<int>"


def parse(df: DataFrame, keep: list[str], media: str = "media", digest: bool = False) -> DataFrame:
    """The kept columns with what ``parse_streams`` finds, a row for each elementary stream; one of nulls where there is none.

    With ``digest``, sizes and checksums of samples and media instead of the samples, and a ``feature`` line.
    """
    fields = [f"{c} {df.schema[c].dataType.simpleString()}" for c in keep]
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    schema = ", ".join(fields) + (", payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" if digest else f", {PARSED}")
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        for batch, data, offsets in slices(batches, media):
            rows, whole, out, of = offsets.tolist(), memoryview(np.ascontiguousarray(data)), [], []
            for i, (a, b) in enumerate(zip(rows, rows[1:])):
                sha = digest and hashlib.sha256(whole[a:b]).hexdigest()
                for found in parse_streams(bytes(whole[a:b])) or [{}]:
                    of.append(i)
                    if not digest:
                        out.append(found)
                    elif found:
                        p, stamps = found["payload"], [x for x in found["time_stamps"] if x is not None]
                        line = "program {program} stream {stream_type}@{pid} packets {packets} continuity errors {continuity_errors}".format(**found) + f" units {len(found['time_stamps'])} last stamp {stamps[-1] if stamps else 'none'} random access {len(found['random_access'])}"
                        line += f" broken {len(found['broken'])}" if found["broken"] else ""
                        out.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), b - a, sha, line))
                    else:
                        out.append((None, None, None, b - a, sha, None))
            kept = [batch.column(c) if len(of) == batch.num_rows else batch.column(c).take(pa.array(of)) for c in keep]
            if digest:
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(list(c), t) for c, t in zip(zip(*out), types))], [*keep, *names])
            else:
                kinds = {"program": pa.int32(), "stream_type": pa.int32(), "pid": pa.int32(), "packets": pa.int32(), "continuity_errors": pa.int32(), "time_stamps": pa.list_(pa.int64()), "random_access": pa.list_(pa.int32()), "payload": pa.binary(), "unit_bytes": pa.list_(pa.int32()), "broken": pa.list_(pa.int32())}
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array([x.get(n) for x in out], t) for n, t in kinds.items())], [*keep, *kinds])

    return df.select(*keep, media).mapInArrow(run, schema)
