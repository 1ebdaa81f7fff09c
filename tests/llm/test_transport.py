import hashlib
import random
import zlib

import pytest

from nightframe.llm import transport


@pytest.mark.parametrize("n", [64, 128, 162, 192, 3648, 3658, 3712, 3840, 7316, 7360, 64 * 900])
def test_round_trip_of_sizes(n):
    payload = random.Random(n).randbytes(n)
    media = transport.stream(payload)
    got = transport.parse_stream(media)
    assert len(media) % 188 == 0 and got["payload"] == payload and got["continuity_errors"] == 0
    units = -(-n // transport.UNIT)
    assert got["time_stamps"] == [3600 * k for k in range(units)] and got["random_access"] == list(range(0, units, 8))


def test_a_lost_packet_is_counted_and_damage_is_no_stream():
    media = transport.stream(bytes(64 * 400))
    cut = media[: 188 * 10] + media[188 * 11 :]
    assert transport.parse_stream(cut) is None  # the unit is short
    pid = bytearray(media)
    pid[188 * 10 + 3] ^= 0x05  # another counter
    assert transport.parse_stream(bytes(pid))["continuity_errors"] == 2
    table = bytearray(media)
    table[8] ^= 1
    assert transport.parse_stream(bytes(table)) is None
    assert transport.parse_stream(b"") is None and transport.parse_stream(b"x" * 188) is None


def test_columns(spark):
    rows = [(1, "a text"), (2, None), (3, ""), (3, ""), (None, "é" * 5000)]
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, media string")
    got = transport.parse(transport.mux(df), ["doc_id", "n_bytes"], digest=True).collect()
    assert len(got) == len(rows)
    for r in got:
        raw = (dict(rows)[r["doc_id"]] or "").encode()
        padded = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert r["media_bytes"] % 188 == 0 and "continuity errors 0" in r["feature"]
    full = transport.parse(transport.mux(df), ["doc_id"]).collect()
    assert all(r["program"] == 1 and r["time_stamps"][0] == 0 for r in full)
    bad = spark.createDataFrame([(1, b"no stream"), (2, None)], "doc_id long, media binary")
    assert all(r["payload_sha256"] is None for r in transport.parse(bad, ["doc_id"], digest=True).collect())
    assert transport.mux(df.limit(0)).count() == 0


def packets_of(pid, body, start=True, counter=0, flags=None):
    """One packet: stuffed in front, as units are."""
    room = 184 - len(body)
    field = b"" if not room and flags is None else bytes([room - 1]) + (bytes([flags or 0]) + b"\xff" * (room - 2) if room > 1 else b"")
    return b"\x47" + ((0x4000 if start else 0) | pid).to_bytes(2, "big") + bytes([(0x30 if field else 0x10) | counter & 15]) + field + body


def section(table_id, number, body):
    raw = number.to_bytes(2, "big") + b"\xc1\0\0" + body
    raw = bytes([table_id]) + (0xB000 | len(raw) + 4).to_bytes(2, "big") + raw
    return raw + transport.section_crc(raw).to_bytes(4, "big")


def table(pid, raw):
    """A section over as many packets as it needs, filled at the end."""
    raw = b"\0" + raw
    parts = [raw[k : k + 184].ljust(184, b"\xff") for k in range(0, len(raw), 184)]
    return b"".join(b"\x47" + ((0 if k else 0x4000) | pid).to_bytes(2, "big") + bytes([0x10 | k]) + x for k, x in enumerate(parts))


def two_programs():
    number = lambda x: (0xE000 | x).to_bytes(2, "big")
    stream = lambda kind, pid, info=b"": bytes([kind]) + number(pid) + (0xF000 | len(info)).to_bytes(2, "big") + info
    programs = section(0, 1, b"\0\0" + number(16) + b"\0\1" + number(0x100) + b"\0\2" + number(0x200))
    first = section(2, 1, number(0x101) + b"\xf0\0" + stream(0x1B, 0x101, b"i" * 200) + stream(0x0F, 0x102))
    second = section(2, 2, number(0x201) + b"\xf0\0" + stream(6, 0x201))
    return table(0, programs) + table(0x100, first) + table(0x200, second)


VIDEO = b"\0\0\1\xe0\0\0\x80\0\0"


def test_all_streams_of_all_programs_and_units_without_length():
    body = lambda c, n=184: bytes([c]) * n
    media = two_programs() + packets_of(0x101, VIDEO + body(1, 175)) + packets_of(0x101, body(2), False, 1) + packets_of(0x101, body(2), False, 1)
    media += packets_of(0x101, VIDEO + body(3, 100), True, 9, 0x80 | 0x40) + packets_of(0x102, b"\0\0\1\xc0\0\x0d\x80\x80\x05\x21\0\1\0\3" + b"ABCDE") + packets_of(0x201, b"\0\0\1\xbf\0\3xyz")
    got = {(x["program"], x["pid"]): x for x in transport.parse_streams(media)}
    assert list(got) == [(1, 0x101), (1, 0x102), (2, 0x201)]
    video = got[1, 0x101]
    assert video["payload"] == body(1, 175) + body(2) + body(3, 100) and video["unit_bytes"] == [359, 100]
    # a repeated packet and an announced jump of the counter are no errors; no flag, no stamp
    assert (video["continuity_errors"], video["broken"], video["time_stamps"], video["random_access"], video["stream_type"]) == (0, [], [None, None], [1], 0x1B)
    assert got[1, 0x102]["payload"] == b"ABCDE" and got[1, 0x102]["time_stamps"] == [1]
    assert got[2, 0x201]["payload"] == b"xyz" and got[2, 0x201]["broken"] == []
    assert transport.parse_stream(media)["payload"] == video["payload"]


def test_broken_units_are_marked_and_the_others_kept(spark):
    payload = random.Random(5).randbytes(transport.UNIT * 3)
    media = transport.stream(payload)
    cut = media[: 188 * 30] + media[188 * 31 :]  # a packet of the second unit
    found = transport.parse_streams(cut)[0]
    assert (found["continuity_errors"], found["broken"], found["time_stamps"], found["random_access"]) == (1, [1], [0, 3600, 7200], [0])
    assert found["unit_bytes"] == [3658, 3474, 3658] and found["payload"][:3658] + found["payload"][-3658:] == payload[:3658] + payload[-3658:]
    head = media[: 188 * 22] + media[188 * 23 :]  # the start of the second unit: its rest lengthens the first
    assert transport.parse_streams(head)[0]["broken"] == [0] and transport.parse_streams(head)[0]["time_stamps"] == [0, 7200]
    noise = bytearray(media)
    noise[188 * 30] = 0
    assert transport.parse_streams(bytes(noise) + b"rest")[0]["broken"] == [1]
    video = two_programs() + packets_of(0x101, VIDEO + b"a" * 175) + packets_of(0x101, VIDEO + b"b" * 175, True, 3)
    assert transport.parse_streams(video)[0]["broken"] == [0]  # its end may be lost
    df = spark.createDataFrame([(1, bytearray(cut)), (2, bytearray(video)), (3, bytearray(b"none")), (4, None)], "doc_id long, media binary")
    rows = transport.parse(df, ["doc_id"]).collect()
    assert sorted((r["doc_id"], r["pid"] or 0, r["broken"]) for r in rows) == [(1, 256, [1]), (2, 0x101, [0]), (2, 0x102, []), (2, 0x201, []), (3, 0, None), (4, 0, None)]
    lines = [r["feature"] for r in transport.parse(df, ["doc_id"], digest=True).collect() if r["doc_id"] == 1]
    assert lines[0].endswith("continuity errors 1 units 3 last stamp 7200 random access 1 broken 1")
