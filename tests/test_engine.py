import glob
import json
import math
import os
import struct

import duckdb
import pytest

from nightframe.operators import patterns, rules
from nightframe.plans import registry
from nightframe.sources import rawlog

SAMPLE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for f in glob.glob(f"{SAMPLE}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return [norm(x) for x in v] if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_oracle(spark, oracle, name):
    df = registry.QUERIES[name](spark, SAMPLE)
    got = oracle.sql(registry.ORACLES[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(repr([norm(r[names.index(c)]) for c in df.columns]) for r in got.fetchall())
    assert sorted(repr([norm(x) for x in r]) for r in df.collect()) == want


def test_entry_module():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_asof_looks_back_over_segments_and_not_beyond_the_tolerance(spark):
    left = spark.createDataFrame([(1, 100), (2, 205), (3, 1000), (4, 50)], "id int, t long").selectExpr("id", "'a' side", "t")
    right = spark.createDataFrame([("a", 98, 1.0), ("a", 100, 2.0), ("a", 199, 3.0), ("a", 300, None)], "side string, t long, v double")
    got = {r["id"]: r["v"] for r in patterns.asof_backward(left, right, ["side"], "t", "v", 50, segment=100).collect()}
    assert got == {1: 2.0, 2: 3.0, 3: None, 4: None}


def test_interval_semi_keeps_each_row_once(spark):
    rows = spark.createDataFrame([(i, "a", i * 10) for i in range(100)], "id int, side string, t long")
    spans = spark.createDataFrame([("a", 100, 250), ("a", 200, 300), ("a", 900, None), ("b", 0, 999)], "side string, lo long, hi long")
    F = patterns.F
    out = patterns.interval_semi(rows, spans, ["side"], "t", F.col("lo"), F.coalesce("hi", F.lit(patterns.OPEN_END)), segment=60)
    assert sorted(r["t"] for r in out.collect()) == [*range(100, 301, 10), *range(900, 1000, 10)]


def test_rules_are_checked():
    deep = {"kind": "literal", "value": 1}
    for _ in range(20):
        deep = {"kind": "not", "condition": deep}
    with pytest.raises(ValueError):
        rules.nodes(deep)
    with pytest.raises(ValueError):
        rules.condition({"kind": "other"}, ["side"])


def encode(x):
    """A small encoder for the tests."""

    def head(major, n):
        return bytes([major << 5 | n]) if n < 24 else bytes([major << 5 | 24, n]) if n < 256 else bytes([major << 5 | 25]) + n.to_bytes(2, "big") if n < 65536 else bytes([major << 5 | 26]) + n.to_bytes(4, "big")

    if isinstance(x, bool):
        return b"\xf5" if x else b"\xf4"
    if isinstance(x, int):
        return head(0, x) if x >= 0 else head(1, -1 - x)
    if isinstance(x, float):
        return b"\xfb" + struct.pack(">d", x)
    if isinstance(x, bytes):
        return head(2, len(x)) + x
    if isinstance(x, str):
        return head(3, len(x.encode())) + x.encode()
    if isinstance(x, list):
        return head(4, len(x)) + b"".join(map(encode, x))
    if isinstance(x, dict):
        return head(5, len(x)) + b"".join(encode(k) + encode(v) for k, v in x.items())
    return b"\xf6"


def test_raw_logs_survive_damage(spark, tmp_path):
    record = lambda seq, *fs: encode({"seq": seq, "data": b"".join(map(encode, fs))})
    a = record(1, {"type": "frzTemp", "ts": 1.5, "amb": -3}, {"type": "log", "ts": 2})
    b = record(70000, {"type": "piezo-dual", "ts": 3.0, "left1": struct.pack("<3i", 1, -2, 3) + b"x"}, {"no": "type"})
    empty = encode({"seq": 5, "data": b""})
    (tmp_path / "one.RAW").write_bytes(a + b"\x00" * 7 + empty + b + a[:9])
    (tmp_path / "SEQNO.RAW").write_bytes(a)
    rows = sorted(rawlog.read(spark, str(tmp_path)).collect(), key=lambda r: r["seq"])
    assert [(r["seq"], r["type"], r["ts"], r["corrupt_bytes"]) for r in rows] == [(1, "frzTemp", 1.5, 0), (1, "log", 2.0, 0), (70000, "piezo-dual", 3.0, 7)]
    assert json.loads(rows[2]["frame"])["left1"] == [1, -2, 3] and json.loads(rows[0]["frame"])["amb"] == -3


def test_rates_of_made_signals():
    import numpy as np

    from nightframe.operators import signals

    rng = np.random.default_rng(3)
    t = np.arange(500 * 30) / 500
    for bpm in (52, 66, 80, 104):
        f = bpm / 60
        x = np.sin(2 * np.pi * f * t) + 0.5 * np.sin(4 * np.pi * f * t) + 0.3 * np.sin(6 * np.pi * f * t) + rng.normal(0, 0.1, len(t))
        rate, score = signals.heart_rate_of(x[None] * 1e6, 500.0)
        assert abs(rate[0] - bpm) < 2 and score[0] > 0.3
    for breaths in (12, 18):
        x = np.sin(2 * np.pi * 1.2 * t) * (1 + 0.3 * np.sin(2 * np.pi * breaths / 60 * t)) * 1e6
        assert abs(signals.breathing_of(x[None], 500.0)[0] - breaths) < 2
    assert np.isnan(signals.heart_rate_of(np.zeros((1, 15000)), 500.0)[0][0])
