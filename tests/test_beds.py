import random

import pandas as pd
import pytest

from nightframe.operators import beds
from nightframe.sources import shared
from nightframe.streaming import beds as stream

SCHEMA = "side string, t long, present boolean, channels array<double>"
T0 = 1_777_000_000


def made(seed, n=900):
    rng, out = random.Random(seed), []
    for side in ("left", "right"):
        t, here = T0, False
        for i in range(n):
            t += rng.choice([3, 5, 9])
            here = not here if rng.random() < 0.012 else here
            flap = rng.random() < 0.05
            out.append((side, t, None if rng.random() < 0.02 else here != flap, None if rng.random() < 0.05 else [rng.random() * 4, rng.random() * 3, None if rng.random() < 0.03 else 1.0]))
    return out


def loop(rows):
    run, out = beds.follower(), []
    for side in ("left", "right"):
        mine = sorted(r for r in [(s, t, bool(p), c) for s, t, p, c in rows] if r[0] == side)
        _, told = run(beds.begin(), pd.DataFrame([r[1:] for r in mine], columns=["t", "present", "channels"]))
        out += [(side, *(None if x is pd.NA or x is None else x for x in r)) for r in told.itertuples(index=False)]
    return flat(out)


def flat(rows):
    spans = lambda v: [(s["start"], s["end"]) for s in v] if isinstance(v, list) else v
    return sorted(repr([spans(v) if isinstance(v, list) else None if v is None else v if isinstance(v, str) else int(v) for v in r]) for r in rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_segments_equal_one_loop(spark, seed):
    rows = made(seed)
    got = beds.follow(spark.createDataFrame(rows, SCHEMA), ["side"], width=150, warm=40)
    assert flat(got.collect()) == loop(rows) and got.filter("kind = 'session'").count() > 0


def test_a_stream_stopped_and_resumed_equals_the_batch_form(spark):
    rows = made(3)
    late = max(r[1] for r in rows) - 120
    source, out, state = (shared.folder(spark, x) for x in ("source", "out", "state"))
    by_time = sorted(rows, key=lambda r: r[1])
    rng = random.Random(0)
    for a, b in ((0, 600), (600, 1200), (1200, 1800)):
        part = by_time[a:b]
        part = part + part[:20]  # some twice
        rng.shuffle(part)
        spark.createDataFrame(part, SCHEMA).write.mode("append").parquet(source)
        if a == 600:  # far too late: before the watermark of the first run
            spark.createDataFrame([("left", T0 + 1, True, [9.0, 9.0, 9.0])], SCHEMA).write.mode("append").parquet(source)
        told = stream.run(stream.follow(spark.readStream.schema(SCHEMA).parquet(source), ["side"]), out, state)
    assert flat(told.collect()) == loop([r for r in rows if r[1] <= late])


def one(samples, **scale):
    rows = pd.DataFrame(samples, columns=["t", "present", "channels"])
    return beds.follower(**scale)(beds.begin(), rows)[1]


def test_dropouts_below_the_debounce_do_not_split_a_session():
    samples, t = [(T0, True), (T0 + 31, True)], T0 + 31
    for _ in range(50):
        t += 60
        samples += [(t, False), (t + 1, True)]
    samples += [(t + 3600, False), (t + 3631, False), (t + 3800, False)]
    told = one([(x, p, None) for x, p in samples])
    done = told[told["kind"] == "session"]
    assert len(done) == 1 and done["exits"].tolist() == [1] and done["entered"].tolist() == [T0] and done["left_at"].tolist() == [t + 3600]


def test_movement_is_told_in_sessions_only_and_forgotten_with_them():
    still = [(T0 + 10 * i, True, [float(i % 2), 0.0, 0.0]) for i in range(60)]
    away = [(T0 + 600 + 10 * i, False, [5.0 * (i % 2), 0.0, 0.0]) for i in range(40)]
    told = one(still + away)
    moved = told[told["kind"] == "movement"]
    assert moved["t"].tolist() == [T0 + 60 * (k + 1) for k in range(13)][: len(moved)] and moved["movement"].iloc[0] == 60
    assert moved["t"].max() < T0 + 600 + 180
    assert one(still, scale=beds.INT_SCALE)["movement"].iloc[0] == 3


def test_baseline_comes_off_after_ten_epochs():
    state = beds.begin()
    assert [beds.scored(state, 5.0, 10.0) for _ in range(10)] == [50] * 10
    assert [beds.scored(state, 5.0, 10.0) for _ in range(3)] == [50, 0, 0]
    assert beds.scored(state, 1e9, 10.0) == 0 and beds.scored(state, 1e9, 10.0) == 950


def test_no_samples(spark):
    assert beds.follow(spark.createDataFrame([], SCHEMA), ["side"]).collect() == []


def test_waiting_samples_are_packed_and_count_once(spark):
    rows = made(5)
    late = max(r[1] for r in rows) - 120
    by_time = sorted(rows, key=lambda r: r[1])
    source, out, state = (shared.folder(spark, x) for x in ("source", "out", "state"))
    for a, b in ((0, 900), (900, 1800)):
        again = by_time[a - 300 : a] if a else []  # the watermark has passed some of them, others wait
        spark.createDataFrame(by_time[a:b] + again, SCHEMA).write.mode("append").parquet(source)
        told = stream.run(stream.follow(spark.readStream.schema(SCHEMA).parquet(source), ["side"]), out, state)
    assert flat(told.collect()) == loop([r for r in rows if r[1] <= late])
    before = spark.conf.get(stream.PROVIDER, None)
    spark.conf.set(stream.PROVIDER, stream.ROCKS)
    try:
        followed = stream.follow(spark.readStream.schema(SCHEMA).parquet(source), ["side"])
        query = followed.writeStream.format("noop").option("checkpointLocation", shared.folder(spark, "state")).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(stream.PROVIDER, before) if before else spark.conf.unset(stream.PROVIDER)
    assert max(o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]) < 100
