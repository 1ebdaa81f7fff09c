import random

import numpy as np

from nightframe.operators import sessions as ss


def slow(rows, debounce, absence, shortest, longest):
    """Sample by sample, with nothing skipped."""
    state, out = ss.Stay(debounce, absence, shortest, longest), []
    for t, present in rows:
        if got := state.step(t, present):
            out.append(got)
    return out


def noisy(seed, n):
    rnd, t, present, out = random.Random(seed), 0, False, []
    for _ in range(n):
        t += rnd.choice([1, 3, 10, 25, 40] if rnd.random() < 0.98 else [200, 5000])
        if rnd.random() < 0.12:
            present = not present
        out.append((t, present if rnd.random() < 0.9 else not present))
    return out


LIMITS = (30, 120, 60, 900)


def test_skipping_samples_changes_nothing():
    for seed in range(60):
        rows = noisy(seed, 400)
        t, p = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        cut = seed * 7
        state = ss.Stay(*LIMITS)
        got = [*state.feed(t[:cut], p[:cut]), *state.feed(t[cut:], p[cut:])]
        assert got == slow(rows, *LIMITS)


def test_sessions_of_stays_equal_those_of_the_whole_series(spark):
    rows = [(k, t, p) for k in range(4) for t, p in noisy(100 + k, 3000)]
    rows += [(None, 5, True), (9, None, True), (8, 10, None)]
    df = spark.createDataFrame(rows, "k int, t long, present boolean").withColumn("extra", ss.F.lit(1))
    got = sorted((r["k"], r["entered"], r["left_at"], r["exits"], [tuple(x) for x in r["present"]], [tuple(x) for x in r["absent"]]) for r in ss.sessions(df, ["k"], *LIMITS).collect())
    spans = lambda v: [(x["start"], x["end"]) for x in v]
    want = [(k, s["entered"], s["left_at"], s["exits"], spans(s["present"]), spans(s["absent"])) for k in range(4) for s in slow(noisy(100 + k, 3000), *LIMITS)]
    assert got == sorted(want) and len(got) > 40
    assert max(x["stay"] for x in ss.stays(df.dropna(), ["k"], 150).collect()) > 3


def test_short_absences_belong_to_the_session_and_long_ones_end_it(spark):
    inside = lambda t: 0 <= t < 400 or 420 <= t < 800 or 900 <= t < 1300
    df = spark.createDataFrame([("left", t, inside(t)) for t in range(-10, 2000, 2)], "side string, t long, present boolean")
    (one,) = ss.sessions(df, ["side"]).collect()
    assert (one["entered"], one["left_at"], one["duration"], one["exits"]) == (0, 1300, 1300, 2)
    assert [tuple(x) for x in one["absent"]] == [(800, 900)] and [tuple(x) for x in one["present"]] == [(0, 800), (900, 1300)]
    always = df.withColumn("present", ss.F.lit(True))
    assert [(r["entered"], r["duration"]) for r in ss.sessions(always, ["side"], longest=1000).orderBy("entered").collect()] == [(-10, 1000), (992, 1000)]
    assert ss.sessions(df.limit(0), ["side"]).count() == 0


def test_frames_with_odd_values(spark):
    from nightframe.functions import frames as f

    F = ss.F
    df = spark.createDataFrame([([1.0, 3.0, 2.0, 4.0, 5.0, 7.0],), ([1.0] * 8,), ([1.0, 2.0],), ([-1.0, *[1.0] * 7],), (None,), ([],)], "v array<double>")
    rows = df.select(f.zone_triple(F.col("v")).alias("z"), f.compensated(F.col("v")).alias("c")).collect()
    assert [r["z"] for r in rows] == [[2.0, 3.0, 6.0], [1.0] * 3, None, [0.0, 1.0, 1.0], None, None]
    assert [r["c"] and [round(x, 6) for x in r["c"]] for r in rows] == [[2.0, 3.0, 6.0], [1.16] * 3, None, None, None, None]
    assert [list(r) for r in spark.range(1).select(f.centi(F.lit(-327.68)), f.centi(F.lit(20.125)), f.centi_int(F.lit(-32768)), f.slug(F.lit("--Bed Room_1!")), f.slug(F.lit("??")), f.generation(F.lit("x-I05-B0708DE3")), f.generation(F.lit(None).cast("string"))).collect()] == [[None, 2012, None, "bed-room_1", "device", 4, 3]]
    orders = spark.createDataFrame([([1320, 60, 360],), ([600, 480, 1200],), ([],)], "m array<int>").select(f.chronological(F.col("m")).alias("m"))
    assert [r["m"] for r in orders.collect()] == [[1320, 60, 360], [480, 600, 1200], []]
    moved = spark.createDataFrame([(1320,), (120,), (720,)], "m int").select(f.rebased(F.col("m"), (1320, 360), (1380, 420)).alias("x"), f.rebased(F.col("m"), (60, 60), (90, 200)).alias("y"))
    assert [tuple(r) for r in moved.collect()] == [(1380, 1350), (180, 150), (420, 750)]
    times = spark.createDataFrame([(5,), (None,), (1700000000,), (1800000000,)], "t long").select(f.sane_time(F.col("t"), F.lit(1750000000), 60).alias("t"))
    assert [r["t"] for r in times.collect()] == [1750000000, 1750000000, 1700000000, 1750000000]
