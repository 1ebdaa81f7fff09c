import json
import random

import pytest
from pyspark.sql import functions as F

from nightframe.operators import engine, guards, segments, store
from nightframe.plans import core, frames, lists, store as stores

T0 = core.NOW


def test_a_pump_trips_while_wanted_and_recovers_wanted_or_not(spark):
    speeds = [0] * 4 + [2000] + [10] * 5 + [1200] * 7 + [900] + [1000] * 8 + [0] * 9
    active = [True] * 20 + [False] * 6 + [False] * 4 + [True] * 5
    frames = spark.createDataFrame([("left", 10 * k, float(s), a) for k, (s, a) in enumerate(zip(speeds, active))] + [("left", 41, None, True)], "side string, t long, rpm double, active boolean")
    events = lambda **x: [(r["t"], r["event"]) for r in guards.stall_guard(frames, ["side"], **x).orderBy("t").collect()]
    assert events() == [(90, "trip"), (250, "recover"), (340, "trip")]
    assert events(recovers=False) == [(90, "trip")]


@pytest.mark.parametrize("width", [40, 1000])
def test_stall_guard_by_segments_equals_one(spark, width):
    rng, rows = random.Random(3), []
    for k in range(400):
        rows.append(("a", k, float(rng.choice([0, 0, 0, 1500])) if k // 40 % 2 else 1500.0, rng.random() < 0.9))
    df = spark.createDataFrame(rows, "side string, t long, rpm double, active boolean")
    whole = sorted(map(tuple, guards.stall_guard(df, ["side"], dwell=3, recovery=4).collect()))
    assert sorted(map(tuple, guards.stall_guard(df, ["side"], dwell=3, recovery=4, width=width, warm=5).collect())) == whole and len(whole) > 4


def test_an_empty_side_goes_off_once_and_the_unknown_never(spark):
    rows = []
    put = lambda n, **x: rows.extend([x] * n)
    base = {"powered": True, "exempt": False, "presence": "empty", "on_at": 0}
    put(5, **base)
    put(1, **base | {"presence": "occupied"})
    put(4, **base)
    put(1, **base | {"presence": None})
    put(7, **base)  # off at the sixth
    put(5, **base | {"on_at": 1300, "exempt": True})
    put(9, **base | {"on_at": 1300, "presence": "unknown"})
    df = spark.createDataFrame([("x", 60 * k, r["powered"], r["exempt"], r["presence"], r["on_at"]) for k, r in enumerate(rows)], "side string, t long, powered boolean, exempt boolean, presence string, on_at long")
    off = lambda **x: [(r["t"], r["reason"]) for r in guards.auto_off(df, ["side"], 5, **x).orderBy("t").collect()]
    assert off() == [(60 * 16, "empty")]
    assert off(max_on_hours=0.2) == [(60 * 13, "max_on")] or off(max_on_hours=0.2)[0] == (780, "max_on")
    assert off(enabled=False) == []


def test_deltas_hold_over_missing_channels(spark):
    rows = [("x", 0, None, 1.0), ("x", 10, 2.0, 1.0), ("x", 20, 9.0, None), ("x", 86405, 3.5, 0.0), ("y", 5, 1.0, 1.0)]
    got = {(r["k"], r["t"]): r["deltas"] for r in guards.deltas(spark.createDataFrame(rows, "k string, t long, a double, b double"), ["k"], ["a", "b"]).collect()}
    assert got == {("x", 0): None, ("x", 10): None, ("x", 20): None, ("x", 86405): [1.5, 1.0], ("y", 5): None}


def test_pumps_silence_movement_and_three_seconds_after(spark):
    moved = spark.createDataFrame([("x", t, 1.16, [1.0, 0.0]) for t in (5, 10, 12, 20, 22, 23)] + [("x", 40, 1.3, [0.1, 0.2]), ("x", 50, 1.3, [0.1, 0.01]), ("x", 60, None, None)], "side string, t long, ref double, deltas array<double>")
    pumps = spark.createDataFrame([("x", 10, 900.0), ("x", 20, 0.0), ("x", 30, 0.0)], "side string, t long, rpm double")
    got = {r["t"]: (r["gated"], round(r["movement"], 6)) for r in guards.pump_gate(moved, pumps, ["side"]).collect()}
    assert got == {5: (False, 1.0), 10: (True, 0.0), 12: (True, 0.0), 20: (True, 0.0), 22: (True, 0.0), 23: (False, 1.0), 40: (True, 0.0), 50: (False, 0.11), 60: (False, 0.0)}


def test_frames_by_running_sums_cross_midnight(spark):
    rows = [("x", 86400 - 300 + 60 * k, k * k % 17) for k in range(12)]
    out = segments.spreads(spark.createDataFrame(rows, "k string, t long, v int"), ["k"], ["v"], 4).orderBy("t").collect()
    for k, r in enumerate(out):
        if k > 8:
            assert r["n"] is None
            continue
        frame = [v for *_, v in rows[k : k + 4]]
        mean = sum(frame) / 4
        assert r["n"] == 4 and r["last"] == rows[k + 3][1] and r["mean_v"] == mean and r["var_v"] == pytest.approx(sum((v - mean) ** 2 for v in frame) / 4)


def test_a_change_after_a_gap_is_a_change_and_a_null_is_none(spark):
    ticks = spark.createDataFrame([("x", 60, 60.0), ("x", 240, 80.0), ("x", 300, None), ("x", 360, 80.0), ("x", 420, 81.0), ("x", 90_000, 82.0)], "side string, t long, v double")
    on = lambda trigger: sorted(r["t"] for r in engine.triggered(ticks, trigger, ["side"], "on").collect() if r["on"])
    assert on({"kind": "signalChange", "signal": "v"}) == [240, 420, 90_000]
    assert on({"kind": "tick", "everyMin": 5}) == [60, 360, 90_000]
    # 00:01 to 00:11 each day, the eleventh minute included
    assert on({"kind": "timeOfDay", "at": "00:01"}) == [60]
    late = spark.createDataFrame([("x", 86400 + 60 * m, 1.0) for m in (12, 40)] + [("x", 2 * 86400 + 60 * 11, 1.0)], "side string, t long, v double")
    assert [r["t"] for r in engine.triggered(late, {"kind": "timeOfDay", "at": "00:01"}, ["side"], "on").filter("on").collect()] == [2 * 86400 + 660]


SESSIONS = "side string, id long, entered long, left_at long"


def picked(spark, rows):
    return {r["side"]: r["id"] for r in core.pick_last_night(None, spark.createDataFrame(rows, SESSIONS)).collect()}


def test_the_longest_of_a_day_beats_a_nap_and_the_newer_of_equals_wins(spark):
    noon = T0 - T0 % 86400 - 86400 + 17 * 3600  # noon in New York
    assert picked(spark, [("x", 1, noon, noon + 9000), ("x", 2, noon + 20_000, noon + 21_900)]) == {"x": 1}
    assert picked(spark, [("x", 1, noon, noon + 5000), ("x", 2, noon + 10_000, noon + 15_000)]) == {"x": 2}
    evening = noon - 3 * 86400 + 10 * 3600
    assert picked(spark, [("x", 1, noon, noon + 9000), ("x", 3, evening, evening + 10_800)]) == {"x": 3}
    old = noon - 3 * 86400
    assert picked(spark, [("x", 1, old, old + 20_000), ("x", 2, old + 30_000, old + 30_100), ("y", 4, T0 - 8 * 86400, T0 - 7 * 86400)]) == {"x": 2}


def test_fires_are_counted_from_local_midnight(spark):
    midnight = T0 - T0 % 86400 + 5 * 3600 - (86400 if T0 % 86400 < 5 * 3600 else 0)
    rules = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    runs = spark.createDataFrame([(1, 1, midnight - 1, "fired"), (2, 1, midnight, "fired"), (3, 1, T0, "skipped"), (4, 1, T0 + 9, "fired")], "id long, automation_id long, fired_at long, outcome string")
    got = {r["id"]: (r["fired"], r["last_outcome"]) for r in core.rule_status(rules, runs).collect()}
    assert got == {1: (1, "skipped"), 2: (0, None)}


def test_missing_readings_are_sent_as_null(spark):
    vitals = spark.createDataFrame([("x", 5, 60.0, None, 12.0), ("x", 9, None, 30.0, None)], "side string, t long, heart_rate double, hrv double, breathing_rate double")
    movement = spark.createDataFrame([("y", 1, 4)], "side string, t long, total_movement int")
    row = lists.sink_mqtt_state(vitals, movement).first()
    assert json.loads(row["payload"]) == {"heart_rate": None, "hrv": 30, "breathing_rate": None, "movement": None, "t": 9}
    assert core.latest_per_key(vitals).first()["heart_rate"] is None


def test_retention_counts_each_table(spark):
    a = spark.createDataFrame([(1,), (T0 - 86400,), (None,)], "t long")
    kept, counts = store.retain_all({"a": a, "b": a.filter(F.lit(False))}, "t", T0, 1)
    assert {tuple(r) for r in counts.collect()} == {("a", 2, 1), ("b", 0, 0)} and kept["a"].count() == 2


def test_ids_beyond_a_million_reach_into_the_seconds_of_a_version(spark):
    """As in the queries' SQL, the latest run is that of the greatest time * 1000000 + id."""
    rules = spark.createDataFrame([(1, "a")], "id long, name string")
    runs = spark.createDataFrame([(5_000_000, 1, T0 - 9, "fired"), (7, 1, T0 - 6, "skipped"), (8, 1, T0 - 90, "fired")], "id long, automation_id long, fired_at long, outcome string")
    assert [tuple(r) for r in core.rule_status(rules, runs).select("last_fired", "last_outcome").collect()] == [(T0 - 6, "fired")]


def test_the_latest_time_need_not_be_the_latest_runs(spark):
    runs = spark.createDataFrame([(5_000_000, 1, T0 - 9, "fired"), (7, 1, T0 - 6, "skipped"), (3, None, T0, None), (2, 2, T0, "fired"), (4, 2, T0, "skipped")], "id long, automation_id long, fired_at long, outcome string")
    assert {tuple(r) for r in stores.upsert(runs).collect()} == {(1, 5_000_000, T0 - 6), (None, 3, T0), (2, 4, T0)}


def test_seven_tenths_of_the_energy_are_not_more_than_seven_tenths(spark):
    rows = [(side, k, 128.0) for k in range(1, 101) for side in ("left", "right")]
    moved = [(side, k, n * k) for k in range(1, 101) for side, n in (("left", 7), ("right", 10))]
    got = frames.cross_channel(spark.createDataFrame(rows, "side string, t long, hrv double"), spark.createDataFrame(moved, "side string, t long, total_movement int"), enter=10**9)
    assert {(r["side"], r["acr"]) for r in got.collect()} == {("left", 0.0), ("right", 0.4)}


@pytest.mark.parametrize("seconds", [7, 90, 400])
def test_folds_over_segments_go_up_and_down_levels(spark, monkeypatch, seconds):
    """Segments of 40 seconds, 3 to a longer one: gaps, several keys, and steps that reach over segments."""
    monkeypatch.setattr(segments, "FAN", 3)
    rng, rows = random.Random(seconds), []
    for key in "abc":
        t = rng.randrange(50)
        for _ in range(300):
            t += rng.choice([1, 2, 9, 30]) if rng.random() < 0.97 else rng.choice([100, 2000])
            rows.append((key, t, rng.choice([100, 100, 300, 500])))
    df = spark.createDataFrame(rows, "k string, t long, v int")
    kept, last = [], {}
    for key, t, _ in rows:
        if t - last.get(key, -(10**9)) >= seconds:
            last[key] = t
            kept.append((key, t))
    assert sorted(map(tuple, segments.chained(df, ["k"], seconds, width=40).collect())) == kept
    step = lambda s, v: F.when(v > 400, 0).when((s >= 0) & (v < 150), F.when(s == 2, -1).otherwise(s + 1)).otherwise(s)
    told, state = [], {}
    for key, t, v in rows:
        s = state.get(key, -1)
        state[key] = 0 if v > 400 else (-1 if s == 2 else s + 1) if s >= 0 and v < 150 else s
        told.append((key, t, state[key]))
    got = segments.automaton(df, ["k"], "v", [-1, 0, 1, 2], step, -1, "s", width=40)
    assert sorted(map(tuple, got.collect())) == told
    assert segments.chained(df.filter("v is null"), ["k"], seconds).count() == 0


def test_the_last_before_and_the_pumps_state_reach_over_segments(spark):
    day = 86400
    rows = spark.createDataFrame([("x", 5, 1.0), ("x", 6, None), ("x", 3 * day, None), ("x", 3 * day + 1, 4.0), ("y", 3 * day, 2.0), ("x", 9 * day, 7.0)], "k string, t long, v double")
    before = guards.last_before(rows, ["k"], "v", "was")
    assert {(r["k"], r["t"]): r["was"] for r in before.collect()} == {("x", 5): None, ("x", 6): 1.0, ("x", 3 * day): 1.0, ("x", 3 * day + 1): 1.0, ("y", 3 * day): None, ("x", 9 * day): 4.0}
    moved = spark.createDataFrame([("x", t, 1.16, [1.0]) for t in (day - 1, day, day + 1, day + 2, 2 * day, 2 * day + 1, 4 * day)], "side string, t long, ref double, deltas array<double>")
    pumps = spark.createDataFrame([("x", day - 50, 900.0), ("x", day - 1, 0.0), ("x", 2 * day - 9, 5.0), ("x", 2 * day, None), ("y", day, 1.0)], "side string, t long, rpm double")
    out = guards.pump_gate(moved, pumps, ["side"])
    assert {r["t"]: r["gated"] for r in out.collect()} == {day - 1: True, day: True, day + 1: True, day + 2: False, 2 * day: True, 2 * day + 1: True, 4 * day: False}
    assert out.columns == ["side", "t", "ref", "deltas", "gated", "movement"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Generate" not in plan
