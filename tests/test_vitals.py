import numpy as np
import pandas as pd
import pytest

from nightframe.operators import recordings as r, vitals

FIELDS = ["at", "std", "acr", "rate", "score", "breathing", "hrv", "pump"]


def told(rows, enter=100.0, leave=40.0):
    begin = {"here": False, "low": 0, "recent": [], "misses": 0}
    _, out = vitals.follower(enter, leave)(begin, pd.DataFrame(rows, columns=FIELDS))
    return [tuple(None if pd.isna(x) else x for x in t) for t in out.itertuples(index=False)]


def test_presence_begins_loud_or_periodic_and_ends_after_three_quiet_minutes():
    loud, dull, quiet = (150.0, 0.1), (60.0, 0.1), (10.0, 0.1)
    row = lambda k, of, pump=False: (60 * k, *of, 60.0, 0.5, 15.0, 30.0, pump)
    at = lambda *of: [t for t, *_ in told([row(k, x) for k, x in enumerate(of)])]
    assert at(dull, quiet, loud, dull, quiet, quiet, dull, quiet, quiet, quiet, dull) == [120, 180, 240, 300, 360, 420, 480]
    assert at((10.0, 0.5), quiet, quiet, quiet) == [0, 60, 120]
    # the own pump's noise lets nobody in, but doesn't turn anybody out
    assert [t for t, *_ in told([row(0, loud, True), row(1, (401.0, 0.61), True), row(2, loud, True)])] == [60, 120]


def test_numbers_quality_and_flags():
    rows = [(0, 150.0, 0.8, 60.0, 1.4, 15.0, None, False), (60, 60.0, -0.2, None, 0.9, None, 33.0, False), (120, 60.0, 0.4, None, None, None, None, False), (180, 150.0, None, 122.0, 0.2, 14.0, 20.0, None)]
    assert told(rows) == [
        (0, 60.0, None, 15.0, 0.89, "no_hrv"),
        (60, None, 33.0, None, 0.0, "no_hr,no_br,low_signal"),
        (180, 61.0, 20.0, 14.0, 0.09, ""),
    ]


def test_segments_equal_one_loop(spark):
    rng = np.random.default_rng(2)
    n = 300
    rows = pd.DataFrame({"k": "x", "at": 60 * np.arange(n), "std": rng.choice([20.0, 60, 150], n, p=[0.6, 0.2, 0.2]), "acr": rng.uniform(0, 0.6, n), "rate": np.where(rng.random(n) < 0.2, np.nan, rng.choice([60.0, 62, 120, 95], n)), "score": rng.random(n), "breathing": 15.0, "hrv": 30.0, "pump": rng.random(n) < 0.2})
    df = spark.createDataFrame([tuple(None if x != x else x for x in t) for t in rows.itertuples(index=False)], "k string, at long, std double, acr double, rate double, score double, breathing double, hrv double, pump boolean")
    want = told(rows[FIELDS])
    got = sorted((o["at"], o["heart_rate"], o["hrv"], o["breathing_rate"], o["quality"], o["flags"]) for o in vitals.emitted(df, ["k"], 100.0, 40.0, width=25, warm=8).collect())
    assert got == want and 20 < len(want) < n


def test_a_made_heart_is_found_each_minute(spark):
    rate, seconds = 50, 400
    t = np.arange(rate * seconds) / rate
    x = (np.sin(2 * np.pi * 1.2 * t) + 0.5 * np.sin(2 * np.pi * 2.4 * t)) * (1 + 0.3 * np.sin(2 * np.pi * 0.25 * t)) * 1000
    x[130 * rate] = np.nan
    df = spark.createDataFrame([("left", i, None if v != v else float(v)) for i, v in enumerate(x)], "side string, i long, x double")
    rows = {o["at"]: o for o in vitals.minutes(df, ["side"], rate).collect()}
    assert sorted(rows) == [60, 120, 180, 240, 300, 360]
    assert all(abs(o["rate"] - 72) < 2 and o["score"] > 0.5 and o["std"] > 300 for o in rows.values())
    assert rows[180]["breathing"] is None and abs(rows[60]["breathing"] - 15) < 2
    assert rows[240]["hrv"] is None


def test_the_other_sleepers_rhythm_is_not_ones_own(spark):
    rows = [("left", 60, 0.5, 100.0), ("right", 60, 0.5, 120.0), ("left", 120, 0.5, 100.0), ("right", 120, 0.2, 120.0), ("left", 180, 0.5, 900.0), ("right", 180, 0.9, 800.0), ("left", 240, 0.4, 1.0)]
    df = spark.createDataFrame(rows, "side string, at long, acr double, std double")
    got = {(o["side"], o["at"]): o["acr"] for o in vitals.uncoupled(df, [], "side", 500.0).collect()}
    assert got == {("left", 60): 0.0, ("right", 60): 0.0, ("left", 120): 0.5, ("right", 120): 0.0, ("left", 180): 0.5, ("right", 180): 0.9, ("left", 240): 0.4}


def test_kernels_of_several_names(spark):
    out = r.windows(spark.createDataFrame([("a", i, float(i)) for i in range(20)], "k string, i long, x double"), ["k"], 5, 5, {("lo", "hi"): lambda m: np.stack([m.min(axis=1), m.max(axis=1)], axis=1), "n": lambda m: m[:, 0] * 0 + 5}).collect()
    assert sorted((o["w"], o["lo"], o["hi"], o["n"]) for o in out) == [(k, 5.0 * k, 5.0 * k + 4, 5.0) for k in range(4)]
    assert pytest.approx(out[0]["n"]) == 5
