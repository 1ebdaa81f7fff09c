import numpy as np
import pandas as pd
import pytest

from nightframe.operators import folds, trackers

SEEDS = [1, 2]


def running(state, rows):
    """A sum that is never forgotten: no guess but the first is right."""
    told = []
    for v in rows["v"].tolist():
        state += int(v)
        told.append(state)
    return state, pd.DataFrame({"t": rows["t"].to_numpy(), "total": told})


def test_wrong_guesses_are_repaired_until_the_result_is_the_sequential_one(spark):
    rng = np.random.default_rng(0)
    rows = [(k, int(t), int(rng.integers(0, 9))) for k in ("a", "b") for t in np.sort(rng.integers(0, 400_000, 60))] + [("a", None, 5), (None, 7, 5)]
    got = folds.fold(spark.createDataFrame(rows, "k string, t long, v int"), ["k"], running, 0, "t bigint, total bigint", order=["v"], width=9, warm=4).collect()
    want = []
    for k in ("a", "b"):
        total = 0
        for _, t, v in sorted(r for r in rows if r[0] == k and r[1] is not None):
            total += v
            want.append((k, t, total))
    assert sorted((r["k"], r["t"], r["total"]) for r in got) == sorted(want)


def test_empty_series(spark):
    assert folds.fold(spark.createDataFrame([], "k string, t long, v int"), ["k"], running, 0, "t bigint, total bigint").collect() == []


@pytest.mark.parametrize("seed", SEEDS)
def test_tracked_rates_equal_one_loop_over_the_night(spark, seed):
    rng = np.random.default_rng(seed)
    level = np.repeat([62.0, 55, 95, 60], 60)
    rate = np.round(level + rng.normal(0, 4, 240), 2) * rng.choice([1, 2, 0.5, 1.45], 240, p=[0.7, 0.12, 0.1, 0.08])
    rows = pd.DataFrame({"side": "left", "t": np.arange(240) * 60, "rate": np.where(rng.random(240) < 0.1, np.nan, rate)})
    _, want = trackers.track({"recent": [], "misses": 0}, rows)
    df = spark.createDataFrame([(r.side, r.t, None if np.isnan(r.rate) else r.rate) for r in rows.itertuples()], "side string, t long, rate double")
    got = {r["t"]: r["rate"] for r in trackers.heart_rates(df, ["side"], width=30, warm=8).collect()}
    assert got == {t: None if pd.isna(v) else v for t, v in zip(want["t"], want["rate"])}


def test_a_lone_outlier_is_told_and_forgotten_a_new_level_is_learnt():
    run = lambda rates: trackers.track({"recent": [], "misses": 0}, pd.DataFrame({"t": range(len(rates)), "rate": rates}))
    state, out = run([60.0, 61, 62, 200, 60])
    assert out["rate"].tolist() == [60, 61, 62, 200, 60] and state["recent"] == [60, 61, 62, 60]
    assert run([60.0, 60, 122])[1]["rate"].tolist() == [60, 60, 61]
    assert run([80.0, 80, 41])[1]["rate"].tolist() == [80, 80, 82]
    assert run([60.0, 200, 200, 200, 201])[0] == {"recent": [200, 201], "misses": 0}


@pytest.mark.parametrize("seed", SEEDS)
def test_gated_energy_equals_one_loop(spark, seed):
    rng = np.random.default_rng(seed)
    left = rng.gamma(2, 10, 400) * np.where(rng.random(400) < 0.05, 80, 1)
    rows = pd.DataFrame({"k": 1, "t": np.cumsum(rng.integers(1, 4, 400)), "left": np.where(rng.random(400) < 0.03, 0, left), "right": left * rng.uniform(0.3, 1.2, 400)})
    _, want = trackers.gate({"base": None, "n": 0, "until": None}, rows)
    got = trackers.energy_gate(spark.createDataFrame(rows), ["k"], width=50, warm=20).toPandas().sort_values("t")
    assert got["dropped"].tolist() == want["dropped"].tolist() and want["dropped"].any()
    assert got["baseline"].tolist() == want["baseline"].tolist()


def test_a_phase_that_is_never_forgotten_takes_no_pass_for_each_segment(spark, monkeypatch):
    def run(state, rows):
        told = []
        for t in rows["t"].tolist():
            state = (state + 1) % 9
            told += [t] * (state == 0)
        return state, pd.DataFrame({"at": told})

    written, passes = folds.shared.written, []
    monkeypatch.setattr(folds.shared, "written", lambda df, what: passes.append(what) or written(df, what))
    rows = [(k, t) for k in "ab" for t in range(2000)]
    got = folds.fold(spark.createDataFrame(rows, "k string, t long"), ["k"], run, 0, "at bigint", width=100, warm=10).collect()
    assert sorted((r["k"], r["at"]) for r in got) == [(k, t) for k in "ab" for t in range(8, 2000, 9)]
    assert passes.count("states") <= 11


def test_what_is_kept_for_good_takes_no_pass_for_each_segment(spark, monkeypatch):
    def run(state, rows):
        told = []
        for t, v in zip(rows["t"].tolist(), rows["v"].tolist()):
            if state["kept"] is None and v > 50:
                state["kept"] = int(v)
            state["last"] = int(v)
            told.append((t, state["kept"], state["last"]))
        return state, pd.DataFrame(told, columns=["at", "kept", "last"])

    written, passes = folds.shared.written, []
    monkeypatch.setattr(folds.shared, "written", lambda df, what: passes.append(what) or written(df, what))
    rng = np.random.default_rng(3)
    rows = [(k, t, int(rng.integers(0, 99)) if t >= n else 0) for k, n in (("a", 150), ("b", 30), ("c", 5000)) for t in range(2000)]
    got = folds.fold(spark.createDataFrame(rows, "k string, t long, v int"), ["k"], run, {"kept": None, "last": None}, "at bigint, kept int, last int", width=100, warm=10).collect()
    want = [(k, *x) for k in "abc" for x in run({"kept": None, "last": None}, pd.DataFrame([r for r in rows if r[0] == k], columns=["k", "t", "v"]))[1].itertuples(index=False)]
    assert sorted((r["k"], r["at"], -1 if r["kept"] is None else r["kept"], r["last"]) for r in got) == sorted((k, t, -1 if pd.isna(x) else int(x), v) for k, t, x, v in want)
    assert passes.count("states") <= 5
