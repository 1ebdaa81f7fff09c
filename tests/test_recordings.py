import numpy as np
import pytest

from nightframe.operators import recordings as r

SCHEMA = "k string, i long, x double"


def beats(rate, seconds, seed):
    """A pulse train with a wandering interval and some noise."""
    rng, x, t = np.random.default_rng(seed), np.zeros(int(rate * seconds)), 0.0
    while t < seconds - 1:
        a = int(t * rate)
        x[a : a + int(0.12 * rate)] += np.hanning(int(0.12 * rate))[: len(x[a : a + int(0.12 * rate)])]
        t += 0.85 + 0.12 * np.sin(t / 20) + rng.normal(0, 0.01)
    return x + rng.normal(0, 0.05, len(x))


def plain(x, rate, span, every, size, hop):
    """The index of each end by loops over windows and intervals."""
    kernel, ms = r.beat_interval(rate), {}
    for w in range((len(x) - size * rate) // (hop * rate) + 1):
        part = x[w * hop * rate : w * hop * rate + size * rate]
        if not np.isnan(part).any() and not np.isnan(v := kernel(part[None])[0]):
            ms[w] = float(v)
    out = {}
    for end in range(span, len(x) // rate + 60, every):
        mine = [(w, v) for w, v in sorted(ms.items()) if end - span <= w * hop and w * hop + size <= end]
        if not mine:
            continue
        kept = []
        for w, v in mine if len(mine) >= 10 else []:
            past = [b for _, b in kept]
            if len(past) >= 3:
                past = sorted(past[-5:])
                past = past[1:-1] if len(past) >= 4 else past
            mid = sum(past) / len(past) if past else None
            for m in (1.0, 2.0, 0.5, 3.0, 1 / 3):
                if mid is None or abs(v - mid * m) / (mid * m) < 0.18:
                    kept.append((w, v if m == 1.0 or mid is None else mid))
                    break
        good = []
        for n, (w, v) in enumerate(kept):
            near = [b for _, b in kept[max(0, n - 3) : n + 4]]
            mid = np.median(near)
            if abs(v - mid) <= 3 * 1.4826 * max(np.median([abs(b - mid) for b in near]), 1e-6):
                good.append((w, v))
        steps = [(b[1] - a[1]) ** 2 for a, b in zip(good, good[1:]) if b[0] - a[0] < 3]
        value = float(np.sqrt(np.mean(steps))) if len(kept) >= 10 and len(good) >= 10 and len(steps) >= 5 else None
        out[end] = (len(mine), value if value is not None and 5 <= value <= 100 else None)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_variability_equals_a_plain_loop(spark, seed, monkeypatch):
    monkeypatch.setattr(r, "STRETCH", 4000)
    rate = 50
    x = beats(rate, 620, seed)
    x[200 * rate : 203 * rate] = np.nan
    x[9001] = np.nan
    rows = [("a", i, None if np.isnan(v) else float(v)) for i, v in enumerate(x)] + [("b", 5, 1.0), ("a", None, 1.0), ("a", 7, -9.0)]
    got = {(o["k"], o["at"]): (o["intervals"], o["hrv"]) for o in r.hrv(spark.createDataFrame(rows, SCHEMA), ["k"], rate).collect()}
    want = plain(x, rate, 300, 60, 10, 5)
    assert set(got) == {("a", t) for t in want}
    for t, (n, v) in want.items():
        assert got["a", t][0] == n and (got["a", t][1] == pytest.approx(v) if v is not None else got["a", t][1] is None)
    assert any(v is not None for _, v in want.values())


def test_windows_are_whole_and_each_comes_once_over_the_stretches(spark, monkeypatch):
    monkeypatch.setattr(r, "STRETCH", 30)
    rows = [(k, i, float(i)) for k in "ab" for i in range(200) if (k, i) != ("b", 101)] + [("a", 3, -1.0), ("a", -5, 1.0)]
    got = r.windows(spark.createDataFrame(rows, SCHEMA), ["k"], 20, 10, {"total": lambda m: m.sum(axis=1), "last": lambda m: m[:, -1]}).collect()
    want = {(k, w): sum(range(10 * w, 10 * w + 20)) for k in "ab" for w in range(19) if k == "a" or not 10 * w <= 101 < 10 * w + 20}
    assert {(o["k"], o["w"]): o["total"] for o in got} == want and len(got) == len(want)
    assert all(o["last"] == 10 * o["w"] + 19 for o in got)


def test_periodic_signals_score_high_and_silence_zero():
    t = np.arange(500 * 12) / 500
    rng = np.random.default_rng(0)
    x = np.stack([np.sin(2 * np.pi * 1.1 * t) + 0.3 * np.sin(2 * np.pi * 2.2 * t), rng.normal(0, 1, len(t)), np.zeros(len(t))])
    score = r.acr_quality(500)(x)
    assert score[0] > 0.7 and score[1] < 0.45 and score[2] == 0
    assert r.window_std(500)(x)[2] == 0 and r.window_std(500)(100 * x)[0] > 50
    assert 880 < r.beat_interval(500)(x)[0] < 940 and np.isnan(r.beat_interval(500)(x)[2])


def test_harmonics_are_replaced_by_the_usual_interval():
    assert r.believed([800.0, 810.0, 1610.0, 405.0, 1000.0]) == [800.0, 810.0, 805.0, pytest.approx((800 + 810 + 805) / 3), None]


def test_windows_may_lie_apart(spark, monkeypatch):
    monkeypatch.setattr(r, "STRETCH", 30)
    rows = [("a", i, float(i)) for i in range(200) if i != 65]
    got = {o["w"]: o["total"] for o in r.windows(spark.createDataFrame(rows, SCHEMA), ["k"], 10, 20, {"total": lambda m: m.sum(axis=1)}).collect()}
    assert got == {w: sum(range(20 * w, 20 * w + 10)) for w in range(10) if w != 3}
