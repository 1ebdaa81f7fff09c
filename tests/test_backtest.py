import random

import pytest

from nightframe.operators import backtest as b

LIT = lambda v: {"kind": "literal", "value": v}
SIG = lambda k: {"kind": "signal", "key": k}
MEAN = lambda fn, m: {"kind": "window", "fn": fn, "signal": "left.movement", "lastMin": m}
OVER = lambda x, v: {"kind": "compare", "op": ">", "left": x, "right": LIT(v)}
SET = lambda temp, **k: {"kind": "setTemperature", "temp": temp, **k}
T0 = 1_704_146_400  # 22:00 UTC
SERIES, NIGHTS = "side string, signal string, t long, value double", "side string, night long, start long, end long"


def made(seed):
    """Two signals with gaps, nulls and ties."""
    rng, out = random.Random(seed), []
    for side in ("left", "right"):
        for signal, step in (("left.movement", 70), ("ambient.temperature", 400)):
            t = T0 - 1200
            while t < T0 + 9000:
                t += step + rng.choice([0, 0, 0, 5, 1100])
                out.append((side, signal, t, None if rng.random() < 0.1 else round(rng.uniform(0, 400 if step == 70 else 30) + (0 if step == 70 else 60), 1)))
                if rng.random() < 0.1:
                    out.append((side, signal, t, 77.0))
    return out


def plain(rule, series, start, end, step, base, delta, held):
    """An edge rule step by step: (fires, suppressed, set points)."""
    by = {}
    for _, s, t, v in series:
        if v is not None:
            by.setdefault(s, {})
            by[s][t] = max(v, by[s].get(t, v))

    def at(signal, now):
        known = [t for t in by.get(signal, {}) if t <= now]
        return by[signal][max(known)] if known and now - max(known) <= 900 else None

    fed, fires, late, points, last, was, slot = [], [], [], [], None, None, None
    for i, now in enumerate(range(start, end + 1, step * 60)):
        if (v := at("left.movement", now)) is not None:
            fed.append((now, v))
        left = rule["conditions"]["left"]
        if left["kind"] == "window":
            inside = [v for t, v in fed if t >= now - left["lastMin"] * 60]
            x = (float(len(inside)) if fed else None) if left["fn"] == "count" else None if not inside else {"avg": sum(inside) / len(inside), "max": max(inside), "sum": sum(inside)}[left["fn"]]
        else:
            x = at(left["key"], now)
        tr, on = rule["trigger"], False
        if tr["kind"] == "tick":
            on = True
        elif tr["kind"] == "signalChange":
            v = at(tr["signal"], now)
            if v is not None:
                on, was = was is not None and v != was, v
        elif now % 86400 // 60 == int(tr["at"][:2]) * 60 + int(tr["at"][3:]) and slot != now // 86400 % 7:
            on, slot = True, now // 86400 % 7
        if on and x is not None and x > rule["conditions"]["right"]["value"]:
            if rule["cooldownMin"] and last is not None and now - last < 60 * rule["cooldownMin"]:
                late.append(i)
            else:
                fires.append(i)
                last = now
        points.append(base + delta if any(f <= i < f + held for f in fires) else base)
    return fires, late, points


RULES = {
    "change": ({"trigger": {"kind": "signalChange", "signal": "left.movement"}, "conditions": OVER(MEAN("avg", 10), 180), "cooldownMin": 12, "actions": [SET({"kind": "binary", "op": "-", "left": SIG("left.currentTemperature"), "right": LIT(3)}, durationSec=600)]}, 1, 80, -3, 10),
    "count": ({"trigger": {"kind": "tick", "everyMin": 1}, "conditions": OVER(MEAN("count", 5), 4), "cooldownMin": None, "actions": [SET(LIT(70), clamp=(60, 90))]}, 1, 75, -5, 1),
    "slot": ({"trigger": {"kind": "timeOfDay", "at": "22:30"}, "conditions": OVER(SIG("ambient.temperature"), 0), "cooldownMin": 60, "actions": [SET({"kind": "binary", "op": "+", "left": LIT(4), "right": SIG("left.targetTemperature")}, durationSec=1800)]}, 2, 80, 4, 15),
    "max": ({"trigger": {"kind": "tick", "everyMin": 1}, "conditions": OVER(MEAN("max", 3), 390), "cooldownMin": 45, "actions": [SET(SIG("ambient.temperature"), durationSec=300)]}, 5, 80, 0, 1),
}


@pytest.mark.parametrize("name", sorted(RULES))
def test_edge_rules_equal_one_loop(spark, name):
    rule, step, base, delta, held = RULES[name]
    series = made(len(name))
    nights = [("left", 1, T0, T0 + 7200), ("left", 2, T0 + 3600, T0 + 9000), ("right", 3, T0 + 60, T0 + 5000), ("right", 4, T0, T0 - 1), ("none", 5, T0, T0 + 600)]
    got = b.steps(spark.createDataFrame(nights, NIGHTS), spark.createDataFrame(series, SERIES), rule, ["side", "night"], step).collect()
    fired = 0
    for side, night, start, end in nights:
        mine = sorted((r for r in got if r["night"] == night), key=lambda r: r["i"])
        fires, late, points = plain(rule, [s for s in series if s[0] == side], start, end, step, base, delta, held)
        assert [r["i"] for r in mine] == list(range(len(points)))
        assert [r["i"] for r in mine if r["outcome"] == "fired"] == fires and [r["i"] for r in mine if r["outcome"] == "suppressed"] == late
        assert [r["setpoint"] for r in mine] == points and all(r["setpoint_raw"] is None for r in mine)
        fired += len(fires)
    assert fired


def test_a_policy_follows_its_signal_inside_its_hours(spark):
    rule = {"trigger": {"kind": "tick", "everyMin": 1}, "conditions": {"kind": "timeBetween", "start": "23:00", "end": "01:00"}, "cooldownMin": None, "actions": [SET({"kind": "binary", "op": "+", "left": SIG("ambient.temperature"), "right": LIT(3)}, clamp=(64, 75))]}
    series = [("left", "ambient.temperature", T0 + 3600 + 60 * k, 60.04 + k) for k in range(0, 20)] + [("left", "ambient.temperature", T0, None)]
    nights = spark.createDataFrame([("left", 1, T0, T0 + 6 * 3600)], NIGHTS)
    tested = b.steps(nights, spark.createDataFrame(series, SERIES), rule, ["side", "night"])
    rows = {r["i"]: r for r in tested.collect()}
    assert rows[59]["setpoint"] is None and (rows[60]["setpoint"], rows[60]["setpoint_raw"]) == (64.0, 63.0) and rows[65]["setpoint"] == 68.0 and rows[79]["setpoint"] == 75.0
    assert rows[79 + 15]["setpoint"] == 75.0 and rows[79 + 16]["setpoint"] is None and {r["outcome"] for r in rows.values()} == {""}
    s = b.summary(tested, rule, ["side", "night"]).collect()[0]
    assert (s["mode"], s["would_fire"], s["label"], s["net_effect"], s["unit"]) == ("policy", 0, "Continuous", None, "°F")
    assert (s["axis_min"], s["axis_max"], s["temp_min"], s["temp_max"], s["set_low"], s["set_high"]) == (0, 100, 62, 83, 63.0, 82.0) and s["clamp_hits"] == 1 + 7 + 15


def test_windows_over_signals_that_are_not_compared_are_unknown(spark):
    rule = {"trigger": {"kind": "tick", "everyMin": 1}, "conditions": {"kind": "and", "conditions": [OVER(SIG("left.movement"), 0), OVER(MEAN("avg", 10), 0)]}, "cooldownMin": None, "actions": [SET(LIT(70))]}
    rows = b.steps(spark.createDataFrame([("left", 1, T0, T0 + 600)], NIGHTS), spark.createDataFrame([("left", "left.movement", T0, 5.0)], SERIES), rule, ["side", "night"]).collect()
    assert len(rows) == 11 and not any(r["outcome"] for r in rows)
