import random

import pytest

from nightframe.operators import engine

LIT = lambda v: {"kind": "literal", "value": v}
SIG = lambda k: {"kind": "signal", "key": k}
ABOVE = lambda k, v: {"kind": "compare", "op": ">", "left": SIG(k), "right": LIT(v)}
ALWAYS = {"kind": "and", "conditions": []}
SET = lambda temp, **x: {"kind": "setTemperature", "temp": temp, **x}
TICK = {"kind": "tick", "everyMin": 1}
COLUMNS = "device string, t long, a double, b double, held_left boolean, busy_left boolean, stalled_right boolean"


def plain(ticks, rules):
    """The engine as one loop over one device's ticks."""
    rt = [{"tick": None, "value": None, "day": None, "fired": None, "acts": [], "off": False} for _ in rules]
    sent, audit = {"left": None, "right": None}, []
    value = lambda e, row: e["value"] if e["kind"] == "literal" else row[e["key"]]

    def temp_of(e, row):
        if e["kind"] != "binary":
            return value(e, row)
        x, y = value(e["left"], row), value(e["right"], row)
        return None if x is None or y is None else x + y

    def holds(c, row):
        if c["kind"] == "and":
            parts = [holds(x, row) for x in c["conditions"]]
            return False if False in parts else None if None in parts else True
        x = value(c["left"], row)
        return None if x is None else x > c["right"]["value"]

    for row in ticks:
        now = row["t"]
        for rule, s in zip(rules, rt):
            if s["off"]:
                continue
            tr, on = rule["trigger"], False
            if tr["kind"] == "tick":
                if on := s["tick"] is None or now - s["tick"] >= tr["everyMin"] * 60:
                    s["tick"] = now
            elif tr["kind"] == "signalChange":
                v = row[tr["signal"]]
                if v is not None:
                    on, s["value"] = s["value"] is not None and v != s["value"], v
            else:
                late = now % 86400 // 60 - (int(tr["at"][:2]) * 60 + int(tr["at"][3:]))
                if 0 <= late <= 10 and s["day"] != now // 86400:
                    on, s["day"] = True, now // 86400
            if not on:
                continue
            h = holds(rule["conditions"], row)
            if h is not True:
                audit.append((now, rule["id"], "skipped", "condition-unknown" if h is None else "condition-false", 0))
                continue
            if rule.get("cooldownMin") is not None and s["fired"] is not None and now - s["fired"] < 60 * rule["cooldownMin"]:
                audit.append((now, rule["id"], "skipped", "cooldown", 0))
                continue
            s["acts"] = [x for x in s["acts"] if now - x < 3600]
            if len(s["acts"]) >= 12:
                s["off"] = True
                audit.append((now, rule["id"], "error", "runaway-disabled", 0))
                continue
            done = []
            for a in rule["actions"]:
                if a["kind"] == "notify":
                    done.append(("notify", False))
                    continue
                for side in [rule["side"]] if rule.get("side") else ["left", "right"]:
                    raw = temp_of(a["temp"], row) if a.get("temp") else None
                    if raw is None and (a["kind"] == "setTemperature" or (a["on"] and a.get("temp"))):
                        done.append(("temp-unknown", False))
                        continue
                    lo, hi = a.get("clamp", (60, 100))
                    temp = None if raw is None else min(max(min(max(raw, lo), hi), 55), 110)
                    cut = temp != raw
                    if row.get(f"held_{side}"):
                        done.append(("manual-override", cut))
                    elif row.get(f"busy_{side}"):
                        done.append(("run-once", cut))
                    elif a["kind"] == "setTemperature" and sent[side] is not None and abs(temp - sent[side]) < 0.5:
                        done.append(("same", cut))
                    elif rule.get("dryRun"):
                        done.append(("dry", cut))
                    elif row.get(f"stalled_{side}") and (a["kind"] == "setTemperature" or a["on"]):
                        done.append(("pump-stall", cut))
                    else:
                        done.append(("sent", cut))
                        s["acts"].append(now)
                        if a["kind"] == "setTemperature" or (a["on"] and temp is not None):
                            sent[side] = temp
                        elif not a["on"]:
                            sent[side] = None
            kinds = [w for w, _ in done]
            if not {"notify", "sent", "same", "dry"} & set(kinds):
                audit.append((now, rule["id"], "skipped", kinds[0] if kinds else None, 0))
                continue
            s["fired"] = now
            outcome = "dry_run" if "dry" in kinds else "clamped" if any(c and w in ("sent", "same") for w, c in done) else "fired"
            audit.append((now, rule["id"], outcome, None, kinds.count("sent")))
    return audit


def compared(spark, ticks, rules, **cut):
    rows = [(r["device"], r["t"], r["a"], r["b"], r.get("held_left"), r.get("busy_left"), r.get("stalled_right")) for r in ticks]
    got = engine.runs(spark.createDataFrame(rows, COLUMNS), rules, ["device"], **cut).collect()
    for device in {r["device"] for r in ticks}:
        want = plain([r for r in ticks if r["device"] == device], rules)
        assert sorted((r["t"], r["rule"], r["outcome"], str(r["reason"]), r["writes"]) for r in got if r["device"] == device) == sorted((t, i, o, str(w), n) for t, i, o, w, n in want)
    return got


def made(seed, n, devices=("x", "y")):
    rng = random.Random(seed)
    out = []
    for d in devices:
        t = 1704067200 + 3600 * 20
        for _ in range(n):
            t += rng.choice([60, 60, 60, 61, 180])
            out.append({"device": d, "t": t, "a": rng.choice([None, 50.0, 66.0, 66.3, 70.0, 120.0]), "b": float(rng.randrange(4)), "held_left": rng.random() < 0.2, "busy_left": rng.random() < 0.1, "stalled_right": rng.random() < 0.2})
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_random_rules_equal_one_loop(spark, seed):
    rng = random.Random(seed)
    rules = []
    for i in range(4):
        trigger = [TICK, {"kind": "tick", "everyMin": 5}, {"kind": "signalChange", "signal": "a"}, {"kind": "timeOfDay", "at": "22:00"}][(i + seed) % 4]
        actions = rng.sample([SET({"kind": "binary", "op": "+", "left": SIG("a"), "right": LIT(1.25)}), SET(SIG("a"), clamp=(62, 68)), {"kind": "notify", "message": "x"}, {"kind": "setPower", "on": True, "temp": SIG("a")}, {"kind": "setPower", "on": False}], 2)
        rules.append({"id": f"r{i}", "trigger": trigger, "conditions": rng.choice([ALWAYS, ABOVE("b", 1), {"kind": "and", "conditions": [ABOVE("a", 60), ABOVE("b", 0)]}]), "actions": actions, "side": rng.choice([None, "left", "right"]), "cooldownMin": rng.choice([None, 0, 15]), "dryRun": rng.random() < 0.2})
    compared(spark, made(seed, 300), rules, width=40, warm=10)


def test_thirteenth_action_within_an_hour_turns_a_rule_off(spark):
    ticks = [{"device": "x", "t": 1704067200 + 60 * i, "a": 60.0 + i % 2 * 5, "b": 1.0} for i in range(90)]
    rules = [{"id": "fast", "trigger": TICK, "conditions": ALWAYS, "actions": [SET(SIG("a"))], "side": "left"}, {"id": "slow", "trigger": {"kind": "tick", "everyMin": 6}, "conditions": ALWAYS, "actions": [SET(LIT(80))], "side": "right"}]
    got = sorted((r["t"], r["outcome"], r["reason"]) for r in compared(spark, ticks, rules) if r["rule"] == "fast")
    assert len(got) == 13 and got[-1][1:] == ("error", "runaway-disabled")


def test_equal_set_points_are_not_sent_again_but_count_as_fires(spark):
    ticks = [{"device": "x", "t": 1704067200 + 60 * i, "a": a, "b": 1.0} for i, a in enumerate([70.0, 70.4, 70.5, 70.1, 99.0, 200.0])]
    got = compared(spark, ticks, [{"id": "r", "trigger": TICK, "conditions": ALWAYS, "actions": [SET(SIG("a"))], "side": "left"}])
    assert [(r["outcome"], r["writes"]) for r in sorted(got, key=lambda r: r["t"])] == [("fired", 1), ("fired", 0), ("fired", 1), ("fired", 0), ("fired", 1), ("clamped", 1)]


def test_a_manual_change_holds_half_an_hour(spark):
    ticks = spark.createDataFrame([("x", 1000 + 300 * i) for i in range(12)], "device string, t long")
    manual = spark.createDataFrame([("x", 1300, "left"), ("x", 2200, "right"), ("y", 1000, "left")], "device string, t long, side string")
    got = {r["t"]: (r["held_left"], r["held_right"]) for r in engine.overridden(ticks, manual, ["device"]).collect()}
    assert [t for t in sorted(got) if got[t][0]] == [1300, 1600, 1900, 2200, 2500, 2800] and [t for t in sorted(got) if got[t][1]] == [2200, 2500, 2800, 3100, 3400, 3700]


def test_no_ticks(spark):
    assert engine.runs(spark.createDataFrame([], COLUMNS), [{"id": "r", "trigger": TICK, "conditions": ALWAYS, "actions": [SET(SIG("a"))]}], ["device"]).collect() == []


def test_a_rule_that_was_turned_off_takes_no_pass_for_each_segment(spark, monkeypatch):
    written, passes = engine.folds.shared.written, []
    monkeypatch.setattr(engine.folds.shared, "written", lambda df, what: passes.append(what) or written(df, what))
    rng = random.Random(4)
    ticks = [{"device": "x", "t": 1704067200 + 60 * i, "a": 60.0 + rng.randrange(40), "b": 60.0 + rng.randrange(40)} for i in range(900)]
    rules = [{"id": "fast", "trigger": TICK, "conditions": ALWAYS, "actions": [SET(SIG("a"))]}, {"id": "slow", "trigger": {"kind": "tick", "everyMin": 10}, "conditions": ALWAYS, "actions": [SET(SIG("b"))], "side": "left"}]
    got = compared(spark, ticks, rules, width=60, warm=30)
    assert [r["outcome"] for r in got if r["rule"] == "fast"].count("error") == 1
    assert passes.count("states") <= 4 and passes.count("evaluations") == 1
