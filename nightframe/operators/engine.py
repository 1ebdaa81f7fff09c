"""The rule engine over recorded ticks: triggers, conditions, cooldowns, the runaway guard and the gates before a write.

All rules of a device are evaluated in one plan: triggers, conditions and temperatures are columns of the ticks, and a tick
becomes a row for each rule whose trigger comes. What follows depends on what rules did before (when one last fired, its
actions of the last hour, what was last sent to each side) and is a fold over a device's rows by time and place of the
rule, run by segments and repaired (``folds``). Ticks with each trigger, and the evaluations, are written to the shared folder, as triggers
and folds join them with what is made of them: left in one plan, the ticks would be made again more than a hundred times. The last ones are
not removed.

Rules are dictionaries: ``id``, ``trigger`` (``tick``, ``signalChange`` or ``timeOfDay``), ``conditions``, ``actions``
(``setTemperature``, ``setPower``, ``notify``), ``side`` (none: both), ``cooldownMin``, ``dryRun``. Ticks hold the signals
as columns, and for each side whether a manual override holds, a run-once session is on and the stall guard blocks
(``held_left``, ``busy_left``, ``stalled_left`` and so on; a missing column or a null is false).
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import units as u
from ..sources import shared
from . import folds, patterns, rules as r, segments as g

# fixed values of the engine
OVERRIDE, GRACE_MIN = 30 * 60, 10
MOST_ACTIONS, HOUR, SAME = 12, 3600, 0.5
BAND, DEVICE = (60, 100), (55, 110)
SIDES = ("left", "right")
GATES = ("held", "busy", "stalled")


def triggered(ticks: DataFrame, trigger: dict, keys: list[str], name: str, t: str = "t", tz: str = "UTC") -> DataFrame:
    """``ticks`` with a column that says whether the trigger comes.

    ``tick`` comes first at the first tick and then at the first one at least ``everyMin`` after the last; ``signalChange``
    where a known value differs from the last known one; ``timeOfDay`` once a local day, at the first tick from the minute on, at most
    ten minutes late.
    """
    if trigger["kind"] == "tick":
        due = g.chained(ticks.select(*keys, t), keys, int(60 * trigger["everyMin"]), t).withColumn(name, F.lit(True))
        return ticks.join(due, [*keys, t], "left").withColumn(name, F.coalesce(name, F.lit(False)))
    if trigger["kind"] == "signalChange":
        v = f"__{name}_v"
        known = g.carried(g.last_known(ticks.withColumn(v, r.named(trigger["signal"])), keys, v, f"{v}_last", t), keys, before=1, t=t)
        before = F.lag(f"{v}_last").over(g.within(keys, t))
        return g.own(known.withColumn(name, F.coalesce(F.col(v) != before, F.lit(False)))).drop(v, f"{v}_last")
    local = F.from_utc_timestamp(F.timestamp_seconds(t), tz)
    late = u.minute_of_day(F.col(t), tz) - u.hhmm(F.lit(trigger["at"]))
    days = (F.dayofweek(local) - 1).isin(*trigger["days"]) if trigger.get("days") else F.lit(True)
    day = F.when(late.between(0, GRACE_MIN) & days, F.to_date(local))
    slots = ticks.select(*keys, t, day.alias("__day")).filter("__day is not null").groupBy(*keys, "__day").agg(F.min(t).alias(t))
    first = slots.drop("__day").withColumn(name, F.lit(True))
    return ticks.join(first, [*keys, t], "left").withColumn(name, F.coalesce(name, F.lit(False)))


def evaluations(ticks: DataFrame, rules: list[dict], keys: list[str], t: str = "t", tz: str = "UTC") -> DataFrame:
    """A row for each tick and each rule whose trigger comes: (keys, t, place, holds, temps, gates)."""
    rows = ticks
    for gate in (f"{x}_{s}" for x in GATES for s in SIDES):
        rows = rows.withColumn(gate, F.coalesce(gate, F.lit(False)) if gate in ticks.columns else F.lit(False))
    rows = shared.written(rows, "ticks")
    for i, rule in enumerate(rules):
        r.nodes(rule["conditions"])
        done, rows = rows, shared.written(triggered(rows, rule["trigger"], keys, f"__on{i}", t, tz), "ticks")
        shared.remove(done)
    reach = max((r.longest([rule["conditions"], rule["actions"]]) for rule in rules), default=0)
    seg = [*keys, "__seg"]
    rows = g.carried(rows, keys, seconds=int(60 * reach), t=t)
    temp = lambda a: r.expression(a["temp"], seg, t) if a.get("temp") else F.lit(None).cast("double")
    each = [F.struct(F.lit(i).alias("place"), F.col(f"__on{i}").alias("on"), r.condition(rule["conditions"], seg, t, tz).alias("holds"), F.array(*map(temp, rule["actions"])).cast("array<double>").alias("temps")) for i, rule in enumerate(rules)]
    gates = F.struct(*(f"{x}_{s}" for x in GATES for s in SIDES)).alias("gates")
    out = g.own(rows.withColumn("__x", F.array(*each))).select(*keys, t, gates, F.explode("__x").alias("x"))
    return out.filter("x.on").select(*keys, t, "x.place", "x.holds", "x.temps", "gates.*")


def overridden(ticks: DataFrame, manual: DataFrame, keys: list[str], t: str = "t") -> DataFrame:
    """``ticks`` with ``held_left`` and ``held_right``: a manual change (keys, t, side) less than half an hour ago."""
    for s in SIDES:
        mine = manual.filter(F.col("side") == s).select(*keys, t, F.lit(1.0).alias(f"held_{s}"))
        ticks = patterns.asof_backward(ticks, mine, keys, t, f"held_{s}", OVERRIDE - 1).withColumn(f"held_{s}", F.col(f"held_{s}").isNotNull())
    return ticks


def clamped(raw: float, band: tuple[float, float]) -> float:
    return reduce(lambda x, b: min(max(x, b[0]), b[1]), (band, DEVICE), raw)


def act(action: dict, raw: float | None, side: str, row: dict, rule: dict, sent: dict) -> tuple[str, float | None, bool]:
    """(what became of one action on one side, its temperature, whether that was clamped); ``sent`` is kept up to date."""
    sets = action["kind"] == "setTemperature"
    if raw is None and (sets or (action["on"] and action.get("temp"))):
        return "temp-unknown", None, False
    temp = None if raw is None else clamped(raw, action.get("clamp", BAND) if sets else BAND)
    told = lambda what: (what, temp, temp != raw)
    if row[f"held_{side}"]:
        return told("manual-override")
    if row[f"busy_{side}"]:
        return told("run-once")
    if sets and sent[side] is not None and abs(temp - sent[side]) < SAME:
        return told("same")
    if rule.get("dryRun"):
        return told("dry")
    if row[f"stalled_{side}"] and (sets or action["on"]):
        return told("pump-stall")
    sent[side] = temp if sets else (temp if temp is not None else sent[side]) if action["on"] else None
    return told("sent")


def decide(rules: list[dict]):
    """The fold's step over rows of ``evaluations``; its state: each rule's last fire, recent actions and whether it is off, and what was sent."""

    def run(state: dict, rows: pd.DataFrame):
        told, end = [], int(rows["t"].max()) if len(rows) else 0
        rows = rows[~rows["place"].isin([i for i, own in enumerate(state["rules"]) if own["off"]])]
        for row in rows.to_dict("records"):
            rule, own, now = rules[row["place"]], state["rules"][row["place"]], int(row["t"])
            if own["off"]:
                continue
            holds, cool = row["holds"], rule.get("cooldownMin")
            out = {"t": now, "rule": rule["id"], "outcome": "skipped", "reason": None, "temp": None, "writes": 0}
            told.append(out)
            if holds is None or pd.isna(holds) or not holds:
                out["reason"] = "condition-unknown" if holds is None or pd.isna(holds) else "condition-false"
                continue
            if cool is not None and own["fired"] is not None and now - own["fired"] < cool * 60:
                out["reason"] = "cooldown"
                continue
            own["acts"] = [x for x in own["acts"] if now - x < HOUR]
            if len(own["acts"]) >= MOST_ACTIONS:
                own |= {"off": True, "fired": None, "acts": []}
                out["outcome"], out["reason"] = "error", "runaway-disabled"
                continue
            results = []
            for action, raw in zip(rule["actions"], row["temps"]):
                if action["kind"] == "notify":
                    results.append(("notified", None, False))
                    continue
                raw = None if raw is None or pd.isna(raw) else float(raw)
                side = action.get("side") or rule.get("side")
                results += [act(action, raw, s, row, rule, state["sent"]) for s in ([side] if side else SIDES)]
            whats = [w for w, _, _ in results]
            out["writes"] = whats.count("sent")
            out["temp"] = next((x for _, x, _ in results if x is not None), None)
            own["acts"] += [now] * out["writes"]
            if {"notified", "sent", "dry", "same"} & set(whats):
                limited = any(c and w in ("sent", "same") for w, _, c in results)
                out["outcome"] = "dry_run" if "dry" in whats else "clamped" if limited else "fired"
                own["fired"] = now
            else:
                out["reason"] = whats[0] if whats else None
        # what no later row can ask for is forgotten, so that a guessed state becomes the true one
        for rule, own in zip(rules, state["rules"]):
            own["acts"] = [x for x in own["acts"] if end - x < HOUR]
            if own["fired"] is not None and end - own["fired"] >= 60 * (rule.get("cooldownMin") or 0):
                own["fired"] = None
        columns = ["t", "rule", "outcome", "reason", "temp", "writes"]
        return state, pd.DataFrame(told, columns=columns).astype({"t": "int64", "temp": "Float64", "writes": "int32"})

    return run


def begin(rules: list[dict]) -> dict:
    return {"rules": [{"fired": None, "acts": [], "off": False} for _ in rules], "sent": dict.fromkeys(SIDES)}


def runs(ticks: DataFrame, rules: list[dict], keys: list[str], t: str = "t", tz: str = "UTC", **cut) -> DataFrame:
    """(keys, t, rule, outcome, reason, temp, writes): the audit of every evaluation of every rule, in the order of ``rules``."""
    rows = shared.written(evaluations(ticks, rules, keys, t, tz), "evaluations").withColumnRenamed(t, "t")
    return folds.fold(rows, keys, decide(rules), begin(rules), "t bigint, rule string, outcome string, reason string, temp double, writes int", order=["place"], **cut)
