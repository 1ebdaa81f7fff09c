"""Back-test of a rule over recorded nights, on a grid of steps.

Every signal the rule names is sampled at each step: its last value, if not older than fifteen minutes. All signals are
merged with the grid in one sort of (side, time), dealt by day with the tail of the day before; no signal is joined on its
own. Windows then see the samples of the steps, so they are frames of a night's grid. Nights are many and each is small,
so a night's frames are one group; the samples, which are not small, never are.

A rule whose set point follows a live signal, with no comparison to drive it, is a policy: the set point is computed at
each step inside its hours. Any other is an edge rule: at the steps where its trigger comes and its condition holds it
fires, unless its cooldown holds it back, and shifts a nominal set point for its duration.

Trees are those of ``rules``; what they say of themselves (mode, first signal, driving comparison, hours) is read on the
driver. Null values are no samples; of several at one time the largest counts. A night that ends before it starts has no step. Nights of
one side may overlap.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import frames as f, units as u
from . import rules as r, segments as g

# fixed values: staleness of a sample, the default band, the device's limits
STALE, BAND, DEVICE = 15 * 60, (60, 100), (55, 110)
#: Signals that a set point may refer to without following them.
OWN_STATE = ("currentTemperature", "targetTemperature")


def half_up(x: float) -> int:
    return math.floor(x + 0.5)


def walk(tree: dict):
    """All nodes of a tree, parents first, children in reading order."""
    yield tree
    for key in ("conditions", "condition", "left", "right", "value", "min", "max"):
        for kid in (k if isinstance(k := tree.get(key), list) else [k]):
            if isinstance(kid, dict):
                yield from walk(kid)


def named(tree: dict) -> dict | None:
    """The first node that names a signal, itself or as a window."""
    return next((n for n in walk(tree) if n["kind"] in ("signal", "window")), None)


def name_of(node: dict) -> str:
    return node["key"] if node["kind"] == "signal" else node["signal"]


class Reading:
    """What a rule says of itself."""

    def __init__(self, rule: dict):
        r.nodes(rule["conditions"])
        self.rule = rule
        self.action = next((a for a in rule["actions"] if a["kind"] == "setTemperature"), None)
        self.compare = next((n for n in walk(rule["conditions"]) if n["kind"] == "compare" and named(n["left"])), None)
        self.compared = named(self.compare["left"]) if self.compare else None
        self.hours = next((n for n in walk(rule["conditions"]) if n["kind"] == "timeBetween"), None)
        self.band = self.action.get("clamp", BAND) if self.action else BAND
        followed = named(self.action["temp"]) if self.action else None
        live = followed is not None and not name_of(followed).endswith(OWN_STATE)
        self.policy = live and self.compare is None
        self.primary = self.compared or (followed if self.policy else None)
        self.threshold = float(self.compare["right"]["value"]) if self.compare and self.compare["right"]["kind"] == "literal" else None
        self.minutes = half_up(self.action.get("durationSec", 0) / 60) if self.action else 0
        self.base = half_up(sum(self.band) / 2)
        self.delta = self._delta()

    def _delta(self) -> float:
        """How far the action moves a set point, where it moves it by a constant or to one."""
        temp = self.action["temp"] if self.action else {"kind": ""}
        if temp["kind"] == "literal":
            return temp["value"] - self.base
        constant = next((temp[k]["value"] for k in ("right", "left") if temp.get("op") in ("+", "-") and temp[k]["kind"] == "literal"), 0)
        return -constant if temp.get("op") == "-" else constant

    def signals(self) -> list[str]:
        """Every signal that takes part."""
        trees = [self.rule["conditions"], *([self.action["temp"]] if self.action else [])]
        trigger = self.rule["trigger"]
        found = [name_of(n) for t in trees for n in walk(t) if n["kind"] in ("signal", "window")]
        return list(dict.fromkeys(found + ([trigger["signal"]] if trigger["kind"] == "signalChange" else [])))


def sampled(grid: DataFrame, series: DataFrame, signals: list[str], side: str, t: str) -> DataFrame:
    """``grid`` with a column for each signal: its last value at or before the step, if fresh."""
    used = series.filter(F.col("signal").isin(signals) & F.col("value").isNotNull()).select(side, t, "signal", F.col("value").cast("double").alias("value"))
    steps = grid.select(side, t, F.struct(*grid.columns).alias("step"))
    both = steps.unionByName(used, allowMissingColumns=True)
    rows = g.carried(both, [side], seconds=STALE, t=t)
    order = Window.partitionBy(side, "__seg").orderBy(t, F.col("step").isNotNull(), "value").rowsBetween(Window.unboundedPreceding, 0)
    last = [F.last(F.when(F.col("signal") == s, F.struct(t, "value")), ignorenulls=True).over(order).alias(f"s{i}") for i, s in enumerate(signals)]
    found = rows.select("*", *last).filter("__own and step is not null")
    return found.select("step.*", *(F.when(F.col(t) - F.col(f"s{i}.{t}") <= STALE, F.col(f"s{i}.value")).alias(s) for i, s in enumerate(signals)))


def _fed(tree, signal: str | None, night: list[str], t: str):
    """``tree`` with the windows over ``signal`` as they are and all others unknown: only the compared signal is recorded."""
    if isinstance(tree, list):
        return [_fed(x, signal, night, t) for x in tree]
    if not isinstance(tree, dict):
        return tree
    if tree.get("kind") == "window":
        if tree["signal"] != signal:
            return {"kind": "column", "column": F.lit(None).cast("double")}
        if tree["fn"] == "count":  # unknown before anything was recorded, then a number
            so_far = F.count(r.named(signal)).over(Window.partitionBy(*night).orderBy(t))
            return {"kind": "column", "column": F.when(so_far > 0, r.expression(tree, night, t))}
    return {k: _fed(v, signal, night, t) for k, v in tree.items()}


def limited(x: Column, band: tuple[float, float]) -> Column:
    """Clamped to the rule's band, then to the device's."""
    for lo, hi in (band, DEVICE):
        x = F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi)))
    return x


def _triggered(rule: dict, night: list[str], t: str, tz: str) -> Column:
    """Whether the trigger comes at a step."""
    trigger = rule["trigger"]
    earlier = Window.partitionBy(*night).orderBy(t).rowsBetween(Window.unboundedPreceding, -1)
    if trigger["kind"] == "tick":
        return F.lit(True)
    if trigger["kind"] == "signalChange":
        v = r.named(trigger["signal"])
        return F.coalesce(v != F.last(v, ignorenulls=True).over(earlier), F.lit(False))
    local = F.from_utc_timestamp(F.timestamp_seconds(t), tz)
    day = F.dayofweek(local) - 1
    due = (u.minute_of_day(F.col(t), tz) == u.hhmm(F.lit(trigger["at"]))) & (day.isin(*trigger["days"]) if trigger.get("days") else F.lit(True))
    # a slot counts once; the next slot of the same weekday only after one of another
    return due & ~day.eqNullSafe(F.last(F.when(due, day), ignorenulls=True).over(earlier))


def steps(nights: DataFrame, series: DataFrame, rule: dict, keys: list[str], step_min: int = 1, tz: str = "UTC", t: str = "t") -> DataFrame:
    """(keys, i, t, clock_min, primary, avg, setpoint, setpoint_raw, outcome) of each step of each night.

    ``nights``: (keys, start, end), the first key being the side; ``series``: (side, signal, t, value).
    """
    read, side = Reading(rule), keys[0]
    grid = nights.select(*keys, F.col("start").alias("__start"), F.explode(F.when(F.col("start") <= F.col("end"), F.sequence("start", "end", F.lit(step_min * 60).cast("long")))).alias(t))
    grid = grid.select(*keys, t, ((F.col(t) - F.col("__start")) / (step_min * 60)).cast("int").alias("i"))
    rows = sampled(grid, series, read.signals(), side, t) if read.signals() else grid
    none = F.lit(None).cast("double")
    fed = read.compared["signal"] if read.compared and read.compared["kind"] == "window" else None
    tree = lambda x: _fed(x, fed, keys, t)
    clock = u.minute_of_day(F.col(t), tz)
    rows = rows.withColumns({
        "clock_min": clock, "primary": r.named(name_of(read.primary)) if read.primary else none,
        "avg": r.expression(tree(read.compare["left"]), keys, t) if read.compare else none,
    })
    if read.policy:
        inside = r.condition(read.hours, keys, t, tz) if read.hours else F.lit(True)
        raw = F.when(inside, r.expression(tree(read.action["temp"]), keys, t))
        rows = rows.withColumns({"setpoint_raw": f.round1(raw), "setpoint": F.when(raw.isNotNull(), f.round1(limited(raw, read.band))), "outcome": F.lit("")})
    else:
        on = _triggered(rule, keys, t, tz) & F.coalesce(r.condition(tree(rule["conditions"]), keys, t, tz), F.lit(False))
        rows = rows.withColumn("on", on)
        cool = int(60 * (rule.get("cooldownMin") or 0))
        if cool:
            fires = g.chained(rows.filter("on").select(*keys, t), keys, cool, t).withColumn("fired", F.lit(True))
            rows = rows.join(fires, [*keys, t], "left").withColumn("fired", F.coalesce("fired", F.lit(False)))
        else:
            rows = rows.withColumn("fired", F.col("on"))
        held = max(1, half_up(read.minutes / step_min)) if read.minutes else 1
        active = F.max("fired").over(Window.partitionBy(*keys).orderBy(t).rowsBetween(1 - held, 0))
        shifted = f.round1(limited(F.lit(float(read.base + read.delta)), read.band))
        rows = rows.withColumns({"setpoint_raw": none, "setpoint": F.when(active, shifted).otherwise(float(read.base)) if read.action else none, "outcome": F.when(F.col("fired"), "fired").when(F.col("on"), "suppressed").otherwise("")})
    return rows.select(*keys, "i", t, "clock_min", "primary", "avg", "setpoint", "setpoint_raw", "outcome")


def summary(tested: DataFrame, rule: dict, keys: list[str]) -> DataFrame:
    """A row for each night: mode, fires, clamped steps, axes, range and net effect."""
    read = Reading(rule)
    threshold = F.lit(read.threshold).cast("double")
    low, high = (F.coalesce(a(*(x for x in (b("primary"), b("avg"))), threshold)) for a, b in ((F.least, F.min), (F.greatest, F.max)))
    unit = "" if read.primary is None or "movement" in name_of(read.primary) else "°F" if "temperature" in name_of(read.primary) else ""
    set_low, set_high = F.least(F.min("setpoint"), F.min("setpoint_raw")), F.greatest(F.max("setpoint"), F.max("setpoint_raw"))
    effect = f"{'+' if read.delta >= 0 else ''}{read.delta:g}°F · {read.minutes}m" if read.action and not read.policy else None
    text = lambda s: F.lit(s).cast("string")
    out = tested.groupBy(*keys).agg(
        F.count_if(F.col("outcome") == "fired").alias("would_fire"), F.count_if(F.col("outcome") == "suppressed").alias("suppressed"),
        F.count_if(F.abs(F.col("setpoint_raw") - F.col("setpoint")) > 0.05).alias("clamp_hits"), low.alias("low"), high.alias("high"), set_low.alias("set_low"), set_high.alias("set_high"),
    )
    drawn = F.col("high").isNotNull() & F.lit(read.primary is not None)
    return out.select(
        *keys, text("policy" if read.policy else "edge").alias("mode"), "would_fire", "suppressed", "clamp_hits", text("Continuous" if read.policy else "Edge-triggered").alias("label"), text(effect).alias("net_effect"),
        F.when(drawn, F.least(F.lit(0.0), "low")).alias("axis_min"), F.when(drawn, f.nice_max(F.col("high"))).cast("double").alias("axis_max"), F.when(drawn, F.lit(unit)).alias("unit"),
        F.floor(F.col("set_low") - 1).cast("double").alias("temp_min"), F.ceil(F.col("set_high") + 1).cast("double").alias("temp_max"), "set_low", "set_high",
    )
