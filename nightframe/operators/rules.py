"""Reactive rules: expression and condition trees compiled to columns, and a back-test over history.

Trees are plain dictionaries (as stored in JSON). Unknown values are nulls, so
SQL's three-valued logic is the rule language's. A back-test evaluates a rule at
every step at once; only the cooldown between fires is sequential, a chain that
is walked in time segments.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import units as u
from . import segments as g

MAX_DEPTH, MAX_NODES = 16, 400
FUNCTIONS = {"avg": F.avg, "min": F.min, "max": F.max, "sum": F.sum, "count": F.count}
COMPARE = {">": "__gt__", ">=": "__ge__", "<": "__lt__", "<=": "__le__", "==": "__eq__", "!=": "__ne__"}


def nodes(tree: dict, depth: int = 1) -> int:
    """Number of nodes; raises where a tree is too deep or too large."""
    if depth > MAX_DEPTH:
        raise ValueError("the rule is nested too deeply")
    kids = [x for v in tree.values() for x in (v if isinstance(v, list) else [v]) if isinstance(x, dict)]
    n = 1 + sum(nodes(k, depth + 1) for k in kids)
    if n > MAX_NODES:
        raise ValueError("the rule has too many parts")
    return n


def named(signal: str) -> Column:
    """The column of a signal, whose name may have dots."""
    return F.col(f"`{signal}`")


def expression(tree: dict, keys: list[str], t: str = "t") -> Column:
    """A number of each step."""
    kind = tree["kind"]
    if kind == "literal":
        return F.lit(float(tree["value"]))
    if kind == "column":  # compiled already
        return tree["column"]
    if kind == "signal":
        return named(tree["key"]).cast("double")
    if kind == "window":
        w = Window.partitionBy(*keys).orderBy(t).rangeBetween(-int(tree["lastMin"] * 60), 0)
        return FUNCTIONS[tree["fn"]](named(tree["signal"])).over(w).cast("double")
    if kind == "clamp":
        x = expression(tree["value"], keys, t)
        known = x.isNotNull()
        if "min" in tree:
            x = F.greatest(x, expression(tree["min"], keys, t))
        if "max" in tree:
            x = F.least(x, expression(tree["max"], keys, t))
        return F.when(known, x)
    a, b = expression(tree["left"], keys, t), expression(tree["right"], keys, t)
    return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.try_divide(a, b)}[tree["op"]]()


def condition(tree: dict, keys: list[str], t: str = "t", tz: str = "UTC") -> Column:
    """True, false or unknown of each step."""
    kind = tree["kind"]
    if kind in ("and", "or"):
        parts = [condition(c, keys, t, tz) for c in tree["conditions"]]
        return reduce((lambda a, b: a & b) if kind == "and" else (lambda a, b: a | b), parts, F.lit(kind == "and"))
    if kind == "not":
        return ~condition(tree["condition"], keys, t, tz)
    if kind == "compare":
        return getattr(expression(tree["left"], keys, t), COMPARE[tree["op"]])(expression(tree["right"], keys, t))
    if kind == "between":
        x, lo, hi = (expression(tree[k], keys, t) for k in ("value", "min", "max"))
        return F.when(x.isNotNull() & lo.isNotNull() & hi.isNotNull(), x.between(lo, hi))  # one unknown makes it unknown
    if kind == "timeBetween":
        start, end = (int(x[:2]) * 60 + int(x[3:]) for x in (tree["start"], tree["end"]))
        return u.within_clock(u.minute_of_day(F.col(t), tz), start, end)
    if kind == "onDays":
        return (F.dayofweek(F.from_utc_timestamp(F.timestamp_seconds(t), tz)) - 1).isin(*tree["days"])
    raise ValueError(f"unknown condition {kind!r}")


def evaluate(steps: DataFrame, rule: dict, key: str = "side", t: str = "t") -> DataFrame:
    """Steps with ``holds`` (null: unknown); windows see over the edges of the time segments that steps are dealt by."""
    nodes(rule["when"])
    rows = g.carried(steps, [key], seconds=int(60 * longest(rule)), t=t)
    return g.own(rows.withColumn("holds", condition(rule["when"], [key, "__seg"], t)))


def longest(tree) -> float:
    """Minutes of the longest window in a tree."""
    if isinstance(tree, dict):
        return max([float(tree.get("lastMin", 0)), *map(longest, tree.values())])
    return max(map(longest, tree), default=0.0) if isinstance(tree, (list, tuple)) else 0.0


def backtest(steps: DataFrame, rule: dict, key: str = "side", t: str = "t") -> DataFrame:
    """Each step's wanted set point and whether the rule fires, is held back by its cooldown, or rests.

    A set point is clamped to the rule's band, then to 55 to 110 degrees. Fires are the steps at which the rule holds,
    each at least a cooldown after the last.
    """
    nodes(rule["when"])
    rows = g.carried(steps, [key], seconds=int(60 * max(longest(rule["when"]), longest(rule["setpoint"]))), t=t)
    raw = expression(rule["setpoint"], [key, "__seg"], t)
    low, high = rule.get("band", (55, 110))
    clamped = F.greatest(F.lit(55.0), F.least(F.lit(110.0), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), raw))))
    rows = g.own(rows.withColumns({"holds": condition(rule["when"], [key, "__seg"], t), "setpoint": F.round(F.when(raw.isNotNull(), clamped), 6), "clamped": raw != clamped}))
    on = rows.filter("holds").select(key, t)
    cool = int(rule.get("cooldown_min", 0)) * 60
    fires = (g.chained(on, [key], cool, t) if cool else on.distinct()).withColumn("__fired", F.lit(True))
    outcome = F.when(F.col("__fired"), "fired").when(F.col("holds"), "suppressed").otherwise("idle")
    return rows.join(fires, [key, t], "left").select(key, t, "holds", "setpoint", "clamped", outcome.alias("outcome"))


def summary(tested: DataFrame, key: str = "side") -> DataFrame:
    """Fires, held-back fires and clamped set points of each key."""
    count = lambda c: F.count_if(c)
    return tested.groupBy(key).agg(count(F.col("outcome") == "fired").alias("fires"), count(F.col("outcome") == "suppressed").alias("suppressed"), count(F.col("clamped")).alias("clamped"), F.count("*").alias("steps"))
