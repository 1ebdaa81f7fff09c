"""Temperature curves of a night as rows: a table function joined laterally to schedules, and the curve as set points.

A curve is a list of knots. A knot's minute lies a fraction of a span after an anchor, its offset from the base
temperature a fraction of the way between two levels; anchors and levels follow from bedtime, waking, intensity and the
wanted range.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import udtf

# fixed values: base temperature, shares of the warm and cool range by intensity, and the knots
BASE = 80
SHARES = {"cool": (0.2, 0.7, 0.6), "balanced": (0.3, 0.6, 0.5), "warm": (0.5, 0.4, 0.3)}
#: (phase, anchor, span, n, m, from, to, p, q): n / m of the span after the anchor, p / q of the way between two levels.
KNOTS = [
    ("warmUp", "early", "early_span", 0, 3, "base", "warm", 0, 3),
    ("warmUp", "early", "early_span", 1, 3, "base", "warm", 1, 3),
    ("warmUp", "early", "early_span", 2, 3, "base", "warm", 2, 3),
    ("warmUp", "early", "early_span", 3, 3, "base", "warm", 3, 3),
    ("coolDown", "bed", "ramp", 1, 4, "base", "warm", 1, 2),
    ("coolDown", "bed", "ramp", 2, 4, "base", "fall", 1, 2),
    ("coolDown", "bed", "ramp", 3, 4, "base", "fall", 3, 4),
    ("coolDown", "bed", "ramp", 4, 4, "base", "fall", 4, 4),
    ("deepSleep", "ramp", "sink", 1, 2, "fall", "cold", 1, 2),
    ("deepSleep", "ramp", "sink", 2, 2, "fall", "cold", 2, 2),
    ("deepSleep", "deep_middle", "none", 1, 1, "cold", "cold", 1, 1),
    ("deepSleep", "deep_end", "none", 1, 1, "cold", "cold", 1, 1),
    ("maintain", "deep_end", "rise_span", 1, 3, "cold", "keep", 1, 3),
    ("maintain", "deep_end", "rise_span", 2, 3, "cold", "keep", 2, 3),
    ("maintain", "deep_end", "rise_span", 3, 3, "cold", "keep", 3, 3),
    ("maintain", "keep_middle", "none", 1, 1, "keep", "keep", 1, 1),
    ("maintain", "early_wake", "none", 1, 1, "keep", "keep", 1, 1),
    ("preWake", "early_wake", "wake_span", 1, 3, "keep", "hot", 1, 3),
    ("preWake", "early_wake", "wake_span", 2, 3, "keep", "hot", 2, 3),
    ("preWake", "wake", "none", 1, 1, "keep", "hot", 1, 1),
    ("wake", "wake", "late_span", 1, 3, "base", "hot", 2, 3),
    ("wake", "wake", "late_span", 2, 3, "base", "hot", 1, 3),
    ("wake", "wake", "late_span", 3, 3, "base", "hot", 0, 3),
]


def _round(x: float) -> int:
    return math.floor(x + 0.5)


def knots(bed: int, wake: int, intensity: str | None, low: float | None, high: float | None):
    """(minute from bedtime, offset, phase) of a curve, in order; of equal minutes the earlier knot first."""
    asleep = (wake - bed) % 1440 or 1440
    share = SHARES[intensity or "balanced"]
    cool, warm = BASE - (68 if low is None else low), (86 if high is None else high) - BASE
    level = {"base": 0, "warm": _round(warm * share[0]), "fall": -_round(cool * share[1]), "cold": -cool, "keep": -_round(cool * share[2]), "hot": warm}
    ramp, sink, end = min(90, asleep * 0.15), min(60, asleep * 0.1), min(210, asleep * 0.45)
    kept = end + 45
    early = min(asleep, max(kept + 30, asleep - 45))
    at = {
        "none": 0, "bed": 0, "early": -45, "early_span": 45, "ramp": ramp, "sink": sink, "deep_middle": (ramp + sink + end) / 2, "deep_end": end, "rise_span": 45,
        "keep_middle": (kept + early) / 2, "early_wake": early, "wake_span": max(0, asleep - early), "wake": asleep, "late_span": 30,
    }
    found = [(_round(at[a] + at[s] * n / m), _round(level[x] + (level[y] - level[x]) * p / q), phase) for phase, a, s, n, m, x, y, p, q in KNOTS if a != "keep_middle" or early > kept + 30]
    return sorted(found, key=lambda k: k[0])


@udtf(returnType="i: int, minute: int, offset: int, phase: string")
class CurvePoints:
    """The knots of one schedule; none without a bedtime or a waking time."""

    def eval(self, bed, wake, intensity, low, high):
        if bed is not None and wake is not None:
            for i, (minute, offset, phase) in enumerate(knots(bed, wake, intensity, low, high)):
                yield i, minute, offset, phase


def curves(schedules: DataFrame, bed: str = "bed", wake: str = "wake", intensity: str = "intensity", low: str = "low", high: str = "high") -> DataFrame:
    """``schedules`` with a row for each knot: ``i``, ``minute`` from bedtime, ``offset`` from the base and ``phase``.

    Times are minutes of the day; a waking time not after bedtime is of the next day. A null intensity is balanced, null limits
    are 68 and 86 degrees.
    """
    points = CurvePoints(*(F.col(c).outer() for c in (bed, wake, intensity, low, high)))
    return schedules.lateralJoin(points)


def set_points(curve: DataFrame, keys: list[str], bed: str = "bed") -> DataFrame:
    """(keys, curve): a map of clock times to degrees; of knots in one minute the last counts."""
    minute = F.pmod(F.col(bed) + F.col("minute"), F.lit(1440)).cast("int")
    clock = F.format_string("%02d:%02d", F.floor(minute / 60).cast("int"), minute % 60)
    last = curve.groupBy(*keys, clock.alias("clock")).agg(F.max_by(BASE + F.col("offset"), "i").alias("degrees"))
    return last.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("clock", "degrees")))).alias("curve"))


def _clocked(bed: int, wake: int, intensity: str | None, low: float | None, high: float | None) -> list[tuple[str, int]]:
    """The set points of one schedule in the order of the clock."""
    last = {(bed + minute) % 1440: BASE + offset for minute, offset, _ in knots(bed, wake, intensity, low, high)}
    return [(f"{m // 60:02d}:{m % 60:02d}", degrees) for m, degrees in sorted(last.items())]


def with_set_points(schedules: DataFrame, bed: str = "bed", wake: str = "wake", intensity: str = "intensity", low: str = "low", high: str = "high") -> DataFrame:
    """``schedules`` that have a curve with ``curve``, the map of ``set_points``.

    A schedule is one row before and after, so no knots are grouped and a task's memory doesn't grow with the table.
    """
    points = F.udf(_clocked, "array<struct<clock: string, degrees: int>>", useArrow=True)
    found = points(*(F.col(c) for c in (bed, wake, intensity, low, high)))
    return schedules.dropna(subset=[bed, wake]).withColumn("curve", F.map_from_entries(found))


def as_text(curve: Column) -> Column:
    """A map of set points as ``HH:MM@degrees`` in the order of the clock."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(curve)), lambda e: F.concat_ws("@", e["key"], e["value"].cast("string"))), "|")
