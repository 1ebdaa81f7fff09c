"""Guards over device states: stalled pumps, empty beds, and pump noise in movement."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import folds, segments as g

# fixed values
DWELL, RECOVERY, LEAST_RPM, HEALTHY_RPM = 5, 8, 50, 1000
SANE = 7 * 86400
PUMP_GUARD, REF_MOVED, REF_SHARE = 3, 0.02, 0.5


def stall_guard(frames: DataFrame, keys: list[str], dwell: int = DWELL, recovery: int = RECOVERY, least: int = LEAST_RPM, healthy: int = HEALTHY_RPM, recovers: bool = True, **cut) -> DataFrame:
    """(keys, t, event): when a guard blocks a pump ('trip') and lets it run again ('recover'), from frames (keys, t, rpm, active).

    It trips on ``dwell`` slow frames in a row while the pump should run; frames at which it shouldn't start the count anew. Blocked, it counts
    healthy frames in a row, wanted or not, and recovers unless ``recovers`` is off. Frames without a speed tell nothing.
    """

    def run(state: dict, rows: pd.DataFrame):
        low, well, blocked, told = state["low"], state["well"], state["blocked"], []
        for t, rpm, active in zip(rows["t"].tolist(), rows["rpm"].tolist(), rows["active"].tolist()):
            if blocked:
                well = well + 1 if rpm >= healthy else 0
                if recovers and well >= recovery:
                    low, well, blocked = 0, 0, False
                    told.append((t, "recover"))
            else:
                low = low + 1 if active and rpm < least else 0
                if low >= dwell:
                    low, well, blocked = 0, 0, True
                    told.append((t, "trip"))
        return {"low": low, "well": well, "blocked": blocked}, pd.DataFrame(told, columns=["t", "event"])

    known = frames.select(*keys, "t", F.col("rpm").cast("double").alias("rpm"), F.coalesce("active", F.lit(False)).alias("active")).dropna(subset=["rpm"])
    return folds.fold(known, keys, run, {"low": 0, "well": 0, "blocked": False}, "t bigint, event string", **cut)


def auto_off(ticks: DataFrame, keys: list[str], minutes: int, enabled: bool = True, max_on_hours: float | None = None, **cut) -> DataFrame:
    """(keys, t, reason): when a side is switched off, from ticks (keys, t, powered, exempt, presence, on_at).

    ``presence`` is 'occupied', 'empty' or anything else for unknown, which never switches off and starts the count anew. An exempt side
    (run-once, always on) is left alone. A side that has been on for ``max_on_hours`` goes off whatever is sensed ('max_on'), unless the
    time it was switched on lies ahead or more than a week back. A side that was switched off stays so until ``on_at`` changes.
    """

    def run(state: dict, rows: pd.DataFrame):
        since, off, told = state["since"], state["off"], []
        for t, powered, exempt, presence, on_at in zip(*(rows[c].tolist() for c in ("t", "powered", "exempt", "presence", "on_at"))):
            on_at = None if pd.isna(on_at) else int(on_at)
            if not powered or exempt or (off is not None and off == on_at):
                since = None
                continue
            age = None if on_at is None else t - on_at
            if max_on_hours and age is not None and max_on_hours * 3600 < age <= SANE:
                reason = "max_on"
            elif not enabled or presence != "empty":
                since = None
                continue
            elif since is None:
                since = t
                continue
            elif t - since >= minutes * 60:
                reason = "empty"
            else:
                continue
            since, off = None, on_at
            told.append((t, reason))
        return {"since": since, "off": off}, pd.DataFrame(told, columns=["t", "reason"])

    known = ticks.select(*keys, "t", F.coalesce("powered", F.lit(False)).alias("powered"), F.coalesce("exempt", F.lit(False)).alias("exempt"), "presence", F.col("on_at").cast("double").alias("on_at"))
    return folds.fold(known, keys, run, {"since": None, "off": None}, "t bigint, reason string", **cut)


def last_before(df: DataFrame, keys: list[str], value: str, name: str, t: str = "t") -> DataFrame:
    """``df`` with the last known ``value`` before each row, its own not counted."""
    rows = g.headed(df.withColumn("__known", F.col(value)), keys, ["__known"], t)
    w = Window.partitionBy(*keys, "__seg").orderBy("__own", t).rowsBetween(Window.unboundedPreceding, -1)
    return g.own(rows.withColumn(name, F.last("__known", ignorenulls=True).over(w))).drop("__known")


def deltas(samples: DataFrame, keys: list[str], channels: list[str]) -> DataFrame:
    """``samples`` with ``deltas``: the absolute change of each channel since the last whole sample; null without one or where a channel is missing."""
    whole = F.when(~F.exists(F.array(*channels), lambda c: c.isNull()), F.struct(*(F.col(c).cast("double").alias(c) for c in channels)))
    rows = last_before(samples.withColumn("__whole", whole), keys, "__whole", "__was")
    change = F.when(F.col("__whole").isNotNull() & F.col("__was").isNotNull(), F.array(*(F.abs(F.col(f"__whole.{c}") - F.col(f"__was.{c}")) for c in channels)))
    return rows.withColumn("deltas", change).drop("__whole", "__was")


def total(values: Column) -> Column:
    return F.coalesce(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.lit(0.0))


def pump_gate(moved: DataFrame, pumps: DataFrame, keys: list[str], nominal: float = 1.16) -> DataFrame:
    """``moved`` (with ``deltas`` and ``ref``) with ``gated`` and ``movement``: none while the own pump runs or has stopped less than three seconds ago, nor
    where the reference has moved and two channels with it. ``pumps``: (keys, t, rpm) of each side."""
    runs = last_before(pumps.select(*keys, "t", F.col("rpm").cast("double").alias("rpm")), keys, "rpm", "was")
    stops = F.when((F.coalesce("rpm", F.lit(0.0)) <= 0) & (F.col("was") > 0), F.col("t"))
    runs = runs.select(*keys, "t", F.when(F.col("rpm").isNotNull(), F.struct("t", "rpm")).alias("__run"), stops.alias("__stop"))
    # both in one order, a pump's row before what moves at its time
    others = [c for c in moved.columns if c not in (*keys, "t")]
    both = moved.select(*keys, "t", F.struct(*others).alias("__row")).unionByName(runs, allowMissingColumns=True)
    w = Window.partitionBy(*keys, "__seg").orderBy("__own", "t", F.col("__row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    rows = g.headed(both, keys, ["__run", "__stop"]).withColumns({c: F.last(c, ignorenulls=True).over(w) for c in ("__run", "__stop")})
    rows = g.own(rows.filter("__row is not null")).withColumns({c: F.col(f"__row.{c}") for c in others}).drop("__row")
    running = F.when(F.col("t") - F.col("__run.t") <= g.DAY, F.col("__run.rpm"))
    shift = F.abs(F.col("ref") - nominal)
    along = F.size(F.filter("deltas", lambda d: d > shift * REF_SHARE)) >= 2
    stopped = F.coalesce(F.col("t") - F.col("__stop") < PUMP_GUARD, F.lit(False))
    gated = (F.coalesce(running, F.lit(0.0)) > 0) | stopped | F.coalesce((shift > REF_MOVED) & F.col("deltas").isNotNull() & along, F.lit(False))
    return rows.withColumns({"gated": gated, "movement": F.when(gated, 0.0).otherwise(total(F.col("deltas")))}).select(*moved.columns, "gated", "movement")
