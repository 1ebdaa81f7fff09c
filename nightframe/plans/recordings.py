"""Queries of the kernels over recordings: the events' values as samples of two sides."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import recordings as r, vitals as v
from ..operators.patterns import asof_backward
from ..sources.views import START, view
from .core import reg, rnd
from .registry import QUERIES
from .sequences import each_pump

RATE, SIZE, HOP = 8, 10 * 8, 5 * 8
WINDOWED = f"""
, n as (select side, i div {HOP} as k, i, x from recording),
w as (select distinct side, k - d as w from n, (values (0), (1)) v(d) where k - d >= 0),
s as (select w.side, w.w, i - w.w * {HOP} as j, x from w join recording r on r.side = w.side and r.i >= w.w * {HOP} and r.i < w.w * {HOP} + {SIZE}),
o as (select side, w, list(x order by j) as xs, count(*) as c from s group by 1, 2 having count(*) = {SIZE}),
z as (select side, w, list_transform(xs, lambda v: v - list_avg(xs)) as xs from o)"""
WINDOWED = WINDOWED.replace(" div ", " // ")


@reg("dsp_acr_quality", WINDOWED + f", l as (select side, w, lag, list_sum(list_transform(range(1, {SIZE} - lag + 1), lambda j: xs[j] * xs[j + lag])) / list_sum(list_transform(xs, lambda v: v * v)) as a from z, range(3, 13) as t(lag)) select side, w, round(greatest(0e0, max(a)), 6) as quality from l group by 1, 2", "recording")
def quality(recording):
    """How periodic each ten seconds are, every five seconds."""
    out = r.windows(recording, ["side"], SIZE, HOP, {"quality": r.acr_quality(RATE)})
    return out.select("side", "w", rnd("quality").alias("quality"))


@reg("dsp_window_std", WINDOWED + f" select side, w, round((list_stddev_pop(xs[1:{HOP}]) + list_stddev_pop(xs[{HOP + 1}:])) / 2, 6) as std from z", "recording")
def window_std(recording):
    """The median deviation of the halves of each ten seconds."""
    return r.windows(recording, ["side"], SIZE, HOP, {"std": r.window_std(RATE)}).select("side", "w", rnd("std").alias("std"))


# a chain of medians and tracked means has no SQL form; a plain loop tests it
QUERIES["dsp_hrv"] = lambda spark, sf_dir: r.hrv(view(spark, sf_dir, "recording"), ["side"], RATE)


def vitals_emit(spark, sf_dir):
    """Vitals of both sides, a row a minute while somebody is there; thresholds for the events' spread of about 50."""
    found = v.minutes(view(spark, sf_dir, "recording"), ["side"], RATE)
    found = v.uncoupled(found, [], "side", 45.0)
    pumps = each_pump(view(spark, sf_dir, "flow")).select("side", F.col("t").alias("at"), (F.col("rpm") >= 50).cast("double").alias("pump"))
    rows = asof_backward(found.withColumn("at", F.col("at") + START), pumps, ["side"], "at", "pump", 60)
    return v.emitted(rows.withColumn("pump", F.coalesce(F.col("pump") > 0, F.lit(False))), ["side"], 45.0, 40.0)


# heart rates by autocorrelation have no SQL form; plain loops test the fold
QUERIES["st_vitals_emit"] = vitals_emit
