"""Queries of window, sequence and state-machine operators.

Series run on over midnight: they are dealt by side and time segment, and what a
segment's frames and folds need of its neighbours is carried over. Stages belong
to a night, which is a sleep record of at most sixteen hours.
"""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import units as u
from ..operators import segments as g, sequences as s
from ..operators.patterns import interval_join
from .core import NOW, reg, rnd

SIDE, NIGHT = ["side"], ["night"]
BY = "partition by side order by t"


def framed(df, lo: int, hi: int, keys=SIDE):
    """Rows with the context of a frame of ``lo`` before to ``hi`` after, and that frame."""
    return g.carried(df, keys, before=lo, after=hi), g.within(keys).rowsBetween(-lo, hi)


@reg("win_moving_avg5", f"select id, round(avg(heart_rate) over ({BY} rows between 2 preceding and 2 following), 6) as mean from vitals", "vitals")
def moving_avg5(vitals):
    rows, w = framed(vitals, 2, 2)
    return g.own(rows.withColumn("mean", rnd(F.avg("heart_rate").over(w)))).select("id", "mean")


FILTER = f"""f as (select v.*, s.id as night, case when heart_rate between 45 and 130 then heart_rate end as raw from vitals v join sleep_records s on s.side = v.side and v.t between s.entered and least(coalesce(s.left_at, 99999999999), s.entered + 57600)),
g as (select *, list_sort(list(raw) filter (raw is not null) over w) as around, stddev_pop(raw) over w as sd from f window w as (partition by night order by t rows between 2 preceding and 2 following)),
h as (select id, side, night, t, hrv, raw, case when sd > 0 and abs(raw - around[len(around) // 2 + 1]) > 2 * sd then null else raw end as hr from g)"""


def by_night(rows, sessions):
    """Rows of each sleep record, by its id; one that is open ends after sixteen hours."""
    end = F.least(F.coalesce("left_at", F.lit(99999999999)), F.col("entered") + 57600)
    return interval_join(rows, sessions.withColumn("night", F.col("id")), SIDE, "t", F.col("entered"), end, ["night"])


@reg("win_hr_median_filter", f", {FILTER} select id, raw, hr from h", "vitals", "movement", "sleep_records")
def median_filter(vitals, _, sessions):
    return s.hr_median_filter(by_night(vitals, sessions), NIGHT).select("id", "raw", "hr")


@reg("win_epoch_duration", f", {FILTER} select id, coalesce(least(lead(t) over (partition by night order by t) - t, 600), 300) as seconds from h", "vitals", "movement", "sleep_records")
def epoch_duration(vitals, _, sessions):
    return s.epoch_duration(by_night(vitals, sessions), NIGHT).select("id", "seconds")


@reg("win_gap_break", "select t, cast(sum(brk) over (order by t) as bigint) as segment from (select t, case when t - lag(t) over (order by t) > 120 then 1 else 0 end as brk from bed_temp)", "bed_temp")
def gap_break(bed, seconds: int = 120):
    """The number of gaps before each row."""
    rows, w = g.carried(bed.select("t"), [], before=1), g.within([])
    rows = g.own(rows.withColumn("brk", F.coalesce((F.col("t") - F.lag("t").over(w) > seconds).cast("int"), F.lit(0))))
    return g.running_sum(rows, [], "brk", "segment").select("t", "segment")


BASE = f"b as (select id, side, t, total_movement, list_sort(list(total_movement) over ({BY} rows between 29 preceding and current row)) as l from movement), c as (select id, side, t, case when len(l) > 10 then greatest(0, total_movement - l[greatest(1, cast(floor(0.05 * len(l) + 0.5) as int))]) else total_movement end as score from b)"


def baseline_subtracted(movement, more: int = 0):
    """Scores above the fifth percentile of the last thirty, with ``more`` rows of context for a further frame."""
    rows = g.carried(movement, SIDE, before=29 + more)
    rows = rows.withColumn("l", F.collect_list("total_movement").over(g.within(SIDE).rowsBetween(-29, 0)))
    return rows.withColumn("score", F.when(F.size("l") > 10, F.greatest(F.lit(0), F.col("total_movement") - s.nearest_rank(F.col("l"), 5))).otherwise(F.col("total_movement")))


@reg("win_baseline_subtract", f", {BASE} select id, score from c", "movement")
def baseline_subtract(movement):
    return g.own(baseline_subtracted(movement)).select("id", "score")


@reg("win_median3", f", {BASE} select id, case when len(l) < 3 then score else list_sort(l)[2] end as median from (select id, score, list(score) over ({BY} rows between 2 preceding and current row) as l from c)", "movement")
def median3(movement):
    last = F.collect_list("score").over(g.within(SIDE).rowsBetween(-2, 0))
    rows = g.own(baseline_subtracted(movement, 2).withColumn("m", last))
    return rows.select("id", F.when(F.size("m") < 3, F.col("score")).otherwise(F.try_element_at(F.array_sort("m"), F.lit(2))).alias("median"))


@reg("win_quietest", f"select side, t // 86400 as day, arg_min(t, v * 1e12 + (t % 86400)) as start, round(min(v), 6) as variance from (select side, t, round(var_pop(total_movement) over ({BY} rows between current row and 299 following), 6) as v, count(*) over ({BY} rows between current row and 299 following) as n from movement) where n = 300 group by 1, 2", "movement")
def quietest(movement, width: int = 300):
    """The quietest run of rows that begins on each day."""
    rows = g.spreads(movement.select("side", "t", "total_movement"), SIDE, ["total_movement"], width).filter("n is not null")
    rows = rows.withColumns({"v": rnd("var_total_movement"), "day": s.day_key()})
    return rows.groupBy("side", "day").agg(F.min_by("t", F.struct("v", "t")).alias("start"), rnd(F.min("v")).alias("variance"))


@reg("win_dynamic_bounds", f"select id, case when len(l) >= 30 then l[cast(floor(len(l) * 0.1) as int) + 1] end as lo, case when len(l) >= 30 then greatest(l[least(len(l), cast(floor(len(l) * 0.9) as int) + 1)], l[cast(floor(len(l) * 0.1) as int) + 1] + 15) end as hi from (select id, coalesce(list_sort(list(heart_rate) filter (heart_rate is not null) over ({BY} rows between 300 preceding and 1 preceding)), []) as l from vitals)", "vitals")
def dynamic_bounds(vitals):
    rows = g.carried(vitals, SIDE, before=300)
    l = F.array_sort(F.collect_list("heart_rate").over(g.within(SIDE).rowsBetween(-300, -1)))
    rows = g.own(rows.withColumn("l", l)).withColumn("n", F.size("l"))
    lo = F.try_element_at("l", F.floor(F.col("n") * 0.1).cast("int") + 1)
    hi = F.try_element_at("l", F.least(F.col("n"), F.floor(F.col("n") * 0.9).cast("int") + 1))
    many = F.col("n") >= 30
    return rows.select("id", F.when(many, lo).alias("lo"), F.when(many, F.greatest(hi, lo + 15)).alias("hi"))


@reg("win_successive_diff", f"select side, t // 86400 as day, round(sqrt(avg(d * d)), 6) as rmssd from (select side, t, case when t - lag(t) over ({BY}) < 180 then hrv - lag(hrv) over ({BY}) end as d from vitals where hrv > 0) group by 1, 2", "vitals")
def successive_diff(vitals):
    """Of each day; its first value is compared with the last of the day before."""
    rows, w = g.carried(vitals.filter("hrv > 0"), SIDE, before=1), g.within(SIDE)
    d = F.when(F.col("t") - F.lag("t").over(w) < 180, F.col("hrv") - F.lag("hrv").over(w))
    rows = g.own(rows.withColumns({"d": d, "day": s.day_key()}))
    return rows.groupBy("side", "day").agg(rnd(F.sqrt(F.avg(F.col("d") * F.col("d")))).alias("rmssd"))


@reg("agg_window_fn", "select id, round(avg(heart_rate) over w, 6) as mean, min(heart_rate) over w as lo, max(heart_rate) over w as hi, sum(heart_rate) over w as total, count(heart_rate) over w as n from vitals window w as (partition by side order by t range between 600 preceding and current row)", "vitals")
def window_fn(vitals, minutes: int = 10):
    w = g.within(SIDE).rangeBetween(-minutes * 60, 0)
    h = "heart_rate"
    rows = g.carried(vitals, SIDE, seconds=minutes * 60)
    rows = g.own(rows.withColumns({"mean": rnd(F.avg(h).over(w)), "lo": F.min(h).over(w), "hi": F.max(h).over(w), "total": F.sum(h).over(w), "n": F.count(h).over(w)}))
    return rows.select("id", "mean", "lo", "hi", "total", "n")


@reg("agg_sample_variance", f"select id, round(stddev_pop(total_movement) over ({BY} rows between 19 preceding and current row), 6) as sd from movement", "movement")
def sample_variance(movement):
    rows, w = framed(movement, 19, 0)
    return g.own(rows.withColumn("sd", rnd(F.stddev_pop("total_movement").over(w)))).select("id", "sd")


@reg("win_hampel", f"select id, case when abs(hrv - m) > 3 * 1.4826 * greatest(list_sort(list_transform(l, lambda x: abs(x - m)))[len(l) // 2 + 1], 0.000001) then null else hrv end as hrv from (select id, hrv, l, l[len(l) // 2 + 1] as m from (select id, hrv, list_sort(list(hrv) over ({BY} rows between 3 preceding and 3 following)) as l from vitals))", "vitals")
def hampel(vitals):
    rows, w = framed(vitals, 3, 3)
    l = F.array_sort(F.collect_list("hrv").over(w))
    mid = lambda a: F.try_element_at(a, (F.size(a) / 2).cast("int") + 1)
    rows = g.own(rows.withColumn("l", l)).withColumn("m", mid(F.col("l")))
    rows = rows.withColumn("mad", mid(F.array_sort(F.transform("l", lambda x: F.abs(x - F.col("m"))))))
    return rows.select("id", F.when(F.abs(F.col("hrv") - F.col("m")) > 3 * 1.4826 * F.greatest(F.col("mad"), F.lit(1e-6)), None).otherwise(F.col("hrv")).alias("hrv"))


def each_pump(flow):
    """(side, t, rpm, flow) of both pumps."""
    each = F.explode(F.array(*(F.struct(F.lit(x).alias("side"), F.col(f"{x}_rpm").alias("rpm"), F.col(f"{x}_flow").alias("flow")) for x in ("left", "right"))))
    return flow.select("t", each.alias("x")).select("x.side", "t", "x.rpm", "x.flow")


PUMPS = "p as (" + " union all ".join(f"select '{x}' as side, t, {x}_rpm as rpm, {x}_flow as flow from flow" for x in ("left", "right")) + ")"


@reg("win_flow_delta", f", {PUMPS} select side, t, abs(flow - was) > 500 as spike from (select side, t, flow, lag(flow) over (partition by side order by t) as was from p where flow is not null)", "flow")
def flow_delta(flow):
    """Jumps of each side's flow from its last known one."""
    rows = g.carried(each_pump(flow).filter("flow is not null"), SIDE, before=1)
    rows = g.own(rows.withColumn("was", F.lag("flow").over(g.within(SIDE))))
    return rows.select("side", "t", (F.abs(F.col("flow") - F.col("was")) > 500).alias("spike"))


@reg("win_edge_powered", f", {PUMPS} select side, t, last_value(case when on_now and not coalesce(was, false) then t end ignore nulls) over (partition by side order by t) as powered_on_at, on_now from (select side, t, rpm >= 50 as on_now, lag(rpm >= 50) over (partition by side order by t) as was from p) qualify on_now", "flow")
def edge_powered(flow):
    """When each running pump was last started."""
    rows = g.carried(each_pump(flow).select("side", "t", (F.col("rpm") >= 50).alias("on_now")), SIDE, before=1)
    edge = F.when(F.col("on_now") & ~F.coalesce(F.lag("on_now").over(g.within(SIDE)), F.lit(False)), F.col("t"))
    rows = g.last_known(g.own(rows.withColumn("edge", edge)), SIDE, "edge", "powered_on_at")
    return rows.filter("on_now").select("side", "t", "powered_on_at", "on_now")


@reg("win_ring_tail", "select id, side, t from (select *, row_number() over (partition by side order by t desc) as k from movement) where k <= 120", "movement")
def ring_tail(movement, keep: int = 120):
    k = F.row_number().over(Window.partitionBy("side").orderBy(F.desc("t")))
    return movement.withColumn("k", k).filter(F.col("k") <= keep).select("id", "side", "t")


STAGED = f""", {FILTER},
v as (select h.*, m.total_movement, avg(hr) over (partition by h.night) as mean_hr from h left join (select side, cast(floor(t / 300.0 + 0.5) as bigint) as k, max_by(total_movement, t) as total_movement from movement group by 1, 2) m on m.side = h.side and m.k = cast(floor(h.t / 300.0 + 0.5) as bigint)),
e as (select id, side, night, t, coalesce(least(lead(t) over (partition by night order by t) - t, 600), 300) as seconds,
 case when coalesce(total_movement, 0) > 200 then 'wake' when hr is null then case when coalesce(total_movement, 0) >= 100 then 'wake' else 'light' end
  when hr / mean_hr < 0.92 and coalesce(hrv, 0) >= 40 and coalesce(total_movement, 0) < 50 then 'deep' when hr / mean_hr >= 0.95 and coalesce(total_movement, 0) < 50 and coalesce(hrv, 0) < 40 then 'rem' else 'light' end as stage from v)"""


def staged(vitals, movement, sessions):
    k = u.half_up(F.col("t") / 300).alias("k")
    m = movement.groupBy("side", k).agg(F.max_by("total_movement", "t").alias("total_movement"))
    rows = s.hr_median_filter(by_night(vitals, sessions), NIGHT).withColumn("k", u.half_up(F.col("t") / 300)).join(m, ["side", "k"], "left")
    rows = rows.withColumn("mean_hr", F.avg("hr").over(Window.partitionBy(*NIGHT)))
    return s.epoch_duration(s.classify(rows), NIGHT)


@reg("stage_classify", f"{STAGED} select id, stage, seconds from e", "vitals", "movement", "sleep_records")
def stage_classify(vitals, movement, sessions):
    return staged(vitals, movement, sessions).select("id", "stage", "seconds")


@reg("agg_stage_distribution", f"{STAGED} select night, " + ", ".join(f"cast(floor(sum(case when stage = '{x}' then seconds else 0 end) * 100.0 / sum(seconds) + 0.5) as bigint) as {x}" for x in ("wake", "light", "deep", "rem")) + " from e group by 1", "vitals", "movement", "sleep_records")
def stage_distribution(vitals, movement, sessions):
    return s.distribution(staged(vitals, movement, sessions), NIGHT)


@reg("win_blocks", f"{STAGED}, x as (select *, case when stage <> coalesce(lag(stage) over (partition by night order by t), '') then 1 else 0 end as new from e), y as (select *, sum(new) over (partition by night order by t) as block from x) select night, any_value(stage) as stage, min(t) as start, max(t + seconds) as \"end\" from y group by night, block", "vitals", "movement", "sleep_records")
def stage_blocks(vitals, movement, sessions):
    return s.blocks(staged(vitals, movement, sessions), NIGHT)


SMOOTH = """, o as (select *, row_number() over (partition by night order by t) as i, count(*) over (partition by night) as n from e),
a as (select night, list(stage order by t) as l, any_value(n) as n from o group by night),
r1 as (select night, l, n, 2 as i from a union all
 select night, case when i < n and l[i - 1] = l[i + 1] and l[i] <> l[i - 1] then list_concat(l[1:i - 1], [l[i - 1]], l[i + 1:]) else l end, n, i + 1 from r1 where i < n),
f1 as (select night, l, n from r1 where i >= n),
r2 as (select night, l, n, 2 as i from f1 union all
 select night, case when (l[i - 1] = 'wake' and l[i] = 'deep') or (l[i - 1] = 'deep' and l[i] in ('wake', 'rem')) or (l[i - 1] = 'rem' and l[i] = 'deep') then list_concat(l[1:i - 1], ['light'], l[i + 1:]) else l end, n, i + 1 from r2 where i <= n),
f2 as (select night, l from r2 where i > n)"""


@reg("win_smooth_stages", f"{STAGED}{SMOOTH} select o.night, o.t, f2.l[o.i] as stage from o join f2 using (night)", "vitals", "movement", "sleep_records")
def smooth_stages(vitals, movement, sessions):
    """A-B-A smoothing and transition repair, both left to right in place."""
    return s.fold_stages(staged(vitals, movement, sessions), NIGHT).select(*NIGHT, "t", "stage")


@reg("agg_quality_score", f"{STAGED}, d as (select night, " + ", ".join(f"cast(floor(sum(case when stage = '{x}' then seconds else 0 end) * 100.0 / sum(seconds) + 0.5) as bigint) as {x}" for x in ("wake", "light", "deep", "rem")) + " from e group by 1) select night, greatest(0, least(100, cast(floor(100 - (greatest((15 - deep) * 2.0, 0) + greatest((deep - 30) * 1.5, 0) + greatest((20 - rem) * 1.5, 0) + greatest((rem - 35) * 1.0, 0) + greatest((wake - 5) * 2.0, 0)) + 0.5) as bigint))) as score from d", "vitals", "movement", "sleep_records")
def quality(vitals, movement, sessions):
    return s.quality_score(s.distribution(staged(vitals, movement, sessions), NIGHT)).select(*NIGHT, "score")


@reg("downsample_avg", "select side, (i - 1) // 12 as bin, round(avg(total_movement), 6) as mean from (select side, total_movement, row_number() over (partition by side order by t) as i from movement) group by 1, 2", "movement")
def downsample_avg(movement, step: int = 12):
    rows = g.numbered(movement, SIDE)
    return rows.groupBy("side", F.expr(f"(i - 1) div {step}").cast("long").alias("bin")).agg(rnd(F.avg("total_movement")).alias("mean"))


@reg("fn_units", "select t, round(ambient_temp / 100.0, 6) as c, round(ambient_temp / 100.0 * 9 / 5 + 32, 6) as f, cast(floor(82.5 + (ambient_temp % 201 - 100) / 100.0 * 27.5 + 0.5) as bigint) as level_f, case when ambient_temp / 100.0 - humidity / 150.0 > 0.5 then 'up' when ambient_temp / 100.0 - humidity / 150.0 < -0.5 then 'down' else 'stable' end as trend, cast(floor((greatest(55.0, least(95.0, ambient_temp / 30.0)) - 55) / 40 * 9 + 1 + 0.5) as bigint) as scale from bed_temp where ambient_temp is not null", "bed_temp")
def units_query(bed):
    a = F.col("ambient_temp")
    return bed.filter(a.isNotNull()).select("t", rnd(u.centi_to_c(a)).alias("c"), rnd(u.c_to_f(u.centi_to_c(a))).alias("f"), u.level_to_f(a % 201 - 100).alias("level_f"), u.trend(a / 100, F.col("humidity") / 150).alias("trend"), u.scale_1_10(a / 30).alias("scale"))


@reg("fn_clock", "select id, lpad(cast(t % 86400 // 3600 as varchar), 2, '0') || ':' || lpad(cast(t % 3600 // 60 as varchar), 2, '0') as clock, cast(cast(to_timestamp(t - 14400) at time zone 'UTC' as date) as varchar) as night, cast(cast(to_timestamp(t) at time zone 'UTC' as date) - cast(dayofweek(to_timestamp(t) at time zone 'UTC') as int) as varchar) as week, cast(total_movement * 60 // 3600 as varchar) || 'h ' || cast(total_movement * 60 % 3600 // 60 as varchar) || 'm' as text from movement", "movement")
def clock_query(movement):
    return movement.select("id", u.to_hhmm(u.minute_of_day(F.col("t"))).alias("clock"), u.logical_day(F.col("t")).cast("string").alias("night"), u.week_start(F.to_date(F.timestamp_seconds("t"))).cast("string").alias("week"), u.duration_text(F.col("total_movement") * 60).alias("text"))


@reg("cal_temp", f"select count(*) as n, round(avg(left_outer_temp) - avg(ambient_temp), 6) as outer_offset, round(avg(left_center_temp) - avg(ambient_temp), 6) as center_offset, round(least(1.0, count(*) / 1000.0), 6) as quality from bed_temp where t > {NOW} - 86400 and t <= {NOW} having count(*) >= 10", "bed_temp")
def cal_temp(bed, now: int = NOW):
    rows = bed.filter((F.col("t") > now - 86400) & (F.col("t") <= now))
    off = lambda c: rnd(F.avg(c) - F.avg("ambient_temp"))
    return rows.agg(F.count("*").alias("n"), off("left_outer_temp").alias("outer_offset"), off("left_center_temp").alias("center_offset"), rnd(F.least(F.lit(1.0), F.count("*") / 1000)).alias("quality")).filter("n >= 10")


@reg("proj_surface_signals", "select t, round(list_avg(z), 6) as mean, case when len(z) >= 2 then list_max(z) - list_min(z) end as spread, left_inner_temp - left_outer_temp as gradient from (select *, list_filter([left_outer_temp, left_center_temp, left_inner_temp], lambda x: x is not null) as z from bed_temp)", "bed_temp")
def surface_signals(bed):
    z = F.array_compact(F.array("left_outer_temp", "left_center_temp", "left_inner_temp"))
    mean = F.aggregate("z", F.lit(0.0), lambda a, x: a + x) / F.size("z")
    return bed.withColumn("z", z).select("t", rnd(mean).alias("mean"), F.when(F.size("z") >= 2, F.array_max("z") - F.array_min("z")).alias("spread"), (F.col("left_inner_temp") - F.col("left_outer_temp")).alias("gradient"))


STAGE_NAMES = ("wake", "light", "deep", "rem")


@reg("agg_weekly_nights", STAGED + ", z as (select night, " + ", ".join(f"cast(sum(case when stage = '{x}' then seconds else 0 end) as bigint) as {x}" for x in STAGE_NAMES) + " from e group by 1), k as (select s.id, s.side, cast(to_timestamp(entered) at time zone 'UTC' as date) - case when (entered % 86400) < 21600 then 1 else 0 end as d, duration, z.* exclude (night) from sleep_records s left join z on z.night = s.id), w as (select cast(unnest(generate_series(date '2023-12-31', date '2024-01-06', interval 1 day)) as date) as d) select x.side, cast(w.d as varchar) as night, round(coalesce(sum(duration), 0) / 3600.0, 6) as hours, " + ", ".join(f"cast(coalesce(sum({x}), 0) as bigint) as {x}" for x in STAGE_NAMES) + " from w cross join (select unnest(['left', 'right']) as side) x left join k on k.d = w.d and k.side = x.side group by 1, 2", "vitals", "movement", "sleep_records")
def weekly_nights(vitals, movement, sessions, start: str = "2023-12-31"):
    """A week's nights of each side: hours asleep and seconds in each stage; a night begins before six in the morning."""
    spark = sessions.sparkSession
    grid = spark.sql(f"select side, d from (select explode(sequence(date '{start}', date_add(date '{start}', 6))) as d) lateral view explode(array('left', 'right')) x as side")
    stages = staged(vitals, movement, sessions).groupBy("night").agg(*(F.sum(F.when(F.col("stage") == x, F.col("seconds")).otherwise(0)).alias(x) for x in STAGE_NAMES))
    early = F.when(F.col("entered") % 86400 < 21600, 1).otherwise(0)
    k = sessions.select(F.col("id").alias("night"), "side", F.date_sub(F.to_date(F.timestamp_seconds("entered")), early).alias("d"), "duration").join(stages, "night", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return grid.join(k.drop("night"), ["side", "d"], "left").groupBy("side", F.col("d").cast("string").alias("night")).agg(rnd(total("duration") / 3600).alias("hours"), *(total(x).cast("long").alias(x) for x in STAGE_NAMES))
