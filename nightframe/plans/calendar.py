"""Queries of curves and of recurring times."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as c, curves as cv
from .core import reg

SCHEDULED = {"bed": "case when id % 29 <> 0 then cast(id * 37 % 1440 as int) end", "wake": "cast((id * 53 + 400) % 1440 as int)", "intensity": "case id % 4 when 0 then 'cool' when 1 then 'balanced' when 2 then 'warm' end", "low": "cast(60 + id % 12 as double)", "high": "cast(81 + id % 9 as double)"}
CURVE = f"""
, a as (select id, {', '.join(f'{e} as {k}' for k, e in SCHEDULED.items())} from automations),
d as (select *, case when (wake - bed + 1440) % 1440 = 0 then 1440 else (wake - bed + 1440) % 1440 end as asleep, 80 - low as cool, high - 80 as heat, case intensity when 'cool' then 0.2e0 when 'warm' then 0.5e0 else 0.3e0 end as s0, case intensity when 'cool' then 0.7e0 when 'warm' then 0.4e0 else 0.6e0 end as s1, case intensity when 'cool' then 0.6e0 when 'warm' then 0.3e0 else 0.5e0 end as s2 from a where bed is not null),
e as (select *, least(90e0, asleep * 0.15e0) as ramp, least(60e0, asleep * 0.1e0) as sink, least(210e0, asleep * 0.45e0) as deep_end, floor(heat * s0 + 0.5) as warm, -floor(cool * s1 + 0.5) as fall, -cool as cold, -floor(cool * s2 + 0.5) as keep, heat as hot from d),
f as (select *, least(cast(asleep as double), greatest(deep_end + 75, asleep - 45)) as early_wake from e),
k as (select * from (values {', '.join(f"({i}, '{p}', '{a}', '{s}', {n}, {m}, '{x}', '{y}', {u}, {v})" for i, (p, a, s, n, m, x, y, u, v) in enumerate(cv.KNOTS))}) as k(j, phase, anchor, span, n, m, x, y, p, q)),
g as (select id, bed, j, phase, n, m, p, q, anchor, early_wake > deep_end + 75 as room,
 case anchor when 'early' then -45 when 'bed' then 0 when 'ramp' then ramp when 'deep_middle' then (ramp + sink + deep_end) / 2 when 'deep_end' then deep_end when 'keep_middle' then (deep_end + 45 + early_wake) / 2 when 'early_wake' then early_wake when 'wake' then asleep end as a0,
 case span when 'early_span' then 45 when 'ramp' then ramp when 'sink' then sink when 'rise_span' then 45 when 'wake_span' then greatest(0e0, asleep - early_wake) when 'late_span' then 30 else 0 end as sp,
 case x when 'base' then 0 when 'fall' then fall when 'cold' then cold when 'keep' then keep end as x0, case y when 'warm' then warm when 'fall' then fall when 'cold' then cold when 'keep' then keep when 'hot' then hot end as y0 from f, k),
h as (select id, bed, j, phase, cast(floor(a0 + sp * n / m + 0.5) as int) as minute, cast(floor(x0 + (y0 - x0) * p / q + 0.5) as int) as "offset" from g where anchor <> 'keep_middle' or room),
o as (select *, cast(row_number() over (partition by id order by minute, j) - 1 as int) as i from h)"""


def schedules(automations):
    return automations.selectExpr("id", *(f"{e} as {k}" for k, e in SCHEDULED.items()))


def curves(automations):
    return cv.curves(schedules(automations))


reg("fn_curve", CURVE + ' select id, i, minute, "offset", phase from o', "automations")(lambda a: curves(a).select("id", "i", "minute", "offset", "phase"))


@reg("fn_curve_map", CURVE + ", l as (select id, lpad(cast((bed + minute + 1440) % 1440 // 60 as varchar), 2, '0') || ':' || lpad(cast((bed + minute + 1440) % 1440 % 60 as varchar), 2, '0') as clock, arg_max(80 + \"offset\", i) as degrees from o group by 1, 2) select id, string_agg(clock || '@' || degrees, '|' order by clock) as curve from l group by 1", "automations")
def curve_map(automations):
    """Each automation's curve as set points of the clock."""
    each = schedules(automations.select("id").repartition("id").distinct())
    return cv.with_set_points(each).select("id", cv.as_text(F.col("curve")).alias("curve"))


#: The instant of a wall time: the first of two, with the offset before a gap.
WALL = "case when timezone({1}, to_timestamp(epoch(timezone({1}, {0})) - 3600)) = {0} then cast(epoch(timezone({1}, {0})) as bigint) - 3600 else cast(epoch(timezone({1}, {0})) as bigint) end"


@reg("fn_next_event", f"""
, s as (select owner, day, minute, min(temperature) as temperature from set_points where enabled group by 1, 2, 3),
m as (select id, owner, zone, timezone(zone, to_timestamp(t)) as w from moments),
c as (select m.id, m.zone, s.minute, s.temperature, (s.day - dayofweek(w) + 7) % 7 as days, date_trunc('day', w) as today, hour(w) * 60 + minute(w) as clock from m join s using (owner)),
f as (select *, row_number() over (partition by id order by days, minute) as k from c where days > 0 or minute > clock)
select m.id, {WALL.format("(f.today + to_days(cast(f.days as int)) + to_minutes(cast(f.minute as int)))", "m.zone")} as next_at, f.minute as next_minute, f.temperature as next_temperature from m left join f on f.id = m.id and k = 1""", "set_points", "moments")
def next_event(set_points, moments):
    """The next set point after moments about both changes of the clocks, in two zones."""
    return c.next_event(moments, set_points, ["owner"]).select("id", "next_at", "next_minute", "next_temperature")


FROM, TO = 1709856000, 1709856000 + 26 * 86400


@reg("fn_weekly_cron", f"""
, j as (select *, owner, case when owner % 2 = 0 then 'America/New_York' else 'Europe/Berlin' end as zone from set_points),
d as (select id, zone, cron_day, minute, unnest(generate_series(date_trunc('day', timezone(zone, to_timestamp({FROM}))), date_trunc('day', timezone(zone, to_timestamp({TO}))), interval 1 day)) as day from (select *, case when id % 11 <> 0 then day end as cron_day from j)),
w as (select id, {WALL.format("(day + to_minutes(cast(minute as int)))", "zone")} as runs_at from d where cron_day is null or dayofweek(day) = cron_day)
select id, runs_at from w where runs_at > {FROM} and runs_at <= {TO}""", "set_points")
def weekly_cron(set_points):
    """All runs of weekly and daily jobs over the spring's changes of the clocks."""
    text = c.cron(F.col("minute"), F.when(F.col("id") % 11 != 0, F.col("day")))
    jobs = set_points.select("id", text.alias("cron"), F.when(F.col("owner") % 2 == 0, "America/New_York").otherwise("Europe/Berlin").alias("zone"))
    return c.occurrences(jobs, FROM, TO, name="runs_at").select("id", "runs_at")


LANES_NOW = 1709856000 + 3 * 86400


@reg("fn_day_lanes", f"""
, z as (select cast(epoch(timezone('America/New_York', date_trunc('day', timezone('America/New_York', to_timestamp({LANES_NOW}))))) as bigint) as midnight),
l as (select id, t, cast(floor((t - midnight) / 86400) as int) as lane, midnight from moments, z)
select id, lane, midnight + lane * 86400 as lane_start, row_number() over (partition by lane order by t, id) as place from l where lane between 0 and 6""", "moments")
def lanes(moments):
    """Jobs of the next seven days in lanes from local midnight, in the order of their times."""
    from ..operators import segments as g

    rows = c.day_lanes(moments.select("id", "t"), LANES_NOW, "America/New_York", "t")
    # a lane is a day of jobs: numbered within hours, after the jobs of earlier hours
    rows = g.numbered(rows.withColumn("__order", F.struct("t", "id")), ["lane", "lane_start"], "place", "t", 3600, "__order")
    return rows.select("id", "lane", "lane_start", "place")
