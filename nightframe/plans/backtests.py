"""Queries of the back-test over recorded nights."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import backtest as b
from .core import reg
from .rules import NUMBER, SIGNAL

EDGE = {
    "trigger": {"kind": "signalChange", "signal": "left.movement"}, "cooldownMin": 20,
    "conditions": {"kind": "and", "conditions": [{"kind": "compare", "op": ">", "left": {"kind": "window", "fn": "avg", "signal": "left.movement", "lastMin": 10}, "right": NUMBER(200)}, {"kind": "not", "condition": {"kind": "compare", "op": ">", "left": SIGNAL("left.heartRate"), "right": NUMBER(120)}}]},
    "actions": [{"kind": "setTemperature", "temp": {"kind": "binary", "op": "-", "left": SIGNAL("left.currentTemperature"), "right": NUMBER(2)}, "durationSec": 900, "clamp": (65, 90)}],
}
POLICY = {
    "trigger": {"kind": "tick", "everyMin": 1}, "cooldownMin": None,
    "conditions": {"kind": "timeBetween", "start": "03:00", "end": "07:00"},
    "actions": [{"kind": "setTemperature", "temp": {"kind": "binary", "op": "+", "left": SIGNAL("ambient.temperature"), "right": NUMBER(3)}, "clamp": (64, 80)}],
}
VIEWS = ("movement", "vitals", "bed_temp", "sleep_records")


def recorded(movement, vitals, bed_temp):
    """(side, signal, t, value) with gaps: the side's own signals under the names that a rule for the left side gives them."""
    m = movement.filter("t div 1800 % 5 <> 2").select("side", F.lit("left.movement").alias("signal"), "t", F.col("total_movement").cast("double").alias("value"))
    h = vitals.filter("t div 1200 % 4 <> 1").select("side", F.lit("left.heartRate").alias("signal"), "t", F.col("heart_rate").alias("value"))
    side = F.explode(F.array(F.lit("left"), F.lit("right")))
    a = bed_temp.filter("t div 2400 % 3 <> 1").select(side.alias("side"), F.lit("ambient.temperature").alias("signal"), "t", (F.col("ambient_temp") / 100 * 9 / 5 + 32).alias("value"))
    return m.union(h).union(a)


def nights(sessions):
    return sessions.filter("left_at is not null").select("side", F.col("id").alias("night"), F.col("entered").alias("start"), F.col("left_at").alias("end"))


STEPS = """
, g as (select side, id as night, entered as start, unnest(range(entered, left_at + 1, 60)) as t from sleep_records where left_at is not null),
m as (select side, t, cast(total_movement as double) as v from movement where t // 1800 % 5 <> 2),
h as (select side, t, heart_rate as v from vitals where t // 1200 % 4 <> 1 and heart_rate is not null),
a as (select t, ambient_temp / 100 * 9 / 5 + 32 as v from bed_temp where t // 2400 % 3 <> 1 and ambient_temp is not null),
s as (select g.side, g.night, g.t, cast((g.t - start) // 60 as int) as i, g.t % 86400 // 60 as clock_min, case when g.t - m.t <= 900 then m.v end as mv, case when g.t - h.t <= 900 then h.v end as hv, case when g.t - a.t <= 900 then a.v end as av
 from g asof left join m on m.side = g.side and m.t <= g.t asof left join h on h.side = g.side and h.t <= g.t asof left join a on a.t <= g.t)"""
EDGES = STEPS + """
, w as (select *, avg(mv) over (partition by side, night order by t range between 600 preceding and current row) as av10, last_value(mv ignore nulls) over (partition by side, night order by t rows between unbounded preceding and 1 preceding) as was from s),
c as (select *, coalesce(mv <> was, false) and coalesce(av10 > 200 and not (hv > 120), false) as hit from w),
f as (select side, night, i, t, hit as fired, case when hit then t end as at from c where i = 0
 union all select c.side, c.night, c.i, c.t, c.hit and coalesce(c.t - f.at >= 1200, true), case when c.hit and coalesce(c.t - f.at >= 1200, true) then c.t else f.at end from f join c on c.side = f.side and c.night = f.night and c.i = f.i + 1),
z as (select c.*, f.fired, max(case when f.fired then 1 else 0 end) over (partition by c.side, c.night order by c.t rows between 14 preceding and current row) = 1 as active from c join f using (side, night, i)),
e as (select side, night, i, t, cast(clock_min as int) as clock_min, mv as "primary", round(av10, 6) as avg, case when active then 76.0e0 else 78.0e0 end as setpoint, cast(null as double) as setpoint_raw, case when fired then 'fired' when hit then 'suppressed' else '' end as outcome from z)"""
POLICIES = STEPS + """
, r as (select *, case when clock_min between 180 and 419 then av + 3 end as raw from s),
e as (select side, night, i, t, cast(clock_min as int) as clock_min, round(av, 6) as "primary", cast(null as double) as avg, floor(greatest(64.0e0, least(80.0e0, raw)) * 10 + 0.5) / 10 as sp, floor(raw * 10 + 0.5) / 10 as setpoint_raw, '' as outcome, raw from r)"""
SUMMARY = """ select side, night, '{0}' as mode, count(*) filter (outcome = 'fired') as would_fire, count(*) filter (outcome = 'suppressed') as suppressed, count(*) filter (abs(setpoint_raw - setpoint) > 0.05) as clamp_hits, '{1}' as label, {2} as net_effect,
 round(least(0.0e0, {3}), 6) as axis_min, ceil({4} / 100) * 100 as axis_max, '{5}' as unit, floor(least(min(setpoint), coalesce(min(setpoint_raw), min(setpoint))) - 1) as temp_min, ceil(greatest(max(setpoint), coalesce(max(setpoint_raw), max(setpoint))) + 1) as temp_max,
 least(min(setpoint), coalesce(min(setpoint_raw), min(setpoint))) as set_low, greatest(max(setpoint), coalesce(max(setpoint_raw), max(setpoint))) as set_high from e group by 1, 2"""
SETPOINT = "case when raw is not null then sp end as setpoint"


def tested(rule):
    def run(movement, vitals, bed_temp, sessions):
        return b.steps(nights(sessions), recorded(movement, vitals, bed_temp), rule, ["side", "night"])

    return run


def smooth(df):
    return df.withColumns({c: F.round(c, 6) for c in ("primary", "avg")})


reg("rule_backtest", EDGES + " select * from e", *VIEWS)(lambda *v: smooth(tested(EDGE)(*v)))
reg("rule_backtest_policy", POLICIES + f" select * exclude (sp, raw), {SETPOINT} from e", *VIEWS)(lambda *v: smooth(tested(POLICY)(*v)))


@reg("rule_backtest_summary", EDGES + SUMMARY.format("edge", "Edge-triggered", "'-2°F · 15m'", "min(least(\"primary\", avg, 200))", "max(greatest(\"primary\", avg, 200))", ""), *VIEWS)
def edge_summary(*views):
    return b.summary(smooth(tested(EDGE)(*views)), EDGE, ["side", "night"])


@reg("rule_backtest_policy_summary", POLICIES.replace("e as (select", "x as (select") + f", e as (select * exclude (sp, raw), {SETPOINT} from x)" + SUMMARY.format("policy", "Continuous", "cast(null as varchar)", 'min("primary")', 'max("primary")', "°F"), *VIEWS)
def policy_summary(*views):
    return b.summary(smooth(tested(POLICY)(*views)), POLICY, ["side", "night"])
