"""Queries of the rule engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import engine as e
from .core import reg, rnd
from .rules import NUMBER, SIGNAL

DIVIDED = lambda key, by, plus: {"kind": "binary", "op": "+", "left": {"kind": "binary", "op": "/", "left": SIGNAL(key), "right": NUMBER(by)}, "right": NUMBER(plus)}
RULES = [
    {"id": "calm", "trigger": {"kind": "tick", "everyMin": 5}, "conditions": {"kind": "compare", "op": ">", "left": SIGNAL("heart_rate"), "right": NUMBER(85)}, "actions": [{"kind": "setTemperature", "temp": DIVIDED("hrv", 4, 20), "clamp": (60, 75)}], "side": "left", "cooldownMin": 30},
    {"id": "follow", "trigger": {"kind": "signalChange", "signal": "moved"}, "conditions": {"kind": "compare", "op": ">", "left": SIGNAL("moved"), "right": NUMBER(300)}, "actions": [{"kind": "setTemperature", "temp": DIVIDED("moved", 20, 50)}]},
    {"id": "evening", "trigger": {"kind": "timeOfDay", "at": "22:00"}, "conditions": {"kind": "and", "conditions": []}, "actions": [{"kind": "setTemperature", "temp": NUMBER(70)}], "side": "right", "dryRun": True},
]

HELD = "exists (select 1 from device_state d where d.side = '{0}' and d.t <= v.t and v.t - d.t < 1800)"
#: Evaluation by evaluation: f the last fire of each rule, x which are off, a each one's actions of the last hour, l and r what was sent last.
AUDIT = f"""
, k as (select v.t, v.heart_rate, v.hrv, cast(m.total_movement as double) as moved, {HELD.format('left')} as hl, {HELD.format('right')} as hr from vitals v join movement m on m.side = 'left' and m.t = v.t where v.side = 'left'),
n as (select *, moved <> lag(moved) over (order by t) as changed, t - min(t) over () as since, t % 86400 // 60 between 1320 and 1330 as slot, row_number() over (partition by t // 86400, t % 86400 // 60 between 1320 and 1330 order by t) as j from k),
o as (select *, row_number() over (order by t, place) as i from (
 select t, hl, hr, 0 as place, heart_rate > 85 as holds, hrv / 4 + 20 as raw, greatest(60e0, least(75e0, hrv / 4 + 20)) as temp, 1800 as cool from n where since % 300 = 0
 union all select t, hl, hr, 1, moved > 300, moved / 20 + 50, greatest(60e0, least(100e0, moved / 20 + 50)), null from n where changed
 union all select t, hl, hr, 2, true, 70e0, 70e0, null from n where slot and j = 1)),
z as (select cast(0 as bigint) as i, cast(null as bigint) as t, 0 as place, cast([null, null, null] as bigint[]) as f, [false, false, false] as x, cast([[], [], []] as bigint[][]) as a, cast(null as double) as l, cast(null as double) as r, '' as outcome, cast(null as varchar) as reason, cast(null as double) as temp, 0 as writes
 union all
 select i, t, place, list_transform(range(1, 4), lambda q: case when q = place + 1 and outcome in ('fired', 'clamped', 'dry_run') then t else f[q] end), list_transform(range(1, 4), lambda q: x[q] or (q = place + 1 and coalesce(reason = 'runaway-disabled', false))),
  list_transform(range(1, 4), lambda q: case when q <> place + 1 then a[q] when passed then list_concat(recent, list_transform(range(0, writes), lambda w: t)) else a[q] end),
  case when passed and wl = 'sent' then temp else l end, case when passed and wr = 'sent' then temp else r end, outcome, reason, case when passed and not away then temp end, case when passed then writes else 0 end
 from (select *, case when gone then '' when why is not null then 'skipped' when away then 'error' when wl = 'dry' or wr = 'dry' then 'dry_run' when not (coalesce(wl in ('sent', 'same'), false) or coalesce(wr in ('sent', 'same'), false)) then 'skipped' when temp <> raw then 'clamped' else 'fired' end as outcome,
   case when gone then null when why is not null then why when away then 'runaway-disabled' when coalesce(wl in ('sent', 'same', 'dry'), false) or coalesce(wr in ('sent', 'same', 'dry'), false) then null else coalesce(wl, wr) end as reason,
   (case when wl = 'sent' then 1 else 0 end) + (case when wr = 'sent' then 1 else 0 end) as writes
  from (select *, not gone and why is null as passed, not gone and why is null and len(recent) >= 12 as away, case when not gone and why is null and len(recent) < 12 and place < 2 then case when raw is null then 'temp-unknown' when hl then 'manual-override' when abs(temp - l) < 0.5 then 'same' else 'sent' end end as wl,
    case when not gone and why is null and len(recent) < 12 and place > 0 then case when raw is null then 'temp-unknown' when hr then 'manual-override' when abs(temp - r) < 0.5 then 'same' when place = 2 then 'dry' else 'sent' end end as wr
   from (select o.*, z.f, z.x, z.a, z.l, z.r, z.x[o.place + 1] as gone, list_filter(z.a[o.place + 1], lambda y: o.t - y < 3600) as recent,
     case when holds is null then 'condition-unknown' when not holds then 'condition-false' when o.t - z.f[o.place + 1] < cool then 'cooldown' end as why
    from z join o on o.i = z.i + 1))))
"""


@reg("rule_eval", AUDIT + " select t, case place when 0 then 'calm' when 1 then 'follow' else 'evening' end as rule, outcome, reason, round(temp, 6) as temp, writes from z where outcome <> ''", "vitals", "movement", "device_state")
def rule_eval(vitals, movement, device):
    """The audit of three rules over a device's ticks, held back for half an hour by every change of its state."""
    moved = movement.filter("side = 'left'").select("t", F.col("total_movement").cast("double").alias("moved"))
    ticks = vitals.filter("side = 'left'").select("t", "heart_rate", "hrv").join(moved, "t").withColumn("device", F.lit("pod"))
    manual = device.select(F.lit("pod").alias("device"), "t", "side")
    out = e.runs(e.overridden(ticks, manual, ["device"]), RULES, ["device"])
    return out.select("t", "rule", "outcome", "reason", rnd("temp").alias("temp"), "writes")


TRIGGERS = {"tick": {"kind": "tick", "everyMin": 10}, "changed": {"kind": "signalChange", "signal": "heart_rate"}, "at_time": {"kind": "timeOfDay", "at": "22:00"}}


@reg("rule_trigger", """, g as (select * from vitals where t // 60 % 7 <> 3),
w as (select *, last_value(heart_rate ignore nulls) over (partition by side order by t rows between unbounded preceding and 1 preceding) as was, t % 86400 // 60 between 1320 and 1330 as slot, row_number() over (partition by side order by t) as i from g),
s as (select *, row_number() over (partition by side, t // 86400, slot order by t) as j from w),
c as (select side, i, t, t as last from w where i = 1 union all select w.side, w.i, w.t, case when w.t - c.last >= 600 then w.t else c.last end from c join w on w.side = c.side and w.i = c.i + 1)
select id, c.last = s.t as tick, coalesce(heart_rate <> was, false) as changed, slot and j = 1 as at_time from s join c using (side, i)""", "vitals")
def rule_trigger(vitals):
    """When rules are looked at, over ticks with gaps: every ten minutes, when the last known rate has changed, once a day at 22:00 with ten minutes' grace."""
    rows = vitals.filter("t div 60 % 7 <> 3").select("id", "side", "t", "heart_rate")
    for name, trigger in TRIGGERS.items():
        rows = e.triggered(rows, trigger, ["side"], name)
    return rows.select("id", *TRIGGERS)
