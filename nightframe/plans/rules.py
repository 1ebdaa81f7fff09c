"""Queries of the rule language."""

from __future__ import annotations

from ..operators import rules as r
from .core import reg, rnd

SIGNAL = lambda k: {"kind": "signal", "key": k}
NUMBER = lambda v: {"kind": "literal", "value": v}
CONDITION = {
    "kind": "and",
    "conditions": [
        {"kind": "or", "conditions": [{"kind": "compare", "op": ">", "left": {"kind": "window", "fn": "avg", "signal": "heart_rate", "lastMin": 10}, "right": NUMBER(85)}, {"kind": "between", "value": SIGNAL("hrv"), "min": NUMBER(20), "max": NUMBER(60)}]},
        {"kind": "not", "condition": {"kind": "compare", "op": "<", "left": SIGNAL("heart_rate"), "right": NUMBER(50)}},
        {"kind": "timeBetween", "start": "21:00", "end": "09:30"},
    ],
}
RULE = {"when": CONDITION, "setpoint": {"kind": "binary", "op": "+", "left": {"kind": "binary", "op": "/", "left": SIGNAL("hrv"), "right": NUMBER(4)}, "right": NUMBER(20)}, "band": (60, 75), "cooldown_min": 30}
STEPS = """s as (select id, side, t, heart_rate, hrv, avg(heart_rate) over (partition by side order by t range between 600 preceding and current row) as a from vitals),
h as (select *, (a > 85 or hrv between 20 and 60) and not (heart_rate < 50) and (t % 86400 // 60 >= 1260 or t % 86400 // 60 < 570) as holds, hrv / 4 + 20 as raw, greatest(55, least(110, greatest(60, least(75, hrv / 4 + 20)))) as setpoint from s)"""


@reg("rule_cond", f", {STEPS} select id, holds from h", "vitals")
def rule_cond(vitals):
    return r.evaluate(vitals, RULE).select("id", "holds")


FOLD = f"""{STEPS}, o as (select *, row_number() over (partition by side order by t) as i from h),
f as (select side, i, t, case when coalesce(holds, false) then 'fired' else 'idle' end as outcome, case when coalesce(holds, false) then t else -1000000000 end as last from o where i = 1
 union all select o.side, o.i, o.t, case when coalesce(o.holds, false) then case when o.t - f.last >= 1800 then 'fired' else 'suppressed' end else 'idle' end, case when coalesce(o.holds, false) and o.t - f.last >= 1800 then o.t else f.last end from f join o on o.side = f.side and o.i = f.i + 1)"""


@reg("rule_replay", f", {FOLD} select o.side, o.t, o.holds, round(o.setpoint, 6) as setpoint, o.raw <> o.setpoint as clamped, f.outcome from o join f using (side, i)", "vitals")
def rule_replay(vitals):
    return r.backtest(vitals, RULE)


@reg("rule_replay_summary", f", {FOLD} select o.side, count(*) filter (f.outcome = 'fired') as fires, count(*) filter (f.outcome = 'suppressed') as suppressed, count(*) filter (o.raw <> o.setpoint) as clamped, count(*) as steps from o join f using (side, i) group by 1", "vitals")
def rule_summary(vitals):
    return r.summary(r.backtest(vitals, RULE))


@reg("rule_expr", "select id, case when heart_rate / nullif(hrv, 0) is not null then round(greatest(50.0, least(heart_rate / nullif(hrv, 0) * 10, 90.0)), 6) end as v from vitals", "vitals")
def rule_expr(vitals):
    tree = {"kind": "clamp", "value": {"kind": "binary", "op": "*", "left": {"kind": "binary", "op": "/", "left": SIGNAL("heart_rate"), "right": SIGNAL("hrv")}, "right": NUMBER(10)}, "min": NUMBER(50), "max": NUMBER(90)}
    return vitals.select("id", rnd(r.expression(tree, ["side"])).alias("v"))
