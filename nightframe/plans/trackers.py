"""Queries of the trackers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import trackers as tr
from .core import reg, rnd

NEAR = "exp(-0.5 * pow(({0} - m) / 15, 2)) > 0.3"
#: Candidate by candidate: h the remembered rates, k the misses in a row, v the rate told.
TRACK = f"""
, o as (select side, t, heart_rate as c, row_number() over (partition by side order by t) as i from vitals),
r as (select side, cast(0 as bigint) as i, cast(null as bigint) as t, cast([] as double[]) as h, 0 as k, cast(null as double) as v from (select distinct side from vitals)
 union all
 select side, i, t, case when c is null then h when v is not null then list_slice(list_append(h, v), greatest(1, len(h) - 3), len(h) + 1) when k = 2 then [c] else h end,
  case when c is null then k when v is not null then 0 when k = 2 then 0 else k + 1 end, case when c is not null then coalesce(v, c) end
 from (select *, case when c is null then null when len(h) = 0 or {NEAR.format('c')} then c when c / 2 between 40 and 120 and {NEAR.format('c / 2')} then c / 2 when c * 2 between 40 and 180 and {NEAR.format('c * 2')} then c * 2 end as v
  from (select o.side, o.i, o.t, o.c, r.h, r.k, list_aggregate(r.h, 'median') as m from r join o on o.side = r.side and o.i = r.i + 1)))
"""


@reg("st_hr_tracker", TRACK + " select side, t, v as rate from r where i > 0", "vitals")
def hr_tracker(vitals):
    """Heart rates with harmonics put right."""
    return tr.heart_rates(vitals.select("side", "t", F.col("heart_rate").alias("rate")), ["side"])


#: Record by record: b the baseline, n its records, u the end of the guard, d whether the record is dropped.
GATE = """
, o as (select device, t, "left" as l, "right" as r, row_number() over (partition by device order by t) as i from piezo),
f as (select device, cast(0 as bigint) as i, cast(null as bigint) as t, cast(null as double) as b, 0 as n, cast(null as bigint) as u, false as d from (select distinct device from piezo)
 union all
 select device, i, t, case when g or z or p then b when b is null then a when a < b * 3 then case when n + 1 < 10 then least(0.95e0 * b + 0.05e0 * a, a) else 0.95e0 * b + 0.05e0 * a end else b end,
  case when g or z or p then n when b is null then 1 when a < b * 3 then n + 1 else n end, case when p then t + 5 else u end, g or p
 from (select *, coalesce(not g and not z and b > 0 and least(l, r) / greatest(l, r) > 0.5 and greatest(l, r) / b > 10, false) as p
  from (select o.device, o.i, o.t, o.l, o.r, (o.l + o.r) / 2 as a, f.b, f.n, f.u, coalesce(o.t < f.u, false) as g, o.l = 0 or o.r = 0 as z from f join o on o.device = f.device and o.i = f.i + 1)))
"""


@reg("st_pump_gate_energy", GATE + " select device, t, d as dropped, round(b, 9) as baseline from f where i > 0", "piezo")
def pump_gate_energy(piezo):
    """Records of which both channels jump together, dropped with the seconds after them."""
    return tr.energy_gate(piezo, ["device"]).select("device", "t", "dropped", rnd(F.col("baseline"), 9).alias("baseline"))
