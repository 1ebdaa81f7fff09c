"""Queries of sessions of presence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sessions as ss
from .core import reg

#: The sessionizer sample by sample: d committed, p pending since, s start, b interval start, l last seen, x exits, a absent seconds; c0.. the closed session.
STEPS = """
, o as (select side, t, total_movement >= 70 as raw, row_number() over (partition by side order by t) as i from movement),
r as (
 select side, cast(0 as bigint) as i, cast(null as bigint) as t, false as d, cast(null as bigint) as p, cast(null as bigint) as s, cast(null as bigint) as b,
  cast(null as bigint) as l, cast(0 as bigint) as x, cast(0 as bigint) as a, cast(null as bigint) as c0, cast(null as bigint) as c1, cast(0 as bigint) as cx, cast(0 as bigint) as ca from (select distinct side from movement)
 union all
 select side, i, t, d and not shut, case when not shut then p end, case when not shut then s end, case when not shut then b end, case when not shut then l end,
  case when shut then 0 else x end, case when shut then 0 else a end, case when shut then s end, case when shut then case when d then s + 57600 else b end end, x, a
 from (select *, coalesce(s is not null and case when d then t - s >= 57600 else t - l >= 120 end, false) as shut from (
  select side, i, t, d, p, case when d then coalesce(s, edge) else s end as s, case when flip then edge else b end as b, case when d then t else l end as l,
   case when flip and not d then x + 1 else x end as x, case when flip and d and s is not null then a + edge - b else a end as a
  from (select side, i, t, flip, case when flip then p else t end as edge, case when flip then raw else d end as d,
    case when flip or raw = d then null else coalesce(p, t) end as p, s, b, l, x, a
   from (select o.side, o.i, o.t, o.raw, r.d, r.p, r.s, r.b, r.l, r.x, r.a, coalesce(o.raw <> r.d and o.t - r.p >= 30, false) as flip from r join o on o.side = r.side and o.i = r.i + 1))))
)
"""


def present(movement):
    return movement.select("side", "t", (F.col("total_movement") >= 70).alias("present"))


@reg("st_session", STEPS + " select side, c0 as entered, c1 as left_at, c1 - c0 as duration, cx as exits, ca as absent_s from r where c1 - c0 >= 300", "movement")
def session(movement):
    """Sessions of movement, with the seconds out of bed."""
    out = ss.sessions(present(movement), ["side"])
    away = F.aggregate("absent", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return out.select("side", "entered", "left_at", "duration", "exits", away.alias("absent_s"))
