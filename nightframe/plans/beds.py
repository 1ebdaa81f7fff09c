"""Queries of sessions and movement from samples, in one go and as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import beds
from ..sources import shared
from ..sources.views import SPECS, ctes
from ..streaming import beds as stream
from .core import reg
from .registry import ORACLES, QUERIES

LATE = 120
#: Sample by sample. Presence as in the sessionizer: d committed, p pending since, s start, u interval start, l last seen, x exits, ab absent
#: seconds; movement: z last close, m sum, pa to pc the last whole sample, sc scores, md medians, mv the score told; c0 to ca the closed session.
FOLLOWED = """
, lim as (select max(t) - {late} as w from samples),
o as (select *, row_number() over (partition by side order by t) as i from samples, lim where t <= w),
r as (
 select side, cast(0 as bigint) as i, cast(null as bigint) as t, false as d, cast(null as bigint) as p, cast(null as bigint) as s, cast(null as bigint) as u, cast(null as bigint) as l, cast(0 as bigint) as x, cast(0 as bigint) as ab,
  cast(null as bigint) as z, cast(0 as double) as m, cast(null as double) as pa, cast(null as double) as pb, cast(null as double) as pc, cast([] as bigint[]) as sc, cast([] as bigint[]) as md, cast(null as bigint) as mv,
  cast(null as bigint) as c0, cast(null as bigint) as c1, cast(0 as bigint) as cx, cast(0 as bigint) as ca from (select distinct side from samples)
 union all
 select side, i, t, d and not shut, case when not shut then p end, case when not shut then s end, case when not shut then u end, case when not shut then l end, case when shut then 0 else x end, case when shut then 0 else ab end,
  z, case when shut then 0 else m end, case when not shut then pa end, case when not shut then pb end, case when not shut then pc end, case when shut then [] else sc end, case when shut then [] else md end, mv,
  case when shut then s end, case when shut then case when d then s + 57600 else u end end, x, ab
 from (select *, coalesce(s is not null and case when d then t - s >= 57600 else t - l >= 120 end, false) as shut from (
  select side, i, t, d, p, case when d then coalesce(s, edge) else s end as s, case when flip then edge else u end as u, case when d then t else l end as l,
   case when flip and not d then x + 1 else x end as x, case when flip and d and s is not null then ab + edge - u else ab end as ab, z, m, pa, pb, pc, sc, md, mv
  from (select side, i, t, flip, case when flip then p else t end as edge, case when flip then raw else d end as d, case when flip or raw = d then null else coalesce(p, t) end as p, s, u, l, x, ab,
    case when tick then t else z end as z, case when tick then 0 else m end as m, pa, pb, pc, sc, case when told then md else old end as md, case when told then case when len(md) = 3 then list_sort(md)[2] else v end end as mv
   from (select *, case when told then list_slice(list_append(old, v), greatest(1, len(old) - 1), len(old) + 1) end as md
    from (select *, case when told then greatest(0, score - case when len(sc) > 10 then list_sort(sc)[greatest(0, cast(floor(0.05 * len(sc) + 0.5) as bigint) - 1) + 1] else 0 end) end as v
     from (select *, case when told then list_slice(list_append(was, score), greatest(1, len(was) - 28), len(was) + 1) else was end as sc
      from (select *, tick and s is not null as told, cast(least(1000, floor(m * 10)) as bigint) as score
       from (select *, t - z >= 60 as tick from (
        select o.side, o.i, o.t, o.present as raw, r.d, r.p, r.s, r.u, r.l, r.x, r.ab, coalesce(r.z, o.t) as z, r.sc as was, r.md as old, coalesce(o.present <> r.d and o.t - r.p >= 30, false) as flip,
         r.m + case when o.a is not null and r.pa is not null then abs(o.a - r.pa) + abs(o.b - r.pb) + abs(o.c - r.pc) else 0 end as m,
         case when o.a is not null then o.a else r.pa end as pa, case when o.a is not null then o.b else r.pb end as pb, case when o.a is not null then o.c else r.pc end as pc
        from r join o on o.side = r.side and o.i = r.i + 1)))))))))
)
"""
SESSIONS = " select side, c0 as entered, c1 as left_at, c1 - c0 as duration, cx as exits, ca as absent_s from r where c1 - c0 >= 300"
EPOCHS = " select side, t, mv as movement from r where mv is not null"


def samples(view):
    return view.select("side", "t", "present", F.array("a", "b", "c").alias("channels"))


def sessions(told):
    away = F.aggregate("absent", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return beds.sessions(told).select("side", "entered", "left_at", "duration", "exits", away.alias("absent_s"))


def epochs(told):
    return beds.epochs(told).select("side", "t", "movement")


reg("st_session_samples", FOLLOWED.format(late=0) + SESSIONS, "samples")(lambda s: sessions(beds.follow(samples(s), ["side"])))
reg("st_movement_epoch", FOLLOWED.format(late=0) + EPOCHS, "samples")(lambda s: epochs(beds.follow(samples(s), ["side"])))


def streamed(spark, sf_dir):
    """What a stream over the events' file tells until its watermark."""
    table, columns, _ = SPECS["samples"]
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir).selectExpr(*(f"{e.format(div='div')} as {c}" for c, e in columns.items()))
    return stream.run(stream.follow(samples(rows), ["side"], f"{LATE} seconds"), shared.folder(spark, "told"), shared.folder(spark, "state"))


for _name, _of, _sql in (("stream_session", sessions, SESSIONS), ("stream_movement_epoch", epochs, EPOCHS)):
    QUERIES[_name] = lambda spark, d, of=_of: of(streamed(spark, d))
    ORACLES[_name] = ctes("samples") + FOLLOWED.format(late=LATE) + _sql
