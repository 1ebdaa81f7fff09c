"""Queries of guards, of checked vitals, calibrations over midnight, occupancy, signals and retention."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import frames as f, units as u
from ..operators import guards as gd, patterns as p, segments as g, store as s
from ..sources.views import START, ctes, view
from .core import NOW, _clean_sql, reg, rnd, sensor
from .frames import CHANNELS, channels
from .lists import profiles
from .registry import ORACLES, QUERIES
from .sequences import PUMPS, each_pump

SIDES = ("left", "right")


@reg("st_stall_guard", f""", {PUMPS},
a as (select p.side, p.t, p.rpm, coalesce(d.powered and p.t - d.t <= 86400, false) as act, row_number() over (partition by p.side order by p.t) as i from p asof left join device_state d on d.side = p.side and d.t <= p.t),
r as (select side, cast(0 as bigint) as i, cast(null as bigint) as t, 0 as low, 0 as well, false as b, cast(null as varchar) as event from (select distinct side from a)
 union all
 select side, i, t, case when b then case when up then 0 else low end when down then 0 when act and rpm < 50 then low + 1 else 0 end, case when down or up then 0 when b and rpm >= 1000 then well + 1 else 0 end, case when b then not up else down end, case when up then 'recover' when down then 'trip' end
 from (select a.side, a.i, a.t, a.rpm, a.act, r.low, r.well, r.b, r.b and a.rpm >= 1000 and r.well + 1 >= 8 as up, not r.b and a.act and a.rpm < 50 and r.low + 1 >= 5 as down from r join a on a.side = r.side and a.i = r.i + 1))
select side, t, event from r where event is not null""", "flow", "device_state")
def stall_guard(flow, device):
    """Both pumps' guards; a pump should run while its side was last switched on."""
    on = device.select("side", "t", F.col("powered").cast("double").alias("active"))
    frames = p.asof_backward(each_pump(flow).select("side", "t", "rpm"), on, ["side"], "t", "active", g.DAY)
    return gd.stall_guard(frames.withColumn("active", F.col("active") > 0), ["side"])


FLOWS = ", ".join(f"last_value({x}_flow ignore nulls) over (order by t rows between unbounded preceding and 1 preceding) as {x}_was" for x in SIDES)


@reg("st_flow_anomaly", f", w as (select *, {FLOWS} from flow) select t, unnest(list_filter([" + ", ".join(f"case when {x}_flow is null and {x}_rpm >= 50 then '{x}_missing' end, case when {x}_rpm >= 50 and abs({x}_flow) < 5 then '{x}_no_flow' end, case when abs({x}_flow - {x}_was) > 500 then '{x}_spike' end" for x in SIDES) + ", case when abs(left_flow - right_flow) > 300 and abs(left_flow) > 5 and abs(right_flow) > 5 then 'asymmetry' end], lambda x: x is not null)) as anomaly from w", "flow")
def flow_anomaly(flow):
    """What is wrong with each frame's flows: missing, none, a jump from the last known one, sides apart."""
    rows, kinds = flow, []
    for x in SIDES:
        rows = gd.last_before(rows, [], f"{x}_flow", f"{x}_was")
        now, on = F.col(f"{x}_flow"), F.col(f"{x}_rpm") >= 50
        kinds += [F.when(now.isNull() & on, f"{x}_missing"), F.when(on & (F.abs(now) < 5), f"{x}_no_flow"), F.when(F.abs(now - F.col(f"{x}_was")) > 500, f"{x}_spike")]
    left, right = (F.col(f"{x}_flow") for x in SIDES)
    kinds.append(F.when((F.abs(left - right) > 300) & (F.abs(left) > 5) & (F.abs(right) > 5), "asymmetry"))
    return rows.select("t", F.explode(F.array_compact(F.array(*kinds))).alias("anomaly"))


#: A side's power, exemption and what is sensed, derived from its movement and rate.
POWERED, EXEMPT, ON_AT = f"(t - {START}) {{div}} 7200 % 4 <> 3", f"(t - {START}) {{div}} 3600 % 11 = 5", f"{START} + (t - {START}) {{div}} 28800 * 28800"
PRESENCE = "case when heart_rate is null then 'unknown' when total_movement >= 150 then 'occupied' else 'empty' end"


@reg("st_auto_off", ", k as (select v.side, v.t, {0} as powered, {1} as exempt, {2} as on_at, {3} as presence, row_number() over (partition by v.side order by v.t) as i from (select vitals.side, vitals.t, heart_rate, total_movement from vitals join movement using (side, t)) v),".format(*(x.format(div="//") for x in (POWERED, EXEMPT, ON_AT)), PRESENCE) + """
r as (select side, cast(0 as bigint) as i, cast(null as bigint) as t, cast(null as bigint) as since, cast(null as bigint) as off, cast(null as varchar) as reason from (select distinct side from k)
 union all
 select side, i, t, case when idle or capped or timed or presence <> 'empty' then null else coalesce(since, t) end, case when capped or timed then on_at else off end, case when capped then 'max_on' when timed then 'empty' end
 from (select *, not idle and not capped and presence = 'empty' and coalesce(t - since >= 300, false) as timed from (select *, not idle and t - on_at > 18000 and t - on_at <= 604800 as capped from (
  select k.*, r.since, r.off, not powered or exempt or coalesce(r.off = k.on_at, false) as idle from r join k on k.side = r.side and k.i = r.i + 1))))
select side, t, reason from r where reason is not null""", "vitals", "movement")
def auto_off(vitals, movement):
    """Sides switched off after five empty minutes or five hours, run-once sessions left alone."""
    rows = vitals.select("side", "t", "heart_rate").join(movement.select("side", "t", "total_movement"), ["side", "t"])
    ticks = rows.selectExpr("side", "t", *(f"{e.format(div='div')} as {n}" for e, n in ((POWERED, "powered"), (EXEMPT, "exempt"), (ON_AT, "on_at"), (PRESENCE, "presence"))))
    return gd.auto_off(ticks, ["side"], 5, max_on_hours=5)


HELD = "h as (select side, t, a, b, c, ref, {0} as pa, {1} as pb, {2} as pc from samples)".format(*(f"last_value(case when a is not null then {x} end ignore nulls) over (partition by side order by t rows between unbounded preceding and 1 preceding)" for x in "abc"))
DELTAS = "d as (select side, t, ref, case when a is not null and pa is not null then [abs(a - pa), abs(b - pb), abs(c - pc)] end as deltas from h)"


@reg("win_abs_delta", f", {HELD}, {DELTAS} select side, t, round(coalesce(list_sum(deltas), 0), 9) as delta from d", "samples")
def abs_delta(samples):
    """Movement between samples: all channels, compared with the last whole sample."""
    rows = gd.deltas(samples, ["side"], ["a", "b", "c"])
    return rows.select("side", "t", rnd(gd.total(F.col("deltas")), 9).alias("delta"))


@reg("st_pump_gate_cap", f""", {PUMPS}, {HELD}, {DELTAS},
o as (select * from (select *, lag(rpm) over (partition by side order by t) as was from p) where rpm <= 0 and was > 0),
j as (select d.*, coalesce(p.rpm, 0) > 0 or coalesce(d.t - o.t < 3, false) or coalesce(abs(ref - 1.16e0) > 0.02 and len(list_filter(deltas, lambda x: x > abs(ref - 1.16e0) * 0.5)) >= 2, false) as gated from d asof left join p on p.side = d.side and p.t <= d.t asof left join o on o.side = d.side and o.t <= d.t)
select side, t, gated, round(case when gated then 0 else coalesce(list_sum(deltas), 0) end, 9) as movement from j""", "samples", "flow")
def pump_gate_cap(samples, flow):
    """Movement without what the pumps cause."""
    moved = gd.deltas(samples, ["side"], ["a", "b", "c"]).select("side", "t", "ref", "deltas")
    return gd.pump_gate(moved, each_pump(flow), ["side"]).select("side", "t", "gated", rnd("movement", 9).alias("movement"))


LIMITS = {"heart_rate": (30, 100), "hrv": (8, 100), "breathing_rate": (6, 22)}
VALID = ", k as (select *, case when heart_rate between 30 and 100 then heart_rate end as hr, case when hrv between 8 and 100 then hrv end as hv, case when breathing_rate between 6 and 22 then breathing_rate end as br from vitals)"


@reg("val_hr", VALID + f""", r as (select id, list_sort(list(hr) over (partition by side order by t rows between 300 preceding and 1 preceding)) as l from k where hr is not null),
q as (select id, len(l) as n, l[greatest(0, cast(floor(len(l) * 0.1e0) as bigint)) + 1] as lo, l[least(len(l) - 1, cast(floor(len(l) * 0.9e0) as bigint)) + 1] as hi from r),
b as (select id, case when coalesce(n, 0) < 30 then 30 else greatest(30, case when hi - lo < 15 then (hi + lo) / 2 - 7.5 else lo end) end as lo, case when coalesce(n, 0) < 30 then 100 else least(100, case when hi - lo < 15 then (hi + lo) / 2 + 7.5 else hi end) end as hi from q),
p as (select side, max(t) as t from calibrations where status = 'completed' and sensor = 'piezo' group by 1),
z as (select k.*, hr is not null and not (hr between lo and hi) as outside, coalesce(greatest(0, least(1, 1 - (({NOW} - p.t) / 3600.0 - 12) / 36)), 0.3) as fresh from k left join b using (id) left join p on p.side = k.side)
select id, hr as heart_rate, hv as hrv, br as breathing_rate, array_to_string(list_filter([case when heart_rate is not null and hr is null then 'hr_out_of_bounds' end, case when outside then 'hr_dynamic_bounds' end, case when hrv is not null and hv is null then 'hrv_out_of_bounds' end, case when breathing_rate is not null and br is null then 'br_out_of_bounds' end], lambda x: x is not null), ',') as flags,
 round(0.2 + 0.3 * case when hr is null then 0 when outside then 0.5 else 1 end + 0.15 * fresh + 0.15 * case when hrv is null and breathing_rate is null then 0.5 else ((case when hv is not null then 1 else 0 end) + (case when br is not null then 1 else 0 end)) / ((case when hrv is not null then 1 else 0 end) + (case when breathing_rate is not null then 1 else 0 end)) end, 6) as quality from z""", "vitals", "calibrations")
def val_hr(vitals, calibrations, now: int = NOW):
    """Vitals within hard limits, flags (also of rates outside the last 300 sound ones' middle), and a quality of signal, bounds, calibration age and plausibility."""
    ok = {c: F.when(F.col(c).between(*b), F.col(c)) for c, b in LIMITS.items()}
    rows = vitals.withColumns({f"ok_{c}": v for c, v in ok.items()})
    recent = g.carried(rows.filter("ok_heart_rate is not null").select("id", "side", "t", "ok_heart_rate"), ["side"], before=300)
    recent = g.own(recent.withColumn("l", F.array_sort(F.collect_list("ok_heart_rate").over(g.within(["side"]).rowsBetween(-300, -1)))))
    at = lambda q: F.try_element_at("l", F.least(F.size("l"), F.floor(F.size("l") * q).cast("int") + 1))
    lo, hi = at(0.1), at(0.9)
    narrow, mid = hi - lo < 15, (lo + hi) / 2
    few = F.size("l") < 30
    low = F.when(few, 30.0).otherwise(F.greatest(F.lit(30.0), F.when(narrow, mid - 7.5).otherwise(lo)))
    high = F.when(few, 100.0).otherwise(F.least(F.lit(100.0), F.when(narrow, mid + 7.5).otherwise(hi)))
    bounds = recent.select("id", (~F.col("ok_heart_rate").between(low, high)).alias("outside"))
    age = profiles(calibrations).filter("sensor = 'piezo'").select("side", ((now - F.col("t")) / 3600).alias("age"))
    rows = rows.join(bounds, "id", "left").join(F.broadcast(age), "side", "left")  # a row for each side
    outside = F.coalesce("outside", F.lit(False))
    flag = lambda c, name: F.when(F.col(c).isNotNull() & F.col(f"ok_{c}").isNull(), name)
    flags = F.array_compact(F.array(flag("heart_rate", "hr_out_of_bounds"), F.when(outside, "hr_dynamic_bounds"), flag("hrv", "hrv_out_of_bounds"), flag("breathing_rate", "br_out_of_bounds")))
    held = F.when(F.col("ok_heart_rate").isNull(), 0.0).when(outside, 0.5).otherwise(1.0)
    fresh = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - (F.col("age") - 12) / 36)), F.lit(0.3))
    count = lambda *c: sum(F.col(x).isNotNull().cast("int") for x in c)
    plausible = F.coalesce(F.try_divide(count("ok_hrv", "ok_breathing_rate"), count("hrv", "breathing_rate")), F.lit(0.5))
    quality = 0.4 * F.lit(0.5) + 0.3 * held + 0.15 * fresh + 0.15 * plausible
    return rows.select("id", *(F.col(f"ok_{c}").alias(c) for c in LIMITS), F.array_join(flags, ",").alias("flags"), rnd(quality).alias("quality"))


@reg("cal_piezo", ", q as (select side, t, round(var_pop(total_movement) over w, 6) as v, avg(total_movement) over w as mean, sqrt(avg(total_movement * total_movement) over w) as rms, count(*) over w as n from movement window w as (partition by side order by t rows between current row and 299 following)), b as (select *, row_number() over (partition by side order by v, t) as k from q where n = 300) select side, round(mean, 6) as mean, round(greatest(50000.0, 6 * rms), 6) as threshold, round(1 - mean / greatest(50000.0, 6 * rms), 6) as quality from b where k = 1", "movement")
def cal_piezo(movement, width: int = 300):
    """Threshold of presence from the quietest run of records, the first of equals; runs lie anywhere in the series."""
    rows = g.spreads(movement.select("side", "t", "total_movement"), ["side"], ["total_movement"], width).filter("n is not null")
    mean, var = F.col("mean_total_movement"), F.col("var_total_movement")
    best = rows.groupBy("side").agg(F.min(F.struct(rnd(var).alias("v"), "t", mean.alias("mean"), F.sqrt(var + mean * mean).alias("rms"))).alias("b"))
    threshold = F.greatest(F.lit(50000.0), 6 * F.col("b.rms"))
    return best.select("side", rnd("b.mean").alias("mean"), rnd(threshold).alias("threshold"), rnd(1 - F.col("b.mean") / threshold).alias("quality"))


def occupancy(spark, sf_dir, now: int = NOW, stale: int = 30, threshold: float = 0.05):
    """Each side's occupancy: movement of a quarter of an hour, or the level of its newest frame above its profile where that is fresh."""
    movement = view(spark, sf_dir, "movement")
    frames = channels(spark, sf_dir).select(F.when(F.col("vec_id") % 2 == 0, "left").otherwise("right").alias("side"), (now - F.col("vec_id") * 11).alias("t"), F.transform("c", lambda x: x + 1).alias("c"))
    zones = frames.withColumn("z", f.compensated(F.col("c"), 1.0))
    profile = zones.groupBy("side").agg(*(F.avg(F.col("z")[i]).alias(f"m{i}") for i in range(3)))
    newest = zones.filter(F.col("t") <= now).groupBy("side").agg(F.max_by("z", "t").alias("z"), F.max("t").alias("t"))
    deviation = F.when(now - F.col("t") <= stale, sum(F.col("z")[i] - F.col(f"m{i}") for i in range(3)))
    level = newest.join(profile, "side").select("side", F.round(deviation, 5).alias("deviation"))
    peak = F.coalesce(F.max(F.when(F.col("t").between(now - 900, now), F.col("total_movement"))), F.lit(0))
    rows = movement.groupBy("side").agg(peak.alias("peak")).join(level, "side", "left")
    high = F.coalesce(F.col("deviation") > threshold, F.lit(False))
    return rows.select("side", "peak", "deviation", ((F.col("peak") >= 50) | high).alias("occupied"), F.col("deviation").isNotNull().alias("available"))


QUERIES["st_occupancy"] = occupancy
ORACLES["st_occupancy"] = ctes("movement") + ", " + CHANNELS.removeprefix("with ") + f"""f as (select case when vec_id % 2 = 0 then 'left' else 'right' end as side, {NOW} - vec_id * 11 as t, list_transform(c, lambda x: x + 1) as c from c),
z as (select side, t, list_transform(range(0, 3), lambda i: (c[2 * i + 1] + c[2 * i + 2]) / 2 - ((c[7] + c[8]) / 2 - 1)) as z from f),
m as (select side, avg(z[1]) as a, avg(z[2]) as b, avg(z[3]) as d from z group by 1), n as (select side, arg_max(z, t) as z, max(t) as t from z where t <= {NOW} group by 1),
l as (select side, case when {NOW} - t <= 30 then round(z[1] - a + (z[2] - b) + (z[3] - d), 5) end as deviation from n join m using (side)),
q as (select side, coalesce(max(total_movement) filter (t between {NOW} - 900 and {NOW}), 0) as peak from movement group by 1)
select side, peak, deviation, peak >= 50 or coalesce(deviation > 0.05, false) as occupied, deviation is not null as available from q left join l using (side)"""

FAHR = "{0} / 100.0 * 9 / 5 + 32"
ZONES = [f"left_{z}_temp" for z in ("outer", "center", "inner")]


def _signals_sql() -> str:
    parts = [f"select side || '.{k}' as key, t, cast({c} as double) as value from {v}" for k, c, v in (("movement", "total_movement", "movement"), ("heartRate", "heart_rate", "vitals"), ("hrv", "hrv", "vitals"), ("breathingRate", "breathing_rate", "vitals"))]
    z = f"(select *, list_filter([{', '.join(FAHR.format(c) for c in ZONES)}], lambda x: x is not null) as z from bed_temp)"
    parts += [f"select '{k}', t, {e} from {v}" for k, e, v in (
        ("ambient.temperature", FAHR.format("ambient_temp"), "bed_temp"), ("ambient.humidity", "humidity / 100.0", "bed_temp"), ("left.surfaceTemp", "list_avg(z)", z), ("left.surfaceTemp.spread", "case when len(z) >= 2 then list_max(z) - list_min(z) end", z),
        ("left.surfaceTemp.gradient", f"({FAHR.format('left_inner_temp')}) - ({FAHR.format('left_outer_temp')})", "bed_temp"), ("left.waterTemp", FAHR.format(f"({_clean_sql('left_water_raw')})"), "freezer_temp"), ("ambient.light", "lux", "light"), ("water.low", "case when level = 'low' then 1.0 else 0.0 end", "water"))]
    parts += [f"select side || '.cap.{k}', t, {e} from samples where a is not null" for k, e in (("max", "greatest(a, b, c)"), ("mean", "(a + b + c) / 3"), ("spread", "greatest(a, b, c) - least(a, b, c)"))]
    return " select key, t, round(value, 9) as value from (" + " union all ".join(parts) + ") where value is not null"


@reg("rule_series", _signals_sql(), "movement", "vitals", "bed_temp", "freezer_temp", "light", "water", "samples")
def rule_series(movement, vitals, bed, freezer, light, water, samples):
    """All signals that rules may name, as one table of (key, t, value); each source is read once."""
    fahr = lambda c: u.c_to_f(u.centi_to_c(c))

    def long(rows, prefix, **signals):
        each = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), e.cast("double").alias("v")) for k, e in signals.items())))
        return rows.select(prefix.alias("p"), "t", each.alias("x")).filter("x.v is not null").select(F.concat("p", "x.k").alias("key"), "t", rnd("x.v", 9).alias("value"))

    side, none = F.concat("side", F.lit(".")), F.lit("")
    z = F.array_compact(F.array(*(fahr(F.col(c)) for c in ZONES)))
    mean = F.try_divide(F.aggregate(z, F.lit(0.0), lambda a, x: a + x), F.size(z))
    a, b, c = (F.col(x) for x in "abc")
    tables = [
        long(movement, side, movement=F.col("total_movement")),
        long(vitals, side, heartRate=F.col("heart_rate"), hrv=F.col("hrv"), breathingRate=F.col("breathing_rate")),
        long(bed, none, **{"ambient.temperature": fahr(F.col("ambient_temp")), "ambient.humidity": F.col("humidity") / 100, "left.surfaceTemp": mean, "left.surfaceTemp.spread": F.when(F.size(z) >= 2, F.array_max(z) - F.array_min(z)), "left.surfaceTemp.gradient": fahr(F.col(ZONES[2])) - fahr(F.col(ZONES[0]))}),
        long(freezer, none, **{"left.waterTemp": fahr(sensor(F.col("left_water_raw")))}),
        long(light, none, **{"ambient.light": F.col("lux")}),
        long(water, none, **{"water.low": F.when(F.col("level") == "low", 1.0).otherwise(0.0)}),
        long(samples.filter("a is not null"), side, **{"cap.max": F.greatest(a, b, c), "cap.mean": (a + b + c) / 3, "cap.spread": F.greatest(a, b, c) - F.least(a, b, c)}),
    ]
    return reduce(DataFrame.union, tables)


RETAINED = ("vitals", "movement", "bed_temp", "freezer_temp", "flow", "light", "water", "samples", "alerts")
CUTOFF = NOW - 86400


@reg("dml_retention", " " + " union all ".join(f"select '{v}' as name, count(*) as kept, (select count(*) from {v} where t < {CUTOFF}) as deleted from {v} where t >= {CUTOFF}" for v in RETAINED), *RETAINED)
def retention(*tables):
    """Rows kept and deleted of the nine tables that grow; the tables without the deleted rows are ``store.retain_all``'s."""
    _, counts = s.retain_all(dict(zip(RETAINED, tables)), "t", NOW, 1)
    return counts


HOURS = 24 * 5


@reg("agg_water_trend", f", w as (select *, t >= {NOW} - {HOURS} * 1800 as recent, t <= {NOW} - {HOURS} * 1800 as older from water where t >= {NOW} - {HOURS} * 3600), c as (select count(*) as n, count(*) filter (level = 'low') as low, count(*) filter (level = 'low' and recent) * 1.0 as rl, count(*) filter (recent) as rn, count(*) filter (level = 'low' and older) * 1.0 as ol, count(*) filter (older) as o from w) select n, low, n - low as ok, cast(floor(low * 100.0 / n + 0.5) as bigint) as low_percent, case when n < 2 then 'unknown' when coalesce(rl / nullif(rn, 0), 0) - coalesce(ol / nullif(o, 0), 0) > 0.2 then 'declining' when coalesce(rl / nullif(rn, 0), 0) - coalesce(ol / nullif(o, 0), 0) < -0.2 then 'rising' else 'stable' end as trend from c", "water")
def water_trend(water, hours: int = HOURS, now: int = NOW):
    """Levels of the trailing hours, and the low share of their later half against the earlier one; a reading at the middle counts in both."""
    if not 1 <= hours <= 168:
        raise ValueError("hours out of range")
    mid = now - hours * 1800
    low, recent, older = F.col("level") == "low", F.col("t") >= mid, F.col("t") <= mid
    a = water.filter(F.col("t") >= now - hours * 3600).agg(F.count("*").alias("n"), F.count_if(low).alias("low"), F.count_if(low & recent).alias("rl"), F.count_if(recent).alias("rn"), F.count_if(low & older).alias("ol"), F.count_if(older).alias("o"))
    share = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    change = share("rl", "rn") - share("ol", "o")
    trend = F.when(F.col("n") < 2, "unknown").when(change > 0.2, "declining").when(change < -0.2, "rising").otherwise("stable")
    return a.select("n", "low", (F.col("n") - F.col("low")).alias("ok"), u.half_up(F.try_divide(F.col("low") * 100, F.col("n"))).alias("low_percent"), trend.alias("trend"))


@reg("cap_zone_replay", ", f as (select s.id as night, s.side, m.t, m.a, m.b, m.c, row_number() over (partition by s.id order by m.t) - 1 as i, count(*) over (partition by s.id) as n from sleep_records s join samples m on m.side = s.side and m.t between s.entered and s.left_at where m.a is not null and s.left_at is not null) select night, side, t, round(a, 9) as a, round(b, 9) as b, round(c, 9) as c, case when a >= b and a >= c then 0 when b >= c then 1 else 2 end as peak_zone from f where i % greatest(1, cast(ceil(n / 300.0) as bigint)) = 0", "samples", "movement", "sleep_records")
def zone_replay(samples, _, sessions, most: int = 300):
    """Each night's frames with whole zones, every k-th so that at most ``most`` are shown, the first always."""
    closed = sessions.filter("left_at is not null").select("side", F.col("id").alias("night"), "entered", "left_at")
    rows = p.interval_join(samples.filter("a is not null").select("side", "t", "a", "b", "c"), closed, ["side"], "t", F.col("entered"), F.col("left_at"), ["night"])
    counts = rows.groupBy("side", "night").agg(F.count("*").alias("n"))
    shown = g.numbered(rows, ["side", "night"]).join(counts, ["side", "night"]).filter((F.col("i") - 1) % F.greatest(F.lit(1), F.ceil(F.col("n") / most)) == 0)
    a, b, c = (F.col(x) for x in "abc")
    peak = F.when((a >= b) & (a >= c), 0).when(b >= c, 1).otherwise(2)
    return shown.select("night", "side", "t", rnd("a", 9).alias("a"), rnd("b", 9).alias("b"), rnd("c", 9).alias("c"), peak.alias("peak_zone"))
