"""Queries of raw frames made uniform, of counters, presence scores and throttles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import frames as f, units as u
from ..operators import segments as g
from ..sources.views import START
from .core import reg
from .registry import ORACLES, QUERIES

SENSED = "case when abs({0} + 327.68) >= 0.01 then {0} end"
CENTI = "cast(round_even((" + SENSED + ") * 100, 0) as int)"


@reg("norm_bedtemp_v2", f"select t, {CENTI.format('coalesce(' + SENSED.format('left_amb') + ', ' + SENSED.format('right_amb') + ')')} as ambient_temp, {CENTI.format('coalesce(' + SENSED.format('left_hu') + ', ' + SENSED.format('right_hu') + ')')} as humidity, {CENTI.format('outer_c')} as left_outer_temp, {CENTI.format('center_c')} as left_center_temp, case when n_temps >= 3 then {CENTI.format('inner_c')} end as left_inner_temp from bed_frames", "bed_frames")
def bedtemp_v2(frames):
    """Float frames: the left side's ambient values before the right one's, zones from arrays of two or three."""
    temps = F.slice(F.array("outer_c", "center_c", "inner_c"), 1, F.col("n_temps"))
    either = lambda name: f.centi(F.coalesce(f.sensed(F.col(f"left_{name}")), f.sensed(F.col(f"right_{name}"))))
    zones = (z.alias(f"left_{n}_temp") for z, n in zip(f.zones(temps), ("outer", "center", "inner")))
    return frames.select("t", either("amb").alias("ambient_temp"), either("hu").alias("humidity"), *zones)


RAW = ("ambient_raw", "heatsink_raw", "left_water_raw")
reg("norm_bedtemp_v1", "select t, " + ", ".join(f"nullif({c}, -32768) as {c[:-4]}" for c in RAW) + " from freezer_temp", "freezer_temp")(lambda z: z.select("t", *(f.centi_int(F.col(c)).alias(c[:-4]) for c in RAW)))


@reg("norm_sanitize_ts", f"select id, case when fired_at is not null and fired_at >= 1577836800 and fired_at <= {START} + 1000000 + 60 then fired_at else {START} + 1000000 end as t from runs", "runs")
def sanitize(runs):
    """Times of runs against a clock that some of them are ahead of."""
    return runs.select("id", f.sane_time(F.col("fired_at"), F.lit(START + 1000000), 60).alias("t"))


def channels(spark, sf_dir, n: int = 8):
    c = F.transform(F.slice("embedding", 1, n), lambda x: x.cast("double"))
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", c.alias("c"))


CHANNELS = "with c as (select vec_id, list_transform(embedding[1:8], lambda x: x::double) as c from embeddings), "
Z = ("a", "b", "c")


def triple(column):
    return [F.round(column[i], 5).alias(n) for i, n in enumerate(Z)]


QUERIES["proj_zone_triple"] = lambda spark, d: channels(spark, d).select("vec_id", *triple(f.zone_triple(F.col("c"))))
ORACLES["proj_zone_triple"] = CHANNELS + "z as (select 1) select vec_id, round((c[1] + c[2]) / 2, 5) as a, round((c[3] + c[4]) / 2, 5) as b, round((c[5] + c[6]) / 2, 5) as c from c"


def cap_extract(spark, sf_dir):
    """Samples about 1 as eight channels; those of a loud first channel have it missing."""
    c = F.transform("c", lambda x, i: F.when((i == 0) & (x > 0.2), f.NO_CHANNEL).otherwise(x + 1))
    return channels(spark, sf_dir).select("vec_id", *triple(f.compensated(c)))


QUERIES["norm_cap_extract"] = cap_extract
ORACLES["norm_cap_extract"] = CHANNELS + "d as (select vec_id, c, (c[7] + c[8]) / 2 + 1 - 1.16 as r, c[1] > 0.2 as gone from c) select vec_id, " + ", ".join(f"case when not gone then round((c[{2 * i + 1}] + c[{2 * i + 2}]) / 2 + 1 - r, 5) end as {n}" for i, n in enumerate(Z)) + " from d"


def presence_z(spark, sf_dir, threshold: float = 6.0):
    """Presence where the pair means are, in sum, more than ``threshold`` deviations from the profile of all samples."""
    rows = channels(spark, sf_dir).select("vec_id", f.zone_triple(F.col("c")).alias("z"))
    profile = rows.agg(*(a(F.col("z")[i]).alias(f"{n}{i}") for i in range(3) for n, a in (("m", F.avg), ("s", F.stddev_pop))))
    score = sum(F.abs((F.col("z")[i] - F.col(f"m{i}")) / F.greatest(f"s{i}", F.lit(0.001))) for i in range(3))
    return rows.join(F.broadcast(profile)).select("vec_id", F.round(score, 5).alias("score"), (score > threshold).alias("present"))


QUERIES["st_presence_z"] = presence_z
ORACLES["st_presence_z"] = CHANNELS + "z as (select vec_id, (c[1] + c[2]) / 2 as a, (c[3] + c[4]) / 2 as b, (c[5] + c[6]) / 2 as d from c), p as (select " + ", ".join(f"avg({x}) as m{x}, greatest(stddev_pop({x}), 0.001) as s{x}" for x in "abd") + " from z), s as (select vec_id, " + " + ".join(f"abs(({x} - m{x}) / s{x})" for x in "abd") + " as score from z, p) select vec_id, round(score, 5) as score, score > 6.0 as present from s"


@reg("win_counter_delta", ", w as (select *, l - lag(l) over (partition by tap order by t) as dl, r - lag(r) over (partition by tap order by t) as dr from gestures), v as (select * from w where dl >= 0 and dr >= 0) select tap, t, 'left' as side, unnest(range(1, dl + 1)) as n from v union all select tap, t, 'right', unnest(range(1, dr + 1)) from v", "gestures")
def counter_delta(gestures):
    """A row for each gesture that a counter has gone up by; a poll at which either side's counter falls tells nothing."""
    rows = g.carried(gestures, ["tap"], before=1)
    w = g.within(["tap"])
    rows = g.own(rows.withColumns({f"d{x}": F.col(x) - F.lag(x).over(w) for x in ("l", "r")})).filter("dl >= 0 and dr >= 0")
    each = F.explode(F.array(F.struct(F.lit("left").alias("side"), F.col("dl").alias("d")), F.struct(F.lit("right").alias("side"), F.col("dr").alias("d"))))
    counts = rows.select("tap", "t", each.alias("x")).filter("x.d > 0")
    return counts.select("tap", "t", "x.side", F.explode(F.sequence(F.lit(1).cast("long"), F.col("x.d"))).alias("n"))


@reg("st_rate_limit_log", ", o as (select kind, t, row_number() over (partition by kind order by t) as i from (select distinct kind, t from alerts)), n as (select o.*, (select min(x.t) from o x where x.kind = o.kind and x.t >= o.t + 300) as nxt from o), r as (select kind, t, nxt from n where i = 1 union all select n.kind, n.t, n.nxt from r join n on n.kind = r.kind and n.t = r.nxt) select kind, t from r", "alerts")
def rate_limit(alerts):
    """Of each kind the first alert and then the first one five minutes or more after the last logged."""
    return g.chained(alerts, ["kind"], 300)


@reg("fn_scalars", "select t, case when d <= -8 then 'much_cooler' when d <= -5 then 'cooler' when d <= -2 then 'a_little_cooler' when d <= 1 then 'as_it_is' when d <= 4 then 'a_little_warmer' when d <= 7 then 'warmer' else 'much_warmer' end as band, target_f - 80 as from_base, floor(current_f / 7 * 10 + 0.5) / 10 as tenth, cast(case when ceil(current_f / 100) = 0 then ceil(current_f) else ceil(current_f / 100) * 100 end as bigint) as axis, cast(greatest(-100, least(100, floor((target_f - 82.5) / 27.5 * 100 + 0.5))) as bigint) as level, cast(greatest(0, least(100, floor(2 * (100 - current_f - 30) + 0.5))) as bigint) as signal from (select *, target_f - current_f as d from device_state)", "device_state")
def scalars(state):
    """Bands, offsets, axis ends, levels and signal strengths of set points."""
    now, target = F.col("current_f"), F.col("target_f")
    return state.select("t", f.delta_band(target - now).alias("band"), (target - 80).alias("from_base"), f.round1(now / 7).alias("tenth"), f.nice_max(now).cast("long").alias("axis"), u.f_to_level(target).cast("long").alias("level"), u.dbm_to_percent(-now - 30).cast("long").alias("signal"))


QUERIES["fn_text"] = lambda spark, d: spark.read.parquet(f"{d}/part.parquet").select("p_partkey", f.slug(F.col("p_name")).alias("slug"), f.generation(F.concat_ws("-", F.substring("p_name", 1, 3), F.concat(F.substring(F.lit("FGHIJK"), (F.col("p_partkey") % 6 + 1).cast("int"), F.lit(1)), F.lit("02")), F.lit("B0708DE3"))).cast("int").alias("generation"), f.response(F.concat_ws(" ", F.col("p_type"), F.when(F.col("p_size") > 40, "Failed"))).alias("success"))
ORACLES["fn_text"] = "select p_partkey, case when trim(regexp_replace(lower(p_name), '[^a-z0-9_-]', '-', 'g'), '-') = '' then 'device' else trim(regexp_replace(lower(p_name), '[^a-z0-9_-]', '-', 'g'), '-') end as slug, cast(case p_partkey % 6 when 3 then 4 when 4 then 5 when 5 then 5 else 3 end as int) as generation, not (p_size > 40 or lower(p_type) like '%error%' or lower(p_type) like '%fail%') as success from part"


@reg("fn_wall_time", "select id, case when h % 12 = 0 then 12 else h % 12 end || ':' || lpad(cast(m % 60 as varchar), 2, '0') || case when h >= 12 then ' PM' else ' AM' end as clock, (420 - m + 1440) % 1440 as until, cast(epoch(timezone('America/New_York', cast(cast(to_timestamp(fired_at) at time zone 'UTC' as date) as timestamp) + to_minutes(m))) as bigint) as utc from (select id, fired_at, fired_at % 86400 // 60 as m, fired_at % 86400 // 3600 as h from runs)", "runs")
def wall_time(runs):
    """Clock texts, minutes until seven, and the instants of the same wall times in another zone."""
    minute = u.minute_of_day(F.col("fired_at"))
    return runs.select("id", f.clock12(minute).alias("clock"), f.span(minute, F.lit(420)).cast("long").alias("until"), f.wall_to_utc(F.to_date(F.timestamp_seconds("fired_at")), minute, "America/New_York").alias("utc"))


@reg("fn_set_points", ", p as (select id, list_transform(range(4), lambda k: (id * 37 + k * 60 * (id % 5 + 2)) % 1440) as m from automations), n as (select id, m, len(list_filter(m, lambda x: x < 720)) > 0 and len(list_filter(m, lambda x: x >= 720)) > 0 and len(list_filter(range(1, 4), lambda i: list_sort(m)[i + 1] - list_sort(m)[i] > 720)) > 0 as night from p) select id, list_transform(list_sort(list_transform(m, lambda x: case when night and x < 720 then x + 1440 else x end)), lambda x: x % 1440) as ordered, list_transform(m, lambda x: cast((1380 + floor(least((x - 1320 + 1440) % 1440, 480) / 480.0 * 510 + 0.5)) % 1440 as bigint)) as moved from n", "automations")
def set_points(automations):
    """Set points in the order of their night, and moved from 22:00-06:00 to 23:00-07:30."""
    points = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: (F.col("id") * 37 + k * 60 * (F.col("id") % 5 + 2)) % 1440)
    rows = automations.select("id", points.alias("m"))
    return rows.select("id", f.chronological(F.col("m")).alias("ordered"), F.transform("m", lambda x: f.rebased(x, (1320, 360), (1380, 450)).cast("long")).alias("moved"))


def _pump_sql(side):
    return f"{side}_rpm >= 50 or coalesce(t - last_value(case when {side}_rpm < 50 and was_{side} >= 50 then t end ignore nulls) over (order by t) < 5, false) as {side}"


@reg("st_pump_state", f", w as (select *, lag(left_rpm) over (order by t) as was_left, lag(right_rpm) over (order by t) as was_right from flow), a as (select t, {_pump_sql('left')}, {_pump_sql('right')} from w) select t, \"left\" as left_active, \"right\" as right_active, case when \"left\" and \"right\" then 'symmetric' when \"left\" then 'left' when \"right\" then 'right' else 'idle' end as state from a", "flow")
def pump_state(flow, least: int = 50, guard: int = 5):
    """Which pumps run, or have stopped less than ``guard`` seconds ago, at each frame."""
    rows = g.carried(flow.select("t", "left_rpm", "right_rpm"), [], before=1)
    w = g.within([])
    stopped = {f"{s}_off": F.when((F.col(f"{s}_rpm") < least) & (F.lag(f"{s}_rpm").over(w) >= least), F.col("t")) for s in ("left", "right")}
    rows = g.own(rows.withColumns(stopped))
    for s in ("left", "right"):
        rows = g.last_known(rows, [], f"{s}_off", f"{s}_since")
    left, right = ((F.col(f"{s}_rpm") >= least) | F.coalesce(F.col("t") - F.col(f"{s}_since") < guard, F.lit(False)) for s in ("left", "right"))
    state = F.when(left & right, "symmetric").when(left, "left").when(right, "right").otherwise("idle")
    return rows.select("t", left.alias("left_active"), right.alias("right_active"), state.alias("state"))


@reg("st_cross_channel", ", j as (select v.side, v.t, v.hrv / 320 as acr, m.total_movement * 1000 as std from vitals v join movement m on m.side = v.side and m.t = v.t) select a.side, a.t, round(case when b.acr > 0.3 and b.std > 0.7 * a.std and a.std < 400000 then 0 else a.acr end, 6) as acr from j a left join j b on b.t = a.t and b.side <> a.side", "vitals", "movement")
def cross_channel(vitals, movement, enter: int = 400000):
    """The periodicity of each side, none where the other side's is clear and its energy as strong: then it is the other sleeper's."""
    energy = movement.select("side", "t", (F.col("total_movement") * 1000).alias("std"))
    rows = vitals.select("side", "t", (F.col("hrv") / 320).alias("acr")).join(energy, ["side", "t"])
    sides = rows.groupBy("t").agg(*(F.max(F.when(F.col("side") == s, F.struct("acr", "std"))).alias(s) for s in ("left", "right")))
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("side"), F.col(a).alias("own"), F.col(b).alias("other")) for a, b in (("left", "right"), ("right", "left")))))
    coupled = (F.col("x.other.acr") > 0.3) & (10 * F.col("x.other.std") > 7 * F.col("x.own.std")) & (F.col("x.own.std") < enter)
    return sides.select("t", each.alias("x")).filter("x.own is not null").select("x.side", "t", F.round(F.when(coupled, 0.0).otherwise(F.col("x.own.acr")), 6).alias("acr"))


ZONES = ("outer", "center", "inner")
TOTAL = " + ".join(f"var_pop(c_{z}) over w" for z in ZONES)


@reg("cal_cap_v1", ", z as (select t, " + ", ".join(f"coalesce(left_{z}_temp, 0) as c_{z}" for z in ZONES) + f" from bed_temp), q as (select t, round({TOTAL}, 4) as v, count(*) over w as n, max(t) over w as last, " + ", ".join(f"avg(c_{z}) over w as m_{z}, stddev_pop(c_{z}) over w as s_{z}" for z in ZONES) + " from z window w as (order by t rows between current row and 299 following)) select t as start, last as until, round(greatest(0, least(1, 1 - v / 100000)), 3) as quality, " + ", ".join(f"round(m_{z}, 2) as mean_{z}, round(greatest(s_{z}, 5.0), 2) as std_{z}" for z in ZONES) + " from q where n = 300 order by v, t limit 1", "bed_temp")
def cal_cap(frames, width: int = 300, floor: float = 5.0):
    """Mean and deviation of three channels over the quietest ``width`` frames, the first such; missing channels count as 0."""
    rows = frames.select("t", *(F.coalesce(f"left_{z}_temp", F.lit(0)).alias(z) for z in ZONES))
    rows = g.spreads(rows, [], list(ZONES), width).filter("n is not null")
    stats = [c for z in ZONES for c in (F.col(f"mean_{z}").alias(f"m_{z}"), F.sqrt(f"var_{z}").alias(f"s_{z}"))]
    best = rows.agg(F.min(F.struct(F.round(sum(F.col(f"var_{z}") for z in ZONES), 4).alias("v"), "t", "last", *stats)).alias("b")).filter("b is not null")
    quality = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("b.v") / 100000)), 3)
    stats = (c for z in ZONES for c in (F.round(f"b.m_{z}", 2).alias(f"mean_{z}"), F.round(F.greatest(f"b.s_{z}", F.lit(floor)), 2).alias(f"std_{z}")))
    return best.select(F.col("b.t").alias("start"), F.col("b.last").alias("until"), quality.alias("quality"), *stats)


PAIRS = {"a": (0, 1), "b": (2, 3), "c": (4, 5), "ref": (6, 7)}
MEANS = ", ".join(f"(c[{i + 1}] + c[{j + 1}]) / 2 as {n}" for n, (i, j) in PAIRS.items())


def cal_cap_float(spark, sf_dir, width: int = 300, least: int = 60, floor: float = 0.05, ref_floor: float = 0.001):
    """Mean and deviation of the channel pairs over the quietest run of frames, of all where there are fewer; none below ``least`` frames."""
    rows = channels(spark, sf_dir).select("vec_id", *((F.col("c")[i] + F.col("c")[j]).alias(f"__{n}") for n, (i, j) in PAIRS.items()))
    rows = rows.select("vec_id", *((F.col(f"__{n}") / 2).alias(n) for n in PAIRS))
    count = rows.count()
    size = min(width, count)
    w = g.within([], "vec_id").rowsBetween(0, max(size, 1) - 1)
    made = {f"{k}_{n}": a(n).over(w) for n in PAIRS for k, a in (("m", F.avg), ("s", F.stddev_pop))}
    made |= {"v": F.round(sum(F.var_pop(n).over(w) for n in ("a", "b", "c")), 6), "n": F.count("*").over(w), "last": F.max("vec_id").over(w)}
    rows = g.own(g.carried(rows, [], after=max(size, 1) - 1, t="vec_id").withColumns(made)).filter((F.col("n") == size) & F.lit(count >= least))
    best = rows.agg(F.min(F.struct("v", "vec_id", "last", *(f"{k}_{n}" for n in PAIRS for k in "ms"))).alias("b")).filter("b is not null")
    quality = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("b.v") / 10)), 3)
    stats = (c for n in PAIRS for c in (F.round(f"b.m_{n}", 4).alias(f"mean_{n}"), F.round(F.greatest(f"b.s_{n}", F.lit(ref_floor if n == "ref" else floor)), 4).alias(f"std_{n}")))
    return best.select(F.col("b.vec_id").alias("start"), F.col("b.last").alias("until"), quality.alias("quality"), *stats)


QUERIES["cal_cap_v2"] = cal_cap_float
ORACLES["cal_cap_v2"] = CHANNELS + f"z as (select vec_id, {MEANS} from c), k as (select count(*) as total from z), q as (select vec_id, round(var_pop(a) over w + var_pop(b) over w + var_pop(c) over w, 6) as v, count(*) over w as n, max(vec_id) over w as last, " + ", ".join(f"avg({n}) over w as m_{n}, stddev_pop({n}) over w as s_{n}" for n in PAIRS) + " from z window w as (order by vec_id rows between current row and 299 following)) select vec_id as start, last as until, round(greatest(0, least(1, 1 - v / 10)), 3) as quality, " + ", ".join(f"round(m_{n}, 4) as mean_{n}, round(greatest(s_{n}, {0.001 if n == 'ref' else 0.05}), 4) as std_{n}" for n in PAIRS) + " from q, k where n = least(300, total) and total >= 60 order by v, vec_id limit 1"
