"""Queries of newest rows, latest readings, alerts, nights, calibration profiles and the state of each side."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import units as u
from .core import NOW, _clean_sql, reg, rnd, sensor, top

FAHRENHEIT = "round({} / 100.0 * 9 / 5 + 32, 6)"


def fahrenheit(c):
    return rnd(u.c_to_f(u.centi_to_c(c)))


# newest rows

FREEZER = ("ambient", "heatsink", "left_water")


@reg("top_freezer_temp", "select t, " + ", ".join(f"{FAHRENHEIT.format(_clean_sql(c + '_raw'))} as {c}_f" for c in FREEZER) + " from freezer_temp order by t desc limit 1440", "freezer_temp")
def top_freezer_temp(freezer):
    return top(freezer.select("t", *(fahrenheit(sensor(F.col(f"{c}_raw"))).alias(f"{c}_f") for c in FREEZER)), "t", 1440, 1440)


reg("top_ambient_light", "select t, lux from light order by t desc limit 1440", "light")(lambda light: top(light.select("t", "lux"), "t", 1440, 1440))
reg("top_water_history", "select t, level from water order by t desc limit 1440", "water")(lambda water: top(water.select("t", "level"), "t", 1440, 10000))
reg("flow_history", "select t, left_flow, right_flow, left_rpm, right_rpm from flow order by t limit 10080", "flow")(lambda flow: flow.select("t", "left_flow", "right_flow", "left_rpm", "right_rpm").orderBy("t").limit(10080))
reg("top_vitals_quality", "select vitals_id, quality_score from quality order by vitals_id desc limit 500", "quality")(lambda q: top(q.select("vitals_id", "quality_score"), "vitals_id", 500, 500))
reg("top_cal_history", "select id, sensor, status, quality from calibrations where side = 'left' order by t desc limit 50", "calibrations")(lambda c: top(c.filter("side = 'left'"), "t", 50, 50).select("id", "sensor", "status", "quality"))
reg("top_runs", "select id, automation_id, fired_at, outcome from runs order by fired_at desc, id desc limit 500", "runs")(lambda r: r.select("id", "automation_id", "fired_at", "outcome").orderBy(F.desc("fired_at"), F.desc("id")).limit(500))


@reg("nights", "select id, entered, case when row_number() over (order by entered desc) = 1 then 'Last night' else strftime(to_timestamp(entered) at time zone 'UTC', '%Y-%m-%d') end as label from (select id, entered from sleep_records where side = 'left' order by entered desc limit 30)", "movement", "sleep_records")
def nights(_, sessions, side: str = "left"):
    """The newest nights of a side; the newest of all is called so."""
    rows = top(sessions.filter(F.col("side") == side).select("id", "entered"), "entered", 30, 30)
    newest = F.row_number().over(Window.orderBy(F.desc("entered"))) == 1  # at most 30 rows
    return rows.select("id", "entered", F.when(newest, "Last night").otherwise(F.date_format(F.timestamp_seconds("entered"), "yyyy-MM-dd")).alias("label"))


# latest readings: one row, or none


def latest(df: DataFrame, *columns: str) -> DataFrame:
    row = df.agg(F.max_by(F.struct(*columns), "t").alias("x"))
    return row.filter("x is not null").select("x.*")


for _name, _view, _columns in (
    ("latest_bed_temp", "bed_temp", ("t", "ambient_temp", "humidity", "left_outer_temp", "left_center_temp", "left_inner_temp")),
    ("latest_freezer_temp", "freezer_temp", ("t", "ambient_raw", "heatsink_raw", "left_water_raw")),
    ("latest_light", "light", ("t", "lux")),
    ("latest_water", "water", ("t", "level")),
    ("latest_flow", "flow", ("t", "left_flow", "right_flow", "left_rpm", "right_rpm")),
):
    reg(_name, f"select {', '.join(_columns)} from {_view} order by t desc limit 1", _view)(lambda df, c=_columns: latest(df, *c))


@reg("latest_sleep", "select id, side, entered, left_at, duration, exits from sleep_records qualify row_number() over (partition by side order by entered desc) = 1", "movement", "sleep_records")
def latest_sleep(_, sessions):
    columns = ("id", "side", "entered", "left_at", "duration", "exits")
    return sessions.groupBy("side").agg(F.max_by(F.struct(*columns), "entered").alias("x")).select("x.*")


# filters and alerts

reg("flt_since_hours", f"select t, level from water where t > {NOW} - 6 * 3600", "water")(lambda water, hours=6: water.filter(F.col("t") > NOW - hours * 3600).select("t", "level"))
reg("flt_null_flags", "select id, kind from alerts where dismissed_at is null and acknowledged_at is null", "alerts")(lambda a: a.filter(F.col("dismissed_at").isNull() & F.col("acknowledged_at").isNull()).select("id", "kind"))
reg("flt_not_null", "select t, left_inner_temp from bed_temp where left_inner_temp is not null", "bed_temp")(lambda b: b.filter(F.col("left_inner_temp").isNotNull()).select("t", "left_inner_temp"))


def open_alerts(alerts: DataFrame, kind: str, limit: int = 500) -> DataFrame:
    return top(alerts.filter((F.col("kind") == kind) & F.col("dismissed_at").isNull()).select("id", "side", "t", "severity"), "t", limit, 500)


for _name, _kind in (("active_water_alerts", "water"), ("pump_alerts", "pump")):
    reg(_name, f"select id, side, t, severity from alerts where kind = '{_kind}' and dismissed_at is null order by t desc limit 500", "alerts")(lambda a, k=_kind: open_alerts(a, k))


@reg("resolve_night", "select s.side, coalesce(r.entered, l.entered, m.t - 43200) as began, coalesce(r.left_at, l.left_at, m.t) as ended from (values ('left', 4), ('right', -1)) as s(side, wanted) join (select side, max(t) as t from movement group by 1) m using (side) left join sleep_records r on r.side = s.side and r.id = s.wanted left join (select side, max(entered) as entered, arg_max(coalesce(left_at, 0), entered) as raw, nullif(arg_max(coalesce(left_at, 0), entered), 0) as left_at from sleep_records group by 1) l on l.side = s.side", "movement", "sleep_records")
def resolve_night(movement, sessions):
    """The wanted record of each side, else its latest, else the twelve hours before its latest movement."""
    wanted = movement.sparkSession.createDataFrame([("left", 4), ("right", -1)], "side string, wanted long")
    asked = sessions.join(F.broadcast(wanted), (sessions["side"] == wanted["side"]) & (sessions["id"] == wanted["wanted"])).select(sessions["side"], F.struct("entered", "left_at").alias("asked"))
    newest = sessions.groupBy("side").agg(F.max_by(F.struct("entered", "left_at"), "entered").alias("newest"))
    moved = movement.groupBy("side").agg(F.max("t").alias("m"))
    rows = moved.join(newest, "side", "left").join(asked, "side", "left")
    return rows.select("side", F.coalesce("asked.entered", "newest.entered", F.col("m") - 43200).alias("began"), F.coalesce("asked.left_at", "newest.left_at", "m").alias("ended"))


@reg("stride_sample_tail", "select t, left_flow from (select t, left_flow, row_number() over (order by t) as i, count(*) over () as n from flow) where (i - 1) % greatest(1, n // 120) = 0 or i = n", "flow")
def stride_sample_tail(flow, parts: int = 120):
    """Every k-th row in time order and the last one; places come from counts of days and numbers within a day."""
    rows = flow.select("t", "left_flow").withColumn("day", F.expr("t div 86400"))
    days = rows.groupBy("day").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = days.select("day", before.alias("before"), F.sum("c").over(Window.partitionBy()).alias("n"))
    i = F.row_number().over(Window.partitionBy("day").orderBy("t")) + F.col("before")
    step = F.greatest(F.lit(1), F.expr(f"n div {parts}"))
    return rows.join(days, "day").withColumn("i", i).filter(((F.col("i") - 1) % step == 0) | (F.col("i") == F.col("n"))).select("t", "left_flow")


# calibration profiles

DONE = "p as (select side, sensor, arg_max(quality, t) as quality, max(t) as t from calibrations where status = 'completed' group by 1, 2)"


def profiles(calibrations: DataFrame) -> DataFrame:
    """The latest completed profile of each side and sensor."""
    return calibrations.filter("status = 'completed'").groupBy("side", "sensor").agg(F.max_by("quality", "t").alias("quality"), F.max("t").alias("t"))


@reg("cal_status", f", {DONE} select side, max(quality) filter (sensor = 'capacitance') as capacitance, max(quality) filter (sensor = 'piezo') as piezo, max(quality) filter (sensor = 'temperature') as temperature from p group by 1", "calibrations")
def cal_status(calibrations):
    return profiles(calibrations).groupBy("side").pivot("sensor", ["capacitance", "piezo", "temperature"]).agg(F.max("quality"))


@reg("cal_due", f", {DONE} select s.side, k.sensor, coalesce({NOW} - p.t >= 25 * 3600, true) as due, coalesce({NOW} - p.t >= 48 * 3600, true) as expired from (select distinct side from calibrations) s cross join (values ('capacitance'), ('piezo'), ('temperature')) k(sensor) left join p on p.side = s.side and p.sensor = k.sensor", "calibrations")
def cal_due(calibrations, now: int = NOW):
    """Profiles that are missing or older than 25 hours, and those that no longer hold (48 hours)."""
    kinds = F.array(*map(F.lit, ("capacitance", "piezo", "temperature")))
    wanted = calibrations.select("side").distinct().withColumn("sensor", F.explode(kinds))
    age = now - F.col("t")
    return wanted.join(profiles(calibrations), ["side", "sensor"], "left").select("side", "sensor", F.coalesce(age >= 25 * 3600, F.lit(True)).alias("due"), F.coalesce(age >= 48 * 3600, F.lit(True)).alias("expired"))


@reg("join_profile_lookup", f", {DONE} select v.id, v.side, p.quality from vitals v left join p on p.side = v.side and p.sensor = 'piezo'", "vitals", "calibrations")
def join_profile_lookup(vitals, calibrations):
    """Vitals with the quality of their side's profile: one row for each side is broadcast."""
    piezo = profiles(calibrations).filter("sensor = 'piezo'").select("side", "quality")
    return vitals.join(F.broadcast(piezo), "side", "left").select("id", "side", "quality")


@reg("val_piezo_presence", "select id, total_movement > 400 as present from movement", "movement")
def val_piezo_presence(movement, threshold: int = 400):
    return movement.select("id", (F.col("total_movement") > threshold).alias("present"))


# the state of each side

STATE = f"""d as (select side, arg_max(powered, t) as powered, arg_max(target_f, t) as target_f, arg_max(current_f, t) as current_f from device_state group by 1),
f as (select t, left_flow, right_flow, left_rpm, right_rpm from flow where t <= {NOW} order by t desc limit 1), z as (select t, {_clean_sql('left_water_raw')} as water from freezer_temp where t <= {NOW} order by t desc limit 1), b as (select t, left_center_temp as center from bed_temp where t <= {NOW} order by t desc limit 1),
x as (select d.side, d.powered, case when d.powered then d.target_f end as target_f, case when d.powered then d.current_f end as current_f, case when d.side = 'left' then f.left_rpm else f.right_rpm end as rpm, case when d.side = 'left' then f.left_flow else f.right_flow end as flow, {NOW} - f.t as age, case when d.side = 'left' then round(z.water / 100.0 * 9 / 5 + 32, 6) end as water_f, case when d.side = 'left' then round(b.center / 100.0 * 9 / 5 + 32, 6) end as bed_f from d left join f on true left join z on true left join b on true)"""


def state_flow(device, flow, freezer, bed, now: int = NOW):
    """Each side's latest device state beside the latest flow, water and bed readings (one row each)."""
    last = device.groupBy("side").agg(F.max_by(F.struct("powered", "target_f", "current_f"), "t").alias("d"))
    before = lambda df: df.filter(F.col("t") <= now)
    f = latest(before(flow), "t", "left_flow", "right_flow", "left_rpm", "right_rpm").select(F.struct("*").alias("f"))
    z = latest(before(freezer), "t", "left_water_raw").select(sensor(F.col("left_water_raw")).alias("water"))
    b = latest(before(bed), "t", "left_center_temp").select(F.col("left_center_temp").alias("center"))
    rows = last
    for one in (f, z, b):  # one row each at most
        rows = rows.join(F.broadcast(one), F.lit(True), "left")
    left = F.col("side") == "left"
    return rows.select(
        "side", "d.powered", F.when(F.col("d.powered"), F.col("d.target_f")).alias("target_f"), F.when(F.col("d.powered"), F.col("d.current_f")).alias("current_f"),
        F.when(left, F.col("f.left_rpm")).otherwise(F.col("f.right_rpm")).alias("rpm"), F.when(left, F.col("f.left_flow")).otherwise(F.col("f.right_flow")).alias("flow"),
        (now - F.col("f.t")).alias("age"), F.when(left, fahrenheit(F.col("water"))).alias("water_f"), F.when(left, fahrenheit(F.col("center"))).alias("bed_f"),
    )


reg("join_state_flow", f", {STATE} select * from x", "device_state", "flow", "freezer_temp", "bed_temp")(state_flow)


@reg("thermal_verdict", f", {STATE} select side, case when not powered then 'off' when rpm is null or rpm < 100 or coalesce(age > 180, false) then 'stalled' when abs(target_f - current_f) > 2 then 'delivering' else 'idle' end as verdict from x", "device_state", "flow", "freezer_temp", "bed_temp")
def thermal_verdict(device, flow, freezer, bed):
    """Whether a powered side's pump runs and its water is on the way to its target."""
    stopped = F.col("rpm").isNull() | (F.col("rpm") < 100) | F.coalesce(F.col("age") > 180, F.lit(False))
    verdict = F.when(~F.col("powered"), "off").when(stopped, "stalled").when(F.abs(F.col("target_f") - F.col("current_f")) > 2, "delivering").otherwise("idle")
    return state_flow(device, flow, freezer, bed).select("side", verdict.alias("verdict"))


@reg("st_expected_stop", "select t, left_rpm, left_rpm < 50 and (left_duty = 0 or t % 3600 < 120 or target = 0) as expected from (select t, left_rpm, case when left_rpm = 0 then 0 else 40 end as left_duty, right_rpm % 7 as target from flow)", "flow")
def st_expected_stop(flow):
    """Slow pumps that nobody need worry about: no duty, priming or just after it, or a target level of zero."""
    low = F.col("left_rpm") < 50
    excused = (F.col("left_rpm") == 0) | (F.col("t") % 3600 < 120) | (F.col("right_rpm") % 7 == 0)
    return flow.select("t", "left_rpm", (low & excused).alias("expected"))


@reg("st_scheduler_liveness", f"select id, name from automations where {NOW} - cooldown_min * 60 < {NOW} - 1200", "automations")
def st_scheduler_liveness(automations, now: int = NOW, stale: int = 1200):
    """Jobs whose next run should have come long ago."""
    return automations.filter(now - F.col("cooldown_min") * 60 < now - stale).select("id", "name")


@reg("agg_month_avg", "select side, strftime(to_timestamp(entered) at time zone 'UTC', '%Y-%m') as month, round(avg(duration) / 3600, 6) as hours, round(avg(exits), 6) as exits from sleep_records group by 1, 2", "movement", "sleep_records")
def agg_month_avg(_, sessions):
    month = F.date_format(F.timestamp_seconds("entered"), "yyyy-MM")
    return sessions.groupBy("side", month.alias("month")).agg(rnd(F.avg("duration") / 3600).alias("hours"), rnd(F.avg("exits")).alias("exits"))


# changes of tables

reg("dml_delete_sleep", "select id, side, entered from sleep_records where id not in (select vitals_id from quality where quality_score > 0.5)", "movement", "sleep_records", "quality")(lambda _, s, q: s.join(q.filter("quality_score > 0.5").select(F.col("vitals_id").alias("id")), "id", "left_anti").select("id", "side", "entered"))


@reg("dml_session_state", "select id, case when outcome = 'skipped' then 'cancelled' when fired_at < 1704067200 + 1000000 then 'expired' else 'active' end as state from runs", "runs")
def dml_session_state(runs):
    """Run-once sessions after a cancel and the expiry of old ones."""
    return runs.select("id", F.when(F.col("outcome") == "skipped", "cancelled").when(F.col("fired_at") < 1704067200 + 1000000, "expired").otherwise("active").alias("state"))


@reg("dml_batch_schedules", "select id, case when enabled then priority + 10 else priority end as priority from automations where priority <> 0 union all select id + 1000000000, priority from automations where priority = 0", "automations")
def dml_batch_schedules(automations):
    """One batch: deletes, then creates, then updates, in that order."""
    gone = automations.filter("priority = 0")
    kept = automations.join(gone.select("id"), "id", "left_anti")
    changed = kept.select("id", F.when(F.col("enabled"), F.col("priority") + 10).otherwise(F.col("priority")).alias("priority"))
    return changed.union(gone.select(F.col("id") + 1000000000, "priority"))


@reg("sink_mqtt_state", """, v as (select side, t, heart_rate, hrv, breathing_rate from vitals qualify row_number() over (partition by side order by t desc) = 1),
m as (select side, total_movement from movement qualify row_number() over (partition by side order by t desc) = 1)
select side, '{"heart_rate":' || coalesce(cast(cast(heart_rate as int) as varchar), 'null') || ',"hrv":' || coalesce(cast(cast(hrv as int) as varchar), 'null') || ',"breathing_rate":' || coalesce(cast(cast(breathing_rate as int) as varchar), 'null') || ',"movement":' || coalesce(cast(total_movement as varchar), 'null') || ',"t":' || cast(t as varchar) || '}' as payload from v left join m using (side)""", "vitals", "movement")
def sink_mqtt_state(vitals, movement):
    """The retained message of each side's latest vitals and movement; what was not measured is null."""
    vital = F.struct(*(F.col(c).cast("int").alias(c) for c in ("heart_rate", "hrv", "breathing_rate")), "t")
    last = vitals.groupBy("side").agg(F.max_by(vital, "t").alias("v"))
    moved = movement.groupBy("side").agg(F.max_by("total_movement", "t").alias("movement"))
    message = F.struct("v.heart_rate", "v.hrv", "v.breathing_rate", "movement", "v.t")
    return last.join(moved, "side", "left").select("side", F.to_json(message, {"ignoreNullFields": "false"}).alias("payload"))
