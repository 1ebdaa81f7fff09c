"""Recurring times in the zone of each row: weekly occurrences, the next set point of a schedule, lanes of days.

All is arithmetic on epoch seconds and on local seconds (those of the wall clock), so it does not depend on the session's
zone. A wall time that a change of clocks skips is read with the offset before it, one that comes twice the first time.
Days of the week count from Sunday, 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

DAY = 86400


def local_seconds(t: Column, zone: Column) -> Column:
    """Seconds of the wall clock at an instant, counted as if in UTC."""
    return F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(t), zone))


def instant(local: Column, zone: Column) -> Column:
    """The instant at which a zone's clock shows some local seconds."""
    return F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds(local), zone))


def weekday(day: Column) -> Column:
    """Day of the week of a number of days since 1970."""
    return F.pmod(day + 4, F.lit(7)).cast("int")


def cron(minute: Column, day: Column) -> Column:
    """The weekly cron text of a minute of the day; every day where ``day`` is null."""
    return F.format_string("%d %d * * %s", (minute % 60).cast("int"), F.floor(minute / 60).cast("int"), F.coalesce(day.cast("string"), F.lit("*")))


def occurrences(jobs: DataFrame, start: int, end: int, text: str = "cron", zone: str = "zone", name: str = "at") -> DataFrame:
    """``jobs`` with a row for each instant after ``start``, up to and with ``end``, at which its weekly cron text comes.

    A row's days are those of the range, whatever the table's size. Texts that are no ``m h * * d`` have none.
    """
    parts = F.split(F.trim(text), r"\s+")
    number = lambda i, most: F.when(parts[i].rlike("^[0-9]{1,2}$") & (parts[i].try_cast("int") <= most), parts[i].try_cast("int"))
    tz = F.coalesce(zone, F.lit("UTC"))
    sound = (F.size(parts) == 5) & (parts[2] == "*") & (parts[3] == "*") & (parts[4].rlike("^[0-7]$") | (parts[4] == "*"))
    wall = F.when(sound, number(1, 23) * 3600 + number(0, 59) * 60)
    first, last = (F.floor(local_seconds(F.lit(x).cast("long"), tz) / DAY) for x in (start, end))
    day = F.explode(F.when(F.col("__wall").isNotNull(), F.sequence(first, last)))
    rows = jobs.withColumns({"__wall": wall, "__day_of": F.pmod(parts[4].try_cast("int"), F.lit(7))}).withColumn("__day", day)
    rows = rows.filter(F.col("__day_of").isNull() | (weekday(F.col("__day")) == F.col("__day_of")))
    return rows.withColumn(name, instant(F.col("__day") * DAY + F.col("__wall"), tz)).filter((F.col(name) > start) & (F.col(name) <= end)).drop("__wall", "__day_of", "__day")


def next_event(moments: DataFrame, schedule: DataFrame, keys: list[str], t: str = "t", zone: str = "zone") -> DataFrame:
    """``moments`` with ``next_at``, ``next_minute`` and ``next_temperature``: the first enabled set point after each, within its week.

    ``schedule``: (keys, day, minute, temperature, enabled). A key's set points meet once, as its week (at most a slot for each minute of it), not
    once for each moment. Set points of the same weekday at or before the minute of the clock are not looked for a week ahead; of several in one minute
    the coolest counts.
    """
    slots = schedule.filter(F.col("enabled") & F.col("minute").between(0, 1439) & F.col("day").between(0, 6)).groupBy(*keys, "day", "minute").agg(F.min("temperature").alias("temperature"))
    weeks = slots.groupBy(*keys).agg(F.collect_list(F.struct("day", "minute", "temperature")).alias("__week"))
    tz = F.coalesce(zone, F.lit("UTC"))
    rows = moments.join(weeks, keys, "left").withColumn("__local", local_seconds(F.col(t), tz))
    today, clock = F.floor(F.col("__local") / DAY), F.floor(F.pmod("__local", F.lit(DAY)) / 60)
    ahead = F.transform("__week", lambda s: F.struct(F.pmod(s["day"] - weekday(today), F.lit(7)).alias("days"), s["minute"].alias("minute"), s["temperature"].alias("temperature")))
    later = F.filter(ahead, lambda s: (s["days"] > 0) | (s["minute"] > clock))
    rows = rows.withColumn("__next", F.array_min(later))
    at = instant((today + F.col("__next.days")) * DAY + F.col("__next.minute") * 60, tz)
    return rows.withColumns({"next_at": at, "next_minute": F.col("__next.minute"), "next_temperature": F.col("__next.temperature")}).drop("__week", "__local", "__next")


def day_lanes(jobs: DataFrame, now: int, zone: str, at: str = "at", days: int = 7) -> DataFrame:
    """``jobs`` of the next days with ``lane`` and ``lane_start``: lanes are 24 hours each, from local midnight of today; others are left out."""
    midnight = instant(F.floor(local_seconds(F.lit(now).cast("long"), F.lit(zone)) / DAY) * DAY, F.lit(zone))
    lane = F.floor((F.col(at) - midnight) / DAY).cast("int")
    return jobs.withColumns({"lane": lane, "lane_start": midnight + lane * DAY}).filter(F.col("lane").between(0, days - 1))
