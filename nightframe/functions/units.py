"""Unit and clock columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def half_up(x: Column) -> Column:
    """Rounding with halves up, also below zero."""
    return F.floor(x + 0.5)


def centi_to_c(x: Column) -> Column:
    return x / 100


def c_to_f(x: Column) -> Column:
    return x * 9 / 5 + 32


def f_to_c(x: Column) -> Column:
    return (x - 32) * 5 / 9


def level_to_f(level: Column) -> Column:
    """Set point in Fahrenheit of a device level from -100 to 100."""
    return half_up(82.5 + level / 100 * 27.5)


def f_to_level(f: Column) -> Column:
    return F.greatest(F.lit(-100), F.least(F.lit(100), half_up((f - 82.5) / 27.5 * 100)))


def trend(now: Column, before: Column) -> Column:
    """up, down or stable by half a degree."""
    return F.when(now - before > 0.5, "up").when(now - before < -0.5, "down").otherwise("stable")


def scale_1_10(f: Column) -> Column:
    """Comfort scale of a set point between 55 and 95 Fahrenheit."""
    return half_up((F.greatest(F.lit(55.0), F.least(F.lit(95.0), f)) - 55) / 40 * 9 + 1)


def dbm_to_percent(dbm: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), half_up(2 * (dbm + 100))))


def minute_of_day(t: Column, tz: str = "UTC") -> Column:
    """Minutes since local midnight of epoch seconds."""
    local = F.from_utc_timestamp(F.timestamp_seconds(t), tz)
    return F.hour(local) * 60 + F.minute(local)


def within_clock(minute: Column, start: int, end: int) -> Column:
    """Start inclusive, end exclusive, over midnight if start is later; an empty window never fits."""
    inside = (minute >= start, minute < end)
    return (inside[0] & inside[1]) if start <= end else (inside[0] | inside[1])


def hhmm(text: Column) -> Column:
    parts = F.split(text, ":")
    return parts[0].cast("int") * 60 + parts[1].cast("int")


def to_hhmm(minute: Column) -> Column:
    m = F.pmod(minute, F.lit(1440))
    return F.format_string("%02d:%02d", (F.floor(m / 60)).cast("int"), (m % 60).cast("int"))


def logical_day(t: Column) -> Column:
    """Date that a night belongs to: before 04:00 the day before."""
    return F.to_date(F.timestamp_seconds(t - 4 * 3600))


def week_start(d: Column) -> Column:
    """Sunday of the week."""
    return F.date_sub(d, F.dayofweek(d) - 1)


def duration_text(seconds: Column) -> Column:
    return F.format_string("%dh %dm", F.floor(seconds / 3600).cast("int"), F.floor(seconds % 3600 / 60).cast("int"))
