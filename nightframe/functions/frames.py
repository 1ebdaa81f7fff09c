"""Columns of raw sensor frames made uniform: temperatures, capacitive channels, clocks and labels.

Null, short or unfitting input gives null throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values of the frame formats
NO_SENSOR, NO_SENSOR_INT = -327.68, -32768
NO_CHANNEL, NOMINAL = -1.0, 1.16
OLDEST = 1577836800
BANDS = [(-8, "much_cooler"), (-5, "cooler"), (-2, "a_little_cooler"), (1, "as_it_is"), (4, "a_little_warmer"), (7, "warmer")]


def sensed(x: Column) -> Column:
    """A float reading, null where no sensor is attached."""
    return F.when(F.abs(x - NO_SENSOR) >= 0.01, x)


def centi(x: Column) -> Column:
    """Hundredths of a float reading, halves to even."""
    return F.bround(sensed(x) * 100, 0).cast("int")


def centi_int(x: Column) -> Column:
    """Hundredths that come as such."""
    return F.when(x != NO_SENSOR_INT, x.cast("int"))


def zones(temps: Column) -> list[Column]:
    """Outer, center and inner temperature of a side's array."""
    return [centi(F.try_element_at(temps, F.lit(i))) for i in (1, 2, 3)]


def pair_means(v: Column) -> Column:
    """Means of the three pairs of sensing channels."""
    return F.array(*((v[i] + v[i + 1]) / 2 for i in (0, 2, 4)))


def zone_triple(channels: Column) -> Column:
    """Pair means where, without the two references of eight or more channels, exactly six remain."""
    n = F.size(channels)
    return F.when(F.when(n >= 8, n - 2).otherwise(n) == 6, pair_means(channels))


def compensated(v: Column, nominal: float = NOMINAL) -> Column:
    """Pair means less the drift of the reference pair; null with a missing sensing channel."""
    drift = F.when((F.size(v) >= 8) & (F.try_element_at(v, F.lit(7)) != NO_CHANNEL) & (F.try_element_at(v, F.lit(8)) != NO_CHANNEL), (F.try_element_at(v, F.lit(7)) + F.try_element_at(v, F.lit(8))) / 2 - nominal).otherwise(0.0)
    whole = (F.size(v) >= 6) & ~F.array_contains(F.slice(v, 1, 6), F.lit(NO_CHANNEL))
    return F.when(whole, F.transform(pair_means(v), lambda x: x - drift))


def sane_time(t: Column, clock: Column, ahead: int | None = None) -> Column:
    """Epoch seconds, or the ingest clock's where they are missing, before 2020 or more than ``ahead`` later than it."""
    good = t.isNotNull() & ~F.isnan(t.cast("double")) & (t >= OLDEST)
    return F.when(good & (t <= clock + ahead if ahead is not None else F.lit(True)), t).otherwise(clock)


def delta_band(delta: Column) -> Column:
    """Band of a set point's distance from the temperature."""
    out = F.when(delta.isNull(), None)
    for limit, name in BANDS:
        out = out.when(delta <= limit, name)
    return out.otherwise("much_warmer")


def nice_max(v: Column) -> Column:
    """The next hundred, the next whole number where that is zero."""
    hundred = F.ceil(v / 100) * 100
    return F.when(hundred == 0, F.ceil(v)).otherwise(hundred)


def round1(x: Column) -> Column:
    return F.floor(x * 10 + 0.5) / 10


def slug(text: Column, default: str = "device") -> Column:
    """Lower case with hyphens for all but letters, digits, hyphens and underscores, none at the ends."""
    out = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9_-]", "-"), "^-+|-+$", "")
    return F.when(F.coalesce(out, F.lit("")) == "", default).otherwise(out)


def generation(label: Column) -> Column:
    """Hardware generation from the last segment of a label that is a letter from H on with two digits; 3 without one."""
    letters = F.filter(F.split(label, "-"), lambda s: s.rlike("^[H-Z][0-9]{2}$"))
    letter = F.substring(F.try_element_at(letters, F.lit(-1)), 1, 1)
    return F.when(letter >= "J", 5).when(letter == "I", 4).otherwise(3)


def response(text: Column) -> Column:
    """Whether a device's answer is a success."""
    low = F.lower(F.trim(text))
    return ~(low.contains("error") | low.contains("fail"))


def clock12(minute: Column) -> Column:
    """Twelve-hour text of a minute of the day."""
    hour = F.floor(minute / 60)
    shown = F.when(hour % 12 == 0, 12).otherwise(hour % 12)
    return F.format_string("%d:%02d %s", shown.cast("int"), (minute % 60).cast("int"), F.when(hour >= 12, "PM").otherwise("AM"))


def span(on: Column, off: Column) -> Column:
    """Minutes from one minute of the day to the next ``off``, over midnight where that is earlier."""
    return F.pmod(off - on, F.lit(1440))


def wall_to_utc(day: Column, minute: Column, zone: str) -> Column:
    """Epoch seconds of a local wall time."""
    midnight = F.to_timestamp(F.date_format(day, "yyyy-MM-dd"))
    local = F.timestamp_seconds(F.unix_timestamp(midnight) + minute * 60)
    return F.unix_timestamp(F.to_utc_timestamp(local, zone))


def chronological(minutes: Column) -> Column:
    """Minutes of the day in the order of a schedule: with times in both halves of the day and a gap above twelve hours it runs over midnight."""
    by_clock = F.array_sort(minutes)
    steps = F.zip_with(F.slice(by_clock, 2, F.greatest(F.size(minutes) - 1, F.lit(0))), F.slice(by_clock, 1, F.greatest(F.size(minutes) - 1, F.lit(0))), lambda b, a: b - a)
    both = F.exists(minutes, lambda m: m < 720) & F.exists(minutes, lambda m: m >= 720)
    night = both & F.exists(steps, lambda d: d > 720)
    shifted = F.transform(minutes, lambda m: F.when(night & (m < 720), m + 1440).otherwise(m))
    return F.transform(F.array_sort(shifted), lambda m: m % 1440)


def rebased(minute: Column, old: tuple[int, int], new: tuple[int, int]) -> Column:
    """A set point's minute moved from one window to another with its share of it kept; those outside go to the end."""
    was, now = (old[1] - old[0]) % 1440, (new[1] - new[0]) % 1440
    if was == 0:
        return F.pmod(minute + (new[0] - old[0]), F.lit(1440))
    share = F.least(F.pmod(minute - old[0], F.lit(1440)), F.lit(was)) / was
    return F.pmod(new[0] + F.floor(share * now + 0.5), F.lit(1440))
