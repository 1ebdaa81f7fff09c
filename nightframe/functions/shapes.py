"""Sensor frames as they come on the wire, in one flat schema: VARIANT values read by their shape.

A frame's fields differ by type, and one field's shape by firmware (a number, an array, an object of values, three named
zones). Each output column is one expression over the parsed frame, so all types are read in one pass. What has not the expected
shape is null (a pump's readings: 0); text that is no JSON gives a row with its text only; unknown types keep theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .frames import NO_SENSOR, NO_SENSOR_INT

NUMBERS = "^(BIGINT|DOUBLE|FLOAT|DECIMAL)"


def part(frame: Column, path: str) -> Column:
    """What lies at a path, as a variant; null where nothing does."""
    return F.try_variant_get(frame, f"$.{path}", "variant")


def shape(v: Column) -> Column:
    return F.schema_of_variant(v)


def number(v: Column) -> Column:
    """A number as such; no text that looks like one."""
    return F.when(shape(v).rlike(NUMBERS), F.try_variant_get(v, "$", "double"))


def items(v: Column) -> Column:
    """The elements of an array, null for another shape."""
    return F.when(shape(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>"))


def present(v: Column) -> Column:
    """Null where the value is missing or null."""
    return F.when(~F.is_variant_null(v), v)


def reading(v: Column) -> Column:
    """A number that is no mark of a missing sensor."""
    x = number(v)
    return F.when(F.abs(x - NO_SENSOR) >= 0.01, x)


def hundredth(v: Column) -> Column:
    """Hundredths as units, null for the mark of a missing sensor."""
    x = number(v)
    return F.when(F.abs(x - NO_SENSOR_INT) >= 1, x / 100)


def channels(v: Column) -> Column:
    """The channels of a side's capacitive payload: a number, an array's numbers, those of ``values``, or three zones twice each; null without any."""
    numbers = lambda a: F.filter(F.transform(a, number), lambda x: x.isNotNull())
    some = lambda a: F.when(F.size(a) > 0, a)
    values, zones = items(part(v, "values")), [number(part(v, z)) for z in ("out", "cen", "in")]
    whole = zones[0].isNotNull() & zones[1].isNotNull() & zones[2].isNotNull()
    return F.when(number(v).isNotNull(), F.array(number(v))).when(shape(v).startswith("ARRAY"), some(numbers(items(v)))).when(values.isNotNull(), some(numbers(values))).when(whole, F.array(*(z for z in zones for _ in (0, 1))))


def _positions(v: Column) -> Column:
    """The channels of a side in their places; an empty array without any."""
    held = F.coalesce(items(present(part(v, "values"))), items(v))
    return F.when(held.isNotNull(), F.transform(held, number)).when(number(v).isNotNull(), F.array(number(v))).otherwise(F.array().cast("array<double>"))


def _paired(side: Column) -> Column:
    """Three zones in the layout of six channels; a missing one keeps its places."""
    return F.array(*(reading(part(side, z)) for z in ("out", "cen", "in") for _ in (0, 1)))


def uniform(frames: DataFrame, text: str = "frame") -> DataFrame:
    """``frames`` with ``kind``, ``ts`` and the columns of all types; other columns stay."""
    rows = frames.withColumn("__f", F.try_parse_json(F.col(text)))
    f = F.col("__f")
    left, right = part(f, "left"), part(f, "right")
    kind = F.when(shape(part(f, "type")) == "STRING", F.try_variant_get(f, "$.type", "string"))
    of = lambda *names: kind.isin(*names)
    v2, v1 = of("bedTemp2"), of("bedTemp")
    temps = {s: items(part(p, "temps")) for s, p in (("left", left), ("right", right))}
    bed = {
        "ambient": (F.coalesce(reading(part(left, "amb")), reading(part(right, "amb"))), hundredth(part(f, "amb"))),
        "mcu": (reading(part(f, "mcu")), hundredth(part(f, "mcu"))),
        "humidity": (F.coalesce(reading(part(left, "hu")), reading(part(right, "hu"))), hundredth(part(f, "hu"))),
    } | {f"{s}_{n}": (reading(F.try_element_at(temps[s], F.lit(i + 1))), hundredth(part(p, z))) for s, p in (("left", left), ("right", right)) for i, (n, z) in enumerate((("outer", "out"), ("center", "cen"), ("inner", "in")))}
    columns = {k: F.when(v2, a).when(v1, b) for k, (a, b) in bed.items()}
    status = lambda *where: F.coalesce(*(F.try_variant_get(w, "$.status", "string") for w in where))
    columns |= {f"{s}_channels": F.when(of("capSense"), _paired(p)).when(of("capSense2"), _positions(p)) for s, p in (("left", left), ("right", right))}
    columns["status"] = F.when(of("capSense"), status(left, right)).when(of("capSense2"), status(f, left, right))
    columns |= {f"water_{n}": F.when(of("frzTemp"), hundredth(part(f, n))) for n in ("left", "right", "amb", "hs")}
    health = of("frzHealth")
    for s, p in (("left", left), ("right", right)):
        columns |= {f"{s}_{n}": F.when(health, F.coalesce(number(part(p, path)), F.lit(0.0))) for n, path in (("rpm", "pump.rpm"), ("duty", "pump.duty"), ("current", "tec.current"))}
        columns[f"{s}_flow"] = F.when(health, number(part(p, "temps.flowrate")))
        columns[f"{s}_power"] = F.when(of("frzTherm"), F.coalesce(number(p), number(part(p, "power")), F.lit(0.0)))
    columns |= {n: F.when(health, F.coalesce(number(part(f, path)), F.lit(0.0))) for n, path in (("fan_rpm", "fan.top.rpm"), ("fan_duty", "fan.top.duty"))}
    columns["fan_bottom_rpm"] = F.when(health, number(part(f, "fan.bottom.rpm")))
    known = of("bedTemp2", "bedTemp", "capSense", "capSense2", "frzTemp", "frzHealth", "frzTherm")
    columns["other"] = F.when(~F.coalesce(known, F.lit(False)), F.col(text))
    kept = [c for c in frames.columns if c not in {text, "kind", "ts", *columns}]
    return rows.select(*kept, kind.alias("kind"), number(part(f, "ts")).alias("ts"), *(c.alias(k) for k, c in columns.items()))
