"""Queries of frames read by their shape."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import shapes as s
from .core import reg

NUMERIC = "json_type({0}) in ('DOUBLE', 'BIGINT', 'UBIGINT', 'HUGEINT')"
#: A number at a path of the frame j, one that is no missing sensor, and hundredths.
NUM = lambda j, p="$": f"case when {NUMERIC.format(f'json_extract({j}, {chr(39)}{p}{chr(39)})')} then cast(json_extract_string({j}, '{p}') as double) end"
READ = lambda j, p: f"case when abs({NUM(j, p)} + 327.68) >= 0.01 then {NUM(j, p)} end"
CENT = lambda j, p: f"case when abs({NUM(j, p)} + 32768) >= 1 then {NUM(j, p)} / 100 end"
PARSED = ", j as (select id, frame, case when json_valid(frame) then json(frame) end as j from wire), f as (select id, frame, j, case when json_type(j, '$.type') = 'VARCHAR' then json_extract_string(j, '$.type') end as kind from j)"
ELEMENTS = lambda j, p: f"list_transform(cast(case when json_type({j}, '{p}') = 'ARRAY' then json_extract({j}, '{p}') end as json[]), lambda e: {NUM('e')})"
CHANNELS = lambda p: f"case when {NUM('j', p)} is not null then [{NUM('j', p)}] when json_type(j, '{p}') = 'ARRAY' then list_filter({ELEMENTS('j', p)}, lambda x: x is not null) when json_type(j, '{p}.values') = 'ARRAY' then list_filter({ELEMENTS('j', p + '.values')}, lambda x: x is not null) when " + " and ".join(f"{NUM('j', p + '.' + z)} is not null" for z in ("out", "cen", "in")) + " then [" + ", ".join(NUM("j", f"{p}.{z}") for z in ("out", "out", "cen", "cen", "in", "in")) + "] end"
NONE = "case when len({0}) > 0 then {0} end"


@reg("norm_cap_channels", PARSED + f", c as (select id, {CHANNELS('$.left')} as l, {CHANNELS('$.right')} as r from f) select id, {NONE.format('l')} as left_channels, {NONE.format('r')} as right_channels from c", "wire")
def cap_channels(wire):
    """Both sides' channels of every frame, whatever their shape."""
    rows = wire.withColumn("f", F.try_parse_json("frame"))
    return rows.select("id", *(s.channels(s.part(F.col("f"), side)).alias(f"{side}_channels") for side in ("left", "right")))


def _frame_sql() -> str:
    out, sides = [], ("left", "right")
    either = lambda n: f"coalesce({READ('j', '$.left.' + n)}, {READ('j', '$.right.' + n)})"
    bed = {"ambient": (either("amb"), CENT("j", "$.amb")), "mcu": (READ("j", "$.mcu"), CENT("j", "$.mcu")), "humidity": (either("hu"), CENT("j", "$.hu"))}
    bed |= {f"{d}_{n}": (READ("j", f"$.{d}.temps[{i}]"), CENT("j", f"$.{d}.{z}")) for d in sides for i, (n, z) in enumerate((("outer", "out"), ("center", "cen"), ("inner", "in")))}
    out += [f"case kind when 'bedTemp2' then {a} when 'bedTemp' then {b} end as {k}" for k, (a, b) in bed.items()]
    for d in sides:
        p = f"$.{d}"
        paired = "[" + ", ".join(READ("j", f"{p}.{z}") for z in ("out", "out", "cen", "cen", "in", "in")) + "]"
        out.append(f"case kind when 'capSense' then {paired} when 'capSense2' then coalesce({ELEMENTS('j', p + '.values')}, {ELEMENTS('j', p)}, case when {NUM('j', p)} is not null then [{NUM('j', p)}] end, []) end as {d}_channels")
    status = lambda *w: "coalesce(" + ", ".join(f"json_extract_string(j, '{p}status')" for p in w) + ")"
    out.append(f"case kind when 'capSense' then {status('$.left.', '$.right.')} when 'capSense2' then {status('$.', '$.left.', '$.right.')} end as status")
    out += [f"case when kind = 'frzTemp' then {CENT('j', '$.' + n)} end as water_{n}" for n in ("left", "right", "amb", "hs")]
    for d in sides:
        out += [f"case when kind = 'frzHealth' then coalesce({NUM('j', f'$.{d}.{p}')}, 0) end as {d}_{n}" for n, p in (("rpm", "pump.rpm"), ("duty", "pump.duty"), ("current", "tec.current"))]
        out += [f"case when kind = 'frzHealth' then {NUM('j', f'$.{d}.temps.flowrate')} end as {d}_flow", f"case when kind = 'frzTherm' then coalesce({NUM('j', '$.' + d)}, {NUM('j', f'$.{d}.power')}, 0) end as {d}_power"]
    out += [f"case when kind = 'frzHealth' then coalesce({NUM('j', p)}, 0) end as {n}" for n, p in (("fan_rpm", "$.fan.top.rpm"), ("fan_duty", "$.fan.top.duty"))]
    out += [f"case when kind = 'frzHealth' then {NUM('j', '$.fan.bottom.rpm')} end as fan_bottom_rpm", "case when coalesce(kind not in ('bedTemp2', 'bedTemp', 'capSense', 'capSense2', 'frzTemp', 'frzHealth', 'frzTherm'), true) then frame end as other"]
    return PARSED + f" select id, kind, {NUM('j', '$.ts')} as ts, " + ",\n ".join(out) + " from f"


reg("norm_frame_ui", _frame_sql(), "wire")(s.uniform)
