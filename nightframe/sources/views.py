"""Sensor tables derived from the driver's tables, for the registered queries.

Every view is declared twice from one text: the same expressions make the
DataFrame and the common table expression of the oracle, so both engines see the
same rows. Times are epoch seconds; temperatures are hundredths of a degree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

START = 1704067200

#: Frames as text, one of each shape and some that are none.
N = "cast(event_id % 900 as string)"
HEAD = """'{"type":"%s","ts":' || cast(event_id as string) || ',"""
WIRE = [
    HEAD % "bedTemp2" + f"""\"mcu":30.5,"left":{{"amb":' || {N} || '.25,"hu":' || {N} || '.5,"temps":[21.5,' || {N} || '.75,22]}},"right":{{"amb":1.5,"temps":[20,-327.68,"x"]}}}}'""",
    HEAD % "bedTemp2" + f"""\"mcu":null,"left":{{"amb":-327.68,"hu":null,"temps":[' || {N} || '.5,20.25]}},"right":{{"amb":' || {N} || ',"hu":40.5}}}}'""",
    HEAD % "bedTemp" + f"""\"amb":' || {N} || ',"mcu":-32768,"hu":4100,"left":{{"out":2100,"cen":' || {N} || ',"in":"7"}},"right":{{"cen":-32768}}}}'""",
    HEAD % "bedTemp" + f"""\"amb":"warm","left":null,"right":[1,2]}}'""",
    HEAD % "capSense" + f"""\"left":{{"out":' || {N} || ',"cen":2,"in":3,"status":"good"}},"right":{{"out":null,"cen":5,"in":' || {N} || '}}}}'""",
    HEAD % "capSense2" + f"""\"left":{{"values":[1.5,2,' || {N} || ',4,5.25,6,7,8],"status":"ok"}},"right":[1,null,"a",' || {N} || '.5],"status":null}}'""",
    HEAD % "capSense2" + f"""\"left":' || {N} || '.5,"right":{{"values":"none"}},"status":"cold"}}'""",
    HEAD % "frzTemp" + f"""\"left":' || {N} || ',"right":-32768,"amb":2500.5,"hs":null}}'""",
    HEAD % "frzHealth" + f"""\"left":{{"pump":{{"rpm":' || {N} || ',"duty":0.5}},"tec":{{"current":1.25}},"temps":{{"flowrate":' || {N} || '}}}},"right":{{"pump":{{"rpm":null}}}},"fan":{{"top":{{"rpm":900,"duty":0.25}},"bottom":{{"rpm":' || {N} || '}}}}}}'""",
    HEAD % "frzHealth" + """\"left":{},"fan":{"top":5}}'""",
    HEAD % "frzTherm" + f"""\"left":' || {N} || '.5,"right":{{"power":' || {N} || '}}}}'""",
    HEAD % "frzTherm" + """\"left":null,"right":true}'""",
    HEAD % "log" + f"""\"msg":"' || {N} || '"}}'""",
    HEAD % "bedTemp2" + """\"left":{"amb":1'""",
    f"""'{{"type":5,"left":{{"out":1,"cen":2,"in":' || {N} || '}},"right":{{"values":[]}}}}'""",
]

#: Stored rules as text: five sound ones and five that are not.
K = "cast(c_custkey % 300 as string)"
_RULE = '\'{"name":"r","enabled":true,"trigger":{"kind":"tick","everyMin":5},"actions":[{"kind":"notify","message":"x"}]%s}\''
_SIGNAL, _LITERAL = '{"kind":"signal","signal":"%s"}', "{\"kind\":\"literal\",\"value\":' || %s || '}"
_COMPARE = '{"kind":"compare","op":"%s","left":%s,"right":%s}'
_WINDOW = '{"kind":"window","fn":"%s","signal":"bed.value","lastMin":%s}'
STORED = [
    _RULE % (',"conditions":' + _COMPARE % (">", _SIGNAL % "bed.value", _LITERAL % K)),
    _RULE % (',"conditions":{"kind":"and","conditions":[{"kind":"between","subject":' + _SIGNAL % "left.heartRate" + ',"min":{"kind":"literal","value":40},"max":{"kind":"literal","value":90}},{"kind":"not","condition":' + _COMPARE % (">", _SIGNAL % "bed.value", '{"kind":"binary","op":"+","left":{"kind":"literal","value":100},"right":' + _LITERAL % K + "}") + "}]}"),
    _RULE % (',"conditions":' + _COMPARE % (">", _WINDOW % ("avg", 40), '{"kind":"binary","op":"+","left":{"kind":"literal","value":50},"right":{"kind":"binary","op":"/","left":' + _LITERAL % K + ',"right":{"kind":"literal","value":4}}}')),
    _RULE % (',"conditions":{"kind":"or","conditions":[' + _COMPARE % ("<", _SIGNAL % "bed.value", _LITERAL % K) + "," + _COMPARE % (">", _SIGNAL % "no.such", _LITERAL % K) + "]}"),
    _RULE % (',"conditions":{"kind":"and","conditions":[{"kind":"timeBetween","start":"20:00","end":"07:00"},' + _COMPARE % (">", _WINDOW % ("max", 40), '{"kind":"binary","op":"*","left":' + _LITERAL % K + ',"right":{"kind":"literal","value":3}}') + "]}"),
    _RULE.replace("}'", "") % ',"conditions":{' + "'",
    _RULE % ',"conditions":{"kind":"maybe"}',
    _RULE % (',"conditions":' + '{"kind":"not","condition":' * 17 + '{"kind":"and","conditions":[]}' + "}" * 17),
    _RULE % (',"conditions":' + _COMPARE % (">", _WINDOW % ("avg", 0), _LITERAL % K)),
    _RULE % "",
]
POINTS = ["""'[{"time":"22:00","temperature":' || cast(55 + c_custkey % 50 as string) || '},{"time":"23:30","temperature":70}]'""", "'[]'", """'[{"time":"25:00","temperature":70}]'""", "'[{'"]
VECTORS = ["'[1.5,' || cast(c_custkey % 7 as string) || ',3]'", "'[1,2]'", "'[1,null,3]'"]


def cases(key: str, of: list[str]) -> str:
    """One of several expressions by a key; braces are doubled for the formatting of views."""
    return (f"case {key} % {len(of)} " + " ".join(f"when {i} then {e}" for i, e in enumerate(of)) + " end").replace("{", "{{").replace("}", "}}")


#: name: (table, {column: expression}, condition); ``{div}`` is integer division.
SPECS: dict[str, tuple[str, dict[str, str], str]] = {
    "movement": ("events", {"id": "event_id", "side": "case when event_id % 2 = 0 then 'left' else 'right' end", "t": f"{START} + (event_id {{div}} 2) * 60", "total_movement": "cast(least(1000, floor(value * 4)) as int)"}, ""),
    "vitals": ("events", {"id": "event_id", "side": "case when event_id % 2 = 0 then 'left' else 'right' end", "t": f"{START} + (event_id {{div}} 2) * 60", "heart_rate": "case when event_type = 'error' then null else cast(40 + event_id * 7 % 90 as double) end", "hrv": "cast(event_id * 13 % 320 as double)", "breathing_rate": "cast(6 + event_id * 3 % 22 as double)"}, ""),
    "bed_temp": ("events", {"t": f"{START} + event_id * 60", "ambient_temp": "case when event_id % 17 = 0 then null else 1500 + cast(floor(value * 10) as int) end", "humidity": "cast(3000 + event_id % 4000 as int)", "left_outer_temp": "cast(2000 + event_id * 11 % 900 as int)", "left_center_temp": "case when event_id % 5 = 0 then null else cast(2100 + event_id * 17 % 900 as int) end", "left_inner_temp": "case when event_id % 7 = 0 then null else cast(2050 + event_id * 23 % 900 as int) end"}, "event_type <> 'error'"),
    "freezer_temp": ("events", {"t": f"{START} + event_id * 60", "ambient_raw": "case when event_id % 50 = 0 then 32768 when event_id % 51 = 0 then -1 else cast(1800 + event_id * 7 % 11000 as int) end", "heatsink_raw": "case when event_id % 40 = 0 then 65535 else cast(2000 + event_id * 29 % 12000 as int) end", "left_water_raw": "case when event_id % 30 = 0 then -32768 else cast(event_id * 31 % 14000 - 1000 as int) end", "right_water_raw": "case when event_id % 23 = 0 then 65535 else cast(event_id * 17 % 13000 as int) end"}, ""),
    "bed_frames": ("events", {"t": f"{START} + event_id * 60", "left_amb": "case when event_type = 'error' then cast(-327.68 as double) else value / 16 end", "right_amb": "case when event_type = 'signup' then null else value / 8 end", "left_hu": "case when event_type = 'view' then null else value / 5 end", "right_hu": "value / 6", "outer_c": "value / 32", "center_c": "case when event_type = 'click' then cast(-327.68 as double) else value / 20 end", "inner_c": "value / 25", "n_temps": "case when event_type = 'purchase' then 2 else 3 end"}, ""),
    "gestures": ("events", {"tap": "case when event_type in ('click', 'view') then 'double' else 'triple' end", "t": f"{START} + event_id * 2", "l": "event_id % 60 {div} 3", "r": "event_id % 45 {div} 2"}, ""),
    "light": ("events", {"t": f"{START} + event_id * 60", "lux": "round(value * 3, 3)"}, ""),
    "flow": ("events", {"t": f"{START} + event_id * 5", "left_flow": "case when event_id % 37 = 0 then null else cast(event_id * 37 % 1200 as int) end", "right_flow": "cast(event_id * 53 % 1200 as int)", "left_rpm": "cast(case when event_id % 20 < 7 then event_id % 60 else 1900 end as int)", "right_rpm": "cast(case when event_id % 31 < 5 then 0 else 1800 + event_id % 100 end as int)"}, ""),
    "water": ("events", {"t": f"{START} + event_id * 60", "level": "case when event_type = 'error' then 'low' else 'ok' end"}, ""),
    "automations": ("customer", {"id": "c_custkey", "name": "c_name", "enabled": "c_acctbal > 0", "priority": "cast(c_nationkey as int)", "cooldown_min": "cast(c_custkey % 5 * 10 as int)"}, ""),
    "runs": ("orders", {"id": "o_orderkey", "automation_id": "o_custkey % 30", "fired_at": f"{START} + o_orderkey * 97 % 2000000", "outcome": "case when o_orderstatus = 'F' then 'fired' when o_orderstatus = 'O' then 'suppressed' else 'skipped' end"}, ""),
    "alerts": ("orders", {"id": "o_orderkey", "kind": "case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'water' else 'pump' end", "side": "case when o_custkey % 2 = 0 then 'left' else 'right' end", "t": f"{START} + o_orderkey * 61", "severity": "o_orderpriority", "acknowledged_at": f"case when o_orderstatus = 'P' then null else {START} + o_orderkey * 61 + 600 end", "dismissed_at": f"case when o_orderstatus = 'F' then {START} + o_orderkey * 61 + 3600 end"}, ""),
    "calibrations": ("part", {"id": "p_partkey", "side": "case when p_partkey % 2 = 0 then 'left' else 'right' end", "sensor": "case when p_size <= 17 then 'capacitance' when p_size <= 34 then 'piezo' else 'temperature' end", "status": "case when p_type = 'ECONOMY' then 'failed' else 'completed' end", "quality": "round(p_retailprice / 3000, 6)", "t": f"{START} + p_partkey * 90"}, ""),
    "device_state": ("supplier", {"side": "case when s_suppkey % 2 = 0 then 'left' else 'right' end", "t": f"{START} + s_suppkey * 60", "powered": "s_acctbal > 0", "target_f": "cast(60 + s_nationkey as double)", "current_f": "cast(60 + s_suppkey % 30 as double)"}, ""),
    "piezo": ("events", {"device": "user_id % 4", "t": f"{START} + event_id", "left": "case when event_id % 211 = 0 then cast(0 as double) else value * case when event_id % 97 < 6 then 400 else 1 end end", "right": "value * (0.3e0 + cast(event_id % 7 as double) / 10) * case when event_id % 97 < 6 then 400 else 1 end"}, ""),
    "samples": ("events", {"side": "case when event_id % 2 = 0 then 'left' else 'right' end", "t": f"{START} + (event_id {{div}} 2) * 7 + (event_id {{div}} 2) % 3", "present": "((event_id {div} 2) {div} 150 % 3 <> 0) <> (event_id % 82 < 2)", "a": "case when event_type = 'error' then null else value / 64 end", "b": "value / 128", "c": "cast(event_id % 13 as double) / 4", "ref": "1.16e0 + cast(event_id % 9 as double) / 100 - 0.04e0"}, ""),
    "set_points": ("part", {"id": "p_partkey", "owner": "p_partkey {div} 10", "day": "cast(p_partkey * 3 % 7 as int)", "minute": "cast(p_partkey * 37 % 1440 as int)", "temperature": "cast(60 + p_size % 30 as int)", "enabled": "p_partkey % 3 <> 0"}, ""),
    "moments": ("orders", {"id": "o_orderkey", "owner": "o_custkey % 400", "zone": "case when o_orderkey % 2 = 0 then 'America/New_York' else 'Europe/Berlin' end", "t": "case when o_orderkey % 3 = 0 then 1729728000 else 1709856000 end + o_orderkey * 977 % 2246400"}, ""),
    "wire": ("events", {"id": "event_id", "frame": cases("event_id", WIRE)}, ""),
    "stored": ("customer", {"id": "c_custkey", "owner": "c_custkey {div} 10", "rule": cases("c_custkey", STORED), "points": cases("c_custkey", POINTS), "vector": cases("c_custkey", VECTORS)}, ""),
    "steps": ("events", {"id": "event_id", "owner": "user_id {div} 10", "t": f"{START} + event_id * 30", "value": "value", "rate": "case when event_type = 'error' then null else cast(40 + event_id * 7 % 90 as double) end"}, ""),
    "recording": ("events", {"side": "case when event_id % 2 = 0 then 'left' else 'right' end", "i": "event_id {div} 2", "x": "value"}, "event_id % 997 <> 5"),
    "quality": ("events", {"vitals_id": "event_id", "quality_score": "round(value / 500, 6)"}, "event_type <> 'signup'"),
}


def _body(name: str, div: str, source: str) -> str:
    table, columns, where = SPECS[name]
    listed = ", ".join(f"{e.format(div=div)} as {c}" for c, e in columns.items())
    return f"select {listed} from {source}" + (f" where {where}" if where else "")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table as a lazy projection of its driver table."""
    if name == "sleep_records":
        return sleep_records(spark, sf_dir)
    table, columns, where = SPECS[name]
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    df = df.filter(where) if where else df
    return df.selectExpr(*(f"{e.format(div='div')} as {c}" for c, e in columns.items()))


def sleep_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session for each side and day of the movement view; the last day's is open."""
    days = view(spark, sf_dir, "movement").selectExpr("side", f"(t - {START}) div 86400 as d").distinct()
    last = days.agg({"d": "max"}).withColumnRenamed("max(d)", "last_d")
    return days.join(last.hint("broadcast")).selectExpr(
        "d * 2 + case when side = 'left' then 0 else 1 end as id", "side", f"{START} + d * 86400 + 3600 as entered", f"case when d = last_d then null else {START} + d * 86400 + 28800 end as left_at", "cast(25200 - d % 4 * 1800 as bigint) as duration", "cast(d % 3 as int) as exits"
    )


SLEEP_SQL = f"""select d * 2 + case when side = 'left' then 0 else 1 end as id, side, {START} + d * 86400 + 3600 as entered,
 case when d = (select max((t - {START}) // 86400) from movement) then null else {START} + d * 86400 + 28800 end as left_at,
 cast(25200 - d % 4 * 1800 as bigint) as duration, cast(d % 3 as int) as exits
 from (select distinct side, (t - {START}) // 86400 as d from movement)"""


def ctes(*names: str) -> str:
    """``with`` clause of the named views for the oracle."""
    order = ["movement", *names] if "sleep_records" in names else list(names)
    parts = []
    for n in dict.fromkeys(order):
        parts.append(f"{n} as ({SLEEP_SQL if n == 'sleep_records' else _body(n, '//', SPECS[n][0])})")
    return "with recursive " + ",\n".join(parts)
