import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nightframe.functions import shapes
from nightframe.operators import rules, stored_rules as s
from nightframe.plans import registry

T0 = 1704067200
OK = {"trigger": {"kind": "tick", "everyMin": 1}, "actions": [{"kind": "notify", "message": "m"}]}


def expr(rng, depth=0):
    kind = rng.choice(["literal", "signal", "window", "signal", "binary", "clamp"] if depth < 3 else ["literal", "signal"])
    if kind == "literal":
        return {"kind": kind, "value": rng.choice([0, 1, 2.5, 40])}
    if kind == "signal":
        return {"kind": kind, "signal": rng.choice(["a", "b"])}
    if kind == "window":
        return {"kind": kind, "fn": rng.choice(["avg", "min", "max", "sum", "count"]), "signal": rng.choice(["a", "b"]), "lastMin": rng.choice([1, 7, 30])}
    if kind == "binary":
        return {"kind": kind, "op": rng.choice("+-*/"), "left": expr(rng, depth + 1), "right": expr(rng, depth + 1)}
    return {"kind": kind, **{k: expr(rng, depth + 1) for k in ("value", "min", "max")}}


def cond(rng, depth=0):
    kind = rng.choice(["and", "or", "not", "compare", "between", "timeBetween", "onDays"] if depth < 3 else ["compare"])
    if kind in ("and", "or"):
        return {"kind": kind, "conditions": [cond(rng, depth + 1) for _ in range(rng.randrange(4))]}
    if kind == "not":
        return {"kind": kind, "condition": cond(rng, depth + 1)}
    if kind == "compare":
        return {"kind": kind, "op": rng.choice([">", ">=", "<", "<=", "==", "!="]), "left": expr(rng), "right": expr(rng)}
    if kind == "between":
        return {"kind": kind, "subject": expr(rng), "min": expr(rng), "max": expr(rng)}
    if kind == "timeBetween":
        return {"kind": kind, "start": rng.choice(["00:10", "23:50"]), "end": "00:40"}
    return {"kind": kind, "days": rng.sample(s.DAYS, 3)}


def compiled(tree):
    """A stored tree in the form that is compiled to columns."""
    if isinstance(tree, list):
        return [compiled(x) for x in tree]
    if not isinstance(tree, dict):
        return tree
    out = {k: compiled(v) for k, v in tree.items()}
    if tree["kind"] == "signal":
        out["key"] = out.pop("signal")
    if tree["kind"] == "between":
        out["value"] = out.pop("subject")
    if tree["kind"] == "onDays":
        out["days"] = [s.DAYS.index(d) for d in tree["days"]]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_random_rules_equal_their_compiled_form(spark, seed):
    rng = random.Random(seed)
    trees = [cond(rng) for _ in range(25)]
    t, steps = T0 - 1800, []
    for i in range(150):
        t += rng.choice([20, 60, 400])
        steps.append(("x", t, rng.choice([None, 0.0, 1.0, 2.5, 41.0]), rng.choice([None, 3.0, 40.0])))
    df = spark.createDataFrame(steps, "o string, t long, a double, b double")
    table = spark.createDataFrame([("x", i, json.dumps(OK | {"conditions": c})) for i, c in enumerate(trees)], "o string, id int, rule string")
    got = {(r["id"], r["t"]): r["holds"] for r in s.evaluated(df, s.parsed(table), "o", {"a": "a", "b": "b"}).collect()}
    rows = df.withColumn("all", F.lit("x"))
    want = rows.select("t", *(rules.condition(compiled(c), ["all"]).alias(f"c{i}") for i, c in enumerate(trees))).collect()
    assert len(got) == 25 * 150
    for r in want:
        for i in range(25):
            assert got[i, r["t"]] == r[f"c{i}"], (trees[i], r["t"])


def test_windows_see_over_midnight_and_blocks_cover_all_rules(spark, monkeypatch):
    monkeypatch.setattr(s, "BLOCK", 3)
    steps = spark.createDataFrame([("x", T0 + 86400 + 600 * k, float(k)) for k in range(-4, 5)] + [("y", T0, 1.0), (None, T0, 1.0), ("x", None, 1.0)], "o string, t long, a double")
    rule = lambda i: OK | {"conditions": {"kind": "compare", "op": ">=", "left": {"kind": "window", "fn": "count", "signal": "a", "lastMin": 30}, "right": {"kind": "literal", "value": i}}}
    table = spark.createDataFrame([("x", i, json.dumps(rule(i))) for i in range(10)] + [("z", 99, json.dumps(rule(1)))], "o string, id int, rule string")
    got = s.evaluated(steps, s.parsed(table), "o", {"a": "a"}).groupBy("id").agg(F.count_if("holds").alias("n"), F.count("*").alias("c")).collect()
    assert sorted((r["id"], r["n"], r["c"]) for r in got) == [(0, 9, 9), (1, 9, 9), (2, 8, 9), (3, 7, 9), (4, 6, 9), *((i, 0, 9) for i in range(5, 10))]


BAD = [
    (None, "no JSON"), ("", "no JSON"), ("[1]", "no JSON"), ("{", "no JSON"), ("{}", "no trigger"),
    (OK, "no conditions"), (OK | {"conditions": {"kind": "or", "conditions": [{"kind": "or"}]}}, "or lacks conditions"),
    (OK | {"conditions": {"kind": "onDays", "days": ["someday"]}}, "onDays has a bad days"), (OK | {"conditions": {"kind": "and", "conditions": [], "x": 1}}, "and has x"),
    (OK | {"conditions": {"kind": "and", "conditions": [{"kind": "and", "conditions": []}] * 25}}, "and has no list of at most 24"),
    (OK | {"conditions": {"kind": "and", "conditions": []}, "actions": []}, "no list of actions"),
    (OK | {"conditions": {"kind": "and", "conditions": []}, "actions": [{"kind": "setTemperature", "temp": {"kind": "literal", "value": 1}, "clamp": {"min": 80, "max": 70}}]}, "setTemperature has a bad clamp"),
    (OK | {"conditions": {"kind": "and", "conditions": [{"kind": "and", "conditions": [{"kind": "timeBetween", "start": "01:00", "end": "02:00"}] * 24}] * 17}}, "too large"),
    (OK | {"conditions": {"kind": "and", "conditions": [{"kind": "timeBetween", "start": "01:00", "end": "24:00"}]}}, "timeBetween has a bad end"),
]


def test_bad_rules_are_told_and_not_fatal(spark):
    good = OK | {"name": "n", "enabled": True, "conditions": {"kind": "and", "conditions": []}, "actions": [{"kind": "setPower", "on": False, "side": "left"}]}
    rows = [(i, x if x is None or isinstance(x, str) else json.dumps(x), "old") for i, (x, _) in enumerate([*BAD, (good, None)])]
    got = {r["id"]: r for r in s.parsed(spark.createDataFrame(rows, "id int, rule string, problem string")).collect()}
    assert [got[i]["problem"] for i in range(len(rows))] == [p for _, p in BAD] + [None]
    assert got[len(BAD)]["name"] == "n" and got[len(BAD)]["enabled"] is True and got[2]["rule"] == "[1]"
    assert s.parsed(spark.createDataFrame([], "id int, rule string")).collect() == []


def test_shapes(spark):
    texts = [(1, '{"left":[1,"2",null,3.5],"right":{"out":1,"cen":2,"in":"3"}}'), (2, '{"left":"7","right":true}'), (3, None), (4, "{"), (5, '{"left":{"values":["a"]},"right":-1}'), (6, '{"type":"bedTemp2","ts":5,"left":{"temps":"no"}}'), (7, "[]")]
    df = spark.createDataFrame(texts, "id int, frame string").withColumn("kind", F.lit("old"))
    got = {r["id"]: (r["l"], r["r"]) for r in df.select("id", *(shapes.channels(shapes.part(F.try_parse_json("frame"), n)).alias(n[0]) for n in ("left", "right"))).collect()}
    assert got == {1: ([1.0, 3.5], None), 2: (None, None), 3: (None, None), 4: (None, None), 5: (None, [-1.0]), 6: (None, None), 7: (None, None)}
    rows = {r["id"]: r for r in shapes.uniform(df).collect()}
    assert rows[6]["kind"] == "bedTemp2" and rows[6]["ts"] == 5 and rows[6]["left_outer"] is None and rows[6]["other"] is None
    assert rows[4]["other"] == "{" and rows[1]["kind"] is None and rows[1]["other"] == texts[0][1]


def test_sums_of_windows_hold_nothing_of_earlier_values():
    rng = random.Random(5)
    t = [600 * k + k % 3 for k in range(20_000)]
    x = [rng.randrange(56_000) / 100 for _ in t]
    one = s.Steps(np.array(t), {"x": np.array(x)}, 0)
    assert (one.window("avg", "x", 1) == x).all()
    assert (one.window("sum", "x", 11)[1:] == [a + b for a, b in zip(x, x[1:])]).all()
    assert (one.window("sum", "x", 60) == [math.fsum(v for v, u in zip(x[max(0, k - 9) : k + 1], t[max(0, k - 9) : k + 1]) if u >= t[k] - 3600) for k in range(len(t))]).all()


def test_groups_run_over_batches_and_are_counted_in_the_tasks(spark, monkeypatch):
    monkeypatch.setattr(s, "BLOCK", 3)
    rng = random.Random(7)
    steps = [(o, T0 + 90_000 * i + rng.randrange(3), rng.choice([None, 1.0, 2.5, 41.0]), None) for o in ("a", "b", "", None) for i in range(40)]
    df = spark.createDataFrame(steps, "o string, t int, a double, b double")
    table = spark.createDataFrame([(o, i, json.dumps(OK | {"conditions": cond(rng)})) for o in ("a", "", "c", None) for i in [*range(9), None]], "o string, id int, rule string")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = []
    for n in (size, "7"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
        try:
            each = s.evaluated(df, s.parsed(table), "o", {"a": "a", "b": "b", "c": "a"})
            assert dict(each.dtypes) == {"o": "string", "id": "int", "t": "int", "holds": "boolean"}
            counted = each.groupBy("o", "id").agg(F.count("*"), F.count_if("holds"), F.count_if(F.col("holds").isNull()))
            told = s.tallied(df, s.parsed(table), "o", {"a": "a", "b": "b", "c": "a"}).groupBy("o", "id").agg(F.sum("steps"), F.sum("held"), F.sum("unknown"))
            got += [sorted(map(repr, map(tuple, x.collect()))) for x in (counted, told)]
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert len(got[0]) == 20 and got[1:] == got[:1] * 3


def test_rules_are_dealt_out_and_checked_once(spark):
    told = registry.QUERIES["rule_stored"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "wrong(" not in told and "CoGroup" not in told  # the sound ones are read from a table, groups are streamed
    sound = s.parsed(spark.createDataFrame([("x", 1, "{}")], "o string, id int, rule string")).filter("problem is null")
    lines = sound._jdf.queryExecution().optimizedPlan().toString().split("\n")
    at = lambda what: next(i for i, line in enumerate(lines) if what in line)
    assert at("wrong(") < at("Repartition")
