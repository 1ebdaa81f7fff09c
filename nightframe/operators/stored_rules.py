"""Rules as a table of JSON texts: checked without failing, and all of them evaluated in one plan.

A stored rule is text. Its top level is parsed permissively, so a broken row keeps its text and says what is wrong; its trees, which may nest
to any depth, stay text there and are checked in the tasks. Sound conditions are evaluated by numpy over time segments of each
owner's steps: a group holds one segment and at most ``BLOCK`` rules, so neither a long history nor many rules meet
in one task, and a thousand rules add rows, not plan nodes. Groups are small and many, so they are not handed over one by one: sorted
partitions are streamed through the tasks in large batches and cut into groups there.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from ..sources import shared
from . import segments as g
from .rules import MAX_DEPTH, MAX_NODES

BLOCK = 64
#: Seconds of a segment of steps: a week of minutes is some ten thousand.
SEGMENT = 7 * g.DAY
#: Top level of a stored rule; trees stay text.
TOP = "name string, enabled boolean, side string, cooldownMin double, dryRun boolean, trigger string, conditions string, actions string, _corrupt_record string"
DAYS = ["sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday"]

_number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
_whole = lambda lo, hi: lambda v: isinstance(v, int) and not isinstance(v, bool) and lo <= v <= hi
_one = lambda *of: lambda v: isinstance(v, str) and v in of
_text = lambda pattern: lambda v: isinstance(v, str) and re.fullmatch(pattern, v) is not None
_clock, _signal = _text("([01][0-9]|2[0-3]):[0-5][0-9]"), _text(r"(?i)[a-z][a-z0-9]*(\.[a-z0-9]+)*")
_days = lambda v: isinstance(v, list) and len(v) > 0 and all(d in DAYS for d in v)
_band = lambda v: isinstance(v, dict) and set(v) == {"min", "max"} and all(_number(x) and 55 <= x <= 110 for x in v.values()) and v["min"] <= v["max"]
EXPR, COND, CONDS = "expression", "condition", "conditions"
# fixed values: the fields of each kind of node, what they hold, and which may be missing
EXPRESSIONS = {
    "literal": {"value": _number},
    "signal": {"signal": _signal},
    "window": {"fn": _one("avg", "min", "max", "sum", "count"), "signal": _signal, "lastMin": _whole(1, 1440)},
    "binary": {"op": _one("+", "-", "*", "/"), "left": EXPR, "right": EXPR},
    "clamp": {"value": EXPR, "min": EXPR, "max": EXPR},
}
CONDITIONS = {
    "and": {"conditions": CONDS},
    "or": {"conditions": CONDS},
    "not": {"condition": COND},
    "compare": {"op": _one(">", ">=", "<", "<=", "==", "!="), "left": EXPR, "right": EXPR},
    "between": {"subject": EXPR, "min": EXPR, "max": EXPR},
    "timeBetween": {"start": _clock, "end": _clock},
    "onDays": {"days": _days},
}
TRIGGERS = {"tick": {"everyMin": _whole(1, 1440)}, "signalChange": {"signal": _signal}, "timeOfDay": {"at": _clock, "days": _days}}
ACTIONS = {
    "notify": {"message": lambda v: isinstance(v, str) and 1 <= len(v) <= 280},
    "setTemperature": {"temp": EXPR, "side": _one("left", "right"), "clamp": _band, "durationSec": _whole(0, 86400)},
    "setPower": {"on": lambda v: isinstance(v, bool), "side": _one("left", "right"), "temp": EXPR},
}
OPTIONAL = {("timeOfDay", "days"), ("setTemperature", "side"), ("setTemperature", "clamp"), ("setTemperature", "durationSec"), ("setPower", "side"), ("setPower", "temp")}


class Unsound(ValueError):
    """What is wrong with a rule."""


def _check(node, kinds: dict, depth: int, seen: list[int]) -> None:
    if not isinstance(node, dict) or not isinstance(node.get("kind"), str) or node["kind"] not in kinds:
        raise Unsound(f"unknown kind {node.get('kind')!r}" if isinstance(node, dict) else "not an object")
    if kinds in (EXPRESSIONS, CONDITIONS):
        seen[0] += 1
        if depth > MAX_DEPTH:
            raise Unsound("too deep")
        if seen[0] > MAX_NODES:
            raise Unsound("too large")
    fields = kinds[node["kind"]]
    if more := set(node) - set(fields) - {"kind"}:
        raise Unsound(f"{node['kind']} has {min(more)}")
    for name, what in fields.items():
        if name not in node:
            if (node["kind"], name) not in OPTIONAL:
                raise Unsound(f"{node['kind']} lacks {name}")
        elif what == EXPR:
            _check(node[name], EXPRESSIONS, depth + 1, seen)
        elif what == COND:
            _check(node[name], CONDITIONS, depth + 1, seen)
        elif what == CONDS:
            if not isinstance(node[name], list) or len(node[name]) > 24:
                raise Unsound(f"{node['kind']} has no list of at most 24")
            for kid in node[name]:
                _check(kid, CONDITIONS, depth + 1, seen)
        elif not what(node[name]):
            raise Unsound(f"{node['kind']} has a bad {name}")


def problem(trigger: str | None, conditions: str | None, actions: str | None) -> str | None:
    """What is wrong with a rule's trees, nothing for a sound rule."""
    try:
        trees = []
        for name, text in (("trigger", trigger), ("conditions", conditions), ("actions", actions)):
            if text is None:
                raise Unsound(f"no {name}")
            trees.append(json.loads(text))
        seen = [0]
        _check(trees[0], TRIGGERS, 0, seen)
        _check(trees[1], CONDITIONS, 1, seen)
        if not isinstance(trees[2], list) or not trees[2]:
            raise Unsound("no list of actions")
        for action in trees[2]:
            _check(action, ACTIONS, 0, seen)
    except (Unsound, json.JSONDecodeError, RecursionError) as e:
        return str(e) if isinstance(e, Unsound) else "no JSON"
    return None


def parsed(rules: DataFrame, text: str = "rule") -> DataFrame:
    """``rules`` with the columns of ``TOP`` but the last, and ``problem``: null for a sound rule; a column of one of these names is replaced.

    Small texts are costly to check, so they are dealt out first, as a file of all of them may be one task's, and the check is marked so that
    a filter of its result doesn't move it to where the file is read.
    """

    @F.pandas_udf("string")
    def wrong(trigger: pd.Series, conditions: pd.Series, actions: pd.Series) -> pd.Series:
        return pd.Series([problem(*(None if pd.isna(x) else x for x in row)) for row in zip(trigger, conditions, actions)], dtype=object)

    wrong = wrong.asNondeterministic()
    made = [f.split()[0] for f in TOP.split(", ")][:-1]
    rows = rules.drop(*(c for c in [*made, "problem"] if c != text)).repartition(int(rules.sparkSession.conf.get("spark.sql.shuffle.partitions"))).withColumn("__r", F.from_json(text, TOP, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    broken = F.col(text).isNull() | F.col("__r").isNull() | F.col("__r._corrupt_record").isNotNull()
    rows = rows.select(*(c for c in rows.columns if c != "__r"), *(F.col(f"__r.{c}").alias(c) for c in made), broken.alias("__broken"))
    return rows.withColumn("problem", F.when(F.col("__broken"), "no JSON").otherwise(wrong("trigger", "conditions", "actions"))).drop("__broken")


def problems(checked: DataFrame) -> DataFrame:
    """(problem, rules): how many rules have it; sound ones under null."""
    return checked.groupBy("problem").agg(F.count("*").alias("rules"))


def longest(tree) -> int:
    """Minutes of a tree's longest window."""
    kids = tree.values() if isinstance(tree, dict) else tree if isinstance(tree, list) else ()
    own = tree["lastMin"] if isinstance(tree, dict) and tree.get("kind") == "window" else 0
    return max([own, *map(longest, kids)])


def _sums(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The sums of ``x[lo:hi]``: differences of running sums, with what each addition rounded off, so that earlier values leave no trace."""
    total = np.append(0.0, np.cumsum(x))
    lost = np.append(0.0, np.cumsum(_rounded_off(total[:-1], x, total[1:])))
    near = total[hi] - total[lo]
    exact = near + (_rounded_off(total[hi], -total[lo], near) + (lost[hi] - lost[lo]))
    return np.where(np.isfinite(exact), exact, near)


def _rounded_off(a: np.ndarray, b: np.ndarray, total: np.ndarray) -> np.ndarray:
    """What ``a + b`` is more than its rounded ``total``."""
    with np.errstate(invalid="ignore"):
        back = total - a
        return (a - (total - back)) + (b - back)


class Steps:
    """Signals of a segment's steps, in time order; unknown numbers are not-a-number."""

    def __init__(self, t: np.ndarray, signals: dict[str, np.ndarray], offset: int):
        self.t, self.signals, self.windows = t, signals, {}
        self.unknown = np.full(len(t), np.nan)
        local = t + offset
        self.minute, self.day = local % 86400 // 60, (local // 86400 + 4) % 7

    def window(self, fn: str, signal: str, minutes: int) -> np.ndarray:
        """The known values of the last ``minutes``, both ends included, of each step."""
        x = self.signals.get(signal, self.unknown)
        lo, hi = np.searchsorted(self.t, self.t - 60 * minutes, "left"), np.searchsorted(self.t, self.t, "right")
        known = ~np.isnan(x)
        count = np.append(0, np.cumsum(known))
        n = (count[hi] - count[lo]).astype(float)
        if fn == "count":
            return n
        with np.errstate(invalid="ignore", divide="ignore"):
            if fn in ("sum", "avg"):
                total = np.where(n > 0, _sums(np.where(known, x, 0.0), lo, hi), np.nan)
                return total if fn == "sum" else total / n
        # extremes by ranges of powers of two
        best, worst = (np.fmin, np.inf) if fn == "min" else (np.fmax, -np.inf)
        table, width = [np.where(known, x, worst)], 1
        while 2 * width <= len(x):
            table.append(best(table[-1][:-width], table[-1][width:]))
            width *= 2
        level = np.log2(np.maximum(hi - lo, 1)).astype(int)
        out = self.unknown.copy()
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            out[at] = best(table[k][lo[at]], table[k][hi[at] - (1 << k)])
        return np.where(n > 0, out, np.nan)

    def number(self, e: dict) -> np.ndarray:
        kind = e["kind"]
        if kind == "literal":
            return np.full(len(self.t), float(e["value"]))
        if kind == "signal":
            return self.signals.get(e["signal"], self.unknown)
        if kind == "window":
            key = (e["fn"], e["signal"], e["lastMin"])
            if key not in self.windows:
                self.windows[key] = self.window(*key)
            return self.windows[key]
        if kind == "clamp":
            x, lo, hi = (self.number(e[k]) for k in ("value", "min", "max"))
            return np.where(np.isnan(x), x, np.fmin(np.fmax(x, lo), hi))
        a, b = self.number(e["left"]), self.number(e["right"])
        with np.errstate(all="ignore"):
            return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: np.where(b == 0, np.nan, a / b)}[e["op"]]()

    def truth(self, c: dict) -> np.ndarray:
        """1, 0 or not-a-number: the least of an ``and`` is its value but for unknowns, which a 0 outweighs."""
        kind = c["kind"]
        if kind in ("and", "or"):
            parts = np.array([self.truth(x) for x in c["conditions"]]).reshape(-1, len(self.t))
            if kind == "and":
                return np.where((parts == 0).any(axis=0), 0.0, np.where(np.isnan(parts).any(axis=0), np.nan, 1.0))
            return np.where((parts == 1).any(axis=0), 1.0, np.where(np.isnan(parts).any(axis=0), np.nan, 0.0))
        if kind == "not":
            return 1 - self.truth(c["condition"])
        if kind == "timeBetween":
            lo, hi = (int(c[k][:2]) * 60 + int(c[k][3:]) for k in ("start", "end"))
            return (((self.minute >= lo) & (self.minute < hi)) if lo <= hi else ((self.minute >= lo) | (self.minute < hi))).astype(float)
        if kind == "onDays":
            return np.isin(self.day, [DAYS.index(d) for d in c["days"]]).astype(float)
        if kind == "between":
            x, lo, hi = (self.number(c[k]) for k in ("subject", "min", "max"))
            return np.where(np.isnan(x) | np.isnan(lo) | np.isnan(hi), np.nan, (x >= lo) & (x <= hi))
        a, b = self.number(c["left"]), self.number(c["right"])
        test = {">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b, "==": a == b, "!=": a != b}[c["op"]]
        return np.where(np.isnan(a) | np.isnan(b), np.nan, test)


@lru_cache(4096)
def _tree(text: str) -> dict:
    return json.loads(text)


def _groups(batches: Iterator[pa.RecordBatch], on: list[str], arrays: Callable[[pa.RecordBatch], list]) -> Iterator[list]:
    """``arrays`` of each group of sorted rows, which may run over several batches."""
    join = lambda parts: parts[0] if len(parts) == 1 else np.concatenate(parts) if isinstance(parts[0], np.ndarray) else pa.concat_arrays(parts)
    whole = lambda pieces: [join(parts) for parts in zip(*pieces)]
    held, last = [], None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys, values = [batch.column(batch.schema.get_field_index(c)) for c in on], arrays(batch)
        new = np.zeros(n - 1, bool)
        for k in keys:
            new |= pc.not_equal(k.slice(1), k.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(new) + 1).tolist(), n]
        if held and last != [k[0] for k in keys]:
            yield whole(held)
            held = []
        for lo, hi in zip(edges, edges[1:]):
            if lo:
                yield whole(held)
                held = []
            held.append([v[lo:hi] for v in values])
        last = [k[n - 1] for k in keys]
    if held:
        yield whole(held)


def _run(steps: DataFrame, checked: DataFrame, owner: str, signals: dict[str, str], rule_id: str, t: str, offset: int, told: Callable, out: str) -> DataFrame:
    """(owner, id, out): of each group and rule the arrays that ``told`` makes of the own steps' times and truths, the rule's id for each."""
    columns = list(dict.fromkeys(signals.values()))
    steps = steps.select(owner, t, *(F.col(c).cast("double").alias(c) for c in columns)).dropna(subset=[owner, t])

    @F.pandas_udf("int")
    def reach(conditions: pd.Series) -> pd.Series:
        return conditions.map(lambda c: longest(json.loads(c))).astype("int32")

    # written, as each read of them would check all texts again
    sound = checked.filter("problem is null").select(owner, rule_id, "conditions")
    sound = shared.written(sound.withColumn("__reach", reach("conditions")), "rules")
    minutes = sound.agg(F.max("__reach")).first()[0] or 0
    counts = sound.groupBy(owner).agg(F.ceil(F.count("*") / BLOCK).alias("__blocks"))
    sound = sound.join(counts, owner).select(owner, F.pmod(F.xxhash64(rule_id), F.col("__blocks")).alias("__block"), F.col(rule_id).alias("__rule"), F.col("conditions").alias("__tree"))
    rows = g.carried(steps, [owner], seconds=60 * minutes, t=t, width=SEGMENT)
    on = [owner, "__seg", "__block"]
    left = rows.join(sound.select(owner, "__block").distinct(), owner)
    right = rows.filter("__own").select(owner, "__seg").distinct().join(sound, owner)
    both = left.unionByName(right, allowMissingColumns=True).repartition(*on).sortWithinPartitions(*on, F.col(t).asc_nulls_first())
    schema = StructType([both.schema[owner], both.schema["__rule"], *StructType.fromDDL(out)])

    def arrays(batch: pa.RecordBatch) -> list:
        c = lambda name: batch.column(batch.schema.get_field_index(name))
        plain = lambda x: x.to_numpy(zero_copy_only=False)
        return [c(owner), c("__rule"), c("__tree"), plain(c("__tree").is_valid()), plain(c("__own").fill_null(False)), plain(c(t).cast("int64", safe=False).fill_null(0)), *(plain(c(x)) for x in columns)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, waiting = [], 0
        for owners, ids, texts, rule, own, times, *values in _groups(batches, on, arrays):
            n = int(rule.sum())  # rules have no time and come first
            own = own[n:]
            if not n or not own.any():
                continue
            held = Steps(times[n:], {k: values[columns.index(c)][n:] for k, c in signals.items()}, offset)
            for i in range(n):
                got = told(held.t[own], held.truth(_tree(texts[i].as_py()))[own])
                at = pa.array(np.full(len(got[0]), i))
                made.append(pa.RecordBatch.from_arrays([owners.take(at), ids.take(at), *got], names=schema.names))
                waiting += len(at)
            if waiting >= 10_000 or len(made) >= 1_000:
                yield from pa.Table.from_batches(made).combine_chunks().to_batches()
                made, waiting = [], 0
        if made:
            yield from pa.Table.from_batches(made).combine_chunks().to_batches()

    return both.mapInArrow(run, schema).withColumnRenamed("__rule", rule_id)


def evaluated(steps: DataFrame, checked: DataFrame, owner: str, signals: dict[str, str], rule_id: str = "id", t: str = "t", offset: int = 0) -> DataFrame:
    """(owner, id, t, holds): whether each sound rule of an owner holds at each of the owner's steps; null is unknown.

    ``signals`` maps the signals that rules name to columns of ``steps``; others are unknown. ``offset``: seconds of the clock ahead of
    UTC. Steps without an owner or time are left out. The sound rules are a table of the shared folder, which is not removed.
    """
    kind = steps.schema[t].dataType
    told = lambda times, truth: [pa.array(times).cast("int64"), pa.array(truth == 1, mask=np.isnan(truth))]
    return _run(steps, checked, owner, signals, rule_id, t, offset, told, f"`{t}` bigint, holds boolean").withColumn(t, F.col(t).cast(kind))


def tallied(steps: DataFrame, checked: DataFrame, owner: str, signals: dict[str, str], rule_id: str = "id", t: str = "t", offset: int = 0) -> DataFrame:
    """(owner, id, steps, held, unknown): the rows of ``evaluated`` counted in the tasks, some rows for each rule."""
    told = lambda times, truth: [pa.array([x], pa.int64()) for x in (len(truth), int((truth == 1).sum()), int(np.isnan(truth).sum()))]
    return _run(steps, checked, owner, signals, rule_id, t, offset, told, "steps bigint, held bigint, unknown bigint")


# other stored values


def set_points(text: Column) -> Column:
    """The set points of a stored list; an empty list where the text is no list of sound ones."""
    points = F.from_json(text, "array<struct<time: string, temperature: double>>", {"mode": "PERMISSIVE"})
    sound = F.forall(points, lambda p: F.coalesce(p["time"].rlike("^([01][0-9]|2[0-3]):[0-5][0-9]$") & p["temperature"].between(55, 110), F.lit(False)))
    return F.when(F.coalesce(sound, F.lit(False)), points).otherwise(F.array().cast("array<struct<time: string, temperature: double>>"))


def zones(text: Column) -> Column:
    """A vector of three numbers, null for anything else."""
    v = F.from_json(text, "array<double>", {"mode": "PERMISSIVE"})
    return F.when((F.size(v) == 3) & F.forall(v, lambda x: x.isNotNull()), v)
