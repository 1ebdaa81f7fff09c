"""Ordered work over long keyed series in parallel time segments, without a cut at their edges.

A key may hold most rows, so a window by key alone would be one task. Each helper
deals rows out by key and time segment and carries over an edge what the next
segment needs: some rows, the last value, a count, or the state of a fold. What
passes between segments is one small row for each of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

DAY, HOUR = 86400, 3600


def segment_of(t: str = "t", width: int = DAY) -> Column:
    return F.floor(F.col(t) / width)


def _neighbours(rows: DataFrame, keys: list[str], t: str, n: int, back: bool) -> DataFrame:
    """The rows that other segments need: the last ``n`` before each (``back``) or the first ``n`` after it."""
    on = [*keys, "__seg"]
    order = (lambda c: F.desc(c)) if back else (lambda c: F.asc(c))
    counts = rows.groupBy(*on).agg(F.count("*").alias("c"))
    # a segment has a row at least, so what n rows take lies in n segments
    w = Window.partitionBy(*keys).orderBy(F.asc("__seg") if back else F.desc("__seg")).rowsBetween(-n, -1)
    near = F.reverse(F.collect_list(F.struct("__seg", "c")).over(w))
    passed = F.transform(F.col("near"), lambda x, i: F.struct(x["__seg"].alias("from"), F.aggregate(F.slice("near", 1, i), F.lit(0).cast("long"), lambda a, y: a + y["c"]).alias("gap")))
    need = counts.withColumn("near", near).withColumn("x", F.explode(F.filter(passed, lambda x: x["gap"] < n)))
    need = need.select(*keys, F.col("__seg").alias("__to"), F.col("x.from").alias("__seg"), F.col("x.gap").alias("__gap"))
    edge = rows.withColumn("__k", F.row_number().over(Window.partitionBy(*on).orderBy(order(t)))).filter(F.col("__k") <= n)
    return edge.join(need, on).filter(F.col("__k") + F.col("__gap") <= n).withColumn("__seg", F.col("__to")).drop("__k", "__gap", "__to")


def carried(df: DataFrame, keys: list[str], before: int = 0, after: int = 0, seconds: int = 0, t: str = "t", width: int = DAY) -> DataFrame:
    """``df`` with ``__seg`` and ``__own``: each segment also holds, not its own, the rows before and after that frames reach.

    Frames of at most ``before`` and ``after`` rows, or of ``seconds`` back (at most a segment), see in a segment all
    they would see in the whole series; rows that are not own are for the frames only.
    """
    rows = df.withColumn("__seg", segment_of(t, width))
    out = rows.withColumn("__own", F.lit(True))
    for n, back in ((before, True), (after, False)):
        if n:
            out = out.unionByName(_neighbours(rows, keys, t, n, back).withColumn("__own", F.lit(False)))
    if seconds:
        if seconds > width:
            raise ValueError("the frame exceeds a segment")
        late = rows.filter(F.col(t) >= (F.col("__seg") + 1) * width - seconds)
        out = out.unionByName(late.withColumn("__seg", F.col("__seg") + 1).withColumn("__own", F.lit(False)))
    return out


def within(keys: list[str], t: str = "t") -> Window:
    """The window of a segment's rows in time order."""
    return Window.partitionBy(*keys, "__seg").orderBy(t)


def own(df: DataFrame) -> DataFrame:
    return df.filter("__own").drop("__own", "__seg")


def _with_prefix(df: DataFrame, keys: list[str], part: Column, prefix: Callable[[Column], Column], t: str, width: int) -> DataFrame:
    """``df`` with ``__seg`` and ``__prefix``: an aggregate of each segment, folded over all segments before it."""
    rows = df.withColumn("__seg", segment_of(t, width))
    each = rows.groupBy(*keys, "__seg").agg(part.alias("__part"))
    w = Window.partitionBy(*keys).orderBy("__seg").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(each.select(*keys, "__seg", prefix(F.col("__part")).over(w).alias("__prefix")), [*keys, "__seg"])


def running_sum(df: DataFrame, keys: list[str], value: str, name: str, t: str = "t", width: int = DAY) -> DataFrame:
    """The sum of ``value`` up to and with each row."""
    rows = _with_prefix(df, keys, F.sum(value), F.sum, t, width)
    return rows.withColumn(name, F.sum(value).over(within(keys, t)) + F.coalesce("__prefix", F.lit(0))).drop("__seg", "__prefix")


def numbered(df: DataFrame, keys: list[str], name: str = "i", t: str = "t", width: int = DAY, order: str | None = None) -> DataFrame:
    """The number of each row in its key's time order, from 1; ``order``: a column that also tells rows of one time apart."""
    rows = _with_prefix(df, keys, F.count("*"), F.sum, t, width)
    return rows.withColumn(name, F.row_number().over(within(keys, order or t)) + F.coalesce("__prefix", F.lit(0))).drop("__seg", "__prefix")


def last_known(df: DataFrame, keys: list[str], value: str, name: str, t: str = "t", width: int = DAY) -> DataFrame:
    """The last ``value`` that isn't null at or before each row."""
    newest = F.max_by(value, F.when(F.col(value).isNotNull(), F.col(t)))
    rows = _with_prefix(df, keys, newest, lambda c: F.last(c, ignorenulls=True), t, width)
    return rows.withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(within(keys, t)), "__prefix")).drop("__seg", "__prefix")


def headed(df: DataFrame, keys: list[str], values: list[str], t: str = "t", width: int = DAY) -> DataFrame:
    """``df`` with ``__seg`` and ``__own``, and for each segment a row, not its own, of the last known ``values`` before it.

    Ordered by ``__own`` and time, a segment's frames then see what they would see in the whole series, after one sort.
    """
    rows = df.withColumns({"__seg": segment_of(t, width), "__own": F.lit(True)})
    each = rows.groupBy(*keys, "__seg").agg(*(F.max_by(v, F.when(F.col(v).isNotNull(), F.col(t))).alias(v) for v in values))
    w = Window.partitionBy(*keys).orderBy("__seg").rowsBetween(Window.unboundedPreceding, -1)
    heads = each.select(*keys, "__seg", *(F.last(v, ignorenulls=True).over(w).alias(v) for v in values), F.lit(False).alias("__own"))
    return rows.unionByName(heads, allowMissingColumns=True)


def spreads(df: DataFrame, keys: list[str], values: list[str], width: int, t: str = "t") -> DataFrame:
    """``df`` with ``n`` (rows of the frame), ``last`` (its last time), and the mean and variance of each value over a row and the ``width`` - 1 after it.

    Frames are differences of running sums, so a row costs the same at any width. Values are whole numbers: their sums are exact.
    """
    rows = carried(df, keys, after=width - 1, t=t)
    so_far = within(keys, t).rowsBetween(Window.unboundedPreceding, 0)
    at = lambda c: F.lead(c, width - 1).over(within(keys, t))
    sums = {f"__s{k}": F.sum(F.col(v).cast("long")).over(so_far) for k, v in enumerate(values)} | {f"__q{k}": F.sum(F.col(v).cast("long") * F.col(v).cast("long")).over(so_far) for k, v in enumerate(values)}
    rows = rows.withColumns(sums)
    ends = {"last": at(t)} | {f"__{x}e{k}": at(f"__{x}{k}") for k in range(len(values)) for x in "sq"}
    rows = own(rows.withColumns(ends)).withColumn("n", F.when(F.col("last").isNotNull(), width))
    for k, v in enumerate(values):
        total = F.col(f"__se{k}") - F.col(f"__s{k}") + F.col(v)
        squares = F.col(f"__qe{k}") - F.col(f"__q{k}") + F.col(v).cast("long") * F.col(v).cast("long")
        rows = rows.withColumns({f"mean_{v}": total / width, f"var_{v}": (width * squares - total * total) / (width * width)})
    return rows.drop(*sums, *(c for c in ends if c != "last"))


def _segments(df: DataFrame, keys: list[str], item: Column, t: str, width: int) -> DataFrame:
    return df.groupBy(*keys, segment_of(t, width).alias("__seg")).agg(F.array_sort(F.collect_list(item)).alias("e"))


#: Segments that a fold goes over at once, and how often so many are made one before the last fold.
FAN, LEVELS = 256, 2


def _told(segments: DataFrame, keys: list[str], start: Column, step: Callable[[Column, Column], Column], each: Column, merged: Callable[[Column], Column]) -> DataFrame:
    """(keys, __seg, state): the state at the start of each segment, folded over one small value ``each`` of the earlier ones.

    ``merged`` makes the values ``x`` of neighbouring segments one value of the same kind, so folds go over at most ``FAN`` of them: up
    to the values of long segments, and with the states at their starts down again. Only the longest ones of a key, 65,536 segments
    each, are folded together.
    """
    wide = lambda level: level.withColumn("__up", F.floor(F.col("__seg") / FAN))
    all_of = F.array_sort(F.collect_list(F.struct("__seg", "x"))).alias("all")
    levels = [segments.select(*keys, "__seg", each.alias("x"))]
    for _ in range(LEVELS):
        up = wide(levels[-1]).groupBy(*keys, "__up").agg(all_of)
        levels.append(up.select(*keys, F.col("__up").alias("__seg"), merged(F.col("all")).alias("x")))

    def down(groups: DataFrame, begin: Column) -> DataFrame:
        first = F.struct(begin.alias("s"), F.array().cast("array<bigint>").alias("out"))
        fold = F.aggregate("all", first, lambda a, x: F.struct(step(a["s"], x["x"]).alias("s"), F.concat(a["out"], F.array(a["s"])).alias("out")), lambda a: a["out"])
        pairs = F.arrays_zip(F.transform("all", lambda x: x["__seg"]).alias("seg"), fold.alias("state"))
        return groups.select(*keys, F.explode(pairs).alias("p")).select(*keys, F.col("p.seg").alias("__seg"), F.col("p.state").alias("state"))

    states = down(levels[-1].groupBy(*keys).agg(all_of), start)
    for level in reversed(levels[:-1]):
        above = states.withColumnRenamed("__seg", "__up")
        states = down(wide(level).groupBy(*keys, "__up").agg(all_of).join(above, [*keys, "__up"]), F.col("state"))
    return states


NEVER = -(10**15)


def chained(df: DataFrame, keys: list[str], seconds: int, t: str = "t", width: int = HOUR) -> DataFrame:
    """(keys, t) of the first row and then of each first one at least ``seconds`` after the last kept.

    Of each segment it is computed where a chain leaves it for every row at which one may enter (those of its first
    ``seconds`` and the next one); a fold over segments finds the real entries, and each segment is then walked once.
    """
    rows = _segments(df.select(*keys, t).distinct(), keys, F.col(t), t, width)
    walk = lambda a, x: F.when(x - a >= seconds, x).otherwise(a)
    near = F.filter("e", lambda x: x < F.element_at("e", 1) + seconds)
    doors = F.concat(near, F.slice("e", F.size(near) + 1, 1))
    rows = rows.withColumn("doors", F.transform(doors, lambda d: F.struct(d.alias("d"), F.aggregate("e", d, walk).alias("leave"))))

    def through(last, x):
        door = F.try_element_at(F.filter(x, lambda d: d["d"] >= last + seconds), F.lit(1))
        return F.coalesce(door["leave"], last)

    def merged(parts):
        """The doors of the first ``seconds`` of all segments and the next one, each with where it leaves the last segment."""
        doors = F.flatten(F.transform(parts, lambda p: F.transform(p["x"], lambda d: d["d"])))
        begins = parts[0]["x"][0]["d"]  # cheap, as it is asked for at each door
        near = F.filter(doors, lambda d: d < begins + seconds)
        found = F.concat(near, F.slice(doors, F.size(near) + 1, 1))
        return F.transform(found, lambda d: F.struct(d.alias("d"), F.aggregate(parts, d - seconds, lambda a, p: through(a, p["x"])).alias("leave")))

    start = _told(rows, keys, F.lit(NEVER).cast("long"), through, F.col("doors"), merged)
    begun = rows.join(start, [*keys, "__seg"])
    # walking marks a kept time by itself, all others by null
    last = F.struct(F.col("state").alias("s"), F.array().cast("array<bigint>").alias("out"))
    kept = F.aggregate("e", last, lambda a, x: F.when(x - a["s"] >= seconds, F.struct(x.alias("s"), F.concat(a["out"], F.array(x)).alias("out"))).otherwise(a), lambda a: a["out"])
    return begun.select(*keys, F.explode(kept).alias(t))


def automaton(df: DataFrame, keys: list[str], value: str, states: list[int], step: Callable[[Column, Column], Column], start: int, name: str, t: str = "t", width: int = HOUR) -> DataFrame:
    """(keys, t, state) after each row of a machine with few states: ``step(state, value)``.

    Each segment is run from every state, a fold over segments finds its real first one.
    """
    rows = _segments(df, keys, F.struct(F.col(t).alias("t"), F.col(value).alias("v")), t, width)
    runs = F.array(*(F.aggregate("e", F.lit(s).cast("long"), lambda a, x: step(a, x["v"]).cast("long")) for s in states))
    at = lambda s: F.array_position(F.array(*(F.lit(x).cast("long") for x in states)), s)
    through = lambda s, x: F.element_at(x, at(s).cast("int"))
    merged = lambda parts: F.array(*(F.aggregate(parts, F.lit(s).cast("long"), lambda a, p: through(a, p["x"])) for s in states))
    told = _told(rows.withColumn("runs", runs), keys, F.lit(start).cast("long"), through, F.col("runs"), merged)
    begun = rows.join(told, [*keys, "__seg"])
    first = F.struct(F.col("state").alias("s"), F.array().cast("array<bigint>").alias("out"))
    walked = F.aggregate("e", first, lambda a, x: F.struct(step(a["s"], x["v"]).cast("long").alias("s"), F.concat(a["out"], F.array(step(a["s"], x["v"]).cast("long"))).alias("out")), lambda a: a["out"])
    return begun.select(*keys, F.explode(F.arrays_zip(F.col("e"), walked.alias("w"))).alias("x")).select(*keys, F.col("x.e.t").alias(t), F.col("x.w").alias(name))
