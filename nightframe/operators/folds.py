"""Folds over long series whose state is no small set: run in parallel from guessed states, repaired where a guess was wrong.

A series is cut into segments of so many rows. Each is first run over the end of the segment before it, from the
starting state; what that leaves is the guess at its own entry. A state that forgets (a window of recent values, a
guard, a mean that old values fade from) is then nearly always the true one. Guesses are compared with what the segment
before leaves, and segments that could be entered otherwise are run again and remember both, until the runs from the
start of the series to its end are known. So the result is the sequential one, always; the work is two passes where guesses hold, some
more where a part of the state (the phase of a clock) takes turns and is never forgotten, and at worst a pass for each segment.

A part that is kept for good once it is there (a rule that was turned off, what was sent last to a side that no rule sets any more) is in no
warm-up from the starting state. Where a pass has brought the known runs on by one segment only, all later segments are therefore guessed
anew, by a warm-up from the state that the series is known to have there: a pass or two for each change of such a part, not for each segment.

What passes between segments is one state each. A segment is one group of a bounded number of rows; rows of equal time
stay together. Segments, states and repairs are tables of the shared folder, so a lost executor costs its tasks only.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..sources import shared
from . import segments as g

WIDTH, WARM = 20_000, 1_000
#: (state, rows in order) to (state, one output row for each of some rows).
Run = Callable[[object, pd.DataFrame], tuple[object, pd.DataFrame]]


def dealt(df: DataFrame, keys: list[str], t: str, width: int) -> DataFrame:
    """``df`` with ``__seg``: each key's rows in time order by their number; equal times share one."""
    rows = df.withColumn("__day", g.segment_of(t))
    on = [*keys, "__day"]
    days = rows.groupBy(*on).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1))
    days = days.select(*on, F.coalesce(before, F.lit(0)).alias("__before"))
    place = F.rank().over(Window.partitionBy(*on).orderBy(t)) - 1 + F.col("__before")
    rows = rows.join(days, on).withColumn("__i", place)
    return rows.withColumn("__seg", F.expr(f"__i div {width}")).drop("__day", "__before")


def fold(df: DataFrame, keys: list[str], run: Run, start: object, out: str, t: str = "t", order: list[str] | None = None, width: int = WIDTH, warm: int = WARM) -> DataFrame:
    """(keys, out) of ``run`` over each key's rows by time (then ``order``), from ``start``, as if in one go.

    ``run`` must not depend on how the rows are cut up, and its state must pass through JSON unchanged. ``out`` is the schema
    of its rows. Rows without a time or key are left out.
    """
    rows = shared.written(dealt(df.dropna(subset=[*keys, t]), keys, t, width), "fold")
    by = [t, *(order or [])]
    begin = json.dumps(start)
    on = [*keys, "__seg"]
    typed = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)
    late = rows.filter(F.col("__i") % width >= width - warm).withColumns({"__seg": F.col("__seg") + 1, "__own": F.lit(False)})
    both = rows.withColumn("__own", F.lit(True)).unionByName(late)

    def guess(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(by, kind="stable")
        mine = pdf[pdf["__own"]]
        if mine.empty:
            return pd.DataFrame(columns=[*on, "entry", "exit"])
        before = pdf[~pdf["__own"]]
        state = json.loads(begin)
        if len(before):
            state, _ = run(state, before)
        entry = json.dumps(state)
        state, _ = run(json.loads(entry), mine)
        return pd.DataFrame([[*mine.iloc[0][on], entry, json.dumps(state)]], columns=[*on, "entry", "exit"])

    def renewed(pdf: pd.DataFrame) -> pd.DataFrame:
        state, _ = run(json.loads(pdf["entry"].iloc[0]), pdf.sort_values(by, kind="stable"))
        return pd.DataFrame([[*pdf.iloc[0][on], json.dumps(state)]], columns=[*on, "entry"])

    def again(pdf: pd.DataFrame) -> pd.DataFrame:
        entry = pdf["entry"].iloc[0]
        state, _ = run(json.loads(entry), pdf.sort_values(by, kind="stable"))
        return pd.DataFrame([[*pdf.iloc[0][on], entry, json.dumps(state)]], columns=[*on, "entry", "exit"])

    def tell(pdf: pd.DataFrame) -> pd.DataFrame:
        _, told = run(json.loads(pdf["entry"].iloc[0]), pdf.sort_values(by, kind="stable"))
        for k in keys:
            told[k] = pdf[k].iloc[0]
        return told

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        """The true entries as far as the runs from them are known, and the first that is not."""
        known, state, told = {(s, a): b for s, a, b in zip(pdf["__seg"], pdf["entry"], pdf["exit"])}, begin, []
        for seg in sorted(set(pdf["__seg"])):
            told.append([*(pdf[k].iloc[0] for k in keys), seg, state, (seg, state) in known])
            if not told[-1][-1]:
                break
            state = known[seg, state]
        return pd.DataFrame(told, columns=[*on, "entry", "known"])

    if not rows.agg(F.max("__seg")).first()[0]:  # every key is one segment: there is nothing to guess
        return rows.withColumn("entry", F.lit(begin)).groupBy(*on).applyInPandas(tell, f"{typed}{out}")
    schema = f"{typed}__seg bigint, entry string, exit string"
    states = shared.written(both.groupBy(*on).applyInPandas(guess, schema), "states")
    order_of = Window.partitionBy(*keys).orderBy("__seg")
    following = states.select(*on, F.lead("__seg").over(order_of).alias("__next")).filter("__next is not null")
    was = None
    while True:
        path = shared.written(states.groupBy(*keys).applyInPandas(walk, f"{typed}__seg bigint, entry string, known boolean"), "path")
        lost = path.filter("not known").select(*keys, F.col("__seg").alias("__from"), F.col("entry").alias("__state"))
        if lost.isEmpty():
            break
        after = states.join(following, on).select(*keys, F.col("__next").alias("__seg"), F.col("exit").alias("entry")).distinct()
        after = after.join(lost, keys).filter("__seg >= __from").select(*on, "entry")
        if was is not None:
            slow = lost.join(was, keys).filter("__from <= __was + 1").select(*keys, "__from", F.col("__state").alias("entry"))
            fresh = late.join(following.select(*keys, F.col("__next").alias("__seg")), on).join(slow, keys).filter("__seg > __from")
            after = after.unionByName(fresh.groupBy(*on).applyInPandas(renewed, f"{typed}__seg bigint, entry string")).distinct()
        was = lost.select(*keys, F.col("__from").alias("__was"))
        wanted = after.join(states.select(*on, "entry"), [*on, "entry"], "left_anti")
        wanted = shared.written(wanted, "wanted")
        states = shared.written(states.unionByName(rows.join(wanted, on).groupBy(*on, "entry").applyInPandas(again, schema)), "states")
    return rows.join(path.select(*on, "entry"), on).groupBy(*on).applyInPandas(tell, f"{typed}{out}")
