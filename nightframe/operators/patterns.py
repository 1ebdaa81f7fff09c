"""Physical patterns that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

DAY = 86400
#: End of a session that is still open.
OPEN_END = 99999999999


def upper_median(x: str | Column) -> Column:
    """The element at n div 2 of the sorted values (aggregate); nulls are left out."""
    values = F.array_sort(F.collect_list(x))
    return F.try_element_at(values, (F.size(values) / 2).cast("int") + 1)


def asof_backward(left: DataFrame, right: DataFrame, on: list[str], t: str, value: str, tolerance: int, segment: int = DAY) -> DataFrame:
    """``left`` with the last ``value`` of ``right`` at or before its time, if not older than ``tolerance``.

    Both sides are dealt by key and time segment, so a key with most of the rows is spread; the tail of a segment
    that a later one may look back to is copied there. One sort in each segment, no range join.
    """
    if tolerance > segment:
        raise ValueError("the tolerance exceeds a segment")
    r = right.select(*on, F.col(t).alias("__t"), F.col(value).alias("__v")).filter("__v is not null")
    own = F.floor(F.col("__t") / segment)
    r = r.withColumn("__s", F.explode(F.array_distinct(F.array(own, F.floor((F.col("__t") + tolerance) / segment)))))
    carried = left.withColumns({"__t": F.col(t), "__s": F.floor(F.col(t) / segment), "__row": F.struct(*left.columns)}).select(*on, "__t", "__s", "__row", F.lit(None).cast("double").alias("__v"))
    both = carried.unionByName(r.withColumn("__row", F.lit(None).cast(carried.schema["__row"].dataType)))
    w = Window.partitionBy(*on, "__s").orderBy("__t", F.col("__row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("__v").isNotNull(), F.struct("__t", "__v")), ignorenulls=True).over(w)
    found = both.withColumn("__last", last).filter(F.col("__row").isNotNull())
    return found.select("__row.*", F.when(F.col("__t") - F.col("__last.__t") <= tolerance, F.col("__last.__v")).alias(value))


def interval_semi(left: DataFrame, right: DataFrame, on: list[str], t: str, lo: Column, hi: Column, segment: int = DAY, latest: Column | None = None) -> DataFrame:
    """Rows of ``left`` whose time lies in some interval of ``right`` (both ends inclusive), each once.

    Intervals are dealt out to the time segments they touch, so the join has an equality on key and segment. Open
    intervals reach to ``latest`` (default: the latest time of ``left``), so their segments are finite.
    """
    spans = right.select(*on, lo.alias("__lo"), hi.alias("__hi"))
    top = left.agg(F.max(t).alias("__top"))
    spans = spans.join(F.broadcast(top)).withColumn("__hi", F.least("__hi", "__top")).filter("__lo <= __hi")
    spans = spans.withColumn("__s", F.explode(F.sequence(F.floor(F.col("__lo") / segment), F.floor(F.col("__hi") / segment))))
    rows = left.withColumn("__s", F.floor(F.col(t) / segment))
    cond = [rows[c].eqNullSafe(spans[c]) for c in [*on]] + [rows["__s"] == spans["__s"], rows[t] >= spans["__lo"], rows[t] <= spans["__hi"]]
    out = cond[0]
    for c in cond[1:]:
        out = out & c
    return rows.join(spans, out, "left_semi").drop("__s")


def interval_join(left: DataFrame, right: DataFrame, on: list[str], t: str, lo: Column, hi: Column, take: list[str], segment: int = DAY) -> DataFrame:
    """Rows of ``left`` with the columns ``take`` of each bounded interval of ``right`` that holds their time (both ends inclusive).

    Intervals are dealt out to the time segments they touch, so the join has an equality on key and segment.
    """
    spans = right.select(*on, *take, lo.alias("__lo"), hi.alias("__hi")).filter("__lo <= __hi")
    spans = spans.withColumn("__s", F.explode(F.sequence(F.floor(F.col("__lo") / segment), F.floor(F.col("__hi") / segment))))
    rows = left.withColumn("__s", F.floor(F.col(t) / segment))
    return rows.join(spans, [*on, "__s"]).filter(F.col(t).between(F.col("__lo"), F.col("__hi"))).drop("__s", "__lo", "__hi")


def in_bed(movement: DataFrame, sessions: DataFrame) -> DataFrame:
    """Movement during any session of its side."""
    return interval_semi(movement, sessions, ["side"], "t", F.col("entered"), F.coalesce(F.col("left_at"), F.lit(OPEN_END)))
