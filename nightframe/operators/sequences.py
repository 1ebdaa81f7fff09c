"""Window and sequence operators over (key, time) rows, and folds over bounded nights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .patterns import upper_median


def frame(keys: list[str], lo: int, hi: int, t: str = "t"):
    return Window.partitionBy(*keys).orderBy(t).rowsBetween(lo, hi)


def nearest_rank(values: Column, percent: int) -> Column:
    """Element int(percent/100 * n + 0.5) - 1 of the sorted values, at least the first."""
    n = F.size(values)
    at = F.greatest(F.lit(1), F.floor(F.lit(percent / 100) * n + 0.5).cast("int"))
    return F.when(n > 0, F.try_element_at(F.array_sort(values), at))


def hr_median_filter(vitals: DataFrame, keys: list[str]) -> DataFrame:
    """Heart rates beyond two deviations of the five around them become null."""
    raw = F.when(F.col("heart_rate").between(45, 130), F.col("heart_rate"))
    w = frame(keys, -2, 2)
    rows = vitals.withColumn("raw", raw).withColumns({"around": F.array_sort(F.collect_list("raw").over(w)), "sd": F.stddev_pop("raw").over(w)})
    median = F.try_element_at("around", (F.size("around") / 2).cast("int") + 1)
    return rows.withColumn("hr", F.when((F.col("sd") > 0) & (F.abs(F.col("raw") - median) > 2 * F.col("sd")), None).otherwise(F.col("raw"))).drop("around", "sd")


def epoch_duration(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Seconds to the next row, at most ten minutes; five for the last."""
    gap = F.lead("t").over(Window.partitionBy(*keys).orderBy("t")) - F.col("t")
    return rows.withColumn("seconds", F.coalesce(F.least(gap, F.lit(600)), F.lit(300)))


CODES = {"wake": "w", "light": "l", "deep": "d", "rem": "r"}


def fold_stages(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Smooths stages of each night in place: A-B-A to A-A-A, then impossible changes to light.

    A night is bounded (some hundred epochs). Its stages are letters of one text; each fold appends a letter that
    depends on the last one written and on two that are read.
    """
    code = F.create_map(*(F.lit(x) for pair in CODES.items() for x in pair))
    name = F.create_map(*(F.lit(x) for pair in CODES.items() for x in reversed(pair)))
    nights = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("t", "stage", "seconds"))).alias("e"))
    nights = nights.withColumn("s", F.transform("e", lambda x: code[x["stage"]]))
    smooth = """aggregate(sequence(1, size(s)), '', (a, i) -> concat(a, case when i > 1 and i < size(s) and right(a, 1) = s[i] and s[i - 1] <> s[i] then s[i] else s[i - 1] end))"""
    bad = "concat(right(a, 1), s[i - 1]) in ('wd', 'dw', 'dr', 'rd')"
    fixed = f"aggregate(sequence(1, size(s)), '', (a, i) -> concat(a, case when {bad} then 'l' else s[i - 1] end))"
    for fold in (smooth, fixed):
        nights = nights.withColumn("s", F.split(F.expr(fold), ""))
    out = nights.select(*keys, F.posexplode(F.arrays_zip("e", "s")))
    return out.select(*keys, "col.e.t", name[F.col("col.s")].alias("stage"), "col.e.seconds")


def classify(rows: DataFrame, quality: float = 1.0) -> DataFrame:
    """Stage of each epoch from heart rate against the mean, movement and variability; low calibration knows wake and light only."""
    still = F.coalesce("total_movement", F.lit(0))
    ratio = F.col("hr") / F.col("mean_hr")
    deep = (ratio < 0.92) & (F.coalesce("hrv", F.lit(0.0)) >= 40) & (still < 50)
    rem = (ratio >= 0.95) & (still < 50) & (F.coalesce("hrv", F.lit(0.0)) < 40)
    fine = F.lit(quality >= 0.5)
    return rows.withColumn("stage", F.when(still > 200, "wake").when(F.col("hr").isNull(), F.when(still >= 100, "wake").otherwise("light")).when(fine & deep, "deep").when(fine & rem, "rem").otherwise("light"))


def blocks(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of equal stages."""
    w = Window.partitionBy(*keys).orderBy("t")
    new = (F.col("stage") != F.coalesce(F.lag("stage").over(w), F.lit(""))).cast("int")
    return rows.withColumn("block", F.sum(new).over(w)).groupBy(*keys, "block").agg(F.first("stage").alias("stage"), F.min("t").alias("start"), F.max(F.col("t") + F.col("seconds")).alias("end")).drop("block")


def distribution(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Percent of time in each stage, rounded."""
    total = F.sum("seconds")
    return rows.groupBy(*keys).agg(*(F.floor(F.sum(F.when(F.col("stage") == s, F.col("seconds")).otherwise(0)) * 100 / total + 0.5).alias(s) for s in ("wake", "light", "deep", "rem")))


def quality_score(dist: DataFrame, calibration: float = 1.0) -> DataFrame:
    """100 less penalties for too little or too much of a stage; at most 50 where calibration is poor."""
    d, r, w = F.col("deep"), F.col("rem"), F.col("wake")
    zero = F.lit(0.0)
    penalty = F.greatest((15 - d) * 2.0, zero) + F.greatest((d - 30) * 1.5, zero) + F.greatest((20 - r) * 1.5, zero) + F.greatest((r - 35) * 1.0, zero) + F.greatest((w - 5) * 2.0, zero)
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.floor(100 - penalty + 0.5)))
    return dist.withColumn("score", F.least(score, F.lit(50)) if calibration < 0.3 else score)


def day_key(t: str = "t") -> Column:
    return F.expr(f"{t} div 86400")


__all__ = ["blocks", "classify", "day_key", "distribution", "epoch_duration", "fold_stages", "frame", "hr_median_filter", "nearest_rank", "quality_score", "upper_median"]
