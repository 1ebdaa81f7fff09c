"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix (operator 12).

A uniform permutation of all rows sends to each run of places an exact number of rows, and how many of them come from
each input partition follows a multivariate hypergeometric law. So the numbers are drawn first, rows are permuted
within their partition and dealt out by them, exchanged once, and permuted again where they arrive.

Shards are cut into blocks of places, the unit that one task holds. A partition's row of the matrix (its number of
rows for each block) is drawn by halving the range of partitions: the blocks' places still to fill are split between both
halves, with a seed that the range itself gives. Every task that has rows of a partition draws the halves on the way
to it, and all agree; neither the matrix nor any row passes through the driver. What the tasks are given is the number
of rows of each partition, eight bytes for each. There are at most ``MAX_BLOCKS`` blocks, so larger tables have larger
blocks; a block is sorted by Spark, which spills.

Places depend on where a row lies in the input, so the input is first written to the shared folder with each row's
partition and number as a column: later steps, also when they run again, read the same.

Null ids and texts, equal rows and very long texts are rows like others. A column named as an output is replaced. An
empty table has empty shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from . import scratch

#: Rows of a block, while there are fewer than ``MAX_BLOCKS`` of them.
BLOCK_ROWS = 4096
MAX_BLOCKS = 1 << 15
#: numpy draws from urns below this size.
URN = 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """One draw from an urn of any size: by its distribution within twelve deviations of its mode."""
    total = good + bad
    if total < URN:
        return int(rng.hypergeometric(good, bad, n))
    mode = (n + 1) * (good + 1) // (total + 2)
    reach = 50 + 12 * int(np.sqrt(n * (good / total) * (bad / total) * ((total - n) / (total - 1))))
    k = np.arange(max(0, n - bad, mode - reach), min(n, good, mode + reach) + 1, dtype=np.float64)
    up = np.log(good - k[:-1]) + np.log(n - k[:-1]) - np.log(k[1:]) - np.log(bad - n + k[1:])
    weight = np.append(0.0, np.cumsum(up))
    below = np.cumsum(np.exp(weight - weight.max()))
    return int(k[min(np.searchsorted(below, rng.random() * below[-1], "right"), len(k) - 1)])


def split(rng: np.random.Generator, places: np.ndarray, n: int) -> np.ndarray:
    """How many of ``n`` rows go to each block with so many ``places``: a multivariate hypergeometric draw.

    The blocks' range is halved again and again; all halvings of one depth are drawn together.
    """
    total = np.append(0, np.cumsum(places))
    lo, hi, take = np.array([0]), np.array([len(places)]), np.array([n])
    while (wide := hi - lo > 1).any():
        mid = (lo + hi) // 2
        a, b, t = total[mid] - total[lo], total[hi] - total[mid], take.copy()
        small = wide & (a + b < URN)
        left = np.zeros(len(lo), np.int64)
        left[small] = rng.hypergeometric(a[small], b[small], t[small])
        for i in np.flatnonzero(wide & ~small):
            left[i] = hypergeometric(rng, int(a[i]), int(b[i]), int(t[i]))
        # a range of one block has its middle at its start: its left half is empty
        lo, hi, take = np.stack([lo, mid], 1).ravel(), np.stack([mid, hi], 1).ravel(), np.stack([left, t - left], 1).ravel()
        lo, hi, take = (x[hi > lo] for x in (lo, hi, take))
    return take


def matrix_row(rows_before: np.ndarray, places: np.ndarray, partition: int, seed: int) -> np.ndarray:
    """How many rows a partition sends to each block, with ``rows_before[p]`` rows in the partitions before p."""
    lo, hi, places = 0, len(rows_before) - 1, places.copy()
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = split(np.random.default_rng([seed, lo, hi]), places, int(rows_before[mid] - rows_before[lo]))
        if partition < mid:
            places, hi = left, mid
        else:
            places, lo = places - left, mid
    return places


def even(n: int, parts: int) -> np.ndarray:
    """``n`` in ``parts`` numbers at most one apart."""
    return n // parts + (np.arange(parts) < n % parts)


def shuffle(df: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """``df`` with ``shard`` (0 to ``shards`` - 1, sizes at most one apart) and ``slot`` (from 0 in each shard): a uniform permutation."""
    spark = df.sparkSession
    rows = scratch.written(df.drop("shard", "slot", "__at", "__block").withColumn("__at", F.monotonically_increasing_id()), "to-shuffle")
    counts = rows.groupBy(F.shiftright("__at", 33).alias("p")).agg(F.count("*").alias("n")).toPandas().sort_values("p")
    numbers, before = counts["p"].to_numpy(np.int64), np.append(0, np.cumsum(counts["n"].to_numpy(np.int64)))
    total = int(before[-1])
    each = max(1, min(-(-total // (shards * BLOCK_ROWS)), MAX_BLOCKS // shards))
    places = np.concatenate([even(int(n), each) for n in even(total, shards)])
    given = spark.sparkContext.broadcast((numbers, before, places))

    def targets(p: int) -> np.ndarray:
        numbers, before, places = given.value
        at = int(np.searchsorted(numbers, p))
        to = np.repeat(np.arange(len(places), dtype=np.int32), matrix_row(before, places, at, seed))
        return np.random.default_rng([seed, at]).permutation(to)

    @F.pandas_udf("int")
    def block(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        last, known = None, None
        for at in batches:
            partition, row, to = at.to_numpy() >> 33, at.to_numpy() & (1 << 33) - 1, np.empty(len(at), np.int32)
            for p in np.unique(partition):
                if p != last:
                    last, known = p, targets(int(p))
                mine = partition == p
                to[mine] = known[row[mine]]
            yield pd.Series(to)

    # places before a block of its shard: the shard's size and the number of blocks give them without a table
    size = F.lit(total // shards).cast("long") + F.when(F.col("shard") < total % shards, 1).otherwise(0)
    inner = F.col("__block") % each
    start = inner * F.floor(size / each) + F.least(inner, size % each)
    again = F.row_number().over(Window.partitionBy("__block").orderBy(F.xxhash64("__at", F.lit(seed)), "__at")) - 1
    dealt = rows.withColumn("__block", block("__at")).withColumn("shard", F.floor(F.col("__block") / each).cast("int"))
    return dealt.withColumn("slot", (start + again).cast("long")).drop("__at", "__block")
