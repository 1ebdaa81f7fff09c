"""Audit of interacting filters: what each removes alone, after others, and on average over all orders (operator 13).

Filters are named by one letter each. All but one see a row by itself. The other one, the duplicate filter, needs the
table: a text fails it where a smaller id has the same text. Its prepass is a counting Bloom filter of the texts. Each
text adds one to three counters of one block of 64; every task adds up its own counts, and merging sketches is adding
them. A text with a counter at one is unique for certain and goes no further. Only texts whose three counters reached
two are shuffled, whole, to find the least id of each text; copies collapse in their task first. So every possible
repeat is the first of its text or a duplicate, and no copy has to meet the others.

The counters that reached two are broadcast as one 64-bit word for each block. There are at most ``MAX_BLOCKS`` of them
whatever the input: beyond ``MAX_BLOCKS * PER_BLOCK`` texts the filter clears fewer and fewer of them and the exact step
sees more, with the same result.

A row's failures are a bit mask. Counts by mask are additive, so rows are counted once, and the 120 orders of five
filters are played over the masks.

Null texts are empty texts. A row without an id is never a duplicate nor the first of its text. Rows of one id are
first copies together if their texts have equal 64-bit hashes. A null part is the empty string. Labels of one id
that differ count as each value they take. Of other columns none is read, so clashing names don't matter; an empty
table gives no row.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, functions as F

#: Texts for each block of 64 counters: about one unique text in a hundred isn't cleared.
PER_BLOCK = 4
#: 2^20 words of eight bytes, about 50 MB as a hash table of an executor.
MAX_BLOCKS = 1 << 20
PROBES = 3


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


#: Failure conditions over the text, its words and its distinct words.
FILTERS: dict[str, Callable[[Column, Column, Column], Column]] = {
    "A": lambda text, n, distinct: n < 200,
    "B": lambda text, n, distinct: 100 * distinct < 50 * n,
    "C": lambda text, n, distinct: 100 * (F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))) > 3 * F.length(text),
    "D": lambda text, n, distinct: text.rlike(r"[#$%&*|]"),
}
DUPLICATE = "E"


def _hashed(rows: DataFrame, blocks: int) -> DataFrame:
    """``rows`` with the block of each text, its counters there, and a hash that tells texts of one id apart."""
    spots = F.xxhash64("text", F.lit(1))
    return rows.withColumns({"hash": F.xxhash64("text"), "spots": F.array_distinct(F.array(*(F.shiftright(spots, 6 * k).bitwiseAND(F.lit(63).cast("long")).cast("int") for k in range(PROBES))))}).withColumn("block", F.pmod("hash", F.lit(blocks).cast("long")))


def sketch(rows: DataFrame, blocks: int) -> DataFrame:
    """(block, full): the counters of each block that two texts or more have added to, as bits of a word."""
    counters = _hashed(rows.select("text"), blocks).select("block", F.explode("spots").alias("spot")).groupBy("block", "spot").count()
    return counters.filter("count > 1").groupBy("block").agg(F.bit_or(F.expr("shiftleft(1L, spot)")).alias("full"))


def possible_repeats(rows: DataFrame, full: DataFrame, blocks: int) -> DataFrame:
    """``rows`` with ``hash`` and ``maybe``: false only for a text that no other row has."""
    hit = F.forall("spots", lambda s: F.coalesce(F.expr("full"), F.lit(0).cast("long")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), s)) != 0)
    return _hashed(rows, blocks).join(F.broadcast(full), "block", "left").withColumn("maybe", hit).drop("spots", "block", "full")


def flags(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(id, part, mask) of every row: bit k of ``mask`` is set if it fails the k-th filter, the duplicate filter last."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    blocks = max(1, min(MAX_BLOCKS, rows.count() // PER_BLOCK))
    told = possible_repeats(rows, sketch(rows, blocks), blocks)
    firsts = told.filter("maybe and id is not null").groupBy("text").agg(F.min("id").alias("first"))
    firsts = firsts.groupBy("first").agg(F.collect_set(F.xxhash64("text")).alias("hashes"))

    counted = told.withColumn("words", words(F.col("text"))).withColumns({"n": F.size("words"), "distinct": F.size(F.array_distinct("words"))})
    mask = F.lit(0)
    for k, fails in enumerate(FILTERS.values()):
        mask = mask + F.when(fails(F.col("text"), F.col("n"), F.col("distinct")), 1 << k).otherwise(0)
    # rows without an id match nothing: any other key spreads them
    narrow = counted.select("id", "part", "hash", "maybe", mask.alias("mask"), F.coalesce("id", -1 - F.monotonically_increasing_id()).alias("__on"))
    again = F.col("maybe") & F.col("id").isNotNull() & ~F.coalesce(F.array_contains("hashes", F.col("hash")), F.lit(False))
    joined = narrow.join(firsts, (F.col("__on") == F.col("first")) & F.col("id").isNotNull(), "left")
    return joined.select("id", "part", (F.col("mask") + F.when(again, 1 << len(FILTERS)).otherwise(0)).alias("mask"), "__on")


def mask_counts(flagged: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(part, mask, good, toxic, n): how many rows of a part fail just these filters and have these labels."""
    known = labels.select(F.col(key).cast("long").alias("__id"), "quality", "toxic").filter("__id is not null").groupBy("__id").agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    rows = flagged.join(known, (F.col("__on") == F.col("__id")) & F.col("id").isNotNull(), "left")
    return rows.groupBy("part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")).agg(F.count("*").alias("n"))


def interactions(counts: DataFrame, names: str = "".join(FILTERS) + DUPLICATE) -> DataFrame:
    """What each step of each order of the filters does, from additive counts by mask."""
    orders = F.array(*(F.lit("".join(p)) for p in permutations(names)))
    steps = counts.withColumn("filter_order", F.explode(orders)).select("*", F.posexplode(F.split("filter_order", "")).alias("at", "filter"))
    bit, earlier = F.lit(0), F.lit(0)
    for k, name in enumerate(names):
        place = F.instr("filter_order", name) - 1
        bit = bit + F.when(place == F.col("at"), 1 << k).otherwise(0)
        earlier = earlier + F.when(place < F.col("at"), 1 << k).otherwise(0)
    steps = steps.withColumns({"bit": bit, "earlier": earlier})
    fails, gone = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("earlier")) != 0
    total = lambda c, n="n": F.coalesce(F.sum(F.when(c, F.col(n) if isinstance(n, str) else n)), F.lit(0)).cast("long")
    # each of a row's failing filters comes first in an equal share of all orders
    share = F.col("n") * (F.lit(factorial(len(names))) / F.bit_count("mask")).cast("long")
    return steps.groupBy("part", "filter_order", (F.col("at") + 1).cast("int").alias("step")).agg(
        total(~fails & ~gone).alias("kept"), total(fails & ~gone).alias("removed"), total(fails & gone).alias("redundant"), total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(fails & ~gone & F.col("good")).alias("good_lost"), total(fails & ~gone & F.col("toxic")).alias("toxic_lost"), total(fails, share).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """A row for each part, order of the filters and step."""
    return interactions(mask_counts(flags(docs, key, text, part), labels, key))
