"""URL filter: a blocked Bloom filter before an exact hash join (operator 3).

Listed entries are of two kinds. An ``exact`` entry is a canonical URL (host and
path). A ``prefix`` entry is a rule that fits its host, all subdomains, and every
path that starts with its own. Both become keys (kind, host, path) of one filter:
an entry sets eight bits, two in each 64-bit word, of one 256-bit block, so the
filter is a table with a row for each block. A URL's keys are itself and, for
each ending of its host at a label, its path cut to each length that a rule's
path has. Keys whose eight bits are set are possible hits; an exact join with the
entries removes the false ones. All of it runs on the distinct URLs, so a URL
that many pages share is judged once.

The blocks are broadcast only up to ``BROADCAST_BLOCKS`` rows; larger filters
are joined by a shuffle on the block. The longest fitting rule (host and path)
decides, of equals the one with the longer host; then the listed URLs do.

Null URLs and those without ``://`` have empty host and path and pass; repeated
rows and ids are kept; an empty table or listing is fine; only the named columns
of the input are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BITS_PER_ENTRY = 16
BLOCK_BITS = 256
#: About 20 MB of blocks.
BROADCAST_BLOCKS = 1 << 18
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def _keyed(df: DataFrame, blocks: int) -> DataFrame:
    """Block number and four masks of each key."""
    key = F.xxhash64("kind", "host", "path")
    bits = F.xxhash64(F.lit(0x5EED), "kind", "host", "path")
    df = df.withColumn("block", F.pmod(key, F.lit(blocks))).withColumn("bits", bits)
    one = F.lit(1).cast("long")
    for k in range(4):
        low, high = (F.shiftrightunsigned("bits", 12 * k + s).bitwiseAND(F.lit(63)).cast("int") for s in (0, 6))
        mask = F.call_function("shiftleft", one, low).bitwiseOR(F.call_function("shiftleft", one, high))
        df = df.withColumn(f"m{k}", mask)
    return df.drop("bits")


def bloom_blocks(entries: DataFrame, blocks: int) -> DataFrame:
    """The filter: (block, w0..w3)."""
    return _keyed(entries, blocks).groupBy("block").agg(*(F.bit_or(f"m{k}").alias(f"w{k}") for k in range(4)))


def possible(keys: DataFrame, entries: DataFrame, n_entries: int) -> DataFrame:
    """Those keys that the filter of ``entries`` lets through."""
    blocks = max(1, -(-n_entries * BITS_PER_ENTRY // BLOCK_BITS))
    table = bloom_blocks(entries, blocks)
    if blocks <= BROADCAST_BLOCKS:
        table = F.broadcast(table)
    hit = F.lit(True)
    for k in range(4):
        hit = hit & (F.col(f"w{k}").bitwiseAND(F.col(f"m{k}")) == F.col(f"m{k}"))
    return _keyed(keys, blocks).join(table, "block").filter(hit).drop("block", *(f"{x}{k}" for x in "mw" for k in range(4)))


def lookup_keys(urls: DataFrame, lengths: list[int]) -> DataFrame:
    """(host, path, kind, key_host, key_path) of distinct URLs; ``lengths``: the lengths that rules' paths have."""
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    cuts = F.filter(F.array(*(F.lit(n) for n in lengths)).cast("array<int>"), lambda n: n <= F.length("path"))
    prefix = F.flatten(F.transform(ends, lambda h: F.transform(cuts, lambda n: F.struct(F.lit("prefix").alias("kind"), h.alias("host"), F.substring(F.col("path"), F.lit(1), n).alias("path")))))
    exact = F.array(F.struct(F.lit("exact").alias("kind"), F.col("host").alias("host"), F.col("path").alias("path")))
    keys = F.concat(exact, prefix) if lengths else exact
    return urls.select(F.col("host").alias("u_host"), F.col("path").alias("u_path"), F.inline(keys))


def judge(pages: DataFrame, listed: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """The pages with host, path, rule and verdict; these four replace columns of the same names.

    ``listed``: (host, path) of URLs to block; ``rules``: (host, path, verdict), of moderate number.
    The lengths of rules' paths come to the driver: at most as many as a URL may have characters.
    """
    rule_rows = rules.select(F.lit("prefix").alias("kind"), "host", "path", "verdict").distinct()
    entries = rule_rows.unionByName(listed.select(F.lit("exact").alias("kind"), "host", "path", F.lit("block").alias("verdict")).distinct())
    n_entries, lengths = entries.agg(F.count("*"), F.collect_set(F.when(F.col("kind") == "prefix", F.length("path")))).first()
    pages = pages.withColumns({"__host": host(F.col(url)), "__path": path(F.col(url))}).drop("host", "path", "rule", "verdict")
    pages = pages.withColumnsRenamed({"__host": "host", "__path": "path"})
    urls = pages.select("host", "path").filter("host <> '' or path <> ''").distinct()
    maybe = possible(lookup_keys(urls, sorted(lengths)), entries.select("kind", "host", "path"), n_entries)
    sure = maybe.join(entries.hint("shuffle_hash"), ["kind", "host", "path"])
    by_rule = F.when(F.col("kind") == "prefix", F.struct((F.length("host") + F.length("path")).alias("n"), F.length("host").alias("h"), F.concat("host", "path").alias("rule"), "verdict"))
    found = sure.groupBy(F.col("u_host").alias("host"), F.col("u_path").alias("path")).agg(F.max(by_rule).alias("__best"))
    verdict = F.coalesce("__best.verdict", F.when(F.col("__hit"), F.lit("block")), F.lit("allow"))
    joined = pages.join(found.withColumn("__hit", F.lit(True)), ["host", "path"], "left")
    return joined.select(*pages.columns, F.col("__best.rule").alias("rule"), verdict.alias("verdict"))


#: Rules of the registered query: (host, path, verdict).
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: Host labels whose crawled URLs make up the listing of the registered query.
LISTED_LABELS = ("ads-track", "spam-farm", "casino-win", "adult-x", "cheap-pills", "free-bets")


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def listing(pages: DataFrame, labels=LISTED_LABELS) -> DataFrame:
    """Canonical URLs of all pages on hosts with a listed label."""
    urls = pages.select(host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    return urls.filter(F.arrays_overlap(F.split("host", r"\."), F.array(*map(F.lit, labels)))).distinct()
