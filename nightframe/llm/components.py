"""Connected components of links, with tables of the shared folder instead of a growing lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from . import scratch


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node that links (a, b) reach, for every node that has a link.

    Each round a node takes the least label beside it and then its label's label, so chains halve. Joins of many
    links deal out both sides.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    tables, rounds = scratch.Working(links.sparkSession), scratch.Working(links.sparkSession)
    both = tables.written(both, "links")
    many = both.count() > scratch.BROADCAST_ROWS
    labels = rounds.written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("component")), "labels")
    while True:
        near = both.join(scratch.dealt(labels, many), F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        step = labels.join(scratch.dealt(near, many), "node").select("node", F.least("component", "m").alias("c"), "component")
        jump = labels.select(F.col("node").alias("c"), F.col("component").alias("cc"))
        new = step.join(scratch.dealt(jump, many), "c", "left").select("node", F.least("c", F.coalesce("cc", "c")).alias("to"), "component")
        seen = Observation()
        new = new.observe(seen, F.coalesce(F.sum((F.col("to") < F.col("component")).cast("int")), F.lit(0)).alias("moved"))
        labels = rounds.written(new.select("node", F.col("to").alias("component")), "labels")
        rounds.clear(but_last=1)
        if not seen.get["moved"]:
            tables.clear()
            return labels
