"""Table maintenance on Parquet: insert-ignore, keyed upsert, retention and CSV export.

Each returns the new content lazily; ``replace`` writes it beside the old table and
reads it from there, so a failed job leaves the old one whole.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def insert_ignore(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Those new rows whose key is not in the target, one for each key."""
    return rows.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti").select(*rows.columns)


def upsert(target: DataFrame, rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Target and rows with the latest version of each key; a new row wins over an equally old one."""
    both = target.withColumn("__new", F.lit(0)).unionByName(rows.withColumn("__new", F.lit(1)))
    latest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(version), F.desc("__new")))
    return both.withColumn("__k", latest).filter("__k = 1").drop("__new", "__k")


def retain(table: DataFrame, t: str, now: int, days: int, inclusive: bool = False) -> DataFrame:
    """Rows that are kept: those before the cutoff go (with ``inclusive`` those at it too)."""
    cutoff = now - days * 86400
    return table.filter(F.col(t) > cutoff) if inclusive else table.filter(F.col(t) >= cutoff)


def dismiss(alerts: DataFrame, ids: list[int], now: int) -> DataFrame:
    """Alerts with a dismissal time where they had none."""
    return alerts.withColumn("dismissed_at", F.when(F.col("id").isin(ids) & F.col("dismissed_at").isNull(), now).otherwise(F.col("dismissed_at")))


def update_session(sessions: DataFrame, which: Column, entered: Column | None = None, left: Column | None = None) -> DataFrame:
    """Sessions with new edges and their duration; an end before its start keeps the old row."""
    e = F.when(which, entered).otherwise(F.col("entered")) if entered is not None else F.col("entered")
    l = F.when(which, left).otherwise(F.col("left_at")) if left is not None else F.col("left_at")
    ok = which & (l.isNull() | (l > e))
    return sessions.withColumns({"entered": F.when(ok, e).otherwise(F.col("entered")), "left_at": F.when(ok, l).otherwise(F.col("left_at")), "duration": F.when(ok & l.isNotNull(), l - e).otherwise(F.col("duration"))})


def replace(df: DataFrame, root: str, partition: str | None = None) -> str:
    """Write a new version of a table; returns its path."""
    path = f"{root.rstrip('/')}/v-{uuid.uuid4().hex}"
    w = df.write
    (w.partitionBy(partition) if partition else w).parquet(path)
    return path


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; nulls are empty cells."""
    df.write.csv(path, header=True, emptyValue="", nullValue="")


def retain_all(tables: dict[str, DataFrame], t: str, now: int, days: int) -> tuple[dict[str, DataFrame], DataFrame]:
    """(each table without rows before the cutoff, (name, kept, deleted) of all of them); rows without a time stay and count as kept."""
    cutoff = now - days * 86400
    old = F.coalesce(F.col(t) < cutoff, F.lit(False))
    kept = {name: df.filter(~old) for name, df in tables.items()}
    each = [df.agg(F.lit(name).alias("name"), F.count_if(~old).alias("kept"), F.count_if(old).alias("deleted")) for name, df in tables.items()]
    return kept, reduce(DataFrame.unionByName, each)
