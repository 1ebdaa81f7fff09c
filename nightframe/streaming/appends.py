"""Appends of several tables from one stream, each batch once and in all of them or in none.

A batch writes each table's rows to a folder of its number, over what a failed attempt may have left, and then commits by one
file of that number. Readers see committed batches only, and a batch that is committed is not written again. So a failure between two
tables leaves neither visible, and the batch that Spark runs again after it leaves one copy.

Before that, rows that come twice within the watermark count once (``unique``): a late copy is dropped as an insert that
its key's index ignores.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

DONE = "_committed"


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def committed(spark: SparkSession, root: str) -> list[int]:
    """The numbers of the batches that are whole."""
    fs, at = _fs(spark, f"{root}/{DONE}")
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(at)) if fs.exists(at) else []


class Appended:
    """A batch function for ``foreachBatch``: ``split`` makes each table's rows of a batch, by name."""

    def __init__(self, root: str, split: Callable[[DataFrame], dict[str, DataFrame]]):
        self.root, self.split = root.rstrip("/"), split

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fs, mark = _fs(spark, f"{self.root}/{DONE}/{number}")
        if fs.exists(mark):
            return
        for name, rows in self.split(batch).items():
            self.write(rows, f"{self.root}/{name}/batch={number}")
        fs.mkdirs(mark.getParent())
        fs.create(mark, True).close()

    def write(self, rows: DataFrame, path: str) -> None:
        rows.write.mode("overwrite").parquet(path)


def read(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """The committed rows of a table, with the number of their batch."""
    numbers = committed(spark, root)
    if not numbers:
        return spark.createDataFrame([], f"{schema}, batch int")
    return spark.read.schema(f"{schema}, batch int").option("basePath", f"{root}/{name}").parquet(*(f"{root}/{name}/batch={n}" for n in numbers))


def unique(stream: DataFrame, keys: list[str], t: str = "t", late: str = "10 minutes") -> DataFrame:
    """A stream without rows whose key has come within the watermark; rows later than that are dropped by it."""
    return stream.withColumn("__at", F.timestamp_seconds(t)).withWatermark("__at", late).dropDuplicatesWithinWatermark(keys).drop("__at")


def run(stream: DataFrame, root: str, state: str, split: Callable[[DataFrame], dict[str, DataFrame]]) -> None:
    """Appends what there is of a stream, from where ``state`` left off."""
    stream.writeStream.foreachBatch(Appended(root, split)).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
