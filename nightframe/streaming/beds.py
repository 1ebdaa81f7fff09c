"""Sessions and movement as a stream: the fold of ``operators.beds`` with its state kept for each bed side.

Samples may come late and out of order within the watermark. They wait in the state until an event-time timer says that
the watermark has passed them, and are then taken in time order, so what is told does not depend on how the stream was cut into
batches, stopped or resumed; it equals the batch form over the samples that the watermark has passed. A sample that comes after
that is dropped by the watermark; one that comes twice within it counts once.

The state of a side is one small record and the samples of the last minutes, packed. A side is one task, as any keyed state.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import beds

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


#: Seconds of samples that are run at once, rows that wait in one value of the state, and their columns.
SPAN, HELD = 86400, 100_000
SAMPLES = pa.schema([("t", pa.int64()), ("present", pa.bool_()), ("channels", pa.list_(pa.float64()))])


def packed(rows: pd.DataFrame) -> bytes:
    """Samples as one compressed value."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, SAMPLES, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(pa.Table.from_pandas(rows, SAMPLES, preserve_index=False))
    return sink.getvalue().to_pybytes()


def unpacked(values: list[bytes]) -> pd.DataFrame:
    """Samples in time order; of those of one time the first that came."""
    rows = pa.concat_tables([pa.ipc.open_stream(v).read_all() for v in values]).to_pandas()
    return rows.drop_duplicates("t").sort_values("t")


class Follower(StatefulProcessor):
    """Holds back samples until the watermark has passed them, then runs the step over them.

    They wait by days, some thousands in one value, so neither the state's entries nor the rows in memory grow with what waits.
    """

    def __init__(self, keys: list[str], scale: float):
        self.keys, self.run = keys, beds.follower(scale)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "state string")
        self.count = handle.getValueState("count", "n bigint")
        self.waiting = handle.getMapState("waiting", "day bigint, n bigint", "samples binary")

    def hold(self, rows: pd.DataFrame) -> None:
        n = self.count.get()[0] if self.count.exists() else 0
        for day, part in rows.groupby(rows["t"] // SPAN):
            self.waiting.updateValue((int(day), n), (packed(part),))
        self.count.update((n + 1,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, some, n = None, [], 0
        for pdf in rows:
            if len(pdf):
                first = int(pdf["t"].min()) if first is None else min(first, int(pdf["t"].min()))
                some.append(pdf[SAMPLES.names])
                n += len(pdf)
            if n >= HELD:
                self.hold(pd.concat(some))
                some, n = [], 0
        if some:
            self.hold(pd.concat(some))
        if first is not None:
            self.handle.registerTimer(first * 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() // 1000
        parts = sorted(self.waiting.keys()) if self.waiting.exists() else []
        state = json.loads(self.state.get()[0]) if self.state.exists() else beds.begin()
        after = None
        for day, of_day in groupby(parts, key=lambda p: p[0]):
            if day * SPAN > passed:
                after = day * SPAN
                break
            names = list(of_day)
            samples = unpacked([self.waiting.getValue(p)[0] for p in names])
            rest = samples[samples["t"] > passed]
            ready = samples[samples["t"] <= passed]
            if len(ready):
                state, told = self.run(state, ready)
                for p in names:
                    self.waiting.removeKey(p)
                if len(rest):
                    self.waiting.updateValue(names[0], (packed(rest),))
                if len(told):
                    for name, value in zip(self.keys, key):
                        told.insert(0, name, value)
                    yield told[[*self.keys, *beds.COLUMNS]]
            if len(rest):
                after = int(rest["t"].iloc[0])
                break
        self.state.update((json.dumps(state),))
        if after is not None:
            self.handle.registerTimer(after * 1000)

    def close(self) -> None:
        pass


def follow(samples: DataFrame, keys: list[str], late: str = "2 minutes", scale: float = beds.SCALE) -> DataFrame:
    """The stream of closed sessions and epochs of a stream of samples (keys, t, present, channels)."""
    known = beds.usable(samples, keys).withColumn("at", F.timestamp_seconds("t")).withWatermark("at", late)
    typed = ", ".join(f"`{k}` {samples.schema[k].dataType.simpleString()}" for k in keys)
    return known.groupBy(*keys).transformWithStateInPandas(Follower(keys, scale), f"{typed}, {beds.TOLD}", "append", "eventTime")


def run(stream: DataFrame, out: str, state: str) -> DataFrame:
    """Runs what there is of a stream into the Parquet folder ``out``, from where ``state`` left off, and reads the whole folder."""
    spark: SparkSession = stream.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        query = stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
    return spark.read.schema(stream.schema).parquet(out)
