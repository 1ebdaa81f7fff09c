"""Structured Streaming over the event table: watermarked movement epochs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources import shared


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files, with an event time that watermarks accept."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.withColumn("at", F.col("ts").cast("timestamp"))


def movement_epochs(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Movement of each tumbling epoch; closed epochs are emitted once the watermark passes them."""
    score = F.least(F.lit(1000), F.floor(F.col("value") * 4)).cast("int")
    return events.withWatermark("at", late).groupBy(F.window("at", width), "event_type").agg(F.sum(score).alias("movement"), F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "movement", "n")


def run_available(stream: DataFrame, schema_from: DataFrame | None = None) -> DataFrame:
    """Run a stream over what is there, into Parquet, and read the sink."""
    spark, folder = stream.sparkSession, shared.folder(stream.sparkSession, "stream")
    query = stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
