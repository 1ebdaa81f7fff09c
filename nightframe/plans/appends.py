"""The paired append, read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import shared
from ..sources.views import SPECS, ctes
from ..streaming import appends
from .registry import ORACLES, QUERIES

VITALS, QUALITY = "id bigint, side string, t bigint, heart_rate double", "vitals_id bigint, quality_score double"


def pair(batch):
    """Vitals and the quality row of each, from one batch."""
    return {"vitals": batch.select("id", "side", "t", "heart_rate"), "quality": batch.select(F.col("id").alias("vitals_id"), F.round(F.col("hrv") / 320, 6).alias("quality_score"))}


def sink_append(spark, sf_dir):
    """Events streamed into two tables that are committed together, joined again."""
    table, columns, _ = SPECS["vitals"]
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir).selectExpr(*(f"{e.format(div='div')} as {c}" for c, e in columns.items()))
    root = shared.folder(spark, "tables")
    appends.run(appends.unique(rows, ["side", "t"]), root, shared.folder(spark, "state"), pair)
    vitals, quality = appends.read(spark, root, "vitals", VITALS), appends.read(spark, root, "quality", QUALITY)
    return vitals.join(quality, vitals["id"] == quality["vitals_id"]).select("id", "side", "t", "heart_rate", "quality_score")


QUERIES["sink_append"] = sink_append
ORACLES["sink_append"] = ctes("vitals") + " select id, side, t, heart_rate, round(hrv / 320, 6) as quality_score from vitals"
