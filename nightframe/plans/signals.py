"""Queries of the sample-array kernels over the embedding arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import signals as s
from .registry import ORACLES, QUERIES


def _samples(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


QUERIES["dsp_energy"] = lambda spark, d: _samples(spark, d).select("vec_id", F.round(s.energy(F.col("embedding")), 5).alias("energy"), F.round(s.rms(F.col("embedding")), 5).alias("rms"), F.round(s.peak_to_peak(F.col("embedding")).cast("double"), 5).alias("p2p"))
ORACLES["dsp_energy"] = "select vec_id, round(list_sum(list_transform(embedding, lambda x: x::double * x::double)) / len(embedding), 5) as energy, round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double)) / len(embedding)), 5) as rms, round((list_max(embedding) - list_min(embedding))::double, 5) as p2p from embeddings"


def proj_reduce_cap(spark, sf_dir):
    """The first eight channels without the two references: max, mean, spread and the strongest pair."""
    c = F.transform(F.slice("embedding", 1, 6), lambda x: x.cast("double"))
    pairs = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: (F.element_at("c", 2 * i + 1) + F.element_at("c", 2 * i + 2)) / 2)
    rows = _samples(spark, sf_dir).select("vec_id", c.alias("c")).withColumn("z", pairs)
    mean = F.aggregate("c", F.lit(0.0), lambda a, x: a + x) / 6
    return rows.select("vec_id", F.round(F.array_max("c"), 5).alias("max"), F.round(mean, 5).alias("mean"), F.round(F.array_max("c") - F.array_min("c"), 5).alias("spread"), (F.array_position("z", F.array_max("z")) - 1).alias("peak_zone"))


QUERIES["proj_reduce_cap"] = proj_reduce_cap
ORACLES["proj_reduce_cap"] = "with c as (select vec_id, list_transform(embedding[1:6], lambda x: x::double) as c from embeddings), z as (select *, [(c[1] + c[2]) / 2, (c[3] + c[4]) / 2, (c[5] + c[6]) / 2] as z from c) select vec_id, round(list_max(c), 5) as max, round(list_sum(c) / 6, 5) as mean, round(list_max(c) - list_min(c), 5) as spread, cast(list_position(z, list_max(z)) - 1 as bigint) as peak_zone from z"
