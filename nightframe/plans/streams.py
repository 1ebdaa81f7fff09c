"""Streaming queries, read back from their sinks; the oracle is restricted to epochs that the watermark has closed."""

from __future__ import annotations

from ..streaming import epochs
from .registry import ORACLES, QUERIES


def stream_hourly_movement(spark, sf_dir):
    out = epochs.run_available(epochs.movement_epochs(epochs.event_stream(spark, sf_dir)))
    return out.selectExpr("cast(start as timestamp_ntz) as start", "event_type", "movement", "n")


QUERIES["stream_hourly_movement"] = stream_hourly_movement
ORACLES["stream_hourly_movement"] = """
with e as (select date_trunc('hour', ts) as start, event_type, cast(least(1000, floor(value * 4)) as int) as score from events)
select start, event_type, cast(sum(score) as bigint) as movement, count(*) as n from e
where start + interval 1 hour <= (select max(ts) from events) - interval 2 hour group by 1, 2
"""
