"""Queries of rules and set points that are stored as text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stored_rules as s
from .core import reg

SOUND = """
, w as (select *, avg(value) over k as mean, max(value) over k as top from steps window k as (partition by owner order by t range between 2400 preceding and current row)),
j as (select r.id, r.id % 10 as kind, r.id % 300 as k, w.* exclude (id) from stored r join w using (owner) where r.id % 10 < 5),
h as (select id, case kind when 0 then value > k when 1 then rate between 40 and 90 and not (value > 100 + k) when 2 then mean > 50 + k / 4.0 when 3 then case when value < k then true end when 4 then (t % 86400 // 60 >= 1200 or t % 86400 // 60 < 420) and top > 3 * k end as holds from j)"""


@reg("rule_stored", SOUND + " select id, count(*) as steps, count(*) filter (holds) as held, count(*) filter (holds is null) as unknown from h group by 1", "stored", "steps")
def rule_stored(stored, steps):
    """How often each stored rule holds over its owner's steps: all sound rules in one plan."""
    asked = stored.join(steps.select("owner").distinct(), "owner", "left_semi")  # others have no step to hold at
    told = s.tallied(steps, s.parsed(asked), "owner", {"bed.value": "value", "left.heartRate": "rate"})
    return told.groupBy("id").agg(*(F.sum(c).alias(c) for c in ("steps", "held", "unknown")))


@reg("rule_problems", " select case id % 10 when 5 then 'no JSON' when 6 then 'unknown kind ''maybe''' when 7 then 'too deep' when 8 then 'window has a bad lastMin' when 9 then 'no conditions' end as problem, count(*) as rules from stored group by 1", "stored")
def rule_problems(stored):
    """The stored rules by what is wrong with them."""
    return s.problems(s.parsed(stored))


@reg("fn_stored_points", ", p as (select id, case when json_valid(points) and json_type(points) = 'ARRAY' then json(points) end as j, vector from stored), l as (select *, cast(json_extract(j, '$[*]') as json[]) as e from p) select id, case when id % 4 in (0, 1) then len(e) else 0 end as n, case when id % 4 = 0 then cast(55 + id % 50 as double) when id % 4 = 1 then null end as first, case id % 3 when 0 then [1.5, cast(id % 7 as double), 3.0] end as zones from l", "stored")
def stored_points(stored):
    """Stored set points and zone vectors; malformed ones are empty or null."""
    points = s.set_points(F.col("points"))
    return stored.select("id", F.size(points).alias("n"), F.try_element_at(points, F.lit(1))["temperature"].alias("first"), s.zones(F.col("vector")).alias("zones"))
