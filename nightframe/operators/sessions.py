"""Sessions of presence: debounced, closed by absence or by length, from samples of any density.

A series may be one key's and never end, so it is first cut where its state is known: after an absence of debounce plus
timeout no session is open and no change is pending, whatever was before. The stays between such absences are dealt out
over the cluster, and each is streamed through its task in time order with a state of a few numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from . import segments as g

DEBOUNCE, ABSENCE, SHORTEST, LONGEST = 30, 120, 300, 16 * 3600


class Stay:
    """The state of one key's sessionizer; ``feed`` takes samples in time order and yields closed sessions."""

    def __init__(self, debounce: int, absence: int, shortest: int, longest: int):
        self.debounce, self.absence, self.shortest, self.longest = debounce, absence, shortest, longest
        self.clear()

    def clear(self) -> None:
        self.here = False  # the committed state
        self.pending = self.start = self.since = self.seen = None
        self.exits, self.present, self.absent = 0, [], []

    def dump(self) -> dict:
        """All but the settings, as plain values."""
        return {k: getattr(self, k) for k in ("here", "pending", "start", "since", "seen", "exits", "present", "absent")}

    def load(self, state: dict) -> None:
        for k, v in state.items():
            setattr(self, k, list(v) if isinstance(v, list) else v)

    def step(self, t: int, present: bool) -> dict | None:
        flip = present != self.here and self.pending is not None and t - self.pending >= self.debounce
        edge = self.pending if flip else t
        if flip:
            self.here = present
        if flip or present == self.here:
            self.pending = None
        elif self.pending is None:
            self.pending = t
        if self.here:
            if self.start is None:
                self.start = self.since = edge
            elif flip:
                self.absent.append((self.since, edge))
                self.since = edge
            self.seen = t
        else:
            if flip:
                self.present.append((self.since, edge))
                self.since, self.exits = edge, self.exits + 1
            if self.start is not None and t - self.seen >= self.absence:
                return self.close(self.since)
        if self.here and t - self.start >= self.longest:
            return self.close(self.start + self.longest)
        return None

    def close(self, left: int) -> dict | None:
        if self.here:
            self.present.append((self.since, left))
        elif left > self.since:
            self.absent.append((self.since, left))
        out = None
        if left - self.start >= self.shortest:
            spans = {k: [{"start": a, "end": b} for a, b in v] for k, v in (("present", self.present), ("absent", self.absent))}
            out = {"entered": self.start, "left_at": left, "duration": left - self.start, "exits": self.exits, **spans}
        self.clear()
        return out

    def feed(self, t: np.ndarray, present: np.ndarray) -> Iterator[dict]:
        """The sessions that close."""
        return (out for _, out in self.steps(t, present) if out)

    def steps(self, t: np.ndarray, present: np.ndarray) -> Iterator[tuple[int, dict | None]]:
        """Steps through the samples at which something can change, with what each tells; those between only prolong a presence."""
        changes = np.flatnonzero(np.diff(present)) + 1
        i, n = 0, len(t)
        while i < n:
            yield i, self.step(int(t[i]), bool(present[i]))
            nearest = np.searchsorted(changes, i, "right")
            nxt = int(changes[nearest]) if nearest < len(changes) else n
            if bool(present[i]) != self.here and self.pending is None:
                nxt = i + 1
            due = [self.pending + self.debounce] if self.pending is not None else []
            if self.start is not None:
                due.append(self.start + self.longest if self.here else self.seen + self.absence)
            nxt = min([nxt, *(max(i + 1, int(np.searchsorted(t, d))) for d in due)])
            if self.here:
                self.seen = int(t[nxt - 1])
            i = nxt


def stays(samples: DataFrame, keys: list[str], quiet: int, t: str = "t") -> DataFrame:
    """``samples`` with ``stay``: it goes up by one where a presence follows an absence of at least ``quiet`` seconds.

    Absences are looked for within time segments; one that reaches over an edge may be missed, which joins two stays and
    changes no session.
    """
    rows = samples.withColumn("__seg", g.segment_of(t))
    w = g.within(keys, t)
    before = F.lag("present").over(w)
    rows = rows.withColumn("__b", F.when(F.coalesce(before != F.col("present"), F.lit(True)), F.col(t)))
    since = F.last("__b", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    cut = F.col("present") & ~before & (F.lag(t).over(w) - since >= quiet)
    rows = rows.withColumn("__cut", F.coalesce(cut, F.lit(False)).cast("long"))
    return g.running_sum(rows, keys, "__cut", "stay", t).drop("__b", "__cut")


SPANS = "array<struct<start: bigint, end: bigint>>"


def sessions(samples: DataFrame, keys: list[str], debounce: int = DEBOUNCE, absence: int = ABSENCE, shortest: int = SHORTEST, longest: int = LONGEST) -> DataFrame:
    """(keys, entered, left_at, duration, exits, present, absent) of each closed session of samples (keys, t, present).

    A change of presence counts once it has lasted ``debounce`` seconds, from its first sample on. A session ends with
    the first absent sample once nobody has been there for ``absence`` seconds, or ``longest`` after its start; below
    ``shortest`` it is dropped, and one that is still open at the end gives no row. Null presence is absence; samples
    without a time or a key are left out; the times of a key are distinct.
    """
    known = samples.select(*keys, F.col("t").cast("long").alias("t"), F.coalesce("present", F.lit(False)).alias("present")).dropna()
    dealt = stays(known, keys, debounce + absence).select(*keys, "stay", "t", "present")
    dealt = dealt.repartition(*keys, "stay").sortWithinPartitions(*keys, "stay", "t")
    columns = [*keys, "entered", "left_at", "duration", "exits", "present", "absent"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for batch in batches:
            found = []
            for key, rows in batch.groupby([*keys, "stay"], sort=False):
                if key != last:
                    last, state = key, Stay(debounce, absence, shortest, longest)
                found += [(*key[:-1], *s.values()) for s in state.feed(rows["t"].to_numpy(), rows["present"].to_numpy())]
            if found:
                yield pd.DataFrame(found, columns=columns)

    typed = ", ".join(f"`{k}` {known.schema[k].dataType.simpleString()}" for k in keys)
    return dealt.mapInPandas(run, f"{typed}, entered bigint, left_at bigint, duration bigint, exits bigint, present {SPANS}, absent {SPANS}")
