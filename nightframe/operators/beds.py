"""Sessions and movement of a bed side from samples of its channels, in one fold that batch and stream share.

Movement is the sum of the absolute differences of neighbouring samples, told for epochs that close with the first sample at least a minute
after the last close, and only inside a session: scaled, capped, less a low percentile of the session's last epochs, and the
median of three. A session's end forgets all of it. The step is a small function of a state and rows, so a series can be
run whole (``folds``) or as it comes (``streaming.beds``).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import folds
from .sessions import ABSENCE, DEBOUNCE, LONGEST, SHORTEST, SPANS, Stay

# fixed values of the movement score; the scale is that of float channels, integer ones have 0.5
EPOCH, SCALE, INT_SCALE, MOST = 60, 10.0, 0.5, 1000
TRAILING, COLD, PERCENT, SMOOTHED = 30, 10, 5, 3
TOLD = f"kind string, t bigint, entered bigint, left_at bigint, duration bigint, exits bigint, present {SPANS}, absent {SPANS}, movement bigint"
COLUMNS = ["kind", "t", "entered", "left_at", "duration", "exits", "present", "absent", "movement"]


def begin() -> dict:
    return {"stay": Stay(DEBOUNCE, ABSENCE, SHORTEST, LONGEST).dump(), "last": None, "sum": 0.0, "before": None, "scores": [], "medians": []}


def scored(state: dict, total: float, scale: float) -> int:
    """The score of an epoch that moved by ``total``; the epochs it is compared with are kept in ``state``."""
    raw = min(MOST, int(total * scale))
    scores = state["scores"] = [*state["scores"], raw][-TRAILING:]
    low = sorted(scores)[max(0, int(PERCENT / 100 * len(scores) + 0.5) - 1)] if len(scores) > COLD else 0
    last = state["medians"] = [*state["medians"], max(0, raw - low)][-SMOOTHED:]
    return sorted(last)[1] if len(last) == SMOOTHED else last[-1]


def _added(total: float, values: np.ndarray) -> float:
    """One by one: a sum of another order could round otherwise."""
    for v in values.tolist():
        total += v
    return total


def _rows(told: list[dict]) -> pd.DataFrame:
    out = pd.DataFrame([[row.get(c) for c in COLUMNS] for row in told], columns=COLUMNS, dtype=object)
    return out.astype({c: "Int64" for c in ("t", "entered", "left_at", "duration", "exits", "movement")})


def _moved(channels: pd.Series, before: list[float] | None, closed: np.ndarray) -> tuple[np.ndarray, list[float] | None]:
    """How far each sample moved from the last whole one of its session, and the last whole one at the end; the samples ``closed`` end one."""
    held = pa.array(channels, pa.list_(pa.float64()), from_pandas=True)
    sizes = held.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    flat = held.flatten().to_numpy(zero_copy_only=False)
    n, known = len(sizes), before or []
    # a row each; the first is the last whole one of before, shorter ones end in zeros
    table = np.zeros((n + 1, max(sizes.max(initial=0), len(known))))
    table[0, : len(known)] = known
    row = np.repeat(np.arange(1, n + 1), sizes)
    table[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    sizes = np.concatenate([[len(known)], sizes])
    whole = np.flatnonzero((sizes > 0) & ~np.isnan(table).any(axis=1))
    was, now = whole[:-1], whole[1:]
    # sample i is row i + 1
    ends = np.searchsorted(closed, whole - 1)
    like = (sizes[was] == sizes[now]) & (ends[:-1] == ends[1:])
    moved, steps = np.zeros(n), np.zeros(len(now))
    for c in range(table.shape[1]):
        steps += np.abs(table[now, c] - table[was, c])
    moved[now[like] - 1] = steps[like]
    if not len(whole) or len(closed) > ends[-1]:
        return moved, None
    return moved, table[whole[-1], : sizes[whole[-1]]].tolist()


def follower(scale: float = SCALE, rules: tuple[int, int, int, int] = (DEBOUNCE, ABSENCE, SHORTEST, LONGEST)):
    """The step over rows (t, present, channels): it tells closed sessions and epochs of movement."""

    def run(state: dict, rows: pd.DataFrame):
        stay, state = Stay(*rules), dict(state)
        stay.load(state["stay"])
        t, told = rows["t"].to_numpy(np.int64), []
        if not len(t):
            return state, _rows(told)
        # where the stay can change: the samples stepped at, whether it is open after each, its closings and what they tell
        at, opened, closed, done = [-1], [stay.start is not None], [], {}
        for i, session in stay.steps(t, rows["present"].to_numpy(bool)):
            at.append(i)
            opened.append(stay.start is not None)
            if opened[-2] and not opened[-1]:
                closed.append(i)
            if session:
                done[i] = session
        moved, before = _moved(rows["channels"], state["before"], np.array(closed, np.int64))
        ticks, last = [], int(t[0]) if state["last"] is None else state["last"]
        while (i := int(np.searchsorted(t, last + EPOCH))) < len(t):
            ticks.append(i)
            last = int(t[i])
        inside = np.array(opened)[np.searchsorted(at, ticks) - 1] if ticks else ()
        epochs, ends = dict(zip(ticks, inside)), set(closed)
        # sums start anew after each epoch and each end of a session
        begun, total = 0, state["sum"]
        for i in sorted({*ticks, *closed, *done}):
            if epochs.get(i):
                told.append({"kind": "movement", "t": int(t[i]), "movement": scored(state, _added(total, moved[begun : i + 1]), scale)})
            if i in done:
                told.append({"kind": "session", "t": int(t[i]), **done[i]})
            if i in epochs or i in ends:
                begun, total = i + 1, 0.0
            if i in ends:
                state |= {"scores": [], "medians": []}
        state |= {"stay": stay.dump(), "last": last, "sum": _added(total, moved[begun:]), "before": before}
        return state, _rows(told)

    return run


def usable(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Samples with a key and a time; unknown presence is absence."""
    return samples.select(*keys, F.col("t").cast("long").alias("t"), F.coalesce("present", F.lit(False)).alias("present"), F.col("channels").cast("array<double>").alias("channels")).dropna(subset=[*keys, "t"])


def follow(samples: DataFrame, keys: list[str], scale: float = SCALE, **cut) -> DataFrame:
    """Closed sessions and epochs of movement of samples (keys, t, present, channels), a row each; ``kind`` tells which.

    A sample whose channels are missing moves nothing, and the next is compared with the last whole one. The first epoch is counted from a
    key's first sample. The times of a key are distinct.
    """
    return folds.fold(usable(samples, keys), keys, follower(scale), begin(), TOLD, **cut)


def epochs(told: DataFrame) -> DataFrame:
    return told.filter("kind = 'movement'").drop("kind", "entered", "left_at", "duration", "exits", "present", "absent")


def sessions(told: DataFrame) -> DataFrame:
    return told.filter("kind = 'session'").drop("kind", "t", "movement")
