"""Trackers of vital signs and of pump noise: folds whose state fades."""

from __future__ import annotations

from statistics import median

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import folds

# fixed values of the heart-rate tracker
SPREAD, REMEMBERED, LIKELY, GIVE_UP = 15.0, 5, 0.3, 3
HALF, DOUBLE = (40, 120), (40, 180)
# fixed values of the energy gate
ALIKE, SPIKE, GUARD, OLD, NEW, CALM, SETTLING = 0.5, 10.0, 5, 0.95, 0.05, 3, 10


def likely(rate: float, usual: float) -> bool:
    """Whether a rate fits the usual one, by a bell curve about it."""
    return bool(np.exp(-0.5 * ((rate - usual) / SPREAD) ** 2) > LIKELY)


def believed(rate: float, recent: list[float], misses: int) -> tuple[float, list[float], int]:
    """(rate told, the rates remembered, misses in a row) after one candidate."""
    usual = median(recent) if recent else rate
    # the rate itself, or its octaves where they lie in range
    fits = [x for x, (lo, hi) in ((rate, (rate, rate)), (rate / 2, HALF), (rate * 2, DOUBLE)) if lo <= x <= hi and likely(x, usual)]
    if fits:
        return fits[0], [*recent, fits[0]][-REMEMBERED:], 0
    return (rate, [rate], 0) if misses + 1 == GIVE_UP else (rate, recent, misses + 1)


def track(state: dict, rows: pd.DataFrame) -> tuple[dict, pd.DataFrame]:
    """Rates told, one for each candidate; ``state``: the last rates that were believed, and how many since were not."""
    recent, misses, told = list(state["recent"]), state["misses"], []
    for rate in rows["rate"].to_numpy(np.float64, na_value=np.nan):
        value = None
        if not np.isnan(rate):
            value, recent, misses = believed(float(rate), recent, misses)
        told.append(value)
    return {"recent": recent, "misses": misses}, pd.DataFrame({"t": rows["t"].to_numpy(), "rate": pd.array(told, "Float64")})


def heart_rates(candidates: DataFrame, keys: list[str], **cut) -> DataFrame:
    """(keys, t, rate): candidates (t, rate) with harmonics put right and outliers kept out of the memory.

    A candidate near the median of the last five believed is believed; else its half or its double may be. Otherwise it is told as
    it is but not remembered, and the third such in a row starts the memory anew. A null candidate gives null and changes nothing.
    """
    return folds.fold(candidates, keys, track, {"recent": [], "misses": 0}, "t bigint, rate double", **cut)


def gate(state: dict, rows: pd.DataFrame) -> tuple[dict, pd.DataFrame]:
    """Whether each record is dropped, and the baseline after it; ``state``: baseline, records in it, end of the guard."""
    base, n, until = state["base"], state["n"], state["until"]
    dropped, bases = [], []
    for t, left, right in zip(rows["t"].tolist(), rows["left"].tolist(), rows["right"].tolist()):
        guarded = until is not None and t < until
        silent = guarded or left == 0 or right == 0
        low, high = min(left, right), max(left, right)
        pump = not silent and base is not None and base > 0 and low / high > ALIKE and high / base > SPIKE
        if pump:
            until = t + GUARD
        elif not silent:
            mean = (left + right) / 2
            if base is None:
                base, n = mean, 1
            elif mean < base * CALM:
                base, n = OLD * base + NEW * mean, min(n + 1, SETTLING)
                base = min(base, mean) if n < SETTLING else base
        dropped.append(guarded or pump)
        bases.append(base)
    return {"base": base, "n": n, "until": until}, pd.DataFrame({"t": rows["t"].to_numpy(), "dropped": dropped, "baseline": pd.array(bases, "Float64")})


def energy_gate(records: DataFrame, keys: list[str], **cut) -> DataFrame:
    """(keys, t, dropped, baseline) of records (t, left, right), the mean squares of both channels.

    A record is dropped where both channels rise together, ten times above a mean that old records fade from, and for five
    seconds after. Only calm records move the mean; the first ten may only lower it. A silent channel decides nothing; records without an
    energy are left out.
    """
    return folds.fold(records.dropna(subset=["left", "right"]), keys, gate, {"base": None, "n": 0, "until": None}, "t bigint, dropped boolean, baseline double", **cut)
