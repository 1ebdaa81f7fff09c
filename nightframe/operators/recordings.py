"""Kernels over hopping windows of long recordings: periodicity, spread and heart-rate variability.

A recording is one sample a row, numbered at a fixed rate, and may be one key's and never end. It is dealt out by
stretches of sample numbers; the samples that windows of a stretch need beyond its edge are copied to it, so every window lies
whole in one group, once. A group's windows are the rows of a matrix, and kernels work on all of them at once.

Windows with a missing sample are left out. Of several samples with one number the largest counts. A band that reaches
to half the rate or beyond can't be filtered; the window is then taken as it is.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .signals import _at, _peaks, autocorrelation, bandpass

#: Samples of a stretch, at least.
STRETCH = 1 << 16
# fixed values: bands, beats a minute, and the chain of beat intervals
QUALITY_BAND, STD_BAND, BEAT_BAND = (0.8, 8.5), (1.0, 10.0), (0.8, 8.5)
BEATS = (40, 150)
LAG_WEIGHTS, LEAST_SCORE, INTERVAL_MS = (1.0, 0.8, 0.6), 0.1, (400, 1500)
OCTAVES, TOLERANCE = (1.0, 2.0, 0.5, 3.0, 1 / 3), 0.18
FEWEST, WIDEST_GAP, FEWEST_STEPS, HRV_MS = 10, 3, 5, (5, 100)

Kernel = Callable[[np.ndarray], np.ndarray]


def windows(samples: DataFrame, keys: list[str], size: int, hop: int, kernels: dict[str | tuple[str, ...], Kernel], i: str = "i", x: str = "x") -> DataFrame:
    """(keys, w, names) of each whole window: window w has the ``size`` samples from number ``w * hop`` on; each kernel gives a number for each row of a matrix, or a column for each of its names."""
    width = -(-max(STRETCH, size) // hop) * hop
    rows = samples.select(*keys, F.col(i).cast("long").alias("__i"), F.col(x).cast("double").alias("__x")).dropna().filter("__i >= 0")
    own = F.floor(F.col("__i") / width)
    early = F.when((F.col("__i") % width < size - hop) & (own > 0), own - 1)
    rows = rows.withColumn("__s", F.explode(F.filter(F.array(own, early), lambda s: s.isNotNull())))
    names = [n for k in kernels for n in ([k] if isinstance(k, str) else k)]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        start = int(pdf["__s"].iloc[0]) * width
        # windows further apart than they are long leave samples between them
        dense = np.full(width + max(0, size - hop), np.nan)
        np.fmax.at(dense, pdf["__i"].to_numpy() - start, pdf["__x"].to_numpy())
        all_of = np.lib.stride_tricks.sliding_window_view(dense, size)[::hop]
        missing = np.append(0, np.cumsum(np.isnan(dense)))
        at = np.arange(len(all_of)) * hop
        whole = np.flatnonzero(missing[at + size] == missing[at])
        if not len(whole):
            return pd.DataFrame(columns=["w", *names, *keys])
        found = {"w": start // hop + whole}
        for name, kernel in kernels.items():
            # matrices of some megabytes
            parts = [kernel(all_of[k]) for k in np.array_split(whole, max(1, len(whole) * size >> 20))]
            columns = np.concatenate(parts).reshape(len(whole), -1).T
            found |= {n: pd.array([None if v != v else v for v in c], "Float64") for n, c in zip([name] if isinstance(name, str) else name, columns)}
        out = pd.DataFrame(found)
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out

    typed = "".join(f"`{k}` {samples.schema[k].dataType.simpleString()}, " for k in keys)
    return rows.groupBy(*keys, "__s").applyInPandas(run, f"{typed}w bigint, " + ", ".join(f"{n} double" for n in names))


def _band(x: np.ndarray, rate: float, band: tuple[float, float]) -> np.ndarray:
    return bandpass(x, rate, *band) if band[1] < rate / 2 else x


def acr_quality(rate: float) -> Kernel:
    """The highest autocorrelation of the first ten seconds at a lag of a heart beat; 0 for silence or less."""

    def kernel(x: np.ndarray) -> np.ndarray:
        seg = _band(x, rate, QUALITY_BAND)[:, : int(10 * rate)]
        seg = seg - seg.mean(axis=1, keepdims=True)
        lo, hi = int(rate * 60 / BEATS[1]), min(int(rate * 60 / BEATS[0]), seg.shape[1] - 1)
        if hi <= lo or not len(x):
            return np.zeros(len(x))
        best = autocorrelation(seg)[:, lo : hi + 1].max(axis=1)
        return np.where(seg.std(axis=1) < 1e-10, 0.0, np.maximum(best, 0.0))

    return kernel


def window_std(rate: float, seconds: int = 5) -> Kernel:
    """The median deviation of a window's pieces of five seconds."""

    def kernel(x: np.ndarray) -> np.ndarray:
        size = int(seconds * rate)
        x = _band(x, rate, STD_BAND)
        n = x.shape[1] // size
        return np.median(x[:, : n * size].reshape(len(x), n, size).std(axis=2), axis=1) if n else np.zeros(len(x))

    return kernel


def beat_interval(rate: float) -> Kernel:
    """Milliseconds between beats: the peak of the autocorrelation that it and its parts support best; none below a score."""

    def kernel(x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        acr = autocorrelation(_band(x, rate, BEAT_BAND))
        lags = np.arange(int(rate * 60 / BEATS[1]), min(int(rate * 60 / BEATS[0]) + 1, acr.shape[1]))
        score = sum(w * np.maximum(_at(acr, lags / (k + 1)), 0) for k, w in enumerate(LAG_WEIGHTS))
        score = np.where(_peaks(acr[:, lags], 0.02, int(rate * 0.15)), score, 0.0)
        best = score.argmax(axis=1)
        ms = lags[best] / rate * 1000
        ok = (score[np.arange(len(x)), best] >= LEAST_SCORE) & (ms >= INTERVAL_MS[0]) & (ms <= INTERVAL_MS[1])
        return np.where(ok, ms, np.nan)

    return kernel


def usual(believed: list[float]) -> float | None:
    """The mean of the last five intervals, without the least and the greatest of four or more; of the first two as they are."""
    last = sorted(believed[-5:]) if len(believed) > 2 else believed
    last = last[1:-1] if len(last) > 3 else last
    return sum(last) / len(last) if last else None


def believed(intervals: list[float]) -> list[float | None]:
    """Each interval as it is near the usual one, the usual one where it is near a multiple or a part of that, else none."""
    kept: list[float] = []
    out = []
    for ms in intervals:
        mid = usual(kept)
        near = [m for m in OCTAVES if mid is not None and abs(ms - mid * m) / (mid * m) < TOLERANCE]
        value = ms if mid is None or (near and near[0] == 1.0) else mid if near else None
        out.append(value)
        if value is not None:
            kept.append(value)
    return out


def variability(w: list[int], intervals: list[float]) -> float | None:
    """Root mean square of the steps between neighbouring windows' intervals, in milliseconds; none where too few are sound."""
    if len(w) < FEWEST:
        return None
    pairs = [(i, v) for i, v in zip(w, believed(intervals)) if v is not None]
    if len(pairs) < FEWEST:
        return None
    at, x = (np.array(c) for c in zip(*pairs))
    sound = []
    for k in range(len(x)):
        near = x[max(0, k - 3) : k + 4]
        mid = np.median(near)
        sound.append(abs(x[k] - mid) <= 3 * 1.4826 * max(np.median(np.abs(near - mid)), 1e-6))
    at, x = at[sound], x[sound]
    steps = np.diff(x)[np.diff(at) < WIDEST_GAP]
    if len(x) < FEWEST or len(steps) < FEWEST_STEPS:
        return None
    index = float(np.sqrt(np.mean(steps**2)))
    return index if HRV_MS[0] <= index <= HRV_MS[1] else None


def hrv(samples: DataFrame, keys: list[str], rate: float, span: int = 300, every: int = 60, size: int = 10, hop: int = 5) -> DataFrame:
    """(keys, at, intervals, hrv): every ``every`` seconds the variability over the last ``span`` seconds' windows.

    Each window's interval is found once; it then goes to the ends it counts for, and a chain runs over the few of each. Each
    window is filtered by itself. ``at`` counts seconds from sample 0; the last end is the first one after a key's last interval.
    """
    beats = windows(samples, keys, int(size * rate), int(hop * rate), {"ms": beat_interval(rate)}).filter("ms is not null")
    final = beats.groupBy(*keys).agg(F.max("w").alias("__w"))
    first = F.ceil((F.col("w") * hop + size) / every)
    last = F.least(F.floor((F.col("w") * hop + span) / every), F.ceil((F.col("__w") * hop + size) / every))
    ends = beats.join(final, keys).filter(first <= last).select(*keys, "w", "ms", F.explode(F.sequence(first, last)).alias("end")).filter(F.col("end") * every >= span)

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("w")
        value = variability(pdf["w"].tolist(), pdf["ms"].tolist())
        out = {"at": [int(pdf["end"].iloc[0]) * every], "intervals": [len(pdf)], "hrv": pd.array([value], "Float64")}
        return pd.DataFrame({k: [pdf[k].iloc[0]] for k in keys} | out)

    typed = "".join(f"`{k}` {samples.schema[k].dataType.simpleString()}, " for k in keys)
    return ends.groupBy(*keys, "end").applyInPandas(chain, f"{typed}at bigint, intervals bigint, hrv double")
