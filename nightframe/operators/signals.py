"""Kernels over sample arrays: energy by built-in functions, spectra and beats by Arrow functions.

An array is one record's samples (a bounded second or window), so a batch of rows
is a matrix; rows of unequal length are padded with their mean.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf


def energy(samples: Column) -> Column:
    """Mean square."""
    return F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) / F.size(samples)


def peak_to_peak(samples: Column) -> Column:
    return F.array_max(samples) - F.array_min(samples)


def rms(samples: Column) -> Column:
    return F.sqrt(energy(samples))


def matrix(rows: pd.Series) -> np.ndarray:
    """Rows of samples about zero."""
    width = max((len(r) for r in rows if r is not None), default=0)
    out = np.zeros((len(rows), width))
    for k, r in enumerate(rows):
        if r is not None and len(r):
            x = np.asarray(r, float)
            out[k, : len(x)] = x - np.nanmean(x)
    return np.nan_to_num(out)


def autocorrelation(x: np.ndarray) -> np.ndarray:
    """By a zero-padded transform, relative to lag 0; silent rows stay zero."""
    n = x.shape[1]
    size = 1 << max(1, (2 * n - 1).bit_length())
    power = np.abs(np.fft.rfft(x, size)) ** 2
    acr = np.fft.irfft(power, size)[:, :n]
    top = acr[:, :1]
    return np.where(top > 1e-12, acr / np.where(top > 1e-12, top, 1), 0.0)


def bandpass(x: np.ndarray, rate: float, low: float, high: float, order: int = 4) -> np.ndarray:
    """Zero-phase Butterworth band: its squared magnitude applied to the spectrum of the mirrored signal."""
    n = x.shape[1]
    both = np.concatenate([x, x[:, ::-1]], 1)
    f = np.fft.rfftfreq(both.shape[1], 1 / rate)
    with np.errstate(divide="ignore", over="ignore"):
        ratio = (f * f - low * high) / np.where(f > 0, f * (high - low), np.inf)
        gain = np.where(f > 0, 1 / (1 + ratio ** (2 * order)), 0)
    return np.fft.irfft(np.fft.rfft(both, axis=1) * gain, both.shape[1], axis=1)[:, :n]


def _at(acr: np.ndarray, lags: np.ndarray) -> np.ndarray:
    """Values between whole lags, by straight lines; none beyond the last."""
    low = lags.astype(int)
    part = lags - low
    inside = low + 1 < acr.shape[1]
    low = np.minimum(low, acr.shape[1] - 2)
    return np.where(inside, acr[:, low] * (1 - part) + acr[:, low + 1] * part, 0.0)


def _peaks(x: np.ndarray, height: float, distance: int) -> np.ndarray:
    """Whether each value is a peak, of which the higher ones rule out others nearer than ``distance``."""
    peak = np.zeros_like(x, bool)
    peak[:, 1:-1] = (x[:, 1:-1] > x[:, :-2]) & (x[:, 1:-1] >= x[:, 2:]) & (x[:, 1:-1] >= height)
    for k in range(len(x)):
        at = np.flatnonzero(peak[k])
        for i in at[np.argsort(-x[k, at], kind="stable")]:
            if peak[k, i]:
                peak[k, max(0, i - distance + 1) : i] = False
                peak[k, i + 1 : i + distance] = False
    return peak


def heart_rate_of(x: np.ndarray, rate: float, low: float = 45, high: float = 120) -> tuple[np.ndarray, np.ndarray]:
    """(beats a minute, score): the lag whose autocorrelation and that of its parts is strongest; NaN below 0.1."""
    acr = autocorrelation(bandpass(x, rate, 1.0, 10.0))
    lags = np.arange(int(rate * 60 / high), min(int(rate * 60 / low) + 1, acr.shape[1]))
    if not len(lags):
        return np.full(len(x), np.nan), np.zeros(len(x))
    score = sum(w * np.maximum(_at(acr, lags / k), 0) for k, w in ((1, 1.0), (2, 0.8), (3, 0.6)))
    inner = acr[:, lags]
    score = np.where(_peaks(inner, 0.02, int(rate * 0.15)), score, -1)
    best = score.argmax(1)
    every = np.arange(len(x))
    # a lag of two beats scores high as well: where half of it is as strong a peak, that is the beat
    half = np.round(lags[best] / 2).astype(int) - lags[0]
    for k in np.flatnonzero(half > 0):
        near = np.arange(max(0, half[k] - 3), half[k] + 4)
        better = near[score[k, near].argmax()]
        if score[k, better] > 0 and inner[k, better] >= 0.9 * inner[k, best[k]]:
            best[k] = better
    top = score[every, best]
    return np.where(top >= 0.1, 60 * rate / lags[best], np.nan), np.maximum(top, 0)


def breathing_of(x: np.ndarray, rate: float) -> np.ndarray:
    """Breaths a minute from the envelope of the cardiac band: its strongest rhythm between 6 and 30."""
    envelope = np.abs(bandpass(x, rate, 0.8, 10.0))
    slow = bandpass(envelope - envelope.mean(1, keepdims=True), rate, 0.1, 0.7)
    size = slow.shape[1] * 4
    power = np.abs(np.fft.rfft(slow, size)) ** 2
    f = np.fft.rfftfreq(size, 1 / rate) * 60
    inside = (f >= 6) & (f <= 30)
    if not inside.any():
        return np.full(len(x), np.nan)
    best = f[inside][power[:, inside].argmax(1)]
    return np.where(power[:, inside].max(1) > 1e-9, best, np.nan)


def heart_rate(samples: Column, rate: float = 500.0) -> Column:
    @pandas_udf("double")
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series(heart_rate_of(matrix(rows), rate)[0])

    return run(samples)


def breathing_rate(samples: Column, rate: float = 500.0) -> Column:
    @pandas_udf("double")
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series(breathing_of(matrix(rows), rate))

    return run(samples)
