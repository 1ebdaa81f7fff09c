"""Vital signs of a recording, told once a minute while somebody is there.

The windows' numbers (spread, periodicity, heart rate with its score, breathing, variability) are found for all minutes at
once. What depends on the minutes before, presence with its hysteresis and the heart-rate tracker, is a fold over them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from . import folds, recordings as r, signals, trackers

# fixed values
ENTER, LEAVE, PERIODIC, QUIET = 400_000.0, 150_000.0, 0.45, 3
COUPLED_STD, COUPLED_ACR = 4.0, 0.6
OTHER_ACR, OTHER_SHARE = 0.3, 0.7
SNR_SHARE, HR_SHARE = 0.55, 0.45
HR_SECONDS, BREATH_SECONDS = 30, 60
TOLD = "at bigint, heart_rate double, hrv double, breathing_rate double, quality double, flags string"


def rates(rate: float) -> r.Kernel:
    return lambda x: np.stack(signals.heart_rate_of(x - x.mean(axis=1, keepdims=True), rate), axis=1) if len(x) else np.zeros((0, 2))


def breaths(rate: float) -> r.Kernel:
    return lambda x: signals.breathing_of(x - x.mean(axis=1, keepdims=True), rate) if len(x) else np.zeros(0)


def minutes(samples: DataFrame, keys: list[str], rate: float, every: int = 60) -> DataFrame:
    """(keys, at, std, acr, rate, score, breathing, hrv): the numbers of the windows that end at each minute; ``at`` in seconds from sample 0.

    A minute whose last half is not whole has no row.
    """
    def ending(seconds, kernels):
        # windows that end with a minute begin a fixed time after one: number the samples from there
        shift = (-seconds) % every * int(rate)
        moved = samples.withColumn("i", F.col("i") - shift).filter("i >= 0")
        out = r.windows(moved, keys, int(seconds * rate), int(every * rate), kernels)
        return out.withColumn("at", F.col("w") * every + shift // int(rate) + seconds).drop("w")

    heart = ending(HR_SECONDS, {"std": r.window_std(rate), "acr": r.acr_quality(rate), ("rate", "score"): rates(rate)})
    breath = ending(BREATH_SECONDS, {"breathing": breaths(rate)})
    return heart.join(breath, [*keys, "at"], "left").join(r.hrv(samples, keys, rate, every=every).drop("intervals"), [*keys, "at"], "left")


def uncoupled(found: DataFrame, group: list[str], side: str, enter: float = ENTER) -> DataFrame:
    """``found`` with ``acr`` 0 where the other side's is clear and its spread as strong: then it is the other sleeper's."""
    other = found.select(*group, "at", F.when(F.col(side) == "left", "right").otherwise("left").alias(side), F.col("acr").alias("__acr"), F.col("std").alias("__std"))
    coupled = (F.col("__acr") > OTHER_ACR) & (F.col("__std") > OTHER_SHARE * F.col("std")) & (F.col("std") < enter)
    rows = found.join(other, [*group, side, "at"], "left")
    return rows.withColumn("acr", F.when(F.coalesce(coupled, F.lit(False)), 0.0).otherwise(F.col("acr"))).drop("__acr", "__std")


def follower(enter: float = ENTER, leave: float = LEAVE):
    """The step over minutes (at, std, acr, rate, score, breathing, hrv, pump)."""

    def run(state: dict, rows: pd.DataFrame):
        here, low, recent, misses, told = state["here"], state["low"], list(state["recent"]), state["misses"], []
        number = lambda v: None if pd.isna(v) else float(v)
        for row in rows.to_dict("records"):
            std, acr, score = number(row["std"]) or 0.0, number(row["acr"]) or 0.0, number(row["score"]) or 0.0
            if not here:
                # while the pump runs, its noise alone lets nobody in
                noise = row["pump"] is True and not (std > enter * COUPLED_STD and acr > COUPLED_ACR)
                here, low = not noise and (std > enter or acr > PERIODIC), 0
            else:
                low = low + 1 if std < leave and acr < PERIODIC / 2 else 0
                here = low < QUIET
            if not here:
                low = 0
                continue
            heart = number(row["rate"])
            if heart is not None:
                heart, recent, misses = trackers.believed(heart, recent, misses)
            hrv, breathing = number(row["hrv"]), number(row["breathing"])
            if heart is None and hrv is None and breathing is None:
                continue
            quality = round(SNR_SHARE * max(0.0, min(1.0, acr)) + HR_SHARE * (max(0.0, min(1.0, score)) if heart is not None else 0.0), 3)
            flags = [name for name, bad in (("no_hr", heart is None), ("no_hrv", hrv is None), ("no_br", breathing is None), ("low_signal", std < enter)) if bad]
            told.append((int(row["at"]), heart, hrv, breathing, quality, ",".join(flags)))
        out = pd.DataFrame(told, columns=["at", "heart_rate", "hrv", "breathing_rate", "quality", "flags"], dtype=object)
        state = {"here": here, "low": low, "recent": recent, "misses": misses}
        return state, out.astype({"at": "int64"} | dict.fromkeys(("heart_rate", "hrv", "breathing_rate", "quality"), "Float64"))

    return run


def emitted(found: DataFrame, keys: list[str], enter: float = ENTER, leave: float = LEAVE, **cut) -> DataFrame:
    """(keys, at, heart_rate, hrv, breathing_rate, quality, flags) of minutes with ``pump``, whether the side's own pump runs.

    Somebody is there from a minute that is loud or periodic until three in a row are neither. A minute without any number tells
    nothing; missing spread and periodicity count as 0.
    """
    begin = {"here": False, "low": 0, "recent": [], "misses": 0}
    return folds.fold(found, keys, follower(enter, leave), begin, TOLD, t="at", **cut)
