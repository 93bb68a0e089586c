"""Raw acceleration: counts, calibration, deviation by block, steps.

Recursive filters and the search for steps go through one sensor's samples in order. A
series is cut into stretches, which reach over into their neighbours by more than a
filter's response lasts, so each stretch is a group of bounded size and a long series
is filtered by many tasks. What can be summed by window or stretch is summed by Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.activity import freedson, to_cpm, vector_magnitude
from . import bouts
from . import wear as wear_ops

#: The published counts filter and its limits.
COUNTS_A = [1, -3.63, 5.04, -3.10, 0.506, 0.324, -0.157, 0.0195]
COUNTS_B = [-0.00934, -0.0255, -0.00424, 0.0442, 0.0365, -0.0119, -0.0229, -0.00679]
RESCALE, CAP, FLOOR_AT, LFE_LEAST = 17.127404, 128, 4, 1
RATE, FINAL_RATE = 30, 10
#: Samples (of RATE) after which a filter's response is over, and those of a stretch, at least.
RESPONSE = 4096
STRETCH = 1 << 18


def _impulse(b: np.ndarray, a: np.ndarray, n: int = RESPONSE) -> np.ndarray:
    """The first ``n`` values of a filter's response to one."""
    y = np.zeros(n)
    for i in range(n):
        k = min(i, len(a) - 1)
        y[i] = (b[i] if i < len(b) else 0.0) - np.dot(a[1 : k + 1], y[i - k : i][::-1])
    return y


def steady_filter(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The filter's output if the first value had always been there before."""
    h = _impulse(np.asarray(b, float), np.asarray(a, float))
    padded = np.concatenate((np.full(len(h), x[0]), x))
    size = 1 << int(len(padded) + len(h)).bit_length()
    return np.fft.irfft(np.fft.rfft(padded, size) * np.fft.rfft(h, size), size)[len(h) : len(padded)]


def both_ways(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward, with the ends turned about themselves, so without delay."""
    n = min(3 * max(len(a), len(b)), len(x) - 1)
    padded = np.concatenate((2 * x[0] - x[n:0:-1], x, 2 * x[-1] - x[-2 : -n - 2 : -1])) if n > 0 else x
    out = steady_filter(b, a, steady_filter(b, a, padded)[::-1])[::-1]
    return out[n : n + len(x)]


def _digital(poles: np.ndarray, zeros: np.ndarray, gain: complex) -> tuple[np.ndarray, np.ndarray]:
    """The bilinear transform (rate 2) of an analogue filter."""
    zd, pd_ = (4 + zeros) / (4 - zeros), (4 + poles) / (4 - poles)
    k = gain * np.prod(4 - zeros) / np.prod(4 - poles)
    zd = np.concatenate((zd, -np.ones(len(poles) - len(zeros))))
    return np.real(k * np.poly(zd)), np.real(np.poly(pd_))


def butterworth_band(order: int, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """A band-pass between two shares of half the sampling rate."""
    prototype = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    a, b = 4 * np.tan(np.pi * low / 2), 4 * np.tan(np.pi * high / 2)
    half = prototype * (b - a) / 2
    root = np.sqrt(half**2 - a * b)
    return _digital(np.concatenate((half + root, half - root)), np.zeros(order), (b - a) ** order)


def chebyshev_low(order: int, ripple_db: float, cut: float) -> tuple[np.ndarray, np.ndarray]:
    """A low-pass of type I up to a share of half the sampling rate."""
    eps = np.sqrt(10 ** (ripple_db / 10) - 1)
    mu = np.arcsinh(1 / eps) / order
    theta = np.pi * (2 * np.arange(1, order + 1) - 1) / (2 * order)
    poles = -np.sinh(mu) * np.sin(theta) + 1j * np.cosh(mu) * np.cos(theta)
    gain = np.real(np.prod(-poles)) / (np.sqrt(1 + eps**2) if order % 2 == 0 else 1)
    w = 4 * np.tan(np.pi * cut / 2)
    return _digital(poles * w, np.zeros(0), gain * w**order)


def decimate(x: np.ndarray, q: int) -> np.ndarray:
    """Every ``q``-th sample after a low-pass without delay."""
    return x if q <= 1 else both_ways(*chebyshev_low(8, 0.05, 0.8 / q), x)[::q]


def count_signal(x: np.ndarray, rate: float, epoch_seconds: int = 60, lfe: bool = False) -> np.ndarray:
    """Counts by epoch of one axis; an unfinished last epoch is left out."""
    x = np.nan_to_num(np.asarray(x, float))
    if len(x) == 0:
        return np.zeros(0)
    x = np.minimum(np.abs(steady_filter(COUNTS_B, COUNTS_A, decimate(x, _factor(rate))) * RESCALE), CAP)
    if lfe:
        x = np.where(x < FLOOR_AT, np.floor(x) - 1, x)
        x = np.where(x < LFE_LEAST, 0, x)
    else:
        x = np.where(x < FLOOR_AT, 0, x)
    tens = np.floor(x[: len(x) // 3 * 3].reshape(-1, 3).sum(1) / 3)
    size = FINAL_RATE * epoch_seconds
    return tens[: len(tens) // size * size].reshape(-1, size).sum(1)


def step_places(x: np.ndarray, rate: float, threshold: float = 0.0359, gap_seconds: float = 0.3) -> np.ndarray:
    """Upward crossings of the band-passed signal, ``gap_seconds`` apart at least, as samples after decimation."""
    if len(x) < 10:
        return np.zeros(0, int)
    x = decimate(np.asarray(x, float), _factor(rate))
    y = both_ways(*butterworth_band(4, 0.25 / 15, 2.5 / 15), x - x.mean())
    out, last = [], -np.inf
    for i in (np.flatnonzero((y[:-2] < -threshold) & (y[1:-1] > threshold)) + 1).tolist():
        if i - last >= gap_seconds * RATE:
            out.append(i)
            last = i
    return np.array(out, int)


def count_steps(x: np.ndarray, rate: float, threshold: float = 0.0359, gap_seconds: float = 0.3) -> int:
    """Steps of a whole signal."""
    return len(step_places(x, rate, threshold, gap_seconds))


def _factor(rate: float) -> int:
    return round(rate / RATE) if rate > RATE else 1


def _cadence(acf: np.ndarray, rate: float, n: int, slowest: float, fastest: float) -> int:
    """Steps of ``n`` samples by the highest peak of the autocorrelation, from lag 1 on."""
    peaks = np.flatnonzero(np.diff(np.sign(np.diff(acf))) == -2) + 1
    if not len(peaks):
        return 0
    cadence = min(rate, RATE) / (peaks[np.argmax(acf[peaks])] + 1) * 60
    return 0 if not slowest <= cadence <= fastest else round(cadence * n / rate / 60)


def count_steps_by_period(x: np.ndarray, rate: float, slowest: float = 60, fastest: float = 200) -> int:
    """Steps of a whole signal from the highest peak of its autocorrelation."""
    if len(x) < rate * 2:
        return 0
    s = decimate(np.asarray(x, float), _factor(rate))
    s = s - s.mean()
    most = min(round(min(rate, RATE) * 60 / slowest), len(s) - 1)
    power = float(s @ s)
    if power == 0:
        return 0
    return _cadence(np.array([s[: len(s) - k] @ s[k:] for k in range(1, most + 1)]) / power, rate, len(x), slowest, fastest)


def _stretches(raw: DataFrame, rate: float | None, unit: Column | int, columns: list[str]) -> DataFrame:
    """``raw`` dealt to stretches of whole units of samples, each with what it reaches over into: subject, part, first (its own first sample, from 0), n_own, sample and ``columns``."""
    unit = F.lit(unit) if isinstance(unit, int) else unit
    factor = F.lit(_factor(rate)) if rate is not None else F.greatest(F.round(F.col("rate") / RATE), F.lit(1)).cast("int")
    units = lambda samples: (F.ceil(samples * factor / unit) * unit).cast("long")
    own, over = units(F.lit(STRETCH)), units(F.lit(3 * RESPONSE))
    at = F.col("sample") - 1
    part = F.floor(at / own)
    near = F.array(part, F.when(at % own < over, part - 1), F.when(at % own >= own - over, part + 1))
    parts = raw.select("subject", "sample", *columns, own.alias("n_own"), F.explode(F.array_compact(near)).alias("part")).where("part >= 0")
    return parts.withColumn("first", F.col("part") * F.col("n_own"))


def _by_stretch(parts: DataFrame, schema: str, make: Callable[[pd.DataFrame, int, int], pd.DataFrame]) -> DataFrame:
    """``make`` gets a stretch's rows in order, where its own ones begin among them, and how many it may have; a stretch that only reaches over has none."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("sample")
        before = int(rows["first"].iloc[0] - (rows["sample"].iloc[0] - 1))
        return make(rows, before, int(rows["n_own"].iloc[0]))

    return parts.groupBy("subject", "part").applyInPandas(run, schema)


def counts(raw: DataFrame, rate: float | None, epoch_seconds: int = 60, lfe: bool = False) -> DataFrame:
    """Counts by subject and epoch of all three axes of ``raw`` (subject, sample from 1 without gaps, x, y, z); axis1 is the vertical y. Without ``rate`` it is a column of ``raw``."""
    size = lambda r: 3 * FINAL_RATE * epoch_seconds * _factor(r)

    def make(rows: pd.DataFrame, before: int, n_own: int) -> pd.DataFrame:
        own = float(rows["rate"].iloc[0]) if rate is None else rate
        axes = [count_signal(rows[c].to_numpy(), own, epoch_seconds, lfe)[before // size(own) :][: n_own // size(own)] for c in "yxz"]
        first = int(rows["first"].iloc[0]) // size(own) + 1
        return pd.DataFrame({"subject": rows["subject"].iloc[0], "epoch": np.arange(first, first + len(axes[0])), "axis1": axes[0], "axis2": axes[1], "axis3": axes[2]})

    epoch = 3 * FINAL_RATE * epoch_seconds
    unit = size(rate) if rate is not None else epoch * F.greatest(F.round(F.col("rate") / RATE), F.lit(1)).cast("int")
    parts = _stretches(raw, rate, unit, ["x", "y", "z", *(["rate"] if rate is None else [])])
    return _by_stretch(parts, "subject string, epoch long, axis1 double, axis2 double, axis3 double", make)


def steps(raw: DataFrame, rate: float, by_period: bool = False, axis: str = "y", slowest: float = 60, fastest: float = 200) -> DataFrame:
    """Steps by subject: crossings, or by the period of the autocorrelation, whose sums are made by stretch."""
    q = _factor(rate)
    parts = _stretches(raw, rate, q, [axis])
    if not by_period:

        def crossings(rows: pd.DataFrame, before: int, n_own: int) -> pd.DataFrame:
            at = step_places(rows[axis].to_numpy(), rate) * q - before
            return pd.DataFrame({"subject": [rows["subject"].iloc[0]], "steps": [int(((at >= 0) & (at < n_own)).sum())]})

        return _by_stretch(parts, "subject string, steps long", crossings).groupBy("subject").agg(F.sum("steps").alias("steps"))
    lags = round(min(rate, RATE) * 60 / slowest)

    def sums(rows: pd.DataFrame, before: int, n_own: int) -> pd.DataFrame:
        """Of the decimated signal: the number and sum of own values, and of the products with the value at each lag the number and the three sums."""
        s = decimate(rows[axis].to_numpy(dtype=float), q)
        a, b = before // q, min(len(s), (before + n_own) // q)
        out = [b - a, s[a:b].sum()]
        for k in range(lags + 1):
            x, y = s[a : min(b, len(s) - k)], s[a + k : min(b + k, len(s))]
            out += [len(x), x.sum(), y.sum(), float(x @ y)]
        return pd.DataFrame({"subject": [rows["subject"].iloc[0]], "own": [max(0, len(rows) - before) if before + n_own >= len(rows) else n_own], "sums": [out if b > a else [0.0] * len(out)]})

    n = 2 + 4 * (lags + 1)
    found = _by_stretch(parts, "subject string, own long, sums array<double>", sums).groupBy("subject").agg(F.sum("own").alias("own"), F.array(*[F.sum(F.col("sums")[i]) for i in range(n)]).alias("sums"))

    def period(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for samples, v in zip(rows["own"], rows["sums"]):
                mean, by_lag = v[1] / max(v[0], 1), np.array(v[2:]).reshape(-1, 4)
                acf = by_lag[:, 3] - mean * (by_lag[:, 1] + by_lag[:, 2]) + mean * mean * by_lag[:, 0]
                most = min(lags, int(v[0]) - 1)
                ok = samples >= rate * 2 and acf[0] > 1e-12 * max(1.0, v[0])
                out.append(_cadence(acf[1 : most + 1] / acf[0], rate, samples, slowest, fastest) if ok else 0)
            yield pd.DataFrame({"subject": rows["subject"], "steps": out})

    return found.mapInPandas(period, "subject string, steps long")


def process(raw: DataFrame, rate: float, epoch_seconds: int = 60, cut_points: Callable[[Column], Column] = freedson, wear_algorithm: str = "troiano", lfe: bool = False) -> DataFrame:
    """Counts, their magnitude, wear and class, both from axis1, the vertical; ``cut_points`` is any function of counts per minute."""
    rule = wear_ops.RULES.get(wear_algorithm.lower())
    if rule is None:
        raise ValueError(f"wear_algorithm is one of {', '.join(wear_ops.RULES)}")
    out = counts(raw, rate, epoch_seconds, lfe)
    out = out.withColumn("vm", vector_magnitude(F.col("axis1"), F.col("axis2"), F.col("axis3")))
    out = wear_ops.wear(out, rule)
    return out.withColumn("intensity", cut_points(to_cpm(F.col("axis1"), epoch_seconds)))


@dataclass
class Processed:
    """Epochs, the classes over wear, and by subject the totals over wear; none computed before it is asked for."""

    epochs: DataFrame
    intensity: DataFrame
    totals: DataFrame


def processed(raw: DataFrame, rate: float, epoch_seconds: int = 60, cut_points: Callable[[Column], Column] = freedson, wear_algorithm: str = "troiano", calculate_steps: bool = True, step_method: str = "peak", lfe: bool = False) -> Processed:
    """All of a recording's results: those of ``process`` with their summaries, and steps (null unless asked for).

    Minutes are scaled by the epoch's length. A subject with less than one epoch has zeros in the totals.
    """
    if step_method not in ("peak", "autocorr"):
        raise ValueError("step_method is peak or autocorr")
    epochs = process(raw, rate, epoch_seconds, cut_points, wear_algorithm, lfe)
    minutes = epoch_seconds / 60
    intensity = bouts.intensity_summary(epochs, epoch_seconds)
    worn = lambda c: F.coalesce(F.sum(F.when(F.col("wear_time"), F.col(c))), F.lit(0.0))
    sums = epochs.groupBy("subject").agg(worn("axis1").alias("total_counts_y"), worn("vm").alias("total_counts_vm"), (F.count_if("wear_time") * minutes).alias("total_wear_minutes"))
    mvpa = bouts.mvpa_minutes(epochs, epoch_seconds=epoch_seconds)
    totals = raw.select("subject").distinct().join(sums.join(mvpa, "subject"), "subject", "left").fillna(0)
    if calculate_steps:
        found = steps(raw, rate, step_method == "autocorr").withColumnRenamed("steps", "total_steps")
        return Processed(epochs, intensity, totals.join(found, "subject", "left"))
    return Processed(epochs, intensity, totals.withColumn("total_steps", F.lit(None).cast("long")))


def mad_blocks(raw: DataFrame, block: int) -> DataFrame:
    """By subject and block of ``block`` samples: the mean distance of the magnitude from its mean; an unfinished last block is left out."""
    r = raw.select("subject", F.floor((F.col("sample") - 1) / block).alias("block"), vector_magnitude(F.col("x"), F.col("y"), F.col("z")).alias("r"))
    mean = r.groupBy("subject", "block").agg(F.avg("r").alias("m"), F.count("*").alias("n")).where(F.col("n") == block)
    return r.join(mean, ["subject", "block"]).groupBy("subject", "block").agg(F.avg(F.abs(F.col("r") - F.col("m"))).alias("mad"))


def still_windows(raw: DataFrame, samples: int, noise: float = 0.013) -> DataFrame:
    """Means over whole windows of ``samples`` in which no axis moves."""
    w = raw.groupBy("subject", F.floor((F.col("sample") - 1) / samples).alias("window")).agg(
        F.count("*").alias("n"), *[F.avg(a).alias(f"mean_{a}") for a in "xyz"], *[F.stddev_samp(a).alias(f"sd_{a}") for a in "xyz"]
    )
    still = (F.col("n") == samples) & (F.col("sd_x") < noise) & (F.col("sd_y") < noise) & (F.col("sd_z") < noise)
    return w.where(still).select("subject", "window", "mean_x", "mean_y", "mean_z")


def calibration(raw: DataFrame, samples: int, least: int = 100, noise: float = 0.013, rate: float = 0.1, rounds: int = 1000, tolerance: float = 1e-6) -> DataFrame:
    """By subject: offsets that bring still windows onto the unit sphere, by gradient descent over the windows' means; zeros with under ``least`` of them."""

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        m = rows.sort_values("window")[["mean_x", "mean_y", "mean_z"]].to_numpy()
        offset, before = np.zeros(3), np.abs(np.linalg.norm(m, axis=1) - 1).mean()
        enough = len(m) >= least
        for _ in range(rounds if enough else 0):
            c = m - offset
            norm = np.linalg.norm(c, axis=1)
            step = rate * 2 * (((norm - 1) / norm)[:, None] * c).mean(0)
            offset = offset + step
            if np.abs(step).max() < tolerance:
                break
        after = np.abs(np.linalg.norm(m - offset, axis=1) - 1).mean()
        values = [before, after] if enough else [None, None]
        return pd.DataFrame([[rows["subject"].iloc[0], *offset, len(m), *values, bool(enough and after < before)]], columns=["subject", "offset_x", "offset_y", "offset_z", "n_windows", "error_before", "error_after", "success"])

    schema = "subject string, offset_x double, offset_y double, offset_z double, n_windows long, error_before double, error_after double, success boolean"
    fitted = still_windows(raw, samples, noise).groupBy("subject").applyInPandas(fit, schema)
    out = raw.select("subject").distinct().join(fitted, "subject", "left")
    return out.fillna(0, ["offset_x", "offset_y", "offset_z", "n_windows"]).fillna(False, ["success"])


def apply_calibration(raw: DataFrame, offsets: DataFrame) -> DataFrame:
    """``raw`` less the offsets of its subject; there is one row of those for each subject."""
    joined = raw.join(offsets.select("subject", "offset_x", "offset_y", "offset_z"), "subject", "left")
    return joined.select(*[(F.col(c) - F.coalesce(f"offset_{c}", F.lit(0.0))).alias(c) if c in ("x", "y", "z") else F.col(c) for c in raw.columns])
