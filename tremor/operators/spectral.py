"""Spectra.  Kernels run in numpy on one signal (a file of a channel) at a time; averages are left to Spark."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.functions import signal as G
from tremor.operators import windows as X


def _ordered(pdf: pd.DataFrame) -> np.ndarray:
    x = pdf.sort_values("i").value.to_numpy(float)
    return np.nan_to_num(x, nan=0.0, posinf=0.0, neginf=0.0)


def _per_signal(df: DataFrame, keys: list[str], rows, schema: str) -> DataFrame:
    kinds = dict(df.dtypes)

    def run(key, pdf):
        out = rows(_ordered(pdf))
        for k, v in zip(reversed(keys), reversed(key)):
            out.insert(0, k, v)
        return out

    return df.select(*keys, "i", "value").groupBy(*keys).applyInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), schema]))


def spectrogram(df: DataFrame, keys: list[str], fs: float = 100.0, size: int = 256, overlap: int = 64, window: str = "hamming") -> DataFrame:
    """(keys, segment, t, freq, power): density of each segment."""

    def rows(x):
        f, p = G.periodograms(x, fs, size, overlap, window)
        n, step = p.shape[0], max(1, min(size, len(x)) - min(overlap, size - 1))
        seg = np.repeat(np.arange(n), len(f))
        return pd.DataFrame({"segment": seg, "t": (seg * step + size / 2) / fs, "freq": np.tile(f, n), "power": p.ravel()})

    return _per_signal(df, keys, rows, "segment bigint, t double, freq double, power double")


def welch(df: DataFrame, keys: list[str], fs: float = 100.0, size: int = 512, window: str = "hann", top: float = 20.0) -> DataFrame:
    """(keys, freq, power): the mean over half-overlapping segments, up to ``top`` Hz."""
    return spectrogram(df, keys, fs, size, size // 2, window).where(F.col("freq") <= top).groupBy(*keys, "freq").agg(F.avg("power").alias("power"))


def spectral_peaks(psd: DataFrame, keys: list[str], share: float = 0.02, distance: int = 20, most: int = 5) -> DataFrame:
    """The first peaks, in the order of frequency, of some share of the largest."""
    kinds = dict(psd.dtypes)

    def run(key, pdf):
        pdf = pdf.sort_values("freq")
        p = pdf.power.to_numpy(float)
        at = G.find_peaks(p, share * p.max() if len(p) else 0, distance)[:most]
        out = pd.DataFrame({"freq": pdf.freq.to_numpy(float)[at], "power": p[at]})
        for k, v in zip(reversed(keys), reversed(key)):
            out.insert(0, k, v)
        return out

    return psd.groupBy(*keys).applyInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "freq double, power double"]))


def bands(psd: DataFrame, keys: list[str]) -> DataFrame:
    """Centroid, trapezoid energies of 0-3, 3-8 and from 8 Hz (a trapezoid needs both ends in its band), and total."""
    w = X.by([*keys, "_b"], "freq")
    d = psd.withColumn("_b", F.when(F.col("freq") < 3, 0).when(F.col("freq") < 8, 1).otherwise(2))
    d = d.withColumn("_a", (F.col("freq") - F.lag("freq").over(w)) * (F.col("power") + F.lag("power").over(w)) / 2)
    d = d.withColumn("_t", (F.col("freq") - F.lag("freq").over(X.by(keys, "freq"))) * (F.col("power") + F.lag("power").over(X.by(keys, "freq"))) / 2)
    band = lambda k, n: F.coalesce(F.sum(F.when(F.col("_b") == k, F.col("_a"))), F.lit(0.0)).alias(n)
    return d.groupBy(*keys).agg(F.try_divide(F.sum(F.col("freq") * F.col("power")), F.sum("power")).alias("centroid"), band(0, "low_band"), band(1, "mid_band"), band(2, "high_band"), F.coalesce(F.sum("_t"), F.lit(0.0)).alias("total"))


def bandpass(df: DataFrame, keys: list[str], fs: float = 100.0, low: float = 0.2, high: float = 16.0, order: int = 4) -> DataFrame:
    """(keys, i, value): zero-phase Butterworth; a signal too short for the filter's ends stays as it is."""

    def rows(x):
        b, a = G.butter_bandpass(order, low, high, fs)
        y = G.filtfilt(b, a, x) if len(x) > 3 * max(len(a), len(b)) else x
        return pd.DataFrame({"i": np.arange(len(x)), "value": y})

    return _per_signal(df, keys, rows, "i bigint, value double")


def reconstruct(df: DataFrame, keys: list[str], step: int) -> DataFrame:
    """(keys, i, value, rebuilt): every ``step``-th sample, and a cubic spline through them."""

    def rows(x):
        i = np.arange(len(x))
        return pd.DataFrame({"i": i, "value": x, "rebuilt": G.cubic(i[::step].astype(float), x[::step], i.astype(float)) if len(x) else x})

    return _per_signal(df, keys, rows, "i bigint, value double, rebuilt double")


def anomaly(df: DataFrame, keys: list[str], fs: float = 100.0, offset: float = 7.0, factor: float = 0.9) -> DataFrame:
    """(keys, i, value): the signal with its high frequencies drawn down."""
    return _per_signal(df, keys, lambda x: pd.DataFrame({"i": np.arange(len(x)), "value": G.compress_frequencies(x, fs, offset, factor) if len(x) > 1 else x}), "i bigint, value double")


def event_spectra(df: DataFrame, keys: list[str], fs: float = 100.0) -> DataFrame:
    """(keys, spectral features) of each event's samples."""
    names = list(G.spectral_features(np.zeros(0)))
    return _per_signal(df, keys, lambda x: pd.DataFrame([G.spectral_features(x, fs)]), ", ".join(f"{n} double" for n in names))


def dft_power(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """(keys, bin, power): |DFT|^2 of short signals as a join with the bins, in codegen."""
    d = df.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n // 2).cast("long"))))
    angle = F.lit(2 * np.pi / n) * ((F.col("i") * F.col("bin")) % n)
    g = d.groupBy(*keys, "bin").agg(F.sum(F.col("value") * F.cos(angle)).alias("re"), F.sum(F.col("value") * F.sin(angle)).alias("im"))
    return g.select(*keys, "bin", (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("power"))


def fft_magnitude(df: DataFrame, keys: list[str], fs: float = 100.0) -> DataFrame:
    """(keys, bin, freq, magnitude) of whole signals of any length."""

    def rows(x):
        m = np.abs(np.fft.rfft(x)) if len(x) else x
        return pd.DataFrame({"bin": np.arange(len(m)), "freq": np.fft.rfftfreq(len(x), 1 / fs) if len(x) else m, "magnitude": m})

    return _per_signal(df, keys, rows, "bin bigint, freq double, magnitude double")


def round_trip(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, i, value, back): each signal, and what its transform and back gives."""
    return _per_signal(df, keys, lambda x: pd.DataFrame({"i": np.arange(len(x)), "value": x, "back": np.fft.ifft(np.fft.fft(x)).real if len(x) else x}), "i bigint, value double, back double")


def welch_grid(df: DataFrame, keys: list[str], windows: tuple[str, ...] = ("hann", "hamming", "blackman", "flattop", "bartlett"), sizes: list[int] = (256, 512, 1024), fs: float = 100.0, top: float = 20.0) -> DataFrame:
    """(keys, window, size, freq, power) for each window and segment length; a signal is read once."""

    def rows(x):
        parts = []
        for w in windows:
            for n in sizes:
                f, p = G.periodograms(x, fs, n, n // 2, w)
                mean = p.mean(0) if len(p) else np.zeros(0)
                parts.append(pd.DataFrame({"window": w, "size": n, "freq": f[: len(mean)], "power": mean}))
        return pd.concat(parts)

    return _per_signal(df, keys, rows, "window string, size bigint, freq double, power double").where(F.col("freq") <= top)


def event_features(df: DataFrame, keys: list[str], fs: float = 100.0) -> DataFrame:
    """(keys, features): moments in the JVM, the spectral part in numpy, joined by event."""
    v = F.col("value")
    q = lambda p: F.percentile(v, p)
    rms, mean_abs = F.sqrt(F.avg(v * v)), F.avg(F.abs(v))
    g = df.groupBy(*keys).agg(
        F.count(v).alias("n"), (F.count(v) / fs).alias("duration"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.var_pop(v).alias("var"), F.min(v).alias("vmin"), F.max(v).alias("vmax"),
        (F.max(v) - F.min(v)).alias("range"), rms.alias("rms"), F.max(F.abs(v)).alias("peak"), F.sum(v * v).alias("energy"), F.skewness(v).alias("skew"), F.kurtosis(v).alias("kurt"), mean_abs.alias("mean_abs"),
        q(0.1).alias("p10"), q(0.25).alias("p25"), q(0.5).alias("p50"), q(0.75).alias("p75"), q(0.9).alias("p90"), (q(0.75) - q(0.25)).alias("iqr"),
        F.try_divide(F.max(F.abs(v)), rms).alias("crest"), F.try_divide(rms, mean_abs).alias("shape"), F.try_divide(F.max(F.abs(v)), mean_abs).alias("impulse"),
        F.try_divide(F.stddev_pop(v), F.abs(F.avg(v))).alias("variation"),
    )
    return g.join(X.zero_crossings(df, keys, "value"), keys).join(event_spectra(df, keys, fs), keys)
