"""Frame-wise maps. A frame is a row with an array column `v`; every function keeps the other columns.

All are column expressions over the array or numpy over batches of frames, so they run inside one stage without a shuffle.
Options are those of the operator. An empty frame stays empty, a null frame stays null, and a frame that holds a null gives
nulls; a number told of an empty frame is null (a rate: 0). Very long frames are frames like all others; other columns stay.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batch import vectors

#: Range of 16-bit samples, by which signal power is normalised.
ADC_RANGE = 65536.0


def _set(df: DataFrame, sql: str, into: str = "v") -> DataFrame:
    return df.withColumn(into, F.expr(sql))


def hamming(df: DataFrame) -> DataFrame:
    """Hamming window over the frame's length; the one value of a frame of length 1 has the weight of an end."""
    return _set(df, "transform(v, (x, i) -> x * (0.54D - 0.46D * cos(2 * pi() * i / greatest(size(v) - 1, 1))))")


def amplify(df: DataFrame, factor: float = 1.0) -> DataFrame:
    return _set(df, f"transform(v, x -> x * {float(factor)}D)")


def signal_power(df: DataFrame) -> DataFrame:
    """Mean square over the square of half the sample range, as column `power`."""
    return _set(df, f"aggregate(v, 0D, (a, x) -> a + x * x) / nullif(size(v), 0) / {ADC_RANGE * ADC_RANGE / 4}D", "power")


def log_scale(df: DataFrame, m: float = 1.0, a: float = 1.0, floor: float | None = None) -> DataFrame:
    """m * log10(x + a), where an argument that isn't positive counts as 1, so that the result is 0. With `floor`, nothing is
    added, and what is below the floor (1e-5 is usual) counts as the floor."""
    if floor is not None:
        return _set(df, f"transform(v, x -> {float(m)}D * log10(greatest(x, {float(floor)}D)))")
    return _set(df, f"transform(v, x -> {float(m)}D * log10(IF(x + {float(a)}D > 0, x + {float(a)}D, 1D)))")


def threshold(df: DataFrame, value: float = 0.0, limit: float = 1.0, mode: str = "upper") -> DataFrame:
    """Replaces what is beyond the limit by value: above it (upper), below it (lower), or on both sides with its sign (both)."""
    t, c = f"{float(limit)}D", f"{float(value)}D"
    rule = {"upper": f"IF(x >= {t}, {c}, x)", "lower": f"IF(x <= {t}, {c}, x)", "both": f"CASE WHEN x >= {t} THEN {c} WHEN x <= -{t} THEN -{c} ELSE x END"}
    return _set(df, f"transform(v, x -> {rule[mode]})")


def zero_crossings(df: DataFrame) -> DataFrame:
    """Hamming-weighted rate of sign changes, as column `rate`; zero counts as positive."""
    change = "IF((v[i + 1] >= 0) <> (v[i] >= 0), 0.54D - 0.46D * cos(2 * pi() * i / (size(v) - 1)), 0D)"
    return _set(df, f"CASE WHEN size(v) < 2 THEN IF(v IS NULL, NULL, 0D) ELSE aggregate(sequence(0, greatest(size(v) - 2, 0)), 0D, (a, i) -> a + {change}) / size(v) END", "rate")


def channel(df: DataFrame, index: int = 0, channels: int = 1) -> DataFrame:
    """One channel of interleaved samples."""
    return _set(df, f"filter(v, (x, i) -> i % {int(channels)} = {int(index)})")


def resample_spectrum(df: DataFrame, ratio: float) -> DataFrame:
    """Values at k * ratio by linear interpolation; ratio is at most 1."""
    if ratio > 1:
        raise ValueError("ratio is at most 1")
    at = f"(i * {float(ratio)}D)"
    return _set(df, f"transform(v, (x, i) -> v[int(floor{at})] + ({at} - floor{at}) * (v[least(int(floor{at}) + 1, size(v) - 1)] - v[int(floor{at})]))")


def median_filter(df: DataFrame, taps: int = 3) -> DataFrame:
    """Median of `taps` neighbours within a frame; the ends stay."""
    h = taps // 2
    return _set(df, f"transform(v, (x, i) -> IF(i < {h} OR i >= size(v) - {h}, x, array_sort(slice(v, i - {h} + 1, {2 * h + 1}))[{h}]))")


def linear_transform(df: DataFrame, matrix: np.ndarray) -> DataFrame:
    """Rows of the matrix times the frame. The matrix is a literal of the plan, of the size of a model."""
    rows = F.array(*(F.array(*(F.lit(float(x)) for x in row)) for row in np.asarray(matrix)))
    return df.withColumn("v", F.transform(rows, lambda r: F.aggregate(F.zip_with(r, "v", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)))


def cosine_matrix(n_out: int, n_in: int, kind: int = 1) -> np.ndarray:
    """Cosine transforms without scaling: 0, type I (ends count once, others twice); 1, type II; 2, type II over n_in with the first column halved."""
    k, j = np.arange(n_out)[:, None], np.arange(n_in)[None]
    if kind == 0:
        if n_in < 2:
            raise ValueError("a cosine transform of type I needs two inputs")
        out = 2 * np.cos(np.pi * k * j / (n_in - 1))
        out[:, [0, -1]] /= 2
        return out
    out = np.cos(np.pi * k * (j + 0.5) / n_in)
    if kind == 2:
        out /= n_in
        out[:, 0] /= 2
    return out


def cepstrum(df: DataFrame, n_out: int = 13, n_in: int = 30, kind: int = 1) -> DataFrame:
    return linear_transform(df, cosine_matrix(n_out, n_in, kind))


def mel(f: float) -> float:
    return 2595 * math.log10(1 + f / 700)


def hertz(m: float) -> float:
    return 700 * (10 ** (m / 2595) - 1)


def mel_matrix(filters: int, bins: int, rate: float, low: float = 0.0, high: float | None = None, version: int = 1) -> np.ndarray:
    """Triangles with equal distances on the mel scale over bins of a power spectrum, each of height 2 / (right - left) in hertz.

    The distance of bins is rate / (4 * (bins // 2)). Version 1 reads a triangle one bin further up than where its weight is used,
    as the reference results ask for; version 2 reads it at the bin itself. A triangle's weights beyond the last bin are left out.
    """
    high = high or rate / 2
    if low < 0 or 2 * high > rate or low > high:
        raise ValueError("edges must lie between 0 and half the rate")
    step = rate / (4 * (bins // 2))
    edges = [hertz(mel(low) + k * (mel(high) - mel(low)) / (filters + 1)) for k in range(filters + 2)]
    out = np.zeros((filters, bins))
    for f, (left, centre, right) in enumerate(zip(edges, edges[1:], edges[2:], strict=False)):
        tall = 2 / (right - left)
        for k in range(math.ceil(left / step), min(math.floor(right / step), bins - 1) + 1):
            at = (k + (version == 1)) * step
            out[f, k] = tall * ((at - left) / (centre - left) if at <= centre else (right - at) / (right - centre))
    return out


def sphinx_mel_matrix(filters: int, bins: int, fft_length: int, rate: float, low: float = 0.0, high: float | None = None) -> np.ndarray:
    """Triangles of height one over bins 1 and up at distances rate / fft_length; bin 0 has no weight."""
    high = high or rate / 2
    if 2 * high > rate:
        raise ValueError("the upper edge is beyond half the rate")
    edges = np.array([hertz(mel(low) + k * (mel(high) - mel(low)) / (filters + 1)) for k in range(filters + 2)])
    at = np.arange(bins) * rate / fft_length
    up = (at - edges[:-2, None]) / np.diff(edges)[:-1, None]
    down = (edges[2:, None] - at) / np.diff(edges)[1:, None]
    out = np.maximum(0, np.minimum(up, down))
    out[:, 0] = 0
    return out


def mel_filterbank(df: DataFrame, filters: int = 30, bins: int = 129, rate: float = 16000.0, version: int = 1) -> DataFrame:
    return linear_transform(df, mel_matrix(filters, bins, rate, version=version))


def sphinx_mel_filterbank(df: DataFrame, filters: int = 30, bins: int = 257, fft_length: int = 512, rate: float = 16000.0, low: float = 0.0, high: float | None = None) -> DataFrame:
    return linear_transform(df, sphinx_mel_matrix(filters, bins, fft_length, rate, low, high))


def warp_matrix(size: int, ratio: float, edge: float = 1.0, version: int = 1) -> np.ndarray:
    """Piecewise linear warping of a spectrum's frequency axis for vocal tract length normalisation.

    Version 1 integrates the spectrum over each warped bin, with slope `ratio` up to where the axis reaches `edge` and a line
    to the end above. Version 2 spreads each bin over the warped bins it covers and divides by the weight that they got."""
    out = np.zeros((size, size))
    if version == 1:
        turn = edge / ratio if edge < ratio else 1.0
        slope = (1 - edge) / (1 - turn) if turn < 1 else 0.0
        at = np.arange(size + 1) / size
        x = np.where(at < turn, ratio * at, slope * at + 1 - slope) * size
        for k in range(size):
            lo, hi = x[k], x[k + 1]
            first, last = min(int(lo), size - 1), min(int(hi), size)
            if first == last:
                out[k, first] += hi - lo
                continue
            out[k, first] += int(lo) + 1 - lo
            out[k, first + 1 : last] += 1
            if last < size:
                out[k, last] += hi - last
        return out
    bend = size * edge
    above = (size - ratio * bend) / (size - bend) if ratio < 1 and size > bend else ratio
    place = lambda f: bend * ratio + (f - bend) * above if f > bend else f * ratio
    for k in range(size):
        lo, hi = place(k - 0.5), place(k + 0.5)
        first, last = math.floor(lo), math.ceil(hi)
        for j in range(first, last + 1):
            if max(j, 0) >= size or first > size - 1:
                break
            share = last - hi if j == last else 1 - (lo - first) if j == first else 1.0
            out[max(j, 0), k] += share
    total = out.sum(1, keepdims=True)
    return np.where(total > 1e-20, out / np.where(total > 1e-20, total, 1), 0)


def warp_spectrum(df: DataFrame, size: int, ratio: float, edge: float = 1.0, version: int = 1) -> DataFrame:
    return linear_transform(df, warp_matrix(size, ratio, edge, version))


def fft(df: DataFrame, length: int) -> DataFrame:
    """Whole complex spectrum of real frames, cut or filled with zeros to `length`, as columns `re` and `im`."""
    def run(x: np.ndarray) -> dict:
        z = np.fft.fft(x.astype(float), length, axis=1)
        return {"re": z.real, "im": z.imag}

    return df.withColumn("__z", vectors(run, "re array<double>, im array<double>", "v")).withColumn("re", F.col("__z.re")).withColumn("im", F.col("__z.im")).drop("__z")


def dft_power(df: DataFrame, bins: int) -> DataFrame:
    """Power of the first `bins` bins of the discrete Fourier transform of a real frame."""
    run = lambda x: np.abs(np.fft.fft(x.astype(float), axis=1)[:, :bins]) ** 2 if x.shape[1] else x
    return df.withColumn("v", vectors(run, "array<double>", "v"))


def autocorrelation(df: DataFrame, lags: int) -> DataFrame:
    return _set(df, f"IF(size(v) < 1, v, transform(sequence(0, {int(lags) - 1}), k -> aggregate(sequence(0, greatest(size(v) - 1, 0)), 0D, (a, i) -> a + IF(i + k < size(v), v[i] * v[least(i + k, size(v) - 1)], 0D))))")


def correlations(x: np.ndarray, lags: int) -> np.ndarray:
    """Autocorrelation of each row at lags 0 to lags - 1."""
    n = x.shape[1]
    return np.stack([(x[:, : n - k] * x[:, k:]).sum(1) if k < n else np.zeros(len(x)) for k in range(lags)], 1)


def levinson(r: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Prediction polynomials (first coefficient 1) and residual powers of many autocorrelations at once, by Levinson and Durbin."""
    a = np.zeros((len(r), order + 1))
    a[:, 0] = 1
    e = r[:, 0].astype(float).copy()
    for m in range(1, order + 1):
        k = np.where(e > 0, -(a[:, :m] * r[:, m:0:-1]).sum(1) / np.where(e > 0, e, 1), 0.0)
        a[:, : m + 1] += k[:, None] * a[:, m::-1]
        e *= 1 - k * k
    return a, e


def lpc(df: DataFrame, order: int) -> DataFrame:
    """Linear prediction by the Levinson-Durbin recursion on the frame's autocorrelation: coefficients in `v`, residual power in `error`."""

    def run(x: np.ndarray) -> dict:
        a, e = levinson(correlations(x.astype(float), order + 1), order)
        return {"a": a, "e": e}

    out = df.withColumn("__a", vectors(run, "a array<double>, e double", "v"))
    return out.withColumn("v", F.col("__a.a")).withColumn("error", F.col("__a.e")).drop("__a")


SPECTRAL = {
    # name: value over an array of powers p of bins 0..n-1
    "centroid": "aggregate(v, cast((0, 0) as struct<s:double,i:double>), (a, x) -> named_struct('s', a.s + a.i * x, 'i', a.i + 1), a -> a.s) / nullif(total, 0)",
    "bandwidth": "sqrt(aggregate(v, cast((0, 0) as struct<s:double,i:double>), (a, x) -> named_struct('s', a.s + (a.i - centroid) * (a.i - centroid) * x, 'i', a.i + 1), a -> a.s) / nullif(total, 0))",
    "rolloff": "cast(aggregate(v, cast((0, 0) as struct<s:double,i:double>), (a, x) -> named_struct('s', a.s + x, 'i', a.i + IF(a.s + x < 0.85D * total, 1, 0)), a -> a.i) as int)",
    "flatness": "exp(aggregate(v, 0D, (a, x) -> a + ln(x)) / nullif(size(v), 0)) / nullif(total / nullif(size(v), 0), 0)",
}


def spectral_shape(df: DataFrame) -> DataFrame:
    """Total, centroid, bandwidth, 85 % roll-off bin and flatness of positive powers; of an empty frame or one of zeros, all but total and roll-off are null."""
    df = _set(df, "aggregate(v, 0D, (a, x) -> a + x)", "total")
    for name, sql in SPECTRAL.items():
        df = _set(df, sql, name)
    return df
