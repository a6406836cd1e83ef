"""Spectral envelopes and pitch: linear prediction, Burg's method, warped and minimum-variance spectra, cepstral smoothing.

All are numpy over batches of equally long frames; frames without energy give a flat envelope of zeros unless told otherwise.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batch import vectors
from .frames import correlations, levinson

#: What an envelope is where the minimum-variance power vanishes.
GUARD = 1e7


def warped_correlations(x: np.ndarray, order: int, warp: float) -> np.ndarray:
    """Correlations of each frame with itself after 0 to `order` all-pass steps: autocorrelation on a warped frequency axis."""
    now, out = x.astype(float), [(x**2).sum(1)]
    for _ in range(order):
        new = np.empty_like(now)
        new[:, 0] = -warp * now[:, 0]
        for j in range(1, x.shape[1]):
            new[:, j] = now[:, j - 1] + warp * (new[:, j - 1] - now[:, j])
        now = new
        out.append((x * now).sum(1))
    return np.stack(out, 1)


def burg(x: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Prediction polynomials and residual powers by Burg's lattice, for many frames at once."""
    f, b = x[:, 1:].astype(float), x[:, :-1].astype(float)
    a, e = np.zeros((len(x), order + 1)), (x**2).mean(1)
    a[:, 0] = 1
    for m in range(1, order + 1):
        under = (f**2 + b**2).sum(1)
        k = np.where(under > 0, -2 * (f * b).sum(1) / np.where(under > 0, under, 1), 0.0)
        a[:, : m + 1] += k[:, None] * a[:, m::-1]
        e = e * (1 - k * k)
        f, b = (f + k[:, None] * b)[:, 1:], (b + k[:, None] * f)[:, :-1]
    return a, e


def predictors(x: np.ndarray, order: int, method: str = "warp", warp: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Polynomials, residual powers and powers of frames by autocorrelation (plain or warped) or Burg's method."""
    if method == "burg":
        a, e = burg(x, order)
        return a, e, (x**2).mean(1)
    r = warped_correlations(x, order, warp) if warp else correlations(x, order + 1)
    a, e = levinson(r, order)
    return a, e, r[:, 0]


def lpc_envelope(df: DataFrame, order: int, length: int, method: str = "warp", warp: float = 0.0) -> DataFrame:
    """Power envelope residual / |A(f)|^2 on length // 2 + 1 bins, as `v`."""

    def run(x: np.ndarray) -> np.ndarray:
        a, e, _ = predictors(x.astype(float), order, method, warp)
        p = np.abs(np.fft.rfft(a, length, axis=1)) ** 2
        return e[:, None] / np.maximum(p, 1e-300)

    return df.withColumn("v", vectors(run, "array<double>", "v"))


def musicus(a: np.ndarray) -> np.ndarray:
    """Coefficients mu_k, k = 0..order, of the minimum-variance spectrum: -sum_i (order + 1 - k - 2 i) a_i a_(i+k) (Musicus, 1985)."""
    order = a.shape[1] - 1
    out = np.zeros_like(a)
    for k in range(order + 1):
        i = np.arange(order + 1 - k)
        out[:, k] = -((order + 1 - k - 2 * i) * a[:, i] * a[:, i + k]).sum(1)
    return out


def mvdr_envelope(df: DataFrame, order: int = 60, method: str = "warp", warp: float = 0.0) -> DataFrame:
    """Minimum-variance envelope of each frame on half its length + 1 bins: the frame's power over the root of the transform of mu.

    The transform of the symmetric sequence mu is real; its square's root is its magnitude. Where it vanishes, the envelope is 1e7."""

    def run(x: np.ndarray) -> np.ndarray:
        x = x.astype(float)
        a, _, power = predictors(x, order, method, warp)
        return minimum_variance(a, power, x.shape[1])

    return df.withColumn("v", vectors(run, "array<double>", "v"))


def minimum_variance(a: np.ndarray, power: np.ndarray, length: int) -> np.ndarray:
    mu = musicus(a)
    if 2 * mu.shape[1] - 1 > length:
        raise ValueError("the order must be below half the frame's length")
    both = np.zeros((len(mu), length))
    both[:, : mu.shape[1]] = mu
    both[:, length - mu.shape[1] + 1 :] += mu[:, :0:-1]
    p = np.sqrt(np.abs(np.fft.rfft(both, axis=1)))
    flat = (power[:, None] <= 0) | (p <= 0)
    return np.where(flat, GUARD, power[:, None] / np.where(p > 0, p, 1))


def twice_warped_mvdr(df: DataFrame, order: int = 60, warp: float = 0.0, sensibility: float = 0.1, fixed: bool = False) -> DataFrame:
    """Minimum-variance envelope whose frequency axis is warped before the prediction by warp + sensibility * R1 / R0 of the frame (unless
    `fixed`) and back after it, so that the resolution moves but the axis stays (Wölfel, 2006)."""

    def run(x: np.ndarray) -> np.ndarray:
        x = x.astype(float)
        r = correlations(x, 2)
        moved = np.full(len(x), warp) if fixed else warp + sensibility * np.where(r[:, 0] > 0, r[:, 1] / np.where(r[:, 0] > 0, r[:, 0], 1), 0)
        out = np.empty((len(x), x.shape[1] // 2 + 1))
        axis = np.linspace(0, np.pi, out.shape[1])
        for k, w in enumerate(np.clip(moved, -0.95, 0.95)):
            a, _, power = predictors(x[k : k + 1], order, "warp", float(w))
            e = minimum_variance(a, power, x.shape[1])[0]
            to = axis + 2 * np.arctan2(w * np.sin(axis), 1 - w * np.cos(axis))
            out[k] = np.interp(to, axis, e)
        return out

    return df.withColumn("v", vectors(run, "array<double>", "v"))


def cepstral_envelope(df: DataFrame, order: int = 14, length: int = 256, padding: float = 1.0) -> DataFrame:
    """exp of the log power spectrum (plus padding) smoothed to `order` cepstral lags: rows with vectors re and im of the whole spectrum."""

    def run(re: np.ndarray, im: np.ndarray) -> np.ndarray:
        c = np.fft.ifft(np.log(re**2 + im**2 + padding), axis=1)
        c[:, order + 1 : c.shape[1] - order] = 0
        return np.exp(np.fft.fft(c, axis=1).real)[:, : length // 2 + 1]

    return df.withColumn("v", vectors(run, "array<double>", "re", "im"))


def smooth_spectrum(df: DataFrame, envelope: str, adjust: str) -> DataFrame:
    """Scales an envelope so that its sum is that of the spectrum in column `adjust`; without energy it stays."""

    def run(e: np.ndarray, s: np.ndarray) -> np.ndarray:
        total = e.sum(1, keepdims=True)
        return np.where(total > 0, e * s.sum(1, keepdims=True) / np.where(total > 0, total, 1), e)

    return df.withColumn("v", vectors(run, "array<double>", envelope, adjust))


def pitch(df: DataFrame, rate: float, tolerance: float = 0.5) -> DataFrame:
    """YIN: rate over the first lag after which the cumulative-mean difference rises again while under the tolerance; 0 if there is none."""

    def run(x: np.ndarray) -> np.ndarray:
        x = x.astype(float)
        half = x.shape[1] // 2
        if half < 2:
            return np.zeros(len(x))
        d = np.stack([((x[:, :half] - x[:, t : t + half]) ** 2).sum(1) for t in range(half)], 1)
        total = np.cumsum(d[:, 1:], 1)
        c = np.ones_like(d)
        c[:, 1:] = np.where(total > 0, d[:, 1:] * np.arange(1, half) / np.where(total > 0, total, 1), 0.0)
        dip = (c[:, 1:] < tolerance) & (c[:, :-1] < c[:, 1:])
        lag = dip.argmax(1)
        return np.where(dip.any(1) & (lag > 0), rate / np.maximum(lag, 1), 0.0)

    return df.withColumn("pitch", vectors(run, "double", "v"))


def remove_spikes(df: DataFrame, key: str, width: int = 5, least: float = 7000.0, start: float = 100.0, factor: float = 15.0, alpha: float = 0.2) -> DataFrame:
    """Takes out spikes: a step of more than `least` and more than factor times the recursive mean step starts one, which ends at the next
    such step the other way or after `width` samples; what lies between is a straight line. The mean step goes on from frame to frame."""
    from .batch import scan

    class State:
        mean = start

        def step(self, rows: dict) -> dict:
            return {"v": np.array([self.one(np.array(x, float)) for x in rows["v"]])}

        def one(self, x: np.ndarray) -> np.ndarray:
            k = 1
            while k < len(x):
                rise = x[k] - x[k - 1]
                limit = max(factor * self.mean, least)
                if abs(rise) <= limit:
                    self.mean = (1 - alpha) * self.mean + alpha * abs(rise)
                    k += 1
                    continue
                first, end = k - 1, k
                while end + 1 < len(x) and end - k < width:
                    end += 1
                    back = x[end] - x[end - 1]
                    if back * rise < 0 and abs(back) > limit:
                        break
                x[first : end + 1] = np.linspace(x[first], x[end], end - first + 1)
                k = end + 1
            return x

    return scan(df.select(key, "n", "v"), [key], ["n"], State, "v array<double>", keep=["n"])
