"""Time delays, directions of arrival and source tracking from spectra of microphone pairs and snapshot vectors.

A pair is a row with the half spectra of both channels as vectors (re_a, im_a, re_b, im_b). Grids of directions and delays are
parameters of the operator, so their size doesn't depend on the data: every row is scored against the grid by one
matrix product, and only the best candidates leave the task.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import complex_of
from .batch import scan, vectors
from .beamforming import SPEED, harmonics, manifold, mode_amplitudes, plane_wave_delays

PAIR = ("re_a", "im_a", "re_b", "im_b")


def channel_pairs(spectra: DataFrame, key: str = "frame") -> DataFrame:
    """All channel pairs a < b of each frame with their half spectra: a join on the frame; channels are few."""
    half = spectra.groupBy(key, "chan").agg(F.sort_array(F.collect_list(F.struct("bin", "re", "im"))).alias("z"))
    half = half.select(key, "chan", F.transform("z", lambda z: z["re"]).alias("re"), F.transform("z", lambda z: z["im"]).alias("im"))
    side = lambda s: half.select(key, F.col("chan").alias(s), F.col("re").alias(f"re_{s}"), F.col("im").alias(f"im_{s}"))
    return side("a").join(side("b"), key).where("a < b")


def _peaks(c: np.ndarray, lags: np.ndarray, peaks: int, apart: int) -> tuple[np.ndarray, np.ndarray]:
    """The highest `peaks` values of each row and their lags, at least `apart` lags from one another; with a parabola through the top."""
    delay, value = np.zeros((len(c), peaks)), np.zeros((len(c), peaks))
    left = c.copy()
    rows = np.arange(len(c))
    for k in range(peaks):
        at = left.argmax(1)
        top = left[rows, at]
        inside = (at > 0) & (at < c.shape[1] - 1)
        lo, hi = c[rows, np.maximum(at - 1, 0)], c[rows, np.minimum(at + 1, c.shape[1] - 1)]
        bend = lo - 2 * c[rows, at] + hi
        move = np.where(inside & (np.abs(bend) > 1e-15), (lo - hi) / (2 * np.where(np.abs(bend) > 1e-15, bend, 1)), 0.0)
        delay[:, k], value[:, k] = lags[at] + np.clip(move, -0.5, 0.5), top
        for shift in range(-apart, apart + 1):
            left[rows, np.clip(at + shift, 0, c.shape[1] - 1)] = -np.inf
    return delay, value


def cross_correlate(spectrum: np.ndarray, rate: float, longest: float | None, peaks: int = 1, apart: int = 1) -> dict:
    """Delays (seconds) and heights of the peaks of cross-correlations, given as half spectra."""
    n = 2 * (spectrum.shape[1] - 1)
    c = np.fft.fftshift(np.fft.irfft(spectrum, n, axis=1), axes=1)
    lags = np.arange(n) - n // 2
    if longest is not None:
        use = np.abs(lags) <= max(longest * rate, 1)
        c, lags = c[:, use], lags[use]
    delay, value = _peaks(c, lags, peaks, apart)
    return {"delay": delay / rate, "value": value}


def gcc(pairs: DataFrame, rate: float, weighting: str = "phat", longest: float | None = None, peaks: int = 1, band: tuple[int, int] | None = None, noise: DataFrame | None = None, q: float = 0.3) -> DataFrame:
    """Generalised cross-correlation of each pair: `delay` of a behind b in seconds and `value`, as vectors of `peaks` values, highest first.

    Weightings: raw; phat divides by the magnitude; ml weighs by both channels' powers and their noise powers. `noise` has,
    per pair (a, b), vectors of noise powers n_a, n_b and of the noise cross spectrum nre, nim, which is subtracted first. `band` limits bins.
    Pairs without any energy have delay 0 at value 0.
    """
    extra = []
    if noise is not None:
        pairs = pairs.join(F.broadcast(noise), ["a", "b"], "left")
        extra = ["n_a", "n_b", "nre", "nim"]
    elif weighting == "ml":
        raise ValueError("the maximum-likelihood weighting needs noise powers")

    def run(re_a, im_a, re_b, im_b, *more) -> dict:
        a, b = re_a + 1j * im_a, re_b + 1j * im_b
        x = a * b.conj()
        if more:
            x = x - (more[2] + 1j * more[3])
        size = np.abs(x)
        if weighting == "phat":
            w = np.where(size > 0, 1 / np.where(size > 0, size, 1), 0)
        elif weighting == "ml":
            pa, pb = np.abs(a) ** 2, np.abs(b) ** 2
            under = q * pa * pb + (1 - q) * (more[1] * pa + more[0] * pb)
            w = np.where(under > 0, np.sqrt(pa * pb) / np.where(under > 0, under, 1), 0)
        else:
            w = np.ones_like(size)
        x = x * w
        if band:
            x[:, : band[0]] = 0
            x[:, band[1] + 1 :] = 0
        return cross_correlate(x, rate, longest, peaks)

    out = pairs.withColumn("__g", vectors(run, "delay array<double>, value array<double>", *PAIR, *extra))
    return out.withColumn("delay", F.col("__g.delay")).withColumn("value", F.col("__g.value")).drop("__g", *extra)


class _Smooth:
    def __init__(self, alpha: float):
        self.alpha, self.state = alpha, None

    def step(self, rows: dict) -> dict:
        out = []
        for x in np.concatenate([rows[c] for c in PAIR], 1):
            k = len(x) // 4
            a, b = x[:k] + 1j * x[k : 2 * k], x[2 * k : 3 * k] + 1j * x[3 * k :]
            z = a * b.conj()
            new = np.concatenate([np.abs(a) ** 2, np.abs(b) ** 2, z.real, z.imag])
            self.state = (1 - self.alpha) * new if self.state is None else self.alpha * self.state + (1 - self.alpha) * new
            out.append(self.state)
        out = np.array(out)
        k = out.shape[1] // 4
        return {"n_a": out[:, :k], "n_b": out[:, k : 2 * k], "nre": out[:, 2 * k : 3 * k], "nim": out[:, 3 * k :]}


def noise_spectra(pairs: DataFrame, key: str = "frame", alpha: float = 0.95) -> DataFrame:
    """Recursive noise powers and cross spectra of each pair over noise frames: (a, b, key, n_a, n_b, nre, nim); the first value is
    weighed by 1 - alpha."""
    kind = ", ".join(f"{c} array<double>" for c in ("n_a", "n_b", "nre", "nim"))
    return scan(pairs.select("a", "b", key, *PAIR), ["a", "b"], [key], lambda: _Smooth(alpha), kind, keep=[key])


def last_noise(noise: DataFrame, key: str = "frame") -> DataFrame:
    """The last row of each pair of noise_spectra: a table of pairs, for gcc."""
    names = ("n_a", "n_b", "nre", "nim")
    return noise.groupBy("a", "b").agg(F.max_by(F.struct(*names), key).alias("z")).select("a", "b", *(F.col(f"z.{c}").alias(c) for c in names))


def direction_grid(polar: np.ndarray, azimuth: np.ndarray) -> np.ndarray:
    """All (polar, azimuth) pairs of two axes."""
    return np.array([(p, a) for p in polar for a in azimuth])


def linear_grid(steps: int = 181) -> np.ndarray:
    return direction_grid(np.array([math.pi / 2]), np.linspace(0, math.pi, steps))


def circular_grid(steps: int = 360) -> np.ndarray:
    return direction_grid(np.array([math.pi / 2]), np.arange(steps) * 2 * math.pi / steps)


def steered_power(frames: DataFrame, manifolds: np.ndarray, best: int = 1, key: str = "frame", least: float = 0.0) -> DataFrame:
    """Steered response power over a grid: (key, rank, place, power) of the `best` places, frames with less energy than `least` left out.

    `frames` has snapshot vectors per key and bin; manifolds is (place x bin x channel). Powers are summed over bins by a
    vector sum per frame, from one matrix product per batch of rows.
    """
    sent = frames.sparkSession.sparkContext.broadcast(manifolds.conj() / manifolds.shape[2])

    def run(b: np.ndarray, re: np.ndarray, im: np.ndarray) -> np.ndarray:
        x = re + 1j * im
        return np.abs(np.einsum("pnc,nc->np", sent.value[:, b.astype(int)], x)) ** 2

    energy = F.aggregate(F.zip_with("re", "im", lambda r, i: r * r + i * i), F.lit(0.0), lambda s, x: s + x)
    each = frames.where(F.col("bin") < manifolds.shape[1]).withColumn("__p", vectors(run, "array<double>", "bin", "re", "im"))
    whole = each.select(key, energy.alias("e"), F.posexplode("__p").alias("place", "p")).groupBy(key, "place").agg(F.sum("p").alias("power"), F.sum("e").alias("e"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("power"), "place"))
    return whole.where(F.col("e") >= least).withColumn("rank", rank).where(F.col("rank") <= best).select(key, "rank", "place", "power")


def plane_manifolds(positions: np.ndarray, grid: np.ndarray, bins: int, rate: float, length: int, speed: float = SPEED) -> np.ndarray:
    return np.stack([manifold(plane_wave_delays(positions, a, p, speed), bins, rate, length) for p, a in grid])


def spherical_manifolds(mics: np.ndarray, grid: np.ndarray, bins: int, rate: float, length: int, radius: float, order: int = 4, speed: float = SPEED) -> np.ndarray:
    """Pressures on a rigid sphere for each place of the grid, by modes up to `order`."""
    y_mic, y = harmonics(order, mics[:, 0], mics[:, 1]), harmonics(order, grid[:, 0], grid[:, 1])
    mode = np.repeat(np.arange(order + 1), 2 * np.arange(order + 1) + 1)
    out = []
    for b in range(bins):
        m = (4 * math.pi * mode_amplitudes(order, max(2 * math.pi * b * rate / length * radius / speed, 1e-3)))[mode]
        out.append((y.conj() * m) @ y_mic.T)
    return np.stack(out, 1)


def multichannel_correlation(frames: DataFrame, delays: np.ndarray, best: int = 1, normalise: bool = True) -> DataFrame:
    """Multichannel correlation coefficient of frames (frame, x: channels' samples one after the other, chans) over a grid of sample
    delays (place x channel): 1 - det(R), R being the channels' correlations after the delays are taken out; best places first."""
    sent = frames.sparkSession.sparkContext.broadcast(np.asarray(delays, int))

    def run(x: np.ndarray, chans: np.ndarray) -> dict:
        c = int(chans[0])
        x = x.reshape(len(x), c, -1)
        d = sent.value - sent.value.min(1, keepdims=True)
        n = x.shape[2] - d.max()
        scores = np.zeros((len(x), len(d)))
        for p, shift in enumerate(d):
            y = np.stack([x[:, k, s : s + n] for k, s in enumerate(shift)], 1)
            r = y @ y.transpose(0, 2, 1) / n
            power = np.sqrt(np.maximum(np.diagonal(r, axis1=1, axis2=2), 1e-300))
            if normalise:
                r = r / (power[:, :, None] * power[:, None])
            scores[:, p] = 1 - np.linalg.det(r)
        order = np.argsort(-scores, axis=1, kind="stable")[:, :best]
        return {"place": order.astype(np.int32), "value": np.take_along_axis(scores, order, 1)}

    out = frames.withColumn("__m", vectors(run, "place array<int>, value array<double>", "x", "chans"))
    return out.withColumn("place", F.col("__m.place")).withColumn("value", F.col("__m.value")).drop("__m", "x")


class _Tracker:
    """Extended Kalman filter of a direction (polar, azimuth) on modal coefficients of several bins, iterated at each frame."""

    def __init__(self, model, move: float, noise: float, first: float, rounds: int, start: tuple[float, float]):
        self.model, self.move, self.noise, self.rounds = model, move, noise, rounds
        self.at, self.p = np.array(start, float), first * np.eye(2)

    def step(self, rows: dict) -> dict:
        out = []
        for re, im in zip(rows["re"], rows["im"], strict=True):
            z = np.concatenate([re, im])
            p = self.p + self.move * np.eye(2)
            prior, at = self.at, self.at
            for _ in range(self.rounds):
                h = self.model(at)
                slope = np.stack([(self.model(at + e) - self.model(at - e)) / 2e-5 for e in 1e-5 * np.eye(2)], 1)
                scale = (h @ z) / max(h @ h, 1e-12)
                h, slope = scale * h, scale * slope
                gain = p @ slope.T @ np.linalg.inv(slope @ p @ slope.T + self.noise * np.eye(len(z)))
                at = prior + gain @ (z - h - slope @ (prior - at))
            self.at, self.p = at, (np.eye(2) - gain @ slope) @ p
            out.append(self.at)
        out = np.array(out)
        return {"polar": out[:, 0], "azimuth": out[:, 1]}


def track_direction(observed: DataFrame, observation, key: str = "stream", order: str = "frame", move: float = 1e-3, noise: float = 1e-2, first: float = 1.0, rounds: int = 2, start: tuple[float, float] = (math.pi / 2, 0.0)) -> DataFrame:
    """Follows one source: observed has vectors re and im (all used bins of a frame), observation(direction) the real and imaginary
    parts that a unit source there gives. A stream's frames pass in order with the filter's state: (key, order, polar, azimuth)."""
    return scan(observed.select(key, order, "re", "im"), [key], [order], lambda: _Tracker(observation, move, noise, first, rounds, start), "polar double, azimuth double", keep=[order])


def modal_observation(order: int, kas: list[float]):
    """Observation model of modal coefficients: 4 pi b_n(ka) conj(Y_nm) for each ka."""
    mode = np.repeat(np.arange(order + 1), 2 * np.arange(order + 1) + 1)
    amplitudes = [(4 * math.pi * mode_amplitudes(order, ka))[mode] for ka in kas]

    def at(direction: np.ndarray) -> np.ndarray:
        y = harmonics(order, direction[:1], direction[1:])[0].conj()
        z = np.concatenate([a * y for a in amplitudes])
        return np.concatenate([z.real, z.imag])

    return at


def spatial_observation(mics: np.ndarray, order: int, kas: list[float]):
    """Observation model of the pressures at the microphones themselves."""
    modal, y = modal_observation(order, kas), harmonics(order, mics[:, 0], mics[:, 1])
    size = y.shape[1]

    def at(direction: np.ndarray) -> np.ndarray:
        z = modal(direction)
        z = z[: len(z) // 2] + 1j * z[len(z) // 2 :]
        p = np.concatenate([y @ z[k * size : (k + 1) * size] for k in range(len(kas))])
        return np.concatenate([p.real, p.imag])

    return at


def modal_coefficients(frames: DataFrame, mics: np.ndarray, order: int) -> DataFrame:
    """Snapshot vectors on a sphere turned into coefficients of spherical harmonics, by the least-squares inverse."""
    sent = frames.sparkSession.sparkContext.broadcast(np.linalg.pinv(harmonics(order, mics[:, 0], mics[:, 1])))

    def run(re: np.ndarray, im: np.ndarray) -> dict:
        z = complex_of({"re": re, "im": im}) @ sent.value.T
        return {"re": z.real, "im": z.imag}

    out = frames.withColumn("__z", vectors(run, "re array<double>, im array<double>", "re", "im"))
    return out.withColumn("re", F.col("__z.re")).withColumn("im", F.col("__z.im")).drop("__z")
