"""Filter banks, prototypes and block convolution.

Analysis turns a stream's samples into complex subbands and synthesis turns them back; both cut the stream into frames by a
join-free explode (temporal.frames) or walk it in order with a bounded buffer. Prototypes are models, made on the driver.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batch import scan, vectors

# prototypes


def low_pass_prototype(length: int, cutoff: float, hamming: bool = True) -> np.ndarray:
    """Windowed sinc with the cutoff as a share of the sampling rate."""
    t = np.arange(length) - (length - 1) / 2
    h = 2 * cutoff * np.sinc(2 * cutoff * t)
    return h * np.hamming(length) if hamming else h


def cosine_prototype(bands: int, overlap: int, rounds: int = 60) -> np.ndarray:
    """Symmetric prototype of 2 * bands * overlap taps for a cosine-modulated bank: a Kaiser-windowed sinc whose cutoff is moved by
    golden section until |H(f)|^2 + |H(1/(2 bands) - f)|^2 is flattest."""
    n = 2 * bands * overlap
    window = np.kaiser(n, 9.0)

    def made(c: float) -> np.ndarray:
        h = low_pass_prototype(n, c, hamming=False) * window
        return h / np.sqrt((h**2).sum())

    def ripple(c: float) -> float:
        p = np.convolve(made(c), made(c)[::-1])[n - 1 :: 2 * bands]
        return float(np.abs(p[1:]).max()) if len(p) > 1 else 0.0

    lo, hi = 0.5 / (4 * bands) * 0.8, 0.5 / (4 * bands) * 3
    g = (math.sqrt(5) - 1) / 2
    for _ in range(rounds):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if ripple(a) < ripple(b) else (a, hi)
    return made((lo + hi) / 2)


def analysis_prototype(bands: int, overlap: int, shift: int, passband: float = 1.0) -> np.ndarray:
    """Analysis prototype of an oversampled transform bank (de Haan, 2001): least mean square error of the passband response, taken to
    be a delay, plus energy that aliases into the band after decimation by `shift`."""
    n = bands * overlap
    edge, delay = passband * math.pi / bands, (n - 1) / 2
    k = np.arange(n)
    near = np.sinc((k[:, None] - k) * edge / math.pi)
    target = np.sinc((k - delay) * edge / math.pi)
    alias = near * np.where((k[:, None] - k) % shift == 0, shift - 1.0, -1.0)
    values, axes = np.linalg.eigh(near + alias + 1e-9 * np.eye(n))
    keep = values > 1e-8 * values.max()
    return axes[:, keep] @ ((axes[:, keep].T @ target) / values[keep])


def nyquist_prototype(bands: int, overlap: int, cutoff: float | None = None) -> np.ndarray:
    """Nyquist(bands) prototype: zeros at all multiples of `bands` taps from the centre but the centre itself, with the least
    energy beyond the cutoff (a share of the sampling rate; one band by default)."""
    n = bands * overlap + 1
    c = n // 2
    k = np.arange(n)
    cutoff = cutoff or 1.0 / bands
    stop = np.eye(n) - 2 * cutoff * np.sinc(2 * cutoff * (k[:, None] - k))
    free = [i for i in k if i == c or (i - c) % bands]
    a = stop[np.ix_(free, free)] + 1e-9 * np.eye(len(free))
    centre = np.zeros(len(free))
    centre[free.index(c)] = 1
    x = np.linalg.solve(a, centre)
    h = np.zeros(n)
    h[free] = x / (x @ centre)
    return h


def synthesis_prototype(analysis: np.ndarray, bands: int, shift: int) -> np.ndarray:
    """The dual of an analysis prototype: for each phase of `shift`, the synthesis taps of least energy with which the bank gives back its
    input delayed by the analysis length less one (least squares)."""
    n = len(analysis)
    g = np.zeros(n)
    for phase in range(shift):
        at = np.arange(phase, n, shift)
        # output at delay n - 1 + lag * bands, for all lags at which both prototypes meet, must be 1 for lag 0 and 0 else
        lags = range(-(n - 1) // bands, (n - 1) // bands + 1)
        rows = []
        for lag in lags:
            j = n - 1 - at + lag * bands
            rows.append(np.where((j >= 0) & (j < n), analysis[np.clip(j, 0, n - 1)], 0.0))
        goal = np.array([float(lag == 0) for lag in lags]) / bands
        g[at] = np.linalg.lstsq(np.array(rows), goal, rcond=None)[0]
    return g


# short-time transforms


def window(length: int, kind: str = "hamming") -> np.ndarray:
    k = 2 * np.pi * np.arange(length) / max(length - 1, 1)
    return {"none": np.ones(length), "hamming": 0.54 - 0.46 * np.cos(k), "hann": 0.5 - 0.5 * np.cos(k)}[kind]


def short_time_transform(frames: DataFrame, length: int, kind: str = "hamming") -> DataFrame:
    """Window and whole Fourier transform of frames `v`, as vectors re and im."""
    w = window(length, kind)

    def run(x: np.ndarray) -> dict:
        z = np.fft.fft(x * w[: x.shape[1]], length, axis=1)
        return {"re": z.real, "im": z.imag}

    out = frames.withColumn("__z", vectors(run, "re array<double>, im array<double>", "v"))
    return out.withColumn("re", F.col("__z.re")).withColumn("im", F.col("__z.im")).drop("__z", "v")


class _Analysis:
    """Polyphase analysis: the last len(h) samples times the prototype, folded to `bands`, transformed, every `shift` samples."""

    def __init__(self, h: np.ndarray, bands: int, shift: int):
        self.h, self.bands, self.shift = h, bands, shift
        self.buffer, self.due, self.frame = np.zeros(len(h)), 0, 0

    def step(self, rows: dict) -> dict:
        x = np.concatenate([self.buffer, rows["x"]])
        ends = np.arange(len(self.h) + self.due, len(x), self.shift) + 1
        seen = x[ends[:, None] - 1 - np.arange(len(self.h))] if len(ends) else np.zeros((0, len(self.h)))
        folded = (seen * self.h).reshape(len(ends), len(self.h) // self.bands, self.bands).sum(1)
        # the newest sample of a frame has the phase of its place in the stream
        z = np.fft.ifft(folded, axis=1) * self.bands
        z = z * np.exp(-2j * np.pi * np.outer((self.frame + np.arange(len(ends))) * self.shift % self.bands, np.arange(self.bands)) / self.bands)
        self.due = int(ends[-1] - 1 + self.shift - len(x)) if len(ends) else self.due - len(rows["x"])
        self.buffer = x[len(x) - len(self.h) :]
        first, self.frame = self.frame, self.frame + len(ends)
        return {"frame": first + np.arange(len(ends)), "re": z.real, "im": z.imag}


class _Synthesis:
    """Transforms back, spreads each frame over the prototype's length and adds up where frames overlap."""

    def __init__(self, g: np.ndarray, bands: int, shift: int):
        self.g, self.bands, self.shift = g, bands, shift
        self.buffer, self.frame, self.n = np.zeros(len(g)), 0, 0

    def step(self, rows: dict) -> dict:
        z = rows["re"] + 1j * rows["im"]
        at = (self.frame + np.arange(len(z))) * self.shift % self.bands
        z = z * np.exp(2j * np.pi * np.outer(at, np.arange(self.bands)) / self.bands)
        y = np.fft.ifft(z * np.exp(2j * np.pi * np.arange(self.bands) / self.bands), axis=1).real * self.bands
        y = np.tile(y, (1, len(self.g) // self.bands)) * self.g
        out = np.zeros(len(z) * self.shift + len(self.g))
        out[: len(self.g)] = self.buffer
        for k, part in enumerate(y):
            out[k * self.shift : k * self.shift + len(self.g)] += part
        cut = len(z) * self.shift
        self.buffer = out[cut:]
        self.frame += len(z)
        first, self.n = self.n, self.n + cut
        return {"n": first + np.arange(cut), "x": out[:cut]}


def analysis(samples: DataFrame, key: str, prototype: np.ndarray, bands: int, shift: int) -> DataFrame:
    """Oversampled transform bank: samples (key, n, x) -> (key, frame, re, im) with `bands` subbands every `shift` samples. The prototype's
    length is a multiple of bands; before the start there are zeros."""
    h = np.asarray(prototype, float)
    if len(h) % bands:
        raise ValueError("the prototype's length must be a multiple of the number of bands")
    return scan(samples.select(key, "n", "x"), [key], ["n"], lambda: _Analysis(h, bands, shift), "frame long, re array<double>, im array<double>")


def synthesis(subbands: DataFrame, key: str, prototype: np.ndarray, bands: int, shift: int) -> DataFrame:
    """Back to samples: (key, n, x), as many as frames times shift. With analysis and its dual prototype the output is the input, delayed
    by the prototype's length less one."""
    g = np.asarray(prototype, float)
    return scan(subbands.select(key, "frame", "re", "im"), [key], ["frame"], lambda: _Synthesis(g, bands, shift), "n long, x double")


def cosine_analysis_matrix(prototype: np.ndarray, bands: int) -> np.ndarray:
    """Impulse responses (band x tap) of a cosine-modulated bank."""
    n = len(prototype)
    k, t = np.arange(bands)[:, None], np.arange(n)[None]
    return 2 * prototype * np.cos(np.pi / bands * (k + 0.5) * (t - (n - 1) / 2) + np.where(k % 2, -1, 1) * np.pi / 4)


class _CosineAnalysis:
    def __init__(self, matrix: np.ndarray):
        self.m, self.shift = matrix, len(matrix)
        self.buffer, self.due, self.frame = np.zeros(matrix.shape[1]), 0, 0

    def step(self, rows: dict) -> dict:
        taps = self.m.shape[1]
        x = np.concatenate([self.buffer, rows["x"]])
        ends = np.arange(taps + self.due, len(x), self.shift) + 1
        seen = x[ends[:, None] - 1 - np.arange(taps)] if len(ends) else np.zeros((0, taps))
        self.due = int(ends[-1] - 1 + self.shift - len(x)) if len(ends) else self.due - len(rows["x"])
        self.buffer = x[len(x) - taps :]
        first, self.frame = self.frame, self.frame + len(ends)
        return {"frame": first + np.arange(len(ends)), "v": seen @ self.m.T}


class _CosineSynthesis:
    def __init__(self, matrix: np.ndarray):
        self.m, self.shift = matrix[:, ::-1], len(matrix)
        self.buffer, self.n = np.zeros(matrix.shape[1]), 0

    def step(self, rows: dict) -> dict:
        y = rows["v"] @ self.m
        taps, cut = self.m.shape[1], len(y) * self.shift
        out = np.zeros(cut + taps)
        out[:taps] = self.buffer
        for k, part in enumerate(y):
            out[k * self.shift : k * self.shift + taps] += part
        self.buffer = out[cut:]
        first, self.n = self.n, self.n + cut
        return {"n": first + np.arange(cut), "x": out[:cut]}


def cosine_analysis(samples: DataFrame, key: str, prototype: np.ndarray, bands: int) -> DataFrame:
    """Critically sampled cosine-modulated bank: (key, frame, v) with one value per band every `bands` samples."""
    m = cosine_analysis_matrix(np.asarray(prototype, float), bands)
    return scan(samples.select(key, "n", "x"), [key], ["n"], lambda: _CosineAnalysis(m), "frame long, v array<double>")


def cosine_synthesis(subbands: DataFrame, key: str, prototype: np.ndarray, bands: int) -> DataFrame:
    """Back to samples, delayed by the prototype's length less one; near-perfect reconstruction by the prototype's flatness."""
    m = cosine_analysis_matrix(np.asarray(prototype, float), bands)
    return scan(subbands.select(key, "frame", "v"), [key], ["frame"], lambda: _CosineSynthesis(m), "n long, x double")


# block convolution


class _Convolution:
    """Overlap-add or overlap-save with transforms of the block's and the response's length."""

    def __init__(self, h: np.ndarray, save: bool):
        self.h, self.save = h, save
        self.tail = np.zeros(len(h) - 1)

    def step(self, rows: dict) -> dict:
        out = []
        for x in rows["v"]:
            if self.save:
                whole = np.concatenate([self.tail, x])
                n = len(whole)
                y = np.fft.irfft(np.fft.rfft(whole, 2 * n) * np.fft.rfft(self.h, 2 * n), 2 * n)[len(self.h) - 1 : n]
                self.tail = whole[len(whole) - len(self.h) + 1 :] if len(self.h) > 1 else self.tail
            else:
                n = len(x) + len(self.h) - 1
                y = np.fft.irfft(np.fft.rfft(x, n) * np.fft.rfft(self.h, n), n)
                y[: len(self.tail)] += self.tail
                self.tail = y[len(x) :]
                y = y[: len(x)]
            out.append(y)
        return {"v": np.array(out)}


def convolve(blocks: DataFrame, key: str, response: np.ndarray, save: bool = False) -> DataFrame:
    """A stream of blocks `v` through an impulse response, by overlap-add or (save) overlap-save: (key, n, v). Blocks are at least as long as the response less one."""
    h = np.asarray(response, float)
    return scan(blocks.select(key, "n", "v"), [key], ["n"], lambda: _Convolution(h, save), "v array<double>", keep=["n"])


def resample(samples: DataFrame, key: str, source: int, target: int, taps: int = 16, kind: str = "sinc") -> DataFrame:
    """Another sampling rate: each new sample is a window of old ones times a windowed sinc (or linear weights, or the nearest one before),
    joined by place, so a stream needs no order in one task. (key, n, x)."""
    ratio, cut = target / source, min(1.0, target / source)
    half = {"sinc": taps, "linear": 1, "hold": 1}[kind]
    reach = half / cut if kind == "sinc" else 1
    first = F.ceil((F.col("n") - reach) * ratio)
    last = F.floor((F.col("n") + reach) * ratio)
    end = F.floor((F.max("n") + 1) * ratio)
    each = samples.select(key, "n", "x", F.explode(F.sequence(F.greatest(first, F.lit(0)), F.greatest(last, F.lit(0)))).alias("m"))
    t = F.col("m") / ratio - F.col("n")
    if kind == "sinc":
        u = t * cut
        sinc = F.when(F.abs(u) < 1e-12, 1.0).otherwise(F.sin(u * math.pi) / (u * math.pi))
        weight = cut * sinc * (0.5 + 0.5 * F.cos(u * math.pi / half))
    elif kind == "linear":
        weight = F.greatest(F.lit(0.0), 1 - F.abs(t))
    else:
        weight = F.when((t >= 0) & (t < 1), 1.0).otherwise(0.0)
    whole = samples.groupBy(F.col(key).alias("__k")).agg(end.alias("__end"))
    out = each.groupBy(key, "m").agg(F.sum(F.col("x") * weight).alias("x"))
    return out.join(whole, F.col(key).eqNullSafe(F.col("__k"))).where(F.col("m") < F.col("__end")).select(key, F.col("m").cast("long").alias("n"), "x")
