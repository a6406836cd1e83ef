"""Speech activity: measures of frames and channels, decisions along a stream, and gates with hang-over.

Measures of a frame are numpy over batches of frames; decisions that depend on what came before walk a stream in order with a
bounded state. Vectors are `v`; streams are (key, n). Frames without energy give the value named in each docstring.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batch import scan, sums, vectors

#: Mean of ln cosh of a standard normal variable.
LOG_COSH_NORMAL = 0.374576


def _add(df: DataFrame, name: str, run, kind: str = "double", *columns: str) -> DataFrame:
    return df.withColumn(name, vectors(run, kind, *(columns or ("v",))))


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x**2).sum(1, keepdims=True))
    return x / np.where(size > 0, size, 1)


def brightness(df: DataFrame, rate: float | None = None) -> DataFrame:
    """Running centroid: at each bin that of the spectrum up to it, in hertz if a rate is given, else as a share of the bins; 0 without energy."""

    def run(x: np.ndarray) -> np.ndarray:
        n = x.shape[1]
        f = (np.arange(n) + 1) * (rate / 2 / n) if rate else np.arange(n) / max(n, 1)
        d = np.cumsum(x, 1)
        return np.where(d != 0, np.cumsum(x * f, 1) / np.where(d != 0, d, 1), 0.0)

    return _add(df, "brightness", run, "array<double>")


def energy_diffusion(df: DataFrame) -> DataFrame:
    """-sum p log10 p over the positive values of the frame scaled to length one; 0 without energy."""

    def run(x: np.ndarray) -> np.ndarray:
        p = _unit(x.astype(float))
        return -(np.where(p > 0, p * np.log10(np.where(p > 0, p, 1)), 0)).sum(1)

    return _add(df, "diffusion", run)


def band_energy_ratio(df: DataFrame, rate: float, edge: float | None = None) -> DataFrame:
    """Root of the energy under `edge` hertz (a quarter of the rate) over that above; null if there is none above."""

    def run(x: np.ndarray) -> np.ndarray:
        at = int((edge or rate / 4) / (rate / 2 / x.shape[1])) if x.shape[1] else 0
        lo, hi = (x[:, :at] ** 2).sum(1), (x[:, at:] ** 2).sum(1)
        return np.where(hi > 0, np.sqrt(lo / np.where(hi > 0, hi, 1)), np.nan)

    return _add(df, "ratio", run).withColumn("ratio", F.nanvl("ratio", F.lit(None).cast("double")))


def flux(df: DataFrame, key: str) -> DataFrame:
    """Distance of each frame, scaled to length one, from the stream's first frame, which is what the reference results hold it against;
    `step` is the distance from the frame before."""

    class State:
        first = last = None

        def step(self, rows: dict) -> dict:
            x = _unit(rows["v"].astype(float))
            if self.first is None:
                self.first = self.last = x[0]
            before = np.vstack([self.last, x[:-1]])
            self.last = x[-1]
            return {"flux": np.sqrt(((x - self.first) ** 2).sum(1)), "step": np.sqrt(((x - before) ** 2).sum(1))}

    return scan(df.select(key, "n", "v"), [key], ["n"], State, "flux double, step double", keep=["n"])


def negative_entropy(df: DataFrame) -> DataFrame:
    """100 (mean ln cosh z - that of a normal variable)^2 of the rectified frame, brought to mean zero and deviation one (the squares'
    sum over n - 1, less the squared mean); null if it doesn't vary or has fewer than two values."""

    def run(x: np.ndarray) -> np.ndarray:
        n = x.shape[1]
        if n < 2:
            return np.full(len(x), np.nan)
        a = np.abs(x.astype(float))
        mean = a.mean(1, keepdims=True)
        var = (a**2).sum(1, keepdims=True) / (n - 1) - mean**2
        z = (a - mean) / np.sqrt(np.where(var > 0, var, np.nan))
        return 100 * ((np.logaddexp(z, -z) - math.log(2)).mean(1) - LOG_COSH_NORMAL) ** 2

    return _add(df, "negentropy", run).withColumn("negentropy", F.nanvl("negentropy", F.lit(None).cast("double")))


def significant_bands(df: DataFrame, limit: float = 0.0) -> DataFrame:
    """How many values of the frame scaled to length one are above the limit."""
    return _add(df, "bands", lambda x: (_unit(x.astype(float)) > limit).sum(1).astype(np.int64), "long")


def bandwidth(df: DataFrame, rate: float, limit: float = 0.0) -> DataFrame:
    """Distance in hertz of the highest and the lowest value above the limit, of the frame scaled to length one; 0 if there is none."""

    def run(x: np.ndarray) -> np.ndarray:
        over = _unit(x.astype(float)) > limit
        n = x.shape[1]
        if not n:
            return np.zeros(len(x))
        return np.where(over.any(1), (n - 1 - over[:, ::-1].argmax(1) - over.argmax(1)) * (rate / 2 / n), 0.0)

    return _add(df, "bandwidth", run)


def low_band_ratio(df: DataFrame, low_pass: np.ndarray) -> DataFrame:
    """h^T R h / r[0]: energy of the frame through a low-pass filter over its whole energy, by autocorrelations; 0 without energy."""
    h = np.asarray(low_pass, float)
    from .frames import correlations

    def run(x: np.ndarray) -> np.ndarray:
        r = correlations(x.astype(float), len(h))
        toeplitz = r[:, np.abs(np.arange(len(h))[:, None] - np.arange(len(h)))]
        return np.where(r[:, 0] > 0, np.einsum("i,nij,j->n", h, toeplitz, h) / np.where(r[:, 0] > 0, r[:, 0], 1), 0.0)

    return _add(df, "ratio", run)


def band(bins: int, length: int, rate: float, low: float = -1.0, high: float = -1.0) -> tuple[int, int]:
    """First and last bin of a band in hertz; a negative edge is an end of the spectrum."""
    return (int(low / rate * length) if low >= 0 else 0, min(int(high / rate * length + 0.5), bins - 1) if high >= 0 else bins - 1)


def channel_powers(df: DataFrame, key: str, lo: int, hi: int, length: int) -> DataFrame:
    """Share of each channel in the power of a band: rows (key, chan, v: half a power spectrum) -> (key, chan, power, share); bins
    other than 0 count twice. Shares are null where there is no power at all."""

    def run(x: np.ndarray) -> np.ndarray:
        w = np.where(np.arange(x.shape[1]) == 0, 1.0, 2.0)
        w[:lo] = w[hi + 1 :] = 0
        return x @ w / length

    from pyspark.sql import Window

    out = df.select(key, "chan", vectors(run, "double", "v").alias("power"))
    return out.withColumn("share", F.col("power") / F.nullif(F.sum("power").over(Window.partitionBy(key)), F.lit(0.0)))


def loudest_channel(powers: DataFrame, key: str, chan: int, factor: float = 1.0) -> DataFrame:
    """1 where the channel's share is more than factor over the number of channels, else -1, and the channel with most power."""
    each = powers.groupBy(key).agg(F.max(F.when(F.col("chan") == chan, F.col("share"))).alias("share"), F.count("*").alias("chans"), F.max_by("chan", F.struct("power", -F.col("chan"))).alias("loudest"))
    return each.select(key, F.when(F.col("share") > factor / F.col("chans"), 1.0).otherwise(-1.0).alias("speech"), "loudest")


def target_to_interference(powers: DataFrame, key: str, chan: int) -> DataFrame:
    """Power of a channel over the mean power of the others, in dB; null if either is zero or there is no other."""
    own, rest = F.sum(F.when(F.col("chan") == chan, F.col("power"))), F.avg(F.when(F.col("chan") != chan, F.col("power")))
    return powers.groupBy(key).agg(own.alias("own"), rest.alias("rest")).select(key, F.when((F.col("own") > 0) & (F.col("rest") > 0), 10 * F.log10(F.col("own") / F.col("rest"))).alias("ratio"))


def coherence_peak(pairs: DataFrame, lo: int, hi: int) -> DataFrame:
    """Highest normalised cross-correlation of two channels in a band, over all lags: rows with vectors re_a, im_a, re_b, im_b."""

    def run(ra, ia, rb, ib) -> np.ndarray:
        a, b = ra + 1j * ia, rb + 1j * ib
        a[:, :lo] = b[:, :lo] = a[:, hi + 1 :] = b[:, hi + 1 :] = 0
        n = 2 * (a.shape[1] - 1)
        power = np.sqrt((np.fft.irfft(a, n, axis=1) ** 2).sum(1) * (np.fft.irfft(b, n, axis=1) ** 2).sum(1))
        return np.where(power > 0, np.fft.irfft(a * b.conj(), n, axis=1).max(1) / np.where(power > 0, power, 1), 0.0)

    return pairs.withColumn("peak", vectors(run, "double", "re_a", "im_a", "re_b", "im_b"))


# generalised Gaussian densities of complex values


def shape_constants(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ln of the norm and the scale of |z|^(2p) for a circular density of variance one with shape p (p = 1 is the Gaussian)."""
    g1 = np.array([math.lgamma(1 / q) for q in np.atleast_1d(p)])
    g2 = np.array([math.lgamma(2 / q) for q in np.atleast_1d(p)])
    b = np.exp(g1 - g2)  # E|z|^2 = s gamma(2/p) / gamma(1/p)
    return np.log(np.atleast_1d(p)) - g1 - np.log(math.pi * b), b


def generalised_log_likelihood(power: np.ndarray, variance: np.ndarray, p: np.ndarray) -> np.ndarray:
    """ln density of complex values of the given power, variance and shape."""
    norm, b = shape_constants(p)
    v = np.maximum(variance, 1e-30)
    return norm - np.log(v) - (power / (v * b)) ** np.atleast_1d(p)


def negentropy_ratio(df: DataFrame, shapes: np.ndarray, lo: int, hi: int) -> DataFrame:
    """Mean over a band of ln generalised Gaussian - ln Gaussian density under an envelope: rows with vectors re, im and envelope
    (variances); bins other than 0 count twice."""
    shapes = np.asarray(shapes, float)

    def run(re, im, env) -> np.ndarray:
        power = re**2 + im**2
        gap = generalised_log_likelihood(power, env, shapes) - generalised_log_likelihood(power, env, np.ones(len(shapes)))
        w = np.where(np.arange(gap.shape[1]) == 0, 1.0, 2.0)
        w[:lo] = w[hi + 1 :] = 0
        return gap @ w / w.sum()

    return df.withColumn("ratio", vectors(run, "double", "re", "im", "envelope"))


def mutual_information(df: DataFrame, lo: int, hi: int, alpha: float = 0.95, key: str = "key") -> DataFrame:
    """Mutual information of two channels per frame, in a band: -mean ln(1 - |coherence|^2) with recursive densities along (key, n)."""

    class State:
        r = None

        def step(self, rows: dict) -> dict:
            a, b = rows["re_a"] + 1j * rows["im_a"], rows["re_b"] + 1j * rows["im_b"]
            out = []
            for x, y in zip(a[:, lo : hi + 1], b[:, lo : hi + 1], strict=True):
                new = np.stack([np.abs(x) ** 2 + 0j, np.abs(y) ** 2 + 0j, x * y.conj()])
                self.r = new if self.r is None else alpha * self.r + (1 - alpha) * new
                c = np.abs(self.r[2]) ** 2 / np.maximum((self.r[0] * self.r[1]).real, 1e-30)
                out.append(-np.log(np.maximum(1 - np.minimum(c, 1), 1e-6)).mean())
            return {"information": np.array(out)}

    return scan(df.select(key, "n", "re_a", "im_a", "re_b", "im_b"), [key], ["n"], State, "information double", keep=["n"])


def fit_shapes(df: DataFrame, candidates: np.ndarray) -> DataFrame:
    """Shape factor of each class and bin: the candidate under which values (class, bin, re, im, variance) are likeliest, all summed
    batch by batch; of equal ones the smaller."""
    candidates = np.asarray(candidates, float)

    def run(rows: dict) -> np.ndarray:
        power = rows["re"] ** 2 + rows["im"] ** 2
        return np.array([generalised_log_likelihood(power, rows["variance"], np.array([p])).sum() for p in candidates])

    s = sums(df.select("class", "bin", "re", "im", "variance"), ["class", "bin"], run)
    at = F.array_position("s", F.array_max("s"))
    return s.select("class", "bin", F.element_at(F.array(*map(F.lit, candidates.tolist())), at.cast("int")).alias("shape"), F.array_max("s").alias("log_likelihood"))


# decisions


class _Ema:
    def __init__(self, gamma: float, threshold: float):
        self.gamma, self.threshold, self.mean = gamma, threshold, 0.0

    def step(self, rows: dict) -> dict:
        out = np.zeros(len(rows["energy"]), bool)
        for k, e in enumerate(rows["energy"]):
            self.mean = self.gamma * self.mean + (1 - self.gamma) * e
            out[k] = self.mean > 0 and e / self.mean > self.threshold
        return {"speech": out.astype(np.int32)}


def energy_activity(df: DataFrame, key: str, threshold: float, gamma: float = 0.995) -> DataFrame:
    """1 where a frame's energy (column energy) is more than threshold times its recursive mean, the frame itself included."""
    return scan(df.select(key, "n", "energy"), [key], ["n"], lambda: _Ema(gamma, threshold), "speech int", keep=["n"])


def _bessel01(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp(-x) I0(x) and exp(-x) I1(x) for x >= 0, by quadrature over the angle."""
    t = (np.arange(256) + 0.5) * math.pi / 256
    e = np.exp(x[:, None] * (np.cos(t) - 1))
    return e.mean(1), (e * np.cos(t)).mean(1)


class _LikelihoodRatio:
    """Decision-directed a-priori ratio with the Ephraim-Malah amplitude (Sohn, Kim and Sung, 1999)."""

    def __init__(self, variance: np.ndarray, threshold: float, alpha: float):
        self.var, self.threshold, self.alpha, self.last = variance, threshold, alpha, np.sqrt(variance)

    def step(self, rows: dict) -> dict:
        score = []
        for power in rows["re"] ** 2 + rows["im"] ** 2:
            post = power / self.var
            prior = self.alpha * self.last**2 / self.var + (1 - self.alpha) * np.maximum(post - 1, 0)
            v = prior / (1 + prior) * post
            i0, i1 = _bessel01(v / 2)
            gain = math.sqrt(math.pi) / 2 * np.sqrt(v) / np.maximum(post, 1e-300) * ((1 + v) * i0 + v * i1)
            self.last = np.where(post > 0, gain * np.sqrt(power), 0.0)
            score.append((post * prior / (1 + prior) - np.log1p(prior)).mean())
        score = np.array(score)
        return {"score": score, "speech": (score > self.threshold).astype(np.int32)}


def likelihood_activity(df: DataFrame, key: str, noise: np.ndarray, threshold: float, alpha: float = 0.98) -> DataFrame:
    """Mean log likelihood ratio of speech and noise over bins, given the noise variances, and 1 where it is above the threshold."""
    noise = np.asarray(noise, float)
    return scan(df.select(key, "n", "re", "im"), [key], ["n"], lambda: _LikelihoodRatio(noise, threshold, alpha), "score double, speech int", keep=["n"])


class _Percentile:
    """Energy against a share of the sorted energies before; those of frames outside of speech are remembered, `history` of them."""

    def __init__(self, share: float, history: int, head: int, tail: int, first: float):
        self.energies, self.at, self.head, self.tail = [first] * history, int(share * history), head, tail
        self.on, self.above, self.below = False, 0, 0

    def step(self, rows: dict) -> dict:
        out = np.zeros(len(rows["energy"]), np.int32)
        for k, e in enumerate(rows["energy"]):
            hit = e > sorted(self.energies)[min(self.at, len(self.energies) - 1)]
            if not self.on and not self.above:
                self.energies = [*self.energies[1:], float(e)]
            if self.on:
                self.below = 0 if hit else self.below + 1
                if self.below > self.tail:
                    self.on, self.above, self.below = False, 0, 0
            else:
                self.above = self.above + 1 if hit else 0
                if self.above > self.head:
                    self.on, self.below = True, 0
            out[k] = self.on
        return {"speech": out}


def percentile_activity(df: DataFrame, key: str, share: float = 0.5, history: int = 200, head: int = 4, tail: int = 10, first: float = math.inf) -> DataFrame:
    """Speech from the frame at which `head` + 1 frames in a row have more energy than a share of the `history` remembered ones, to that at
    which more than `tail` in a row have less. `first` fills the history at the start."""
    return scan(df.select(key, "n", "energy"), [key], ["n"], lambda: _Percentile(share, history, head, tail, first), "speech int", keep=["n"])


def gate(decided: DataFrame, key: str, head: int = 4) -> DataFrame:
    """Rows of speech, with the `head` rows before each stretch of it: the prefix that a gate has buffered."""
    from .temporal import ordered

    ahead = F.max("speech").over(ordered(key).rowsBetween(0, head))
    return decided.where(F.col("speech").isNotNull()).withColumn("__a", ahead).where("__a = 1").drop("__a")


def stages(df: DataFrame, conditions: list[tuple[str, float]]) -> DataFrame:
    """Raw decision in stages: `hit` is true where the first column is above its threshold and every further one, asked only then, too."""
    out = F.lit(True)
    for name, limit in conditions:
        out = out & F.coalesce(F.col(name) > limit, F.lit(False))
    return df.withColumn("hit", out)


def perceptron(df: DataFrame, weights: list[tuple[np.ndarray, np.ndarray]], threshold: float = 0.1) -> DataFrame:
    """Speech by a multilayer perceptron on (stacked) frames: sigmoid layers, a softmax at the end; 1 where the second output is above the threshold."""
    sent = df.sparkSession.sparkContext.broadcast(weights)

    def run(x: np.ndarray) -> np.ndarray:
        for k, (w, b) in enumerate(sent.value):
            x = x @ w.T + b
            if k < len(sent.value) - 1:
                x = 1 / (1 + np.exp(-np.clip(x, -50, 50)))
        e = np.exp(x - x.max(1, keepdims=True))
        return (e[:, 1] / e.sum(1) > threshold).astype(np.int32)

    return df.withColumn("speech", vectors(run, "int", "v"))


def independent_axes(df: DataFrame, keep: int, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """FastICA by deflation with tanh: mean and unmixing rows. Moments are gathered by batches; each round is one pass that sums the
    contrast over all frames, so nothing but models reaches the driver."""
    from .gaussians import principal_axes

    mean, axes = principal_axes(df, keep)
    projected = df.where(F.col("v").isNotNull()).select("v")
    var = np.array(sums(projected, [], lambda r: np.concatenate([[len(r["v"])], (((r["v"] - mean) @ axes.T) ** 2).sum(0)])).first()["s"])
    white = axes / np.sqrt(np.maximum(var[1:] / var[0], 1e-12))[:, None]
    found: list[np.ndarray] = []
    rng = np.random.default_rng(3)
    for _ in range(keep):
        w = rng.normal(size=keep)
        for _ in range(rounds):
            for f in found:
                w = w - (w @ f) * f
            w = w / np.linalg.norm(w)

            def contrast(r: dict, w=w) -> np.ndarray:
                z = (r["v"] - mean) @ white.T
                g = np.tanh(z @ w)
                return np.concatenate([[len(z), (1 - g**2).sum()], g @ z])

            s = np.array(sums(projected, [], contrast).first()["s"])
            new = s[2:] / s[0] - s[1] / s[0] * w
            for f in found:
                new = new - (new @ f) * f
            new = new / max(np.linalg.norm(new), 1e-300)
            done = abs(abs(new @ w) - 1) < 1e-6
            w = new
            if done:
                break
        found.append(w)
    return mean, np.array(found) @ white
