"""Beamformers on snapshot vectors (frame, bin, re, im over channels): weights per bin are models on the driver, output is w^H x.

Fixed weights are applied as matrix products over batches of rows; adaptive ones walk each bin's frames in order with their
own state, so all bins run side by side. Distances are in the unit of `speed` times seconds.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import complex_of
from .batch import scan, sums, vectors

SPEED = 343.0


def plane_wave_delays(positions: np.ndarray, azimuth: float, polar: float = math.pi / 2, speed: float = SPEED) -> np.ndarray:
    """Arrival of a plane wave from a direction at each microphone, in seconds from that at the origin."""
    to = np.array([math.sin(polar) * math.cos(azimuth), math.sin(polar) * math.sin(azimuth), math.cos(polar)])
    return -np.asarray(positions) @ to / speed


def point_delays(positions: np.ndarray, source: np.ndarray, speed: float = SPEED) -> np.ndarray:
    """Arrival of a point source's wave at each microphone, in seconds after the nearest one."""
    far = np.sqrt(((np.asarray(positions) - source) ** 2).sum(1)) / speed
    return far - far.min()


def manifold(delays: np.ndarray, bins: int, rate: float, length: int) -> np.ndarray:
    """Array manifold (bin x channel): exp(-j 2 pi f delay)."""
    f = np.arange(bins) * rate / length
    return np.exp(-2j * np.pi * f[:, None] * np.asarray(delays)[None])


def delay_and_sum_weights(d: np.ndarray) -> np.ndarray:
    return d / d.shape[1]


def diffuse_coherence(positions: np.ndarray, bins: int, rate: float, length: int, speed: float = SPEED) -> np.ndarray:
    """Coherence of a spherically isotropic field (bin x channel x channel): sinc of 2 f distance / speed."""
    p = np.asarray(positions, float)
    far = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
    return np.sinc(2 * (np.arange(bins) * rate / length)[:, None, None] * far / speed)


def loaded(r: np.ndarray, loading: float) -> np.ndarray:
    return r + loading * np.eye(r.shape[-1])


def mvdr_weights(r: np.ndarray, d: np.ndarray, loading: float = 0.01) -> np.ndarray:
    """R^-1 d / (d^H R^-1 d) per bin, with `loading` added to the diagonal."""
    x = np.linalg.solve(loaded(r, loading), d[..., None])[..., 0]
    return x / (d.conj() * x).sum(-1, keepdims=True)


def lcmv_weights(r: np.ndarray, constraints: np.ndarray, response: np.ndarray, loading: float = 0.01) -> np.ndarray:
    """Weights of least power with constraints^H w = response, per bin (constraints: bin x channel x source): for a source of response 1
    and jammers of response 0."""
    x = np.linalg.solve(loaded(r, loading), constraints)
    small = np.swapaxes(constraints.conj(), -1, -2) @ x
    return (x @ np.linalg.solve(small, np.broadcast_to(response, small.shape[:-1])[..., None]))[..., 0]


def blocking_matrix(d: np.ndarray, constraints: int = 1) -> np.ndarray:
    """Orthonormal columns that block the columns of d (channel, or channel x constraint)."""
    d = d.reshape(len(d), -1)
    u = np.linalg.svd(d, full_matrices=True)[0]
    return u[:, d.shape[1] :]


def apply_weights(df: DataFrame, weights: np.ndarray, bin_column: str = "bin") -> DataFrame:
    """df with re and im of w^H x, w being the row of `weights` for the bin."""
    sent = df.sparkSession.sparkContext.broadcast(weights)

    def run(b: np.ndarray, re: np.ndarray, im: np.ndarray) -> dict:
        y = (sent.value[b.astype(int)].conj() * (re + 1j * im)).sum(1)
        return {"re": y.real, "im": y.imag}

    out = df.withColumn("__y", vectors(run, "re double, im double", bin_column, "re", "im"))
    return out.withColumn("re", F.col("__y.re")).withColumn("im", F.col("__y.im")).drop("__y")


def project(df: DataFrame, matrices: np.ndarray, bin_column: str = "bin") -> DataFrame:
    """df with vectors re and im of B^H x: outputs of a blocking matrix per bin (bin x channel x output)."""
    sent = df.sparkSession.sparkContext.broadcast(matrices)

    def run(b: np.ndarray, re: np.ndarray, im: np.ndarray) -> dict:
        y = np.einsum("nco,nc->no", sent.value[b.astype(int)].conj(), re + 1j * im)
        return {"re": y.real, "im": y.imag}

    out = df.withColumn("__y", vectors(run, "re array<double>, im array<double>", bin_column, "re", "im"))
    return out.withColumn("re", F.col("__y.re")).withColumn("im", F.col("__y.im")).drop("__y")


def time_align(df: DataFrame, d: np.ndarray) -> DataFrame:
    """Snapshot vectors with each channel's delay taken out."""
    sent = df.sparkSession.sparkContext.broadcast(d)

    def run(b: np.ndarray, re: np.ndarray, im: np.ndarray) -> dict:
        y = sent.value[b.astype(int)].conj() * (re + 1j * im)
        return {"re": y.real, "im": y.imag}

    out = df.withColumn("__y", vectors(run, "re array<double>, im array<double>", "bin", "re", "im"))
    return out.withColumn("re", F.col("__y.re")).withColumn("im", F.col("__y.im")).drop("__y")


def covariances(df: DataFrame, bins: int, both_ways: bool = False) -> np.ndarray:
    """Mean of x x^H per bin (bin x channel x channel), summed batch by batch; with `both_ways` averaged with its reversal
    J conj(R) J. A model of bins x channels squared, on the driver; bins without frames are zero."""

    def run(rows: dict) -> np.ndarray:
        x = complex_of(rows)
        r = (x.T @ x.conj()).ravel()
        return np.concatenate([[len(x)], r.real, r.imag])

    found = sums(df.select("bin", "re", "im"), ["bin"], run).collect()
    size = round(math.sqrt((len(found[0]["s"]) - 1) / 2)) if found else 0
    out = np.zeros((bins, size, size), complex)
    for row in found:
        s, k = np.array(row["s"]), size * size
        r = ((s[1 : 1 + k] + 1j * s[1 + k :]) / s[0]).reshape(size, size)
        out[row["bin"]] = (r + r.conj()[::-1, ::-1]) / 2 if both_ways else r
    return out


class _Covariance:
    def __init__(self, mu: float):
        self.mu, self.r = mu, None

    def step(self, rows: dict) -> dict:
        re, im = [], []
        for x in complex_of(rows):
            new = np.outer(x, x.conj())
            self.r = new if self.r is None else self.mu * self.r + (1 - self.mu) * new
            re.append(self.r.real.ravel())
            im.append(self.r.imag.ravel())
        return {"r_re": np.array(re), "r_im": np.array(im)}


def running_covariances(df: DataFrame, mu: float = 0.9) -> DataFrame:
    """Recursive covariance of each bin after each frame: (bin, frame, r_re, r_im), rows of the matrix after one another."""
    return scan(df.select("bin", "frame", "re", "im"), ["bin"], ["frame"], lambda: _Covariance(mu), "r_re array<double>, r_im array<double>", keep=["frame"])


def mvdr(df: DataFrame, r: np.ndarray, d: np.ndarray, loading: float = 0.01) -> DataFrame:
    return apply_weights(df, mvdr_weights(r, d, loading))


def sidelobe_canceller(df: DataFrame, quiescent: np.ndarray, d: np.ndarray, active: np.ndarray) -> DataFrame:
    """(wq - B wa)^H x with fixed active weights (bin x channel - 1)."""
    b = np.stack([blocking_matrix(x) for x in d])
    return apply_weights(df, quiescent - np.einsum("bco,bo->bc", b, active))


class _Adaptive:
    """Active weights of a sidelobe canceller by recursive least squares (forgetting mu, loading sigma) or normalised LMS."""

    def __init__(self, quiescent: np.ndarray, d: np.ndarray, kind: str, mu: float, sigma: float):
        self.all_q, self.all_d, self.kind, self.mu, self.sigma, self.ready = quiescent, d, kind, mu, sigma, False

    def _start(self, b: int) -> None:
        self.q, self.b = self.all_q[b], blocking_matrix(self.all_d[b])
        k = self.b.shape[1]
        self.w, self.p, self.power, self.ready = np.zeros(k, complex), np.eye(k) / max(self.sigma, 1e-6), 0.0, True

    def step(self, rows: dict) -> dict:
        if not self.ready:
            self._start(int(rows["bin"][0]))
        out = np.empty(len(rows["re"]), complex)
        for n, x in enumerate(complex_of(rows)):
            z = self.b.conj().T @ x
            y = self.q.conj() @ x - self.w.conj() @ z
            out[n] = y
            if self.kind == "rls":
                g = self.p @ z / (self.mu + (z.conj() @ self.p @ z).real)
                self.p = (self.p - np.outer(g, z.conj() @ self.p)) / self.mu
                self.w = self.w + g * np.conj(y)
            else:
                self.power = self.mu * self.power + (1 - self.mu) * (z.conj() @ z).real
                self.w = self.w + self.sigma * z * np.conj(y) / max(self.power, 1e-12)
        return {"re": out.real, "im": out.imag}


def adaptive_canceller(df: DataFrame, quiescent: np.ndarray, d: np.ndarray, kind: str = "rls", mu: float = 0.9, sigma: float = 0.01) -> DataFrame:
    """Generalised sidelobe canceller whose active weights follow each bin's frames: (bin, frame, re, im). `kind` is rls or lms."""
    sent = df.sparkSession.sparkContext.broadcast((quiescent, d))
    return scan(df.select("bin", "frame", "re", "im"), ["bin"], ["frame"], lambda: _Adaptive(*sent.value, kind, mu, sigma), "re double, im double", keep=["frame"])


# spherical arrays


def spherical_bessel(order: int, x: float) -> tuple[np.ndarray, np.ndarray]:
    """j_n(x) and y_n(x) for n = 0..order; j by downward recursion, which is stable, y by upward."""
    x = max(float(x), 1e-9)
    top = order + 20 + int(x)
    j = np.zeros(top + 2)
    j[top] = 1e-30
    for n in range(top, 0, -1):
        j[n - 1] = (2 * n + 1) / x * j[n] - j[n + 1]
        if abs(j[n - 1]) > 1e200:
            j[n - 1 :] /= 1e200
    j0, j1 = math.sin(x) / x, math.sin(x) / x**2 - math.cos(x) / x
    j *= j0 / j[0] if abs(j0) > abs(j1) * 1e-3 else j1 / j[1]
    y = np.zeros(max(order, 1) + 1)
    y[0], y[1] = -math.cos(x) / x, -math.cos(x) / x**2 - math.sin(x) / x
    for n in range(1, order):
        y[n + 1] = (2 * n + 1) / x * y[n] - y[n - 1]
    return j[: order + 1], y[: order + 1]


def mode_amplitudes(order: int, ka: float) -> np.ndarray:
    """b_n(ka) of a rigid sphere with microphones on it: i^n (j_n - j_n' / h_n' h_n), which is i^(n-1) / ((ka)^2 h_n'(ka)) up to sign."""
    j, y = spherical_bessel(order + 1, ka)
    h = j + 1j * y
    n = np.arange(order + 1)
    slope = lambda f: n / ka * f[:-1] - f[1:]
    return 1j**n * (j[:-1] - slope(j) / slope(h) * h[:-1])


def harmonics(order: int, polar: np.ndarray, azimuth: np.ndarray) -> np.ndarray:
    """Y_nm at directions, as (direction x (order + 1)^2), n rising and m from -n to n."""
    x = np.cos(np.asarray(polar, float))
    s = np.sqrt(np.maximum(0, 1 - x * x))
    p = {(0, 0): np.ones_like(x)}
    for m in range(1, order + 1):
        p[m, m] = -(2 * m - 1) * s * p[m - 1, m - 1]
    for m in range(order):
        p[m + 1, m] = (2 * m + 1) * x * p[m, m]
    for m in range(order + 1):
        for n in range(m + 2, order + 1):
            p[n, m] = ((2 * n - 1) * x * p[n - 1, m] - (n + m - 1) * p[n - 2, m]) / (n - m)
    out = []
    for n in range(order + 1):
        for m in range(-n, n + 1):
            k = abs(m)
            y = math.sqrt((2 * n + 1) / (4 * math.pi) * math.factorial(n - k) / math.factorial(n + k)) * p[n, k] * np.exp(1j * k * np.asarray(azimuth))
            out.append(y if m >= 0 else (-1) ** k * y.conj())
    return np.stack(out, -1)


def _by_mode(order: int) -> np.ndarray:
    return np.repeat(np.arange(order + 1), 2 * np.arange(order + 1) + 1)


def spherical_weights(positions: np.ndarray, look: tuple[float, float], bins: int, rate: float, length: int, radius: float, order: int = 4, kind: str = "delay_and_sum", gain: float = 1.0, loading: float = 1e-2, speed: float = SPEED) -> np.ndarray:
    """Weights on the channels (bin x channel) of a modal beamformer on a rigid sphere; positions and look are (polar, azimuth).

    Kinds: delay_and_sum weighs modes by their amplitude; regular divides by it (plane-wave decomposition); white_noise adds to
    it as much loading as the white-noise gain `gain` asks for; optimal is the loaded least-squares inverse of each mode. Responses in
    the look direction are one. Bin 0, where the modes above zero vanish, uses the zeroth mode.
    """
    positions = np.asarray(positions, float)
    y_mic = harmonics(order, positions[:, 0], positions[:, 1])
    y_look = harmonics(order, np.array([look[0]]), np.array([look[1]]))[0]
    to_modes = np.linalg.pinv(y_mic)  # mode x channel
    mode = _by_mode(order)
    out = np.zeros((bins, len(positions)), complex)
    for b in range(bins):
        ka = max(2 * math.pi * b * rate / length * radius / speed, 1e-3)
        amplitude = (4 * math.pi * mode_amplitudes(order, ka))[mode]
        if kind == "delay_and_sum":
            c = amplitude.conj()
        elif kind == "regular":
            c = 1 / np.where(np.abs(amplitude) > 1e-6, amplitude, np.inf)
        else:
            extra = loading if kind == "optimal" else 1e-8
            while True:
                c = amplitude.conj() / (np.abs(amplitude) ** 2 + extra)
                response = (c * amplitude * np.abs(y_look) ** 2).sum()
                noise = (np.abs((c * y_look)[:, None] * to_modes).sum(0) ** 2).sum() / abs(response) ** 2
                if kind == "optimal" or 1 / noise >= gain or extra > 1e6:
                    break
                extra *= 4
        w = ((c * y_look)[:, None] * to_modes).sum(0)
        pressure = y_mic @ (amplitude * y_look.conj())
        out[b] = (w / (w * pressure).sum()).conj()
    return out


def plane_wave_pressures(positions: np.ndarray, source: tuple[float, float], bins: int, rate: float, length: int, radius: float, order: int = 8, speed: float = SPEED) -> np.ndarray:
    """Pressure of a unit plane wave at the microphones of a rigid sphere (bin x channel): a simulator of snapshots."""
    positions = np.asarray(positions, float)
    y_mic, y_src = harmonics(order, positions[:, 0], positions[:, 1]), harmonics(order, np.array([source[0]]), np.array([source[1]]))[0]
    mode = _by_mode(order)
    ka = [max(2 * math.pi * b * rate / length * radius / speed, 1e-3) for b in range(bins)]
    return np.stack([y_mic @ ((4 * math.pi * mode_amplitudes(order, k))[mode] * y_src.conj()) for k in ka])
