"""Echo cancellers on complex subbands, dereverberation by weighted prediction, and adaptive filters.

Rows are (bin, frame) with numbers re/im of the recorded and the played signal. Every bin is a stream of its own, whose filter is
the state that travels along its frames, so bins run side by side and memory doesn't grow with a recording.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .batch import per_group, scan

ECHO = ("frame", "rec_re", "rec_im", "play_re", "play_im")


class _Echo:
    """Shared part: complex inputs, the last `taps` played values, errors out."""

    def __init__(self, taps: int):
        self.v = np.zeros(taps, complex)

    def step(self, rows: dict) -> dict:
        out = np.empty(len(rows["rec_re"]), complex)
        for k, (a, v) in enumerate(zip(rows["rec_re"] + 1j * rows["rec_im"], rows["play_re"] + 1j * rows["play_im"], strict=True)):
            self.v = np.concatenate([[v], self.v[:-1]])
            out[k] = self.error(a)
        return {"re": out.real, "im": out.imag}


class _NlmsEcho(_Echo):
    def __init__(self, delta: float, rate: float, threshold: float):
        super().__init__(1)
        self.r, self.delta, self.rate, self.threshold = 0j, delta, rate, threshold

    def error(self, a: complex) -> complex:
        v = self.v[0]
        e = a - self.r * v
        if abs(v) ** 2 > self.threshold:
            self.r += self.rate * e * v.conjugate() / (self.delta + abs(v) ** 2)
        return e


class _KalmanEcho(_Echo):
    """Kalman filter of the echo path over `taps` frames; the error's variance is a recursive mean. With `guard`, a frame whose error
    is more than guard times the expected one (someone speaks) leaves the path as it is."""

    def __init__(self, taps: int, beta: float, drift: float, start: float, threshold: float, guard: float | None):
        super().__init__(taps)
        self.r, self.p = np.zeros(taps, complex), start * np.eye(taps, dtype=complex)
        self.beta, self.drift, self.threshold, self.guard, self.var = beta, drift, threshold, guard, start

    def error(self, a: complex) -> complex:
        v = self.v.conj()
        e = a - v.conj() @ self.r
        if (np.abs(self.v) ** 2).sum() <= self.threshold:
            return e
        p = self.p + self.drift * np.eye(len(v))
        through = (v.conj() @ p @ v).real
        if self.guard is None or abs(e) ** 2 <= self.guard * (self.var + through):
            self.var = self.beta * self.var + (1 - self.beta) * abs(e) ** 2
            gain = p @ v / (through + self.var)
            self.r = self.r + gain * e
            self.p = p - np.outer(gain, v.conj() @ p)
        return e


class _InformationEcho(_Echo):
    """The same filter in information form: the inverse covariance and its product with the path; as a square root, if asked for."""

    def __init__(self, taps: int, beta: float, start: float, loading: float, threshold: float, root: bool):
        super().__init__(taps)
        self.y, self.z = np.eye(taps, dtype=complex) / start, np.zeros(taps, complex)
        self.s = np.eye(taps, dtype=complex) / np.sqrt(start)
        self.beta, self.loading, self.threshold, self.root, self.var = beta, loading, threshold, root, start

    def error(self, a: complex) -> complex:
        v = self.v.conj()
        taps = len(v)
        if self.root:
            path = np.linalg.solve(self.s + self.loading * np.eye(taps), self.z)
        else:
            path = np.linalg.solve(self.y + self.loading * np.eye(taps), self.z)
        e = a - v.conj() @ path
        if (np.abs(self.v) ** 2).sum() <= self.threshold:
            return e
        self.var = max(self.beta * self.var + (1 - self.beta) * abs(e) ** 2, 1e-12)
        if self.root:  # a QR step takes the new row into the triangular root
            rows = np.vstack([np.column_stack([np.sqrt(self.beta) * self.s, np.sqrt(self.beta) * self.z]), np.append(v.conj(), a)[None] / np.sqrt(self.var)])
            r = np.linalg.qr(rows, mode="r")
            self.s, self.z = r[:taps, :taps], r[:taps, taps]
        else:
            self.y = self.beta * self.y + np.outer(v, v.conj()) / self.var
            self.z = self.beta * self.z + v * a / self.var
        return e


def _echo(df: DataFrame, make, keys: list[str]) -> DataFrame:
    return scan(df.select(*keys, *ECHO), keys, ["frame"], make, "re double, im double", keep=["frame"])


def nlms_echo(df: DataFrame, delta: float = 100.0, rate: float = 1e-4, threshold: float = 100.0, keys: tuple[str, ...] = ("bin",)) -> DataFrame:
    """Normalised LMS per bin; frames whose played power isn't above `threshold` don't move the filter: (keys, frame, re, im)."""
    return _echo(df, lambda: _NlmsEcho(delta, rate, threshold), list(keys))


def kalman_echo(df: DataFrame, taps: int = 1, beta: float = 0.95, drift: float = 1e-3, start: float = 5.0, threshold: float = 100.0, guard: float | None = None, keys: tuple[str, ...] = ("bin",)) -> DataFrame:
    """Kalman filter per bin with one or more lags; `guard` is the double-talk detector."""
    return _echo(df, lambda: _KalmanEcho(taps, beta, drift, start, threshold, guard), list(keys))


def information_echo(df: DataFrame, taps: int = 1, beta: float = 0.95, start: float = 5.0, loading: float = 1e-4, threshold: float = 100.0, root: bool = False, keys: tuple[str, ...] = ("bin",)) -> DataFrame:
    """Information filter per bin, or its square root kept by orthogonal transformations."""
    return _echo(df, lambda: _InformationEcho(taps, beta, start, loading, threshold, root), list(keys))


def weighted_prediction(x: np.ndarray, lower: int, upper: int, rounds: int = 2, load_db: float = -20.0) -> np.ndarray:
    """Late reverberation taken out of one bin's frames (frame x channel): every channel is predicted from their
    own values lower to upper frames back, with weights by the inverse of the predicted power, in turns."""
    frames, chans = x.shape
    lags = range(lower, upper + 1)
    past = np.concatenate([np.vstack([np.zeros((min(k, frames), chans), complex), x[: max(frames - k, 0)]]) for k in lags], 1)
    y = x.copy()
    for _ in range(rounds):
        power = np.maximum((np.abs(y) ** 2).mean(1), 1e-10 + 1e-3 * (np.abs(x) ** 2).mean())
        w = past / power[:, None]
        r = w.conj().T @ past
        r += 10 ** (load_db / 10) * max(np.trace(r).real / len(r), 1e-12) * np.eye(len(r))
        y = x - past @ np.linalg.solve(r, w.conj().T @ x)
    return y


def dereverberate(df: DataFrame, lower: int = 1, upper: int = 5, rounds: int = 2, load_db: float = -20.0, keys: tuple[str, ...] = ("utt", "bin")) -> DataFrame:
    """Weighted prediction error for utterances: rows (keys, frame) with vectors re and im over channels; returns (keys, frame, re, im).

    The filter needs all frames of an utterance and bin at once, so a group is one utterance's bin: cut long recordings into
    utterances first. A single channel is a vector of length one."""

    def run(rows: list[dict]) -> list[dict]:
        rows = sorted(rows, key=lambda r: r["frame"])
        x = np.array([np.asarray(r["re"]) + 1j * np.asarray(r["im"]) for r in rows])
        y = weighted_prediction(x, lower, upper, rounds, load_db)
        return [{"frame": r["frame"], "re": v.real.tolist(), "im": v.imag.tolist()} for r, v in zip(rows, y, strict=True)]

    return per_group(df.select(*keys, "frame", "re", "im"), list(keys), run, "frame long, re array<double>, im array<double>")


class _BlockLms:
    """Fast block LMS: filter and gradient by transforms of two blocks, with power normalisation per bin."""

    def __init__(self, taps: int, alpha: float, gamma: float):
        self.n, self.alpha, self.gamma = taps, alpha, gamma
        self.w, self.power, self.old = np.zeros(2 * taps, complex), np.zeros(2 * taps), np.zeros(taps)

    def step(self, rows: dict) -> dict:
        out = []
        for far, x in zip(rows["far"], rows["v"], strict=True):
            u = np.fft.fft(np.concatenate([self.old, far]))
            y = np.fft.ifft(u * self.w).real[self.n :]
            e = x - y
            self.power = self.gamma * self.power + (1 - self.gamma) * np.abs(u) ** 2
            g = np.fft.ifft(np.where(self.power > 0, u.conj() / np.maximum(self.power, 1e-12), 0) * np.fft.fft(np.concatenate([np.zeros(self.n), e]))).real[: self.n]
            self.w = self.w + self.alpha * np.fft.fft(np.concatenate([g, np.zeros(self.n)]))
            self.old = far
            out.append(e)
        return {"e": np.array(out)}


def block_lms(df: DataFrame, key: str, taps: int, alpha: float = 0.1, gamma: float = 0.9) -> DataFrame:
    """Adaptive filter on blocks `v` and `far` of `taps` samples: (key, n, e) with the error blocks."""
    return scan(df.select(key, "n", "v", "far"), [key], ["n"], lambda: _BlockLms(taps, alpha, gamma), "e array<double>", keep=["n"])
