"""Kalman filters along streams, and positions from time differences."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame

from .batch import scan, vectors
from .beamforming import SPEED


class Kalman:
    """Linear filter x' = F x + noise U, y = H x + noise V; step takes observations one by one."""

    def __init__(self, f: np.ndarray, u: np.ndarray, h: np.ndarray, v: np.ndarray, x: np.ndarray, p: np.ndarray):
        self.f, self.u, self.h, self.v, self.x, self.p = (np.asarray(m, float) for m in (f, u, h, v, x, p))

    def predicted(self) -> tuple[np.ndarray, np.ndarray]:
        return self.f @ self.x, self.f @ self.p @ self.f.T + self.u

    def observe(self, y: np.ndarray) -> np.ndarray:
        x, p = self.predicted()
        s = self.h @ p @ self.h.T + self.v
        gain = np.linalg.solve(s, self.h @ p).T
        self.x = x + gain @ (y - self.h @ x)
        i = np.eye(len(x)) - gain @ self.h
        self.p = i @ p @ i.T + gain @ self.v @ gain.T  # Joseph's form stays positive
        return self.x

    def step(self, rows: dict) -> dict:
        return {"x": np.array([self.observe(np.asarray(y, float)) for y in rows["v"]])}


def kalman(df: DataFrame, key: str, f: np.ndarray, u: np.ndarray, h: np.ndarray, v: np.ndarray, x: np.ndarray, p: np.ndarray) -> DataFrame:
    """State after each observation `v` of a stream: (key, n, x)."""
    return scan(df.select(key, "n", "v"), [key], ["n"], lambda: Kalman(f, u, h, v, x, p), "x array<double>", keep=["n"])


def microphone_pairs(count: int) -> list[tuple[int, int]]:
    return list(itertools.combinations(range(count), 2))


def pair_delays(position: np.ndarray, mics: np.ndarray, pairs: list[tuple[int, int]], speed: float = SPEED) -> np.ndarray:
    """Arrival at the first microphone of each pair after that at the second."""
    far = np.sqrt(((mics - position) ** 2).sum(1)) / speed
    return np.array([far[a] - far[b] for a, b in pairs])


def delay_slopes(position: np.ndarray, mics: np.ndarray, pairs: list[tuple[int, int]], speed: float = SPEED) -> np.ndarray:
    """Derivatives of the delays by the position."""
    d = position - mics
    unit = d / np.maximum(np.sqrt((d**2).sum(1, keepdims=True)), 1e-9)
    return np.array([unit[a] - unit[b] for a, b in pairs]) / speed


class _Extended:
    """Extended Kalman filter of a position on the delays of microphone pairs, iterated; a null or non-finite delay is left out of its frame."""

    def __init__(self, mics, pairs, start, move, noise, first, rounds, speed):
        self.mics, self.pairs, self.x, self.move, self.noise, self.rounds, self.speed = mics, pairs, np.asarray(start, float), move, noise, rounds, speed
        self.p = first * np.eye(len(self.x))

    def step(self, rows: dict) -> dict:
        out = []
        for y in rows["v"]:
            y = np.asarray(y, float)
            use = np.flatnonzero(np.isfinite(y))
            p = self.p + self.move * np.eye(len(self.x))
            x = self.x
            if len(use):
                for _ in range(self.rounds):
                    h = delay_slopes(x, self.mics, self.pairs, self.speed)[use]
                    gain = np.linalg.solve(h @ p @ h.T + self.noise * np.eye(len(use)), h @ p).T
                    x = self.x + gain @ (y[use] - pair_delays(x, self.mics, self.pairs, self.speed)[use] - h @ (self.x - x))
                p = (np.eye(len(x)) - gain @ h) @ p
            self.x, self.p = x, p
            out.append(x)
        return {"x": np.array(out)}


def track_position(df: DataFrame, key: str, mics: np.ndarray, start: np.ndarray, move: float = 1e-3, noise: float = 1e-10, first: float = 1.0, rounds: int = 4, speed: float = SPEED) -> DataFrame:
    """Position after each frame of pair delays `v` (all pairs of the microphones in order): (key, n, x)."""
    mics = np.asarray(mics, float)
    pairs = microphone_pairs(len(mics))
    return scan(df.select(key, "n", "v"), [key], ["n"], lambda: _Extended(mics, pairs, start, move, noise, first, rounds, speed), "x array<double>", keep=["n"])


def locate(df: DataFrame, mics: np.ndarray, start: np.ndarray, rounds: int = 30, speed: float = SPEED) -> DataFrame:
    """Position of each row's pair delays `v` by damped Gauss-Newton steps from `start`, as `x`."""
    mics = np.asarray(mics, float)
    pairs = microphone_pairs(len(mics))

    def run(v: np.ndarray) -> np.ndarray:
        out = np.empty((len(v), len(start)))
        for k, y in enumerate(v):
            x, damp = np.asarray(start, float), 1e-3
            error = lambda x, y=y: (y - pair_delays(x, mics, pairs, speed)) * speed
            for _ in range(rounds):
                h, e = delay_slopes(x, mics, pairs, speed) * speed, error(x)
                new = x + np.linalg.solve(h.T @ h + damp * np.eye(len(x)), h.T @ e)
                x, damp = (new, damp / 3) if (error(new) ** 2).sum() < (e**2).sum() else (x, damp * 5)
            out[k] = x
        return out

    return df.withColumn("x", vectors(run, "array<double>", "v"))
