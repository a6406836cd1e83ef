"""Grey images as frames: a row has the pixels `v` row by row, and all images of a call have the same width and height.

All are numpy over batches of images. Pixels beyond the border repeat the border.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .batch import scan, vectors


def _map(df: DataFrame, width: int, height: int, fn, kind: str = "array<double>", into: str = "v") -> DataFrame:
    def run(x: np.ndarray):
        if x.shape[1] != width * height:
            raise ValueError("an image doesn't have width x height pixels")
        y = fn(x.reshape(-1, height, width).astype(float))
        return y.reshape(len(x), -1) if kind == "array<double>" and isinstance(y, np.ndarray) else y

    return df.withColumn(into, vectors(run, kind, "v"))


def crop(df: DataFrame, width: int, height: int, x: int, y: int, w: int, h: int) -> DataFrame:
    return _map(df, width, height, lambda im: im[:, y : y + h, x : x + w])


def _near(im: np.ndarray, size: int) -> np.ndarray:
    """All size x size neighbours of each pixel, as a last axis."""
    r = size // 2
    p = np.pad(im, ((0, 0), (r, r), (r, r)), mode="edge")
    return np.stack([p[:, i : i + im.shape[1], j : j + im.shape[2]] for i in range(size) for j in range(size)], -1)


def smooth(df: DataFrame, width: int, height: int, kind: str = "mean", size: int = 3, sigma: float | None = None) -> DataFrame:
    """Mean, median or Gaussian filter of an odd size."""
    if kind == "gaussian":
        s = sigma or 0.3 * ((size - 1) * 0.5 - 1) + 0.8
        g = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * s * s))
        w = np.outer(g, g).ravel() / g.sum() ** 2
        return _map(df, width, height, lambda im: _near(im, size) @ w)
    return _map(df, width, height, lambda im: (np.median if kind == "median" else np.mean)(_near(im, size), axis=-1))


def _erode(im: np.ndarray, times: int) -> np.ndarray:
    for _ in range(times):
        im = _near(im, 3).min(-1)
    return im


def _dilate(im: np.ndarray, times: int) -> np.ndarray:
    for _ in range(times):
        im = _near(im, 3).max(-1)
    return im


MORPHOLOGY = {
    "erode": _erode,
    "dilate": _dilate,
    "open": lambda im, n: _dilate(_erode(im, n), n),
    "close": lambda im, n: _erode(_dilate(im, n), n),
    "gradient": lambda im, n: _dilate(im, n) - _erode(im, n),
    "top_hat": lambda im, n: im - _dilate(_erode(im, n), n),
    "black_hat": lambda im, n: _erode(_dilate(im, n), n) - im,
}


def morphology(df: DataFrame, width: int, height: int, kind: str, times: int = 1) -> DataFrame:
    """Erosion, dilation and what is made of them, with 3 x 3 neighbours."""
    return _map(df, width, height, lambda im: MORPHOLOGY[kind](im, times))


def threshold(df: DataFrame, width: int, height: int, limit: float, top: float = 255.0, kind: str = "binary") -> DataFrame:
    """binary: top above the limit, else 0; inverse; truncate at the limit; to_zero below it; to_zero_inverse above it."""
    rule = {
        "binary": lambda im: np.where(im > limit, top, 0.0),
        "inverse": lambda im: np.where(im > limit, 0.0, top),
        "truncate": lambda im: np.minimum(im, limit),
        "to_zero": lambda im: np.where(im > limit, im, 0.0),
        "to_zero_inverse": lambda im: np.where(im > limit, 0.0, im),
    }[kind]
    return _map(df, width, height, rule)


def gradients(im: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sobel's derivatives along x and y."""
    n = _near(im, 3)
    return n @ np.array([-1, 0, 1, -2, 0, 2, -1, 0, 1.0]), n @ np.array([-1, -2, -1, 0, 0, 0, 1, 2, 1.0])


def edges(df: DataFrame, width: int, height: int, low: float, high: float) -> DataFrame:
    """Canny's edges, 255 or 0: ridges of the gradient above `high`, and those above `low` that are joined to them."""

    def run(im: np.ndarray) -> np.ndarray:
        gx, gy = gradients(im)
        size = np.abs(gx) + np.abs(gy)
        near = _near(size, 3)
        turn = np.round(np.arctan2(gy, gx) / (np.pi / 4)).astype(int) % 4
        pairs = np.array([(5, 3), (8, 0), (7, 1), (6, 2)])  # neighbours along the gradient
        ahead = np.take_along_axis(near, pairs[turn][..., :1], -1)[..., 0]
        back = np.take_along_axis(near, pairs[turn][..., 1:], -1)[..., 0]
        ridge = (size >= ahead) & (size > back)
        sure, maybe = ridge & (size > high), ridge & (size > low)
        while True:
            new = maybe & (_near(sure.astype(float), 3).max(-1) > 0)
            if (new == sure).all():
                return np.where(sure, 255.0, 0.0)
            sure = new | sure

    return _map(df, width, height, run)


def centre(df: DataFrame, width: int, height: int) -> DataFrame:
    """Moves the centre of mass of the brightness to the middle; what comes in is 0, dark images stay."""

    def run(im: np.ndarray) -> np.ndarray:
        out = np.zeros_like(im)
        for k, one in enumerate(im):
            total = one.sum()
            if total <= 0:
                out[k] = one
                continue
            dy = int(round(height / 2 - 0.5 - (one.sum(1) @ np.arange(height)) / total))
            dx = int(round(width / 2 - 0.5 - (one.sum(0) @ np.arange(width)) / total))
            src = one[max(0, -dy) : height - max(0, dy), max(0, -dx) : width - max(0, dx)]
            out[k, max(0, dy) : max(0, dy) + src.shape[0], max(0, dx) : max(0, dx) + src.shape[1]] = src
        return out

    return _map(df, width, height, run)


def interpolate(df: DataFrame, width: int, height: int, to_width: int, to_height: int) -> DataFrame:
    """Bilinear resizing."""

    def run(im: np.ndarray) -> np.ndarray:
        y, x = np.linspace(0, height - 1, to_height), np.linspace(0, width - 1, to_width)
        y0, x0 = np.minimum(y.astype(int), max(height - 2, 0)), np.minimum(x.astype(int), max(width - 2, 0))
        fy, fx = (y - y0)[:, None], (x - x0)[None]
        y1, x1 = np.minimum(y0 + 1, height - 1), np.minimum(x0 + 1, width - 1)
        at = lambda a, b: im[:, a[:, None], b[None]]
        return (at(y0, x0) * (1 - fx) + at(y0, x1) * fx) * (1 - fy) + (at(y1, x0) * (1 - fx) + at(y1, x1) * fx) * fy

    return _map(df, width, height, run)


class _Flow:
    """Horn and Schunck's flow from the frame before."""

    def __init__(self, width: int, height: int, alpha: float, rounds: int):
        self.shape, self.alpha, self.rounds, self.last = (height, width), alpha, rounds, None

    def step(self, rows: dict) -> dict:
        us, vs = [], []
        mean = np.array([1, 2, 1, 2, 0, 2, 1, 2, 1]) / 12
        for x in rows["v"]:
            im = np.asarray(x, float).reshape(1, *self.shape)
            last = im if self.last is None else self.last
            gx, gy = (g / 8 for g in gradients((im + last) / 2))
            gt = im - last
            u = v = np.zeros_like(im)
            for _ in range(self.rounds):
                mu, mv = _near(u, 3) @ mean, _near(v, 3) @ mean
                t = (gx * mu + gy * mv + gt) / (self.alpha**2 + gx**2 + gy**2)
                u, v = mu - gx * t, mv - gy * t
            us.append(u.ravel())
            vs.append(v.ravel())
            self.last = im
        return {"u": np.array(us), "w": np.array(vs)}


def optical_flow(df: DataFrame, key: str, width: int, height: int, alpha: float = 10.0, rounds: int = 50) -> DataFrame:
    """Movement of each pixel since the frame before (zero for a stream's first): (key, n, u, w)."""
    return scan(df.select(key, "n", "v"), [key], ["n"], lambda: _Flow(width, height, alpha, rounds), "u array<double>, w array<double>", keep=["n"])


def snake(df: DataFrame, width: int, height: int, start: np.ndarray, alpha: float = 0.1, beta: float = 0.1, gamma: float = 1.0, rounds: int = 100) -> DataFrame:
    """Closed active contour (points x 2, as x and y) drawn to strong gradients by Kass, Witkin and Terzopoulos' implicit steps: `points` as
    x, y after one another."""
    n = len(start)
    stiff = np.zeros((n, n))
    for shift, c in ((0, 2 * alpha + 6 * beta), (1, -alpha - 4 * beta), (-1, -alpha - 4 * beta), (2, beta), (-2, beta)):
        stiff += c * np.roll(np.eye(n), shift, axis=1)
    inverse = np.linalg.inv(stiff + gamma * np.eye(n))

    def run(im: np.ndarray) -> np.ndarray:
        gx, gy = gradients(im)
        fy, fx = np.gradient(gx**2 + gy**2, axis=(1, 2))
        scale = np.maximum(np.hypot(fx, fy).reshape(len(im), -1).max(1), 1e-12)[:, None]
        p = np.repeat(np.asarray(start, float)[None], len(im), 0)
        rows = np.arange(len(im))[:, None]
        for _ in range(rounds):
            ix, iy = (np.clip(np.round(p[..., k]).astype(int), 0, m - 1) for k, m in ((0, width), (1, height)))
            f = np.stack([fx[rows, iy, ix], fy[rows, iy, ix]], -1) / scale[..., None]
            p = np.einsum("ij,njk->nik", inverse, gamma * p + f)
            p = np.clip(p, 0, [width - 1, height - 1])
        return p.reshape(len(im), -1)

    return _map(df, width, height, run, "array<double>", "points")


def project_axes(df: DataFrame, mean: np.ndarray, axes: np.ndarray) -> DataFrame:
    """Principal components: axes (v - mean). Mean and axes come from gaussians.principal_axes."""
    return df.withColumn("v", vectors(lambda x: (x - mean) @ np.asarray(axes).T, "array<double>", "v"))


def rebuild(df: DataFrame, mean: np.ndarray, axes: np.ndarray) -> DataFrame:
    """Back from components to pixels."""
    return df.withColumn("v", vectors(lambda x: x @ np.asarray(axes) + mean, "array<double>", "v"))
