"""Gaussian codebooks and mixtures: training by sufficient statistics, scores as matrix products over batches of frames.

A frame is a row with a vector `v` and a `label` (its class). A codebook has one row per class and dimension; it is a model,
whose size doesn't depend on the data, so it is collected and sent to every task. Frames are read once and never exploded.
Null labels form no class; frames that are null or hold a null are left out of training and get null scores.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batch import sums, vectors

#: Occupancy up to which a Gaussian isn't updated, padding of mixture weights, and floor of variances.
LEAST_OCCUPANCY, PADDING, FLOOR = 5.0, 1e-4, 1e-4


def long_frames(df: DataFrame, key: str = "frame_x", label: str = "label") -> DataFrame:
    return df.select(key, label, F.posexplode("v").alias("dim", "x"))


def _whole(df: DataFrame) -> DataFrame:
    return df.where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()))


def statistics(df: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """Occupancy, sums and squares of the vectors of each group: (keys, occ, first, second), summed batch by batch."""
    columns = [*keys, "v", *([weight] if weight else [])]

    def run(rows: dict) -> np.ndarray:
        x = rows["v"]
        w = rows[weight] if weight else np.ones(len(x))
        return np.concatenate([[w.sum()], w @ x, w @ x**2])

    n = (F.size("s") - 1) / 2
    return sums(_whole(df).select(*columns), keys, run).select(*keys, F.col("s")[0].alias("occ"), F.slice("s", 2, n.cast("int")).alias("first"), F.slice("s", (n + 2).cast("int"), n.cast("int")).alias("second"))


def codebook(df: DataFrame, floor: float = FLOOR, least: float = LEAST_OCCUPANCY, previous: DataFrame | None = None) -> DataFrame:
    """Maximum-likelihood means and floored variances: (label, dim, occ, mu, var). A class whose occupancy isn't above `least` keeps
    its row of `previous`, or has none."""
    acc = statistics(df.where("label is not null"), ["label"]).where(F.col("occ") > least)
    rows = acc.select("label", "occ", F.posexplode(F.arrays_zip("first", "second")).alias("dim", "z"))
    mu = F.col("z.first") / F.col("occ")
    new = rows.select("label", "dim", F.col("occ").cast("long").alias("occ"), mu.alias("mu"), F.greatest(F.col("z.second") / F.col("occ") - mu * mu, F.lit(floor)).alias("var"))
    if previous is None:
        return new
    return new.unionByName(previous.join(new.select("label").distinct(), "label", "left_anti").select(*new.columns))


class Book:
    """A codebook on the driver: classes, means and variances as matrices (class x dimension), and weights."""

    def __init__(self, classes: list, mu: np.ndarray, var: np.ndarray, weights: np.ndarray | None = None):
        self.classes, self.mu, self.var = classes, mu, var
        self.weights = np.ones(len(classes)) if weights is None else weights
        self.constant = (np.log(var).sum(1) + var.shape[1] * math.log(2 * math.pi)) / 2

    def scores(self, x: np.ndarray) -> np.ndarray:
        """-ln of each Gaussian's density (frame x class)."""
        y = 1 / self.var
        d = (x**2) @ y.T - 2 * x @ (self.mu * y).T + (self.mu**2 * y).sum(1)
        return d / 2 + self.constant


def collect_book(book: DataFrame, weights: DataFrame | None = None) -> Book:
    rows = book.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("dim", "mu", "var"))).alias("d")).orderBy("label").collect()
    classes = [r["label"] for r in rows]
    shares = {r["class"]: r["weight"] for r in weights.collect()} if weights is not None else {}
    matrix = lambda f: np.array([[d[f] for d in r["d"]] for r in rows])
    return Book(classes, matrix("mu"), matrix("var"), np.array([shares.get(c, 0.0) for c in classes]) if shares else None)


def _sent(df: DataFrame, book: Book):
    return df.sparkSession.sparkContext.broadcast(book)


def scores(df: DataFrame, book: Book) -> DataFrame:
    """df with `scores`: -ln of the density of each class's Gaussian, in the order of book.classes."""
    sent = _sent(df, book)
    return df.withColumn("scores", vectors(lambda x: sent.value.scores(x), "array<double>", "v"))


def best(df: DataFrame, book: Book) -> DataFrame:
    """df with the place `at` of the class with the least score, of equal ones the first, and that `score`."""
    sent = _sent(df, book)

    def run(x: np.ndarray) -> dict:
        s = sent.value.scores(x)
        at = s.argmin(1)
        return {"at": at.astype(np.int32), "score": s[np.arange(len(s)), at]}

    out = df.withColumn("__b", vectors(run, "at int, score double", "v"))
    names = F.array(*(F.lit(c) for c in book.classes))
    return out.withColumn("class", F.get(names, F.col("__b.at"))).withColumn("score", F.col("__b.score")).drop("__b")


def _weighted(book: Book, x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return book.scores(x) - np.log(book.weights)


def mixture(df: DataFrame, book: Book) -> DataFrame:
    """df with `score` = -ln sum of weight * density, the least term taken out first."""
    sent = _sent(df, book)

    def run(x: np.ndarray) -> np.ndarray:
        s = _weighted(sent.value, x)
        low = s.min(1)
        return low - np.log(np.exp(low[:, None] - s).sum(1))

    return df.withColumn("score", vectors(run, "double", "v"))


def posteriors(df: DataFrame, book: Book) -> DataFrame:
    """df with `p`: the share of each Gaussian of the mixture, in the order of book.classes."""
    sent = _sent(df, book)

    def run(x: np.ndarray) -> np.ndarray:
        s = _weighted(sent.value, x)
        e = np.exp(s.min(1, keepdims=True) - s)
        return e / e.sum(1, keepdims=True)

    return df.withColumn("p", vectors(run, "array<double>", "v"))


def mixture_weights(df: DataFrame, padding: float = PADDING) -> DataFrame:
    """(n + padding) over the sum of the same, per class: (class, weight)."""
    n = df.where("label is not null").groupBy(F.col("label").alias("class")).agg(F.count("*").alias("n"))
    return n.select("class", ((F.col("n") + padding) / F.sum(F.col("n") + padding).over(Window.partitionBy(F.lit(1)))).alias("weight"))


def split(book: DataFrame, shift: float = 0.2) -> DataFrame:
    """The heaviest Gaussian in two: its mean moved up and down by `shift` standard deviations, its occupancy halved; the new one
    has the label -1 - label."""
    top = book.groupBy("label").agg(F.max("occ").alias("o")).orderBy(F.desc("o"), "label").limit(1).select("label")
    old = book.join(F.broadcast(top), "label", "left_semi")
    move = F.sqrt("var") * shift
    made = lambda sign, label: old.select(label.alias("label"), "dim", (F.col("occ") / 2).cast("long").alias("occ"), (F.col("mu") + sign * move).alias("mu"), "var")
    return book.join(F.broadcast(top), "label", "left_anti").unionByName(made(1, F.col("label"))).unionByName(made(-1, -1 - F.col("label")))


def discriminative(numerator: DataFrame, denominator: DataFrame, book: DataFrame, factor: float = 2.0, floor: float = FLOOR) -> DataFrame:
    """Maximum mutual information update from statistics of the right and of the competing labels: with D = factor times the
    competing occupancy, mean (a - b + D mu) / (n - m + D) and the variance likewise."""
    side = lambda s, t: s.select("label", F.col("occ").alias(f"{t}0"), F.posexplode(F.arrays_zip("first", "second")).alias("dim", f"{t}z"))
    j = book.join(side(numerator, "n"), ["label", "dim"]).join(side(denominator, "d"), ["label", "dim"], "left")
    z = lambda c: F.coalesce(c, F.lit(0.0))
    d = F.greatest(z(F.col("d0")) * factor, F.lit(1e-9))
    n = F.col("n0") - z(F.col("d0")) + d
    mu = (F.col("nz.first") - z(F.col("dz.first")) + d * F.col("mu")) / n
    second = (F.col("nz.second") - z(F.col("dz.second")) + d * (F.col("var") + F.col("mu") * F.col("mu"))) / n
    return j.select("label", "dim", F.col("n0").cast("long").alias("occ"), mu.alias("mu"), F.greatest(second - mu * mu, F.lit(floor)).alias("var"))


def class_moments(df: DataFrame) -> DataFrame:
    """Count, sums and outer products of each class's vectors: (label, s), products summed batch by batch."""

    def run(rows: dict) -> np.ndarray:
        x = rows["v"]
        return np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])

    return sums(_whole(df).where("label is not null").select("label", "v"), ["label"], run)


def scatter_of(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """Within- and between-class scatter over the number of frames, from collected class moments."""
    within = between = None
    total, whole = 0.0, 0.0
    for r in rows:
        s = np.array(r["s"])
        d = round((-1 + math.sqrt(1 + 4 * (len(s) - 1))) / 2)
        n, first, second = s[0], s[1 : 1 + d], s[1 + d :].reshape(d, d)
        inner = np.outer(first, first) / n
        within = second - inner if within is None else within + second - inner
        between = inner if between is None else between + inner
        total, whole = total + n, whole + first
    return within / total, (between - np.outer(whole, whole) / total) / total


def scatter(df: DataFrame) -> DataFrame:
    """Within- and between-class scatter as (i, j, within, between): one row of moments per class, merged on the driver (a model)."""
    rows = class_moments(df).collect()
    if not rows:
        return df.sparkSession.createDataFrame([], "i int, j int, within double, between double")
    w, b = scatter_of(rows)
    d = len(w)
    return df.sparkSession.createDataFrame([(i, j, float(w[i, j]), float(b[i, j])) for i in range(d) for j in range(d)], "i int, j int, within double, between double")


def discriminants(df: DataFrame, keep: int) -> np.ndarray:
    """Linear discriminants (keep x dimension): whitening by the within-class scatter, then axes of the between-class scatter by falling variance."""
    w, b = scatter_of(class_moments(df).collect())
    value, axis = np.linalg.eigh(w)
    white = axis / np.sqrt(np.maximum(value, 1e-12))
    spread, turn = np.linalg.eigh(white.T @ b @ white)
    return (white @ turn[:, np.argsort(-spread)][:, :keep]).T


def principal_axes(df: DataFrame, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean, and axes (keep x dimension) of greatest variance over all vectors."""
    s = np.array(sums(_whole(df).select("v"), [], lambda r: np.concatenate([[len(r["v"])], r["v"].sum(0), (r["v"].T @ r["v"]).ravel()])).first()["s"])
    d = round((-1 + math.sqrt(1 + 4 * (len(s) - 1))) / 2)
    mean = s[1 : 1 + d] / s[0]
    value, axis = np.linalg.eigh(s[1 + d :].reshape(d, d) / s[0] - np.outer(mean, mean))
    axis = axis[:, np.argsort(-value)][:, :keep].T
    return mean, axis * np.sign(axis[np.arange(len(axis)), np.abs(axis).argmax(1)])[:, None]
