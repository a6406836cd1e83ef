"""Toxicity by a counterfactually regularised classifier.

A logistic model over hashed words and word stems. Sentences of labelled texts that name an identity group are written
again with another group of the same kind, and the squared change of the score between the two is part of the loss, so
that a group's name by itself can't carry weight and neutral mentions aren't rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, give_back, small_batches, text_slices, tidy
from .textvec import U64, hashes, raw, spans

BITS = 20
#: Byte lengths of the stems that count beside whole words.
STEMS = (4, 5, 6)
#: Identity terms by kind; a swap replaces a term by the next ones of its kind.
IDENTITIES = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "arab"),
    ("mexican", "chinese", "german", "french", "spanish", "american", "african", "indian"),
    ("immigrants", "refugees", "foreigners", "citizens"),
    ("elderly", "young", "disabled", "blind", "deaf"),
    ("frauen", "männer", "muslime", "christen", "juden", "ausländer"),
    ("mujeres", "hombres", "musulmanes", "cristianos", "judíos", "inmigrantes"),
    ("femmes", "hommes", "musulmans", "chrétiens", "juifs", "immigrés"),
)
_SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*")


class Swaps:
    """Terms by kind, and what replaces each of them: the next one and the next but one of its kind."""

    def __init__(self, identities: tuple[tuple[str, ...], ...] = IDENTITIES):
        self.after = {t: [kind[(k + j) % len(kind)] for j in (1, 2) if j < len(kind)] for kind in identities if len(kind) > 1 for k, t in enumerate(kind)}
        self.named = re.compile(r"\b(?:" + "|".join(map(re.escape, sorted(self.after, key=len, reverse=True))) + r")\b", re.IGNORECASE) if self.after else None

    def rewritten(self, sentence: str, turn: int) -> str:
        return self.named.sub(lambda m: (to := self.after[m[0].lower()])[turn % len(to)], sentence)


_SWAPS = Swaps()


def counterfactuals(text: str, swaps: Swaps = _SWAPS) -> list[tuple[str, str]]:
    """Each sentence that names a group, with its rewritings."""
    out = []
    if swaps.named and swaps.named.search(text):
        for sentence in _SENTENCE.findall(text):
            if swaps.named.search(sentence):
                out += [(sentence, swaps.rewritten(sentence, turn)) for turn in (0, 1)]
    return out


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and feature of everything that occurs in a text, once each, sorted; and the share of a row's words that has it."""
    data, off = raw(pc.utf8_lower(texts))
    start, end, row = spans(data, off, letters=True)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    words = np.bincount(row, minlength=len(texts))
    rows, found = [], []
    for h in hashes(data, start, end, STEMS):
        has = h != 0
        rows.append(row[has])
        found.append((h[has] >> U64(64 - BITS)).astype(np.int64))
    both = np.sort((np.concatenate(rows) << BITS) | np.concatenate(found))
    first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
    count = np.diff(np.append(first, len(both)))
    both = both[first]
    row = both >> BITS
    return row, both & ((1 << BITS) - 1), count / words[row]


def value(share: np.ndarray) -> np.ndarray:
    """Input of the model for a feature that this share of a text's words has: grows with the share, slowly."""
    return np.log1p(200 * share)


def _as_bytes(row: np.ndarray, found: np.ndarray, share: np.ndarray, rows: int) -> tuple[list[bytes], list[bytes]]:
    cut = np.searchsorted(row, np.arange(rows + 1))
    f, v = found.astype(np.int32), value(share).astype(np.float32)
    return [f[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], [v[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _training_rows(batches: Iterator[pa.RecordBatch], swaps: Swaps = _SWAPS) -> Iterator[pa.RecordBatch]:
    """toxic 0 or 1: a labelled text; 2 and 3: a sentence and its rewriting, one after the other."""
    for batch in batches:
        for lo, hi, texts in text_slices(batch.column("text")):
            rewritten = [t for x in texts.to_pylist() for pair in counterfactuals(x, swaps) for t in pair]
            both = pa.concat_arrays([texts, pa.array(rewritten, pa.large_string())])
            f, v = _as_bytes(*features(both), len(both))
            kind = pa.array([*batch.column("toxic").slice(lo, hi - lo).to_pylist(), *([2, 3] * (len(rewritten) // 2))], pa.int32())
            yield pa.RecordBatch.from_arrays([kind, pa.array(f, pa.binary()), pa.array(v, pa.binary())], names=["toxic", "features", "values"])


class Model:
    """Weights over the hashed features."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def score(self, texts: pa.Array) -> np.ndarray:
        row, found, share = features(texts)
        z = np.bincount(row, self.weights[found] * value(share), len(texts)) if len(row) else np.zeros(len(texts))
        return 1 / (1 + np.exp(-np.clip(z + self.bias, -30, 30)))


def _counts(found: np.ndarray, has: np.ndarray) -> np.ndarray:
    """How often each feature occurs where `has` holds, in blocks, as counting widens its input."""
    out = np.zeros(1 << BITS, np.int64)
    for lo in range(0, len(found), 1 << 18):
        out += np.bincount(found[lo : lo + (1 << 18)][has[lo : lo + (1 << 18)]], minlength=1 << BITS)
    return out


def fit(label: np.ndarray, size: np.ndarray, found: np.ndarray, v: np.ndarray, least: int = 5, most: int = 60_000, rounds: int = 250, l2: float = 3e-4, fairness: float = 1.0) -> Model:
    """Logistic regression by Adam over texts with a label and `size` features each, whose ids (int32) and values (float32) follow one another.

    Features are those of at least `least` texts that tell the classes apart best, at most `most`."""
    if not (label == 1).any() or not (label == 0).any():
        return Model(np.zeros(1 << BITS, np.float32), float(20 if (label == 1).any() else -20))
    row = np.repeat(np.arange(len(label), dtype=np.int32), size)
    n1, n0 = int((label == 1).sum()), int((label == 0).sum())
    kind = np.repeat(label.astype(np.int8), size)
    with1, with0 = _counts(found, kind == 1), _counts(found, kind == 0)
    p1, p0 = (with1 + 0.5) / (n1 + 1), (with0 + 0.5) / (n0 + 1)
    pooled = (with1 + with0 + 1) / (n1 + n0 + 2)
    tells = np.abs(p1 - p0) / np.sqrt(pooled * (1 - pooled).clip(1e-9) * (1 / n1 + 1 / n0))
    tells[with1 + with0 < least] = 0
    kept = np.argsort(-tells, kind="stable")[:most]
    kept = kept[tells[kept] > 2.5]
    named = np.flatnonzero(_counts(found, kind >= 2))
    kept = np.union1d(kept, named[(with1 + with0)[named] > 0])
    place = np.full(1 << BITS, -1, np.int32)
    place[kept] = np.arange(len(kept))
    # inputs are scaled by how far a feature tells the classes apart, so that common words weigh little
    scale = np.abs(np.log(p1[kept] / p0[kept]))
    use = place[found] >= 0
    row, column, v = row[use].astype(np.int64), place[found[use]].astype(np.int64), v[use].astype(np.float64)
    v *= scale[column]
    doc = label < 2
    y, share = (label == 1).astype(float), np.where(label == 1, 0.5 / n1, np.where(label == 0, 0.5 / n0, 0.0))
    swapped = np.flatnonzero(label == 3)
    w, b = np.zeros(len(kept)), 0.0
    m = s = np.zeros(len(kept) + 1)
    for t in range(1, rounds + 1):
        z = np.bincount(row, w[column] * v, len(label)) + b
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        g = np.where(doc, share * (p - y), 0.0)
        if len(swapped):
            gap = fairness * 2 * (p[swapped] - p[swapped - 1]) / len(swapped)
            g[swapped] += gap * p[swapped] * (1 - p[swapped]) + fairness * 0.2 * (z[swapped] - z[swapped - 1]) / len(swapped)
            g[swapped - 1] -= gap * p[swapped - 1] * (1 - p[swapped - 1]) + fairness * 0.2 * (z[swapped] - z[swapped - 1]) / len(swapped)
        grad = np.append(np.bincount(column, g[row] * v, len(kept)) + l2 * w, g[doc].sum())
        m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad**2
        move = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8) * min(1, 2 - 2 * t / rounds)
        w, b = w - move[:-1], b - move[-1]
    weights = np.zeros(1 << BITS, np.float32)
    weights[kept] = w * scale
    return Model(weights, float(_threshold(np.bincount(row, w[column] * v, len(label))[doc], y[doc], b)))


def _threshold(z: np.ndarray, y: np.ndarray, b: float) -> float:
    """The bias with which a score of 0.5 errs least on the texts learned from; of equal ones the one nearest the fitted bias."""
    order = np.argsort(z, kind="stable")
    z, y = z[order], y[order]
    wrong = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([np.cumsum((1 - y)[::-1])[::-1], [0]])  # cut before i
    mid = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
    best = np.flatnonzero(wrong <= wrong.min() + 1e-9)
    return -mid[best[np.argmin(np.abs(mid[best] + b))]]


def train(docs: DataFrame, labels: DataFrame, most_each: int = 5000, fairness: float = 1.0, identities: tuple[tuple[str, ...], ...] = IDENTITIES) -> Model:
    """Learns from labelled rows outside the held-out fold: at most `most_each` of either label, chosen by a hash of doc_id,
    and all rewritten sentence pairs of each of them. `fairness` weighs the penalty on the pairs' change of score (0: none); `identities`
    are the terms by kind that are swapped.

    Rows with a null doc_id or label are left out; of several labels for an id the highest counts.
    """
    small_batches(docs.sparkSession)
    swaps = Swaps(identities)
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null")
    ids = ids.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64(F.col("doc_id"), F.lit(7))
    chosen = None
    for kind in (0, 1):
        part = ids.where(F.col("toxic") == kind).orderBy(order, "doc_id").limit(most_each)
        chosen = part if chosen is None else chosen.union(part)
    chosen = checkpoint(chosen).select(F.col("doc_id").alias("d"), "toxic")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("d")).select("toxic", "text")  # at most 2 * most_each ids
    table = rows.mapInArrow(tidy(lambda batches: _training_rows(batches, swaps)), "toxic int, features binary, values binary").toArrow()
    label, size = table.column("toxic").to_numpy(), pc.binary_length(table.column("features")).to_numpy().astype(np.int64) // 4
    found, values = _joined(table.column("features"), np.int32), _joined(table.column("values"), np.float32)
    del table
    give_back()
    model = fit(label, size, found, values, fairness=fairness)
    del found, values
    give_back()
    return model


def _joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """The numbers in a column of bytes, one row's after another's."""
    parts = [np.zeros(0, kind)]
    for chunk in column.chunks:
        if len(chunk) and chunk.buffers()[2] is not None:
            off = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
            parts.append(np.frombuffer(chunk.buffers()[2], np.uint8)[off[0] : off[-1]].view(kind))
    return np.concatenate(parts)


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _score(spark, model: Model):
    """A column function: the score of a whole text. Only texts go to Python, and only scores come back."""
    shared = spark.sparkContext.broadcast((model.weights, model.bias))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = Model(*shared.value)
        for column in batches:
            yield pa.array(np.concatenate([np.zeros(0), *(model.score(texts) for _, _, texts in text_slices(column))]))
        give_back()

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "double")


def toxicity_scores(docs: DataFrame, labels: DataFrame, most_each: int = 5000, fairness: float = 1.0, identities: tuple[tuple[str, ...], ...] = IDENTITIES) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= 0.5) of each row of docs.

    Only the whole text is an input, however long; texts go to Python in slices of whole texts of about 2 MB. Null and empty texts get the score of a text without words; a null id is not held out;
    repeated rows get equal scores; other columns are ignored. Without labels of both kinds all scores are that of the only
    kind there is (0 without any).
    """
    score = _score(docs.sparkSession, train(docs, labels, most_each, fairness, identities))
    out = docs.select("doc_id", score(F.col("text").cast("string")).alias("score"))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, most_each: int = 5000) -> DataFrame:
    """docs without the rows whose score is 0.5 or more; all columns stay, whatever their names. Null and empty texts have the score of a text
    without words, rows with a null id are scored like others, repeated rows stay or go together, an empty table stays empty."""
    score = _score(docs.sparkSession, train(docs, labels, most_each))
    return docs.where(score(F.col("text").cast("string")) < 0.5)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read_table

    return toxicity_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
