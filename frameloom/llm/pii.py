"""Personal data by fixed patterns and a skip-chain conditional random field.

The patterns give the base spans (email, ip, card, phone). The field adds spans where a document repeats or nearly repeats
what a base span holds in a form that no pattern takes: its nodes are tokens that carry digits or "@" or share a key with a
labelled token, neighbours are joined by chain edges and tokens with a common key, however far apart, by skip edges. Loopy
belief propagation with the base spans as evidence then settles on consistent labels for the document.

All potentials are learned. Repeats that no pattern takes have no labels to learn from, so they are held back on purpose: each
training text is read with further uses of what its spans hold, in other forms, whose labels are known but whose evidence
is hidden, and with decoys of the same shape that repeat nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, small_batches, tidy

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"\S+")
_NO_ALNUM = re.compile(r"[^0-9a-z]")

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if k & 1:
            n = 2 * n - 9 * (n > 4)
        total += n
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind, in linear time; a match that fails its test is dropped."""
    out: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > done and text[lo - 1] in _LOCAL:
            lo -= 1
        m = _DOMAIN.match(text, at + 1) if lo < at else None
        if m:
            out.append((lo, 0, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(done, at + 1))
    # a part of over 255 or a run that goes on with digits before it can't start a match any further right
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (g.lstrip("0") or "0" for g in m.groups())):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = "".join(c for c in m[0] if c not in " -")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGIT.findall(m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def keys(token: str) -> list[str]:
    """What makes two tokens alike: letters and digits without case, an address's name, the last seven digits."""
    low = token.lower()
    out = []
    for x in {low, low.partition("@")[0]}:
        x = _NO_ALNUM.sub("", x)
        if len(x) >= 6:
            out.append(x)
    digits = "".join(c for c in low if "0" <= c <= "9")
    if len(digits) >= 7:
        out.append("#" + digits[-7:])
    return out


#: Unary features: shape of the token, and whether a base span of each kind covers it.
N_SHAPE, N_LABELS = 18, 5
O = N_LABELS - 1  # noqa: E741


def shape(token: str) -> list[float]:
    digits = sum("0" <= c <= "9" for c in token)
    letters = sum(c.isalpha() for c in token)
    body = token.strip(".,;:!?\"'()[]")
    parts = body.split(".")
    quad = len(parts) == 4 and all(p.isdigit() and p.isascii() for p in parts)
    plain = "".join(c for c in token if c not in " -")
    return [
        1.0,
        float("@" in token),
        float("@" in token and "." in token.partition("@")[2]),
        float(digits == 0),
        float(0 < digits <= 3),
        float(3 < digits <= 6),
        float(6 < digits <= 11),
        float(11 < digits <= 19),
        float(digits > 19),
        float(letters > 0 and digits > 0),
        float(letters > 6),
        float(quad),
        float(quad and all(len(p) <= 3 and int(p) <= 255 for p in parts)),
        float(token[:1] == "+"),
        float("(" in token or ")" in token),
        float("-" in token and digits >= 6),
        float("=" in token or '"' in token),
        float(12 <= digits <= 19 and plain.isdigit() and plain.isascii() and luhn(plain)),
    ]


class Graph:
    """Nodes, edges and evidence of one document."""

    def __init__(self, text: str, base: list[Span]):
        self.text, self.base = text, base
        tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
        starts = [t[0] for t in tokens]
        label: dict[int, int] = {}
        for lo, kind, hi in reversed(base):
            k = int(np.searchsorted(starts, lo, side="right")) - 1
            while k < len(tokens) and tokens[k][0] < hi:
                label[k] = kind
                k += 1
        wanted = {key for k in label for key in keys(text[slice(*tokens[k])])}
        found: dict[int, list[str]] = {}
        for k, (lo, hi) in enumerate(tokens):
            token = text[lo:hi]
            if k in label or "@" in token or _DIGIT.search(token):
                found[k] = keys(token)
            elif wanted and hi - lo >= 6 and (own := [x for x in keys(token) if x in wanted]):
                found[k] = own
        self.index = sorted(found)
        place = {k: n for n, k in enumerate(self.index)}
        self.spans = [tokens[k] for k in self.index]
        self.evidence = np.array([label.get(k, -1) for k in self.index], np.int64)
        self.shapes = np.array([shape(text[lo:hi]) for lo, hi in self.spans]).reshape(len(self.index), N_SHAPE)
        self.chain = [(place[k], place[k + 1]) for k in self.index if k + 1 in place]
        last: dict[str, int] = {}
        skips = set()
        for n, k in enumerate(self.index):  # each use of a key is joined with the one before it: as many edges as uses
            for key in found[k]:
                if key in last and n - last[key] > 0:
                    skips.add((last[key], n))
                last[key] = n
        self.skips = sorted(skips - set(self.chain))


class Crf:
    """Unary weights (label x feature), chain potentials (left, right) and symmetric skip potentials."""

    def __init__(self, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.unary, self.chain, self.skip = unary, chain, skip

    def marginals(self, g: Graph, rounds: int = 20, tolerance: float = 1e-4) -> np.ndarray:
        """Label probabilities of each node by damped loopy sum-product; nodes with evidence keep their label."""
        own = g.shapes @ self.unary.T
        known = g.evidence >= 0
        own[known] = -50.0
        own[known, g.evidence[known]] = 0.0
        edges = [(a, b, self.chain) for a, b in g.chain] + [(a, b, self.skip) for a, b in g.skips]
        if not edges:
            return _normal(own)
        a, b = np.array([e[0] for e in edges]), np.array([e[1] for e in edges])
        potential = np.stack([e[2] for e in edges])
        to_b, to_a = np.zeros((len(edges), N_LABELS)), np.zeros((len(edges), N_LABELS))
        for _ in range(rounds):
            belief = own.copy()
            np.add.at(belief, b, to_b)
            np.add.at(belief, a, to_a)
            new_b = _log_normal(_log_sum((belief[a] - to_a)[:, :, None] + potential, 1))
            new_a = _log_normal(_log_sum((belief[b] - to_b)[:, None, :] + potential, 2))
            change = max(np.abs(new_b - to_b).max(), np.abs(new_a - to_a).max())
            to_b, to_a = 0.5 * (to_b + new_b), 0.5 * (to_a + new_a)
            if change < tolerance:
                break
        belief = own.copy()
        np.add.at(belief, b, to_b)
        np.add.at(belief, a, to_a)
        return _normal(belief)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def _log_normal(x: np.ndarray) -> np.ndarray:
    return x - _log_sum(x, 1)[:, None]


def _normal(x: np.ndarray) -> np.ndarray:
    return np.exp(_log_normal(x))


_TURN = str.maketrans("0123456789abcdefghijklmnopqrstuvwxyz", "3916402857mkqwxzbvtylcjhpfgdsnraueoi")


def _again(kind: int, held: str) -> str | None:
    """What a span holds, in a form that no pattern takes: an address's name, or digits cut another way."""
    if kind == 0:
        name = held.partition("@")[0]
        return name if len(_NO_ALNUM.sub("", name.lower())) >= 6 else None
    digits = "".join(c for c in held if "0" <= c <= "9")
    if len(digits) < 7:
        return None
    return {1: "/".join(held.split(".")), 2: "-".join([digits[:-8], digits[-8:]])[-9:], 3: f"{digits[-10:-7]}-{digits[-7:-4]}-{digits[-4:]}".lstrip("-")}[kind]


def taught(g: Graph) -> tuple[Graph, np.ndarray]:
    """The document with a further use and a decoy for each span that has one, and the true labels of all its nodes; the further uses
    stand behind the text, in the order of the spans, so their neighbours tell nothing."""
    parts, truth, at = [g.text], {}, len(g.text)
    for lo, kind, hi in g.base:
        form = _again(kind, g.text[lo:hi])
        if form:
            for word, label in ((form, kind), (form.lower().translate(_TURN), O)):
                parts.append(f" and {word}")
                truth[at + 5] = label
                at += 5 + len(word)
    whole = "".join(parts)
    big = Graph(whole, [b for b in base_spans(whole) if b[2] <= len(g.text)])
    label = np.where(big.evidence >= 0, big.evidence, O)
    for n, (lo, _) in enumerate(big.spans):
        if lo in truth:
            label[n] = truth[lo]
    return big, label


def training_rows(g: Graph) -> np.ndarray:
    """Per node of the document with its held-back repeats: label, shape, and how many neighbours of each label it has to the left, to
    the right and by skip edges."""
    g, label = taught(g)
    near = np.zeros((len(label), 3 * N_LABELS))
    for a, b in g.chain:
        near[b, label[a]] += 1
        near[a, N_LABELS + label[b]] += 1
    for a, b in g.skips:
        near[a, 2 * N_LABELS + label[b]] += 1
        near[b, 2 * N_LABELS + label[a]] += 1
    return np.column_stack([label, g.shapes, near])


def fit(rows: np.ndarray, rounds: int = 600, l2: float = 1e-4) -> Crf:
    """Maximum pseudo-likelihood. Half of the nodes are learned from their neighbours alone, so that shape isn't all that counts."""
    if not len(rows):
        return Crf(np.tile(np.eye(N_LABELS)[O][:, None], (1, N_SHAPE)), np.zeros((N_LABELS, N_LABELS)), 2 * np.eye(N_LABELS))
    y, x = rows[:, 0].astype(np.int64), rows[:, 1:].copy()
    blind = np.arange(len(x)) % 2 == 1
    x[blind, 1:N_SHAPE] = 0
    truth = np.eye(N_LABELS)[y]
    share = (1 / np.sqrt(np.bincount(y, minlength=N_LABELS).clip(1)))[y]
    share /= share.sum()
    w = np.zeros((N_LABELS, x.shape[1]))
    left, right, skip = (slice(N_SHAPE + k * N_LABELS, N_SHAPE + (k + 1) * N_LABELS) for k in range(3))
    m = s = np.zeros_like(w)
    for t in range(1, rounds + 1):
        grad = (share[:, None] * (_normal(x @ w.T) - truth)).T @ x + l2 * w
        # both ends of an edge share its potential: one matrix for the chain, a symmetric one for skip edges
        chain = (grad[:, left].T + grad[:, right]) / 2
        grad[:, left], grad[:, right], grad[:, skip] = chain.T, chain, (grad[:, skip] + grad[:, skip].T) / 2
        m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad**2
        w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return Crf(w[:, :N_SHAPE], w[:, right], w[:, skip])


def find_spans(text: str, crf: Crf, least: float = 0.9) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans: base ones and those that the field adds. Every text with a token to label goes through the field; a
    token without evidence is added where its label has a probability of `least` and a path of skip edges leads to evidence: what
    stands alone is for the patterns to judge."""
    base = base_spans(text)
    g = Graph(text, base)
    free = g.evidence < 0
    if not free.any():
        return base, base
    p = crf.marginals(g)
    linked = ~free
    while True:
        more = linked.copy()
        for a, b in g.skips:
            more[a] |= more[b]
            more[b] |= more[a]
        if (more == linked).all():
            break
        linked = more
    best = p[:, :O].argmax(1)
    added: list[list[int]] = []
    for n in np.flatnonzero(free & linked & (p[np.arange(len(p)), best] >= least)):
        lo, hi = g.spans[n]
        while lo < hi and text[lo] in ".,;:!?\"'()[]<>":
            lo += 1
        while hi > lo and text[hi - 1] in ".,;:!?\"'()[]<>":
            hi -= 1
        if hi > lo and not any(b[0] < hi and lo < b[2] for b in base):
            if added and added[-1][1] == best[n] and text[added[-1][2] : lo].isspace():
                added[-1][2] = hi
            else:
                added.append([lo, int(best[n]), hi])
    return base, sorted([*base, *(tuple(a) for a in added)])


def write_spans(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{lo}:{hi}" for lo, kind, hi in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its (first) kind in brackets."""
    out, done = [], 0
    for lo, kind, hi in spans:
        if lo >= done:
            out += [text[done:lo], f"[{KINDS[kind].upper()}]"]
        done = max(done, hi)
    return "".join([*out, text[done:]])


def _suspects(texts: pa.Array) -> list[int]:
    return np.flatnonzero(pc.match_substring_regex(texts.cast(pa.string()), "[0-9@]").fill_null(False).to_numpy(zero_copy_only=False)).tolist()


def train(docs: DataFrame, most: int = 2000) -> Crf:
    """Learns from the base spans of at most `most` documents that have any, chosen by a hash of their text, and from all nodes of
    each of them, so the driver holds as many rows as these documents have nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            order, rows = [], []
            for k in _suspects(texts):
                text = texts[k].as_py()
                if base := base_spans(text):
                    order.append(hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest())
                    rows.append(training_rows(Graph(text, base)).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(order, pa.string()), pa.array(rows, pa.binary())], names=["order", "rows"])

    small_batches(docs.sparkSession)
    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), "order string, rows binary")
    found = found.orderBy("order").limit(most).toArrow().column("rows").to_pylist()
    return fit(np.concatenate([np.zeros((0, 1 + N_SHAPE + 3 * N_LABELS)), *(np.frombuffer(r, np.float32).reshape(-1, 1 + N_SHAPE + 3 * N_LABELS) for r in found)]))


def personal_data(docs: DataFrame, most: int = 2000) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, spans (all) and n_added of each document's whole text.

    Null and empty texts have no spans; null ids, ties and repeated rows are rows like all others; other columns are ignored;
    no rows give no rows. Places count code points.
    """
    crf = train(docs, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            texts = batch.column("text")
            counts = np.zeros((5, len(texts)), np.int64)
            digest, spans = [nothing] * len(texts), [""] * len(texts)
            for k in _suspects(texts):
                base, every = find_spans(texts[k].as_py(), crf)
                for _, kind, _ in base:
                    counts[kind, k] += 1
                counts[4, k] = len(every) - len(base)
                digest[k], spans[k] = hashlib.sha256(write_spans(base).encode()).hexdigest(), write_spans(every)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *map(pa.array, counts[:4]), pa.array(digest, pa.string()), pa.array(spans, pa.string()), pa.array(counts[4])],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redact_documents(docs: DataFrame, most: int = 2000) -> DataFrame:
    """docs with all spans replaced by their kind, and n_chars, if there is such a column, counted anew for texts that change."""
    crf = train(docs, most)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            changed: list[str | None] = [None] * len(texts)
            for k in _suspects(texts):
                text = texts[k].as_py()
                if spans := find_spans(text, crf)[1]:
                    changed[k] = redact(text, spans)
            yield pa.array(changed, pa.string())
        give_back()

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    new = F.arrow_udf(run, "string")(F.col("text").cast("string"))  # null for a text that stays, so that few come back
    rows = docs.withColumn("__new", new).withColumn("text", F.coalesce("__new", F.col("text").cast("string")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        rows = rows.withColumn("n_chars", F.when(F.col("__new").isNotNull(), F.length("__new").cast(kind)).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read_table

    return personal_data(read_table(spark, sf_dir, "documents"))
