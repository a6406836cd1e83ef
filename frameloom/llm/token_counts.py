"""Edit-aware token counts: a segment tree over each document's pre-tokens, re-encoded only where edits touch the text.

Byte-level BPE never merges across pre-tokens, so a text's token count is the sum over its pre-tokens, and the pattern that
cuts them only looks ahead. After an edit the cut is therefore made anew from a pre-token that ends a few characters
before the edit (boundary context) until a cut falls together with an old one behind it; only those pre-tokens are encoded,
and the sums on the way from their leaves to the root are updated.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, tidy

#: The cut of a pre-token is decided by at most so many characters behind its end ("'ll" and one character of look-ahead).
CONTEXT = 3


class Counts(dict):
    """Token counts of pre-tokens, filled as they are asked for; forgets all when it holds too many."""

    def __init__(self, path: str, pattern: str, most: int = 600_000):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("pre-tokens", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.cut, self.most = regex.compile(pattern), most
        self.encoded = 0

    def __missing__(self, piece: str) -> int:
        if len(self) >= self.most:
            self.clear()
        n = self[piece] = len(self.encoding.encode_ordinary(piece))
        return n


class Tree:
    """Segment tree with a slot per pre-token of the text it was built from. A slot holds the (characters, tokens) of its
    pre-tokens now: one at first, more or none after edits. `sums` has characters and tokens of every subtree."""

    def __init__(self, text: str, counts: Counts, leaves: tuple[np.ndarray, np.ndarray] | None = None):
        """Built by cutting and counting the text, or from the characters and tokens of its pre-tokens, as `stored` gave them."""
        self.text, self.counts = text, counts
        pieces = counts.cut.findall(text) if leaves is None else leaves[0]
        n = len(pieces)
        self.leaves = 1 << max(0, n - 1).bit_length()
        self.sums = np.zeros((2 * self.leaves, 2), np.int64)
        if n:
            self.sums[self.leaves : self.leaves + n, 0] = np.fromiter(map(len, pieces), np.int64, n) if leaves is None else leaves[0]
            self.sums[self.leaves : self.leaves + n, 1] = np.fromiter(map(counts.__getitem__, pieces), np.int64, n) if leaves is None else leaves[1]
        level = self.leaves
        while level > 1:
            self.sums[level // 2 : level] = self.sums[level : 2 * level : 2] + self.sums[level + 1 : 2 * level : 2]
            level //= 2
        self.changed: dict[int, list[tuple[int, int]]] = {}
        self.recounted = 0

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def stored(self) -> tuple[np.ndarray, np.ndarray]:
        """Characters and tokens of all pre-tokens, in order."""
        if not self.changed:
            held = self.sums[self.leaves :]
            held = held[held[:, 0] > 0]
            return held[:, 0], held[:, 1]
        held = np.array([p for k in range(self.leaves) for p in self.slot(k)], np.int64).reshape(-1, 2)
        return held[:, 0], held[:, 1]

    def slot(self, k: int) -> list[tuple[int, int]]:
        """Pre-tokens of slot k."""
        if k in self.changed:
            return self.changed[k]
        one = self.sums[self.leaves + k]
        return [(int(one[0]), int(one[1]))] if one[0] else []

    def find(self, at: int) -> tuple[int, int]:
        """The slot with character `at`, or the last that has any, and where it starts."""
        k, start = 1, 0
        at = min(at, int(self.sums[1, 0]) - 1)
        while k < self.leaves:
            k *= 2
            if start + self.sums[k, 0] <= at:
                start += int(self.sums[k, 0])
                k += 1
        return k - self.leaves, start

    def put(self, k: int, pieces: list[tuple[int, int]]) -> None:
        self.changed[k] = pieces
        k += self.leaves
        self.sums[k] = [sum(p[0] for p in pieces), sum(p[1] for p in pieces)]
        k //= 2
        while k:
            self.sums[k] = self.sums[2 * k] + self.sums[2 * k + 1]
            k //= 2

    def edit(self, at: int, drop: int, put: str) -> None:
        """Replaces `drop` characters from `at` by `put`; both ends are kept within the text."""
        size = len(self.text)
        at = min(max(at, 0), size)
        drop = min(max(drop, 0), size - at)
        text = self.text[:at] + put + self.text[at + drop :]
        shift, new_end = len(put) - drop, at + len(put)
        if not size:
            self.__init__(text, self.counts)
            self.recounted += len(self.counts.cut.findall(text))
            return
        first, start = self.find(max(0, at - CONTEXT))
        while start > max(0, at - CONTEXT) - 1 and start > 0:  # a slot that ends before the context
            first, start = self.find(start - 1)
        # cut anew until a cut meets an old one behind the edit
        k, old = first, start
        here, pieces = start, []
        ends: list[int] = []
        behind = self.slot(k)
        inner = 0
        while here < len(text):
            while old + shift < here or old < at + drop:  # the next old cut that could be met
                if inner < len(behind):
                    old += behind[inner][0]
                    inner += 1
                elif k + 1 < self.leaves:
                    k += 1
                    behind, inner = self.slot(k), 0
                else:
                    break
            if here >= new_end and old >= at + drop and old + shift == here:
                break
            end = self.counts.cut.match(text, here).end()
            pieces.append((end - here, self.counts[text[here:end]]))
            ends.append(end)
            here = end
        else:
            k, behind, inner = self.leaves - 1, [], 0
        self.recounted += len(pieces)
        self.text = text
        if inner == 0 and here < len(text):  # the cut that was met is the start of slot k
            kept, last = [], k - 1
        else:
            kept, last = behind[inner:], k
        for j in range(first + 1, last + 1):
            if self.sums[self.leaves + j, 0]:
                self.put(j, [])
        if last >= first:
            self.put(first, pieces + kept)
        else:  # nothing to replace but an insertion in front of slot k
            self.put(k, pieces + self.slot(k))


def count_with_edits(docs: DataFrame, edits: str, tokenizer_path: str, pattern: str) -> DataFrame:
    """Token counts of each text before and after its edits, which the column `edits` lists: array<struct<at, drop, put>>.

    Edits are made one after the other; `at` counts code points of the text as it then is, and places outside of it are moved
    to its ends. Returns doc_id, n_tokens, n_edits, n_tokens_edited, n_pretokens, n_recounted (pre-tokens encoded for the
    edits). A null text is empty, null edits are none, a null `put` is empty; null ids and repeated rows are rows like all
    others; other columns are ignored; no rows give no rows. Nothing is shuffled, and a task holds one document's tree.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _counts(tokenizer_path, pattern)
        for batch in batches:
            out: list[list[int]] = [[], [], [], [], []]
            for text, changes in zip(batch.column("text"), batch.column("edits"), strict=True):
                tree = Tree(text.as_py() or "", counts)
                before, pretokens = tree.tokens, int((tree.sums[tree.leaves :, 0] > 0).sum())
                recounted, changes = 0, changes.as_py() or []
                for e in changes:
                    tree.recounted = 0
                    tree.edit(e["at"] or 0, e["drop"] or 0, e["put"] or "")
                    recounted += tree.recounted
                for c, v in zip(out, (before, len(changes), tree.tokens, pretokens, recounted), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in out)], names=["doc_id", "n_tokens", "n_edits", "n_tokens_edited", "n_pretokens", "n_recounted"])
        counts.clear()

    small_batches(docs.sparkSession)
    kind = "array<struct<at:long,drop:long,put:string>>"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(edits).cast(kind).alias("edits"))
    return rows.mapInArrow(tidy(run), "doc_id long, n_tokens long, n_edits long, n_tokens_edited long, n_pretokens long, n_recounted long")


TREES = "doc_id long, text string, sizes array<int>, tokens array<int>, n_tokens long, n_recounted long"


def _trees(rows: DataFrame, tokenizer_path: str, pattern: str, build) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _counts(tokenizer_path, pattern)
        for batch in batches:
            for row in range(batch.num_rows):  # one tree at a time
                one = batch.slice(row, 1)
                tree = build(one, counts)
                sizes, tokens = tree.stored()
                lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x.astype(np.int32))) for x in (sizes, tokens)]
                yield pa.RecordBatch.from_arrays([one.column("doc_id"), pa.array([tree.text]), *lists, pa.array([tree.tokens]), pa.array([tree.recounted], pa.int64())], names=["doc_id", "text", "sizes", "tokens", "n_tokens", "n_recounted"])
        counts.clear()

    small_batches(rows.sparkSession)
    return rows.mapInArrow(tidy(run), TREES)


def token_trees(docs: DataFrame, tokenizer_path: str, pattern: str) -> DataFrame:
    """The leaves of each document's tree, to be stored: doc_id, text, sizes and tokens of its pre-tokens, n_tokens, n_recounted (0). A null
    text is empty; null ids and repeated rows are rows like all others; other columns are ignored."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _trees(rows, tokenizer_path, pattern, lambda one, counts: Tree(one.column("text")[0].as_py() or "", counts))


def edit_trees(trees: DataFrame, edits: str, tokenizer_path: str, pattern: str) -> DataFrame:
    """Stored trees after the edits in column `edits` (array<struct<at, drop, put>>): the same columns, to be stored again. Sums are added up
    from the stored leaves; only the pre-tokens that an edit touches are cut and encoded, and n_recounted says how many."""
    from pyspark.sql.functions import col

    def build(one: pa.RecordBatch, counts: Counts) -> Tree:
        leaves = tuple(one.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("sizes", "tokens"))
        tree = Tree(one.column("text")[0].as_py() or "", counts, leaves)
        for e in one.column("edits")[0].as_py() or []:
            tree.edit(e["at"] or 0, e["drop"] or 0, e["put"] or "")
        return tree

    rows = trees.select("doc_id", "text", "sizes", "tokens", col(edits).cast("array<struct<at:long,drop:long,put:string>>").alias("edits"))
    return _trees(rows, tokenizer_path, pattern, build)


_COUNTS: dict[tuple[str, str], Counts] = {}


def _counts(path: str, pattern: str) -> Counts:
    if (path, pattern) not in _COUNTS:
        _COUNTS[path, pattern] = Counts(path, pattern)
    return _COUNTS[path, pattern]


def sample_edits(text):
    """Four edits that depend on the text's length alone: a replacement, two insertions and a deletion."""
    n = F.length(F.coalesce(text, F.lit(""))).cast("long")
    edit = lambda at, drop, put: F.struct(at.cast("long").alias("at"), drop.cast("long").alias("drop"), F.lit(put).alias("put"))
    return F.array(edit(F.floor(n / 3), F.lit(5), "edited 42"), edit(F.floor(n * 2 / 3), F.lit(0), " it's new"), edit(n, F.lit(0), "?"), edit(F.floor(n / 2), F.lit(3), ""))


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import read_table, tidy

    docs = read_table(spark, sf_dir, "documents").withColumn("edits", sample_edits(F.col("text")))
    return count_with_edits(docs, "edits", public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
