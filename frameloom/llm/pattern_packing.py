"""Best-fit packing by patterns: non-negative least squares on the length histogram, then best fit for what is left.

Only lengths decide a packing, so documents are turned into pieces (length and checksum) once and the ids never move.
The plan is made on the driver from the histogram, which has at most `capacity` rows at any corpus size. It is a short
list of runs - "ranks lo..hi of length L fill slots of sequences from s on" - and each piece finds its run by its rank.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, small_batches, tidy
from .wordpieces import documents_of_ids, word_pieces

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Each text (null: empty) as ids and a closing end_id, cut into pieces of `capacity` ids; the last may be shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for k, ids in documents_of_ids(tokenizer_path, batch, "text", end_id):
                ids = np.ascontiguousarray(ids, "<u4")
                for p, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    row.append(k)
                    piece.append(p)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], schema=schema)
        word_pieces(tokenizer_path).clear()

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), PIECES)


#: Patterns have as many pieces as keep their number under this, whatever the unit.
MOST_PATTERNS = 40_000


def how_many(units: int, most: int) -> int:
    """Number of multisets of up to `most` lengths whose sum is `units`."""
    ways = [1] + [0] * units
    for part in range(1, most + 1):  # as many as partitions into parts of at most `most`
        for u in range(part, units + 1):
            ways[u] += ways[u - part]
    return ways[units]


def patterns(units: int, most: int = 3) -> np.ndarray:
    """Every multiset of up to `most` lengths 1..units whose sum is exactly `units`, as rows of counts by length."""
    found: list[tuple[int, ...]] = []

    def extend(have: tuple[int, ...], left: int, largest: int) -> None:
        if left == 0:
            found.append(have)
        elif len(have) < most:
            for x in range(min(left, largest), 0, -1):
                if x * (most - len(have)) < left:
                    break
                extend((*have, x), left - x, x)

    extend((), units, units)
    out = np.zeros((len(found), units + 1))
    for k, one in enumerate(found):
        for x in one:
            out[k, x] += 1
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """x >= 0 with a.T @ x close to b in least squares (a: pattern x length), by active sets (Lawson and Hanson, 1974): at most as
    many patterns as there are lengths are used, so their counts are large and little is lost when they are rounded. It ends after
    `rounds` steps, one for each length and 128 at most by default, with a fit that is not the best yet but good to round."""
    x, active = np.zeros(a.shape[0]), []
    rest = b.astype(float)
    least = 1e-9 * max(np.abs(b).max(initial=0), 1e-300)
    for _ in range(rounds or min(a.shape[1], 128)):
        pull = a @ rest
        pull[active] = -np.inf
        k = int(pull.argmax())
        if pull[k] <= least:
            break
        active.append(k)
        while active:
            part = a[active]
            best = np.linalg.solve(part @ part.T + 1e-9 * np.eye(len(active)), part @ b)
            if best.min() > 0:
                x[active] = best
                break
            now = x[active]
            low = best <= 0
            step = (now[low] / np.maximum(now[low] - best[low], 1e-300)).min()
            x[active] = now + step * (best - now)
            gone = [p for p in active if x[p] <= 1e-12]
            x[gone] = 0
            active = [p for p in active if p not in set(gone)]
        rest = b - a[active].T @ x[active] if active else b.astype(float)
        if rest @ rest <= 1e-6 * (b @ b):
            break
    return x


class _Run:
    """`count` equal sequences with `room` left; `was` and `put` (length, how many) tell what they hold."""

    __slots__ = ("count", "put", "room", "was")

    def __init__(self, room: int, count: int, was: _Run | None = None, put: tuple[int, int] | None = None):
        self.room, self.count, self.was, self.put = room, count, was, put


Plan = tuple[list[tuple[int, int, int, int, int, int]], int]


def plan(histogram: dict[int, int], capacity: int = 4096, unit: int | None = None, sand: int = 128, most: int = 6) -> Plan:
    """Runs (length, first rank, last rank + 1, first sequence, pieces a sequence, offset) that place every piece once, and the number of sequences.

    Lengths are rounded up to `unit` (or, if that doesn't divide the capacity, the next smaller divisor) and fitted by patterns of up to
    `most` pieces, whose counts are rounded to the nearest; lengths of up to `sand` and all that rounding leaves over are packed largest
    first into the fullest sequence with room, those of the patterns included. Coarse units allow patterns of many pieces, fine ones waste
    less room: without a unit, plans with 64, 128 and 256 units are made, and the one with the fewest sequences counts.
    """
    if unit:
        return _planned(histogram, capacity, unit, sand, most)
    plans = [_planned(histogram, capacity, max(1, capacity // units), sand, most) for units in (64, 128, 256)]
    return min(plans, key=lambda p: p[1])


def _planned(histogram: dict[int, int], capacity: int, unit: int, sand: int, most: int) -> Plan:
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    runs: list[_Run] = []
    if left[capacity]:
        runs.append(_Run(0, int(left[capacity]), _Run(capacity, 0), (capacity, 1)))
        left[capacity] = 0
    by_room: dict[int, list[_Run]] = defaultdict(list)
    if capacity % unit:
        unit = max(u for u in range(1, unit + 1) if capacity % u == 0)
    units = capacity // unit
    rounded = -(-np.arange(capacity + 1) // unit)
    goal = np.bincount(rounded[sand + 1 :], left[sand + 1 :], units + 1)
    if goal.sum() and units > 3:
        while most > 2 and how_many(units, most) > MOST_PATTERNS:
            most -= 1
        a = patterns(units, most)
        scale = max(1.0, goal.max())
        x = nnls(a, goal / scale) * scale
        for k in np.argsort(-x, kind="stable"):
            if x[k] < 0.5:
                break
            need = {int(u): int(a[k, u]) for u in np.flatnonzero(a[k])}
            again = int(min(round(x[k]), *(goal[u] // n for u, n in need.items())))  # to the nearest, as far as there are pieces
            if again < 1:
                continue
            run = [_Run(capacity, again)]
            for u, n in need.items():
                goal[u] -= n * again
                for _ in range(n):
                    run = _fill_slot(run, left, max(sand + 1, (u - 1) * unit + 1), u * unit)
            for r in run:
                by_room[r.room].append(r)
    rooms = np.zeros(capacity + 1, bool)
    rooms[[r for r in by_room if by_room[r]]] = True
    for length in range(capacity - 1, 0, -1):
        n = int(left[length])
        while n:
            room = length + int(np.argmax(rooms[length:]))
            if not rooms[room]:
                each = capacity // length
                whole, rest = divmod(n, each)
                for count, put in ((whole, each), (1, rest)):
                    if count and put:
                        new = _Run(capacity - put * length, count, _Run(capacity, 0), (length, put))
                        by_room[new.room].append(new)
                        rooms[new.room] = True
                n = 0
                continue
            run = by_room[room].pop()
            if not by_room[room]:
                rooms[room] = False
            put = min(n, room // length)
            count = min(run.count, n // put)
            new = _Run(room - put * length, count, run, (length, put))
            for r in (new, _Run(room, run.count - count, run.was, run.put) if run.count > count else None):
                if r:
                    by_room[r.room].append(r)
                    rooms[r.room] = True
            n -= put * count
    runs += [r for rs in by_room.values() for r in rs]
    used: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for r in runs:
        at, offset = r, 0
        while at is not None and at.put is not None:
            length, put = at.put
            lo = used[length]
            used[length] = lo + put * r.count
            out.append((length, lo, used[length], sequence, put, offset))
            offset += put * length
            at = at.was
        sequence += r.count
    return out, sequence


def _fill_slot(runs: list[_Run], left: np.ndarray, low: int, high: int) -> list[_Run]:
    """Gives each sequence of the runs one piece with a length from low to high, largest first."""
    out, length = [], high
    for r in runs:
        need = r.count
        while need:
            while left[length] == 0:
                length -= 1
                if length < low:
                    raise AssertionError("the histogram holds fewer pieces than the plan asks for")
            n = int(min(need, left[length]))
            left[length] -= n
            need -= n
            out.append(_Run(r.room - length, n, r if r.put else None, (length, 1)))
    return out


def best_fit_packing(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Packs every document (columns doc_id, text; others are ignored) into sequences of at most `capacity` ids.

    Returns per piece doc_id, piece, start, length, ids_crc32, sequence_id and offset. Null or empty texts are one piece
    with only end_id; null ids, ties and repeated rows are rows like all others; no rows give no rows. Ranks within a length
    are counted in blocks of a few thousand rows, so a length that a third of all rows share is split over many tasks.
    """
    spark = docs.sparkSession
    cut = checkpoint(pieces(docs, tokenizer_path, capacity, end_id).withColumn("uid", F.monotonically_increasing_id()))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs, _ = plan(counts, capacity)
    blocks = max(1, -(-sum(counts.values()) // 4000))
    cut = cut.withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(blocks)))
    before = (
        cut.groupBy("length", "block")
        .agg(F.count("*").alias("n"))
        .select("length", "block", (F.sum("n").over(Window.partitionBy("length").orderBy("block")) - F.col("n")).alias("before"))
    )
    ranked = cut.withColumn("rank", F.row_number().over(Window.partitionBy("length", "block").orderBy("uid")) - 1).join(before, ["length", "block"])
    table = sorted(runs)
    key = np.array([(r[0] << 48) + r[1] for r in table], np.int64)
    first, put, offset = (np.array([r[k] for r in table], np.int64) for k in (3, 4, 5))
    low = np.array([r[1] for r in table], np.int64)
    shared = spark.sparkContext.broadcast((key, low, first, put, offset))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, low, first, put, offset = shared.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(key, (length << 48) + rank, side="right") - 1
            turn = rank - low[at]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(first[at] + turn // put[at]), pa.array(offset[at] + turn % put[at] * length)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    rows = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    return rows.mapInArrow(tidy(place), f"{PIECES}, sequence_id long, offset long")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import read_table

    return best_fit_packing(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
