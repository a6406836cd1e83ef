"""MinHash near-duplicates with ProbMinHash: signatures of weighted shingles whose agreement is the probability Jaccard similarity.

Every shingle of a text (five words) is an element whose weight is the number of times it occurs. Its arrivals form a
Poisson process with that rate, seeded by the shingle alone; each arrival goes to a random register, which keeps the
element of its earliest arrival, and a process ends once its next arrival is later than the latest register (Ertl, 2020).
Two texts agree in a register with probability sum over shared d of 1 / sum over d' of max(a[d']/a[d], b[d']/b[d]).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, forget, small_batches, small_side, text_slices, tidy
from .graph import connected_components
from .textvec import U64, mix, shingles

#: A miss of a pair with similarity 0.8 has a chance of (1 - 0.8**ROWS)**BANDS = 3e-5, of one with 0.9 2e-10.
BANDS, ROWS = 20, 4
_GOLD = 0x9E3779B97F4A7C15


def weighted(row: np.ndarray, element: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, element) with the number of times each occurs, sorted. Elements keep 48 bits, rows have 16."""
    both = np.sort((row.astype(U64) << U64(48)) | (element >> U64(16)))
    first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(both)))
    both = both[first]
    return (both >> U64(48)).astype(np.int64), both & U64((1 << 48) - 1), count


def signatures(row: np.ndarray, element: np.ndarray, weight: np.ndarray, rows: int, registers: int) -> np.ndarray:
    """ProbMinHash of every row, interleaved over all elements of all rows: (rows, registers), zeros for a row without elements."""
    total = np.bincount(row, weight, rows) if len(row) else np.zeros(rows)
    # by this time all registers are filled with a chance of 98 %; only rows for which they aren't go through all arrivals
    soon = registers * (np.log(registers) + 4) / np.maximum(total, 1e-300)
    out = np.zeros((rows, registers), U64)
    todo = np.ones(rows, bool)
    for limit in (soon, np.full(rows, np.inf)):
        if not todo.any():
            break
        late, best = _arrivals(row, element, weight, rows, registers, np.where(todo, limit, -1.0))
        late, best = late.reshape(rows, registers), best.reshape(rows, registers)
        good = todo & (late.max(1) <= limit) & (total > 0)
        out[good] = best[good]
        todo &= ~good & (total > 0)
    return out


def _arrivals(row, element, weight, rows, registers, limit):
    time_of, best = np.full(rows * registers, np.inf), np.zeros(rows * registers, U64)
    take = limit[row] >= 0
    row, element, rate = row[take], element[take], 1.0 / weight[take]
    at, turn = np.zeros(len(row)), 0
    bound = limit
    while len(row):
        with np.errstate(over="ignore"):
            seed = mix(element + U64((2 * turn + 1) * _GOLD & 0xFFFFFFFFFFFFFFFF))
            at = at - np.log(((seed >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53) * rate
            register = ((mix(seed ^ U64(0x5851F42D4C957F2D)) >> U64(32)) * U64(registers)) >> U64(32)
        keep = at < bound[row]
        row, element, rate, at, register = row[keep], element[keep], rate[keep], at[keep], register[keep]
        slot = row * registers + register.astype(np.int64)
        better = np.flatnonzero(at < time_of[slot])
        better = better[np.argsort(-at[better], kind="stable")]  # of equal slots the last assignment, the earliest arrival, stays
        time_of[slot[better]] = at[better]
        best[slot[better]] = element[better]
        bound = np.minimum(limit, time_of.reshape(rows, registers).max(1))
        keep = at < bound[row]
        row, element, rate, at = row[keep], element[keep], rate[keep], at[keep]
        turn += 1
    return time_of, best


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    odd = mix(np.arange(1, rows + 1, dtype=U64)) | U64(1)
    with np.errstate(over="ignore"):
        s = (mix(signature).reshape(len(signature), bands, rows) * odd).sum(2, dtype=U64)
        return mix(s + mix(np.arange(bands, dtype=U64) + U64(77))[None, :]).view(np.int64)


def similarity(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Exact probability Jaccard similarity of two sorted element arrays with their weights; of two sets it is Jaccard's."""
    if not len(a) or not len(b):
        return 0.0
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    hit = a[at] == b
    shared = int(hit.sum())
    if not shared:
        return 0.0
    if wa.max() == 1 and wb.max() == 1:
        return shared / (len(a) + len(b) - shared)
    x, y = wa[at[hit]].astype(float), wb[hit].astype(float)
    only_a, only_b = wa.sum() - x.sum(), wb.sum() - y.sum()
    order = np.argsort(y / x, kind="stable")
    x, y = x[order], y[order]
    ratio = y / x
    below = only_a + np.cumsum(x)[np.searchsorted(ratio, ratio, side="right") - 1]
    above = only_b + y.sum() - np.cumsum(y)[np.searchsorted(ratio, ratio, side="right") - 1]
    return float((1 / (below / x + above / y)).sum())


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, texts in text_slices(batch.column("text")):
            row, element, weight = weighted(*shingles(texts))
            n = np.bincount(row, minlength=hi - lo)
            keys = band_keys(signatures(row, element, weight, hi - lo, BANDS * ROWS), BANDS, ROWS)
            keys, off = keys[n > 0], np.concatenate([[0], np.cumsum((n > 0) * BANDS)])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "key")), pa.array(n.astype(np.int32)), pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(keys.ravel()))],
                names=["doc_id", "key", "n_shingles", "bands"],
            )


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, texts in text_slices(batch.column("text")):
            row, element, weight = weighted(*shingles(texts))
            cut = np.searchsorted(row, np.arange(hi - lo + 1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("uid").slice(lo, hi - lo),
                    pa.array([element[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
                    pa.array([weight[a:b].astype(np.int32).tobytes() if weight[a:b].max(initial=1) > 1 else b"" for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
                ],
                names=["uid", "elements", "weights"],
            )


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for ea, wa, eb, wb in zip(*(batch.column(c) for c in ("ea", "wa", "eb", "wb")), strict=True):
            a, b = np.frombuffer(ea.as_buffer(), U64), np.frombuffer(eb.as_buffer(), U64)
            va, vb = (np.frombuffer(w.as_buffer(), np.int32) if w.as_buffer().size else np.ones(len(e), np.int32) for w, e in ((wa, a), (wb, b)))
            out.append(1 - similarity(a, va, b, vb))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out, pa.float64())], names=["a", "b", "distance"])


def _measured(pairs: DataFrame, store: DataFrame) -> DataFrame:
    """Distance of each pair (a, b). The join on a hub's key is a plain equi-join, which adaptive execution splits."""
    b = store.select(F.col("uid").alias("b"), F.col("elements").alias("eb"), F.col("weights").alias("wb"))
    a = store.select(F.col("uid").alias("a"), F.col("elements").alias("ea"), F.col("weights").alias("wa"))
    return checkpoint(pairs.join(b, "b").join(a, "a").mapInArrow(tidy(_distances), "a long, b long, distance double"))


def near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Classes of near-duplicate documents: doc_id, text_class (smallest id with the same text), class_id (smallest id reachable by links), kept.

    Links join two texts whose probability Jaccard similarity of five-word shingles (words are cut at ASCII white space, case
    counts) is `threshold` or more, found through shared bands and verified exactly. Equal texts are one class before any
    comparison, so no group of copies is expanded. In a band bucket all members are compared with two hubs; where that leaves
    more than one component, the members of other components are compared too: in small buckets as pairs, in large ones in
    blocks, those outside of the largest component against all that the triangle inequality doesn't rule out (1 - similarity
    is a metric). So within a bucket no link between components is missed, and links within one aren't enumerated.

    Null, empty and blank texts have no shingles and link with nothing (they are their own class); texts under five words are
    one shingle. Rows with a null doc_id take part, and their class is the smallest id other than null. Repeated rows are
    copies: each gets the row of its text. Other columns are ignored. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("key", F.unhex(F.md5("text")))
    seen = checkpoint(docs.mapInArrow(tidy(_signatures), "doc_id long, key binary, n_shingles int, bands array<long>"))
    classes = checkpoint(
        seen.where("n_shingles > 0")
        .groupBy("key")
        .agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
        .withColumn("uid", F.monotonically_increasing_id())
    )
    rows = classes.select("uid", F.explode("bands").alias("bucket"))
    buckets = rows.groupBy("bucket").agg(F.min("uid").alias("hub"), F.max("uid").alias("last")).where("hub < last")
    members = checkpoint(rows.join(buckets, "bucket"))
    component = _links(docs, classes, members, threshold)
    forget(members)
    smallest = component.join(classes.select("uid", "rep"), component.node == F.col("uid"))
    smallest = smallest.join(smallest.groupBy("component").agg(F.min("rep").alias("class_id")), "component").select("uid", "class_id")
    named = classes.select("uid", "key", "rep").join(smallest, "uid", "left").select(F.col("key").alias("k"), "rep", F.coalesce("class_id", "rep").alias("class"))
    out = seen.drop("bands").join(named, (F.col("key") == F.col("k")) & (F.col("n_shingles") > 0), "left")
    own = F.col("n_shingles") == 0
    out = out.select("doc_id", F.when(own, F.col("doc_id")).otherwise(F.col("rep")).alias("text_class"), F.when(own, F.col("doc_id")).otherwise(F.col("class")).alias("class_id"), "key")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def _links(docs, classes, members, threshold):
    far = 1 - threshold + 1e-9
    candidates = checkpoint(members.select("uid").distinct().join(classes.drop("bands"), "uid"))
    wanted = small_side(candidates, candidates.select("uid", F.col("key").alias("k"), F.col("rep").alias("r")))
    found = docs.join(wanted, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("r")))
    once = found.groupBy("uid").agg(F.first("text").alias("text"))  # repeated rows have the same id and text
    store = checkpoint(once.mapInArrow(tidy(_elements), "uid long, elements binary, weights binary"))

    pairs = members.select(F.explode(F.array(F.struct(F.col("hub").alias("a"), F.col("uid").alias("b")), F.struct(F.col("uid").alias("a"), F.col("last").alias("b")))).alias("p"))
    known = _measured(pairs.select("p.*").where("a < b").distinct(), store)
    component = connected_components(known.where(F.col("distance") <= far).select(F.col("a").alias("src"), F.col("b").alias("dst")))
    m = members.select("bucket", "hub", "uid").join(component, F.col("uid") == F.col("node"), "left").select("bucket", "hub", "uid", F.coalesce("component", "uid").alias("component"))
    torn = m.groupBy("bucket").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count("*").alias("n")).where("c0 < c1")
    m = checkpoint(m.join(torn.select("bucket", "n"), "bucket"))
    small, large = m.where(F.col("n") <= SMALL), m.where(F.col("n") > SMALL)
    links = []
    if not small.isEmpty():
        a = small.select("bucket", F.col("uid").alias("a"), F.col("component").alias("ca"))
        b = small.select("bucket", F.col("uid").alias("b"), F.col("component").alias("cb"))
        pairs = a.join(b, "bucket").where("a < b and ca <> cb").select("a", "b").distinct()
        pairs = pairs.join(known.select("a", "b"), ["a", "b"], "left_anti")
        links.append(_measured(pairs, store).where(F.col("distance") <= far).select("a", "b"))
    if not large.isEmpty():
        links.append(_block_links(large, known, store, far))
    links = [x for x in links if not x.isEmpty()]
    if links:  # links lead from component to component, so their ends are named by component and the old stars stay
        across = reduce(DataFrame.union, links)
        for end in ("a", "b"):
            at = component.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
            across = across.join(at, end, "left").withColumn(end, F.coalesce(f"c{end}", end)).drop(f"c{end}")
        joined = connected_components(across.select(F.col("a").alias("src"), F.col("b").alias("dst"))).withColumnRenamed("node", "of")
        old = component.select("node", F.col("component").alias("c")).union(joined.select("of", "of")).distinct()
        component = checkpoint(old.join(joined.withColumnRenamed("component", "to"), F.col("c") == F.col("of"), "left").select("node", F.coalesce("to", "c").alias("component")))
    forget(candidates, store, known, m)
    return component


#: Buckets of up to so many texts are compared as pairs, larger ones in blocks of at most BLOCK texts and BLOCK_BYTES.
SMALL, BLOCK, BLOCK_BYTES = 64, 256, 4 << 20
#: Distances to a hub are cut into so many bins; texts of bins too far apart can't be linked.
BINS = 10


def _block_links(large: DataFrame, known: DataFrame, store: DataFrame, far: float) -> DataFrame:
    """Links between components of large buckets. Buckets with the same hub are one group, whose texts are cut into blocks by
    their distance to the hub; only blocks of texts outside of the group's largest component are compared with others."""
    d = known.select(F.col("a").alias("hub"), F.col("b").alias("uid"), "distance")
    group = large.select("hub", "uid", "component").distinct().join(d, ["hub", "uid"], "left")
    group = checkpoint(group.select("hub", "uid", "component", F.floor(F.coalesce("distance", F.lit(0.0)) * BINS).alias("bin")))
    main = group.groupBy("hub", "component").agg(F.count("*").alias("n")).groupBy("hub").agg(F.max_by("component", F.struct("n", "component")).alias("main"))
    rows = group.join(main, "hub").join(store, "uid").withColumn("off", F.col("component") != F.col("main"))
    place = ["hub", "off", "bin"]
    sizes = rows.groupBy(*place).agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.length("elements")) / BLOCK_BYTES)).alias("parts"))
    rows = rows.join(sizes, place).withColumn("part", F.pmod(F.xxhash64("uid"), F.col("parts")))
    blocks = checkpoint(rows.groupBy(*place, "part").agg(F.collect_list(F.struct("uid", "component", "elements", "weights")).alias("rows")))
    names = blocks.select(F.concat_ws("/", *place, "part").alias("block"), *place)
    a, b = (names.select(*(F.col(c).alias(f"{c}_{s}") for c in names.columns)) for s in "ab")
    pairs = a.where("off_a").join(b, F.col("hub_a") == F.col("hub_b"))
    pairs = pairs.where((~F.col("off_b") | (F.col("block_a") <= F.col("block_b"))) & (F.abs(F.col("bin_a") - F.col("bin_b")) <= int(far * BINS) + 1)).select("block_a", "block_b")
    side = lambda s: blocks.select(F.concat_ws("/", *place, "part").alias(f"block_{s}"), F.col("rows").alias(f"rows_{s}"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column("rows_a"), batch.column("rows_b"), strict=True):
                a, b = linked_texts(_texts(x), _texts(y), 1 - far)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return checkpoint(pairs.join(side("a"), "block_a").join(side("b"), "block_b").mapInArrow(tidy(compare), "a long, b long").distinct())


def _texts(rows: pa.ListScalar) -> dict:
    v = rows.values
    return {c: v.field(c).to_numpy(zero_copy_only=False) for c in ("uid", "component")} | {
        "elements": [np.frombuffer(x, U64) for x in v.field("elements").to_pylist()],
        "weights": [np.frombuffer(x, np.int32) if x else None for x in v.field("weights").to_pylist()],
    }


#: Up to so many pairs of weights, those of an element in either text, similarities of blocks are computed as matrices.
COMBINATIONS = 64


def similarities(a: dict, b: dict) -> np.ndarray:
    """Exact similarity of each text of one block with each of another: shared elements are counted by their pair of weights,
    as products of indicator matrices, and the sum over elements becomes one over pairs of weights. Where there are
    too many pairs of weights, texts that share anything are compared one by one."""
    sides = [[np.concatenate(x["elements"]), np.array([len(e) for e in x["elements"]])] for x in (a, b)]
    shared = np.intersect1d(sides[0][0], sides[1][0])
    for side, x in zip(sides, (a, b), strict=True):
        weight = np.concatenate([np.ones(len(e), np.int32) if w is None else w for e, w in zip(x["elements"], x["weights"], strict=True)])
        row = np.repeat(np.arange(len(side[1])), side[1])
        at = np.minimum(np.searchsorted(shared, side[0]), max(len(shared) - 1, 0))
        hit = shared[at] == side[0] if len(shared) else np.zeros(len(row), bool)
        side += [np.bincount(row, weight, len(side[1])), row[hit], at[hit], weight[hit]]
    (_, na, wa, *hits_a), (_, nb, wb, *hits_b) = sides
    levels = [np.unique(h[2]) for h in (hits_a, hits_b)]
    if len(levels[0]) * len(levels[1]) > COMBINATIONS:
        out = np.zeros((len(na), len(nb)))
        ones = lambda x, k: x["weights"][k] if x["weights"][k] is not None else np.ones(len(x["elements"][k]), np.int32)
        for i in range(len(na)):
            for j in range(len(nb)):
                out[i, j] = similarity(a["elements"][i], ones(a, i), b["elements"][j], ones(b, j))
        return out
    count = {(x, y): np.zeros((len(na), len(nb))) for x in levels[0] for y in levels[1]}
    for lo in range(0, len(shared), 4096):  # a few thousand shared elements at a time, as dense columns
        wide = min(4096, len(shared) - lo)
        parts = []
        for (row, at, weight), n, of in zip((hits_a, hits_b), (na, nb), levels, strict=True):
            use = (at >= lo) & (at < lo + 4096)
            part = np.zeros((len(of), len(n), wide), np.float32)
            part[np.searchsorted(of, weight[use]), row[use], at[use] - lo] = 1
            parts.append(part)
        for k, x in enumerate(levels[0]):
            for m, y in enumerate(levels[1]):
                count[x, y] += parts[0][k] @ parts[1][m].T
    only_a = wa[:, None] - sum((x * n for (x, _), n in count.items()), np.zeros((len(na), len(nb))))
    only_b = wb[None] - sum((y * n for (_, y), n in count.items()), np.zeros((len(na), len(nb))))
    out = np.zeros((len(na), len(nb)))
    for (x, y), n in count.items():
        out += n / (only_a / x + only_b / y + sum(m * max(u / x, v / y) for (u, v), m in count.items())).clip(1e-300)
    return out


def linked_texts(a: dict, b: dict, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links between texts of two blocks and different components: enough of them that they join what all of them join."""
    link = similarities(a, b) >= threshold
    link &= a["component"][:, None] != b["component"][None]
    label_a, label_b = a["component"].copy(), b["component"].copy()
    top = np.iinfo(np.int64).max
    while True:
        new_b = np.minimum(label_b, np.where(link, label_a[:, None], top).min(0))
        new_a = np.minimum(label_a, np.where(link, new_b[None], top).min(1))
        if (new_a == label_a).all() and (new_b == label_b).all():
            break
        label_a, label_b = new_a, new_b
    moved = [(x["component"][now != x["component"]], now[now != x["component"]]) for x, now in ((a, label_a), (b, label_b))]
    return np.concatenate([m[0] for m in moved]), np.concatenate([m[1] for m in moved])


def keep_one(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """docs without the documents that near_duplicates doesn't keep; of rows that repeat an id and its text one stays.

    All columns stay, whatever their names. Null, empty and blank texts are near-duplicates of nothing and stay, repeated or
    not; rows with a null doc_id count as others, and stay if no copy of theirs has an id; an empty table stays empty.
    """
    found = near_duplicates(docs, threshold)
    empty = F.unhex(F.md5(F.lit("")))
    named = lambda df, gone: df.select(F.col("doc_id").alias("__d"), F.col("key").alias("__k"), F.lit(gone).alias("__gone"))
    gone = named(found.where("not kept"), True).distinct()
    again = found.where(F.col("kept") & (F.col("key") != empty)).groupBy("doc_id", "key").agg(F.count("*").alias("n")).where("n > 1")
    marks = checkpoint(gone.union(named(again, False)))
    text_key = F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    out = docs.withColumn("__key", text_key)
    out = out.join(small_side(marks, marks), (F.col("__key") == F.col("__k")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__d")), "left")
    once = out.where("__gone is null")
    if not marks.where("not __gone").isEmpty():
        once = once.unionByName(out.where("__gone = false").dropDuplicates(["__key", "__d"]))
    return once.select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read_table

    return near_duplicates(read_table(spark, sf_dir, "documents")).drop("key")
