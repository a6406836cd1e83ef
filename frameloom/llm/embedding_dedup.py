"""Embedding near-duplicates by product quantisation: coarse inverted lists, residual subspace codes, exact rerank.

The index (coarse centroids, code books) is fitted on a bounded sample; every row is indexed. A label's rows, in the order of their
lists and distances to the centroid, are cut into blocks of bounded size. Which blocks can hold a link is told by small
summaries (least and greatest distance per block and list) before any vector moves: two lists are too far apart if the gap between
their centroids is wider than both radii and the search radius together. Within a pair of blocks a vector probes a list unless the
plane between the two centroids is farther than the search radius, its distances to the list's codes are looked up in a table by
subspace (asymmetric: the vector itself against codes), and whatever the code's own error can't rule out is reranked by exact
cosine in double precision. All tests only drop pairs below the threshold, so the probes are sufficient and no link is lost.

Vectors that lie within half the radius of their centroid are linked with one another for certain. This core of a list is
counted, not compared, so a large group of near copies costs one aggregation. Equal vectors are one vector with a multiplicity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, forget, tidy
from .graph import connected_components

SUBSPACES, CODES = 8, 256
#: Slack of distance tests, far above the rounding of double precision and far below any distance that matters.
SLACK = 1e-7


class Index:
    """Coarse centroids (cells x width) and code books (subspace x code x width of a subspace) for unit vectors."""

    def __init__(self, centroids: np.ndarray, books: np.ndarray):
        self.centroids, self.books = centroids, books
        self.between = np.sqrt(np.maximum(0, ((centroids[:, None] - centroids[None]) ** 2).sum(2)))

    @property
    def width(self) -> int:
        return self.centroids.shape[1]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Cell, distance to its centroid, codes of the residual, and the length of what the codes leave out."""
        cell = nearest(x, self.centroids)
        rest = x - self.centroids[cell]
        parts = rest.reshape(len(x), SUBSPACES, -1)
        codes = np.stack([nearest(parts[:, m], self.books[m]) for m in range(SUBSPACES)], 1).astype(np.uint8)
        left = parts - self.books[np.arange(SUBSPACES)[None], codes]
        return cell, np.sqrt((rest**2).sum(1)), codes, np.sqrt((left**2).sum((1, 2)))

    def looked_up(self, x: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Distance of each vector to each code of a list, by one table per vector and subspace."""
        rest = (x - self.centroids[cell]).reshape(len(x), SUBSPACES, -1)
        out = np.zeros((len(x), len(codes)))
        for m in range(SUBSPACES):
            table = (rest[:, m] ** 2).sum(1)[:, None] - 2 * rest[:, m] @ self.books[m].T + (self.books[m] ** 2).sum(1)
            out += np.take(table, codes[:, m], axis=1)
        return np.sqrt(np.maximum(out, 0, out=out), out=out)


def nearest(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.argmax(x @ to.T - (to**2).sum(1) / 2, axis=1) if len(x) else np.zeros(0, np.int64)


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Centroids of at most k clusters, seeded by k-means++."""
    seeds = [x[rng.integers(len(x))]]
    far = ((x - seeds[0]) ** 2).sum(1)
    while len(seeds) < k and far.max() > 1e-12:
        seeds.append(x[rng.choice(len(x), p=far / far.sum())])
        far = np.minimum(far, ((x - seeds[-1]) ** 2).sum(1))
    c = np.stack(seeds)
    for _ in range(rounds):
        at = nearest(x, c)
        n = np.bincount(at, minlength=len(c))
        for j in np.flatnonzero(n):
            c[j] = x[at == j].mean(0)
    return c


def fit(sample: np.ndarray, cells: int, seed: int = 5) -> Index:
    rng = np.random.default_rng(seed)
    c = k_means(sample, cells, rng)
    rest = (sample - c[nearest(sample, c)]).reshape(len(sample), SUBSPACES, -1)
    books = np.zeros((SUBSPACES, CODES, rest.shape[2]))
    for m in range(SUBSPACES):
        b = k_means(rest[:4096, m], CODES, rng, 8)
        books[m, : len(b)] = b
    return Index(c, books)


def unit(values: list, width: int) -> np.ndarray:
    """Vectors as rows of length one, filled up with zeros to `width`."""
    out = np.zeros((len(values), width))
    for k, v in enumerate(values):
        out[k, : len(v)] = v
    out /= np.abs(out).max(1, keepdims=True).clip(1e-300)
    return out / np.sqrt((out**2).sum(1, keepdims=True)).clip(1e-300)


def near_vectors(vectors: DataFrame, threshold: float = 0.93, sample: int = 20_000, list_rows: int = 4096, most_cells: int = 1024, block_rows: int = 4096) -> DataFrame:
    """Links vectors(vec_id, embedding, label) of equal label with a cosine of `threshold` or more: vec_id, n_links, component_id, kept.

    One row per input row. A null label, a null, empty or zero vector, or one with a null or non-finite component links with
    nothing, as do vectors of different lengths. Rows that repeat a vector link with each other; a null vec_id is a vector like
    all others, and component_id is the smallest id that isn't null. Other columns are ignored; no rows give no rows.
    """
    spark = vectors.sparkSession
    e = F.col("embedding")
    finite = F.forall(e, lambda v: F.coalesce(F.abs(v) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(v))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    good = F.col("label").isNotNull() & e.isNotNull() & finite & F.exists(e, lambda v: v != 0)
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    key = F.unhex(F.md5(F.concat_ws(",", F.col("label").cast("string"), F.array_join(F.transform(e, lambda v: F.hex(F.when(v == 0, 0.0).otherwise(v).cast("string"))), ","))))
    narrow = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    raw = e.cast(f"array<{narrow}>")
    keyed = checkpoint(rows.select("vec_id", "good", F.when(F.col("good"), key).alias("key")))
    distinct = rows.where("good").select("vec_id", key.alias("key"), "label", raw.alias("embedding")).groupBy("key")
    distinct = distinct.agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    distinct = checkpoint(distinct.withColumn("uid", F.monotonically_increasing_id()))
    stats = distinct.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width")).first()
    if not stats["n"]:
        return keyed.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    width = -(-stats["width"] // SUBSPACES) * SUBSPACES
    some = distinct.select("embedding").orderBy(F.xxhash64("key"), "key").limit(sample).toArrow().column("embedding").to_pylist()
    cells = int(min(most_cells, max(4, stats["n"] // list_rows), max(1, len(some) // 16)))
    shared = spark.sparkContext.broadcast(fit(unit(some, width), cells))

    radius = float(np.sqrt(2 - 2 * threshold)) + SLACK
    inner = float(np.sqrt(2 - 2 * threshold)) - SLACK

    narrow_type = np.float32 if narrow == "float" else np.float64

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                values = part.column("embedding").to_pylist()
                x = unit(values, width)
                cell, rho, codes, left = shared.value.encode(x)
                group = [f"{label}:{len(v)}" for label, v in zip(part.column("label").to_pylist(), values, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c) for c in ("uid", "copies")),
                        pa.array(group),
                        pa.array(cell.astype(np.int32)),
                        pa.array(rho <= inner / 2),
                        pa.array(rho),
                        pa.array((rho * 256).astype(np.int32)),
                        pa.array(left),
                        pa.array([c.tobytes() for c in codes], pa.binary()),
                        pa.array([np.asarray(v, narrow_type).tobytes() for v in values], pa.binary()),
                    ],
                    names=["uid", "copies", "grp", "cell", "core", "rho", "bin", "left", "codes", "raw"],
                )

    indexed = checkpoint(distinct.select("uid", "copies", "label", "embedding").mapInArrow(tidy(assign), "uid long, copies long, grp string, cell int, core boolean, rho double, bin int, left double, codes binary, raw binary"))

    # blocks: runs of a group's distance bins, list by list, and where a single bin is too large, parts of it
    place = ["grp", "cell", "core", "bin"]
    bins = indexed.groupBy(*place).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("grp").orderBy("cell", "core", "bin"))
    bins = bins.select(*place, F.floor((upto - F.col("n")) / block_rows).alias("run"), F.ceil(F.col("n") / block_rows).alias("parts"))
    member = indexed.join(bins, place).withColumn("part", F.when(F.col("parts") > 1, F.concat_ws("-", "cell", "core", "bin", F.pmod(F.xxhash64("uid"), F.col("parts")))).otherwise(""))
    member = member.withColumn("block", F.concat_ws("/", "grp", "run", "part"))
    rows_of = F.struct("uid", "copies", "cell", "core", "rho", "left", "codes", "raw")
    blocks = checkpoint(member.groupBy("grp", "block").agg(F.collect_list(rows_of).alias("rows")))
    found_in = blocks.select("grp", "block", F.explode(F.transform("rows", lambda r: F.struct(r["cell"].alias("cell"), r["rho"].alias("rho"), r["core"].alias("core")))).alias("r"))
    summary = checkpoint(found_in.groupBy("grp", "block", "r.cell").agg(F.min("r.rho").alias("lo"), F.max("r.rho").alias("hi"), F.min("r.core").alias("cores")))
    a, b = (summary.select("grp", *(F.col(c).alias(f"{c}_{s}") for c in ("block", "cell", "lo", "hi", "cores"))) for s in "ab")

    def gaps(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for x, y in batches:
            yield pa.array(shared.value.between[x.to_numpy(zero_copy_only=False), y.to_numpy(zero_copy_only=False)])

    gaps.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    near = a.join(b, "grp").where("block_a <= block_b").withColumn("gap", F.arrow_udf(gaps, "double")("cell_a", "cell_b"))
    same_list = F.col("cell_a") == F.col("cell_b")
    ring = (F.col("lo_a") - F.col("hi_b") <= radius) & (F.col("lo_b") - F.col("hi_a") <= radius) & ~(F.col("cores_a") & F.col("cores_b"))
    apart = (F.col("gap") - F.col("hi_a") - F.col("hi_b") <= radius) & (F.col("lo_b") - F.col("hi_a") - F.col("gap") <= radius) & (F.col("lo_a") - F.col("hi_b") - F.col("gap") <= radius)
    pairs = near.where(F.when(same_list, ring).otherwise(apart)).select("block_a", "block_b").distinct()
    side = lambda s: blocks.select(F.col("block").alias(f"block_{s}"), F.col("rows").alias(f"rows_{s}"))
    pairs = pairs.join(side("a"), "block_a").join(side("b"), "block_b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for k in range(batch.num_rows):
                one = {c: batch.column(c)[k] for c in batch.schema.names}
                same = one["block_a"].as_py() == one["block_b"].as_py()
                a = _block(one["rows_a"], width, narrow_type)
                found = linked_blocks(index, a, a if same else _block(one["rows_b"], width, narrow_type), same, threshold, radius)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names=["uid", "n", "to"])

    found = checkpoint(pairs.mapInArrow(tidy(compare), "uid long, n long, to long"))
    forget(blocks, summary)
    core = indexed.where("core")
    of_core = core.groupBy("grp", "cell").agg(F.sum("copies").alias("all"), F.min("uid").alias("to"))
    core = checkpoint(core.select("uid", "copies", "grp", "cell").join(of_core, ["grp", "cell"]).select("uid", (F.col("all") - F.col("copies")).alias("n"), "to"))
    found = found.union(core)
    counts = found.groupBy("uid").agg(F.sum("n").alias("n"))
    component = connected_components(found.select(F.col("uid").alias("src"), F.col("to").alias("dst")))
    ids = component.join(distinct.select("uid", "vec_id"), component.node == F.col("uid"))
    ids = ids.join(ids.groupBy("component").agg(F.min("vec_id").alias("component_id")), "component").select(F.col("uid").alias("u"), "component_id")
    each = distinct.select(F.col("key").alias("k"), "uid", "copies", "vec_id").join(counts, "uid", "left").join(ids, F.col("uid") == F.col("u"), "left")
    each = each.select("k", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component_id", F.col("vec_id")).alias("component"))
    out = keyed.select("vec_id", "good", "key").join(each, F.col("key") == F.col("k"), "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("good"), F.col("component")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _block(rows: pa.ListScalar, width: int, kind: type) -> dict[str, np.ndarray]:
    v = rows.values
    get = lambda c: v.field(c).to_numpy(zero_copy_only=False)
    return {c: get(c) for c in ("uid", "copies", "cell", "core", "rho", "left")} | {
        "codes": np.frombuffer(b"".join(get("codes")), np.uint8).reshape(-1, SUBSPACES),
        "unit": unit([np.frombuffer(x, kind) for x in get("raw")], width),
    }


def linked_blocks(index: Index, a: dict, b: dict, same: bool, threshold: float, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links between two blocks: (vector, number of vectors linked, a vector that stands for its component here). Pairs of one list's core
    are left to the aggregation over cores."""
    x, y = a["unit"], b["unit"]
    link = np.zeros((len(x), len(y)), bool)
    for cell in np.unique(b["cell"]):
        columns = np.flatnonzero(b["cell"] == cell)
        far = np.sqrt(np.maximum(0, ((x - index.centroids[cell]) ** 2).sum(1)))
        gap = np.maximum(index.between[a["cell"], cell], 1e-300)
        reach = (a["cell"] == cell) | ((far**2 - a["rho"] ** 2) / (2 * gap) <= radius)  # the plane between the lists is within reach
        reach &= (far >= b["rho"][columns].min() - radius) & (far <= b["rho"][columns].max() + radius)
        probing = np.flatnonzero(reach)
        for lo in range(0, len(probing), 512):
            query = probing[lo : lo + 512]
            near = index.looked_up(x[query], int(cell), b["codes"][columns]) <= radius + b["left"][columns] + SLACK
            near &= ~((a["cell"][query] == cell) & a["core"][query])[:, None] | ~b["core"][columns][None]
            rows, these = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
            if len(rows):
                exact = x[query[rows]] @ y[columns[these]].T >= threshold
                link[np.ix_(query[rows], columns[these])] = near[np.ix_(rows, these)] & exact
    if same:
        link[np.arange(len(x)), np.arange(len(x))] = False
        link |= link.T
    query, columns = np.flatnonzero(link.any(1)), np.flatnonzero(link.any(0))
    nothing = np.zeros(0, np.int64)
    if not len(query):
        return nothing, nothing, nothing
    link = link[np.ix_(query, columns)]
    label_a, label_b = a["uid"][query].copy(), b["uid"][columns].copy()
    top = np.iinfo(np.int64).max
    while True:
        new_b = np.minimum(label_b, np.where(link, label_a[:, None], top).min(0))
        new_a = np.minimum(label_a, np.where(link, new_b[None], top).min(1))
        if (new_a == label_a).all() and (new_b == label_b).all():
            break
        label_a, label_b = new_a, new_b
    by_a, by_b = link @ b["copies"][columns], link.T @ a["copies"][query]
    out = [(a["uid"][query], by_a, label_a)]
    if not same:
        out.append((b["uid"][columns], by_b, label_b))
    uid, n, to = (np.concatenate(c) for c in zip(*out, strict=True))
    return uid[n > 0], n[n > 0], to[n > 0]


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read_table

    return near_vectors(read_table(spark, sf_dir, "embeddings"))


SQL = """
with recursive v as (
  select vec_id, label, embedding::double[] as e from embeddings where label is not null and len(embedding) > 0
), l as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.e, b.e) >= 0.93
), r as (
  select vec_id as node, vec_id as reach from embeddings
  union
  select r.node, l.b from r join l on l.a = r.reach
)
select x.vec_id, coalesce(n.n_links, 0) as n_links, c.component_id, c.component_id = x.vec_id as kept
from embeddings x join (select node, min(reach) as component_id from r group by node) c on c.node = x.vec_id
left join (select a, count(*) as n_links from l group by a) n on n.a = x.vec_id
"""
