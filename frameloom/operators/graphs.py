"""Weighted graph algebra on edge tables (src, dst, isym, osym, cost) and final states (state, cost).

Costs are negative logs; a path's cost is the sum of its edges' costs and its final cost. Symbol 0 is the empty one.
Closures are driver loops of joins that stop once nothing changes; each round ends in a table in the shared folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kept import forget, keep

LOG_ZERO = 1e10


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "isym", "osym", "cost")


def project(edges: DataFrame, side: str = "isym") -> DataFrame:
    """An acceptor of the input (or output) symbols."""
    return edges.withColumn("isym", F.col(side)).withColumn("osym", F.col(side))


def invert(edges: DataFrame) -> DataFrame:
    return edges.withColumn("__i", F.col("osym")).withColumn("osym", F.col("isym")).withColumn("isym", F.col("__i")).drop("__i")


def union(a: DataFrame, b: DataFrame, offset: int) -> DataFrame:
    """Both graphs, the second with its states moved by offset, under a new start -1 with empty edges to both."""
    start = a.sparkSession.createDataFrame([(-1, 0, 0, 0, 0.0), (-1, offset, 0, 0, 0.0)], "src long, dst long, isym long, osym long, cost double")
    return a.union(b.withColumn("src", F.col("src") + offset).withColumn("dst", F.col("dst") + offset)).union(start)


def compose(a: DataFrame, b: DataFrame, width: int, start: tuple[int, int] = (0, 0), finals: tuple[DataFrame, DataFrame] | None = None):
    """Edges of the composition over the states that can be reached: a's output meets b's input.

    A state is (p, q, filter), numbered (p * width + q) * 3 + filter, with all q under width. The filter keeps one of the ways in which
    empty symbols interleave: after a move of a alone (an empty output) only a may go on alone, after one of b alone (an empty
    input) only b, until both move; an empty output meets an empty input only if neither has just moved alone. Grown from the start in
    rounds of equi-joins over the states found last, for as many rounds as the longest path needs.
    With `finals` of both, returns (edges, finals): a pair is final at the sum of the costs, whatever its filter.
    """
    x = a.select(F.col("src").alias("p"), F.col("dst").alias("p2"), F.col("isym").alias("i"), F.col("osym").alias("m"), F.col("cost").alias("c1"))
    y = b.select(F.col("src").alias("q"), F.col("dst").alias("q2"), F.col("isym").alias("m"), F.col("osym").alias("o"), F.col("cost").alias("c2"))
    none = F.lit(0).cast("long")
    columns = ("p", "q", "f", "p2", "q2", "f2", "isym", "osym", "cost")
    seen = front = keep(a.sparkSession.createDataFrame([(*start, 0)], "p long, q long, f int"))
    parts = []
    while True:
        both = front.join(x, "p").join(y, ["q", "m"]).where("m <> 0 or f = 0")
        both = both.select("p", "q", "f", "p2", "q2", F.lit(0).alias("f2"), F.col("i").alias("isym"), F.col("o").alias("osym"), (F.col("c1") + F.col("c2")).alias("cost"))
        of_a = front.where("f <> 1").join(x.where("m = 0"), "p").select("p", "q", "f", "p2", F.col("q").alias("q2"), F.lit(2).alias("f2"), F.col("i").alias("isym"), none.alias("osym"), F.col("c1").alias("cost"))
        of_b = front.where("f <> 2").join(y.where("m = 0"), "q").select("p", "q", "f", F.col("p").alias("p2"), "q2", F.lit(1).alias("f2"), none.alias("isym"), F.col("o").alias("osym"), F.col("c2").alias("cost"))
        new = keep(both.union(of_a.select(*columns)).union(of_b.select(*columns)))
        parts.append(new)
        front = keep(new.select(F.col("p2").alias("p"), F.col("q2").alias("q"), F.col("f2").alias("f")).distinct().join(seen, ["p", "q", "f"], "left_anti"))
        if front.isEmpty():
            break
        seen = keep(seen.union(front))
    state = lambda p, q, f: ((F.col(p) * width + F.col(q)) * 3 + F.col(f)).cast("long")
    found = reduce(DataFrame.union, parts).select(state("p", "q", "f").alias("src"), state("p2", "q2", "f2").alias("dst"), "isym", "osym", "cost")
    if finals is None:
        return found
    ends = seen.join(finals[0].select(F.col("state").alias("p"), F.col("cost").alias("c1")), "p").join(finals[1].select(F.col("state").alias("q"), F.col("cost").alias("c2")), "q")
    return found, ends.select(state("p", "q", "f").alias("state"), (F.col("c1") + F.col("c2")).alias("cost"))


def shortest(edges: DataFrame, start: int) -> DataFrame:
    """Least cost from start to every state that can be reached: (state, cost), by rounds over the states that became cheaper, as many as the
    longest of the cheapest paths has edges; a round is one aggregation of old and new costs. A loop of negative cost raises once no
    path can be that long."""
    steps = keep(edges.groupBy("src", "dst").agg(F.min("cost").alias("step")))
    best = keep(edges.sparkSession.createDataFrame([(start, 0.0, True)], "state long, cost double, fresh boolean"))
    rounds = 0
    while True:
        new = best.where("fresh").join(steps, F.col("state") == F.col("src")).select(F.col("dst").alias("state"), F.lit(None).cast("double").alias("old"), (F.col("cost") + F.col("step")).alias("new"))
        all_costs = best.select("state", F.col("cost").alias("old"), F.lit(None).cast("double").alias("new")).union(new).groupBy("state").agg(F.min("old").alias("old"), F.min("new").alias("new"))
        better = F.col("new").isNotNull() & (F.col("old").isNull() | (F.col("new") < F.col("old") - 1e-12))
        after = keep(all_costs.select("state", F.when(better, F.col("new")).otherwise(F.col("old")).alias("cost"), better.alias("fresh")))
        forget(best)
        best = after
        rounds += 1
        if not best.agg(F.max("fresh")).first()[0]:
            forget(steps)
            return best.select("state", "cost")
        if rounds % 64 == 0 and rounds > best.count():
            raise ValueError("a loop has a negative cost")


def purge(edges: DataFrame, start: int, finals: DataFrame) -> DataFrame:
    """Edges on some path from the start to a final state."""
    ahead = shortest(edges.withColumn("cost", F.lit(0.0)), start).select("state")
    ends = finals.select(F.lit(-2).cast("long").alias("src"), F.col("state").alias("dst"), F.lit(0).cast("long").alias("isym"), F.lit(0).cast("long").alias("osym"), F.lit(0.0).alias("cost"))
    back = shortest(reverse(edges).withColumn("cost", F.lit(0.0)).union(ends), -2).select("state")
    kept = ahead.join(back, "state").select("state")
    return edges.join(kept, edges.src == kept.state, "left_semi").join(kept, edges.dst == kept.state, "left_semi")


def push_weights(edges: DataFrame, finals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Moves costs toward the start: an edge costs what it adds to the least cost to the end; states with no end are dropped."""
    ends = finals.select(F.lit(-2).cast("long").alias("src"), F.col("state").alias("dst"), F.lit(0).cast("long").alias("isym"), F.lit(0).cast("long").alias("osym"), "cost")
    to_end = shortest(reverse(edges).union(ends), -2).select(F.col("state"), F.col("cost").alias("d"))
    a, b = to_end.select(F.col("state").alias("src"), F.col("d").alias("ds")), to_end.select(F.col("state").alias("dst"), F.col("d").alias("dd"))
    moved = edges.join(a, "src").join(b, "dst").select("src", "dst", "isym", "osym", (F.col("cost") + F.col("dd") - F.col("ds")).alias("cost"))
    return moved, finals.join(to_end, "state").select("state", (F.col("cost") - F.col("d")).alias("cost"))


def forward_backward(edges: DataFrame, start: int, end: int, levels: DataFrame) -> DataFrame:
    """Posterior of each edge of an acyclic lattice whose states have levels (state, level), every edge going up: (src, dst, isym, gamma).

    One round per level in either direction, each a join and a log-sum; -ln probabilities throughout."""
    top = levels.agg(F.max("level")).first()[0] or 0

    def sweep(edges: DataFrame, first: int, order: list[int]) -> DataFrame:
        done = edges.sparkSession.createDataFrame([(first, 0.0)], "state long, s double")
        for level in order:
            into = edges.join(levels.where(F.col("level") == level).select(F.col("state").alias("dst")), "dst")
            sums = into.join(done.withColumnRenamed("state", "src"), "src").select("dst", (F.col("cost") + F.col("s")).alias("c"))
            low = sums.groupBy("dst").agg(F.min("c").alias("low"))
            new = sums.join(low, "dst").groupBy("dst").agg((F.min("low") - F.log(F.sum(F.exp(F.col("low") - F.col("c"))))).alias("s"))
            done = keep(done.union(new.select(F.col("dst").alias("state"), "s")))
        return done

    ahead = sweep(edges, start, list(range(1, top + 1)))
    back = sweep(reverse(edges), end, list(range(top - 1, -1, -1)))
    whole = ahead.where(F.col("state") == end).first()
    whole = F.lit(whole["s"] if whole else LOG_ZERO)
    a, b = ahead.select(F.col("state").alias("src"), F.col("s").alias("fs")), back.select(F.col("state").alias("dst"), F.col("s").alias("bs"))
    return edges.join(a, "src").join(b, "dst").select("src", "dst", "isym", F.exp(whole - F.col("fs") - F.col("cost") - F.col("bs")).alias("gamma"))
