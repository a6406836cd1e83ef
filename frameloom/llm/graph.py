"""Connected components as joins and aggregates; no component is ever gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, forget


def connected_components(links: DataFrame) -> DataFrame:
    """links(src, dst) of any orderable type -> (node, component) with the smallest node reachable; only nodes with a link.

    Alternates large-star and small-star rounds (Kiveris et al., 2014): each node's neighbours are moved to its smallest
    neighbour until only stars are left. Whether they are is told by the table of smallest neighbours that a round needs
    anyway, so a graph of stars costs one aggregation. The number of rounds has no bound, as each one brings the graph
    nearer to stars; it grows with the logarithm of the nodes. Minima are pre-aggregated before each shuffle, and the joins that
    meet a hub of very many links are plain equi-joins, which adaptive execution splits. Rounds end in kept tables, and a
    table is deleted once the next one is written. Null ends and loops are ignored; no links give an empty result.
    """
    e = checkpoint(
        links.where("src is not null and dst is not null and src <> dst")
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .distinct()
    )
    while True:
        both = e.select("u", "v", F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select(F.col("v").alias("u"), F.col("u").alias("v"), F.lit(0), F.lit(1)))
        near = both.groupBy("u").agg(F.min("v").alias("m"), F.sum("up").alias("up"), F.max("down").alias("down"))
        near = checkpoint(near.select("u", F.least("u", "m").alias("m"), F.expr("up > 1 or up > 0 and down > 0").alias("moves")))
        if not near.agg(F.max("moves")).first()[0]:
            forget(e)
            return near.select(F.col("u").alias("node"), F.col("m").alias("component"))
        large = both.select("u", "v").join(near.select("u", "m"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        new = checkpoint(large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low).distinct())
        forget(e, near)
        e = new
