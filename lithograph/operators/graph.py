"""Connected components of an undirected graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithograph.session import discard, materialize


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) for edges (a, b) of longs: component is the smallest id that can be reached, id itself included.

    Alternates the large-star and small-star steps, which need a number of rounds in the logarithm of the longest
    path. Each step is a minimum per node (with partial aggregation) and an equi-join, so that a node of very many
    edges is split like any skewed join key; each round is written to the shared folder, and deleted after the next. Ids with no edge but to
    themselves come out as their own component. Null ends are left out.
    """
    start = materialize(edges.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL"), "cc-start")
    nodes = materialize(start.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "cc-nodes")
    pairs = materialize(start.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc-edges")
    discard(start)
    last = None
    for _ in range(max_rounds):
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.filter("u <> v").distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
        before, pairs = pairs, materialize(small.select("e.u", "e.v").filter("u <> v").distinct(), "cc-edges")
        discard(before)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.join(pairs.select(F.col("u").alias("id"), F.col("v").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
