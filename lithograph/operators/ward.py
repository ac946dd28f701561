"""Ward's agglomeration in rounds in which all reciprocal nearest clusters merge at once.

A cluster is its number of rows and its centre, from which the rise of the squared error by a merge follows (for these the Lance-Williams
update). Ward's merges cannot bring two clusters nearer to each other than to both halves of a third, so merging all reciprocal nearest pairs
gives the dendrogram that one merge at a time gives. For the same reason a cluster keeps its nearest one until that merges: each round
finds those of the others, by pairs of blocks, against all clusters. Once at most `limit` clusters are left, one task finishes. The work is the square of the rows that start; for very many rows they start as `micro` cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithograph.operators.graph import connected_components
from lithograph.operators.neighbours import MANY, TILE_ROWS, Screen, every_pair, packed_blocks, places_of, unpacked, within
from lithograph.operators.sampling import dense_index
from lithograph.session import materialize

ROUNDED = 2.0**-20  # more than what single precision makes of a quotient
MERGES = "a long, b long, height double, n long"


def _rise(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The exact rise of the squared error by the merge of two clusters, whose last number is their size."""
    n, m = v[:, -1], w[:, -1]
    return ((v[:, :-1] - w[:, :-1]) ** 2).sum(axis=1) * n * m / (n + m)


def _nearest(ids: np.ndarray, v: np.ndarray, others: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, height): the cluster that each merges with at the least rise, ties to the smaller name; of no other, none."""
    found = []
    screen, (own, same) = Screen(v[:, :-1], w[:, :-1]), places_of(ids, others)
    n, m = 1 / v[:, -1], 1 / w[:, -1]
    for at in range(0, len(ids), TILE_ROWS):
        rows = slice(at, min(at + TILE_ROWS, len(ids)))
        least, held = np.full(rows.stop - at, np.inf), []
        mine = slice(*np.searchsorted(own, [rows.start, rows.stop]))
        for cols in screen.cols():
            here = (same[mine] >= cols.start) & (same[mine] < cols.stop)
            for single in (True, False):
                d, slack = screen.tile(rows, cols, single)
                share = np.add.outer(n[rows].astype(d.dtype), m[cols].astype(d.dtype))
                slack = slack / (n[rows] + m[cols].min())
                d /= share
                d[own[mine][here] - at, same[mine][here] - cols.start] = np.inf
                bound = np.minimum(least, d.min(axis=1) * (1 + ROUNDED) + slack)
                i, j = within(d, bound * (1 + ROUNDED) + slack)
                if len(i) <= MANY * len(d) or not screen.single:  # else rounding hides which are near
                    break
            least = bound
            held.append((at + i, j + cols.start))
        i, j = (np.concatenate(x) for x in zip(*held))
        height = _rise(v[i], w[j])
        order = np.lexsort((others[j], height, i))
        i, j, height = i[order], j[order], height[order]
        first = np.unique(i, return_index=True)[1]
        found.append((ids[i[first]], others[j[first]], height[first]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _finish(pdf: pd.DataFrame) -> pd.DataFrame:
    """All merges of a bounded number of clusters, one at a time."""
    pdf = pdf.sort_values("id")
    ids, v = pdf["id"].to_numpy().copy(), np.concatenate([np.stack(pdf["v"].to_numpy()), pdf["n"].to_numpy(dtype=float)[:, None]], axis=1) if len(pdf) else np.zeros((0, 1))
    alive = np.ones(len(ids), dtype=bool)
    d = np.full((len(ids), len(ids)), np.inf)
    for i in range(len(ids)):
        d[i] = _rise(np.broadcast_to(v[i], v.shape), v)
        d[i, i] = np.inf
    near = d.argmin(axis=1) if len(ids) > 1 else np.zeros(len(ids), dtype=int)
    least = d[np.arange(len(ids)), near] if len(ids) else np.zeros(0)
    rows = []
    for _ in range(len(ids) - 1):
        i = int(np.where(alive, least, np.inf).argmin())
        j = int(near[i])
        a, b = min(i, j), max(i, j)
        n, m = v[a, -1], v[b, -1]
        rows.append((ids[a], ids[b], d[a, b], int(n + m)))
        v[a, :-1] = (v[a, :-1] * n + v[b, :-1] * m) / (n + m)
        v[a, -1] = n + m
        alive[b] = False
        d[b, :] = d[:, b] = np.inf
        d[a] = np.where(alive, _rise(np.broadcast_to(v[a], v.shape), v), np.inf)
        d[a, a] = np.inf
        d[:, a] = d[a]
        stale = np.flatnonzero(alive & ((near == a) | (near == b)))
        closer = alive & (d[a] < least)
        near[closer], least[closer] = a, d[a][closer]
        for s in {*stale.tolist(), a}:
            near[s] = int(d[s].argmin())
            least[s] = d[s, near[s]]
    return pd.DataFrame(rows, columns=["a", "b", "height", "n"]).astype({"a": "int64", "b": "int64", "height": "float64", "n": "int64"})


def ward_merges(clusters: DataFrame, limit: int = 2000, block_rows: int | None = None) -> DataFrame:
    """(a, b, height, n): all merges of clusters (id, n, v) of n rows with centre v, a merged cluster having the smaller name of the two."""
    live = materialize(clusters.select("id", F.col("n").cast("long").alias("n"), F.col("v").cast("array<double>").alias("v")), "ward")
    done = live.sparkSession.createDataFrame([], MERGES)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (i, a), (j, b) in zip(unpacked(batch, "ids", "vectors"), unpacked(batch, "ids2", "vectors2")):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in _nearest(i, a, j, b)], ["a", "b", "height"])

    known, left_over = None, live.count()
    while left_over > limit:
        sized = live.withColumn("x", F.concat("v", F.array(F.col("n").cast("double"))))
        blocks, count = packed_blocks(sized, "x", block_rows)
        asked, looked = blocks, count
        if known is not None:
            asked, looked = packed_blocks(sized.join(known.select(F.col("a").alias("id")), "id", "left_anti"), "x", block_rows)
        pairs = every_pair(asked, looked, blocks, count).mapInArrow(meet, "a long, b long, height double")
        near = pairs.groupBy("a").agg(F.min(F.struct("height", "b")).alias("e")).select("a", "e.b", "e.height")
        near = materialize(near if known is None else near.unionByName(known), "ward-near")
        back = near.select(F.col("b").alias("a"), F.col("a").alias("b"))
        mutual = near.join(back, ["a", "b"]).filter("a < b")
        left, right = (live.select(F.col("id").alias(e), F.col("n").alias(f"n{e}"), F.col("v").alias(f"v{e}")) for e in "ab")
        merged = materialize(mutual.join(left, "a").join(right, "b").withColumn("n", F.col("na") + F.col("nb")), "ward-merged")
        done = done.unionByName(merged.select("a", "b", "height", "n"))
        centre = F.zip_with("va", "vb", lambda x, y: (x * F.col("na") + y * F.col("nb")) / F.col("n"))
        gone = merged.select(F.explode(F.array("a", "b")).alias("id"))
        live = materialize(live.join(gone, "id", "left_anti").unionByName(merged.select(F.col("a").alias("id"), "n", centre.alias("v"))), "ward")
        merges = merged.count()
        left_over -= merges
        kept = near.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti")
        known = materialize(kept, "ward-known") if merges else None  # ties may have gone in a ring: all anew
    return done.unionByName(live.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(_finish, MERGES))  # at most limit clusters


def cut_merges(merges: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(id, cluster) with k clusters: all merges but the k - 1 highest take place."""
    top = merges.orderBy(F.desc("height"), F.desc("n"), "a").limit(max(0, k - 1)) if k > 1 else merges.limit(0)
    kept = merges.join(top.select("a", "b"), ["a", "b"], "left_anti").select("a", "b").unionByName(ids.select(F.col("id").alias("a"), F.col("id").alias("b")))
    found = connected_components(kept)
    order = dense_index(found.select("component").distinct(), "component").withColumnRenamed("idx", "number")
    return found.join(order, "component").select("id", F.col("number").cast("int").alias("cluster"))


def ward_clusters(df: DataFrame, k: int, col: str = "embedding", micro: int | None = None, seed: int = 42, limit: int = 2000, block_rows: int | None = None) -> DataFrame:
    """(id, cluster): Ward's clusters of all rows or, with micro, of the cells of a KMeans with that many.

    Rows at one place are together from the start, so that fewer than k places make fewer than k clusters.
    """
    rows = df.filter(F.col(col).isNotNull()).select("id", F.col(col).cast("array<double>").alias("v"))
    if micro is None:
        places = materialize(rows.groupBy("v").agg(F.min("id").alias("place"), F.count("*").alias("n")), "ward-places")
        starts = places.select(F.col("place").alias("id"), "n", "v")
        found = cut_merges(materialize(ward_merges(starts, limit, block_rows), "ward-merges"), starts, k)
        return rows.join(places, "v").join(found.withColumnRenamed("id", "place"), "place").select("id", "cluster")
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector, vector_to_array

    ready = rows.select("id", array_to_vector("v").alias("features"))
    fitted = KMeans(k=micro, seed=seed, predictionCol="cell").fit(ready)
    cells = materialize(fitted.transform(ready).select("id", F.col("cell").cast("long").alias("cell"), vector_to_array("features").alias("v")), "ward-cells")
    centres = rows.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(fitted.clusterCenters())], "cell long, v array<double>")
    starts = cells.groupBy("cell").agg(F.count("*").alias("n")).join(centres, "cell").withColumnRenamed("cell", "id")
    found = cut_merges(materialize(ward_merges(starts, limit, block_rows), "ward-merges"), starts, k)
    return cells.join(found.withColumnRenamed("id", "cell"), "cell").select("id", "cluster")
