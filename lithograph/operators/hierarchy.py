"""Clusters by density: spanning tree of mutual reachability, dendrogram, condensed tree, and the most stable clusters.

The steps and what bounds them:

1. Edges. Exact mode: of each pair of blocks its own minimum spanning tree, whose union holds one of the whole. What is shuffled is the rows times the
   blocks, so blocks are large; a tree of two of them is put together of trees of TREE_ROWS and TREE_ROWS rows. Graph mode: the lists
   of neighbours by descent, in work about in proportion to the rows.
2. Spanning forest. In rounds each component takes its least outgoing edge; once at most `limit` edges are left between components, one
   task finishes.
3. Dendrogram. Edges are numbered by weight. A tree of more than `limit` edges is cut at its median edge: the components of the lighter
   half are trees of their own, and nodes of the tree that the heavier half makes. Trees are put together by groups of about `limit` edges.
4. Condensed tree. Where both sides of a merge have min_size rows, two clusters part, seen from the top; everything else leaves the
   cluster it is in. Clusters are the components that are left when those partings are cut.
5. Selection. A cluster stands if it is as stable as all that stand below it. Leaves are folded into their parents in rounds until at
   most `limit` clusters are left, which one task finishes.

No step collects rows, and none depends on how many clusters there are. Rows whose vector is null, and rows that no chosen cluster
holds, are noise (-1).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithograph.operators.graph import connected_components
from lithograph.operators.neighbours import KNN_SHARE, block_pairs, descend, distances, exact_pairs, packed_blocks, unpacked
from lithograph.operators.sampling import dense_index
from lithograph.session import materialize

LIMIT = 500_000
TREE_ROWS, MOST_EDGES = 1024, 1 << 19  # rows of each side whose distances are held at once, and edges that a task holds beside its tree
EDGES = "u long, v long, w double"
MERGES = "idx long, w double, left long, right long, n_left long, n_right long"
SHARPEST = 1e10  # the density of rows at one place


def core_distances(pairs: DataFrame, min_samples: int) -> DataFrame:
    """(id, core): distance to the min_samples-th nearest other row, or to the last where there are fewer."""
    order = Window.partitionBy("id").orderBy("distance", "neighbour")
    near = pairs.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= min_samples)
    return near.groupBy("id").agg(F.max("distance").alias("core"))


def _tree_of(v: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (i, j, w) of a minimum spanning tree of mutual reachability over all rows of v; all distances come from one product of matrices."""
    n = len(v)
    x = v - v.mean(axis=0) if n else v
    reach = np.sqrt(distances(x, x))
    np.maximum(reach, core[:, None], out=reach)
    np.maximum(reach, core[None, :], out=reach)
    best, near = np.full(n, np.inf), np.zeros(n, dtype=np.int64)
    out = np.zeros(n, dtype=bool)
    at, order = 0, []
    for _ in range(n - 1):
        out[at] = True
        best[at] = np.inf
        d = reach[at]
        closer = (d < best) & ~out
        best[closer], near[closer] = d[closer], at
        at = int(best.argmin())
        order.append(at)
    j = np.array(order, dtype=np.int64)
    i = near[j]
    return i, j, np.maximum(np.sqrt(((v[i] - v[j]) ** 2).sum(axis=1)), np.maximum(core[i], core[j]))


def _lightest(n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of edges between n rows those of a minimum spanning forest."""
    _, first = np.unique(np.minimum(i, j) * n + np.maximum(i, j), return_index=True)
    first = first[np.argsort(w[first], kind="stable")]
    parent, kept = list(range(n)), []
    for at, a, b in zip(first.tolist(), i[first].tolist(), j[first].tolist()):
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[b] != b:
            parent[b] = b = parent[parent[b]]
        if a != b:
            parent[a] = b
            kept.append(at)
    return i[kept], j[kept], w[kept]


def _tree_of_blocks(v: np.ndarray, core: np.ndarray, sides: list[tuple[slice, slice]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (i, j, w) of a minimum spanning tree of the union of the whole graphs over each two sides."""
    held, edges = [], 0
    for at, (s, t) in enumerate(sides):
        rows = np.arange(len(v))[s] if s == t else np.concatenate([np.arange(len(v))[s], np.arange(len(v))[t]])
        i, j, w = _tree_of(v[rows], core[rows])
        held.append((rows[i], rows[j], w))
        edges += len(w)
        if len(sides) > 1 and (edges > MOST_EDGES + len(v) or at == len(sides) - 1):
            held = [_lightest(len(v), *(np.concatenate(x) for x in zip(*held)))]
            edges = len(held[0][2])
    return tuple(np.concatenate(x) for x in zip(*held))


def _cut(first: int, last: int) -> list[slice]:
    return [slice(at, min(at + TREE_ROWS, last)) for at in range(first, last, TREE_ROWS)]


def exact_edges(df: DataFrame, col: str, min_samples: int, block_rows: int | None = None) -> DataFrame:
    """(u, v, w) that hold a minimum spanning tree of all rows."""
    core = core_distances(exact_pairs(df, col, min_samples), min_samples)
    rows = materialize(df.select("id", F.col(col).cast("array<double>").alias("x")).join(core, "id").select("id", F.concat("x", F.array("core")).alias("x")), "cores")
    blocks, count = packed_blocks(rows, "x", block_rows, share=KNN_SHARE)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (i, a), (j, b), same in zip(unpacked(batch, "ids", "vectors"), unpacked(batch, "ids2", "vectors2"), batch.column("same").to_pylist()):
                if same and np.array_equal(i, j):
                    ids, v, parts = i, a, _cut(0, len(i))
                    sides = list(combinations(parts, 2)) or [(parts[0], parts[0])]
                else:
                    ids, v = np.concatenate([i, j]), np.concatenate([a, b])
                    sides = list(product(_cut(0, len(i)), _cut(len(i), len(ids))))
                p, q, w = _tree_of_blocks(v[:, :-1], v[:, -1], sides)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[p], ids[q])), pa.array(np.maximum(ids[p], ids[q])), pa.array(w)], ["u", "v", "w"])

    return block_pairs(blocks, count).mapInArrow(meet, EDGES).filter("u <> v").distinct()


def graph_edges(df: DataFrame, col: str, min_samples: int, **descent) -> DataFrame:
    """(u, v, w) between rows and the near rows that descent finds."""
    pairs = materialize(descend(df, col, **({"size": max(40, 2 * min_samples)} | descent))[0], "near")
    core = materialize(core_distances(pairs, min_samples), "cores")
    both = pairs.join(core, "id").join(core.select(F.col("id").alias("neighbour"), F.col("core").alias("other")), "neighbour")
    return both.select(F.least("id", "neighbour").alias("u"), F.greatest("id", "neighbour").alias("v"), F.greatest("distance", "core", "other").alias("w")).groupBy("u", "v").agg(F.min("w").alias("w"))


# --- spanning forest


def _find(parent: dict[int, int], x: int) -> int:
    while (up := parent.get(x, x)) != x:
        parent[x] = parent.get(up, up)
        x = parent[x]
    return x


def _forest(pdf: pd.DataFrame) -> pd.DataFrame:
    parent: dict[int, int] = {}
    kept = []
    for cu, cv, u, v, w in pdf.sort_values(["w", "u", "v"])[["cu", "cv", "u", "v", "w"]].itertuples(index=False):
        a, b = _find(parent, cu), _find(parent, cv)
        if a != b:
            parent[a] = b
            kept.append((u, v, w))
    return pd.DataFrame(kept, columns=["u", "v", "w"]).astype({"u": "int64", "v": "int64", "w": "float64"})


def spanning_forest(edges: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(u, v, w) of a minimum spanning forest; of equal weights the edge of smaller ends goes first."""
    live = materialize(edges.select("u", "v", "w", F.col("u").alias("cu"), F.col("v").alias("cv")), "forest-live")
    found = edges.sparkSession.createDataFrame([], EDGES)
    while (left := live.count()) > limit:
        ends = live.select(F.col("cu").alias("c"), F.col("cv").alias("other"), "w", "u", "v").unionByName(live.select(F.col("cv").alias("c"), F.col("cu").alias("other"), "w", "u", "v"))
        best = materialize(ends.groupBy("c").agg(F.min(F.struct("w", "u", "v", "other")).alias("e")), "forest-best")
        found = found.unionByName(best.select("e.u", "e.v", "e.w").distinct())
        joined = materialize(connected_components(best.select(F.col("c").alias("a"), F.col("e.other").alias("b"))), "forest-components")
        moved = live.join(joined.select(F.col("id").alias("cu"), F.col("component").alias("du")), "cu").join(joined.select(F.col("id").alias("cv"), F.col("component").alias("dv")), "cv").filter("du <> dv")
        between = moved.groupBy(F.least("du", "dv").alias("cu"), F.greatest("du", "dv").alias("cv")).agg(F.min(F.struct("w", "u", "v")).alias("e"))
        live = materialize(between.select("e.u", "e.v", "e.w", "cu", "cv"), "forest-live")
    return found.unionByName(live.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(_forest, EDGES)) if left else found  # at most limit edges


# --- dendrogram


def _merge_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    """Merges of trees, edges in the order of their numbers."""
    parent: dict[int, int] = {}
    node: dict[int, tuple[int, int]] = {}
    rows = []
    for idx, w, u, v, nu, nv, base in pdf.sort_values("idx")[["idx", "w", "u", "v", "nu", "nv", "base"]].itertuples(index=False):
        a, b = _find(parent, u), _find(parent, v)
        (left, n), (right, m) = node.get(a, (u, nu)), node.get(b, (v, nv))
        parent[a] = b
        node[b] = base + idx, n + m
        rows.append((idx, w, left, right, n, m))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in MERGES.split(", ")]).astype({"idx": "int64", "left": "int64", "right": "int64", "n_left": "int64", "n_right": "int64", "w": "float64"})


def dendrogram(forest: DataFrame, points: int, limit: int = LIMIT) -> DataFrame:
    """Merges in the order of weight for a forest (u, v, w) over points 0 .. points - 1: idx, w, left, right, n_left, n_right.

    Sides are points or, from `points` on, the merge of that number less points.
    """
    one = F.lit(1).cast("long")
    subs = materialize(dense_index(forest, "w", "u", "v").select(F.lit("t").alias("sub"), F.col("idx").cast("long").alias("idx"), "w", "u", "v", one.alias("nu"), one.alias("nv")), "dendrogram")
    done = forest.sparkSession.createDataFrame([], MERGES)
    level = 0
    while (total := subs.count()) > 0:
        sizes = subs.groupBy("sub").agg(F.count("*").alias("n"), F.percentile_approx("idx", 0.5, 10000).alias("cut"))
        sized = materialize(subs.join(sizes, "sub"), "dendrogram-sized")
        groups = F.pmod(F.xxhash64("sub"), F.lit(max(1, total // limit)))
        small = sized.filter(F.col("n") <= limit).withColumn("base", F.lit(points).cast("long"))
        done = done.unionByName(small.groupBy(groups).applyInPandas(_merge_rows, MERGES))
        big = sized.filter(F.col("n") > limit)
        light, heavy = big.filter("idx <= cut"), big.filter("idx > cut")
        part = materialize(connected_components(light.select(F.col("u").alias("a"), F.col("v").alias("b"))), "dendrogram-parts")
        nodes = light.select(F.col("u").alias("id"), F.col("nu").alias("n")).union(light.select("v", "nv")).distinct().join(part, "id")
        whole = nodes.groupBy("component").agg(F.sum("n").alias("size"))
        inside = light.join(part.withColumnRenamed("id", "u"), "u")
        root = inside.groupBy("component").agg((F.max("idx") + points).alias("root")).join(whole, "component")
        to = materialize(part.join(root, "component").select("id", "root", "size"), "dendrogram-roots")
        lower = inside.select(F.concat(F.lit(f"{level}-"), F.col("component").cast("string")).alias("sub"), "idx", "w", "u", "v", "nu", "nv")
        upper = heavy
        for end, n in (("u", "nu"), ("v", "nv")):
            told = to.select(F.col("id").alias(end), F.col("root").alias("r"), F.col("size").alias("s"))
            upper = upper.join(told, end, "left").withColumn(end, F.coalesce("r", end)).withColumn(n, F.coalesce("s", n)).drop("r", "s")
        upper = upper.select(F.concat("sub", F.lit("h")).alias("sub"), "idx", "w", "u", "v", "nu", "nv")
        subs = materialize(lower.unionByName(upper), "dendrogram")
        level += 1
    return done


# --- condensed tree and selection


def density_of(w: Column) -> Column:
    return F.lit(1.0) / F.greatest(w, F.lit(1 / SHARPEST))


def condensed_tree(merges: DataFrame, points: int, min_size: int) -> tuple[DataFrame, DataFrame]:
    """(node, cluster) for points and merges, and a row per cluster: cluster, parent (null at the top), stability, size.

    A cluster is named by its topmost merge.
    """
    nodes = merges.select((F.col("idx") + points).alias("node"), "w", "left", "right", "n_left", "n_right", ((F.col("n_left") >= min_size) & (F.col("n_right") >= min_size)).alias("parts"))
    down = nodes.select(F.explode(F.array("left", "right")).alias("child"), "node", "parts", "w")
    own = nodes.select(F.col("node").alias("child"), "node")
    kept = down.filter("NOT parts").select("child", "node").unionByName(own).unionByName(down.filter("parts").select("child", F.col("child").alias("node")))
    found = connected_components(kept.select((-F.col("child")).alias("a"), (-F.col("node")).alias("b")))  # the topmost is the least
    member = materialize(found.select((-F.col("id")).alias("node"), (-F.col("component")).alias("cluster")), "condensed")
    size = F.col("n_left") + F.col("n_right")
    leaving = F.when(F.col("parts"), size).otherwise(F.when(F.col("n_left") < min_size, F.col("n_left")).otherwise(0) + F.when(F.col("n_right") < min_size, F.col("n_right")).otherwise(0))
    big = nodes.filter(size >= min_size).join(member, "node")
    lives = big.groupBy("cluster").agg(F.sum(density_of(F.col("w")) * leaving).alias("lived"), F.max(F.struct("node", size.alias("size")))["size"].alias("size"))
    born = down.filter("parts").select(F.col("child").alias("cluster"), F.col("node").alias("above"), density_of(F.col("w")).alias("birth"))
    parent = born.join(member.select(F.col("node").alias("above"), F.col("cluster").alias("parent")), "above").drop("above")
    # a cluster that starts at a single point has no merge of its own, and is no cluster unless min_size is 1
    tree = lives.join(parent, "cluster", "left").select("cluster", "parent", (F.col("lived") - F.coalesce("birth", F.lit(0.0)) * F.col("size")).alias("stability"), "size")
    return member, materialize(tree, "condensed-tree")


def _choose(pdf: pd.DataFrame) -> pd.DataFrame:
    """Labels of a whole tree; clusters have greater names than those below them."""
    pdf = pdf.sort_values("cluster")
    below: dict[int, float] = {}
    rows = []
    for cluster, parent, stability, kids, may in pdf[["cluster", "parent", "stability", "kids", "may"]].itertuples(index=False):
        total = kids + below.get(cluster, 0.0)
        if not pd.isna(parent):
            below[int(parent)] = below.get(int(parent), 0.0) + max(stability, total)
        rows.append((int(cluster), None if pd.isna(parent) else int(parent), bool(may) and not stability < total))
    label: dict[int, int | None] = {}
    for cluster, parent, stands in reversed(rows):
        label[cluster] = label.get(parent) if label.get(parent) is not None else cluster if stands else None
    return pd.DataFrame({"cluster": list(label), "label": pd.array(list(label.values()), dtype="Int64")})


def choose_clusters(tree: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(cluster, label): the standing cluster at or above each, null where there is none. The top of a single tree never stands."""
    tops = tree.filter("parent IS NULL").limit(2).count()
    live = materialize(tree.select("cluster", "parent", "stability", F.lit(0.0).alias("kids"), (F.col("parent").isNotNull() | F.lit(tops > 1)).alias("may")), "choose")
    folded = []
    while live.count() > limit:
        inner = live.filter("parent IS NOT NULL").select(F.col("parent").alias("cluster")).distinct()
        leaves = materialize(live.join(inner, "cluster", "left_anti").withColumn("stands", F.col("may") & ~(F.col("stability") < F.col("kids"))), "choose-leaves")
        given = leaves.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("cluster")).agg(F.sum(F.greatest("stability", "kids")).alias("given"))
        live = materialize(live.join(inner, "cluster", "left_semi").join(given, "cluster", "left").withColumn("kids", F.col("kids") + F.coalesce("given", F.lit(0.0))).drop("given"), "choose")
        folded.append(leaves)
    labels = live.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(_choose, "cluster long, label long")  # at most limit clusters
    for leaves in reversed(folded):
        labels = materialize(labels, "choose-labels")
        above = labels.select(F.col("cluster").alias("parent"), F.col("label").alias("above"))
        labels = labels.unionByName(leaves.join(above, "parent", "left").select("cluster", F.coalesce("above", F.when(F.col("stands"), F.col("cluster"))).alias("label")))
    return labels


def density_hierarchy(df: DataFrame, col: str = "embedding", min_size: int = 10, min_samples: int = 10, mode: str = "exact", limit: int = LIMIT, **options) -> DataFrame:
    """(id, cluster): the most stable clusters of all densities; -1 is noise. mode is exact or descent (see module)."""
    if mode not in ("exact", "descent"):
        raise ValueError(f"mode is exact or descent, not {mode!r}")
    if min_size < 2:
        raise ValueError("a cluster has two rows at least")
    edges = (exact_edges if mode == "exact" else graph_edges)(df, col, min_samples, **options)
    numbered = materialize(dense_index(df.filter(F.col(col).isNotNull()).select("id").distinct(), "id").withColumnRenamed("idx", "point"), "points")
    points = numbered.count()
    forest = materialize(spanning_forest(edges, limit), "forest")
    for end in ("u", "v"):
        forest = forest.join(numbered.select(F.col("id").alias(end), F.col("point").alias("_p")), end).withColumn(end, F.col("_p").cast("long")).drop("_p")
    merges = materialize(dendrogram(forest, points, limit), "merges")
    member, tree = condensed_tree(merges, points, min_size)
    labels = choose_clusters(tree, limit)
    standing = labels.filter("label IS NOT NULL")
    order = materialize(dense_index(standing.select("label").distinct(), "label").withColumnRenamed("idx", "number"), "numbers")
    found = numbered.join(member.withColumnRenamed("node", "point"), "point").join(standing, "cluster").join(order, "label").select("id", F.col("number").cast("int").alias("cluster"))
    return df.select("id").join(found, "id", "left").select("id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))
