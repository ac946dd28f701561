"""Scores of clusters against expert labels.

All label scores read the contingency table, which one aggregation over the rows makes; from there on the rows are one
per pair of labels. Labels with null do not count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithograph.functions.geo import combine_states
from lithograph.operators.neighbours import block_pairs, packed_blocks, unpacked
from lithograph.session import materialize


def contingency(df: DataFrame, gt: str = "gt", pred: str = "pred") -> DataFrame:
    """gt, pred, n for the pairs that occur."""
    return df.filter(F.col(gt).isNotNull() & F.col(pred).isNotNull()).groupBy(F.col(gt).alias("gt"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def contingency_wide(ct: DataFrame, preds: list[int]) -> DataFrame:
    """One row per gt, one column per predicted label."""
    return ct.groupBy("gt").pivot("pred", preds).agg(F.sum("n")).na.fill(0)


def align_labels(ct: DataFrame) -> DataFrame:
    """pred, gt, n: the one-to-one assignment of predicted labels to classes with the greatest agreement.

    Of several the one that is least in order of pred, a class coming before none. The K x K table, which holds labels and
    not rows, is solved on the driver; ranks of classes, worth less than a single row of agreement, decide ties.
    """
    rows = ct.collect()  # one row per pair of labels
    gts, preds = sorted({r["gt"] for r in rows}), sorted({r["pred"] for r in rows})
    count = {(r["pred"], r["gt"]): r["n"] for r in rows}
    base = len(gts) + 1
    spare = max(0, len(preds) - len(gts))
    gain = [[count.get((p, g), 0) * base ** len(preds) - min(j, len(gts)) * base ** (len(preds) - 1 - i) for j, g in enumerate([*gts, *[None] * spare])] for i, p in enumerate(preds)]
    chosen = [(preds[i], gts[j], count.get((preds[i], gts[j]), 0)) for i, j in (_assign(gain) if gain else []) if j < len(gts)]
    return ct.sparkSession.createDataFrame(chosen, "pred int, gt int, n long")


def _assign(gain: list[list[int]]) -> list[tuple[int, int]]:
    """Rows to columns for the greatest sum, by augmenting paths with potentials."""
    rows, cols = len(gain), len(gain[0])
    size, top = max(rows, cols), max(map(max, gain))
    cost = [[top - gain[i][j] if i < rows and j < cols else top for j in range(size)] for i in range(size)]
    u, v, match = [0] * (size + 1), [0] * (size + 1), [0] * (size + 1)
    for i in range(1, size + 1):
        match[0], j0 = i, 0
        least, way, used = [None] * (size + 1), [0] * (size + 1), [False] * (size + 1)  # whole numbers may be larger than floats
        while True:
            used[j0] = True
            i0 = match[j0]
            for j in range(1, size + 1):
                if not used[j]:
                    c = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if least[j] is None or c < least[j]:
                        least[j], way[j] = c, j0
            step, j1 = min((least[j], j) for j in range(1, size + 1) if not used[j])
            for j in range(size + 1):
                if used[j]:
                    u[match[j]] += step
                    v[j] -= step
                elif j:
                    least[j] -= step
            j0 = j1
            if not match[j0]:
                break
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    return [(match[j] - 1, j - 1) for j in range(1, size + 1) if match[j] <= rows and j <= cols]


def apply_alignment(assignments: DataFrame, mapping: DataFrame) -> DataFrame:
    """assignments with aligned: the class of the predicted label, -1 where it has none."""
    m = F.broadcast(mapping.select("pred", F.col("gt").alias("_gt")))  # one row per predicted label
    return assignments.join(m, "pred", "left").withColumn("aligned", F.coalesce("_gt", F.lit(-1))).drop("_gt")


def confusion(df: DataFrame, gt: str = "gt", aligned: str = "aligned") -> DataFrame:
    """gt, aligned, n, percent of the class (2 decimals), for all pairs of classes that occur and of aligned labels."""
    ct = contingency(df, gt, aligned).withColumnRenamed("pred", "aligned")
    grid = ct.select("gt").distinct().join(F.broadcast(ct.select("aligned").union(ct.select("gt")).distinct()))
    full = grid.join(ct, ["gt", "aligned"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    return full.withColumn("percent", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("gt")), 2))


def _pairs(n: Column) -> Column:
    return n.cast("double") * (n - 1) / 2


def _margins(ct: DataFrame) -> tuple[DataFrame, DataFrame]:
    return ct.groupBy("gt").agg(F.sum("n").alias("a")), ct.groupBy("pred").agg(F.sum("n").alias("b"))


def adjusted_rand(ct: DataFrame) -> DataFrame:
    """One row: ari; 1 where both sides are trivial in the same way."""
    a, b = _margins(ct)
    sums = ct.agg(F.sum(_pairs(F.col("n"))).alias("ij"), F.sum("n").alias("t")).join(F.broadcast(a.agg(F.sum(_pairs(F.col("a"))).alias("i")))).join(F.broadcast(b.agg(F.sum(_pairs(F.col("b"))).alias("j"))))
    expected = F.when(F.col("t") > 1, F.col("i") * F.col("j") / _pairs(F.col("t"))).otherwise(0.0)
    most = (F.col("i") + F.col("j")) / 2
    return sums.select(F.when(most == expected, 1.0).otherwise((F.col("ij") - expected) / (most - expected)).alias("ari"))


def entropies(ct: DataFrame) -> DataFrame:
    """One row: mi, h_gt, h_pred in natural units."""
    a, b = _margins(ct)
    t = ct.agg(F.sum("n").alias("t"))
    own = lambda m, c, name: m.join(F.broadcast(t)).agg((-F.sum(F.col(c) / F.col("t") * F.ln(F.col(c) / F.col("t")))).alias(name))
    cells = ct.join(a, "gt").join(b, "pred").join(F.broadcast(t))
    mi = cells.agg(F.sum(F.col("n") / F.col("t") * F.ln(F.col("n").cast("double") * F.col("t") / (F.col("a").cast("double") * F.col("b")))).alias("mi"))
    return mi.join(F.broadcast(own(a, "a", "h_gt"))).join(F.broadcast(own(b, "b", "h_pred")))


def nmi(ct: DataFrame) -> DataFrame:
    """One row: mutual information over the mean of the entropies; 1 where both are 0."""
    half = (F.col("h_gt") + F.col("h_pred")) / 2
    return entropies(ct).select(F.when(half > 0, F.greatest(F.col("mi"), F.lit(0.0)) / half).otherwise(1.0).alias("nmi"))


def v_measure(ct: DataFrame) -> DataFrame:
    """One row: homogeneity, completeness, v_measure."""
    h = F.when(F.col("h_gt") > 0, F.col("mi") / F.col("h_gt")).otherwise(1.0)
    c = F.when(F.col("h_pred") > 0, F.col("mi") / F.col("h_pred")).otherwise(1.0)
    out = entropies(ct).select(h.alias("homogeneity"), c.alias("completeness"))
    both = F.col("homogeneity") + F.col("completeness")
    return out.withColumn("v_measure", F.when(both > 0, 2 * F.col("homogeneity") * F.col("completeness") / both).otherwise(0.0))


def silhouette(df: DataFrame, label: str, coords: tuple[str, str] = ("x1", "x2"), most: int | None = None, block_rows: int | None = None) -> DataFrame:
    """One row: the mean exact Euclidean silhouette; 0 for a point alone in its cluster, null for fewer than two clusters."""
    return silhouettes(df, [label], coords, most, block_rows).withColumnRenamed(label, "silhouette")


def silhouettes(df: DataFrame, labels: list[str], coords: tuple[str, str] = ("x1", "x2"), most: int | None = None, block_rows: int | None = None) -> DataFrame:
    """One row: silhouette by each of several labels (whole numbers), from one pass over the distances.

    Points meet by pairs of blocks, in which a task sums distances by point and label. The work is the square of the rows. Only if asked
    for does a seeded sample of `most` rows stand in for more; silhouette_squared is linear.
    """
    from lithograph.operators.sampling import subset_n

    rows = df.select("id", F.array(*(F.col(c).cast("double") for c in (*coords, *labels))).alias("x"))
    if most is not None and rows.count() > most:
        rows = subset_n(rows, most)
    blocks, count = packed_blocks(rows, "x", block_rows)

    def sums(ids: np.ndarray, a: np.ndarray, b: np.ndarray):
        for at in range(0, len(ids), 512):
            yield from part_sums(ids[at : at + 512], a[at : at + 512], b)

    def part_sums(ids: np.ndarray, a: np.ndarray, b: np.ndarray):
        distance = np.sqrt((a[:, None, 0] - b[None, :, 0]) ** 2 + (a[:, None, 1] - b[None, :, 1]) ** 2)
        for which in range(len(labels)):
            for other in np.unique(b[:, 2 + which]):
                there = b[:, 2 + which] == other
                columns = [ids, np.full(len(ids), which), a[:, 2 + which], np.full(len(ids), other), distance[:, there].sum(axis=1), np.full(len(ids), there.sum())]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["id", "which", "l", "l2", "d", "n"])

    def meet(batches):
        for batch in batches:
            for (i, a), (j, b), same in zip(unpacked(batch, "ids", "vectors"), unpacked(batch, "ids2", "vectors2"), batch.column("same").to_pylist(), strict=True):
                yield from sums(i, a, b)
                if not same:
                    yield from sums(j, b, a)

    per = block_pairs(blocks, count).mapInArrow(meet, "id long, which long, l double, l2 double, d double, n long").groupBy("id", "which", "l", "l2").agg(F.sum("d").alias("d"), F.sum("n").alias("n"))
    own = F.max(F.when((F.col("l") == F.col("l2")) & (F.col("n") > 1), F.col("d") / (F.col("n") - 1)))
    nearest = F.min(F.when(F.col("l") != F.col("l2"), F.col("d") / F.col("n")))
    points = per.groupBy("id", "which").agg(own.alias("a"), nearest.alias("b"))
    score = F.when(F.col("b").isNull(), F.lit(None)).when(F.col("a").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)))
    value = F.coalesce(score, F.when(F.col("b").isNotNull(), 0.0))
    return points.agg(*(F.avg(F.when(F.col("which") == i, value)).alias(name) for i, name in enumerate(labels)))


def silhouette_squared(df: DataFrame, label: str, features: str = "features") -> float:
    """Spark ML's silhouette with squared distances: linear in the rows, and another number than silhouette."""
    from pyspark.ml.evaluation import ClusteringEvaluator

    return ClusteringEvaluator(featuresCol=features, predictionCol=label, metricName="silhouette", distanceMeasure="squaredEuclidean").evaluate(df)


def matched_centroids(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """gt, and the centroids of the class (g1, g2) and of the predicted label that matches it (p1, p2).

    df: (gt, pred, x1, x2). Classes without a match, or with an empty one, are left out.
    """
    g = df.groupBy("gt").agg(F.avg("x1").alias("g1"), F.avg("x2").alias("g2"))
    p = df.groupBy("pred").agg(F.avg("x1").alias("p1"), F.avg("x2").alias("p2"))
    return g.join(mapping.select("pred", "gt"), "gt").join(p, "pred").select("gt", "g1", "g2", "p1", "p2")


def procrustes_disparity(centroids: DataFrame) -> DataFrame:
    """One row: what is left after centring, scaling to unit norm and the best rotation and scale; null below two rows.

    With A and B so prepared and M = A'B, it is 1 - (|M|^2 + 2 |det M|).
    """
    s = lambda a, b: F.sum(F.col(a) * F.col(b)) - F.sum(a) * F.sum(b) / F.count("*")
    m = centroids.agg(F.count("*").alias("n"), *(s(a, b).alias(f"{a}{b}") for a, b in (("g1", "g1"), ("g2", "g2"), ("p1", "p1"), ("p2", "p2"), ("g1", "p1"), ("g1", "p2"), ("g2", "p1"), ("g2", "p2"))))
    scale = (F.col("g1g1") + F.col("g2g2")) * (F.col("p1p1") + F.col("p2p2"))
    square = F.col("g1p1") * F.col("g1p1") + F.col("g1p2") * F.col("g1p2") + F.col("g2p1") * F.col("g2p1") + F.col("g2p2") * F.col("g2p2")
    det = F.abs(F.col("g1p1") * F.col("g2p2") - F.col("g1p2") * F.col("g2p1"))
    return m.select(F.when((F.col("n") >= 2) & (scale > 0), 1 - (square + 2 * det) / scale).alias("disparity"))


def centroid_distance_corr(centroids: DataFrame) -> DataFrame:
    """One row: Spearman correlation of the pairwise distances among classes and among their matches; null if undefined."""
    a, b = (centroids.select(*(F.col(c).alias(f"{c}_{s}") for c in centroids.columns)) for s in ("a", "b"))
    away = lambda k: F.sqrt((F.col(f"{k}1_a") - F.col(f"{k}1_b")) ** 2 + (F.col(f"{k}2_a") - F.col(f"{k}2_b")) ** 2)
    d = a.join(b, F.col("gt_a") < F.col("gt_b")).select(away("g").alias("dg"), away("p").alias("dp"))  # one row per pair of classes
    ranked = d.select(*(_average_rank(c).alias(f"r{c}") for c in ("dg", "dp")))
    return ranked.agg(F.when((F.stddev_pop("rdg") > 0) & (F.stddev_pop("rdp") > 0), F.corr("rdg", "rdp")).alias("distance_corr"))


def _average_rank(c: str) -> Column:
    return F.rank().over(Window.orderBy(c)) + (F.count("*").over(Window.partitionBy(c)) - 1) / 2.0


def boundary_uncertainty(probs: DataFrame, smallest: int | None = None) -> DataFrame:
    """One row: mean natural entropy of the rows' class probabilities; 0 if the smallest class has fewer than two rows."""
    h = F.aggregate("prob", F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.ln(p)).otherwise(0.0))
    return probs.agg((F.lit(0.0) if smallest is not None and smallest < 2 else F.avg(h)).alias("uncertainty"))


def cluster_sizes(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    return df.groupBy(F.col(cluster).alias("cluster")).agg(F.count("*").alias("n"))


def pairwise_distances(df: DataFrame, key: str = "k", vec: str = "v") -> DataFrame:
    """a, b (a < b), distance among few rows, such as centroids; knn_edges serves many."""
    a, b = (df.select(F.col(key).alias(s), F.col(vec).alias(f"v{s}")) for s in ("a", "b"))
    d = F.aggregate(F.zip_with("va", "vb", lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.sqrt(d).alias("distance"))


def compare_given(df: DataFrame, combine_labels: bool = False, folds: int = 5) -> DataFrame:
    """One row of three groups of scores for (id, gt, pred, x1, x2).

    standard_metrics (ari, nmi) are of the classes that predicted labels are matched with, -1 for labels without one; structural_similarity
    has disparity and distance_corr of matched centroids, v_measure of the labels as they are, and both silhouettes;
    continuum_evidence has boundary_uncertainty, the mean entropy of held-out class probabilities (see cv_probabilities).
    """
    from lithograph.operators.learning import cv_probabilities

    spark = df.sparkSession
    rows = df.withColumn("gt", combine_states(F.col("gt"))) if combine_labels else df
    rows = materialize(rows.filter("gt IS NOT NULL AND pred IS NOT NULL"), "compare-rows")
    counts = contingency(rows).collect()  # one row per pair of labels; all label scores come from it
    ct = spark.createDataFrame(counts, "gt int, pred int, n long")
    mapping = align_labels(ct).collect()
    to = {m["pred"]: m["gt"] for m in mapping}
    aligned: dict[tuple[int, int], int] = {}
    for r in counts:
        aligned[r["gt"], to.get(r["pred"], -1)] = aligned.get((r["gt"], to.get(r["pred"], -1)), 0) + r["n"]
    aligned_ct = spark.createDataFrame([(*k, n) for k, n in aligned.items()], "gt int, pred int, n long")
    centroids = spark.createDataFrame(matched_centroids(rows, spark.createDataFrame(mapping, "pred int, gt int, n long")).collect(), "gt int, g1 double, g2 double, p1 double, p2 double")  # one row per class
    smallest = min((sum(r["n"] for r in counts if r["gt"] == g) for g in {r["gt"] for r in counts}), default=0)
    probs = cv_probabilities(rows.select("id", "gt", F.array("x1", "x2").alias("embedding")), "gt", folds=folds)
    standard = _side_by_side(adjusted_rand(aligned_ct), nmi(aligned_ct)).select(F.struct("ari", "nmi").alias("standard_metrics"))
    both = silhouettes(rows, ["pred", "gt"]).select(F.col("pred").alias("silhouette_pred"), F.col("gt").alias("silhouette_true"))
    structure = _side_by_side(procrustes_disparity(centroids), centroid_distance_corr(centroids), v_measure(ct).select("v_measure"), both)
    structure = structure.select(F.struct(*structure.columns).alias("structural_similarity"))
    continuum = boundary_uncertainty(probs, smallest).select(F.struct(F.col("uncertainty").alias("boundary_uncertainty")).alias("continuum_evidence"))
    return _side_by_side(standard, structure, continuum)


def _side_by_side(*frames: DataFrame) -> DataFrame:
    """Frames of one row each as one row."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(F.broadcast(f))
    return out
