"""Losses on embeddings and balanced soft assignments, as aggregations over rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lithograph.session import materialize


def _dims(latents: DataFrame, *by: str) -> DataFrame:
    return latents.select(*by, F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))


def variance_penalty(latents: DataFrame, eps: float = 1e-4) -> DataFrame:
    """One row: mean over dimensions of max(0, 1 - sqrt(sample variance + eps))."""
    per = _dims(latents).groupBy("dim").agg(F.var_samp("x").alias("v"))
    return per.agg(F.avg(F.greatest(F.lit(0.0), 1 - F.sqrt(F.col("v") + eps))).alias("variance_penalty"))


def covariance_penalty(latents: DataFrame) -> DataFrame:
    """One row: sum of squared covariances of different dimensions, by the number of dimensions.

    Each task adds up the products of its batches, one matrix product a batch, and sends one row per dimension; null
    vectors take no part.
    """

    def products(batches):
        held = None
        for batch in batches:
            if batch.num_rows:
                x = batch.column("embedding").flatten().to_numpy().astype(float).reshape(batch.num_rows, -1)
                x = np.hstack([np.ones((len(x), 1)), x])  # row and column 0: the count and the sums
                held = x.T @ x if held is None else held + x.T @ x
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(held))), pa.array(list(held))], ["i", "sums"])

    rows = latents.filter("embedding IS NOT NULL").select("embedding").mapInArrow(products, "i long, sums array<double>")
    total = rows.select("i", F.posexplode("sums").alias("j", "s")).groupBy("i", "j").agg(F.sum("s").alias("s"))
    means = total.filter("j = 0").select("i", F.col("s").alias("m"))
    n = F.broadcast(means.filter("i = 0").select(F.col("m").alias("n")))  # one row
    pair = total.filter("i > 0 AND j > 0 AND i <> j").join(means, "i").join(means.select(F.col("i").cast("int").alias("j"), F.col("m").alias("m2")), "j").join(n)
    cov = pair.select("i", ((F.col("s") - F.col("m") * F.col("m2") / F.col("n")) / (F.col("n") - 1)).alias("c"))
    d = latents.agg(F.max(F.size("embedding")).alias("d"))
    return cov.agg(F.sum(F.col("c") * F.col("c")).alias("s")).join(F.broadcast(d)).select((F.coalesce("s", F.lit(0.0)) / F.col("d")).alias("covariance_penalty"))


def neighbour_entropy(latents: DataFrame, group: str, temperature: float, gamma: float) -> DataFrame:
    """group, and -gamma times the mean entropy of softmax(-distance / temperature) over all rows of the group.

    The work of a group is the square of its rows: groups are training batches of bounded size.
    """
    a = latents.select(F.col(group).alias("g"), "id", F.col("embedding").alias("v"))
    b = latents.select(F.col(group).alias("g"), F.col("id").alias("id2"), F.col("embedding").alias("v2"))
    d = F.sqrt(F.aggregate(F.zip_with("v", "v2", lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))
    w = a.join(b, "g").select("g", "id", F.exp(-d / temperature).alias("w"))  # the row itself has distance 0, so no sum vanishes
    q = w.withColumn("q", F.col("w") / F.sum("w").over(Window.partitionBy("g", "id")))
    h = q.groupBy("g", "id").agg((-F.sum(F.col("q") * F.ln(F.col("q") + 1e-8))).alias("h"))
    return h.groupBy(F.col("g").alias(group)).agg((-gamma * F.avg("h")).alias("neighbour_entropy"))


def soft_cross_entropy(rows: DataFrame) -> DataFrame:
    """One row: mean over row_id of -sum of target * log_softmax(score), for (row_id, cluster, score, target)."""
    by = Window.partitionBy("row_id")
    top = F.max("score").over(by)
    lse = top + F.ln(F.sum(F.exp(F.col("score") - F.col("top"))).over(by))
    scored = rows.withColumn("top", top).withColumn("lse", lse)
    per = scored.groupBy("row_id").agg((-F.sum(F.col("target") * (F.col("score") - F.col("lse")))).alias("loss"))
    return per.agg(F.avg("loss").alias("soft_cross_entropy"))


def sinkhorn(scores: DataFrame, eps: float = 0.05, rounds: int = 3, mode: str = "reference") -> DataFrame:
    """(row_id, cluster, q): balanced soft assignments of (row_id, cluster, score).

    q starts as exp(score / eps) (less the greatest score, for stability); each round divides rows by their sum and K,
    then clusters by their sum and B; at the end all is multiplied by K. mode="balanced" divides rows by their sum once
    more, so that each adds up to 1. Every half round is one window sum; clusters, of which there are few, are summed by
    an aggregation with partial sums and a join, since a window would put a cluster's rows into one task.
    """
    if mode not in ("reference", "balanced"):
        raise ValueError(f"mode is reference or balanced, not {mode!r}")
    sizes = scores.agg(F.count_distinct("row_id").alias("b"), F.count_distinct("cluster").alias("k"), F.max("score").alias("top"))
    q = scores.join(F.broadcast(sizes)).select("row_id", "cluster", "b", "k", F.exp((F.col("score") - F.col("top")) / eps).alias("q"))
    row = F.sum("q").over(Window.partitionBy("row_id"))
    for _ in range(rounds):
        q = materialize(q.withColumn("q", F.col("q") / row / F.col("k")), "sinkhorn")  # read twice below
        sums = q.groupBy("cluster").agg(F.sum("q").alias("s"))
        q = q.join(F.broadcast(sums), "cluster").withColumn("q", F.col("q") / F.col("s") / F.col("b")).drop("s")  # one row per cluster
    q = q.withColumn("q", F.col("q") * F.col("k"))
    if mode == "balanced":
        q = q.withColumn("q", F.col("q") / row)
    return q.select("row_id", "cluster", "q")


def view_consistency(scores1: DataFrame, scores2: DataFrame, weight: float = 1.0, **kwargs) -> DataFrame:
    """One row: weight times the cross-entropy of the second view's scores against the first view's assignments."""
    targets = sinkhorn(scores1, **kwargs).withColumnRenamed("q", "target")
    loss = soft_cross_entropy(scores2.join(targets, ["row_id", "cluster"]))
    return loss.select((weight * F.col("soft_cross_entropy")).alias("consistency_loss"))


def vicreg_score(latents: DataFrame, gv: float, gc: float) -> DataFrame:
    """One row: gv times the variance penalty plus gc times the covariance penalty."""
    both = variance_penalty(latents).join(F.broadcast(covariance_penalty(latents)))
    return both.select((gv * F.col("variance_penalty") + gc * F.col("covariance_penalty")).alias("vicreg"))


def total_loss(loss: float, latents: DataFrame, group: str, gv: float, gc: float, temperature: float, gamma: float) -> DataFrame:
    """One row: 0.1 loss + vicreg + 0.05 neighbour entropy, averaged over groups."""
    near = neighbour_entropy(latents, group, temperature, gamma).agg(F.avg("neighbour_entropy").alias("e"))
    return vicreg_score(latents, gv, gc).join(F.broadcast(near)).select((0.1 * loss + F.col("vicreg") + 0.05 * F.col("e")).alias("total"))
