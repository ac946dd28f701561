"""Fitted operators: scaling, PCA, clustering, neighbours, encoding, and their composites.

Latents are (id, embedding array). Models hold d x d or k x d numbers at most; rows never go to the driver.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.functions import array_to_vector, predict_batch_udf
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lithograph.functions import resample
from lithograph.functions.geo import file_stem
from lithograph.operators.folds import fit_folds, held_out
from lithograph.operators.graph import connected_components
from lithograph.operators.hierarchy import density_hierarchy
from lithograph.operators.neighbours import best_of, exact_pairs, knn_edges, lsh_pairs, pairs_within
from lithograph.operators.pca import PcaModel, RowsOf, as_matrix, fit_pca, moments, pca_reconstruct, stored, transform_pca
from lithograph.operators.sampling import dense_index
from lithograph.operators.spectral import spectral_clusters
from lithograph.operators.ward import ward_clusters
from lithograph.session import materialize

METHODS = ("kmeans", "gmm", "spectral", "agglomerative", "bisecting", "density")
TECHNIQUES = ("pca",)


def scale_stats(df: DataFrame, col: str) -> DataFrame:
    """One row: mean and population std of each dimension, as arrays."""
    _, mean, std = moments(df, col)
    return df.sparkSession.createDataFrame([(mean.tolist(), std.tolist())], "mean array<double>, std array<double>")


def standard_scale(df: DataFrame, col: str, stats: DataFrame | None = None) -> DataFrame:
    """df with col scaled to mean 0 and population std 1; dimensions without spread become 0."""
    joined = df.join(F.broadcast(scale_stats(df, col) if stats is None else stats))  # one row
    centred = F.zip_with(col, "mean", lambda x, m: x.cast("double") - m)
    return joined.withColumn(col, F.zip_with(centred, "std", lambda x, s: F.when(s > 0, x / s).otherwise(0.0))).drop("mean", "std")


def inverse_scale(df: DataFrame, col: str, stats: DataFrame) -> DataFrame:
    joined = df.join(F.broadcast(stats))
    return joined.withColumn(col, F.zip_with(F.zip_with(col, "std", lambda x, s: x * s), "mean", lambda x, m: x + m)).drop("mean", "std")


def pca_2d(df: DataFrame, col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(id, x1, x2) and (pc, ratio)."""
    model = fit_pca(df, col, 2)
    coords = transform_pca(df, col, model).select("id", F.col("pcs")[0].alias("x1"), F.get("pcs", F.lit(1)).alias("x2"))
    return coords, explained_variance(df, model)


def explained_variance(df: DataFrame, model: PcaModel) -> DataFrame:
    """pc, ratio, cumulative."""
    rows = [(i + 1, float(r), float(c)) for i, (r, c) in enumerate(zip(model.explained, np.cumsum(model.explained), strict=True))]
    return df.sparkSession.createDataFrame(rows, "pc int, ratio double, cumulative double")


def pca_variance(df: DataFrame, col: str = "embedding", share: float = 0.95) -> PcaModel:
    """The fewest components that keep a share of the variance."""
    return fit_pca(df, col, share=share)


def cluster(df: DataFrame, k: int = 4, method: str = "kmeans", col: str = "embedding", seed: int = 42, **options) -> DataFrame:
    """(id, cluster) by the named method; clusters are numbered from 0, noise of density clustering is -1."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; one of {', '.join(METHODS)}")
    if method == "density":
        return density_cut(df, col=col, **options) if "radius" in options or options.get("mode") == "lsh" else density_hierarchy(df, col=col, **options)
    if method == "spectral":
        return spectral_clusters(df, k, col, seed=seed, **options)
    if method == "agglomerative":
        return ward_clusters(df, k, col, seed=seed, **options)
    rows = df.select("id", col, array_to_vector(F.transform(col, lambda x: x.cast("double"))).alias("features"))
    if method in ("kmeans", "bisecting"):
        made = (KMeans if method == "kmeans" else BisectingKMeans)(k=k, seed=seed, predictionCol="cluster").fit(rows)
        return made.transform(rows).select("id", "cluster")
    reduced = transform_pca(df, col, fit_pca(df, col, options.get("components", 10)))  # full covariances need few dimensions
    rows = reduced.select("id", array_to_vector("pcs").alias("features"))
    return GaussianMixture(k=k, seed=seed, predictionCol="cluster").fit(rows).transform(rows).select("id", "cluster")


def density_cut(df: DataFrame, col: str = "embedding", min_size: int = 10, min_samples: int = 10, radius: float | None = None, mode: str = "exact", bucket: float = 1.0, tables: int = 5, seed: int = 42) -> DataFrame:
    """(id, cluster): core points have min_samples rows within radius (themselves included); cores within radius of each
    other join, other rows within radius of a core take the nearest one's cluster, and groups below min_size are noise (-1).

    One cut at one radius, by default the median distance to the min_samples-th row; density_hierarchy looks at all. mode is exact
    or lsh, which needs a radius.
    """
    if mode == "lsh":
        if radius is None:
            raise ValueError("lsh needs a radius")
        pairs = materialize(lsh_pairs(df, col, radius, bucket, tables, seed), "density-pairs")
    else:
        if radius is None:
            kth = best_of(exact_pairs(df, col, max(1, min_samples - 1)), max(1, min_samples - 1)).groupBy("id").agg(F.max("distance").alias("d"))
            radius = kth.agg(F.percentile_approx("d", 0.5)).first()[0] or 0.0
        pairs = pairs_within(df, col, radius)
    near = materialize(pairs.filter(F.col("distance") <= radius), "density-near")
    cores = materialize(near.groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") + 1 >= min_samples).select("id"), "density-cores")
    links = near.join(cores, "id").join(cores.withColumnRenamed("id", "neighbour"), "neighbour")
    own = connected_components(links.select(F.col("id").alias("a"), F.col("neighbour").alias("b")).union(cores.select("id", "id")))
    reach = near.join(own.withColumnRenamed("id", "neighbour"), "neighbour").join(cores, "id", "left_anti")
    border = reach.groupBy("id").agg(F.min_by("component", F.struct("distance", "neighbour")).alias("component"))
    member = own.unionByName(border)
    big = member.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") >= min_size)
    numbered = big.withColumn("cluster", (F.row_number().over(Window.orderBy("component")) - 1).cast("int")).drop("n")  # one row per cluster
    found = member.join(numbered, "component").select("id", "cluster")
    return df.select("id").join(found, "id", "left").select("id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def cv_probabilities(df: DataFrame, label: str, col: str = "embedding", folds: int = 5, features: int = 100, gamma: float | None = None, cost: float = 1.0, seed: int = 42) -> DataFrame:
    """(id, prob): held-out class probabilities of a multinomial regression on random Fourier features, k-fold by class.

    folds is cut to the size of the smallest class; with fewer than two rows there, no row comes out, nor does one for a row without label
    or vector. Classes are in the order of their labels. All folds are fitted together, one pass over the rows a step.
    """
    rows = df.select("id", F.col(label).alias("label"), F.col(col).alias("x")).filter("label IS NOT NULL AND x IS NOT NULL")
    sizes = rows.groupBy("label").agg(F.count("*").alias("n"))
    classes, smallest = sizes.agg(F.count("*"), F.coalesce(F.min("n"), F.lit(0))).first()
    folds = min(folds, smallest)
    if folds < 2:
        return df.limit(0).select("id", F.array().cast("array<double>").alias("prob"))
    _, mean, std = moments(rows, "x")
    d, spread = len(mean), float((std**2).mean() + mean.var()) or 1.0
    gamma = gamma or 1.0 / (d * spread)
    rng = np.random.default_rng(seed)
    w, b = rng.normal(0, np.sqrt(2 * gamma), (d, features)), rng.uniform(0, 2 * np.pi, features)

    def lift(batches):
        for batch in batches:
            x = as_matrix(batch.column("x"))
            if len(x):
                seen = [batch.column(c).to_numpy()[:, None].astype(np.float64) for c in ("y", "fold")]
                numbers = np.concatenate([*seen, np.sqrt(2 / features) * np.cos(x.astype(np.float64) @ w + b)], axis=1)
                lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * numbers.shape[1], numbers.ravel())
                yield pa.RecordBatch.from_arrays([batch.column("id"), lists], ["id", "numbers"])

    # places by class and draw: rows of one class follow each other, so that folds share each class evenly
    drawn = dense_index(rows.withColumn("draw", F.md5(F.concat_ws("-", F.col("id").cast("string"), F.lit(str(seed))))), "label", "draw", "id")
    indexed = sizes.select("label", (F.row_number().over(Window.orderBy("label")) - 1).alias("y"))  # one row per class
    placed = drawn.join(F.broadcast(indexed), "label").select("id", "y", (F.col("idx") % folds).alias("fold"), "x")
    lifted = materialize(placed.mapInArrow(lift, f"id {df.schema['id'].dataType.simpleString()}, numbers array<double>"), "cv-rows")
    return held_out(lifted, "numbers", fit_folds(lifted, "numbers", classes, folds, cost))


def encode(chips: DataFrame, encoder: PcaModel | Callable[[], Callable], col: str = "px", batch_size: int = 400, rows_of: RowsOf = stored) -> DataFrame:
    """(id, embedding): by a PCA model (rows_of as for fit_pca), or by a maker of a function from a batch (n, pixels) to (n, latents)."""
    if isinstance(encoder, PcaModel):
        return transform_pca(chips, col, encoder, "embedding", rows_of).select("id", "embedding")
    run = predict_batch_udf(encoder, return_type=_floats(), batch_size=batch_size, input_tensor_shapes=[[chips.agg(F.max(F.size(col))).first()[0]]])
    return chips.select("id", run(F.transform(col, lambda x: x.cast("float"))).alias("embedding"))


def encode_labelled(images: DataFrame, listing: DataFrame, components: int = 8, size: int = 224) -> DataFrame:
    """(id, state, embedding) of labelled images: (name, shape, px) with rows of bytes, and (name, state) of the listing.

    Images are brought to size x size pixels and to 0 .. 1, turned so that their darker half is on the right, and encoded by their own components.
    """
    h, w = F.element_at("shape", -2), F.element_at("shape", -1)
    resized = images.select("name", resample.resize(F.col("px"), h, w, size, size, "bilinear", True).alias("px"))
    ready = resized.select(F.col("name").alias("id"), resample.oriented_unit(F.col("px"), size, size).alias("px"))
    ready = materialize(ready, "labelled", wide=True)
    states = listing.select(file_stem(F.col("name")).alias("id"), "state")
    return encode(ready, fit_pca(ready, "px", components)).join(states, "id").select("id", "state", "embedding")


def reconstruct(chips: DataFrame, model: PcaModel, col: str = "px") -> DataFrame:
    """(id, x, xhat): chips beside what a PCA model makes of them."""
    scores = transform_pca(chips, col, model)
    return pca_reconstruct(scores, model).select("id", F.transform(col, lambda x: x.cast("double")).alias("x"), F.col("reconstructed").alias("xhat"))


def _floats():
    from pyspark.sql.types import ArrayType, FloatType

    return ArrayType(FloatType())


def cluster_and_assign(latents: DataFrame, method: str = "kmeans", k: int = 4, technique: str = "pca", reduce_95: bool = False, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(assignments, coords, explained variance): optional PCA to 95 % of the variance, clustering, a 2-D layout."""
    if technique not in TECHNIQUES:
        raise ValueError(f"unknown technique {technique!r}; one of {', '.join(TECHNIQUES)}")
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; one of {', '.join(METHODS)}")
    n = latents.count()
    if n < k:
        raise ValueError(f"{n} rows for {k} clusters")
    rows = latents.select("id", "embedding")
    if reduce_95:
        rows = transform_pca(rows, "embedding", pca_variance(rows), "reduced").select("id", F.col("reduced").alias("embedding"))
    coords, explained = pca_2d(rows)
    return cluster(rows, k, method, seed=seed), coords, explained


def compare_clusters(latents: DataFrame, states: DataFrame, method: str = "kmeans", k: int = 4, combine_labels: bool = False, **options) -> DataFrame:
    """One row of scores of fitted clusters against (id, state); with combine_labels both sides have two classes."""
    from lithograph.operators.evaluation import compare_given

    found, coords, _ = cluster_and_assign(latents, method, 2 if combine_labels else k, **options)
    rows = states.select("id", F.col("state").alias("gt")).join(found.select("id", F.col("cluster").alias("pred")), "id").join(coords, "id")
    return compare_given(materialize(rows, "compare"), combine_labels)
