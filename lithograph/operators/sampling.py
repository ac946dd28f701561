"""Seeded samples, splits and dense positions; the order of a sample is the order of an MD5 of key and seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithograph.session import materialize


def seeded_order(key: str, seed: int = 42) -> Column:
    return F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed))))


def sample_n(df: DataFrame, n: int, seed: int = 42, key: str = "id") -> DataFrame:
    """Exactly min(n, rows) rows without replacement; all rows for n <= 0."""
    return df.orderBy(seeded_order(key, seed), key).limit(n) if n > 0 else df


def subset_n(df: DataFrame, n: int, seed: int = 42, key: str = "id") -> DataFrame:
    """min(n, rows) rows for training; none for n <= 0."""
    return df.orderBy(seeded_order(key, seed), key).limit(max(0, n))


def random_k(df: DataFrame, k: int, seed: int = 42, key: str = "id") -> DataFrame:
    return subset_n(df, k, seed, key)


def sample_per_group(df: DataFrame, group: str, k: int, seed: int = 42, key: str = "id") -> DataFrame:
    """Up to k rows of each group; Spark keeps the best k of each task before it shuffles."""
    order = Window.partitionBy(group).orderBy(seeded_order(key, seed), key)
    return df.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= k).drop("_rank")


def first_k(df: DataFrame, key: str, k: int) -> DataFrame:
    return df.orderBy(key).limit(k)


def dense_index(df: DataFrame, *keys: str) -> DataFrame:
    """df with idx = 0, 1, .. in the order of keys.

    Rows are dealt by ranges of the keys and written once; each range numbers its own rows and adds the rows of the
    ranges before it, so that no task sees more than its range. The window without a partition runs over one row per range.
    """
    part = materialize(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = part.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    ranked = part.withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy(*keys)))
    return ranked.join(offsets, "_part").withColumn("idx", F.col("_offset") + F.col("_rank") - 1).drop("_part", "_rank", "_offset")


def linspace_rows(df: DataFrame, m: int, key: str = "id") -> DataFrame:
    """m rows spread evenly over the order of key: positions trunc(i * (n - 1) / (m - 1)), i = 0 .. m - 1."""
    indexed = dense_index(df, key)
    last = indexed.agg((F.count("*") - 1).alias("last")).filter("last >= 0")
    step = F.lit(0.0) if m <= 1 else F.col("last").cast("double") / (m - 1)
    wanted = last.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(max(m, 1) - 1)), lambda i: F.floor(i * step).cast("long"))).alias("idx"))
    return indexed.join(wanted, "idx").drop("idx") if m > 0 else indexed.limit(0).drop("idx")


def batch_id(df: DataFrame, size: int, key: str = "id") -> DataFrame:
    """df with batch = position // size in the order of key."""
    return dense_index(df, key).withColumn("batch", F.floor(F.col("idx") / size)).drop("idx")


def train_val_split(df: DataFrame, frac: float = 0.2, seed: int = 42, key: str = "id", exact: bool = True) -> DataFrame:
    """df with split = val for int(rows * frac) rows in the seeded order, else train.

    exact=False decides each row by itself, so that the size is only about frac, and needs no shuffle.
    """
    if not exact:
        share = F.conv(F.substring(seeded_order(key, seed), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
        return df.withColumn("split", F.when(share < frac, "val").otherwise("train"))
    ordered = dense_index(df.withColumn("_order", seeded_order(key, seed)), "_order", key).drop("_order")
    n = ordered.agg(F.floor(F.count("*") * F.lit(frac)).alias("_val"))
    return ordered.join(F.broadcast(n)).withColumn("split", F.when(F.col("idx") < F.col("_val"), "val").otherwise("train")).drop("idx", "_val")
