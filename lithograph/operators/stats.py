"""Statistics of chips, chip pairs and training histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithograph.functions.chips import half_means


def _total(px: Column, of=lambda x: x) -> Column:
    return F.aggregate(px, F.lit(0.0), lambda a, x: a + of(x.cast("double")))


def per_channel(chips: DataFrame, c: int) -> DataFrame:
    """One row per chip and channel, with the channel's pixels in px."""
    n = (F.size("px") / c).cast("int")
    planes = F.array(*[F.struct(F.lit(k).alias("channel"), F.slice("px", n * k + 1, n).alias("px")) for k in range(c)])
    return chips.select("id", F.explode(planes).alias("p")).select("id", "p.channel", "p.px")


def channel_stats(chips: DataFrame, c: int = 1, two_pass: bool = False) -> DataFrame:
    """channel, mean, std (population), n_px over all pixels of all chips.

    One aggregation of counts, sums and sums of squares; two_pass takes deviations from the mean in a second one, which
    is better for pixels with a mean far from zero.
    """
    planes = per_channel(chips, c)
    sums = planes.groupBy("channel").agg(F.sum(F.size("px")).alias("n_px"), F.sum(_total(F.col("px"))).alias("s"), F.sum(_total(F.col("px"), lambda x: x * x)).alias("s2"))
    mean = F.col("s") / F.col("n_px")
    if not two_pass:
        return sums.select("channel", mean.alias("mean"), F.sqrt(F.greatest(F.col("s2") / F.col("n_px") - mean * mean, F.lit(0.0))).alias("std"), "n_px")
    means = sums.select("channel", mean.alias("mean"), "n_px")
    spread = planes.join(F.broadcast(means.select("channel", "mean")), "channel")  # one row per channel
    off = F.aggregate("px", F.lit(0.0), lambda a, x: a + (x.cast("double") - F.col("mean")) * (x.cast("double") - F.col("mean")))
    spread = spread.groupBy("channel").agg(F.sum(off).alias("d2"))
    return means.join(spread, "channel").select("channel", "mean", F.sqrt(F.col("d2") / F.col("n_px")).alias("std"), "n_px")


def validate_sample(chips: DataFrame, n: int = 1000, c: int = 1) -> DataFrame:
    """channel, min, max, mean, std over the first min(n, rows) chips by id."""
    first = per_channel(chips.orderBy("id").limit(n), c)
    ends = first.groupBy("channel").agg(F.min(F.array_min("px")).alias("min"), F.max(F.array_max("px")).alias("max"))
    return ends.join(channel_stats(chips.orderBy("id").limit(n), c), "channel").select("channel", "min", "max", "mean", "std")


def image_stats(chips: DataFrame) -> DataFrame:
    """id, h, w, min, max, mean, std of each chip."""
    n, px = F.size("px"), F.col("px")
    mean = _total(px) / n
    square = _total(px, lambda x: x * x) / n
    return chips.select("id", "h", "w", F.array_min("px").alias("min"), F.array_max("px").alias("max"), mean.alias("mean"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("std"))


def collection_summary(stats: DataFrame) -> DataFrame:
    """One row over image_stats."""
    return stats.agg(
        F.min("mean").alias("mean_lo"), F.max("mean").alias("mean_hi"), F.avg("mean").alias("mean_avg"), F.min("std").alias("std_lo"), F.max("std").alias("std_hi"),
        F.avg("std").alias("std_avg"), F.min("min").alias("px_min"), F.max("max").alias("px_max"),
    )


def data_range(chips: DataFrame) -> DataFrame:
    """One row: min, max and mean of all pixels."""
    return chips.agg(F.min(F.array_min("px")).alias("min"), F.max(F.array_max("px")).alias("max"), (F.sum(_total(F.col("px"))) / F.sum(F.size("px"))).alias("mean"))


def orientation_report(chips: DataFrame, n: int = 100, least: float = 80.0) -> DataFrame:
    """One row over the first n chips by id: how many are darker on the right, their share in %, and whether that is low."""
    left, right = half_means(F.col("px"), F.col("h"), F.col("w"))
    seen = chips.orderBy("id").limit(n).select(left.alias("l"), right.alias("r"))
    out = seen.agg(F.count("*").alias("n_checked"), F.count_if(F.col("r") < F.col("l")).alias("n_right_darker"))
    share = F.when(F.col("n_checked") > 0, F.col("n_right_darker") * 100.0 / F.col("n_checked"))
    return out.withColumn("percent", share).withColumn("warn", F.coalesce(share < least, F.lit(False)))


def dataset_report(chips: DataFrame, bytes_per_px: int = 4) -> DataFrame:
    """One row: records and bytes."""
    return chips.agg(F.count("*").alias("n_records"), F.coalesce(F.sum(F.size("px").cast("long") * bytes_per_px), F.lit(0)).alias("n_bytes"))


def pixel_diff(pairs: DataFrame) -> DataFrame:
    """name, max and mean absolute difference of a and b, and whether they are identical."""
    d = F.zip_with("a", "b", lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    return pairs.select("name", F.array_max(d).alias("max_abs"), (_total(d) / F.size(d)).alias("mean_abs"), (F.array_max(d) == 0).alias("identical"))


def epoch_losses(history: DataFrame, *by: str) -> DataFrame:
    """epoch, split (and further columns): loss = sum of batch loss by batch size, over all rows of the batches."""
    keys = ["epoch", "split", *by]
    return history.groupBy(*keys).agg((F.sum(F.col("batch_loss") * F.col("batch_n")) / F.sum("batch_n")).alias("loss"))


def final_losses(losses: DataFrame, *by: str) -> DataFrame:
    """The loss of the last epoch of each split."""
    return losses.groupBy("split", *by).agg(F.max_by("loss", "epoch").alias("final_loss"), F.max("epoch").alias("last_epoch"))


def reconstruction_mse(pairs: DataFrame) -> DataFrame:
    """id and mean squared difference of x and xhat."""
    d = F.zip_with("x", "xhat", lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double")))
    return pairs.select("id", (_total(d) / F.size(d)).alias("mse"))


def with_stats(chips: DataFrame, stats: DataFrame) -> DataFrame:
    """Chips of one channel with that channel's mean and std on each row."""
    return chips.join(F.broadcast(stats.filter("channel = 0").select("mean", "std")))  # one row
