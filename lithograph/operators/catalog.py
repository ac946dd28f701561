"""Operators on the feature catalogue: filters, metadata, crop windows, and joins by name or id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithograph.functions.geo import CATALOG_RADIUS_M, crop_box, project_equirect, wrap_lon


def filter_catalog(df: DataFrame, dmin: float, dmax: float, lat_lo: float, lat_hi: float) -> DataFrame:
    """Features with diameter and latitude in the ranges, bounds included; null and NaN drop out."""
    return df.filter(F.col("diam_km").between(dmin, dmax) & F.col("lat").between(lat_lo, lat_hi))


def filter_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: how many rows there were, stayed and went."""
    n, m = before.agg(F.count("*").alias("n_before")), after.agg(F.count("*").alias("n_after"))
    return n.join(F.broadcast(m)).withColumn("n_dropped", F.col("n_before") - F.col("n_after"))  # one row by one row


def build_metadata(df: DataFrame, radius_m: float = CATALOG_RADIUS_M) -> DataFrame:
    """id, lat, lon in -180 .. 180, x and y in metres, diameter in metres."""
    x, y = project_equirect(wrap_lon(F.col("lon")), F.col("lat"), radius_m)
    return df.select(F.col("crater_id").alias("id"), "lat", wrap_lon(F.col("lon")).alias("lon"), x.alias("x"), y.alias("y"), (F.col("diam_km") * 1000).alias("diam"))


def crop_boxes(df: DataFrame, offset: float, radius_m: float = CATALOG_RADIUS_M) -> DataFrame:
    """The catalogue with minx, miny, maxx, maxy."""
    x, y = project_equirect(wrap_lon(F.col("lon")), F.col("lat"), radius_m)
    box = crop_box(x, y, F.col("lat"), F.col("diam_km"), offset)
    return df.withColumns(dict(zip(("minx", "miny", "maxx", "maxy"), box, strict=True)))


def pixel_windows(boxes: DataFrame, geo: DataFrame) -> DataFrame:
    """boxes with the pixel window r0, c0, h, w: floor at the near edge, ceil at the far one, clipped to the raster.

    geo has one row: x0, y0 (top left), xres, yres, width, height.
    """
    joined = boxes.join(F.broadcast(geo.select("x0", "y0", "xres", "yres", "width", "height").limit(1)))
    clip = lambda c, most: F.least(F.greatest(c.cast("long"), F.lit(0).cast("long")), most.cast("long"))
    c0 = clip(F.floor((F.col("minx") - F.col("x0")) / F.col("xres")), F.col("width"))
    c1 = clip(F.ceil((F.col("maxx") - F.col("x0")) / F.col("xres")), F.col("width"))
    r0 = clip(F.floor((F.col("y0") - F.col("maxy")) / F.col("yres")), F.col("height"))
    r1 = clip(F.ceil((F.col("y0") - F.col("miny")) / F.col("yres")), F.col("height"))
    return joined.withColumns({"r0": r0, "c0": c0, "h": r1 - r0, "w": c1 - c0}).drop("x0", "y0", "xres", "yres", "width", "height")


def valid_windows(windows: DataFrame) -> DataFrame:
    """Windows that hold at least one pixel."""
    return windows.filter("h > 0 AND w > 0")


def restrict_to_ids(catalog: DataFrame, ids: DataFrame) -> DataFrame:
    """Catalogue rows whose crater_id is among ids."""
    return catalog.join(ids.select("crater_id"), "crater_id", "left_semi")


def pair_by_name(left: DataFrame, right: DataFrame) -> DataFrame:
    """(name, a, b) for the names both sides have."""
    return left.select("name", F.col("px").alias("a")).join(right.select("name", F.col("px").alias("b")), "name")


def shape_mismatch(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs whose sides differ in size, the rest)."""
    same = F.size("a") == F.size("b")
    return pairs.filter(~same), pairs.filter(same)


def attach_latents(metadata: DataFrame, latents: DataFrame) -> DataFrame:
    """Metadata with the latent vector of the same id."""
    return metadata.join(latents, "id")


def join_truth(states: DataFrame, assignments: DataFrame) -> DataFrame:
    """(id, gt, pred)."""
    return states.select("id", F.col("state").alias("gt")).join(assignments.select("id", "pred"), "id")


def reconcile(left: DataFrame, right: DataFrame, mode: str = "strict") -> DataFrame:
    """Rows of both sides brought together: by id (strict), or by their rank in the order of id (compat).

    Adds n_unmatched, the rows of the longer side that found no partner.
    """
    from lithograph.operators.sampling import dense_index

    if mode not in ("strict", "compat"):
        raise ValueError(f"mode is strict or compat, not {mode!r}")
    n = left.agg(F.count("*").alias("n_left")).join(F.broadcast(right.agg(F.count("*").alias("n_right"))))
    if mode == "strict":
        both = left.join(right, "id")
    else:
        both = dense_index(left, "id").join(dense_index(right.withColumnRenamed("id", "right_id"), "right_id"), "idx").drop("idx", "right_id")
    matched = both.agg(F.count("*").alias("n_matched"))
    extra = n.join(F.broadcast(matched)).select((F.greatest("n_left", "n_right") - F.col("n_matched")).alias("n_unmatched"))
    return both.join(F.broadcast(extra))


def drop_nan(df: DataFrame, col: str) -> DataFrame:
    """Rows without a NaN or null in an array column."""
    return df.filter(~F.exists(col, lambda x: x.isNull() | F.isnan(x.cast("double"))))


def common_names(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("name").intersect(b.select("name"))


def concat_runs(*dfs: DataFrame) -> DataFrame:
    """Rows of several runs, columns matched by name."""
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df)
    return out


def label_union(gt: DataFrame, pred: DataFrame, gt_col: str = "gt", pred_col: str = "pred") -> DataFrame:
    return gt.select(F.col(gt_col).alias("label")).union(pred.select(F.col(pred_col).alias("label"))).distinct()


def label_domain(df: DataFrame, col: str) -> DataFrame:
    """One row: the sorted array of the labels present."""
    return df.agg(F.array_sort(F.collect_set(col)).alias("labels"))


def labelled_listing(paths: DataFrame) -> DataFrame:
    """path, name, state: the integer between the first "_" and the next "." of the file name."""
    name: Column = F.regexp_extract("path", r"([^/]+)$", 1)
    return paths.select("path", name.alias("name"), F.split(F.get(F.split(name, "_"), F.lit(1)), r"\.")[0].cast("int").alias("state"))
