"""Chip functions and resamplers against NumPy, with edge cases."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lithograph.functions import chips as E
from lithograph.functions import resample
from lithograph.functions.register import register_all


def frame(spark, images):
    return spark.createDataFrame([(i, int(a.shape[0]), int(a.shape[1]), [int(v) for v in a.ravel()]) for i, a in enumerate(images)], "id int, h int, w int, px array<int>")


def run(df, col):
    return [np.array(r[0]) for r in df.orderBy("id").select(col).collect()]


@pytest.fixture(scope="module")
def images():
    rng = np.random.default_rng(0)
    return [rng.integers(0, 256, s) for s in ((8, 8), (4, 6), (3, 5), (2, 3), (1, 1), (6, 4))] + [np.full((4, 4), 7)]


def args():
    return F.col("px"), F.col("h"), F.col("w")


def test_mirror_twice_is_the_chip(spark, images):
    df = frame(spark, images)
    once = df.withColumn("px", E.mirror(*args()))
    assert all((a == b.ravel()).all() for a, b in zip(run(once, "px"), [i[:, ::-1] for i in images], strict=True))
    assert all((a == b.ravel()).all() for a, b in zip(run(once.withColumn("px", E.mirror(*args())), "px"), images, strict=True))


def test_orient_puts_the_dark_half_right_and_mirrors_ties(spark, images):
    got = run(frame(spark, images), E.orient(*args()))
    for image, px in zip(images, got, strict=True):
        w = image.shape[1]
        q, m = w // 4, w // 2
        left = image[:, q:m].mean() if m > q else np.nan
        right = image[:, m : w - q].mean() if q else np.nan
        want = image if left > right else image[:, ::-1]
        assert (px == want.ravel()).all()


def test_orient_ignores_a_constant(spark, images):
    df = frame(spark, images)
    a, b = run(df, E.orient(*args())), run(df.withColumn("px", F.transform("px", lambda x: x + 9)), E.orient(*args()))
    assert all((x + 9 == y).all() for x, y in zip(a, b, strict=True))


def test_masks(spark):
    df = spark.createDataFrame([(0, [1, 0, 0, 1], [1.0] * 16, [2.0] * 16)], "id int, mask array<int>, r array<double>, o array<double>")
    df = df.withColumn("m", E.expand_mask(F.col("mask"), 2, 4))
    want = np.kron(np.array([[1, 0], [0, 1]]), np.ones((2, 2))).ravel()
    assert (run(df, "m")[0] == want).all()
    assert (run(df, E.composite(F.col("r"), F.col("o"), F.col("m")))[0] == np.where(want > 0, 1.0, 2.0)).all()
    assert (run(df, E.masked_only(F.col("o"), F.col("m")))[0] == np.where(want > 0, 2.0, 0.5)).all()


@pytest.mark.parametrize("kernel", ["bilinear", "bicubic"])
@pytest.mark.parametrize("antialias", [False, True])
def test_resampling_keeps_constants_and_size(kernel, antialias):
    for a, b in ((8, 8), (8, 16), (16, 5), (1, 4)):
        m = resample.resample_matrix(a, b, kernel, antialias)
        assert m.shape == (b, a)
        assert np.allclose(m.sum(axis=1), 1)
    assert np.allclose(resample.resample_matrix(8, 8, kernel, antialias), np.eye(8))


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 30), st.integers(1, 30))
def test_bilinear_stays_within_the_values(a, b):
    m = resample.resample_matrix(a, b, "bilinear")
    assert (m >= 0).all()


def test_resize_udf(spark, images):
    df = frame(spark, images[:2])
    out = run(df, resample.resize(*args(), 5, 7, "bilinear"))
    for image, px in zip(images, out, strict=False):
        want = resample.resample_matrix(image.shape[0], 5) @ image @ resample.resample_matrix(image.shape[1], 7).T
        assert np.allclose(px, want.ravel(), atol=1e-3)
    fixed = df.select("id", F.size(resample.aspect_fix(*args(), F.lit(60.0))).alias("n"), resample.aspect_height(F.col("h"), F.lit(60.0)).alias("h"), "w").orderBy("id").collect()
    assert [r.n for r in fixed] == [r.h * r.w for r in fixed]


def test_noise_and_erasing_repeat(spark, images):
    df = frame(spark, images)
    for made in (lambda: resample.add_noise(F.transform("px", lambda x: x / 255.0), F.col("id")), lambda: E.erase_random(*args(), F.col("id"), p=1.0)):
        assert all(np.allclose(a, b) for a, b in zip(run(df, made()), run(df.repartition(3), made()), strict=True))
    erased = run(frame(spark, [np.full((20, 20), 5)] * 20), E.erase_random(*args(), F.col("id"), p=1.0))
    assert all(0 < (e == 0).sum() <= 0.1 * e.size for e in erased)


def test_sql_names(spark):
    names = register_all(spark)
    assert "wrap_lon" in names
    row = spark.sql("SELECT wrap_lon(180.01D) a, wrap_lon(180D) b, file_stem('/x/y.tar.png') c, chip_mirror(array(1D,2D,3D,4D), 2, 2) d").first()
    assert round(row.a, 2) == -179.99 and row.b == 180 and row.c == "y.tar" and row.d == [2.0, 1.0, 4.0, 3.0]


def test_sql_names_give_what_the_functions_give(spark):
    """Each function by its name in SQL text and as a column, over the same chips."""
    import math
    import random

    from lithograph.functions import geo as G
    from lithograph.functions import resample as R

    register_all(spark)
    rng = random.Random(2)
    rows = [(i, 8, w, [float(rng.randrange(256)) for _ in range(8 * w)], [float(rng.randrange(256)) for _ in range(8 * w)], [float(rng.random() < 0.5) for _ in range(8 * w)], [1.0, 0.0, 0.0, 1.0], rng.uniform(-89, 89), rng.uniform(0, 360), rng.randrange(1, 5), f"/a/b/c{i}_{i % 4}.x.png") for i, w in enumerate([8, 8, 3, 12, 1, 8] * 6)]
    rows.append((99, 1, 2, [math.nan, 1.0], [1.0, 2.0], [0.0, 1.0], [1.0, 0.0, 0.0, 1.0], 90.0, 180.0, 3, "n"))
    df = spark.createDataFrame(rows, "id int, h int, w int, px array<double>, other array<double>, mask array<double>, patches array<double>, lat double, lon double, state int, path string")
    px, h, w, other, mask, lat, lon, key = (F.col(c) for c in ("px", "h", "w", "other", "mask", "lat", "lon", "id"))
    left, right = E.half_means(px, h, w)
    box = G.crop_box(lon, lat, lat, F.lit(4.0), 0.5)
    pairs = {
        "chip_mirror(px, h, w)": E.mirror(px, h, w), "chip_left_mean(px, h, w)": left, "chip_right_mean(px, h, w)": right, "chip_orient(px, h, w)": E.orient(px, h, w),
        "chip_to_unit(px)": E.to_unit(px), "chip_to_gray(px, 2)": E.to_gray(px, 2), "chip_replicate(px, 3)": E.replicate(px, 3), "chip_standardize(px, 9D, 2D)": E.standardize(px, F.lit(9.0), F.lit(2.0)),
        "chip_destandardize(px, 9D, 2D)": E.destandardize(px, F.lit(9.0), F.lit(2.0)), "chip_clamp(px, 20D, 90D)": E.clamp(px, 20, 90), "chip_display_scale(chip_standardize(px, 127D, 40D))": E.display_scale(E.standardize(px, F.lit(127.0), F.lit(40.0))),
        "chip_expand_mask(patches, 4, 8)": E.expand_mask(F.col("patches"), 4, 8), "chip_masked_only(px, mask, 0.5D)": E.masked_only(px, mask), "chip_composite(px, other, mask)": E.composite(px, other, mask),
        "chip_abs_diff(px, other)": E.abs_diff(px, other), "chip_vflip_random(px, h, w, cast(id AS STRING), '42', 0.5D)": E.vflip_random(px, h, w, key), "chip_erase_random(px, h, w, cast(id AS STRING), '42', 0.7D)": E.erase_random(px, h, w, key, p=0.7),
        "has_nan(px)": E.has_nan(px), "wrap_lon(lon)": G.wrap_lon(lon), "project_x(lon, 10D)": G.project_equirect(lon, lat, 10.0)[0], "project_y(lat, 10D)": G.project_equirect(lon, lat, 10.0)[1],
        "combine_states(state)": G.combine_states(F.col("state")), "state_name(state, map(1, 'new'))": G.state_name(F.col("state"), {1: "new"}), "file_stem(path)": G.file_stem(F.col("path")),
        "crop_box(lon, lat, lat, 4D, 0.5D).min_x": box[0], "crop_box(lon, lat, lat, 4D, 0.5D).max_y": box[3], "aspect_height(h, lat * 0.9)": R.aspect_height(h, lat * 0.9),
        "chip_resize(px, h, w, 5, 7)": R.resize(px, h, w, 5, 7), "chip_resize_bicubic(px, h, w, 5, 7)": R.resize(px, h, w, 5, 7, "bicubic", True), "chip_add_noise(px, cast(id AS STRING))": R.add_noise(px, key),
        "shape_differs(px, other)": F.size(px) != F.size(other), "km_to_m(lat)": lat * 1000,
    }
    columns = [c for i, (sql, column) in enumerate(pairs.items()) for c in (F.expr(sql).alias(f"s{i}"), column.alias(f"c{i}"))]
    same = lambda a, b: a == b or (isinstance(a, list) and len(a) == len(b) and all(same(x, y) for x, y in zip(a, b))) or (isinstance(a, float) and (math.isclose(a, b, rel_tol=1e-12) or (math.isnan(a) and math.isnan(b))))
    for row in df.select(*columns).collect():
        for i, sql in enumerate(pairs):
            assert same(row[f"s{i}"], row[f"c{i}"]), (sql, row[f"s{i}"], row[f"c{i}"])
    assert spark.sql("SELECT in_catalog_bounds(5D, 10D, 1D, 10D, -60D, 60D) a, in_catalog_bounds(double('nan'), 0D, 1D, 10D, -60D, 60D) b, in_catalog_bounds(NULL, 0D, 1D, 10D, -60D, 60D) c, label_of_file('/a/x_3.png') d").first()[:] == (True, False, False, 3)


def test_orient_by_batches_is_orient(spark):
    import random

    from lithograph.functions import chips, resample

    rng = random.Random(1)
    rows = [(i, h, w, [rng.randrange(4) for _ in range(h * w)]) for i, (h, w) in enumerate((rng.randint(1, 6), rng.randint(1, 9)) for _ in range(80))]
    df = spark.createDataFrame(rows, "id int, h int, w int, px array<int>")
    args = [F.col(c) for c in ("px", "h", "w")]
    assert df.filter(chips.orient(*args) != resample.orient(*args)).count() == 0


def test_resized_chips_go_out_a_bounded_number_of_pixels_at_a_time(spark):
    chips = [pd.Series([np.arange(64)] * 100), *(pd.Series([n] * 100) for n in (8, 8, 224, 224))]
    out = list(resample.resize_udf().func(iter([chips])))
    assert sum(map(len, out)) == 100 and max(sum(map(len, part)) for part in out) < resample.MOST_PIXELS + 224 * 224
    some = spark.range(300).select("id", resample.resize(F.array(*(F.lit(float(i)) for i in range(63)), F.col("id").cast("double")), F.lit(8), F.lit(8), 224, 224).alias("px"))
    assert {(r.id, r.last) for r in some.select("id", F.col("px")[50175].alias("last")).collect()} == {(i, i) for i in range(300)}


def test_orienting_by_the_batch_gives_the_very_pixels_of_the_columns(spark, images):
    rng = np.random.default_rng(1)
    df = frame(spark, [*images, *(rng.integers(0, 3, (4, 8)) for _ in range(40))]).withColumn("px", F.col("px").cast("array<float>"))
    unit = df.withColumn("px", E.to_unit(F.col("px")))
    for a, b in zip(run(unit, E.orient(*args())), run(df, resample.oriented_unit(*args())), strict=True):
        assert (a == b).all()
