"""Catalogue, raster, sampling, evaluation and learning operators on small hand-made tables."""

import itertools
from unittest import mock

import numpy as np
import pytest
from pyspark.sql import functions as F

from lithograph.functions import chips, resample
from lithograph.functions import geo as G
from lithograph.operators import catalog, embedding, evaluation, learning, raster, sampling, stats
from lithograph.operators.graph import connected_components


def test_catalog_bounds_and_nan(spark):
    rows = [("a", 60.0, 180.0, 1.0), ("b", -60.0, 180.01, 10.0), ("c", 60.1, 0.0, 5.0), ("d", 0.0, 0.0, 10.5), ("e", None, 0.0, 5.0), ("f", float("nan"), 0.0, 5.0), ("g", 90.0, 0.0, 5.0)]
    df = spark.createDataFrame(rows, "crater_id string, lat double, lon double, diam_km double")
    assert [r[0] for r in catalog.filter_catalog(df, 1, 10, -60, 60).orderBy("crater_id").collect()] == ["a", "b"]
    assert df.select(G.wrap_lon(F.col("lon"))).collect()[1][0] == pytest.approx(-179.99)
    assert catalog.crop_boxes(df.filter("crater_id = 'g'"), 0.5).first().minx is None
    assert catalog.filter_report(df, df.limit(0)).first() == (7, 0, 7)


def test_pixel_windows_clip(spark):
    geo = spark.createDataFrame([(0.0, 100.0, 1.0, 1.0, 100, 100)], "x0 double, y0 double, xres double, yres double, width long, height long")
    boxes = spark.createDataFrame([(1, -5.0, 95.0, 2.5, 105.0), (2, 200.0, 10.0, 210.0, 20.0), (3, 10.2, 10.2, 12.7, 12.7)], "id int, minx double, miny double, maxx double, maxy double")
    got = {r.id: (r.r0, r.c0, r.h, r.w) for r in catalog.pixel_windows(boxes, geo).collect()}
    assert got[1] == (0, 0, 5, 3) and got[2][3] == 0 and got[3] == (87, 10, 3, 3)
    assert catalog.valid_windows(catalog.pixel_windows(boxes, geo)).count() == 2


@pytest.fixture(scope="module")
def scene(spark):
    image = np.random.default_rng(1).integers(0, 256, (24, 32))
    tiles = [(r, c, image[r * 8 : r * 8 + 8, c * 8 : c * 8 + 8].ravel().tolist()) for r in range(3) for c in range(4)]
    return image, spark.createDataFrame(tiles, "tile_row long, tile_col long, px array<int>")


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_windows_are_slices(spark, scene, parts):
    image, tiles = scene
    w = [(0, 0, 0, 1, 1), (1, 5, 6, 10, 20), (2, 0, 0, 24, 32), (3, 23, 31, 1, 1), (4, 8, 8, 8, 8), (5, 3, 3, 0, 4)]
    df = spark.createDataFrame(w, "id long, r0 long, c0 long, h long, w long").repartition(parts)
    got = {r.id: r.px for r in raster.extract_windows(df, tiles.repartition(parts), 8).collect()}
    assert set(got) == {0, 1, 2, 3, 4}
    for i, r0, c0, h, wide in w[:5]:
        assert got[i] == image[r0 : r0 + h, c0 : c0 + wide].ravel().tolist()


def test_roll_and_highpass(spark, scene):
    image, tiles = scene
    geo = spark.createDataFrame([(0.0, 90.0, 1.0, 1.0, 32, 24, 8)], "x0 double, y0 double, xres double, yres double, width long, height long, tile int")
    rolled, moved = raster.roll_half(tiles, geo, 8)
    got = {(r.tile_row, r.tile_col): r.px for r in rolled.collect()}
    want = np.roll(image, 16, axis=1)
    assert all(px == want[r * 8 : r * 8 + 8, c * 8 : c * 8 + 8].ravel().tolist() for (r, c), px in got.items())
    assert moved.first().x0 == -180
    for radius in (1, 9):  # the second reaches past one tile
        out = {(r.tile_row, r.tile_col): r.px for r in raster.highpass(tiles, 8, radius=radius).collect()}
        for r, c in ((0, 0), (13, 17), (23, 31)):
            box = image[max(0, r - radius) : r + radius + 1, max(0, c - radius) : c + radius + 1]
            assert out[r // 8, c // 8][(r % 8) * 8 + c % 8] == int(np.floor(np.clip(image[r, c] - box.mean() + 128 + 1e-9, 0, 255)))


@pytest.mark.parametrize("sigma, tile", [(2.0, 8), (5.0, 4)])
def test_gaussian_highpass_around_an_absent_tile(spark, scene, sigma, tile):
    image, _ = scene
    rows = [(r, c, image[r * tile : (r + 1) * tile, c * tile : (c + 1) * tile].ravel().tolist()) for r in range(24 // tile) for c in range(32 // tile) if (r, c) != (1, 1)]
    got = {(r.tile_row, r.tile_col): r.px for r in raster.highpass(spark.createDataFrame(rows, "tile_row long, tile_col long, px array<int>"), tile, sigma=sigma).collect()}
    assert set(got) == {(r, c) for r, c, _ in rows}
    reach = int(np.ceil(3 * sigma))
    there = np.ones(image.shape)
    there[tile : 2 * tile, tile : 2 * tile] = 0
    for y, x in ((0, 0), (tile - 1, tile - 1), (13, 17), (23, 31), (2 * tile, 2 * tile)):
        box = np.s_[max(0, y - reach) : y + reach + 1, max(0, x - reach) : x + reach + 1]
        yy, xx = (axis[box] for axis in np.indices(image.shape))
        k = np.exp(-((yy - y) ** 2 + (xx - x) ** 2) / (2 * sigma**2)) * there[box]
        assert got[y // tile, x // tile][(y % tile) * tile + x % tile] == int(np.floor(np.clip(image[y, x] - (k * image[box]).sum() / k.sum() + 128, 0, 255)))


@pytest.mark.parametrize("radius, sigma", [(1, None), (None, 2.0)])
def test_highpass_beside_an_unfinished_row_of_tiles(spark, scene, radius, sigma):
    """The last row of tiles ends early: pixels above its end see its last pixel across the corner."""
    image, _ = scene
    rows = [(r, c, image[r * 8 : (r + 1) * 8, c * 8 : (c + 1) * 8].ravel().tolist()) for r in range(3) for c in range(4 if r < 2 else 2)]
    got = {(r.tile_row, r.tile_col): r.px for r in raster.highpass(spark.createDataFrame(rows, "tile_row long, tile_col long, px array<int>"), 8, radius, sigma).collect()}
    assert set(got) == {(r, c) for r, c, _ in rows}
    there = np.ones(image.shape)
    there[16:, 16:] = 0
    reach = radius or 6
    for y, x in [*((y, x) for y in range(10, 16) for x in range(12, 22)), (16, 15), (23, 15), (0, 0)]:
        box = np.s_[max(0, y - reach) : y + reach + 1, max(0, x - reach) : x + reach + 1]
        yy, xx = (axis[box] for axis in np.indices(image.shape))
        k = there[box] * (1 if radius else np.exp(-((yy - y) ** 2 + (xx - x) ** 2) / 8))
        assert got[y // 8, x // 8][(y % 8) * 8 + x % 8] == int(np.floor(np.clip(image[y, x] - (k * image[box]).sum() / k.sum() + 128, 0, 255)))


def test_highpass_sends_strips(spark):
    tile, reach = 32, 75  # as sigma 100 is to tiles of 128
    rows = spark.range(25).select(F.floor(F.col("id") / 5).alias("tile_row"), (F.col("id") % 5).alias("tile_col"), F.array_repeat(F.lit(1.0), tile * tile).alias("px"))
    rows = rows.withColumn("sums", F.col("px")).withColumn("weight", F.array_repeat(F.lit(1.0), tile))
    for axis in ("tile_row", "tile_col"):
        sent = raster.strips(rows, tile, reach, axis).select("step", F.size("sums").alias("n"), F.size("px").alias("px")).collect()
        assert len(sent) == 25 * 7  # 2 * rings + 1 a tile, where squares of neighbours would be 49
        assert {(abs(r.step), r.n) for r in sent} == {(0, 1024), (1, 1024), (2, 1024), (3, (75 - 64) * 32)}
        assert all((r.px == 1024) == (r.step == 0) for r in sent)


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_samples_do_not_depend_on_partitions(spark, parts):
    df = spark.range(100).repartition(parts)
    base = spark.range(100).repartition(2)
    ids = lambda d: sorted(r.id for r in d.collect())
    for n in (0, 1, 37, 100, 500):
        assert ids(sampling.sample_n(df, n)) == ids(sampling.sample_n(base, n))
        assert sampling.sample_n(df, n).count() == (min(n, 100) if n > 0 else 100)
    assert ids(sampling.train_val_split(df).filter("split = 'val'")) == ids(sampling.train_val_split(base).filter("split = 'val'"))
    assert sampling.train_val_split(df).filter("split = 'val'").count() == 20
    assert [r.idx for r in sampling.dense_index(df, "id").orderBy("id").collect()] == list(range(100))
    assert ids(sampling.linspace_rows(df, 4)) == [0, 33, 66, 99]
    assert sampling.dense_index(df.limit(0), "id").count() == 0


def ct(spark, table):
    return spark.createDataFrame([(g, p, n) for g, row in enumerate(table) for p, n in enumerate(row) if n], "gt int, pred int, n long")


def test_label_scores(spark):
    perfect = ct(spark, [[0, 5, 0], [3, 0, 0], [0, 0, 4]])
    assert evaluation.adjusted_rand(perfect).first()[0] == pytest.approx(1)
    assert evaluation.v_measure(perfect).first().v_measure == pytest.approx(1)
    assert evaluation.nmi(perfect).first()[0] == pytest.approx(1)
    a, b = ct(spark, [[3, 2], [1, 6]]), ct(spark, [[3, 1], [2, 6]])
    assert evaluation.adjusted_rand(a).first()[0] == pytest.approx(evaluation.adjusted_rand(b).first()[0])
    assert {(r.pred, r.gt) for r in evaluation.align_labels(perfect).collect()} == {(1, 0), (0, 1), (2, 2)}
    assert evaluation.align_labels(ct(spark, [[0]])).count() == 0


def test_assignment_ties_go_to_the_least_in_order_of_pred(spark):
    draw = np.random.default_rng(5)
    for shape in ((3, 3), (4, 2), (2, 4), (4, 4)):
        table = draw.integers(0, 3, shape)  # classes by predicted labels, with many ties
        classes, labels = [*range(shape[0]), *[None] * max(0, shape[1] - shape[0])], range(shape[1])
        ways = set(itertools.permutations(classes, len(labels)))
        score = lambda w: sum(table[g, p] for p, g in enumerate(w) if g is not None)
        best = min(ways, key=lambda w: (-score(w), [99 if g is None else g for g in w]))  # noqa: B023
        got = {(r.pred, r.gt) for r in evaluation.align_labels(ct(spark, table.tolist())).collect()}
        assert got == {(p, g) for p, g in enumerate(best) if g is not None}


@pytest.mark.parametrize("across", [2, 3, 5])
def test_roll_half_where_half_the_width_is_not_whole_tiles(spark, across):
    image = np.arange(8 * 4 * across).reshape(8, 4 * across)
    rows = [(r, c, image[r * 4 : r * 4 + 4, c * 4 : c * 4 + 4].ravel().tolist()) for r in range(2) for c in range(across)]
    tiles, geo = spark.createDataFrame(rows, "tile_row long, tile_col long, px array<int>"), spark.createDataFrame([(0.0, 4 * across)], "x0 double, width long")
    want = np.roll(image, 2 * across, axis=1)
    got = {(r.tile_row, r.tile_col): r.px for r in raster.roll_half(tiles, geo, 4)[0].collect()}
    assert got == {(r, c): want[r * 4 : r * 4 + 4, c * 4 : c * 4 + 4].ravel().tolist() for r, c, _ in rows}
    with pytest.raises(ValueError):
        raster.roll_half(tiles, geo, 3 if across != 3 else 5)


def test_assignment_beyond_permutations(spark):
    rng = np.random.default_rng(2)
    table = rng.integers(0, 50, (9, 9))
    table[np.arange(9), (np.arange(9) + 3) % 9] += 1000
    got = {(r.pred, r.gt) for r in evaluation.align_labels(ct(spark, table.tolist())).collect()}
    assert got == {((g + 3) % 9, g) for g in range(9)}


def test_geometry(spark):
    pts = np.array([[0, 0], [2, 0], [0, 1], [3, 4.0]])
    turn = np.array([[0, -1], [1, 0]])
    rows = [(i, *map(float, a), *map(float, b)) for i, (a, b) in enumerate(zip(pts, pts @ turn * 2.5 + 7, strict=True))]
    df = spark.createDataFrame(rows, "gt int, g1 double, g2 double, p1 double, p2 double")
    assert evaluation.procrustes_disparity(df).first()[0] == pytest.approx(0, abs=1e-9)
    assert evaluation.centroid_distance_corr(df).first()[0] == pytest.approx(1)
    assert evaluation.procrustes_disparity(df.limit(1)).first()[0] is None
    assert evaluation.centroid_distance_corr(df.limit(1)).first()[0] is None


def test_silhouette_edges(spark):
    df = spark.createDataFrame([(0, 0, 0.0, 0.0), (1, 0, 0.0, 1.0), (2, 1, 5.0, 5.0)], "id long, l int, x1 double, x2 double")
    b = [np.hypot(5, 5), np.hypot(5, 4)]
    assert evaluation.silhouette(df, "l").first()[0] == pytest.approx(((b[0] - 1) / b[0] + (b[1] - 1) / b[1]) / 3)
    assert evaluation.silhouette(df.filter("l = 0"), "l").first()[0] is None


def test_silhouette_takes_all_of_many_rows(spark):
    n, odd = 10050, 100  # two points, with some of the second cluster at the first one's
    df = spark.range(2 * n).select("id", (F.col("id") >= n).cast("int").alias("l"), F.when(F.col("id") >= n + odd, 10.0).otherwise(0.0).alias("x1"), F.lit(0.0).alias("x2"))
    away = 10 * odd / (n - 1)
    want = (n * 1.0 + odd * -1.0 + (n - odd) * (10 - away) / 10) / (2 * n)
    assert evaluation.silhouette(df, "l").first()[0] == pytest.approx(want, rel=1e-12)


def test_silhouettes_by_blocks(spark):
    rng = np.random.default_rng(3)
    x, l, m = rng.normal(size=(90, 2)), rng.integers(0, 3, 90), rng.integers(0, 2, 90)
    df = spark.createDataFrame([(i, int(l[i]), int(m[i]), *map(float, x[i])) for i in range(90)], "id long, l int, m int, x1 double, x2 double")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    want = []
    for k in (l, m):
        a = [d[i][k == k[i]].sum() / ((k == k[i]).sum() - 1) for i in range(90)]
        b = [min(d[i][k == o].mean() for o in set(k.tolist()) - {k[i]}) for i in range(90)]
        want.append(np.mean([(q - p) / max(p, q) for p, q in zip(a, b)]))
    assert evaluation.silhouettes(df, ["l", "m"], block_rows=16).first()[:] == pytest.approx(tuple(want))


def test_comparison_with_more_predicted_labels_than_classes(spark):
    rng = np.random.default_rng(4)
    gt = rng.integers(1, 3, 200)
    pred = np.where(rng.random(200) < 0.6, gt, rng.integers(3, 6, 200))
    rows = [(i, int(gt[i]), int(pred[i]), float(gt[i] * 5 + rng.normal()), float(rng.normal())) for i in range(200)]
    got = evaluation.compare_given(spark.createDataFrame(rows, "id long, gt int, pred int, x1 double, x2 double")).first()
    matched = np.where(pred < 3, pred, -1)
    ct = spark.createDataFrame([(int(a), int(b)) for a, b in zip(gt, matched)], "gt int, pred int")
    assert got.standard_metrics.ari == pytest.approx(evaluation.adjusted_rand(evaluation.contingency(ct)).first()[0])
    assert got.standard_metrics.nmi == pytest.approx(evaluation.nmi(evaluation.contingency(ct)).first()[0])
    raw = evaluation.contingency(spark.createDataFrame([(int(a), int(b)) for a, b in zip(gt, pred)], "gt int, pred int"))
    assert got.structural_similarity.v_measure == pytest.approx(evaluation.v_measure(raw).first()["v_measure"])
    assert set(got.structural_similarity.asDict()) == {"disparity", "distance_corr", "v_measure", "silhouette_pred", "silhouette_true"}
    assert 0 < got.continuum_evidence.boundary_uncertainty < np.log(2)


def test_windows_over_absent_tiles_raise(spark, scene):
    _, tiles = scene
    windows = spark.createDataFrame([(0, 0, 0, 4, 4), (1, 16, 0, 4, 4)], "id long, r0 long, c0 long, h long, w long")
    some = tiles.filter("tile_row < 2")
    for run in (raster.extract_windows, raster.window_stats):
        with pytest.raises(Exception, match="a tile is missing under window 1"):
            run(windows, some, 8).collect()


def test_window_stats_are_those_of_the_chips(spark, scene):
    image, tiles = scene
    windows = spark.createDataFrame([(0, 0, 0, 1, 1), (1, 5, 6, 10, 20), (2, 0, 0, 24, 32)], "id long, r0 long, c0 long, h long, w long")
    px = np.concatenate([image[:1, :1].ravel(), image[5:15, 6:26].ravel(), image.ravel()])
    got = raster.window_stats(windows, tiles, 8).first()
    assert got.n_px == len(px) and got.mean == pytest.approx(px.mean()) and got.std == pytest.approx(px.std())
    assert raster.window_stats(windows.limit(0), tiles, 8).count() == 0


def test_window_stats_take_corners_not_tiles(spark, scene):
    """Many windows of all sizes against plain sums, around a hole that none touches; no row for every window and tile is made."""
    image, tiles = scene
    rng = np.random.default_rng(5)
    w = []
    while len(w) < 300:
        r, c = rng.integers(0, 24), rng.integers(0, 32)
        h, wide = rng.integers(1, 25 - r), rng.integers(1, 33 - c)
        if r >= 16 or r + h <= 8 or c >= 16 or c + wide <= 8:
            w.append((len(w), int(r), int(c), int(h), int(wide)))
    windows = spark.createDataFrame(w, "id long, r0 long, c0 long, h long, w long")
    px = np.concatenate([image[r : r + h, c : c + wide].ravel() for _, r, c, h, wide in w])
    with mock.patch.object(raster, "_window_parts", side_effect=AssertionError):
        got = raster.window_stats(windows, tiles.filter("tile_row <> 1 OR tile_col <> 1"), 8).first()
    assert got.n_px == len(px) and got.mean == pytest.approx(px.mean()) and got.std == pytest.approx(px.std())


def test_windows_become_chips_where_their_tiles_are(spark, scene):
    """map_windows with squared_chip against the crop, aspect, orientation and size one after the other; no part of a window travels."""
    image, tiles = scene
    rng = np.random.default_rng(6)
    starts = [(int(rng.integers(0, 24)), int(rng.integers(0, 32))) for _ in range(60)]
    w = [(i, r, c, int(rng.integers(1, 25 - r)), int(rng.integers(1, 33 - c)), float(rng.integers(-60, 61))) for i, (r, c) in enumerate(starts)]
    windows = spark.createDataFrame(w, "id long, r0 long, c0 long, h long, w long, lat double")
    crops = raster.extract_windows(windows, tiles, 8).join(windows.select("id", "lat"), "id")
    fixed = crops.select("id", "w", resample.aspect_height(F.col("h"), F.col("lat")).alias("h"), resample.aspect_fix(F.col("px"), F.col("h"), F.col("w"), F.col("lat")).alias("px"))
    want = {r.id: r.px for r in fixed.select("id", resample.resize(chips.orient(F.col("px"), F.col("h"), F.col("w")), F.col("h"), F.col("w"), 16, 16, "bicubic", True).alias("px")).collect()}
    with mock.patch.object(raster, "_window_parts", side_effect=AssertionError):
        for most in (1 << 28, 300):
            got = {r.id: r.px for r in raster.map_windows(windows, tiles, 8, lambda image, lat: resample.squared_chip(image, lat, 16), "lat", most).collect()}
            assert set(got) == set(want) == set(range(60)) and all(np.abs(np.array(got[i]) - want[i]).max() < 1e-3 for i in got)
        with pytest.raises(Exception, match="a tile is missing under window"):
            raster.map_windows(windows, tiles.filter("tile_row <> 1"), 8, lambda image, lat: resample.squared_chip(image, lat, 16), "lat").collect()


def test_tiles_under_windows_do_not_go_through_the_driver(spark, scene):
    """Pieces times the tiles under them look as small as the pieces to Spark's planner, which would broadcast them."""
    windows = spark.createDataFrame([(i, 0, 0, 24, 32, 0.0) for i in range(4)], "id long, r0 long, c0 long, h long, w long, lat double")
    found = raster.map_windows(windows, scene[1], 8, lambda image, lat: resample.squared_chip(image, lat, 16), "lat", 300)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" in plan and "Broadcast" not in plan, plan
    assert {len(r.px) for r in found.collect()} == {256}


def test_sinkhorn_sums(spark):
    rng = np.random.default_rng(3)
    rows = [(i, k, float(rng.normal())) for i in range(20) for k in range(4)]
    df = spark.createDataFrame(rows, "row_id long, cluster int, score double")
    q = embedding.sinkhorn(df)
    assert all(r.s == pytest.approx(4 / 20) for r in q.groupBy("cluster").agg(F.sum("q").alias("s")).collect())
    assert all(r.s == pytest.approx(1) for r in embedding.sinkhorn(df, mode="balanced").groupBy("row_id").agg(F.sum("q").alias("s")).collect())
    with pytest.raises(ValueError):
        embedding.sinkhorn(df, mode="other")


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 103), (103, 101), (200, 200)] + [(300, i) for i in range(301, 340)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(51)) and got[101] == got[103] == 100 and got[200] == 200 and got[339] == 300
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(4)
    centres = np.array([[0, 0, 0], [20, 0, 0], [0, 20, 0]])
    rows = [(i, (centres[i % 3] + rng.normal(0, 0.5, 3)).tolist()) for i in range(120)]
    return spark.createDataFrame(rows, "id long, embedding array<double>")


@pytest.mark.parametrize("method", ["kmeans", "agglomerative", "bisecting", "density", "gmm"])
def test_clusters_find_blobs(blobs, method):
    options = {"micro": 12} if method == "agglomerative" else {"components": 2} if method == "gmm" else {"radius": 3.0} if method == "density" else {}
    found = learning.cluster(blobs, 3, method, **options)
    rows = found.select(F.col("cluster").alias("pred"), (F.col("id") % 3).cast("int").alias("gt"))
    assert evaluation.adjusted_rand(evaluation.contingency(rows)).first()[0] > 0.95


def test_composite_errors_and_pca(blobs):
    with pytest.raises(ValueError):
        learning.cluster_and_assign(blobs.limit(2), k=3)
    with pytest.raises(ValueError):
        learning.cluster_and_assign(blobs, technique="umap")
    with pytest.raises(ValueError):
        learning.cluster(blobs, method="none")
    model = learning.fit_pca(blobs, "embedding", 3)
    back = learning.pca_reconstruct(learning.transform_pca(blobs, "embedding", model), model)
    assert all(np.allclose(r.embedding, r.reconstructed) for r in back.collect())
    assert model.explained.sum() == pytest.approx(1)
    scaled = learning.standard_scale(blobs, "embedding")
    stats_row = learning.scale_stats(blobs, "embedding")
    assert all(np.allclose(a.embedding, b.embedding) for a, b in zip(learning.inverse_scale(scaled, "embedding", stats_row).orderBy("id").collect(), blobs.orderBy("id").collect(), strict=True))


def test_held_out_probabilities(blobs):
    rows = blobs.withColumn("label", (F.col("id") % 3).cast("int"))
    got = learning.cv_probabilities(rows, "label", folds=3)
    assert got.count() == 120
    assert all(abs(sum(r.prob) - 1) < 1e-9 for r in got.collect())
    assert evaluation.boundary_uncertainty(got).first()[0] < 0.7
    assert learning.cv_probabilities(rows.limit(1), "label").count() == 0


def test_neighbours_by_lsh_are_near(blobs):
    exact = {(r.id, r.neighbour) for r in learning.knn_edges(blobs, 3).collect()}
    lsh = {(r.id, r.neighbour) for r in learning.knn_edges(blobs, 3, "lsh", bucket=4.0, tables=8, radius=5.0).collect()}
    assert len(exact & lsh) / len(exact) > 0.9


def test_density_by_lsh(blobs):
    with pytest.raises(ValueError):
        learning.cluster(blobs, method="density", mode="lsh")
    found = learning.cluster(blobs, method="density", mode="lsh", radius=3.0, bucket=4.0, tables=8)
    rows = found.select(F.col("cluster").alias("pred"), (F.col("id") % 3).cast("int").alias("gt"))
    assert evaluation.adjusted_rand(evaluation.contingency(rows)).first()[0] > 0.95


def test_channel_stats_edges(spark):
    flat = spark.createDataFrame([(0, 1, 2, [7, 7])], "id int, h int, w int, px array<int>")
    assert stats.channel_stats(flat).first()[1:3] == (7.0, 0.0)
    assert stats.channel_stats(flat.limit(0)).count() == 0
    assert stats.orientation_report(flat.limit(0)).first().n_checked == 0
    big = spark.createDataFrame([(0, [1e8 + v for v in (0.0, 1.0, 2.0, 3.0)])], "id int, px array<double>")
    assert stats.channel_stats(big, two_pass=True).first().std == pytest.approx(np.std([0, 1, 2, 3]))


def test_silhouette_by_cells_is_near_and_its_bounds_hold(spark):
    from lithograph.operators.cells import silhouette_by_cells

    rng = np.random.default_rng(12)
    k = rng.integers(0, 4, 1500)
    x = rng.normal(size=(1500, 2)) * np.array([0.05, 1.0, 2.0, 0.5])[k][:, None] + np.array([[0, 0], [3, 1], [-40, 2], [3, 3]])[k]
    x[:300] = x[0]  # many at one place, of all labels
    rows = [(i, f"c{k[i]}", float(x[i, 0]), float(x[i, 1])) for i in range(1500)]
    df = spark.createDataFrame([*rows, (1500, "alone", 9.0, 9.0), (1501, None, 0.0, 0.0), (1502, "c1", None, 1.0)], "id long, l string, x1 double, x2 double").repartition(3)
    clean = df.filter("l IS NOT NULL AND x1 IS NOT NULL").withColumn("k", F.ascii(F.substring("l", 2, 1)))
    exact = evaluation.silhouette(clean, "k").first()[0]
    wide, fine = silhouette_by_cells(df, "l", cells=100).first(), silhouette_by_cells(df, "l", cells=1000, precision=0.005).first()
    assert wide.low <= exact <= wide.high and fine.low <= exact <= fine.high
    assert fine.high - fine.low < (wide.high - wide.low) / 2
    assert abs(wide.silhouette - exact) < 0.01 and abs(fine.silhouette - exact) < 0.001
    assert silhouette_by_cells(df.filter("l = 'c1'"), "l").first()[:] == (None, None, None)
    assert silhouette_by_cells(df.limit(0), "l").first()[:] == (None, None, None)
