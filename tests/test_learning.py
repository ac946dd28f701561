"""PCA, neighbours, density hierarchy, Ward and spectral clusters against plain versions."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.sql import functions as F

from lithograph.functions import resample
from lithograph.operators import hierarchy, learning, neighbours, pca, spectral, ward


def table(spark, x, parts=3):
    return spark.createDataFrame([(i * 7 + 3, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>").repartition(parts)


def labels(df, n):
    found = {r.id: r.cluster for r in df.collect()}
    assert len(found) == n
    return [found[i * 7 + 3] for i in range(n)]


def same(a, b):
    return len(set(zip(a, b, strict=True))) == len(set(a)) == len(set(b))


# --- PCA


@pytest.mark.parametrize("solver", ["exact", "randomized"])
def test_components_against_a_whole_decomposition(spark, solver):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 12)) * 0.7 ** np.arange(12) @ rng.normal(size=(12, 200)) + 0.01 * rng.normal(size=(300, 200)) + 4
    df = table(spark, x).unionByName(spark.createDataFrame([(1, None)], "id long, embedding array<double>"))
    _, s, v = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    ratios = s**2 / (s**2).sum()
    model = pca.fit_pca(df, "embedding", 5, solver=solver)
    assert np.abs(np.abs((v[:5] * model.loadings.T).sum(axis=1)) - 1).max() < 1e-6
    assert np.abs(model.explained - ratios[:5]).max() < 1e-8
    most = pca.fit_pca(df, "embedding", share=0.9, solver=solver)
    assert most.loadings.shape[1] == np.searchsorted(np.cumsum(ratios), 0.9) + 1
    back = {r.id: r.reconstructed for r in pca.pca_reconstruct(pca.transform_pca(df, "embedding", model), model).collect()}
    assert back[1] is None
    want = x.mean(axis=0) + (x - x.mean(axis=0)) @ v[:5].T @ v[:5]
    assert max(np.abs(np.array(back[i * 7 + 3]) - want[i]).max() for i in range(300)) < 1e-5


def test_rows_of_less_rank_than_asked_for(spark):
    x = np.outer(np.arange(6.0), np.ones(1500)) + 1
    model = pca.fit_pca(table(spark, x), "embedding", 4)
    assert model.explained[0] == pytest.approx(1) and np.abs(np.abs(model.loadings[:, 0]) - 1500**-0.5).max() < 1e-9
    with pytest.raises(ValueError):
        pca.fit_pca(table(spark, x[:0]), "embedding", 2)
    with pytest.raises(ValueError):
        pca.fit_pca(table(spark, x), "embedding", 2, solver="exact")


def test_chips_of_full_size_encode(spark):
    made = F.transform(F.sequence(F.lit(0), F.lit(224 * 224 - 1)), lambda i: (F.sin(i / 500.0) * F.col("id") + F.cos(i / 90.0) * (F.col("id") % 7)).cast("float"))
    chips = spark.range(60).select("id", made.alias("px"))
    model = pca.fit_pca(chips, "px", 3)
    assert model.loadings.shape == (50176, 3) and model.explained[:2].sum() == pytest.approx(1, abs=1e-6)
    assert all(len(r.embedding) == 3 for r in learning.encode(chips, model).collect())


def test_full_size_chips_are_made_by_each_pass_and_not_stored(spark, sf_dir, monkeypatch):
    from lithograph.plans import queries

    rng = np.random.default_rng(5)
    sizes = [(8, 8)] * 30 + [(5, 9)] * 3 + [(8, 8)] * 20
    rows = [(i, rng.integers(0, 255, h * w).tolist(), h, w) for i, (h, w) in enumerate(sizes)]
    small = spark.createDataFrame(rows, "id long, px array<int>, h int, w int")
    full = small.select("id", resample.resize(F.col("px"), F.col("h"), F.col("w"), 40, 40, "bilinear", True).alias("px"))
    chips, rows_of = small.select("id", F.struct("px", "h", "w").alias("chip")), resample.resized_rows(40, 40, "bilinear", True)
    want, got = pca.fit_pca(full, "px", 4), pca.fit_pca(chips, "chip", 4, rows_of=rows_of)
    assert np.abs(want.mean - got.mean).max() < 1e-9 and np.abs(want.explained - got.explained).max() < 1e-9
    plain = {r.id: r.embedding for r in learning.encode(full, want).collect()}
    gone = chips.unionByName(spark.createDataFrame([(99, None)], "id long, chip struct<px array<int>, h int, w int>"))
    made = {r.id: r.embedding for r in learning.encode(gone, want, "chip", rows_of=rows_of).collect()}
    assert made.pop(99) is None and made.keys() == plain.keys() and all(np.abs(np.array(made[i]) - plain[i]).max() < 1e-3 for i in plain)

    kept, write = [], queries.materialize

    def seen(df, *args, **options):
        table = write(df, *args, **options)
        kept.append(table.agg(F.max(F.length(F.to_json(F.struct(*table.columns))))).first()[0])
        return table

    monkeypatch.setattr(queries, "materialize", seen)
    assert [tuple(r) for r in queries.QUERIES["M13_encode_full_size"](spark, sf_dir).select("n_px", "n_latents", "falls").collect()] == [(50176, 8, True)]
    assert all(n < 2000 for n in kept), kept  # no row holds a full-size chip


def test_a_pipeline_comes_back_as_it_was(spark, tmp_path):
    df = table(spark, np.random.default_rng(2).normal(size=(80, 9)))
    fitted = Pipeline(stages=[pca.Pca(k=3, scale=True), KMeans(k=3, seed=1)]).fit(df)
    fitted.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    assert again.stages[0].uid == fitted.stages[0].uid and again.stages[0].getOrDefault("scale")
    assert [r[:] for r in fitted.transform(df).orderBy("id").collect()] == [r[:] for r in again.transform(df).orderBy("id").collect()]


# --- neighbours


def test_exact_neighbours_and_ties(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.integers(0, 3, size=(60, 2)).astype(float), rng.normal(size=(40, 2))])
    got = {(r.id, r["rank"]): (r.neighbour, r.distance) for r in neighbours.knn_edges(table(spark, x), 4, block_rows=16).collect()}
    for i in range(len(x)):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((np.arange(len(x)), d)) if j != i][:4]
        assert [got[i * 7 + 3, r + 1] for r in range(4)] == [(j * 7 + 3, pytest.approx(d[j])) for j in order]
    within = {(r.id, r.neighbour) for r in neighbours.pairs_within(table(spark, x), "embedding", 1.0, 16).collect()}
    assert within == {(i * 7 + 3, j * 7 + 3) for i in range(100) for j in range(100) if i != j and ((x[i] - x[j]) ** 2).sum() <= 1}


def test_neighbours_rank_by_rounded_distances_as_the_sql_does(spark, tmp_path):
    import duckdb

    from lithograph.plans.queries import QUERIES, SQL

    at = {0: 0.0, 5: 1.0000001, 3: 1.0000004, 4: -1.0000002, 9: 0.9999999, 8: 7.0, 7: -7.0000005, 6: 3.0000003, 2: 3.0000001}
    spark.createDataFrame([(i, [x, 0.0], 0) for i, x in at.items()], "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(r) for r in QUERIES["M8_knn_edges"](spark, str(tmp_path)).select("id", "neighbour", "distance", "rank").collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    assert got == sorted(con.execute(SQL["M8_knn_edges"]).fetchall())
    df = spark.createDataFrame([(i, [x]) for i, x in at.items()], "id long, embedding array<double>")
    for options in ({"mode": "descent"}, {"block_rows": 2}, {"mode": "descent", "size": 1, "rounds": 0, "tables": 1, "block_rows": 2}):
        rows = learning.knn_edges(df, 2, digits=6, **options).filter("id = 0").orderBy("rank").collect()
        assert [(r["neighbour"], r["distance"]) for r in rows] == [(3, 1.0), (4, 1.0)], options


def test_pairs_of_blocks_are_dealt_evenly_and_blocks_grow_to_a_bound(spark):
    df = spark.range(4000).select("id", F.array(F.col("id") * 1.0).alias("embedding"))
    blocks, count = neighbours.packed_blocks(df, "embedding", 200)
    tasks = [r.n for r in neighbours.block_pairs(blocks, count).groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect()]
    assert sum(tasks) == 210 and max(tasks) <= 10  # by the join alone one task has all 20 pairs of a block at least
    assert neighbours.packed_blocks(df, "embedding")[1] == 2
    wide = spark.range(40).select("id", F.array_repeat(F.col("id") * 1.0, 1 << 18).alias("embedding"))
    assert neighbours.packed_blocks(wide, "embedding")[1] == 5  # of 8 rows, as a block's numbers are bounded


def test_descent_finds_nine_of_ten_in_less_than_all_pairs(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 16))[rng.integers(0, 40, 2500)] * 4 + rng.normal(size=(2500, 16))
    df = table(spark, x)
    exact = {(r.id, r.neighbour) for r in neighbours.knn_edges(df, 5).collect()}
    found, done = neighbours.descend(df, size=16, sample=6, block_rows=64)
    rows = neighbours.best_of(found, 5).collect()
    assert len(rows) == 5 * 2500 and len({(r.id, r.neighbour) for r in rows} & exact) > 0.9 * len(exact)
    assert sum(d["distances"] for d in done) < 0.7 * 2500 * 2499 / 2
    assert all(r.distance == pytest.approx(np.sqrt(((x[(r.id - 3) // 7] - x[(r.neighbour - 3) // 7]) ** 2).sum())) for r in rows[:200])


def test_descent_is_given_up_where_all_pairs_take_less(spark, monkeypatch):
    """Then all pairs are compared, and all neighbours are right; vectors that are stored in single precision travel so."""
    df = table(spark, np.random.default_rng(14).normal(size=(1500, 24)))
    small = df.select("id", F.col("embedding").cast("array<float>").alias("embedding"))
    options = {"size": 8, "sample": 4, "block_rows": 16, "tables": 2}
    written, plain = [], neighbours.materialize

    def seen(frame, name, *args):
        if name == "descent-rows":
            written.append(frame.schema["v"].dataType.simpleString())
        return plain(frame, name, *args)

    monkeypatch.setattr(neighbours, "materialize", seen)
    assert len(neighbours.descend(small, worth=1, **options)[1]) == 1  # lists to start with take more distances than 1500 * 1500 / 200
    free = neighbours.descend(small, rounds=2, **options)
    held = neighbours.descend(small.withColumn("embedding", F.col("embedding").cast("array<double>")), rounds=2, worth=neighbours.WORTH, **options)
    assert written == ["array<float>", "array<float>", "array<double>"] and free[1] == held[1] and len(free[1]) == 3
    assert sorted(map(tuple, free[0].collect())) == sorted(map(tuple, held[0].collect()))
    got = {(r.id, r.neighbour, r.rank) for r in neighbours.knn_edges(small, 5, "descent", worth=1, **options).collect()}
    assert got == {(r.id, r.neighbour, r.rank) for r in neighbours.knn_edges(small, 5).collect()}


def test_descent_of_copies_few_rows_and_none(spark):
    copies = neighbours.knn_edges(table(spark, np.ones((300, 4))), 3, "descent", size=8, sample=4, block_rows=32)
    assert copies.count() == 900 and copies.agg(F.max("distance")).first()[0] == 0
    assert neighbours.knn_edges(table(spark, np.arange(6.0).reshape(3, 2)), 5, "descent").count() == 6
    assert neighbours.knn_edges(table(spark, np.zeros((0, 2))), 5, "descent").count() == 0
    assert neighbours.knn_edges(table(spark, np.zeros((0, 2))), 5).count() == 0


def test_descent_makes_up_for_what_it_does_not_find(spark):
    """Nearly isotropic vectors and lists that are far too small: without the pass over all pairs, less than nine of ten."""
    x = np.random.default_rng(3).normal(size=(1200, 48))
    df = table(spark, x)
    few = neighbours.best_of(neighbours.descend(df, size=6, sample=2, block_rows=16, tables=1, rounds=1)[0], 5)
    assert neighbours.recall_of(few, df, "embedding", 5) < 0.8
    found = neighbours.knn_edges(df, 5, "descent", size=6, sample=2, block_rows=16, tables=1, rounds=1)
    want = {(r.id, r.neighbour) for r in neighbours.knn_edges(df, 5).collect()}
    got = {(r.id, r.neighbour) for r in found.collect()}
    assert len(got) == 6000 and got == want


@pytest.mark.parametrize("kind", ["normal", "grid", "far", "copies"])
def test_nearest_is_exact_where_single_precision_is_not(kind):
    rng = np.random.default_rng(5)
    make = {"normal": lambda n: rng.normal(size=(n, 6)), "grid": lambda n: rng.integers(0, 3, (n, 3)).astype(float), "far": lambda n: 1e3 + 100.0 * rng.integers(0, 2, (n, 1)) + 1e-4 * rng.normal(size=(n, 4)), "copies": lambda n: np.ones((n, 2))}[kind]
    a, b = make(600), make(5000 if kind in ("normal", "far") else 300)
    ids, others = rng.permutation(6000)[: len(a)], rng.permutation(6000)[: len(b)]
    i, j, d = neighbours.nearest(ids, a, others, b, 7)
    whole = np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2))
    whole[ids[:, None] == others[None, :]] = np.inf
    for row in range(0, len(a), 37):
        order = np.lexsort((others, whole[row]))[:7]
        assert j[i == ids[row]].tolist() == others[order].tolist()
        assert np.allclose(d[i == ids[row]], whole[row][order], rtol=1e-12, atol=0)


# --- density


def slow_hierarchy(x, m, k):
    """The clusters of a plain hierarchy of mutual reachability, the most stable ones standing."""
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    core = np.sort(d, axis=1)[:, k]
    reach = np.maximum(d, np.maximum(core[:, None], core[None]))
    up, node, kids, height, size = list(range(n)), list(range(n)), {}, {}, dict.fromkeys(range(n), 1)

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    top = n
    for w, i, j in sorted((reach[i, j], i, j) for i in range(n) for j in range(i + 1, n)):
        a, b = find(i), find(j)
        if a != b:
            up[a], kids[top], height[top], size[top] = b, (node[a], node[b]), w, size[node[a]] + size[node[b]]
            node[b], top = top, top + 1

    def rows(at):
        todo, out = [at], set()
        while todo:
            y = todo.pop()
            todo += kids.get(y, ())
            out |= {y} if y < n else set()
        return out

    def cluster(at, birth):
        whole, lived = rows(at), 0.0
        while True:
            density = 1 / max(height[at], 1e-10)
            big = [c for c in kids[at] if size[c] >= m]
            lived += (density - birth) * sum(size[c] for c in kids[at] if len(big) == 2 or c not in big)
            if len(big) != 1:
                return whole, lived, [cluster(c, density) for c in big]
            at = big[0]

    def best(c):
        below = [best(x) for x in c[2]]
        total = sum(s for s, _ in below)
        return (total, [w for _, ws in below for w in ws]) if c[2] and c[1] < total else (c[1], [c[0]])

    out = np.full(n, -1)
    for number, whole in enumerate(w for c in cluster(top - 1, 0.0)[2] for w in best(c)[1]):
        out[list(whole)] = number
    return out.tolist()


def uneven(seed):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal([0, 0], 0.2, (80, 2)), rng.normal([3, 0], 0.2, (60, 2)), rng.normal([20, 20], 4, (90, 2)), rng.uniform(-20, 40, (25, 2))])
    return x[rng.permutation(len(x))]


@pytest.mark.parametrize("seed, options", [(0, {}), (1, {"limit": 20, "block_rows": 64})])
def test_density_hierarchy_against_a_plain_one(spark, seed, options):
    x = uneven(seed)
    want = slow_hierarchy(x, 10, 10)
    got = labels(hierarchy.density_hierarchy(table(spark, x), **options), len(x))
    assert same(got, want) and all((g == -1) == (w == -1) for g, w in zip(got, want)) and len(set(want)) == 4
    if not options:
        assert not same(labels(learning.density_cut(table(spark, x)), len(x)), want)  # no one cut finds clusters of unequal density


def test_a_tree_of_large_blocks_is_put_together_of_small_ones(spark, monkeypatch):
    """As light as the tree from all distances, with no more edges; blocks grow with the rows, as each goes to every other."""
    rng = np.random.default_rng(12)
    v = rng.normal(size=(300, 3))
    core = np.sort(np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2)), axis=1)[:, 5]
    whole = np.sort(hierarchy._tree_of(v, core)[2])
    monkeypatch.setattr(hierarchy, "TREE_ROWS", 40)
    for most in (1, 500, 1 << 19):
        monkeypatch.setattr(hierarchy, "MOST_EDGES", most)
        sides = list(hierarchy.combinations(hierarchy._cut(0, 300), 2))
        i, j, w = hierarchy._tree_of_blocks(v, core, sides)
        assert np.abs(np.sort(w) - whole).max() < 1e-12 and len({*i.tolist(), *j.tolist()}) == 300
    dealt, plain = [], hierarchy.packed_blocks

    def seen(*args, **options):
        blocks, count = plain(*args, **options)
        dealt.append(count)
        return blocks, count

    monkeypatch.setattr(hierarchy, "packed_blocks", seen)
    x = rng.normal(size=(4096, 2))
    weights = sorted(r.w for r in hierarchy.spanning_forest(hierarchy.exact_edges(table(spark, x), "embedding", 5)).collect())
    near = np.sqrt(np.sort(neighbours.distances(x, x), axis=1)[:, 5])
    assert dealt == [2] and np.abs(weights - np.sort(hierarchy._tree_of(x, near)[2])).max() < 1e-6


def test_a_block_takes_its_distances_once(monkeypatch):
    """The tree has the least weight, also far from 0, and all distances come from one product."""
    rng = np.random.default_rng(11)
    calls, plain = [], hierarchy.distances
    monkeypatch.setattr(hierarchy, "distances", lambda a, b: calls.append(a.shape) or plain(a, b))
    x = 1e4 + rng.normal(size=(150, 5))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    core = np.sort(d, axis=1)[:, 4]
    i, j, w = hierarchy._tree_of(x, core)
    reach = np.maximum(d, np.maximum(core[:, None], core[None, :]))
    part, total = list(range(150)), 0.0
    for a, b in zip(*np.unravel_index(np.argsort(reach, axis=None), reach.shape)):
        if part[a] != part[b]:
            total += reach[a, b]
            part = [part[a] if p == part[b] else p for p in part]
    assert calls == [(150, 5)] and len(w) == 149 and abs(w.sum() - total) < 1e-9 * total
    assert np.allclose(w, reach[i, j], rtol=1e-12)


def test_density_hierarchy_on_a_neighbour_graph(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal([0, 0], 0.3, (70, 2)), rng.normal([9, 0], 0.3, (70, 2)), rng.normal([0, 9], 1.2, (70, 2))])
    got = labels(hierarchy.density_hierarchy(table(spark, x), mode="descent", size=24, sample=10, block_rows=64), len(x))
    inside = [(g, i // 70) for i, g in enumerate(got) if g >= 0]
    assert len(inside) > 180 and len(set(inside)) == 3


def test_choice_by_rounds_of_leaves(spark):
    rng = np.random.default_rng(6)
    tree = [(0, None)]
    for i in range(1, 60):
        tree.append((i, rng.integers(0, i)))
    rows = [(100 - i, None if p is None else 100 - int(p), float(rng.random() * 5), 10) for i, p in tree]
    df = spark.createDataFrame(rows, "cluster long, parent long, stability double, size long")
    whole, rounds = ({r.cluster: r.label for r in hierarchy.choose_clusters(df, limit).collect()} for limit in (1000, 5))
    assert whole == rounds and len(whole) == 60 and whole[100] is None


# --- Ward


def slow_ward(x, k):
    n, v, live, member = np.ones(len(x)), x.copy(), list(range(len(x))), {i: [i] for i in range(len(x))}
    while len(live) > k:
        a = np.array(live)
        d = ((v[a][:, None] - v[a][None]) ** 2).sum(axis=2) * (n[a][:, None] * n[a][None] / (n[a][:, None] + n[a][None]))
        np.fill_diagonal(d, np.inf)
        i, j = (a[t] for t in np.unravel_index(d.argmin(), d.shape))
        v[i], n[i] = (v[i] * n[i] + v[j] * n[j]) / (n[i] + n[j]), n[i] + n[j]
        member[i] += member.pop(j)
        live.remove(j)
    out = np.zeros(len(x), dtype=int)
    for number, rows in enumerate(member.values()):
        out[rows] = number
    return out.tolist()


@pytest.mark.parametrize("options", [{}, {"limit": 60, "block_rows": 128}])
def test_ward_against_one_merge_at_a_time(spark, options):
    x = np.random.default_rng(7).normal(size=(500, 5))
    assert same(labels(ward.ward_clusters(table(spark, x), 7, **options), 500), slow_ward(x, 7))


def test_ward_looks_anew_only_for_clusters_whose_nearest_merged(spark, monkeypatch):
    """After the first round, far fewer rows are looked for than there are clusters; the merges stay the same."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 6))
    clusters = table(spark, x).select("id", F.lit(1).alias("n"), F.col("embedding").alias("v"))
    packed, plain = [], ward.packed_blocks

    def counted(df, *args):
        packed.append(df.count())
        return plain(df, *args)

    monkeypatch.setattr(ward, "packed_blocks", counted)
    got = {(r.a, r.b): r.height for r in ward.ward_merges(clusters, 150, 64).collect()}
    whole, asked = packed[1::2], packed[2::2]  # the first round packs all clusters, each other one all and those asked for
    assert packed[0] == 400 and len(asked) >= 2 and all(a < n for n, a in zip(whole, asked))
    want = {(r.a, r.b): r.height for r in ward.ward_merges(clusters, 400).collect()}
    assert got.keys() == want.keys() and all(abs(got[e] - want[e]) < 1e-9 * want[e] for e in got)


def test_ward_sends_no_blocks_through_the_driver(spark, monkeypatch):
    """A table of blocks that is sent out anew for each block it meets looks small to Spark's planner, which would broadcast it."""
    plans, plain = [], ward.materialize

    def seen(df, name, *args):
        if name == "ward-near":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, name, *args)

    monkeypatch.setattr(ward, "materialize", seen)
    clusters = table(spark, np.random.default_rng(8).normal(size=(400, 6))).select("id", F.lit(1).alias("n"), F.col("embedding").alias("v"))
    assert ward.ward_merges(clusters, 150, 64).count() == 399
    assert len(plans) >= 2 and not any("Broadcast" in p for p in plans), plans
    assert all(p.count("hashpartitioning(block#") == 2 for p in plans), plans  # each block goes once to each of its pairs


def test_ward_of_copies_and_few_rows(spark):
    assert len(set(labels(ward.ward_clusters(table(spark, np.ones((30, 2))), 4), 30))) == 1
    few = np.repeat([[0.0, 0.0], [1.0, 0.0], [9.0, 9.0]], [20, 5, 5], axis=0)
    assert same(labels(ward.ward_clusters(table(spark, few), 2), 30), [0] * 25 + [1] * 5)
    assert labels(ward.ward_clusters(table(spark, np.ones((1, 2))), 1), 1) == [0]


def test_neighbours_shuffle_each_pair_of_blocks_and_each_candidate_once(spark):
    x = np.random.default_rng(11).normal(size=(400, 4))
    df = table(spark, x)
    plan = neighbours.knn_edges(df, 3, block_rows=100)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(id#") == 1 and "Broadcast" not in plan, plan  # candidates go to their id once; no vectors through the driver
    found = {(r.id, r.rank): r.neighbour for r in neighbours.knn_edges(df, 3, block_rows=100).collect()}
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    assert found == {(i * 7 + 3, r + 1): int(j) * 7 + 3 for i in range(400) for r, j in enumerate(np.argsort(d[i])[:3])}


# --- spectral


def test_spectral_parts_moons_where_kmeans_fails(spark):
    rng = np.random.default_rng(8)
    t = np.linspace(0, np.pi, 70)
    moons = [np.stack([c + np.cos(t), up * np.sin(t) + (0 if up > 0 else 0.35)], axis=1) for c, up in ((0, 1), (1, -1), (4, 1), (5, -1))]
    x = np.concatenate(moons) + rng.normal(scale=0.04, size=(280, 2))
    df = table(spark, x)
    want = np.repeat(range(4), 70).tolist()
    assert same(labels(spectral.spectral_clusters(df, 4), 280), want)
    assert not same(labels(learning.cluster(df, 4, "kmeans"), 280), want)


def test_leading_directions_against_a_whole_decomposition(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(c, 0.5, (40, 2)) for c in ([0, 0], [3, 0], [0, 3])])
    s = spectral.affinity(neighbours.knn_edges(table(spark, x), 10))
    dense = np.zeros((120, 120))
    for r in s.collect():
        dense[(r.a - 3) // 7, (r.b - 3) // 7] = r.s
    values, vectors = np.linalg.eigh(dense)
    y, found = spectral.leading_directions(s, 3, tolerance=1e-5)
    assert np.abs(found - values[::-1][:3]).max() < 1e-6
    rows = {r.id: r[1:] for r in y.collect()}
    got = np.array([rows[i * 7 + 3] for i in range(120)])
    top = vectors[:, ::-1][:, :3]
    assert np.abs(got @ got.T - top @ top.T).max() < 1e-3


def test_a_step_of_leading_directions_shuffles_packed_sums_not_edges(spark):
    rng = np.random.default_rng(10)
    edges = spark.createDataFrame([(i, int(j)) for i in range(600) for j in {*rng.integers(0, 600, 8).tolist(), (i + 1) % 600} - {i}], "id long, neighbour long")
    s = spectral.affinity(edges)
    n_edges = s.count()
    dense = np.zeros((600, 600))
    for r in s.collect():
        dense[r.a, r.b] = r.s
    values, vectors = np.linalg.eigh(dense)
    top = vectors[:, ::-1][:, :3]

    def stages():
        sc, jvm = spark.sparkContext, spark._jvm
        listed = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        found = (listed.apply(i) for i in range(listed.size()))
        return {x.stageId(): x.shuffleWriteRecords() for x in found}

    for block_rows in (150, 10**6):
        before = stages()
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # joins as of large tables
        try:
            y, found = spectral.leading_directions(s, 3, degree=6, cycles=3, tolerance=0.0, block_rows=block_rows)
            rows = {r.id: r[1:] for r in y.collect()}
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        shuffled = sum(n for k, n in stages().items() if k not in before)
        assert shuffled < 4 * n_edges  # for 15 products with S; edges are dealt to blocks once, by one end and the other
        got = np.array([rows[i] for i in range(600)])
        assert sorted(rows) == list(range(600)) and np.abs(got.T @ got - np.eye(3)).max() < 1e-9
        assert np.abs(np.diag(got.T @ dense @ got) - found).max() < 1e-9 and abs(found[0] - 1) < 1e-6 and np.abs(top[:, 0] @ got[:, 0]) > 1 - 1e-6


def test_folds_fitted_together_are_those_fitted_one_by_one(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    from lithograph.operators.folds import fit_folds, held_out

    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(240, 4)), rng.integers(0, 3, 240)
    x[:, 0] += y
    x[:, 1] = 50 * x[:, 1] + 7  # badly scaled
    rows = spark.createDataFrame([(i, [float(y[i]), float(i % 4), *map(float, x[i])]) for i in range(240)], "id long, numbers array<double>").repartition(3)
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("folds", "folds")
    weights = fit_folds(rows, "numbers", 3, 4, cost=2.0, tolerance=1e-8)
    ran = len(jobs.getJobIdsForGroup("folds"))
    spark.sparkContext.setJobGroup("", "")
    got = {r.id: r.prob for r in held_out(rows, "numbers", weights).collect()}
    assert len(got) == 240 and ran < 160  # each step is one job or two, for all folds
    flat = rows.select("id", F.col("numbers")[0].alias("y"), F.col("numbers")[1].alias("fold"), array_to_vector(F.slice("numbers", 3, 4)).alias("features"))
    for f in range(4):
        model = LogisticRegression(labelCol="y", family="multinomial", maxIter=500, tol=1e-12, regParam=1 / (2.0 * 180), standardization=False).fit(flat.filter(F.col("fold") != f))
        for r in model.transform(flat.filter(F.col("fold") == f)).collect():
            assert np.allclose(got[r.id], r.probability.toArray(), atol=1e-5)


def test_held_out_probabilities_of_rows_without_label_or_vector(spark):
    rows = [(i, i % 2, [float(i % 2) * 3 + i / 50, 1.0]) for i in range(40)] + [(40, None, [1.0, 1.0]), (41, 1, None)]
    got = learning.cv_probabilities(spark.createDataFrame(rows, "id long, label int, embedding array<double>"), "label")
    assert sorted(r.id for r in got.collect()) == list(range(40))
    assert all(r.prob[r.id % 2] > 0.6 for r in got.collect())
