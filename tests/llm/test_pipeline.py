"""The corpus pipeline over the smallest tables, stage by stage, and the registered queries with SQL."""

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from lithograph.llm import simhash
from lithograph.llm.queries import QUERIES, SQL


def test_stages_and_run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        if name != "source_mixing":
            assert out.join(docs, "doc_id", "left_anti").count() == 0 and out.count() <= before
        docs, before = out, out.count()
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_near_dedup_keeps_one_of_each_simhash_component(spark, sf_dir):
    """Two texts three bits apart at most whose 5-word shingles are too different to be met by them alone; and two that only shingles show."""
    rng = np.random.default_rng(0)
    words = lambda n: [f"w{i}" for i in rng.integers(0, 10**6, n)]
    found: dict[bool, tuple[str, str]] = {}
    while len(found) < 2:
        a = words(60)
        b = list(a)
        alike = len(found) and True in found  # then one change of a long text, which leaves most shingles
        for i in (30,) if alike else (20, 30, 40):
            b[i] = f"x{rng.integers(10**6)}"
        pair = " ".join(a), " ".join(b)
        near = (simhash.fingerprint(pair[0].encode()) ^ simhash.fingerprint(pair[1].encode())).bit_count() <= 3
        if near != bool(alike):
            found[near] = pair
    rows = [(k, text, "en", "s", len(text)) for k, text in enumerate([*found[True], *found[False]])]
    sets = [simhash.shingle_set(r[1].encode()) for r in rows]
    jaccard = lambda x, y: len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    assert jaccard(sets[0], sets[1]) < 0.8 <= jaccard(sets[2], sets[3])
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf_dir).collect()) == [0, 2]


def test_pipeline_over_nothing(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0, name


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    want = con.execute(SQL[name])
    columns = [d[0] for d in want.description]
    got = QUERIES[name](spark, sf_dir).select(*columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_one_row_per_row(spark, sf_dir, name):
    table = "pages" if name.startswith("op6") else "embeddings" if name.startswith("op1_") else "documents"
    n = spark.read.parquet(f"{sf_dir}/{table}.parquet").count()
    rows = QUERIES[name](spark, sf_dir).count()
    if name.startswith("op13"):  # every part has a row for each step of each order
        n = 600 * spark.read.parquet(f"{sf_dir}/{table}.parquet").select("lang").distinct().count()
    assert rows >= n if name.startswith("op7") else rows > 0 if name.startswith("op1_") else rows == n
