"""Readers and writers that need files of their own."""

import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lithograph.session import materialize
from lithograph.sources import io
from lithograph.sources.raw_f32 import RawF32Writer, Staged, StagedWriter, read_f32_records, write_f32_records


def test_raw_records_ignore_a_cut_one(spark, tmp_path):
    data = np.arange(7 * 1 * 2 * 3, dtype="<f4")
    path = tmp_path / "chips.dat"
    path.write_bytes(data.tobytes() + b"\0" * 5)
    rows = read_f32_records(spark, str(path), 1, 2, 3, split_records=3).orderBy("id").collect()
    assert [r.id for r in rows] == list(range(7))
    assert np.allclose(np.concatenate([r.px for r in rows]), data)
    (tmp_path / "none.dat").write_bytes(b"")
    assert read_f32_records(spark, str(tmp_path / "none.dat"), 1, 2, 3).count() == 0


def test_npy_folder(spark, tmp_path):
    for name, shape in (("b", (1, 2, 2)), ("a", (3, 1, 1))):
        np.save(tmp_path / f"{name}.npy", np.full(shape, ord(name), dtype=np.float32))
    (tmp_path / "c.txt").write_text("no")
    rows = io.read_npy_dir(spark, str(tmp_path)).orderBy("name").collect()
    assert [(r.name, r.shape, r.px[0]) for r in rows] == [("a", [3, 1, 1], 97.0), ("b", [1, 2, 2], 98.0)]


def test_malformed_catalogue(spark, tmp_path):
    (tmp_path / "c.csv").write_text("CRATER_ID,LAT,LON,DIAM\na,1.5,2.5,3.5\nb,x,2.5,3.5\n")
    assert io.read_catalog(spark, str(tmp_path / "c.csv"), "DROPMALFORMED").collect()[0].lat == 1.5
    assert len(io.read_catalog(spark, str(tmp_path / "c.csv"), "DROPMALFORMED").collect()) == 1
    assert [r.lat for r in io.read_catalog(spark, str(tmp_path / "c.csv")).collect()] == [1.5, None]
    with pytest.raises(Exception, match="(?i)malformed"):
        io.read_catalog(spark, str(tmp_path / "c.csv"), "FAILFAST").collect()


def test_metadata_does_not_double(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0, 2.0, 3.0, 4.0, 5.0)], io.METADATA)
    for _ in range(2):
        io.write_metadata(df, str(tmp_path / "m"))
    assert io.read_metadata(spark, str(tmp_path / "m")).collect() == df.collect()


def test_geojson_collection(spark, tmp_path):
    df = spark.createDataFrame([(1.5, -2.0, 3), (0.0, 0.0, -1)], "x double, y double, cluster int")
    io.write_geojson(df, str(tmp_path / "g"), collection=True)
    text = "".join(p.read_text() for p in (tmp_path / "g").glob("part-*"))
    made = json.loads(text)
    assert made["type"] == "FeatureCollection" and len(made["features"]) == 2
    with pytest.raises(ValueError):
        io.write_geojson(df, str(tmp_path / "h"), collection=True, most=1)


def chips(spark, n, parts=3):
    return spark.range(n).select("id", F.lit(1).alias("c"), F.lit(2).alias("h"), F.lit(3).alias("w"), F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: (F.col("id") * 10 + i).cast("float")).alias("px")).repartition(parts)


def test_a_smaller_second_run_leaves_its_own_records_only(spark, tmp_path):
    for n in (900, 7):
        write_f32_records(chips(spark, n), str(tmp_path / "f32"))
        rows = read_f32_records(spark, str(tmp_path / "f32"), 1, 2, 3).orderBy("id").collect()
        assert [r.px[0] for r in rows] == [10.0 * i for i in range(n)]
        io.write_npy_dir(chips(spark, n), str(tmp_path / "npy"))
        assert sorted(int(r.name) for r in io.read_npy_dir(spark, str(tmp_path / "npy")).collect()) == list(range(n))
    assert {r.name: r.px for r in io.read_npy_dir(spark, str(tmp_path / "npy")).collect()}["6"] == [60.0 + i for i in range(6)]
    assert not [f for f in [*(tmp_path / "f32").iterdir(), *(tmp_path / "npy").iterdir()] if f.name.startswith("_")]


def test_a_task_that_fails_once_writes_its_records_once(spark, tmp_path):
    """Attempts write aside, and only those that count are taken over."""
    writer = RawF32Writer(str(tmp_path / "out"))
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "part-000009.f32").write_bytes(b"old")
    batch = pa.RecordBatch.from_arrays([pa.array([[1.0, 2.0], [3.0, 4.0]], pa.list_(pa.float32()))], ["px"])
    system, _, hidden = writer.hidden()

    def attempt(number, batches):
        folder = f"{hidden}/000000-{number}"
        system.create_dir(folder, recursive=True)
        return Staged(folder, writer.write_files(system, folder, 0, batches))

    def broken():
        yield batch
        raise OSError("lost")

    with pytest.raises(OSError):
        attempt(0, broken())
    done = attempt(1, iter([batch]))
    attempt(2, iter([batch, batch]))  # a copy of the task that came too late
    assert [f.name for f in (tmp_path / "out").iterdir() if f.is_file()] == ["part-000009.f32"]
    writer.commit([done, None])
    assert [f.name for f in (tmp_path / "out").iterdir()] == ["part-000000.f32"]
    assert np.fromfile(tmp_path / "out" / "part-000000.f32", dtype="<f4").tolist() == [1, 2, 3, 4]


def test_a_job_that_fails_leaves_what_was_there(spark, tmp_path):
    write_f32_records(chips(spark, 5), str(tmp_path / "f32"))
    bad = chips(spark, 50).withColumn("px", F.when(F.col("id") == 33, F.raise_error(F.lit("no"))).otherwise(F.col("px")))
    with pytest.raises(Exception):
        write_f32_records(bad, str(tmp_path / "f32"))
    assert read_f32_records(spark, str(tmp_path / "f32"), 1, 2, 3).count() == 5
    assert not [f for f in (tmp_path / "f32").iterdir() if f.name.startswith("_")]
    assert issubclass(RawF32Writer, StagedWriter)


def test_wide_rows_are_written_in_small_row_groups(spark):
    import glob

    import pyarrow.parquet as pq

    made = F.transform(F.sequence(F.lit(0), F.lit(50175)), lambda i: F.sin(i + F.col("id") * 7.0).cast("float"))
    table = materialize(spark.range(0, 400, 1, 1).select("id", made.alias("px")), "wide", wide=True)
    groups = [f.metadata.row_group(i).num_rows for f in map(pq.ParquetFile, glob.glob(f"{table._written}/*.parquet")) for i in range(f.metadata.num_row_groups)]
    assert sum(groups) == 400 and max(groups) <= 200  # a task reads no more than a group at a time, and by default all 400 make one


def test_small_files_are_read_by_few_tasks(spark, tmp_path, monkeypatch):
    """A table of many small files has a task for about 32 of them; reading takes less than starting so many."""
    monkeypatch.setattr(io, "FILES_MERGED", 4)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4194304")
    try:
        for i in range(96):
            np.save(tmp_path / f"{i}.npy", np.full((1, 1), i, dtype=np.float32))
        read = io.read_npy_dir(spark, str(tmp_path))
        assert read.rdd.getNumPartitions() <= 24
        assert sorted(r.px[0] for r in read.collect()) == list(range(96))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
