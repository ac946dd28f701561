"""Sources and sinks: catalogues, metadata, chips, statistics, latents, assignments, tiles and fitted models."""

from __future__ import annotations

import io as bytesio
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource

from lithograph.operators.catalog import labelled_listing
from lithograph.sources.raw_f32 import StagedWriter

CATALOG = "crater_id string, lat double, lon double, diam_km double"
METADATA = "id string, lat double, lon double, x double, y double, diam double"
TILES = "tile_row long, tile_col long, px array<int>"
GEO = "x0 double, y0 double, xres double, yres double, width long, height long, tile int"


def read_catalog(spark: SparkSession, path: str, mode: str = "PERMISSIVE") -> DataFrame:
    """The catalogue from CSV with a header; mode FAILFAST raises on a malformed row, DROPMALFORMED leaves it out."""
    return spark.read.schema(CATALOG).option("header", True).option("mode", mode).option("enforceSchema", True).csv(path)


def write_catalog(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_metadata(df: DataFrame, path: str, kind: str = "csv") -> None:
    """Overwrites, so that a second run does not double the rows."""
    df.write.mode("overwrite").option("header", True).format(kind).save(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METADATA).option("header", True).csv(path)


def write_chips(df: DataFrame, path: str, parts: int = 16, key: str = "id") -> None:
    """Parquet, partitioned by a hash of the id."""
    df.withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")).write.mode("overwrite").partitionBy("part").parquet(path)


def read_chips(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("part")


def write_stats(df: DataFrame, path: str) -> None:
    """A table of one row per channel, in one file."""
    df.coalesce(1).write.mode("overwrite").parquet(path)


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_latents(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_latents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_assignments_csv(df: DataFrame, path: str) -> None:
    """x, y, cluster with a header."""
    df.select("x", "y", "cluster").write.mode("overwrite").option("header", True).csv(path)


def geojson_features(df: DataFrame) -> DataFrame:
    """value: a GeoJSON Point feature for each row, with its cluster as property."""
    point = F.struct(F.lit("Point").alias("type"), F.array("x", "y").alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct("cluster").alias("properties"))).alias("value"))


def write_geojson(df: DataFrame, path: str, collection: bool = False, most: int = 100_000) -> None:
    """One feature a line; collection=True makes one FeatureCollection, for at most `most` rows."""
    features = geojson_features(df)
    if collection:
        n = df.count()
        if n > most:
            raise ValueError(f"{n} rows for one collection; at most {most}")
        joined = F.concat_ws(",", F.collect_list("value"))
        features = features.agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), joined, F.lit("]}")).alias("value"))
    features.write.mode("overwrite").text(path)


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    """Tiles; filters on tile_row and tile_col reach the files."""
    return spark.read.parquet(path)


def write_tiles(tiles: DataFrame, geo: DataFrame, path: str) -> None:
    """Tiles under path/tiles, sorted by key so that a window reads few row groups, and the geo row under path/geo."""
    tiles.repartitionByRange("tile_row", "tile_col").sortWithinPartitions("tile_row", "tile_col").write.mode("overwrite").parquet(f"{path}/tiles")
    geo.coalesce(1).write.mode("overwrite").parquet(f"{path}/geo")


class NpyWriter(StagedWriter):
    """Each row (key, h, w, px) as key.npy of shape (h, w)."""

    def write_files(self, system, folder: str, part: int, batches: Iterator[pa.RecordBatch]) -> int:
        n = 0
        for batch in batches:
            for name, h, w, px in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                held = bytesio.BytesIO()
                np.save(held, px.values.to_numpy().astype(np.float32).reshape(h, w))
                with system.open_output_stream(f"{folder}/{name}.npy") as f:
                    f.write(held.getvalue())
            n += batch.num_rows
        return n


class NpySource(DataSource):
    """A sink of .npy files; read_npy_dir reads them."""

    @classmethod
    def name(cls) -> str:
        return "npy_dir"

    def writer(self, schema, overwrite: bool) -> NpyWriter:
        return NpyWriter(self.options["path"])


def write_npy_dir(chips: DataFrame, path: str, key: str = "id") -> None:
    """Each chip as key.npy of shape (h, w), in a folder that all executors reach. It takes the place of what was there."""
    chips.sparkSession.dataSource.register(NpySource)
    chips.select(F.col(key).cast("string").alias("key"), "h", "w", F.col("px").cast("array<float>").alias("px")).write.format("npy_dir").mode("overwrite").save(path)


def read_npy_dir(spark: SparkSession, path: str) -> DataFrame:
    """name (file stem), shape, px of every .npy file in a folder; ordered use sorts by name."""
    files = in_few_tasks(spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path))

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            arrays = [np.load(bytesio.BytesIO(c), allow_pickle=False) for c in pdf["content"]]
            yield pd.DataFrame({"name": pdf["name"], "shape": [list(a.shape) for a in arrays], "px": [a.astype(np.float32).ravel() for a in arrays]})

    stem = F.regexp_extract("path", r"([^/]+)\.npy$", 1).alias("name")
    return files.select(stem, "content").mapInPandas(load, "name string, shape array<int>, px array<float>")


FILES_MERGED = 16  # partitions of files that one task reads


def in_few_tasks(files: DataFrame) -> DataFrame:
    """files with fewer tasks: Spark deals out some 32 small files a task, which takes longer to start than to read them."""
    parts, cores = files.rdd.getNumPartitions(), files.sparkSession.sparkContext.defaultParallelism
    return files.coalesce(max(1, min(parts, max(4 * cores, parts // FILES_MERGED))))


def list_labelled(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, name, state of the files in a folder, the state taken from the name (see labelled_listing); nothing of the files is read."""
    return labelled_listing(in_few_tasks(spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path")))


def save_model(model, path: str) -> None:
    """A fitted Spark ML model, for later stages."""
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)
