"""Session settings and the shared folder in which long plans are cut."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where that is unset and the session is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.sparkContext.setCheckpointDir(found)
    return found


WIDE_GROUP = 16 << 20  # bytes of a row group of wide rows: a task reads up to 4096 rows at a time, but no more than a group


def materialize(df: DataFrame, name: str, wide: bool = False) -> DataFrame:
    """Write df once as Parquet to the shared folder and read it back: a lineage cut that outlives executors.

    wide is for rows of many thousand bytes each: their row groups are small, so that a task holds few of them at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    (df.write.option("parquet.block.size", WIDE_GROUP) if wide else df.write).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written = path
    return table


def discard(table: DataFrame) -> None:
    """Deletes what materialize wrote, once nothing will read it again."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table._written)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
