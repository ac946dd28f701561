"""A batch source for headerless float32 records (n, c, h, w), split by byte ranges.

The path is a file or a folder of files in the order of their names: on a folder that all executors mount, or a URI of a
file system that Arrow knows (hdfs://, s3://, gs://, file://).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage


MOVERS = 16  # files that a commit moves at once


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


class Records(InputPartition):
    """n records of a file from its record `first`; the first of them is number `at` of all."""

    def __init__(self, path: str, first: int, n: int, at: int):
        super().__init__((path, first, n, at))
        self.path, self.first, self.n, self.at = path, first, n, at


class RawF32Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.c, self.h, self.w = (int(options[k]) for k in ("c", "h", "w"))
        self.split = int(options.get("split_records", 1024))

    @property
    def record(self) -> int:
        return 4 * self.c * self.h * self.w

    def partitions(self) -> list[InputPartition]:
        system, path = file_system(self.path)
        found = system.get_file_info(path)
        files = [found] if found.is_file else sorted((f for f in system.get_file_info(fs.FileSelector(path)) if f.is_file and not f.base_name.startswith(("_", "."))), key=lambda f: f.base_name)
        out, before = [], 0
        for f in files:
            n = f.size // self.record  # what is left of a cut record is ignored
            out += [Records(f.path, at, min(self.split, n - at), before + at) for at in range(0, n, self.split)]
            before += n
        return out or [Records(path, 0, 0, 0)]

    def read(self, part: Records) -> Iterator[pa.RecordBatch]:
        if not part.n:
            return
        with file_system(self.path)[0].open_input_file(part.path) as f:
            for step in range(0, part.n, 64):
                at, n = part.at + step, min(64, part.n - step)
                px = np.frombuffer(f.read_at(n * self.record, (part.first + step) * self.record), dtype="<f4")
                offsets = pa.array(np.arange(n + 1, dtype=np.int32) * (self.record // 4))
                columns = [pa.array(np.arange(at, at + n, dtype=np.int64)), *(pa.array(np.full(n, v, dtype=np.int32)) for v in (self.c, self.h, self.w)), pa.ListArray.from_arrays(offsets, pa.array(px))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "c", "h", "w", "px"])


@dataclass
class Staged(WriterCommitMessage):
    """The folder of a task's files, and how many records they hold."""

    folder: str
    records: int


class StagedWriter(DataSourceArrowWriter):
    """Files that become visible when the whole job is done.

    Each attempt of a task writes to a folder of its own below a hidden one. The commit takes the files of the attempts that count to their final
    names and removes all others, those of earlier runs as well; an abort leaves the folder as it was.
    """

    def __init__(self, path: str):
        self.path, self.job = path, uuid.uuid4().hex

    def hidden(self) -> tuple[fs.FileSystem, str, str]:
        system, folder = file_system(self.path)
        folder = folder.rstrip("/")
        return system, folder, f"{folder}/_temporary-{self.job}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Staged:
        system, _, hidden = self.hidden()
        task = TaskContext.get()
        own = f"{hidden}/{task.partitionId():06d}-{task.taskAttemptId()}"
        system.create_dir(own, recursive=True)
        return Staged(own, self.write_files(system, own, task.partitionId(), batches))

    def write_files(self, system: fs.FileSystem, folder: str, part: int, batches: Iterator[pa.RecordBatch]) -> int:
        raise NotImplementedError

    def commit(self, messages: list[Staged | None]) -> None:
        system, folder, hidden = self.hidden()
        system.create_dir(folder, recursive=True)
        before = {f.base_name for f in system.get_file_info(fs.FileSelector(folder)) if f.is_file}
        staged = [f for message in messages if message for f in system.get_file_info(fs.FileSelector(message.folder))]
        with ThreadPoolExecutor(MOVERS) as movers:  # a move is a call to the store that mostly waits
            list(movers.map(lambda f: system.move(f.path, f"{folder}/{f.base_name}"), staged))
            list(movers.map(lambda name: system.delete_file(f"{folder}/{name}"), before - {f.base_name for f in staged}))
        self._clear()

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, _, hidden = self.hidden()
        if system.get_file_info(hidden).type == fs.FileType.Directory:
            system.delete_dir(hidden)


class RawF32Writer(StagedWriter):
    """Column px as little-endian float32, one file for each task that has rows."""

    def write_files(self, system: fs.FileSystem, folder: str, part: int, batches: Iterator[pa.RecordBatch]) -> int:
        n = 0
        with system.open_output_stream(f"{folder}/part-{part:06d}.f32") as f:
            for batch in batches:
                f.write(batch.column("px").flatten().to_numpy().astype("<f4").tobytes())
                n += batch.num_rows
        return n


class RawF32Source(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raw_f32"

    def schema(self) -> str:
        return "id long, c int, h int, w int, px array<float>"

    def reader(self, schema) -> DataSourceReader:
        return RawF32Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return RawF32Writer(self.options["path"])


def read_f32_records(spark: SparkSession, path: str, c: int, h: int, w: int, split_records: int = 1024) -> DataFrame:
    """Records of a raw file or a folder of them; id is the position among all."""
    spark.dataSource.register(RawF32Source)
    return spark.read.format("raw_f32").options(c=c, h=h, w=w, split_records=split_records).load(path)


def write_f32_records(chips: DataFrame, path: str, key: str = "id") -> None:
    """Pixels of chips as a folder of raw files, in the order of key: a file for each range of keys. It takes the place of what was there."""
    chips.sparkSession.dataSource.register(RawF32Source)
    ordered = chips.repartitionByRange(key).sortWithinPartitions(key).select(F.col("px").cast("array<float>").alias("px"))
    ordered.write.format("raw_f32").mode("overwrite").save(path)
