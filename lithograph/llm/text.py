"""Small pieces that several training-data operators share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space; bytes.split() cuts at just these six bytes.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def planes(numbers: np.ndarray) -> bytes:
    """Numbers byte by byte, the lowest bytes of all first, so that they compress."""
    return np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, numbers.itemsize).T.tobytes()


def from_planes(data: bytes, kind: type, count: int, offset: int = 0) -> np.ndarray:
    kind = np.dtype(kind)
    flat = np.frombuffer(data, dtype=np.uint8, count=count * kind.itemsize, offset=offset)
    return np.ascontiguousarray(flat.reshape(kind.itemsize, -1).T).view(kind).reshape(-1)


def text_batches(batches, size: int = 256):
    """(record batch of at most size rows, its texts as UTF-8 bytes, None for null) from Arrow batches with a text column."""
    import pyarrow as pa

    for batch in batches:
        for start in range(0, batch.num_rows, size):
            part = batch.slice(start, size)
            yield part, part.column("text").cast(pa.binary()).to_pylist()
