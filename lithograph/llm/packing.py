"""Variable-capacity best-fit packing of documents into training sequences.

Documents are cut into pieces of at most the longest permitted length. Pieces are written, and dealt by a hash of their place there (not of
what they are, so that equal ones spread as well) into groups of about `group_rows` pieces; each group is packed by itself, so that no task holds more than its group. Inside a
group, pieces go in falling length to the open bin with the least room that holds them. Where none does, a bin opens: each
permitted size that holds the piece is filled on trial with the largest of the pieces left that fit, and the size of least
cost per token wins. A bin costs its length plus a fixed charge. The group is packed by this and, for comparison, by
opening at one least size throughout; the packing of least total cost stands. At the end every bin is downsized to the
smallest permitted length that holds its contents.

Defined cases: a null or empty text has no pieces and gives no row; ties go by doc_id (null first), then piece; repeated
rows are packed each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithograph.llm.text import word_count
from lithograph.session import materialize

LENGTHS = (512, 1024, 2048, 4096)
BIN_CHARGE = 64
PACKED = "doc_id long, piece int, start long, n_tokens long, bin_group long, bin long, bin_offset long, bin_length long"


def opening_size(n: int, rising: list[int], left: int, lengths: tuple[int, ...], charge: int) -> int:
    """The permitted size of least cost per token for a bin that opens with a piece of n tokens, if it is filled with the
    largest fitting ones of the pieces left, rising[:left]; the smaller of equal ones."""
    best = None
    for size in lengths:
        if size < n:
            continue
        used, end = n, left
        while end and used < size:
            end = bisect_right(rising, size - used, 0, end) - 1
            if end < 0:
                break
            used += rising[end]
        cost = (next(c for c in lengths if c >= used) + charge) / used
        if best is None or cost < best[0]:
            best = cost, size
    return best[1]


def best_fit(sizes: list[int], lengths: tuple[int, ...], charge: int, least: int | None) -> tuple[int, list[int], list[int], list[int]]:
    """Cost, bin and offset of each piece (given in falling size), and the length of each bin; bins open at the first size
    from `least` that holds the piece or, without one, at the size that promises the least cost."""
    rising = sizes[::-1]
    room: list[tuple[int, int]] = []
    used: list[int] = []
    where, offset = [], []
    for i, n in enumerate(sizes):
        at = bisect_left(room, (n, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            size = opening_size(n, rising, len(sizes) - i - 1, lengths, charge) if least is None else next(c for c in lengths if c >= n and c >= least)
            free, b = size, len(used)
            used.append(0)
        where.append(b)
        offset.append(used[b])
        used[b] += n
        if free > n:
            insort(room, (free - n, b))
    fitted = [next(c for c in lengths if c >= u) for u in used]
    return sum(fitted) + charge * len(fitted), where, offset, fitted


def pack(sizes: list[int], lengths: tuple[int, ...] = LENGTHS, charge: int = BIN_CHARGE) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each piece (given in falling size), and the length of each bin."""
    return min((best_fit(sizes, lengths, charge, least) for least in (None, *lengths)), key=lambda x: x[0])[1:]


def _pack_group(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], na_position="first", kind="stable").reset_index(drop=True)
    where, offset, fitted = pack(pdf["n_tokens"].tolist())
    return pdf.assign(bin=where, bin_offset=offset, bin_length=np.asarray(fitted, dtype="int64")[where])[[c.split()[0] for c in PACKED.split(", ")]]


def pack_documents(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, group_rows: int = 1000) -> DataFrame:
    """One row per piece: doc_id, piece, start (first word), n_tokens, and bin_group, bin, bin_offset, bin_length of its sequence."""
    longest = lengths[-1]
    sizes = docs.select("doc_id", word_count(F.col("text")).alias("n")).filter("n > 0")
    pieces = sizes.withColumn("piece", F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / longest).cast("int")))).select(
        "doc_id", "piece", (F.col("piece") * F.lit(longest).cast("long")).alias("start"), F.least(F.lit(longest).cast("long"), F.col("n") - F.col("piece") * longest).alias("n_tokens")
    )
    pieces = materialize(pieces.withColumn("place", F.monotonically_increasing_id()), "pack-pieces")
    groups = max(1, -(-pieces.count() // group_rows))
    dealt = pieces.withColumn("bin_group", F.pmod(F.xxhash64("place"), F.lit(groups)))
    return dealt.drop("place").groupBy("bin_group").applyInPandas(_pack_group, PACKED)


def op7_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
