"""Spectral clusters of a neighbour graph by block subspace iteration.

The graph's affinity is W = (A + A') / 2 for the lists of nearest neighbours A, a row being its own neighbour; S = D^-1/2 W D^-1/2. The k
leading directions of S are found by filtered subspace iteration: each step multiplies k columns by S, and a Chebyshev recurrence makes the
leading directions grow against the rest; then the columns are made orthonormal by their k x k Gram matrix, which with Q' S Q (another
k x k) is all that reaches the driver. Rows, scaled to length 1, go to KMeans.

Rows are dealt to blocks. Edges stay where the block of their one end is, packed by the block of the other; in a step a block sends each other
block the sums of its edges into it, one for each row that they reach, packed. So what a step shuffles is not a row for every edge, but
rows times blocks at most, and never more than edges.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithograph.operators.neighbours import knn_edges
from lithograph.session import discard, materialize


def affinity(edges: DataFrame) -> DataFrame:
    """(a, b, s) of S, both directions and the diagonal, from (id, neighbour)."""
    half = edges.select(F.col("id").alias("a"), F.col("neighbour").alias("b"))
    both = half.unionByName(half.select(F.col("b").alias("a"), F.col("a").alias("b"))).withColumn("w", F.lit(0.5))
    loops = half.select("a").union(half.select("b")).distinct().select("a", F.col("a").alias("b"), F.lit(1.0).alias("w"))
    w = materialize(both.unionByName(loops).groupBy("a", "b").agg(F.sum("w").alias("w")), "affinity")
    degree = materialize(w.groupBy("a").agg(F.sum("w").alias("d")), "degrees")
    other = degree.select(F.col("a").alias("b"), F.col("d").alias("e"))
    return materialize(w.join(degree, "a").join(other, "b").select("a", "b", (F.col("w") / F.sqrt(F.col("d") * F.col("e"))).alias("s")), "normalised")


FEW_BLOCKS, BLOCK_ROWS, MOST_BLOCK_ROWS = 4, 2048, 1 << 16  # blocks of at least so many rows up to so many blocks; from there on they grow up to a bound
STATE = "block int, numbers array<double>"  # the numbers of a block's rows, row by row, rows in the order of their ids
MESSAGES = "block int, source int, rows array<int>, numbers array<double>"  # to a block; what it keeps itself has source -1 and all rows


def _columns(k: int) -> list[str]:
    return [f"y{i}" for i in range(k)]


def _packed(s: DataFrame, width: int, seed: int, block_rows: int | None) -> tuple[DataFrame, DataFrame, int]:
    """(block, ids, numbers) with numbers to start from, (block, target, rows, cols, s) with the edges from a block into another, and how many parts both are dealt to."""
    ids = materialize(s.select(F.col("a").alias("id")).distinct(), "spectral-ids")
    n = ids.count()
    blocks = -(-n // block_rows) if block_rows else max(1, min(FEW_BLOCKS, n // BLOCK_ROWS), -(-n // MOST_BLOCK_ROWS))
    coin = lambda i: F.xxhash64("id", F.lit(seed + i)).cast("double") / float(2**63)
    dealt = ids.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.struct("id", F.array(*(coin(i) for i in range(width))).alias("y")).alias("m"))
    lists = dealt.groupBy("block").agg(F.sort_array(F.collect_list("m")).alias("m"))  # about MOST_BLOCK_ROWS rows at most
    start = materialize(lists.select("block", F.col("m.id").alias("ids"), F.flatten("m.y").alias("numbers")), "directions")
    place = start.select("block", F.posexplode("ids").alias("place", "id"))
    ends = s.join(place.select(F.col("id").alias("a"), F.col("block").alias("target"), F.col("place").alias("row")), "a")
    ends = ends.join(place.select(F.col("id").alias("b"), "block", F.col("place").alias("col")), "b")
    cells = ends.groupBy("block", "target").agg(F.sort_array(F.collect_list(F.struct("row", "col", "s"))).alias("m"))  # the edges of two blocks
    cells = materialize(cells.select("block", "target", F.col("m.row").alias("rows"), F.col("m.col").alias("cols"), F.col("m.s").alias("s")), "cells")
    parts = 2 * blocks
    return start, cells.repartition(parts, "block").sortWithinPartitions("block").persist(), parts


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [v.values.to_numpy(zero_copy_only=False) for v in column]


def _table(columns: list, schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64())}
    names, types = zip(*(c.split() for c in schema.split(", ")))
    return pa.table([pa.array(c, kinds[kind]) for c, kind in zip(columns, types, strict=True)], names=list(names))


def _sent(block: int, own: np.ndarray, width: int, cells: pa.Table) -> pa.Table:
    """Messages of a block: its own numbers to itself, and to each block the sums over its edges into it of s times the first columns."""
    out = [[block], [-1], [np.zeros(0, np.int32)], [own.ravel()]]
    for target, rows, cols, s in zip(cells.column("target").to_pylist(), *(_lists(cells.column(c)) for c in ("rows", "cols", "s")), strict=True):
        first = np.flatnonzero(np.diff(rows, prepend=-1))  # rows are in order
        sums = np.add.reduceat(s[:, None] * own[cols, :width], first)
        for held, new in zip(out, (target, block, rows[first], sums.ravel()), strict=True):
            held.append(new)
    return _table(out, MESSAGES)


def _received(messages: pa.Table, width: int, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """A block's own numbers, and the sum of what the blocks sent, which is S times its first columns."""
    messages = messages.sort_by("source")  # so that sums do not depend on who came first
    rows, numbers = _lists(messages.column("rows")), _lists(messages.column("numbers"))
    own = numbers[0].reshape(-1, wide)
    total = np.zeros((len(own), width))
    for r, v in zip(rows[1:], numbers[1:], strict=True):
        total[r] += v.reshape(-1, width)
    return own, total


class _Graph:
    """Products of S with the columns of all blocks. A step is one shuffle, of messages; edges stay in their parts."""

    def __init__(self, cells: DataFrame, parts: int, width: int):
        self.cells, self.parts, self.width = cells, parts, width

    def _meet(self, rows: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table]) -> DataFrame:
        return rows.repartition(self.parts, "block").groupBy("block").cogroup(self.cells.groupBy("block")).applyInArrow(run, MESSAGES)

    def sent(self, state: DataFrame, m: np.ndarray) -> DataFrame:
        """Messages about the first columns of state, times a small matrix."""
        width, wide = self.width, len(m)

        def run(left: pa.Table, cells: pa.Table) -> pa.Table:
            numbers = _lists(left.column("numbers"))[0].reshape(-1, wide)
            return _sent(left.column("block")[0].as_py(), numbers @ m, width, cells)

        return self._meet(state.select("block", "numbers"), run)

    def again(self, messages: DataFrame, wide: int, make: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
        """Messages about make(own numbers, S times their first columns)."""
        width = self.width

        def run(left: pa.Table, cells: pa.Table) -> pa.Table:
            return _sent(left.column("block")[0].as_py(), make(*_received(left, width, wide)), width, cells)

        return self._meet(messages, run)

    def state(self, messages: DataFrame, wide: int, make: Callable[[np.ndarray, np.ndarray], np.ndarray], name: str) -> DataFrame:
        """make(own numbers, S times their first columns), written."""
        width = self.width

        def run(left: pa.Table) -> pa.Table:
            return _table([[left.column("block")[0].as_py()], [make(*_received(left, width, wide)).ravel()]], STATE)

        return materialize(messages.repartition(self.parts, "block").groupBy("block").applyInArrow(run, STATE), name)

    def filtered(self, state: DataFrame, m: np.ndarray, low: float, degree: int) -> DataFrame:
        """T_degree((2 S - (low - 1)) / (low + 1)) times state m: values from -1 to low stay small, those above grow."""
        width, middle, half = self.width, (low - 1) / 2, (low + 1) / 2

        def first(y: np.ndarray, sy: np.ndarray) -> np.ndarray:
            return np.concatenate([(sy - middle * y) / half, y], axis=1)

        def later(own: np.ndarray, sy: np.ndarray) -> np.ndarray:
            y, before = own[:, :width], own[:, width:]
            return np.concatenate([2 * (sy - middle * y) / half - before, y], axis=1)

        messages = self.sent(state, m)
        for step in range(degree - 1):
            messages = self.again(messages, 2 * width if step else width, later if step else first)
        last = later if degree > 1 else first
        return self.state(messages, 2 * width if degree > 1 else width, lambda own, sy: last(own, sy)[:, :width], "directions")


def _gram(state: DataFrame, wide: int) -> np.ndarray:
    """Sums of products of columns, wide x wide numbers."""

    def products(batches):
        for batch in batches:
            for numbers in _lists(batch.column("numbers")):
                z = numbers.reshape(-1, wide)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(wide * wide, dtype=np.int32)), pa.array((z.T @ z).ravel())], ["at", "v"])

    rows = state.select("numbers").mapInArrow(products, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    found = np.zeros(wide * wide)
    for r in rows:
        found[r["at"]] = r["v"]
    return found.reshape(wide, wide)


def _orthonormal(gram: np.ndarray) -> np.ndarray:
    """The matrix that makes columns of this Gram matrix orthonormal."""
    values, vectors = np.linalg.eigh(gram)
    return vectors / np.sqrt(np.maximum(values, values.max() * 1e-14))


def _unpacked(start: DataFrame, state: DataFrame, m: np.ndarray) -> DataFrame:
    """(id, y0 ..) of the first columns of state times a small matrix."""

    def rows(batches):
        for batch in batches:
            for ids, numbers in zip(_lists(batch.column("ids")), _lists(batch.column("numbers")), strict=True):
                y = numbers.reshape(len(ids), -1)[:, : len(m)] @ m
                yield pa.RecordBatch.from_arrays([pa.array(ids), *(pa.array(y[:, i].copy()) for i in range(y.shape[1]))], ["id", *_columns(y.shape[1])])

    schema = ", ".join(["id long", *(f"{c} double" for c in _columns(m.shape[1]))])
    return start.select("block", "ids").join(state, "block").select("ids", "numbers").mapInArrow(rows, schema)


def leading_directions(
    s: DataFrame, k: int, degree: int = 16, cycles: int = 10, tolerance: float = 2e-3, seed: int = 42, extra: int = 2, block_rows: int | None = None
) -> tuple[DataFrame, np.ndarray]:
    """(id, y0 .. y(k-1)) and the k greatest values of S. It stops when S Y differs from Y times its values by `tolerance` at most."""
    width = k + extra
    start, cells, parts = _packed(s, width, seed, block_rows)
    graph, y = _Graph(cells, parts, width), start
    for cycle in range(cycles):
        if cycle:
            y = graph.filtered(both, np.eye(2 * width, width) @ turn, float(min(values[-1], 0.999)), degree)  # noqa: F821
            discard(both)  # noqa: F821
        basis = _orthonormal(_gram(y, width))
        both = graph.state(graph.sent(y, basis), width, lambda own, sy: np.concatenate([own, sy], axis=1), "images")  # Y and S Y
        if cycle:
            discard(y)
        products = _gram(both, 2 * width)
        small, squares = products[:width, width:], products[width:, width:]
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        lost = np.sqrt(np.maximum(np.diag(turn.T @ squares @ turn) - values**2, 0))  # | S y - value y |
        if lost[:k].max() <= tolerance:
            break
    cells.unpersist()
    return _unpacked(start, both, turn[:, :k]), values[:k]


def spectral_clusters(df: DataFrame, k: int, col: str = "embedding", neighbours: int = 10, mode: str = "exact", seed: int = 42, **options) -> DataFrame:
    """(id, cluster): KMeans of the rows of the k leading directions of the neighbour graph; mode is as for knn_edges."""
    edges = materialize(knn_edges(df, neighbours, mode, col, **options), "spectral-edges")
    y, _ = leading_directions(affinity(edges), k, seed=seed)
    length = F.sqrt(sum((F.col(c) * F.col(c) for c in _columns(k)), F.lit(0.0)))
    rows = y.select("id", array_to_vector(F.array(*(F.col(c) / F.greatest(length, F.lit(1e-300)) for c in _columns(k)))).alias("features"))
    rows = materialize(rows, "spectral-rows")
    return KMeans(k=k, seed=seed, initSteps=5, predictionCol="cluster").fit(rows).transform(rows).select("id", "cluster")
