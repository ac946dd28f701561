"""Principal components of vectors of any length, by passes over the rows that hold no d x d matrix.

Two passes find mean and spread of each dimension. Each further pass multiplies the covariance by a few directions: a task
adds X_b' (X_b Z) over its Arrow batches X_b, and the d x l sums of all tasks are added up by ranges of dimensions. Starting
from Gaussian directions (a randomised range finder), what a pass gives is made orthonormal to all directions so far and goes out in the next, until
the small matrix Q' C Q over all directions Q names the same variances twice. For short vectors the directions of
the first pass are the axes themselves, which gives the whole covariance in one pass and its exact components.

Vectors may be made of what a row stores when a pass comes to them (rows_of): a table of full-size chips is many hundred times the stored ones.

A task holds d x l numbers, l being a few more than the components asked for, the driver those of all passes, within MOST_NUMBERS. Rows whose vector is null take no part in a
fit, and have null scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXACT_DIMS = 1024
MOST_NUMBERS = 1 << 26  # of directions and their products on the driver: 512 MB
BLOCK_NUMBERS = 1 << 22  # of the piece of a batch that is worked on at a time
RANGE_NUMBERS = 4096  # of one row of partial sums


@dataclass
class PcaModel:
    """Loadings (d, k), the mean and scale of each input dimension, and the share of variance of each component."""

    loadings: np.ndarray
    mean: np.ndarray
    std: np.ndarray
    explained: np.ndarray

    def keep(self, k: int) -> PcaModel:
        return PcaModel(self.loadings[:, :k], self.mean, self.std, self.explained[:k])


def as_matrix(lists: pa.Array) -> np.ndarray:
    """The vectors of a list column that are not null, as rows; they must be of one length."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    rows = len(lists) - lists.null_count
    if not rows:
        return np.zeros((0, 0))
    if len(set(np.unique(lists.value_lengths().drop_null().to_numpy()))) > 1:
        raise ValueError("vectors of different lengths")
    return flat.reshape(rows, -1)


def pieces(rows: np.ndarray) -> Iterator[np.ndarray]:
    """rows as doubles, a bounded number of them at a time."""
    step = max(1, BLOCK_NUMBERS // max(1, rows.shape[1]))
    for at in range(0, len(rows), step):
        yield rows[at : at + step].astype(np.float64)


def stored(lists: pa.Array) -> Iterator[np.ndarray]:
    """The vectors of a list column as they are stored."""
    return pieces(as_matrix(lists))


RowsOf = Callable[[pa.Array], Iterator[np.ndarray]]  # the vectors of a column's rows that are not null, as doubles, a bounded number at a time


def added_up(df: DataFrame, col: str, per_batch, width: int, rows_of: RowsOf = stored) -> np.ndarray:
    """The sum over all rows of what per_batch(matrix) gives: (d, width) numbers.

    Each task adds up its batches and gives its sums away by ranges of dimensions; each range is added up by one task as it comes.
    """

    def partial(batches):
        total = None
        for batch in batches:
            for block in rows_of(batch.column(0)):
                found = per_batch(block)
                total = found if total is None else total + found
        if total is not None:
            step = max(1, RANGE_NUMBERS // width)
            starts = range(0, len(total), step)
            for some in range(0, len(starts), 256):
                at = starts[some : some + 256]
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([total[i : i + step].ravel() for i in at], pa.list_(pa.float64()))], ["start", "sums"])

    def total(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for start, sums in zip(batch.column(0).to_pylist(), batch.column(1)):
                numbers = sums.values.to_numpy()
                held[start] = held[start] + numbers if start in held else numbers.copy()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(list(held.values()), pa.list_(pa.float64()))], ["start", "sums"])

    shape = "start long, sums array<double>"
    rows = df.select(col).mapInArrow(partial, shape).repartition("start").mapInArrow(total, shape).collect()  # d x width numbers
    return np.concatenate([np.asarray(r["sums"]) for r in sorted(rows, key=lambda r: r["start"])]).reshape(-1, width) if rows else np.zeros((0, width))


def moments(df: DataFrame, col: str, rows_of: RowsOf = stored) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows, mean and population std of each dimension; the spread is taken about the mean, in a second pass."""
    sums = added_up(df, col, lambda x: np.stack([x.sum(axis=0), np.full(x.shape[1], float(len(x)))], axis=1), 2, rows_of)
    if not len(sums):
        return 0, np.zeros(0), np.zeros(0)
    n = int(sums[0, 1])
    sent = df.sparkSession.sparkContext.broadcast(sums[:, 0] / n)
    squares = added_up(df, col, lambda x: ((x - sent.value) ** 2).sum(axis=0)[:, None], 1, rows_of)[:, 0]
    return n, sums[:, 0] / n, np.sqrt(squares / n)


def _signed(loadings: np.ndarray) -> np.ndarray:
    """Each component with its largest loading positive."""
    return loadings * np.where(loadings[np.abs(loadings).argmax(axis=0), np.arange(loadings.shape[1])] < 0, -1.0, 1.0)


def fit_pca(df: DataFrame, col: str, k: int | None = None, scale: bool = False, share: float | None = None, solver: str = "auto", oversample: int = 10, passes: int = 30, tolerance: float = 1e-5, seed: int = 42, rows_of: RowsOf = stored) -> PcaModel:
    """PCA on centred (and, if asked, scaled) vectors: k components, or the fewest that keep a share of the variance.

    solver is exact (the whole covariance, for at most EXACT_DIMS dimensions), randomized, or auto: exact where it can be. The randomised one
    stops when all variances it is asked for have settled to `tolerance` of the first, or after `passes`. rows_of makes vectors of what col holds, anew in each pass.
    """
    if solver not in ("auto", "exact", "randomized"):
        raise ValueError(f"solver is auto, exact or randomized, not {solver!r}")
    n, mean, std = moments(df, col, rows_of)
    d = len(mean)
    if not d:
        raise ValueError("PCA of no rows")
    std = np.where(std > 0, std, 1.0) if scale else np.ones(d)
    if solver == "exact" and d > EXACT_DIMS:
        raise ValueError(f"exact PCA holds a d x d matrix, for at most {EXACT_DIMS} dimensions, not {d}")
    spark = df.sparkSession
    centre, width = spark.sparkContext.broadcast(mean), spark.sparkContext.broadcast(std)

    def times_covariance(directions: np.ndarray) -> np.ndarray:
        sent = spark.sparkContext.broadcast(directions)

        def per_batch(x: np.ndarray) -> np.ndarray:
            ready = (x - centre.value) / width.value
            return ready.T @ (ready @ sent.value)

        found = added_up(df, col, per_batch, directions.shape[1], rows_of) / max(1, n - 1)
        sent.unpersist()
        return found

    most = min(d, max(1, n - 1))
    wanted = most if k is None else min(k, d)
    if solver == "exact" or (solver == "auto" and d <= EXACT_DIMS):
        values, vectors = np.linalg.eigh(times_covariance(np.eye(d)))
        values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
        total = values.sum()
    else:
        total = added_up(df, col, lambda x: (((x - centre.value) / width.value) ** 2).sum(axis=0)[:, None], 1, rows_of).sum() / max(1, n - 1)
        values, vectors = _subspace(times_covariance, d, most, wanted, share, total, oversample, passes, tolerance, seed)
    ratios = values / total if total > 0 else np.zeros(len(values))
    if share is not None:
        wanted = min(wanted, int(np.searchsorted(np.cumsum(ratios), share - 1e-12) + 1))
    return PcaModel(_signed(vectors[:, :wanted]), mean, std, ratios[:wanted])


def _subspace(times_covariance, d: int, most: int, wanted: int, share: float | None, total: float, oversample: int, passes: int, tolerance: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Variances and directions, largest first, from the space that Gaussian directions and their products span."""
    rng = np.random.default_rng(seed)
    size = min(most, (32 if share is not None else wanted) + oversample)
    new = np.linalg.qr(rng.normal(size=(d, size)))[0]
    held, products = np.zeros((d, 0)), np.zeros((d, 0))
    before = np.zeros(0)
    for _ in range(passes):
        product = times_covariance(new)
        held, products = np.concatenate([held, new], axis=1), np.concatenate([products, product], axis=1)
        small = held.T @ products
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = np.maximum(values[::-1], 0), turn[:, ::-1]
        looked_at = min(wanted, len(values)) if share is None else min(wanted, int(np.searchsorted(np.cumsum(values), share * total - 1e-12 * total) + 1))
        if looked_at <= len(before) and np.abs(values[:looked_at] - before[:looked_at]).max() <= tolerance * values[0]:
            break
        before = values
        if 2 * d * (held.shape[1] + 2 * size) > MOST_NUMBERS:  # start anew from the best of what is held
            keep = min(looked_at + size, held.shape[1])
            if 2 * d * (keep + 2 * size) > MOST_NUMBERS:
                raise ValueError(f"{keep} directions of {d} dimensions are more than the {MOST_NUMBERS} numbers that may be held; ask for fewer components")
            held, products, turn = held @ turn[:, :keep], products @ turn[:, :keep], np.eye(keep)
        for _ in range(2):
            product = product - held @ (held.T @ product)
        new, rest = np.linalg.qr(product)
        new = new[:, np.abs(np.diag(rest)) > 1e-9 * max(values[0], 1e-300)][:, : d - held.shape[1]]
        if not new.shape[1]:  # the rows span no more
            break
    return values, held @ turn


def transform_pca(df: DataFrame, col: str, model: PcaModel, out: str = "pcs", rows_of: RowsOf = stored) -> DataFrame:
    """df with the component scores as an array."""
    return df.withColumn(out, _applied(df, F.col(col), model, lambda x, m: (x - m.mean) / m.std @ m.loadings, rows_of))


def pca_reconstruct(df: DataFrame, model: PcaModel, col: str = "pcs", out: str = "reconstructed") -> DataFrame:
    """df with vectors rebuilt from component scores."""
    return df.withColumn(out, _applied(df, F.col(col), model, lambda x, m: (x @ m.loadings.T) * m.std + m.mean))


def _applied(df: DataFrame, vectors: Column, model: PcaModel, formula, rows_of: RowsOf = stored) -> Column:
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("array<double>")
    def run(lists: pa.Array) -> pa.Array:
        done = [formula(x, sent.value) for x in rows_of(lists)]
        rows = iter(np.concatenate(done)) if done else iter(())
        return pa.array([next(rows) if there else None for there in lists.is_valid().to_pylist()], pa.list_(pa.float64()))

    return run(vectors)


# --- as stages of Spark ML pipelines


class _PcaParams(HasInputCol, HasOutputCol):
    k = Param(Params._dummy(), "k", "number of components; with a share, the most of them", TypeConverters.toInt)
    scale = Param(Params._dummy(), "scale", "whether to scale each dimension to a spread of 1", TypeConverters.toBoolean)
    share = Param(Params._dummy(), "share", "share of the variance to keep; 0 for k components", TypeConverters.toFloat)


class Pca(Estimator, _PcaParams, DefaultParamsReadable, DefaultParamsWritable):
    """fit_pca as an estimator; input is an array or an ML vector, output an ML vector."""

    @keyword_only
    def __init__(self, *, k: int = 2, scale: bool = False, share: float = 0.0, inputCol: str = "embedding", outputCol: str = "features"):
        super().__init__()
        self._set(**self._input_kwargs)
        self._setDefault(k=2, scale=False, share=0.0, inputCol="embedding", outputCol="features")

    def _fit(self, dataset: DataFrame) -> FittedPca:
        share = self.getOrDefault("share")
        rows = dataset.select(_as_array(dataset, self.getInputCol()).alias("v"))
        model = fit_pca(rows, "v", self.getOrDefault("k"), self.getOrDefault("scale"), share or None)
        return self._copyValues(FittedPca(model))


class FittedPca(Model, _PcaParams, MLReadable, MLWritable):
    """A fitted PcaModel as a transformer that a pipeline saves and loads with its other stages."""

    def __init__(self, model: PcaModel | None = None):
        super().__init__()
        self.model = model
        self._setDefault(k=2, scale=False, share=0.0, inputCol="embedding", outputCol="features")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        scores = _applied(dataset, _as_array(dataset, self.getInputCol()), self.model, lambda x, m: (x - m.mean) / m.std @ m.loadings)
        return dataset.withColumn(self.getOutputCol(), array_to_vector(scores))

    def write(self) -> MLWriter:
        return _PcaWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _PcaReader(cls)


class _PcaWriter(MLWriter):
    def __init__(self, instance: FittedPca):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        save_arrays(self.sparkSession, self.instance.model, f"{path}/data")


class _PcaReader(MLReader):
    def __init__(self, cls: type):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> FittedPca:
        found = self.cls(load_arrays(self.sparkSession, f"{path}/data"))
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        found._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(found, metadata)
        return found


def save_arrays(spark, model: PcaModel, path: str) -> None:
    """A row per dimension (mean, std, loadings) and one more, numbered -1, with the shares of variance."""
    rows = [(i, float(m), float(s), w.tolist()) for i, (m, s, w) in enumerate(zip(model.mean, model.std, model.loadings, strict=True))]
    spark.createDataFrame([*rows, (-1, 0.0, 0.0, model.explained.tolist())], "dim int, mean double, std double, loadings array<double>").write.mode("overwrite").parquet(path)


def load_arrays(spark, path: str) -> PcaModel:
    last, *rows = sorted(spark.read.parquet(path).collect(), key=lambda r: r["dim"])  # d x k numbers
    return PcaModel(np.array([r["loadings"] for r in rows]), np.array([r["mean"] for r in rows]), np.array([r["std"] for r in rows]), np.array(last["loadings"]))


def _as_array(df: DataFrame, col: str) -> Column:
    return vector_to_array(F.col(col)) if isinstance(df.schema[col].dataType, VectorUDT) else F.col(col)
