"""Silhouettes from cells of space instead of from pairs of points: linear in the rows, with bounds that hold.

Each label has cells, squares that are cut into 4 x 4 where the most is to gain, with the count, mean and second moments of its points
there. A point's distances to the n points of a cell with mean m, at distance D of it, sum up to n D at least, as distance is convex,
and at most to n D + min(S / (2 (D - r)), sqrt(n S)): S is the sum of squared distances to the mean, r the radius about it. Between the two, the second
term of the distance's expansion tells where. Cells of points at one place are exact.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 24  # of a cell's place along an axis, at the finest
POINTS = 1024  # worked on at a time


@dataclass
class Cells:
    """By row: label's number, level, place, then n, mean (2), second moments about it (xx, xy, yy), radius."""

    key: np.ndarray
    moments: np.ndarray

    def spread(self) -> np.ndarray:
        return self.moments[:, 3] + self.moments[:, 5]


def _places(x: np.ndarray, level: np.ndarray | int, corner: np.ndarray, side: float) -> np.ndarray:
    return np.clip(np.floor((x - corner) / side * 2.0**level), 0, 2.0**level - 1).astype(np.int64)


def _code(label: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (label << 2 * BITS) | (place[:, 0] << BITS) | place[:, 1]


def _measure(rows: DataFrame, wanted: np.ndarray, corner: np.ndarray, side: float) -> Cells:
    """The 4 x 4 parts of the wanted cells (label, level, x, y) that have points, by one pass over the rows (x, y, label's number)."""
    sent = rows.sparkSession.sparkContext.broadcast(wanted)

    def parts(batches):
        cells = {int(v): np.sort(_code((c := sent.value[sent.value[:, 1] == v])[:, 0], c[:, 2:])) for v in np.unique(sent.value[:, 1])}
        for batch in batches:
            x = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)
            label = batch.column(2).to_numpy().astype(np.int64)
            for level, codes in cells.items():
                own = _code(label, _places(x, level, corner, side))
                inside = codes[np.minimum(np.searchsorted(codes, own), len(codes) - 1)] == own
                if not inside.any():
                    continue
                y, kind = x[inside], label[inside]
                place = _places(y, level + 2, corner, side)
                d = y - _centre(place, level + 2, corner, side)
                found, where = np.unique(_code(kind, place), return_inverse=True)
                sums = [np.bincount(where, weights=w) for w in (np.ones(len(y)), d[:, 0], d[:, 1], d[:, 0] ** 2, d[:, 0] * d[:, 1], d[:, 1] ** 2)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), level + 2)), pa.array(found), *map(pa.array, sums)], names)

    names = ["level", "code", "n", "x", "y", "xx", "xy", "yy"]
    made = rows.mapInArrow(parts, "level long, code long, n double, x double, y double, xx double, xy double, yy double")
    got = np.array(made.groupBy("level", "code").agg(*(F.sum(c).alias(c) for c in names[2:])).collect(), dtype=object)  # at most 16 a wanted cell
    level, code = got[:, 0].astype(np.int64), got[:, 1].astype(np.int64)
    n, mx, my, xx, xy, yy = got[:, 2:].astype(np.float64).T
    place = np.stack([code >> BITS & (1 << BITS) - 1, code & (1 << BITS) - 1], axis=1)
    off = np.stack([mx, my], axis=1) / n[:, None]
    second = np.stack([np.maximum(xx - mx * mx / n, 0), xy - mx * my / n, np.maximum(yy - my * my / n, 0)], axis=1)
    second[(n == 1) | (second[:, [0, 2]].sum(axis=1) <= 1e-12 * (xx + yy))] = 0  # one point, or points at one place, up to rounding
    half = side / 2.0**level / 2
    radius = np.hypot(*(np.abs(off) + half[:, None]).T)
    mean = _centre(place, level, corner, side) + off
    return Cells(np.stack([code >> 2 * BITS, level, *place.T], axis=1), np.column_stack([n, mean, second, radius]))


def _centre(place: np.ndarray, level: np.ndarray | int, corner: np.ndarray, side: float) -> np.ndarray:
    return corner + (place + 0.5) * (side / 2.0 ** np.asarray(level, dtype=np.float64)).reshape(-1, 1)


def _cut(rows: DataFrame, labels: int, corner: np.ndarray, side: float, most: int, precision: float) -> Cells:
    """At most `most` cells and 16 a label: those are cut first whose points can add most to the error of a mean distance to their label.

    A label is done when its points are within `precision` of its own spread of the means of their cells, on average.
    """
    cells = _measure(rows, np.array([[i, 0, 0, 0] for i in range(labels)]), corner, side)
    while True:
        label, n, mean = cells.key[:, 0], cells.moments[:, 0], cells.moments[:, 1:3]
        sizes = np.bincount(label, weights=n)
        centre = np.stack([np.bincount(label, weights=n * m) for m in mean.T], axis=1) / sizes[:, None]
        wide = np.sqrt(np.bincount(label, weights=cells.spread() + n * ((mean - centre[label]) ** 2).sum(axis=1)) / sizes)
        doubt = np.sqrt(n * cells.spread()) / (sizes * np.where(wide > 0, wide, 1.0))[label]
        doubt[np.bincount(label, weights=doubt)[label] <= precision] = 0
        doubt[cells.key[:, 1] + 2 > BITS] = 0
        order = np.argsort(-doubt, kind="stable")[: max(0, (most - len(doubt)) // 15)]
        order = order[(doubt[order] > 0) & (doubt[order] >= doubt.max() / 32)]
        if not len(order):
            return cells
        new, stay = _measure(rows, cells.key[order], corner, side), np.setdiff1d(np.arange(len(doubt)), order)
        cells = Cells(np.concatenate([cells.key[stay], new.key]), np.concatenate([cells.moments[stay], new.moments]))


def distance_sums(x: np.ndarray, moments: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each point and label: the least, likely and greatest sum of distances to the label's points; starts are the labels' first cells."""
    n, second, radius = moments[:, 0], moments[:, 3:6], moments[:, 6]
    spread = second[:, 0] + second[:, 2]
    dx, dy = x[:, :1] - moments[:, 1], x[:, 1:] - moments[:, 2]
    away = np.hypot(dx, dy)
    least = n * away
    with np.errstate(divide="ignore", invalid="ignore"):
        over = np.where(away > radius, spread / (2 * (away - radius)), np.inf)
        over = np.where(spread > 0, np.minimum(over, np.sqrt(n * spread)), 0.0)
        bend = (spread - (dx * dx * second[:, 0] + 2 * dx * dy * second[:, 1] + dy * dy * second[:, 2]) / (away * away)) / (2 * away)
        bend = np.where(away > 0, np.clip(bend, 0, over), over)
    return tuple(np.add.reduceat(a, starts, axis=1) for a in (least, least + bend, least + over))


def _scores(own: np.ndarray, other: np.ndarray) -> np.ndarray:
    top = np.maximum(own, other)
    return np.divide(other - own, top, out=np.zeros_like(top), where=top > 0)


def silhouette_by_cells(df: DataFrame, label: str, coords: tuple[str, str] = ("x1", "x2"), cells: int = 2048, precision: float = 0.02) -> DataFrame:
    """One row: silhouette, and low and high, between which the exact one is; 0 for a point alone in its cluster, all null for fewer than two clusters.

    Rows with null or non-finite coordinates or null label take no part. Each point meets at most `cells` cells, or 16 a label where that
    is more: the work is linear in the rows, and what goes to the driver does not grow with them.
    """
    spark = df.sparkSession
    x, y = (F.col(c).cast("double") for c in coords)
    rows = df.select(x.alias("x"), y.alias("y"), F.col(label).alias("label")).filter("label IS NOT NULL AND abs(x) < double('Infinity') AND abs(y) < double('Infinity')")
    box = rows.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    kinds = [r[0] for r in rows.select("label").distinct().orderBy("label").collect()]  # labels, not rows
    shape = "silhouette double, low double, high double"
    if len(kinds) < 2:
        return spark.createDataFrame([(None, None, None)], shape)
    numbered = spark.createDataFrame(list(enumerate(kinds)), f"number long, label {rows.schema['label'].dataType.simpleString()}")
    rows = rows.join(F.broadcast(numbered), "label").select("x", "y", "number")  # one row per label
    corner, side = np.array(box[:2]), max(box[2] - box[0], box[3] - box[1]) * (1 + 1e-9) or 1.0
    found = _cut(rows, len(kinds), corner, side, cells, precision)
    order = np.argsort(found.key[:, 0], kind="stable")
    sorted_labels, moments = found.key[order, 0], found.moments[order]
    starts = np.searchsorted(sorted_labels, np.arange(len(kinds)))
    sent = spark.sparkContext.broadcast((moments, starts, np.add.reduceat(moments[:, 0], starts)))

    def score(batches):
        moments, starts, sizes = sent.value
        total, n = np.zeros(3), 0
        for batch in batches:
            points = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)
            number = batch.column(2).to_numpy().astype(np.int64)
            for at in range(0, len(points), POINTS):
                own = number[at : at + POINTS]
                i, alone = np.arange(len(own)), sizes[own] == 1
                a, b = [], []
                for sums in distance_sums(points[at : at + POINTS], moments, starts):
                    a.append(sums[i, own] / np.maximum(sizes[own] - 1, 1))
                    means = sums / sizes
                    means[i, own] = np.inf
                    b.append(means.min(axis=1))
                for k, (p, q) in enumerate(((1, 1), (2, 0), (0, 2))):
                    total[k] += np.where(alone, 0.0, _scores(a[p], b[q])).sum()
                n += len(own)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*total, n)], ["s", "low", "high", "n"])

    made = rows.mapInArrow(score, "s double, low double, high double, n long")
    return made.agg(*((F.sum(c) / F.sum("n")).alias(name) for c, name in (("s", "silhouette"), ("low", "low"), ("high", "high"))))
