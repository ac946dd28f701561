"""Multinomial regressions of all folds of a cross-validation, fitted together.

Every step is one pass over the rows, in which a row adds its loss and gradient to each fold that does not hold it out. The
steps are those of L-BFGS, which each fold takes for itself on the driver, where there are folds x classes x features numbers.
One first pass gives each fold the Gram matrix of its rows. Half of it bounds the curvature of the loss, whatever the weights, so
that in coordinates in which this bound is the identity a first full step never overshoots, and few steps are needed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lithograph.operators.pca import added_up, as_matrix

MEMORY = 10


def _log_softmax(scores: np.ndarray) -> np.ndarray:
    top = scores - scores.max(axis=-1, keepdims=True)
    return top - np.log(np.exp(top).sum(axis=-1, keepdims=True))


class _Descent:
    """L-BFGS of one fold, told loss and gradient at the point it asks for next."""

    def __init__(self, gram: np.ndarray, classes: int, cost: float, tolerance: float):
        self.n = gram[-1, -1]
        self.ridge = np.full(len(gram), 1.0 / (cost * self.n))
        self.ridge[-1] = 0.0  # of the intercept
        bound = gram / (2 * self.n) + np.diag(self.ridge)
        spread, axes = np.linalg.eigh(bound)
        self.back = axes / np.sqrt(np.maximum(spread, 1e-12 * spread[-1]))
        self.at = np.zeros((len(gram), classes))
        self.next, self.loss, self.gradient, self.way, self.length = self.at, np.inf, None, None, 1.0
        self.steps: list[tuple[np.ndarray, np.ndarray]] = []
        self.tolerance, self.done = tolerance, False

    def weights(self) -> np.ndarray:
        return self.back @ (self.at if self.done else self.next)

    def tell(self, loss: float, gradient: np.ndarray) -> None:
        w = self.back @ self.next
        loss = loss / self.n + 0.5 * (self.ridge[:, None] * w * w).sum()
        gradient = self.back.T @ (gradient / self.n + self.ridge[:, None] * w)
        if self.gradient is not None:
            if loss > self.loss + 1e-4 * self.length * (self.gradient * self.way).sum():
                self.length /= 2
                self.done = self.length < 1e-10  # rounding is all that is left
                self.next = self.at + self.length * self.way
                return
            s, y = self.next - self.at, gradient - self.gradient
            if (s * y).sum() > 0:
                self.steps = [*self.steps[1 - MEMORY :], (s, y)]
        self.at, self.loss, self.gradient, self.length = self.next, loss, gradient, 1.0
        self.done = np.abs(gradient).max() <= self.tolerance
        self.way = -self._scaled(gradient)
        self.next = self.at + self.way

    def _scaled(self, g: np.ndarray) -> np.ndarray:
        shares = []
        for s, y in reversed(self.steps):
            shares.append((s * g).sum() / (s * y).sum())
            g = g - shares[-1] * y
        if self.steps:
            s, y = self.steps[-1]
            g = g * ((s * y).sum() / (y * y).sum())
        for (s, y), share in zip(self.steps, reversed(shares)):
            g = g + (share - (y * g).sum() / (s * y).sum()) * s
        return g


def fit_folds(rows: DataFrame, col: str, classes: int, folds: int, cost: float = 1.0, steps: int = 100, tolerance: float = 1e-5) -> np.ndarray:
    """Weights (folds, features + 1, classes), the last row of each those of the intercepts; fold f is fitted on the rows of all others.

    col holds the class (0 ..), the fold (0 ..) and the features of a row, as one array of doubles. The loss of a fold is the mean
    negative log-likelihood plus |weights|^2 / (2 cost n), n being its rows and intercepts free of charge.
    """
    context = rows.sparkSession.sparkContext

    def grams(x):
        z = with_intercept(x[:, 2:])
        return np.concatenate([(part := z[x[:, 1] == f]).T @ part for f in range(folds)])

    first = rows.select(col).first()
    sums = added_up(rows, col, grams, len(first[0]) - 1)  # a class and a fold are no features, an intercept is one
    held = sums.reshape(folds, -1, sums.shape[1])
    fits = [_Descent(held.sum(axis=0) - own, classes, cost, tolerance) for own in held]
    for _ in range(steps):
        active = [f for f, fit in enumerate(fits) if not fit.done]
        if not active:
            break
        sent = context.broadcast((active, np.concatenate([fits[f].weights() for f in active], axis=1)))

        def losses(x, sent=sent):
            active, weights = sent.value
            z = with_intercept(x[:, 2:])
            y, n = x[:, 0].astype(int), np.arange(len(x))
            logs = _log_softmax((z @ weights).reshape(len(x), len(active), classes))
            trains = x[:, 1][:, None] != np.array(active)[None, :]
            wrong = np.exp(logs)
            wrong[n, :, y] -= 1
            wrong *= trains[:, :, None]
            loss = -(logs[n, :, y] * trains).sum(axis=0)
            return np.concatenate([loss, (z.T @ wrong.reshape(len(x), -1)).ravel()])[:, None]

        found = added_up(rows, col, losses, 1)[:, 0]
        gradients = found[len(active) :].reshape(-1, len(active), classes)
        for i, f in enumerate(active):
            fits[f].tell(found[i], gradients[:, i])
        sent.destroy()
    for fit in fits:
        fit.done = True
    return np.stack([fit.weights() for fit in fits])


def with_intercept(features: np.ndarray) -> np.ndarray:
    return np.concatenate([features, np.ones((len(features), 1))], axis=1)


def held_out(rows: DataFrame, col: str, weights: np.ndarray) -> DataFrame:
    """(id, prob): the class probabilities of each row by the regression of the fold that holds it out."""
    sent = rows.sparkSession.sparkContext.broadcast(weights)

    def score(batches):
        weights = sent.value
        for batch in batches:
            x = as_matrix(batch.column(1))
            if len(x):
                z, fold = with_intercept(x[:, 2:]), x[:, 1].astype(int)
                prob = np.empty((len(x), weights.shape[2]))
                for f in np.unique(fold):
                    prob[fold == f] = np.exp(_log_softmax(z[fold == f] @ weights[f]))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(prob), pa.list_(pa.float64()))], ["id", "prob"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", col).mapInArrow(score, f"id {kind}, prob array<double>")
