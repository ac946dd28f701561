"""Quality classifier: ordinal cumulative-link regression on hashed text.

Grades come from the labels: 0 for poor quality, 1 for good but toxic, 2 for good and clean. One weight vector over
hashed features is shared by all grades and ordered thresholds cut its score: P(grade > k) = sigmoid(w.x - theta_k). The
expected grade and the tail probability P(grade >= 2) come out for every document; `kept` asks the tail to reach a cut.

Features: presence of each word (lower case, ASCII punctuation removed), of the beginnings of longer words, which inflected
forms share, and the bucket of each of a few ratios of the whole text. The model is fitted on a bounded sample: the
`sample_rows` labelled documents that come first by a hash of their id. Every fifth of them is held out of the fit: the cut
is the highest that leaves all but `spare` of the held-out top grade (all of it where that is less than a row; 0 where none is there). Its weights have a fixed number of slots, so that they may go to every task. Scoring is a map over all rows.

Defined cases: a null or empty text is scored by its ratios alone; a document with several label rows takes their
highest grade, rows with null labels do not count; without any label all documents get the top grade and are kept;
repeated rows give repeated rows; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

import math
import string
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from lithograph.llm.text import text_batches

SLOTS = 1 << 18
GRADES = 3
_PUNCTUATION = string.punctuation.encode()
_UPPER = bytes(range(65, 91))


def ratio_features(text: bytes, words: int, distinct: int) -> list[bytes]:
    """The constant feature, and the names of the buckets that the text's ratios fall in."""
    n = max(1, len(text))
    lines = [x for x in text.split(b"\n") if x]
    ratios = {
        b"symbols": (n - len(text.translate(None, b"#*$%&|<>"))) / n * 40,
        b"bangs": text.count(b"!") / n * 40,
        b"upper": (n - len(text.translate(None, _UPPER))) / n * 20,
        b"twice": (len(lines) - len(set(lines))) / max(1, len(lines)) * 20,
        b"length": math.log2(words + 1),
        b"mean": len(text) / max(1, words),
        b"variety:%d" % math.log2(words + 1): distinct / max(1, words) * 20,
    }
    return [b"="] + [b"%s=%d" % (k, min(20, math.ceil(v))) for k, v in ratios.items()]


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(None, _PUNCTUATION).split()


def beginnings(words: set[bytes], size: int = 4) -> set[bytes]:
    """First bytes of the longer words, under names that no word has."""
    return {b"^" + w[:size] for w in words if len(w) > size}


def slot(name: bytes) -> int:
    return zlib.crc32(name) & (SLOTS - 1)


def text_slots(text: bytes) -> list[int]:
    """Slots of all features of a text; ratio names hold "=", which no word does."""
    words = words_of(text)
    distinct = set(words)
    return [*map(slot, distinct), *map(slot, beginnings(distinct)), *map(slot, ratio_features(text, len(words), len(distinct)))]


MOST_EPOCHS = 400


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray
    cut: float = 0.4

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for k = 0 .. GRADES - 2, a row per score."""
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.thresholds[None, :], -40, 40)))


def fit_ordinal(slots: list[np.ndarray], grades: np.ndarray, steps: int = 6000, batch: int = 32, rate: float = 1.0, lasso: float = 0.002, seed: int = 42) -> OrdinalModel:
    """Cumulative-link regression by proximal steps (follow the regularised leader) with an L1 penalty of `lasso` for each row.

    It takes `steps` steps of `batch` rows, or goes MOST_EPOCHS times over the rows if that is less.
    The penalty leaves all but a few features at zero: words of one document would only be learned by heart. Thresholds
    take AdaGrad steps and are kept in order.
    """
    rng = np.random.default_rng(seed)
    if not len(slots):
        return OrdinalModel(np.zeros(SLOTS), np.full(GRADES - 1, -40.0))
    lasso *= len(slots)
    push, squares = np.zeros(SLOTS), np.zeros(SLOTS)
    theta, theta_squares = np.linspace(-1.0, 0.0, GRADES - 1), np.full(GRADES - 1, 1e-2)
    apart = np.arange(GRADES - 1) * 0.2

    def weights(at: np.ndarray) -> np.ndarray:
        shrunk = push[at] - np.sign(push[at]) * lasso
        return np.where(np.abs(push[at]) <= lasso, 0.0, -shrunk / ((1 + np.sqrt(squares[at])) / rate + 1))

    for _ in range(min(MOST_EPOCHS, -(-steps * batch // len(slots)))):
        order = rng.permutation(len(slots))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            sizes, y, pick = np.array([len(slots[r]) for r in rows]), grades[rows], np.arange(len(rows))
            used, where = np.unique(np.concatenate([slots[r] for r in rows]), return_inverse=True)
            old = weights(used)
            score = np.add.reduceat(old[where], np.concatenate([[0], np.cumsum(sizes)[:-1]]))
            up = np.hstack([np.ones((len(rows), 1)), OrdinalModel(old, theta).tails(score), np.zeros((len(rows), 1))])
            grad = np.bincount(where, np.repeat(up[pick, y] + up[pick, y + 1] - 1, sizes), len(used))
            push[used] += grad - (np.sqrt(squares[used] + grad**2) - np.sqrt(squares[used])) / rate * old
            squares[used] += grad**2
            slope, chance = up * (1 - up), np.maximum(up[pick, y] - up[pick, y + 1], 1e-9)
            d_theta = np.zeros(GRADES - 1)
            np.add.at(d_theta, y[y > 0] - 1, (slope[pick, y] / chance)[y > 0])
            np.add.at(d_theta, y[y < GRADES - 1], -(slope[pick, y + 1] / chance)[y < GRADES - 1])
            d_theta /= len(rows)
            theta_squares += d_theta**2
            theta = np.maximum.accumulate(theta - 0.1 * d_theta / np.sqrt(theta_squares) - apart) + apart
    return OrdinalModel(weights(np.arange(SLOTS)), theta)


def _sample_slots(batches):
    for part, texts in text_batches(batches):
        packed = [np.array(text_slots(t or b""), dtype=np.int32).tobytes() for t in texts]
        yield pa.RecordBatch.from_arrays([part.column("grade"), pa.array(packed, pa.binary())], ["grade", "slots"])


def fit_with_cut(slots: list[np.ndarray], grades: np.ndarray, spare: float = 0.005) -> OrdinalModel:
    """The model of four fifths of the rows, with the cut that spares the top grade of the rest: all but a share `spare` of its rows pass,
    all of them if they are few, and all documents if there are none."""
    test = np.arange(len(slots)) % 5 == 4
    model = fit_ordinal([s for s, t in zip(slots, test, strict=True) if not t], grades[~test])
    scores = np.array([model.weights[slots[i]].sum() for i in np.flatnonzero(test & (grades == GRADES - 1))])
    model.cut = float(np.sort(model.tails(scores)[:, -1])[int(spare * len(scores))]) if len(scores) else 0.0
    return model


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 20000) -> OrdinalModel:
    """The model of the first sample_rows labelled documents by hash: a row for each id, of texts that share one the least by hash, of labels
    that differ the greatest grade."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    graded = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(grade).alias("grade"))
    sample = graded.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    rows = rows.groupBy("doc_id", "grade").agg(F.min_by(F.coalesce("text", F.lit("")), F.xxhash64("text")).alias("text"))
    got = rows.mapInArrow(_sample_slots, "grade int, slots binary").toArrow()
    slots = [np.frombuffer(s, dtype=np.int32) for s in got.column("slots").to_pylist()]
    order = sorted(range(len(slots)), key=lambda i: zlib.crc32(slots[i].tobytes()))  # not the order of arrival
    return fit_with_cut([slots[i] for i in order], got.column("grade").to_numpy().astype(int)[order])


class _Weights(dict):
    """Weight by feature name, looked up once."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def __missing__(self, name: bytes) -> float:
        found = self[name] = float(self.weights[slot(name)])
        return found


def grade_documents(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """docs, which hold text and none of these names, with expected_grade, tail_probability and kept."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds, model.cut))

    def score(batches):
        weights, thresholds, cut = sent.value
        known, model = _Weights(weights), OrdinalModel(weights, thresholds)
        for part, texts in text_batches(batches):
            scores = []
            for text in texts:
                words = words_of(text or b"")
                distinct = set(words)
                total = sum(map(known.__getitem__, distinct)) + sum(map(known.__getitem__, beginnings(distinct))) + sum(map(known.__getitem__, ratio_features(text or b"", len(words), len(distinct))))
                scores.append(total)
            if len(known) > 200_000:
                known.clear()
            tails = model.tails(np.array(scores))
            added = [pa.array(tails.sum(axis=1)), pa.array(tails[:, -1]), pa.array(tails[:, -1] >= cut)]
            yield pa.RecordBatch.from_arrays([*part.columns, *added], [*part.schema.names, "expected_grade", "tail_probability", "kept"])

    added = [StructField("expected_grade", DoubleType()), StructField("tail_probability", DoubleType()), StructField("kept", BooleanType())]
    return docs.mapInArrow(score, StructType([*docs.schema.fields, *added]))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs' own columns, without the documents that the classifier rejects."""
    held = docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("doc"), "text")
    kept = grade_documents(held, train(docs, labels)).filter("kept")
    return kept.select(*(F.col("text") if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns))


def op9_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return grade_documents(docs.select("doc_id", "text"), train(docs, labels)).drop("text")
