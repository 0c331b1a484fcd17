"""Quality classifier: naive-Bayes support vectors over n-gram indicators.

Indicators are the presence of word 1- and 2-grams and of 1- to 4-grams of a text's shape (letters, digits, white
space and each mark as classes, runs of small letters as one), hashed to ``DIMENSIONS``; a word that repeats its
forerunner is one 2-gram whatever the word. Each indicator is scaled by the log ratio of its smoothed counts in the
two classes; a linear model with squared hinge loss is fitted by dual coordinate descent and drawn towards its
mean magnitude, as the method has it; Platt's sigmoid, fitted to rows that the weights were not, makes the margin a score.

The fit takes at most ``TRAIN_ROWS`` labelled documents, ``training.TRAIN_TEXT_BYTES`` of a text and
``training.TRAIN_BYTES`` in all (their hashed indicators, not their texts, reach the driver). Scoring reads every whole text in one pass without a shuffle.

Edge cases: null and empty texts have no indicators and score by the intercept; with one class only, or no labelled row,
every score is the labels' mean or 0.5; repeated rows are scored one by one; further columns are not read, and one to be kept
that is named ``score`` gives way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strataforge.llm import textkit as K
from strataforge.llm.training import folds, gathered

BITS = 18
DIMENSIONS = 1 << BITS
TRAIN_ROWS = 4000
SHAPE_GRAMS = 4

_CLASS = np.zeros(256, np.uint64)
_CLASS[0x21:0x7F] = np.arange(10, 10 + 0x7F - 0x21)
_CLASS[0x61:0x7B] = _CLASS[0x80:] = 1
_CLASS[0x41:0x5B] = 2
_CLASS[0x30:0x3A] = 3
_CLASS[[0x20, 0x09]] = 4
_CLASS[[0x0A, 0x0D]] = 5
_REPEAT = np.uint64(0x51ED270B7F2A6A1D)


def _grams(values: np.ndarray, doc: np.ndarray, n: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    h = K.gram_hashes(values + np.uint64(salt), n)
    inside = doc[: len(h)] == doc[n - 1 :][: len(h)]
    return h[inside], doc[: len(h)][inside]


def indicators(s: K.Slice) -> list[np.ndarray]:
    """Each text's distinct indicators, in no order."""
    kind = _CLASS[s.buf]
    keep = np.ones(len(kind), bool)
    keep[1:] = (kind[1:] != 1) | (kind[:-1] != 1)
    begin = s.offsets[:-1]
    keep[begin[begin < len(kind)]] = True
    at = np.flatnonzero(keep)
    shape, where = kind[at], np.searchsorted(s.offsets, at, side="right") - 1
    found = [_grams(shape, where, n, 1000 * n) for n in range(1, SHAPE_GRAMS + 1)]
    buf = K.LOWER[s.buf]
    starts, ends, doc = K.spans(s, K.SPACED, buf)
    words = K.span_hashes(buf, starts, ends)
    found.append((words, doc))
    pair, pair_doc = _grams(words, doc, 2, 0)
    if len(words) > 1:
        same = (words[1:] == words[:-1])[doc[1:] == doc[:-1]]
        pair[same] = _REPEAT
    found.append((pair, pair_doc))
    ids = np.concatenate([(h >> np.uint64(64 - BITS)).astype(np.int32) for h, _ in found])
    owner = np.concatenate([d for _, d in found])
    order = np.argsort(owner, kind="stable")
    ids, edge = ids[order], K.bounds(owner[order], s.n)
    tag, out = np.zeros(DIMENSIONS, np.int32), []
    for i in range(s.n):
        part = ids[edge[i] : edge[i + 1]]
        number = np.arange(len(part), dtype=np.int32)
        tag[part] = number
        out.append(part[tag[part] == number])
    return out


def fit_hinge(rows: list[np.ndarray], scale: np.ndarray, sign: np.ndarray, c: float = 1.0, epochs: int = 12, seed: int = 7) -> np.ndarray:
    """Weights of the last ``len(scale) + 1`` places (intercept last) for squared hinge loss, by dual coordinate descent."""
    w = np.zeros(len(scale) + 1)
    values = [np.r_[scale[r], 1.0] for r in rows]
    places = [np.r_[r, len(scale)] for r in rows]
    diagonal = 0.5 / c
    norm = np.array([v @ v + diagonal for v in values])
    alpha = np.zeros(len(rows))
    rng = np.random.Generator(np.random.PCG64(seed))
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            gradient = sign[i] * (w[places[i]] @ values[i]) - 1 + diagonal * alpha[i]
            step = max(alpha[i] - gradient / norm[i], 0.0) - alpha[i]
            if step:
                worst = max(worst, abs(gradient))
                alpha[i] += step
                w[places[i]] += step * sign[i] * values[i]
        if worst < 1e-3:
            break
    return w


def fit_sigmoid(margin: np.ndarray, target: np.ndarray, steps: int = 30) -> tuple[float, float]:
    """Platt's scaling with his smoothed targets, by damped Newton steps."""
    pos, neg = target.sum(), len(target) - target.sum()
    t = np.where(target == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x, theta = np.stack([margin, np.ones_like(margin)], 1), np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        theta = theta - np.linalg.solve(hessian, x.T @ (p - t)) * 0.7
    return float(theta[0]), float(theta[1])


class Model:
    def __init__(self, rows: list[np.ndarray], labels: np.ndarray, blend: float = 0.25) -> None:
        self.constant, self.slope, self.shift = None, 1.0, 0.0
        if not 0 < labels.sum() < len(labels):
            self.constant = float(labels.mean()) if len(labels) else 0.5
            return
        counts = np.zeros((2, DIMENSIONS))
        for r, y in zip(rows, labels, strict=True):
            counts[int(y)][r] += 1
        smoothed = counts + 1
        ratio = np.log(smoothed[1] / smoothed[1].sum()) - np.log(smoothed[0] / smoothed[0].sum())
        ratio[counts.sum(0) == 0] = 0
        w = fit_hinge(rows, ratio, np.where(labels == 1, 1.0, -1.0))
        mean = np.abs(w[:-1]).mean()
        self.weight, self.bias = ((1 - blend) * mean + blend * w[:-1]) * ratio, blend * w[-1]

    def calibrate(self, margin: np.ndarray, labels: np.ndarray) -> None:
        """The sigmoid, from margins of rows that the weights were not fitted on."""
        if self.constant is None and 0 < labels.sum() < len(labels):
            self.slope, self.shift = fit_sigmoid(margin, labels)

    def margin(self, row: np.ndarray) -> float:
        return float(self.weight[row].sum() + self.bias)

    def score(self, row: np.ndarray) -> float:
        if self.constant is not None:
            return self.constant
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(row) + self.shift, -30, 30))))


def fit(sample: DataFrame) -> Model:
    """``sample``: rows of ``labelled_sample``. The sigmoid is fitted to a quarter's margins by a model of the other rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in K.slices(batch.column(0)):
                found = indicators(s)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(s.first, s.n).cast(pa.int32()), batch.column(2).slice(s.first, s.n).cast(pa.string()), pa.array([f.tobytes() for f in found], pa.binary())], names=["y", "k", "f"])

    id_col = sample.columns[0]
    rows = sample.select("text", "_label", id_col).mapInArrow(run, "y int, k string, f binary")
    rows = gathered(rows)
    features = [np.sort(np.frombuffer(x, np.int32)) for x in rows.column("f").to_pylist()]
    labels = rows.column("y").to_numpy().astype(np.int64)
    model = Model(features, labels)
    fitted, rest = folds(len(labels))
    trial = Model([features[i] for i in fitted], labels[fitted])
    if trial.constant is None:
        model.calibrate(np.array([trial.margin(features[i]) for i in rest]), labels[rest])
    return model


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The ``keep`` columns and ``score``, the probability-like value of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = tuple(K.others(keep, "score"))
    kinds = dict(docs.dtypes)
    extra = [c for c in keep if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in K.slices(batch.column(len(extra))):
                value = [shared.value.score(f) for f in indicators(s)]
                part = batch.slice(s.first, s.n)
                kept = [part.column(extra.index(c) if c in extra else len(extra)) for c in keep]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(value, pa.float64())], names=[*keep, "score"])

    return docs.select(*extra, text_col).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "score double"]))
