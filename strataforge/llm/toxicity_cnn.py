"""Toxicity: a convolutional text classifier in numpy.

A word's input is the sum of the hashed embeddings of the whole word and of its first ``PREFIXES`` bytes, so that
inflected and compound forms share what they have in common. Of ``BUCKETS`` buckets, those that occur in ``MIN_DOCS`` training
documents or more have an embedding of their own, all others share one, so that the fit can't learn single documents by heart. Filters of the widths in ``WIDTHS`` slide over them, a rectifier and max
pooling over the whole text follow, then a logistic layer. Training is AdaGrad on the log loss; only the winning
position of each filter carries a gradient. For scoring, each filter's product with every embedding is worked out
once, so a convolution is a sum of table rows.

``language_thresholds`` calibrates a decision threshold per language (largest F1, ties to the lower threshold) on a quarter of
the training rows, scored by a model of the other three; languages with fewer than ``MIN_PER_LANGUAGE`` rows of either class use the one of all rows. Thresholds are
applied to scores afterwards; a language is never an input of a score.

The fit takes at most ``TRAIN_ROWS`` labelled documents, ``training.TRAIN_TEXT_BYTES`` of a text and
``training.TRAIN_BYTES`` of word hashes in all, which is what reaches the driver; it holds about three times as much. Scoring reads every whole text,
in one pass without a shuffle.

Edge cases: null and empty texts have no words and pool to zeros; with one class only, or no labelled row, every score is
the labels' mean or 0; repeated rows are scored one by one; further columns are not read, and one to be kept that is named
``score`` gives way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strataforge.llm import textkit as K
from strataforge.llm.training import folds, gathered

BITS = 20
BUCKETS = 1 << BITS
SIZE = 8
FILTERS = 8
WIDTHS = (1, 2, 3)
PREFIXES = (6, 7, 9)
TRAIN_ROWS = 6000
MIN_PER_LANGUAGE = 20
MIN_DOCS = 5
SETTLED = 0.01  # an error under it changes nothing


def buckets(s: K.Slice) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of each word (words x forms), and where each text's words begin."""
    buf = K.LOWER[s.buf]
    starts, ends, doc = K.spans(s, K.ALNUM, buf)
    forms = [K.span_hashes(buf, starts, ends), *(K.span_hashes(buf, starts, np.minimum(starts + n, ends), n) for n in PREFIXES)]
    return np.stack([(h >> np.uint64(64 - BITS)).astype(np.int32) for h in forms], 1), K.bounds(doc, s.n)


class Model:
    def __init__(self, texts: list[np.ndarray], labels: np.ndarray, epochs: int = 5, rate: float = 0.08, seed: int = 5) -> None:
        self.constant = None
        if not 0 < labels.sum() < len(labels):
            self.constant = float(labels.mean()) if len(labels) else 0.0
            return
        rng = np.random.Generator(np.random.PCG64(seed))
        in_docs = np.zeros(BUCKETS, np.int32)
        for t in texts:
            in_docs[np.unique(t)] += 1
        known = np.flatnonzero(in_docs >= MIN_DOCS)
        self.number = np.zeros(BUCKETS, np.int32)
        self.number[known] = np.arange(1, len(known) + 1)
        self.embedding = rng.normal(0, 0.1, (len(known) + 1, SIZE))
        self.filters = {w: rng.normal(0, 0.5, (w, SIZE, FILTERS)) for w in WIDTHS}
        self.bias = {w: np.zeros(FILTERS) for w in WIDTHS}
        self.out, self.base = rng.normal(0, 0.3, FILTERS * len(WIDTHS)), float(np.log(labels.mean() / (1 - labels.mean())))
        self._train(texts, labels, epochs, rate, rng)
        self._tabulate()

    def _train(self, texts: list[np.ndarray], labels: np.ndarray, epochs: int, rate: float, rng: np.random.Generator) -> None:
        squares = {"e": np.full(self.embedding.shape, 1e-3), "o": np.full(len(self.out), 1e-3), "b": 1e-3}
        squares |= {w: np.full((w, SIZE, FILTERS), 1e-3) for w in WIDTHS} | {(w, "b"): np.full(FILTERS, 1e-3) for w in WIDTHS}
        col = np.arange(FILTERS)
        for _ in range(epochs):
            for i in rng.permutation(len(texts)):
                ids = self.number[texts[i]]
                e = self.embedding[ids].sum(1)
                pooled, wins = np.zeros(FILTERS * len(WIDTHS)), {}
                for b, w in enumerate(WIDTHS):
                    if len(ids) < w:
                        continue
                    f = self.filters[w]
                    made = sum(e[j : len(ids) - w + 1 + j] @ f[j] for j in range(w)) + self.bias[w]
                    best = made.argmax(0)
                    value = made[best, col]
                    pooled[b * FILTERS : (b + 1) * FILTERS] = np.maximum(value, 0)
                    wins[w] = (best, value > 0)
                p = 1 / (1 + np.exp(-np.clip(pooled @ self.out + self.base, -30, 30)))
                error = p - labels[i]
                if abs(error) < SETTLED:
                    continue
                down = error * self.out
                g = error * pooled + 1e-4 * self.out
                squares["o"] += g * g
                self.out -= rate * g / np.sqrt(squares["o"])
                squares["b"] += error * error
                self.base -= rate * error / np.sqrt(squares["b"])
                for b, w in enumerate(WIDTHS):
                    if w not in wins:
                        continue
                    best, on = wins[w]
                    d = down[b * FILTERS : (b + 1) * FILTERS] * on
                    if not d.any():
                        continue
                    f = self.filters[w]
                    g_b = d
                    squares[(w, "b")] += g_b * g_b
                    self.bias[w] -= rate * g_b / np.sqrt(squares[(w, "b")])
                    for j in range(w):
                        at = ids[best + j]
                        g_f = e[best + j].T * d
                        g_e = (f[j] * d).T
                        squares[w][j] += g_f * g_f
                        f[j] -= rate * g_f / np.sqrt(squares[w][j])
                        forms, g_all = at[on].reshape(-1), np.repeat(g_e[on], at.shape[1], 0)
                        np.add.at(squares["e"], forms, g_all * g_all)
                        np.add.at(self.embedding, forms, -rate * g_all / np.sqrt(squares["e"][forms]))

    def _tabulate(self) -> None:
        self.tables = {w: [(self.embedding @ self.filters[w][j]).astype(np.float32) for j in range(w)] for w in WIDTHS}
        del self.embedding

    def scores(self, ids: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """One score per text; ``edge`` as from ``buckets``."""
        n = len(edge) - 1
        if self.constant is not None:
            return np.full(n, self.constant)
        z = np.full(n, self.base)
        ids = self.number[ids]
        for b, w in enumerate(WIDTHS):
            some = np.flatnonzero(np.diff(edge) >= w)
            if not len(some):
                continue
            made = np.tile(self.bias[w].astype(np.float32), (len(ids) - w + 1, 1))
            for j in range(w):
                for form in range(ids.shape[1]):
                    made += self.tables[w][j][ids[j : len(ids) - w + 1 + j, form]]
            cut = np.stack([edge[some], edge[some + 1] - w + 1], 1).reshape(-1)
            if cut[-1] == len(made):
                cut = cut[:-1]
            top = np.maximum.reduceat(made, cut, axis=0)[::2]
            z[some] += np.maximum(top, 0) @ self.out[b * FILTERS : (b + 1) * FILTERS]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _best(score: np.ndarray, label: np.ndarray) -> float:
    order = np.argsort(-score, kind="stable")
    hit = np.cumsum(label[order])
    f1 = 2 * hit / (np.arange(1, len(order) + 1) + label.sum())
    last = np.r_[score[order][1:] != score[order][:-1], True]  # only between distinct scores
    k = int(np.flatnonzero(last)[f1[last].argmax()])
    below = score[order][k + 1] if k + 1 < len(order) else 0.0
    return float((score[order][k] + below) / 2)


def language_thresholds(score: np.ndarray, label: np.ndarray, lang: list[str | None]) -> tuple[dict[str, float], float]:
    """A threshold per language and the one of all rows; without both classes it is 0.5."""
    overall = _best(score, label) if 0 < label.sum() < len(label) else 0.5
    found = {}
    for x in sorted({v for v in lang if v is not None}):
        mine = np.array([v == x for v in lang])
        if min(label[mine].sum(), (1 - label[mine]).sum()) >= MIN_PER_LANGUAGE:
            found[x] = _best(score[mine], label[mine])
    return found, overall


def fit(sample: DataFrame, lang_col: str | None = None) -> tuple[Model, dict[str, float], float]:
    """From rows of ``labelled_sample``: the model, thresholds by language, the overall threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in K.slices(batch.column(0)):
                ids, edge = buckets(s)
                found = [ids[edge[i] : edge[i + 1]].tobytes() for i in range(s.n)]
                part = batch.slice(s.first, s.n)
                yield pa.RecordBatch.from_arrays([part.column(1).cast(pa.int32()), part.column(2).cast(pa.string()), part.column(3).cast(pa.string()), pa.array(found, pa.binary())], names=["y", "k", "lang", "f"])

    id_col = sample.columns[0]
    rows = sample.select("text", "_label", id_col, lang_col or id_col).mapInArrow(run, "y int, k string, lang string, f binary")
    rows = gathered(rows)
    texts, labels = [np.frombuffer(x, np.int32).reshape(-1, 1 + len(PREFIXES)) for x in rows.column("f").to_pylist()], rows.column("y").to_numpy().astype(np.int64)
    model = Model(texts, labels)
    fitted, rest = folds(len(labels))
    trial, held = Model([texts[i] for i in fitted], labels[fitted]), [texts[i] for i in rest]
    edge = np.r_[0, np.cumsum([len(t) for t in held])].astype(np.int64)
    score = trial.scores(np.concatenate(held) if held else np.zeros((0, 1 + len(PREFIXES)), np.int32), edge)
    langs = rows.column("lang").to_pylist() if lang_col else []
    by_lang, overall = language_thresholds(score, labels[rest], [langs[i] for i in rest] if langs else [])
    return model, by_lang, overall


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The ``keep`` columns and ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = tuple(K.others(keep, "score"))
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in K.slices(batch.column(len(keep))):
                part = batch.slice(s.first, s.n)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(shared.value.scores(*buckets(s)), pa.float64())], names=[*keep, "score"])

    return docs.select(*keep, text_col).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "score double"]))
