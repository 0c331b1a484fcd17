"""Language identification by hyperdimensional profiles.

Every letter, whatever its script, has a fixed random vector of ``DIMENSIONS`` signs, which come from a hash of its code point. A letter 3-gram is bound by rotating the first
letter's vector twice, the second's once, and multiplying the three; a text is the bundle (sum) of its 3-grams' vectors,
with word edges as one more letter. A language's prototype is the bundle of all its training texts, kept as whole
numbers, so it is the same in whatever order tasks finish. A text gets the language of the largest cosine.

The fit covers every training row: each task sends one sum per language, so what is shuffled and what reaches the
driver is languages times dimensions. Scoring is one pass without a shuffle.

Edge cases: a text that is null, empty or without a letter is ``und`` with score 0, and so is every text if no language
was learned; rows with null text or language are not learned from; cosines that tie take the language first in
order; negative cosines count as score 0; repeated rows are judged one by one; further columns are not read (of those to keep,
ones named like a new column give way). Memory is bounded by ``BLOCK`` vectors and one sum for each text of a slice.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataforge.llm import textkit as K

DIMENSIONS = 1024
#: 3-grams whose vectors are held at once, and the share of texts with a 3-gram above which a dense product is the faster.
BLOCK, DENSE = 4096, 0.05
_POINT = 21  # bits of a code point
_TABLE = 1 << 22  # up to so many possible values are counted in a table instead of being sorted

_STATE: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """The small letter of each code point, 0 for what is no letter."""
    if not _STATE:
        number = np.zeros(sys.maxunicode + 1, np.int64)
        for point in range(sys.maxunicode + 1):
            c = chr(point)
            if c.isalpha():
                low = c.lower()
                number[point] = ord(low) if len(low) == 1 else point
        _STATE["number"] = number
    return _STATE["number"]


def signs(points: np.ndarray) -> np.ndarray:
    """The vector of each letter: ``DIMENSIONS`` bits of a hash of its code point, as 1 and -1."""
    words = np.arange(DIMENSIONS // 64, dtype=np.uint64)
    bits = K.mix(K.mix(points.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D))[:, None] + words * np.uint64(0x9E3779B97F4A7C15))
    return np.unpackbits(bits.astype("<u8").view(np.uint8).reshape(len(points), -1), axis=1).astype(np.int8) * 2 - 1


def bind(codes: np.ndarray) -> np.ndarray:
    """Vectors of 3-gram codes, as signs."""
    three = np.stack([codes >> 2 * _POINT, codes >> _POINT, codes], 1) & ((1 << _POINT) - 1)
    points, at = np.unique(three, return_inverse=True)
    at, sign = at.reshape(three.shape), signs(points)
    return np.roll(sign, 2, 1)[at[:, 0]] * np.roll(sign, 1, 1)[at[:, 1]] * sign[at[:, 2]]


def gram_counts(s: K.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct 3-gram codes of a slice; code (sorted), text and count of every pair of them that occurs; whether a text has a letter."""
    points = np.frombuffer(s.buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    first = np.r_[0, np.cumsum((s.buf & 0xC0) != 0x80)][s.offsets]
    first[-1] = len(points)
    letters = np.insert(_letters()[points], first[:-1], 0)
    begin = first[:-1] + np.arange(s.n)
    letters = np.append(letters, 0)
    doc = np.zeros(len(letters), np.int64)
    doc[begin] = 1
    doc = np.cumsum(doc) - 1
    doc[-1] = s.n
    keep = np.ones(len(letters), bool)
    keep[1:] = (letters[1:] > 0) | (letters[:-1] > 0) | (doc[1:] != doc[:-1])
    letters, doc = letters[keep], doc[keep]
    has = np.bincount(doc, letters > 0, minlength=s.n)[: s.n] > 0
    ok = (doc[:-2] == doc[1:-1]) & ((doc[2:] == doc[:-2]) | (letters[2:] == 0)) if len(letters) > 2 else np.zeros(0, bool)
    known, small = _distinct(letters, int(letters.max()) + 1)
    local, at = _distinct(((small[:-2] * len(known) + small[1:-1]) * len(known) + small[2:])[ok], len(known) ** 3)
    codes = (known[local // len(known) ** 2] << 2 * _POINT) | (known[local // len(known) % len(known)] << _POINT) | known[local % len(known)] if len(local) else local
    key = at * s.n + doc[:-2][ok]
    if len(codes) * s.n <= _TABLE:
        count = np.bincount(key, minlength=len(codes) * s.n)
        pair = np.flatnonzero(count)
        count = count[pair]
    else:
        pair, count = np.unique(key, return_counts=True)
    return codes, pair // max(s.n, 1), pair % max(s.n, 1), count, has


def _distinct(values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order and which of them each is; values are under ``size``."""
    if size > _TABLE:
        return np.unique(values, return_inverse=True)
    there = np.zeros(size, bool)
    there[values] = True
    found = np.flatnonzero(there)
    number = np.empty(size, np.int32)
    number[found] = np.arange(len(found))
    return found, number[values].astype(np.int64)


def bundle(codes: np.ndarray, code: np.ndarray, row: np.ndarray, count: np.ndarray, rows: int) -> np.ndarray:
    """For each row the sum of its 3-grams' vectors, times their counts; exact whole numbers up to 2^53 a sum."""
    out = np.zeros((rows, DIMENSIONS))
    for begin in range(0, len(codes), BLOCK):
        some = codes[begin : begin + BLOCK]
        vectors = bind(some)
        a, b = np.searchsorted(code, [begin, begin + len(some)])
        used, at = np.unique(row[a:b], return_inverse=True)
        c, n = code[a:b] - begin, count[a:b]
        if len(c) > DENSE * len(used) * len(some):
            wide = vectors.astype(np.float32 if n.max(initial=0) < 1 << 11 else np.float64)
            for i in range(0, len(used), 256):
                here = (at >= i) & (at < i + 256)
                table = np.zeros((min(256, len(used) - i), len(some)), wide.dtype)
                table[at[here] - i, c[here]] = n[here]
                out[used[i : i + 256]] += table @ wide
        else:
            order = np.argsort(at, kind="stable")
            for i in range(0, len(order), BLOCK):
                here = order[i : i + BLOCK]
                first = np.flatnonzero(np.r_[True, np.diff(at[here]) != 0])
                out[used[at[here[first]]]] += np.add.reduceat(vectors[c[here]] * n[here, None], first, axis=0)
    return out


def prototypes(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> dict[str, np.ndarray]:
    """The bundle of each language's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for s in K.slices(batch.column(0), K.SLICE_BYTES // 2):
                names, lang = np.unique(np.array(langs[s.first : s.first + s.n], object), return_inverse=True)
                codes, code, row, count, _ = gram_counts(s)
                pair, at = np.unique(code * len(names) + lang[row], return_inverse=True)
                summed = bundle(codes, pair // len(names), pair % len(names), np.bincount(at, count, minlength=len(pair)).astype(np.int64), len(names))
                for name, vector in zip(names, summed, strict=True):
                    total[name] = total.get(name, 0) + np.rint(vector).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.int64()))], names=["lang", "v"])

    known = docs.select(text_col, F.col(lang_col).cast("string").alias("lang")).where(F.col(text_col).isNotNull() & F.col("lang").isNotNull())
    summed = known.mapInArrow(run, "lang string, v array<bigint>").select("lang", F.posexplode("v")).groupBy("lang", "pos").agg(F.sum("col").alias("n"))
    found: dict[str, np.ndarray] = {}
    for r in summed.collect():
        found.setdefault(r["lang"], np.zeros(DIMENSIONS, np.int64))[r["pos"]] = r["n"]
    return dict(sorted(found.items()))


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The ``keep`` columns, ``lang_pred`` and ``score`` (cosine with that language's prototype, 0 at least)."""
    names = list(profiles)
    unit = np.stack([v / max(np.linalg.norm(v), 1e-9) for v in profiles.values()], 1) if names else None
    shared = docs.sparkSession.sparkContext.broadcast((names, unit))
    keep = K.others(keep, "lang_pred", "score")
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, unit = shared.value
        for batch in batches:
            for s in K.slices(batch.column(len(keep)), K.SLICE_BYTES // 2):
                lang, value = ["und"] * s.n, np.zeros(s.n)
                if names:
                    codes, code, row, count, has = gram_counts(s)
                    vector = bundle(codes, code, row, count, s.n)
                    size = np.linalg.norm(vector, axis=1)
                    cosine = (vector @ unit) / np.maximum(size, 1e-9)[:, None]
                    best = cosine.argmax(1)
                    value = np.where(has, np.clip(cosine[np.arange(s.n), best], 0, 1), 0).astype(float)
                    lang = [names[b] if h else "und" for b, h in zip(best, has, strict=True)]
                part = batch.slice(s.first, s.n)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(lang, pa.string()), pa.array(value)], names=[*keep, "lang_pred", "score"])

    return docs.select(*keep, text_col).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "lang_pred string, score double"]))
