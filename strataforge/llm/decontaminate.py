"""Benchmark decontamination: which words of a document stand inside a window of a benchmark item.

A prefix-filtered set join. A window is a run of ``window`` item words (an item of fewer words is one window);
as a set it is the ``SHINGLE``-word shingles it holds (words are compared by 128 bits of hashes). A document contains a window only if it contains all
of these shingles, so one of them is prefix enough: the rarest, by its count over the whole corpus. Documents
are joined on these prefix shingles alone; a candidate's position gives the only place where the window could
stand, which must lie inside the text (length and positional bound), and its words are then compared one by
one. A window with a shingle that no document has is dropped before the join.

The benchmark is joined in blocks of at most about ``BLOCK_WORDS`` words, each small enough to be sent to every
executor; a larger benchmark takes more passes, with the documents and their hits so far staged in between.

Edge cases: null or empty text has no words and no hits; items with null id or text are ignored; rows with the
same item id count as one item; repeated document rows are judged one by one; empty tables give no hits or
no rows; further columns of either table are not read, and those of the documents can be kept with ``keep``, unless a new
column has the name. Item ids may be of any type that can be ordered.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from strataforge.llm import textkit as K
from strataforge.llm.staging import stage

SHINGLE = 3
BLOCK_WORDS = 500_000


def _words(text: str) -> np.ndarray:
    """Two hashes of each word, side by side."""
    buf = K.LOWER[np.frombuffer(text.encode(), np.uint8)]
    s = K.Slice(0, buf, np.array([0, len(buf)], np.int64))
    starts, ends, _ = K.spans(s, K.ALNUM, buf)
    return np.stack([K.span_hashes(buf, starts, ends, seed) for seed in (0, 1)], 1)


class Windows:
    """Distinct windows of one length, with the ids of their items and, once ranked, their prefix shingles."""

    def __init__(self, length: int, items: dict[bytes, set[int]]) -> None:
        self.length, self.k = length, min(SHINGLE, length)
        keys = sorted(items)
        both = np.frombuffer(b"".join(keys), np.uint64).reshape(len(keys), length, 2)
        self.words, self.second = np.ascontiguousarray(both[:, :, 0]), np.ascontiguousarray(both[:, :, 1])
        self.items = [sorted(items[k]) for k in keys]
        flat = both.reshape(-1)
        places = length - self.k + 1
        grams = [flat[0:0]] * places
        for j in range(places):
            h = np.zeros(len(keys), np.uint64)
            for i in range(self.k):
                h = h + self.words[:, j + i] * K._GRAM[i]
            grams[j] = K.mix(h + np.uint64(self.k))
        self.shingles = np.stack(grams, 1)

    def rank(self, counts: dict[int, int]) -> None:
        """Keeps windows that can occur, keyed by their rarest shingle (ties: the smaller hash)."""
        known = np.array(sorted(counts), np.uint64)
        number = np.array([counts[int(x)] for x in known], np.int64)
        at = np.searchsorted(known, self.shingles)
        at[at == len(known)] = 0
        seen = known[at] == self.shingles if len(known) else np.zeros(self.shingles.shape, bool)
        alive = np.flatnonzero(seen.all(1))
        self.words, self.second, self.items = self.words[alive], self.second[alive], [self.items[i] for i in alive]
        shingles, number = self.shingles[alive], number[at[alive]] if len(known) else np.zeros((0, 1), np.int64)
        place = np.array([min(range(n.size), key=lambda j: (n[j], h[j])) for n, h in zip(number, shingles, strict=True)], np.int64)
        key = shingles[np.arange(len(place)), place] if len(place) else np.zeros(0, np.uint64)
        order = np.argsort(key, kind="stable")
        self.owner, self.place = order, place[order]
        self.key, self.first = np.unique(key[order], return_index=True)
        self.first = np.r_[self.first, len(order)]
        del self.shingles

    def find(self, words: np.ndarray, low: np.ndarray, high: np.ndarray, second: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Start word and window of each occurrence; ``low`` and ``high`` bound the words of each word's text, ``second`` gives
        the second hashes of words."""
        at, k = K.gram_hashes(words, self.k), self.key
        if not len(k) or not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        slot = np.searchsorted(k, at)
        slot[slot == len(k)] = 0
        here = np.flatnonzero(k[slot] == at)
        slot = slot[here]
        size = self.first[slot + 1] - self.first[slot]
        each = np.repeat(np.arange(len(here)), size)
        entry = np.arange(len(each)) - np.repeat(np.cumsum(size) - size, size) + self.first[slot][each]
        token, window = here[each], self.owner[entry]
        start = token - self.place[entry]
        ok = (start >= low[token]) & (start + self.length <= high[token])
        start, window = start[ok], window[ok]
        for i in range(self.length):
            same = words[start + i] == self.words[window, i]
            start, window = start[same], window[same]
        if len(start):
            used, at = np.unique(start[:, None] + np.arange(self.length), return_inverse=True)
            same = (second(used)[at].reshape(len(start), -1) == self.second[window]).all(1)
            start, window = start[same], window[same]
        return start, window


def _windows(items: list[tuple[int, str]], window: int) -> list[Windows]:
    """``items``: place of the item's id, text."""
    by: dict[int, dict[bytes, set[int]]] = defaultdict(lambda: defaultdict(set))
    for place, text in items:
        words = _words(text)
        n = min(window, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            by[n][words[i : i + n].tobytes()].add(place)
    return [Windows(n, by[n]) for n in sorted(by)]


def _tokens(s: K.Slice) -> tuple[np.ndarray, ...]:
    buf = K.LOWER[s.buf]
    starts, ends, doc = K.spans(s, K.ALNUM, buf)
    return starts, ends, doc, K.span_hashes(buf, starts, ends), K.bounds(doc, s.n), buf


def _count(docs: DataFrame, text_col: str, windows: list[Windows]) -> dict[int, int]:
    """How often each shingle of the block occurs in the corpus; shingles that never do are left out."""
    keys = {k: np.unique(np.concatenate([w.shingles.reshape(-1) for w in windows if w.k == k])) for k in {w.k for w in windows}}
    shared = docs.sparkSession.sparkContext.broadcast(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {k: np.zeros(len(v), np.int64) for k, v in shared.value.items()}
        for batch in batches:
            for s in K.slices(batch.column(0)):
                _, _, doc, words, _, _ = _tokens(s)
                for k, v in shared.value.items():
                    h = K.gram_hashes(words, k)
                    h = h[doc[: len(h)] == doc[k - 1 :][: len(h)]]
                    at = np.searchsorted(v, h)
                    at[at == len(v)] = 0
                    total[k] += np.bincount(at[v[at] == h], minlength=len(v))
        for k, v in shared.value.items():
            some = total[k] > 0
            yield pa.RecordBatch.from_arrays([pa.array(v[some].view(np.int64)), pa.array(total[k][some])], names=["h", "n"])

    rows = docs.select(text_col).mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).toPandas()
    return {int(np.int64(h).view(np.uint64)): int(n) for h, n in zip(rows.h, rows.n, strict=True)}


def find_windows(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 8, keep: Sequence[str] | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document row: the ``keep`` columns (the id by default), ``n_words``, ``n_hit``, ``hit_spans`` (byte offsets of
    the maximal runs of hit words in the UTF-8 text) and ``item_ids`` (sorted ids of items with an occurring window)."""
    spark = docs.sparkSession
    keep = K.others(keep if keep is not None else [id_col], "n_words", "n_hit", "hit_spans", "item_ids")
    items = benchmark.select(F.col(item_col).alias("i"), F.col(item_text_col).alias("t")).where("i is not null and t is not null and t != ''")
    item_kind = dict(items.dtypes)["i"]
    volume = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-volume // (6 * block_words)))
    carried = [c for c in keep if c != text_col]
    kinds = dict(docs.dtypes)
    out = [*(f"`{c}` {kinds[c]}" for c in carried), f"`{text_col}` string", "n_words bigint", "n_hit bigint", "hit_spans array<struct<start: bigint, end: bigint>>", f"item_ids array<{item_kind}>"]
    id_type = pa.list_(to_arrow_type(items.schema["i"].dataType))
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    frame = docs.select(*carried, text_col)
    with_text = text_col in keep or blocks > 1
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == block).collect() if blocks > 1 else items.collect()
        ids = sorted({r["i"] for r in rows})
        place = {x: k for k, x in enumerate(ids)}
        windows = _windows([(place[r["i"]], r["t"]) for r in rows], window)
        counts = _count(docs, text_col, windows) if windows else {}
        for w in windows:
            w.rank(counts)
        shared = spark.sparkContext.broadcast((windows, ids))
        first = block == 0

        def run(batches: Iterator[pa.RecordBatch], shared=shared, first=first) -> Iterator[pa.RecordBatch]:
            windows, ids = shared.value
            for batch in batches:
                texts = batch.column(len(carried))
                for s in K.slices(texts):
                    here = batch.slice(s.first, s.n)
                    starts, ends, doc, words, bound, buf = _tokens(s)
                    low, high = bound[doc], bound[doc + 1]
                    cover, found = np.zeros(len(words) + 1, np.int64), [set() for _ in range(s.n)]
                    for w in windows:
                        at, which = w.find(words, low, high, lambda x: K.span_hashes(buf, starts[x], ends[x], 1))
                        np.add.at(cover, at, 1)
                        np.add.at(cover, at + w.length, -1)
                        for d, x in set(zip(doc[at].tolist(), which.tolist(), strict=True)):
                            found[d].update(w.items[x])
                    hit = np.cumsum(cover[:-1]) > 0
                    spans, item_ids = [[] for _ in range(s.n)], [sorted(ids[x] for x in f) for f in found]
                    if not first:  # what earlier blocks found
                        for d, (old, more) in enumerate(zip(here.column(len(carried) + 3).to_pylist(), here.column(len(carried) + 4).to_pylist(), strict=True)):
                            item_ids[d] = sorted({*item_ids[d], *more})
                            for x in old:
                                a, b = np.searchsorted(starts, [x["start"] + s.offsets[d], x["end"] + s.offsets[d]])
                                hit[a:b] = True
                    on = np.flatnonzero(hit)
                    new = np.ones(len(on), bool)
                    new[1:] = (on[1:] != on[:-1] + 1) | (doc[on[1:]] != doc[on[:-1]])
                    head = np.flatnonzero(new)
                    for a, b in zip(on[head], on[np.r_[head[1:] - 1, len(on) - 1]] if len(on) else [], strict=True):
                        spans[doc[a]].append({"start": int(starts[a] - s.offsets[doc[a]]), "end": int(ends[b] - s.offsets[doc[a]])})
                    n_hit = np.bincount(doc[on], minlength=s.n) if len(on) else np.zeros(s.n, np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [*(here.column(i) for i in range(len(carried))), here.column(len(carried)) if with_text else pa.nulls(s.n, pa.string()), pa.array(np.diff(bound)), pa.array(n_hit), pa.array(spans, span_type), pa.array(item_ids, id_type)],
                        names=[*carried, text_col, "n_words", "n_hit", "hit_spans", "item_ids"],
                    )

        frame = frame.mapInArrow(run, ", ".join(out))
        if blocks > 1:
            frame = stage(frame, "hits")
    return frame.select(*keep, "n_words", "n_hit", "hit_spans", "item_ids")
