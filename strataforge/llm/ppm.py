"""Language-model scoring: prediction by partial matching over bytes, beside a word-count base line.

The trie of byte contexts up to ``ORDER`` bytes is counted over all training texts (A-Z lower-cased). A text's code length
adds up symbol by symbol, its end being a symbol too: in the longest context that the trie has, a seen symbol costs
count / (total + distinct), an unseen one an escape of distinct / (total + distinct) (escape method C) and a step to
the next shorter context, where the symbols of the longer one are excluded from total and distinct. Below order 0
the symbols never seen share what is left evenly. As a longer context's symbols all occur in the shorter one,
exclusion needs one number per context: how much its symbols weigh in the shorter context.

The base line needs every word's training count at every text that has it. Texts are taken in slices; a slice
keeps which text has which word, and only its distinct words travel: to the bucket of their hash, where they are
summed, and the counts back. A word in every text is still one row per slice.

The trie is parted in the same way and no context is left out: a slice's distinct codes (a symbol with the longest context)
travel to the bucket of their context, where the symbols seen in it get their final value, which goes back. Codes
that no training text has go on to the bucket of their last two context bytes, together with the distinct codes of all
training texts that end alike: all that the shorter contexts down to two bytes need. Contexts of one byte and none
are at most 65,536 codes whatever the input, and are sent to every task.

A whole trie in one process (``build``) can be given to ``score`` instead; only there, and only if the caller asks,
``max_nodes`` bounds it: the rarest contexts are left out, whole contexts at a time, shorter ones staying wherever longer ones do.

Edge cases: a null or empty text has its end only; without training rows every count is 0 and the model is uniform
over 256 symbols; repeated rows are scored (and learned) one by one; further columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataforge.llm import textkit as K
from strataforge.llm.staging import lanes, light_batches, parts, passing, small_batches, stage

ORDER = 5
#: Bytes that UTF-8 never has, for the place before a text and its end.
BEFORE, END = 0xFE, 0xFF
SYMBOLS = 255  # all bytes but BEFORE
SLICE_BYTES = 1 << 23  # what travels is distinct by slice: large ones send less
BUCKET_BYTES = 1 << 24  # of words and codes, so many in one bucket on average at most


def gram_codes(s: K.Slice, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Each symbol with the ``order`` bytes before it as one number, and where each text's symbols begin."""
    place = s.offsets + np.arange(s.n + 1) * (order + 1)
    buf = np.full(place[-1], BEFORE, np.uint8)
    if len(s.buf):
        doc = np.repeat(np.arange(s.n), np.diff(s.offsets))
        buf[np.arange(len(s.buf)) + doc * (order + 1) + order] = K.LOWER[s.buf]
    buf[place[1:] - 1] = END
    code = np.zeros(max(len(buf) - order, 0), np.uint64)
    for j in range(order + 1):
        code = (code << np.uint64(8)) | buf[j : len(buf) - order + j]
    starts = place[:-1]
    keep = np.ones(len(code), bool)
    for i in range(1, order + 1):  # those whose last byte is padding of the next text
        at = starts[1:] - order - 1 + i
        keep[at[(at >= 0) & (at < len(code))]] = False
    return code[keep], s.offsets + np.arange(s.n + 1)


def count_grams(docs: DataFrame, text_col: str = "text", order: int = ORDER) -> DataFrame:
    """(code, n) over all texts; each task sends its distinct codes once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        for batch in batches:
            for s in K.slices(batch.column(0)):
                found.append(_added([np.unique(gram_codes(x, order)[0], return_counts=True) for x in s.pieces()]))
                if len(found) == 8:
                    found = [_added(found)]
        codes, counts = _added(found)
        yield pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(counts)], names=["code", "n"])

    return docs.select(text_col).mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))


def _added(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes = np.concatenate([c for c, _ in found])
    order = np.argsort(codes, kind="stable")
    codes, n = codes[order], np.concatenate([n for _, n in found])[order].astype(np.int64, copy=False)
    del order
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.add.reduceat(n, first) if len(first) else n


class Order:
    """Contexts of one length: sorted codes of (context, symbol) with counts, and sums by context."""

    def __init__(self, code: np.ndarray, count: np.ndarray) -> None:
        order = np.argsort(code)
        self.code, self.count = code[order], count[order].astype(np.float64)
        self.context, at = np.unique(self.code >> np.uint64(8), return_inverse=True)
        self.at = at
        self.total = np.bincount(at, self.count, minlength=len(self.context))
        self.distinct = np.bincount(at, minlength=len(self.context)).astype(np.float64)
        self.shorter_total = np.zeros(len(self.context))  # weight of its symbols in the shorter context

    def find(self, keys: np.ndarray, value: np.ndarray) -> np.ndarray:
        at = np.searchsorted(keys, value)
        at[at == len(keys)] = 0
        return np.where(keys[at] == value, at, -1) if len(keys) else np.full(len(value), -1)


class Trie:
    def __init__(self, orders: list[tuple[np.ndarray, np.ndarray]], table: bool = True) -> None:
        """``orders[k]``: codes of k + 1 bytes and their counts. Without ``table`` only ``escape`` works."""
        self.orders = [Order(*o) for o in orders]
        for k in range(1, len(self.orders)):
            o, low = self.orders[k], self.orders[k - 1]
            at = low.find(low.code, o.code & np.uint64((1 << 8 * k) - 1))
            o.shorter_total = np.bincount(o.at, low.count[at], minlength=len(o.context))
        top = self.orders[-1]
        if table:
            self._fill(top)
        for o in self.orders:
            del o.at

    def _fill(self, top: Order) -> None:
        value = np.log10(top.count / (top.total + top.distinct)[top.at]) if len(top.code) else top.count
        self._table(top.code, value)

    def _table(self, code: np.ndarray, value: np.ndarray) -> None:
        """An open hash table of the longest order's codes, at most half full."""
        bits = max(10, int(2 * len(code)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, ~np.uint64(0)), np.zeros(1 << bits, np.float32)
        slot, left = self._slot(code), np.arange(len(code))
        while len(left):
            free = self.keys[slot[left]] == ~np.uint64(0)
            _, first = np.unique(slot[left][free], return_index=True)
            won = left[free][first]
            self.keys[slot[won]], self.values[slot[won]] = code[won], value[won]
            left = left[self.keys[slot[left]] != code[left]]
            slot[left] = (slot[left] + 1) & self.mask

    def _slot(self, code: np.ndarray) -> np.ndarray:
        return ((code * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def log10(self, code: np.ndarray) -> np.ndarray:
        """log10 probability of each symbol after its context."""
        out, slot = np.zeros(len(code)), self._slot(code)
        left, missed = np.arange(len(code)), []
        while len(left):
            key = self.keys[slot]
            hit = key == code[left]
            out[left[hit]] = self.values[slot[hit]]
            empty = key == ~np.uint64(0)
            missed.append(left[empty])
            on = ~hit & ~empty
            left, slot = left[on], (slot[on] + 1) & self.mask
        rest = np.concatenate(missed) if missed else np.zeros(0, np.int64)
        if len(rest):
            out[rest] = self.escape(code[rest])
        return out

    def escape(self, code: np.ndarray) -> np.ndarray:
        """The same, order by order: for codes that the longest order does not have."""
        out, open_ = np.zeros(len(code)), np.ones(len(code), bool)
        gone_total, gone = np.zeros(len(code)), np.zeros(len(code))  # what the longer contexts exclude here
        for k in range(len(self.orders) - 1, -1, -1):
            o, short = self.orders[k], code & np.uint64((1 << 8 * (k + 1)) - 1)
            at = o.find(o.context, short >> np.uint64(8))
            here = open_ & (at >= 0)
            if not here.any():
                continue
            total, distinct = o.total[at] - gone_total, o.distinct[at] - gone
            sym = o.find(o.code, short)
            whole = np.maximum(total + distinct, 1e-300)
            seen = here & (sym >= 0)
            out[seen] += np.log10(o.count[sym[seen]] / whole[seen])
            open_ &= ~seen
            on = here & open_ & (distinct > 0)
            out[on] += np.log10(distinct[on] / whole[on])
            gone_total = np.where(here, o.shorter_total[at], gone_total)
            gone = np.where(here, o.distinct[at], gone)
        out[open_] -= np.log10(np.maximum(SYMBOLS - gone[open_], 1))
        return out


def build(counts: DataFrame, order: int = ORDER, max_nodes: int | None = None) -> Trie:
    """The trie from ``count_grams`` in one process: whole, or with at most ``max_nodes`` nodes an order."""
    with small_batches(counts.sparkSession):
        counts = stage(counts, "grams")
    if max_nodes is None or counts.count() <= max_nodes:
        got = counts.toArrow()
        code, n = got.column("code").to_numpy().view(np.uint64), got.column("n").to_numpy()
        return Trie([_ends(code, n, k + 1) for k in range(order + 1)])
    found, least = [], 0
    for k in range(order + 1):
        nodes = counts.groupBy(F.col("code").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1)).alias("c")).agg(F.sum("n").alias("n"))
        context = F.shiftrightunsigned("c", 8).alias("x")
        totals = nodes.groupBy(context).agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("m"))
        level = F.floor(F.log2("t")).cast("int").alias("level")
        by_level = sorted(totals.groupBy(level).agg(F.sum("m").alias("m")).collect(), key=lambda r: -r["level"])
        held, cut = 0, 0
        for r in by_level:  # the frequent contexts first, as many whole levels as there is room for
            held += r["m"]
            if held > max_nodes:
                cut = r["level"] + 1
                break
        least = max(least, cut)
        kept = totals.where(level >= least).select("x")
        got = nodes.join(kept, F.shiftrightunsigned("c", 8) == F.col("x"), "left_semi").toArrow()
        found.append((got.column("c").to_numpy().view(np.uint64), got.column("n").to_numpy()))
    return Trie(found)


def _ends(code: np.ndarray, n: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct last ``width`` bytes of codes, and their counts."""
    u, at = np.unique(code & np.uint64((1 << 8 * width) - 1), return_inverse=True)
    return u, np.bincount(at, n, minlength=len(u)).astype(np.int64)


def _planes(code: np.ndarray, width: int = ORDER + 1) -> bytes:
    """Sorted codes byte by byte, the high bytes first to be alike: these pack well."""
    return np.ascontiguousarray(code.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _from_planes(blob: bytes, width: int = ORDER + 1) -> np.ndarray:
    out = np.zeros((len(blob) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(blob, np.uint8).reshape(width, -1).T
    return out.view("<u8").reshape(-1)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _by_context(code: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of codes by the bucket of their context, and where each bucket begins in it."""
    bucket = _bucket(K.mix(code >> np.uint64(8)), buckets)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _narrow(x: np.ndarray) -> np.ndarray:
    top = int(x.max()) if len(x) else 0
    return x.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4")


def _wide(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob, {1: "<u1", 2: "<u2", 4: "<u4"}[len(blob) // n] if n else "<u1").astype(np.int64)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together up to ``SLICE_BYTES``."""
    held, size = [], 0
    for batch in batches:
        if held and size + batch.nbytes > SLICE_BYTES:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


_SLICE = "part bigint, n int, doc_id binary, held_out binary, n_tokens binary, score binary, pairs bigint, words binary, train binary, sizes binary, docs binary, counts binary, text binary, lengths binary, codes binary, learned binary"
_BACK = "part bigint, kind int, bucket int, a binary, b binary"


def score(docs: DataFrame, held_out: Column, trie: Trie | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id (a whole number), ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    The model is that of the rows not held out, kept in parts, unless a ``trie`` in one process is given.
    """
    with light_batches(docs.sparkSession), passing() as kept:
        kept.append(stage(_scored(docs, held_out, trie, id_col, text_col), "scores"))
    return kept[0]


def _scored(docs: DataFrame, held_out: Column, trie: Trie | None, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    shared = trie and spark.sparkContext.broadcast(trie)
    narrow = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_col, held_out.alias("h"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _joined(batches):
            ids, held = batch.column(0), batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for s in K.slices(batch.column(1), SLICE_BYTES):
                rows = slice(s.first, s.first + s.n)
                value, (codes, seen), n_words, h, doc, times = _taken(s, held[rows], shared.value if shared else None)
                words, first = np.unique(h, return_index=True)
                sizes = np.diff(np.r_[first, len(h)])
                learned = np.where(held[rows][doc], 0, times)
                train = np.add.reduceat(learned, first) if len(first) else first
                id_part = ids.slice(s.first, s.n)
                pairs = len(doc)
                null = id_part.is_null().to_numpy(zero_copy_only=False)
                packed_ids = id_part.fill_null(0).to_numpy().astype("<i8").tobytes() + (np.packbits(null).tobytes() if null.any() else b"")
                binary = [packed_ids, held[rows].tobytes(), n_words.astype("<u4").tobytes(), value.astype("<f8").tobytes()]
                blobs = [words.astype("<u8").tobytes(), *(_narrow(x).tobytes() for x in (train, sizes, doc, times))]
                if shared:
                    blobs += [b""] * 4
                else:
                    blobs += [pa.compress(K.LOWER[s.buf].tobytes(), "zstd", asbytes=True) if len(s.buf) else b"", _narrow(np.diff(s.offsets)).tobytes(), _planes(codes), _narrow(seen).tobytes()]
                del codes, seen, h, doc, times, learned, sizes, words, first
                K.trim()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.array([s.n], pa.int32()), *(pa.array([x], pa.binary()) for x in binary), pa.array([pairs], pa.int64()), *(pa.array([x], pa.binary()) for x in blobs)],
                    names=[x.split()[0] for x in _SLICE.split(", ")],
                )

    with small_batches(spark):
        cuts = stage(narrow.mapInArrow(cut, _SLICE), "slices", wide=True)
    volume = cuts.agg(F.sum(F.octet_length("words") + 2 * F.octet_length("codes")).alias("v")).first()["v"] or 0
    buckets = max(parts(spark), -(-volume // BUCKET_BYTES))
    lane = lanes(spark, buckets)
    place = {int(x): i for i, x in enumerate(lane)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, blob, train in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                words = np.frombuffer(blob, "<u8")
                counts = _wide(train, len(words))
                bucket = _bucket(words, buckets)
                edge = np.searchsorted(bucket, np.arange(buckets + 1))
                some = np.flatnonzero(np.diff(edge))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lane[some]), pa.array(np.full(len(some), part)), pa.array([words[edge[b] : edge[b + 1]].tobytes() for b in some], pa.binary()), pa.array([_narrow(counts[edge[b] : edge[b + 1]]).tobytes() for b in some], pa.binary())],
                    names=["bucket", "part", "words", "train"],
                )

    def total(table: pa.Table) -> pa.Table:
        words = [np.frombuffer(x, "<u8") for x in table.column("words").to_pylist()]
        train = np.concatenate([_wide(x, len(w)) for x, w in zip(table.column("train").to_pylist(), words, strict=True)])
        distinct, at = np.unique(np.concatenate(words), return_inverse=True)
        count = np.bincount(at, train, minlength=len(distinct)).astype("<u8")
        back, edge = count[at], np.cumsum([0, *(len(w) for w in words)])
        known = np.zeros(len(words), np.int64)
        known[0] = (count > 0).sum()  # once per bucket
        K.trim()
        return pa.table({"bucket": table.column("bucket"), "part": table.column("part"), "c": pa.array([back[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary()), "known": known})

    dealt = cuts.select("part", "words", "train").mapInArrow(deal, "bucket int, part bigint, words binary, train binary")
    totals = stage(dealt.groupBy("bucket").applyInArrow(total, "bucket int, part bigint, c binary, known bigint"), "totals", wide=True)
    types = totals.agg(F.sum("known").alias("v")).first()["v"] or 0

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = rows = 0
        for batch in batches:
            for held, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                learned = ~np.frombuffer(held, bool)
                rows += int(learned.sum())
                tokens += int(np.frombuffer(n, "<u4")[learned].sum())
        yield pa.RecordBatch.from_arrays([pa.array([tokens], pa.int64()), pa.array([rows], pa.int64())], names=["tokens", "rows"])

    sums = cuts.select("held_out", "n_tokens").mapInArrow(seen, "tokens bigint, rows bigint").agg(F.sum("tokens").alias("t"), F.sum("rows").alias("r")).first()
    ends = sums["r"] or 0
    train_tokens, vocabulary = (sums["t"] or 0) + ends, types + (ends > 0)

    def finish(key, left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        n = row["n"]
        back = sorted(zip(*(right.column(x).to_pylist() for x in ("kind", "bucket", "a", "b")), strict=True), key=lambda r: (r[0], place[r[1]]))
        count = np.concatenate([np.zeros(0, "<u8"), *(np.frombuffer(a, "<u8") for kind, _, a, _ in back if kind == WORDS)]).astype(np.float64)
        sizes = _wide(row["sizes"], len(count))
        doc, times = _wide(row["docs"], row["pairs"]), _wide(row["counts"], row["pairs"])
        value, known = np.repeat(np.log10(count + 1), sizes), np.repeat(count > 0, sizes)
        n_tokens = np.frombuffer(row["n_tokens"], "<u4").astype(np.int64) + 1
        base = np.bincount(doc, times * value, minlength=n) + np.log10(ends + 1) - n_tokens * np.log10(train_tokens + vocabulary + 1)
        n_known = np.bincount(doc, times * known, minlength=n).astype(np.int64) + (ends > 0)
        ids = pa.array(np.frombuffer(row["doc_id"][: 8 * n], "<i8"))
        if len(row["doc_id"]) > 8 * n:
            ids = pa.array(ids.to_numpy(), mask=np.unpackbits(np.frombuffer(row["doc_id"][8 * n :], np.uint8))[:n].astype(bool))
        return pa.table([ids, pa.array(np.frombuffer(row["held_out"], bool)), pa.array(n_tokens), pa.array(n_known), pa.array(np.full(n, train_tokens)), pa.array(base), pa.array(np.frombuffer(row["score"], "<f8") if shared else _read(row, back, buckets))], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    left = cuts.select("part", "n", "doc_id", "held_out", "n_tokens", "score", "pairs", "sizes", "docs", "counts", "text", "lengths")
    back = totals.select("part", F.lit(WORDS).alias("kind"), "bucket", F.col("c").alias("a"), F.lit(None).cast("binary").alias("b"))
    if not shared:
        for values in _parted(cuts, lane):
            back = back.unionByName(values)
    done = left.groupBy("part").cogroup(back.groupBy("part")).applyInArrow(finish, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    return done.withColumnRenamed("doc_id", id_col)


#: What comes back to a slice: counts of words, values of codes by bucket, values of codes not seen in training.
WORDS, SEEN, UNSEEN = range(3)


def _taken(s: K.Slice, held: np.ndarray, trie: Trie | None = None) -> tuple:
    """Of a slice: the texts' scores by ``trie``; without one, the distinct codes and how often each stands in texts not held out; the
    number of words of each text; and distinct pairs of a word's hash and a text, in order, with their counts.

    Codes and pairs are counted piece by piece and added up after every few: a worker stands beside a JVM that takes most of the memory.
    """
    value, grams, n_words, pairs = np.zeros(s.n if trie else 0), [(np.zeros(0, np.uint64), np.zeros(0, np.int64))], [], []
    for piece in s.pieces():
        code, edge = gram_codes(piece)
        if trie:
            value[piece.first : piece.first + piece.n] = np.add.reduceat(trie.log10(code), edge[:-1])
        else:
            grams.append(_counted(code, np.repeat(~held[piece.first : piece.first + piece.n], np.diff(edge))))
            if len(grams) == 8:
                grams = [_added(grams)]
        buf = K.LOWER[piece.buf]
        starts, ends, owner = K.spans(piece, K.SPACED, buf)
        h = K.span_hashes(buf, starts, ends)
        n_words.append(np.bincount(owner, minlength=piece.n))
        order = np.argsort(h, kind="stable")  # texts stay in order within a word
        h, owner = h[order], owner[order]
        at = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]) if len(h) else np.zeros(0, np.int64)
        pairs.append((h[at], (owner[at] + piece.first).astype(np.int32), np.diff(np.r_[at, len(h)]).astype(np.int32)))
    grams = _added(grams)  # before the pairs are put together: their arrays are the largest
    h, doc, times = (np.concatenate([p[i] for p in pairs]) for i in range(3))
    del pairs
    order = np.argsort(h, kind="stable")
    h, doc, times = h[order], doc[order], times[order]
    return value, grams, np.concatenate(n_words), h, doc, times


def _counted(code: np.ndarray, learned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, and how often each stands where ``learned`` holds."""
    codes, at = np.unique(code, return_inverse=True)
    return codes, np.bincount(at, learned, minlength=len(codes)).astype(np.int64)


def _parted(cuts: DataFrame, lane: np.ndarray) -> list[DataFrame]:
    """The values of all codes of all slices as rows of ``_BACK``; ``lane``: a number for each bucket."""
    spark, buckets = cuts.sparkSession, len(lane)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, blob, learned in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                code = _from_planes(blob)
                n = _wide(learned, len(code))
                order, edge = _by_context(code, buckets)
                code, n = code[order], n[order]
                some = np.flatnonzero(np.diff(edge))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lane[some]), pa.array(np.full(len(some), part)), pa.array([_planes(code[edge[b] : edge[b + 1]]) for b in some], pa.binary()), pa.array([_narrow(n[edge[b] : edge[b + 1]]).tobytes() for b in some], pa.binary())],
                    names=["bucket", "part", "codes", "n"],
                )

    def total(table: pa.Table) -> pa.Table:
        """Per slice the values, NaN for codes not seen, and these codes; and in a row of no slice the distinct seen codes with counts."""
        codes = [_from_planes(x) for x in table.column("codes").to_pylist()]
        n = np.concatenate([_wide(x, len(c)) for x, c in zip(table.column("n").to_pylist(), codes, strict=True)])
        edge = np.cumsum([0, *(len(c) for c in codes)])
        distinct, at = np.unique(np.concatenate(codes), return_inverse=True)
        count = np.bincount(at, n, minlength=len(distinct))
        seen = count > 0
        o = Order(distinct[seen], count[seen])
        value = np.full(len(distinct), np.nan, "<f4")
        value[seen] = np.log10(o.count / (o.total + o.distinct)[o.at])
        back = value[at]
        a, b = [], []
        for i, c in enumerate(codes):
            v = back[edge[i] : edge[i + 1]]
            a.append(v.tobytes())
            b.append(c[np.isnan(v)].tobytes())
        parts_ = pa.array([*table.column("part").to_pylist(), None], pa.int64())
        bucket = pa.array([table.column("bucket")[0].as_py()] * len(parts_), pa.int32())
        K.trim()
        return pa.table([parts_, pa.array([SEEN] * len(parts_), pa.int32()), bucket, pa.array([*a, o.code.tobytes()], pa.binary()), pa.array([*b, o.count.astype("<i8").tobytes()], pa.binary())], names=["part", "kind", "bucket", "a", "b"])

    dealt = cuts.select("part", "codes", "learned").mapInArrow(deal, "bucket int, part bigint, codes binary, n binary")
    sums = stage(dealt.groupBy("bucket").applyInArrow(total, _BACK), "values", wide=True)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        for batch in batches:
            for code, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = [_added([*found, _ends(np.frombuffer(code, "<u8"), np.frombuffer(n, "<i8"), 2)])]
        code, n = found[0]
        yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int64)), pa.array(n)], names=["code", "n"])

    low = sums.where("part is null").select("a", "b").mapInArrow(ends, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    short = spark.sparkContext.broadcast((low.column("code").to_numpy().astype(np.uint64), low.column("n").to_numpy().astype(np.int64)))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Codes by their last two context bytes: seen ones with counts, others with the slice."""
        for batch in batches:
            for part, a, b in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                code = np.frombuffer(a if part is None else b, "<u8")
                if not len(code):
                    continue
                bucket = _bucket(K.mix((code >> np.uint64(8)) & np.uint64(0xFFFF)), buckets)
                n = np.frombuffer(b, "<i8") if part is None else np.zeros(len(code), np.int64)
                for i in range(0, len(code), 1 << 16):
                    at = slice(i, i + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(lane[bucket[at]]), pa.array(np.full(len(code[at]), part or 0)), pa.array(code[at].view(np.int64)), pa.array(n[at])], names=["bucket", "part", "code", "n"])

    def escape(table: pa.Table) -> pa.Table:
        code, n, part = table.column("code").to_numpy().view(np.uint64), table.column("n").to_numpy(), table.column("part").to_numpy()
        asked = n == 0
        out = [[], [], []]
        if asked.any():
            seen, n = code[~asked], n[~asked]
            trie = Trie([_ends(*short.value, 1), short.value, *(_ends(seen, n, k + 1) for k in range(2, ORDER + 1))], table=False)
            code, part = code[asked], part[asked]
            distinct, at = np.unique(code, return_inverse=True)
            value = trie.escape(distinct)[at]
            order = np.argsort(part, kind="stable")
            code, value, part = code[order], value[order], part[order]
            first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            edge = [*first.tolist(), len(part)]
            out = [part[first], [code[i:j].tobytes() for i, j in zip(edge[:-1], edge[1:])], [value[i:j].astype("<f4").tobytes() for i, j in zip(edge[:-1], edge[1:])]]
        rows = len(out[0])
        K.trim()
        return pa.table([pa.array(out[0], pa.int64()), pa.array([UNSEEN] * rows, pa.int32()), pa.array(np.full(rows, lane[0])), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], names=["part", "kind", "bucket", "a", "b"])

    unseen = sums.select("part", F.when(F.col("part").isNull(), F.col("a")).alias("a"), "b").mapInArrow(again, "bucket int, part bigint, code bigint, n bigint").groupBy("bucket").applyInArrow(escape, _BACK)
    seen = sums.where("part is not null").withColumn("b", F.lit(None).cast("binary"))
    return [seen, unseen]


def _read(row: dict, back: list[tuple], buckets: int) -> np.ndarray:
    """The score of each text of a slice, from the values that came back."""
    edges = np.cumsum([0, *_wide(row["lengths"], row["n"])])
    raw = pa.decompress(row["text"], int(edges[-1]), "zstd", asbytes=True) if row["text"] else b""  # packed on its way: what is shuffled stays small
    s = K.Slice(0, np.frombuffer(raw, np.uint8), edges)
    found = []
    for piece in s.pieces():
        code, edge = gram_codes(piece)
        found.append((piece, edge, *np.unique(code, return_inverse=True)))
    codes = np.unique(np.concatenate([u for _, _, u, _ in found]))
    value = np.zeros(len(codes))
    value[_by_context(codes, buckets)[0]] = np.concatenate([np.frombuffer(a, "<f4") for kind, _, a, _ in back if kind == SEEN])
    for kind, _, a, b in back:
        if kind == UNSEEN:
            value[np.searchsorted(codes, np.frombuffer(a, "<u8"))] = np.frombuffer(b, "<f4")
    out = np.zeros(s.n)
    for piece, edge, u, at in found:
        out[piece.first : piece.first + piece.n] = np.add.reduceat(value[np.searchsorted(codes, u)][at], edge[:-1])
    return out
