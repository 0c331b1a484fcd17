"""Suffix-array dedup: which bytes of a text lie in a string of ``length`` bytes that a text with a smaller id has too.

Every window of ``length`` bytes is filed under its anchor, the substring of ``ANCHOR`` bytes in it whose hash is least: equal
windows have equal anchors at equal places, and most windows in a row share one.

1. Texts equal as a whole are settled by their digest; the later ones go.
2. The anchors of all other texts meet in buckets by their hash; those of one text only are done with. An anchor that
   occurs in several texts of one slice of the input meets the other slices as one entry.
3. Texts that have a shared anchor are read again. Each such anchor brings what its windows cover, up to ``length`` bytes
   from the anchor on and what is left of it; equal ones of a slice are one entry with the smallest id. Anchors that ``HOT`` slices
   or more have bring each of their windows as an entry of its own, under a key of all its bytes: what surrounds a hot passage
   differs from text to text, and this spreads it over all buckets, while the passage itself is one entry a slice.
4. In a bucket two suffix arrays are built by linear grouping: of the strings from the anchors on, and of the strings before
   the anchors, read backwards. Letters are runs of ``LETTER`` bytes as numbers; what all entries of an anchor share is left
   out. Neighbours' common prefixes, counted in bytes, give the windows that reach k bytes beyond their anchor and agree
   there, and those that reach o bytes before it and agree there; entries that do both have that window in common, and the
   smallest id keeps it. No hash takes part in this.
5. Each slice learns, for its entries, the smallest id and which windows a smaller id has, and cuts its texts.

What grows with a hot passage is one entry per slice and anchor, not per text.

Edge cases: a null or empty text has no bytes and loses none; a text shorter than ``length`` never loses any; equal texts with
the same id keep all; rows with a null id are left as they are and delete nothing; an empty table gives an empty
table; further columns are not read. Long texts are gone through in chunks; a text is held whole by one task, with
``length`` + 30 bytes for every shared anchor, one in about 15 bytes of what is shared.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataforge.llm import textkit as K
from strataforge.llm.bloom import filter_of, holds, may_match
from strataforge.llm.gsaca import suffix_array
from strataforge.llm.staging import drop, lanes, parts, passing, small_batches, stage

ANCHOR = 20
#: Bytes in a letter of the suffix arrays, the most that keeps a letter a whole number of 63 bits.
LETTER = 7
SLICE_BYTES = 1 << 21
#: Of a longer text so many bytes are gone through at once.
CHUNK = 1 << 22
SORTED_AT_ONCE = 5_000
#: Text in one bucket on average at most; what is shared of it is about five times as much there.
BUCKET_BYTES = 1 << 23
#: An anchor in so many slices has its windows dealt one by one.
HOT = 4096
_PLACE_BITS = np.uint64(24)


def _ident(sha: str) -> int:
    return int(sha[:15], 16)


def _window_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` values in a row."""
    out, have = v, 1
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(v) - width + 1], out[width - have : width - have + len(v) - width + 1])


class Anchors:
    """The anchors of a slice: place, hash, text, and the first and last window that each stands for."""

    def __init__(self, s: K.Slice, length: int) -> None:
        found = [self._chunk(s, a, min(a + CHUNK, len(s.buf) - length + 1), length) for a in range(0, len(s.buf) - length + 1, CHUNK)]
        none = np.zeros(0, np.int64)
        self.at, self.first, self.last, self.hash, self.doc = (np.concatenate([f[i] for f in found]) if found else none.astype(kind) for i, kind in enumerate((np.int64, np.int64, np.int64, np.uint64, np.int64)))

    @staticmethod
    def _chunk(s: K.Slice, a: int, b: int, length: int) -> tuple[np.ndarray, ...]:
        """Of the windows that start at ``a`` and before ``b``; a run of windows ends with the chunk."""
        buf = s.buf[a : b + length - 1]
        eight = K.loads(buf)
        n = len(buf) - ANCHOR + 1
        h = K.mix(eight[:n] * K._GRAM[0] + eight[8 : n + 8] * K._GRAM[1] + (eight[16 : n + 16] & np.uint64(0xFFFFFFFF)) * K._GRAM[2])
        low = _window_min((h >> _PLACE_BITS << _PLACE_BITS) | np.arange(n, dtype=np.uint64), length - ANCHOR + 1)
        cut = s.offsets[1:-1]
        cut = cut[(cut > a) & (cut < b + length - 1)] - a
        over = np.zeros(len(low) + 1, np.int64)  # windows that run into the next text
        np.add.at(over, np.clip(cut - length + 1, 0, len(low)), 1)
        np.add.at(over, np.clip(cut, 0, len(low)), -1)
        ok = np.flatnonzero(np.cumsum(over[:-1]) == 0)
        if not len(ok):
            return (ok, ok, ok, h[:0], ok)
        at = (low[ok] & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))).astype(np.int64)
        new = np.r_[True, (at[1:] != at[:-1]) | (ok[1:] != ok[:-1] + 1)]
        head = np.flatnonzero(new)
        at, first, last = at[head], ok[head], ok[np.r_[head[1:] - 1, len(ok) - 1]]
        return at + a, first + a, last + a, h[at], np.searchsorted(s.offsets, at + a, side="right") - 1

    def keys(self, buckets: int) -> np.ndarray:
        return _keys(self.hash, buckets)


def _keys(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 32 more bits of hashes, as one number. Anchors have the least hashes there are, so these are mixed again first:
    by their own high bits a sixth of all anchors would meet in one bucket of a hundred."""
    h = K.mix(h)
    bucket = (h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    return ((bucket << np.uint64(32)) | (h >> np.uint64(4) & np.uint64(0xFFFFFFFF))).view(np.int64)


def windows_of(anchor_hash: np.ndarray, body: np.ndarray, low: np.ndarray, high: np.ndarray, owner: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For entries (rows of ``body``: ``length - ANCHOR`` bytes before the anchor, ``length`` from it on; windows start ``low`` to
    ``high`` bytes before the anchor): the smallest owner of an equal entry, and the windows, as bits, that a smaller owner than that has."""
    code = np.concatenate([body, low[:, None], high[:, None]], 1)
    row = _row_hash(code)
    order = np.lexsort((owner, row))
    new = _new_rows(row, code, order)
    one, back = order[new], np.empty(len(order), np.int64)
    back[order] = np.cumsum(new) - 1
    least, mask = owner[one], np.zeros(len(one), np.uint64)
    # Anchors with one entry are settled; the others' strings are put in order, some anchors at a time.
    _, at, size = np.unique(anchor_hash[one], return_inverse=True, return_counts=True)
    open_ = np.flatnonzero(size[at] > 1)
    open_ = open_[np.argsort(at[open_], kind="stable")]
    edge = np.flatnonzero(np.r_[True, np.diff(at[open_]) != 0, True]) if len(open_) else np.zeros(1, np.int64)
    begin = 0
    for end, after in zip(edge[1:], np.r_[edge[2:], np.iinfo(np.int64).max], strict=False):
        if after - begin > SORTED_AT_ONCE:
            part = open_[begin:end]
            mask[part] = _smaller(body[one[part]], at[part], low[one[part]], high[one[part]], least[part], length)
            begin = end
    return least[back], mask[back]


def _bodies(buf: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, length: int) -> np.ndarray:
    """A row of ``length - ANCHOR`` bytes before each anchor and ``length`` from it on, zeros where none of its windows reaches."""
    lead = length - ANCHOR
    at, low, high = (x.astype(np.int64) for x in (at, low, high))
    offset = np.arange(-lead, length, dtype=np.int32)
    body = np.zeros((len(at), lead + length), np.uint8)
    for a in range(0, len(at), 16384):
        rows = slice(a, a + 16384)
        body[rows] = buf[np.clip(at[rows, None] + offset, 0, len(buf) - 1)]
        body[rows][(offset < -high[rows, None]) | (offset >= length - low[rows, None])] = 0
    return body


def _row_hash(code: np.ndarray) -> np.ndarray:
    weight = K.mix(np.arange(1, code.shape[1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    row = np.zeros(len(code), np.uint64)
    for j in range(code.shape[1]):
        row += K._BYTE_CODE[code[:, j]] * weight[j]
    return K.mix(row)


def _new_rows(row: np.ndarray, code: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Where, in ``order``, a row other than the one before it begins. Hashes only bring equal rows together; bytes decide."""
    if not len(order):
        return np.zeros(0, bool)
    new = np.r_[True, row[order][1:] != row[order][:-1]]
    same = np.flatnonzero(~new)
    new[same] = (code[order[same]] != code[order[same - 1]]).any(1)
    return new


def _ranked(rows: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of strings of equal length within their anchors, and the bytes that each shares with the next in that order (-1 at
    the end of an anchor). ``anchor``: numbers in order, one anchor's rows in a row.

    The suffix array is that of all strings one after the other, each led by its anchor's number, without the bytes at the front on
    which all of an anchor agree and the zeros at their ends; of two strings the first letter in which they differ is enough.
    """
    n, width = rows.shape
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    size = np.diff(np.r_[first, n])
    head = np.repeat(first, size)
    differ = rows != rows[head]
    shared = np.where(differ.any(1), differ.argmax(1), width)
    front = np.minimum.reduceat(shared, first)  # what all of an anchor agree on
    used = rows[:, ::-1] != 0
    back = np.maximum.reduceat(np.where(used.any(1), width - used.argmax(1), 0), first)
    rest = np.clip(back - front, 0, np.where(size == 2, 1, width))
    letters = -(-rest // LETTER)
    front, letters = np.repeat(front, size), np.repeat(letters, size)
    place = np.r_[0, np.cumsum(letters + 1)]
    text = np.empty(place[-1], np.int64)
    text[place[:-1]] = np.repeat(np.arange(len(first)), size)
    wide = np.zeros((n, width + LETTER), np.uint8)
    wide[:, :width] = rows
    for j in range(int(letters.max(initial=0))):
        some = np.flatnonzero(letters > j)
        value = np.zeros(len(some), np.int64)
        for i in range(LETTER):
            value = (value << 8) | wide[some, np.minimum(front[some] + j * LETTER + i, width)]
        text[place[some] + 1 + j] = value + len(first)  # all letters are greater than an anchor's number
    starts = np.zeros(len(text), bool)
    starts[place[:-1]] = True
    found = suffix_array(text)
    ranked = np.searchsorted(place, found[starts[found]])
    left, right = rows[ranked[:-1]], rows[ranked[1:]]
    differ = left != right
    common = np.where(differ.any(1), differ.argmax(1), width)
    return ranked, np.where(anchor[ranked[1:]] == anchor[ranked[:-1]], common, -1)


def _smaller(body: np.ndarray, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, owner: np.ndarray, length: int) -> np.ndarray:
    """The windows, as bits, of each distinct entry that an entry with a smaller owner has too."""
    lead = length - ANCHOR
    sides = [_ranked(np.ascontiguousarray(x), anchor) for x in (body[:, lead:], body[:, lead - 1 :: -1] if lead else body[:, :0])]
    bits = np.zeros(len(body), np.uint64)
    run = [np.zeros(len(body), np.int64) for _ in sides]
    for o in range(lead + 1):
        here = np.flatnonzero((low <= o) & (o <= high))
        if len(here) < 2:
            continue
        for k, (side, reach) in enumerate(zip(sides, (length - o, o), strict=True)):
            ranked, common = side
            run[k][ranked] = np.r_[0, np.cumsum(common < reach)]
        group = run[0][here] * len(body) + run[1][here]
        sort = np.lexsort((owner[here], group))
        g, w = group[sort], owner[here][sort]
        first = np.r_[True, g[1:] != g[:-1]]
        smallest = w[first][np.cumsum(first) - 1]
        bits[here[sort[smallest < w]]] |= np.uint64(1) << np.uint64(o)
    return bits


_POSTED = "bucket int, ident bigint, keys binary, who binary, idents binary"
_CUT = "part bigint, n int, ids binary, idents binary, sizes binary, text binary, doc binary, at binary, low binary, high binary, entry binary, keys binary, lead binary, one binary, owners binary"


def find_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id (a whole number), ``n_bytes``, ``n_removed``, ``removed`` (byte spans, maximal runs), ``kept_sha256`` and ``sha256`` (of the whole text)."""
    with small_batches(docs.sparkSession), passing() as kept:
        out = _find_repeats(docs, length, id_col, text_col)
        kept.append(out)
        return out


def _find_repeats(docs: DataFrame, length: int, id_col: str, text_col: str) -> DataFrame:
    if not ANCHOR < length <= ANCHOR + 60:
        raise ValueError(f"length must be over {ANCHOR} and at most {ANCHOR + 60}")
    spark = docs.sparkSession
    lead = length - ANCHOR
    narrow = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    sha = F.sha2("t", 256)
    rows = stage(narrow.select("id", F.octet_length("t").cast("bigint").alias("n"), sha.alias("sha"), F.conv(F.substring(sha, 1, 15), 16, 10).cast("bigint").alias("ident")), "digests")
    # Equal texts, by the whole digest; ``ident`` is a short name of them.
    firsts = stage(rows.where(f"n >= {length} and id is not null").groupBy("sha").agg(F.min("id").alias("first"), F.first("ident").alias("ident")), "firsts")
    volume = rows.agg(F.sum("n").alias("n")).first()["n"] or 0
    buckets = max(2 * parts(spark), -(-volume // BUCKET_BYTES))
    lane = lanes(spark, buckets)
    place = {int(x): i for i, x in enumerate(lane)}

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in K.slices(batch.column(0), SLICE_BYTES):
                ident = np.array([_ident(hashlib.sha256(s.text(i)).hexdigest()) for i in range(s.n)], np.int64)
                distinct, number = np.unique(ident, return_inverse=True)
                key, who = [], []
                for piece in s.pieces():
                    found = Anchors(piece, length)
                    key.append(found.keys(buckets))
                    who.append(number[piece.first + found.doc])
                key, who = np.concatenate(key), np.concatenate(who)
                order = np.lexsort((who, key))
                key, who = key[order], who[order]
                new = np.r_[True, (key[1:] != key[:-1]) | (who[1:] != who[:-1])] if len(key) else np.zeros(0, bool)
                key, who = key[new], who[new]
                first = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
                size = np.diff(np.r_[np.flatnonzero(first), len(key)])
                several = np.repeat(size > 1, size)
                if several.any():  # shared within the slice: known to be so, whatever the others have
                    order = np.argsort(who[several], kind="stable")
                    k, w = key[several][order], who[several][order]
                    edge = np.flatnonzero(np.r_[True, w[1:] != w[:-1], True])
                    of = distinct[w[edge[:-1]]]
                    none = pa.nulls(len(of), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(lane[of % buckets]), pa.array(of), pa.array([k[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary()), none, none], names=["bucket", "ident", "keys", "who", "idents"])
                key, who = key[~several | first], np.where(several, len(distinct), who)[~several | first]
                edge = np.searchsorted(key >> 32, np.arange(buckets + 1))
                some = np.flatnonzero(np.diff(edge))
                sent = []
                for b in some:
                    w = who[edge[b] : edge[b + 1]]
                    used, at = np.unique(w, return_inverse=True)
                    table = np.r_[distinct, -1][used]
                    sent.append(((key[edge[b] : edge[b + 1]] & 0xFFFFFFFF).astype("<u4").tobytes(), at.astype("<u2" if len(used) < 1 << 16 else "<u4").tobytes(), table.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(lane[some]), pa.nulls(len(some), pa.int64()), *(pa.array([x[i] for x in sent], pa.binary()) for i in range(3))], names=["bucket", "ident", "keys", "who", "idents"])

    def meet(table: pa.Table) -> pa.Table:
        bucket, none = place[table.column("bucket")[0].as_py()], np.zeros(0, np.int64)
        found = table.to_pylist()
        idents, keys = [r["ident"] for r in found if r["ident"] is not None], [r["keys"] for r in found if r["ident"] is not None]
        plain = [r for r in found if r["ident"] is None]
        hot = none
        if plain:
            rest = np.concatenate([np.frombuffer(r["keys"], "<u4") for r in plain]).astype(np.int64)
            who = np.concatenate([np.frombuffer(r["idents"], np.int64)[np.frombuffer(r["who"], "<u2" if 2 * len(r["keys"]) == 4 * len(r["who"]) else "<u4")] for r in plain])
            order = np.lexsort((who, rest))
            rest, who = rest[order], who[order]
            first = np.r_[True, rest[1:] != rest[:-1]]
            at = np.flatnonzero(first)
            end = np.r_[at[1:], len(rest)] - 1
            shared = np.repeat((who[at] == -1) | (who[at] != who[end]), end - at + 1) & (who != -1)
            hot = rest[at[end - at + 1 >= HOT]]
            rest, who = rest[shared], who[shared]
            order = np.argsort(who, kind="stable")
            rest, who = rest[order] | (bucket << 32), who[order]
            edge = np.flatnonzero(np.r_[True, who[1:] != who[:-1], True]) if len(who) else np.zeros(1, np.int64)
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                idents.append(int(who[a]))
                keys.append(rest[a:b].tobytes())
        if len(hot):
            idents.append(-1 - bucket)
            keys.append((hot | (bucket << 32)).tobytes())
        K.trim()
        return pa.table({"ident": pa.array(idents, pa.int64()), "keys": pa.array(keys, pa.binary())})

    met = narrow.where(f"id is not null and octet_length(t) >= {length}").select("t").mapInArrow(post, _POSTED).groupBy("bucket").applyInArrow(meet, "ident bigint, keys binary")
    found = stage(met.groupBy("ident").agg(F.collect_list("keys").alias("keys")).join(firsts.select("ident", "first"), "ident", "left").select(F.col("first").alias("id"), "ident", "keys"), "wanted")
    wanted = found.where("id is not null")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(some), np.int64))], names=["key"])

    # A filter of fixed size: keys that it takes for hot ones are treated as hot everywhere.
    hot_keys = spark.sparkContext.broadcast(filter_of(found.where("ident < 0").select("keys").mapInArrow(listed, "key bigint")))
    again = may_match(narrow.where(f"id is not null and octet_length(t) >= {length}"), wanted.select("id")).join(wanted, "id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in K.slices(batch.column(1), SLICE_BYTES):
                ids, want = (batch.column(i).slice(s.first, s.n).to_numpy() for i in (0, 2))
                shared = batch.column(3).slice(s.first, s.n).to_pylist()
                mine = np.array([_ident(hashlib.sha256(s.text(i)).hexdigest()) for i in range(s.n)], np.int64) == want
                got = []
                for piece in s.pieces():
                    x, a = Anchors(piece, length), piece.first
                    key, base = x.keys(buckets), s.offsets[a]
                    keep, edge = np.zeros(len(key), bool), K.bounds(x.doc, piece.n)
                    for i in range(piece.n):
                        if mine[a + i] and edge[i] < edge[i + 1]:
                            keep[edge[i] : edge[i + 1]] = np.isin(key[edge[i] : edge[i + 1]], np.frombuffer(b"".join(shared[a + i]), np.int64))
                    got.append((key[keep], a + x.doc[keep], base + x.at[keep], (x.at - x.last)[keep], (x.at - x.first)[keep], x.hash[keep]))
                key, doc, at, low, high, h = (np.concatenate([g[i] for g in got]) for i in range(6))
                hot = holds(hot_keys.value, key)
                if hot.any():
                    times = np.where(hot, high - low + 1, 1)
                    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    hot = np.repeat(hot, times)
                    key, doc, at, low, high, h = (np.repeat(x, times) for x in (key, doc, at, low, high, h))
                    low = low + np.where(hot, nth, 0)
                    high = np.where(hot, low, high)
                body = _bodies(s.buf, at, low, high, length)
                low8, high8, owner = low.astype(np.uint8), high.astype(np.uint8), ids[doc] if len(doc) else doc
                code = np.concatenate([body, low8[:, None], high8[:, None]], 1)
                row = _row_hash(code)
                if hot.any():
                    h, key = np.where(hot, row, h), np.where(hot, _keys(row, buckets), key)
                order = np.lexsort((owner, row, key >> 32))
                new = _new_rows(row, code, order)
                new[1:] |= key[order][1:] >> 32 != key[order][:-1] >> 32
                del code
                one, entry = order[new], np.empty(len(order), np.int64)
                entry[order] = np.cumsum(new) - 1
                texts = np.flatnonzero(mine)
                blobs = [ids[texts].tobytes(), want[texts].tobytes(), np.diff(s.offsets)[texts].tobytes(), b"".join(s.text(i) for i in texts)]
                seat = np.cumsum(mine) - 1
                begin = np.r_[0, np.cumsum(np.diff(s.offsets)[texts])]
                blobs += [x.astype("<u4").tobytes() for x in (seat[doc], at - s.offsets[doc] + begin[seat[doc]])]
                blobs += [low8.tobytes(), high8.tobytes(), entry.astype("<u4").tobytes()]
                blobs += [key[one].tobytes(), h[one].tobytes(), one.astype("<u4").tobytes(), owner[one].astype(np.int64).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.array([len(texts)], pa.int32()), *(pa.array([x], pa.binary()) for x in blobs)], names=[x.split()[0] for x in _CUT.split(", ")])

    cuts = stage(again.select("id", "t", "ident", "keys").mapInArrow(cut, _CUT), "cuts")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = {"lead": 8, "body": lead + length, "lows": 1, "highs": 1, "owners": 8}
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                one = np.frombuffer(r["one"], "<u4")
                at, low, high = (np.frombuffer(r[c], kind)[one] for c, kind in (("at", "<u4"), ("low", np.uint8), ("high", np.uint8)))
                # The strings are cut from the text here, not kept beside it: they are many times as long.
                r |= {"body": _bodies(np.frombuffer(r["text"], np.uint8), at, low, high, length).tobytes(), "lows": low.tobytes(), "highs": high.tobytes()}
                edge = np.searchsorted(np.frombuffer(r["keys"], np.int64) >> 32, np.arange(buckets + 1))
                some = np.flatnonzero(np.diff(edge))
                columns = [pa.array([r[c][edge[b] * w : edge[b + 1] * w] for b in some], pa.binary()) for c, w in width.items()]
                yield pa.RecordBatch.from_arrays([pa.array(lane[some]), pa.array(np.full(len(some), r["part"], np.int64)), *columns], names=["bucket", "part", *width])
            K.trim()

    def settle(table: pa.Table) -> pa.Table:
        join = lambda c, kind: np.concatenate([np.frombuffer(x, kind) for x in table.column(c).to_pylist()])
        size = [len(x) for x in table.column("lows").to_pylist()]
        least, mask = windows_of(join("lead", np.uint64), join("body", np.uint8).reshape(-1, lead + length), join("lows", np.uint8), join("highs", np.uint8), join("owners", np.int64), length)
        edge = np.cumsum([0, *size])
        pieces = [pa.array([x[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary()) for x in (least, mask)]
        K.trim()
        return pa.table({"bucket": table.column("bucket"), "part": table.column("part"), "least": pieces[0], "mask": pieces[1]})

    settled = stage(cuts.select("part", "text", "at", "low", "high", "keys", "lead", "one", "owners").mapInArrow(deal, "bucket int, part bigint, lead binary, body binary, lows binary, highs binary, owners binary").groupBy("bucket").applyInArrow(settle, "bucket int, part bigint, least binary, mask binary"), "settled")
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        r = left.to_pylist()[0]
        ids, idents, sizes = (np.frombuffer(r[c], np.int64) for c in ("ids", "idents", "sizes"))
        doc, at, entry = (np.frombuffer(r[c], "<u4").astype(np.int64) for c in ("doc", "at", "entry"))
        low, high = np.frombuffer(r["low"], np.uint8), np.frombuffer(r["high"], np.uint8)
        back = sorted(right.select(["bucket", "least", "mask"]).to_pylist(), key=lambda x: place[x["bucket"]])
        least = np.concatenate([np.frombuffer(x["least"], np.int64) for x in back]) if back else np.zeros(0, np.int64)
        mask = np.concatenate([np.frombuffer(x["mask"], np.uint64) for x in back]) if back else np.zeros(0, np.uint64)
        begin = np.r_[0, np.cumsum(sizes)]
        cover = np.zeros(begin[-1] + 1, np.int64)
        if len(entry):
            bits = np.where(ids[doc] > least[entry], ~np.uint64(0), mask[entry])
            for o in range(lead + 1):
                gone = (low <= o) & (o <= high) & ((bits >> np.uint64(o) & np.uint64(1)) == 1)
                np.add.at(cover, at[gone] - o, 1)
                np.add.at(cover, at[gone] - o + length, -1)
        hit = np.cumsum(cover[:-1]) > 0
        text, out = np.frombuffer(r["text"], np.uint8), []
        for i in range(len(ids)):
            mine = hit[begin[i] : begin[i + 1]]
            edge = np.flatnonzero(np.diff(np.r_[False, mine, False].astype(np.int8)))
            kept = text[begin[i] : begin[i + 1]][~mine].tobytes()
            out.append((int(mine.sum()), [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)], hashlib.sha256(kept).hexdigest()))
        K.trim()
        return pa.table({"id": ids, "ident": idents, "n_removed": pa.array([x[0] for x in out], pa.int64()), "removed": pa.array([x[1] for x in out], span), "kept": pa.array([x[2] for x in out], pa.string())})

    left = cuts.select("part", "ids", "idents", "sizes", "text", "doc", "at", "low", "high", "entry").groupBy("part")
    spans = "array<struct<start: bigint, end: bigint>>"
    done = stage(left.cogroup(settled.groupBy("part")).applyInArrow(finish, f"id bigint, ident bigint, n_removed bigint, removed {spans}, kept string").where("n_removed > 0").dropDuplicates(["id", "ident"]), "repeats")
    for used in (cuts, settled, found):
        drop(used)
    # Whole copies, by a join of digests only; hot digests are split, as both sides are staged tables.
    told = stage(rows.join(firsts.select("sha", "first"), "sha", "left").select("id", "n", "sha", "ident", (F.col("first") < F.col("id")).alias("copy")), "told")
    joined = told.join(done, ["id", "ident"], "left")
    copy = F.coalesce("copy", F.lit(False)) & (F.col("n") >= length)
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("n").alias("end")))
    empty = hashlib.sha256(b"").hexdigest()
    return joined.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_bytes"),
        F.when(copy, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0).cast("bigint"))).alias("n_removed"),
        F.when(copy, whole).otherwise(F.coalesce("removed", F.array().cast(spans))).alias("removed"),
        F.when(copy, F.lit(empty)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
        F.col("sha").alias("sha256"),
    )

