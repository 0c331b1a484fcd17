"""Vectorised text helpers: Arrow string columns as byte arrays, word spans and 64-bit hashes.

All functions work on one slice of rows at a time. A slice holds about ``SLICE_BYTES`` of text, so
memory stays bounded however many rows an Arrow batch has; a single longer text is a slice of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_GRAM = [np.uint64(pow(0xD6E8FEB86659FD93, i + 1, 1 << 64)) for i in range(64)]
#: Of a little-endian 8-byte number, its first 0 to 8 bytes.
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
#: Longer spans are hashed one by one with BLAKE2.
LONG_SPAN = 256

#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_TABLE = LOWER.tobytes()

#: Bytes of words that end at white space: ``[^\x20\x09-\x0D]+``.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False

#: Bytes of words of letters and digits: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _trimmer():
    import ctypes

    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # another C library: nothing to call
        return lambda n: 0


_TRIM = _trimmer()


def trim() -> None:
    """Gives freed memory back to the system: Python workers live on between stages, beside a JVM that needs it."""
    pa.default_memory_pool().release_unused()
    _TRIM(0)


class Slice:
    """Some rows' texts as one byte array. ``rows`` are their places in the batch; a null text is empty."""

    def __init__(self, first: int, buf: np.ndarray, offsets: np.ndarray) -> None:
        self.first, self.buf, self.offsets = first, buf, offsets
        self.n = len(offsets) - 1

    def text(self, i: int) -> bytes:
        return self.buf[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def pieces(self, limit: int = 1 << 18) -> Iterator[Slice]:
        """Its texts in slices of about ``limit`` bytes, for work whose arrays are many times as large."""
        i = 0
        while i < self.n:
            j = int(np.searchsorted(self.offsets, self.offsets[i] + limit, side="right")) - 1
            j = min(max(j, i + 1), self.n)
            yield Slice(i, self.buf[self.offsets[i] : self.offsets[j]], self.offsets[i : j + 1] - self.offsets[i])
            i = j


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i, n = 0, len(column)
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield Slice(i, buf[off[i] : off[j]], off[i : j + 1] - off[i])
        i = j
    trim()


def row_groups(column: pa.Array, rows: int = 256, limit: int = 1 << 24) -> Iterator[tuple[int, int]]:
    """First row and number of rows of runs that hold about ``limit`` bytes at most; a longer value is a run of its own."""
    size = np.array([x or 0 for x in pc.binary_length(column).to_pylist()], np.int64)
    first, held = 0, 0
    for i, n in enumerate(size.tolist()):
        if i > first and (held + n > limit or i - first == rows):
            yield first, i - first
            first, held = i, 0
        held += n
    if len(size):
        yield first, len(size) - first


def others(keep, *made: str) -> list[str]:
    """Of the columns to keep, those whose names, whatever their case, are not those of new columns."""
    taken = {m.lower() for m in made}
    return [c for c in keep if c.lower() not in taken]


def spans(s: Slice, table: np.ndarray, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and the place in ``s`` of each word's text."""
    inside = np.zeros(len(buf) + 2, bool)
    inside[1:-1] = table[buf]
    edge = inside[1:] != inside[:-1]
    bounds = np.flatnonzero(edge)
    starts, ends = bounds[::2], bounds[1::2]
    cut = s.offsets[1:-1]
    cut = np.unique(cut[(cut > 0) & (cut < len(buf))])
    cut = cut[inside[cut] & inside[cut + 1]] if len(cut) else cut
    if len(cut):  # a word that runs on into the next text
        starts, ends = np.sort(np.r_[starts, cut]), np.sort(np.r_[ends, cut])
    return starts, ends, np.searchsorted(s.offsets, starts, side="right") - 1


def loads(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as a little-endian number, zeros behind the end."""
    held = np.zeros(len(buf) + 8, np.uint8)
    held[: len(buf)] = buf
    return np.ndarray((len(buf) + 1,), "<u8", held.data, strides=(1,))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span's bytes, the same wherever they stand: 8 bytes after 8 are mixed in, so that no
    arrangement of bytes cancels out. With another ``seed`` it is another hash."""
    starts, size = np.asarray(starts, np.int64), np.asarray(ends - starts, np.int64)
    at, eight = starts, loads(buf)
    h = mix(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019 + seed))
    h = mix(h ^ (eight[at] & _FIRST[np.minimum(size, 8)]))
    some = np.flatnonzero((size > 8) & (size <= LONG_SPAN))
    at, left = at[some] + 8, size[some] - 8
    while len(some):
        h[some] = mix(h[some] ^ (eight[at] & _FIRST[np.minimum(left, 8)]))
        on = left > 8
        some, at, left = some[on], at[on] + 8, left[on] - 8
    for i in np.flatnonzero(size > LONG_SPAN).tolist():
        got = hashlib.blake2b(buf[starts[i] : starts[i] + size[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little")).digest()
        h[i] = int.from_bytes(got, "little")
    return h


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each ``n`` words in a row, over all texts; the caller drops those that cross texts."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = words[: len(words) - n + 1] * _GRAM[0]
    for i in range(1, n):
        out = out + words[i : len(words) - n + 1 + i] * _GRAM[i]
    return mix(out + np.uint64(n))


def bounds(doc: np.ndarray, n: int) -> np.ndarray:
    """Where each text's words begin in ``doc``, a sorted array of places, with the end."""
    return np.searchsorted(doc, np.arange(n + 1))


def runs(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans in order of their starts, as maximal runs; spans that touch or overlap are joined."""
    if not len(starts):
        return starts, ends
    reach = np.maximum.accumulate(ends)
    new = np.r_[True, starts[1:] > reach[:-1]]
    at = np.flatnonzero(new)
    return starts[at], reach[np.r_[at[1:] - 1, len(starts) - 1]]


def without_spans(text: str | None, spans: list[dict] | None) -> str | None:
    """``text`` without byte spans of its UTF-8 form; what is left of a cut character goes too."""
    if not spans or text is None:
        return text
    raw, out, at = text.encode(), [], 0
    for s in spans:
        out.append(raw[at : s["start"]])
        at = s["end"]
    return b"".join([*out, raw[at:]]).decode("utf-8", "ignore")


def cut_spans(df, spans_col: str, text_col: str = "text", length_col: str | None = "n_chars"):
    """``df`` without ``spans_col``: the spans are cut from the text, and ``length_col``, if there, follows."""
    names = [c for c in df.columns if c != spans_col]
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n_rows in row_groups(batch.column(text_col), 512):
                part = batch.slice(first, n_rows)
                texts = [without_spans(t, s) for t, s in zip(part.column(text_col).to_pylist(), part.column(spans_col).to_pylist(), strict=True)]
                made = {text_col: pa.array(texts, part.schema.field(text_col).type)}
                if length_col in names:
                    made[length_col] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(part.schema.field(length_col).type)
                yield pa.RecordBatch.from_arrays([made.get(c, part.column(c)) for c in names], names=names)

    return df.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names))
