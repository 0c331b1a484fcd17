"""Media columns: ISO media containers, written and read box by box.

``write_container`` wraps a payload as one track of raw grey 8-bit frames (``FRAME`` samples a frame): ``ftyp``, a
``moov`` tree with the sample tables, and the payload in ``mdat``. ``read_container`` walks nested boxes of any such
file, decodes the sample tables (``stts``, ``stsc``, ``stsz``, ``stco``/``co64``, ``stss``) and gives codec, duration and the
byte ranges of the keyframes and of all samples, without decoding a payload.

Edge cases: a null or empty text is one frame of zeros; boxes with 64-bit sizes and boxes that reach to the end
of the file are read; ``probe`` gives nulls for a value that is null or no well-formed container; repeated rows
and further columns are left alone, but for those kept columns that are named as a new one, which give way.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from strataforge.llm import textkit as K

FRAME = 64
FRAMES_PER_CHUNK = 16
KEYFRAME_EVERY = 8
TIMESCALE = 25
#: Boxes whose payload is boxes, and how many bytes stand before the first of them.
CONTAINERS = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"stbl": 0, b"dinf": 0, b"edts": 0, b"udta": 0}


def _box(kind: bytes, *payload: bytes) -> bytes:
    body = b"".join(payload)
    if len(body) + 8 >= 1 << 32:
        return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body
    return struct.pack(">I4s", len(body) + 8, kind) + body


def _full(kind: bytes, flags: int, *payload: bytes) -> bytes:
    return _box(kind, struct.pack(">I", flags), *payload)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
_FTYP = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")


def write_container(payload: bytes) -> bytes:
    """A container of ``payload``, whose length is a positive multiple of ``FRAME``."""
    frames = len(payload) // FRAME
    chunks = -(-frames // FRAMES_PER_CHUNK)
    last = frames - (chunks - 1) * FRAMES_PER_CHUNK
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", 8, 8, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 40, -1))
    runs = [(1, FRAMES_PER_CHUNK)] if last == FRAMES_PER_CHUNK else [(1, FRAMES_PER_CHUNK), (chunks, last)] if chunks > 1 else [(1, last)]
    keys = range(1, frames + 1, KEYFRAME_EVERY)
    wide = len(payload) >= 1 << 31

    def moov(base: int) -> bytes:
        at = range(base, base + len(payload), FRAME * FRAMES_PER_CHUNK)
        table = _box(
            b"stbl",
            _full(b"stsd", 0, struct.pack(">I", 1), entry),
            _full(b"stts", 0, struct.pack(">III", 1, frames, 1)),
            _full(b"stss", 0, struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            _full(b"stsc", 0, struct.pack(">I", len(runs)), *(struct.pack(">III", a, b, 1) for a, b in runs)),
            _full(b"stsz", 0, struct.pack(">II", FRAME, frames)),
            _full(b"co64" if wide else b"stco", 0, struct.pack(f">I{len(at)}{'Q' if wide else 'I'}", len(at), *at)),
        )
        media = _box(
            b"mdia",
            _full(b"mdhd", 0, struct.pack(">IIIIHH", 0, 0, TIMESCALE, frames, 0x55C4, 0)),
            _full(b"hdlr", 0, bytes(4), b"vide", bytes(12), b"payload\0"),
            _box(b"minf", _full(b"vmhd", 1, bytes(8)), _box(b"dinf", _full(b"dref", 0, struct.pack(">I", 1), _full(b"url ", 1))), table),
        )
        track = _box(b"trak", _full(b"tkhd", 3, struct.pack(">IIIII", 0, 0, 1, 0, frames), bytes(16), _MATRIX, struct.pack(">II", 8 << 16, 8 << 16)), media)
        return _box(b"moov", _full(b"mvhd", 0, struct.pack(">IIIIIH", 0, 0, TIMESCALE, frames, 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2)), track)

    head = len(_FTYP) + len(moov(0)) + (16 if len(payload) + 8 >= 1 << 32 else 8)
    return b"".join((_FTYP, moov(head), _box(b"mdat", payload)))


def walk(data: bytes, start: int = 0, end: int | None = None, path: bytes = b"") -> Iterator[tuple[bytes, int, int]]:
    """Path (such as ``moov/trak``), payload start and end of each box, outer boxes first."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise ValueError(f"box {kind!r} at {start} reaches beyond {end}")
        name = path + b"/" + kind if path else kind
        yield name, start + head, start + size
        if kind in CONTAINERS:
            yield from walk(data, start + head + CONTAINERS[kind], start + size, name)
        start += size


@dataclass
class Track:
    codec: str
    timescale: int
    duration: int
    samples: list[tuple[int, int]]
    keyframes: list[int]

    def keyframe_ranges(self) -> list[tuple[int, int]]:
        """First byte and length of each keyframe's sample."""
        return [self.samples[i] for i in self.keyframes]


def _table(data: bytes, at: int, kind: str, width: int = 1) -> list:
    n = struct.unpack_from(">I", data, at + 4)[0]
    flat = struct.unpack_from(f">{n * width}{kind}", data, at + 8)
    return list(flat) if width == 1 else [flat[i : i + width] for i in range(0, len(flat), width)]


def _track(data: bytes, boxes: dict[bytes, tuple[int, int]]) -> Track:
    at = {k.rpartition(b"/")[2]: v[0] for k, v in boxes.items()}
    version = data[at[b"mdhd"]]
    timescale, duration = struct.unpack_from(">IQ" if version else ">II", data, at[b"mdhd"] + (20 if version else 12))
    codec = data[at[b"stsd"] + 12 : at[b"stsd"] + 16].decode("latin-1")
    fixed, n = struct.unpack_from(">II", data, at[b"stsz"] + 4)
    sizes = [fixed] * n if fixed else list(struct.unpack_from(f">{n}I", data, at[b"stsz"] + 12))
    chunks = _table(data, at[b"co64"], "Q") if b"co64" in at else _table(data, at[b"stco"], "I")
    runs = _table(data, at[b"stsc"], "I", 3)
    samples, k = [], 0
    for r, (first, each, _) in enumerate(runs):
        for chunk in range(first - 1, runs[r + 1][0] - 1 if r + 1 < len(runs) else len(chunks)):
            place = chunks[chunk]
            for size in sizes[k : k + each]:
                samples.append((place, size))
                place += size
            k += each
    if sum(count for count, _ in _table(data, at[b"stts"], "I", 2)) != n or len(samples) != n:
        raise ValueError("sample tables disagree")
    if samples and max(a + b for a, b in samples) > len(data):
        raise ValueError("samples reach beyond the file")
    keys = [i - 1 for i in _table(data, at[b"stss"], "I")] if b"stss" in at else list(range(n))
    return Track(codec, timescale, duration, samples, keys)


def read_container(data: bytes) -> list[Track]:
    tracks: list[dict[bytes, tuple[int, int]]] = []
    for path, start, end in walk(data):
        if path == b"moov/trak":
            tracks.append({})
        elif path.startswith(b"moov/trak/"):
            tracks[-1][path] = (start, end)
    return [_track(data, t) for t in tracks]


def stored(data: bytes, track: Track) -> bytes:
    """The track's samples in order; neighbours are read in one piece."""
    out, start, reach = [], None, None
    for place, size in track.samples:
        if place != reach:
            if start is not None:
                out.append(data[start:reach])
            start = place
        reach = place + size
    if start is not None:
        out.append(data[start:reach])
    return b"".join(out)


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    size = max(FRAME, -(-len(raw) // FRAME) * FRAME)
    return len(raw), raw.ljust(size, b"\0")


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column, ``n_bytes`` (of the text) and ``media``, the container of its padded UTF-8 bytes."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n_rows in K.row_groups(batch.column(1)):
                part = batch.slice(first, n_rows)
                made = [padded(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _ in made], pa.int64()), pa.array([write_container(p) for _, p in made], pa.binary())], names=[id_col, "n_bytes", "media"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, media binary")


_PROBED = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, codec string, timescale bigint, duration bigint, n_samples bigint, keyframes array<struct<start: bigint, length: bigint>>"


def probe(media: DataFrame, media_col: str = "media", keep: tuple[str, ...] = ("doc_id", "n_bytes")) -> DataFrame:
    """Reads each container's first track back; adds digests of its stored bytes, codec, duration and keyframe byte ranges.

    The media column itself is kept, so that a caller can hash or store it.
    """
    keep = K.others(keep, media_col, "payload_bytes", "payload_sha256", "tail_crc32", "codec", "timescale", "duration", "n_samples", "keyframes")
    kinds = dict(media.dtypes)
    fields = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
    ranges = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))

    def one(data: bytes | None) -> tuple:
        try:
            track = read_container(data)[0] if data else None
        except (ValueError, KeyError, IndexError, struct.error):
            track = None
        if track is None:
            return (None,) * 8
        payload = stored(data, track)
        keys = [{"start": a, "length": b} for a, b in track.keyframe_ranges()]
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-FRAME:]), track.codec, track.timescale, track.duration, len(track.samples), keys

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), ranges]
        names = [*keep, media_col, "payload_bytes", "payload_sha256", "tail_crc32", "codec", "timescale", "duration", "n_samples", "keyframes"]
        for batch in batches:
            for first, n_rows in K.row_groups(batch.column(len(keep))):
                part = batch.slice(first, n_rows)
                found = [one(x) for x in part.column(len(keep)).to_pylist()]
                columns = [pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep) + 1)), *columns], names=names)

    return media.select(*keep, media_col).mapInArrow(run, f"{fields}, `{media_col}` binary, {_PROBED}")
