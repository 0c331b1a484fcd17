"""A filter of fixed size over ids, to keep rows that a join would drop anyway from its shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strataforge.llm.textkit import mix

BITS = 24
CHUNK = 4096
WORDS = 1 << (BITS - 6)


def _place(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = mix(ids.view(np.uint64)) >> np.uint64(64 - BITS)
    return (h >> np.uint64(6)).astype(np.int64), h & np.uint64(63)


def filter_of(ids: DataFrame) -> np.ndarray:
    """Bits of the values of the one column (bigint) of ``ids``: 2 MB whatever their number; with very many it only filters less."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(WORDS, np.uint64)
        for batch in batches:
            word, bit = _place(batch.column(0).to_numpy())
            np.bitwise_or.at(bits, word, np.uint64(1) << bit)
        some = [i for i in range(0, WORDS, CHUNK) if bits[i : i + CHUNK].any()]
        yield pa.RecordBatch.from_arrays([pa.array([i // CHUNK for i in some], pa.int32()), pa.array([bits[i : i + CHUNK].tobytes() for i in some], pa.binary())], names=["chunk", "v"])

    def unite(table: pa.Table) -> pa.Table:
        bits = np.zeros(CHUNK, np.uint64)
        for x in table.column("v").to_pylist():
            bits |= np.frombuffer(x, np.uint64)
        return pa.table({"chunk": table.column("chunk")[:1].cast(pa.int32()), "v": pa.array([bits.tobytes()], pa.binary())})

    bits = np.zeros(WORDS, np.uint64)
    for r in ids.mapInArrow(mark, "chunk int, v binary").groupBy("chunk").applyInArrow(unite, "chunk int, v binary").collect():
        bits[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["v"], np.uint64)
    return bits


def holds(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each value may be among those of the filter: true for all that are."""
    word, bit = _place(values)
    return (bits[word] >> bit & np.uint64(1)).astype(bool)


def may_match(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose first column (bigint, no nulls) may be in the one column of ``ids``: all that are, and few others."""
    shared = rows.sparkSession.sparkContext.broadcast(filter_of(ids))

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(holds(shared.value, batch.column(0).to_numpy())))

    return rows.mapInArrow(sift, ", ".join(f"`{c}` {t}" for c, t in rows.dtypes))
