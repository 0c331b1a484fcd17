"""A bounded sample of labelled rows for the classifiers: bounded in rows, in the length of a text and in bytes as a whole."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataforge.llm.staging import drop, stage

#: Texts of more bytes are not learned from (they are scored, like all).
TRAIN_TEXT_BYTES = 1 << 20
#: Of features, so much is sent to the driver at most.
TRAIN_BYTES = 48 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, rows: int, usable: Column, id_col: str = "doc_id", extra: tuple[str, ...] = (), text_col: str = "text", text_bytes: int = TRAIN_TEXT_BYTES) -> DataFrame:
    """At most ``rows`` labelled ids with their documents (texts of up to ``text_bytes``): those whose id has the smallest hash, so the same in any run.

    An id with several labels takes the largest, one with several documents brings each. The ids are chosen from
    the labels alone; they are at most ``rows``, which is what bounds the broadcast.
    """
    usable_labels = labels.where(usable & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).alias("_label"))
    chosen = usable_labels.orderBy(F.xxhash64(id_col), id_col).limit(rows)
    short = docs.select(F.col(id_col), F.col(text_col).alias("text"), *(F.col(c) for c in extra)).where(f"text is null or octet_length(text) <= {text_bytes}")
    return short.join(F.broadcast(chosen), id_col)


def gathered(features: DataFrame, budget: int = TRAIN_BYTES) -> pa.Table:
    """Rows (y, k, ..., f: binary) in order of k, which is the id as text, and y, as far as ``budget`` bytes of ``f`` go.

    They are staged first; then sums by ranges of a hash of id and label show how much fits, and only that much is sent.
    """
    kept = stage(features.withColumn("_h", F.pmod(F.xxhash64("k", "y"), F.lit(4096))), "features")
    size = {r["_h"]: r["n"] for r in kept.groupBy("_h").agg(F.sum(F.coalesce(F.octet_length("f"), F.lit(0)) + 64).alias("n")).collect()}
    total, limit = 0, -1
    for h in range(4096):
        total += size.get(h, 0)
        if total > budget:
            break
        limit = h
    out = kept.where(F.col("_h") <= limit).drop("_h").toArrow().sort_by([("k", "ascending"), ("y", "ascending"), ("f", "ascending")])
    drop(kept)
    return out


def folds(n: int, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Of ``n`` rows those to fit a trial model on, and a quarter to calibrate what comes after the model."""
    order = np.random.Generator(np.random.PCG64(seed)).permutation(n)
    cut = n - n // 4
    return np.sort(order[:cut]), np.sort(order[cut:])
