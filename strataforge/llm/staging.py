"""Tables between the passes of an operator, in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[SparkSession, str]] = []
#: Spark's setting that deletes a query's shuffle files when the query ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where the session names none, one of this machine, if all of it runs here."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        held = sc._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="strataforge-")
        sc.setCheckpointDir(found)
    return found


#: Parquet looks at the size of pages and row groups after 100 rows at first, keeps the least and greatest value of each whole until a file
#: is closed, and Spark reads a row group's column as one array: with rows of megabytes a task would hold all of its rows.
WIDE_ROWS = {"parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "100", "parquet.block.size": str(1 << 24), "parquet.column.statistics.enabled": "false"}


def stage(df: DataFrame, name: str, wide: bool = False) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back: later passes depend on no executor, and the shuffle files of
    this one go at once, not when the driver happens to collect its garbage. ``wide``: rows may take megabytes each."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/strataforge-{name}-{uuid.uuid4().hex}"
    with _setting(spark, SHUFFLE_CLEANUP, "true"):
        df.write.option("compression", "zstd").options(**WIDE_ROWS if wide else {}).parquet(path)
    if not _WRITTEN:
        atexit.register(_sweep)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Deletes a table of ``stage`` that nothing reads any more."""
    for item in list(_WRITTEN):
        if any(item[1].split("/")[-1] in f for f in df.inputFiles()[:1]):
            _delete(*item)
            _WRITTEN.remove(item)


@contextlib.contextmanager
def passing() -> Iterator[list[DataFrame]]:
    """Tables staged inside go at its end, but for those that are put in the list it gives: a run's disk holds what is still to be read."""
    before, kept = list(_WRITTEN), []
    try:
        yield kept
    finally:
        files = [f for df in kept for f in df.inputFiles()]
        for item in [x for x in _WRITTEN if x not in before]:
            name = item[1].split("/")[-1]
            if not any(name in f for f in files):
                _delete(*item)
                _WRITTEN.remove(item)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _sweep() -> None:
    for spark, path in _WRITTEN:
        if spark.sparkContext._jsc is None:  # the session has ended: nothing to reach the folder by
            continue
        _delete(spark, path)


def parts(spark: SparkSession) -> int:
    """How many buckets a packed exchange gets: the session's shuffle partitions, the user's knob for scale."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def lanes(spark: SparkSession, buckets: int) -> np.ndarray:
    """A number for each bucket, all different, such that Spark's hash partitioning by them gives each shuffle partition as many.

    A few hundred bucket numbers hashed to as many partitions would leave some empty and give others five.
    """
    n = parts(spark)
    each = -(-buckets // n)
    found, held, begin = np.full((n, each), -1, np.int64), np.zeros(n, np.int64), 0
    while (held < each).any():
        number = np.arange(begin, begin + 4 * n * each + 64)
        to = _spark_hash(number) % n
        order = np.argsort(to, kind="stable")
        first = np.searchsorted(to[order], np.arange(n + 1))
        for p in np.flatnonzero(held < each):
            some = number[order[first[p] : first[p + 1]]][: each - held[p]]
            found[p, held[p] : held[p] + len(some)] = some
            held[p] += len(some)
        begin = int(number[-1]) + 1
    return found.T.reshape(-1)[:buckets].astype(np.int32)


def _spark_hash(number: np.ndarray) -> np.ndarray:
    """Spark's hash of an int, the 32-bit Murmur3 of one block with seed 42, as a signed number."""
    turn = lambda x, k: (x << np.uint32(k)) | (x >> np.uint32(32 - k))
    k = turn(number.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
    h = turn(np.uint32(42) ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64) ^ np.uint32(4)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return (h ^ (h >> np.uint32(16))).view(np.int32).astype(np.int64)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """While staged passes run, Arrow batches of whole texts hold at most ``rows`` of them; the session's setting is put back after."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(key))
    with _setting(spark, key, str(rows if before <= 0 or before > rows else before)):
        yield


@contextlib.contextmanager
def light_batches(spark: SparkSession, size: int = 1 << 23) -> Iterator[None]:
    """While staged passes run, Arrow batches end once they hold ``size`` bytes, so that wide rows go few at a time."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key).removesuffix("b")
    with _setting(spark, key, before if before.isdigit() and 0 < int(before) < size else str(size)):
        yield


@contextlib.contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
