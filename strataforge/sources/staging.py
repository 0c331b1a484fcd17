"""Tables between passes, in the folder that the driver and all executors share, and dense row numbers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where the session names none, one of this machine, if all of it runs here."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        held = sc._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        if sc.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="strataforge-")
        sc.setCheckpointDir(found)
    return found


def stage(df: DataFrame, name: str) -> DataFrame:
    """Written and read back: what follows sees the same rows in every pass, and depends on no executor."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df``, staged, with a column ``name`` that numbers its rows from 0 without gaps, in the order of the staged files.

    Rows are counted per partition; nothing is sorted or shuffled but these counts.
    """
    rows = stage(df, "rows").withColumn("_at", F.monotonically_increasing_id())
    rows = stage(rows, "numbered").withColumns({"_part": F.shiftright("_at", 33), "_in": F.col("_at").bitwiseAND((1 << 33) - 1)})
    counts = sorted((r["_part"], r["n"]) for r in rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())
    before, at = [], 0
    for part, n in counts:
        before.append((part, at))
        at += n
    table = df.sparkSession.createDataFrame(before, "_part bigint, _before bigint")  # one row per partition
    return rows.join(F.broadcast(table), "_part").withColumn(name, F.col("_before") + F.col("_in")).drop("_part", "_before", "_in", "_at")
