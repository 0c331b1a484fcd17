"""Sessions. Nothing here runs at import."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import SparkSession


def init_spark(app_name: str = "strataforge", master: str | None = None, jars_packages: list[str] | None = None, py_files: list[str] | None = None, spark_config: Mapping[str, str] | None = None) -> SparkSession:
    """A session with UTC as its zone and adaptive execution on; ``spark_config`` wins over both."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    if jars_packages:
        builder = builder.config("spark.jars.packages", ",".join(jars_packages))
    conf = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", **(spark_config or {})}
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    for path in py_files or []:
        spark.sparkContext.addPyFile(path)
    return spark
