"""Random and stratified samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataforge.functions.columns import Columns, col, resolve
from strataforge.operators.stats import unique_count


def data_sample(df: DataFrame, strata_cols: Columns = "all", drop_cols: Columns = (), fraction: float = 0.1, method_type: str = "random", stratified_type: str = "population", seed_value: int = 12, unique_threshold: float = 0.5) -> DataFrame:
    """Bernoulli sample, overall or by stratum.

    A stratum is a combination of values of the strata columns (null is a value of its own); columns with more distinct values than
    ``unique_threshold`` (a share of the rows up to 1, else a number) are left out. ``balanced`` takes as many rows from each stratum as
    ``fraction`` takes from the smallest. Strata and their fractions stay a table: with many of them nothing
    collects on the driver.
    """
    if not 0 < fraction <= 1:
        raise TypeError("Invalid input for fraction")
    if method_type == "random":
        return df.sample(False, fraction, seed_value)
    if method_type != "stratified" or stratified_type not in ("population", "balanced"):
        raise TypeError("Invalid input for data_sample method_type")
    names = resolve(df, strata_cols, drop_cols, df.columns)
    limit = unique_threshold * df.count() if unique_threshold <= 1 else unique_threshold
    distinct = {r["attribute"]: r["unique_values"] for r in unique_count(df, names).collect()}
    names = [c for c in names if distinct[c] <= limit]
    if not names:
        raise TypeError("No strata column is under unique_threshold")
    marked = df.withColumn("_u", F.rand(seed_value))
    if stratified_type == "population":
        return marked.where(F.col("_u") < fraction).drop("_u")
    strata = df.groupBy(*(col(c).alias(f"_s{i}") for i, c in enumerate(names))).agg(F.count(F.lit(1)).alias("_n"))
    least = strata.agg(F.min("_n")).first()[0] or 0
    same = None
    for i, c in enumerate(names):
        equal = col(c).eqNullSafe(F.col(f"_s{i}"))
        same = equal if same is None else same & equal
    kept = marked.join(strata, same).where(F.col("_u") < fraction * least / F.col("_n"))
    return kept.select(*(col(c) for c in df.columns))
