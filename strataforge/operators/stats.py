"""Descriptive statistics: a row per attribute, each from one aggregation pass over all columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataforge.functions.columns import ACCURACY, Columns, col, discrete, long_text, model_frame, numeric_columns, per_attribute, quantiles, resolve, type_classes

_Measures = dict[str, Callable[[str], Column]]


def _rows() -> Column:
    return F.count(F.lit(1))


def global_summary(df: DataFrame, list_of_cols: Columns = "all", drop_cols: Columns = ()) -> DataFrame:
    """Rows, columns, and names and numbers by type class, all as strings."""
    names = resolve(df, list_of_cols, drop_cols, df.columns)
    part = df.select(*(col(c) for c in names))
    numeric, text, other = type_classes(part)
    rows = [("rows_count", str(df.count())), ("columns_count", str(len(names)))]
    for kind, found in (("numcols", numeric), ("catcols", text), ("othercols", other)):
        rows += [(f"{kind}_count", str(len(found))), (f"{kind}_name", ", ".join(found))]
    return model_frame(df, rows, "metric string, value string")


def missing_count(df: DataFrame, list_of_cols: Columns = "all", drop_cols: Columns = ()) -> DataFrame:
    """``missing_pct`` is rounded from the counts; NaN is a value."""
    names = resolve(df, list_of_cols, drop_cols, df.columns if list_of_cols != "all" else None)
    found = per_attribute(df, names, {"missing_count": lambda c: F.count_if(col(c).isNull()), "_n": lambda c: _rows()}, "missing_count bigint, _n bigint")
    return found.select("attribute", "missing_count", F.round(F.try_divide("missing_count", "_n"), 4).alias("missing_pct"))


def nonzero_count(df: DataFrame, list_of_cols: Columns = "all", drop_cols: Columns = ()) -> DataFrame:
    """Numeric columns; null is zero, the share is of all rows."""
    names = numeric_columns(df, list_of_cols, drop_cols, empty_ok=True)
    found = per_attribute(df, names, {"nonzero_count": _nonzero, "_n": lambda c: _rows()}, "nonzero_count bigint, _n bigint")
    return found.select("attribute", "nonzero_count", F.round(F.try_divide("nonzero_count", "_n"), 4).alias("nonzero_pct"))


def _nonzero(c: str) -> Column:
    return F.count_if(F.coalesce(col(c).cast("double"), F.lit(0.0)) != 0)


def measures_of_counts(df: DataFrame, list_of_cols: Columns = "all", drop_cols: Columns = ()) -> DataFrame:
    """``missing_pct`` is 1 less the rounded ``fill_pct``; non-zero values are null for string columns."""
    names = resolve(df, list_of_cols, drop_cols)
    numeric = type_classes(df)[0]
    measures: _Measures = {"fill_count": lambda c: F.count(col(c)), "_n": lambda c: _rows(), "nonzero_count": lambda c: _nonzero(c) if c in numeric else F.lit(None)}
    found = per_attribute(df, names, measures, "fill_count bigint, _n bigint, nonzero_count bigint")
    fill = F.round(F.try_divide("fill_count", "_n"), 4)
    return found.select(
        "attribute",
        "fill_count",
        fill.alias("fill_pct"),
        (F.col("_n") - F.col("fill_count")).alias("missing_count"),
        F.round(1 - fill, 4).alias("missing_pct"),
        "nonzero_count",
        F.round(F.try_divide("nonzero_count", "_n"), 4).alias("nonzero_pct"),
    )


def mode(df: DataFrame, list_of_cols: Columns = "all", drop_cols: Columns = ()) -> DataFrame:
    """The most frequent value as a string and its rows; of values that tie, the first in text order. Columns without values give nulls."""
    names = resolve(df, list_of_cols, drop_cols)
    counts = long_text(df, names).groupBy("attribute", "value").agg(F.count("value").alias("n"))
    best = counts.groupBy("attribute").agg(F.min(F.when(F.col("value").isNotNull(), F.struct(-F.col("n"), "value"))).alias("b"))
    found = best.select("attribute", F.col("b.value").alias("mode"), (-F.col("b.col1")).alias("mode_rows"))
    return found


def central_tendency(df: DataFrame, list_of_cols: Columns = "all", drop_cols: Columns = (), accuracy: int = ACCURACY) -> DataFrame:
    """Mean and median of numeric columns, mode of discrete ones (string, int, bigint), its rows and their share of non-null rows."""
    names = resolve(df, list_of_cols, drop_cols)
    numeric, listed = type_classes(df)[0], [c for c in names if c in discrete(df)]
    medians = quantiles(df, [c for c in names if c in numeric], [0.5], accuracy)
    measures: _Measures = {
        "mean": lambda c: F.avg(col(c)) if c in numeric else F.lit(None),
        "median": lambda c: F.lit((medians.get(c) or [None])[0]),
        "_n": lambda c: F.count(col(c)),
    }
    found = per_attribute(df, names, measures, "mean double, median double, _n bigint")
    modes = mode(df, listed) if listed else model_frame(df, [], "attribute string, mode string, mode_rows bigint")
    return found.join(modes, "attribute", "left").select("attribute", F.round("mean", 4).alias("mean"), F.round("median", 4).alias("median"), "mode", "mode_rows", F.round(F.try_divide("mode_rows", "_n"), 4).alias("mode_pct"))


def _unique(approx: bool, rsd: float | None) -> Callable[[str], Column]:
    if approx:
        return lambda c: F.approx_count_distinct(col(c), rsd) if rsd else F.approx_count_distinct(col(c))
    return lambda c: F.count_distinct(col(c))


def unique_count(df: DataFrame, list_of_cols: Columns = "all", drop_cols: Columns = (), compute_approx_unique_count: bool = False, rsd: float | None = None) -> DataFrame:
    """Distinct non-null values, exact or by HyperLogLog++."""
    if compute_approx_unique_count:
        names = resolve(df, list_of_cols, drop_cols, discrete(df) if list_of_cols == "all" else df.columns)
        return per_attribute(df, names, {"unique_values": _unique(True, rsd)}, "unique_values bigint")
    names = resolve(df, list_of_cols, drop_cols, discrete(df) if list_of_cols == "all" else df.columns)
    # Exact counts of many columns in one aggregation would expand every row; by (attribute, value) they share one shuffle.
    distinct = long_text(df, names).groupBy("attribute", "value").agg(F.lit(1).alias("_"))
    return distinct.groupBy("attribute").agg(F.count("value").alias("unique_values"))


def measures_of_cardinality(df: DataFrame, list_of_cols: Columns = "all", drop_cols: Columns = (), use_approx_unique_count: bool = True, rsd: float | None = None) -> DataFrame:
    """Distinct values of discrete columns and IDness, their share of non-null rows."""
    names = resolve(df, list_of_cols, drop_cols, discrete(df) if list_of_cols == "all" else df.columns)
    filled = per_attribute(df, names, {"_n": lambda c: F.count(col(c))}, "_n bigint")
    found = unique_count(df, names, (), use_approx_unique_count, rsd).join(filled, "attribute")
    return found.select("attribute", "unique_values", F.round(F.try_divide("unique_values", "_n"), 4).alias("IDness"))


def measures_of_dispersion(df: DataFrame, list_of_cols: Columns = "all", drop_cols: Columns = (), accuracy: int = ACCURACY) -> DataFrame:
    """Numeric columns. ``variance`` is the square of the rounded ``stddev``, ``cov`` the rounded stddev over the mean."""
    names = numeric_columns(df, list_of_cols, drop_cols, empty_ok=True)
    quarters = quantiles(df, names, [0.25, 0.75], accuracy)
    measures: _Measures = {
        "s": lambda c: F.stddev_samp(col(c)),
        "m": lambda c: F.avg(col(c)),
        "q": lambda c: F.lit(quarters[c]),
        "lo": lambda c: F.min(col(c)),
        "hi": lambda c: F.max(col(c)),
    }
    found = per_attribute(df, names, measures, "s double, m double, q array<double>, lo double, hi double")
    sd = F.round("s", 4)
    return found.select(
        "attribute",
        sd.alias("stddev"),
        F.round(sd * sd, 4).alias("variance"),
        F.round(F.try_divide(sd, F.col("m")), 4).alias("cov"),
        F.round(F.col("q")[1] - F.col("q")[0], 4).alias("IQR"),
        F.round(F.col("hi") - F.col("lo"), 4).alias("range"),
    )


PERCENTILES = {"1%": 0.01, "5%": 0.05, "10%": 0.1, "25%": 0.25, "50%": 0.5, "75%": 0.75, "90%": 0.9, "95%": 0.95, "99%": 0.99}


def measures_of_percentiles(df: DataFrame, list_of_cols: Columns = "all", drop_cols: Columns = (), accuracy: int = ACCURACY) -> DataFrame:
    names = numeric_columns(df, list_of_cols, drop_cols, empty_ok=True)
    found = quantiles(df, names, list(PERCENTILES.values()), accuracy)
    measures: _Measures = {
        "lo": lambda c: F.min(col(c)),
        "q": lambda c, found=found: F.lit(found[c]),
        "hi": lambda c: F.max(col(c)),
    }
    found = per_attribute(df, names, measures, "lo double, q array<double>, hi double")
    between = [F.round(F.col("q")[i], 4).alias(p) for i, p in enumerate(PERCENTILES)]
    return found.select("attribute", F.round("lo", 4).alias("min"), *between, F.round("hi", 4).alias("max"))


def measures_of_shape(df: DataFrame, list_of_cols: Columns = "all", drop_cols: Columns = ()) -> DataFrame:
    """Skewness and excess kurtosis of the rows as a population."""
    names = numeric_columns(df, list_of_cols, drop_cols, empty_ok=True)
    found = per_attribute(df, names, {"s": lambda c: F.skewness(col(c)), "k": lambda c: F.kurtosis(col(c))}, "s double, k double")
    return found.select("attribute", F.round("s", 4).alias("skewness"), F.round("k", 4).alias("kurtosis"))
