"""Tables behind a report, and a plain HTML page of them."""

from __future__ import annotations

from collections.abc import Mapping
from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataforge.functions.columns import col, type_classes, union_all
from strataforge.operators import association, binning, drift, quality, stats


def frequency(df: DataFrame, name: str, cuts: list[float] | None = None) -> DataFrame:
    """Rows and share (%) by category, or by bin of a number."""
    value = binning.bin_label(col(name), cuts) if cuts else col(name).cast("string")
    counts = df.groupBy(value.alias(name)).agg(F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.sum("count").alias("_t"))
    return counts.join(F.broadcast(total)).select(name, "count", F.round(100 * F.col("count") / F.col("_t"), 4).alias("count_%"))


def event_rate(df: DataFrame, name: str, label_col: str, event_label: object, cuts: list[float] | None = None) -> DataFrame:
    value = binning.bin_label(col(name), cuts) if cuts else col(name).cast("string")
    return df.groupBy(value.alias(name)).agg(F.round(100 * F.avg((col(label_col) == event_label).cast("double")), 4).alias("event_rate"))


def comparative_drift(target: DataFrame, source: DataFrame, name: str, cuts: Mapping[str, list[float]] | None = None) -> DataFrame:
    """Shares of source and target by bin, and the difference in percent."""
    p, q = (drift.frequencies(x, [name], cuts or {}).select("bin", F.col("share").alias(k)) for x, k in ((source, "source_share"), (target, "target_share")))
    return p.join(q, "bin", "full_outer").fillna(0.0).withColumn("%_diff", F.round(100 * F.try_divide(F.col("target_share") - F.col("source_share"), F.col("source_share")), 4))


def stability_band(index) -> object:
    return F.when(index >= 3.5, "Very Stable").when(index >= 3, "Stable").when(index >= 2, "Marginally Stable").when(index >= 1, "Unstable").when(index >= 0, "Very Unstable").otherwise("Out of Range")


def health_flags(df: DataFrame, label_col: str | None = None, event_label: object = 1, iv_threshold: float = 0.02, corr_threshold: float = 0.4) -> DataFrame:
    """(attribute, flag) of attributes that stand out: high variance, skew, kurtosis, low fill, bias, outliers, correlation, information value."""
    s, k = stats.measures_of_shape(df), stats.measures_of_counts(df)
    out, bias = quality.outlier_detection(df, treatment=False)[1], quality.biasedness_detection(df)[1]
    found = [
        stats.measures_of_dispersion(df).where("cov > 1").select("attribute", F.lit("High Variance").alias("flag")),
        s.where("skewness > 0").select("attribute", F.lit("Positive Skewness")),
        s.where("skewness < 0").select("attribute", F.lit("Negative Skewness")),
        s.where("kurtosis > 0").select("attribute", F.lit("High Kurtosis")),
        s.where("kurtosis < 0").select("attribute", F.lit("Low Kurtosis")),
        k.where("fill_pct < 0.7").select("attribute", F.lit("Low Fill Rates")),
        bias.where("flagged = 1").select("attribute", F.lit("High Biasedness")),
        out.where("lower_outliers + upper_outliers > 0").select("attribute", F.lit("Outliers")),
    ]
    if len(type_classes(df)[0]) > 1:
        corr = association.correlation_matrix(df)
        names = [c for c in corr.columns if c != "attribute"]
        long = corr.unpivot(["attribute"], names, "other", "r").where((F.col("attribute") != F.col("other")) & (F.abs("r") > corr_threshold))
        found.append(long.select("attribute", F.lit("High Correlation")).distinct())
    if label_col:
        found.append(association.iv_calculation(df, label_col=label_col, event_label=event_label).where(F.col("iv") > iv_threshold).select("attribute", F.lit("Significant Attributes")))
    return union_all(found)


def basic_tables(df: DataFrame, id_col: str = "", label_col: str = "", event_label: object = 1, skip_corr_matrix: bool = True) -> dict[str, DataFrame]:
    """Every statistic, quality check and association of a dataset, by name."""
    part = df.drop(id_col) if id_col else df
    made = {
        "global_summary": stats.global_summary(df),
        "measures_of_counts": stats.measures_of_counts(part),
        "measures_of_centralTendency": stats.central_tendency(part),
        "measures_of_cardinality": stats.measures_of_cardinality(part),
        "measures_of_percentiles": stats.measures_of_percentiles(part),
        "measures_of_dispersion": stats.measures_of_dispersion(part),
        "measures_of_shape": stats.measures_of_shape(part),
        "duplicate_detection": quality.duplicate_detection(part, treatment=False)[1],
        "nullRows_detection": quality.null_rows_detection(part)[1],
        "nullColumns_detection": quality.null_columns_detection(part)[1],
        "IDness_detection": quality.idness_detection(part)[1],
        "biasedness_detection": quality.biasedness_detection(part)[1],
        "invalidEntries_detection": quality.invalid_entries_detection(part)[1],
        "outlier_detection": quality.outlier_detection(part, treatment=False)[1],
    }
    if not skip_corr_matrix:
        made["correlation_matrix"] = association.correlation_matrix(part)
    if label_col:
        made["IV_calculation"] = association.iv_calculation(part, label_col=label_col, event_label=event_label)
        made["IG_calculation"] = association.ig_calculation(part, label_col=label_col, event_label=event_label)
    return made


def html(tables: Mapping[str, DataFrame], title: str = "Report", rows: int = 1000) -> str:
    """A page with each table's first ``rows`` rows."""
    out = [f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1>"]
    for name, df in tables.items():
        head = "".join(f"<th>{escape(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{'' if v is None else escape(str(v))}</td>" for v in r) + "</tr>" for r in df.limit(rows).collect())
        out.append(f"<h2>{escape(name)}</h2><table border='1'><tr>{head}</tr>{body}</table>")
    return "".join([*out, "</body></html>"])
