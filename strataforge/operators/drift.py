"""Drift between two datasets, and stability over periods."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataforge.functions.columns import Columns, as_list, col, model_frame, resolve, type_classes, union_all
from strataforge.operators import binning

DISTANCES = ("PSI", "HD", "JSD", "KS")
_NONE = 0.0001


def _methods(method_type: Columns) -> list[str]:
    found = list(DISTANCES) if method_type == "all" else as_list(method_type)
    if not found or any(m not in DISTANCES for m in found):
        raise TypeError("Invalid input for method_type")
    return [m for m in DISTANCES if m in found]


def frequencies(df: DataFrame, names: Sequence[str], cuts: Mapping[str, Sequence[float]]) -> DataFrame:
    """(attribute, bin, share) over all rows in one shuffle; numeric bins sort by number, categories by text. A null's share is 0."""

    def cell(c: str) -> Column:
        value = F.format_string("%09d", binning.bin_number(col(c), cuts[c])) if c in cuts else col(c).cast("string")
        return F.struct(F.lit(c).alias("attribute"), F.when(col(c).isNotNull(), value).alias("bin"))

    counts = df.select(F.inline(F.array(*(cell(c) for c in names)))).groupBy("attribute", "bin").agg(F.count("bin").alias("n"), F.count(F.lit(1)).alias("rows"))
    total = counts.groupBy("attribute").agg(F.sum("rows").alias("t"))
    return counts.join(F.broadcast(total), "attribute").select("attribute", "bin", (F.col("n") / F.col("t")).alias("share"))


def drift_statistics(
    target: DataFrame,
    source: DataFrame | None,
    list_of_cols: Columns = "all",
    drop_cols: Columns = (),
    method_type: Columns = "PSI",
    bin_method: str = "equal_range",
    bin_size: int = 10,
    threshold: float = 0.1,
    use_sampling: bool = False,
    sample_size: int = 100_000,
    sample_seed: int = 42,
    pre_existing_source: bool = False,
    source_save: bool = False,
    source_path: str = "NA",
    model_directory: str = "drift_statistics",
) -> DataFrame:
    """PSI, HD, JSD and KS per attribute between the shares of source-fitted bins (or categories); a share of 0 or none counts as 0.0001.

    KS sums bins in their order. A saved source (cut-offs and shares) stands in for the frame.
    """
    methods = _methods(method_type)
    names = resolve(target, list_of_cols, drop_cols)
    folder = f"{source_path}/{model_directory}"
    numeric = [c for c in names if c in type_classes(target)[0]]
    spark = target.sparkSession

    def sampled(df: DataFrame) -> DataFrame:
        rows = df.count() if use_sampling else 0
        return df.sample(False, sample_size / rows, sample_seed) if rows > sample_size else df

    target = sampled(target)
    if pre_existing_source:
        cuts = {r["attribute"]: list(r["parameters"]) for r in spark.read.parquet(folder + "/attribute_binning").collect()}
        p = spark.read.parquet(folder + "/frequency_counts")
    else:
        source = sampled(source)
        cuts = binning.cutoffs(source, numeric, bin_method, bin_size) if numeric else {}
        p = frequencies(source, names, cuts)
        if source_save:
            model_frame(spark, list(cuts.items()), "attribute string, parameters array<double>").coalesce(1).write.mode("overwrite").parquet(folder + "/attribute_binning")
            p.write.mode("overwrite").parquet(folder + "/frequency_counts")
    q = frequencies(target, [c for c in names if c not in numeric or c in cuts], cuts)
    same = F.col("x.attribute").eqNullSafe(F.col("y.attribute")) & F.col("x.bin").eqNullSafe(F.col("y.bin"))

    def share(of: str) -> Column:
        v = F.coalesce(F.col(of), F.lit(_NONE))
        return F.when(v == 0, _NONE).otherwise(v)

    both = p.alias("x").join(q.alias("y"), same, "full_outer").select(F.coalesce("x.attribute", "y.attribute").alias("attribute"), F.coalesce("x.bin", "y.bin").alias("bin"), share("x.share").alias("p"), share("y.share").alias("q"))
    w = Window.partitionBy("attribute").orderBy(F.col("bin").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    if "KS" in methods:
        both = both.withColumn("gap", F.abs(F.sum("p").over(w) - F.sum("q").over(w)))
    m = (F.col("p") + F.col("q")) / 2
    made = {
        "PSI": F.sum((F.col("p") - F.col("q")) * F.ln(F.col("p") / F.col("q"))),
        "HD": F.sqrt(F.sum(F.pow(F.sqrt("p") - F.sqrt("q"), 2)) / 2),
        "JSD": (F.sum(F.col("p") * F.ln(F.col("p") / m)) + F.sum(F.col("q") * F.ln(F.col("q") / m))) / 2,
    }
    if "KS" in methods:
        made["KS"] = F.max("gap")
    out = both.groupBy("attribute").agg(*(made[k].alias(k) for k in methods))
    return out.withColumn("flagged", F.when(F.greatest(*methods) > threshold if len(methods) > 1 else F.col(methods[0]) > threshold, 1).otherwise(0))


def score_cv(cv: Column, thresholds: Sequence[float] = (0.03, 0.1, 0.2, 0.5)) -> Column:
    out = F.lit(float(4 - len(thresholds)))
    for score, limit in reversed(list(enumerate(thresholds))):
        out = F.when(F.abs(cv) < limit, float(4 - score)).otherwise(out)
    return F.when(cv.isNotNull(), out)


def score_sd(sd: Column) -> Column:
    scored = F.when(sd <= 0.005, 4.0).when(sd <= 0.01, F.round(-100 * sd + 4.5, 1)).when(sd <= 0.05, F.round(-50 * sd + 4, 1)).when(sd <= 0.1, F.round(-30 * sd + 3, 1)).otherwise(0.0)
    return F.when(sd.isNotNull(), scored)


def check_weights(weights: Mapping[str, float]) -> None:
    if round(sum(weights.get(k, 0) for k in ("mean", "stddev", "kurtosis")), 3) != 1:
        raise ValueError("Metric weightages must add up to 1")


def check_threshold(threshold: float) -> None:
    if not 0 <= threshold <= 4:
        raise ValueError("threshold must be between 0 and 4")


_WEIGHTS = {"mean": 0.5, "stddev": 0.3, "kurtosis": 0.2}


def period_metrics(df: DataFrame, names: Sequence[str], idx_col: str, binary_cols: Columns = ()) -> DataFrame:
    """(idx, attribute, type, mean, stddev, kurtosis) of each period, in one aggregation."""
    binary = as_list(binary_cols)
    made = [f(col(c)).alias(f"{k}{i}") for i, c in enumerate(names) for k, f in (("m", F.avg), ("s", F.stddev_samp), ("k", F.kurtosis))]
    rows = F.array(*(F.struct(F.lit(c).alias("attribute"), F.lit("Binary" if c in binary else "Numerical").alias("type"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("stddev"), (F.col(f"k{i}") + 3).alias("kurtosis")) for i, c in enumerate(names)))
    return df.groupBy(col(idx_col).cast("string").alias("idx")).agg(*made).select("idx", F.inline(rows))


def stability_from_metrics(metrics: DataFrame, metric_weightages: Mapping[str, float] | None = None, threshold: float = 1) -> DataFrame:
    weights = dict(metric_weightages or _WEIGHTS)
    check_weights(weights)
    check_threshold(threshold)
    moments = [f(k).alias(f"{f.__name__}_{k}") for k in ("mean", "stddev", "kurtosis") for f in (F.stddev_samp, F.avg)]
    cv = {k: F.try_divide(F.col(f"stddev_samp_{k}"), F.col(f"avg_{k}")) for k in ("mean", "stddev", "kurtosis")}
    clean = lambda x: F.when(~F.isnan(x), x)
    found = metrics.groupBy("attribute", "type").agg(*moments).select("attribute", "type", F.col("stddev_samp_mean").alias("mean_stddev"), *(clean(v).alias(f"{k}_cv") for k, v in cv.items()))
    binary = F.col("type") == "Binary"
    si = {"mean": F.when(binary, score_sd(F.col("mean_stddev"))).otherwise(score_cv(F.col("mean_cv")))}
    si |= {k: F.when(~binary, score_cv(F.col(f"{k}_cv"))) for k in ("stddev", "kurtosis")}
    found = found.select("*", *(v.alias(f"{k}_si") for k, v in si.items()))
    index = F.when(binary, F.col("mean_si")).otherwise(F.round(sum(F.col(f"{k}_si") * weights.get(k, 0) for k in ("mean", "stddev", "kurtosis")), 4))
    rounded = [F.round(k, 4).alias(k) for k in ("mean_stddev", "mean_cv", "stddev_cv", "kurtosis_cv")]
    return found.select("attribute", "type", *rounded, "mean_si", "stddev_si", "kurtosis_si", index.alias("stability_index")).withColumn("flagged", F.when((F.col("stability_index") < threshold) | F.col("stability_index").isNull(), 1).otherwise(0))


def stability_index_computation(
    dfs: Sequence[DataFrame] | DataFrame, list_of_cols: Columns = "all", drop_cols: Columns = (), metric_weightages: Mapping[str, float] | None = None, binary_cols: Columns = (), existing_metric_path: str = "", appended_metric_path: str = "", threshold: float = 1, idx_col: str | None = None
) -> DataFrame:
    """How much mean, stddev and kurtosis of numeric columns vary over periods, scored from 0 to 4 and weighted.

    Periods: a list of frames, or one frame with ``idx_col``. History is a csv of (idx, attribute, type, mean, stddev, kurtosis).
    """
    check_weights(metric_weightages or _WEIGHTS)
    history = None
    if isinstance(dfs, DataFrame):
        names = resolve(dfs, list_of_cols, [*as_list(drop_cols), idx_col], type_classes(dfs)[0])
        spark, new = dfs.sparkSession, period_metrics(dfs, names, idx_col, binary_cols)
    else:
        names = resolve(dfs[0], list_of_cols, drop_cols, type_classes(dfs[0])[0])
        spark = dfs[0].sparkSession
        if existing_metric_path:
            last = spark.read.csv(existing_metric_path, header=True, inferSchema=True).agg(F.max(F.col("idx").cast("int"))).first()[0]
        first = (last or 0) + 1 if existing_metric_path else 1
        periods = [df.select(F.lit(first + i).alias("_idx"), *(col(c).cast("double").alias(c) for c in names)) for i, df in enumerate(dfs)]
        new = period_metrics(union_all(periods), names, "_idx", binary_cols)
    if existing_metric_path:
        history = spark.read.csv(existing_metric_path, header=True, schema="idx string, attribute string, type string, mean double, stddev double, kurtosis double")
        new = new.unionByName(history.where(F.col("attribute").isin(names)))
    if appended_metric_path:
        new.coalesce(1).write.mode("overwrite").csv(appended_metric_path, header=True)
    return stability_from_metrics(new, metric_weightages, threshold)


def feature_stability_estimation(attribute_stats: DataFrame, attribute_transformation: Mapping[str, str], metric_weightages: Mapping[str, float] | None = None, threshold: float = 1) -> DataFrame:
    """Stability of features that are formulas of attributes, by the delta method on the attributes' mean and stddev per period.

    ``attribute_stats`` has a row per period and attribute, so it is read on the driver.
    """
    from statistics import fmean, pstdev

    from strataforge.functions.formula import parse

    weights = dict(metric_weightages or _WEIGHTS)
    check_weights(weights)
    check_threshold(threshold)
    stats = {(str(r["idx"]), r["attribute"]): (r["mean"], r["stddev"]) for r in attribute_stats.select("idx", "attribute", "mean", "stddev").collect()}
    periods = sorted({k[0] for k in stats}, key=lambda x: (len(x), x))
    rows = []
    for listed, text in attribute_transformation.items():
        names, formula = as_list(listed), parse(text)
        means, deviations = [], []
        for t in periods:
            if any((t, a) not in stats for a in names):
                raise TypeError("attribute_stats must have every attribute in every period")
            at = {a: float(stats[t, a][0]) for a in names}
            mean, var = formula(at), 0.0
            for a in names:
                s2 = float(stats[t, a][1]) ** 2
                d1 = formula.derivative(a)
                mean += s2 * d1.derivative(a)(at) / 2
                var += s2 * d1(at) ** 2
            means.append(mean)
            deviations.append(var**0.5)
        cv = [round(pstdev(v) / fmean(v), 4) if fmean(v) else None for v in (means, deviations)]
        rows.append((text, *cv))
    out = model_frame(attribute_stats, rows, "feature_formula string, mean_cv double, stddev_cv double")
    out = out.withColumns({"mean_si": score_cv(F.col("mean_cv")).cast("int"), "stddev_si": score_cv(F.col("stddev_cv")).cast("int")})
    low = F.round(F.col("mean_si") * weights.get("mean", 0) + F.col("stddev_si") * weights.get("stddev", 0), 4)
    out = out.withColumn("stability_index_lower_bound", low).withColumn("stability_index_upper_bound", F.round(low + 4 * weights.get("kurtosis", 0), 4))
    flag = lambda c: F.when((F.col(c) < threshold) | F.col(c).isNull(), 1).otherwise(0)
    return out.withColumns({"flagged_lower": flag("stability_index_lower_bound"), "flagged_upper": flag("stability_index_upper_bound")})
