"""Data quality: detection with statistics, and treatment on request. Every function returns (treated frame, statistics)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataforge.functions.columns import ACCURACY, Columns, col, discrete, model_frame, numeric_columns, per_attribute, place, quantiles, resolve
from strataforge.operators import stats


def duplicate_detection(df: DataFrame, list_of_cols: Columns = "all", drop_cols: Columns = (), treatment: bool = True, keep_columns: bool = False) -> tuple[DataFrame, DataFrame]:
    """The treated frame has the listed columns only, unless ``keep_columns``."""
    names = resolve(df, list_of_cols, drop_cols, df.columns)
    part = df.select(*(col(c) for c in names))
    groups = part.groupBy(*(col(c) for c in names)).agg(F.count(F.lit(1)).alias("_n"))
    summed = groups.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("double").alias("rows"), F.count(F.lit(1)).cast("double").alias("uniq"))
    pct = F.coalesce(F.round(F.try_divide(F.col("rows") - F.col("uniq"), F.col("rows")), 4), F.lit(0.0))
    pairs = (("rows_count", F.col("rows")), ("unique_rows_count", F.col("uniq")), ("duplicate_rows", F.col("rows") - F.col("uniq")), ("duplicate_pct", pct))
    found = summed.select(F.inline(F.array(*(F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in pairs))))
    out = (df.dropDuplicates(names) if keep_columns else part.distinct()) if treatment else df
    return out, found


def null_rows_detection(df: DataFrame, list_of_cols: Columns = "all", drop_cols: Columns = (), treatment: bool = False, treatment_threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Rows by their number of nulls; flagged over ``treatment_threshold`` of the columns (all of them if it is 1)."""
    names = resolve(df, list_of_cols, drop_cols, df.columns)
    if not 0 <= float(treatment_threshold) <= 1:
        raise TypeError("Invalid input for treatment_threshold")
    nulls = reduce(lambda a, b: a + b, (col(c).isNull().cast("int") for c in names))
    n = len(names)
    over = (nulls == n) if treatment_threshold == 1 else (nulls > n * float(treatment_threshold))
    found = df.select(nulls.alias("null_cols_count"), over.cast("int").alias("f")).groupBy("null_cols_count", "f").agg(F.count(F.lit(1)).alias("row_count"))
    total = found.agg(F.sum("row_count").alias("_t"))
    mark = "treated" if treatment else "flagged"
    stats_ = found.join(F.broadcast(total)).select("null_cols_count", "row_count", F.round(F.col("row_count") / F.col("_t"), 4).alias("row_pct"), F.col("f").alias(mark))
    return (df.where(~over) if treatment else df), stats_


def null_columns_detection(df: DataFrame, list_of_cols: Columns = "missing", drop_cols: Columns = (), treatment: bool = False, treatment_method: str = "row_removal", treatment_configs: Mapping | None = None) -> tuple[DataFrame, DataFrame]:
    """Missing values by column; ``missing`` lists the columns that have some. Treatments: row_removal, column_removal
    (``treatment_threshold``), and the imputers MMM, KNN, regression, MF and auto with their configs."""
    found = stats.missing_count(df, df.columns)
    configs = dict(treatment_configs or {})
    rows = {r["attribute"]: r for r in found.collect()}
    if list_of_cols == "missing":
        names = [c for c in df.columns if rows[c]["missing_count"] > 0 and c not in resolve(df, drop_cols, (), df.columns, empty_ok=True)]
    else:
        names = resolve(df, list_of_cols, drop_cols, df.columns)
    listed = found.where(F.col("attribute").isin(names)) if names else found.where("false")
    if not treatment or not names:
        return df, listed
    from strataforge.operators import imputation

    threshold = configs.pop("treatment_threshold", None)
    if threshold is not None:
        over = [c for c in names if rows[c]["missing_pct"] > float(threshold)]
    if treatment_method == "column_removal":
        if threshold is None:
            raise TypeError("Invalid input for column removal threshold")
        return df.drop(*over), listed
    if threshold is not None:
        names = over
    if treatment_method == "row_removal":
        return df.dropna(subset=names), listed
    if treatment_method == "MMM":
        return imputation.impute_mmm(df, names, **configs), listed
    if treatment_method in ("KNN", "regression"):
        return imputation.impute_model(df, names, method_type=treatment_method, **configs), listed
    if treatment_method == "MF":
        return imputation.impute_factorization(df, names, **configs), listed
    if treatment_method == "auto":
        return imputation.auto_imputation(df, names, **configs), listed
    raise TypeError("Invalid input for method_type")


_OUTLIER = {"pctile_lower": 0.05, "pctile_upper": 0.95, "stdev_lower": 3.0, "stdev_upper": 3.0, "IQR_lower": 1.5, "IQR_upper": 1.5, "min_validation": 2}


def outlier_bounds(df: DataFrame, names: Sequence[str], detection_side: str, configs: Mapping, accuracy: int = ACCURACY) -> tuple[dict[str, tuple], list[str]]:
    """(lower, upper) per column, and the columns left out as skewed, whose two percentiles are equal. Of the bounds that the methods
    give on a side the ``min_validation``-th strictest counts."""
    if detection_side not in ("lower", "upper", "both"):
        raise TypeError("Invalid input for detection_side")
    sides = ("lower", "upper") if detection_side == "both" else (detection_side,)
    methods = []
    for m in ("pctile", "stdev", "IQR"):
        given = [f"{m}_{s}" in configs for s in sides]
        if any(given) != all(given):
            raise TypeError("Both sides need the same methods")
        if all(given):
            methods.append(m)
    n = int(configs.get("min_validation", len(methods)))
    if not methods or n > len(methods):
        raise TypeError("Invalid input for min_validation")
    p = [configs.get("pctile_lower", 0.05), configs.get("pctile_upper", 0.95)]
    found = quantiles(df, names, [*p, 0.25, 0.75], accuracy)
    spread = df.agg(*(f(col(c).cast("double")).alias(f"{k}{i}") for i, c in enumerate(names) for k, f in (("m", F.avg), ("s", F.stddev_samp)))).first()
    bounds, skewed = {}, []
    for i, c in enumerate(names):
        q = found[c]
        if q is None or q[0] == q[1]:
            skewed.append(c)
            continue
        low, high = [], []
        if "pctile" in methods:
            low.append(q[0])
            high.append(q[1])
        if "stdev" in methods and spread[f"s{i}"] is not None:
            low.append(spread[f"m{i}"] - configs.get("stdev_lower", 0.0) * spread[f"s{i}"])
            high.append(spread[f"m{i}"] + configs.get("stdev_upper", 0.0) * spread[f"s{i}"])
        if "IQR" in methods:
            low.append(q[2] - configs.get("IQR_lower", 0.0) * (q[3] - q[2]))
            high.append(q[3] + configs.get("IQR_upper", 0.0) * (q[3] - q[2]))
        low, high = sorted(low, reverse=True), sorted(high)
        bounds[c] = (low[min(n, len(low)) - 1] if "lower" in sides else None, high[min(n, len(high)) - 1] if "upper" in sides else None)
    return bounds, skewed


def outlier_detection(
    df: DataFrame, list_of_cols: Columns = "all", drop_cols: Columns = (), detection_side: str = "upper", detection_configs: Mapping | None = None, treatment: bool = True, treatment_method: str = "value_replacement", pre_existing_model: bool = False, model_path: str = "NA", sample_size: int | None = None, output_mode: str = "replace", accuracy: int = ACCURACY
) -> tuple[DataFrame, DataFrame]:
    """Marks -1 below, 1 above, 0 else (nulls too). Treatments: value_replacement, null_replacement, row_removal. Bounds are fitted on
    all rows, or on ``sample_size`` where one is given; all rows are marked."""
    names = numeric_columns(df, list_of_cols, drop_cols)
    if treatment_method not in ("value_replacement", "null_replacement", "row_removal"):
        raise TypeError("Invalid input for treatment_method")
    if pre_existing_model:
        model = {r["attribute"]: r["parameters"] for r in df.sparkSession.read.parquet(model_path + "/outlier_numcols").collect()}
        skewed = [c for c in names if c in model and "skewed_attribute" in (model[c] or [])]
        bounds = {c: tuple(None if v is None else float(v) for v in model[c]) for c in names if c in model and c not in skewed}
    else:
        rows = df.count() if sample_size else 0
        fit = df.sample(False, sample_size / rows, 11) if sample_size and rows > sample_size else df
        bounds, skewed = outlier_bounds(fit.select(*(col(c) for c in names)), names, detection_side, detection_configs if detection_configs is not None else _OUTLIER, accuracy)
        if model_path != "NA":
            none = ["skewed_attribute" if detection_side in (s, "both") else None for s in ("lower", "upper")]
            saved = [(c, [None if v is None else repr(v) for v in b]) for c, b in bounds.items()] + [(c, none) for c in skewed]
            model_frame(df, saved, "attribute string, parameters array<string>").coalesce(1).write.mode("overwrite").parquet(model_path + "/outlier_numcols")

    def mark(c: str) -> Column:
        low, high = bounds[c]
        out = F.lit(0)
        if high is not None:
            out = F.when(col(c) > high, 1).otherwise(out)
        return F.when(col(c) < low, -1).otherwise(out) if low is not None else out

    measures = {
        "lower_outliers": lambda c: F.count_if(mark(c) == -1) if c in bounds else F.lit(0),
        "upper_outliers": lambda c: F.count_if(mark(c) == 1) if c in bounds else F.lit(0),
        "excluded_due_to_skewness": lambda c: F.max(F.lit(int(c in skewed))),
    }
    found = per_attribute(df, [c for c in names if c in bounds or c in skewed], measures, "lower_outliers bigint, upper_outliers bigint, excluded_due_to_skewness int")
    found = found.fillna(0)
    if not treatment:
        return df, found
    if treatment_method == "row_removal":
        keep = reduce(lambda a, b: a & b, ((mark(c) == 0) for c in bounds), F.lit(True))
        return df.where(keep), found
    new = {}
    for c, (low, high) in bounds.items():
        low_v, high_v = (F.lit(low), F.lit(high)) if treatment_method == "value_replacement" else (F.lit(None), F.lit(None))
        new[c] = F.when(mark(c) == 1, high_v).when(mark(c) == -1, low_v).otherwise(col(c))
    return place(df, new, "_outliered", output_mode), found


def idness_detection(df: DataFrame, list_of_cols: Columns = "all", drop_cols: Columns = (), treatment: bool = False, treatment_threshold: float = 0.8, use_approx_unique_count: bool = False) -> tuple[DataFrame, DataFrame]:
    """Discrete columns whose IDness reaches the threshold; the treatment drops them."""
    names = resolve(df, list_of_cols, drop_cols, discrete(df))
    mark = "treated" if treatment else "flagged"
    found = stats.measures_of_cardinality(df, names, (), use_approx_unique_count).withColumn(mark, F.when(F.col("IDness") >= treatment_threshold, 1).otherwise(0))
    return (df.drop(*(r["attribute"] for r in found.where(F.col(mark) == 1).collect())) if treatment else df), found


def biasedness_detection(df: DataFrame, list_of_cols: Columns = "all", drop_cols: Columns = (), treatment: bool = False, treatment_threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Discrete columns whose mode has a share of the threshold or more, or that have no mode; the treatment drops them."""
    names = resolve(df, list_of_cols, drop_cols, discrete(df))
    mark = "treated" if treatment else "flagged"
    central = stats.central_tendency(df, names).select("attribute", "mode", "mode_rows", "mode_pct")
    found = central.withColumn(mark, F.when((F.col("mode_pct") >= treatment_threshold) | F.col("mode_pct").isNull(), 1).otherwise(0))
    return (df.drop(*(r["attribute"] for r in found.where(F.col(mark) == 1).collect())) if treatment else df), found


#: Texts that stand for no value, and single marks that are none.
NULL_VOCABULARY = ["", " ", "nan", "null", "na", "inf", "n/a", "not defined", "none", "undefined", "blank", "unknown"]
MARK_VOCABULARY = ["&", "$", ";", ":", ".", ",", "*", "#", "@", "_", "?", "%", "!", "^", "(", ")", "-", "/", "'"]


def _suspect(value: Column) -> Column:
    """A stand-in for null, a lone mark, a word of one character three times or more, or characters that count upwards."""
    n = F.length(value)
    steps = F.sequence(F.lit(2), F.greatest(n, F.lit(2)))
    rising = (n >= 3) & F.forall(steps, lambda i: F.ascii(F.substr(value, i, F.lit(1))) - F.ascii(F.substr(value, i - 1, F.lit(1))) == 1)
    return value.isin(NULL_VOCABULARY + MARK_VOCABULARY) | value.rlike(r"\b([a-zA-Z0-9])\1\1+\b") | rising


def invalid_entries_detection(
    df: DataFrame,
    list_of_cols: Columns = "all",
    drop_cols: Columns = (),
    detection_type: str = "auto",
    invalid_entries: Sequence[str] = (),
    valid_entries: Sequence[str] = (),
    partial_match: bool = False,
    treatment: bool = False,
    treatment_method: str = "null_replacement",
    treatment_configs: Mapping | None = None,
    output_mode: str = "replace",
) -> tuple[DataFrame, DataFrame]:
    """Values that look like none (auto), match one of ``invalid_entries`` or none of ``valid_entries`` (manual), or either (both), in lower
    case without white space around. Statistics list the distinct invalid values in order, joined by ``|``."""
    if detection_type not in ("auto", "manual", "both"):
        raise TypeError("Invalid input for detection_type")
    names = resolve(df, list_of_cols, drop_cols, discrete(df) if list_of_cols == "all" else df.columns)

    def matches(value: Column, patterns: Sequence[str]) -> Column:
        return reduce(lambda a, b: a | b, (value.rlike(p if partial_match else f"^(?:{p})$") for p in patterns), F.lit(False))

    def invalid(c: str) -> Column:
        value = F.lower(F.trim(col(c).cast("string")))
        bad = F.lit(False)
        if detection_type != "manual":
            bad = bad | _suspect(value)
        if detection_type != "auto":
            bad = bad | matches(value, invalid_entries)
            if valid_entries:
                bad = bad | ~matches(value, valid_entries)
        return F.coalesce(bad, F.lit(False))

    marked = df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("attribute"), col(c).cast("string").alias("value"), invalid(c).alias("bad")) for c in names))))
    by_value = marked.groupBy("attribute", F.when(F.col("bad"), F.col("value")).alias("value")).agg(F.count_if("bad").alias("n"), F.count(F.lit(1)).alias("rows"))
    found = by_value.groupBy("attribute").agg(F.array_join(F.array_sort(F.collect_list("value")), "|").alias("invalid_entries"), F.sum("n").alias("invalid_count"), F.round(F.sum("n") / F.sum("rows"), 4).alias("invalid_pct"))
    if not treatment:
        return df, found
    configs = dict(treatment_configs or {})
    if treatment_method == "column_removal":
        if "treatment_threshold" not in configs:
            raise TypeError("Invalid input for column removal threshold")
        return df.drop(*(r["attribute"] for r in found.where(F.col("invalid_pct") > configs["treatment_threshold"]).collect())), found
    cleaned = place(df, {c: F.when(~invalid(c), col(c)) for c in names}, "_invalid", output_mode)
    if treatment_method == "null_replacement":
        return cleaned, found
    if treatment_method == "MMM":
        from strataforge.operators.imputation import impute_mmm

        configs.pop("treatment_threshold", None)
        return impute_mmm(cleaned, names if output_mode == "replace" else [c + "_invalid" for c in names], **configs), found
    raise TypeError("Invalid input for treatment_method")
