"""Time-series columns: detection, eligibility, profile by grain, decomposition and stationarity."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataforge.functions.columns import Columns, as_list, col, resolve, type_classes

#: Text formats that are tried, in this order; the first that fits a value counts.
FORMATS = (
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd",
    "yyyy/MM/dd HH:mm:ss",
    "yyyy/MM/dd",
    "dd-MM-yyyy HH:mm:ss",
    "dd-MM-yyyy",
    "dd/MM/yyyy HH:mm:ss",
    "dd/MM/yyyy",
    "MM/dd/yyyy HH:mm:ss",
    "MM/dd/yyyy",
    "dd.MM.yyyy",
    "d MMM yyyy",
    "d MMMM yyyy",
    "MMM d, yyyy",
    "MMMM d, yyyy",
    "yyyyMMdd",
    "yyyyMM",
    "yyyy-MM",
    "HH:mm:ss",
)
_LENGTHS = (4, 6, 8, 10, 13)


def candidates(df: DataFrame, id_col: str | None = None) -> dict[str, str]:
    """Columns that may hold times: ``dt`` (already do), ``string``, ``string_c``/``int_c``/``bigint_c`` (one length of 4, 6, 8, 10 or 13)."""
    names = [c for c in df.columns if c != id_col]
    kinds = {f.name: f.dataType for f in df.schema}
    found = {c: "dt" for c in names if isinstance(kinds[c], T.DateType | T.TimestampType | T.TimestampNTZType)}
    rest = [c for c in names if isinstance(kinds[c], T.StringType | T.IntegerType | T.LongType)]
    if rest:
        row = df.agg(*(f(F.length(col(c).cast("string"))).alias(f"{k}{i}") for i, c in enumerate(rest) for k, f in (("lo", F.min), ("hi", F.max)))).first()
        for i, c in enumerate(rest):
            same = row[f"lo{i}"] is not None and row[f"lo{i}"] == row[f"hi{i}"] and row[f"lo{i}"] in _LENGTHS
            kind = kinds[c].simpleString()
            if same:
                found[c] = kind + "_c"
            elif kind == "string" and row[f"hi{i}"] is not None:
                found[c] = "string"
    return found


def as_timestamp(value: Column, formats: Sequence[str] = FORMATS) -> Column:
    """A timestamp from text or number: seconds (10 digits), milliseconds (13), dates by the formats; null where none fits."""
    text = F.trim(value.cast("string"))
    epoch = F.when(text.rlike("^[0-9]{10}$"), F.timestamp_seconds(text.try_cast("bigint"))).when(text.rlike("^[0-9]{13}$"), F.timestamp_millis(text.try_cast("bigint")))
    year = F.when(text.rlike("^(19|20)[0-9]{2}$"), F.make_timestamp(text.try_cast("int"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    return F.coalesce(epoch, year, *(F.try_to_timestamp(text, F.lit(p)) for p in formats))


def detect_timestamps(df: DataFrame, id_col: str | None = None, threshold: float = 0.9, output_mode: str = "replace") -> tuple[DataFrame, dict[str, str]]:
    """Converts the candidates of which ``threshold`` of the values read as times; one aggregation decides for all."""
    found = candidates(df, id_col)
    tried = [c for c, k in found.items() if k != "dt"]
    if tried:
        row = df.agg(*(F.avg(F.when(col(c).isNotNull(), as_timestamp(col(c)).isNotNull().cast("double"))).alias(f"_{i}") for i, c in enumerate(tried))).first()
        good = [c for i, c in enumerate(tried) if (row[f"_{i}"] or 0) >= threshold]
    else:
        good = []
    made = {c if output_mode == "replace" else c + "_ts": as_timestamp(col(c)) for c in good}
    return df.withColumns(made), {c: k for c, k in found.items() if k == "dt" or c in good}


def daypart(hour: Column) -> Column:
    return (
        F.when(hour.isNull(), "Missing_NA")
        .when(hour.between(4, 6), "early_hours")
        .when(hour.between(10, 16), "work_hours")
        .when(hour.between(20, 23), "late_hours")
        .when(hour.between(7, 9) | hour.between(17, 19), "commuting_hours")
        .otherwise("other_hours")
    )


def processed_features(df: DataFrame, time_col: str) -> DataFrame:
    """All parts of the time, its day as ``yyyymmdd_col``, ``daypart_cat``, ``week_cat`` (weekend: Saturday, Sunday) and ``dow``."""
    t = col(time_col)
    parts = {u: getattr(F, u)(t) for u in ("hour", "minute", "second", "dayofmonth", "dayofweek", "dayofyear", "weekofyear", "month", "quarter", "year")}
    return df.withColumns({**parts, "yyyymmdd_col": t.cast("date"), "daypart_cat": daypart(F.hour(t)), "week_cat": F.when(F.dayofweek(t).isin(1, 7), "weekend").otherwise("weekday"), "dow": F.date_format(t, "EEE")})


def eligibility(df: DataFrame, id_col: str, time_col: str, opt: int = 1) -> DataFrame:
    """1: percentiles of dates per id and ids per date; 2: dates, first, last and modal date, and the gaps between dates."""
    day = df.select(col(id_col).alias("id"), col(time_col).cast("date").alias("d")).where("d is not null")
    if opt == 1:
        probs = [0.0, 0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0]

        def spread(key: str, of: str, name: str) -> DataFrame:
            per = day.groupBy(key).agg(F.count_distinct(of).alias("n"))
            return per.agg(F.percentile_approx("n", probs, 100_000).alias("q")).select(F.lit(name).alias("metric"), *(F.col("q")[i].alias(f"p{round(p * 100)}") for i, p in enumerate(probs)))

        return spread("id", "d", "id_date_pair").union(spread("d", "id", "date_id_pair"))
    dates = day.groupBy("d").agg(F.count(F.lit(1)).alias("n"))
    gaps = dates.withColumn("gap", F.datediff("d", F.lag("d").over(Window.orderBy("d"))))  # one row per date
    return gaps.agg(
        F.count(F.lit(1)).alias("count_unique_dates"),
        F.min("d").alias("min_date"),
        F.max("d").alias("max_date"),
        F.max(F.struct("n", "d"))["d"].alias("modal_date"),
        F.round(F.avg("gap"), 3).alias("mean"),
        F.round(F.var_samp("gap"), 3).alias("variance"),
        F.round(F.stddev_samp("gap"), 3).alias("stdev"),
        F.round(F.try_divide(F.stddev_samp("gap"), F.avg("gap")), 3).alias("cov"),
    )


def _grain(time_col: str, output_type: str) -> Column:
    t = col(time_col)
    if output_type == "daily":
        return t.cast("date")
    if output_type == "hourly":
        return daypart(F.hour(t))
    if output_type == "weekly":
        return F.dayofweek(t)
    raise TypeError("Invalid input for output_type")


def profile(df: DataFrame, time_col: str, value_col: str, output_type: str = "daily", n_cat: int = 10) -> DataFrame:
    """By day, part of the day or day of the week: min, max, mean and median of a number; the rows of the ``n_cat`` most frequent categories
    and of the others."""
    grain = _grain(time_col, output_type).alias(time_col)
    if value_col in type_classes(df)[0]:
        v = col(value_col)
        return df.groupBy(grain).agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.percentile(v, 0.5).alias("median"))
    counts = df.groupBy(col(value_col)).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), col(value_col)).limit(n_cat)
    top = [r[0] for r in counts.collect()]
    label = F.when(col(value_col).isin([x for x in top if x is not None]), col(value_col)).otherwise("Others")
    return df.groupBy(grain, label.alias(value_col)).agg(F.count(F.lit(1)).alias("count"))


def ts_analyzer(df: DataFrame, id_col: str, output_type: Columns = "daily", max_days: int = 3600, columns: Columns = "all") -> dict[tuple[str, str, str], DataFrame]:
    """``profile`` of every time column with every number and string, the last ``max_days`` of daily ones."""
    times = [c for c, k in candidates(df, id_col).items() if k == "dt"]
    values = [c for c in resolve(df, columns, [id_col]) if c not in times]
    out = {}
    for t in times:
        for v in values:
            for kind in as_list(output_type):
                p = profile(df, t, v, kind)
                out[t, v, kind] = p.orderBy(F.desc(t)).limit(max_days) if kind == "daily" else p
    return out


def decomposition(df: DataFrame, time_col: str, value_col: str, period: int = 12) -> DataFrame:
    """(time, value, trend, seasonal, residual) of a series of one row per time, the same additive way as ``seasonal_decompose``.

    The series is a profile by day, so windows over all of it are over as many rows as there are days.
    """
    w = Window.orderBy(time_col)
    half = period // 2
    inner = F.sum("value").over(w.rowsBetween(1 - half if period % 2 == 0 else -half, half - 1 if period % 2 == 0 else half))
    ends = F.lag("value", half).over(w) + F.lead("value", half).over(w)
    whole = F.count("value").over(w.rowsBetween(-half, half)) == 2 * half + 1
    x = df.select(col(time_col).alias(time_col), col(value_col).cast("double").alias("value")).withColumn("_phase", F.pmod(F.row_number().over(w) - 1, F.lit(period)))
    x = x.withColumn("trend", F.when(whole, (inner + ends / 2) / period if period % 2 == 0 else inner / period))
    x = x.withColumn("_mean", F.coalesce(F.avg(F.col("value") - F.col("trend")).over(Window.partitionBy("_phase")), F.lit(0.0)))
    level = x.select("_phase", "_mean").distinct().agg(F.avg("_mean").alias("_level"))
    x = x.join(F.broadcast(level)).withColumn("seasonal", F.col("_mean") - F.col("_level"))
    return x.select(time_col, "value", "trend", "seasonal", (F.col("value") - F.col("trend") - F.col("seasonal")).alias("residual"))


def seasonal_decompose(values: Sequence[float], period: int = 12) -> dict[str, np.ndarray]:
    """Additive decomposition: a centred moving average, the mean of each phase around it, and what is left."""
    x = np.asarray(values, float)
    weight = np.ones(period) if period % 2 else np.r_[0.5, np.ones(period - 1), 0.5]
    half = len(weight) // 2
    trend = np.full(len(x), np.nan)
    if len(x) >= len(weight):
        trend[half : len(x) - half] = np.convolve(x, weight / weight.sum(), "valid")
    rest = x - trend
    phase = np.array([np.nanmean(rest[k::period]) if np.isfinite(rest[k::period]).any() else 0.0 for k in range(period)])
    seasonal = (phase - phase.mean())[np.arange(len(x)) % period]
    return {"trend": trend, "seasonal": seasonal, "residual": rest - seasonal}


def stationarity(values: Sequence[float]) -> dict[str, float]:
    """The Dickey-Fuller statistic with lags, the KPSS statistic for a level, and Yeo-Johnson's lambda by likelihood."""
    x = np.asarray(values, float)
    n, lags = len(x), int(12 * (len(x) / 100) ** 0.25) if len(x) > 20 else 1
    d = np.diff(x)
    lags = max(0, min(lags, len(d) // 2 - 2))
    y = d[lags:]
    a = np.column_stack([np.ones(len(y)), x[lags:-1], *(d[lags - k : -k] for k in range(1, lags + 1))])
    beta, *_ = np.linalg.lstsq(a, y, rcond=None)
    left = y - a @ beta
    s2 = left @ left / max(1, len(y) - a.shape[1])
    adf = beta[1] / np.sqrt(s2 * np.linalg.pinv(a.T @ a)[1, 1])
    e = x - x.mean()
    m = int(np.ceil(12 * (n / 100) ** 0.25))
    long_run = (e @ e + 2 * sum((1 - k / (m + 1)) * (e[k:] @ e[:-k]) for k in range(1, min(m, n - 1) + 1))) / n
    kpss = (np.cumsum(e) ** 2).sum() / (n * n * long_run)

    def likelihood(lam: float) -> float:
        p, q = x >= 0, x < 0
        z = np.empty(n)
        z[p] = np.log1p(x[p]) if abs(lam) < 1e-9 else ((x[p] + 1) ** lam - 1) / lam
        z[q] = -np.log1p(-x[q]) if abs(lam - 2) < 1e-9 else -((1 - x[q]) ** (2 - lam) - 1) / (2 - lam)
        v = z.var()
        return -n / 2 * np.log(v) + (lam - 1) * (np.sign(x) * np.log1p(np.abs(x))).sum() if v > 0 else -np.inf

    grid = np.linspace(-4, 4, 801)
    return {"adf": float(adf), "kpss": float(kpss), "yeo_johnson_lambda": float(grid[int(np.argmax([likelihood(v) for v in grid]))])}
