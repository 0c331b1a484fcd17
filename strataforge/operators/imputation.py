"""Imputers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataforge.functions.columns import ACCURACY, Columns, col, model_frame, place, quantiles, resolve, type_classes, union_all
from strataforge.operators import stats
from strataforge.sources.staging import numbered, stage

#: ALS takes ids of 31 bits.
MOST_IDS = 2**31 - 1


def _missing(df: DataFrame, list_of_cols: Columns, drop_cols: Columns, numeric_only: bool) -> list[str]:
    numeric, text, _ = type_classes(df)
    allowed = numeric if numeric_only else [c for c in df.columns if c in numeric or c in text]
    if list_of_cols != "missing":
        return resolve(df, list_of_cols, drop_cols, allowed, empty_ok=True)
    names = resolve(df, "all", drop_cols, allowed, empty_ok=True)
    if not names:
        return []
    row = df.agg(*(F.count_if(col(c).isNull()).alias(f"_{i}") for i, c in enumerate(names))).first()
    return [c for i, c in enumerate(names) if row[f"_{i}"]]


def impute_mmm(df: DataFrame, list_of_cols: Columns = "missing", drop_cols: Columns = (), method_type: str = "median", pre_existing_model: bool = False, model_path: str = "NA", output_mode: str = "replace", accuracy: int = ACCURACY) -> DataFrame:
    """Nulls of numeric columns by mean, median or mode, of string columns by mode; whole-number columns keep their type."""
    if method_type not in ("mean", "median", "mode"):
        raise TypeError("Invalid input for method_type")
    names = _missing(df, list_of_cols, drop_cols, False)
    if not names:
        return df
    numeric = [c for c in names if c in type_classes(df)[0]]
    path = model_path + "/imputation_MMM"
    if pre_existing_model:
        values = {r["attribute"]: r["value"] for r in df.sparkSession.read.parquet(path).collect()}
    else:
        by_mode = names if method_type == "mode" else [c for c in names if c not in numeric]
        values = {r["attribute"]: r["mode"] for r in stats.mode(df, by_mode).collect()} if by_mode else {}
        rest = [c for c in names if c not in by_mode]
        if rest and method_type == "mean":
            row = df.agg(*(F.avg(col(c).cast("double")).alias(f"_{i}") for i, c in enumerate(rest))).first()
            values |= {c: None if row[f"_{i}"] is None else repr(row[f"_{i}"]) for i, c in enumerate(rest)}
        elif rest:
            values |= {c: None if q is None else repr(q[0]) for c, q in quantiles(df, rest, [0.5], accuracy).items()}
        if model_path != "NA":
            model_frame(df, list(values.items()), "attribute string, value string").coalesce(1).write.mode("overwrite").parquet(path)
    kinds = dict(df.dtypes)
    made = {}
    for c in names:
        fill = F.lit(values.get(c))
        if c in numeric:
            fill = fill.cast("double").cast(kinds[c]) if kinds[c] != "string" else fill
        made[c] = F.coalesce(col(c), fill)
    return place(df, made, "_imputed", output_mode)


def _neighbours(fit: np.ndarray, x: np.ndarray, k: int = 5) -> np.ndarray:
    """Nulls of ``x`` by the mean of the ``k`` nearest fitted rows that have the value; distances over shared columns, scaled up."""
    out, gaps = x.copy(), np.isnan(x)
    known, means = ~np.isnan(fit), np.nanmean(fit, axis=0)
    filled = np.where(known, fit - means, 0)
    some = np.flatnonzero(gaps.any(1))
    for at in range(0, len(some), 256):  # distances of 256 rows to all fitted ones as products of matrices
        rows = some[at : at + 256]
        have = (~gaps[rows]).astype(float)
        here = np.where(gaps[rows], 0, x[rows] - means)
        shared = have @ known.T
        d = have @ (filled**2).T - 2 * here @ filled.T + (here**2) @ known.T
        d = np.where(shared > 0, np.maximum(d, 0) * x.shape[1] / np.maximum(shared, 1), np.inf)
        for j in np.flatnonzero(gaps[rows].any(0)):
            can, mine = np.flatnonzero(known[:, j]), np.flatnonzero(gaps[rows, j])
            if len(can) == 0:
                out[rows[mine], j] = means[j]
                continue
            dist = d[np.ix_(mine, can)]
            order = np.argpartition(dist, min(k, len(can)) - 1, axis=1)[:, :k]
            used = np.isfinite(np.take_along_axis(dist, order, 1))
            total = np.where(used, fit[can, j][order], 0).sum(1)
            out[rows[mine], j] = np.where(used.any(1), total / np.maximum(used.sum(1), 1), means[j])
    return out


def _regressions(fit: np.ndarray, rounds: int = 10) -> tuple[np.ndarray, list[np.ndarray]]:
    """Column means, and for each column the ridge coefficients on the others, from rounds of filling in."""
    mean = np.nan_to_num(np.nanmean(fit, axis=0))
    x, gap = np.where(np.isnan(fit), mean, fit), np.isnan(fit)
    beta = [np.zeros(fit.shape[1]) for _ in range(fit.shape[1])]
    for _ in range(rounds):
        for j in range(fit.shape[1]):
            others = np.delete(x, j, 1)
            a = np.c_[np.ones(len(x)), others]
            use = ~gap[:, j]
            beta[j] = np.linalg.solve(a[use].T @ a[use] + 1e-6 * np.eye(a.shape[1]), a[use].T @ x[use, j])
            x[gap[:, j], j] = a[gap[:, j]] @ beta[j]
    return mean, beta


def impute_model(df: DataFrame, list_of_cols: Columns = "missing", drop_cols: Columns = (), missing_threshold: float = 1.0, method_type: str = "regression", sample_size: int = 10_000, sample_seed: int = 42, output_mode: str = "replace") -> DataFrame:
    """``KNN`` (5 neighbours) or ``regression`` (each column on the others, in rounds), fitted on at most ``sample_size`` rows of all numeric
    columns and applied to every row in batches. Columns missing in ``missing_threshold`` of the rows or more are left out."""
    if method_type not in ("KNN", "regression"):
        raise TypeError("Invalid input for method_type")
    names = _missing(df, list_of_cols, drop_cols, True)
    numeric = type_classes(df)[0]
    shares = {r["attribute"]: r["missing_pct"] for r in stats.missing_count(df, numeric).collect()}
    used = [c for c in numeric if shares[c] < missing_threshold and shares[c] < 1]
    names = [c for c in names if c in used]
    if not names:
        return df
    rows = df.count()
    part = df.select(*(col(c).cast("double").alias(c) for c in used))
    fit = (part.sample(False, sample_size / rows, sample_seed) if rows > sample_size else part).toPandas().to_numpy(float)
    mean, beta = _regressions(fit) if method_type == "regression" else (None, None)
    at = [used.index(c) for c in names]

    @F.pandas_udf("array<double>")
    def fill(columns: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for one in columns:
            x = np.stack([c.to_numpy(float) for c in one], 1)
            if method_type == "KNN":
                y = _neighbours(fit, x)
            else:
                gap, y = np.isnan(x), np.where(np.isnan(x), mean, x)
                for _ in range(3):
                    for j in at:
                        made = np.c_[np.ones(len(y)), np.delete(y, j, 1)] @ beta[j]
                        y[gap[:, j], j] = made[gap[:, j]]
            yield pd.Series(list(y[:, at]))

    kinds = dict(df.dtypes)
    full = df.withColumn("_y", fill(*(col(c).cast("double") for c in used)))
    made = {c: F.coalesce(col(c), F.col("_y")[i].cast(kinds[c])) for i, c in enumerate(names)}
    return place(full, made, "_imputed", output_mode).drop("_y")


def impute_factorization(df: DataFrame, list_of_cols: Columns = "missing", drop_cols: Columns = (), id_col: str = "", output_mode: str = "replace", rank: int = 10, iterations: int = 20, seed: int = 7) -> DataFrame:
    """Alternating least squares on (row, column, standardised value); rows without any value keep their nulls.

    Rows are staged and numbered without gaps, which makes their numbers ids for ALS; tables of over 2^31 - 1 rows are fitted in
    as many parts as that needs.
    """
    from pyspark.ml.recommendation import ALS

    names = _missing(df, list_of_cols, drop_cols, True)
    numeric = [c for c in type_classes(df)[0] if c != id_col]
    names = [c for c in names if c in numeric]
    if not names:
        return df
    keyed = stage(numbered(df, "_r"), "keyed")
    parts = -(-keyed.count() // MOST_IDS)
    scale = df.agg(*(f(col(c).cast("double")).alias(f"{k}{i}") for i, c in enumerate(numeric) for k, f in (("m", F.avg), ("s", F.stddev_samp)))).first()
    cells = F.array(*(F.struct(F.lit(i).alias("k"), ((col(c).cast("double") - (scale[f"m{i}"] or 0.0)) / (scale[f"s{i}"] or 1.0)).alias("x")) for i, c in enumerate(numeric)))
    guesses = []
    for part in range(parts):
        mine = keyed.where(F.floor(F.col("_r") / MOST_IDS) == part) if parts > 1 else keyed
        long = mine.select("_r", (F.col("_r") - part * MOST_IDS).cast("int").alias("u"), F.inline(cells))
        model = ALS(maxIter=iterations, regParam=0.01, rank=rank, coldStartStrategy="drop", userCol="u", itemCol="k", ratingCol="x", seed=seed).fit(long.where("x is not null"))
        guesses.append(model.transform(long.where(F.col("x").isNull())).select("_r", "k", "prediction"))
    if not guesses:
        return df
    guess = union_all(guesses).groupBy("_r").pivot("k", [numeric.index(c) for c in names]).agg(F.first("prediction"))
    kinds = dict(df.dtypes)
    full = keyed.join(guess, "_r", "left")
    made = {}
    for c in names:
        i = numeric.index(c)
        made[c] = F.coalesce(col(c), (F.col(f"`{i}`") * (scale[f"s{i}"] or 1.0) + (scale[f"m{i}"] or 0.0)).cast(kinds[c]))
    return place(full, made, "_imputed", output_mode).drop("_r", *(str(numeric.index(c)) for c in names))


def auto_imputation(df: DataFrame, list_of_cols: Columns = "missing", drop_cols: Columns = (), id_col: str = "", null_pct: float = 0.1, output_mode: str = "replace", seed: int = 11) -> DataFrame:
    """The imputer with the least error on complete rows of which ``null_pct`` of the values are taken out (root mean square over the
    mean, summed over the columns), applied to all rows."""
    names = _missing(df, list_of_cols, drop_cols, False)
    numeric = [c for c in names if c in type_classes(df)[0] and c != id_col]
    if not numeric:
        return impute_mmm(df, names, output_mode=output_mode)
    complete = df.dropna(subset=numeric)
    keep = {c: F.when(F.rand(seed + i) >= null_pct, col(c)) for i, c in enumerate(numeric)}
    # Staged: every method sees the same values taken out.
    test = stage(complete.select("*", *(col(c).alias(f"_true{i}") for i, c in enumerate(numeric))).withColumns(keep), "test")
    methods = {
        "median": lambda x: impute_mmm(x, numeric, method_type="median"),
        "mean": lambda x: impute_mmm(x, numeric, method_type="mean"),
        "KNN": lambda x: impute_model(x, numeric, method_type="KNN"),
        "regression": lambda x: impute_model(x, numeric, method_type="regression"),
        "factorization": lambda x: impute_factorization(x, numeric, id_col=id_col),
    }
    hidden = [f"_true{i}" for i in range(len(numeric))]
    best, least = "median", float("inf")
    for name, run in methods.items():
        seen = test.drop(*hidden).columns
        got = run(test.select(*(col(c) for c in seen), *(col(h).cast("string").alias(h) for h in hidden)))
        row = got.agg(*(F.try_divide(F.sqrt(F.avg(F.pow(col(c) - col(h).cast("double"), F.lit(2.0)))), F.abs(F.avg(col(h).cast("double")))).alias(h) for c, h in zip(numeric, hidden, strict=True))).first()
        error = sum(v for v in row if v is not None)
        if error < least:
            best, least = name, error
    out = methods[best](df)
    rest = [c for c in names if c not in numeric]
    out = impute_mmm(out, rest) if rest else out
    if output_mode == "append":
        return df.select("*") if not names else place(df, {}, "_imputed", "append") if not numeric else out
    return out
