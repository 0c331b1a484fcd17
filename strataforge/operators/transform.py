"""Feature transformers: encoding, scaling, mathematics, categories, expressions and latent features."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataforge.functions.columns import ACCURACY, Columns, as_list, col, long_text, model_frame, numeric_columns, place, quantiles, text_columns, type_classes
from strataforge.operators.stats import unique_count

#: Category tables up to this many rows are sent to every executor; larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000


def _load(df: DataFrame, path: str) -> DataFrame:
    return df.sparkSession.read.parquet(path)


def _save(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("overwrite").parquet(path)


# Encoding


def category_index(df: DataFrame, names: Sequence[str], index_order: str = "frequencyDesc") -> DataFrame:
    """(attribute, value, idx from 0) of non-null values, by frequency (ties by text) or text."""
    orders = {
        "frequencyDesc": lambda: [-F.col("n"), F.col("value")],
        "frequencyAsc": lambda: [F.col("n"), F.col("value")],
        "alphabetDesc": lambda: [F.col("value").desc()],
        "alphabetAsc": lambda: [F.col("value")],
    }
    if index_order not in orders:
        raise TypeError("Invalid input for index_order")
    counts = long_text(df, names).where("value is not null").groupBy("attribute", "value").agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window

    return counts.withColumn("idx", F.row_number().over(Window.partitionBy("attribute").orderBy(*orders[index_order]())) - 1).select("attribute", "value", "idx")


def cat_to_num_unsupervised(df: DataFrame, list_of_cols: Columns = "all", drop_cols: Columns = (), method_type: str = "label_encoding", index_order: str = "frequencyDesc", cardinality_threshold: int = 50, pre_existing_model: bool = False, model_path: str = "NA", output_mode: str = "replace") -> DataFrame:
    """``label_encoding``: a number per category, null stays null. ``onehot_encoding``: columns ``c_0`` ... of which the last stands for null.
    Columns with over ``cardinality_threshold`` categories are left as they are."""
    names = text_columns(df, list_of_cols, drop_cols)
    if method_type not in ("label_encoding", "onehot_encoding"):
        raise TypeError("Invalid input for method_type")
    path = model_path + "/cat_to_num_unsupervised"
    if pre_existing_model:
        table = _load(df, path)
    else:
        found = {r["attribute"]: r["unique_values"] for r in unique_count(df, names).collect()}
        names = [c for c in names if found[c] <= cardinality_threshold]
        table = category_index(df, names, index_order) if names else model_frame(df, [], "attribute string, value string, idx int")
        if model_path != "NA":
            _save(table, path)
    maps: dict[str, list[str]] = {}
    for r in sorted(table.collect(), key=lambda r: (r["attribute"], r["idx"])):
        maps.setdefault(r["attribute"], []).append(r["value"])
    out = df
    for c in [c for c in names if c in maps]:
        index = F.array_position(F.array(*(F.lit(v) for v in maps[c])), col(c)).cast("int") - 1
        label = F.when(col(c).isNotNull() & (index >= 0), index)
        if method_type == "label_encoding":
            out = place(out, {c: label}, "_index", output_mode)
        else:
            slots = [F.when(F.coalesce(label, F.lit(len(maps[c]))) == i, 1).otherwise(0).alias(f"{c}_{i}") for i in range(len(maps[c]) + 1)]
            out = out.select("*", *slots)
            out = out.drop(c) if output_mode == "replace" else out
    return out


def _joined(df: DataFrame, table: DataFrame, name: str, value: str) -> DataFrame:
    """``df`` with ``value`` of the row of ``table`` (key, value) whose key is null-safe equal to ``name``."""
    side = table.select(F.col("key").alias("_k"), F.col("value").alias(value))
    side = F.broadcast(side) if side.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else side
    return df.join(side, col(name).cast("string").eqNullSafe(F.col("_k")), "left").drop("_k")


def cat_to_num_supervised(df: DataFrame, list_of_cols: Columns = "all", drop_cols: Columns = (), label_col: str = "label", event_label: object = 1, pre_existing_model: bool = False, model_path: str = "NA", output_mode: str = "replace") -> DataFrame:
    """Each category's event rate, to 4 digits. A null category has none and stays null."""
    names = [c for c in text_columns(df, list_of_cols, drop_cols) if c != label_col]
    path = model_path + "/cat_to_num_supervised"
    if pre_existing_model:
        table = _load(df, path)
    else:
        event = (col(label_col) == event_label).cast("int")
        cells = F.array(*(F.struct(F.lit(c).alias("attribute"), col(c).cast("string").alias("key")) for c in names))
        rows = df.select(F.coalesce(event, F.lit(0)).alias("y"), F.inline(cells)).where("key is not null")
        table = rows.groupBy("attribute", "key").agg(F.round(F.avg("y"), 4).alias("value"))
        if model_path != "NA":
            _save(table, path)
    out, order = df, df.columns
    for c in names:
        out = _joined(out, table.where(F.col("attribute") == c), c, c + "_encoded")
    if output_mode == "replace":
        out = out.select(*(F.col(f"`{c}_encoded`").alias(c) if c in names else col(c) for c in order))
    return out


def cat_to_num_transformer(df: DataFrame, list_of_cols: Columns = "all", drop_cols: Columns = (), method_type: str = "unsupervised", encoding: str = "label_encoding", label_col: str | None = None, event_label: object = None) -> DataFrame:
    """All string columns to numbers; a string label becomes 1 for its event and 0 else."""
    names = text_columns(df, list_of_cols, drop_cols, empty_ok=True)
    features = [c for c in names if c != label_col]
    if not features:
        return df
    if method_type == "supervised":
        out = cat_to_num_supervised(df, features, (), label_col, event_label)
    elif method_type == "unsupervised":
        out = cat_to_num_unsupervised(df, features, (), encoding)
    else:
        raise TypeError("Invalid input for method_type")
    return out.withColumn(label_col, (col(label_col) == event_label).cast("int")) if label_col and label_col in names else out


# Scaling


def _fit(df: DataFrame, names: Sequence[str], fit, pre: bool, path: str) -> dict[str, list[float]]:
    if pre:
        return {r["feature"]: list(r["parameters"]) for r in _load(df, path).collect() if r["feature"] in names}
    found = fit()
    if not path.startswith("NA"):
        _save(model_frame(df, list(found.items()), "feature string, parameters array<double>"), path)
    return found


def z_standardization(df: DataFrame, list_of_cols: Columns = "all", drop_cols: Columns = (), pre_existing_model: bool = False, model_path: str = "NA", output_mode: str = "replace") -> DataFrame:
    """(x - mean) / stddev; columns whose stddev is null or rounds to 0 at 5 digits are left as they are."""
    names = numeric_columns(df, list_of_cols, drop_cols)

    def fit() -> dict[str, list[float]]:
        row = df.agg(*(f(col(c).cast("double")).alias(f"{k}{i}") for i, c in enumerate(names) for k, f in (("m", F.avg), ("s", F.stddev_samp)))).first()
        return {c: [row[f"m{i}"], row[f"s{i}"]] for i, c in enumerate(names) if row[f"s{i}"] and round(row[f"s{i}"], 5)}

    found = _fit(df, names, fit, pre_existing_model, model_path + "/z_standardization")
    return place(df, {c: (col(c) - m) / s for c, (m, s) in found.items()}, "_scaled", output_mode)


def iqr_standardization(df: DataFrame, list_of_cols: Columns = "all", drop_cols: Columns = (), pre_existing_model: bool = False, model_path: str = "NA", output_mode: str = "replace", accuracy: int = ACCURACY) -> DataFrame:
    """(x - median) / (third - first quartile); columns with equal quartiles are left as they are."""
    names = numeric_columns(df, list_of_cols, drop_cols)

    def fit() -> dict[str, list[float]]:
        return {c: q for c, q in quantiles(df, names, [0.25, 0.5, 0.75], accuracy).items() if q and q[0] != q[2]}

    found = _fit(df, names, fit, pre_existing_model, model_path + "/IQR_standardization")
    return place(df, {c: (col(c) - q[1]) / (q[2] - q[0]) for c, q in found.items()}, "_scaled", output_mode)


def normalization(df: DataFrame, list_of_cols: Columns = "all", drop_cols: Columns = (), pre_existing_model: bool = False, model_path: str = "NA", output_mode: str = "replace") -> DataFrame:
    """(x - min) / (max - min), 0.5 for a constant column; NaN becomes null and is not fitted on."""
    names = numeric_columns(df, list_of_cols, drop_cols)
    value = lambda c: F.nanvl(col(c).cast("double"), F.lit(None).cast("double"))

    def fit() -> dict[str, list[float]]:
        row = df.agg(*(f(value(c)).alias(f"{k}{i}") for i, c in enumerate(names) for k, f in (("lo", F.min), ("hi", F.max)))).first()
        return {c: [row[f"lo{i}"], row[f"hi{i}"]] for i, c in enumerate(names) if row[f"lo{i}"] is not None}

    found = _fit(df, names, fit, pre_existing_model, model_path + "/normalization")
    made = {c: (value(c) - lo) / (hi - lo) if hi > lo else F.when(value(c).isNotNull(), 0.5) for c, (lo, hi) in found.items()}
    return place(df, made, "_scaled", output_mode)


# Mathematics

_PARAMETRIC = ("powOfN", "toPowerN", "remainderDivByN", "roundN")


def _math(method: str, n: float | None):
    table = {
        "ln": F.ln,
        "log10": F.log10,
        "log2": F.log2,
        "exp": F.exp,
        "powOf2": lambda x: F.pow(F.lit(2.0), x),
        "powOf10": lambda x: F.pow(F.lit(10.0), x),
        "powOfN": lambda x: F.pow(F.lit(float(n)), x),
        "sqrt": F.sqrt,
        "cbrt": F.cbrt,
        "sq": lambda x: F.pow(x, F.lit(2.0)),
        "cb": lambda x: F.pow(x, F.lit(3.0)),
        "toPowerN": lambda x: F.pow(x, F.lit(float(n))),
        "sin": F.sin,
        "cos": F.cos,
        "tan": F.tan,
        "asin": F.asin,
        "acos": F.acos,
        "atan": F.atan,
        "radians": F.radians,
        "remainderDivByN": lambda x: F.try_mod(x, F.lit(n)),
        "factorial": lambda x: F.factorial(x.cast("int")),
        "mul_inv": lambda x: F.try_divide(F.lit(1.0), x),
        "floor": F.floor,
        "ceil": F.ceil,
        "roundN": lambda x: F.round(x, int(n)),
    }
    if method not in table:
        raise TypeError("Invalid input method_type")
    return table[method]


def feature_transformation(df: DataFrame, list_of_cols: Columns = "all", drop_cols: Columns = (), method_type: str = "sqrt", N: float | None = None, output_mode: str = "replace") -> DataFrame:
    """One of 25 functions; where it is undefined the result is null or NaN, never an error."""
    names, f = numeric_columns(df, list_of_cols, drop_cols), _math(method_type, N)
    suffix = f"_{method_type[:-1]}{N}" if method_type in _PARAMETRIC else f"_{method_type}"
    return place(df, {c: f(col(c)) for c in names}, suffix, output_mode)


#: The exponents tried.
LAMBDAS = (1, -1, 0.5, -0.5, 2, -2, 0.25, -0.25, 3, -3, 4, -4, 5, -5)


def boxcox_transformation(df: DataFrame, list_of_cols: Columns = "all", drop_cols: Columns = (), boxcox_lambda: float | Sequence[float] | None = None, output_mode: str = "replace") -> DataFrame:
    """x to the power lambda, or ln x for 0. Without a lambda the one whose result is nearest to the standard normal by the
    Kolmogorov-Smirnov p-value, 1 if none has any. Values must be over 0."""
    names = numeric_columns(df, list_of_cols, drop_cols)
    least = df.agg(*(F.min(col(c)).alias(f"_{i}") for i, c in enumerate(names))).first()
    if any(v is None or v <= 0 for v in least):
        raise ValueError("Data must be positive")
    given = [boxcox_lambda] * len(names) if isinstance(boxcox_lambda, int | float) else list(boxcox_lambda) if boxcox_lambda else [None] * len(names)
    if len(given) != len(names):
        raise TypeError("Invalid input for boxcox_lambda")
    power = lambda c, v: F.ln(col(c)) if v == 0 else F.pow(col(c).cast("double"), F.lit(float(v)))
    chosen = {}
    for c, v in zip(names, given, strict=True):
        if v is None:
            from pyspark.ml.stat import KolmogorovSmirnovTest

            best, v = 0.0, 1
            for one in (*LAMBDAS, 0):
                p = KolmogorovSmirnovTest.test(df.select(power(c, one).alias("x")).where("x is not null"), "x", "norm", 0.0, 1.0).first()["pValue"]
                if p > best:
                    best, v = p, one
        chosen[c] = v
    return place(df, {c: power(c, v) for c, v in chosen.items()}, "_bxcx", output_mode)


# Categories and expressions


def outlier_categories(df: DataFrame, list_of_cols: Columns = "all", drop_cols: Columns = (), coverage: float = 1.0, max_category: int = 50, pre_existing_model: bool = False, model_path: str = "NA", output_mode: str = "replace") -> DataFrame:
    """All but the most frequent categories, up to ``coverage`` of the non-null rows and ``max_category`` - 1 of them, become
    ``outlier_categories``. Frequencies that tie share a rank, and among them text order decides on coverage."""
    names = text_columns(df, list_of_cols, drop_cols)
    path = model_path + "/outlier_categories"
    if pre_existing_model:
        table = _load(df, path)
    else:
        from pyspark.sql import Window

        counts = long_text(df, names).where("value is not null").groupBy("attribute", "value").agg(F.count(F.lit(1)).alias("n"))
        total = counts.groupBy("attribute").agg(F.sum("n").alias("t"))
        by = Window.partitionBy("attribute")
        ranked = counts.join(F.broadcast(total), "attribute").withColumns(
            {
                "rank": F.rank().over(by.orderBy(F.desc("n"))),
                "before": F.coalesce(F.sum("n").over(by.orderBy(F.desc("n"), "value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            }
        )
        table = ranked.where((F.col("before") < coverage * F.col("t")) & (F.col("rank") <= max_category - 1)).select("attribute", F.col("value").alias("parameters"))
        if model_path != "NA":
            _save(table, path)
    kept: dict[str, list[str]] = {}
    for r in table.collect():  # at most max_category a column, but for ties
        kept.setdefault(r["attribute"], []).append(r["parameters"])
    made = {c: F.when(col(c).isNull() | col(c).isin(kept.get(c, [])), col(c)).otherwise("outlier_categories") for c in names}
    return place(df, made, "_outliered", output_mode)


def expression_parser(df: DataFrame, list_of_expr: Columns, postfix: str = "") -> DataFrame:
    """SQL expressions as new columns ``f0``, ``f1`` ...; special characters of column names may be written as in backticks or as ``_``."""
    exprs = as_list(list_of_expr) if isinstance(list_of_expr, str) else list(list_of_expr)
    import re

    renamed = {c: re.sub(r"[^A-Za-z0-9_]", "_", c) for c in df.columns}
    odd = {c: n for c, n in renamed.items() if c != n}
    view = df.select("*", *(col(c).alias(n) for c, n in odd.items() if n not in df.columns))
    made = [F.expr(_plain(e, odd)).alias(f"f{i}{postfix}") for i, e in enumerate(exprs)]
    return view.select(*(col(c) for c in df.columns), *made)


def _plain(text: str, odd: dict[str, str]) -> str:
    for c in sorted(odd, key=len, reverse=True):
        text = text.replace(f"`{c}`", odd[c]).replace(c, odd[c])
    return text


# Latent features


def _prepared(df: DataFrame, names: Sequence[str], standardization: bool, imputation: bool) -> DataFrame:
    out = df.withColumns({c: col(c).cast("double") for c in names})
    if standardization:
        out = z_standardization(out, names)
    if imputation:
        from strataforge.operators.imputation import impute_mmm

        out = impute_mmm(out, names, method_type="mean")
    return out


def pca_latent_features(df: DataFrame, list_of_cols: Columns = "all", drop_cols: Columns = (), explained_variance_cutoff: float = 0.95, pre_existing_model: bool = False, model_path: str = "NA", standardization: bool = True, imputation: bool = False, output_mode: str = "replace") -> DataFrame:
    """``latent_0`` ...: the fewest principal components whose variances add up to more than the cut-off. Rows with a null in the columns
    go unless ``imputation`` fills them."""
    from pyspark.ml.feature import PCA, PCAModel, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    names = numeric_columns(df, list_of_cols, drop_cols)
    spark = df.sparkSession
    prepared = _prepared(df.select("*", *(col(c).alias(f"_p{i}") for i, c in enumerate(names))), [f"_p{i}" for i in range(len(names))], standardization, imputation)
    assembled = VectorAssembler(inputCols=[f"_p{i}" for i in range(len(names))], outputCol="_v", handleInvalid="skip").transform(prepared)
    path = model_path + "/PCA_latentFeatures"
    if pre_existing_model:
        model = PCAModel.load(path + "/pca_model")
        k = spark.read.parquet(path + "/k").first()["k"]
    else:
        model = PCA(k=len(names), inputCol="_v", outputCol="_latent").fit(assembled)
        total, k = 0.0, len(names)
        for i, share in enumerate(model.explainedVariance.toArray()):
            total += share
            if total > explained_variance_cutoff:
                k = i + 1
                break
        if model_path != "NA":
            model.write().overwrite().save(path + "/pca_model")
            model_frame(spark, [(k,)], "k int").coalesce(1).write.mode("overwrite").parquet(path + "/k")
    found = model.transform(assembled).withColumn("_a", vector_to_array("_latent"))
    kept = [c for c in df.columns if output_mode == "append" or c not in names]
    return found.select(*(col(c) for c in kept), *(F.col("_a")[i].alias(f"latent_{i}") for i in range(k)))


def autoencoder_latent_features(df: DataFrame, list_of_cols: Columns = "all", drop_cols: Columns = (), reduction_params: float = 0.5, sample_size: int = 500_000, epochs: int = 20, batch_size: int = 256, standardization: bool = True, imputation: bool = False, output_mode: str = "replace", seed: int = 3) -> DataFrame:
    """``latent_0`` ... from the bottleneck of a dense network (n, 2n, k, 2n, n; tanh) that is trained in numpy to give its input back.

    ``reduction_params``: the bottleneck's width, as a share of the columns if under 1. It is fitted on at most ``sample_size`` rows.
    """
    names = numeric_columns(df, list_of_cols, drop_cols)
    prepared = _prepared(df.select("*", *(col(c).alias(f"_p{i}") for i, c in enumerate(names))), [f"_p{i}" for i in range(len(names))], standardization, imputation)
    inputs = [f"_p{i}" for i in range(len(names))]
    prepared = prepared.dropna(subset=inputs)
    rows = prepared.count()
    fit = prepared.select(*inputs)
    x = (fit.sample(False, min(1.0, sample_size / rows), seed) if rows > sample_size else fit).toPandas().to_numpy(float)
    n, k = len(names), max(1, int(round(reduction_params * len(names))) if reduction_params < 1 else int(reduction_params))
    rng = np.random.default_rng(seed)
    sizes = [n, 2 * n, k, 2 * n, n]
    weights = [rng.normal(0, (1 / a) ** 0.5, (a, b)) for a, b in zip(sizes, sizes[1:])]
    biases = [np.zeros(b) for b in sizes[1:]]
    squares = [np.full_like(w, 1e-3) for w in weights] + [np.full_like(b, 1e-3) for b in biases]
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch_size)):
            if not len(at):
                continue
            layers = [x[at]]
            for i, (w, b) in enumerate(zip(weights, biases, strict=True)):
                z = layers[-1] @ w + b
                layers.append(z if i == 3 else np.tanh(z))
            delta = (layers[-1] - x[at]) / len(at)
            for i in range(3, -1, -1):
                g, gb = layers[i].T @ delta, delta.sum(0)
                delta = (delta @ weights[i].T) * (1 - layers[i] ** 2) if i else None
                for p, grad, j in ((weights[i], g, i), (biases[i], gb, 4 + i)):
                    squares[j] += grad * grad
                    p -= 0.05 * grad / np.sqrt(squares[j])

    @F.pandas_udf("array<double>")
    def encode(columns: pd.DataFrame) -> pd.Series:
        v = columns.to_numpy(float)
        v = np.tanh(np.tanh(v @ weights[0] + biases[0]) @ weights[1] + biases[1])
        return pd.Series(list(v))

    found = prepared.withColumn("_a", encode(F.struct(*inputs)))
    kept = [c for c in df.columns if output_mode == "append" or c not in names]
    return found.select(*(col(c) for c in kept), *(F.col("_a")[i].alias(f"latent_{i}") for i in range(k)))


def is_numeric(df: DataFrame, name: str) -> bool:
    return name in type_classes(df)[0]


def null_safe(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))
