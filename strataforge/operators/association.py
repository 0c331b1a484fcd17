"""Association between attributes, and with a label."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataforge.functions.columns import Columns, col, model_frame, numeric_columns, resolve, type_classes
from strataforge.operators import binning


def _correlations(df: DataFrame, names: list[str]) -> np.ndarray:
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation

    part = df.select(*(col(c).cast("double").alias(f"_{i}") for i, c in enumerate(names)))
    v = VectorAssembler(inputCols=part.columns, outputCol="v", handleInvalid="skip").transform(part).select("v")
    return Correlation.corr(v, "v", "pearson").first()[0].toArray()


def correlation_matrix(df: DataFrame, list_of_cols: Columns = "all", drop_cols: Columns = (), use_sampling: bool = False, sample_size: int = 1_000_000) -> DataFrame:
    """Pearson's correlation of numeric columns over rows without a null, sorted by name."""
    names = sorted(numeric_columns(df, list_of_cols, drop_cols))
    rows = df.count() if use_sampling else 0
    matrix = _correlations(df.sample(False, sample_size / rows, 11) if rows > sample_size else df, names)
    schema = ", ".join(["attribute string", *(f"`{c}` double" for c in names)])
    return model_frame(df, [(c, *(float(x) for x in matrix[i])) for i, c in enumerate(names)], schema)


def _segments(df: DataFrame, list_of_cols: Columns, drop_cols: Columns, label_col: str, event_label: object, encoding_configs: Mapping | None) -> tuple[DataFrame, DataFrame]:
    """(attribute, bin, event, nonevent), numerics binned first, null a bin of its own; and the overall counts as one row."""
    names = [c for c in resolve(df, list_of_cols, drop_cols) if c != label_col]
    if label_col not in df.columns:
        raise TypeError("Invalid input for label_col")
    numeric = [c for c in names if c in type_classes(df)[0]]
    configs = {"bin_method": "equal_frequency", "bin_size": 10, "monotonicity_check": 0} if encoding_configs is None else dict(encoding_configs)
    work = df.select(F.coalesce((col(label_col) == event_label).cast("int"), F.lit(0)).alias("_y"), *(col(c) for c in names))
    if numeric and configs:
        if configs.get("monotonicity_check"):
            work = binning.monotonic_binning(work, numeric, (), "_y", 1, configs["bin_method"], configs["bin_size"])
        else:
            work = binning.attribute_binning(work, numeric, (), configs["bin_method"], configs["bin_size"])
    cells = F.array(*(F.struct(F.lit(c).alias("attribute"), col(c).cast("string").alias("bin")) for c in names))
    found = work.select("_y", F.inline(cells)).groupBy("attribute", "bin").agg(F.sum("_y").alias("event"), F.sum(1 - F.col("_y")).alias("nonevent"))
    total = found.groupBy("attribute").agg(F.sum("event").alias("events"), F.sum("nonevent").alias("nonevents"))
    return found, total


def iv_calculation(df: DataFrame, list_of_cols: Columns = "all", drop_cols: Columns = (), label_col: str = "label", event_label: object = 1, encoding_configs: Mapping | None = None) -> DataFrame:
    """Information value: the sum of (nonevent share - event share) ln(nonevent share / event share); where a bin has no event or
    no nonevent, both counts of the ratio get 0.5."""
    found, total = _segments(df, list_of_cols, drop_cols, label_col, event_label, encoding_configs)
    both = found.join(F.broadcast(total), "attribute")
    e, n = F.try_divide("event", "events"), F.try_divide("nonevent", "nonevents")
    smoothed = F.ln(F.try_divide(F.try_divide(F.col("nonevent") + 0.5, F.col("nonevents")), F.try_divide(F.col("event") + 0.5, F.col("events"))))
    woe = F.when((F.col("event") == 0) | (F.col("nonevent") == 0), smoothed).otherwise(F.ln(F.try_divide(n, e)))
    return both.groupBy("attribute").agg(F.sum(woe * (n - e)).alias("iv"))


def ig_calculation(df: DataFrame, list_of_cols: Columns = "all", drop_cols: Columns = (), label_col: str = "label", event_label: object = 1, encoding_configs: Mapping | None = None) -> DataFrame:
    """Information gain: the label's entropy less the bins' entropies by their shares; pure bins add nothing."""
    found, total = _segments(df, list_of_cols, drop_cols, label_col, event_label, encoding_configs)
    both = found.join(F.broadcast(total), "attribute")
    rows = F.col("events") + F.col("nonevents")

    def entropy(p):
        return F.when((p > 0) & (p < 1), -(p * F.log2(p) + (1 - p) * F.log2(1 - p))).otherwise(0.0)

    here = F.col("event") + F.col("nonevent")
    of_bins = F.sum(here / rows * entropy(F.col("event") / here))
    return both.groupBy("attribute").agg((F.max(entropy(F.col("events") / rows)) - of_bins).alias("ig"))


def variable_clustering(df: DataFrame, list_of_cols: Columns = "all", drop_cols: Columns = (), max_eigenvalue: float = 1.0, max_clusters: int | None = None, restarts: int = 0, seed: int = 7) -> DataFrame:
    """Groups of correlated attributes: the group whose second eigenvalue is largest (over ``max_eigenvalue``) is split along its two first
    components after quartimax rotation, and attributes move between the parts while that gains variance. String columns are label
    encoded, nulls get the median, constant columns are left out. ``restarts``: how often a split is tried again with the attributes in
    another order, of which the one with the most variance stays. RS_Own is the squared correlation with the own group's component,
    RS_NC the largest with another's, RS_Ratio (1 - RS_Own) / (1 - RS_NC)."""
    from strataforge.operators.imputation import impute_mmm
    from strataforge.operators.stats import unique_count
    from strataforge.operators.transform import cat_to_num_unsupervised

    names = resolve(df, list_of_cols, drop_cols)
    found = {r["attribute"]: r["unique_values"] for r in unique_count(df, names).collect()}
    names = [c for c in names if found[c] > 1]
    work = df.select(*(col(c) for c in names))
    text = type_classes(work)[1]
    if text:
        work = cat_to_num_unsupervised(work, text, cardinality_threshold=max(found.values()))
    work = impute_mmm(work.select(*(col(c).cast("double").alias(c) for c in names)), names, method_type="median")
    corr = _correlations(work, names)
    groups = _clusters(corr, max_eigenvalue, max_clusters, restarts, seed)
    rows = []
    for k, group in enumerate(groups):
        for i in group:
            own, others = _r2(corr, i, group), [_r2(corr, i, g) for j, g in enumerate(groups) if j != k]
            near = max(others, default=0.0)
            rows.append((k, names[i], round(own, 4), round(near, 4), round(float((1 - own) / (1 - near)), 4) if near < 1 else None))
    return model_frame(df, rows, "Cluster int, Attribute string, RS_Own double, RS_NC double, RS_Ratio double")


def _eigen(corr: np.ndarray, group: list[int]) -> tuple[np.ndarray, np.ndarray]:
    values, vectors = np.linalg.eigh(corr[np.ix_(group, group)])
    vectors = vectors * np.where(vectors.sum(0) < 0, -1, 1)
    return values[::-1], vectors[:, ::-1]


def _r2(corr: np.ndarray, i: int, group: list[int]) -> float:
    values, vectors = _eigen(corr, group)
    return float(min(1.0, (corr[i, group] @ vectors[:, 0]) ** 2 / values[0])) if values[0] > 0 else 0.0


def _quartimax(loadings: np.ndarray, rounds: int = 100) -> np.ndarray:
    rotation = np.eye(loadings.shape[1])
    before = 0.0
    for _ in range(rounds):
        made = loadings @ rotation
        u, s, v = np.linalg.svd(loadings.T @ made**3)
        rotation = u @ v
        if s.sum() < before * (1 + 1e-9):
            break
        before = s.sum()
    return loadings @ rotation


def _reassign(corr: np.ndarray, left: list[int], right: list[int], order: list[int]) -> tuple[list[int], list[int], float]:
    """The two parts after attributes, taken in ``order``, have moved while that gains variance; and the variance of both."""
    first = lambda g: float(_eigen(corr, g)[0][0]) if g else 0.0
    left, right, moved = sorted(left), sorted(right), True
    while moved:
        moved = False
        for x in order:
            a, b = (left, right) if x in left else (right, left)
            if len(a) == 1:
                continue
            one, two = [y for y in a if y != x], sorted([*b, x])
            if first(one) + first(two) > first(a) + first(b) + 1e-12:
                a.remove(x)
                b.append(x)
                b.sort()
                moved = True
    return left, right, first(left) + first(right)


def _clusters(corr: np.ndarray, limit: float, most: int | None, restarts: int = 0, seed: int = 7) -> list[list[int]]:
    rng = np.random.Generator(np.random.PCG64(seed))
    groups = [list(range(len(corr)))]
    fixed: set[tuple[int, ...]] = set()
    while most is None or len(groups) < most:
        seconds = [(_eigen(corr, g)[0][1] if len(g) > 1 and tuple(g) not in fixed else 0.0) for g in groups]
        k = int(np.argmax(seconds))
        if seconds[k] <= limit:
            break
        group = groups[k]
        values, vectors = _eigen(corr, group)
        rotated = _quartimax(vectors[:, :2] * np.sqrt(np.maximum(values[:2], 0)))
        left = [x for x, r in zip(group, rotated, strict=True) if abs(r[0]) >= abs(r[1])]
        right = [x for x in group if x not in left]
        if not left or not right:
            fixed.add(tuple(group))
            continue
        tries = [_reassign(corr, left, right, order) for order in (group, *(rng.permutation(group).tolist() for _ in range(restarts)))]
        left, right, _ = max(tries, key=lambda t: t[2])
        groups[k : k + 1] = [sorted(left), sorted(right)]
    return groups
