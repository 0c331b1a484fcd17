"""Binning of numeric columns by expressions on the cut-offs: no Python on the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataforge.functions.columns import ACCURACY, Columns, col, model_frame, numeric_columns, place, quantiles


def cutoffs(df: DataFrame, names: Sequence[str], method_type: str, bin_size: int, accuracy: int = ACCURACY) -> dict[str, list[float]]:
    """Inner cut-offs of each column, from one pass; columns without values are left out."""
    if method_type == "equal_frequency":
        found = quantiles(df, names, [j * (1 / bin_size) for j in range(1, bin_size)], accuracy)
        return {c: list(v) for c, v in found.items() if v is not None}
    if method_type != "equal_range":
        raise TypeError("Invalid input for method_type")
    row = df.agg(*(f(col(c).cast("double")).alias(f"{k}{i}") for i, c in enumerate(names) for k, f in (("lo", F.min), ("hi", F.max)))).first()
    out = {}
    for i, c in enumerate(names):
        lo, hi = row[f"lo{i}"], row[f"hi{i}"]
        if hi is not None:
            width = (hi - lo) / bin_size
            out[c] = [lo + j * width for j in range(1, bin_size)]
    return out


def cutoffs_by_size(df: DataFrame, names: Sequence[str], method_type: str, sizes: Sequence[int], accuracy: int = ACCURACY) -> dict[int, dict[str, list[float]]]:
    """``cutoffs`` for several numbers of bins, still from one pass."""
    if method_type not in ("equal_range", "equal_frequency"):
        raise TypeError("Invalid input for method_type")
    if method_type == "equal_range":
        row = df.agg(*(f(col(c).cast("double")).alias(f"{k}{i}") for i, c in enumerate(names) for k, f in (("lo", F.min), ("hi", F.max)))).first()
        return {n: {c: [row[f"lo{i}"] + j * ((row[f"hi{i}"] - row[f"lo{i}"]) / n) for j in range(1, n)] for i, c in enumerate(names) if row[f"hi{i}"] is not None} for n in sizes}
    wanted = {n: [j * (1 / n) for j in range(1, n)] for n in sizes}
    probs = sorted({p for v in wanted.values() for p in v})
    found = {c: dict(zip(probs, v, strict=True)) for c, v in quantiles(df, names, probs, accuracy).items() if v is not None}
    return {n: {c: [v[p] for p in wanted[n]] for c, v in found.items()} for n in sizes}


def bin_number(value: Column, cuts: Sequence[float]) -> Column:
    """1 for values up to the first cut-off, and so on; NaN is above all, null stays null."""
    edges = F.array(*(F.lit(float(x)) for x in cuts))
    return F.when(value.isNotNull(), (F.size(F.filter(edges, lambda x: x < value.cast("double"))) + 1).cast("int"))


def bin_label(value: Column, cuts: Sequence[float]) -> Column:
    text = [str(round(float(x), 4)) for x in cuts]
    labels = ["<= " + text[0], *(f"{a}-{b}" for a, b in zip(text, text[1:])), "> " + text[-1]]
    return F.element_at(F.array(*(F.lit(x) for x in labels)), bin_number(value, cuts))


def attribute_binning(
    df: DataFrame, list_of_cols: Columns = "all", drop_cols: Columns = (), method_type: str = "equal_range", bin_size: int = 10, bin_dtype: str = "numerical", pre_existing_model: bool = False, model_path: str = "NA", output_mode: str = "replace", accuracy: int = ACCURACY
) -> DataFrame:
    """Equal-range or equal-frequency bins, closed to the right, as numbers or range texts."""
    names = numeric_columns(df, list_of_cols, drop_cols)
    if bin_size < 2:
        raise TypeError("Invalid input for bin_size")
    if bin_dtype not in ("numerical", "categorical"):
        raise TypeError("Invalid input for bin_dtype")
    if pre_existing_model:
        saved = {r["attribute"]: list(r["parameters"]) for r in df.sparkSession.read.parquet(model_path + "/attribute_binning").collect()}
        cuts = {c: saved[c] for c in names if c in saved}
    else:
        cuts = cutoffs(df, names, method_type, bin_size, accuracy)
        if model_path != "NA":
            model_frame(df, list(cuts.items()), "attribute string, parameters array<double>").coalesce(1).write.mode("overwrite").parquet(model_path + "/attribute_binning")
    make = bin_number if bin_dtype == "numerical" else bin_label
    return place(df, {c: make(col(c), v) for c, v in cuts.items()}, "_binned", output_mode)


def _ranks(values: list[float]) -> list[float]:
    order = sorted(range(len(values)), key=values.__getitem__)
    out, i = [0.0] * len(values), 0
    while i < len(order):
        j = i
        while j + 1 < len(order) and values[order[j + 1]] == values[order[i]]:
            j += 1
        for k in order[i : j + 1]:
            out[k] = (i + j) / 2
        i = j + 1
    return out


def monotonic_binning(df: DataFrame, list_of_cols: Columns = "all", drop_cols: Columns = (), label_col: str = "label", event_label: object = 1, bin_method: str = "equal_range", bin_size: int = 10, bin_dtype: str = "numerical", output_mode: str = "replace") -> DataFrame:
    """The most bins, from 20 down to 3, over which the mean label rises with the mean value; ``bin_size`` if there are none.

    All bin counts of a column are tried in one aggregation of at most 20 x 18 rows.
    """
    names = [c for c in numeric_columns(df, list_of_cols, drop_cols) if c != label_col]
    event = F.when(col(label_col) == event_label, 1).otherwise(0)
    tried = list(range(20, 2, -1))
    cuts = cutoffs_by_size(df, names, bin_method, tried)
    cells = [F.struct(F.lit(c).alias("c"), F.lit(n).alias("n"), bin_number(col(c), cuts[n][c]).alias("b"), col(c).cast("double").alias("v")) for c in names for n in tried if c in cuts[n]]
    chosen = {c: bin_size for c in names}
    if cells:
        rows = df.select(event.alias("y"), F.explode(F.array(*cells)).alias("x")).where("x.b is not null").groupBy("x.c", "x.n", "x.b").agg(F.avg("x.v").alias("v"), F.avg("y").alias("y")).collect()
        by: dict[tuple, list] = {}
        for r in rows:
            by.setdefault((r["c"], r["n"]), []).append((r["v"], r["y"]))
        for c in names:
            for n in tried:
                points = by.get((c, n), [])
                if len(points) > 1 and len({y for _, y in points}) > 1 and _ranks([v for v, _ in points]) == _ranks([y for _, y in points]):
                    chosen[c] = n
                    break
    out = df
    for n in sorted(set(chosen.values())):
        out = attribute_binning(out, [c for c in names if chosen[c] == n], (), bin_method, n, bin_dtype, output_mode=output_mode)
    return out
