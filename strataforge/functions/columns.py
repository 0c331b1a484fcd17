"""Column lists, type classes and one-pass aggregation by attribute."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rank error of approximate quantiles is one part in this many rows; the sketch's size is bounded by it too.
ACCURACY = 100_000
#: The finest sketch that exact quantiles begin with: finer ones take longer than the second pass.
SKETCH = 10_000
#: Exact quantiles of more columns than this go in several passes, to stay within code generation limits.
QUANTILE_CHUNK = 24
#: Aggregates over more columns than this go in several passes, to stay within code generation limits.
CHUNK = 200

_NUMERIC = (T.DoubleType, T.FloatType, T.IntegerType, T.LongType, T.DecimalType)
_DISCRETE = (T.StringType, T.IntegerType, T.LongType)

Columns = str | Sequence[str]


def type_classes(df: DataFrame) -> tuple[list[str], list[str], list[str]]:
    """Numeric, categorical (string) and other columns; smallint and tinyint count as other."""
    numeric = [f.name for f in df.schema if isinstance(f.dataType, _NUMERIC)]
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return numeric, text, [c for c in df.columns if c not in numeric and c not in text]


def get_dtype(df: DataFrame, name: str) -> str:
    """The Spark type of one column, by name."""
    return dict(df.dtypes)[name]


def discrete(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, _DISCRETE)]


def as_list(columns: Columns | None) -> list[str]:
    if columns is None:
        return []
    if isinstance(columns, str):
        columns = columns.split("|")
    return list(dict.fromkeys(c.strip() for c in columns if c.strip()))


def resolve(df: DataFrame, columns: Columns, drop: Columns = (), allowed: Sequence[str] | None = None, empty_ok: bool = False) -> list[str]:
    """Names in the caller's order, without repeats and ``drop``. ``all`` is ``allowed`` (numeric and string by default).

    Raises ``TypeError`` on unknown or disallowed names, or if nothing is left and ``empty_ok`` is false.
    """
    if allowed is None:
        numeric, text, _ = type_classes(df)
        allowed = [c for c in df.columns if c in numeric or c in text]
    dropped = as_list(drop)
    names = list(allowed) if columns == "all" else as_list(columns)
    names = [c for c in names if c not in dropped]
    wrong = [c for c in names if c not in allowed]
    if wrong or not (names or empty_ok):
        raise TypeError(f"Invalid input for Column(s): {wrong or 'none left'}")
    return names


def numeric_columns(df: DataFrame, columns: Columns, drop: Columns = (), **kw) -> list[str]:
    return resolve(df, columns, drop, type_classes(df)[0], **kw)


def text_columns(df: DataFrame, columns: Columns, drop: Columns = (), **kw) -> list[str]:
    return resolve(df, columns, drop, type_classes(df)[1], **kw)


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def per_attribute(df: DataFrame, names: Sequence[str], measures: dict[str, Callable[[str], Column]], schema: str) -> DataFrame:
    """A row per name with the aggregates ``measures``; one aggregation pass per ``CHUNK`` names.

    ``schema``: DDL of the measures in order, which also fixes the types when ``names`` is empty.
    """
    spark = df.sparkSession
    kinds = T.StructType([T.StructField("attribute", T.StringType()), *T._parse_datatype_string(schema).fields])
    if not names:
        return spark.createDataFrame([], kinds)
    parts = []
    for at in range(0, len(names), CHUNK):
        chunk = names[at : at + CHUNK]
        row = df.agg(*(make(c).cast(kinds[m].dataType).alias(f"_{i}_{m}") for i, c in enumerate(chunk) for m, make in measures.items()))
        rows = F.array(*(F.struct(F.lit(c).alias("attribute"), *(F.col(f"`_{i}_{m}`").alias(m) for m in measures)) for i, c in enumerate(chunk)))
        parts.append(row.select(F.inline(rows)))
    return union_all(parts)


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL as a balanced tree, which keeps the plan shallow."""
    parts = list(parts)
    while len(parts) > 1:
        parts = [parts[i].union(parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def long_text(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(attribute, value) with values as strings, nulls kept."""
    pairs = F.array(*(F.struct(F.lit(c).alias("attribute"), col(c).cast("string").alias("value")) for c in names))
    return df.select(F.inline(pairs))


def place(df: DataFrame, made: dict[str, Column], suffix: str, output_mode: str) -> DataFrame:
    """Puts new values in place (``replace``) or beside the column, with ``suffix`` (``append``)."""
    if output_mode == "replace":
        return df.withColumns(made)
    if output_mode == "append":
        return df.withColumns({c + suffix: v for c, v in made.items()})
    raise TypeError("Invalid input for output_mode")


def quantiles(df: DataFrame, names: Sequence[str], probs: Sequence[float], accuracy: int = ACCURACY) -> dict[str, list[float] | None]:
    """Values of given ranks, the ceil(p * rows)-th least each, from the data and exact. None for a column without values.

    A sketch of ``accuracy``, but ``SKETCH`` at most, gives two values around each rank; a second pass counts the rows below these and each
    value between them. The sketch's size doesn't grow with the rows, and few values lie between.
    """
    out: dict[str, list[float] | None] = {}
    for at in range(0, len(names), QUANTILE_CHUNK):
        out |= _quantiles(df, names[at : at + QUANTILE_CHUNK], list(probs), min(accuracy, SKETCH))
    return out


def _quantiles(df: DataFrame, names: Sequence[str], probs: list[float], sketch: int) -> dict[str, list[float] | None]:
    sides = {p: (max(p - 2 / sketch, 0.0), min(p + 2 / sketch, 1.0)) for p in probs}
    asked = sorted({*probs, *(q for s in sides.values() for q in s)})
    values = [col(c).cast("double") for c in names]
    row = df.agg(*(x for i, v in enumerate(values) for x in (F.count(v).alias(f"n{i}"), F.percentile_approx(v, asked, sketch).alias(f"q{i}")))).first()
    out: dict[str, list[float] | None] = {}
    ranks: dict[int, dict[int, tuple[float, float]]] = {}  # by column, the values around each rank
    for i, c in enumerate(names):
        n, found = row[f"n{i}"], dict(zip(asked, row[f"q{i}"] or [], strict=False))
        out[c] = [found[p] for p in probs] if n else None
        if n > sketch // 2:  # so few rows the sketch keeps whole
            ranks[i] = {max(1, math.ceil(p * n)): (found[sides[p][0]], found[sides[p][1]]) for p in probs}
    exact: dict[tuple[int, int], float] = {}
    for _ in range(3):  # once more only if a sketch was wrong: then what lies between two others is searched whole
        if not ranks:
            break
        ranks = _ranked(df, values, ranks, exact)
    if ranks:
        raise RuntimeError("the rows changed between two passes")
    for i, c in enumerate(names):
        if out[c] and (n := row[f"n{i}"]) > sketch // 2:
            out[c] = [exact[i, max(1, math.ceil(p * n))] for p in probs]
    return out


def _ranked(df: DataFrame, values: Sequence[Column], ranks: dict[int, dict[int, tuple[float, float]]], exact: dict[tuple[int, int], float]) -> dict[int, dict[int, tuple[float, float]]]:
    """Puts the values of ranks into ``exact``; what is left lies outside the given values, and gets others."""
    order = lambda v: (math.isnan(v), 0.0 if math.isnan(v) else v)
    between: dict[int, list[tuple[float, float]]] = {}
    cells, wanted = [], F.lit(False)
    for i, around in ranks.items():
        spans: list[tuple[float, float]] = []
        for lo, hi in sorted(around.values(), key=lambda s: order(s[0])):
            if spans and order(lo) <= order(spans[-1][1]):
                spans[-1] = (spans[-1][0], max(hi, spans[-1][1], key=order))
            else:
                spans.append((lo, hi))
        between[i] = spans
        made = lambda k, v, i=i: F.struct(F.lit(i).alias("i"), F.lit(k).alias("k"), v.alias("v"))
        nothing = F.lit(None).cast("double")
        cell = F.when(values[i].isNull(), made(-1, nothing))
        for k, (lo, hi) in enumerate(spans):
            cell = cell.when(values[i] < lo, made(2 * k, nothing)).when(values[i] <= hi, made(2 * k + 1, values[i]))
        cells.append(cell.otherwise(made(2 * len(spans), nothing)))
        for r in around:
            wanted = wanted | ((F.col("i") == i) & (F.col("upto") >= r) & (F.col("upto") - F.col("n") < r))
    counts = df.select(F.inline(F.array(*cells))).where("k >= 0").groupBy("i", "k", "v").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("i").orderBy("k", "v").rowsBetween(Window.unboundedPreceding, 0))
    left: dict[int, dict[int, tuple[float, float]]] = {i: {} for i in ranks}
    found = counts.withColumn("upto", upto).where(wanted).collect()
    for i, around in ranks.items():
        for r in around:
            x = next((x for x in found if x["i"] == i and x["upto"] - x["n"] < r <= x["upto"]), None)
            if x is not None and x["k"] % 2:
                exact[i, r] = x["v"]
            else:
                k = x["k"] // 2 if x is not None else 0
                left[i][r] = (between[i][k - 1][1] if k else -math.inf, between[i][k][0] if x is not None and k < len(between[i]) else math.nan)
    return {i: around for i, around in left.items() if around}


def group_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """The keys, ``min``, ``q`` (the exact values of given ranks) and ``max`` of ``value`` by group: a sort of each group's distinct values."""
    group = Window.partitionBy(*(col(k) for k in keys))
    counts = df.groupBy(*(col(k) for k in keys), col(value).alias("_v")).agg(F.count(col(value)).alias("_n"))
    upto = F.sum("_n").over(group.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumns({"_upto": upto, "_rows": F.sum("_n").over(group)})
    at = [F.min(F.when(F.col("_upto") >= F.greatest(F.lit(1), F.ceil(F.lit(float(p)) * F.col("_rows"))), F.col("_v"))) for p in probs]
    return ranked.groupBy(*(col(k) for k in keys)).agg(F.min("_v").alias("min"), F.array(*at).alias("q"), F.max("_v").alias("max"))


def model_frame(df_or_spark, rows: Iterable[tuple], schema: str) -> DataFrame:
    spark = getattr(df_or_spark, "sparkSession", df_or_spark)
    return spark.createDataFrame(list(rows), schema)


def transpose(df: DataFrame, fixed: str) -> DataFrame:
    """Rows become columns: a column per value of ``fixed``, a row (``key``) per other column."""
    names = [c for c in df.columns if c != fixed]
    heads = [r[0] for r in df.select(fixed).collect()]
    pairs = F.array(*(F.struct(F.lit(c).alias("key"), col(c).cast("string").alias("value")) for c in names))
    return df.select(col(fixed).alias("_f"), F.inline(pairs)).groupBy("key").pivot("_f", heads).agg(F.first("value"))


def flatten(df: DataFrame, fixed: Sequence[str]) -> DataFrame:
    """Wide to long: the fixed columns, ``key`` and ``value`` (a string where the kinds differ)."""
    names = [c for c in df.columns if c not in fixed]
    kinds = {dict(df.dtypes)[c] for c in names}
    to = next(iter(kinds)) if len(kinds) == 1 else "string"
    return df.select(*fixed, *(col(c).cast(to).alias(c) for c in names)).unpivot(list(fixed), names, "key", "value")
