"""Reading, writing and reshaping datasets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataforge.functions.columns import Columns, as_list, col, per_attribute, resolve, type_classes


def read_dataset(spark: SparkSession, file_path: str, file_type: str, file_configs: Mapping | None = None, schema: str | None = None) -> DataFrame:
    """Any format that the session knows; give a ``schema`` where the format would infer it."""
    reader = spark.read.format(file_type).options(**(file_configs or {}))
    return (reader.schema(schema) if schema else reader).load(file_path)


def write_dataset(df: DataFrame, file_path: str, file_type: str, file_configs: Mapping | None = None, column_order: Sequence[str] = ()) -> None:
    """``file_configs`` may hold ``mode`` and ``repartition`` (a number of files) beside the format's options."""
    options = dict(file_configs or {})
    mode, files = options.pop("mode", "error"), options.pop("repartition", None)
    if column_order:
        if sorted(column_order) != sorted(df.columns):
            raise ValueError("column_order must hold each column once")
        df = df.select(*column_order)
    if files is not None:
        df = df.coalesce(1) if int(files) == 1 else df.repartition(int(files))
    df.write.format(file_type).options(**options).mode(mode).save(file_path)


def concatenate_dataset(*dfs: DataFrame, method_type: str = "name") -> DataFrame:
    """UNION ALL. ``name``: by the first one's columns, others' further columns go; ``index``: by position."""
    if method_type not in ("name", "index"):
        raise TypeError("Invalid input for concatenate_dataset method")
    out = dfs[0]
    for df in dfs[1:]:
        out = out.union(df.select(*out.columns) if method_type == "name" else df)
    return out


def join_dataset(*dfs: DataFrame, join_cols: Columns, join_type: str) -> DataFrame:
    """Equi-join from left to right; columns besides the keys must have different names."""
    keys = as_list(join_cols)
    for df in dfs:
        if any(k not in df.columns for k in keys):
            raise ValueError("join_cols are not in every dataset")
    rest = [c for df in dfs for c in df.columns if c not in keys]
    if len(rest) != len(set(rest)) and join_type not in ("left_semi", "left_anti"):
        raise ValueError("Duplicate columns beside join_cols")
    out = dfs[0]
    for df in dfs[1:]:
        out = out.join(df, keys, join_type)
    return out


def delete_column(df: DataFrame, list_of_cols: Columns) -> DataFrame:
    return df.drop(*as_list(list_of_cols))


def select_column(df: DataFrame, list_of_cols: Columns) -> DataFrame:
    """In the caller's order."""
    return df.select(*(col(c) for c in as_list(list_of_cols)))


def rename_column(df: DataFrame, list_of_cols: Columns, list_of_newcols: Columns) -> DataFrame:
    old, new = as_list(list_of_cols), as_list(list_of_newcols)
    if len(old) != len(new):
        raise TypeError("Mismatch between old and new names")
    return df.withColumnsRenamed(dict(zip(old, new, strict=True)))


def recast_column(df: DataFrame, list_of_cols: Columns, list_of_dtypes: Columns) -> DataFrame:
    """Values that do not convert become null."""
    names = as_list(list_of_cols)
    kinds = [t.strip() for t in (list_of_dtypes.split("|") if isinstance(list_of_dtypes, str) else list_of_dtypes)]
    if len(names) != len(kinds):
        raise TypeError("Mismatch between columns and types")
    return df.withColumns({c: col(c).try_cast(t) for c, t in zip(names, kinds, strict=True)})


def recommend_type(df: DataFrame, list_of_cols: Columns = "all", drop_cols: Columns = (), dynamic_threshold: float = 0.01, static_threshold: int = 100) -> DataFrame:
    """Columns whose form should change: numeric ones with few distinct values to categorical, strings that all are numbers and have many
    distinct values to numerical. Few: under the smaller of ``dynamic_threshold`` times the non-null rows and ``static_threshold``."""
    names = resolve(df, list_of_cols, drop_cols)
    numeric = type_classes(df)[0]
    kinds = dict(df.dtypes)
    measures = {
        "distinct_value_count": lambda c: F.count_distinct(col(c)),
        "filled": lambda c: F.count(col(c)),
        "numbers": lambda c: F.count(col(c).try_cast("double")),
    }
    found = per_attribute(df, names, measures, "distinct_value_count bigint, filled bigint, numbers bigint")
    is_numeric = F.col("attribute").isin(numeric) if numeric else F.lit(False)
    kind = F.lit(None).cast("string")
    for c in names:
        kind = F.when(F.col("attribute") == c, kinds[c]).otherwise(kind)
    few = F.col("distinct_value_count") < F.least(F.col("filled") * dynamic_threshold, F.lit(float(static_threshold)))
    to_cat = is_numeric & few
    to_num = ~is_numeric & (F.col("filled") > 0) & (F.col("filled") == F.col("numbers")) & ~few
    return found.where(to_cat | to_num).select(
        "attribute",
        F.when(is_numeric, "numerical").otherwise("categorical").alias("original_form"),
        kind.alias("original_dataType"),
        F.when(is_numeric, "categorical").otherwise("numerical").alias("recommended_form"),
        F.when(is_numeric, "string").otherwise("double").alias("recommended_dataType"),
        "distinct_value_count",
    )
