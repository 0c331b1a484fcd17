"""Date and time operators. Columns may be timestamps (with or without zone) or dates; ``output_mode`` is ``replace`` or ``append``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataforge.functions.columns import ACCURACY, Columns, as_list, col, group_quantiles, place

#: Seconds in a unit; months and years are averages.
SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800, "month": 2628000, "year": 31536000}
UNITS = ("hour", "minute", "second", "dayofmonth", "dayofweek", "dayofyear", "weekofyear", "month", "quarter", "year")
#: Strptime directives in the pattern letters of Java.
_DIRECTIVES = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "f": "SSSSSS", "p": "a", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "j": "DDD", "z": "xx", "Z": "VV", "%": "%"}


def java_pattern(text: str) -> str:
    """A strptime format as a Java date-time pattern; letters outside directives are quoted."""
    out, i = [], 0
    while i < len(text):
        if text[i] == "%" and i + 1 < len(text):
            if text[i + 1] not in _DIRECTIVES:
                raise TypeError(f"Invalid format: %{text[i + 1]}")
            out.append(_DIRECTIVES[text[i + 1]])
            i += 2
        elif text[i].isalpha():
            j = i
            while j < len(text) and text[j].isalpha():
                j += 1
            out.append(f"'{text[i:j]}'")
            i = j
        else:
            out.append("''" if text[i] == "'" else text[i])
            i += 1
    return "".join(out)


def _names(df: DataFrame, list_of_cols: Columns) -> list[str]:
    names = as_list(list_of_cols)
    if not names or any(c not in df.columns for c in names):
        raise TypeError("Invalid input for Column(s)")
    return names


def _one_of(value: str, allowed: Sequence[str], what: str) -> str:
    if value not in allowed:
        raise TypeError(f"Invalid input for {what}")
    return value


def _unit(unit: str) -> str:
    unit = unit[:-1] if unit.endswith("s") else unit
    return _one_of(unit, list(SECONDS), "unit")


def _ts(c: str) -> Column:
    return col(c).cast("timestamp")


def _each(df: DataFrame, list_of_cols: Columns, make, suffix: str, output_mode: str) -> DataFrame:
    return place(df, {c: make(c) for c in _names(df, list_of_cols)}, suffix, output_mode)


def _zone(df: DataFrame, tz: str) -> str:
    return df.sparkSession.conf.get("spark.sql.session.timeZone") if tz == "local" else {"gmt": "GMT", "utc": "UTC"}.get(tz.lower(), tz)


def timestamp_to_unix(df: DataFrame, list_of_cols: Columns, precision: str = "s", tz: str = "local", output_mode: str = "replace") -> DataFrame:
    """Whole seconds (``s``) or milliseconds (``ms``); the wall clock is read in ``tz``."""
    _one_of(precision, ("s", "ms"), "precision")
    zone = _zone(df, tz)
    local = lambda c: F.to_utc_timestamp(F.from_utc_timestamp(_ts(c), _zone(df, "local")), zone)
    return _each(df, list_of_cols, lambda c: F.unix_seconds(local(c)) if precision == "s" else F.unix_millis(local(c)), "_unix", output_mode)


def unix_to_timestamp(df: DataFrame, list_of_cols: Columns, precision: str = "s", tz: str = "local", output_mode: str = "replace") -> DataFrame:
    _one_of(precision, ("s", "ms"), "precision")
    zone = _zone(df, tz)
    base = lambda c: F.timestamp_seconds(col(c)) if precision == "s" else F.timestamp_millis(col(c).cast("bigint"))
    return _each(df, list_of_cols, lambda c: F.to_utc_timestamp(F.from_utc_timestamp(base(c), zone), _zone(df, "local")), "_ts", output_mode)


def timezone_conversion(df: DataFrame, list_of_cols: Columns, given_tz: str, output_tz: str, output_mode: str = "replace") -> DataFrame:
    a, b = _zone(df, given_tz), _zone(df, output_tz)
    return _each(df, list_of_cols, lambda c: F.from_utc_timestamp(F.to_utc_timestamp(_ts(c), a), b), "_tzconverted", output_mode)


def string_to_timestamp(df: DataFrame, list_of_cols: Columns, input_format: str = "%Y-%m-%d %H:%M:%S", output_type: str = "ts", output_mode: str = "replace") -> DataFrame:
    """Text that does not fit becomes null."""
    _one_of(output_type, ("ts", "dt"), "output_type")
    pattern = F.lit(java_pattern(input_format))
    make = lambda c: F.try_to_timestamp(col(c), pattern)
    return _each(df, list_of_cols, make if output_type == "ts" else lambda c: make(c).cast("date"), "_ts", output_mode)


def timestamp_to_string(df: DataFrame, list_of_cols: Columns, output_format: str = "%Y-%m-%d %H:%M:%S", output_mode: str = "replace") -> DataFrame:
    return _each(df, list_of_cols, lambda c: F.date_format(col(c), java_pattern(output_format)), "_str", output_mode)


def dateformat_conversion(df: DataFrame, list_of_cols: Columns, input_format: str = "%Y-%m-%d %H:%M:%S", output_format: str = "%Y-%m-%d %H:%M:%S", output_mode: str = "replace") -> DataFrame:
    make = lambda c: F.date_format(F.try_to_timestamp(col(c), F.lit(java_pattern(input_format))), java_pattern(output_format))
    return _each(df, list_of_cols, make, "_dateformat", output_mode)


def time_units_extraction(df: DataFrame, list_of_cols: Columns, units: Columns = "all", output_mode: str = "append") -> DataFrame:
    names, wanted = _names(df, list_of_cols), list(UNITS) if units == "all" else as_list(units)
    for u in wanted:
        _one_of(u, UNITS, "units")
    out = df.withColumns({f"{c}_{u}": getattr(F, u)(col(c)) for c in names for u in wanted})
    return out.drop(*names) if output_mode == "replace" else out


def _between(a: Column, b: Column, unit: str) -> Column:
    """Absolute difference in ``unit``, from whole seconds."""
    return F.abs(F.unix_seconds(a) - F.unix_seconds(b)) / SECONDS[_unit(unit)]


def time_diff(df: DataFrame, ts1: str, ts2: str, unit: str, output_mode: str = "append") -> DataFrame:
    _names(df, [ts1, ts2])
    out = df.withColumn(f"{ts1}_{ts2}_{_unit(unit)}diff", _between(_ts(ts1), _ts(ts2), unit))
    return out.drop(ts1, ts2) if output_mode == "replace" else out


def time_elapsed(df: DataFrame, list_of_cols: Columns, unit: str, output_mode: str = "append", now: object = None) -> DataFrame:
    """Time since (or to) ``now``, the time of the run by default."""
    until = F.current_timestamp() if now is None else F.lit(now)
    return _each(df, list_of_cols, lambda c: _between(_ts(c), until, unit), f"_{_unit(unit)}diff", output_mode)


def adding_time_units(df: DataFrame, list_of_cols: Columns, unit: str, unit_value: int, output_mode: str = "append") -> DataFrame:
    return _each(df, list_of_cols, lambda c: _ts(c) + F.expr(f"INTERVAL {int(unit_value)} {_unit(unit)}"), "_adjusted", output_mode)


def timestamp_comparison(df: DataFrame, list_of_cols: Columns, comparison_type: str, comparison_value: str, comparison_format: str = "%Y-%m-%d %H:%M:%S", output_mode: str = "append") -> DataFrame:
    """1 where it holds, else 0 (for null too)."""
    tests = {"greater_than": "__gt__", "less_than": "__lt__", "greaterThan_equalTo": "__ge__", "lessThan_equalTo": "__le__"}
    _one_of(comparison_type, list(tests), "comparison_type")
    value = F.to_timestamp(F.lit(comparison_value), java_pattern(comparison_format))
    return _each(df, list_of_cols, lambda c: F.when(getattr(_ts(c), tests[comparison_type])(value), 1).otherwise(0), "_compared", output_mode)


def _day(c: str) -> Column:
    return col(c).cast("date")


_STARTS = {"month": lambda c: F.trunc(_day(c), "month"), "quarter": lambda c: F.trunc(_day(c), "quarter"), "year": lambda c: F.trunc(_day(c), "year")}
_ENDS = {"month": lambda c: F.last_day(_day(c)), "quarter": lambda c: F.date_sub(F.add_months(F.trunc(_day(c), "quarter"), 3), 1), "year": lambda c: F.make_date(F.year(_day(c)), F.lit(12), F.lit(31))}


def _edge(of: dict, unit: str, suffix: str):
    def edge(df: DataFrame, list_of_cols: Columns, output_mode: str = "append") -> DataFrame:
        return _each(df, list_of_cols, of[unit], suffix, output_mode)

    return edge


def _is_edge(of: dict, unit: str, suffix: str):
    def is_edge(df: DataFrame, list_of_cols: Columns, output_mode: str = "append") -> DataFrame:
        """1, 0, or null for null."""
        return _each(df, list_of_cols, lambda c: (_day(c) == of[unit](c)).cast("int"), suffix, output_mode)

    return is_edge


start_of_month, end_of_month = _edge(_STARTS, "month", "_monthStart"), _edge(_ENDS, "month", "_monthEnd")
start_of_quarter, end_of_quarter = _edge(_STARTS, "quarter", "_quarterStart"), _edge(_ENDS, "quarter", "_quarterEnd")
start_of_year, end_of_year = _edge(_STARTS, "year", "_yearStart"), _edge(_ENDS, "year", "_yearEnd")
is_month_start, is_month_end = _is_edge(_STARTS, "month", "_ismonthStart"), _is_edge(_ENDS, "month", "_ismonthEnd")
is_quarter_start, is_quarter_end = _is_edge(_STARTS, "quarter", "_isquarterStart"), _is_edge(_ENDS, "quarter", "_isquarterEnd")
is_year_start, is_year_end = _is_edge(_STARTS, "year", "_isyearStart"), _is_edge(_ENDS, "year", "_isyearEnd")


def is_year_first_half(df: DataFrame, list_of_cols: Columns, output_mode: str = "append") -> DataFrame:
    return _each(df, list_of_cols, lambda c: (F.month(col(c)) <= 6).cast("int"), "_isFirstHalf", output_mode)


def is_selected_hour(df: DataFrame, list_of_cols: Columns, start_hour: int, end_hour: int, output_mode: str = "append") -> DataFrame:
    """Both hours included; a start after the end runs over midnight."""
    hour = lambda c: F.hour(col(c))
    inside = (lambda c: hour(c).between(start_hour, end_hour)) if start_hour <= end_hour else (lambda c: (hour(c) >= start_hour) | (hour(c) <= end_hour))
    return _each(df, list_of_cols, lambda c: inside(c).cast("int"), "_isselectedHour", output_mode)


def is_leap_year(df: DataFrame, list_of_cols: Columns, output_mode: str = "append") -> DataFrame:
    def leap(c: str) -> Column:
        y = F.year(col(c))
        return ((y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))).cast("int")

    return _each(df, list_of_cols, leap, "_isleapYear", output_mode)


def is_weekend(df: DataFrame, list_of_cols: Columns, output_mode: str = "append") -> DataFrame:
    return _each(df, list_of_cols, lambda c: F.dayofweek(col(c)).isin(1, 7).cast("int"), "_isweekend", output_mode)


def aggregator(df: DataFrame, list_of_cols: Columns, list_of_aggs: Columns, time_col: str, granularity_format: str = "%Y-%m-%d", accuracy: int = ACCURACY) -> DataFrame:
    """Aggregates by the formatted time; ``median`` is a value of the data and exact, whatever the ``accuracy``."""
    makers = {
        "count": F.count,
        "min": F.min,
        "max": F.max,
        "sum": F.sum,
        "mean": F.avg,
        "median": None,  # by a sort of its own
        "stddev": F.stddev_samp,
        "countDistinct": F.count_distinct,
        "sumDistinct": F.sum_distinct,
        "collect_list": F.collect_list,
        "collect_set": F.collect_set,
    }
    names, aggs = _names(df, list_of_cols), as_list(list_of_aggs)
    for a in aggs:
        _one_of(a, list(makers), "list_of_aggs")
    bucket = F.date_format(col(time_col), java_pattern(granularity_format)) if granularity_format else col(time_col)
    plain = [makers[a](col(c)).alias(f"{c}_{a}") for c in names for a in aggs if a != "median"]
    out = df.groupBy(bucket.alias(time_col)).agg(*plain) if plain else df.select(bucket.alias(time_col)).distinct()
    if "median" not in aggs:
        return out
    for c in names:
        middle = group_quantiles(df.select(bucket.alias("_time"), col(c).alias("_value")), ["_time"], "_value", [0.5]).select("_time", F.col("q")[0].alias(f"{c}_median"))
        out = out.join(middle, out[f"`{time_col}`"].eqNullSafe(middle["_time"]), "left").drop("_time")
    return out.select(col(time_col), *(col(f"{c}_{a}") for c in names for a in aggs))


def window_aggregator(df: DataFrame, list_of_cols: Columns, list_of_aggs: Columns, order_col: str, window_type: str = "expanding", window_size: int | str = "unbounded", partition_col: str | None = None, output_mode: str = "append", accuracy: int = 10_000) -> DataFrame:
    """Aggregates over the rows so far (``expanding``) or the ``window_size`` rows before and the row itself (``rolling``).

    Without ``partition_col`` the rows have one order as a whole, which one task has to follow; give a partition on large data.
    """
    makers = {"count": F.count, "min": F.min, "max": F.max, "sum": F.sum, "mean": F.avg, "median": lambda c: F.percentile_approx(c, 0.5, accuracy)}
    names, aggs = _names(df, list_of_cols), as_list(list_of_aggs)
    for a in aggs:
        _one_of(a, list(makers), "list_of_aggs")
    _one_of(window_type, ("expanding", "rolling"), "window_type")
    before = Window.unboundedPreceding if window_type == "expanding" else -int(window_size)
    keys = as_list(partition_col)
    w = Window.partitionBy(*(col(k) for k in keys)).orderBy(col(order_col)).rowsBetween(before, 0)
    out = df.withColumns({f"{c}_{a}": makers[a](col(c)).over(w) for c in names for a in aggs})
    return out.drop(*names) if output_mode == "replace" else out


def lagged_ts(df: DataFrame, list_of_cols: Columns, lag: int, output_type: str = "ts", tsdiff_unit: str = "days", partition_col: str | None = None, output_mode: str = "append") -> DataFrame:
    """The time ``lag`` rows before, or the difference from it."""
    _one_of(output_type, ("ts", "ts_diff"), "output_type")
    names, keys = _names(df, list_of_cols), as_list(partition_col)
    made = {}
    for c in names:
        earlier = F.lag(_ts(c), int(lag)).over(Window.partitionBy(*(col(k) for k in keys)).orderBy(col(c)))
        made[f"{c}_lag{lag}"] = earlier
        if output_type == "ts_diff":
            made = {f"{c}_{c}_lag{lag}_{_unit(tsdiff_unit)}diff": _between(_ts(c), earlier, tsdiff_unit), **{k: v for k, v in made.items() if not k.startswith(f"{c}_lag")}}
    out = df.withColumns(made)
    return out.drop(*names) if output_mode == "replace" else out
