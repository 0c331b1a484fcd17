"""Tables behind charts and report tabs, and charts as JSON objects.

All tables are DataFrames; what is turned into JSON is bounded by bins, categories, days or a documented number of rows.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataforge.functions.columns import Columns, as_list, col, group_quantiles, model_frame, resolve, type_classes, union_all
from strataforge.functions.paths import ends_with
from strataforge.operators import binning, timeseries
from strataforge.operators.imputation import impute_mmm
from strataforge.plans import report

#: Saved statistics that a function takes, and the function that writes each.
_TAKES = {"biasedness_detection": ("stats_mode",), "IDness_detection": ("stats_unique",), "nullColumns_detection": ("stats_unique", "stats_mode", "stats_missing"), "variable_clustering": ("stats_mode",)}
_SAVED = {"stats_unique": "measures_of_cardinality", "stats_mode": "measures_of_centralTendency", "stats_missing": "measures_of_counts"}
#: Upper ends of the power's ranges and what a power in them is called.
_POWERS = ((-1, "Reciprocal Square Transform"), (-0.5, "Reciprocal Transform"), (0, "Receiprocal Square Root Transform"), (0.5, "Log Transform"), (1, "Square Root Transform"), (2, "No Transform"))


def saved_stats(path: str, function: str) -> dict[str, dict]:
    """Where the saved statistics that ``function`` takes are, as arguments of ``read_dataset``."""
    return {a: {"file_path": f"{ends_with(path)}{_SAVED[a]}.csv", "file_type": "csv", "file_configs": {"header": True, "inferSchema": True}} for a in _TAKES.get(function, ())}


def title(metric: str) -> str:
    """A metric's name as words: ``nullRows_detection`` as Null Detection."""
    return " ".join("Null" if w in ("nullRows", "nullColumns") else w[:1].upper() + w[1:] for w in metric.split("_"))


def power_name(power: float) -> str:
    return next((name for end, name in _POWERS if power < end), "Square Transform" if power >= 2 else "ValueOutOfRange")


def plain_names(names: Sequence[str]) -> list[str]:
    """Time columns without the ending of converted ones."""
    return [n.removesuffix("_ts") for n in names]


def converted_names(names: Sequence[str]) -> list[str]:
    return [n if n.endswith("_ts") else n + "_ts" for n in names]


# Bins, outliers, charts of attributes


def range_text(label: Column) -> Column:
    """A bin's range whose ends are the same as that one number."""
    ends = F.split(label, "-")
    return F.when(F.size(F.array_distinct(ends)) < F.size(ends), ends[0]).otherwise(label)


def bin_index(df: DataFrame, name: str, cuts: Sequence[float]) -> DataFrame:
    """(bin_idx, name) of every bin: its number and its range."""
    text = [str(round(float(x), 4)) for x in cuts]
    labels = ["<= " + text[0], *(f"{a}-{b}" for a, b in zip(text, text[1:])), "> " + text[-1]]
    return model_frame(df, [(i + 1, x) for i, x in enumerate(labels)], f"bin_idx int, `{name}` string").withColumn(name, range_text(col(name)))


def outlier_spread(df: DataFrame, list_of_cols: Columns = "all", drop_cols: Columns = (), split_col: str | None = None, accuracy: int = 100_000) -> DataFrame:
    """Per attribute (and group): quartiles, the fences 1.5 quartile ranges from them and rows outside: a violin's or box's outline, of all
    rows. Quartiles are exact, whatever the ``accuracy``."""
    names = [c for c in resolve(df, list_of_cols, drop_cols, type_classes(df)[0]) if c != split_col]
    group = [col(split_col).alias("group")] if split_col else []
    cells = F.array(*(F.struct(F.lit(c).alias("attribute"), col(c).cast("double").alias("v")) for c in names))
    long = df.select(*group, F.inline(cells))
    keys = [*(["group"] if split_col else []), "attribute"]
    q = group_quantiles(long, keys, "v", [0.25, 0.5, 0.75])
    q = q.select(*keys, "min", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "max")
    q = q.withColumns({"lower_fence": F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), "upper_fence": F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))})
    # Fences are one row per attribute and group.
    out = long.join(F.broadcast(q), keys).groupBy(*keys).agg(F.count_if((F.col("v") < F.col("lower_fence")) | (F.col("v") > F.col("upper_fence"))).alias("outliers"))
    return q.join(out, keys)


def outlier_points(df: DataFrame, name: str, split_col: str | None = None, sample_size: int = 500_000, seed: int = 0) -> DataFrame:
    """Values for a violin: a sample of about ``sample_size`` rows, nulls as the median."""
    part = df.select(*dict.fromkeys([name, *([split_col] if split_col else [])]))
    rows = part.count()
    return impute_mmm(part.sample(False, min(1.0, sample_size / rows), seed) if rows else part, name)


def chart_tables(df: DataFrame, list_of_cols: Columns = "all", drop_cols: Columns = (), label_col: str | None = None, event_label: object = 1, bin_method: str = "equal_range", bin_size: int = 10, source: DataFrame | None = None, outlier_charts: bool = False, most: int = 200) -> dict[str, DataFrame]:
    """Tables by chart: ``freqDist_``, ``eventDist_``, ``drift_`` and ``outlier_`` with the attribute's name. Categories beyond the ``most`` frequent
    are left to the full ``report.frequency``: a chart can't show them."""
    names = [c for c in resolve(df, list_of_cols, drop_cols) if c != label_col]
    numeric = [c for c in names if c in type_classes(df)[0]]
    cuts = binning.cutoffs(source if source is not None else df, numeric, bin_method, bin_size) if numeric else {}
    out = {}
    for c in names:
        if c in numeric and c not in cuts:
            continue
        out[f"freqDist_{c}"] = report.frequency(df, c, cuts.get(c)).orderBy(F.desc("count"), c).limit(max(most, bin_size + 1))
        if label_col:
            out[f"eventDist_{c}"] = report.event_rate(df, c, label_col, event_label, cuts.get(c))
        if source is not None:
            out[f"drift_{c}"] = report.comparative_drift(df, source, c, cuts)
        if outlier_charts and c in numeric:
            out[f"outlier_{c}"] = outlier_spread(df, c)
    return out


#: Kind of chart, its axis and its value by the beginning of a table's name.
_KINDS = {"freqDist_": ("bar", "count"), "eventDist_": ("bar", "event_rate"), "drift_": ("line", "%_diff"), "outlier_": ("box", "median")}


def chart(name: str, table: DataFrame, rows: int = 1000) -> dict:
    """A chart as an object: kind, title, names of axis and value, and its rows."""
    kind, value = next((v for k, v in _KINDS.items() if name.startswith(k)), ("line", table.columns[-1]))
    data = [json.loads(x) for x in table.limit(rows).toJSON().collect()]
    return {"name": name, "type": kind, "title": title(name), "x": table.columns[0], "y": value, "data": data}


def charts_to_objects(df: DataFrame, folder: str | None = None, **args) -> dict[str, dict]:
    """All charts of ``chart_tables``; written to ``folder`` as one JSON text each if one is given."""
    made = {name: chart(name, table) for name, table in chart_tables(df, **args).items()}
    if folder:
        rows = [(name, json.dumps(x)) for name, x in made.items()]
        model_frame(df, rows, "name string, value string").write.mode("overwrite").partitionBy("name").text(folder)
    return made


def charts_in(df_or_spark, folder: str, kind: str, names: Columns | None = None) -> dict[str, dict]:
    """Charts of one kind (``freqDist_`` and so on) that ``charts_to_objects`` has written, all or those of some attributes."""
    spark = getattr(df_or_spark, "sparkSession", df_or_spark)
    rows = spark.read.text(folder).where(F.col("name").startswith(kind)).collect()
    wanted = {kind + n for n in as_list(names)} if names else None
    return {r["name"]: json.loads(r["value"]) for r in rows if wanted is None or r["name"] in wanted}


# Stability, dictionary, tabs


def stability_lines(history: DataFrame, index: DataFrame, names: Columns = "all") -> DataFrame:
    """Per attribute, period and measure (mean, stddev, kurtosis) its value, with the attribute's index and band."""
    part = history if names == "all" else history.where(F.col("attribute").isin(as_list(names)))
    long = part.unpivot(["attribute", "idx"], ["mean", "stddev", "kurtosis"], "measure", "value")
    return long.join(index.select("attribute", "stability_index", report.stability_band(F.col("stability_index")).alias("band")), "attribute", "left")


def data_dictionary(df: DataFrame, descriptions: DataFrame | None = None) -> DataFrame:
    """(attribute, data_type, definition), in the order of the columns where no definitions are joined."""
    kinds = model_frame(df, df.dtypes, "attribute string, data_type string")
    return kinds.withColumn("definition", F.lit(None).cast("string")) if descriptions is None else kinds.join(descriptions.select("attribute", "definition"), "attribute", "left")


#: Tables of each tab by the beginnings of their names.
TABS = {
    "Descriptive Statistics": ("global_summary", "measures_of_", "freqDist_", "eventDist_"),
    "Quality Check": ("duplicate_detection", "nullRows_detection", "nullColumns_detection", "IDness_detection", "biasedness_detection", "invalidEntries_detection", "outlier_detection", "outlier_"),
    "Attribute Associations": ("correlation_matrix", "variable_clustering", "IV_calculation", "IG_calculation"),
    "Data Drift & Data Stability": ("drift_", "stability_", "feature_stability"),
    "Time Series": ("timeseries_", "ts_"),
    "Geospatial": ("geospatial_", "location_", "clusters_"),
    "Wiki": ("data_dictionary", "metric_dictionary"),
}


def tabs(tables: Mapping[str, DataFrame]) -> dict[str, dict[str, DataFrame]]:
    """Tables by tab, in a tab by their titles; tables of no tab come under ``Other``, tabs without tables are left out."""
    out: dict[str, dict[str, DataFrame]] = {t: {} for t in [*TABS, "Other"]}
    for name, table in tables.items():
        bare = name.rpartition("/")[2] if not name.startswith(("timeseries_", "geospatial_")) else name
        tab = next((t for t, begins in TABS.items() if bare.startswith(begins)), "Other")
        out[tab][title(bare.replace("/", "_"))] = table
    return {t: v for t, v in out.items() if v}


def page(tables: Mapping[str, DataFrame], heading: str = "Report", rows: int = 1000) -> str:
    """One HTML page of all tabs."""
    flat = {f"{t}: {name}": table for t, some in tabs(tables).items() for name, table in some.items()}
    return report.html(flat, heading, rows)


# Time series


def ts_views(df: DataFrame, time_col: str, value_cols: Columns, output_type: str = "daily") -> dict[str, DataFrame]:
    """The profile of each value over time, part of the day or day of the week."""
    return {f"ts_{c}_{output_type}": timeseries.profile(df, time_col, c, output_type) for c in as_list(value_cols)}


def ts_decompositions(df: DataFrame, time_col: str, value_col: str, period: int = 12, least: int = 24) -> DataFrame:
    """Decompositions of the daily mean, median, min and max, by ``metric``; none where there are under ``least`` days."""
    days = timeseries.profile(df, time_col, value_col)
    found = [timeseries.decomposition(days, time_col, m, period).select(F.lit(m).alias("metric"), "*") for m in ("mean", "median", "min", "max")]
    many = days.agg((F.count(F.lit(1)) >= least).alias("_many"))
    return union_all(found).join(F.broadcast(many)).where("_many").drop("_many")


def ts_tests(df: DataFrame, time_col: str, value_col: str, least: int = 6, max_days: int = 3600) -> DataFrame:
    """Per metric of the daily profile: Dickey-Fuller and KPSS statistics, Yeo-Johnson's power and its name. Of the last ``max_days`` days, one row each."""
    days = timeseries.profile(df, time_col, value_col).dropna().orderBy(F.desc(time_col)).limit(max_days).toPandas().sort_values(time_col)
    rows = []
    for m in ("mean", "median", "min", "max"):
        if len(days) >= least:
            x = timeseries.stationarity(days[m].to_numpy(float))
            rows.append((m, x["adf"], x["kpss"], x["yeo_johnson_lambda"], power_name(x["yeo_johnson_lambda"])))
    return model_frame(df, rows, "metric string, adf double, kpss double, yeo_johnson_lambda double, transform string")


def ts_landscape(df: DataFrame, time_cols: Columns, id_col: str) -> dict[str, DataFrame]:
    """Eligibility tables of every time column."""
    return {f"ts_{c}_eligibility_{k}": timeseries.eligibility(df, id_col, c, k) for c in as_list(time_cols) for k in (1, 2)}


# Locations


def location_fields(df: DataFrame, lat_cols: Sequence[str], long_cols: Sequence[str], geohash_cols: Sequence[str]) -> DataFrame:
    """(field, columns, count) of latitude, longitude and geohash columns."""
    rows = [(k, ",".join(v or ()), len(v or ())) for k, v in (("Latitude Col", lat_cols), ("Longitude Col", long_cols), ("Geohash Col", geohash_cols))]
    return model_frame(df, rows, "field string, columns string, count int")


def location_tables(df: DataFrame, id_col: str, top_geo_records: int = 100, clusters: Mapping | None = None) -> dict[str, DataFrame]:
    """Fields, summaries, top locations and, with ``clusters`` (arguments of ``cluster_all``), cluster sizes with their middles."""
    from strataforge.operators import geospatial

    lats, lons, hashes = geospatial.detect_locations(df)
    out = {"location_fields": location_fields(df, lats, lons, hashes)}
    for name, (summary, top) in geospatial.geospatial_profile(df, id_col, top_geo_records).items():
        out |= {f"location_summary_{name}": summary, f"location_top_{name}": top}
    if clusters is not None:
        for name, pair in geospatial.cluster_all(df, lats, lons, hashes, **clusters).items():
            for kind, points in zip(("kmeans", "density"), pair, strict=True):
                out[f"clusters_{kind}_{name}"] = cluster_sizes(points)
    return out


def cluster_sizes(points: DataFrame) -> DataFrame:
    """Per cluster its rows and mean position; ``points``: latitude, longitude, cluster."""
    a, b = (c for c in points.columns if c != "cluster")
    return points.groupBy("cluster").agg(F.count(F.lit(1)).alias("count"), F.avg(col(a)).alias("latitude"), F.avg(col(b)).alias("longitude"))
