"""Operators on small frames, with known results and error paths."""

import pytest
from pyspark.sql import functions as F

from strataforge.functions import datetime as dt
from strataforge.functions import geo as G
from strataforge.functions.columns import resolve, transpose
from strataforge.functions.formula import parse
from strataforge.operators import association, binning, drift, geospatial, imputation, quality, sampling, stats, timeseries, transform
from strataforge.plans import featurestore, pipeline, report
from strataforge.sources import io


@pytest.fixture(scope="module")
def people(spark):
    rows = [("27520a", 51, 9000, "HS-grad"), ("10a", 42, 7000, "Postgrad"), ("11a", 55, None, None), ("1100b", 23, 6000, "HS-grad"), ("1100b", 23, 6000, "HS-grad")]
    return spark.createDataFrame(rows, "ifa string, age bigint, income bigint, education string")


def by(df, key="attribute"):
    return {r[key]: r.asDict() for r in df.collect()}


def test_resolver(people):
    assert resolve(people, "income|age|income", "age") == ["income"]
    with pytest.raises(TypeError):
        resolve(people, "nothing")
    with pytest.raises(TypeError):
        resolve(people, "age", "age")


def test_counts_and_modes(people):
    c = by(stats.measures_of_counts(people))
    assert c["education"]["missing_count"] == 1 and c["education"]["missing_pct"] == 0.2 and c["education"]["nonzero_count"] is None
    assert c["income"]["nonzero_count"] == 4 and c["income"]["nonzero_pct"] == 0.8
    m = by(stats.mode(people))
    assert (m["education"]["mode"], m["education"]["mode_rows"]) == ("HS-grad", 3)
    assert by(stats.unique_count(people))["ifa"]["unique_values"] == 4
    assert by(stats.measures_of_cardinality(people, use_approx_unique_count=False))["ifa"]["IDness"] == 0.8


def test_statistics_of_an_empty_frame(spark, people):
    empty = people.limit(0)
    assert by(stats.measures_of_counts(empty))["age"]["fill_pct"] is None
    assert by(stats.measures_of_dispersion(empty))["age"]["stddev"] is None
    assert stats.measures_of_shape(people.select("ifa")).count() == 0
    assert quality.duplicate_detection(empty)[1].count() == 4


def test_ingest(spark, people, tmp_path):
    io.write_dataset(people, str(tmp_path / "x"), "csv", {"header": "true", "repartition": 1}, ["education", "income", "age", "ifa"])
    back = io.read_dataset(spark, str(tmp_path / "x"), "csv", {"header": "true", "inferSchema": "true"})
    assert back.columns == ["education", "income", "age", "ifa"] and back.count() == 5
    with pytest.raises(ValueError):
        io.write_dataset(people, str(tmp_path / "y"), "csv", {}, ["age"])
    with pytest.raises(ValueError):
        io.join_dataset(people, people, join_cols="ifa", join_type="inner")
    assert io.recast_column(people, "ifa", "int").where("ifa is not null").count() == 0
    assert io.concatenate_dataset(people, people.select("education", "income", "age", "ifa")).count() == 10


def test_quality(people):
    assert {r["metric"]: r["value"] for r in quality.duplicate_detection(people)[1].collect()} == {"rows_count": 5.0, "unique_rows_count": 4.0, "duplicate_rows": 1.0, "duplicate_pct": 0.2}
    kept, found = quality.null_rows_detection(people, treatment=True, treatment_threshold=0.4)
    assert kept.count() == 4 and sum(r["row_count"] for r in found.collect()) == 5
    assert quality.null_columns_detection(people, treatment=True, treatment_method="column_removal", treatment_configs={"treatment_threshold": 0.1})[0].columns == ["ifa", "age"]
    with pytest.raises(TypeError):
        quality.outlier_detection(people, "ifa")


def test_outlier_model_round_trip(spark, tmp_path):
    x = spark.range(1000).select((F.col("id") * 1.0).alias("v"), F.lit(1.0).alias("flat"))
    out, found = quality.outlier_detection(x, detection_side="both", model_path=str(tmp_path))
    assert by(found)["flat"]["excluded_due_to_skewness"] == 1
    again, _ = quality.outlier_detection(x, detection_side="both", pre_existing_model=True, model_path=str(tmp_path))
    assert out.agg(F.sum("v")).first() == again.agg(F.sum("v")).first()


def test_invalid_entries(spark):
    x = spark.createDataFrame([("Na",), ("aaa",), ("abcd",), ("?",), ("fine",), (None,)], "v string")
    cleaned, found = quality.invalid_entries_detection(x, treatment=True)
    r = found.first()
    assert r["invalid_count"] == 4 and r["invalid_entries"] == "?|Na|aaa|abcd"
    assert [v["v"] for v in cleaned.where("v is not null").collect()] == ["fine"]
    assert quality.invalid_entries_detection(x, detection_type="manual", valid_entries=["f.*"])[1].first()["invalid_count"] == 4


def test_drift_goldens(spark):
    values = [0.34, -1.76, 0.32, -0.39, -0.67, 0.61, 1.03, 0.93, -0.84, -0.31]
    source = spark.createDataFrame([(v, v) for v in values], "A double, B double")
    target = source.withColumn("B", F.col("B") - 1)
    r = by(drift.drift_statistics(target, source, method_type="all"))
    assert [round(r["B"][k], 4) for k in drift.DISTANCES] == [7.6776, 0.7091, 0.3704, 0.4999] and r["B"]["flagged"] == 1
    assert [round(r["A"][k], 4) for k in drift.DISTANCES] == [0, 0, 0, 0] and r["A"]["flagged"] == 0
    r = by(drift.drift_statistics(target, source, method_type="all", bin_method="equal_frequency"))
    assert [round(r["B"][k], 4) for k in drift.DISTANCES] == [3.0899, 0.4775, 0.1769, 0.4]


def test_drift_saved_source(spark, tmp_path):
    source = spark.range(100).select(F.col("id").cast("double").alias("v"), (F.col("id") % 3).cast("string").alias("c"))
    target = source.where("v > 20")
    first = drift.drift_statistics(target, source, source_save=True, source_path=str(tmp_path))
    again = drift.drift_statistics(target, None, pre_existing_source=True, source_path=str(tmp_path))
    assert {k: round(v["PSI"], 9) for k, v in by(first).items()} == {k: round(v["PSI"], 9) for k, v in by(again).items()}


def test_stability(spark, tmp_path):
    periods = [spark.range(n).select((F.col("id") * 1.0 + 100).alias("A")) for n in (50, 50, 50)]
    r = drift.stability_index_computation(periods, "A", appended_metric_path=str(tmp_path / "m")).first()
    assert r["stability_index"] == 4.0 and r["flagged"] == 0
    more = drift.stability_index_computation(periods[:1], "A", existing_metric_path=str(tmp_path / "m")).first()
    assert more["mean_cv"] == 0
    with pytest.raises(ValueError):
        drift.stability_index_computation(periods, "A", metric_weightages={"mean": 0.5})


def test_scores(spark):
    x = spark.createDataFrame([(0.02,), (0.05,), (0.15,), (0.3,), (0.9,), (None,)], "v double")
    assert [r[0] for r in x.select(drift.score_cv(F.col("v"))).collect()] == [4, 3, 2, 1, 0, None]
    assert [r[0] for r in x.select(drift.score_sd(F.col("v"))).collect()] == [3.0, 1.5, 0.0, 0.0, 0.0, None]


def test_formula():
    f = parse("A**2 + 3*B/A - exp(B)")
    at, h = {"A": 2.0, "B": 0.5}, 1e-6
    for x in "AB":
        up, down = {**at, x: at[x] + h}, {**at, x: at[x] - h}
        assert abs(f.derivative(x)(at) - (f(up) - f(down)) / (2 * h)) < 1e-5
    with pytest.raises(TypeError):
        parse("__import__('os')")


def test_binning(spark, tmp_path):
    x = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (10.0,), (float("nan"),), (None,)], "v double")
    y = x.where("not isnan(v) or v is null")
    assert [r[0] for r in binning.attribute_binning(y, "v", bin_size=10).collect()] == [1, 1, 2, 10, None]
    assert binning.attribute_binning(y, "v", bin_size=5, bin_dtype="categorical").first()[0] == "<= 2.0"
    binning.attribute_binning(y, "v", model_path=str(tmp_path))
    assert [r[0] for r in binning.attribute_binning(x, "v", pre_existing_model=True, model_path=str(tmp_path)).collect()] == [1, 1, 2, 10, 10, None]
    z = spark.range(100).select(F.col("id").cast("double").alias("v"), (F.col("id") > 50).cast("int").alias("label"))
    assert binning.monotonic_binning(z, "v", bin_size=7).agg(F.max("v")).first()[0] >= 3


def test_encoding_and_scaling(spark, people, tmp_path):
    e = transform.cat_to_num_unsupervised(people, "education", model_path=str(tmp_path))
    assert [r["education"] for r in e.collect()] == [0, 1, None, 0, 0] and e.columns == people.columns
    again = transform.cat_to_num_unsupervised(people, "education", pre_existing_model=True, model_path=str(tmp_path))
    assert again.collect() == e.collect()
    t = transform.cat_to_num_supervised(people.withColumn("label", (F.col("age") > 45).cast("int")), "education").collect()
    assert {r["ifa"]: r["education"] for r in t}["10a"] == 0.0 and {r["ifa"]: r["education"] for r in t}["11a"] is None
    z = transform.z_standardization(people, "age").agg(F.round(F.avg("age"), 9), F.round(F.stddev("age"), 9)).first()
    assert tuple(z) == (0.0, 1.0)
    n = transform.normalization(people.withColumn("flat", F.lit(3.0)), "age|flat").agg(F.min("age"), F.max("age"), F.max("flat")).first()
    assert tuple(n) == (0.0, 1.0, 0.5)


def test_imputation(spark, people):
    m = imputation.impute_mmm(people, method_type="mean").where("ifa = '11a'").first()
    assert m["income"] == 7000 and m["education"] == "HS-grad"
    x = spark.range(60).select(F.col("id").cast("double").alias("a"), F.when(F.col("id") % 6 != 0, F.col("id") * 2.0).alias("b"))
    r = imputation.impute_model(x, method_type="regression").where("a = 30").first()
    assert abs(r["b"] - 60) < 1
    assert imputation.impute_model(x, method_type="KNN").where("b is null").count() == 0
    assert imputation.impute_factorization(x.withColumn("k", F.col("a").cast("bigint")), id_col="k", rank=1, iterations=3).where("b is null").count() == 0
    assert imputation.auto_imputation(x).where("b is null").count() == 0


def test_latent(spark):
    x = spark.range(50).select(F.col("id").cast("double").alias("a"), (F.col("id") * 2.0).alias("b"), F.sin(F.col("id")).alias("c"))
    assert [c for c in transform.pca_latent_features(x).columns if c.startswith("latent")] == ["latent_0", "latent_1"]
    assert transform.autoencoder_latent_features(x, reduction_params=1, epochs=2).columns == ["latent_0"]


def test_association(spark):
    x = spark.range(400).select((F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 7 * 2.0 + F.col("id") % 2).alias("b"), F.sin(F.col("id") * 12.9).alias("c"), (F.col("id") % 7 > 3).cast("int").alias("label"))
    iv = by(association.iv_calculation(x))
    assert iv["a"]["iv"] > iv["c"]["iv"]
    ig = by(association.ig_calculation(x))
    assert ig["a"]["ig"] > 0.9 > ig["c"]["ig"]
    y = x.drop("label").withColumn("d", F.col("c") + F.col("b") / 100)
    groups = {r["Attribute"]: r["Cluster"] for r in association.variable_clustering(y).collect()}
    assert groups["a"] == groups["b"] != groups["c"] == groups["d"]


def test_datetime(spark):
    x = spark.sql("select timestamp'2024-02-29 23:30:00' as t union all select cast(null as timestamp)")
    r = dt.is_leap_year(dt.is_month_end(dt.end_of_quarter(x, "t"), "t"), "t").orderBy(F.desc("t")).collect()
    assert str(r[0]["t_quarterEnd"]) == "2024-03-31" and r[0]["t_ismonthEnd"] == 1 and r[0]["t_isleapYear"] == 1 and r[1]["t_isleapYear"] is None
    assert dt.is_selected_hour(x, "t", 22, 4).where("t is not null").first()["t_isselectedHour"] == 1
    bad = spark.createDataFrame([("2024-13-01",), ("2024-12-01",)], "t string")
    assert [str(v[0]) for v in dt.string_to_timestamp(bad, "t", "%Y-%m-%d", "dt").collect()] == ["None", "2024-12-01"]
    with pytest.raises(TypeError):
        dt.time_units_extraction(x, "t", "century")


def test_geo(spark):
    x = spark.createDataFrame([(57.64911, 10.40744)], "lat double, lon double")
    assert x.select(G.geohash(F.col("lat"), F.col("lon"), 11)).first()[0] == "u4pruydqqvj"
    back = x.select(*G.from_geohash(F.lit("u4pruydqqvj"))).first()
    assert abs(back[0] - 57.64911) < 1e-5 and abs(back[1] - 10.40744) < 1e-5
    flinders = x.select(G.vincenty(F.lit(-37.95103342), F.lit(144.42486789), F.lit(-37.65282114), F.lit(143.92649553))).first()[0]
    assert abs(flinders - 54972.271) < 0.01
    square = {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 4], [0, 4]]]}}
    points = spark.createDataFrame([(1.0, 1.0), (4.0, 2.0), (5.0, 5.0)], "lat double, lon double")
    assert [r[-1] for r in geospatial.location_in_polygon(points, "lat", "lon", square).collect()] == [1, 1, 0]
    c = geospatial.centroid(spark.createDataFrame([(0.0, 10.0), (0.0, 20.0), (99.0, 0.0)], "lat double, lon double"), "lat", "lon").first()
    assert abs(c["lon_centroid"] - 15) < 1e-9


def test_location_detection(spark):
    x = spark.range(200).select(((F.col("id") % 80) + 0.5).alias("latitude"), ((F.col("id") % 160) + 0.25).alias("longitude"), G.geohash((F.col("id") % 80) + 0.5, (F.col("id") % 160) + 0.25, 7).alias("gh"))
    assert geospatial.detect_locations(x) == (["latitude"], ["longitude"], ["gh"])


def test_timeseries(spark):
    x = spark.createDataFrame([("20240131", "1700000000", "word"), ("20240201", "1700000100", "other")], "a string, b string, c string")
    out, kinds = timeseries.detect_timestamps(x)
    assert set(kinds) == {"a", "b"} and dict(out.dtypes)["a"] == "timestamp"
    parts = timeseries.seasonal_decompose([float(i % 12 + i) for i in range(60)])
    assert abs(parts["residual"][20]) < 1e-9
    assert set(timeseries.stationarity([float(i % 5) for i in range(50)])) == {"adf", "kpss", "yeo_johnson_lambda"}


def test_sampling(spark):
    x = spark.range(4000).select(F.when(F.col("id") < 400, "a").otherwise("b").alias("k"), "id")
    got = {r["k"]: r["n"] for r in sampling.data_sample(x, "k", fraction=0.5, method_type="stratified", stratified_type="balanced").groupBy("k").agg(F.count("*").alias("n")).collect()}
    assert 130 < got["a"] < 270 and 130 < got["b"] < 270


def test_point_in_time(spark):
    e = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "u int, t int").withColumn("t", F.timestamp_seconds("t"))
    f = spark.createDataFrame([(1, 2, "x"), (1, 5, "y"), (1, 6, "z")], "u int, ft int, v string").withColumn("ft", F.timestamp_seconds("ft"))
    got = {(r["u"], r["t"].second): r["v"] for r in featurestore.point_in_time_join(e, f, ["u"], "t", "ft").collect()}
    assert got == {(1, 5): "y", (1, 1): None, (2, 9): None}


def test_feature_store_text():
    config = {"file_path": "p", "entity": {"name": "person", "id_col": "ifa"}, "file_source": {"event_timestamp": "ev", "create_timestamp": "cr"}, "feature_view": {"name": "view", "ttl_in_seconds": 10}, "service_name": "svc"}
    featurestore.check_config(config, 1)
    text = featurestore.definitions([("ifa", "string"), ("age", "bigint"), ("d", "decimal(3,1)")], config, "x.parquet")
    compile(text, "x", "exec")
    assert 'Field(name="age", dtype=Int64)' in text and "ifa\", dtype" not in text
    with pytest.raises(ValueError):
        featurestore.check_config(config, 2)


def test_pipeline(spark, people, tmp_path):
    people.write.parquet(str(tmp_path / "in"))
    config = {
        "input_dataset": {"read_dataset": {"file_path": str(tmp_path / "in"), "file_type": "parquet"}, "rename_column": {"list_of_cols": ["age"], "list_of_newcols": ["years"]}},
        "stats_generator": {"metric": ["measures_of_counts"], "metric_args": {"list_of_cols": "all"}},
        "quality_checker": {"duplicate_detection": {"treatment": True}, "nullColumns_detection": {"treatment": True, "treatment_method": "MMM"}},
        "transformers": {"scale": {"normalization": {"list_of_cols": "years"}}},
        "write_main": {"file_path": str(tmp_path / "out"), "file_type": "parquet"},
    }
    df, tables = pipeline.run(spark, config)
    assert df.count() == 4 and df.where("education is null").count() == 0
    assert "stats_generator/measures_of_counts" in tables
    assert "<h2>stats_generator/measures_of_counts</h2>" in report.html(tables)


def test_transpose(spark):
    x = spark.createDataFrame([("a", 1, 2.0), ("b", 3, 4.0)], "k string, x int, y double")
    assert {r["key"]: (r["a"], r["b"]) for r in transpose(x, "k").collect()} == {"x": ("1", "3"), "y": ("2.0", "4.0")}


def test_cluster_analysis_covers_all_rows(spark):
    from strataforge.operators.geospatial import cluster_analysis

    rows = [(float(i % 50), float(i % 70)) for i in range(900)]
    means, _ = cluster_analysis(spark.createDataFrame(rows, "lat double, lon double"), "lat", "lon", 4, 5.0, 10, max_records=100)
    assert sorted((r["lat"], r["lon"]) for r in means.collect()) == sorted(rows)


def test_queries_fit_as_the_operators_do(monkeypatch):
    """No query fits a smaller model than the operator's defaults give."""
    from strataforge import registry

    given = []
    monkeypatch.setattr(registry, "_gaps", lambda s, d: None)
    monkeypatch.setattr(registry, "_items", lambda s, d, *c: None)
    monkeypatch.setattr(registry.imputation, "impute_model", lambda df, **k: given.append(k))
    monkeypatch.setattr(registry.transform, "autoencoder_latent_features", lambda df, cols, **k: given.append(k))
    for name in ("imputation_knn", "autoencoder_latent_features"):
        registry.queries()[name](None, "")
    assert given == [{"method_type": "KNN"}, {}]


def test_point_in_time_join_null_keys_and_ties(spark):
    from strataforge.plans.featurestore import point_in_time_join

    entities = spark.createDataFrame([(1, None, 10), (2, 7, 10), (3, 7, 4)], "i int, k int, t int")
    features = spark.createDataFrame([(None, 5, "leak"), (7, 5, "b"), (7, 5, "c"), (7, 5, "a")], "k int, ft int, v string")
    assert sorted((r["i"], r["v"]) for r in point_in_time_join(entities, features, ["k"], "t", "ft").collect()) == [(1, None), (2, "c"), (3, None)]


def test_quantiles_are_exact_whatever_the_sketch(spark, monkeypatch):
    import math

    from strataforge.functions import columns

    n, probs = 30_011, [0.1, 0.30000000000000004, 0.5, 0.95, 1.0]
    x = spark.range(n).select((F.col("id") * 7919 % n).alias("a"), F.when(F.col("id") % 3 > 0, F.col("id") % 11 - 5).alias("b"), F.lit(None).cast("double").alias("c"), F.when(F.col("id") < 900, F.lit(float("nan"))).otherwise(-F.col("id")).alias("d"))
    b, d = sorted(i % 11 - 5 for i in range(n) if i % 3), [*map(float, range(1 - n, -899)), *[math.nan] * 900]
    for sketch in (100, 5000):
        got = columns.quantiles(x, ["a", "b", "c", "d"], probs, sketch)
        assert got["a"] == [math.ceil(p * n) - 1 for p in probs] and got["c"] is None
        assert got["b"] == [b[math.ceil(p * len(b)) - 1] for p in probs]
        assert repr(got["d"]) == repr([d[math.ceil(p * n) - 1] for p in probs])
    wrong = columns._ranked(x, [F.col("a").cast("double")], {0: {15_000: (3.0, 5.0), 20_000: (29_000.0, 29_001.0)}}, exact := {})
    assert columns._ranked(x, [F.col("a").cast("double")], wrong, exact) == {} and exact == {(0, 15_000): 14_999.0, (0, 20_000): 19_999.0}


def test_aggregator_medians_are_exact_whatever_the_sketch(spark):
    n = 20_011
    x = spark.range(n).select((F.col("id") * 7919 % n).alias("v"), F.when(F.col("id") > 0, F.timestamp_seconds(F.col("id") * 7919 % n % 2 * 86400)).alias("t"), F.lit(None).cast("double").alias("e"))
    got = {r["t"]: r.asDict() for r in dt.aggregator(x, "v|e", "median|count", "t", accuracy=100).collect()}
    odd, even = list(range(1, n, 2)), list(range(2, n, 2))
    for day, v in (("1970-01-01", even), ("1970-01-02", odd), (None, [0])):
        assert got[day] == {"t": day, "v_median": v[(len(v) + 1) // 2 - 1], "v_count": len(v), "e_median": None, "e_count": 0}


def test_outlier_spread_is_exact_whatever_the_sketch(spark):
    import math

    from strataforge.plans import charts

    n = 20_011
    x = spark.range(n).select((F.col("id") * 7919 % n).alias("v"), (F.col("id") * 7919 % n % 2).alias("g"), F.lit(None).cast("double").alias("e"))
    got = {(r["group"], r["attribute"]): (r["min"], r["q1"], r["median"], r["q3"], r["max"]) for r in charts.outlier_spread(x, "v|e", split_col="g", accuracy=100).collect()}
    for g in (0, 1):
        v = list(range(g, n, 2))
        assert got[g, "v"] == (v[0], *(v[math.ceil(p * len(v)) - 1] for p in (0.25, 0.5, 0.75)), v[-1]) and got[g, "e"] == (None,) * 5


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_point_in_time_join_ttl_counts_fractions(spark, kind):
    from strataforge.plans.featurestore import point_in_time_join

    stamp = lambda x, c: x.withColumn(c, F.to_timestamp(c).cast(kind))
    entities = stamp(spark.createDataFrame([(1, 7, "2024-01-01 00:00:10.2"), (2, 7, "2024-01-01 00:00:10.9"), (3, 8, "2024-01-01 00:00:10.1")], "i int, k int, t string"), "t")
    features = stamp(spark.createDataFrame([(7, "2024-01-01 00:00:00.2", "a"), (8, "2023-12-31 23:59:59.9", "b")], "k int, ft string, v string"), "ft")
    got = sorted((r["i"], r["v"]) for r in point_in_time_join(entities, features, ["k"], "t", "ft", 10).collect())
    assert got == [(1, "a"), (2, None), (3, None)]


def test_reverse_geocoding_round_the_globe(spark):
    import math

    from strataforge.operators.geospatial import reverse_geocoding

    places = [("far", -60.0, 20.0), ("east", 0.5, 179.2), ("west", 0.5, -179.95), ("pole", 89.0, 10.0), ("home", 40.0, 3.0)]
    g = spark.createDataFrame([(n, a, b, "r", "c") for n, a, b in places], "name_of_place string, latitude double, longitude double, region string, country_code string")
    points = [(0.5, 179.95), (0.5, 179.5), (88.0, -170.0), (-80.0, -100.0), (41.0, 3.5), (0.0, 90.0)]

    def distance(p, q):
        a, b, c, d = map(math.radians, (*p, *q))
        return math.asin(min(1, math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2)))

    want = {p: min(places, key=lambda x: distance(p, x[1:]))[0] for p in points}
    for precision in (1, 3):
        got = reverse_geocoding(spark.createDataFrame(points, "lat double, lon double"), "lat", "lon", g, precision).collect()
        assert {(r["lat"], r["lon"]): r["name_of_place"] for r in got} == want


def test_numbered_rows_have_no_gaps(spark):
    from strataforge.sources.staging import numbered

    x = numbered(spark.range(1000).repartition(7), "n")
    assert sorted(r["n"] for r in x.collect()) == list(range(1000))


def test_factorization_tells_rows_apart(spark):
    from strataforge.operators.imputation import auto_imputation, impute_factorization

    rows = [(i, float(i % 10), float(2 * (i % 10)), None if i % 9 == 0 else float(3 * (i % 10))) for i in range(200)]
    df = spark.createDataFrame(rows, "i bigint, a double, b double, c double")
    got = {r["i"]: r for r in impute_factorization(df, "c", id_col="i", rank=2, iterations=10).collect()}
    assert len(got) == 200 and all(abs(got[i]["c"] - 3 * a) < 3 for i, a, _, _ in rows)
    assert auto_imputation(df, "c", id_col="i").where("c is null").count() == 0


def test_nearest_neighbours_of_all_rows():
    import numpy as np

    from strataforge.operators.imputation import _neighbours

    rng = np.random.default_rng(1)
    fit, x = rng.normal(5, 2, (60, 4)), rng.normal(5, 2, (30, 4))
    fit[rng.random(fit.shape) < 0.1] = np.nan
    x[rng.random(x.shape) < 0.2] = np.nan
    got = _neighbours(fit, x)
    for i, row in enumerate(x):
        for j in np.flatnonzero(np.isnan(row)):
            found = []
            for f in fit:
                both = ~np.isnan(f) & ~np.isnan(row)
                if not np.isnan(f[j]) and both.any():
                    found.append((((f - row)[both] ** 2).sum() * 4 / both.sum(), f[j]))
            want = np.mean([v for _, v in sorted(found)[:5]]) if found else np.nanmean(fit[:, j])
            assert abs(got[i, j] - want) < 1e-9


def test_bins_of_all_sizes_at_once(spark):
    from strataforge.operators.binning import cutoffs, cutoffs_by_size

    x = spark.range(500).selectExpr("cast(id as double) v", "cast(id % 7 as double) w")
    for method in ("equal_range", "equal_frequency"):
        assert cutoffs_by_size(x, ["v", "w"], method, [3, 8, 20]) == {n: cutoffs(x, ["v", "w"], method, n) for n in (3, 8, 20)}


def test_restarts_of_clustering(spark):
    from strataforge.operators.association import variable_clustering

    x = spark.range(300).selectExpr("sin(id) a", "sin(id) + cos(id * 3) / 9 b", "cos(id * 7) c", "cos(id * 7) - sin(id * 5) / 9 d", "cast(id % 5 as double) e")
    got = {r["Attribute"]: r for r in variable_clustering(x, restarts=3).collect()}
    assert got["a"]["Cluster"] == got["b"]["Cluster"] != got["c"]["Cluster"] == got["d"]["Cluster"]
    assert all(0 <= r["RS_NC"] <= 1 and r["RS_Own"] > r["RS_NC"] for r in got.values())


def test_names_and_paths(spark):
    from strataforge.functions.columns import get_dtype
    from strataforge.functions.paths import ends_with, https_path, local_path
    from strataforge.plans import charts

    assert (ends_with("a"), ends_with("a/"), local_path("dbfs:/x"), local_path("/x")) == ("a/", "a/", "/dbfs/x", "/x")
    assert https_path("wasbs://box@host.example.net/a/b") == "https://host.example.net/box/a/b"
    assert get_dtype(spark.range(1), "id") == "bigint"
    assert charts.title("nullRows_detection") == "Null Detection" and charts.title("measures_of_counts") == "Measures Of Counts"
    assert [charts.power_name(v) for v in (-2, -1, -0.5, 0, 0.5, 1, 2)] == ["Reciprocal Square Transform", "Reciprocal Transform", "Receiprocal Square Root Transform", "Log Transform", "Square Root Transform", "No Transform", "Square Transform"]
    assert charts.plain_names(["a_ts", "b"]) == ["a", "b"] and charts.converted_names(["a_ts", "b"]) == ["a_ts", "b_ts"]
    assert set(charts.saved_stats("p", "nullColumns_detection")) == {"stats_unique", "stats_mode", "stats_missing"} and charts.saved_stats("p", "x") == {}


def test_charts(spark, tmp_path):
    from strataforge.plans import charts

    x = spark.range(100).selectExpr("cast(id as double) v", "if(id % 3 = 0, 'a', 'b') c", "cast(id % 2 as int) y")
    made = charts.charts_to_objects(x, f"{tmp_path}/charts", list_of_cols="v|c", label_col="y", source=x, outlier_charts=True)
    assert set(made) == {"freqDist_v", "eventDist_v", "drift_v", "outlier_v", "freqDist_c", "eventDist_c", "drift_c"}
    assert {r["c"]: r["count"] for r in made["freqDist_c"]["data"]} == {"a": 34, "b": 66} and made["outlier_v"]["type"] == "box"
    assert charts.charts_in(spark, f"{tmp_path}/charts", "freqDist_", "c") == {"freqDist_c": made["freqDist_c"]}
    found = charts.tabs({"stats_generator/measures_of_counts": x, "quality_checker/nullRows_detection": x, "drift_detector/drift_statistics": x, "zzz": x})
    assert list(found) == ["Descriptive Statistics", "Quality Check", "Data Drift & Data Stability", "Other"]
    assert "<h2>Wiki: Data Dictionary</h2>" in charts.page({"data_dictionary": charts.data_dictionary(x)})
    assert charts.outlier_points(x, "v").count() == 100


def test_pipeline_with_charts_and_feature_store(spark, tmp_path):
    from strataforge.plans import pipeline

    spark.range(60).selectExpr("id", "cast(id % 7 as double) v", "if(id % 2 = 0, 'a', 'b') c").write.parquet(f"{tmp_path}/in")
    config = {
        "input_dataset": {"read_dataset": {"file_path": f"{tmp_path}/in", "file_type": "parquet"}},
        "stats_generator": {"metric": ["measures_of_counts"], "metric_args": {"list_of_cols": "v|c"}},
        "report_preprocessing": {"charts_to_objects": {"list_of_cols": "v|c", "outlier_charts": True}},
        "report_generation": {"final_report_path": f"{tmp_path}/page"},
        "write_main": {"file_path": f"{tmp_path}/out", "file_type": "parquet", "file_configs": {"mode": "overwrite", "repartition": 1}},
        "write_feast_features": {"file_path": f"{tmp_path}/store", "entity": {"name": "thing", "id_col": "id"}, "file_source": {"event_timestamp": "event_time", "create_timestamp": "create_time"}, "feature_view": {"name": "view", "ttl_in_seconds": 60}},
    }
    df, tables = pipeline.run(spark, config)
    assert {"event_time", "create_time"} < set(df.columns) and "report_preprocessing/outlier_v" in tables and "data_dictionary" in tables
    text = "\n".join(r[0] for r in spark.read.text(f"{tmp_path}/store").collect())
    assert 'Field(name="v", dtype=Float64)' in text and 'join_keys=["id"]' in text
    assert "Measures Of Counts" in spark.read.text(f"{tmp_path}/page").first()[0]


def test_checks(spark):
    from strataforge.functions.columns import resolve
    from strataforge.operators import drift

    with pytest.raises(ValueError):
        drift.check_weights({"mean": 0.5})
    with pytest.raises(ValueError):
        drift.check_threshold(5)
    drift.check_weights({"mean": 0.5, "stddev": 0.3, "kurtosis": 0.2})
    with pytest.raises(TypeError):
        resolve(spark.range(1), "nope")
