"""The library's queries over the test tables, by name, with DuckDB SQL for those that SQL can express.

The tables hold no nulls and no coordinates, so queries that need some derive them from keys, the same way in both.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataforge.functions import datetime as dt
from strataforge.functions import geo as G
from strataforge.functions.columns import flatten, transpose
from strataforge.operators import association, binning, drift, geospatial, imputation, quality, recommend, sampling, stats, timeseries, transform
from strataforge.plans import charts, featurestore, report
from strataforge.sources import io
from strataforge.sources.staging import shared_folder
from strataforge.streaming.profile import windowed_profile

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return io.read_dataset(spark, f"{d}/{name}.parquet", "parquet")


#: Rank error of quantiles in the queries: none on tables of up to some 100,000 rows, so that results can be held against SQL.
EXACT = 1_000_000
NUM = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
FLAGS = ("l_returnflag", "l_linestatus")


def _union(make: Callable[[str], str], names=NUM) -> str:
    return " UNION ALL ".join(make(c) for c in names)


def _items(spark, d, *cols):
    return _t(spark, d, "lineitem").select(*cols)


def _gaps(spark, d):
    """Customers with nulls: the balance of every seventh, the segment of every fifth."""
    c = _t(spark, d, "customer")
    return c.withColumns({"c_acctbal": F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")), "c_mktsegment": F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment"))})


_GAPS = "(SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS c_mktsegment FROM customer)"


def _places(spark, d):
    """Customers with a latitude and longitude made from the key."""
    k = F.col("c_custkey")
    return _t(spark, d, "customer").select("c_custkey", "c_nationkey", ((k * 7919 % 17000) / 100.0 - 85).alias("lat"), ((k * 104729 % 35000) / 100.0 - 175).alias("lon"))


_PLACES = "(SELECT c_custkey, c_nationkey, (c_custkey * 7919 % 17000) / 100.0::DOUBLE - 85 AS lat, (c_custkey * 104729 % 35000) / 100.0::DOUBLE - 175 AS lon FROM customer)"

# Ingest


@_query("read_select", "SELECT o_orderkey, o_totalprice FROM orders")
def _(s, d):
    return io.select_column(_t(s, d, "orders"), "o_orderkey|o_totalprice")


@_query("delete_column", "SELECT p_partkey, p_brand, p_size FROM part")
def _(s, d):
    return io.delete_column(_t(s, d, "part"), ["p_name", "p_type", "p_retailprice"])


@_query("rename_column", "SELECT n_nationkey AS id, n_name AS name, n_regionkey FROM nation")
def _(s, d):
    return io.rename_column(_t(s, d, "nation"), "n_nationkey|n_name", "id|name")


@_query("recast_column", "SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, TRY_CAST(s_name AS DOUBLE) AS bad FROM supplier")
def _(s, d):
    x = _t(s, d, "supplier").select("s_suppkey", "s_name", "s_nationkey", F.col("s_name").alias("bad"))
    return io.recast_column(x, "s_nationkey|bad", "bigint|double")


@_query("concatenate_dataset", "SELECT c_custkey AS k, c_acctbal AS b FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier")
def _(s, d):
    a = _t(s, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("b"))
    return io.concatenate_dataset(a, _t(s, d, "supplier").select(F.col("s_acctbal").alias("b"), F.col("s_suppkey").alias("k")), method_type="name")


@_query("join_dataset", "SELECT n_regionkey AS r_regionkey, n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(s, d):
    return io.join_dataset(_t(s, d, "nation").withColumnRenamed("n_regionkey", "r_regionkey"), _t(s, d, "region"), join_cols="r_regionkey", join_type="inner")


@_query("join_left_anti", "SELECT p_partkey, p_size FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def _(s, d):
    hot = _t(s, d, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return io.join_dataset(_t(s, d, "part").select("p_partkey", "p_size"), hot, join_cols="p_partkey", join_type="left_anti")


@_query(
    "recommend_type",
    """SELECT attribute, 'numerical' AS original_form, kind AS "original_dataType", 'categorical' AS recommended_form, 'string' AS "recommended_dataType", n AS distinct_value_count FROM (
    SELECT 'l_linenumber' AS attribute, 'int' AS kind, count(DISTINCT l_linenumber) AS n, count(l_linenumber) AS f FROM lineitem
    UNION ALL SELECT 'l_quantity', 'double', count(DISTINCT l_quantity), count(l_quantity) FROM lineitem
    UNION ALL SELECT 'l_extendedprice', 'double', count(DISTINCT l_extendedprice), count(l_extendedprice) FROM lineitem) WHERE n < least(f * 0.01, 100.0)""",
)
def _(s, d):
    return io.recommend_type(_items(s, d, "l_linenumber", "l_quantity", "l_extendedprice"))


@_query("data_sample_random")
def _(s, d):
    return sampling.data_sample(_t(s, d, "orders"), fraction=0.1)


@_query("data_sample_stratified")
def _(s, d):
    return sampling.data_sample(_t(s, d, "orders"), "o_orderstatus|o_orderpriority", fraction=0.2, method_type="stratified", stratified_type="balanced")


@_query("flatten_dataframe", "SELECT n_nationkey, 'n_name' AS key, n_name AS value FROM nation UNION ALL SELECT n_nationkey, 'n_regionkey', CAST(n_regionkey AS VARCHAR) FROM nation")
def _(s, d):
    return flatten(_t(s, d, "nation"), ["n_nationkey"])


@_query("transpose_dataframe", "SELECT 'r_regionkey' AS key, " + ", ".join(f"max(CASE WHEN r_regionkey = {i} THEN CAST(r_regionkey AS VARCHAR) END) AS c{i}" for i in range(5)) + " FROM region")
def _(s, d):
    x = _t(s, d, "region").select(F.concat(F.lit("c"), F.col("r_regionkey")).alias("head"), "r_regionkey")
    return transpose(x, "head")


# Statistics


@_query(
    "global_summary",
    """SELECT * FROM (VALUES ('rows_count', (SELECT CAST(count(*) AS VARCHAR) FROM lineitem)), ('columns_count', '11'), ('numcols_count', '8'), ('numcols_name', 'l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax'),
    ('catcols_count', '2'), ('catcols_name', 'l_returnflag, l_linestatus'), ('othercols_count', '1'), ('othercols_name', 'l_shipdate')) t(metric, value)""",
)
def _(s, d):
    return stats.global_summary(_t(s, d, "lineitem"))


@_query("missing_count", _union(lambda c: f"SELECT '{c}' AS attribute, count(*) - count({c}) AS missing_count, round((count(*) - count({c})) / count(*)::DOUBLE, 4) AS missing_pct FROM {_GAPS}", ("c_acctbal", "c_mktsegment", "c_name")))
def _(s, d):
    return stats.missing_count(_gaps(s, d), "c_acctbal|c_mktsegment|c_name")


@_query("nonzero_count", _union(lambda c: f"SELECT '{c}' AS attribute, count(*) FILTER (coalesce({c}, 0) <> 0) AS nonzero_count, round(count(*) FILTER (coalesce({c}, 0) <> 0) / count(*)::DOUBLE, 4) AS nonzero_pct FROM lineitem"))
def _(s, d):
    return stats.nonzero_count(_t(s, d, "lineitem"), NUM)


def _counts_sql(c: str, numeric: bool, table: str) -> str:
    nz = f"count(*) FILTER (coalesce({c}, 0) <> 0)" if numeric else "CAST(NULL AS BIGINT)"
    return f"SELECT '{c}' AS attribute, count({c}) AS fill_count, round(count({c}) / count(*)::DOUBLE, 4) AS fill_pct, count(*) - count({c}) AS missing_count, round(1 - round(count({c}) / count(*)::DOUBLE, 4), 4) AS missing_pct, {nz} AS nonzero_count, round({nz} / count(*)::DOUBLE, 4) AS nonzero_pct FROM {table}"


@_query("measures_of_counts", " UNION ALL ".join([*(_counts_sql(c, True, "lineitem") for c in NUM), *(_counts_sql(c, False, "lineitem") for c in FLAGS)]))
def _(s, d):
    return stats.measures_of_counts(_t(s, d, "lineitem"), [*NUM, *FLAGS])


@_query("measures_of_counts_nulls", " UNION ALL ".join([_counts_sql("c_acctbal", True, _GAPS), _counts_sql("c_mktsegment", False, _GAPS)]))
def _(s, d):
    return stats.measures_of_counts(_gaps(s, d), "c_acctbal|c_mktsegment")


def _mode_sql(c: str, table: str) -> str:
    return f"SELECT * FROM (SELECT '{c}' AS attribute, CAST({c} AS VARCHAR) AS mode, count(*) AS mode_rows FROM {table} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY mode_rows DESC, mode LIMIT 1)"


@_query("mode_computation", " UNION ALL ".join(_mode_sql(c, "lineitem") for c in (*FLAGS, "l_linenumber", "l_suppkey")))
def _(s, d):
    return stats.mode(_t(s, d, "lineitem"), [*FLAGS, "l_linenumber", "l_suppkey"])


@_query(
    "measures_of_central_tendency",
    f"""WITH m AS ({" UNION ALL ".join(_mode_sql(c, "lineitem") for c in (*FLAGS, "l_linenumber"))}), s AS (
    SELECT 'l_linenumber' AS attribute, avg(l_linenumber) AS mean, CAST(quantile_disc(l_linenumber, 0.5) AS DOUBLE) AS median, count(l_linenumber) AS n FROM lineitem
    UNION ALL SELECT 'l_quantity', avg(l_quantity), quantile_disc(l_quantity, 0.5), count(*) FROM lineitem
    UNION ALL {_union(lambda c: f"SELECT '{c}', NULL, NULL, count({c}) FROM lineitem", FLAGS)})
    SELECT attribute, round(mean, 4) AS mean, round(median, 4) AS median, mode, mode_rows, round(mode_rows / n::DOUBLE, 4) AS mode_pct FROM s LEFT JOIN m USING (attribute)""",
)
def _(s, d):
    return stats.central_tendency(_t(s, d, "lineitem"), ["l_linenumber", "l_quantity", *FLAGS], accuracy=EXACT)


@_query("unique_count", _union(lambda c: f"SELECT '{c}' AS attribute, count(DISTINCT {c}) AS unique_values FROM lineitem", ("l_partkey", "l_suppkey", *FLAGS)))
def _(s, d):
    return stats.unique_count(_t(s, d, "lineitem"), ["l_partkey", "l_suppkey", *FLAGS])


@_query("measures_of_cardinality", _union(lambda c: f"SELECT '{c}' AS attribute, count(DISTINCT {c}) AS unique_values, round(count(DISTINCT {c}) / count({c})::DOUBLE, 4) AS \"IDness\" FROM {_GAPS}", ("c_custkey", "c_mktsegment", "c_nationkey")))
def _(s, d):
    return stats.measures_of_cardinality(_gaps(s, d), "c_custkey|c_mktsegment|c_nationkey", use_approx_unique_count=False)


@_query("cardinality_approximate")
def _(s, d):
    return stats.measures_of_cardinality(_t(s, d, "lineitem"), "all")


@_query(
    "measures_of_dispersion",
    _union(lambda c: f"SELECT '{c}' AS attribute, round(stddev_samp({c}), 4) AS stddev, round(round(stddev_samp({c}), 4) * round(stddev_samp({c}), 4), 4) AS variance, round(round(stddev_samp({c}), 4) / avg({c}), 4) AS cov, round(quantile_disc({c}, 0.75) - quantile_disc({c}, 0.25), 4) AS \"IQR\", round(max({c}) - min({c}), 4) AS range FROM lineitem"),
)
def _(s, d):
    return stats.measures_of_dispersion(_t(s, d, "lineitem"), NUM, accuracy=EXACT)


@_query("measures_of_percentiles", _union(lambda c: f"SELECT '{c}' AS attribute, round(min({c}), 4) AS min, " + ", ".join(f'round(quantile_disc({c}, {p}), 4) AS "{n}"' for n, p in stats.PERCENTILES.items()) + f", round(max({c}), 4) AS max FROM lineitem"))
def _(s, d):
    return stats.measures_of_percentiles(_t(s, d, "lineitem"), NUM, accuracy=EXACT)


@_query(
    "measures_of_shape",
    _union(lambda c: f"SELECT '{c}' AS attribute, round(avg(pow({c} - m, 3)) / pow(avg(pow({c} - m, 2)), 1.5), 4) AS skewness, round(avg(pow({c} - m, 4)) / pow(avg(pow({c} - m, 2)), 2) - 3, 4) AS kurtosis FROM lineitem, (SELECT avg({c}) AS m FROM lineitem)"),
)
def _(s, d):
    return stats.measures_of_shape(_t(s, d, "lineitem"), NUM)


# Quality


@_query(
    "duplicate_detection",
    """WITH s AS (SELECT count(*)::DOUBLE AS n, (SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem))::DOUBLE AS u FROM lineitem)
    SELECT 'rows_count' AS metric, n AS value FROM s UNION ALL SELECT 'unique_rows_count', u FROM s UNION ALL SELECT 'duplicate_rows', n - u FROM s UNION ALL SELECT 'duplicate_pct', round((n - u) / n, 4) FROM s""",
)
def _(s, d):
    return quality.duplicate_detection(_t(s, d, "lineitem"), "l_returnflag|l_linestatus|l_quantity")[1]


@_query("duplicate_treatment", "SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem")
def _(s, d):
    return quality.duplicate_detection(_t(s, d, "lineitem"), "l_returnflag|l_linestatus|l_quantity")[0]


@_query(
    "null_rows_detection",
    f"""SELECT k AS null_cols_count, count(*) AS row_count, round(count(*) / (SELECT count(*) FROM customer)::DOUBLE, 4) AS row_pct, CAST(k > 1.6 AS INTEGER) AS flagged
    FROM (SELECT CAST((c_acctbal IS NULL) AS INTEGER) + CAST((c_mktsegment IS NULL) AS INTEGER) AS k FROM {_GAPS}) GROUP BY k""",
)
def _(s, d):
    return quality.null_rows_detection(_gaps(s, d), "c_acctbal|c_mktsegment")[1]


@_query("null_rows_treatment", f"SELECT * FROM {_GAPS} WHERE NOT (c_acctbal IS NULL AND c_mktsegment IS NULL)")
def _(s, d):
    return quality.null_rows_detection(_gaps(s, d), "c_acctbal|c_mktsegment", treatment=True)[0]


@_query("null_columns_detection", _union(lambda c: f"SELECT '{c}' AS attribute, count(*) - count({c}) AS missing_count, round((count(*) - count({c})) / count(*)::DOUBLE, 4) AS missing_pct FROM {_GAPS}", ("c_acctbal", "c_mktsegment")))
def _(s, d):
    return quality.null_columns_detection(_gaps(s, d))[1]


@_query("null_columns_row_removal", f"SELECT * FROM {_GAPS} WHERE c_acctbal IS NOT NULL AND c_mktsegment IS NOT NULL")
def _(s, d):
    return quality.null_columns_detection(_gaps(s, d), treatment=True)[0]


def _bounds_sql(c: str) -> str:
    """The second strictest of the three upper bounds."""
    return f"""SELECT list_sort([quantile_disc({c}, 0.95), avg({c}) + 3.0 * stddev_samp({c}), quantile_disc({c}, 0.75) + 1.5 * (quantile_disc({c}, 0.75) - quantile_disc({c}, 0.25))])[2] AS hi FROM lineitem"""


@_query("outlier_detection", _union(lambda c: f"SELECT '{c}' AS attribute, CAST(0 AS BIGINT) AS lower_outliers, count(*) FILTER ({c} > hi) AS upper_outliers, 0 AS excluded_due_to_skewness FROM lineitem, ({_bounds_sql(c)})"))
def _(s, d):
    return quality.outlier_detection(_t(s, d, "lineitem"), NUM, treatment=False, accuracy=EXACT)[1]


@_query("outlier_value_replacement", f"SELECT l_orderkey, l_linenumber, round(CASE WHEN l_extendedprice > hi THEN hi ELSE l_extendedprice END, 4) AS l_extendedprice FROM lineitem, ({_bounds_sql('l_extendedprice')})")
def _(s, d):
    x = quality.outlier_detection(_items(s, d, "l_orderkey", "l_linenumber", "l_extendedprice"), "l_extendedprice", accuracy=EXACT)[0]
    return x.withColumn("l_extendedprice", F.round("l_extendedprice", 4))


@_query("idness_detection", _union(lambda c: f"SELECT '{c}' AS attribute, count(DISTINCT {c}) AS unique_values, round(count(DISTINCT {c}) / count({c})::DOUBLE, 4) AS \"IDness\", CAST(round(count(DISTINCT {c}) / count({c})::DOUBLE, 4) >= 0.8 AS INTEGER) AS flagged FROM customer", ("c_custkey", "c_nationkey", "c_mktsegment")))
def _(s, d):
    return quality.idness_detection(_t(s, d, "customer"), "c_custkey|c_nationkey|c_mktsegment")[1]


@_query(
    "biasedness_detection",
    f"""SELECT attribute, mode, mode_rows, round(mode_rows / (SELECT count(*) FROM lineitem)::DOUBLE, 4) AS mode_pct, CAST(round(mode_rows / (SELECT count(*) FROM lineitem)::DOUBLE, 4) >= 0.4 AS INTEGER) AS flagged FROM ({" UNION ALL ".join(_mode_sql(c, "lineitem") for c in (*FLAGS, "l_linenumber"))})""",
)
def _(s, d):
    return quality.biasedness_detection(_t(s, d, "lineitem"), [*FLAGS, "l_linenumber"], treatment_threshold=0.4)[1]


_ODD = "(SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN ' NA ' WHEN 1 THEN 'aaa' WHEN 2 THEN 'abc' WHEN 3 THEN '#' ELSE o_orderstatus END AS v FROM orders)"


@_query(
    "invalid_entries_detection",
    f"SELECT 'v' AS attribute, (SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT v FROM {_ODD} WHERE v IN (' NA ', 'aaa', 'abc', '#'))) AS invalid_entries, CAST(count(*) FILTER (v IN (' NA ', 'aaa', 'abc', '#')) AS BIGINT) AS invalid_count, round(count(*) FILTER (v IN (' NA ', 'aaa', 'abc', '#')) / count(*)::DOUBLE, 4) AS invalid_pct FROM {_ODD}",
)
def _(s, d):
    k = F.col("o_orderkey") % 6
    x = _t(s, d, "orders").select("o_orderkey", F.when(k == 0, " NA ").when(k == 1, "aaa").when(k == 2, "abc").when(k == 3, "#").otherwise(F.col("o_orderstatus")).alias("v"))
    return quality.invalid_entries_detection(x, "v")[1]


# Association


@_query(
    "correlation_matrix",
    " UNION ALL ".join(f"SELECT '{a}' AS attribute, " + ", ".join("CAST(1.0 AS DOUBLE) AS " + b if a == b else f"round(corr({a}, {b}), 6) AS {b}" for b in sorted(NUM)) + " FROM lineitem" for a in sorted(NUM)),
)
def _(s, d):
    x = association.correlation_matrix(_t(s, d, "lineitem"), NUM)
    return x.select("attribute", *(F.round(c, 6).alias(c) for c in x.columns if c != "attribute"))


_BINS = ", ".join(f"l[CAST(ceil({j * 0.1!r}::DOUBLE * len(l)) AS BIGINT)]" for j in range(1, 10))
_SEGMENTS = f"""WITH cut AS (SELECT [{_BINS}] AS c FROM (SELECT list(l_quantity ORDER BY l_quantity) AS l FROM lineitem)), seg AS (
    SELECT 'l_quantity' AS attribute, CAST(1 + len(list_filter(c, lambda x: x < l_quantity)) AS VARCHAR) AS bin, l_returnflag = 'R' AS y FROM lineitem, cut
    UNION ALL SELECT 'l_linestatus', l_linestatus, l_returnflag = 'R' FROM lineitem),
    g AS (SELECT attribute, bin, sum(CAST(y AS INTEGER))::DOUBLE AS e, sum(1 - CAST(y AS INTEGER))::DOUBLE AS n FROM seg GROUP BY ALL),
    t AS (SELECT attribute, sum(e) AS te, sum(n) AS tn FROM g GROUP BY ALL)"""


@_query("iv_calculation", _SEGMENTS + " SELECT attribute, round(sum((n / tn - e / te) * CASE WHEN e = 0 OR n = 0 THEN ln(((n + 0.5) / tn) / ((e + 0.5) / te)) ELSE ln((n / tn) / (e / te)) END), 6) AS iv FROM g JOIN t USING (attribute) GROUP BY attribute")
def _(s, d):
    x = association.iv_calculation(_items(s, d, "l_quantity", "l_linestatus", "l_returnflag"), label_col="l_returnflag", event_label="R")
    return x.withColumn("iv", F.round("iv", 6))


@_query(
    "ig_calculation",
    _SEGMENTS
    + """ SELECT attribute, round(max(-(te / (te + tn) * log2(te / (te + tn)) + tn / (te + tn) * log2(tn / (te + tn)))) - sum(CASE WHEN e > 0 AND n > 0 THEN (e + n) / (te + tn) * -(e / (e + n) * log2(e / (e + n)) + n / (e + n) * log2(n / (e + n))) ELSE 0 END), 6) AS ig
    FROM g JOIN t USING (attribute) GROUP BY attribute""",
)
def _(s, d):
    x = association.ig_calculation(_items(s, d, "l_quantity", "l_linestatus", "l_returnflag"), label_col="l_returnflag", event_label="R")
    return x.withColumn("ig", F.round("ig", 6))


@_query("variable_clustering")
def _(s, d):
    return association.variable_clustering(_items(s, d, *NUM, *FLAGS, "l_linenumber"))


# Drift and stability

_SHARES = """WITH b AS (SELECT min(c_acctbal) AS lo, (max(c_acctbal) - min(c_acctbal)) / 10 AS w FROM customer), cut AS (SELECT [lo + j * w FOR j IN range(1, 10)] AS c FROM b),
    p AS (SELECT 1 + len(list_filter(c, lambda x: x < c_acctbal)) AS bin, count(*) / (SELECT count(*) FROM customer)::DOUBLE AS p FROM customer, cut GROUP BY bin),
    q AS (SELECT 1 + len(list_filter(c, lambda x: x < s_acctbal)) AS bin, count(*) / (SELECT count(*) FROM supplier)::DOUBLE AS q FROM supplier, cut GROUP BY bin),
    pq AS (SELECT bin, coalesce(p, 0.0001) AS p, coalesce(q, 0.0001) AS q FROM p FULL JOIN q USING (bin)),
    k AS (SELECT *, (p + q) / 2 AS m, abs(sum(p) OVER (ORDER BY bin) - sum(q) OVER (ORDER BY bin)) AS gap FROM pq)"""


@_query(
    "drift_statistics",
    _SHARES
    + """, r AS (SELECT sum((p - q) * ln(p / q)) AS psi, sqrt(sum(pow(sqrt(p) - sqrt(q), 2)) / 2) AS hd, (sum(p * ln(p / m)) + sum(q * ln(q / m))) / 2 AS jsd, max(gap) AS ks FROM k)
    SELECT 'bal' AS attribute, round(psi, 6) AS "PSI", round(hd, 6) AS "HD", round(jsd, 6) AS "JSD", round(ks, 6) AS "KS", CAST(greatest(psi, hd, jsd, ks) > 0.1 AS INTEGER) AS flagged FROM r""",
)
def _(s, d):
    x = drift.drift_statistics(_t(s, d, "supplier").select(F.col("s_acctbal").alias("bal")), _t(s, d, "customer").select(F.col("c_acctbal").alias("bal")), method_type="all")
    return x.withColumns({c: F.round(c, 6) for c in drift.DISTANCES})


def _score_sql(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN NULL WHEN abs({c}) < 0.03 THEN 4.0 WHEN abs({c}) < 0.1 THEN 3.0 WHEN abs({c}) < 0.2 THEN 2.0 WHEN abs({c}) < 0.5 THEN 1.0 ELSE 0.0 END::DOUBLE"


@_query(
    "stability_index",
    f"""WITH y AS (SELECT year(o_orderdate) AS idx, o_totalprice AS v, avg(o_totalprice) OVER (PARTITION BY year(o_orderdate)) AS m FROM orders),
    s AS (SELECT idx, avg(v) AS mean, stddev_samp(v) AS stddev, avg(pow(v - m, 4)) / pow(avg(pow(v - m, 2)), 2) AS kurtosis FROM y GROUP BY idx),
    c AS (SELECT stddev_samp(mean) AS mean_stddev, stddev_samp(mean) / avg(mean) AS mean_cv, stddev_samp(stddev) / avg(stddev) AS stddev_cv, stddev_samp(kurtosis) / avg(kurtosis) AS kurtosis_cv FROM s),
    i AS (SELECT *, {_score_sql("mean_cv")} AS mean_si, {_score_sql("stddev_cv")} AS stddev_si, {_score_sql("kurtosis_cv")} AS kurtosis_si FROM c)
    SELECT 'o_totalprice' AS attribute, 'Numerical' AS type, round(mean_stddev, 4) AS mean_stddev, round(mean_cv, 4) AS mean_cv, round(stddev_cv, 4) AS stddev_cv, round(kurtosis_cv, 4) AS kurtosis_cv, mean_si, stddev_si, kurtosis_si, round(mean_si * 0.5 + stddev_si * 0.3 + kurtosis_si * 0.2, 4) AS stability_index, CAST(mean_si * 0.5 + stddev_si * 0.3 + kurtosis_si * 0.2 < 1 AS INTEGER) AS flagged FROM i""",
)
def _(s, d):
    x = _t(s, d, "orders").select(F.year("o_orderdate").alias("idx"), "o_totalprice")
    return drift.stability_index_computation(x, "o_totalprice", idx_col="idx")


_SI = "CASE WHEN {0} IS NULL THEN NULL WHEN abs({0}) < 0.03 THEN 4 WHEN abs({0}) < 0.1 THEN 3 WHEN abs({0}) < 0.2 THEN 2 WHEN abs({0}) < 0.5 THEN 1 ELSE 0 END"


@_query(
    "feature_stability",
    f"""WITH p AS (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders GROUP BY year(o_orderdate)), f AS (SELECT m * m + s * s AS fm, 2 * m * s AS fs FROM p),
    c AS (SELECT round(stddev_pop(fm) / avg(fm), 3) AS mean_cv, round(stddev_pop(fs) / avg(fs), 3) AS stddev_cv FROM f), i AS (SELECT *, CAST({_SI.format("mean_cv")} AS INTEGER) AS mean_si, CAST({_SI.format("stddev_cv")} AS INTEGER) AS stddev_si FROM c)
    SELECT 'A**2' AS feature_formula, mean_cv, stddev_cv, mean_si, stddev_si, CAST(mean_si * 0.5 + stddev_si * 0.3 AS DOUBLE) AS lower, CAST(mean_si * 0.5 + stddev_si * 0.3 + 0.8 AS DOUBLE) AS upper FROM i""",
)
def _(s, d):
    x = _t(s, d, "orders").select(F.year("o_orderdate").alias("idx"), F.col("o_totalprice").alias("A"))
    found = drift.feature_stability_estimation(drift.period_metrics(x, ["A"], "idx"), {"A": "A**2"})
    return found.select("feature_formula", F.round("mean_cv", 3).alias("mean_cv"), F.round("stddev_cv", 3).alias("stddev_cv"), "mean_si", "stddev_si", F.col("stability_index_lower_bound").alias("lower"), F.col("stability_index_upper_bound").alias("upper"))


# Transformers


def _range_bin(c: str, table: str, n: int = 10) -> str:
    return f"(SELECT [lo + j * w FOR j IN range(1, {n})] AS c_{c} FROM (SELECT min({c}) AS lo, (max({c}) - min({c})) / {n} AS w FROM {table}))"


@_query(
    "binning_equal_range",
    f"SELECT l_orderkey, l_linenumber, CAST(1 + len(list_filter(c_l_extendedprice, lambda x: x < l_extendedprice)) AS INTEGER) AS l_extendedprice, CAST(1 + len(list_filter(c_l_tax, lambda x: x < l_tax)) AS INTEGER) AS l_tax FROM lineitem, {_range_bin('l_extendedprice', 'lineitem')}, {_range_bin('l_tax', 'lineitem')}",
)
def _(s, d):
    return binning.attribute_binning(_items(s, d, "l_orderkey", "l_linenumber", "l_extendedprice", "l_tax"), "l_extendedprice|l_tax")


@_query(
    "binning_equal_frequency",
    "SELECT l_orderkey, l_linenumber, l_extendedprice, CAST(1 + len(list_filter(c, lambda x: x < l_extendedprice)) AS INTEGER) AS l_extendedprice_binned FROM lineitem, (SELECT [" + ", ".join(f"l[CAST(ceil({j * 0.1!r}::DOUBLE * len(l)) AS BIGINT)]" for j in range(1, 10)) + "] AS c FROM (SELECT list(l_extendedprice ORDER BY l_extendedprice) AS l FROM lineitem))",
)
def _(s, d):
    return binning.attribute_binning(_items(s, d, "l_orderkey", "l_linenumber", "l_extendedprice"), "l_extendedprice", method_type="equal_frequency", output_mode="append", accuracy=EXACT)


@_query("monotonic_binning")
def _(s, d):
    x = _items(s, d, "l_orderkey", "l_quantity", "l_extendedprice").withColumn("label", (F.col("l_extendedprice") > 40000).cast("int"))
    return binning.monotonic_binning(x, "l_quantity")


_SEG = "(SELECT v, CAST(row_number() OVER (ORDER BY n DESC, v) - 1 AS INTEGER) AS i FROM (SELECT c_mktsegment AS v, count(*) AS n FROM {} WHERE c_mktsegment IS NOT NULL GROUP BY v))".format(_GAPS)


@_query("label_encoding", f"SELECT c_custkey, i AS c_mktsegment FROM {_GAPS} LEFT JOIN {_SEG} ON v = c_mktsegment")
def _(s, d):
    return transform.cat_to_num_unsupervised(_gaps(s, d).select("c_custkey", "c_mktsegment"), "c_mktsegment")


@_query("onehot_encoding", "SELECT c_custkey, " + ", ".join(f"CAST(coalesce(i, 5) = {k} AS INTEGER) AS c_mktsegment_{k}" for k in range(6)) + f" FROM {_GAPS} LEFT JOIN {_SEG} ON v = c_mktsegment")
def _(s, d):
    return transform.cat_to_num_unsupervised(_gaps(s, d).select("c_custkey", "c_mktsegment"), "c_mktsegment", method_type="onehot_encoding")


@_query("target_encoding", f"SELECT c_custkey, c_acctbal, r AS c_mktsegment FROM {_GAPS} LEFT JOIN (SELECT c_mktsegment AS v, round(avg(CAST(coalesce(c_nationkey = 3, false) AS INTEGER)), 4) AS r FROM {_GAPS} GROUP BY v) ON v = c_mktsegment")
def _(s, d):
    return transform.cat_to_num_supervised(_gaps(s, d), "c_mktsegment", label_col="c_nationkey", event_label=3).select("c_custkey", "c_acctbal", "c_mktsegment")


@_query(
    "cat_to_num_transformer",
    "SELECT o_orderkey, CAST(i AS INTEGER) AS o_orderpriority, CAST(o_orderstatus = 'F' AS INTEGER) AS o_orderstatus FROM orders JOIN (SELECT v, row_number() OVER (ORDER BY n DESC, v) - 1 AS i FROM (SELECT o_orderpriority AS v, count(*) AS n FROM orders GROUP BY 1)) ON v = o_orderpriority",
)
def _(s, d):
    return transform.cat_to_num_transformer(_t(s, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus"), label_col="o_orderstatus", event_label="F")


@_query("z_standardization", "SELECT l_orderkey, l_linenumber, round((l_quantity - m) / sd, 6) AS l_quantity FROM lineitem, (SELECT avg(l_quantity) AS m, stddev_samp(l_quantity) AS sd FROM lineitem)")
def _(s, d):
    return transform.z_standardization(_items(s, d, "l_orderkey", "l_linenumber", "l_quantity"), "l_quantity").withColumn("l_quantity", F.round("l_quantity", 6))


@_query("iqr_standardization", "SELECT l_orderkey, l_linenumber, round((l_quantity - b) / (c - a), 6) AS l_quantity FROM lineitem, (SELECT quantile_disc(l_quantity, 0.25) AS a, quantile_disc(l_quantity, 0.5) AS b, quantile_disc(l_quantity, 0.75) AS c FROM lineitem)")
def _(s, d):
    return transform.iqr_standardization(_items(s, d, "l_orderkey", "l_linenumber", "l_quantity"), "l_quantity", accuracy=EXACT).withColumn("l_quantity", F.round("l_quantity", 6))


@_query("normalization", "SELECT l_orderkey, l_linenumber, round((l_extendedprice - lo) / (hi - lo), 6) AS l_extendedprice FROM lineitem, (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)")
def _(s, d):
    return transform.normalization(_items(s, d, "l_orderkey", "l_linenumber", "l_extendedprice"), "l_extendedprice").withColumn("l_extendedprice", F.round("l_extendedprice", 6))


@_query("imputation_mmm", f"SELECT c_custkey, coalesce(c_acctbal, (SELECT quantile_disc(c_acctbal, 0.5) FROM {_GAPS})) AS c_acctbal, coalesce(c_mktsegment, (SELECT mode FROM ({_mode_sql('c_mktsegment', _GAPS)}))) AS c_mktsegment FROM {_GAPS}")
def _(s, d):
    return imputation.impute_mmm(_gaps(s, d).select("c_custkey", "c_acctbal", "c_mktsegment"), accuracy=EXACT)


@_query("imputation_mean", f"SELECT c_custkey, round(coalesce(c_acctbal, (SELECT avg(c_acctbal) FROM {_GAPS})), 6) AS c_acctbal FROM {_GAPS}")
def _(s, d):
    return imputation.impute_mmm(_gaps(s, d).select("c_custkey", "c_acctbal"), method_type="mean").withColumn("c_acctbal", F.round("c_acctbal", 6))


@_query("imputation_knn")
def _(s, d):
    return imputation.impute_model(_gaps(s, d), method_type="KNN")


@_query("imputation_regression")
def _(s, d):
    return imputation.impute_model(_gaps(s, d), method_type="regression")


@_query("imputation_matrix_factorization")
def _(s, d):
    return imputation.impute_factorization(_gaps(s, d).drop("c_name"), id_col="c_custkey", rank=2, iterations=5)


@_query("auto_imputation")
def _(s, d):
    return imputation.auto_imputation(_gaps(s, d), id_col="c_custkey")


@_query("pca_latent_features")
def _(s, d):
    return transform.pca_latent_features(_items(s, d, "l_orderkey", *NUM), NUM)


@_query("autoencoder_latent_features")
def _(s, d):
    return transform.autoencoder_latent_features(_items(s, d, "l_orderkey", *NUM), NUM)


_MATH = {
    "ln": "ln({c})",
    "log10": "log10({c})",
    "log2": "log2({c})",
    "sqrt": "sqrt({c})",
    "cbrt": "cbrt({c})",
    "sq": "pow({c}, 2)",
    "cb": "pow({c}, 3)",
    "sin": "sin({c})",
    "cos": "cos({c})",
    "tan": "tan({c})",
    "atan": "atan({c})",
    "radians": "radians({c})",
    "mul_inv": "1.0 / {c}",
    "floor": "CAST(floor({c}) AS BIGINT)",
    "ceil": "CAST(ceil({c}) AS BIGINT)",
}


@_query("feature_transformation", "SELECT l_orderkey, l_linenumber, " + ", ".join(f"round({v.format(c='l_quantity')}, 6) AS l_quantity_{k}" if k not in ("floor", "ceil") else f"{v.format(c='l_quantity')} AS l_quantity_{k}" for k, v in _MATH.items()) + " FROM lineitem")
def _(s, d):
    x = _items(s, d, "l_orderkey", "l_linenumber", "l_quantity")
    for k in _MATH:
        x = transform.feature_transformation(x, "l_quantity", method_type=k, output_mode="append")
    return x.select("l_orderkey", "l_linenumber", *((F.round(f"l_quantity_{k}", 6) if k not in ("floor", "ceil") else F.col(f"l_quantity_{k}")).alias(f"l_quantity_{k}") for k in _MATH))


@_query("feature_transformation_n", "SELECT l_orderkey, l_linenumber, round(pow(l_linenumber, 3), 6) AS a, l_linenumber % 3 AS b, round(l_tax, 1) AS c FROM lineitem")
def _(s, d):
    x = _items(s, d, "l_orderkey", "l_linenumber", "l_tax").withColumns({"a": F.col("l_linenumber"), "b": F.col("l_linenumber"), "c": F.col("l_tax")})
    x = transform.feature_transformation(x, "a", method_type="toPowerN", N=3)
    x = transform.feature_transformation(transform.feature_transformation(x, "b", method_type="remainderDivByN", N=3), "c", method_type="roundN", N=1)
    return x.select("l_orderkey", "l_linenumber", F.round("a", 6).alias("a"), "b", "c")


@_query("boxcox_transformation", "SELECT l_orderkey, l_linenumber, round(pow(l_quantity, 0.5), 6) AS l_quantity FROM lineitem")
def _(s, d):
    return transform.boxcox_transformation(_items(s, d, "l_orderkey", "l_linenumber", "l_quantity"), "l_quantity", boxcox_lambda=0.5).withColumn("l_quantity", F.round("l_quantity", 6))


@_query("boxcox_fitted")
def _(s, d):
    return transform.boxcox_transformation(_t(s, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice")


@_query(
    "outlier_categories",
    """WITH n AS (SELECT p_brand AS v, count(*) AS n FROM part GROUP BY v), r AS (SELECT v, rank() OVER (ORDER BY n DESC) AS rk, coalesce(sum(n) OVER (ORDER BY n DESC, v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, (SELECT count(*) FROM part) AS t FROM n)
    SELECT p_partkey, CASE WHEN p_brand IN (SELECT v FROM r WHERE before < 0.5 * t AND rk <= 9) THEN p_brand ELSE 'outlier_categories' END AS p_brand FROM part""",
)
def _(s, d):
    return transform.outlier_categories(_t(s, d, "part").select("p_partkey", "p_brand"), "p_brand", coverage=0.5, max_category=10)


@_query("expression_parser", "SELECT o_orderkey, o_totalprice, o_totalprice * 2 AS f0, upper(o_orderstatus) AS f1, o_orderstatus FROM orders")
def _(s, d):
    return transform.expression_parser(_t(s, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), "o_totalprice * 2|upper(o_orderstatus)")


# Date and time

_ORD = "o_orderkey, o_orderdate"


def _o(s, d):
    return _t(s, d, "orders").select("o_orderkey", "o_orderdate")


@_query("timestamp_to_unix", "SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS o_orderdate, CAST(epoch_ms(o_orderdate) AS BIGINT) AS ms FROM orders")
def _(s, d):
    x = _o(s, d).withColumn("ms", F.col("o_orderdate"))
    return dt.timestamp_to_unix(dt.timestamp_to_unix(x, "ms", "ms", "utc"), "o_orderdate", tz="utc")


@_query("unix_to_timestamp", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS t FROM orders")
def _(s, d):
    x = dt.unix_to_timestamp(dt.timestamp_to_unix(_o(s, d), "o_orderdate", tz="utc"), "o_orderdate", tz="utc")
    return dt.timestamp_to_string(x.withColumnRenamed("o_orderdate", "t"), "t")


@_query("timezone_conversion", "SELECT o_orderkey, strftime(o_orderdate + INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M:%S') AS t FROM orders")
def _(s, d):
    x = dt.timezone_conversion(_o(s, d), "o_orderdate", "UTC", "Asia/Kolkata").withColumnRenamed("o_orderdate", "t")
    return dt.timestamp_to_string(x, "t")


@_query("dateformat_conversion", "SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS t, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def _(s, d):
    x = dt.timestamp_to_string(_o(s, d).withColumnRenamed("o_orderdate", "t"), "t", "%Y-%m-%d")
    x = dt.string_to_timestamp(x.withColumn("day", F.col("t")), "day", "%Y-%m-%d", "dt")
    return dt.dateformat_conversion(x, "t", "%Y-%m-%d", "%d/%m/%Y").withColumn("day", F.col("day").cast("string"))


@_query(
    "time_units_extraction",
    "SELECT event_id, " + ", ".join(f"CAST({v} AS INTEGER) AS ts_{k}" for k, v in {"hour": "hour(ts)", "minute": "minute(ts)", "second": "second(ts)", "dayofmonth": "day(ts)", "dayofweek": "dayofweek(ts) + 1", "dayofyear": "dayofyear(ts)", "weekofyear": "weekofyear(ts)", "month": "month(ts)", "quarter": "quarter(ts)", "year": "year(ts)"}.items()) + " FROM events",
)
def _(s, d):
    return dt.time_units_extraction(_t(s, d, "events").select("event_id", "ts"), "ts", "all", "replace")


@_query("time_diff", "SELECT l_orderkey, l_linenumber, round(abs(epoch(l_shipdate) - epoch(o_orderdate)) / 86400, 6) AS days, round(abs(epoch(l_shipdate) - epoch(o_orderdate)) / 2628000, 6) AS months FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def _(s, d):
    x = _items(s, d, "l_orderkey", "l_linenumber", "l_shipdate").join(_o(s, d), F.col("l_orderkey") == F.col("o_orderkey"))
    x = dt.time_diff(dt.time_diff(x, "l_shipdate", "o_orderdate", "days"), "l_shipdate", "o_orderdate", "months")
    return x.select("l_orderkey", "l_linenumber", F.round("l_shipdate_o_orderdate_daydiff", 6).alias("days"), F.round("l_shipdate_o_orderdate_monthdiff", 6).alias("months"))


@_query("time_elapsed", "SELECT o_orderkey, round(abs(epoch(TIMESTAMP '2001-02-03 04:05:06') - epoch(o_orderdate)) / 86400, 6) AS o_orderdate_daydiff FROM orders")
def _(s, d):
    found = dt.time_elapsed(_o(s, d), "o_orderdate", "days", now=datetime(2001, 2, 3, 4, 5, 6, tzinfo=UTC))
    return found.select("o_orderkey", F.round("o_orderdate_daydiff", 6).alias("o_orderdate_daydiff"))


@_query("string_to_timestamp", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d 00:00:00') END AS day FROM orders")
def _(s, d):
    x = _t(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise("31/31/x").alias("day"))
    return dt.timestamp_to_string(dt.string_to_timestamp(x, "day", "%d/%m/%Y"), "day")


@_query("timestamp_to_string", "SELECT event_id, strftime(ts, '%d.%m.%Y %H:%M') AS ts FROM events")
def _(s, d):
    return dt.timestamp_to_string(_t(s, d, "events").select("event_id", "ts"), "ts", "%d.%m.%Y %H:%M")


@_query("adding_time_units", "SELECT o_orderkey, strftime(o_orderdate + INTERVAL 2 MONTH, '%Y-%m-%d') AS t FROM orders")
def _(s, d):
    return dt.timestamp_to_string(dt.adding_time_units(_o(s, d), "o_orderdate", "months", 2).select("o_orderkey", F.col("o_orderdate_adjusted").alias("t")), "t", "%Y-%m-%d")


@_query("timestamp_comparison", "SELECT o_orderkey, CAST(o_orderdate > TIMESTAMP '1995-06-17 00:00:00' AS INTEGER) AS o_orderdate FROM orders")
def _(s, d):
    return dt.timestamp_comparison(_o(s, d), "o_orderdate", "greater_than", "1995-06-17 00:00:00", output_mode="replace")


_EDGES = {
    "monthStart": "date_trunc('month', o_orderdate)",
    "monthEnd": "last_day(o_orderdate)",
    "quarterStart": "date_trunc('quarter', o_orderdate)",
    "quarterEnd": "date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY",
    "yearStart": "date_trunc('year', o_orderdate)",
    "yearEnd": "make_date(year(o_orderdate), 12, 31)",
}


@_query("period_edges", "SELECT o_orderkey, " + ", ".join(f"CAST(CAST({v} AS DATE) AS VARCHAR) AS o_orderdate_{k}" for k, v in _EDGES.items()) + " FROM orders")
def _(s, d):
    x = _o(s, d)
    for f in (dt.start_of_month, dt.end_of_month, dt.start_of_quarter, dt.end_of_quarter, dt.start_of_year, dt.end_of_year):
        x = f(x, "o_orderdate")
    return x.select("o_orderkey", *(F.col(c).cast("string").alias(c) for c in x.columns[2:]))


@_query("period_edge_flags", "SELECT o_orderkey, " + ", ".join(f"CAST(CAST({v} AS DATE) = CAST(o_orderdate AS DATE) AS INTEGER) AS o_orderdate_is{k}" for k, v in _EDGES.items()) + " FROM orders")
def _(s, d):
    x = _o(s, d)
    for f in (dt.is_month_start, dt.is_month_end, dt.is_quarter_start, dt.is_quarter_end, dt.is_year_start, dt.is_year_end):
        x = f(x, "o_orderdate")
    return x.drop("o_orderdate")


@_query(
    "calendar_flags",
    "SELECT event_id, CAST(month(ts) <= 6 AS INTEGER) AS \"ts_isFirstHalf\", CAST(hour(ts) >= 22 OR hour(ts) <= 4 AS INTEGER) AS \"ts_isselectedHour\", CAST((year(ts) % 4 = 0 AND year(ts) % 100 <> 0) OR year(ts) % 400 = 0 AS INTEGER) AS \"ts_isleapYear\", CAST(dayofweek(ts) IN (0, 6) AS INTEGER) AS ts_isweekend FROM events",
)
def _(s, d):
    x = _t(s, d, "events").select("event_id", "ts")
    return dt.is_weekend(dt.is_leap_year(dt.is_selected_hour(dt.is_year_first_half(x, "ts"), "ts", 22, 4), "ts"), "ts").drop("ts")


@_query(
    "aggregator",
    "SELECT strftime(ts, '%Y-%m-%d') AS ts, count(value) AS value_count, min(value) AS value_min, max(value) AS value_max, round(sum(value), 8) AS value_sum, round(avg(value), 8) AS value_mean, quantile_disc(value, 0.5) AS value_median, round(stddev_samp(value), 8) AS value_stddev, count(DISTINCT value) AS \"value_countDistinct\" FROM events GROUP BY 1",
)
def _(s, d):
    x = dt.aggregator(_t(s, d, "events"), "value", "count|min|max|sum|mean|median|stddev|countDistinct", "ts", accuracy=EXACT)
    return x.withColumns({c: F.round(c, 8) for c in ("value_sum", "value_mean", "value_stddev")})


@_query("window_aggregator", "SELECT event_id, round(sum(value) OVER w, 4) AS value_sum, max(value) OVER w AS value_max, count(value) OVER w AS value_count FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)")
def _(s, d):
    x = dt.window_aggregator(_t(s, d, "events"), "value", "sum|max|count", "event_id", "rolling", 3, "user_id")
    return x.select("event_id", F.round("value_sum", 4).alias("value_sum"), "value_max", "value_count")


@_query("window_expanding", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 8) AS value_mean FROM events")
def _(s, d):
    return dt.window_aggregator(_t(s, d, "events"), "value", "mean", "event_id", partition_col="user_id").select("event_id", F.round("value_mean", 8).alias("value_mean"))


@_query("lagged_ts", "SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, strftime(lag(ts) OVER (PARTITION BY user_id ORDER BY ts), '%Y-%m-%d %H:%M:%S') AS earlier FROM (SELECT DISTINCT user_id, ts FROM events)")
def _(s, d):
    x = dt.lagged_ts(_t(s, d, "events").select("user_id", "ts").distinct(), "ts", 1, partition_col="user_id")
    return dt.timestamp_to_string(x.select("user_id", "ts", F.col("ts_lag1").alias("earlier")), "ts|earlier")


# Time series


@_query("ts_detection", "SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d %H:%M:%S') AS day, strftime(o_orderdate + INTERVAL 1000000000 SECOND, '%Y-%m-%d %H:%M:%S') AS sec FROM orders")
def _(s, d):
    x = _t(s, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyyMMdd").alias("day"), (F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + 1_000_000_000).alias("sec"))
    found = timeseries.detect_timestamps(x, "o_orderkey")[0]
    return found.select("o_orderkey", *(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("day", "sec")))


@_query("ts_eligibility", "WITH x AS (SELECT d, count(*) AS n, datediff('day', lag(d) OVER (ORDER BY d), d) AS gap FROM (SELECT CAST(ts AS DATE) AS d FROM events) GROUP BY d) SELECT count(*) AS count_unique_dates, CAST(min(d) AS VARCHAR) AS min_date, CAST(max(d) AS VARCHAR) AS max_date, CAST(arg_max(d, n * 100000 + datediff('day', DATE '1970-01-01', d)) AS VARCHAR) AS modal_date, round(avg(gap), 3) AS mean, round(var_samp(gap), 3) AS variance, round(stddev_samp(gap), 3) AS stdev, round(stddev_samp(gap) / avg(gap), 3) AS cov FROM x")
def _(s, d):
    x = timeseries.eligibility(_t(s, d, "events"), "user_id", "ts", 2)
    return x.withColumns({c: F.col(c).cast("string") for c in ("min_date", "max_date", "modal_date")})


_SPREAD = ", ".join(f"CAST(l[greatest(1, CAST(ceil({p!r} * len(l)) AS BIGINT))] AS BIGINT) AS p{round(p * 100)}" for p in (0.0, 0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0))


@_query(
    "ts_eligibility_spread",
    f"""WITH x AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events) SELECT 'id_date_pair' AS metric, {_SPREAD} FROM (SELECT list(n ORDER BY n) AS l FROM (SELECT count(*) AS n FROM x GROUP BY user_id))
    UNION ALL SELECT 'date_id_pair', {_SPREAD} FROM (SELECT list(n ORDER BY n) AS l FROM (SELECT count(*) AS n FROM x GROUP BY d))""",
)
def _(s, d):
    return timeseries.eligibility(_t(s, d, "events"), "user_id", "ts", 1)


@_query("ts_profile_daily", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS ts, min(value) AS min, max(value) AS max, round(avg(value), 8) AS mean, round(quantile_cont(value, 0.5), 8) AS median FROM events GROUP BY 1")
def _(s, d):
    return timeseries.profile(_t(s, d, "events"), "ts", "value").withColumns({"ts": F.col("ts").cast("string"), "mean": F.round("mean", 8), "median": F.round("median", 8)})


@_query("ts_profile_weekly", "SELECT CAST(dayofweek(ts) + 1 AS INTEGER) AS ts, event_type, count(*) AS count FROM events GROUP BY 1, 2")
def _(s, d):
    return timeseries.profile(_t(s, d, "events"), "ts", "event_type", "weekly")


@_query("ts_processed_features", "SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS yyyymmdd_col, CASE WHEN hour(ts) BETWEEN 4 AND 6 THEN 'early_hours' WHEN hour(ts) BETWEEN 10 AND 16 THEN 'work_hours' WHEN hour(ts) BETWEEN 20 AND 23 THEN 'late_hours' WHEN hour(ts) IN (7, 8, 9, 17, 18, 19) THEN 'commuting_hours' ELSE 'other_hours' END AS daypart_cat, CASE WHEN dayofweek(ts) IN (0, 6) THEN 'weekend' ELSE 'weekday' END AS week_cat FROM events")
def _(s, d):
    return timeseries.processed_features(_t(s, d, "events"), "ts").select("event_id", F.col("yyyymmdd_col").cast("string").alias("yyyymmdd_col"), "daypart_cat", "week_cat")


@_query("windowed_profile", "SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS start, count(*) AS rows, count(value) AS value_filled, round(avg(value), 8) AS value_mean, round(stddev_samp(value), 8) AS value_stddev FROM events GROUP BY 1")
def _(s, d):
    x = windowed_profile(_t(s, d, "events"), "ts", ["value"], "1 day")
    return x.select(F.unix_seconds("start").alias("start"), "rows", "value_filled", F.round("value_mean", 8).alias("value_mean"), F.round("value_stddev", 8).alias("value_stddev"))


# Geospatial

_XYZ = "cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y, sin(radians(lat)) AS z"


def _hav(a: str, b: str, c: str, d: str, r: float) -> str:
    return f"2 * {r} * asin(sqrt(least(1.0, pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin((radians({d}) - radians({b})) / 2), 2))))"


@_query("geo_format_latlon", f"SELECT c_custkey, round(cos(radians(lat)) * cos(radians(lon)) * 6371009, 3) AS p_x, round(cos(radians(lat)) * sin(radians(lon)) * 6371009, 3) AS p_y, round(sin(radians(lat)) * 6371009, 3) AS p_z, round(radians(lat), 9) AS p_lat_radian, round(radians(lon), 9) AS p_lon_radian FROM {_PLACES}")
def _(s, d):
    x = geospatial.geo_format_latlon(_places(s, d), "lat", "lon", "dd", "cartesian", "p")
    x = geospatial.geo_format_latlon(x, "lat", "lon", "dd", "radian", "p")
    return x.select("c_custkey", *(F.round(c, 3).alias(c) for c in ("p_x", "p_y", "p_z")), *(F.round(c, 9).alias(c) for c in ("p_lat_radian", "p_lon_radian")))


@_query("geo_format_cartesian", f"SELECT c_custkey, round(lat, 6) AS p_lat_dd, round(lon, 6) AS p_lon_dd FROM {_PLACES}")
def _(s, d):
    x = geospatial.geo_format_latlon(_places(s, d), "lat", "lon", "dd", "cartesian", "p")
    x = geospatial.geo_format_cartesian(x.select("c_custkey", "p_x", "p_y", "p_z"), "p_x", "p_y", "p_z", "dd", "p")
    return x.select("c_custkey", F.round("p_lat_dd", 6).alias("p_lat_dd"), F.round("p_lon_dd", 6).alias("p_lon_dd"))


@_query("geo_format_geohash", f"SELECT c_custkey, CAST(1 AS INTEGER) AS near FROM {_PLACES}")
def _(s, d):
    x = geospatial.geo_format_latlon(_places(s, d), "lat", "lon", "dd", "geohash", "p")
    x = geospatial.geo_format_geohash(x, "p_geohash", "dd", "q")
    return x.select("c_custkey", ((F.abs(F.col("q_lat_dd") - F.col("lat")) < 0.0002) & (F.abs(F.col("q_lon_dd") - F.col("lon")) < 0.0004)).cast("int").alias("near"))


@_query("location_distance_haversine", f"SELECT c_custkey, round({_hav('lat', 'lon', '10.0', '20.0', G.EARTH_RADIUS)}, 2) AS m FROM {_PLACES}")
def _(s, d):
    x = _places(s, d).withColumns({"a": F.lit(10.0), "b": F.lit(20.0)})
    return geospatial.location_distance(x, "lat|lon", "a|b", result_prefix="x").select("c_custkey", F.round("x_distance", 2).alias("m"))


@_query("location_distance_euclidean", f"SELECT c_custkey, round(sqrt(pow(x - cos(radians(10)) * cos(radians(20)), 2) + pow(y - cos(radians(10)) * sin(radians(20)), 2) + pow(z - sin(radians(10)), 2)) * 6371.009, 4) AS km FROM (SELECT c_custkey, {_XYZ} FROM {_PLACES})")
def _(s, d):
    x = _places(s, d).withColumns({"a": F.lit(10.0), "b": F.lit(20.0)})
    return geospatial.location_distance(x, "lat|lon", "a|b", result_prefix="x", distance_type="euclidean", unit="km").select("c_custkey", F.round("x_distance", 4).alias("km"))


@_query("location_distance_vincenty")
def _(s, d):
    x = _places(s, d).withColumns({"a": F.lit(10.0), "b": F.lit(20.0)})
    return geospatial.location_distance(x, "lat|lon", "a|b", result_prefix="x", distance_type="vincenty")


@_query("geohash_precision_control", f"SELECT c_custkey, 4 AS n FROM {_PLACES}")
def _(s, d):
    x = geospatial.geo_format_latlon(_places(s, d), "lat", "lon", "dd", "geohash", "p")
    return geospatial.geohash_precision_control(x, "p_geohash", km_max_error=20, output_mode="replace").select("c_custkey", F.length("p_geohash").alias("n"))


_RING = [[-20.0, -30.0], [50.0, -30.0], [50.0, 35.0], [-20.0, 35.0], [-20.0, -30.0]]


@_query("location_in_polygon", f"SELECT c_custkey, CAST(lat BETWEEN -30 AND 35 AND lon BETWEEN -20 AND 50 AS INTEGER) AS p_in_poly FROM {_PLACES}")
def _(s, d):
    return geospatial.location_in_polygon(_places(s, d), "lat", "lon", {"type": "Polygon", "coordinates": [_RING]}, "p").select("c_custkey", "p_in_poly")


@_query("location_in_country", f"SELECT c_custkey, CAST(lat BETWEEN 8.0 AND 35.5 AND lon BETWEEN 68.1 AND 97.4 AS INTEGER) AS \"p_in_IN_approx\" FROM {_PLACES}")
def _(s, d):
    return geospatial.location_in_country(_places(s, d), "lat", "lon", "IN", {"IN": (68.1, 8.0, 97.4, 35.5)}, result_prefix="p").select("c_custkey", "p_in_IN_approx")


@_query("centroid", f"SELECT c_nationkey, round(degrees(atan2(z, sqrt(x * x + y * y))), 4) AS lat_centroid, round(degrees(atan2(y, x)), 4) AS lon_centroid FROM (SELECT c_nationkey, sum(x) AS x, sum(y) AS y, sum(z) AS z FROM (SELECT c_nationkey, {_XYZ} FROM {_PLACES}) GROUP BY 1)")
def _(s, d):
    return geospatial.centroid(_places(s, d), "lat", "lon", "c_nationkey").withColumns({c: F.round(c, 4) for c in ("lat_centroid", "lon_centroid")})


@_query("weighted_centroid", f"SELECT c_nationkey, round(degrees(atan2(z, sqrt(x * x + y * y))), 4) AS lat_weighted_centroid, round(degrees(atan2(y, x)), 4) AS lon_weighted_centroid FROM (SELECT DISTINCT c_nationkey FROM customer), (SELECT sum(x) AS x, sum(y) AS y, sum(z) AS z FROM (SELECT {_XYZ} FROM {_PLACES}))")
def _(s, d):
    return geospatial.weighted_centroid(_places(s, d), "c_nationkey", "lat", "lon").withColumns({c: F.round(c, 4) for c in ("lat_weighted_centroid", "lon_weighted_centroid")})


@_query(
    "rog_calculation",
    f"""WITH c AS (SELECT c_nationkey, degrees(atan2(z, sqrt(x * x + y * y))) AS la, degrees(atan2(y, x)) AS lo FROM (SELECT c_nationkey, sum(x) AS x, sum(y) AS y, sum(z) AS z FROM (SELECT c_nationkey, {_XYZ} FROM {_PLACES}) GROUP BY 1))
    SELECT c_nationkey, round(avg({_hav("lat", "lon", "la", "lo", G.GYRATION_RADIUS)}), 1) AS radius_of_gyration FROM {_PLACES} JOIN c USING (c_nationkey) GROUP BY 1""",
)
def _(s, d):
    return geospatial.rog_calculation(_places(s, d), "lat", "lon", "c_nationkey").withColumn("radius_of_gyration", F.round("radius_of_gyration", 1))


@_query(
    "reverse_geocoding",
    f"""WITH g AS (SELECT lat AS ga, lon AS go, 'city' || c_custkey AS name_of_place FROM {_PLACES} WHERE c_custkey % 10 = 0), p AS (SELECT DISTINCT lat, lon FROM {_PLACES})
    SELECT lat, lon, arg_min(name_of_place, round({_hav("lat", "lon", "ga", "go", G.EARTH_RADIUS)}, 3)) AS name_of_place, 'r' AS region, 'XX' AS country_code FROM p, g GROUP BY lat, lon""",
)
def _(s, d):
    g = _places(s, d).where("c_custkey % 10 = 0").select(F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), F.concat(F.lit("city"), F.col("c_custkey")).alias("name_of_place"), F.lit("r").alias("region"), F.lit("XX").alias("country_code"))
    return geospatial.reverse_geocoding(_places(s, d), "lat", "lon", g)


@_query("location_stats_top", f"SELECT concat_ws(',', CAST(la AS VARCHAR), CAST(lo AS VARCHAR)) AS location, count(DISTINCT c_custkey) AS count_id, count(*) AS count_records FROM (SELECT c_custkey, CAST(floor(lat / 40) AS BIGINT) AS la, CAST(floor(lon / 40) AS BIGINT) AS lo FROM {_PLACES}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def _(s, d):
    x = _places(s, d).select("c_custkey", F.floor(F.col("lat") / 40).alias("la"), F.floor(F.col("lon") / 40).alias("lo"))
    return geospatial.location_stats(x, "la", "lo", None, "c_custkey", 20)[1]


@_query("geo_clusters")
def _(s, d):
    return geospatial.cluster_analysis(_places(s, d), "lat", "lon", 5, 5.0, 10)[0]


# Recommendation, feature store, report


def _corpus(s, d):
    return _t(s, d, "part").select(F.col("p_name").alias("feature_name"), F.col("p_type").alias("feature_desc"), F.lower("p_brand").alias("industry"), F.concat(F.lit("size "), F.col("p_size") % 5).alias("usecase"))


@_query("feature_corpus", "SELECT DISTINCT lower(p_brand) AS industry, concat('size ', p_size % 5) AS usecase FROM part")
def _(s, d):
    return recommend.listed(_corpus(s, d), "pair")


@_query("feature_exploration")
def _(s, d):
    return recommend.features_by(_corpus(s, d), usecase="size 3", num_of_feat=50)


@_query("feature_mapper")
def _(s, d):
    return recommend.feature_mapper(_t(s, d, "nation"), recommend.prepare_corpus(_corpus(s, d)), "n_name")


@_query("find_attr_by_relevance")
def _(s, d):
    return recommend.find_attr_by_relevance(_t(s, d, "nation"), ["north america", "a land in europe"], "n_name", threshold=0.1)


@_query(
    "point_in_time_join",
    """SELECT e.event_id, (SELECT f.value FROM events f WHERE f.user_id = e.user_id AND f.event_type = 'purchase' AND f.ts <= e.ts ORDER BY f.ts DESC, f.value DESC LIMIT 1) AS last_value FROM events e WHERE e.event_type <> 'purchase'""",
)
def _(s, d):
    e = _t(s, d, "events")
    f = e.where("event_type = 'purchase'").groupBy("user_id", F.col("ts").alias("ft")).agg(F.max("value").alias("last_value"))
    return featurestore.point_in_time_join(e.where("event_type != 'purchase'").select("event_id", "user_id", "ts"), f, ["user_id"], "ts", "ft").select("event_id", "last_value")


@_query("report_frequency", "SELECT l_returnflag, count(*) AS count, round(100 * count(*) / (SELECT count(*) FROM lineitem)::DOUBLE, 4) AS \"count_%\" FROM lineitem GROUP BY 1")
def _(s, d):
    return report.frequency(_t(s, d, "lineitem"), "l_returnflag")


@_query("report_event_rate", "SELECT l_linestatus, round(100 * avg(CAST(l_returnflag = 'R' AS INTEGER)), 4) AS event_rate FROM lineitem GROUP BY 1")
def _(s, d):
    return report.event_rate(_t(s, d, "lineitem"), "l_linestatus", "l_returnflag", "R")


@_query("report_health_flags")
def _(s, d):
    return report.health_flags(_items(s, d, *NUM, *FLAGS), "l_returnflag", "R")


# Tables behind charts and report tabs


@_query("write_dataset", "SELECT s_nationkey, s_acctbal, s_name FROM supplier")
def _(s, d):
    path = f"{shared_folder(s).rstrip('/')}/suppliers-{uuid.uuid4().hex}"
    io.write_dataset(_t(s, d, "supplier").select("s_name", "s_acctbal", "s_nationkey"), path, "parquet", {"mode": "overwrite", "repartition": 2}, ["s_nationkey", "s_acctbal", "s_name"])
    return io.read_dataset(s, path, "parquet")


@_query(
    "report_comparative_drift",
    """WITH p AS (SELECT c_nationkey AS k, count(*) / (SELECT count(*) FROM customer)::DOUBLE AS a FROM customer GROUP BY 1), q AS (SELECT s_nationkey AS k, count(*) / (SELECT count(*) FROM supplier)::DOUBLE AS b FROM supplier GROUP BY 1)
    SELECT CAST(k AS VARCHAR) AS bin, round(coalesce(a, 0), 6) AS source_share, round(coalesce(b, 0), 6) AS target_share, CASE WHEN a > 0 THEN round(100 * (coalesce(b, 0) - a) / a, 4) END AS diff FROM p FULL JOIN q USING (k)""",
)
def _(s, d):
    a, b = _t(s, d, "customer").select(F.col("c_nationkey").cast("string").alias("k")), _t(s, d, "supplier").select(F.col("s_nationkey").cast("string").alias("k"))
    return report.comparative_drift(b, a, "k").select("bin", F.round("source_share", 6).alias("source_share"), F.round("target_share", 6).alias("target_share"), F.col("%_diff").alias("diff"))


_Q3 = "[l[greatest(1, CAST(ceil(p * len(l)) AS BIGINT))] for p in [0.25, 0.5, 0.75]]"


@_query(
    "report_outlier_spread",
    f"""WITH q AS (SELECT l_linestatus AS grp, l[1] AS lo, l[len(l)] AS hi, {_Q3} AS q, l FROM (SELECT l_linestatus, list(l_extendedprice ORDER BY l_extendedprice) AS l FROM lineitem GROUP BY 1)),
    f AS (SELECT *, q[1] - 1.5 * (q[3] - q[1]) AS a, q[3] + 1.5 * (q[3] - q[1]) AS b FROM q)
    SELECT grp AS "group", 'l_extendedprice' AS attribute, lo AS min, q[1] AS q1, q[2] AS median, q[3] AS q3, hi AS max, round(a, 4) AS lower_fence, round(b, 4) AS upper_fence, CAST(len(list_filter(l, lambda x: x < a OR x > b)) AS BIGINT) AS outliers FROM f""",
)
def _(s, d):
    found = charts.outlier_spread(_t(s, d, "lineitem"), "l_extendedprice", split_col="l_linestatus", accuracy=EXACT)
    return found.withColumns({c: F.round(c, 4) for c in ("lower_fence", "upper_fence")})


@_query("report_bin_index", "SELECT * FROM (VALUES (1, '<= 1.0'), (2, '1.0-2.5'), (3, '2.5'), (4, '> 2.5')) t(bin_idx, size)")
def _(s, d):
    return charts.bin_index(_t(s, d, "region"), "size", [1, 2.5, 2.5])


@_query("report_frequency_binned", f"SELECT CASE WHEN l_quantity <= lo + w THEN 0 WHEN l_quantity <= lo + 2 * w THEN 1 WHEN l_quantity <= lo + 3 * w THEN 2 ELSE 3 END AS bin, count(*) AS count, round(100 * count(*) / (SELECT count(*) FROM lineitem)::DOUBLE, 4) AS pct FROM lineitem, (SELECT min(l_quantity) AS lo, (max(l_quantity) - min(l_quantity)) / 4 AS w FROM lineitem) GROUP BY 1")
def _(s, d):
    x = _items(s, d, "l_quantity")
    cuts = binning.cutoffs(x, ["l_quantity"], "equal_range", 4)["l_quantity"]
    labels = charts.bin_index(x, "l_quantity", cuts)
    found = charts.chart_tables(x, bin_size=4)["freqDist_l_quantity"]
    return found.join(labels, "l_quantity").select((F.col("bin_idx") - 1).alias("bin"), "count", F.col("count_%").alias("pct"))


@_query(
    "report_stability_lines",
    """WITH p AS (SELECT CAST(year(o_orderdate) AS VARCHAR) AS idx, avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders GROUP BY 1), i AS (SELECT (SELECT stddev_samp(m) / avg(m) FROM p) AS cv)
    SELECT 'o_totalprice' AS attribute, idx, measure, round(value, 2) AS value FROM (SELECT idx, 'mean' AS measure, m AS value FROM p UNION ALL SELECT idx, 'stddev', s FROM p)""",
)
def _(s, d):
    x = _t(s, d, "orders").select(F.year("o_orderdate").alias("idx"), "o_totalprice")
    history = drift.period_metrics(x, ["o_totalprice"], "idx")
    lines = charts.stability_lines(history, drift.stability_from_metrics(history))
    return lines.where("measure != 'kurtosis'").select("attribute", "idx", "measure", F.round("value", 2).alias("value"))


@_query("report_stability_bands", "SELECT * FROM (VALUES (0.5, 'Very Unstable'), (1.0, 'Unstable'), (2.2, 'Marginally Stable'), (3.0, 'Stable'), (3.5, 'Very Stable'), (-1.0, 'Out of Range')) t(x, band)")
def _(s, d):
    x = s.createDataFrame([(v,) for v in (0.5, 1.0, 2.2, 3.0, 3.5, -1.0)], "x double")
    return x.withColumn("x", F.col("x").cast("decimal(2,1)")).withColumn("band", report.stability_band(F.col("x")))


@_query("data_dictionary", "SELECT * FROM (VALUES ('n_nationkey', 'int', NULL), ('n_name', 'string', 'name of a nation'), ('n_regionkey', 'int', NULL)) t(attribute, data_type, definition)")
def _(s, d):
    return charts.data_dictionary(_t(s, d, "nation"), s.createDataFrame([("n_name", "name of a nation")], "attribute string, definition string"))


_PRODUCT_DAYS = "(SELECT CAST(ts AS DATE) AS d, avg(value) AS v FROM events GROUP BY 1)"


@_query(
    "ts_decomposition",
    f"""WITH x AS (SELECT d, v, (row_number() OVER w - 1) % 12 AS ph, CASE WHEN count(v) OVER (ORDER BY d ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) = 13 THEN (sum(v) OVER (ORDER BY d ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) + (lag(v, 6) OVER w + lead(v, 6) OVER w) / 2) / 12 END AS t FROM {_PRODUCT_DAYS} WINDOW w AS (ORDER BY d)),
    m AS (SELECT ph, coalesce(avg(v - t), 0) AS m FROM x GROUP BY ph) SELECT CAST(d AS VARCHAR) AS ts, round(v, 6) AS value, round(t, 6) AS trend, round(m - (SELECT avg(m) FROM m), 6) AS seasonal, round(v - t - (m - (SELECT avg(m) FROM m)), 6) AS residual FROM x JOIN m USING (ph)""",
)
def _(s, d):
    days = timeseries.profile(_t(s, d, "events"), "ts", "value")
    found = timeseries.decomposition(days, "ts", "mean")
    return found.select(F.col("ts").cast("string").alias("ts"), *(F.round(c, 6).alias(c) for c in ("value", "trend", "seasonal", "residual")))


@_query("ts_view_hourly", "SELECT CASE WHEN hour(ts) BETWEEN 4 AND 6 THEN 'early_hours' WHEN hour(ts) BETWEEN 10 AND 16 THEN 'work_hours' WHEN hour(ts) BETWEEN 20 AND 23 THEN 'late_hours' WHEN hour(ts) IN (7, 8, 9, 17, 18, 19) THEN 'commuting_hours' ELSE 'other_hours' END AS ts, min(value) AS min, max(value) AS max, round(avg(value), 8) AS mean, round(quantile_cont(value, 0.5), 8) AS median FROM events GROUP BY 1")
def _(s, d):
    found = charts.ts_views(_t(s, d, "events"), "ts", "value", "hourly")["ts_value_hourly"]
    return found.withColumns({c: F.round(c, 8) for c in ("mean", "median")})


@_query("ts_analyzer", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS ts, event_type, count(*) AS count FROM events WHERE event_type IN (SELECT event_type FROM events GROUP BY 1 ORDER BY count(*) DESC, event_type LIMIT 10) GROUP BY 1, 2")
def _(s, d):
    found = timeseries.ts_analyzer(_t(s, d, "events").select("event_id", "ts", "event_type"), "event_id", max_days=1_000_000)
    return found["ts", "event_type", "daily"].withColumn("ts", F.col("ts").cast("string"))


@_query("ts_landscape", "SELECT CAST(count(DISTINCT CAST(ts AS DATE)) AS BIGINT) AS days, CAST(min(CAST(ts AS DATE)) AS VARCHAR) AS first, CAST(max(CAST(ts AS DATE)) AS VARCHAR) AS last FROM events")
def _(s, d):
    found = charts.ts_landscape(_t(s, d, "events"), "ts", "user_id")["ts_ts_eligibility_2"]
    return found.select(F.col("count_unique_dates").alias("days"), F.col("min_date").cast("string").alias("first"), F.col("max_date").cast("string").alias("last"))


@_query("ts_tests")
def _(s, d):
    return charts.ts_tests(_t(s, d, "events"), "ts", "value")


@_query("location_fields", "SELECT * FROM (VALUES ('Latitude Col', 'latitude', 1), ('Longitude Col', 'longitude', 1), ('Geohash Col', '', 0)) t(field, columns, count)")
def _(s, d):
    x = _places(s, d).select("c_custkey", F.col("lat").alias("latitude"), F.col("lon").alias("longitude"))
    return charts.location_fields(x, *geospatial.detect_locations(x))


@_query("location_stats_summary", f"WITH x AS (SELECT DISTINCT lat, lon FROM {_PLACES}) SELECT 'Distinct {{Lat, Long}} Pair' AS stats, CAST(count(*) AS VARCHAR) AS count FROM x UNION ALL SELECT 'Distinct Latitude', CAST(count(DISTINCT lat) AS VARCHAR) FROM x UNION ALL SELECT 'Distinct Longitude', CAST(count(DISTINCT lon) AS VARCHAR) FROM x")
def _(s, d):
    x = _places(s, d).select("c_custkey", F.col("lat").alias("latitude"), F.col("lon").alias("longitude"))
    return charts.location_tables(x, "c_custkey")["location_summary_latitude_longitude"]


@_query("location_in_range", f"SELECT c_custkey, lat, lon FROM {_PLACES} WHERE c_custkey % 9 <> 0")
def _(s, d):
    x = _places(s, d).select("c_custkey", F.when(F.col("c_custkey") % 9 != 0, F.col("lat")).otherwise(F.col("lat") + 300).alias("lat"), "lon")
    return geospatial._valid(x, "lat", "lon").select("c_custkey", "lat", "lon")


@_query("cluster_sizes", f"SELECT CAST(c_nationkey AS BIGINT) AS cluster, count(*) AS count, round(avg(lat), 9) AS latitude, round(avg(lon), 9) AS longitude FROM {_PLACES} GROUP BY 1")
def _(s, d):
    x = _places(s, d).select("lat", "lon", F.col("c_nationkey").cast("bigint").alias("cluster"))
    return charts.cluster_sizes(x).withColumns({c: F.round(c, 9) for c in ("latitude", "longitude")})


@_query("usecases_by_industry", "SELECT DISTINCT 'size ' || (p_size % 5) AS usecase FROM part WHERE contains(lower(p_brand), (SELECT min(lower(p_brand)) FROM part))")
def _(s, d):
    c = _corpus(s, d)
    return recommend.listed_by(c, "usecase", "industry", c.agg(F.min("industry")).first()[0], semantic=False)


@_query("industries_by_usecase", "SELECT DISTINCT lower(p_brand) AS industry FROM part WHERE p_size % 5 = 2")
def _(s, d):
    return recommend.listed_by(_corpus(s, d), "industry", "usecase", "size 2", semantic=False)


@_query("features_by_pair", "SELECT p_name AS feature_name, p_type AS feature_desc, lower(p_brand) AS industry, 'size 1' AS usecase FROM part WHERE p_size % 5 = 1 AND contains(lower(p_brand), (SELECT min(lower(p_brand)) FROM part))")
def _(s, d):
    c = _corpus(s, d)
    return recommend.features_by(c, c.agg(F.min("industry")).first()[0], "size 1", "all", semantic=False)


@_query("features_by_usecase", "SELECT p_name AS feature_name, p_type AS feature_desc, lower(p_brand) AS industry, 'size 4' AS usecase FROM part WHERE p_size % 5 = 4")
def _(s, d):
    return recommend.features_by(_corpus(s, d), usecase="size 4", num_of_feat="all", semantic=False)


@_query("sankey_edges", "SELECT r_name AS source, n_name AS target, CAST(1.5 AS DOUBLE) AS weight FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(s, d):
    x = _t(s, d, "nation").join(_t(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", F.col("n_name").alias("feature_name"), F.lit(1.5).alias("similarity"))
    return recommend.sankey_frames(x, "r_name")[1]


@_query(
    "feature_store_fields",
    """SELECT * FROM (VALUES ('c_name', '        Field(name="c_name", dtype=String),'), ('c_nationkey', '        Field(name="c_nationkey", dtype=Int64),'), ('c_acctbal', '        Field(name="c_acctbal", dtype=Float64),'), ('c_mktsegment', '        Field(name="c_mktsegment", dtype=String),')) t(attribute, field)""",
)
def _(s, d):
    kinds = [(n, k) for n, k in _t(s, d, "customer").dtypes if n != "c_custkey"]
    text = featurestore.fields_text(kinds, ["c_custkey"]).splitlines()
    return s.createDataFrame([(n, line) for (n, _), line in zip(kinds, text, strict=True)], "attribute string, field string")


@_query("feature_store_timestamps", "SELECT s_suppkey, '2020-01-02 03:04:05' AS event_time, '2020-01-02 03:04:05' AS create_time FROM supplier")
def _(s, d):
    source = {"event_timestamp": "event_time", "create_timestamp": "create_time"}
    x = featurestore.add_timestamp_columns(_t(s, d, "supplier").select("s_suppkey"), source, datetime(2020, 1, 2, 3, 4, 5, tzinfo=UTC))
    return x.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in source.values()})


@_query(
    "point_in_time_join_ttl",
    """SELECT event_id, CASE WHEN user_id IS NOT NULL THEN (SELECT f.value FROM events f WHERE f.event_type = 'purchase' AND CASE WHEN f.event_id % 4 <> 0 THEN f.user_id END = e.user_id AND f.ts <= e.ts AND e.ts - f.ts <= INTERVAL 864000 SECOND ORDER BY f.ts DESC, f.value DESC LIMIT 1) END AS value
    FROM (SELECT event_id, ts, CASE WHEN event_id % 3 <> 0 THEN user_id END AS user_id FROM events WHERE event_type <> 'purchase') e""",
)
def _(s, d):
    e = _t(s, d, "events")
    keyed = lambda x, n: x.withColumn("user_id", F.when(F.col("event_id") % n != 0, F.col("user_id")))
    f = keyed(e.where("event_type = 'purchase'"), 4).select("user_id", F.col("ts").alias("ft"), "value")
    return featurestore.point_in_time_join(keyed(e.where("event_type != 'purchase'"), 3).select("event_id", "user_id", "ts"), f, ["user_id"], "ts", "ft", 864_000).select("event_id", "value")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
