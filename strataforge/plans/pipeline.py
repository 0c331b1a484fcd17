"""Pipelines from a configuration: blocks are run in their order, each on what the one before gave."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from strataforge.functions import datetime as dt
from strataforge.operators import association, binning, drift, geospatial, imputation, quality, sampling, stats, timeseries, transform
from strataforge.plans import charts, featurestore, report
from strataforge.sources import io

_INGEST = {"delete_column": io.delete_column, "select_column": io.select_column, "rename_column": io.rename_column, "recast_column": io.recast_column, "data_sample": sampling.data_sample}
_STATS = {
    "global_summary": stats.global_summary,
    "measures_of_counts": stats.measures_of_counts,
    "measures_of_centralTendency": stats.central_tendency,
    "measures_of_cardinality": stats.measures_of_cardinality,
    "measures_of_dispersion": stats.measures_of_dispersion,
    "measures_of_percentiles": stats.measures_of_percentiles,
    "measures_of_shape": stats.measures_of_shape,
}
_QUALITY = {
    "duplicate_detection": quality.duplicate_detection,
    "nullRows_detection": quality.null_rows_detection,
    "nullColumns_detection": quality.null_columns_detection,
    "outlier_detection": quality.outlier_detection,
    "IDness_detection": quality.idness_detection,
    "biasedness_detection": quality.biasedness_detection,
    "invalidEntries_detection": quality.invalid_entries_detection,
}
_ASSOCIATION = {"correlation_matrix": association.correlation_matrix, "variable_clustering": association.variable_clustering, "IV_calculation": association.iv_calculation, "IG_calculation": association.ig_calculation}
_TRANSFORM = {
    "attribute_binning": binning.attribute_binning,
    "monotonic_binning": binning.monotonic_binning,
    "cat_to_num_unsupervised": transform.cat_to_num_unsupervised,
    "cat_to_num_supervised": transform.cat_to_num_supervised,
    "z_standardization": transform.z_standardization,
    "IQR_standardization": transform.iqr_standardization,
    "normalization": transform.normalization,
    "imputation_MMM": imputation.impute_mmm,
    "imputation_sklearn": imputation.impute_model,
    "imputation_matrixFactorization": imputation.impute_factorization,
    "auto_imputation": imputation.auto_imputation,
    "autoencoder_latentFeatures": transform.autoencoder_latent_features,
    "PCA_latentFeatures": transform.pca_latent_features,
    "feature_transformation": transform.feature_transformation,
    "boxcox_transformation": transform.boxcox_transformation,
    "outlier_categories": transform.outlier_categories,
    "expression_parser": transform.expression_parser,
}


def _pick(table: Mapping[str, Any], name: str) -> Any:
    if name not in table:
        raise ValueError(f"unknown operator: {name}")
    return table[name]


def load(path: str, spark: SparkSession | None = None) -> dict:
    """A YAML file, by Spark's file systems if a session is given."""
    import yaml

    if spark is not None:
        return yaml.safe_load(spark.read.text(path, wholetext=True).first()[0])
    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)


def etl(spark: SparkSession, block: Mapping) -> DataFrame:
    """``read_dataset`` and the ingest operators that follow it."""
    df = io.read_dataset(spark, **block["read_dataset"])
    for name, args in block.items():
        if name != "read_dataset" and args:
            df = _pick(_INGEST, name)(df, **args)
    return df


def _write(df: DataFrame, config: Mapping | None, name: str) -> DataFrame:
    """Written and read again where a folder is configured: later steps don't repeat earlier ones."""
    if not config:
        return df
    args = dict(config)
    path = f"{args.pop('file_path').rstrip('/')}/{name}"
    args["file_configs"] = {"mode": "overwrite", **(args.get("file_configs") or {})}
    io.write_dataset(df, path, **args)
    return io.read_dataset(df.sparkSession, path, args["file_type"], {"header": "true"} if args["file_type"] == "csv" else {}, df.schema.simpleString()[7:-1] if args["file_type"] == "csv" else None)


def run(spark: SparkSession, config: Mapping | str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The final dataset and every table of statistics, by ``block/operator``."""
    config = load(config, spark) if isinstance(config, str) else config
    df = etl(spark, config["input_dataset"])
    tables: dict[str, DataFrame] = {}
    between, kept = config.get("write_intermediate"), config.get("write_stats")

    def keep(name: str, table: DataFrame) -> None:
        tables[name] = _write(table, kept, name)

    for block, args in config.items():
        if not args or block in ("input_dataset", "write_main", "write_intermediate", "write_stats", "write_feast_features"):
            continue  # the last two after all others
        if block == "concatenate_dataset":
            rest = [etl(spark, v) for k, v in args.items() if k != "method"]
            df = _write(io.concatenate_dataset(df, *rest, method_type=args.get("method", "name")), between, block)
        elif block == "join_dataset":
            rest = [etl(spark, v) for k, v in args.items() if k not in ("join_cols", "join_type")]
            df = _write(io.join_dataset(df, *rest, join_cols=args["join_cols"], join_type=args["join_type"]), between, block)
        elif block == "timeseries_analyzer":
            if args.get("auto_detection"):
                df, _ = timeseries.detect_timestamps(df, args.get("id_col"))
            for key, table in timeseries.ts_analyzer(df, args.get("id_col"), args.get("analysis_level", "daily"), int(args.get("max_days", 3600))).items():
                keep("/".join((block, *key)), table)
        elif block == "geospatial_controller":
            if "geospatial_analyzer" in args:
                args = args["geospatial_analyzer"]
            clusters = {k: args[k] for k in ("max_cluster", "eps", "min_samples", "max_records") if args.get(k) is not None} if args.get("cluster_analysis") else None
            for name, table in charts.location_tables(df, args["id_col"], int(args.get("top_geo_records", 100)), clusters).items():
                keep(f"{block}/{name}", table)
        elif block == "basic_report":
            if args.get("basic_report", True):
                wanted = {k: v for k, v in args.get("report_args", {}).items() if k in ("id_col", "label_col", "event_label", "skip_corr_matrix")}
                for name, table in report.basic_tables(df, **wanted).items():
                    keep(f"report/{name}", table)
                break
        elif block == "stats_generator":
            for name in args["metric"]:
                keep(f"{block}/{name}", _pick(_STATS, name)(df, **(args.get("metric_args") or {})))
        elif block == "quality_checker":
            for name, a in args.items():
                if a is not None:
                    df, table = _pick(_QUALITY, name)(df, **a)
                    keep(f"{block}/{name}", table)
                    df = _write(df, between, f"{block}/{name}")
        elif block == "association_evaluator":
            for name, a in args.items():
                if a is not None:
                    keep(f"{block}/{name}", _pick(_ASSOCIATION, name)(df, **a))
        elif block == "drift_detector":
            if args.get("drift_statistics"):
                one = args["drift_statistics"]
                source = etl(spark, one["source_dataset"]) if one.get("source_dataset") else None
                keep(f"{block}/drift_statistics", drift.drift_statistics(df, source, **one["configs"]))
            if args.get("stability_index"):
                one = args["stability_index"]
                frames = [etl(spark, v) for k, v in one.items() if k != "configs"]
                keep(f"{block}/stability_index", drift.stability_index_computation(frames, **one["configs"]))
        elif block == "transformers":
            for group in args.values():
                for name, a in (group or {}).items():
                    if a is not None:
                        df = _write(_pick(_TRANSFORM, name)(df, **a), between, f"{block}/{name}")
        elif block == "datetime":
            for name, a in args.items():
                df = getattr(dt, name)(df, **a)
        elif block == "report_preprocessing":
            wanted = dict(args.get("charts_to_objects") or {})
            source = etl(spark, wanted.pop("source_dataset")) if wanted.get("source_dataset") else None
            allowed = {k: v for k, v in wanted.items() if k in ("list_of_cols", "drop_cols", "label_col", "event_label", "bin_method", "bin_size", "outlier_charts") and v is not None}
            for name, table in charts.chart_tables(df, source=source, **allowed).items():
                keep(f"{block}/{name}", table)
        elif block == "report_generation":
            keep("data_dictionary", charts.data_dictionary(df))
            page = charts.page(tables, args.get("title", "Report"))
            df.sparkSession.createDataFrame([(page,)], "page string").coalesce(1).write.mode("overwrite").text(args["final_report_path"])
        else:
            raise ValueError(f"unknown block: {block}")
    export = config.get("write_feast_features")
    if export:
        featurestore.check_config(export, int((config.get("write_main") or {}).get("file_configs", {}).get("repartition", 1)))
        df = featurestore.add_timestamp_columns(df, export["file_source"])
    if config.get("write_main"):
        df = _write(df, config["write_main"], "final_dataset")
    if export:
        path = f"{config['write_main']['file_path'].rstrip('/')}/final_dataset" if config.get("write_main") else ""
        text = featurestore.definitions(df.dtypes, export, path)
        spark.createDataFrame([(text,)], "text string").coalesce(1).write.mode("overwrite").text(export["file_path"])
    return df, tables
