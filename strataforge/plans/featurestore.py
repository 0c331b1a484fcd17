"""Feature-store definitions as Python source text, and point-in-time joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataforge.functions.columns import col

#: The store's type of each Spark type.
FIELD_TYPES = {"string": "String", "int": "Int64", "smallint": "Int64", "tinyint": "Int64", "bigint": "Int64", "float": "Float32", "double": "Float64", "boolean": "Bool", "binary": "Bytes", "date": "UnixTimestamp", "timestamp": "UnixTimestamp", "timestamp_ntz": "UnixTimestamp"}


def check_config(config: Mapping, repartition_count: int) -> None:
    for block in ("file_path", "entity", "file_source", "feature_view"):
        if block not in config:
            raise ValueError(f"feature store configuration: {block} is missing")
    if repartition_count != 1:
        raise ValueError("feature store export needs one file: repartition must be 1")


def entity_text(entity: Mapping) -> str:
    name = entity["name"]
    return f'{name} = Entity(name="{name}", join_keys=["{entity["id_col"]}"], description="{entity.get("description", "")}")\n'


def source_text(source: Mapping, path: str) -> str:
    return f'file_source = FileSource(path="{path}", timestamp_field="{source["event_timestamp"]}", created_timestamp_column="{source["create_timestamp"]}")\n'


def field_text(name: str, kind: str) -> str:
    base = "Float64" if kind.startswith("decimal") else FIELD_TYPES.get(kind, "String")
    return f'        Field(name="{name}", dtype={base}),\n'


def fields_text(types: Sequence[tuple[str, str]], exclude: Sequence[str]) -> str:
    return "".join(field_text(n, t) for n, t in types if n not in exclude)


def view_text(types: Sequence[tuple[str, str]], exclude: Sequence[str], view: Mapping, entity: str) -> str:
    name = view["name"]
    return f'{name} = FeatureView(\n    name="{name}",\n    entities=[{entity}],\n    ttl=timedelta(seconds={int(view["ttl_in_seconds"])}),\n    schema=[\n{fields_text(types, exclude)}    ],\n    online=True,\n    source=file_source,\n    tags={{"owner": "{view.get("owner", "")}"}},\n)\n'


def service_text(name: str, view: str) -> str:
    return f'{name} = FeatureService(name="{name}", features=[{view}])\n'


def definitions(types: Sequence[tuple[str, str]], config: Mapping, path: str) -> str:
    """A module that defines the entity, source, view and, if configured, service."""
    entity, source, view = config["entity"], config["file_source"], config["feature_view"]
    exclude = [entity["id_col"], source["event_timestamp"], source["create_timestamp"]]
    used = sorted({field_text("", t).split("dtype=")[1].split(")")[0] for n, t in types if n not in exclude})
    head = f"from datetime import timedelta\n\nfrom feast import Entity, FeatureService, FeatureView, Field, FileSource\nfrom feast.types import {', '.join(used)}\n\n"
    parts = [head, entity_text(entity), source_text(source, path), view_text(types, exclude, view, entity["name"])]
    if "service_name" in config:
        parts.append(service_text(config["service_name"], view["name"]))
    return "\n".join(parts)


def add_timestamp_columns(df: DataFrame, source: Mapping, now: datetime | None = None) -> DataFrame:
    stamp = F.lit(now) if now else F.current_timestamp()
    return df.withColumns({source["event_timestamp"]: stamp, source["create_timestamp"]: stamp})


def point_in_time_join(entities: DataFrame, features: DataFrame, keys: Sequence[str], event_time: str, feature_time: str, ttl_seconds: int | None = None) -> DataFrame:
    """Each entity row with the features of its keys that were the latest at its time: one union, one sort per key, no pairs.

    Rows of both sides are put in time order per key and the last features are carried on. Feature rows of one key and time: the
    greatest by its values, in the order of the columns. As in any equi-join, a key with a null has no features. Features older than
    ``ttl_seconds``, to the microsecond, count as none.
    """
    null_key = reduce(lambda a, b: a | b, (col(k).isNull() for k in keys))
    keyless, entities, features = entities.where(null_key), entities.where(~null_key), features.where(~null_key)
    values = [c for c in features.columns if c not in keys and c != feature_time]
    left = entities.select(*(col(k) for k in keys), col(event_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*(col(c) for c in entities.columns)).alias("_e"), F.lit(None).cast(features.select(F.struct(F.col(feature_time).alias("_ft"), *(col(c) for c in values)).alias("s")).schema["s"].dataType).alias("_f"))
    right = features.select(*(col(k) for k in keys), col(feature_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(left.schema["_e"].dataType).alias("_e"), F.struct(col(feature_time).alias("_ft"), *(col(c) for c in values)).alias("_f"))
    w = Window.partitionBy(*(col(k) for k in keys)).orderBy("_t", "_side", F.to_json("_f") if _unordered(features, values) else "_f").rowsBetween(Window.unboundedPreceding, 0)
    found = left.unionByName(right).withColumn("_last", F.last("_f", ignorenulls=True).over(w)).where("_side = 1")
    fresh = F.lit(True) if ttl_seconds is None else _fresh(found, ttl_seconds)
    joined = found.select("_e.*", *(F.when(fresh, F.col(f"_last.`{c}`")).alias(c) for c in values))
    return joined.unionByName(keyless.select("*", *(F.lit(None).cast(features.schema[c].dataType).alias(c) for c in values)))


def _fresh(found: DataFrame, ttl_seconds: int) -> Column:
    """Whether the last features are young enough. Times without a zone are taken as they stand, whatever the session's zone."""
    kinds = {found.schema["_t"].dataType.typeName(), found.schema["_last"].dataType["_ft"].dataType.typeName()}
    if kinds <= {"timestamp_ntz", "date"}:
        return F.col("_t").cast("timestamp_ntz") - F.col("_last._ft").cast("timestamp_ntz") <= F.lit(timedelta(seconds=ttl_seconds))
    return F.unix_micros(F.col("_t").cast("timestamp")) - F.unix_micros(F.col("_last._ft").cast("timestamp")) <= ttl_seconds * 1_000_000


def _unordered(features: DataFrame, values: Sequence[str]) -> bool:
    """Whether a value's type, such as a map, has no order."""
    return any("map<" in features.schema[c].dataType.simpleString() or features.schema[c].dataType.typeName() == "variant" for c in values)
