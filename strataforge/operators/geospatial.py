"""Geospatial operators on columns, and the profile of locations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataforge.functions import geo as G
from strataforge.functions.columns import Columns, as_list, col, type_classes, union_all
from strataforge.sources.staging import stage

_FORMATS = ("dd", "dms", "radian", "cartesian", "geohash")


def _check(value: str, allowed: Sequence[str]) -> None:
    if value not in allowed:
        raise TypeError(f"Invalid input: {value}")


def _read(parts: Sequence[Column], fmt: str, radius: float) -> tuple[Column, Column]:
    """Latitude and longitude in degrees."""
    if fmt == "dd":
        return parts[0].cast("double"), parts[1].cast("double")
    if fmt == "dms":
        return G.from_dms(parts[0]), G.from_dms(parts[1])
    if fmt == "radian":
        return F.degrees(parts[0]), F.degrees(parts[1])
    if fmt == "cartesian":
        return G.from_cartesian(*parts, radius)
    return G.from_geohash(parts[0])


def _write(lat: Column, lon: Column, fmt: str, radius: float, precision: int) -> dict[str, Column]:
    if fmt == "dd":
        return {"_lat_dd": lat, "_lon_dd": lon}
    if fmt == "dms":
        return {"_lat_dms": G.dms(lat), "_lon_dms": G.dms(lon)}
    if fmt == "radian":
        return {"_lat_radian": F.radians(lat), "_lon_radian": F.radians(lon)}
    if fmt == "cartesian":
        return dict(zip(("_x", "_y", "_z"), G.cartesian(lat, lon, radius), strict=True))
    return {"_geohash": G.geohash(lat, lon, precision)}


def _format(df: DataFrame, groups: Sequence[Sequence[str]], input_format: str, output_format: str, result_prefix: Columns, configs: Mapping | None, output_mode: str) -> DataFrame:
    _check(input_format, _FORMATS)
    _check(output_format, _FORMATS)
    configs = {"geohash_precision": 8, "radius": G.EARTH_RADIUS, **(configs or {})}
    prefixes = as_list(result_prefix) or ["_".join(g) for g in groups]
    out = df
    for g, prefix in zip(groups, prefixes, strict=True):
        lat, lon = _read([col(c) for c in g], input_format, configs["radius"])
        made = _write(lat, lon, output_format, configs["radius"], configs["geohash_precision"])
        out = out.withColumns({prefix + k: v for k, v in made.items()})
    return out.drop(*(c for g in groups for c in g)) if output_mode == "replace" else out


def geo_format_latlon(df: DataFrame, list_of_lat: Columns, list_of_lon: Columns, input_format: str, output_format: str, result_prefix: Columns = (), optional_configs: Mapping | None = None, output_mode: str = "append") -> DataFrame:
    groups = list(zip(as_list(list_of_lat), as_list(list_of_lon), strict=True))
    return _format(df, groups, input_format, output_format, result_prefix, optional_configs, output_mode)


def geo_format_cartesian(df: DataFrame, list_of_x: Columns, list_of_y: Columns, list_of_z: Columns, output_format: str, result_prefix: Columns = (), optional_configs: Mapping | None = None, output_mode: str = "append") -> DataFrame:
    groups = list(zip(as_list(list_of_x), as_list(list_of_y), as_list(list_of_z), strict=True))
    return _format(df, groups, "cartesian", output_format, result_prefix, optional_configs, output_mode)


def geo_format_geohash(df: DataFrame, list_of_geohash: Columns, output_format: str, result_prefix: Columns = (), optional_configs: Mapping | None = None, output_mode: str = "append") -> DataFrame:
    return _format(df, [(c,) for c in as_list(list_of_geohash)], "geohash", output_format, result_prefix, optional_configs, output_mode)


def location_distance(df: DataFrame, list_of_cols_loc1: Columns, list_of_cols_loc2: Columns, loc_format: str = "dd", result_prefix: str = "", distance_type: str = "haversine", unit: str = "m", optional_configs: Mapping | None = None, output_mode: str = "append") -> DataFrame:
    """The distance between two locations in metres or kilometres."""
    _check(loc_format, _FORMATS)
    _check(distance_type, ("haversine", "vincenty", "euclidean"))
    _check(unit, ("m", "km"))
    configs = {"radius": G.EARTH_RADIUS, "vincenty_model": "WGS-84", **(optional_configs or {})}
    first, second = as_list(list_of_cols_loc1), as_list(list_of_cols_loc2)
    points = [_read([col(c) for c in names], loc_format, configs["radius"]) for names in (first, second)]
    if distance_type == "vincenty":
        d = G.vincenty(*points[0], *points[1], configs["vincenty_model"])
    else:
        d = (G.haversine if distance_type == "haversine" else G.euclidean)(*points[0], *points[1], configs["radius"])
    name = result_prefix + "_distance" if result_prefix else "_".join([*first, *second]) + "_distance"
    out = df.withColumn(name, d / 1000 if unit == "km" else d)
    return out.drop(*first, *second) if output_mode == "replace" else out


#: The largest error in kilometres of a geohash of 1, 2, ... characters.
GEOHASH_ERROR_KM = (2500, 630, 78, 20, 2.4, 0.61, 0.076, 0.019, 0.0024, 0.0006, 0.000074)


def geohash_precision_control(df: DataFrame, list_of_geohash: Columns, output_precision: int = 8, km_max_error: float | None = None, output_mode: str = "append") -> DataFrame:
    """Cut to ``output_precision`` characters, or to the fewest whose error is not over ``km_max_error``."""
    if km_max_error is not None:
        output_precision = next((i + 1 for i, e in enumerate(GEOHASH_ERROR_KM) if km_max_error >= e), 12)
    names = as_list(list_of_geohash)
    suffix = "" if output_mode == "replace" else f"_precision_{int(output_precision)}"
    return df.withColumns({c + suffix: F.substring(col(c), 1, int(output_precision)) for c in names})


def location_in_polygon(df: DataFrame, list_of_lat: Columns, list_of_lon: Columns, polygon: Mapping, result_prefix: Columns = (), output_mode: str = "append") -> DataFrame:
    rings = G.polygons_of(polygon)
    test = lambda a, b: reduce(lambda x, y: x | y, (G.in_polygon(a, b, r) for r in rings))
    return _mark(df, list_of_lat, list_of_lon, test, "_in_poly", result_prefix, output_mode)


def location_in_country(df: DataFrame, list_of_lat: Columns, list_of_lon: Columns, country: str, boxes: Mapping[str, tuple[float, float, float, float]] | None = None, country_shapefile_path: str = "", method_type: str = "approx", result_prefix: Columns = (), output_mode: str = "append") -> DataFrame:
    """``approx``: inside the country's box of ``boxes`` (ISO code: west, south, east, north); ``exact``: inside its polygon in a GeoJSON file
    whose features name it by an ISO code or name."""
    _check(method_type, ("approx", "exact"))
    if method_type == "approx":
        if not boxes or country.upper() not in boxes:
            raise TypeError("Invalid input for country")
        return _mark(df, list_of_lat, list_of_lon, lambda a, b: G.in_box(a, b, boxes[country.upper()]), f"_in_{country}_approx", result_prefix, output_mode)
    import json

    text = df.sparkSession.read.text(country_shapefile_path, wholetext=True).first()[0]
    features = [f for f in json.loads(text)["features"] if country.lower() in {str(v).lower() for v in f["properties"].values()}]
    if not features:
        raise TypeError("Invalid input for country")
    rings = [r for f in features for r in G.polygons_of(f)]
    return _mark(df, list_of_lat, list_of_lon, lambda a, b: reduce(lambda x, y: x | y, (G.in_polygon(a, b, r) for r in rings)), f"_in_{country}_exact", result_prefix, output_mode)


def _mark(df: DataFrame, lats: Columns, lons: Columns, test, suffix: str, result_prefix: Columns, output_mode: str) -> DataFrame:
    pairs = list(zip(as_list(lats), as_list(lons), strict=True))
    prefixes = as_list(result_prefix) or [f"{a}_{b}" for a, b in pairs]
    out = df.withColumns({p + suffix: F.when(test(col(a).cast("double"), col(b).cast("double")), 1).otherwise(0) for (a, b), p in zip(pairs, prefixes, strict=True)})
    return out.drop(*(c for p in pairs for c in p)) if output_mode == "replace" else out


def _valid(df: DataFrame, lat: str, lon: str) -> DataFrame:
    return df.where(col(lat).between(-90, 90) & col(lon).between(-180, 180))


def _sums(df: DataFrame, lat: str, lon: str, keys: Sequence[str]) -> DataFrame:
    x, y, z = G.cartesian(col(lat).cast("double"), col(lon).cast("double"), 1.0)
    return _valid(df, lat, lon).groupBy(*(col(k) for k in keys)).agg(F.sum(x).alias("_x"), F.sum(y).alias("_y"), F.sum(z).alias("_z"), F.count(F.lit(1)).alias("_n"))


def _middle(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    return F.degrees(F.atan2(z, F.sqrt(x * x + y * y))), F.degrees(F.atan2(y, x))


def centroid(df: DataFrame, lat_col: str, long_col: str, id_col: str | None = None) -> DataFrame:
    """The spherical centroid, overall or per id; rows outside the ranges are left out."""
    keys = as_list(id_col)
    lat, lon = _middle(F.col("_x"), F.col("_y"), F.col("_z"))
    return _sums(df, lat_col, long_col, keys).select(*(col(k) for k in keys), lat.alias(f"{lat_col}_centroid"), lon.alias(f"{long_col}_centroid"))


def weighted_centroid(df: DataFrame, id_col: str, lat_col: str, long_col: str) -> DataFrame:
    """Every id with one centroid: that of the ids' centroids, each weighted by its rows."""
    per = _sums(df, lat_col, long_col, [id_col])
    mean = per.agg(*(F.sum(c).alias(c) for c in ("_x", "_y", "_z")))
    lat, lon = _middle(F.col("_x"), F.col("_y"), F.col("_z"))
    return per.select(col(id_col)).join(F.broadcast(mean)).select(col(id_col), lat.alias(f"{lat_col}_weighted_centroid"), lon.alias(f"{long_col}_weighted_centroid"))


def rog_calculation(df: DataFrame, lat_col: str, long_col: str, id_col: str | None = None) -> DataFrame:
    """Radius of gyration: the mean distance from the centroid in metres, overall or per id."""
    keys = as_list(id_col)
    middle = centroid(df, lat_col, long_col, id_col).withColumnsRenamed({f"{lat_col}_centroid": "_la", f"{long_col}_centroid": "_lo"})
    rows = _valid(df, lat_col, long_col)
    both = rows.join(middle, keys) if keys else rows.join(F.broadcast(middle))
    d = G.haversine(col(lat_col).cast("double"), col(long_col).cast("double"), F.col("_la"), F.col("_lo"), G.GYRATION_RADIUS)
    return both.groupBy(*(col(k) for k in keys)).agg(F.avg(d).alias("radius_of_gyration"))


#: Widths of grid cells in degrees, each a part of 360; the last holds the globe.
WIDTHS = (1.0, 5.0, 20.0, 60.0, 360.0)


def reverse_geocoding(df: DataFrame, lat_col: str, long_col: str, gazetteer: DataFrame, precision: int = 3) -> DataFrame:
    """The nearest place of ``gazetteer`` (latitude, longitude, name_of_place, region, country_code) for every row; ties by name.

    Places are filed under grid cells, which go round the globe. A point looks into its own cell and those around it; where the
    nearest place there is farther than a place outside might be, the point goes on to cells of the next width. ``precision``
    (1 to 3) sets only the first width, 20, 5 or 1 degrees, and with it the work, not the result.
    """
    first = {1: 20.0, 2: 5.0, 3: 1.0}.get(precision, 1.0)
    g = gazetteer.select(F.col("latitude").cast("double").alias("_ga"), F.col("longitude").cast("double").alias("_go"), "name_of_place", "region", "country_code")
    left = _valid(df, lat_col, long_col).select(col(lat_col).cast("double").alias(lat_col), col(long_col).cast("double").alias(long_col)).distinct()
    d = G.haversine(col(lat_col), col(long_col), F.col("_ga"), F.col("_go"))
    settled = []
    for width in (w for w in WIDTHS if w >= first):
        round_ = int(360 / width)
        cell = lambda a, b, width=width, round_=round_: (F.floor((a + 90) / width).cast("int"), F.pmod(F.floor((b + 180) / width).cast("int"), F.lit(round_)))
        steps = sorted({j % round_: j for j in (0, 1, -1)}.values())
        around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in steps))
        a, b = cell(col(lat_col), col(long_col))
        near = left.select("*", F.inline(around)).select(lat_col, long_col, (a + F.col("i")).alias("_ca"), F.pmod(b + F.col("j"), F.lit(round_)).alias("_co"))
        places = g.withColumns(dict(zip(("_ca", "_co"), cell(F.col("_ga"), F.col("_go")), strict=True)))
        found = near.join(places, ["_ca", "_co"]).groupBy(lat_col, long_col).agg(F.min(F.struct(d.alias("d"), "name_of_place", "region", "country_code")).alias("p"))
        if width == WIDTHS[-1]:
            settled.append(found)
            break
        # Whatever is in none of these cells is over one width away, north, south, or along a circle of latitude.
        sure = stage(found.where(F.col("p.d") <= 0.99 * width * 111_000 * F.cos(F.radians(F.least(F.abs(col(lat_col)) + width, F.lit(90.0))))), "settled")
        settled.append(sure)
        left = stage(left.join(sure.select(lat_col, long_col), [lat_col, long_col], "left_anti"), "unsettled")
    return union_all(settled).select(lat_col, long_col, "p.name_of_place", "p.region", "p.country_code")


# Detection and profile


def detect_locations(df: DataFrame) -> tuple[list[str], list[str], list[str]]:
    """Names of latitude, longitude and geohash columns: by name, by the spread of fractional numbers, by texts that decode.
    Unequal numbers of latitudes and longitudes count as none. One aggregation over all rows."""
    kinds = dict(df.dtypes)
    floats = [c for c, t in kinds.items() if t in ("double", "float") or t.startswith("decimal")]
    texts = type_classes(df)[1]
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(floats):
        v = col(c).cast("double")
        aggs += [F.max(F.abs(v)).alias(f"f{i}m"), F.stddev_samp(v).alias(f"f{i}s"), F.avg(v).alias(f"f{i}a"), F.max((v != F.floor(v)).cast("int")).alias(f"f{i}p"), F.min(F.abs(v) <= 90).alias(f"f{i}l")]
    for i, c in enumerate(texts):
        lat, _ = G.from_geohash(col(c))
        aggs += [F.max(F.length(col(c))).alias(f"t{i}n"), F.approx_count_distinct(lat).alias(f"t{i}d"), F.count_if(col(c).isNotNull() & lat.isNull()).alias(f"t{i}b")]
    row = df.agg(*aggs).first()
    lats, lons = [], []
    for i, c in enumerate(floats):
        name = c.lower()
        if "latitude" in name:
            lats.append(c)
        elif "longitude" in name:
            lons.append(c)
        elif row[f"f{i}p"] and row[f"f{i}m"] <= 180 and (row[f"f{i}s"] or 0) >= 1 and row[f"f{i}a"] and row[f"f{i}s"] / abs(row[f"f{i}a"]) < 1:
            (lats if row[f"f{i}l"] else lons).append(c)
    hashes = [c for i, c in enumerate(texts) if row[f"t{i}n"] and 5 <= row[f"t{i}n"] <= 11 and row[f"t{i}d"] > 2 and not row[f"t{i}b"]]
    return (lats, lons, hashes) if len(lats) == len(lons) else ([], [], hashes)


def location_stats(df: DataFrame, lat_col: str | None = None, long_col: str | None = None, geohash_col: str | None = None, id_col: str | None = None, max_val: int = 100) -> tuple[DataFrame, DataFrame]:
    """A summary (stats, count) and the ``max_val`` locations with the most ids (ties by location)."""
    if geohash_col:
        key = col(geohash_col)
        summary = df.agg(F.count_distinct(key).cast("string").alias("Total number of Distinct Geohashes"), F.max(F.length(key)).cast("string").alias("The Precision level observed for the Geohashes"))
    else:
        key = F.concat_ws(",", col(lat_col), col(long_col))
        summary = df.agg(F.count_distinct(F.struct(col(lat_col), col(long_col))).cast("string").alias("Distinct {Lat, Long} Pair"), F.count_distinct(col(lat_col)).cast("string").alias("Distinct Latitude"), F.count_distinct(col(long_col)).cast("string").alias("Distinct Longitude"))
    rows = summary.select(F.inline(F.array(*(F.struct(F.lit(c).alias("stats"), F.col(f"`{c}`").alias("count")) for c in summary.columns))))
    ids = F.count_distinct(col(id_col)) if id_col else F.count(F.lit(1))
    top = df.where(key.isNotNull()).groupBy(key.alias("location")).agg(ids.alias("count_id"), F.count(F.lit(1)).alias("count_records")).orderBy(F.desc("count_id"), "location").limit(max_val)
    return rows, top


def cluster_analysis(df: DataFrame, lat_col: str, long_col: str, max_cluster: int = 20, eps: float = 0.3, min_samples: int = 500, max_records: int = 100_000, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(latitude, longitude, cluster) by k-means, fitted on and given for all valid rows, with the number of clusters at the
    elbow of the cost; and by density, of a sample of at most ``max_records`` rows. ``eps`` in degrees."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    rows = _valid(df, lat_col, long_col).select(col(lat_col).cast("double").alias(lat_col), col(long_col).cast("double").alias(long_col)).cache()
    n = rows.count()
    part = (rows.sample(False, min(1.0, max_records / n), seed) if n > max_records else rows).cache()
    v = VectorAssembler(inputCols=[lat_col, long_col], outputCol="_v").transform(rows)
    models = {k: KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster").fit(v) for k in range(2, max(3, max_cluster + 1))}
    ks = sorted(models)
    cost = [models[k].summary.trainingCost for k in ks]
    span = [(c - cost[-1]) / ((cost[0] - cost[-1]) or 1) + (k - ks[0]) / ((ks[-1] - ks[0]) or 1) for k, c in zip(ks, cost, strict=True)]
    best = ks[span.index(min(span))]
    points = part.toPandas()
    points["cluster"] = _density(points.to_numpy(float), eps, min_samples)
    return models[best].transform(v).drop("_v"), df.sparkSession.createDataFrame(points, f"`{lat_col}` double, `{long_col}` double, cluster long")


def cluster_all(df: DataFrame, lat_cols: Sequence[str] = (), long_cols: Sequence[str] = (), geohash_cols: Sequence[str] = (), max_cluster: int = 20, eps: float = 0.3, min_samples: int = 500, max_records: int = 100_000) -> dict[str, tuple[DataFrame, DataFrame]]:
    """``cluster_analysis`` of every pair of location columns and every geohash column (by its cell's middle), by name."""
    if len(lat_cols) != len(long_cols):
        raise TypeError("there must be as many latitudes as longitudes")
    found = {f"{a}_{b}": cluster_analysis(df, a, b, max_cluster, eps, min_samples, max_records) for a, b in zip(lat_cols, long_cols, strict=True)}
    for c in geohash_cols:
        lat, lon = G.from_geohash(col(c))
        found[c] = cluster_analysis(df.select(lat.alias("latitude"), lon.alias("longitude")), "latitude", "longitude", max_cluster, eps, min_samples, max_records)
    return found


def _density(x, eps: float, min_samples: int):
    """DBSCAN over a grid of cells of size ``eps``; -1 is noise."""
    from collections import defaultdict, deque

    import numpy as np

    cells = defaultdict(list)
    for i, key in enumerate(map(tuple, np.floor(x / eps).astype(int))):
        cells[key].append(i)
    near = lambda i: np.array([j for a in (-1, 0, 1) for b in (-1, 0, 1) for j in cells.get((int(np.floor(x[i, 0] / eps)) + a, int(np.floor(x[i, 1] / eps)) + b), ())])
    label, now = np.full(len(x), -2), -1
    for i in range(len(x)):
        if label[i] != -2:
            continue
        n = near(i)
        n = n[((x[n] - x[i]) ** 2).sum(1) <= eps * eps]
        if len(n) < min_samples:
            label[i] = -1
            continue
        now += 1
        label[i] = now
        queue = deque(n)
        while queue:
            j = queue.popleft()
            if label[j] == -1:
                label[j] = now
            if label[j] != -2:
                continue
            label[j] = now
            m = near(j)
            m = m[((x[m] - x[j]) ** 2).sum(1) <= eps * eps]
            if len(m) >= min_samples:
                queue.extend(m)
    return label


def geospatial_profile(df: DataFrame, id_col: str, top_geo_records: int = 100) -> dict[str, tuple[DataFrame, DataFrame]]:
    """``location_stats`` of every location column that is found."""
    lats, lons, hashes = detect_locations(df)
    out = {f"{a}_{b}": location_stats(df, a, b, None, id_col, top_geo_records) for a, b in zip(lats, lons, strict=True)}
    return out | {c: location_stats(df, None, None, c, id_col, top_geo_records) for c in hashes}


__all__ = [n for n in dir() if not n.startswith("_") and n != "union_all"]
