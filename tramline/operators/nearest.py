"""Nearest-neighbour joins in time and in space, without cross joins of the large side.

Time: both sides are cut into buckets as wide as the tolerance; a left row meets the right rows of
its own and the two neighbouring buckets by equality. Space: a grid of cells as wide as the radius
does the same with nine cells.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions import geo, times

#: Dimension tables (stops, centroids, grid points) up to this many rows may be sent to all executors.
SMALL_ROWS = 100_000


def small_or_shuffled(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """df with a broadcast hint only if a count bounds it."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def asof_nearest(left: DataFrame, right: DataFrame, by: list[str], on: str, row_id: str, tolerance_s: float, values: list[str], strict: bool = False) -> DataFrame:
    """left with the values of the right row nearest in time at the same `by`, null beyond tolerance_s.

    Ties go to the earlier right row, then to the lesser values. `strict` excludes a distance of
    exactly the tolerance. row_id identifies the rows of left; null times match nothing.
    """
    bucket = lambda ts: F.floor(times.seconds(ts) / tolerance_s)
    r = right.select(*[F.col(c).alias(f"_{c}") for c in by], F.col(on).alias("_on"), *[F.col(v).alias(f"_v_{v}") for v in values])
    r = r.where(F.col("_on").isNotNull()).withColumn("_b", F.explode(F.array(*[bucket(F.col("_on")) + d for d in (-1, 0, 1)])))
    key = [F.col(c) == F.col(f"_{c}") for c in by] + [bucket(F.col(on)) == F.col("_b")]
    gap = F.abs(times.elapsed_s(F.col("_on"), F.col(on)))
    near = left.select(row_id, on, *by).join(r, key).withColumn("_gap", gap).where((F.col("_gap") < tolerance_s) if strict else (F.col("_gap") <= tolerance_s))
    best = near.groupBy(row_id).agg(F.min(F.struct("_gap", "_on", *[f"_v_{v}" for v in values])).alias("_m"))
    best = best.select(F.col(row_id).alias("_id"), F.col("_m._gap").alias("gap_s"), F.col("_m._on").alias(f"matched_{on}"), *[F.col(f"_m._v_{v}").alias(v) for v in values])
    return left.join(best, F.col(row_id) == F.col("_id"), "left").drop("_id")


def band_nearest(left: DataFrame, right: DataFrame, by: list[str], left_min: str, right_min: str, row_id: str, window_min: float, value: str) -> DataFrame:
    """left with the right row of the same `by` whose time of day is nearest around the clock, within window_min; ties to the lesser value.

    Rows meet in parts of the day at least as wide as the window. Of the right rows of a part and a
    minute only the least value can win, so the others go before they meet.
    """
    n = max(1, int(1440 // max(window_min, 1.0)))
    part = lambda m: F.floor(F.pmod(m, F.lit(1440.0)) / F.lit(1440.0 / n)).cast("int")
    least = right.groupBy(*by, right_min).agg(F.min(value).alias("_value")).where(F.col(right_min).isNotNull())
    near_by = F.array_distinct(F.array(*[F.pmod(part(F.col(right_min)) + d, F.lit(n)) for d in (-1, 0, 1)]))
    r = least.select(*[F.col(c).alias(f"_{c}") for c in by], F.col(right_min).alias("_m"), "_value", F.explode(near_by).alias("_part"))
    d = times.circular_minutes(F.col(left_min), F.col("_m"))
    keys = [F.col(c) == F.col(f"_{c}") for c in by] + [part(F.col(left_min)) == F.col("_part")]
    near = left.select(row_id, left_min, *by).join(r, keys).withColumn("_d", d).where(F.col("_d") <= window_min)
    best = near.groupBy(row_id).agg(F.min(F.struct("_d", "_value")).alias("_b")).select(F.col(row_id).alias("_id"), F.col("_b._value").alias(value), F.round("_b._d", 6).alias("delta_min"))
    return left.join(best, F.col(row_id) == F.col("_id"), "left").drop("_id")


def _cells(lat: Column, lng: Column, deg_lat: float, deg_lng: float) -> tuple[Column, Column]:
    return F.floor(lat / deg_lat), F.floor(lng / deg_lng)


def snap(points: DataFrame, stops: DataFrame, radius_m: float = 200.0, row_id: str = "id", max_abs_lat: float = 60.0) -> DataFrame:
    """points with snapped_stop_id and snap_distance_m, the nearest stop within radius_m, else null.

    Ties go to the lesser stop_id. Cells are wide enough for latitudes up to max_abs_lat.
    """
    deg_lat = radius_m / 1000 / geo.KM_PER_DEGREE * 1.01
    deg_lng = deg_lat / math.cos(math.radians(max_abs_lat))
    a, b = _cells(F.col("lat"), F.col("lng"), deg_lat, deg_lng)
    s = stops.select(F.col("stop_id").alias("_stop"), F.col("lat").alias("_lat"), F.col("lng").alias("_lng")).where(F.col("_lat").isNotNull() & F.col("_lng").isNotNull())
    x, y = _cells(F.col("_lat"), F.col("_lng"), deg_lat, deg_lng)
    around = F.array(*[F.struct((x + i).alias("x"), (y + j).alias("y")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    s = small_or_shuffled(s.withColumn("_c", F.explode(around)).select("_stop", "_lat", "_lng", "_c.x", "_c.y"))
    d = geo.haversine_m(F.col("lat"), F.col("lng"), F.col("_lat"), F.col("_lng"))
    near = points.select(row_id, "lat", "lng", a.alias("x"), b.alias("y")).join(s, ["x", "y"]).withColumn("_d", d).where(F.col("_d") <= radius_m)
    best = near.groupBy(row_id).agg(F.min(F.struct("_d", "_stop")).alias("_m")).select(F.col(row_id).alias("_id"), F.col("_m._stop").alias("snapped_stop_id"), F.col("_m._d").alias("snap_distance_m"))
    return points.join(best, F.col(row_id) == F.col("_id"), "left").drop("_id")


#: Centres that nearest_k sends to all tasks, at most: some 2 MB.
MOST_CENTRES = 50_000


def nearest_k(points: DataFrame, centres: DataFrame, k: int, point_id: str, centre_id: str, most_centres: int = MOST_CENTRES) -> DataFrame:
    """(point_id, centre_id, distance_km, rank): the k nearest centres of each point by great circle; ties to the lesser centre_id.

    centres is a stated query set of at most most_centres rows, sent to all tasks as one array; more
    raise ValueError, so that no product of two large tables arises.
    """
    usable = centres.where(F.col("lat").isNotNull() & F.col("lng").isNotNull())
    n = usable.limit(most_centres + 1).count()
    if n > most_centres:
        raise ValueError(f"more than {most_centres} centres; use snap() with a radius")
    listed = usable.groupBy().agg(F.collect_list(F.struct(F.col(centre_id).alias("c"), "lat", "lng")).alias("_all")).withColumn("_k", F.lit(1))
    held = points.where(F.col("lat").isNotNull() & F.col("lng").isNotNull()).select(point_id, "lat", "lng", F.lit(1).alias("_k")).join(F.broadcast(listed), "_k")
    d = F.transform("_all", lambda c: F.struct((geo.haversine_m(F.col("lat"), F.col("lng"), c["lat"], c["lng"]) / 1000).alias("d"), c["c"].alias("c")))
    top = held.select(point_id, F.posexplode(F.slice(F.array_sort(d), 1, k)).alias("i", "x"))
    return top.select(point_id, F.col("x.c").alias(centre_id), F.col("x.d").alias("distance_km"), (F.col("i") + 1).alias("rank"))


def idw(neighbours: DataFrame, values: DataFrame, point_id: str, centre_id: str, at: str, names: list[str], power: float = 2.0) -> DataFrame:
    """(point_id, at, names): inverse-distance means of centre values at each time; weights are renormalised over values that are not null."""
    w = 1 / F.pow(F.col("distance_km") + 1e-9, F.lit(power))
    joined = values.join(small_or_shuffled(neighbours), centre_id).withColumn("_w", w)
    mean = lambda c: F.sum(F.when(F.col(c).isNotNull(), F.col("_w") * F.col(c))) / F.sum(F.when(F.col(c).isNotNull(), F.col("_w")))
    return joined.groupBy(point_id, at).agg(*[mean(c).alias(c) for c in names])


def assign_zone(points: DataFrame, zones: DataFrame, point_id: str, zone_id: str = "zone_id", cell_deg: float = 0.02) -> DataFrame:
    """points with zone_id: the first zone (by id) whose polygon holds the point, else the one with the nearest centroid.

    zones has zone_id, polygon (or null), lat and lng. Polygons enter all grid cells of their bounding
    box, so a point meets those of its cell only; points outside all meet the centroids, of which
    nearest_k takes MOST_CENTRES.
    """
    side = lambda c: F.transform("polygon", lambda p: p[c])
    span = lambda c: F.sequence(F.floor(F.array_min(side(c)) / cell_deg), F.floor(F.array_max(side(c)) / cell_deg))
    shapes = zones.where(F.size("polygon") > 2).select(F.col(zone_id).alias("_z"), "polygon", F.explode(span("lat")).alias("_x"), F.lit(None).alias("_n"))
    shapes = shapes.select("_z", "polygon", "_x", F.explode(span("lng")).alias("_y"))
    known = points.where(F.col("lat").isNotNull() & F.col("lng").isNotNull()).select(point_id, "lat", "lng", F.floor(F.col("lat") / cell_deg).alias("_x"), F.floor(F.col("lng") / cell_deg).alias("_y"))
    inside = known.join(shapes, ["_x", "_y"]).where(geo.point_in_polygon(F.col("lat"), F.col("lng"), F.col("polygon"))).groupBy(point_id).agg(F.min("_z").alias("_z"))
    outside = known.join(inside, point_id, "left_anti")
    nearest = nearest_k(outside, zones.select(F.col(zone_id).alias("_z"), "lat", "lng"), 1, point_id, "_z").select(point_id, "_z")
    found = inside.unionByName(nearest).withColumnRenamed("_z", zone_id)
    return points.drop(zone_id).join(found, point_id, "left")


def match_edges(points: DataFrame, edges: DataFrame, radius_m: float = 50.0, row_id: str = "id", max_abs_lat: float = 60.0) -> DataFrame:
    """points with edge_id and edge_distance_m of the nearest edge (edge_id, lat1, lng1, lat2, lng2) within radius_m.

    Each edge is entered into all grid cells of its bounding box, widened by the radius.
    """
    deg = max(radius_m, 200.0) / 1000 / geo.KM_PER_DEGREE
    pad_lat = radius_m / 1000 / geo.KM_PER_DEGREE * 1.01
    pad_lng = pad_lat / math.cos(math.radians(max_abs_lat))
    span = lambda lo, hi, pad: F.sequence(F.floor((lo - pad) / deg), F.floor((hi + pad) / deg))
    e = edges.withColumn("x", F.explode(span(F.least("lat1", "lat2"), F.greatest("lat1", "lat2"), pad_lat))).withColumn("y", F.explode(span(F.least("lng1", "lng2"), F.greatest("lng1", "lng2"), pad_lng)))
    p = points.select(row_id, "lat", "lng", F.floor(F.col("lat") / deg).alias("x"), F.floor(F.col("lng") / deg).alias("y"))
    d = geo.segment_distance_m(F.col("lat"), F.col("lng"), F.col("lat1"), F.col("lng1"), F.col("lat2"), F.col("lng2"))
    near = p.join(e.select("edge_id", "lat1", "lng1", "lat2", "lng2", "x", "y"), ["x", "y"]).withColumn("_d", d).where(F.col("_d") <= radius_m)
    best = near.groupBy(row_id).agg(F.min(F.struct("_d", "edge_id")).alias("_m")).select(F.col(row_id).alias("_id"), F.col("_m.edge_id").alias("edge_id"), F.col("_m._d").alias("edge_distance_m"))
    return points.join(best, F.col(row_id) == F.col("_id"), "left").drop("_id")


def nearest_of_window(df: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """The first k rows of each key by order, numbered in `rank`."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
