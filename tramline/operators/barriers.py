"""Barriers and networks beside zones: permeability, sides, building and road features of cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.functions import geo
from tramline.operators.shapes import cut_by_cells

#: Weights of features that let people cross a corridor (fixed values).
PERMEABLE = {"bridge": 1.0, "tunnel": 1.0, "footbridge": 0.5, "crossing": 0.2}


def permeability_features(tags: DataFrame) -> DataFrame:
    """A row for each kind of passage that a feature (id, bridge, tunnel, footbridge, crossing flags, lat, lng) is, with its weight."""
    kinds = F.array(*[F.when(F.coalesce(F.col(k), F.lit(False)), F.struct(F.lit(k).alias("kind"), F.lit(w).alias("weight"))) for k, w in PERMEABLE.items() if k in tags.columns])
    return tags.withColumn("_k", F.explode(F.array_compact(kinds))).select("id", "lat", "lng", "_k.kind", "_k.weight")


def near_edges(points: DataFrame, edges: DataFrame, within_m: float, point_id: str = "id", max_abs_lat: float = 60.0) -> DataFrame:
    """(point_id, edge_id, distance_m): all pairs of a point and an edge (edge_id, lat1, lng1, lat2, lng2) within a distance, met through grid cells."""
    deg = max(within_m, 200.0) / 1000 / geo.KM_PER_DEGREE
    pad = within_m / 1000 / geo.KM_PER_DEGREE * 1.01
    wide = pad / math.cos(math.radians(max_abs_lat))
    span = lambda a, b, p: F.sequence(F.floor((F.least(a, b) - p) / deg), F.floor((F.greatest(a, b) + p) / deg))
    e = edges.select("edge_id", "lat1", "lng1", "lat2", "lng2", F.explode(span("lat1", "lat2", pad)).alias("x"))
    e = e.withColumn("y", F.explode(span("lng1", "lng2", wide)))
    p = points.select(point_id, "lat", "lng", F.floor(F.col("lat") / deg).alias("x"), F.floor(F.col("lng") / deg).alias("y"))
    d = geo.segment_distance_m(F.col("lat"), F.col("lng"), F.col("lat1"), F.col("lng1"), F.col("lat2"), F.col("lng2"))
    return p.join(e, ["x", "y"]).select(point_id, "edge_id", d.alias("distance_m")).where(F.col("distance_m") <= within_m)


def corridor_permeability(features: DataFrame, corridors: DataFrame, within_m: float = 20.0) -> DataFrame:
    """Each corridor with the weights of its passages over its length in km, 0 where it has none."""
    found = near_edges(features, corridors, within_m).join(features.select("id", "weight"), "id").groupBy("edge_id").agg(F.sum("weight").alias("_w"))
    km = geo.haversine_m(F.col("lat1"), F.col("lng1"), F.col("lat2"), F.col("lng2")) / 1000
    return corridors.join(found, "edge_id", "left").withColumn("length_km", km).withColumn("permeability", F.coalesce("_w", F.lit(0.0)) / F.nullif(F.col("length_km"), F.lit(0.0))).drop("_w")


def tag_barriers(cells: DataFrame, barriers: DataFrame, within_m: float = 20.0, cell_id: str = "cell") -> DataFrame:
    """cells with barrier: the nearest barrier within a distance of the centre, the lesser id on a tie, else null."""
    best = near_edges(cells, barriers, within_m, cell_id).groupBy(cell_id).agg(F.min(F.struct("distance_m", "edge_id")).alias("_m"))
    return cells.join(best, cell_id, "left").withColumn("barrier", F.col("_m.edge_id")).drop("_m")


def side_of_line(lat: Column, lng: Column, lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """1 to the left of the line from its first to its second end, -1 to the right, 0 on it."""
    return F.signum((lng2 - lng1) * (lat - lat1) - (lat2 - lat1) * (lng - lng1)).cast("int")


def to_cells(points: DataFrame, cell_deg: float) -> DataFrame:
    """points with row and col of a grid in degrees."""
    return points.withColumns({"row": F.floor(F.col("lat") / cell_deg), "col": F.floor(F.col("lng") / cell_deg)})


def building_proxies(cells: DataFrame, buildings: DataFrame, cell_deg: float, m2_per_person: float = 30.0) -> DataFrame:
    """cells (row, col) with buildings' number, area, mean levels (1 where none) and people."""
    people = F.col("area_m2") * F.col("levels") / m2_per_person
    found = to_cells(buildings, cell_deg).groupBy("row", "col").agg(F.count(F.lit(1)).alias("n_buildings"), F.sum("area_m2").alias("building_area_m2"), F.avg("levels").alias("mean_levels"), F.sum(people).alias("population"))
    out = cells.join(found, ["row", "col"], "left")
    return out.fillna(0, ["n_buildings", "building_area_m2", "population"]).fillna(1.0, ["mean_levels"])


def road_lengths(edges: DataFrame, cell_deg: float, classes: list[str]) -> DataFrame:
    """(row, col, km_<class>): road length by class and cell, each edge cut where it leaves a cell."""
    wide = cut_by_cells(edges, cell_deg).groupBy("row", "col").pivot("road_class", classes).agg(F.sum("km")).fillna(0.0, classes)
    return wide.select("row", "col", *[F.col(f"`{c}`").alias(f"km_{c}") for c in classes])


def road_population(row_km: list[Column], weights: list[float], area_km2: Column, per_km: float = 400.0, low: float = 100.0, high: float = 50_000.0) -> Column:
    """People from weighted road length where buildings are unknown: per_km a kilometre, density within bounds."""
    total = sum((k * w for k, w in zip(row_km, weights)), F.lit(0.0)) * per_km
    return F.greatest(F.lit(low), F.least(F.lit(high), total / F.nullif(area_km2, F.lit(0.0)))) * area_km2
