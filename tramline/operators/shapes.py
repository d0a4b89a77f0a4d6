"""Hexagonal cells, polygons cut by lines, and lines cut by cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.functions import geo
from tramline.functions.seqs import let
from tramline.operators.quantiles import exact_quantiles

#: Areas in km2 of the hexagons of each resolution (fixed values).
HEX_KM2 = {6: 36.129, 7: 5.161, 8: 0.737, 9: 0.105}


def hex_resolution(area_km2: float, cells: int = 7500) -> int:
    """The resolution whose hexagons come nearest to dividing an area into so many cells; the coarser on a tie."""
    return min(sorted(HEX_KM2), key=lambda r: abs(HEX_KM2[r] - area_km2 / cells))


def _side_km(resolution: int) -> float:
    return math.sqrt(2 * HEX_KM2[resolution] / (3 * math.sqrt(3)))


def hex_cell(lat: Column, lng: Column, resolution: int = 8, lat0: float = 0.0) -> Column:
    """struct<q, r>: axial coordinates of the hexagon (point upwards) that holds a place; null for null coordinates.

    Cells lie in a plane of equal degrees, right at latitude lat0. Only the nearest of the hexagons'
    centres holds a place: coordinates are rounded as a cube, the one furthest off following from the others.
    """
    s = _side_km(resolution)
    x, y = lng * (geo.KM_PER_DEGREE * math.cos(math.radians(lat0))), lat * geo.KM_PER_DEGREE
    q, r = (x * (math.sqrt(3) / 3) - y / 3) / s, y * (2 / 3) / s
    near = lambda v: F.floor(v + 0.5)

    def rounded(c: Column) -> Column:
        q, r = c["q"], c["r"]
        a, b, t = near(q), near(r), near(-q - r)
        dq, dr, dt = F.abs(a - q), F.abs(b - r), F.abs(t + q + r)
        cell = F.when((dq > dr) & (dq > dt), F.struct((-b - t).alias("q"), b.alias("r"))).when(dr > dt, F.struct(a.alias("q"), (-a - t).alias("r"))).otherwise(F.struct(a.alias("q"), b.alias("r")))
        return cell

    return F.when(lat.isNotNull() & lng.isNotNull(), let(F.struct(q.alias("q"), r.alias("r")), rounded))


def hex_polygon(cell: Column, resolution: int = 8, lat0: float = 0.0) -> Column:
    """The six corners of a hexagon as array<struct<lat, lng>>."""
    s = _side_km(resolution)
    cx, cy = (cell["q"] + cell["r"] / 2.0) * (math.sqrt(3) * s), cell["r"] * (1.5 * s)
    k = geo.KM_PER_DEGREE * math.cos(math.radians(lat0))
    corner = lambda i: F.struct(((cy + s * math.sin(math.radians(60 * i - 30))) / geo.KM_PER_DEGREE).alias("lat"), ((cx + s * math.cos(math.radians(60 * i - 30))) / k).alias("lng"))
    return F.array(*map(corner, range(6)))


def clip(polygon: Column, line: Column, left: bool = True) -> Column:
    """The part of a convex polygon to the left (or right) of a line struct<lat1, lng1, lat2, lng2>, extended; empty if there is none."""
    sign = 1.0 if left else -1.0
    side = lambda p: sign * ((line["lng2"] - line["lng1"]) * (p["lat"] - line["lat1"]) - (line["lat2"] - line["lat1"]) * (p["lng"] - line["lng1"]))
    place = lambda lat, lng: F.struct(lat.alias("lat"), lng.alias("lng"))

    def edge(p: Column, i: Column) -> Column:
        q = F.element_at(polygon, F.when(i == F.size(polygon) - 1, 1).otherwise(i + 2))
        a, b = side(p), side(q)
        t = a / F.nullif(a - b, F.lit(0.0))
        meet = F.when(((a > 0) & (b < 0)) | ((a < 0) & (b > 0)), place(p["lat"] + (q["lat"] - p["lat"]) * t, p["lng"] + (q["lng"] - p["lng"]) * t))
        return F.array_compact(F.array(F.when(a >= 0, place(p["lat"], p["lng"])), meet))

    return let(F.flatten(F.transform(polygon, edge)), lambda c: F.when(F.size(c) > 2, c).otherwise(F.slice(c, 1, 0)))


def crosses(polygon: Column, line: Column) -> Column:
    """Whether a line segment struct<lat1, lng1, lat2, lng2> meets a polygon: an end lies in it, or it cuts a side."""
    turn = lambda ax, ay, bx, by, cx, cy: (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)

    def cuts(p: Column, i: Column) -> Column:
        q = F.element_at(polygon, F.when(i == F.size(polygon) - 1, 1).otherwise(i + 2))
        a = turn(p["lng"], p["lat"], q["lng"], q["lat"], line["lng1"], line["lat1"])
        b = turn(p["lng"], p["lat"], q["lng"], q["lat"], line["lng2"], line["lat2"])
        c = turn(line["lng1"], line["lat1"], line["lng2"], line["lat2"], p["lng"], p["lat"])
        d = turn(line["lng1"], line["lat1"], line["lng2"], line["lat2"], q["lng"], q["lat"])
        return (a * b <= 0) & (c * d <= 0)

    return geo.point_in_polygon(line["lat1"], line["lng1"], polygon) | F.exists(F.transform(polygon, cuts), lambda x: x)


def zone_barriers(zones: DataFrame, barriers: DataFrame, zone_id: str = "zone_id", cell_deg: float = 0.02) -> DataFrame:
    """(zone_id, edge_id, line): pairs of a zone (zone_id, polygon) and a barrier (edge_id, lat1, lng1, lat2, lng2) that meet, found through grid cells of their bounding boxes."""
    cells = lambda lo, hi: F.sequence(F.floor(lo / cell_deg), F.floor(hi / cell_deg))
    side = lambda c: F.transform("polygon", lambda p: p[c])
    z = zones.where(F.size("polygon") > 2).select(zone_id, "polygon", F.explode(cells(F.array_min(side("lat")), F.array_max(side("lat")))).alias("_x"))
    z = z.select(zone_id, "polygon", "_x", F.explode(cells(F.array_min(side("lng")), F.array_max(side("lng")))).alias("_y"))
    line = F.struct("lat1", "lng1", "lat2", "lng2").alias("line")
    b = barriers.select("edge_id", line, F.explode(cells(F.least("lat1", "lat2"), F.greatest("lat1", "lat2"))).alias("_x"))
    b = b.select("edge_id", "line", "_x", F.explode(cells(F.least("line.lng1", "line.lng2"), F.greatest("line.lng1", "line.lng2"))).alias("_y"))
    return z.join(b, ["_x", "_y"]).where(crosses(F.col("polygon"), F.col("line"))).select(zone_id, "edge_id", "line").distinct()


def split_zones(zones: DataFrame, barriers: DataFrame, zone_id: str = "zone_id", sliver: float = 0.05) -> DataFrame:
    """zones cut along the barriers that meet them: part, split, polygon and area_km2.

    A barrier cuts a convex zone along its whole extension. Parts number from 0 within a zone; those
    under `sliver` times the median area of the zones go.
    """
    lines = zone_barriers(zones, barriers, zone_id).groupBy(zone_id).agg(F.transform(F.array_sort(F.collect_list(F.struct("edge_id", "line"))), lambda x: x["line"]).alias("_lines"))
    area = lambda p: geo.polygon_area_m2(p) / 1e6
    median = (exact_quantiles(zones.select(area(F.col("polygon")).alias("a")), "a", [0.5]) or [0.0])[0]
    both = lambda parts, line: F.filter(F.flatten(F.transform(parts, lambda p: F.array(clip(p, line, True), clip(p, line, False)))), lambda p: F.size(p) > 2)
    joined = zones.join(lines, zone_id, "left")
    shape = F.transform("polygon", lambda p: F.struct(p["lat"].cast("double").alias("lat"), p["lng"].cast("double").alias("lng")))
    parts = F.when(F.col("_lines").isNull(), F.array(shape)).otherwise(F.aggregate("_lines", F.array(shape), both))
    out = joined.withColumn("split", F.col("_lines").isNotNull()).select(*[c for c in zones.columns if c != "polygon"], "split", F.posexplode(parts).alias("part", "polygon"))
    return out.withColumn("area_km2", area(F.col("polygon"))).where(F.col("area_km2") > median * sliver)


def cut_by_cells(lines: DataFrame, cell_deg: float) -> DataFrame:
    """lines (lat1, lng1, lat2, lng2 and others) in pieces by grid cell: row, col and km, exact for lines that are straight in degrees."""
    def meets(a: str, b: str) -> Column:
        lo, hi = F.least(a, b), F.greatest(a, b)
        first, last = F.floor(lo / cell_deg) + 1, F.ceil(hi / cell_deg) - 1
        steps = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(steps, lambda k: (k * cell_deg - F.col(a)) / (F.col(b) - F.col(a)))

    shares = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), meets("lat1", "lat2"), meets("lng1", "lng2"))))
    spans = lambda t: F.transform(F.slice(t, 1, F.size(t) - 1), lambda x, i: F.struct(x.alias("a"), F.get(t, i + 1).alias("b")))
    km = geo.haversine_m(F.col("lat1"), F.col("lng1"), F.col("lat2"), F.col("lng2")) / 1000
    each = lines.withColumns({"_km": km, "_t": F.explode(let(shares, spans))})
    middle = (F.col("_t.a") + F.col("_t.b")) / 2
    at = lambda a, b: F.floor((F.col(a) + (F.col(b) - F.col(a)) * middle) / cell_deg)
    return each.withColumns({"row": at("lat1", "lat2"), "col": at("lng1", "lng2"), "km": F.col("_km") * (F.col("_t.b") - F.col("_t.a"))}).drop("_km", "_t")
