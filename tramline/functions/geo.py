"""Geographic column expressions: WGS84 degrees in, metres, kilometres or degrees out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
KM_PER_DEGREE = 111.32


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column, radius: float = EARTH_RADIUS_M) -> Column:
    """Great-circle distance in metres; null if any coordinate is."""
    dlat, dlng = F.radians(lat2 - lat1) / 2, F.radians(lng2 - lng1) / 2
    h = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlng) * F.sin(dlng)
    return 2 * radius * F.asin(F.sqrt(F.when(h > 1, 1.0).otherwise(h)))


def equirectangular_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Planar distance in kilometres with longitudes scaled at the mean latitude."""
    x = (lng2 - lng1) * F.cos(F.radians((lat1 + lat2) / 2))
    return KM_PER_DEGREE * F.sqrt((lat2 - lat1) * (lat2 - lat1) + x * x)


def bearing_deg(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Initial bearing, 0 to 360 degrees from north."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lng2 - lng1)
    y = F.sin(d) * F.cos(b)
    x = F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def km_to_lat_deg(km: Column) -> Column:
    return km / KM_PER_DEGREE


def km_to_lng_deg(km: Column, lat: Column) -> Column:
    return km / (KM_PER_DEGREE * F.cos(F.radians(lat)))


def grid_cell(lat: Column, lng: Column, cell_m: float, lat0: float = 0.0, lng0: float = 0.0) -> tuple[Column, Column]:
    """(row, column) of a square grid with its origin at (lat0, lng0), truncated towards zero."""
    row = (lat - lat0) * (KM_PER_DEGREE * 1000 / cell_m)
    col = (lng - lng0) * F.cos(F.radians(F.lit(lat0))) * (KM_PER_DEGREE * 1000 / cell_m)
    return row.cast("int"), col.cast("int")


def utm_zone(lng: Column) -> Column:
    return (F.floor((lng + 180) / 6) + 1).cast("int")


def utm_epsg(lat: Column, lng: Column) -> Column:
    return utm_zone(lng) + F.when(lat >= 0, 32600).otherwise(32700)


def circle(lat: Column, lng: Column, radius_m: Column, points: int = 16) -> Column:
    """Polygon of `points` corners around a centre, as array<struct<lat, lng>>."""
    return arc(lat, lng, radius_m, F.lit(0.0), F.lit(360.0 * (points - 1) / points), points)


def arc(lat: Column, lng: Column, radius_m: Column, start_deg: Column, end_deg: Column, points: int) -> Column:
    """`points` positions on a circle from one bearing to another."""
    def at(i: Column) -> Column:
        angle = F.radians(start_deg + (end_deg - start_deg) * i / max(1, points - 1))
        dlat = km_to_lat_deg(radius_m / 1000) * F.cos(angle)
        dlng = km_to_lng_deg(radius_m / 1000, lat) * F.sin(angle)
        return F.struct((lat + dlat).alias("lat"), (lng + dlng).alias("lng"))

    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), at)


def sector(lat: Column, lng: Column, azimuth_deg: Column, beamwidth_deg: Column, radius_m: Column, arc_points: int = 12) -> Column:
    """Wedge of an antenna: its place, then the arc."""
    centre = F.array(F.struct(lat.alias("lat"), lng.alias("lng")))
    return F.concat(centre, arc(lat, lng, radius_m, azimuth_deg - beamwidth_deg / 2, azimuth_deg + beamwidth_deg / 2, arc_points))


def point_in_polygon(lat: Column, lng: Column, polygon: Column) -> Column:
    """Ray casting: whether a point is inside a polygon given as array<struct<lat, lng>>, closed or not.

    Of a box the upper latitude and the lesser longitude belong to it, the other two sides don't.
    """
    def crosses(p: Column, i: Column) -> Column:
        q = F.element_at(polygon, F.when(i == 0, F.size(polygon)).otherwise(i))
        meets = (lat > p["lat"]) != (lat > q["lat"])
        edge = (q["lng"] - p["lng"]) * (lat - p["lat"]) / F.nullif(q["lat"] - p["lat"], F.lit(0.0)) + p["lng"]
        return meets & (lng < edge)

    return F.size(F.filter(polygon, crosses)) % 2 == 1


def segment_distance_m(lat: Column, lng: Column, lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Distance in metres from a point to a line segment, in a plane around the point."""
    m = KM_PER_DEGREE * 1000
    k = m * F.cos(F.radians(lat))
    ax, ay, bx, by = (lng1 - lng) * k, (lat1 - lat) * m, (lng2 - lng) * k, (lat2 - lat) * m
    dx, dy = bx - ax, by - ay
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(-(ax * dx + ay * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))))
    x, y = ax + t * dx, ay + t * dy
    return F.sqrt(x * x + y * y)


def polygon_area_m2(polygon: Column) -> Column:
    """Shoelace area of array<struct<lat, lng>>, in a plane at its first corner's latitude."""
    first = F.get(polygon, 0)
    m = KM_PER_DEGREE * 1000
    k = m * F.cos(F.radians(first["lat"]))

    def term(p: Column, i: Column) -> Column:
        q = F.element_at(polygon, F.when(i == F.size(polygon) - 1, 1).otherwise(i + 2))
        return (p["lng"] - first["lng"]) * k * (q["lat"] - first["lat"]) * m - (q["lng"] - first["lng"]) * k * (p["lat"] - first["lat"]) * m

    return F.abs(F.aggregate(F.transform(polygon, term), F.lit(0.0), lambda a, x: a + x)) / 2


def polygon_perimeter_m(polygon: Column) -> Column:
    """Length of the closed outline."""
    def side(p: Column, i: Column) -> Column:
        q = F.element_at(polygon, F.when(i == F.size(polygon) - 1, 1).otherwise(i + 2))
        return haversine_m(p["lat"], p["lng"], q["lat"], q["lng"])

    return F.aggregate(F.transform(polygon, side), F.lit(0.0), lambda a, x: a + x)
