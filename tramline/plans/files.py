"""Queries that write files to the shared folder and read them back, and of what reads and keeps them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tramline.functions import geo
from tramline.operators import generations, trajectory
from tramline.operators.storage import shared_folder
from tramline.plans import inputs as i
from tramline.plans.bus import rounded
from tramline.plans.catalogue import query
from tramline.sources import readers, writers
from tramline.sources.readers import table


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


@query("parquet_by_status", "SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice FROM orders")
def parquet_by_status(spark, sf):
    """Orders in folders by status, read as one table."""
    at = _folder(spark)
    writers.write_table(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), at, ["o_orderstatus"])
    return rounded(spark.read.parquet(at), 2)


@query("vehicle_buckets", "SELECT user_id, count(*) AS n, 1 AS n_files FROM events GROUP BY 1")
def vehicle_buckets(spark, sf):
    """Each vehicle's pings are in one file of its bucket."""
    at = _folder(spark)
    writers.write_buckets(table(spark, sf, "events").select("event_id", "user_id"), at, "user_id", 8)
    found = spark.read.parquet(at).withColumn("f", F.input_file_name())
    return found.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("f").cast("int").alias("n_files"))


@query("nations_json", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def nations_json(spark, sf):
    at = _folder(spark)
    writers.write_json(table(spark, sf, "nation").select("n_nationkey", "n_name"), at)
    return spark.read.json(at).select("n_nationkey", "n_name")


@query("stops_csv", f"WITH {i.STOPS} SELECT stop_id, 'stop ' || stop_id AS stop_name, round(lat, 6) AS lat, round(lng, 6) AS lng FROM stops WHERE lat BETWEEN 18.9 AND 19.2")
def stops_csv(spark, sf):
    """Stops written as CSV and read within bounds."""
    at = _folder(spark)
    s = i.stops(spark).select("stop_id", F.concat(F.lit("stop "), F.col("stop_id")).alias("stop_name"), "lat", "lng", F.lit("Morning").alias("stop_category"))
    writers.write_csv(s, at)
    return rounded(readers.read_stops(spark, at, (18.9, 19.2)).select("stop_id", "stop_name", "lat", "lng"), 6)


@query("zones_csv", f"WITH {i.ZONES} SELECT zone_id::VARCHAR AS zone_id, round(lat, 6) AS lat, population::BIGINT AS population FROM zones")
def zones_csv(spark, sf):
    at = _folder(spark)
    box = {"lat_min": F.col("lat") - 0.01, "lat_max": F.col("lat") + 0.01, "lng_min": F.col("lng") - 0.01, "lng_max": F.col("lng") + 0.01}
    z = i.zones(spark, sf).withColumns(box).select("zone_id", "lat", "lng", *box, F.col("population").cast("long").alias("population"))
    writers.write_csv(z, at)
    return rounded(readers.read_zones(spark, at).select("zone_id", "lat", "population"), 6)


@query("towers_csv", f"WITH {i.STOPS} SELECT stop_id::VARCHAR AS cell_id, round(lat, 6) AS lat, 14 AS n_corners FROM stops")
def towers_csv(spark, sf):
    """Towers written as CSV, read, and drawn as sectors: the tower, twelve places on the arc, and back."""
    at = _folder(spark)
    s = i.stops(spark).select(F.col("stop_id").alias("cell_id"), "lat", "lng", (F.col("stop_id") * 9.0).alias("azimuth_deg"), F.lit(120.0).alias("beamwidth_deg"), F.lit(500.0).alias("radius_m"))
    writers.write_csv(s, at)
    t = readers.read_towers(spark, at)
    wedge = geo.sector(F.col("lat"), F.col("lng"), F.col("azimuth_deg"), F.col("beamwidth_deg"), F.col("radius_m"))
    return rounded(t.select("cell_id", "lat", (F.size(wedge) + 1).alias("n_corners")), 6)


@query("stop_times_csv", "SELECT l_orderkey::VARCHAR AS trip_id, l_linenumber AS stop_sequence, round(1380.0 + l_linenumber * 30, 4) AS arrival_min, round(1381.0 + l_linenumber * 30, 4) AS departure_min FROM lineitem")
def stop_times_csv(spark, sf):
    """Schedule times past midnight, written as clocks beyond 24 hours."""
    at = _folder(spark)
    m = 1380 + F.col("l_linenumber") * 30
    clock = lambda x: F.format_string("%02d:%02d:00", F.floor(x / 60), (x % 60).cast("long"))
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("trip_id"), clock(m).alias("arrival_time"), clock(m + 1).alias("departure_time"), F.lit("s").alias("stop_id"), F.col("l_linenumber").alias("stop_sequence"))
    writers.write_csv(li, at)
    return rounded(readers.read_gtfs_stop_times(spark, at).select("trip_id", "stop_sequence", "arrival_min", "departure_min"))


@query("geojson_places", f"WITH {i.STOPS} SELECT stop_id::BIGINT AS stop_id, round(lat, 6) AS lat, round(lng, 6) AS lng FROM stops")
def geojson_places(spark, sf):
    """Points written as one feature collection and read back."""
    at = _folder(spark)
    one = writers.feature(writers.point_geometry(F.col("lat"), F.col("lng")), ["stop_id"])
    features = i.stops(spark).select(one.alias("f")).agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.sort_array(F.collect_list("f")), ","), F.lit("]}")).alias("value"))
    features.coalesce(1).write.text(at)
    return rounded(readers.read_geojson_points(spark, at).select("stop_id", "lat", "lng"), 6)


@query("geojson_outlines", f"WITH {i.ZONES} SELECT zone_id::BIGINT AS zone_id, 'Polygon' AS kind, 4 AS n_corners, round(lng, 6) AS first_lng FROM zones")
def geojson_outlines(spark, sf):
    """Triangles as features, a line each: closed outlines."""
    at = _folder(spark)
    corner = lambda a, b: F.struct((F.col("lat") + a).alias("lat"), (F.col("lng") + b).alias("lng"))
    ring = F.array(corner(0.0, 0.0), corner(0.01, 0.0), corner(0.01, 0.01))
    writers.write_features(i.zones(spark, sf), writers.polygon_geometry(ring), ["zone_id"], at)
    g = spark.read.json(at).select("properties.zone_id", "geometry.type", "geometry.coordinates")
    return rounded(g.select("zone_id", F.col("type").alias("kind"), F.size(F.get("coordinates", F.lit(0))).alias("n_corners"), F.get(F.get(F.get("coordinates", F.lit(0)), F.lit(0)), F.lit(0)).alias("first_lng")), 6)


@query("pending_jobs", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber > 3)")
def pending_jobs(spark, sf):
    done = table(spark, sf, "lineitem").where("l_linenumber > 3").select(F.col("l_orderkey").alias("o_orderkey"))
    return readers.pending(table(spark, sf, "orders").select("o_orderkey"), done, "o_orderkey")


@query("fuse_schedule", f"WITH {i.PINGS}, e AS (SELECT vehicle_id, ts + to_seconds(id % 90) AS ts, lat + 0.0001::DOUBLE AS lat, lng FROM pings WHERE event_type = 'click'), x AS (SELECT p.id, e.ts, e.lat, e.lng FROM pings p JOIN e USING (vehicle_id) WHERE abs(epoch_us(e.ts) - epoch_us(p.ts)) <= 60000000 AND {i.HAVERSINE.format('p.lat', 'p.lng', 'e.lat', 'e.lng')} <= 50), b AS (SELECT id, arg_min(lat, (ts, lat, lng)) AS lat, arg_min(lng, (ts, lat, lng)) AS lng FROM x GROUP BY 1) SELECT p.id, round(CASE WHEN b.id IS NULL THEN p.lat ELSE 0.7 * p.lat + 0.3 * b.lat END, 8) AS lat, round(CASE WHEN b.id IS NULL THEN p.lng ELSE 0.7 * p.lng + 0.3 * b.lng END, 8) AS lng, CASE WHEN b.id IS NULL THEN 'gps' ELSE 'gps+schedule' END AS source FROM pings p LEFT JOIN b ON b.id = p.id")
def fuse_schedule(spark, sf):
    """Pings drawn towards schedule events that stand up to 90 seconds after a click."""
    p = i.pings(spark, sf).select(F.col("vehicle_id").alias("trip_id"), "id", "ts", "lat", "lng", "event_type")
    later = F.timestamp_add("SECOND", F.col("id") % 90, F.col("ts"))
    e = p.where("event_type = 'click'").select("trip_id", later.alias("ts"), (F.col("lat") + 0.0001).alias("lat"), "lng")
    return rounded(trajectory.fuse_schedule(p.drop("event_type"), e).select("id", "lat", "lng", "source"), 8)


@query("match_confidences", "SELECT event_id, round(greatest(0.5, 1 - (event_id % 60) / 50.0), 6) AS confidence FROM events")
def match_confidences(spark, sf):
    return rounded(table(spark, sf, "events").select("event_id", trajectory.match_confidence((F.col("event_id") % 60).cast("double")).alias("confidence")), 6)


@query("places_of_folders", "SELECT n_nationkey, array_to_string(list_transform(string_split(lower(n_name), '_'), lambda w: upper(w[1]) || w[2:]), ', ') AS place FROM nation")
def places_of_folders(spark, sf):
    n = table(spark, sf, "nation")
    return n.select("n_nationkey", generations.place_of_folder(F.lower("n_name")).alias("place"))


_GENERATIONS = "g AS (SELECT s_suppkey AS generation_id, s_nationkey AS city FROM supplier), z AS (SELECT p_partkey AS zone, p_partkey % 40 + 1 AS generation_id FROM part)"


@query("zones_of_cities", f"WITH {_GENERATIONS} SELECT zone, z.generation_id, city, n_name FROM z JOIN g USING (generation_id) JOIN nation ON n_nationkey = city WHERE z.generation_id <> 7")
def zones_of_cities(spark, sf):
    """Zones with their generation and city, one generation removed."""
    g = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("generation_id"), F.col("s_nationkey").alias("city"))
    z = table(spark, sf, "part").select(F.col("p_partkey").alias("zone"), (F.col("p_partkey") % 40 + 1).alias("generation_id"))
    left = generations.remove({"zones": z, "generations": g}, 7)
    city = table(spark, sf, "nation").select(F.col("n_nationkey").alias("city"), "n_name")
    return generations.zones_with_city(left["zones"], left["generations"], city).select("zone", "generation_id", "city", "n_name")
