"""Queries of zones, skims, trajectories and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tramline.functions import geo, times
from tramline.operators import features, trajectory, zones
from tramline.plans import inputs as i
from tramline.plans.bus import rounded
from tramline.plans.catalogue import query
from tramline.sources.readers import table
from tramline.streaming import windows

_SKIM = i.ZONES + ", sk AS (SELECT o.zone_id AS origin, d.zone_id AS destination, " + i.HAVERSINE.format("o.lat", "o.lng", "d.lat", "d.lng") + " / 1000 AS distance_km FROM zones o, zones d)"
_TIME = "distance_km / greatest(12.0, 45.0 * (1 - exp(-distance_km / 5.0))) * 60"


@query("skim_long", f"WITH {_SKIM} SELECT origin, destination, round(distance_km, 6) AS distance_km FROM sk")
def skim_long(spark, sf):
    return rounded(zones.skim(i.zones(spark, sf)), 6)


@query("travel_cost", f"WITH {_SKIM} SELECT origin, destination, round({_TIME}, 6) AS minutes, round({_TIME} * 0.5 + distance_km * 0.1, 6) AS cost FROM sk")
def travel_cost(spark, sf):
    s = zones.skim(i.zones(spark, sf)).withColumn("minutes", zones.travel_time_min(F.col("distance_km")))
    return rounded(s.select("origin", "destination", "minutes", zones.generalized_cost(F.col("minutes"), F.col("distance_km")).alias("cost")), 6)


@query("routing_connectivity", f"WITH {_SKIM} SELECT count(*) FILTER (distance_km >= 9) AS n_unreachable, count(*) AS n_pairs, (SELECT count(DISTINCT z) FROM (SELECT unnest([origin, destination]) AS z FROM sk WHERE distance_km >= 9)) AS n_zones_involved, count(*) FILTER (distance_km >= 9) = 0 AS is_connected FROM sk")
def routing_connectivity(spark, sf):
    return zones.routing_connectivity(zones.skim(i.zones(spark, sf)), 9.0)


@query("validate_zones", f"WITH {i.ZONES} SELECT count(*) AS n_zones, count(*) FILTER (NOT population BETWEEN 1100 AND 1800) AS n_bad_population, count(*) FILTER (NOT area_km2 BETWEEN 2.0 AND 4.0) AS n_bad_area, round(stddev_samp(population) / avg(population), 6) AS population_cv, round(avg(4 * pi() * area_km2 / (area_km2 * 8 * area_km2 * 8)), 6) AS mean_compactness, false AS is_valid FROM zones")
def validate_zones(spark, sf):
    z = i.zones(spark, sf).withColumn("perimeter_km", F.col("area_km2") * 8)
    return rounded(zones.validate_zones(z, (1100, 1800), (2.0, 4.0), 0.5), 6)


@query("zone_summary", f"WITH {i.ZONES} SELECT district AS zone, count(*) AS n_cells, sum(population) AS population, round(avg(area_km2), 6) AS mean_employment, mode(CASE WHEN zone_id % 3 = 0 THEN 'residential' ELSE 'commercial' END) AS land_use, bool_or(zone_id = 7) AS is_special FROM zones GROUP BY district")
def zone_summary(spark, sf):
    z = i.zones(spark, sf).select(F.col("district").alias("zone"), "population", F.col("area_km2").alias("employment"), F.when(F.col("zone_id") % 3 == 0, "residential").otherwise("commercial").alias("land_use"), (F.col("zone_id") == 7).alias("is_special"))
    return rounded(zones.zone_summary(z), 6)


_TYPES = ["click", "error", "purchase", "signup", "view"]


def _profile(spark, sf):
    pois = table(spark, sf, "events").select((F.col("user_id") % 20).alias("cell"), F.col("event_type").alias("poi_type"))
    return zones.poi_profile(pois, ["cell"], _TYPES, {"purchase": 3.0, "view": 0.5})


@query("poi_profile", "WITH c AS (SELECT user_id % 20 AS cell, " + ", ".join(f"count(*) FILTER (event_type = '{t}') AS poi_{t}" for t in _TYPES) + ", count(*) AS n FROM events GROUP BY 1) SELECT cell, " + ", ".join(f"poi_{t}" for t in _TYPES) + ", n AS total_pois, poi_click + poi_error + 3.0::DOUBLE * poi_purchase + poi_signup + 0.5::DOUBLE * poi_view AS intensity, round(" + " + ".join(f"CASE WHEN poi_{t} > 0 THEN -(poi_{t} / n) * ln(poi_{t} / n) ELSE 0 END" for t in _TYPES) + ", 6) AS poi_entropy FROM c")
def poi_profile(spark, sf):
    return rounded(_profile(spark, sf), 6)


@query("robust_z", "WITH c AS (SELECT user_id % 20 AS cell, count(*) AS n FROM events GROUP BY 1), q AS (SELECT quantile_cont(n, 0.25) AS a, median(n) AS m, quantile_cont(n, 0.75) AS b FROM c) SELECT cell, round(greatest(-5.0, least(5.0, (n - m) / (b - a))), 6) AS z FROM c, q")
def robust_z(spark, sf):
    return rounded(zones.robust_z(_profile(spark, sf).select("cell", "total_pois"), "total_pois", "z").select("cell", "z"), 6)


@query("land_use", f"WITH {i.ZONES} SELECT zone_id, CASE WHEN area_km2 * 700 >= 2000 THEN 'commercial' WHEN area_km2 * 700 >= 1600 AND population >= 1000 THEN 'mixed' WHEN population >= 1000 THEN 'residential' WHEN population > 0 THEN 'low_density' ELSE 'vacant' END AS land_use FROM zones")
def land_use(spark, sf):
    return i.zones(spark, sf).select("zone_id", zones.land_use(F.col("area_km2") * 700, F.col("population"), mixed=1600.0).alias("land_use"))


@query("weighted_centroids", f"WITH {i.ZONES} SELECT district, round(sum(lat * population) / sum(population), 7) AS lat, round(sum(lng * population) / sum(population), 7) AS lng FROM zones GROUP BY 1")
def weighted_centroids(spark, sf):
    return rounded(zones.weighted_centroids(i.zones(spark, sf), "district", "population"), 7)


_EDGES = "e AS (SELECT p_partkey AS a, p_partkey // 40 * 40 + (p_partkey * 7 + 3) % 40 AS b, 1.0::DOUBLE + p_partkey % 5 AS cost FROM part WHERE p_partkey % 40 < 25)"


def _edges(spark, sf):
    """Streets of towns of forty places; the roles leave some places without a street of their own."""
    k = F.col("p_partkey")
    return table(spark, sf, "part").where("p_partkey % 40 < 25").select(k.alias("a"), (F.floor(k / 40) * 40 + (k * 7 + 3) % 40).alias("b"), (1.0 + k % 5).alias("cost"))


_SQUARE = "{1} AS (SELECT x.origin, y.node, min(x.cost + y.cost) AS cost FROM {0} x JOIN {0} y ON y.origin = x.node GROUP BY ALL)"
_STEPS = ", ".join(_SQUARE.format(f"d{n}", f"d{n + 1}") for n in range(6))


@query("network_skim", f"WITH {_EDGES}, d0 AS (SELECT origin, node, min(cost) AS cost FROM (SELECT a AS origin, b AS node, cost FROM e UNION ALL SELECT b, a, cost FROM e UNION ALL SELECT a, a, 0.0 FROM e UNION ALL SELECT b, b, 0.0 FROM e) GROUP BY ALL), {_STEPS} SELECT origin, node, cost FROM d6 WHERE origin IN (SELECT a FROM e)")
def network_skim(spark, sf):
    e = _edges(spark, sf)
    return zones.shortest_paths(e, e.select("a"))


@query("connected_components", f"WITH RECURSIVE {_EDGES}, s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(node, other) AS (SELECT p_partkey, p_partkey FROM part UNION SELECT r.node, s.b FROM r JOIN s ON s.a = r.other) SELECT node, min(other) AS component FROM r GROUP BY node")
def connected_components(spark, sf):
    return zones.connected(_edges(spark, sf), table(spark, sf, "part").select("p_partkey"), "p_partkey")


@query("region_merge")
def region_merge(spark, sf):
    """Nations grown into zones within their districts."""
    z = zones.z_scores(i.zones(spark, sf), ["population", "area_km2"]).select("district", F.col("zone_id").alias("cell"), "population", F.col("area_km2").alias("employment"), (F.col("zone_id") % 2).alias("barrier"), "z_population", "z_area_km2")
    cells = i.zones(spark, sf).select("district", "zone_id")
    e = cells.join(cells.select("district", F.col("zone_id").alias("b")), "district").where("zone_id < b").select("district", F.col("zone_id").alias("a"), "b")
    return zones.grow_regions(z, e, "district", 3000.0)


@query("convex_hull")
def convex_hull(spark, sf):
    """Hulls of the places of each kind of event."""
    return zones.hulls(i.pings(spark, sf), "event_type").select("event_type", "n_points", F.size("hull").alias("n_corners"), F.round(geo.polygon_area_m2(F.col("hull")), 0).alias("area_m2"))


@query("neighbour_cells", "WITH c AS (SELECT DISTINCT floor(user_id % 40 / 4)::INT AS row, floor(event_id % 30 / 3)::INT AS col FROM events) SELECT a.row, a.col, b.row AS row2, b.col AS col2 FROM c a JOIN c b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1")
def neighbour_cells(spark, sf):
    c = table(spark, sf, "events").select(F.floor(F.col("user_id") % 40 / 4).cast("int").alias("row"), F.floor(F.col("event_id") % 30 / 3).cast("int").alias("col")).distinct()
    return zones.neighbours(c)


def _track(spark, sf):
    return i.pings(spark, sf).withColumnRenamed("vehicle_id", "trip_id").select("trip_id", "id", "ts", "lat", "lng")


@query("smooth_traj", f"WITH {i.PINGS} SELECT id, round(avg(lat) OVER w, 10) AS lat, round(avg(lng) OVER w, 10) AS lng FROM pings WINDOW w AS (PARTITION BY vehicle_id ORDER BY ts, id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
def smooth_traj(spark, sf):
    return rounded(trajectory.smooth(_track(spark, sf)).select("id", "lat", "lng"), 10)


_SPEED = i.HAVERSINE.format("lag(lat) OVER w", "lag(lng) OVER w", "lat", "lng")


@query("point_speeds", f"WITH {i.PINGS} SELECT id, round(coalesce({_SPEED} / ((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1000000.0), 0), 6) AS speed_mps FROM pings WINDOW w AS (PARTITION BY vehicle_id ORDER BY ts, id)")
def point_speeds(spark, sf):
    return rounded(trajectory.speeds(_track(spark, sf)).select("id", "speed_mps"), 6)


_LEADS = i.PINGS + ", x AS (SELECT *, lead(ts) OVER w AS nts, lead(lat) OVER w AS nlat, lead(lng) OVER w AS nlng, (epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 1000000.0 AS gap FROM pings WINDOW w AS (PARTITION BY vehicle_id ORDER BY ts, id))"


@query("resample", f"WITH {_LEADS}, n AS (SELECT *, greatest(0, coalesce(CASE WHEN gap <= 7200 THEN floor(gap / 600)::INT - 1 END, 0)) AS k FROM x), s AS (SELECT *, unnest(range(k + 1)) AS step FROM n) SELECT id, step::INT AS step, ts + to_microseconds((step * 600000000)::BIGINT) AS ts, round(CASE WHEN step = 0 THEN lat ELSE lat + (nlat - lat) * (step / (k + 1)) END, 10) AS lat, round(CASE WHEN step = 0 THEN lng ELSE lng + (nlng - lng) * (step / (k + 1)) END, 10) AS lng FROM s")
def resample(spark, sf):
    return rounded(trajectory.resample(_track(spark, sf), 600.0, max_gap_s=7200.0).select("id", "step", "ts", "lat", "lng"), 10)


@query("gps_gaps", f"WITH {_LEADS} SELECT id, round(gap, 9) AS gap_s, nts AS gap_end FROM x WHERE gap > 50000")
def gps_gaps(spark, sf):
    return rounded(trajectory.gaps(_track(spark, sf), 10000.0).select("id", "gap_s", "gap_end"), 9)


_LENGTH = i.HAVERSINE.format("lag(lat) OVER w", "lag(lng) OVER w", "lat", "lng")


@query("route_length", f"WITH {i.PINGS}, d AS (SELECT vehicle_id AS trip_id, {_LENGTH} AS m FROM pings WINDOW w AS (PARTITION BY vehicle_id ORDER BY ts, id)) SELECT trip_id, round(sum(m), 3) AS length_m, count(*) AS n_points FROM d GROUP BY 1")
def route_length(spark, sf):
    return rounded(trajectory.route_length_m(_track(spark, sf)), 3)


_TRUTH = i.PINGS + """, truth AS (SELECT vehicle_id AS trip_id, id, ts, lat, lng FROM pings),
found AS (SELECT vehicle_id AS trip_id, 'a' AS algorithm, ts + INTERVAL 2 SECOND AS ts, lat + 0.0002 * (id % 5) AS lat, lng AS lng, 0.8 AS confidence FROM pings WHERE id % 4 <> 0
  UNION ALL SELECT vehicle_id, 'b', ts + INTERVAL 3 SECOND, lat, lng + 0.0005 * (id % 3), 0.6 FROM pings),
pairs AS (SELECT t.id, f.algorithm, abs(epoch_us(t.ts) - epoch_us(f.ts)) / 1000000.0 AS g, f.ts AS fts, """ + i.HAVERSINE.format("t.lat", "t.lng", "f.lat", "f.lng") + """ AS e, f.lat AS flat, f.lng AS flng, confidence FROM truth t JOIN found f USING (trip_id) WHERE abs(epoch_us(t.ts) - epoch_us(f.ts)) / 1000000.0 < 5),
best AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY id, algorithm ORDER BY g, fts, flat, flng, confidence) = 1),
acc AS (SELECT algorithm, (SELECT count(*) FROM truth) AS n_truth, count(*) AS n_matched, sqrt(avg(e * e)) AS rmse_m, avg(e) AS mae_m, max(e) AS max_m, quantile_cont(e, 0.95) AS p95_m, avg(g) AS temporal_mae_s, avg(confidence) AS mean_confidence, count(*) / (SELECT count(*) FROM truth) AS coverage FROM best GROUP BY 1)"""


def _accuracy(spark, sf):
    p = _track(spark, sf)
    moved = lambda s: F.timestamp_add("SECOND", F.lit(s), F.col("ts")).alias("ts")
    a = p.where("id % 4 <> 0").select("trip_id", F.lit("a").alias("algorithm"), moved(2), (F.col("lat") + 0.0002 * (F.col("id") % 5)).alias("lat"), "lng", F.lit(0.8).alias("confidence"))
    b = p.select("trip_id", F.lit("b").alias("algorithm"), moved(3), "lat", (F.col("lng") + 0.0005 * (F.col("id") % 3)).alias("lng"), F.lit(0.6).alias("confidence"))
    return trajectory.accuracy(p, a.unionByName(b))


@query("fusion_metrics", f"WITH {_TRUTH} SELECT algorithm, n_truth, n_matched, round(rmse_m, 5) AS rmse_m, round(mae_m, 5) AS mae_m, round(max_m, 5) AS max_m, round(p95_m, 5) AS p95_m, round(temporal_mae_s, 5) AS temporal_mae_s, round(mean_confidence, 5) AS mean_confidence, round(coverage, 5) AS coverage, round(0.40 * exp(-rmse_m / 50) + 0.25 * coverage + 0.20 * mean_confidence + 0.15, 5) AS quality FROM acc")
def fusion_metrics(spark, sf):
    return rounded(_accuracy(spark, sf), 5)


@query("rank_algorithms", f"WITH {_TRUTH} SELECT algorithm, rank() OVER (ORDER BY rmse_m)::DOUBLE AS rank_rmse_m, rank() OVER (ORDER BY coverage DESC)::DOUBLE AS rank_coverage, (rank() OVER (ORDER BY rmse_m) + rank() OVER (ORDER BY coverage DESC)) / 2.0 AS mean_rank FROM acc")
def rank_algorithms(spark, sf):
    return trajectory.rank_algorithms(_accuracy(spark, sf), ["rmse_m"], ["coverage"]).select("algorithm", "rank_rmse_m", "rank_coverage", "mean_rank")


@query("average_rank", "WITH x AS (SELECT o_orderkey, o_custkey % 13 AS v FROM orders) SELECT o_orderkey, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r FROM x")
def average_rank(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 13).alias("v"))
    return features.average_rank(o, "v", "r").select("o_orderkey", "r")


@query("gtfs_times", "SELECT o_orderkey, o_orderdate + to_microseconds((o_orderkey % 30 * 3600 + o_orderkey % 60 * 60)::BIGINT * 1000000) AS ts FROM orders")
def gtfs_times(spark, sf):
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", F.format_string("%02d:%02d:00", k % 30, k % 60).alias("arrival_time"))
    return trajectory.schedule_times(o, F.col("o_orderdate")).select("o_orderkey", "ts")


_NEAR = i.HAVERSINE.format("t.lat", "t.lng", "o.lat", "o.lng")


@query("tower_positions", f"WITH {i.STOPS}, p AS (SELECT t.stop_id, o.lat, o.lng, CASE WHEN t.stop_id = o.stop_id THEN 1.0 ELSE 0.5 END AS w FROM stops t JOIN stops o ON {_NEAR} <= 6000), x AS (SELECT stop_id, sum(w * lat) / sum(w) AS lat, sum(w * lng) / sum(w) AS lng, least(0.6, 0.3 + 0.1 * count(*)) AS confidence FROM p GROUP BY 1) SELECT event_id, round(lat, 7) AS lat, round(lng, 7) AS lng, round(confidence, 7) AS confidence FROM events JOIN x ON x.stop_id = event_id % 40")
def tower_positions(spark, sf):
    towers = i.stops(spark).withColumnRenamed("stop_id", "tower_id")
    e = table(spark, sf, "events").select("event_id", (F.col("event_id") % 40).cast("int").alias("tower_id"))
    return rounded(trajectory.tower_positions(e, towers, 6.0).select("event_id", "lat", "lng", "confidence"), 7)


@query("gps_track", f"WITH {_LEADS}, n AS (SELECT vehicle_id, greatest(0, coalesce(CASE WHEN gap <= 7200 THEN floor(gap / 600)::INT - 1 END, 0)) AS k FROM x) SELECT vehicle_id AS trip_id, (count(*) + sum(k))::BIGINT AS n_points, sum(k)::BIGINT AS n_interpolated, round(sum(k) / (count(*) + sum(k)), 6) AS interpolated_share FROM n GROUP BY 1")
def gps_track(spark, sf):
    return rounded(trajectory.source_shares(trajectory.gps_track(_track(spark, sf), 600.0, 7200.0)), 6)


@query("schedule_track", "WITH e AS (SELECT o_custkey, o_orderkey AS id, o_orderdate + to_seconds(o_orderkey % 7000) AS a, o_orderkey % 900 AS w FROM orders), s AS (SELECT o_custkey, a AS ts FROM e UNION ALL SELECT o_custkey, a + to_seconds(w) FROM e WHERE w > 0) SELECT o_custkey AS trip_id, count(*) AS n_events, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY 1")
def schedule_track(spark, sf):
    k = F.col("o_orderkey")
    later = lambda s, t: F.timestamp_add("SECOND", s, t)
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("trip_id"), k.alias("id"), later(k % 7000, F.col("o_orderdate")).alias("arrival_ts"), (F.lit(18.9) + k % 40 * 0.01).alias("lat"), (F.lit(72.8) + k % 30 * 0.01).alias("lng"), (k % 900).alias("w"))
    track = trajectory.schedule_track(o.withColumn("departure_ts", later(F.col("w"), F.col("arrival_ts"))).drop("w"), 864000.0)
    return track.where("step = 0").groupBy("trip_id").agg(F.count(F.lit(1)).alias("n_events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("tower_track")
def tower_track(spark, sf):
    """Places of tower events drawn along the direction of travel."""
    towers = i.stops(spark).withColumnRenamed("stop_id", "tower_id")
    e = _track(spark, sf).select("trip_id", "id", "ts", (F.col("id") % 40).cast("int").alias("tower_id"))
    placed = trajectory.tower_positions(e, towers, 6.0).join(towers.select("tower_id", F.col("lat").alias("tower_lat"), F.col("lng").alias("tower_lng")), "tower_id").withColumn("radius_m", F.lit(500.0))
    return rounded(trajectory.tower_track(placed).select("id", "lat", "lng", "confidence"), 6)


@query("stream_tumbling", "SELECT time_bucket(INTERVAL '6 hours', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, sf):
    s = windows.with_clock(windows.stream_table(spark, sf, "events"))
    out = windows.run_to_table(windows.tumbling(s, "6 hours", ["event_type"], [F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")]))
    return rounded(out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total"))


@query("stream_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > 12 * 3600000000 OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), k AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM k GROUP BY user_id, k.n")
def stream_sessions(spark, sf):
    s = windows.with_clock(windows.stream_table(spark, sf, "events"))
    out = windows.run_to_table(windows.sessions(s, "12 hours", ["user_id"], [F.count(F.lit(1)).alias("n")]))
    return out.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n")


@query("time_labels", "SELECT event_id, CASE dayofweek(ts) WHEN 6 THEN 'SATURDAY' WHEN 0 THEN 'SUNDAY' ELSE 'WEEKDAY' END AS day_type, (ts - INTERVAL 3 HOUR)::DATE AS effective_day, hour(ts) >= 20 OR hour(ts) < 7 AS home_time, hour(ts) >= 7 AND hour(ts) < 20 AS work_time FROM events")
def time_labels(spark, sf):
    t = F.col("ts")
    return table(spark, sf, "events").select("event_id", times.day_type(t).alias("day_type"), times.effective_day(t).alias("effective_day"), times.in_hours(t, 20, 7).alias("home_time"), times.in_hours(t, 7, 20).alias("work_time"))


_LINES = "lines AS (SELECT k AS edge_id, 18.9::DOUBLE + k * 0.02::DOUBLE AS lat FROM range(20) t(k))"


def _lines(spark):
    k = F.col("id")
    lat = F.lit(18.9) + k * F.lit(0.02)
    return spark.range(20).select(k.alias("edge_id"), lat.alias("lat1"), F.lit(72.7).alias("lng1"), lat.alias("lat2"), F.lit(73.2).alias("lng2"))


@query("near_edges", f"WITH {i.PINGS}, {_LINES} SELECT id, edge_id, round(abs(pings.lat - lines.lat) * 111320.0::DOUBLE, 4) AS distance_m FROM pings JOIN lines ON abs(pings.lat - lines.lat) * 111320.0::DOUBLE <= 500")
def near_edges(spark, sf):
    from tramline.operators import barriers

    return rounded(barriers.near_edges(i.pings(spark, sf), _lines(spark), 500.0))


@query("tag_barriers", f"WITH {i.PINGS}, {_LINES}, x AS (SELECT id, edge_id, abs(pings.lat - lines.lat) * 111320.0::DOUBLE AS d FROM pings JOIN lines ON abs(pings.lat - lines.lat) * 111320.0::DOUBLE <= 300) SELECT pings.id AS cell, arg_min(edge_id, (d, edge_id)) AS barrier FROM pings LEFT JOIN x USING (id) GROUP BY 1")
def tag_barriers(spark, sf):
    from tramline.operators import barriers

    return barriers.tag_barriers(i.pings(spark, sf).withColumnRenamed("id", "cell"), _lines(spark), 300.0).select("cell", "barrier")


@query("building_proxies", f"WITH {i.PINGS}, b AS (SELECT floor(lat / 0.05::DOUBLE)::BIGINT AS row, floor(lng / 0.05::DOUBLE)::BIGINT AS col, speed AS area, stop_id % 4 + 1 AS lv FROM pings), c AS (SELECT DISTINCT row, col + d AS col FROM b, (VALUES (0), (1)) v(d)), f AS (SELECT row, col, count(*) AS n, sum(area) AS a, avg(lv) AS l, sum(area * lv / 30.0) AS p FROM b GROUP BY ALL) SELECT row, col, coalesce(n, 0) AS n_buildings, round(coalesce(a, 0), 4) AS building_area_m2, round(coalesce(l, 1), 4) AS mean_levels, round(coalesce(p, 0), 4) AS population FROM c LEFT JOIN f USING (row, col)")
def building_proxies(spark, sf):
    from tramline.operators import barriers

    b = i.pings(spark, sf).select("lat", "lng", F.col("speed").alias("area_m2"), (F.col("stop_id") % 4 + 1).alias("levels"))
    c = barriers.to_cells(b, 0.05).select("row", F.explode(F.array(F.col("col"), F.col("col") + 1)).alias("col")).distinct()
    return rounded(barriers.building_proxies(c, b, 0.05))


@query("road_lengths", f"WITH e AS (SELECT p_partkey AS e, CASE p_partkey % 2 WHEN 0 THEN 'primary' ELSE 'local' END AS c, 18.9::DOUBLE + p_partkey % 20 * 0.01::DOUBLE AS lat1, 72.8::DOUBLE + p_partkey % 30 * 0.01::DOUBLE AS lng1, 18.9::DOUBLE + p_partkey % 21 * 0.01::DOUBLE AS lat2, 72.8::DOUBLE + p_partkey % 31 * 0.01::DOUBLE AS lng2 FROM part), t AS (SELECT e, 0.0::DOUBLE AS t FROM e UNION SELECT e, 1.0 FROM e UNION SELECT e, (k * 0.05::DOUBLE - lat1) / (lat2 - lat1) FROM e, range(300, 450) r(k) WHERE k * 0.05::DOUBLE > least(lat1, lat2) AND k * 0.05::DOUBLE < greatest(lat1, lat2) UNION SELECT e, (k * 0.05::DOUBLE - lng1) / (lng2 - lng1) FROM e, range(1400, 1500) r(k) WHERE k * 0.05::DOUBLE > least(lng1, lng2) AND k * 0.05::DOUBLE < greatest(lng1, lng2)), s AS (SELECT e, t AS a, lead(t) OVER (PARTITION BY e ORDER BY t) AS b FROM t), p AS (SELECT c, {i.HAVERSINE.format('lat1', 'lng1', 'lat2', 'lng2')} / 1000 * (b - a) AS km, floor((lat1 + (lat2 - lat1) * (a + b) / 2) / 0.05::DOUBLE)::BIGINT AS row, floor((lng1 + (lng2 - lng1) * (a + b) / 2) / 0.05::DOUBLE)::BIGINT AS col FROM e JOIN s USING (e) WHERE b IS NOT NULL), w AS (SELECT row, col, sum(km) AS every, round(coalesce(sum(km) FILTER (c = 'primary'), 0), 4) AS km_primary, round(coalesce(sum(km) FILTER (c = 'local'), 0), 4) AS km_local FROM p GROUP BY ALL) SELECT row, col, km_primary, km_local FROM w WHERE every > 0.0001")
def road_lengths(spark, sf):
    """Road length by class and cell."""
    from tramline.operators import barriers

    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    e = p.select(F.element_at(F.array(F.lit("primary"), F.lit("local")), (k % 2 + 1).cast("int")).alias("road_class"), (F.lit(18.9) + k % 20 * 0.01).alias("lat1"), (F.lit(72.8) + k % 30 * 0.01).alias("lng1"), (F.lit(18.9) + k % 21 * 0.01).alias("lat2"), (F.lit(72.8) + k % 31 * 0.01).alias("lng2"))
    return rounded(barriers.road_lengths(e, 0.05, ["primary", "local"]).where("km_primary + km_local > 0.0001"))


@query("corridor_permeability", f"WITH {_LINES}, f AS (SELECT event_id AS id, 18.9::DOUBLE + (event_id % 39) * 0.01::DOUBLE AS lat, CASE event_type WHEN 'view' THEN 1.0 WHEN 'click' THEN 0.5 WHEN 'error' THEN 0.2 ELSE 0 END AS w FROM events), s AS (SELECT edge_id, sum(w) AS w FROM lines JOIN f ON abs(lines.lat - f.lat) * 111320.0::DOUBLE <= 20 GROUP BY 1), l AS (SELECT edge_id, {i.HAVERSINE.format('lat', '72.7::DOUBLE', 'lat', '73.2::DOUBLE')} / 1000 AS km FROM lines) SELECT edge_id, round(coalesce(w, 0) / km, 6) AS permeability FROM l LEFT JOIN s USING (edge_id)")
def corridor_permeability(spark, sf):
    from tramline.operators import barriers

    e = table(spark, sf, "events")
    f = e.select(F.col("event_id").alias("id"), (F.lit(18.9) + (F.col("event_id") % 39) * F.lit(0.01)).alias("lat"), F.lit(72.9).alias("lng"), (F.col("event_type") == "view").alias("bridge"), (F.col("event_type") == "click").alias("footbridge"), (F.col("event_type") == "error").alias("crossing"))
    found = barriers.corridor_permeability(barriers.permeability_features(f), _lines(spark))
    return rounded(found.select("edge_id", "permeability"), 6)
