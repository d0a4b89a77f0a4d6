"""Queries of hexagons, cut shapes, sparse matrices, summaries, maps and the composed runs."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tramline.functions import geo, seqs
from tramline.operators import audit, barriers, features, od, pipelines, population, segments, shapes, telecom, trajectory, zones
from tramline.plans import inputs as i
from tramline.plans.bus import _OD, _binned, rounded
from tramline.plans.catalogue import query
from tramline.sources.readers import table

_SIDE = math.sqrt(2 * shapes.HEX_KM2[8] / (3 * math.sqrt(3)))
_KM = geo.KM_PER_DEGREE
_HEX = f"""hx AS (SELECT id, (lng * {_KM * math.cos(math.radians(19.0))}::DOUBLE * {math.sqrt(3) / 3}::DOUBLE - lat * {_KM}::DOUBLE / 3) / {_SIDE}::DOUBLE AS q, lat * {_KM}::DOUBLE * {2 / 3}::DOUBLE / {_SIDE}::DOUBLE AS r FROM pings),
hn AS (SELECT *, floor(q + 0.5::DOUBLE) AS a, floor(r + 0.5::DOUBLE) AS b, floor(-q - r + 0.5::DOUBLE) AS t FROM hx),
hc AS (SELECT id, CASE WHEN abs(a - q) > abs(b - r) AND abs(a - q) > abs(t + q + r) THEN -b - t ELSE a END AS hq,
  CASE WHEN NOT (abs(a - q) > abs(b - r) AND abs(a - q) > abs(t + q + r)) AND abs(b - r) > abs(t + q + r) THEN -a - t ELSE b END AS hr FROM hn)"""


@query("hex_pings", f"WITH {i.PINGS}, {_HEX} SELECT hq::BIGINT AS q, hr::BIGINT AS r, count(*) AS n_pings FROM hc GROUP BY ALL")
def hex_pings(spark, sf):
    cell = shapes.hex_cell(F.col("lat"), F.col("lng"), 8, 19.0)
    return i.pings(spark, sf).groupBy(cell.alias("c")).agg(F.count(F.lit(1)).alias("n_pings")).select("c.q", "c.r", "n_pings")


@query("hex_areas", f"WITH {i.PINGS}, {_HEX} SELECT hq::BIGINT AS q, hr::BIGINT AS r, 6 AS n_corners, round({shapes.HEX_KM2[8]}, 2) AS km2 FROM hc GROUP BY ALL")
def hex_areas(spark, sf):
    """The cells' polygons, by their corners and areas."""
    cell = shapes.hex_cell(F.col("lat"), F.col("lng"), 8, 19.0)
    cells = i.pings(spark, sf).select(cell.alias("c")).distinct().withColumn("p", shapes.hex_polygon(F.col("c"), 8, 19.0))
    return cells.select("c.q", "c.r", F.size("p").alias("n_corners"), F.round(geo.polygon_area_m2(F.col("p")) / 1e6, 2).alias("km2"))


def _squares(spark, sf):
    """Squares of 0.01 degrees around nations' places."""
    corner = lambda a, b: F.struct((F.col("lat") + a).alias("lat"), (F.col("lng") + b).alias("lng"))
    return i.zones(spark, sf).select("zone_id", "lat", "lng", F.array(corner(-0.005, -0.005), corner(-0.005, 0.005), corner(0.005, 0.005), corner(0.005, -0.005)).alias("polygon"))


def _east_west(spark):
    """Lines along latitudes, each from one meridian to another."""
    k = F.col("id")
    lat = F.lit(18.902) + k * 0.02
    return spark.range(4).select(k.alias("edge_id"), lat.alias("lat1"), F.lit(72.7).alias("lng1"), lat.alias("lat2"), F.lit(72.875).alias("lng2"))


@query("crossed_zones", f"WITH {i.ZONES}, b AS (SELECT k AS edge_id, 18.902::DOUBLE + k * 0.02::DOUBLE AS lat FROM range(4) t(k)) SELECT zone_id, edge_id FROM zones z JOIN b ON b.lat BETWEEN z.lat - 0.005 AND z.lat + 0.005 AND z.lng - 0.005 <= 72.875")
def crossed_zones(spark, sf):
    return shapes.zone_barriers(_squares(spark, sf), _east_west(spark)).select("zone_id", "edge_id")


@query("split_zones", f"WITH {i.ZONES}, b AS (SELECT k, 18.902::DOUBLE + k * 0.02::DOUBLE AS y FROM range(4) t(k)), s AS (SELECT zone_id, lat, y FROM zones z LEFT JOIN b ON b.y BETWEEN z.lat - 0.005 AND z.lat + 0.005 AND z.lng - 0.005 <= 72.875), a AS (SELECT zone_id, y IS NOT NULL AS split, unnest(CASE WHEN y IS NULL THEN [1.0::DOUBLE] ELSE [(lat + 0.005 - y) / 0.01, (y - lat + 0.005) / 0.01] END) AS share FROM s) SELECT zone_id, split, round(share, 3) AS share FROM a")
def split_zones(spark, sf):
    whole = _squares(spark, sf).select("zone_id", geo.polygon_area_m2(F.col("polygon")).alias("m2"))
    parts = shapes.split_zones(_squares(spark, sf), _east_west(spark)).join(whole, "zone_id")
    return parts.select("zone_id", "split", F.round(F.col("area_km2") * 1e6 / F.col("m2"), 3).alias("share"))


@query("od_sparse", f"WITH {i.FLOWS}, z AS (SELECT n_nationkey AS zone, row_number() OVER (ORDER BY n_nationkey) - 1 AS n FROM nation) SELECT a.n AS row, b.n AS col, sum(flow) AS flow FROM flows JOIN z a ON a.zone = origin JOIN z b ON b.zone = destination GROUP BY ALL HAVING sum(flow) <> 0")
def od_sparse(spark, sf):
    return od.to_sparse(i.flows(spark, sf), table(spark, sf, "nation").select(F.col("n_nationkey").alias("zone")))


@query("od_row_starts", f"WITH {i.FLOWS}, z AS (SELECT n_nationkey AS zone, row_number() OVER (ORDER BY n_nationkey) - 1 AS n FROM nation), e AS (SELECT DISTINCT a.n AS row, b.n AS col FROM flows JOIN z a ON a.zone = origin JOIN z b ON b.zone = destination), c AS (SELECT z.n AS row, count(e.row) AS n FROM z LEFT JOIN e ON e.row = z.n GROUP BY ALL) SELECT row, n, coalesce(sum(n) OVER (ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM c")
def od_row_starts(spark, sf):
    zones_ = table(spark, sf, "nation").select(F.col("n_nationkey").alias("zone"))
    return od.row_starts(od.to_sparse(i.flows(spark, sf), zones_), zones_.count())


@query("ward_od", f"WITH {_OD}, a AS (SELECT origin_stop_id, dest_stop_id, time_bin, period, month, is_monsoon, dow, count(*) AS flow, (origin_stop_id * 2 + dest_stop_id) / 4.0 AS km FROM binned GROUP BY ALL) SELECT origin_stop_id % 3 AS origin_ward, dest_stop_id % 3 AS dest_ward, period, month, is_monsoon, dow, date_trunc('month', time_bin)::DATE AS month_start, sum(flow)::BIGINT AS trip_count, round(avg(km), 6) AS avg_distance_km, count(DISTINCT origin_stop_id) AS n_origin_stops, count(DISTINCT dest_stop_id) AS n_dest_stops FROM a WHERE origin_stop_id < 9 AND dest_stop_id < 9 GROUP BY ALL")
def ward_od(spark, sf):
    """Stops from 9 on lie outside all wards."""
    wards = i.stops(spark, 12).select("stop_id", F.when(F.col("stop_id") < 9, F.col("stop_id") % 3).alias("ward"))
    agg = od.od_aggregate(_binned(spark, sf)).withColumn("distance_km", (F.col("origin_stop_id") * 2 + F.col("dest_stop_id")) / 4.0)
    return rounded(features.ward_od(agg, wards), 6)


@query("effective_days", "SELECT user_id, (ts - INTERVAL 3 HOUR)::DATE AS effective_day, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY ALL")
def effective_days(spark, sf):
    return features.by_effective_day(table(spark, sf, "events"), ["user_id"])


@query("generation_summary", f"WITH {i.ZONES}, z AS (SELECT *, population * 0.4 AS employment, zone_id % 7 = 0 AS is_cbd, CASE zone_id % 3 WHEN 0 THEN 'housing' WHEN 1 THEN 'trade' ELSE 'mixed' END AS land_use FROM zones) SELECT count(*) AS n_zones, round(sum(area_km2), 4) AS total_area, round(sum(population), 4) AS total_population, round(sum(employment), 4) AS total_employment, round(avg(area_km2), 4) AS avg_area, round(avg(population), 4) AS avg_population, round(avg(employment), 4) AS avg_employment, count(*) FILTER (is_cbd) AS n_cbd, (SELECT string_agg(land_use || ':' || n, ',' ORDER BY land_use) FROM (SELECT land_use, count(*) AS n FROM z GROUP BY 1)) AS land_uses FROM z")
def generation_summary(spark, sf):
    z = i.zones(spark, sf).withColumns({"employment": F.col("population") * 0.4, "is_cbd": F.col("zone_id") % 7 == 0, "land_use": F.element_at(F.array(F.lit("housing"), F.lit("trade"), F.lit("mixed")), (F.col("zone_id") % 3 + 1).cast("int"))})
    told = F.array_join(F.transform(F.array_sort(F.map_entries("land_uses")), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
    return rounded(zones.generation_summary(z).withColumn("land_uses", told))


@query("vehicle_lines", f"WITH {i.PINGS}, c AS (SELECT vehicle_id, count(*) AS n_pings FROM pings GROUP BY 1 HAVING count(*) >= 2 ORDER BY n_pings DESC, vehicle_id LIMIT 20) SELECT vehicle_id, n_pings, n_pings AS n_points, round(arg_min(lat, (ts, id)), 6) AS first_lat, round(arg_max(lng, (ts, id)), 6) AS last_lng FROM c JOIN pings USING (vehicle_id) GROUP BY ALL")
def vehicle_lines(spark, sf):
    v = audit.vehicle_lines(i.pings(spark, sf))
    return rounded(v.select("vehicle_id", "n_pings", F.size("line").cast("long").alias("n_points"), F.get("line", F.lit(0))["lat"].alias("first_lat"), F.element_at("line", -1)["lng"].alias("last_lng")), 6)


@query("longest_segments", f"WITH {i.SEGMENTED}, s AS (SELECT vehicle_id, segment_id, date_diff('minute', min(ts), max(ts)) AS duration_min FROM segmented GROUP BY ALL HAVING count(*) >= 5 AND date_diff('minute', min(ts), max(ts)) >= 5), k AS (SELECT vehicle_id || '_' || segment_id AS trip_id, duration_min FROM s) SELECT trip_id, duration_min, row_number() OVER (ORDER BY duration_min DESC, trip_id)::INT AS rank FROM k QUALIFY row_number() OVER (ORDER BY duration_min DESC, trip_id) <= 10")
def longest_segments(spark, sf):
    s = segments.segment_summary(segments.number_segments(i.pings(spark, sf), gap_min=720))
    return audit.longest(s.select(F.concat_ws("_", "vehicle_id", "segment_id").alias("trip_id"), "duration_min"), 10)


@query("balance_bins", "SELECT c_mktsegment, CASE WHEN c_acctbal > -1000 AND c_acctbal <= 0 THEN 0 WHEN c_acctbal > 0 AND c_acctbal <= 2500 THEN 1 WHEN c_acctbal > 2500 AND c_acctbal <= 5000 THEN 2 WHEN c_acctbal > 5000 AND c_acctbal <= 10000 THEN 3 ELSE -1 END AS bin, count(*) AS n FROM customer GROUP BY ALL")
def balance_bins(spark, sf):
    return audit.bins(table(spark, sf, "customer"), "c_acctbal", [-1000.0, 0.0, 2500.0, 5000.0, 10000.0], "c_mktsegment")


@query("table_columns", "SELECT (row_number() OVER () - 1)::INT AS position, column_name FROM (DESCRIBE SELECT * FROM lineitem)")
def table_columns(spark, sf):
    return audit.schema_of(table(spark, sf, "lineitem")).select("position", "column_name")


@query("route_lists", f"WITH {i.TRIPS} SELECT trip_id, len(stops)::INT AS n_stops, stops[1]::INT AS first_stop, stops[len(stops)]::INT AS last_stop, round(start_min, 4) AS start_min FROM trips")
def route_lists(spark, sf):
    """Routes and schedules read back from their JSON texts."""
    t = i.trips(spark, sf).select("trip_id", F.to_json("stops").alias("stops"), F.to_json(F.array("start_min")).alias("schedule"))
    s, m = seqs.stop_list(F.col("stops")), seqs.schedule_list(F.col("schedule"))
    return rounded(t.select("trip_id", F.size(s).alias("n_stops"), F.get(s, F.lit(0)).alias("first_stop"), F.element_at(s, -1).alias("last_stop"), F.get(m, F.lit(0)).alias("start_min")))


@query("sides_of_line", f"WITH {i.PINGS} SELECT id, sign((73.0::DOUBLE - 72.8::DOUBLE) * (lat - 18.9::DOUBLE) - (19.3::DOUBLE - 18.9::DOUBLE) * (lng - 72.8::DOUBLE))::INT AS side FROM pings")
def sides_of_line(spark, sf):
    at = [F.lit(v) for v in (18.9, 72.8, 19.3, 73.0)]
    return i.pings(spark, sf).select("id", barriers.side_of_line(F.col("lat"), F.col("lng"), *at).alias("side"))


_HEAT = "-8.78469475556 + 1.61139411 * t + 2.33854883889 * r - 0.14611605 * t * r - 0.012308094 * t * t - 0.0164248277778 * r * r + 0.002211732 * t * t * r + 0.00072546 * t * r * r - 0.000003582 * t * t * r * r"


@query("heat_index", f"WITH w AS (SELECT event_id, 20.0::DOUBLE + event_id % 20 AS t, 30.0::DOUBLE + user_id % 60 AS r FROM events) SELECT event_id, round(CASE WHEN t < 27 THEN t ELSE {_HEAT} END, 6) AS feels_c FROM w")
def heat_index(spark, sf):
    e = table(spark, sf, "events")
    return rounded(e.select("event_id", features.heat_index_c(20.0 + F.col("event_id") % 20, 30.0 + F.col("user_id") % 60).alias("feels_c")), 6)


@query("forward_fill", "WITH d AS (SELECT o_orderkey, o_custkey, o_orderdate, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS v FROM orders) SELECT o_orderkey, round(coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING), 0), 2) AS v FROM d")
def forward_fill(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice")).alias("v"))
    return rounded(features.forward_fill(o, ["o_custkey"], "o_orderkey", "v").select("o_orderkey", "v"), 2)


@query("building_people", "SELECT p_partkey, round(p_retailprice * (p_size % 5 + 1) / 30.0 * 0.9, 4) AS people FROM part")
def building_people(spark, sf):
    p = table(spark, sf, "part")
    return rounded(p.select("p_partkey", population.building_population(F.col("p_retailprice"), F.col("p_size") % 5 + 1).alias("people")))


@query("intra_zonal_times", f"WITH {i.ZONES} SELECT zone_id, round(0.52 * sqrt(area_km2) / 20 * 3600, 4) AS seconds FROM zones")
def intra_zonal_times(spark, sf):
    return rounded(i.zones(spark, sf).select("zone_id", zones.intra_zonal_s(F.col("area_km2")).alias("seconds")))


@query("stream_sliding", "WITH w AS (SELECT event_type, value, unnest([time_bucket(INTERVAL '3 hours', ts), time_bucket(INTERVAL '3 hours', ts) - INTERVAL '3 hours']) AS window_start FROM events) SELECT window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY ALL")
def stream_sliding(spark, sf):
    from tramline.streaming import windows

    s = windows.with_clock(windows.stream_table(spark, sf, "events"))
    out = windows.run_to_table(windows.sliding(s, "6 hours", "3 hours", ["event_type"], [F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")]))
    return rounded(out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total"))


@query("cdr_observations", "SELECT user_id::VARCHAR AS imsi, ts, event_type AS cell_id, 'cdr' AS source FROM events")
def cdr_observations(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("imsi"), "ts", F.col("event_type").alias("cell_id"), F.lit(None).cast("string").alias("tac"))
    return telecom.from_cdr(e).select("imsi", "ts", "cell_id", "source")


@query("xdr_observations", "SELECT user_id::VARCHAR AS imsi, ts, CASE WHEN event_id % 3 = 0 THEN 'xdr_cell' ELSE 'xdr_gps' END AS source FROM events")
def xdr_observations(spark, sf):
    e = i.observations(spark, sf).select("imsi", "ts", "cell_id", "tac", "lat", "lng")
    return telecom.from_xdr(e).select("imsi", "ts", "source")


@query("count_model")
def count_model(spark, sf):
    """A negative-binomial regression of orders a day on the day of the week and the month."""
    d = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    d = d.withColumns({"sunday": (F.dayofweek("d") == 1).cast("double"), "late": (F.month("d") > 6).cast("double")})
    m = population.negative_binomial(d, "n", ["sunday", "late"])
    rows = [("constant", *m.coefficients[:1])] + list(zip(m.features, m.coefficients[1:])) + sorted(m.stats.items())
    return rounded(spark.createDataFrame([(k, float(v)) for k, v in rows], "term string, value double"), 4)


@query("tower_handovers")
def tower_handovers(spark, sf):
    """Changes of the nearest tower along each vehicle's day, looked at every hour."""
    t = i.pings(spark, sf).select(F.concat_ws("_", "vehicle_id", F.to_date("ts").cast("string")).alias("trip_id"), "id", "ts", "lat", "lng")
    return trajectory.handovers(t, i.stops(spark).withColumnRenamed("stop_id", "tower_id"), 3600, 7200.0)


@query("telecom_demand")
def telecom_demand(spark, sf):
    """The matrix of a whole run over the observations."""
    return rounded(pipelines.telecom_demand([i.observations(spark, sf)])["matrix"])


@query("zone_generation")
def zone_generation(spark, sf):
    """Zones grown from nations' squares, with barriers across some."""
    z = i.zones(spark, sf)
    cells = z.select("district", F.col("zone_id").alias("cell"), "population", (F.col("population") * 0.4).alias("employment"), (F.col("zone_id") % 2).alias("barrier")).join(_squares(spark, sf).withColumnRenamed("zone_id", "cell"), "cell")
    one = z.select("district", "zone_id")
    edges = one.join(one.select("district", F.col("zone_id").alias("b")), "district").where("zone_id < b").select("district", F.col("zone_id").alias("a"), "b")
    return rounded(pipelines.generate_zones(cells, edges, _east_west(spark), 3000.0)["zones"], 6)


@query("fusion_evaluation")
def fusion_evaluation(spark, sf):
    """Thinned and moved tracks against the pings."""
    truth = i.pings(spark, sf).withColumnRenamed("vehicle_id", "trip_id").select("trip_id", "id", "ts", "lat", "lng")
    half = truth.where("id % 2 = 0")
    moved = truth.withColumn("lat", F.col("lat") + 0.001)
    return rounded(pipelines.evaluate_fusion(truth, {"half": half, "moved": moved, "same": truth}), 4)
