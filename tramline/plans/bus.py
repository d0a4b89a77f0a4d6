"""Queries of the bus pipeline: pings to segments, stops, routes, matrices, headways, features and policy."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.functions import geo, seqs, times
from tramline.operators import clean, features, nearest, od, routes, segments
from tramline.plans import inputs as i
from tramline.plans.catalogue import query
from tramline.sources.readers import table

_BOX = "lat BETWEEN 18.8894 - 0.15 AND 19.3274 + 0.15 AND lng BETWEEN 72.7692 - 0.15 AND 73.1165 + 0.15 AND lat <> 0 AND lng <> 0"


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded, as sums depend on the order of addition."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _segmented(spark: SparkSession, sf: str) -> DataFrame:
    return segments.number_segments(i.pings(spark, sf), gap_min=720)


@query("clean_funnel", f"WITH {i.PINGS} SELECT id, vehicle_id, round(lat, 9) AS lat, round(lng, 9) AS lng, CASE WHEN speed <= 120 THEN round(speed, 9) END AS speed, ts::DATE AS ride_date, year(ts)::SMALLINT AS year, month(ts)::TINYINT AS month, hour(ts)::TINYINT AS hour FROM pings WHERE {_BOX} AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25' AND (deviation_s IS NULL OR abs(deviation_s) <= 300)")
def clean_funnel(spark, sf):
    found = clean.clean_pings(i.pings(spark, sf), dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 25))
    return rounded(found.select("id", "vehicle_id", "lat", "lng", "speed", "ride_date", "year", "month", "hour"), 9)


@query("funnel_counts", f"WITH {i.PINGS} SELECT count(*) AS n_raw, count(ts) AS n_dated, count(*) FILTER ({_BOX}) AS n_box, count(*) FILTER ({_BOX} AND abs(deviation_s) <= 300) AS n_deviation, count(*) FILTER ({_BOX} AND abs(deviation_s) <= 300 AND speed <= 120) AS n_speed FROM pings")
def funnel_counts(spark, sf):
    return clean.funnel_counts(i.pings(spark, sf))


@query("dedup_first", f"WITH {i.PINGS} SELECT id, vehicle_id, ts::DATE AS d, stop_id FROM pings QUALIFY row_number() OVER (PARTITION BY vehicle_id, ts::DATE, stop_id ORDER BY ts, id) = 1")
def dedup_first(spark, sf):
    return clean.keep_first(i.pings(spark, sf).withColumn("d", F.to_date("ts")), ["vehicle_id", "d", "stop_id"], ["ts", "id"]).select("id", "vehicle_id", "d", "stop_id")


_JUMP = i.HAVERSINE.format("lag(lat) OVER w", "lag(lng) OVER w", "lat", "lng")


@query("jump_filter", f"WITH {i.PINGS}, j AS (SELECT id, vehicle_id, CASE WHEN ts > lag(ts) OVER w THEN {_JUMP} / 1000 / ((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 3600000000.0) END AS k FROM pings WINDOW w AS (PARTITION BY vehicle_id ORDER BY ts, id)) SELECT id, vehicle_id, round(k, 4) AS jump_kmh FROM j WHERE k IS NULL OR k <= 5")
def jump_filter(spark, sf):
    return rounded(clean.jump_filter(i.pings(spark, sf), max_kmh=5.0).select("id", "vehicle_id", "jump_kmh"))


@query("segment_trips", f"WITH {i.SEGMENTED} SELECT vehicle_id, segment_id, min(ts) AS seg_start, max(ts) AS seg_end, count(*) AS n_pings, date_diff('minute', min(ts), max(ts)) AS duration_min FROM segmented GROUP BY 1, 2 HAVING count(*) >= 5 AND date_diff('minute', min(ts), max(ts)) >= 5")
def segment_trips(spark, sf):
    return segments.segment_summary(_segmented(spark, sf))


@query("valid_pings", f"WITH {i.SEGMENTED} SELECT id, vehicle_id, segment_id FROM segmented QUALIFY count(*) OVER (PARTITION BY vehicle_id, segment_id) >= 5 AND date_diff('minute', min(ts) OVER (PARTITION BY vehicle_id, segment_id), max(ts) OVER (PARTITION BY vehicle_id, segment_id)) >= 5")
def valid_pings(spark, sf):
    return segments.valid_pings(_segmented(spark, sf)).select("id", "vehicle_id", "segment_id")


@query("gap_sensitivity", f"WITH {i.PINGS}, g AS (SELECT (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY vehicle_id ORDER BY ts, id))) / 60000000.0 AS gap FROM pings) SELECT t::INT AS threshold_min, count(*) FILTER (gap > t) AS n_breaks, count(*) FILTER (gap > t OR gap IS NULL) AS n_segments FROM g, (VALUES (60), (120), (240), (480), (720), (960), (1200), (1440)) v(t) GROUP BY t")
def gap_sensitivity(spark, sf):
    return segments.gap_sensitivity(i.pings(spark, sf), [60, 120, 240, 480, 720, 960, 1200, 1440])


@query("gap_quantiles", f"WITH {i.PINGS}, g AS (SELECT (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY vehicle_id ORDER BY ts, id))) / 60000000.0 AS gap FROM pings) SELECT s::DOUBLE AS share, round(q, 4) AS gap_min FROM (SELECT unnest([0.5, 0.9, 0.95, 0.99]) AS s, unnest(quantile_cont(gap, [0.5, 0.9, 0.95, 0.99])) AS q FROM g)")
def gap_quantiles(spark, sf):
    return rounded(segments.gap_quantiles(i.pings(spark, sf), [0.5, 0.9, 0.95, 0.99]))


@query("segment_sequences", f"WITH {i.SEGMENTED}, r AS (SELECT vehicle_id, segment_id, ts, id, stop_id, lag(stop_id) OVER (PARTITION BY vehicle_id, segment_id ORDER BY ts, id) AS prev FROM segmented) SELECT vehicle_id, segment_id, count(*) AS n_pings, count(DISTINCT stop_id) AS n_stops, string_agg(stop_id::VARCHAR, '-' ORDER BY ts, id) FILTER (prev IS NULL OR prev <> stop_id) AS stops FROM r GROUP BY 1, 2 HAVING count(*) FILTER (prev IS NULL OR prev <> stop_id) >= 4")
def segment_sequences(spark, sf):
    return segments.segment_sequences(_segmented(spark, sf)).select("vehicle_id", "segment_id", "n_pings", "n_stops", F.array_join(F.transform("stops", lambda s: s.cast("string")), "-").alias("stops"))


_VISITS = i.PINGS + """, f AS (SELECT *, CASE WHEN stop_id = lag(stop_id) OVER (PARTITION BY vehicle_id, ts::DATE ORDER BY ts, id) THEN 0 ELSE 1 END AS s FROM pings),
g AS (SELECT *, (sum(s) OVER (PARTITION BY vehicle_id, ts::DATE ORDER BY ts, id) - 1)::BIGINT AS visit_group FROM f),
visits AS (SELECT vehicle_id, ts::DATE AS ride_date, stop_id, visit_group, min(ts) AS arrival, count(*) AS n_pings FROM g GROUP BY ALL),
heads AS (SELECT * FROM (SELECT *, (epoch_us(arrival) - epoch_us(lag(arrival) OVER (PARTITION BY stop_id, ride_date ORDER BY arrival, vehicle_id))) / 60000000.0 AS headway_min FROM visits) WHERE headway_min > 0 AND headway_min < 120)"""


def _visits(spark, sf):
    return segments.stop_visits(i.pings(spark, sf).withColumn("ride_date", F.to_date("ts")), ["vehicle_id", "ride_date"])


@query("stop_visits", f"WITH {_VISITS} SELECT vehicle_id, ride_date, stop_id, visit_group, arrival, n_pings FROM visits")
def stop_visits(spark, sf):
    return _visits(spark, sf)


@query("headways", f"WITH {_VISITS} SELECT vehicle_id, stop_id, arrival, round(headway_min, 9) AS headway_min FROM heads")
def headways(spark, sf):
    return rounded(segments.headways(_visits(spark, sf), ["stop_id", "ride_date"]).select("vehicle_id", "stop_id", "arrival", "headway_min"), 9)


@query("headway_stats", f"WITH {_VISITS}, m AS (SELECT *, avg(headway_min) OVER (PARTITION BY stop_id) AS mu FROM heads) SELECT stop_id, count(*) AS n, round(avg(headway_min), 4) AS mean_headway, round(stddev_samp(headway_min), 4) AS sd_headway, round(median(headway_min), 4) AS median_headway, round(quantile_cont(headway_min, 0.85), 4) AS p85_headway, count(*) FILTER (headway_min < 0.25 * mu) AS n_bunched, round(stddev_samp(headway_min) / avg(headway_min), 4) AS cv, round(1 - stddev_samp(headway_min) / avg(headway_min), 4) AS regularity, round(count(*) FILTER (headway_min < 0.25 * mu) / count(*), 4) AS bunching_share FROM m GROUP BY 1 HAVING count(*) >= 10")
def headway_stats(spark, sf):
    return rounded(segments.headway_stats(segments.headways(_visits(spark, sf), ["stop_id", "ride_date"]), ["stop_id"]))


_OD = i.SEGMENTED + """, od AS (SELECT vehicle_id, segment_id, arg_min(stop_id, (epoch_us(ts), stop_id)) AS origin_stop_id, arg_max(stop_id, (epoch_us(ts), stop_id)) AS dest_stop_id, min(ts) AS seg_start, max(ts) AS seg_end, count(*) AS n_pings, date_diff('minute', min(ts), max(ts)) AS duration_min FROM segmented GROUP BY 1, 2),
tier2 AS (SELECT * FROM od WHERE n_pings >= 3 AND duration_min >= 2 AND origin_stop_id <> dest_stop_id),
binned AS (SELECT *, time_bucket(INTERVAL '30 minutes', seg_start) AS time_bin, CASE WHEN hour(seg_start) >= 6 AND hour(seg_start) < 10 THEN 'AM_peak' WHEN hour(seg_start) >= 17 AND hour(seg_start) < 21 THEN 'PM_peak' ELSE 'off_peak' END AS period, month(seg_start)::INT AS month, month(seg_start) BETWEEN 6 AND 9 AS is_monsoon, dayofweek(seg_start)::INT AS dow FROM tier2)"""


def _binned(spark, sf):
    return od.with_bins(od.segment_od(_segmented(spark, sf)))


@query("od_tier2", f"WITH {_OD} SELECT * FROM tier2")
def od_tier2(spark, sf):
    return od.segment_od(_segmented(spark, sf))


@query("od_agg", f"WITH {_OD} SELECT origin_stop_id, dest_stop_id, time_bin, period, month, is_monsoon, dow, count(*) AS flow, round(avg(duration_min), 4) AS mean_duration_min FROM binned GROUP BY ALL")
def od_agg(spark, sf):
    return rounded(od.od_aggregate(_binned(spark, sf)))


@query("service_supply", f"WITH {_OD} SELECT origin_stop_id, dest_stop_id, month, count(*) AS n_runs, count(DISTINCT seg_start::DATE) AS n_days, round(count(*) / count(DISTINCT seg_start::DATE), 4) AS runs_per_day FROM binned GROUP BY ALL")
def service_supply(spark, sf):
    return rounded(od.service_supply(_binned(spark, sf)))


@query("service_frequency", f"WITH {_OD} SELECT origin_stop_id, dest_stop_id, time_bin, count(*) AS flow, round(30.0 / nullif(count(*), 0), 4) AS implied_headway_min FROM binned GROUP BY ALL")
def service_frequency(spark, sf):
    return rounded(od.service_frequency(od.od_aggregate(_binned(spark, sf)).groupBy("origin_stop_id", "dest_stop_id", "time_bin").agg(F.sum("flow").alias("flow"))))


@query("ward_rollup", f"WITH {_OD}, a AS (SELECT origin_stop_id, dest_stop_id, time_bin, count(*) AS flow, avg(duration_min) AS m FROM binned GROUP BY ALL) SELECT origin_stop_id % 4 AS origin_ward, dest_stop_id % 4 AS dest_ward, date_trunc('month', time_bin)::DATE AS month, sum(flow)::BIGINT AS flow, round(avg(m), 4) AS mean_duration_min, count(DISTINCT origin_stop_id) AS n_origin_stops, count(DISTINCT dest_stop_id) AS n_dest_stops FROM a GROUP BY ALL")
def ward_rollup(spark, sf):
    wards = i.stops(spark, 12).select("stop_id", (F.col("stop_id") % 4).alias("ward"))
    agg = _binned(spark, sf).groupBy("origin_stop_id", "dest_stop_id", "time_bin").agg(F.count(F.lit(1)).alias("flow"), F.avg("duration_min").alias("mean_duration_min"))
    return rounded(features.ward_rollup(agg, wards, "time_bin"))


@query("route_catalog", f"WITH {i.TRIPS} SELECT min(trip_id) AS template_id, count(*) AS n_trips, round(median(start_min), 4) AS median_start_min, min(trip_date) AS first_date, max(trip_date) AS last_date, count(DISTINCT trip_date) AS n_dates, len(stops)::INT AS n_stops, array_to_string(stops, '-') AS stops, array_to_string(list_sort(list(DISTINCT trip_id))[1:3], ',') AS sample_trip_ids FROM trips WHERE len(stops) >= 2 GROUP BY stops")
def route_catalog(spark, sf):
    c = routes.route_catalog(i.trips(spark, sf))
    text = lambda col, sep: F.array_join(F.transform(col, lambda x: x.cast("string")), sep).alias(col)
    return rounded(c.select("template_id", "n_trips", "median_start_min", "first_date", "last_date", "n_dates", "n_stops", text("stops", "-"), text("sample_trip_ids", ",")))


@query("route_candidates", f"WITH {i.TRIPS}, d AS (SELECT trip_id, unnest(list_distinct(stops)) AS stop FROM trips WHERE len(stops) >= 4), x AS (SELECT a.trip_id, t.trip_id AS template_id, count(*) AS shared FROM d a JOIN d t USING (stop) GROUP BY ALL), y AS (SELECT *, max(shared) OVER (PARTITION BY trip_id) AS most FROM x WHERE shared > 0) SELECT trip_id, template_id, shared::BIGINT AS shared FROM y WHERE shared >= 2 OR most < 2 QUALIFY row_number() OVER (PARTITION BY trip_id ORDER BY shared DESC, template_id) <= 15")
def route_candidates(spark, sf):
    t = i.trips(spark, sf).where(F.size("stops") >= 4)
    return routes.candidates(t.select("trip_id", "stops"), t.select(F.col("trip_id").alias("template_id"), "stops"), ["trip_id"])


@query("route_match")
def route_match(spark, sf):
    """Trips matched to the catalogue's templates by common stops, order and direction."""
    t = i.trips(spark, sf).where(F.size("stops") >= 4)
    templates = routes.route_catalog(t).select("template_id", "stops")
    found = routes.infer_routes(t.select("trip_id", "stops"), templates, ["trip_id"])
    return rounded(found.drop("stops"))


@query("route_stops", "SELECT l_orderkey AS trip_id, (l_partkey % 50)::INT AS stop_id, round(min(l_linenumber) * 10.0, 4) AS minutes FROM lineitem GROUP BY ALL")
def route_stops(spark, sf):
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_partkey") % 50).alias("s")))).alias("r"))
    text = F.array_join(F.transform("r", lambda x: F.format_string("(%d, '%02d:%02d:00')", x["s"], F.floor(x["l_linenumber"] * 10 / 60), x["l_linenumber"] * 10 % 60)), ", ")
    trips = li.select(F.col("l_orderkey").alias("trip_id"), seqs.parse_route(F.concat(F.lit("["), text, F.lit("]"))).alias("route"))
    return rounded(routes.route_stops(trips))


@query("schedule_adherence", f"WITH {i.PINGS}, s AS (SELECT vehicle_id, stop_id, avg(hour(ts) * 60.0 + minute(ts) + second(ts) / 60.0) AS minutes FROM pings GROUP BY ALL), d AS (SELECT p.stop_id, hour(ts) * 60.0 + minute(ts) + second(ts) / 60.0 - minutes AS raw FROM pings p JOIN s USING (vehicle_id, stop_id)), e AS (SELECT stop_id, CASE WHEN raw > 720 THEN raw - 1440 WHEN raw < -720 THEN raw + 1440 ELSE raw END AS d FROM d) SELECT stop_id, count(*) AS n, round(avg(d), 4) AS mean_delay, round(stddev_samp(d), 4) AS sd_delay, round(median(d), 4) AS median_delay, round(avg((abs(d) <= 3)::INT), 4) AS on_time_share, round(avg((d > 5)::INT), 4) AS late_share, round(avg((d < -2)::INT), 4) AS early_share FROM e WHERE abs(d) < 90 GROUP BY 1")
def schedule_adherence(spark, sf):
    p = i.pings(spark, sf)
    daily = p.select(F.col("vehicle_id").alias("trip_id"), "stop_id", "id", times.minutes_of_day(F.col("ts")).alias("minutes"))
    schedule = features.mean_in_order(daily, ["trip_id", "stop_id"], "minutes", ["id"], "minutes")
    return rounded(routes.adherence(p.select(F.col("vehicle_id").alias("trip_id"), "stop_id", F.col("ts").alias("arrival")), schedule, ["stop_id"]))


@query("schedule_similarity", f"WITH s AS (SELECT o_custkey % 20 AS t, month(o_orderdate)::INT AS m, list(DISTINCT o_orderkey % 40) AS s FROM orders GROUP BY ALL) SELECT a.t AS template_id, a.m AS month_a, b.m AS month_b, round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))), 4) AS jaccard FROM s a JOIN s b ON a.t = b.t AND a.m < b.m")
def schedule_similarity(spark, sf):
    o = table(spark, sf, "orders").select((F.col("o_custkey") % 20).alias("template_id"), F.month("o_orderdate").alias("month"), (F.col("o_orderkey") % 40).alias("signature"))
    return rounded(routes.schedule_similarity(o))


_REACH = """st AS (SELECT DISTINCT p_partkey // 6 AS template_id, unnest([p_partkey // 2, p_partkey * 5 // 4]) AS stop_id FROM part),
direct AS (SELECT DISTINCT least(x.stop_id, y.stop_id) AS a, greatest(x.stop_id, y.stop_id) AS b FROM st x JOIN st y USING (template_id) WHERE x.stop_id < y.stop_id),
far AS (SELECT DISTINCT least(x.stop_id, y.stop_id) AS a, greatest(x.stop_id, y.stop_id) AS b FROM st x JOIN st m ON m.template_id = x.template_id JOIN st n ON n.stop_id = m.stop_id AND n.template_id <> m.template_id JOIN st y ON y.template_id = n.template_id WHERE x.stop_id <> y.stop_id),
transfer AS (SELECT * FROM far EXCEPT SELECT * FROM direct)"""


def _reach(spark, sf):
    k = F.col("p_partkey")
    p = table(spark, sf, "part").select(F.floor(k / 6).alias("template_id"), F.array(F.floor(k / 2), F.floor(k * 5 / 4)).alias("s"))
    return routes.reachability(p.groupBy("template_id").agg(F.flatten(F.collect_list("s")).alias("stops")))


@query("reachability", f"WITH {_REACH} SELECT a, b, 'direct' AS kind FROM direct UNION ALL SELECT a, b, 'transfer' FROM transfer")
def reachability(spark, sf):
    direct, transfer = _reach(spark, sf)
    return direct.withColumn("kind", F.lit("direct")).union(transfer.withColumn("kind", F.lit("transfer")))


@query("service_gaps", f"WITH {_REACH}, q AS (SELECT l_partkey // 2 AS o, l_partkey // 2 + l_suppkey % 9 AS d, count(*) AS flow FROM lineitem WHERE l_suppkey % 9 <> 0 GROUP BY ALL), s AS (SELECT q.*, CASE WHEN direct.a IS NOT NULL THEN 'direct' WHEN transfer.a IS NOT NULL THEN 'transfer' ELSE 'gap' END AS status FROM q LEFT JOIN direct ON direct.a = least(o, d) AND direct.b = greatest(o, d) LEFT JOIN transfer ON transfer.a = least(o, d) AND transfer.b = greatest(o, d)) SELECT status, sum(flow)::BIGINT AS flow, count(*) AS n_pairs, count(DISTINCT o) AS n_origins FROM s GROUP BY 1")
def service_gaps(spark, sf):
    direct, transfer = _reach(spark, sf)
    o = F.floor(F.col("l_partkey") / 2)
    li = table(spark, sf, "lineitem").select(o.alias("o"), (o + F.col("l_suppkey") % 9).alias("d")).where("o <> d").groupBy("o", "d").agg(F.count(F.lit(1)).alias("flow"))
    return features.service_status(li, direct, transfer, "o", "d").groupBy("status").agg(F.sum("flow").alias("flow"), F.count(F.lit(1)).alias("n_pairs"), F.countDistinct("o").alias("n_origins"))


@query("mode_shift", "WITH s AS (SELECT o_custkey, count(*)::DOUBLE AS runs, (o_custkey % 11) / 10.0 AS r FROM orders GROUP BY o_custkey), c AS (SELECT quantile_cont(runs, 0.99) AS cap FROM s), x AS (SELECT o_custkey, runs, 0.6 * least(runs / cap, 1.0) + 0.4 * least(r, 1.0) AS score FROM s, c) SELECT o_custkey, runs, round(score, 4) AS score, CASE WHEN score <= 0.5 THEN 'T3' WHEN score <= 0.7 THEN 'T2' ELSE 'T1' END AS tier, round(greatest(0.0, runs * 2.5 * 0.141), 4) AS co2_kg, round(runs / 1.15, 1) AS cars_avoided FROM x")
def mode_shift(spark, sf):
    s = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).cast("double").alias("runs")).withColumns({"r": (F.col("o_custkey") % 11) / 10.0, "km": F.lit(2.5)})
    return rounded(features.co2_savings(features.mode_shift(s, "runs", "r"), "runs", "km").drop("r", "km"))


@query("asof_nearest", f"WITH {i.PINGS}, l AS (SELECT id, vehicle_id, ts, speed FROM pings WHERE event_type = 'view'), r AS (SELECT id, vehicle_id, ts, speed FROM pings WHERE event_type = 'click'), x AS (SELECT l.id, abs(epoch_us(l.ts) - epoch_us(r.ts)) / 1000000.0 AS g, r.ts AS rt, r.speed AS v FROM l JOIN r USING (vehicle_id) WHERE abs(epoch_us(l.ts) - epoch_us(r.ts)) / 1000000.0 <= 7200), b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY id ORDER BY g, rt, v) = 1) SELECT l.id, l.vehicle_id, round(b.g, 9) AS gap_s, b.rt AS matched_ts, round(b.v, 9) AS right_speed FROM l LEFT JOIN b USING (id)")
def asof_nearest(spark, sf):
    p = i.pings(spark, sf)
    r = p.where("event_type = 'click'").select("vehicle_id", "ts", F.col("speed").alias("right_speed"))
    return rounded(nearest.asof_nearest(p.where("event_type = 'view'").select("id", "vehicle_id", "ts"), r, ["vehicle_id"], "ts", "id", 7200.0, ["right_speed"]).select("id", "vehicle_id", "gap_s", "matched_ts", "right_speed"), 9)


_DIST = i.HAVERSINE.format("p.lat", "p.lng", "s.lat", "s.lng")


@query("knn_snap", f"WITH {i.PINGS}, {i.STOPS}, x AS (SELECT p.id, s.stop_id, {_DIST} AS d FROM pings p, stops s), b AS (SELECT * FROM x WHERE d <= 2000 QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, stop_id) = 1) SELECT pings.id, b.stop_id AS snapped_stop_id, round(b.d, 3) AS snap_distance_m FROM pings LEFT JOIN b USING (id)")
def knn_snap(spark, sf):
    return rounded(nearest.snap(i.pings(spark, sf).drop("stop_id"), i.stops(spark), 2000.0).select("id", "snapped_stop_id", "snap_distance_m"), 3)


@query("knn_idw", f"WITH {i.PINGS}, {i.STOPS}, g AS (SELECT * FROM stops WHERE stop_id % 3 = 0), w AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE value END AS v, (event_id % 14 * 3)::INT AS stop_id, ts::DATE AS t FROM events), h AS (SELECT stop_id, t, avg(v) AS v FROM w GROUP BY ALL), n AS (SELECT p.stop_id AS point_id, s.stop_id, {_DIST} / 1000 AS km FROM stops p, g s QUALIFY row_number() OVER (PARTITION BY p.stop_id ORDER BY {_DIST}, s.stop_id) <= 4) SELECT point_id, t, round(sum(CASE WHEN v IS NOT NULL THEN v / pow(km + 1e-9, 2) END) / sum(CASE WHEN v IS NOT NULL THEN 1 / pow(km + 1e-9, 2) END), 4) AS v FROM n JOIN h USING (stop_id) GROUP BY ALL")
def knn_idw(spark, sf):
    e = table(spark, sf, "events")
    hourly = e.select((F.col("event_id") % 14 * 3).cast("int").alias("stop_id"), F.to_date("ts").alias("t"), F.when(F.col("event_id") % 9 != 0, F.col("value")).alias("v")).groupBy("stop_id", "t").agg(F.avg("v").alias("v"))
    points = i.stops(spark).withColumnRenamed("stop_id", "point_id")
    near = nearest.nearest_k(points, i.stops(spark).where("stop_id % 3 = 0"), 4, "point_id", "stop_id")
    return rounded(nearest.idw(near, hourly, "point_id", "stop_id", "t", ["v"]))


@query("band_nearest", "WITH l AS (SELECT o_orderkey, o_custkey % 50 AS k, (o_orderkey * 7 % 1440)::DOUBLE AS m FROM orders), r AS (SELECT o_orderkey AS trip, o_custkey % 50 AS k, (o_orderkey * 11 % 1440)::DOUBLE AS m FROM orders), x AS (SELECT l.o_orderkey, least(abs(l.m - r.m), 1440 - abs(l.m - r.m)) AS d, r.trip FROM l JOIN r USING (k)), b AS (SELECT * FROM x WHERE d <= 45 QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY d, trip) = 1) SELECT l.o_orderkey, b.trip, round(b.d, 4) AS delta_min FROM l LEFT JOIN b USING (o_orderkey)")
def band_nearest(spark, sf):
    o = table(spark, sf, "orders")
    k = (F.col("o_custkey") % 50).alias("k")
    left = o.select("o_orderkey", k, (F.col("o_orderkey") * 7 % 1440).cast("double").alias("m"))
    right = o.select(F.col("o_orderkey").alias("trip"), k, (F.col("o_orderkey") * 11 % 1440).cast("double").alias("rm"))
    return rounded(nearest.band_nearest(left, right, ["k"], "m", "rm", "o_orderkey", 45.0, "trip").select("o_orderkey", "trip", "delta_min"))


_DAILY = "d AS (SELECT o_orderpriority AS k, o_orderdate AS t, sum(o_totalprice) / 1000 AS y, count(*) AS n FROM orders GROUP BY ALL)"


def _daily(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("k"), F.col("o_orderdate").alias("t")).agg((F.sum("o_totalprice") / 1000).alias("y"), F.count(F.lit(1)).alias("n"))


@query("lag_rolling_features", f"WITH {_DAILY} SELECT k, t, round(lag(y, 1) OVER w, 6) AS y_lag_1, round(lag(y, 2) OVER w, 6) AS y_lag_2, round(lag(y, 48) OVER w, 6) AS y_lag_48, round(lag(y, 336) OVER w, 6) AS y_lag_336, round(avg(y) OVER p, 9) AS y_mean_48, round(stddev_samp(y) OVER p, 4) AS y_sd_48 FROM d WINDOW w AS (PARTITION BY k ORDER BY t), p AS (PARTITION BY k ORDER BY t ROWS BETWEEN 48 PRECEDING AND 1 PRECEDING)")
def lag_rolling_features(spark, sf):
    found = features.lag_features(_daily(spark, sf), ["k"], "t", "y").drop("y", "n")
    digits = {"y_mean_48": 9, "y_sd_48": 4}
    return found.select(*[F.round(c, digits.get(c, 6)).alias(c) if c.startswith("y_") else F.col(c) for c in found.columns])


@query("rolling_sums", f"WITH {_DAILY} SELECT k, t, n, sum(n) OVER (PARTITION BY k ORDER BY t ROWS 2 PRECEDING)::BIGINT AS n_sum_3, sum(n) OVER (PARTITION BY k ORDER BY t ROWS 5 PRECEDING)::BIGINT AS n_sum_6, sum(n) OVER (PARTITION BY k ORDER BY t ROWS 23 PRECEDING)::BIGINT AS n_sum_24 FROM d")
def rolling_sums(spark, sf):
    return features.rolling_sums(_daily(spark, sf).drop("y"), ["k"], "t", "n", [3, 6, 24])


@query("time_features", "SELECT event_id, hour(ts)::INT AS hour, minute(ts)::INT AS minute, dayofweek(ts)::INT AS dow, dayofyear(ts)::INT AS doy, dayofweek(ts) IN (0, 6) AS is_weekend, (hour(ts) >= 7 AND hour(ts) < 10) OR (hour(ts) >= 17 AND hour(ts) < 21) AS is_peak, month(ts) BETWEEN 6 AND 9 AS is_monsoon, round(sin(2 * pi() * (hour(ts) + minute(ts) / 60.0) / 24), 4) AS hour_sin, round(cos(2 * pi() * (hour(ts) + minute(ts) / 60.0) / 24), 4) AS hour_cos, round(sin(2 * pi() * dayofweek(ts) / 7), 4) AS dow_sin, round(cos(2 * pi() * dayofweek(ts) / 7), 4) AS dow_cos FROM events")
def time_features(spark, sf):
    return rounded(features.time_features(table(spark, sf, "events").select("event_id", "ts")).drop("ts"))


@query("historical_mean", f"WITH {_DAILY}, tr AS (SELECT k, dayofweek(t) AS w, avg(y) AS p FROM d WHERE t <= TIMESTAMP '1999-12-31' GROUP BY ALL), x AS (SELECT y, p FROM d JOIN tr ON d.k = tr.k AND dayofweek(d.t) = tr.w WHERE t > TIMESTAMP '1999-12-31') SELECT count(*) AS n, round(avg(abs(p - y)), 3) AS mae, round(sqrt(avg((p - y) * (p - y))), 3) AS rmse, round(avg(CASE WHEN abs(y) + abs(p) = 0 THEN 0.0 ELSE 200 * abs(p - y) / (abs(y) + abs(p)) END), 3) AS smape, round(corr(y, p), 3) AS pearson, round(1 - sum((p - y) * (p - y)) / (var_pop(y) * count(*)), 3) AS r2 FROM x")
def historical_mean(spark, sf):
    d = _daily(spark, sf).withColumn("w", times.sunday_zero(F.col("t")))
    end = dt.datetime(1999, 12, 31)
    train, _, test = features.temporal_split(d, "t", end, end)
    return rounded(features.historical_mean(train, test, ["k", "w"], "y"), 3)


@query("persistence", f"WITH {_DAILY}, x AS (SELECT y, lag(y) OVER (PARTITION BY k ORDER BY t) AS p FROM d) SELECT count(*) AS n, round(avg(abs(p - y)), 3) AS mae, round(sqrt(avg((p - y) * (p - y))), 3) AS rmse, round(avg(CASE WHEN abs(y) + abs(p) = 0 THEN 0.0 ELSE 200 * abs(p - y) / (abs(y) + abs(p)) END), 3) AS smape, round(corr(y, p), 3) AS pearson, round(1 - sum((p - y) * (p - y)) / (var_pop(y) * count(*)), 3) AS r2 FROM x WHERE p IS NOT NULL")
def persistence(spark, sf):
    return rounded(features.persistence(_daily(spark, sf), ["k"], "t", "y"), 3)


@query("overdispersion", f"WITH {_DAILY} SELECT round(avg(n), 4) AS mean, round(var_samp(n), 4) AS variance, round(var_samp(n) / avg(n), 4) AS dispersion FROM d")
def overdispersion(spark, sf):
    return rounded(features.overdispersion(_daily(spark, sf), "n"))


@query("target_encode", "WITH d AS (SELECT o_custkey, avg(o_totalprice) AS m FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY 1), r AS (SELECT o_custkey, m, (rank() OVER (ORDER BY m) + (count(*) OVER (PARTITION BY m) - 1) / 2.0) / count(*) OVER () AS p FROM d) SELECT o.o_orderkey, o.o_custkey, round(r.m, 3) AS o_custkey_mean, round(r.p, 6) AS o_custkey_rank FROM orders o LEFT JOIN r USING (o_custkey) WHERE o_orderkey % 5 = 0")
def target_encode(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    out = features.target_encode(o.where("o_orderkey % 5 <> 0"), [o.where("o_orderkey % 5 = 0").drop("o_totalprice")], "o_custkey", "o_totalprice", order=["o_orderkey"])[0]
    return out.select("o_orderkey", "o_custkey", (F.round(F.col("o_custkey_mean") * 1000) / 1000).alias("o_custkey_mean"), F.round("o_custkey_rank", 6).alias("o_custkey_rank"))


@query("weather_merge", "WITH a AS (SELECT user_id % 15 AS g, date_trunc('hour', ts) AS t, max(value) AS x FROM events WHERE event_type = 'view' GROUP BY ALL), b AS (SELECT user_id % 15 AS g, date_trunc('hour', ts) AS t, max(value) AS x FROM events WHERE event_type = 'click' GROUP BY ALL) SELECT g, t, a.x, b.x AS x_1 FROM a FULL JOIN b USING (g, t)")
def weather_merge(spark, sf):
    e = table(spark, sf, "events").select((F.col("user_id") % 15).alias("g"), F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("t"), "event_type", "value")
    part = lambda k: e.where(F.col("event_type") == k).groupBy("g", "t").agg(F.max("value").alias("x"))
    return features.merge_groups([part("view"), part("click")], ["g", "t"])


@query("vehicle_presence", f"WITH {i.PINGS}, x AS (SELECT vehicle_id, count(DISTINCT event_type) AS n_files FROM pings GROUP BY 1) SELECT n_files, count(*) AS n_vehicles FROM x GROUP BY 1")
def vehicle_presence(spark, sf):
    return i.pings(spark, sf).groupBy("vehicle_id").agg(F.countDistinct("event_type").alias("n_files")).groupBy("n_files").agg(F.count(F.lit(1)).alias("n_vehicles"))


@query("bearing_distance", f"WITH {i.PINGS}, x AS (SELECT id, lat, lng, lag(lat) OVER w AS a, lag(lng) OVER w AS b FROM pings WINDOW w AS (PARTITION BY vehicle_id ORDER BY ts, id)) SELECT id, round(111.32 * sqrt(pow(lat - a, 2) + pow((lng - b) * cos(radians((a + lat) / 2)), 2)), 4) AS km FROM x")
def bearing_distance(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("vehicle_id").orderBy("ts", "id")
    p = i.pings(spark, sf)
    return rounded(p.select("id", geo.equirectangular_km(F.lag("lat").over(w), F.lag("lng").over(w), F.col("lat"), F.col("lng")).alias("km")))
