"""Queries of the mobile-network model: fusion, ping-pong, users, stays, trips, expansion and matrices."""

from __future__ import annotations

from pyspark.sql import functions as F

from tramline.operators import od, stays, telecom
from tramline.plans import inputs as i
from tramline.plans.bus import rounded
from tramline.plans.catalogue import query
from tramline.sources.readers import table

_BUCKET = "(round_even(epoch_us(ts) / 1000000.0 / 43200.0, 0) * 43200)::BIGINT"


@query("fusion_ivw", f"WITH {i.OBS}, b AS (SELECT *, {_BUCKET} AS bucket, CASE WHEN lat IS NOT NULL THEN confidence END AS w FROM obs) SELECT imsi, bucket, round(sum(w * lat) / sum(w), 10) AS lat, round(sum(w * lng) / sum(w), 10) AS lng, round(avg(confidence), 10) AS confidence, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(*) AS n_obs, arg_max(cell_id, (confidence, -epoch_us(ts), source, cell_id)) AS cell_id FROM b GROUP BY imsi, bucket")
def fusion_ivw(spark, sf):
    return rounded(telecom.fuse_weighted(i.observations(spark, sf), 43200).select("imsi", "bucket", "lat", "lng", "confidence", "sources", "n_obs", "cell_id"), 10)


@query("fusion_priority", f"WITH {i.OBS} SELECT id, imsi, {_BUCKET} AS bucket, source FROM obs QUALIFY row_number() OVER (PARTITION BY imsi, {_BUCKET} ORDER BY confidence DESC, ts, id) = 1")
def fusion_priority(spark, sf):
    return telecom.fuse_first(i.observations(spark, sf), [F.desc("confidence"), "ts", "id"], 43200).select("id", "imsi", "bucket", "source")


@query("fusion_recent", f"WITH {i.OBS} SELECT id, imsi, {_BUCKET} AS bucket, source FROM obs QUALIFY row_number() OVER (PARTITION BY imsi, {_BUCKET} ORDER BY ts DESC, id DESC) = 1")
def fusion_recent(spark, sf):
    return telecom.fuse_first(i.observations(spark, sf), [F.desc("ts"), F.desc("id")], 43200).select("id", "imsi", "bucket", "source")


_UNIT = "greatest(0.0, least(1.0, ({0} + {1}) / {2}))"


@query("signal_confidence", f"SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN '5g' ELSE '4g' END AS source, round((CASE WHEN event_id % 2 = 0 THEN 0.8 ELSE 0.75 END) * (0.7 + 0.3 * (0.5 * {_UNIT.format('-40.0 - value', 140.0, 96.0)} + 0.3 * {_UNIT.format('-value / 5', 20.0, 17.0)} + 0.2 * {_UNIT.format('value / 3', 20.0, 50.0)})), 12) AS confidence FROM events")
def signal_confidence(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("user_id").alias("imsi"), "ts", F.col("event_type").alias("cell_id"), F.col("event_id").cast("string").alias("tac"), F.lit(None).alias("lat"), F.lit(None).alias("lng"), (F.lit(-40.0) - F.col("value")).alias("rsrp"), (-F.col("value") / 5).alias("rsrq"), (F.col("value") / 3).alias("sinr"))
    both = telecom.union_sources(telecom.from_radio(e.where("event_id % 2 = 0"), "nr"), telecom.from_radio(e.where("event_id % 2 = 1"), "lte"))
    return rounded(both.select(F.col("tac").cast("long").alias("id"), "source", "confidence"), 12)


@query("ping_pong_aba", f"WITH {i.OBS}, x AS (SELECT *, lag(cell_id) OVER w AS a, lead(cell_id) OVER w AS b, (epoch_us(lead(ts) OVER w) - epoch_us(lag(ts) OVER w)) / 1000000.0 AS s FROM obs WINDOW w AS (PARTITION BY imsi ORDER BY ts, id)) SELECT id, coalesce(a = b AND cell_id <> a AND s <= 36000, false) AS is_ping_pong FROM x")
def ping_pong_aba(spark, sf):
    return telecom.flag_aba(i.observations(spark, sf), 36000.0).select("id", "is_ping_pong")


_HOP = i.HAVERSINE.format("lag(lat) OVER w", "lag(lng) OVER w", "lat", "lng")


@query("ping_pong_velocity", f"WITH {i.OBS}, x AS (SELECT id, imsi, source, {_HOP} AS m, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1000000.0 AS s FROM obs WHERE lat IS NOT NULL WINDOW w AS (PARTITION BY imsi ORDER BY ts, id)) SELECT id, imsi FROM x WHERE NOT coalesce(s >= 5 AND m / s > CASE WHEN source LIKE '%gps%' THEN 0.5 ELSE 2.0 END, false)")
def ping_pong_velocity(spark, sf):
    o = i.observations(spark, sf).where("lat is not null")
    return telecom.drop_flagged(telecom.flag_velocity(o, 0.5, 2.0)).select("id", "imsi")


@query("user_summary", f"WITH {i.OBS} SELECT imsi, count(*) AS n_records, min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT cell_id) AS n_cells, count(lat) AS n_located, count(DISTINCT ts::DATE) AS active_days, (max(ts)::DATE - min(ts)::DATE + 1)::INT AS span_days, round(count(*) / count(DISTINCT ts::DATE), 4) AS avg_per_day FROM obs GROUP BY imsi")
def user_summary(spark, sf):
    return rounded(telecom.user_summary(i.observations(spark, sf)))


@query("user_filter", f"WITH {i.OBS} SELECT id, imsi FROM obs WHERE imsi IN (SELECT imsi FROM obs GROUP BY imsi HAVING count(*) BETWEEN 60 AND 75 AND count(DISTINCT ts::DATE) >= 20)")
def user_filter(spark, sf):
    return telecom.keep_users(i.observations(spark, sf), 60, 75, 20).select("id", "imsi")


@query("infer_cells", f"WITH {i.OBS}, k AS (SELECT *, cell_id || '-' || tac AS c FROM obs WHERE lat IS NOT NULL) SELECT c AS cell_id, round(avg(lat), 6) AS lat, round(avg(lng), 6) AS lng, round(greatest(100.0, least(2000.0, (stddev_pop(lat) + stddev_pop(lng)) / 2 * 111320.0 * 2)), 3) AS radius_m, count(*) AS n FROM k GROUP BY c HAVING count(*) >= 3")
def infer_cells(spark, sf):
    found = telecom.infer_cells(i.observations(spark, sf).withColumn("cell_id", F.concat_ws("-", "cell_id", "tac")))
    return found.select("cell_id", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"), F.round("radius_m", 3).alias("radius_m"), "n")


@query("fill_locations", f"WITH {i.OBS}, c AS (SELECT cell_id, avg(lat) AS a, avg(lng) AS b FROM obs WHERE lat IS NOT NULL GROUP BY 1) SELECT id, round(coalesce(lat, a), 6) AS lat, round(coalesce(lng, b), 6) AS lng FROM obs LEFT JOIN c USING (cell_id)")
def fill_locations(spark, sf):
    o = i.observations(spark, sf)
    return rounded(telecom.fill_locations(o, telecom.infer_cells(o)).select("id", "lat", "lng"), 6)


@query("tac_zones", f"WITH {i.OBS} SELECT tac, round(min(lat), 7) AS lat_min, round(max(lat), 7) AS lat_max, round(min(lng), 7) AS lng_min, round(max(lng), 7) AS lng_max, round(avg(lat), 7) AS lat, round(avg(lng), 7) AS lng, count(*) AS n FROM obs WHERE lat IS NOT NULL GROUP BY tac")
def tac_zones(spark, sf):
    return rounded(telecom.tac_zones(i.observations(spark, sf)), 7)


_STAYS = i.OBS + """, st AS (SELECT imsi, cell_id AS stay_id, count(*)::INT AS observation_count, count(DISTINCT ts::DATE)::INT AS visit_count, (sum(confidence) / 2) AS duration_hours, avg(lat) AS lat, avg(lng) AS lng, min(ts) AS first_seen, max(ts) AS last_seen FROM obs GROUP BY 1, 2),
h AS (SELECT *, row_number() OVER (PARTITION BY imsi ORDER BY round(0.5 * least(1.0, duration_hours / 8) + 0.3 * least(1.0, visit_count / 3.0) + 0.2 * least(1.0, ln(1 + observation_count) / ln(101)), 9) DESC, observation_count DESC, stay_id) AS hn FROM st)"""


def _stays(spark, sf):
    o = i.observations(spark, sf)
    return o.groupBy("imsi", F.col("cell_id").alias("stay_id")).agg(
        F.count(F.lit(1)).cast("int").alias("observation_count"), F.countDistinct(F.to_date("ts")).cast("int").alias("visit_count"), F.round(F.sum("confidence") / 2, 6).alias("duration_hours"), F.avg("lat").alias("lat"), F.avg("lng").alias("lng"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen")
    )


_HOME = "least(1.0, duration_hours / 8) * 0.5 + 0.3 * least(1.0, visit_count / 3.0) + 0.2 * least(1.0, ln(1 + observation_count) / ln(101))"
_FAR = i.HAVERSINE.format("(max(lat) FILTER (hn = 1) OVER (PARTITION BY imsi))", "(max(lng) FILTER (hn = 1) OVER (PARTITION BY imsi))", "lat", "lng")


@query("home_work", f"WITH {i.OBS}, st AS (SELECT imsi, cell_id AS stay_id, count(*)::INT AS observation_count, count(DISTINCT ts::DATE)::INT AS visit_count, round(sum(confidence) / 2, 6) AS duration_hours, avg(lat) AS lat, avg(lng) AS lng FROM obs GROUP BY 1, 2), h AS (SELECT *, row_number() OVER (PARTITION BY imsi ORDER BY {_HOME} DESC, observation_count DESC, stay_id) AS hn FROM st), f AS (SELECT *, hn > 1 AND visit_count >= 3 AND coalesce({_FAR} >= 500, true) AS able FROM h), w AS (SELECT *, row_number() OVER (PARTITION BY imsi ORDER BY able DESC, 0.6 * visit_count + 0.4 * ln(1 + duration_hours) DESC, observation_count DESC, stay_id) AS wn FROM f) SELECT imsi, stay_id, visit_count, observation_count, CASE WHEN hn = 1 THEN 'home' WHEN able AND wn = 1 THEN 'work' ELSE 'other' END AS stay_type FROM w")
def home_work(spark, sf):
    """Home and work among cells seen by each user."""
    return telecom.label_home_work(_stays(spark, sf), 3, 500.0).select("imsi", "stay_id", "visit_count", "observation_count", "stay_type")


@query("trips_from_stays", f"WITH {_STAYS}, x AS (SELECT imsi, stay_id AS origin, lead(stay_id) OVER w AS destination, last_seen AS departure, lead(first_seen) OVER w AS arrival FROM st WINDOW w AS (PARTITION BY imsi ORDER BY first_seen, stay_id)) SELECT imsi, origin, destination, departure, arrival FROM x WHERE destination IS NOT NULL")
def trips_from_stays(spark, sf):
    s = _stays(spark, sf).withColumn("stay_type", F.lit("other"))
    return telecom.trips_from_stays(s).select("imsi", "origin", "destination", "departure", "arrival")


_KIND = "CASE cell_id WHEN 'view' THEN 'home' WHEN 'click' THEN 'work' ELSE 'other' END"
_TRIPS = i.OBS + f""", k AS (SELECT *, {_KIND} AS kind, (ts - INTERVAL 3 HOUR)::DATE AS effective_day FROM obs),
m AS (SELECT imsi, effective_day, id, lag(cell_id) OVER w AS origin, cell_id AS destination, lag(ts) OVER w AS departure, ts AS arrival, lag(kind) OVER w AS origin_type, kind AS dest_type FROM k WINDOW w AS (PARTITION BY imsi, effective_day ORDER BY ts, id)),
t AS (SELECT *, row_number() OVER (PARTITION BY imsi ORDER BY arrival, id)::INT AS trip_no, (epoch_us(arrival) - epoch_us(departure)) / 60000000.0 AS duration_min,
  CASE WHEN 'home' IN (origin_type, dest_type) AND 'work' IN (origin_type, dest_type) THEN 'HBW' WHEN 'home' IN (origin_type, dest_type) THEN 'HBO' ELSE 'NHB' END AS purpose,
  CASE WHEN hour(departure) >= 7 AND hour(departure) < 10 THEN 'AM_PEAK' WHEN hour(departure) >= 10 AND hour(departure) < 16 THEN 'MIDDAY' WHEN hour(departure) >= 16 AND hour(departure) < 19 THEN 'PM_PEAK' WHEN hour(departure) >= 19 AND hour(departure) < 22 THEN 'EVENING' ELSE 'NIGHT' END AS period,
  CASE dayofweek(departure) WHEN 6 THEN 'SATURDAY' WHEN 0 THEN 'SUNDAY' ELSE 'WEEKDAY' END AS day_type FROM m WHERE origin IS NOT NULL AND origin <> destination)"""


def _trips(spark, sf):
    o = i.observations(spark, sf)
    kind = F.when(F.col("cell_id") == "view", "home").when(F.col("cell_id") == "click", "work").otherwise("other")
    return telecom.trips_from_observations(o.withColumn("kind", kind), "cell_id", "kind")


@query("trips_from_obs", f"WITH {_TRIPS} SELECT imsi, effective_day, trip_no, origin, destination, departure, arrival, round(duration_min, 9) AS duration_min, purpose, period, day_type FROM t")
def trips_from_obs(spark, sf):
    return rounded(_trips(spark, sf).select("imsi", "effective_day", "trip_no", "origin", "destination", "departure", "arrival", "duration_min", "purpose", "period", "day_type"), 9)


@query("plausible_trips", f"WITH {_TRIPS} SELECT imsi, trip_no FROM t WHERE duration_min <= 240")
def plausible_trips(spark, sf):
    return telecom.plausible_trips(_trips(spark, sf).withColumn("distance_m", F.lit(1000.0))).select("imsi", "trip_no")


_CHAINS = _TRIPS + """, c AS (SELECT *, coalesce(lag(destination) OVER (PARTITION BY imsi, effective_day ORDER BY trip_no) = origin, true) AS joint FROM t),
chains AS (SELECT *, dense_rank() OVER (PARTITION BY imsi ORDER BY effective_day)::INT AS chain_id, count(*) OVER w AS chain_length, bool_and(joint) OVER w AS is_continuous,
  bool_and(joint) OVER w AND first(origin_type ORDER BY trip_no) OVER w = 'home' AND last(dest_type ORDER BY trip_no) OVER w = 'home' AS is_valid FROM c WINDOW w AS (PARTITION BY imsi, effective_day))"""


@query("activity_chains", f"WITH {_CHAINS} SELECT imsi, trip_no, chain_id, chain_length, is_continuous, is_valid, CASE WHEN is_valid THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END AS chain_weight FROM chains")
def activity_chains(spark, sf):
    return telecom.chain_weights(telecom.activity_chains(_trips(spark, sf))).select("imsi", "trip_no", "chain_id", "chain_length", "is_continuous", "is_valid", "chain_weight")


@query("trip_table", f"WITH {_TRIPS} SELECT purpose, period, count(*) AS n_trips, round(avg(duration_min), 6) AS mean_duration_min FROM t GROUP BY ALL")
def trip_table(spark, sf):
    return rounded(_trips(spark, sf).groupBy("purpose", "period").agg(F.count(F.lit(1)).alias("n_trips"), F.avg("duration_min").alias("mean_duration_min")), 6)


_EXPANDED = _CHAINS + """, d AS (SELECT imsi, count(DISTINCT ts::DATE) AS active_days FROM obs GROUP BY 1),
x AS (SELECT *, 3.0 * active_days / count(*) OVER (PARTITION BY imsi) AS user_factor FROM chains JOIN d USING (imsi)),
ex AS (SELECT *, user_factor / 0.35 * CASE WHEN is_valid THEN 1.0 ELSE 0.7 END AS expanded_trips FROM x)"""


def _expanded(spark, sf):
    days = telecom.user_summary(i.observations(spark, sf)).select("imsi", "active_days")
    return telecom.expand(telecom.chain_weights(telecom.activity_chains(_trips(spark, sf))).join(days, "imsi"))


@query("expand_trips", f"WITH {_EXPANDED} SELECT imsi, trip_no, round(user_factor, 7) AS user_factor, round(expanded_trips, 7) AS expanded_trips FROM ex")
def expand_trips(spark, sf):
    return rounded(_expanded(spark, sf).select("imsi", "trip_no", "user_factor", "expanded_trips"), 7)


@query("calibrate_trips", f"WITH {_EXPANDED}, t1 AS (SELECT sum(expanded_trips) AS s FROM ex) SELECT imsi, round(sum(expanded_trips * 3.0 * 1000 * 30 / s), 4) AS trips FROM ex, t1 GROUP BY imsi")
def calibrate_trips(spark, sf):
    return rounded(telecom.calibrate(_expanded(spark, sf), 1000, 30).groupBy("imsi").agg(F.sum("expanded_trips").alias("trips")))


@query("od_by_purpose", f"WITH {_EXPANDED} SELECT origin, destination, purpose, period, count(*) AS observed_trips, round(round(sum(expanded_trips), 2), 1) AS flow FROM ex GROUP BY ALL")
def od_by_purpose(spark, sf):
    return rounded(od.od_matrix(_expanded(spark, sf), "origin", "destination", "expanded_trips", ["purpose", "period"]).select("origin", "destination", "purpose", "period", "observed_trips", "flow"), 1)


@query("od_matrix", f"WITH {i.FLOWS} SELECT origin, destination, year, flow, n FROM flows")
def od_matrix(spark, sf):
    m = od.od_matrix(i.shipments(spark, sf).withColumn("year", F.year("o_orderdate")), "c_nationkey", "s_nationkey", "l_quantity", ["year"])
    return m.withColumnRenamed("observed_trips", "n")


@query("od_zero_fill", f"WITH {i.FLOWS}, s AS (SELECT origin, destination, sum(flow) AS flow FROM flows WHERE year = 1998 GROUP BY ALL) SELECT a.n_nationkey AS origin, b.n_nationkey AS destination, coalesce(flow, 0)::DOUBLE AS flow FROM nation a CROSS JOIN nation b LEFT JOIN s ON s.origin = a.n_nationkey AND s.destination = b.n_nationkey")
def od_zero_fill(spark, sf):
    zones = table(spark, sf, "nation").select(F.col("n_nationkey").alias("zone"))
    return od.zero_fill(i.flows(spark, sf).where("year = 1998"), zones)


@query("od_compare", f"WITH {i.FLOWS}, a AS (SELECT origin, destination, flow AS x FROM flows WHERE year = 1997), b AS (SELECT origin, destination, flow AS y FROM flows WHERE year = 1998), j AS (SELECT a.x IS NOT NULL AS i, b.y IS NOT NULL AS k, coalesce(x, 0) AS x, coalesce(y, 0) AS y FROM a FULL JOIN b USING (origin, destination)) SELECT count(*) AS n_pairs, count(*) FILTER (i AND k) AS n_common, sum(x) AS total_a, sum(y) AS total_b, round(corr(x, y), 6) AS correlation, round(sqrt(avg((x - y) * (x - y))), 6) AS rmse, round(avg(abs(x - y)), 6) AS mae FROM j")
def od_compare(spark, sf):
    f = i.flows(spark, sf)
    return rounded(od.compare(f.where("year = 1997"), f.where("year = 1998")), 6)


@query("od_intra_zone", f"WITH {i.FLOWS}, s AS (SELECT origin, destination, sum(flow) AS flow FROM flows GROUP BY ALL), o AS (SELECT *, sum(CASE WHEN origin <> destination THEN flow ELSE 0 END) OVER (PARTITION BY origin) * (0.3 / 0.7) AS want FROM s) SELECT origin, destination, round(CASE WHEN origin <> destination THEN flow WHEN flow > 0 THEN least(want, flow * 5) ELSE want END, 6) AS flow FROM o")
def od_intra_zone(spark, sf):
    s = i.flows(spark, sf).groupBy("origin", "destination").agg(F.sum("flow").alias("flow"))
    return rounded(od.intra_zone(s), 6)


@query("od_summary", f"WITH {i.FLOWS} SELECT count(*) AS n_pairs, sum(flow) AS total_flow, round(avg(flow), 6) AS mean_flow, median(flow) AS median_flow, max(flow) AS max_flow, min(flow) FILTER (flow > 0) AS min_nonzero_flow, count(DISTINCT origin) AS n_origins, count(DISTINCT destination) AS n_destinations FROM flows")
def od_summary(spark, sf):
    return rounded(od.summary(i.flows(spark, sf)), 6)


@query("od_top_pairs", f"WITH {i.FLOWS} SELECT origin, destination, sum(flow) AS flow FROM flows GROUP BY ALL ORDER BY flow DESC, origin, destination LIMIT 5")
def od_top_pairs(spark, sf):
    return od.top_pairs(i.flows(spark, sf))


@query("net_flow", f"WITH {i.FLOWS}, x AS (SELECT origin AS zone, flow AS d, 0 AS a FROM flows UNION ALL SELECT destination, 0, flow FROM flows) SELECT zone, sum(d)::DOUBLE AS departures, sum(a)::DOUBLE AS arrivals, (sum(a) - sum(d))::DOUBLE AS net_flow FROM x GROUP BY zone")
def net_flow(spark, sf):
    return od.net_flow(i.flows(spark, sf))


@query("stay_points")
def stay_points(spark, sf):
    """Stays of each user from a sequential scan."""
    return rounded(stays.detect_stays(i.observations(spark, sf), 5000.0, 60.0, 3000.0), 6)


@query("assign_to_stays")
def assign_to_stays(spark, sf):
    """Observations with the stay they belong to."""
    o = i.observations(spark, sf)
    return stays.assign_to_stays(o, stays.detect_stays(o, 5000.0, 60.0, 3000.0)).select("id", "imsi", "stay_id")
