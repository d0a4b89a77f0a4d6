"""Hand-checked cases of the mobility operators."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tramline.functions import geo, seqs, times
from tramline.operators import clean, features, nearest, od, routes, segments, stays, telecom, trajectory, zones
from tramline.plans import bus

PING = "vehicle_id long, id long, ts timestamp_ntz, lat double, lng double, stop_id int"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def value(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_minute_boundaries_decide_segments(spark, at):
    p = spark.createDataFrame([(1, i, at(c), 0.0, 0.0, 1) for i, c in enumerate(("00:00:59", "00:21:00", "00:42:00"))], PING)
    assert [r[1] for r in rows(segments.number_segments(p), "id", "segment_id")] == [0, 1, 2]
    assert [r[1] for r in rows(segments.number_segments(p, elapsed=True), "id", "segment_id")] == [0, 1, 2]
    q = spark.createDataFrame([(1, 0, at("00:00:01"), 0.0, 0.0, 1), (1, 1, at("00:20:59"), 0.0, 0.0, 1)], PING)
    assert [r[1] for r in rows(segments.number_segments(q), "id", "segment_id")] == [0, 0]


def test_keep_first_and_jump_filter(spark, at):
    d = spark.createDataFrame([(1, 2, at("10:00:00"), 0.0, 0.0, 1), (1, 1, at("10:00:00"), 0.0, 0.0, 1)], PING)
    assert rows(clean.keep_first(d, ["vehicle_id", "ts"], ["id"]), "id") == [(1,)]
    p = spark.createDataFrame([(1, 0, at("10:00:00"), 0.0, 0.0, 1), (1, 1, at("10:01:00"), 5 / 111.195, 0.0, 1), (1, 2, at("10:02:00"), 0.1 / 111.195, 0.0, 1)], PING)
    assert rows(clean.jump_filter(p), "id") == [(0,)]


def test_stop_visits_and_headways(spark, at):
    p = spark.createDataFrame([(1, i, at(f"10:{i:02d}:00"), 0.0, 0.0, s) for i, s in enumerate((1, 1, 2, 2, 1))], PING)
    assert [r[1] for r in rows(segments.stop_visits(p, ["vehicle_id"]), "visit_group", "stop_id")] == [1, 2, 1]
    v = spark.createDataFrame([(7, at(c), k) for k, c in enumerate(("08:00:00", "08:10:00", "08:10:00", "10:20:00"))], "stop_id int, arrival timestamp_ntz, vehicle_id int")
    assert rows(segments.headways(v, ["stop_id"]), "headway_min") == [(10.0,)]


def test_bins_ends_and_days(spark, at):
    assert value(spark, times.floor_bin(F.lit(dt.datetime(2024, 1, 1, 8, 29, 59, 700000)), 30)) == dt.datetime(2024, 1, 1, 8, 0)
    assert value(spark, times.effective_day(F.lit(at("02:59:00", 2)))) == dt.date(2024, 1, 1)
    assert value(spark, times.effective_day(F.lit(at("03:00:00", 2)))) == dt.date(2024, 1, 2)
    p = spark.createDataFrame([(1, 0, at("10:00:00"), 0.0, 0.0, 7), (1, 1, at("10:00:00"), 0.0, 0.0, 3), (1, 2, at("10:09:00"), 0.0, 0.0, 3), (1, 3, at("10:09:00"), 0.0, 0.0, 7)], PING).withColumn("segment_id", F.lit(0))
    assert rows(od.segment_od(p), "origin_stop_id", "dest_stop_id") == [(3, 7)]


def test_clocks(spark):
    assert value(spark, times.clock_minutes(F.lit("25:30:00"))) == 1530
    assert value(spark, times.canonical_clock(F.lit("93005"))) is None
    assert value(spark, times.canonical_clock(F.lit("093005"))) == "09:30:05"
    assert value(spark, times.circular_minutes(F.lit(1430.0), F.lit(10.0))) == 20
    assert value(spark, times.parse_timestamp(F.lit("05/02/2024 06:07:08"))) == dt.datetime(2024, 2, 5, 6, 7, 8)


def test_idw_renormalises(spark):
    near = spark.createDataFrame([("p", "a", 1.0), ("p", "b", 2.0)], "point string, centre string, distance_km double")
    v = spark.createDataFrame([("a", 0, 10.0), ("b", 0, None)], "centre string, t int, v double")
    assert rows(nearest.idw(near, v, "point", "centre", "t", ["v"]), "v")[0][0] == pytest.approx(10)


def test_asof_takes_the_nearest_within_tolerance(spark, at):
    left = spark.createDataFrame([(1, "k", at("10:20:00")), (2, "k", at("12:01:00"))], "id int, k string, ts timestamp_ntz")
    right = spark.createDataFrame([("k", at("10:00:00"), 1.0), ("k", at("11:00:00"), 2.0)], "k string, ts timestamp_ntz, v double")
    assert rows(nearest.asof_nearest(left, right, ["k"], "ts", "id", 3600.0, ["v"]), "id", "v") == [(1, 1.0), (2, None)]


def test_ping_pong(spark, at):
    def flags(last):
        o = spark.createDataFrame([("u", i, at("10:00:00") + dt.timedelta(seconds=s), c) for i, (c, s) in enumerate((("A", 0), ("B", 100), ("A", last)))], "imsi string, id int, ts timestamp_ntz, cell_id string")
        return [r[1] for r in rows(telecom.flag_aba(o), "id", "is_ping_pong")]

    assert flags(250) == [False, True, False]
    assert flags(301) == [False, False, False]


def test_purpose(spark):
    d = spark.createDataFrame([("home", "work"), ("work", "home"), ("home", "other"), ("work", "other")], "a string, b string")
    assert [r[0] for r in d.select(telecom.purpose(F.col("a"), F.col("b"))).collect()] == ["HBW", "HBW", "HBO", "NHB"]


def test_tiers_are_right_closed(spark):
    d = spark.createDataFrame([(0.5, 0.5), (0.5, 0.500003), (0.5, 0.9), (1.0, 0.4)], "runs double, r double")
    got = features.mode_shift(d, "runs", "r", (0.0, 1.0)).orderBy("r").collect()
    assert [(r["score"], r["tier"]) for r in got] == [(0.4, "T3"), (0.5, "T3"), (0.500003, "T2"), (0.9, "T1")]


def test_sequences(spark):
    ints = lambda *x: F.array(*map(F.lit, x))
    assert value(spark, seqs.lcs_length(ints(1, 2, 3), ints(1, 3, 2, 3))) == 3
    assert value(spark, seqs.longest_rise(ints(0, 1, 0, 1, 0, 1))) == 4
    assert value(spark, seqs.monotone_share(ints(0, 1, 0, 1, 0, 1))) == pytest.approx(4 / 6)
    assert value(spark, seqs.collapse_runs(ints(1, 1, 2, 2, 1))) == [1, 2, 1]
    assert [tuple(s) for s in value(spark, seqs.parse_route(F.lit("[(142, '19:30:00'), (152,'20:00:00')]")))] == [(142, 1170.0), (152, 1200.0)]
    assert [tuple(s) for s in value(spark, seqs.parse_route(F.lit("(1,05:00:00)")))] == [(1, 300.0)]
    unwrapped = seqs.unwrap_midnight(F.array(F.lit(1430.0), F.lit(5.0), F.lit(10.0)))
    assert value(spark, unwrapped) == [1430.0, 1445.0, 1450.0]
    assert value(spark, seqs.rises(unwrapped))


def test_zero_fill_and_guard(spark):
    z = spark.createDataFrame([(1,), (2,)], "zone int")
    f = spark.createDataFrame([(1, 2, 3.0)], "origin int, destination int, flow double")
    assert rows(od.zero_fill(f, z), "origin", "destination", "flow") == [(1, 1, 0.0), (1, 2, 3.0), (2, 1, 0.0), (2, 2, 0.0)]
    with pytest.raises(ValueError):
        od.zero_fill(f, z, most=1)


def test_expansion(spark):
    t = spark.createDataFrame([("u", 3, 1.0)] * 3, "imsi string, active_days int, chain_weight double")
    got = telecom.expand(t, 3.0, 0.35).first()
    assert got["user_factor"] == 3.0
    assert got["expanded_trips"] == pytest.approx(8.571, abs=1e-3)


def test_weighted_fusion(spark, at):
    o = spark.createDataFrame([("u", at("10:00:00"), "a", "t", 10.0, 10.0, "x", 1.0), ("u", at("10:00:01"), "b", "t", 20.0, 20.0, "y", 0.5), ("u", at("10:00:02"), "c", "t", None, None, "z", 0.9)], "imsi string, ts timestamp_ntz, cell_id string, tac string, lat double, lng double, source string, confidence double")
    got = telecom.fuse_weighted(o).first()
    assert got["lat"] == pytest.approx(13.3333, abs=1e-3)
    assert got["confidence"] == pytest.approx(0.8)
    assert (got["cell_id"], got["sources"], got["n_obs"]) == ("a", "x,y,z", 3)


def test_average_rank(spark):
    d = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (4.0,), (None,)], "v double")
    assert rows(features.average_rank(d.where("v is not null"), "v", "r"), "v", "r") == [(1.0, 1.0), (2.0, 2.5), (2.0, 2.5), (4.0, 4.0)]
    assert features.average_rank(d, "v", "r").where("v is null").first()["r"] is None


def test_geometry(spark):
    corner = lambda a, b: F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lng"))
    square = F.array(corner(0.0, 0.0), corner(0.0, 1.0), corner(1.0, 1.0), corner(1.0, 0.0))
    assert value(spark, geo.point_in_polygon(F.lit(0.5), F.lit(0.5), square))
    assert not value(spark, geo.point_in_polygon(F.lit(1.5), F.lit(0.5), square))
    assert value(spark, geo.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))) == pytest.approx(111194.9, abs=1)
    assert value(spark, geo.haversine_m(F.lit(None).cast("double"), F.lit(0.0), F.lit(0.0), F.lit(1.0))) is None
    assert value(spark, geo.bearing_deg(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))) == pytest.approx(90)
    assert value(spark, geo.utm_epsg(F.lit(19.0), F.lit(72.8))) == 32643
    assert value(spark, geo.segment_distance_m(F.lit(0.001), F.lit(0.5), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))) == pytest.approx(111.32, abs=0.1)
    assert value(spark, geo.polygon_area_m2(square)) == pytest.approx(111320.0**2, rel=1e-6)
    assert value(spark, F.size(geo.circle(F.lit(0.0), F.lit(0.0), F.lit(100.0)))) == 16
    assert zones.convex_hull([(0, 0), (0, 2), (2, 2), (2, 0), (1, 1)]) == [(0, 0), (0, 2), (2, 2), (2, 0)]


def test_zone_assignment_and_edges(spark):
    z = spark.createDataFrame([(1, [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0)], 0.5, 0.5), (2, None, 5.0, 5.0)], "zone_id int, polygon array<struct<lat:double,lng:double>>, lat double, lng double")
    p = spark.createDataFrame([(1, 0.2, 0.2), (2, 4.0, 4.0), (3, None, 1.0)], "id int, lat double, lng double")
    assert rows(nearest.assign_zone(p, z, "id"), "id", "zone_id") == [(1, 1), (2, 2), (3, None)]
    e = spark.createDataFrame([("e1", 0.0, 0.0, 0.0, 0.01), ("e2", 0.01, 0.0, 0.01, 0.01)], "edge_id string, lat1 double, lng1 double, lat2 double, lng2 double")
    q = spark.createDataFrame([(1, 0.0001, 0.005), (2, 0.005, 0.005)], "id int, lat double, lng double")
    assert rows(nearest.match_edges(q, e, 50.0), "id", "edge_id") == [(1, "e1"), (2, None)]


def test_routes(spark):
    t = spark.createDataFrame([(1, [1, 2, 3, 4]), (2, [4, 3, 2, 1]), (9, [7, 8])], "template_id int, stops array<int>")
    s = spark.createDataFrame([("a", [1, 2, 4]), ("b", [4, 2, 1]), ("c", [5, 6])], "seg string, stops array<int>")
    got = {r["seg"]: (r["template_id"], r["status"]) for r in routes.infer_routes(s, t, ["seg"]).collect()}
    assert got == {"a": (1, "matched"), "b": (2, "matched"), "c": (None, "unmatched")}
    direct, transfer = routes.reachability(spark.createDataFrame([(1, [1, 2]), (2, [2, 3])], "template_id int, stops array<int>"))
    assert rows(direct, "a", "b") == [(1, 2), (2, 3)]
    assert rows(transfer, "a", "b") == [(1, 3)]


def test_stays(spark, at):
    pts = [("u", at(f"10:{m:02d}:00"), 19.0, 72.8, "c1") for m in range(0, 50, 10)] + [("u", at(f"12:{m:02d}:00"), 19.1, 72.9, "c2") for m in range(0, 50, 10)] + [("u", at(f"15:{m:02d}:00"), 19.0, 72.8, "c1") for m in range(0, 50, 10)]
    got = stays.detect_stays(spark.createDataFrame(pts, "imsi string, ts timestamp_ntz, lat double, lng double, cell_id string")).orderBy("stay_id").collect()
    assert [(r["stay_id"], r["cell_id"], r["visit_count"], r["observation_count"]) for r in got] == [("u_S001", "c1", 2, 10), ("u_S002", "c2", 1, 5)]


def test_region_growing_respects_barriers(spark):
    c = spark.createDataFrame([("x", i, 100.0, float(-i), 0 if i < 2 else 1, 0.0) for i in range(4)], "area string, cell int, population double, employment double, barrier int, z_a double")
    e = spark.createDataFrame([("x", 0, 1), ("x", 1, 2), ("x", 2, 3)], "area string, a int, b int")
    zone = dict(rows(zones.grow_regions(c, e, "area", 1000.0), "cell", "zone"))
    assert zone[0] == zone[1] != zone[2] == zone[3]


def test_paths_and_components(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 5.0), (8, 9, 1.0)], "a long, b long, cost double")
    assert rows(zones.shortest_paths(e, spark.createDataFrame([(1,)], "o long")), "node", "cost") == [(1, 0.0), (2, 1.0), (3, 2.0)]
    assert rows(zones.connected(e, spark.createDataFrame([(i,) for i in (1, 2, 3, 8, 9, 10)], "n long"), "n"), "node", "component") == [(1, 1), (2, 1), (3, 1), (8, 8), (9, 8), (10, 10)]


def test_resample_and_smooth(spark, at):
    p = spark.createDataFrame([("t", 0, at("10:00:00"), 0.0, 0.0), ("t", 1, at("10:00:04"), 4.0, 0.0)], "trip_id string, id int, ts timestamp_ntz, lat double, lng double")
    got = trajectory.resample(p, 1.0).orderBy("ts").collect()
    assert [round(r["lat"], 6) for r in got] == [0.0, 1.0, 2.0, 3.0, 4.0]
    assert [r["lat"] for r in trajectory.smooth(p).orderBy("id").collect()] == [2.0, 2.0]
    assert value(spark, trajectory.quality_score(F.lit(0.0), F.lit(1.0), F.lit(1.0), F.lit(1.0))) == pytest.approx(1.0)


def test_features_handle_constants(spark):
    d = spark.createDataFrame([(1, 2.0), (2, 2.0)], "k int, v double")
    assert rows(zones.z_scores(d, ["v"]), "z_v") == [(0.0,), (0.0,)]
    assert rows(zones.robust_z(d, "v", "z"), "z") == [(0.0,), (0.0,)]
    assert value(spark, zones.travel_time_min(F.lit(float("inf")))) == math.inf
    assert value(spark, zones.building_levels(F.lit("3,5"))) == 3
    assert value(spark, zones.building_levels(F.lit("many"))) == 2


def test_candidates_of_the_whole_catalogue(spark, monkeypatch):
    rnd = random.Random(3)
    trips = {i: [rnd.randrange(12) for _ in range(rnd.randint(1, 8))] for i in range(150)}
    rows = list(trips.items())
    segments, templates = spark.createDataFrame(rows, "trip_id long, stops array<long>"), spark.createDataFrame(rows, "template_id long, stops array<long>")
    want = set()
    for i, s in rows:
        shared = sorted((-len(set(s) & set(t)), j) for j, t in rows if set(s) & set(t))
        kept = [x for x in shared if x[0] <= -2] or shared
        want |= {(i, j, -n) for n, j in kept[:3]}
    for most in (8, 0):
        monkeypatch.setattr(routes, "SUBSET_STOPS", most)
        assert set(map(tuple, routes.candidates(segments, templates, ["trip_id"], top_n=3).collect())) == want


def test_candidates_of_long_trips_meet_by_subsets(spark, monkeypatch):
    """Trips of up to 14 distinct stops don't bring all segments of a stop to all its templates."""
    monkeypatch.setattr(routes, "stop_index", lambda _: pytest.fail("joined by stops"))
    rnd = random.Random(5)
    rows = [(i, rnd.sample(range(20), rnd.choice([1, 2, 3, 5, 14]))) for i in range(40)]
    rows += [(100 + i, s) for i, s in rows[:10]]
    segments, templates = spark.createDataFrame(rows, "trip_id long, stops array<long>"), spark.createDataFrame(rows, "template_id long, stops array<long>")
    want = set()
    for i, s in rows:
        shared = sorted((-len(set(s) & set(t)), j) for j, t in rows if set(s) & set(t))
        want |= {(i, j, -n) for n, j in ([x for x in shared if x[0] <= -2] or shared)[:4]}
    assert set(map(tuple, routes.candidates(segments, templates, ["trip_id"], top_n=4).collect())) == want


def test_few_long_trips_leave_the_others_to_subsets(spark, monkeypatch):
    """Trips of over 16 distinct stops meet the others stop by stop, which still meet each other by subsets."""
    monkeypatch.setattr(routes, "stop_index", lambda _: pytest.fail("all joined by stops"))
    rnd = random.Random(7)
    rows = [(i, rnd.sample(range(40), rnd.choice([1, 2, 3, 5]))) for i in range(40)] + [(50, list(range(18))), (3000, list(range(9, 29)))]
    rows += [(100 + i, s) for i, s in rows[:10]] + [(60, [70]), (61, [71, 72]), (62, [70, 73])]
    segments, templates = spark.createDataFrame(rows, "trip_id long, stops array<long>"), spark.createDataFrame(rows, "template_id long, stops array<long>")
    want = set()
    for i, s in rows:
        shared = sorted((-len(set(s) & set(t)), j) for j, t in rows if set(s) & set(t))
        want |= {(i, j, -n) for n, j in ([x for x in shared if x[0] <= -2] or shared)[:4]}
    assert set(map(tuple, routes.candidates(segments, templates, ["trip_id"], top_n=4).collect())) == want


def test_route_match_meets_every_template(spark, tmp_path):
    stops = {1: [1, 2, 3, 4], 70: [11, 12, 13, 14], 900: [21, 22, 23, 24], 901: [21, 22, 23, 24]}
    lines = [(k, n, p) for k, s in stops.items() for n, p in enumerate(s)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.sql("select id as o_orderkey, timestamp_ntz'2024-01-01' as o_orderdate from range(1000)").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r["trip_id"]: (r["template_id"], r["confidence"], r["status"]) for r in bus.route_match(spark, str(tmp_path)).collect()}
    assert got == {1: (1, 1.0, "matched"), 70: (70, 1.0, "matched"), 900: (900, 1.0, "matched"), 901: (900, 1.0, "matched")}
