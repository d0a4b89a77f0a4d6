"""Operators that SQL doesn't express, against plain Python."""

import collections
import datetime as dt
import http.server
import itertools
import math
import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from tramline.functions import geo, seqs
from tramline.operators import nearest, pipelines, population, quantiles, routes, shapes, stays, trajectory, zones
from tramline.sources import http as web


def metres(a, b):
    lat1, lng1, lat2, lng2 = map(math.radians, (*a, *b))
    h = math.sin((lat2 - lat1) / 2) ** 2 + math.cos(lat1) * math.cos(lat2) * math.sin((lng2 - lng1) / 2) ** 2
    return 2 * 6_371_000 * math.asin(math.sqrt(h))


def lcs(a, b):
    best = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b, 1):
            row.append(best[j - 1] + 1 if x == y else max(best[j], row[-1]))
        best = row
    return best[-1]


def test_common_subsequences(spark):
    rnd = random.Random(1)
    rows = [(i, [rnd.randrange(6) for _ in range(rnd.randrange(9))], [rnd.randrange(6) for _ in range(rnd.choice((0, 1, 5, 61, 62, 63, 70)))]) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, a array<int>, b array<int>")
    got = {r["i"]: r["n"] for r in df.select("i", seqs.lcs_length(F.col("a"), F.col("b")).alias("n")).collect()}
    assert got == {i: lcs(a, b) for i, a, b in rows}


def test_route_match(spark):
    """The best template by overlap, order, direction, endpoints and jaccard in turn, among all templates."""
    rnd = random.Random(2)
    routes_ = [(t, rnd.sample(range(14), rnd.randint(3, 7))) for t in range(40)]
    trips = [(i, rnd.sample(range(16), rnd.randint(2, 6))) for i in range(80)]
    s = spark.createDataFrame(trips, "trip_id int, stops array<int>")
    t = spark.createDataFrame(routes_, "template_id int, stops array<int>")
    got = {r["trip_id"]: (r["template_id"], r["status"]) for r in routes.infer_routes(s, t, ["trip_id"], top_n=100).collect()}

    def rise(v):
        best = [1 + max([0] + [0]) for _ in v]
        for j in range(len(v)):
            best[j] = 1 + max([best[k] for k in range(j) if v[k] <= v[j]], default=0)
        return max(best, default=0)

    for i, a in trips:
        scored = []
        most = max((len(set(a) & set(b)) for _, b in routes_), default=0)
        for k, b in routes_:
            shared = len(set(a) & set(b))
            if not shared or (shared < 2 and most >= 2):
                continue
            places = [b.index(x) for x in a if x in b]
            direction = 0.5 if len(places) < 2 else rise(places) / len(places)
            near = lambda x, end: 0.0 if x not in b else 1 - abs(b.index(x) - end) / max(1, len(b) - 1)  # noqa: B023, E731
            ends = (near(a[0], 0) + near(a[-1], len(b) - 1)) / 2
            order = lcs(a, b) / len(a)
            scored.append((-shared / len(set(a)), -order, -direction, -ends, -shared / len(set(a) | set(b)), k, min(shared / len(set(a)), order, direction)))
        if not scored:
            assert got[i] == (None, "unmatched")
            continue
        best = min(scored)
        assert got[i] == (best[5], "below_threshold" if best[6] < 0.2 else "matched")


def test_exact_quantiles(spark):
    rnd = random.Random(3)
    values = [rnd.choice((1.0, 2.5, rnd.gauss(0, 9))) for _ in range(700)] + [None] * 9
    df = spark.createDataFrame([(v,) for v in values], "v double")
    shares = [0.0, 0.1, 0.25, 0.5, 0.95, 1.0]
    assert quantiles.exact_quantiles(df, "v", shares) == pytest.approx(list(np.quantile([v for v in values if v is not None], shares)))
    assert quantiles.exact_quantiles(df.where("v is null"), "v", shares) is None


def test_paths_of_large_networks(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(60), rnd.randrange(60), float(rnd.randint(1, 9))) for _ in range(70)]
    e = spark.createDataFrame(edges, "a int, b int, cost double")
    best = {(i, j): 0.0 if i == j else math.inf for i in range(60) for j in range(60)}
    for a, b, c in edges:
        best[a, b] = best[b, a] = min(best[a, b], c)
    for k, i, j in itertools.product(range(60), repeat=3):
        best[i, j] = min(best[i, j], best[i, k] + best[k, j])
    starts = spark.createDataFrame([(i,) for i in range(0, 60, 7)], "a int")
    want = {(i, j): c for (i, j), c in best.items() if i % 7 == 0 and c < math.inf}
    for small in (1_000, 3):
        assert {(r[0], r[1]): r[2] for r in zones.shortest_paths(e, starts, small).collect() if (r[0], r[1]) in want or small == 3} .items() <= (want | {(i, i): 0.0 for i in range(60)}).items()
        assert {(r[0], r[1]) for r in zones.shortest_paths(e, starts, small).collect()} >= set(want) - {(i, i) for i in range(60)}


def test_nearest_around_the_clock(spark):
    rnd = random.Random(5)
    left = [(i, i % 3, float(rnd.randrange(1440))) for i in range(80)] + [(999, 0, None)]
    right = [(1000 + i, i % 3, float(rnd.randrange(1440))) for i in range(60)]
    a, b = spark.createDataFrame(left, "id int, k int, m double"), spark.createDataFrame(right, "trip int, k int, rm double")
    for window in (45.0, 700.0):
        got = {r["id"]: (r["trip"], r["delta_min"]) for r in nearest.band_nearest(a, b, ["k"], "m", "rm", "id", window, "trip").collect()}
        around = lambda x, y: min(abs(x - y), 1440 - abs(x - y))
        for i, k, m in left:
            found = min(((around(m, n), t) for t, g, n in right if g == k and around(m, n) <= window), default=None) if m is not None else None
            assert got[i] == ((found[1], found[0]) if found else (None, None))


def test_hexagons(spark):
    """A place lies in the hexagon with the nearest centre, and inside its polygon."""
    rnd = random.Random(6)
    places = [(i, rnd.uniform(18.9, 19.3), rnd.uniform(72.7, 73.1)) for i in range(200)] + [(999, None, 73.0)]
    df = spark.createDataFrame(places, "i int, lat double, lng double")
    cell = shapes.hex_cell(F.col("lat"), F.col("lng"), 8, 19.0)
    out = df.withColumn("c", cell).withColumn("p", shapes.hex_polygon(F.col("c"), 8, 19.0)).withColumn("inside", geo.point_in_polygon(F.col("lat"), F.col("lng"), F.col("p"))).collect()
    assert all(r["inside"] for r in out if r["i"] < 999) and [r["c"] for r in out if r["i"] == 999] == [None]
    assert shapes.hex_resolution(5500) == 8 and shapes.hex_resolution(200_000) == 6


def test_cut_polygons(spark):
    """Parts of a cut zone sum to it, and lie on either side."""
    square = [{"lat": 0.0, "lng": 0.0}, {"lat": 0.0, "lng": 1.0}, {"lat": 1.0, "lng": 1.0}, {"lat": 1.0, "lng": 0.0}]
    z = spark.createDataFrame([(1, square), (2, [{"lat": p["lat"] + 3, "lng": p["lng"]} for p in square])], "zone_id int, polygon array<struct<lat:double,lng:double>>")
    b = spark.createDataFrame([(1, 0.25, -1.0, 0.25, 0.5), (2, -1.0, 0.5, 0.1, 0.5), (3, 1.2, 0.0, 1.2, 1.0)], "edge_id int, lat1 double, lng1 double, lat2 double, lng2 double")
    out = shapes.split_zones(z, b, sliver=0.0).collect()
    area = {r["zone_id"]: sum(x["area_km2"] for x in out if x["zone_id"] == r["zone_id"]) for r in out}
    assert collections.Counter((r["zone_id"], r["split"]) for r in out) == {(1, True): 4, (2, False): 1}
    whole = z.select("zone_id", (geo.polygon_area_m2(F.col("polygon")) / 1e6).alias("a")).collect()
    assert all(area[r["zone_id"]] == pytest.approx(r["a"], rel=1e-3) for r in whole)


def test_stays_of_sparse_users(spark, at):
    """Users without any stay have one at each cell."""
    rows = [("u", at("08:00"), 19.0, 73.0, "a"), ("u", at("08:05"), 19.5, 73.0, "b"), ("u", at("08:10"), 20.0, 73.0, "c"), ("v", at("08:00"), 19.0, 73.0, None), ("v", at("08:05"), 19.9, 73.0, None)]
    obs = spark.createDataFrame(rows, "imsi string, ts timestamp_ntz, lat double, lng double, cell_id string")
    got = sorted((r["imsi"], r["cell_id"], r["visit_count"]) for r in stays.detect_stays(obs, min_visits=2).collect())
    assert got == [("u", "a", 2), ("u", "b", 2), ("u", "c", 2), ("v", None, 2)]


def test_records_meet_stays(spark):
    rnd = random.Random(7)
    places = [("u", f"u_S{k}", f"c{k}" if k % 2 else None, 19 + k * 0.004, 73.0) for k in range(6)]
    obs = [(i, "u", f"c{rnd.randrange(9)}" if i % 3 else None, 19 + rnd.random() * 0.04, 73.0) for i in range(40)]
    got = {r["id"]: r["stay_id"] for r in stays.assign_to_stays(spark.createDataFrame(obs, "id int, imsi string, cell_id string, lat double, lng double"), spark.createDataFrame(places, "imsi string, stay_id string, cell_id string, lat double, lng double")).collect()}
    for i, _, cell, lat, lng in obs:
        same = sorted(p[1] for p in places if cell is not None and p[2] == cell)
        near = min(((metres((lat, lng), p[3:]), p[1]) for p in places if metres((lat, lng), p[3:]) <= 1000), default=(0, None))[1]
        assert got[i] == (same[0] if same else near)


def test_count_model(spark):
    rnd = np.random.default_rng(8)
    x = rnd.normal(size=(400, 2))
    mu = np.exp(0.5 + x @ [0.4, -0.3])
    y = rnd.poisson(mu * rnd.gamma(1.0, 1.0, 400))
    df = spark.createDataFrame([(int(k), float(a), float(b)) for k, (a, b) in zip(y, x)] + [(1, None, 0.0)], "y int, a double, b double")
    m = population.negative_binomial(df, "y", ["a", "b"])
    z, b = np.c_[np.ones(400), x], np.array([np.log(y.mean()), 0, 0])
    for _ in range(100):
        u = np.exp(z @ b)
        w = u / (1 + u)
        b = np.linalg.solve((z * w[:, None]).T @ z, (z * w[:, None]).T @ (z @ b + (y - u) / u))
    u = np.exp(z @ b)
    ll = lambda u: float((y * np.log(u / (1 + u)) - np.log(1 + u)).sum())
    assert m.coefficients == pytest.approx(list(b), abs=1e-6)
    assert m.stats["log_likelihood"] == pytest.approx(ll(u)) and m.stats["aic"] == pytest.approx(6 - 2 * ll(u)) and m.stats["bic"] == pytest.approx(3 * math.log(400) - 2 * ll(u))
    dev = 2 * (np.where(y > 0, y * np.log(np.maximum(y, 1e-300) / u), 0) - (y + 1) * np.log((1 + y) / (1 + u))).sum()
    assert m.stats["deviance"] == pytest.approx(float(dev)) and m.stats["pseudo_r2"] == pytest.approx(1 - ll(u) / ll(np.full(400, y.mean())))


def test_handovers(spark, at):
    track = [("t", i, at("08:00") + dt.timedelta(seconds=20 * i), 19.0 + 0.001 * i, 73.0) for i in range(30)]
    towers = [(1, 19.0, 73.0), (2, 19.01, 73.0), (3, 19.025, 73.0)]
    got = [(r["ts"], r["from_tower"], r["tower_id"]) for r in trajectory.handovers(spark.createDataFrame(track, "trip_id string, id int, ts timestamp_ntz, lat double, lng double"), spark.createDataFrame(towers, "tower_id int, lat double, lng double")).orderBy("ts").collect()]
    want, last = [], None
    for k in range(0, 29 * 20 + 1, 30):
        when = at("08:00") + dt.timedelta(seconds=k)
        p = min(track, key=lambda r: (abs((r[2] - when).total_seconds()), r[2]))
        tower = min(towers, key=lambda t: (metres(t[1:], p[3:]), t[0]))[0]
        if last is not None and tower != last:
            want.append((when, last, tower))
        last = tower
    assert got == want and len(want) == 2


def test_fit_margins(spark):
    rnd = np.random.default_rng(9)
    seed = rnd.integers(1, 9, (4, 5)).astype(float)
    rows, cols = np.array([10.0, 20, 30, 40]), np.array([15.0, 25, 20, 30, 10])
    want = seed.copy()
    for _ in range(20):
        want *= (rows / want.sum(1))[:, None]
        want *= cols / want.sum(0)
    s = spark.createDataFrame([(i, j, float(seed[i, j])) for i in range(4) for j in range(5)], "origin int, destination int, flow double")
    got = population.fit_margins(s, spark.createDataFrame(list(enumerate(map(float, rows))), "origin int, total double"), spark.createDataFrame(list(enumerate(map(float, cols))), "destination int, total double")).collect()
    assert all(r["flow"] == pytest.approx(want[r["origin"], r["destination"]]) for r in got) and len(got) == 20


def test_steps_of_demand(spark, at):
    obs = spark.createDataFrame([], "imsi string, ts timestamp_ntz, cell_id string, tac string, lat double, lng double, source string, confidence double")
    out = pipelines.telecom_demand([obs], ("fuse", "preprocess"))
    assert set(out) == {"fused", "users", "records"} and out["records"].count() == 0
    with pytest.raises(ValueError):
        pipelines.telecom_demand([obs], ("fly",))


def test_http(spark):
    """Answers after failures, and rows from a local server."""
    seen = collections.Counter()

    class Handler(http.server.BaseHTTPRequestHandler):
        def answer(self):
            seen[self.path] += 1
            n = int(self.headers.get("Content-Length") or 0)
            body = self.rfile.read(n)
            code = 404 if self.path == "/no" else 503 if self.path == "/busy" and seen[self.path] < 3 else 200
            self.send_response(code)
            self.end_headers()
            self.wfile.write(self.path.encode() + body)

        do_GET = do_POST = answer

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    waits = []
    assert web.ask(f"{base}/busy", sleep=waits.append) == (200, "/busy") and waits == [1.0, 2.0]
    assert web.ask(f"{base}/no", sleep=waits.append)[0] == 404 and seen["/no"] == 1
    rows = spark.createDataFrame([(f"{base}/a", None), (f"{base}/b", web.request_body(y=1, x=2))], "url string, body string")
    assert sorted((r["status"], r["text"]) for r in web.fetch(rows).collect()) == [(200, "/a"), (200, '/b{"x": 2, "y": 1}')]
    server.shutdown()
