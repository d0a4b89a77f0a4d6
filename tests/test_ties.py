"""Values that lie on a limit, and sums whose last digits depend on the order of rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tramline.functions import geo
from tramline.operators import features
from tramline.plans import catalogue

duckdb = pytest.importorskip("duckdb")


def against_sql(spark, tmp_path, name, rows):
    """What the query and its SQL give for events (event_id, user_id, value)."""
    at = dt.datetime(2024, 1, 7, 11, 12)
    events = spark.createDataFrame([(i, at, u, "view", v) for i, u, v in rows], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    events.write.parquet(f"{tmp_path}/events.parquet")
    db = duckdb.connect()
    db.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    return sorted(map(tuple, catalogue.queries()[name](spark, str(tmp_path)).collect())), sorted(db.sql(catalogue.oracle_sql()[name]).fetchall())


def test_zero_is_a_value(spark, tmp_path):
    got, want = against_sql(spark, tmp_path, "repair_coordinates", [(8, 1, 0.0), (10, 1, 5.0), (11, 1, 0.0), (50, 1, 0.0), (51, 1, 2.0), (52, 1, None)])
    assert got == want and (8, 0.0) in got and (52, None) in got


def test_point_on_a_side(spark, tmp_path):
    got, want = against_sql(spark, tmp_path, "zone_assignment", [(121488, 340, 0.0), (21488, 340, 0.0), (12, 10, 0.0), (15, 5, 0.0)])
    assert got == want


def test_sides_of_a_box(spark):
    square = "array(named_struct('lat', 0D, 'lng', 0D), named_struct('lat', 0D, 'lng', 1D), named_struct('lat', 1D, 'lng', 1D), named_struct('lat', 1D, 'lng', 0D))"
    points = spark.createDataFrame([(0.0, 0.5), (1.0, 0.5), (0.5, 0.0), (0.5, 1.0)], "lat double, lng double")
    found = points.select("lat", "lng", geo.point_in_polygon(F.col("lat"), F.col("lng"), F.expr(square)).alias("inside"))
    assert {(r["lat"], r["lng"]): r["inside"] for r in found.collect()} == {(0.0, 0.5): False, (1.0, 0.5): True, (0.5, 0.0): True, (0.5, 1.0): False}


def test_delays_on_a_limit(spark, tmp_path):
    """Delays of 90 minutes but for the last digits of a mean: its addition follows the ids, whatever the order of rows."""
    random.seed(3)
    rows, day = [], dt.datetime(2024, 1, 7)
    for vehicle in range(200):
        late = random.randrange(48_000, 52_000)
        others = [late - 6300 + random.randrange(-300, 300) for _ in range(5)]
        for s in [late, *others, 6 * late - sum(others) - 37_800]:
            rows.append((len(rows) * 12, day + dt.timedelta(seconds=s), vehicle, "view", 0.0))
    random.shuffle(rows)
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    events.repartition(5).write.parquet(f"{tmp_path}/events.parquet")
    db = duckdb.connect(config={"threads": 1})
    db.sql(f"create table events as select * from '{tmp_path}/events.parquet/*.parquet' order by event_id")
    got = [tuple(r) for r in catalogue.queries()["schedule_adherence"](spark, str(tmp_path)).collect()]
    assert got == db.sql(catalogue.oracle_sql()["schedule_adherence"]).fetchall() and got[0][1] < len(rows)


def test_means_in_order(spark):
    t = spark.createDataFrame([(1, 2, 0.1), (1, 1, 1e16), (1, 3, -1e16), (2, 1, None), (3, 1, None), (3, 2, 2.0), (None, 1, 4.0)], "k int, i int, y double")
    got = {r["k"]: r["m"] for r in features.mean_in_order(t, ["k"], "y", ["i"], "m").collect()}
    assert got == {1: (1e16 + 0.1 - 1e16) / 3, 2: None, 3: 2.0, None: 4.0}
    keys = spark.createDataFrame([(1,), (9,)], "k int")
    assert sorted((r["k"], r["k_mean"]) for r in features.target_encode(t.where("k = 1"), [keys], "k", "y", ["i"])[0].collect()) == [(1, 0.0), (9, None)]


def test_equal_targets_tie_in_any_order(spark, tmp_path):
    random.seed(5)
    rows = []
    for customer in range(12):
        values = random.Random(customer % 3)
        rows += [(1000 * customer + i, customer, round(values.uniform(1, 400_000), 2)) for i in range(30)]
    random.shuffle(rows)
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double")
    orders.repartition(5).write.parquet(f"{tmp_path}/orders.parquet")
    db = duckdb.connect(config={"threads": 1})
    db.sql(f"create table orders as select * from '{tmp_path}/orders.parquet/*.parquet' order by o_orderkey")
    got = sorted(map(tuple, catalogue.queries()["target_encode"](spark, str(tmp_path)).collect()))
    assert got == sorted(db.sql(catalogue.oracle_sql()["target_encode"]).fetchall()) and len({r[3] for r in got}) == 3
