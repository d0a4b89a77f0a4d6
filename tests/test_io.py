"""Readers, writers and streams on small files."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tramline.sources import readers, writers
from tramline.streaming import windows


def test_pings_csv(spark, tmp_path):
    lines = ["1,19.0,72.8,x,7,2024-01-01 10:00:00.500+0000,30.5,0,1,a,b,12.0,c,d", "2,NULL,72.8,x,7,not a time,30.5", "3,19,72.8,x,7,2024-01-01 10:00:01Z,1,0,1,a,b,NULL,c,d,extra,extra"]
    (tmp_path / "p.csv").write_text("\n".join(lines) + "\n")
    got = readers.read_pings(spark, str(tmp_path / "p.csv")).orderBy("id").collect()
    assert [r["ts"] for r in got] == [dt.datetime(2024, 1, 1, 10, 0, 0, 500000), None, dt.datetime(2024, 1, 1, 10, 0, 1)]
    assert got[1]["lat"] is None and got[2]["deviation_s"] is None
    assert "bearing" not in got[0].asDict()


def test_trips_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text('trip_id,trip_route,trip_date\n1,"[(142, \'19:30:00\'), (152, \'19:40:00\')]",2024-01-05\n2,"[]",2024-01-05\n')
    got = readers.read_trips(spark, str(tmp_path / "t.csv")).orderBy("trip_id").collect()
    assert (got[0]["stops"], got[0]["start_min"], got[1]["stops"]) == ([142, 152], 1170.0, [])


def test_telecom_csv(spark, tmp_path):
    (tmp_path / "cdr_1.csv").write_text("IMSI,START_TIME,CELL_ID,TAC\n1,2024-01-01 10:00:00,nan,5\n")
    (tmp_path / "cdr_2.csv").write_text("IMSI,START_TIME,CELL_ID,TAC\n2,bad,9,5\n")
    (tmp_path / "xdr_1.csv").write_text("IMSI,TIMESTAMP,LOCATION_LAT\n1,2024-01-01T10:00:00,19.5\n")
    got = readers.read_all_telecom(spark, str(tmp_path))
    assert sorted(got) == ["cdr", "xdr"]
    assert sorted((r["imsi"], r["cell_id"], r["ts"]) for r in got["cdr"].collect()) == [("1", None, dt.datetime(2024, 1, 1, 10)), ("2", "9", None)]
    (tmp_path / "bad.csv").write_text("X\n1\n")
    with pytest.raises(ValueError):
        readers.read_telecom(spark, str(tmp_path / "bad.csv"), "cdr")


def test_half_months(spark):
    got = [(str(r["first"]), str(r["last"])) for r in readers.half_months(spark, "2024-01-10", "2024-02-15").orderBy("first").collect()]
    assert got == [("2024-01-10", "2024-01-15"), ("2024-01-16", "2024-01-31"), ("2024-02-01", "2024-02-15")]


def test_skim_round_trip(spark, tmp_path):
    m = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 2.0), ("a", "a", 0.0), ("b", "b", 0.0)], "origin string, destination string, distance_km double")
    writers.write_csv(writers.wide(m, "distance_km").coalesce(1), str(tmp_path / "w"))
    back = readers.read_skim(spark, str(tmp_path / "w"))
    assert sorted(map(tuple, back.select("origin", "destination", "distance_km").collect())) == sorted(map(tuple, m.collect()))


def test_geojson(spark, tmp_path):
    p = spark.createDataFrame([("a", 19.0, 72.8)], "name string, lat double, lng double")
    writers.write_features(p, writers.point_geometry(F.col("lat"), F.col("lng")), ["name"], str(tmp_path / "g"))
    line = json.loads(next(f for f in (tmp_path / "g").glob("part-*.txt") if f.stat().st_size).read_text())
    assert line == {"type": "Feature", "geometry": {"type": "Point", "coordinates": [72.8, 19.0]}, "properties": {"name": "a"}}


def test_versions(spark):
    a = spark.createDataFrame([(1, "x", 1, True)], "id int, city string, at int, is_current boolean")
    b = spark.createDataFrame([(2, "x", 2, True)], "id int, city string, at int, is_current boolean")
    assert sorted((r["id"], r["is_current"]) for r in writers.supersede(a, b, ["city"], "at").collect()) == [(1, False), (2, True)]
    assert writers.upsert_missing(a, b, ["city"]).count() == 1


def test_streams(spark, tmp_path):
    src = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 0, m), 1.0) for m in (0, 5, 40)], "k int, ts timestamp_ntz, v double")
    src.write.parquet(str(tmp_path / "events.parquet"))
    s = windows.with_clock(windows.stream_table(spark, str(tmp_path), "events"))
    got = windows.run_to_table(windows.sessions(s, "20 minutes", ["k"], [F.count(F.lit(1)).alias("n")]))
    assert sorted(r["n"] for r in got.collect()) == [1, 2]
    windows.run_to_files(windows.first_within(s, ["k"]), str(tmp_path / "out"), str(tmp_path / "check"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_database_round_trip(spark):
    """Over the database that comes with the session, in memory."""
    url = "jdbc:derby:memory:tramline;create=true"
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    try:
        writers.write_jdbc(df, url, "places", "overwrite", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    except Exception as e:  # the driver's jar is not part of every installation
        if "ClassNotFound" in str(e) or "No suitable driver" in str(e):
            pytest.skip("no database driver here")
        raise
    got = readers.jdbc(spark, url, 'select "id", "name" from places where "id" > 1', driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    assert [tuple(r) for r in got.collect()] == [(2, "b")]


def test_versions_of_one_time(spark):
    """Of two rows with the newest stamp exactly one is current, the same however they are dealt out."""
    a = spark.createDataFrame([(i, "x", 5) for i in range(9)], "id int, city string, at int")
    for n in (1, 4):
        got = writers.supersede(a.limit(0), a.repartition(n), ["city"], "at").where("is_current").collect()
        assert [r["id"] for r in got] == [8]
