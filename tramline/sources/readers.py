"""Readers: files in, DataFrames with the engine's column names out. All of them are lazy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.functions import seqs, times
from tramline.operators.clean import null_tokens
from tramline.sources import schemas


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_pings(spark: SparkSession, paths: str | list[str], fmt: str = "yyyy-MM-dd HH:mm:ss[.SSSSSS]") -> DataFrame:
    """Headerless GPS exports; short rows are padded, long ones cut, and values that don't parse become null.

    The time, whose zone is dropped as it is always UTC, becomes ts.
    """
    raw = spark.read.schema(schemas.PINGS_RAW).option("header", False).option("mode", "PERMISSIVE").option("nullValue", "NULL").csv(paths)
    clean = F.regexp_replace(F.trim("timestamp"), r"([+-]\d\d(:?\d\d)?|Z)$", "")
    return raw.withColumn("ts", F.try_to_timestamp(clean, F.lit(fmt)).cast("timestamp_ntz")).drop("created", "timestamp", "bearing", "c10", "c11", "c13", "c14")


def read_stops(spark: SparkSession, path: str, lat: tuple[float, float] = (-90.0, 90.0), lng: tuple[float, float] = (-180.0, 180.0)) -> DataFrame:
    """Stops with usable coordinates within the bounds."""
    s = spark.read.schema(schemas.STOPS).option("header", True).csv(path)
    return s.where(F.col("lat").between(*lat) & F.col("lng").between(*lng) & (F.col("lat") != 0) & (F.col("lng") != 0))


def read_trips(spark: SparkSession, path: str) -> DataFrame:
    """Trips with their route text parsed: route, stops and start_min."""
    t = spark.read.schema(schemas.TRIPS).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    t = t.withColumn("route", seqs.parse_route(F.col("trip_route"))).drop("trip_route")
    return t.withColumns({"stops": F.transform("route", lambda s: s["stop_id"]), "start_min": F.get("route", 0)["minutes"]})


def read_telecom(spark: SparkSession, paths: str | list[str], kind: str, fraction: float | None = None, seed: int = 42) -> DataFrame:
    """A mobile-network export of kind cdr, xdr, lte or nr: columns renamed, ids as text, tokens for missing values null, times parsed.

    A missing required column raises ValueError. fraction, if given, samples by seed.
    """
    raw = spark.read.option("header", True).csv(paths)
    names = schemas.TELECOM[kind]
    out = raw.withColumnsRenamed({k: v for k, v in names.items() if k in raw.columns})
    if missing := [c for c in schemas.REQUIRED[kind] if c not in out.columns]:
        raise ValueError(f"{kind} without {', '.join(missing)}")
    for c in ("imsi", "cell_id", "tac", "lac"):
        if c in out.columns:
            out = out.withColumn(c, null_tokens(F.col(c).cast("string")))
    for c in ("lat", "lng", "rsrp", "rsrq", "sinr", "duration_s"):
        if c in out.columns:
            out = out.withColumn(c, F.col(c).try_cast("double"))
    if "ts" in out.columns:
        out = out.withColumn("ts", times.parse_timestamp(F.col("ts")))
    return out.sample(fraction, seed) if fraction else out


def read_all_telecom(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All sources of a folder by kind; each reads every file named after it, and kinds without a file are left out."""
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(folder)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = {}
    for kind in schemas.TELECOM:
        pattern = f"{folder}/{kind}*.csv"
        if fs.globStatus(jvm.org.apache.hadoop.fs.Path(pattern)):
            found[kind] = read_telecom(spark, pattern, kind)
    return found


def read_gtfs_stop_times(spark: SparkSession, path: str) -> DataFrame:
    """stop_times with arrival_min and departure_min, which may pass 1440."""
    t = spark.read.schema(schemas.GTFS_STOP_TIMES).option("header", True).csv(path)
    return t.withColumns({"arrival_min": times.clock_minutes(F.col("arrival_time")), "departure_min": times.clock_minutes(F.col("departure_time"))})


def read_zones(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.ZONES).option("header", True).csv(path)


def read_towers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.TOWERS).option("header", True).csv(path)


def read_skim(spark: SparkSession, path: str, value: str = "distance_km") -> DataFrame:
    """A wide matrix (first column the origin) as (origin, destination, value)."""
    wide = spark.read.option("header", True).csv(path)
    origin = wide.columns[0]
    return wide.unpivot([origin], wide.columns[1:], "destination", value).withColumnRenamed(origin, "origin").withColumn(value, F.col(value).try_cast("double"))


def read_geojson_points(spark: SparkSession, path: str) -> DataFrame:
    """Properties and place of the point features of GeoJSON files."""
    f = spark.read.option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    return f.where("f.geometry.type = 'Point'").select("f.properties.*", F.col("f.geometry.coordinates")[1].cast("double").alias("lat"), F.col("f.geometry.coordinates")[0].cast("double").alias("lng"))


def half_months(spark: SparkSession, start: str, end: str) -> DataFrame:
    """(first, last): half-month windows that cover the dates from start to end, clipped to them."""
    months = spark.sql("select explode(sequence(date_trunc('MONTH', cast(:a as date)), cast(:b as timestamp), interval 1 month)) m", args={"a": start, "b": end})
    first = F.col("m").cast("date")
    halves = F.array(F.struct(first.alias("a"), F.date_add(first, 14).alias("b")), F.struct(F.date_add(first, 15).alias("a"), F.last_day(first).alias("b")))
    h = months.select(F.explode(halves).alias("h"))
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    return h.where((F.col("h.a") <= hi) & (F.col("h.b") >= lo)).select(F.greatest("h.a", lo).alias("first"), F.least("h.b", hi).alias("last"))


def pending(jobs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Jobs that the log of completed ones lacks."""
    return jobs.join(done.select(key).distinct(), key, "left_anti")


def jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """The rows of a query on a database; its driver must be on the class path."""
    return spark.read.format("jdbc").option("url", url).option("query", query).options(**options).load()
