"""The driver's tables in the roles of mobility data: the same derivations as columns and as SQL.

events are pings and observations (a user is a vehicle or subscriber, coordinates follow from ids
and values), lineitem rows of an order are the stops of a trip, nations are zones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.sources.readers import table

PINGS = """pings AS (
  SELECT event_id AS id, user_id AS vehicle_id, ts, 18.9::DOUBLE + (user_id % 40) * 0.01::DOUBLE + value / 10000 AS lat, 72.8::DOUBLE + (event_id % 30) * 0.01::DOUBLE AS lng,
         value * 1.5::DOUBLE AS speed, value * 8 - 100 AS deviation_s, (event_id % 12)::INT AS stop_id, event_type FROM events)"""

OBS = """obs AS (
  SELECT event_id AS id, user_id::VARCHAR AS imsi, ts, event_type AS cell_id, (user_id % 7)::VARCHAR AS tac,
         CASE WHEN event_id % 3 = 0 THEN NULL ELSE 18.9::DOUBLE + (user_id % 40) * 0.01::DOUBLE + value / 10000 END AS lat,
         CASE WHEN event_id % 3 = 0 THEN NULL ELSE 72.8::DOUBLE + (event_id % 30) * 0.01::DOUBLE END AS lng,
         CASE event_id % 4 WHEN 0 THEN 'cdr' WHEN 1 THEN 'xdr_gps' WHEN 2 THEN '4g' ELSE '5g' END AS source,
         0.3::DOUBLE + (event_id % 7) * 0.1::DOUBLE AS confidence FROM events)"""

TRIPS = """trips AS (
  SELECT l_orderkey AS trip_id, list(l_partkey % 50 ORDER BY l_linenumber, l_partkey) AS stops, any_value(o_orderdate) AS trip_date,
         any_value((l_orderkey % 1440)::DOUBLE) AS start_min
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey)"""

#: Minute boundaries between two timestamps.
GAP = "date_diff('minute', {0}, {1})"
HAVERSINE = "2 * 6371000.0::DOUBLE * asin(sqrt(pow(sin(radians({2} - {0}) / 2), 2) + cos(radians({0})) * cos(radians({2})) * pow(sin(radians({3} - {1}) / 2), 2)))"

SEGMENTED = PINGS + """,
gapped AS (SELECT *, date_diff('minute', lag(ts) OVER (PARTITION BY vehicle_id ORDER BY ts, id), ts) AS gap FROM pings),
segmented AS (SELECT *, (sum(CASE WHEN gap IS NULL OR gap > 720 THEN 1 ELSE 0 END) OVER (PARTITION BY vehicle_id ORDER BY ts, id) - 1)::BIGINT AS segment_id FROM gapped)"""


def pings(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("vehicle_id"), "ts", (F.lit(18.9) + (F.col("user_id") % 40) * 0.01 + F.col("value") / 10000).alias("lat"), (F.lit(72.8) + (F.col("event_id") % 30) * 0.01).alias("lng"),
        (F.col("value") * 1.5).alias("speed"), (F.col("value") * 8 - 100).alias("deviation_s"), (F.col("event_id") % 12).cast("int").alias("stop_id"), "event_type",
    )


def observations(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    known = F.col("event_id") % 3 != 0
    source = F.element_at(F.array(*map(F.lit, ("cdr", "xdr_gps", "4g", "5g"))), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("imsi"), "ts", F.col("event_type").alias("cell_id"), (F.col("user_id") % 7).cast("string").alias("tac"),
        F.when(known, F.lit(18.9) + (F.col("user_id") % 40) * 0.01 + F.col("value") / 10000).alias("lat"), F.when(known, F.lit(72.8) + (F.col("event_id") % 30) * 0.01).alias("lng"),
        source.alias("source"), (F.lit(0.3) + (F.col("event_id") % 7) * 0.1).alias("confidence"),
    )


def trips(spark: SparkSession, sf: str) -> DataFrame:
    """trip_id, stops, trip_date and start_min of each order that has lines."""
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("s"))
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_orderkey").alias("trip_id"), F.transform("s", lambda x: x["l_partkey"] % 50).alias("stops"), F.col("o_orderdate").alias("trip_date"), (F.col("l_orderkey") % 1440).cast("double").alias("start_min"))


STOPS = "stops AS (SELECT i::INT AS stop_id, 18.9::DOUBLE + (i % 8) * 0.05::DOUBLE AS lat, 72.8::DOUBLE + (i // 8) * 0.06::DOUBLE AS lng FROM range(40) t(i))"


def stops(spark: SparkSession, n: int = 40) -> DataFrame:
    i = F.col("id")
    return spark.range(n).select(i.cast("int").alias("stop_id"), (F.lit(18.9) + (i % 8) * 0.05).alias("lat"), (F.lit(72.8) + F.floor(i / 8) * 0.06).alias("lng"))


def zones(spark: SparkSession, sf: str) -> DataFrame:
    """Nations as zones with centroids, populations and areas."""
    k = F.col("n_nationkey")
    return table(spark, sf, "nation").select(k.alias("zone_id"), (F.lit(18.9) + (k % 5) * 0.02).alias("lat"), (F.lit(72.8) + F.floor(k / 5) * 0.03).alias("lng"), (1000.0 + k * 37).alias("population"), (2.0 + k * 0.1).alias("area_km2"), F.col("n_regionkey").alias("district"))


ZONES = "zones AS (SELECT n_nationkey AS zone_id, 18.9::DOUBLE + (n_nationkey % 5) * 0.02::DOUBLE AS lat, 72.8::DOUBLE + (n_nationkey // 5) * 0.03::DOUBLE AS lng, 1000.0::DOUBLE + n_nationkey * 37 AS population, 2.0::DOUBLE + n_nationkey * 0.1::DOUBLE AS area_km2, n_regionkey AS district FROM nation)"

FLOWS = """flows AS (
  SELECT c_nationkey AS origin, s_nationkey AS destination, year(o_orderdate)::INT AS year, sum(l_quantity) AS flow, count(*) AS n, avg(l_extendedprice) AS price
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"""


def shipments(spark: SparkSession, sf: str) -> DataFrame:
    """Line items with the nations of their customer and supplier: trips between zones."""
    li, o, c, s = (table(spark, sf, t) for t in ("lineitem", "orders", "customer", "supplier"))
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))


def flows(spark: SparkSession, sf: str) -> DataFrame:
    out = shipments(spark, sf).groupBy(F.col("c_nationkey").alias("origin"), F.col("s_nationkey").alias("destination"), F.year("o_orderdate").alias("year"))
    return out.agg(F.sum("l_quantity").alias("flow"), F.count(F.lit(1)).alias("n"), F.avg("l_extendedprice").alias("price"))
