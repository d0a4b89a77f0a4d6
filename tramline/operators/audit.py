"""Audits and reports of reference data, pings and matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stop_issues(stops: DataFrame, lat: tuple[float, float], lng: tuple[float, float]) -> DataFrame:
    """stops with is_duplicate_name (trimmed, case aside), is_dummy and is_outside."""
    name = F.trim(F.lower("stop_name"))
    count = F.count(F.lit(1)).over(Window.partitionBy(name))
    return stops.withColumns({"is_duplicate_name": count > 1, "is_dummy": name.rlike("dummy|test"), "is_outside": ~(F.col("lat").between(*lat) & F.col("lng").between(*lng))})


def valid_routes(trips: DataFrame, stops: DataFrame, least: int = 2) -> DataFrame:
    """trips (trip_id, stops) with only the stops that the catalogue has, in order; trips left with fewer than `least` go."""
    each = trips.select("trip_id", F.posexplode("stops").alias("pos", "stop_id")).join(stops.select("stop_id").distinct(), "stop_id", "left_semi")
    kept = each.groupBy("trip_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "stop_id"))), lambda s: s["stop_id"]).alias("stops"))
    return kept.where(F.size("stops") >= least)


def without_templates(trips: DataFrame, bad: DataFrame) -> DataFrame:
    """Trips whose stop sequence is not among the bad ones."""
    return trips.join(bad.select("stops").distinct(), "stops", "left_anti")


def stop_usage(trips: DataFrame, stops: DataFrame) -> DataFrame:
    """Uses of each stop of any trip or of the catalogue, and whether the catalogue has it."""
    used = trips.select(F.explode("stops").alias("stop_id")).groupBy("stop_id").agg(F.count(F.lit(1)).alias("n_uses"))
    known = stops.select("stop_id", F.lit(True).alias("in_catalog")).distinct()
    return used.join(known, "stop_id", "full_outer").select("stop_id", F.coalesce("n_uses", F.lit(0)).alias("n_uses"), F.coalesce("in_catalog", F.lit(False)).alias("in_catalog"))


def repeated_places(pings: DataFrame, n: int = 20) -> DataFrame:
    """The n coordinates with most pings."""
    return pings.groupBy("lat", "lng").agg(F.count(F.lit(1)).alias("n_pings")).orderBy(F.desc("n_pings"), "lat", "lng").limit(n)


def bucket_sizes(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.groupBy(F.pmod(F.col(key), F.lit(n)).alias("bucket")).agg(F.count(F.lit(1)).alias("n_rows"))


def within_radii(df: DataFrame, distance: str, radii: list[float]) -> DataFrame:
    """(radius, share): how many rows have a distance up to each radius; null distances count as beyond all."""
    one = df.agg(*[F.avg(F.when(F.col(distance) <= r, 1.0).otherwise(0.0)).alias(f"s{i}") for i, r in enumerate(radii)])
    rows = F.array(*[F.struct(F.lit(float(r)).alias("radius"), F.col(f"s{i}").alias("share")) for i, r in enumerate(radii)])
    return one.select(F.explode(rows).alias("x")).select("x.*")


def distance_cdf(df: DataFrame, distance: str, width: float) -> DataFrame:
    """(bin, n, cumulative_share) of distances in bins of a width. Bins are counted first, so the running sum meets few rows."""
    bins = df.where(F.col(distance).isNotNull()).groupBy((F.floor(F.col(distance) / width) * width).cast("double").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    part = Window.partitionBy(F.lit(0))
    return bins.withColumn("cumulative_share", F.sum("n").over(part.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(part))


def date_gaps(df: DataFrame, key: str, date: str) -> DataFrame:
    """Days since the date before of each key's distinct dates."""
    w = Window.partitionBy(key).orderBy(date)
    return df.select(key, date).distinct().withColumn("gap_days", F.datediff(date, F.lag(date).over(w)))


def schedule_variation(trips: DataFrame, template: str, month: Column, months: list[int]) -> DataFrame:
    """(template, variation): sample deviation over mean of its trips by month, months without one counting 0."""
    wide = trips.groupBy(template).pivot("_m", months).count() if "_m" in trips.columns else trips.withColumn("_m", month).groupBy(template).pivot("_m", months).count()
    counts = F.array(*[F.coalesce(F.col(f"`{m}`"), F.lit(0)).cast("double") for m in months])
    long = wide.select(template, F.explode(counts).alias("n"))
    return long.groupBy(template).agg((F.stddev_samp("n") / F.nullif(F.avg("n"), F.lit(0.0))).alias("variation"))


def heatmap(od: DataFrame, top_n: int = 15) -> DataFrame:
    """Flows among the top_n zones by departures, as rows."""
    top = od.groupBy("origin").agg(F.sum("flow").alias("_t")).orderBy(F.desc("_t"), "origin").limit(top_n).select(F.col("origin").alias("_z"))
    inside = od.join(top, F.col("origin") == F.col("_z"), "left_semi").join(top, F.col("destination") == F.col("_z"), "left_semi")
    return inside.groupBy("origin", "destination").agg(F.sum("flow").alias("flow"))


def network_summary(df: DataFrame, date: str, hour: Column, origin: str, dest: str) -> DataFrame:
    """One row: first and last date, days, pairs, zones and the hour with most rows (the earlier on a tie)."""
    pairs = df.agg(F.min(date).alias("first_date"), F.max(date).alias("last_date"), F.countDistinct(F.to_date(date)).alias("n_days"), F.countDistinct(origin, dest).alias("n_pairs"), F.countDistinct(origin).alias("n_origins"))
    peak = df.groupBy(hour.alias("h")).agg(F.count(F.lit(1)).alias("n")).agg(F.min_by("h", F.struct(-F.col("n"), F.col("h"))).alias("peak_hour"))
    return pairs.join(peak, F.lit(True))


def best_row(df: DataFrame, by: str, name: str) -> DataFrame:
    """name of the row with the largest value, the lesser name on a tie."""
    return df.agg(F.min_by(name, F.struct(-F.col(by), F.col(name))).alias("best"), F.max(by).alias(by))


def markdown(df: DataFrame, title: str, most: int = 1_000) -> str:
    """A table of at most `most` rows as Markdown text."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    line = lambda cells: "| " + " | ".join(map(str, cells)) + " |"
    return "\n".join([f"# {title}", "", line(df.columns), line(["---"] * len(df.columns)), *[line(r) for r in rows]]) + "\n"


def vehicle_lines(pings: DataFrame, top_n: int = 20, key: str = "vehicle_id") -> DataFrame:
    """(key, n_pings, line): the places of the top_n vehicles with most pings (two at least) in order of time, for maps."""
    counts = pings.groupBy(key).agg(F.count(F.lit(1)).alias("n_pings")).where("n_pings >= 2").orderBy(F.desc("n_pings"), key).limit(top_n)
    place = F.struct("ts", "id", "lat", "lng")
    lines = pings.join(F.broadcast(counts.select(key)), key, "left_semi").groupBy(key).agg(F.transform(F.array_sort(F.collect_list(place)), lambda p: F.struct(p["lat"], p["lng"])).alias("line"))
    return counts.join(lines, key)


def longest(trips: DataFrame, n: int, minutes: str = "duration_min", key: str = "trip_id") -> DataFrame:
    """The n longest trips with their rank, ties by key."""
    top = trips.where(F.col(minutes).isNotNull()).orderBy(F.desc(minutes), key).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(minutes), key)))


def bins(df: DataFrame, value: str, edges: list[float], by: str | None = None) -> DataFrame:
    """Rows by right-closed bin of a value, numbered from 0; values outside the edges and nulls count in bin -1."""
    inside = F.coalesce(*[F.when((F.col(value) > lo) & (F.col(value) <= hi), F.lit(i)) for i, (lo, hi) in enumerate(zip(edges, edges[1:]))], F.lit(-1))
    return df.groupBy(*([by] if by else []), inside.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def schema_of(df: DataFrame) -> DataFrame:
    """(position, column_name, column_type, nullable) of a table."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "position int, column_name string, column_type string, nullable boolean")
