"""Trip segments, stop sequences, visits and headways: gaps-and-islands over ordered pings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions import seqs, times
from tramline.operators.quantiles import exact_quantiles

_UP_TO_NOW = (Window.unboundedPreceding, Window.currentRow)


def islands(df: DataFrame, keys: list[str], order: list, starts: Column, name: str) -> DataFrame:
    """Numbers runs from 0 within keys: a run starts where `starts`, evaluated per row, is true or null."""
    w = Window.partitionBy(*keys).orderBy(*order)
    flag = F.when(F.coalesce(starts, F.lit(True)), 1).otherwise(0)
    return df.withColumn("_s", flag).withColumn(name, (F.sum("_s").over(w.rowsBetween(*_UP_TO_NOW)) - 1).cast("long")).drop("_s")


def number_segments(pings: DataFrame, gap_min: int = 20, order: tuple[str, ...] = ("ts", "id"), elapsed: bool = False) -> DataFrame:
    """pings with segment_id per vehicle: a new one after a gap of more than gap_min minute boundaries (or elapsed minutes)."""
    w = Window.partitionBy("vehicle_id").orderBy(*order)
    before = F.lag("ts").over(w)
    gap = (times.elapsed_s(before, F.col("ts"))) / 60 if elapsed else times.minute_gap(before, F.col("ts"))
    return islands(pings, ["vehicle_id"], list(order), gap > gap_min, "segment_id")


def segment_summary(segmented: DataFrame, min_pings: int = 5, min_minutes: int = 5) -> DataFrame:
    """Segments with enough pings and minutes: start, end, n_pings and duration."""
    found = segmented.groupBy("vehicle_id", "segment_id").agg(F.min("ts").alias("seg_start"), F.max("ts").alias("seg_end"), F.count(F.lit(1)).alias("n_pings"))
    found = found.withColumn("duration_min", times.minute_gap(F.col("seg_start"), F.col("seg_end")))
    return found.where((F.col("n_pings") >= min_pings) & (F.col("duration_min") >= min_minutes))


def valid_pings(segmented: DataFrame, min_pings: int = 5, min_minutes: int = 5) -> DataFrame:
    """The pings of segments that segment_summary keeps, without a join."""
    w = Window.partitionBy("vehicle_id", "segment_id")
    minutes = times.minute_gap(F.min("ts").over(w), F.max("ts").over(w))
    return segmented.withColumn("_ok", (F.count(F.lit(1)).over(w) >= min_pings) & (minutes >= min_minutes)).where("_ok").drop("_ok")


def gap_sensitivity(pings: DataFrame, thresholds_min: list[int], order: tuple[str, ...] = ("ts", "id")) -> DataFrame:
    """(threshold_min, n_breaks, n_segments) by elapsed minutes, all thresholds in one pass."""
    w = Window.partitionBy("vehicle_id").orderBy(*order)
    gaps = pings.select(((times.elapsed_s(F.lag("ts").over(w), F.col("ts"))) / 60).alias("gap"))
    flags = [F.count_if(F.col("gap") > t).alias(f"b{t}") for t in thresholds_min]
    one = gaps.agg(F.count_if(F.col("gap").isNull()).alias("firsts"), *flags)
    rows = F.array(*[F.struct(F.lit(t).alias("threshold_min"), F.col(f"b{t}").alias("n_breaks")) for t in thresholds_min])
    return one.select("firsts", F.explode(rows).alias("x")).select("x.threshold_min", "x.n_breaks", (F.col("x.n_breaks") + F.col("firsts")).alias("n_segments"))


def gap_quantiles(pings: DataFrame, shares: list[float], order: tuple[str, ...] = ("ts", "id")) -> DataFrame:
    """(share, gap_min): quantiles of the minutes between pings of a vehicle."""
    w = Window.partitionBy("vehicle_id").orderBy(*order)
    gaps = pings.select(((times.elapsed_s(F.lag("ts").over(w), F.col("ts"))) / 60).alias("gap"))
    found = exact_quantiles(gaps, "gap", shares) or [None] * len(shares)
    return pings.sparkSession.createDataFrame(list(zip(map(float, shares), found)), "share double, gap_min double")


def segment_sequences(segmented: DataFrame, stop: str = "stop_id", min_stops: int = 4, order: tuple[str, ...] = ("ts", "id")) -> DataFrame:
    """Each segment's stops in order with runs collapsed, of segments that keep min_stops or more."""
    found = segmented.where(F.col(stop).isNotNull()).groupBy("vehicle_id", "segment_id").agg(
        seqs.ordered(F.struct(*order), F.col(stop)).alias("raw"), F.min("ts").alias("seg_start"), F.max("ts").alias("seg_end"), F.count(F.lit(1)).alias("n_pings"), F.countDistinct(stop).alias("n_stops")
    )
    return found.withColumn("stops", seqs.collapse_runs(F.col("raw"))).drop("raw").where(F.size("stops") >= min_stops)


def stop_visits(pings: DataFrame, keys: list[str], stop: str = "stop_id", order: tuple[str, ...] = ("ts", "id")) -> DataFrame:
    """One row for each run of pings at a stop: keys, stop, visit_group, arrival and n_pings."""
    w = Window.partitionBy(*keys).orderBy(*order)
    runs = islands(pings.where(F.col(stop).isNotNull()), keys, list(order), F.col(stop) != F.lag(stop).over(w), "visit_group")
    return runs.groupBy(*keys, stop, "visit_group").agg(F.min("ts").alias("arrival"), F.count(F.lit(1)).alias("n_pings"))


def headways(visits: DataFrame, keys: list[str], max_min: float = 120.0, tie: str = "vehicle_id") -> DataFrame:
    """visits with headway_min since the arrival before at the same keys, where over 0 and under max_min."""
    w = Window.partitionBy(*keys).orderBy("arrival", tie)
    gap = (times.elapsed_s(F.lag("arrival").over(w), F.col("arrival"))) / 60
    return visits.withColumn("headway_min", gap).where((F.col("headway_min") > 0) & (F.col("headway_min") < max_min))


def headway_stats(found: DataFrame, keys: list[str], least: int = 10, bunching: float = 0.25) -> DataFrame:
    """Count, mean, deviation, median, 85th percentile, variation, regularity and bunching of headways by keys."""
    h = F.col("headway_min")
    mean = F.avg(h).over(Window.partitionBy(*keys))
    stats = found.withColumn("_mean", mean).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(h).alias("mean_headway"), F.stddev_samp(h).alias("sd_headway"), F.median(h).alias("median_headway"), F.percentile(h, F.lit(0.85)).alias("p85_headway"), F.count_if(h < bunching * F.col("_mean")).alias("n_bunched")
    )
    cv = F.col("sd_headway") / F.nullif(F.col("mean_headway"), F.lit(0.0))
    return stats.where(F.col("n") >= least).withColumns({"cv": cv, "regularity": 1 - cv, "bunching_share": F.col("n_bunched") / F.col("n")})
