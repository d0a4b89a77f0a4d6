"""Origin-destination matrices, service supply and frequency, and matrix tools."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions import times
from tramline.operators.nearest import small_or_shuffled
from tramline.operators.storage import cut


def segment_od(pings: DataFrame, stop: str = "stop_id", min_pings: int = 3, min_minutes: int = 2) -> DataFrame:
    """First and last stop of each segment (by time, then stop), with start, pings and minutes; differing stops only."""
    first = F.min_by(stop, F.struct("ts", stop))
    last = F.max_by(stop, F.struct("ts", stop))
    found = pings.where(F.col(stop).isNotNull()).groupBy("vehicle_id", "segment_id").agg(
        first.alias("origin_stop_id"), last.alias("dest_stop_id"), F.min("ts").alias("seg_start"), F.max("ts").alias("seg_end"), F.count(F.lit(1)).alias("n_pings")
    )
    found = found.withColumn("duration_min", times.minute_gap(F.col("seg_start"), F.col("seg_end")))
    return found.where((F.col("n_pings") >= min_pings) & (F.col("duration_min") >= min_minutes) & (F.col("origin_stop_id") != F.col("dest_stop_id")))


def template_od(inferred: DataFrame, catalog: DataFrame, min_conf: float = 0.3) -> DataFrame:
    """Segments matched to a template with enough confidence get the template's ends as origin and destination."""
    ends = small_or_shuffled(catalog.select("template_id", F.get("stops", 0).alias("origin_stop_id"), F.element_at("stops", -1).alias("dest_stop_id")))
    return inferred.where(F.col("confidence") >= min_conf).join(ends, "template_id")


def unmatched(segments: DataFrame, inferred: DataFrame, min_conf: float = 0.3) -> DataFrame:
    """Segments without a confident template: an anti join."""
    sure = inferred.where(F.col("confidence") >= min_conf).select("vehicle_id", "segment_id")
    return segments.join(sure, ["vehicle_id", "segment_id"], "left_anti")


def with_bins(segments: DataFrame, minutes: int = 30) -> DataFrame:
    """Adds time_bin, period, month, is_monsoon and dow (Sunday 0) of seg_start."""
    ts = F.col("seg_start")
    return segments.withColumns({"time_bin": times.floor_bin(ts, minutes), "period": times.bus_period(ts), "month": F.month(ts), "is_monsoon": times.is_monsoon(ts), "dow": times.sunday_zero(ts)})


def od_aggregate(binned: DataFrame) -> DataFrame:
    """Trips and mean minutes by origin, destination, bin and its labels."""
    keys = ["origin_stop_id", "dest_stop_id", "time_bin", "period", "month", "is_monsoon", "dow"]
    return binned.groupBy(*keys).agg(F.count(F.lit(1)).alias("flow"), F.avg("duration_min").alias("mean_duration_min"))


def service_supply(binned: DataFrame) -> DataFrame:
    """Runs, distinct days and runs a day by origin, destination and month."""
    found = binned.groupBy("origin_stop_id", "dest_stop_id", "month").agg(F.count(F.lit(1)).alias("n_runs"), F.countDistinct(F.to_date("seg_start")).alias("n_days"))
    return found.withColumn("runs_per_day", F.col("n_runs") / F.nullif(F.col("n_days"), F.lit(0)))


def service_frequency(od: DataFrame, bin_minutes: int = 30) -> DataFrame:
    """od with runs in a bin as headway: bin_minutes over flow, null without flow."""
    return od.withColumn("implied_headway_min", F.lit(float(bin_minutes)) / F.nullif(F.col("flow"), F.lit(0)))


def od_matrix(trips: DataFrame, origin: str, dest: str, weight: str, by: list[str] = (), distance: str | None = None) -> DataFrame:
    """Weighted flow, observed trips and mean distance by origin, destination and further keys; null zones drop."""
    aggs = [F.round(F.sum(weight), 2).alias("flow"), F.count(F.lit(1)).alias("observed_trips")]
    if distance:
        aggs.append(F.round(F.avg(distance), 2).alias("avg_distance_m"))
    known = trips.where(F.col(origin).isNotNull() & F.col(dest).isNotNull())
    return known.groupBy(F.col(origin).alias("origin"), F.col(dest).alias("destination"), *by).agg(*aggs)


def zero_fill(od: DataFrame, zones: DataFrame, zone: str = "zone", most: int = 20_000) -> DataFrame:
    """A row for each ordered pair of zones, with flow 0 where od has none.

    The product of zones is the result asked for; above `most` zones it is refused.
    """
    ids = zones.select(zone).where(F.col(zone).isNotNull()).distinct()
    n = ids.count()
    if n > most:
        raise ValueError(f"{n} zones give {n * n} pairs; at most {most} zones are filled")
    listed = ids.agg(F.collect_list(zone).alias("_all")).withColumn("_k", F.lit(1))
    pairs = ids.select(F.col(zone).alias("origin"), F.lit(1).alias("_k")).join(F.broadcast(listed), "_k").select("origin", F.explode("_all").alias("destination"))
    sums = od.groupBy("origin", "destination").agg(F.sum("flow").alias("flow"))
    return pairs.join(sums, ["origin", "destination"], "left").fillna(0.0, ["flow"])


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: correlation, RMSE, MAE, totals and pair counts of two matrices, absent pairs as 0."""
    x = a.groupBy("origin", "destination").agg(F.sum("flow").alias("x"))
    y = b.groupBy("origin", "destination").agg(F.sum("flow").alias("y"))
    both = x.join(y, ["origin", "destination"], "full_outer").select(F.col("x").isNotNull().alias("in_a"), F.col("y").isNotNull().alias("in_b"), F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"))
    d = F.col("x") - F.col("y")
    return both.agg(
        F.count(F.lit(1)).alias("n_pairs"), F.count_if(F.col("in_a") & F.col("in_b")).alias("n_common"), F.sum("x").alias("total_a"), F.sum("y").alias("total_b"),
        F.corr("x", "y").alias("correlation"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"),
    )


def summary(od: DataFrame) -> DataFrame:
    """One row: pairs, total, mean, median, extremes and zones of a matrix."""
    f = F.col("flow")
    return od.agg(F.count(F.lit(1)).alias("n_pairs"), F.sum(f).alias("total_flow"), F.avg(f).alias("mean_flow"), F.median(f).alias("median_flow"), F.max(f).alias("max_flow"), F.min(F.when(f > 0, f)).alias("min_nonzero_flow"), F.countDistinct("origin").alias("n_origins"), F.countDistinct("destination").alias("n_destinations"))


def top_pairs(od: DataFrame, n: int = 5) -> DataFrame:
    """The n pairs with the largest flow."""
    return od.groupBy("origin", "destination").agg(F.sum("flow").alias("flow")).orderBy(F.desc("flow"), "origin", "destination").limit(n)


def intra_zone(od: DataFrame, rate: float = 0.3, cap: float = 5.0) -> DataFrame:
    """Trips within a zone as a share of its departures: the diagonal is scaled to rate / (1 - rate) of
    the outflow, by at most cap times its observed flow where there is one."""
    out = F.sum(F.when(F.col("origin") != F.col("destination"), F.col("flow")).otherwise(0.0)).over(Window.partitionBy("origin"))
    wanted = out * (rate / (1 - rate))
    new = F.when(F.col("flow") > 0, F.least(wanted, F.col("flow") * cap)).otherwise(wanted)
    return od.withColumn("_w", F.when(F.col("origin") == F.col("destination"), new)).withColumn("flow", F.coalesce("_w", "flow")).drop("_w")


def net_flow(od: DataFrame, by: list[str] = ()) -> DataFrame:
    """Departures, arrivals and their difference by zone and further keys."""
    out = od.select(F.col("origin").alias("zone"), *by, F.col("flow").alias("dep"), F.lit(0.0).alias("arr"))
    into = od.select(F.col("destination").alias("zone"), *by, F.lit(0.0).alias("dep"), F.col("flow").alias("arr"))
    sums = out.unionByName(into).groupBy("zone", *by).agg(F.sum("dep").alias("departures"), F.sum("arr").alias("arrivals"))
    return sums.withColumn("net_flow", F.col("arrivals") - F.col("departures"))


def to_sparse(od: DataFrame, zones: DataFrame, zone: str = "zone") -> DataFrame:
    """(row, col, flow) by the places of origin and destination among the ordered zones, from 0; the compressed rows of a matrix when sorted.

    Zones are numbered by ranges, so that no task orders all of them. Flows of other zones go.
    """
    dealt = cut(zones.select(F.col(zone).alias("_z")).where("_z is not null").distinct().repartitionByRange(16, "_z").withColumn("_p", F.spark_partition_id()))
    sizes = sorted((r[0], r[1]) for r in dealt.groupBy("_p").agg(F.count(F.lit(1))).collect())
    before, at = {}, 0
    for p, n in sizes:
        before[p], at = at, at + n
    start = F.coalesce(*[F.when(F.col("_p") == p, F.lit(n)) for p, n in before.items()], F.lit(0))
    place = dealt.select("_z", (start + F.row_number().over(Window.partitionBy("_p").orderBy("_z")) - 1).cast("long").alias("_n"))
    named = lambda c, n: place.select(F.col("_z").alias(c), F.col("_n").alias(n))
    sums = od.groupBy("origin", "destination").agg(F.sum("flow").alias("flow"))
    return sums.join(named("origin", "row"), "origin").join(named("destination", "col"), "destination").where("flow <> 0").select("row", "col", "flow")


def row_starts(sparse: DataFrame, n_zones: int) -> DataFrame:
    """(row, n, start): entries of each row and where they start among all, for rows 0 to n_zones - 1."""
    counts = sparse.groupBy("row").agg(F.count(F.lit(1)).alias("n"))
    rows = sparse.sparkSession.range(n_zones).select(F.col("id").alias("row")).join(counts, "row", "left").fillna(0, ["n"])
    block = F.floor(F.col("row") / 1024)
    sums = rows.groupBy(block.alias("_b")).agg(F.sum("n").alias("_s"))
    ahead = Window.partitionBy(F.lit(1)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_a", F.coalesce(F.sum("_s").over(ahead), F.lit(0))).drop("_s")
    own = F.coalesce(F.sum("n").over(Window.partitionBy("_b").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_b", block).join(sums, "_b").select("row", "n", (F.col("_a") + own).alias("start"))
