"""Trajectories: smoothing, resampling, gaps, schedules with hours past 24, fusion and accuracy metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions import geo, times
from tramline.operators.features import average_rank
from tramline.operators.nearest import asof_nearest, nearest_k

_TRIP = ["trip_id"]


def smooth(points: DataFrame, keys: list[str] = _TRIP, at: tuple[str, ...] = ("ts", "id"), half: int = 2) -> DataFrame:
    """Centred moving average of places over half rows to each side, fewer at the ends."""
    w = Window.partitionBy(*keys).orderBy(*at).rowsBetween(-half, half)
    return points.withColumns({"lat": F.avg("lat").over(w), "lng": F.avg("lng").over(w)})


def speeds(points: DataFrame, keys: list[str] = _TRIP, at: tuple[str, ...] = ("ts", "id")) -> DataFrame:
    """points with speed_mps from the row before, 0 for the first and where no time passes."""
    w = Window.partitionBy(*keys).orderBy(*at)
    d = geo.haversine_m(F.lag("lat").over(w), F.lag("lng").over(w), F.col("lat"), F.col("lng"))
    s = times.elapsed_s(F.lag("ts").over(w), F.col("ts"))
    return points.withColumn("speed_mps", F.coalesce(F.when(s > 0, d / s), F.lit(0.0)))


def gaps(points: DataFrame, expected_s: float, keys: list[str] = _TRIP, at: tuple[str, ...] = ("ts", "id"), factor: float = 5.0) -> DataFrame:
    """Rows before a gap of more than factor times the expected interval, with gap_s and gap_end."""
    w = Window.partitionBy(*keys).orderBy(*at)
    s = times.elapsed_s(F.col("ts"), F.lead("ts").over(w))
    return points.withColumns({"gap_s": s, "gap_end": F.lead("ts").over(w)}).where(F.col("gap_s") > factor * expected_s)


def resample(points: DataFrame, interval_s: float, keys: list[str] = _TRIP, at: tuple[str, ...] = ("ts", "id"), max_gap_s: float | None = None) -> DataFrame:
    """The points and evenly placed ones between neighbours: floor(gap / interval) - 1 of them, interval_s apart in time.

    Between points further apart than max_gap_s nothing is put in. Column step is 0 for given points.
    """
    w = Window.partitionBy(*keys).orderBy(*at)
    nxt = lambda c: F.lead(c).over(w)
    gap = times.elapsed_s(F.col("ts"), nxt("ts"))
    n = F.floor(gap / interval_s).cast("int") - 1
    if max_gap_s is not None:
        n = F.when(gap <= max_gap_s, n)
    wide = points.select("*", nxt("lat").alias("_lat"), nxt("lng").alias("_lng"), F.greatest(F.lit(0), F.coalesce(n, F.lit(0))).alias("_n"))
    each = wide.withColumn("step", F.explode(F.sequence(F.lit(0), F.col("_n"))))
    part = F.col("step") / (F.col("_n") + 1)
    moved = lambda a, b: F.when(F.col("step") == 0, F.col(a)).otherwise(F.col(a) + (F.col(b) - F.col(a)) * part)
    ts = F.timestamp_add("MICROSECOND", F.round(F.col("step") * interval_s * 1_000_000).cast("long"), F.col("ts"))
    return each.withColumns({"lat": moved("lat", "_lat"), "lng": moved("lng", "_lng"), "ts": ts}).drop("_lat", "_lng", "_n")


def route_length_m(points: DataFrame, keys: list[str] = _TRIP, at: tuple[str, ...] = ("ts", "id")) -> DataFrame:
    """Sum of distances between neighbouring points by key."""
    w = Window.partitionBy(*keys).orderBy(*at)
    d = geo.haversine_m(F.lag("lat").over(w), F.lag("lng").over(w), F.col("lat"), F.col("lng"))
    return points.withColumn("_d", d).groupBy(*keys).agg(F.sum("_d").alias("length_m"), F.count(F.lit(1)).alias("n_points"))


def schedule_times(stop_times: DataFrame, base_date: Column, clock: str = "arrival_time") -> DataFrame:
    """stop_times with ts, the base date plus a clock that may pass 24 hours."""
    return stop_times.withColumn("ts", F.timestamp_add("MICROSECOND", F.round(times.clock_minutes(F.col(clock)) * 60_000_000).cast("long"), base_date.cast("timestamp_ntz")))


def stop_events(stop_times: DataFrame) -> DataFrame:
    """An event for the arrival, and one for the departure where it is later."""
    events = F.filter(F.array(F.struct(F.lit("arrival").alias("kind"), F.col("arrival_ts").alias("ts")), F.struct(F.lit("departure").alias("kind"), F.col("departure_ts").alias("ts"))), lambda e: (e["kind"] == "arrival") | (e["ts"] > F.col("arrival_ts")))
    return stop_times.withColumn("e", F.explode(events)).select(*[c for c in stop_times.columns if c not in ("arrival_ts", "departure_ts")], F.col("e.kind").alias("kind"), F.col("e.ts").alias("ts"))


def match_confidence(moved_m: Column, radius_m: float = 50.0, least: float = 0.5) -> Column:
    return F.greatest(F.lit(least), 1 - moved_m / radius_m)


def fuse_schedule(gps: DataFrame, events: DataFrame, row_id: str = "id", within_s: float = 60.0, within_m: float = 50.0, gps_weight: float = 0.7) -> DataFrame:
    """gps drawn towards the earliest schedule event of its trip near in time and place: 0.7 to 0.3."""
    e = events.select(F.col("trip_id").alias("_t"), F.col("ts").alias("_ts"), F.col("lat").alias("_lat"), F.col("lng").alias("_lng"))
    bucket = lambda ts: F.floor(times.seconds(ts) / within_s)
    e = e.withColumn("_b", F.explode(F.array(*[bucket(F.col("_ts")) + d for d in (-1, 0, 1)])))
    d = geo.haversine_m(F.col("lat"), F.col("lng"), F.col("_lat"), F.col("_lng"))
    near = gps.join(e, (F.col("trip_id") == F.col("_t")) & (bucket(F.col("ts")) == F.col("_b"))).where((F.abs(times.elapsed_s(F.col("_ts"), F.col("ts"))) <= within_s) & (d <= within_m))
    first = near.groupBy(row_id).agg(F.min(F.struct("_ts", "_lat", "_lng")).alias("m")).select(F.col(row_id).alias("_id"), "m")
    mixed = lambda c: F.coalesce(gps_weight * F.col(c) + (1 - gps_weight) * F.col(f"m._{c}"), F.col(c))
    return gps.join(first, F.col(row_id) == F.col("_id"), "left").withColumns({"lat": mixed("lat"), "lng": mixed("lng"), "source": F.when(F.col("m").isNull(), "gps").otherwise("gps+schedule")}).drop("m", "_id")


def tower_positions(events: DataFrame, towers: DataFrame, near_km: float = 2.0) -> DataFrame:
    """events (event_id, tower_id) with a place from the tower and its neighbours within near_km: weights 1 and 0.5, confidence 0.3 + 0.1 n up to 0.6."""
    deg = near_km / geo.KM_PER_DEGREE
    t = towers.select("tower_id", "lat", "lng", F.floor(F.col("lat") / deg).alias("x"), F.floor(F.col("lng") / (deg * 2)).alias("y"))
    o = t.select(F.col("tower_id").alias("_o"), F.col("lat").alias("_lat"), F.col("lng").alias("_lng"), F.explode(F.array(*[F.struct((F.col("x") + i).alias("x"), (F.col("y") + j).alias("y")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("c"))
    pairs = t.join(o, (F.col("x") == F.col("c.x")) & (F.col("y") == F.col("c.y"))).where(geo.haversine_m(F.col("lat"), F.col("lng"), F.col("_lat"), F.col("_lng")) <= near_km * 1000)
    w = F.when(F.col("tower_id") == F.col("_o"), 1.0).otherwise(0.5)
    placed = pairs.groupBy("tower_id").agg((F.sum(w * F.col("_lat")) / F.sum(w)).alias("lat"), (F.sum(w * F.col("_lng")) / F.sum(w)).alias("lng"), F.least(F.lit(0.6), 0.3 + 0.1 * F.count(F.lit(1))).alias("confidence"))
    return events.join(placed, "tower_id", "left")


def tower_track(placed: DataFrame, keys: list[str] = _TRIP, at: tuple[str, ...] = ("ts", "id"), reach: float = 0.3) -> DataFrame:
    """placed (keys, at, lat, lng, tower_lat, tower_lng, radius_m) with each place drawn on from the tower in the direction of travel.

    The shift is at most reach times the radius. A place depends on the one put out before it, so a
    trip, of bounded length, is one group.
    """
    import pandas as pd

    names, schema = placed.columns, placed.schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(at), kind="stable").reset_index(drop=True)
        lat, lng = pdf["lat"].to_numpy(copy=True), pdf["lng"].to_numpy(copy=True)
        base_lat, base_lng, radius = pdf["tower_lat"].to_numpy(), pdf["tower_lng"].to_numpy(), pdf["radius_m"].to_numpy()
        for k in range(1, len(pdf)):
            dy, dx = lat[k] - lat[k - 1], lng[k] - lng[k - 1]
            far = (dy * dy + dx * dx) ** 0.5
            if far > 0:
                step = min(radius[k] / 111_000 * reach, far) / far
                lat[k], lng[k] = base_lat[k] + dy * step, base_lng[k] + dx * step
        return pdf.assign(lat=lat, lng=lng)[names]

    return placed.where(F.col("lat").isNotNull() & F.col("tower_lat").isNotNull()).groupBy(*keys).applyInPandas(run, schema)


def gps_track(points: DataFrame, interval_s: float, max_gap_s: float = 60.0, keys: list[str] = _TRIP, at: tuple[str, ...] = ("ts", "id")) -> DataFrame:
    """Points with neighbours put in across gaps of up to max_gap_s, smoothed, with source gps or interpolated and a speed."""
    filled = resample(points, interval_s, keys, at, max_gap_s).withColumn("source", F.when(F.col("step") == 0, "gps").otherwise("interpolated"))
    order = (*at, "step")
    return speeds(smooth(filled, keys, order), keys, order)


def schedule_track(stop_times: DataFrame, interval_s: float, keys: list[str] = _TRIP) -> DataFrame:
    """Positions along a schedule: its stop events (trip_id, arrival_ts, departure_ts, lat, lng, id) and places between them in steps of interval_s."""
    events = stop_events(stop_times)
    track = resample(events, interval_s, keys, ("ts", "id", "kind"))
    return track.withColumn("source", F.when(F.col("step") == 0, F.col("kind")).otherwise("interpolated"))


def source_shares(points: DataFrame, keys: list[str] = _TRIP) -> DataFrame:
    """Points, those put in, and their share by key."""
    made = F.count_if(F.col("source") == "interpolated")
    return points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_points"), made.alias("n_interpolated"), (made / F.count(F.lit(1))).alias("interpolated_share"))


def accuracy(truth: DataFrame, found: DataFrame, row_id: str = "id", within_s: float = 5.0) -> DataFrame:
    """One row for each algorithm of found (algorithm, trip_id, ts, lat, lng, confidence): errors against truth by nearest time, coverage and quality."""
    names = [r[0] for r in found.select("algorithm").distinct().orderBy("algorithm").collect()]
    out = None
    for name in names:
        matched = asof_nearest(truth, found.where(F.col("algorithm") == name).select("trip_id", "ts", F.col("lat").alias("f_lat"), F.col("lng").alias("f_lng"), "confidence"), ["trip_id"], "ts", row_id, within_s, ["f_lat", "f_lng", "confidence"], strict=True)
        e = geo.haversine_m(F.col("lat"), F.col("lng"), F.col("f_lat"), F.col("f_lng"))
        one = matched.withColumn("_e", e).agg(
            F.count(F.lit(1)).alias("n_truth"), F.count("_e").alias("n_matched"), F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse_m"), F.avg("_e").alias("mae_m"), F.max("_e").alias("max_m"), F.percentile("_e", F.lit(0.95)).alias("p95_m"), F.avg("gap_s").alias("temporal_mae_s"), F.avg(F.when(F.col("_e").isNotNull(), F.col("confidence"))).alias("mean_confidence")
        ).withColumn("algorithm", F.lit(name))
        out = one if out is None else out.unionByName(one)
    out = out.withColumn("coverage", F.col("n_matched") / F.nullif(F.col("n_truth"), F.lit(0)))
    return out.withColumn("quality", quality_score(F.col("rmse_m"), F.col("coverage"), F.col("mean_confidence"), F.lit(1.0)))


def quality_score(rmse_m: Column, coverage: Column, confidence: Column, speed: Column) -> Column:
    """0.40 exp(-rmse / 50) + 0.25 coverage + 0.20 confidence + 0.15 speed."""
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return 0.40 * z(F.exp(-rmse_m / 50)) + 0.25 * z(coverage) + 0.20 * z(confidence) + 0.15 * z(speed)


def rank_algorithms(table: DataFrame, lower: list[str], higher: list[str]) -> DataFrame:
    """table with rank_<metric> (ties at their average) and mean_rank."""
    out = table
    for c in lower:
        out = average_rank(out, c, f"rank_{c}")
    for c in higher:
        out = average_rank(out, c, f"rank_{c}", descending=True)
    ranks = [F.col(f"rank_{c}") for c in [*lower, *higher]]
    return out.withColumn("mean_rank", sum(ranks[1:], ranks[0]) / len(ranks))


def handovers(track: DataFrame, towers: DataFrame, every_s: int = 30, within_s: float = 600.0) -> DataFrame:
    """(trip_id, ts, tower_id, from_tower): changes of the nearest tower along a track (trip_id, id, ts, lat, lng), looked at every every_s seconds from its start.

    At each look the nearest point in time within within_s counts; looks without one are passed over.
    """
    ends = track.groupBy("trip_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    looks = ends.select("trip_id", F.explode(F.sequence(F.lit(0), F.floor(times.elapsed_s(F.col("a"), F.col("b")) / every_s))).alias("k"), "a")
    looks = looks.select("trip_id", F.timestamp_add("SECOND", (F.col("k") * every_s).cast("long"), F.col("a")).alias("ts"), F.concat_ws(":", "trip_id", "k").alias("look"), "k")
    at = asof_nearest(looks, track.select("trip_id", "ts", "lat", "lng"), ["trip_id"], "ts", "look", within_s, ["lat", "lng"])
    near = nearest_k(at.where("lat is not null"), towers, 1, "look", "tower_id").select("look", "tower_id")
    w = Window.partitionBy("trip_id").orderBy("k")
    seen = at.join(near, "look").withColumn("from_tower", F.lag("tower_id").over(w))
    return seen.where("from_tower <> tower_id").select("trip_id", "ts", "tower_id", "from_tower")
