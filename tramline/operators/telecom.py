"""Mobile-network records: source projections, fusion, ping-pong, users, home and work, trips, chains and expansion."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions import geo, times
from tramline.operators.clean import keep_first

OBSERVATION = ("imsi", "ts", "cell_id", "tac", "lat", "lng", "source", "confidence")


@dataclass(frozen=True)
class Confidence:
    gps: float = 0.95
    xdr_cell: float = 0.7
    nr: float = 0.8
    lte: float = 0.75
    cdr: float = 0.5


def signal_quality(rsrp: Column, rsrq: Column, sinr: Column) -> Column:
    """0 to 1 from received power, quality and noise ratio, weighted 0.5, 0.3 and 0.2; unknown parts count as middling."""
    unit = lambda x, lo, hi: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce((x - lo) / (hi - lo), F.lit(0.5))))
    return 0.5 * unit(rsrp, -140.0, -44.0) + 0.3 * unit(rsrq, -20.0, -3.0) + 0.2 * unit(sinr, -20.0, 30.0)


def _observations(df: DataFrame, lat: Column, lng: Column, source: Column, confidence: Column) -> DataFrame:
    out = df.select("imsi", "ts", F.col("cell_id").cast("string").alias("cell_id"), F.col("tac").cast("string").alias("tac"), lat.cast("double").alias("lat"), lng.cast("double").alias("lng"), source.alias("source"), confidence.cast("double").alias("confidence"))
    return out.where(F.col("imsi").isNotNull() & F.col("ts").isNotNull())


def from_cdr(df: DataFrame, c: Confidence = Confidence()) -> DataFrame:
    return _observations(df, F.lit(None), F.lit(None), F.lit("cdr"), F.lit(c.cdr))


def from_xdr(df: DataFrame, c: Confidence = Confidence()) -> DataFrame:
    located = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    return _observations(df, F.col("lat"), F.col("lng"), F.when(located, "xdr_gps").otherwise("xdr_cell"), F.when(located, c.gps).otherwise(c.xdr_cell))


def from_radio(df: DataFrame, kind: str, c: Confidence = Confidence()) -> DataFrame:
    """4G (`lte`) or 5G (`nr`) measurements; confidence scales with signal quality."""
    base = c.nr if kind == "nr" else c.lte
    quality = signal_quality(F.col("rsrp"), F.col("rsrq"), F.col("sinr"))
    return _observations(df, F.col("lat"), F.col("lng"), F.lit("5g" if kind == "nr" else "4g"), base * (0.7 + 0.3 * quality))


def union_sources(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def fuse_weighted(obs: DataFrame, bucket_s: int = 60) -> DataFrame:
    """One row for each user and time bucket: confidence-weighted place, the surest cell and source, mean confidence, all sources.

    Only rows with both coordinates weigh in the place; without positive weight the plain mean stands.
    """
    has = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    w = F.when(has, F.col("confidence"))
    mean = lambda c: F.coalesce(F.sum(w * F.col(c)) / F.nullif(F.sum(w), F.lit(0.0)), F.avg(F.when(has, F.col(c))))
    best = F.max_by(F.struct("cell_id", "tac", "source"), F.struct("confidence", F.negate(times.micros(F.col("ts"))), "source", "cell_id"))
    out = obs.withColumn("bucket", times.round_bin_s(F.col("ts"), bucket_s)).groupBy("imsi", "bucket").agg(
        mean("lat").alias("lat"), mean("lng").alias("lng"), best.alias("b"), F.avg("confidence").alias("confidence"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"), F.count(F.lit(1)).alias("n_obs")
    )
    return out.select("imsi", "bucket", "lat", "lng", "b.cell_id", "b.tac", F.col("b.source").alias("best_source"), "confidence", "sources", "n_obs")


def fuse_first(obs: DataFrame, order: list, bucket_s: int = 60) -> DataFrame:
    """The first observation of each user and time bucket by an order: highest confidence, or most recent."""
    return keep_first(obs.withColumn("bucket", times.round_bin_s(F.col("ts"), bucket_s)), ["imsi", "bucket"], order)


def flag_aba(obs: DataFrame, within_s: float = 300.0, order: tuple[str, ...] = ("ts", "id")) -> DataFrame:
    """obs with is_ping_pong: a cell between two of one other cell that are at most within_s apart."""
    w = Window.partitionBy("imsi").orderBy(*order)
    before, after = F.lag("cell_id").over(w), F.lead("cell_id").over(w)
    span = times.elapsed_s(F.lag("ts").over(w), F.lead("ts").over(w))
    return obs.withColumn("is_ping_pong", F.coalesce((before == after) & (F.col("cell_id") != before) & (span <= within_s), F.lit(False)))


def flag_velocity(obs: DataFrame, gps_ms: float = 42.0, cell_ms: float = 80.0, min_gap_s: float = 5.0, order: tuple[str, ...] = ("ts", "id")) -> DataFrame:
    """obs with is_ping_pong: faster from the row before than its kind of position allows; gaps under min_gap_s are passed over."""
    w = Window.partitionBy("imsi").orderBy(*order)
    m = geo.haversine_m(F.lag("lat").over(w), F.lag("lng").over(w), F.col("lat"), F.col("lng"))
    s = times.elapsed_s(F.lag("ts").over(w), F.col("ts"))
    limit = F.when(F.col("source").contains("gps"), gps_ms).otherwise(cell_ms)
    return obs.withColumn("is_ping_pong", F.coalesce((s >= min_gap_s) & (m / s > limit), F.lit(False)))


def drop_flagged(obs: DataFrame) -> DataFrame:
    return obs.where(~F.col("is_ping_pong")).drop("is_ping_pong")


def user_summary(obs: DataFrame) -> DataFrame:
    """Records, first and last time, cells, located records, days and records a day of each user."""
    day = F.to_date("ts")
    out = obs.groupBy("imsi").agg(F.count(F.lit(1)).alias("n_records"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.countDistinct("cell_id").alias("n_cells"), F.count(F.when(F.col("lat").isNotNull() & F.col("lng").isNotNull(), 1)).alias("n_located"), F.countDistinct(day).alias("active_days"))
    return out.withColumn("span_days", F.datediff(F.to_date("last_ts"), F.to_date("first_ts")) + 1).withColumn("avg_per_day", F.col("n_records") / F.col("active_days"))


def keep_users(obs: DataFrame, min_records: int = 10, max_records: int = 100_000, min_days: int = 3) -> DataFrame:
    """The records of users with records and active days within bounds."""
    s = user_summary(obs).where(F.col("n_records").between(min_records, max_records) & (F.col("active_days") >= min_days))
    return obs.join(s.select("imsi"), "imsi", "left_semi")


def home_score(stays: DataFrame) -> Column:
    """Of a stay: half for hours, 0.3 for visits, 0.2 for observations."""
    part = lambda x, full: F.least(F.lit(1.0), x / full)
    return 0.5 * part(F.col("duration_hours"), 8.0) + 0.3 * part(F.col("visit_count"), 3.0) + 0.2 * F.least(F.lit(1.0), F.log1p(F.col("observation_count").cast("double")) / F.log1p(F.lit(100.0)))


def work_score(stays: DataFrame) -> Column:
    return 0.6 * F.col("visit_count") + 0.4 * F.log1p(F.col("duration_hours"))


def label_home_work(stays: DataFrame, min_work_visits: int = 3, min_distance_m: float = 500.0) -> DataFrame:
    """stays (imsi, stay_id, lat, lng, duration_hours, visit_count, observation_count) with stay_type: home, work or other.

    Home has the best home score; work the best work score among the others with enough visits and
    at least min_distance_m from home. Ties go to more observations, then the lesser stay_id.
    """
    w = Window.partitionBy("imsi")
    ranked = stays.withColumn("_h", F.row_number().over(w.orderBy(home_score(stays).desc(), F.desc("observation_count"), "stay_id")))
    home = lambda c: F.first(F.when(F.col("_h") == 1, F.col(c)), ignorenulls=True).over(w)
    far = geo.haversine_m(home("lat"), home("lng"), F.col("lat"), F.col("lng"))
    able = (F.col("_h") > 1) & (F.col("visit_count") >= min_work_visits) & F.coalesce(far >= min_distance_m, F.lit(True))
    ranked = ranked.withColumn("_able", able)
    ranked = ranked.withColumn("_w", F.row_number().over(w.orderBy(F.desc("_able"), work_score(stays).desc(), F.desc("observation_count"), "stay_id")))
    kind = F.when(F.col("_h") == 1, "home").when(F.col("_able") & (F.col("_w") == 1), "work").otherwise("other")
    return ranked.withColumn("stay_type", kind).drop("_h", "_able", "_w")


def purpose(origin_type: Column, dest_type: Column) -> Column:
    """Home-based work, home-based other or not home-based."""
    home = (origin_type == "home") | (dest_type == "home")
    work = (origin_type == "work") | (dest_type == "work")
    return F.when(home & work, "HBW").when(home, "HBO").otherwise("NHB")


def trips_from_observations(obs: DataFrame, place: str = "stay_id", kind: str = "stay_type", day_start: int = 3, order: tuple[str, ...] = ("ts", "id")) -> DataFrame:
    """A trip for each change of place within a user's effective day: last time at the origin, first at the destination.

    obs has imsi, ts, place, kind, lat and lng; rows without a place are passed over.
    """
    known = obs.where(F.col(place).isNotNull()).withColumn("effective_day", times.effective_day(F.col("ts"), day_start))
    w = Window.partitionBy("imsi", "effective_day").orderBy(*order)
    before = lambda c: F.lag(c).over(w)
    moved = known.select("imsi", "effective_day", before(place).alias("origin"), F.col(place).alias("destination"), before("ts").alias("departure"), F.col("ts").alias("arrival"), before(kind).alias("origin_type"), F.col(kind).alias("dest_type"), geo.haversine_m(before("lat"), before("lng"), F.col("lat"), F.col("lng")).alias("distance_m"), *[F.col(c) for c in order if c not in ("ts",)])
    moved = moved.where(F.col("origin").isNotNull() & (F.col("origin") != F.col("destination")))
    number = F.row_number().over(Window.partitionBy("imsi").orderBy("arrival", *[c for c in order if c != "ts"]))
    return moved.withColumns({"trip_no": number, "duration_min": (times.elapsed_s(F.col("departure"), F.col("arrival"))) / 60, "purpose": purpose(F.col("origin_type"), F.col("dest_type")), "period": times.telecom_period(F.col("departure")), "day_type": times.day_type(F.col("departure"))})


def trips_from_stays(stays: DataFrame) -> DataFrame:
    """Trips between a user's stays in the order of their first sighting."""
    w = Window.partitionBy("imsi").orderBy("first_seen", "stay_id")
    after = lambda c: F.lead(c).over(w)
    out = stays.select("imsi", F.col("stay_id").alias("origin"), after("stay_id").alias("destination"), F.col("last_seen").alias("departure"), after("first_seen").alias("arrival"), F.col("stay_type").alias("origin_type"), after("stay_type").alias("dest_type"), geo.haversine_m(F.col("lat"), F.col("lng"), after("lat"), after("lng")).alias("distance_m"))
    return out.where(F.col("destination").isNotNull()).withColumn("purpose", purpose(F.col("origin_type"), F.col("dest_type")))


def plausible_trips(trips: DataFrame, min_m: float = 200.0, max_m: float = 100_000.0, max_min: float = 240.0) -> DataFrame:
    """Trips whose distance and duration are unknown or within bounds."""
    d, t = F.col("distance_m"), F.col("duration_min")
    return trips.where((d.isNull() | d.between(min_m, max_m)) & (t.isNull() | (t <= max_min)))


def activity_chains(trips: DataFrame, need_home: bool = True) -> DataFrame:
    """trips with chain_id, chain_length, is_continuous and is_valid for each user and effective day.

    A chain is continuous if each trip starts where the one before ended, and valid if it also
    begins and ends at home (where need_home).
    """
    w = Window.partitionBy("imsi", "effective_day").orderBy("trip_no")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    joint = F.coalesce(F.lag("destination").over(w) == F.col("origin"), F.lit(True))
    linked = trips.withColumn("_joint", joint)
    continuous = F.min("_joint").over(whole)
    anchored = (F.first("origin_type").over(whole) == "home") & (F.last("dest_type").over(whole) == "home")
    chain = F.dense_rank().over(Window.partitionBy("imsi").orderBy("effective_day"))
    return linked.withColumns({"chain_id": chain, "chain_length": F.count(F.lit(1)).over(whole), "is_continuous": continuous, "is_valid": continuous & (F.coalesce(anchored, F.lit(False)) if need_home else F.lit(True))}).drop("_joint")


def chain_weights(chains: DataFrame, keep_partial: bool = True, partial: float = 0.7) -> DataFrame:
    """Weight 1 for trips of valid chains; others weigh `partial`, or go."""
    weighted = chains.withColumn("chain_weight", F.when(F.col("is_valid"), 1.0).otherwise(partial))
    return weighted if keep_partial else weighted.where("is_valid")


def expand(trips: DataFrame, expected_rate: float = 3.0, market_share: float = 0.35, zone_factors: DataFrame | None = None, vehicle_share: float | None = None) -> DataFrame:
    """trips (imsi, active_days, chain_weight, origin) with user_factor, population_factor and expanded_trips.

    A user's factor brings observed trips a day to the expected rate; the population's is the zone's,
    or one over the market share.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy("imsi"))
    user = F.lit(expected_rate) * F.col("active_days") / n
    out = trips.withColumn("user_factor", user)
    if zone_factors is None:
        out = out.withColumn("population_factor", F.lit(1 / market_share))
    else:
        z = zone_factors.select(F.col("zone").alias("_z"), F.col("factor").alias("_f"))
        out = out.join(z, F.col("origin") == F.col("_z"), "left").withColumn("population_factor", F.coalesce("_f", F.lit(1 / market_share))).drop("_z", "_f")
    total = F.col("user_factor") * F.col("population_factor") * F.coalesce("chain_weight", F.lit(1.0))
    return out.withColumn("expanded_trips", total * vehicle_share if vehicle_share else total)


def calibrate(trips: DataFrame, population: float, days: int = 1, target_rate: float = 3.0) -> DataFrame:
    """Rescales expanded_trips so that trips a person and day meet the target."""
    total = trips.agg(F.sum("expanded_trips")).first()[0] or 0.0
    factor = target_rate * population * days / total if total else 1.0
    return trips.withColumn("expanded_trips", F.col("expanded_trips") * F.lit(factor))


def infer_cells(obs: DataFrame, min_samples: int = 3) -> DataFrame:
    """Cell places from located records: mean, spread as radius (100 to 2000 m) and samples."""
    located = obs.where(F.col("lat").isNotNull() & F.col("lng").isNotNull() & F.col("cell_id").isNotNull())
    spread = (F.stddev_pop("lat") + F.stddev_pop("lng")) / 2 * geo.KM_PER_DEGREE * 1000 * 2
    return located.groupBy("cell_id").agg(F.avg("lat").alias("lat"), F.avg("lng").alias("lng"), F.greatest(F.lit(100.0), F.least(F.lit(2000.0), spread)).alias("radius_m"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_samples)


def tac_zones(obs: DataFrame) -> DataFrame:
    """Bounds, centre and records of each tracking area."""
    located = obs.where(F.col("lat").isNotNull() & F.col("lng").isNotNull() & F.col("tac").isNotNull())
    return located.groupBy("tac").agg(F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max"), F.min("lng").alias("lng_min"), F.max("lng").alias("lng_max"), F.avg("lat").alias("lat"), F.avg("lng").alias("lng"), F.count(F.lit(1)).alias("n"))


def fill_locations(obs: DataFrame, cells: DataFrame) -> DataFrame:
    """obs with missing coordinates taken from their cell."""
    c = cells.select(F.col("cell_id").alias("_c"), F.col("lat").alias("_lat"), F.col("lng").alias("_lng"))
    return obs.join(c, F.col("cell_id") == F.col("_c"), "left").withColumns({"lat": F.coalesce("lat", "_lat"), "lng": F.coalesce("lng", "_lng")}).drop("_c", "_lat", "_lng")
