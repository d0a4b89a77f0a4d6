"""Whole runs: demand from mobile-network records, zones from cells, and the evaluation of fused tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.functions import geo, times
from tramline.operators import od, shapes, stays, telecom, zones
from tramline.operators.nearest import asof_nearest

#: The steps of telecom_demand, in order.
DEMAND_STEPS = ("fuse", "preprocess", "cells", "zones", "stays", "home_work", "trips", "expand", "matrix")


def telecom_demand(observations: list[DataFrame], steps: tuple[str, ...] = DEMAND_STEPS, given: dict[str, DataFrame] | None = None, market_share: float = 0.35) -> dict[str, DataFrame]:
    """From observations (imsi, ts, cell_id, tac, lat, lng, source, confidence) of several sources to matrices of expanded trips.

    steps selects a part of DEMAND_STEPS; what earlier steps would give may be passed in `given`. All
    results are plans that run when used: users are spread over tasks, so no chunks are needed.
    """
    if unknown := set(steps) - set(DEMAND_STEPS):
        raise ValueError(f"no such steps: {', '.join(sorted(unknown))}")
    out = dict(given or {})
    if "fuse" in steps:
        out["fused"] = telecom.fuse_weighted(telecom.union_sources(*observations))
    if "preprocess" in steps:
        at = F.timestamp_add("SECOND", F.col("bucket"), F.lit("1970-01-01").cast("timestamp_ntz"))
        flat = out["fused"].withColumns({"ts": at, "id": F.xxhash64("imsi", "bucket")}).drop("bucket")
        out["users"] = telecom.user_summary(flat)
        out["records"] = telecom.keep_users(flat)
    if "cells" in steps:
        out["towers"] = telecom.infer_cells(out["records"])
        out["records"] = telecom.drop_flagged(telecom.flag_aba(telecom.fill_locations(out["records"], out["towers"])))
    if "zones" in steps:
        out["areas"] = telecom.tac_zones(out["records"])
    if "stays" in steps:
        out["stays"] = stays.detect_stays(out["records"])
    if "home_work" in steps:
        out["stays"] = telecom.label_home_work(out["stays"])
    if "trips" in steps:
        found = telecom.trips_from_stays(out["stays"])
        minutes = F.greatest(F.lit(0.0), times.elapsed_s(F.col("departure"), F.col("arrival")) / 60)
        out["trips"] = telecom.plausible_trips(found.withColumn("duration_min", minutes))
    if "expand" in steps:
        days = out["users"].select("imsi", "active_days")
        weighed = out["trips"].join(days, "imsi").withColumn("chain_weight", F.lit(1.0))
        out["trips"] = telecom.expand(weighed, market_share=market_share)
    if "matrix" in steps:
        place = lambda side: out["stays"].select("imsi", F.col("stay_id").alias(side), F.col("cell_id").alias(f"{side}_zone"))
        zoned = out["trips"].join(place("origin"), ["imsi", "origin"], "left").join(place("destination"), ["imsi", "destination"], "left")
        out["matrix"] = od.od_matrix(zoned, "origin_zone", "destination_zone", "expanded_trips")
        out["by_purpose"] = od.od_matrix(zoned, "origin_zone", "destination_zone", "expanded_trips", ["purpose"])
        out["summary"] = od.summary(out["matrix"])
    return out


def generate_zones(cells: DataFrame, edges: DataFrame, barriers: DataFrame, min_population: float, area: str = "district") -> dict[str, DataFrame]:
    """From cells (district, cell, population, employment, barrier, lat, lng, polygon) and their neighbour edges to zones.

    Steps: cells that barriers meet are told (crossed), features are standardised, regions grown,
    zones summed up and placed, and a skim made between their centres.
    """
    crossed = shapes.zone_barriers(cells, barriers, "cell").select("cell", F.lit(True).alias("is_crossed")).distinct()
    marked = cells.join(crossed, "cell", "left").fillna(False, ["is_crossed"])
    grown = zones.grow_regions(zones.z_scores(marked, ["population", "employment"]), edges, area, min_population)
    placed = marked.join(grown, [area, "cell"]).withColumn("zone_id", F.concat_ws("_", F.col(area).cast("string"), F.col("zone").cast("string")))
    sums = placed.groupBy("zone_id", area).agg(
        F.sum("population").alias("population"), F.sum("employment").alias("employment"), F.count(F.lit(1)).alias("n_cells"), F.sum(geo.polygon_area_m2(F.col("polygon")) / 1e6).alias("area_km2"),
        (F.sum(F.col("lat") * F.col("population")) / F.sum("population")).alias("lat"), (F.sum(F.col("lng") * F.col("population")) / F.sum("population")).alias("lng"), F.max("is_crossed").alias("is_crossed"),
    )
    return {"cells": placed, "zones": sums, "skim": zones.skim(sums)}


def evaluate_fusion(truth: DataFrame, tracks: dict[str, DataFrame], within_s: float = 30.0) -> DataFrame:
    """A row for each track (trip_id, id, ts, lat, lng): points, truth points met, coverage, RMSE and mean distance in metres.

    Each truth point meets the nearest point in time of the same trip within within_s.
    """
    n = truth.count()
    rows = []
    for name, track in sorted(tracks.items()):
        near = asof_nearest(truth.select("trip_id", "id", "ts", F.col("lat").alias("t_lat"), F.col("lng").alias("t_lng")), track.select("trip_id", "ts", "lat", "lng"), ["trip_id"], "ts", "id", within_s, ["lat", "lng"])
        d = geo.haversine_m(F.col("t_lat"), F.col("t_lng"), F.col("lat"), F.col("lng"))
        met, square, mean = near.where("lat is not null").agg(F.count(F.lit(1)), F.avg(d * d), F.avg(d)).first()
        rows.append((name, track.count(), met, met / n if n else 0.0, square**0.5 if square is not None else None, mean))
    found = truth.sparkSession.createDataFrame(rows, "algorithm string, n_points long, n_met long, coverage double, rmse_m double, mean_m double")
    return found


def sample_flows(od_pairs: DataFrame, travel_s, captured_at) -> DataFrame:
    """od_pairs (origin, destination, area_km2 of the origin) with seconds of a trip as captured: from travel_s between zones, by area within a zone."""
    seconds = F.when(F.col("origin") == F.col("destination"), zones.intra_zonal_s(F.col("area_km2"))).otherwise(travel_s)
    return od_pairs.withColumns({"seconds": seconds, "captured_at": captured_at, "is_imputed": F.col("origin") == F.col("destination"), "minute": times.minutes_of_day(captured_at)})
