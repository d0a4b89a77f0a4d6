"""Cleaning of GPS pings: filter funnel, keep-first deduplication and the jump filter."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions import geo, times


@dataclass(frozen=True)
class CleanRules:
    lat_min: float = 18.8894
    lat_max: float = 19.3274
    lng_min: float = 72.7692
    lng_max: float = 73.1165
    buffer_deg: float = 0.15
    max_speed_kmh: float = 120.0
    max_deviation_s: float = 300.0


def in_box(lat: Column, lng: Column, r: CleanRules) -> Column:
    b = r.buffer_deg
    return lat.between(r.lat_min - b, r.lat_max + b) & lng.between(r.lng_min - b, r.lng_max + b) & (lat != 0) & (lng != 0)


def clean_pings(pings: DataFrame, start=None, end=None, rules: CleanRules = CleanRules()) -> DataFrame:
    """Pings inside the study window and box, deviations within bounds or unknown; speeds over the
    limit become null; ride_date, year, month and hour are added."""
    ts = F.col("ts")
    keep = ts.isNotNull() & in_box(F.col("lat"), F.col("lng"), rules)
    if start is not None:
        keep = keep & ts.between(F.lit(start), F.lit(end))
    keep = keep & (F.col("deviation_s").isNull() | (F.abs("deviation_s") <= rules.max_deviation_s))
    return pings.where(keep).withColumns(
        {"speed": F.when(F.col("speed") <= rules.max_speed_kmh, F.col("speed")), "ride_date": F.to_date(ts), "year": F.year(ts).cast("short"), "month": F.month(ts).cast("byte"), "hour": F.hour(ts).cast("byte")}
    )


def funnel_counts(pings: DataFrame, rules: CleanRules = CleanRules()) -> DataFrame:
    """One row: how many pings pass each filter and all before it."""
    box = in_box(F.col("lat"), F.col("lng"), rules)
    late = F.col("deviation_s").isNull() | (F.abs("deviation_s") <= rules.max_deviation_s)
    slow = F.col("speed").isNull() | (F.col("speed") <= rules.max_speed_kmh)
    dated = F.col("ts").isNotNull()
    n = lambda c: F.count_if(c)
    return pings.agg(F.count(F.lit(1)).alias("n_raw"), n(dated).alias("n_dated"), n(dated & box).alias("n_box"), n(dated & box & late).alias("n_deviation"), n(dated & box & late & slow).alias("n_speed"))


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by an explicit order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def jump_filter(pings: DataFrame, max_kmh: float = 120.0, order: tuple[str, ...] = ("ts", "id")) -> DataFrame:
    """Drops pings that would need more than max_kmh from the one before, which may itself be dropped.

    Pings without a predecessor or without time since it stay.
    """
    w = Window.partitionBy("vehicle_id").orderBy(*order)
    km = geo.haversine_m(F.lag("lat").over(w), F.lag("lng").over(w), F.col("lat"), F.col("lng")) / 1000
    hours = (times.elapsed_s(F.lag("ts").over(w), F.col("ts"))) / 3600
    speed = F.when(hours > 0, km / hours)
    return pings.withColumn("jump_kmh", speed).where(F.col("jump_kmh").isNull() | (F.col("jump_kmh") <= max_kmh))


def null_tokens(col: Column, tokens: tuple[str, ...] = ("nan", "None", "NaN", "<NA>", "", "NULL", "null")) -> Column:
    """A text column with the tokens for missing values as null."""
    return F.when(~F.trim(col).isin(*tokens), col)


def repair_coordinates(df: DataFrame, fixes: DataFrame, key: str, valid: Column) -> DataFrame:
    """lat and lng of fixes where those of df are invalid or null."""
    f = fixes.select(F.col(key).alias("_k"), F.col("lat").alias("_lat"), F.col("lng").alias("_lng"))
    bad = ~F.coalesce(valid, F.lit(False))
    joined = df.join(f, F.col(key) == F.col("_k"), "left")
    return joined.withColumns({"lat": F.when(bad, F.coalesce("_lat", "lat")).otherwise(F.col("lat")), "lng": F.when(bad, F.coalesce("_lng", "lng")).otherwise(F.col("lng"))}).drop("_k", "_lat", "_lng")
