"""Stored generations of zones: cities, current versions, unions of their tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def city_key(name: Column) -> Column:
    """Lower case, trimmed, commas gone, blanks as underscores."""
    return F.regexp_replace(F.replace(F.trim(F.lower(name)), F.lit(","), F.lit("")), r"\s+", "_")


def place_of_folder(folder: Column) -> Column:
    """old_town_country as Old, Town, Country."""
    return F.array_join(F.transform(F.split(folder, "_"), lambda p: F.initcap(p)), ", ")


def latest(generations: DataFrame, keys: list[str], stamp: str = "created_at", ident: str = "generation_id") -> DataFrame:
    """The newest generation of each key, the larger id on a tie."""
    return generations.groupBy(*keys).agg(F.max_by(ident, F.struct(stamp, ident)).alias(ident), F.max(stamp).alias(stamp))


def find(generations: DataFrame, ident: str = "generation_id", stamp: str = "created_at", **wanted) -> DataFrame:
    """The newest generation with the given parameters, if any."""
    out = generations
    for k, v in wanted.items():
        out = out.where(F.col(k).eqNullSafe(F.lit(v)))
    return out.orderBy(F.desc(stamp), F.desc(ident)).limit(1)


def set_current(generations: DataFrame, ident: int, key: str = "city") -> DataFrame:
    """is_current on one generation and off for the others of its city."""
    mine = F.max(F.when(F.col("generation_id") == ident, True)).over(Window.partitionBy(key))
    return generations.withColumn("is_current", F.when(F.coalesce(mine, F.lit(False)), F.col("generation_id") == ident).otherwise(F.col("is_current")))


def cities(city: DataFrame, generations: DataFrame) -> DataFrame:
    """Cities with their generations' number and latest time, the latest first, those without last."""
    g = generations.groupBy("city").agg(F.count(F.lit(1)).alias("n_generations"), F.max("created_at").alias("latest"))
    return city.join(g, "city", "left").withColumn("n_generations", F.coalesce("n_generations", F.lit(0))).orderBy(F.desc_nulls_last("latest"), "city")


def remove(tables: dict[str, DataFrame], ident: int) -> dict[str, DataFrame]:
    """All tables without the rows of a generation."""
    return {k: t.where(~F.col("generation_id").eqNullSafe(F.lit(ident))) for k, t in tables.items()}


def zones_with_city(zones: DataFrame, generations: DataFrame, city: DataFrame) -> DataFrame:
    return zones.join(generations, "generation_id").join(city, "city")
