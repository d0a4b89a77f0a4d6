"""Writers: partitioned Parquet, CSV and JSON, wide matrices, GeoJSON and versioned tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, by: list[str] = (), mode: str = "overwrite") -> None:
    """zstd Parquet, in folders by the partition columns."""
    w = df.write.mode(mode).option("compression", "zstd")
    (w.partitionBy(*by) if by else w).parquet(path)


def write_buckets(df: DataFrame, path: str, key: str, n: int) -> None:
    """Parquet files by hash of a key, so that each key is in one file."""
    df.repartition(n, key).write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_csv(df: DataFrame, path: str, by: list[str] = (), mode: str = "overwrite") -> None:
    w = df.write.mode(mode).option("header", True)
    (w.partitionBy(*by) if by else w).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def wide(matrix: DataFrame, value: str, destinations: list[str] | None = None) -> DataFrame:
    """(origin, one column for each destination): for export only."""
    return matrix.groupBy("origin").pivot("destination", destinations).agg(F.first(value)).orderBy("origin")


def feature(geometry: Column, properties: list[str]) -> Column:
    """A GeoJSON feature as text; geometry is JSON text."""
    return F.concat(F.lit('{"type":"Feature","geometry":'), geometry, F.lit(',"properties":'), F.to_json(F.struct(*properties)), F.lit("}"))


def point_geometry(lat: Column, lng: Column) -> Column:
    return F.to_json(F.struct(F.lit("Point").alias("type"), F.array(lng, lat).alias("coordinates")))


def polygon_geometry(ring: Column) -> Column:
    """Of array<struct<lat, lng>>, closed."""
    pairs = F.transform(F.concat(ring, F.slice(ring, 1, 1)), lambda p: F.array(p["lng"], p["lat"]))
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(pairs).alias("coordinates")))


def write_features(df: DataFrame, geometry: Column, properties: list[str], path: str) -> None:
    """One feature a line."""
    df.select(feature(geometry, properties)).write.mode("overwrite").text(path)


def supersede(current: DataFrame, new: DataFrame, keys: list[str], stamp: str) -> DataFrame:
    """All generations, with is_current on the latest of each key only."""
    from pyspark.sql import Window

    every = current.drop("is_current").unionByName(new.drop("is_current"), allowMissingColumns=True)
    return every.withColumn("is_current", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(stamp), *[F.col(c).desc_nulls_last() for c in sorted(every.columns) if c not in {*keys, stamp}])) == 1)


def upsert_missing(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """current and those rows of new whose keys it lacks."""
    return current.unionByName(new.join(current.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def write_jdbc(df: DataFrame, url: str, name: str, mode: str = "append", **options: str) -> None:
    df.write.format("jdbc").option("url", url).option("dbtable", name).options(**options).mode(mode).save()
