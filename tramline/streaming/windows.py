"""Structured Streaming forms of the time-windowed operators. They also run on static tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.operators.storage import shared_folder


def stream_table(spark, folder: str, name: str) -> DataFrame:
    """A Parquet table as a stream of its files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder) if _is_file(spark, f"{folder}/{name}.parquet") else spark.readStream.schema(schema).parquet(f"{folder}/{name}.parquet")


def _is_file(spark, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


def with_clock(df: DataFrame, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """A watermark needs an instant: ts is read as UTC."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def tumbling(df: DataFrame, width: str, keys: list[str], aggs: list, ts: str = "ts") -> DataFrame:
    return df.groupBy(F.window(ts, width).alias("w"), *keys).agg(*aggs).withColumns({"window_start": F.col("w.start"), "window_end": F.col("w.end")}).drop("w")


def sliding(df: DataFrame, width: str, step: str, keys: list[str], aggs: list, ts: str = "ts") -> DataFrame:
    return df.groupBy(F.window(ts, width, step).alias("w"), *keys).agg(*aggs).withColumns({"window_start": F.col("w.start"), "window_end": F.col("w.end")}).drop("w")


def sessions(df: DataFrame, gap: str, keys: list[str], aggs: list, ts: str = "ts") -> DataFrame:
    """Sessions that end after a gap of silence."""
    return df.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(*aggs).withColumns({"session_start": F.col("w.start"), "session_end": F.col("w.end")}).drop("w")


def first_within(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key within the watermark."""
    return df.dropDuplicatesWithinWatermark(keys)


def run_to_table(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a stream over all that is there now and returns the result, a table in the shared folder.

    In complete mode each batch replaces the result, else it is appended.
    """
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    spark.createDataFrame([], stream.schema).write.parquet(f"{folder}/result")
    how = "overwrite" if mode == "complete" else "append"
    query = stream.writeStream.foreachBatch(lambda batch, _: batch.write.mode(how).parquet(f"{folder}/result")).option("checkpointLocation", f"{folder}/log").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/result")


def run_to_files(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Appends all that is there now to Parquet, with a checkpoint from which it goes on after a failure."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
