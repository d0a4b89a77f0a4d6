"""What the operators share: table access, words, lineage cuts and connected components."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the words of a text that is not null."""
    return F.filter(F.split(text, GAP), lambda w: w != "")


def let(value: Column, body) -> Column:
    """body(value) with the value computed once per row, whatever the optimizer inlines."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir. Without one, a local
    session (as in tests) gets a temporary folder; a cluster must name one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage through reliable storage that every executor can reach."""
    scratch_dir(df.sparkSession)
    return df.checkpoint()


_SCOPES: list[str] = []


def stored(df: DataFrame) -> DataFrame:
    """As settle, for large tables: Parquet in the shared folder takes less room than a checkpoint."""
    at = f"{_SCOPES[-1] if _SCOPES else scratch_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def remove(spark: SparkSession, at: str) -> None:
    """Remove a folder of the shared storage."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def exists(spark: SparkSession, at: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables stored inside are removed at the end; what is computed from them must be written by then."""
    _SCOPES.append(f"{scratch_dir(spark)}/scratch-{uuid.uuid4().hex}")
    try:
        yield
    finally:
        remove(spark, _SCOPES.pop())


def small(df: DataFrame, most_rows: int) -> DataFrame:
    """df with a broadcast hint if a count proves it to have at most most_rows rows; else df as it is."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge table as (node, component).

    component is the smallest node that can be reached. Nodes without an edge to another node do
    not appear. Self-loops and repeated edges are harmless; edges with a null end are ignored.

    Alternating large-star and small-star rounds: each node points its larger (then its smaller)
    neighbours at the smallest one it sees. Minima are grouped aggregates joined back, so that a
    hub is never gathered in one task, and each round's edges are checkpointed.
    """
    x, y = F.col(a), F.col(b)
    now = settle(edges.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct())
    before = None
    while before != (mark := _mark(now)) and mark[0]:
        before = mark
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(down, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v")))
        now = settle(star.distinct())
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]
