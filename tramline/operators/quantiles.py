"""Exact quantiles of columns that no single task can hold."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tramline.operators.storage import cut

#: Ranges into which values are split; each is sorted by one task, and only those with a wanted rank are.
RANGES = 200


def exact_quantiles(df: DataFrame, value: str, shares: list[float]) -> list[float] | None:
    """Quantiles with linear interpolation between ranks, nulls left out; None without values.

    Equal values are counted first, so that a value that is frequent fills no range. The values are
    then split into ordered ranges; the ranks wanted are found from the ranges' counts.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    dealt = cut(counted.repartitionByRange(RANGES, "v").withColumn("part", F.spark_partition_id()))
    sizes = sorted((r["part"], r["n"]) for r in dealt.groupBy("part").agg(F.sum("n").alias("n")).collect())
    total = sum(n for _, n in sizes)
    if not total:
        return None
    before, at = {}, 0
    for part, n in sizes:
        before[part], at = at, at + n
    wanted = sorted({r for s in shares for r in (math.floor(s * (total - 1)), math.ceil(s * (total - 1)))})
    parts = [p for p, n in sizes if any(before[p] <= r < before[p] + n for r in wanted)]
    start = F.coalesce(*[F.when(F.col("part") == p, F.lit(before[p])) for p in parts])
    upto = F.sum("n").over(Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)) + start
    ranked = dealt.where(F.col("part").isin(parts)).withColumn("hi", upto)
    hit = F.filter(F.array(*map(F.lit, wanted)), lambda r: (r < F.col("hi")) & (r >= F.col("hi") - F.col("n")))
    found = {r["rank"]: r["v"] for r in ranked.select("v", F.explode(hit).alias("rank")).collect()}
    out = []
    for s in shares:
        place = s * (total - 1)
        lo, hi = found[math.floor(place)], found[math.ceil(place)]
        out.append(lo + (hi - lo) * (place - math.floor(place)))
    return out
