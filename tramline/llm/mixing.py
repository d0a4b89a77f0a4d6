"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents are shuffled by a hash and seen as one stream of words, cut into blocks of
equally many words and repeated for at most two epochs. A source with target t owns the first
ceil(t / block) blocks, the last cut short at the target. The slots of the schedule are the
numbers below the total of blocks, visited in van der Corput order (reversed bits): each number
falls into one source's interval of the cumulated block counts, so each source gets exactly its
number of slots, spread evenly over the schedule. Slots are ranked within their source, and rank r
takes the source's block r.

Everything is built from DataFrame functions. Ranks and running sums go over buckets of about the
square root of the rows, then over rows within a bucket, so that no source is gathered in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tramline.llm.common import WORD, settle, small, table, text_of

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MAX_REPEATS = 2
BLOCK_WORDS = 1024
SEED = "mix-1"
#: A table of sources up to this many rows is sent to all executors; a larger one is joined by a shuffle.
SMALL_SOURCES = 10_000
_PARTS = 64


def sized(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(doc_id, source, size): the words of each row's text, null as none."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("size"))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MAX_REPEATS) -> DataFrame:
    """One row for each source: sid (rank by code points from 0, null last), source_size, weight, target.

    The weights repeat along the ranks. The targets share `share` times all words by weight; none
    exceeds `most` times its source's words, and the excess goes to the others by weight until
    none does.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    dealt = settle(sums.repartitionByRange(_PARTS, F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    before, at = {}, 0
    for row in sorted(dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r["part"]):
        before[row["part"]], at = at, at + row["n"]
    offset = F.coalesce(*[F.when(F.col("part") == p, F.lit(n)) for p, n in before.items()], F.lit(0)) if before else F.lit(0)
    within = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    sid = (offset + within - 1).cast("long")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("sid"), F.lit(len(weights))) + 1).cast("int"))
    ranked = settle(dealt.withColumn("sid", sid).select("source", "sid", "source_size", weight.alias("weight")))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    cap, level, last = most * F.col("source_size"), 0.0, None
    while level != last:
        last = level
        full = cap < F.col("weight") * level if level else F.lit(False)
        taken, open_weight = ranked.agg(F.sum(F.when(full, cap).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        level = (share * total - taken) / open_weight if open_weight else level
    return ranked.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))


def _ranges(rows: DataFrame, keys: list[str], bucket: str, order: list, amount) -> DataFrame:
    """rows with `before`: the sum of amount over the rows of the same keys that come earlier, and
    `nth`, the place within the bucket. Buckets are ordered as the rows are."""
    sums = rows.groupBy(*keys, bucket).agg(F.sum(amount).alias("_sum"))
    ahead = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_ahead", F.coalesce(F.sum("_sum").over(ahead), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*keys, bucket).orderBy(*order)
    own = F.coalesce(F.sum(amount).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = rows.withColumn("_own", own).withColumn("nth", F.row_number().over(inside))
    return each.join(sums, [*keys, bucket]).withColumn("before", F.col("_ahead") + F.col("_own")).drop("_ahead", "_own")


def schedule(spark: SparkSession, shares: DataFrame, block: int) -> DataFrame:
    """(slot, sid, rank): the slots in order; rank r of a source takes its block r.

    shares has sid and n_blocks.
    """
    ahead = Window.partitionBy("part").orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    width = max(1, math.isqrt(shares.count()))
    parted = shares.withColumn("part", F.floor(F.col("sid") / width))
    sums = parted.groupBy("part").agg(F.sum("n_blocks").alias("n"))
    sums = sums.withColumn("one", F.lit(1)).withColumn("at", F.coalesce(F.sum("n").over(Window.partitionBy("one").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.coalesce(F.sum("n_blocks").over(ahead), F.lit(0))
    spans = settle(parted.withColumn("own", own).join(sums.select("part", "at"), "part").select("sid", (F.col("at") + F.col("own")).alias("lo"), "n_blocks").where("n_blocks > 0"))
    total = spans.agg(F.sum("n_blocks")).first()[0] or 0
    bits = max(1, (total - 1).bit_length())
    bucket = -(-total // 4096) or 1
    cover = spans.select("sid", "lo", "n_blocks", F.explode(F.sequence(F.floor(F.col("lo") / bucket), F.floor((F.col("lo") + F.col("n_blocks") - 1) / bucket))).alias("bucket"))
    points = spark.range(total).select(F.col("id").alias("point"), F.floor(F.col("id") / bucket).alias("bucket"), F.conv(F.reverse(F.lpad(F.bin("id"), bits, "0")), 2, 10).cast("long").alias("slot"))
    hit = points.join(small(cover, SMALL_SOURCES), "bucket").where((F.col("point") >= F.col("lo")) & (F.col("point") < F.col("lo") + F.col("n_blocks")))
    chunk = max(1024, math.isqrt(total))
    slots = hit.select("slot", "sid", F.floor(F.col("slot") / chunk).alias("chunk"))
    return _ranges(slots, ["sid"], "chunk", ["slot"], F.lit(1)).select("slot", "sid", F.col("before").alias("rank"))


def plan(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, block: int = BLOCK_WORDS, seed: str = SEED, **cols) -> tuple[DataFrame, DataFrame]:
    """(rows, pieces) of the mix.

    rows: one for each document with doc_id, source, size, source_size, target and its place in
    its source's stream (sid, spot, nth). pieces: slot, sid, rank, spot, nth, doc_id, epoch, start,
    words: what the schedule takes of which document, `words` words of it from word `start` on.

    The order depends on doc_id, size and the seed alone, so that reruns agree; rows that tie in
    all are alike. Texts without words have no pieces. An empty table gives empty results.
    """
    spark = docs.sparkSession
    each = settle(sized(docs, **cols))
    want = F.round("target").cast("long")
    shares = settle(targets(each, weights, share).withColumn("want", want).withColumn("n_blocks", F.ceil(F.col("want") / block)))
    digits = max(2, round(math.log(max(1, each.count()), 16) / 2))
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":" + seed)))
    keyed = each.join(small(shares, SMALL_SOURCES).withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    keyed = keyed.withColumn("key", key).withColumn("spot", F.substring("key", 1, digits))
    rows = settle(_ranges(keyed, ["sid"], "spot", ["key", F.col("doc_id").asc_nulls_first(), "size"], F.col("size")).drop("key", "weight"))
    twice = rows.where("size > 0").withColumn("epoch", F.explode(F.array(*map(F.lit, range(MAX_REPEATS)))))
    begin = F.col("epoch") * F.col("source_size") + F.col("before")
    laid = twice.withColumn("begin", begin).withColumn("end", F.least(F.col("begin") + F.col("size"), F.col("want"))).where("begin < end")
    laid = laid.withColumn("rank", F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("end") - 1) / block))))
    lo, hi = F.greatest("begin", F.col("rank") * block), F.least("end", (F.col("rank") + 1) * block)
    parts = laid.select("sid", "rank", "spot", "nth", "doc_id", "epoch", (lo - F.col("begin")).alias("start"), (hi - lo).alias("words"))
    pieces = schedule(spark, shares.select("sid", "n_blocks"), block).join(parts, ["sid", "rank"])
    return rows, pieces


def taken(rows: DataFrame, pieces: DataFrame) -> DataFrame:
    """rows with taken, the words that the mix takes of each document, repeats counted, and first_slot, where it first does (-1: never)."""
    sums = pieces.groupBy("sid", "spot", "nth").agg(F.sum("words").alias("_taken"), F.min("slot").alias("first_slot"))
    return rows.join(sums, ["sid", "spot", "nth"], "left").withColumns({"taken": F.coalesce("_taken", F.lit(0)).cast("long"), "first_slot": F.coalesce("first_slot", F.lit(-1)).cast("long")}).drop("_taken")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_slot of every document."""
    return taken(*plan(table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, whole, in the order of the schedule: one copy for each time that most of a document is taken.

    A document id (null is one, too) is repeated round(taken / size) times (of all its rows
    together), so at most twice; documents without words, which no block holds, stay once. A copy
    stands at the slot that first takes of it, documents without words come first. Partitions are
    ranges of slots, so that sources keep their shares in every part of the mix. All columns stay,
    and texts are read whole, however long.
    """
    rows, pieces = plan(docs)
    per = pieces.groupBy("sid", "spot", "nth").agg(F.sum("words").alias("_t"), *[F.min(F.when(F.col("epoch") == e, F.col("slot"))).alias(f"_s{e}") for e in range(MAX_REPEATS)])
    slots = [f"_s{e}" for e in range(MAX_REPEATS)]
    found = rows.join(per, ["sid", "spot", "nth"], "left").groupBy("doc_id").agg(F.coalesce(F.sum("_t"), F.lit(0)).alias("_t"), F.sum("size").alias("_s"), *[F.min(s).alias(s) for s in slots])
    number = F.when(F.col("_s") == 0, 1).otherwise(F.round(F.col("_t") / F.col("_s"))).cast("int")
    copies = settle(found.select(F.col("doc_id").alias("_id"), F.slice(F.array(*slots), 1, number).alias("_slots")).where(F.size("_slots") > 0))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    out = keyed.join(copies, F.col("_row")["doc_id"].eqNullSafe(F.col("_id"))).select("_row", F.explode("_slots").alias("_slot"))
    spread = F.xxhash64(F.col("_row")["doc_id"])  # so that documents without words fill several ranges
    ordered = out.withColumn("_spread", spread).repartitionByRange("_slot", "_spread").sortWithinPartitions("_slot", "_spread")
    return ordered.select(*[F.col("_row")[c].alias(c) for c in docs.columns])


ORACLE_OP10 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':mix-1') AS k
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w
  FROM d GROUP BY source),
lam(i, l) AS (
  SELECT 0, (SELECT 1.5::DOUBLE * sum(source_size)::DOUBLE / sum(w) FROM s)
  UNION ALL
  SELECT i + 1, (SELECT (1.5::DOUBLE * sum(source_size)::DOUBLE - sum(CASE WHEN 2.0::DOUBLE * source_size < w * lam.l THEN 2.0::DOUBLE * source_size ELSE 0 END))
                        / sum(CASE WHEN 2.0::DOUBLE * source_size < w * lam.l THEN 0 ELSE w END) FROM s)
  FROM lam WHERE i < 60),
t AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, w * (SELECT l FROM lam WHERE i = 60)) AS target FROM s),
o AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, round(t.target)::BIGINT AS want,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
n AS (
  SELECT source, b, coalesce(sum(b) OVER (ORDER BY source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo
  FROM (SELECT source, ceil(round(target)::BIGINT / 1024.0)::BIGINT AS b FROM t)),
v AS (SELECT unnest(range((SELECT sum(b) FROM n)::BIGINT)) AS point, greatest(1, length(bin(greatest(1, (SELECT sum(b) FROM n)::BIGINT - 1)))) AS bits),
k AS (
  SELECT n.source, x.slot, row_number() OVER (PARTITION BY n.source ORDER BY x.slot) - 1 AS rank
  FROM (SELECT point, list_sum(list_transform(range(bits), lambda i: ((point >> i) & 1) << (bits - 1 - i)))::BIGINT AS slot FROM v) x
  JOIN n ON x.point >= n.lo AND x.point < n.lo + n.b)
SELECT o.doc_id, size, source_size, target,
       (greatest(0, least(pos + size, want) - pos) + greatest(0, least(source_size + pos + size, want) - source_size - pos))::BIGINT AS taken,
       coalesce(k.slot, -1)::BIGINT AS first_slot
FROM o LEFT JOIN k ON o.source IS NOT DISTINCT FROM k.source AND o.size > 0 AND o.pos < o.want AND k.rank = o.pos // 1024
"""
