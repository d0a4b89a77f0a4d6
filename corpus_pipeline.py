"""The corpus pipeline: quality, near-duplicates, secrets, mixing, and token ids with the digest of their decoding."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tramline.llm import mixing, pieces, quality, secrets, simhash
from tramline.llm.common import remove, scratch, scratch_dir, table

STAGES = [
    ("quality classifier", quality.reject_poor),
    ("SimHash near-dedup", simhash.keep_one),
    ("secret scans", secrets.redact),
    ("mixing sources to target weights", mixing.mix),
    ("SentencePiece encoding and decoding", pieces.tokens),
]

#: Classifiers, components and merges are beyond SQL; the stages are tested against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on documents, each one's rows written as Parquet to the shared folder and read again.

    What a stage has stored on its way, and the rows of all stages but the last, are removed when the next one is written.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{scratch_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for nth, (_, stage) in enumerate(STAGES):
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{nth}")
        if nth:
            remove(spark, f"{folder}/{nth - 1}")
        docs = spark.read.parquet(f"{folder}/{nth}")
    return docs
