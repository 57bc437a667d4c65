"""Incremental refresh of chunks and postings; an extension beside the batch engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.functions.text import tokens
from quillon.operators.ingest import changed


def refresh(batch: DataFrame, known: DataFrame) -> DataFrame:
    """document_id, sha256, token, tf of the documents of a batch that are new or changed."""
    new = batch.withColumn("sha256", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    fresh = changed(known, new)
    return fresh.select("document_id", "sha256", F.explode(tokens(F.col("text"))).alias("token")).groupBy("document_id", "sha256", "token").agg(F.count(F.lit(1)).alias("tf"))


def start(stream: DataFrame, path: str, checkpoint: str, known: Callable[[], DataFrame]) -> StreamingQuery:
    """Each micro-batch's changed documents as a folder of postings, rewritten if the batch comes again."""

    def write(batch: DataFrame, number: int) -> None:
        refresh(batch, known()).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
