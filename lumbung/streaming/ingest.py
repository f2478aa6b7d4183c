"""Incremental ingest of chunk files: what the batch manifest does, as a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.jsonl import scan_strict


def stream_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of new files under a folder with outcome, text and metadata; the checkpoint of the query
    that reads it is the manifest: a file is read once."""
    return scan_strict(spark.readStream.text(folder))


def ingest_new(spark: SparkSession, folder: str, target: str, checkpoint: str) -> None:
    """Append the sound rows of files not yet seen to a Parquet table, then stop. Ids are made from the
    text alone, so a batch that runs twice gives the same points."""
    rows = stream_chunks(spark, folder).filter("outcome = 'row'").select(X.uuid5(F.col("text")).alias("id"), "text", "metadata")
    rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
