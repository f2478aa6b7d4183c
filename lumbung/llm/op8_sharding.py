"""Rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import KeyRanges, documents

#: Rows that one task numbers at once, and the most (shard, range) counts that are broadcast.
ROWS_A_RANGE, MOST_COUNTS = 20_000, 1_000_000


def scores(key: Column, weights: list[float]) -> Column:
    """array<struct<score, shard>>: each shard's score for ``key``; the least score wins.

    ``-ln(u) / weight`` with u from a hash of key and shard alone: a shard wins in proportion to its
    weight, and another shard changes no score but its own, so rows move only into it.
    """
    text = F.coalesce(key.cast("string"), F.lit("null"))
    each = []
    for shard, weight in enumerate(weights):
        h = F.shiftrightunsigned(F.xxhash64(text, F.lit(shard)), 11).cast("double")
        each.append(F.struct((-F.log((h + 0.5) / float(1 << 53)) / float(weight)).alias("score"), F.lit(shard).alias("shard")))
    return F.array(*each)


def shard_records(docs: DataFrame, weights: list[float], grown_weight: float = 1.0, key: str = "doc_id", overhead: int = 16) -> DataFrame:
    """Shard and slot of every document, and its shard once one more is added.

    A row's shard needs its key alone: no shuffle and no state. The slot numbers the rows of a shard
    by key from 0. It is made in two levels, so that no task sorts a whole shard: rows are numbered
    within (shard, range of keys), and the counts of the ranges before are added; those counts, at
    most ``MOST_COUNTS`` of them, are the one thing broadcast.

    Columns: doc_id, size (UTF-8 bytes and ``overhead``), text_crc32, law, shard, slot, grown_shard.
    Null texts have ``overhead`` alone and the checksum of no bytes. Null keys are one key. Repeated
    keys share a shard and get slots of their own, by checksum. Other columns are ignored; an empty
    table gives no rows. Very long texts are only measured and summed, where they are read.
    """
    ranges = KeyRanges(docs, ROWS_A_RANGE, max(1, MOST_COUNTS // len(weights)), key)
    own = F.col(key)

    def placed(df: DataFrame) -> DataFrame:
        every = scores(own, [*weights, grown_weight])
        return (
            df.withColumn("all", every)
            .withColumn("best", F.array_min(F.slice("all", 1, len(weights))))
            .withColumn("range", ranges.of(own))
        )

    text = F.coalesce(F.col("text"), F.lit(""))
    counts = placed(docs.select(key)).groupBy(F.col("best.shard").alias("shard"), "range").count()
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("shard", "range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    rows_ = placed(docs.select(own.alias(key), (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))).select(
        F.col(key).alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), F.col("best.shard").alias("shard"), "range",
        F.array_min(F.array("best", F.element_at("all", -1)))["shard"].alias("grown_shard"),
    )
    within = Window.partitionBy("shard", "range").orderBy("doc_id", "text_crc32")
    return (
        rows_.withColumn("within", F.row_number().over(within) - 1)
        .join(F.broadcast(base), ["shard", "range"])
        .select("doc_id", "size", "text_crc32", "law", "shard", (F.col("base") + F.col("within")).cast("long").alias("slot"), "grown_shard")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_records(documents(spark, sf_dir), [1.0] * 40)
