"""Mixing sources to target weights by systematic sampling of whole documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, KeyRanges, cut, documents

WEIGHTS = (3.0, 1.0, 2.0)
#: Share of all sizes that the mix takes, and the most copies of a document.
SHARE, CAP = 1.5, 2
#: Random offsets that the query draws for each source; the one whose words come nearest the target holds.
OFFSETS = 16
#: Rows of one source and size that one task numbers at once, the most ranges of doc_ids, and sources up
#: to which the plan is broadcast.
ROWS_A_RANGE, MOST_RANGES, MOST_SOURCES = 50_000, 65_536, 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size, target of each source from rows of (source, size).

    Weights repeat over the sources by code point, null last. Sharing by weight, stopping at ``cap``
    times a source's size and sharing the excess anew ends where every source not stopped has the
    same target for its weight: with sources in order of cap over weight, the first at which the rest
    of the total, over the weights from there on, is no more than its own ratio. It is found by
    running sums over one row for each source.
    """
    by_name, by_ratio = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", "place")
    before, onward = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    table = F.array(*map(F.lit, weights))
    return (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("place", F.row_number().over(by_name))
        .withColumn("weight", F.element_at(table, ((F.col("place") - 1) % len(weights) + 1).cast("int")))
        .withColumn("top", F.col("source_size") * F.lit(float(cap)))
        .withColumn("ratio", F.col("top") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("top").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
        .withColumn("level", F.coalesce(F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything), F.lit(float("inf"))))
        .select("source", "source_size", F.least("top", F.col("level") * F.col("weight")).alias("target"))
    )


def offset(source: Column, seed: int, draw: int) -> Column:
    """The draw-th random number in [0, 0.999) of a source: the same in every run."""
    name = F.concat(F.lit(f"{seed}/{draw}/"), F.when(source.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), source)))
    return F.conv(F.substring(F.md5(name), 1, 12), 16, 10).cast("double") / F.lit(float(16**12)) * 0.999


def crossed(rate: Column, rank: Column, start: Column) -> Column:
    """Integer boundaries that the prefix sum of expected copies, plus the offset, crosses at a rank."""
    return (F.floor(rate * rank + start) - F.floor(rate * (rank - 1) + start)).cast("long")


def mix(docs: DataFrame, keep: list[str], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP, seed: int = 0, draws: int = 1) -> DataFrame:
    """Every document with the copies that the mix takes of it.

    Within a source, documents stand in order of size, doc_id and a hash of the text; each is expected
    ``target / source_size`` times; the prefix sum of these, plus one random offset, crosses an integer
    once for each copy. The order by size makes each stretch of sizes give its part, so the words taken
    stay near the target. With several ``draws``, that many offsets are tried for each source, all in
    one pass over slim rows, and the one whose words come nearest the target holds.

    A rank within a source is made in two levels, so that no task sorts a source: rows are numbered
    within (source, size, range of doc_ids), and the counts of the groups before, one row each, are
    summed along the source.

    Columns: those of ``keep`` and size, source_size, target, copies. Null texts and texts without
    words have size 0. A null source is a source, the last. Repeated rows are documents of their own.
    Sources without words have target 0 and no copies. Columns of ``docs`` named like ours are only
    taken if in ``keep``. An empty table gives no rows; very long texts are only counted.
    """
    ranges = KeyRanges(docs, ROWS_A_RANGE, MOST_RANGES)
    extra = [c for c in keep if c not in ("doc_id", "source")]
    base = docs.select(
        "doc_id", "source", *(F.col(c).alias(f"_keep_{i}") for i, c in enumerate(extra)), word_count(F.col("text")).alias("_size"),
        F.xxhash64("text").alias("_tie"), ranges.of(F.col("doc_id")).alias("_range"),
    )
    slim = cut(base.select("doc_id", "source", F.col("_size").alias("size"), "_tie", "_range"))
    targets = cut(source_targets(slim.select("source", "size"), weights, share, cap))
    few = targets.agg((F.count("*") <= MOST_SOURCES) & (F.coalesce(F.sum(F.octet_length("source")), F.lit(0)) <= 1_000_000)).first()[0]
    group = ["source", "_size", "_range"]
    along = Window.partitionBy("source").orderBy("_size", "_range").rowsBetween(Window.unboundedPreceding, -1)
    groups = (
        slim.withColumnRenamed("size", "_size").groupBy(*group).count()
        .select(*group, F.coalesce(F.sum("count").over(along), F.lit(0)).alias("_before"))
    )

    def with_targets(df: DataFrame, plan: DataFrame) -> DataFrame:
        plan = plan.withColumnRenamed("source", "_source")
        return df.join(F.broadcast(plan) if few else plan, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")

    def ranked(df: DataFrame) -> DataFrame:
        within = Window.partitionBy(*group).orderBy("doc_id", "_tie")
        other = groups.select(*(F.col(c).alias(f"{c}_") for c in group), "_before")
        same = F.lit(True)
        for c in group:
            same &= F.col(c).eqNullSafe(F.col(f"{c}_"))
        return df.withColumn("_within", F.row_number().over(within)).join(other, same).withColumn("_rank", F.col("_before") + F.col("_within")).drop("_before", "_within", *(f"{c}_" for c in group))

    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    drawn = [F.sum(crossed(rate, F.col("_rank"), offset(F.col("source"), seed, i)) * F.col("_size")).alias(f"d{i}") for i in range(draws)]
    if draws == 1:
        plan = targets.withColumn("_start", offset(F.col("source"), seed, 0))
        return _taken(base if extra else slim.withColumnRenamed("size", "_size"), plan, rate, ranked, with_targets, keep, extra, cap)
    tried = with_targets(ranked(slim.withColumnRenamed("size", "_size")), targets).groupBy("source", "source_size", "target").agg(*drawn)
    best = F.array_min(F.array(*(F.struct(F.abs(F.col(f"d{i}") - F.col("target")).alias("off"), F.lit(i).alias("i"), offset(F.col("source"), seed, i).alias("start")) for i in range(draws))))
    plan = cut(tried.select("source", "source_size", "target", best["start"].alias("_start")))
    return _taken(base if extra else slim.withColumnRenamed("size", "_size"), plan, rate, ranked, with_targets, keep, extra, cap)


def _taken(own: DataFrame, plan: DataFrame, rate: Column, ranked, with_targets, keep: list[str], extra: list[str], cap: int) -> DataFrame:
    """The rows of ``own`` with the copies that each source's offset (``_start``) gives them."""
    out = with_targets(ranked(own), plan).withColumn("copies", F.least(crossed(rate, F.col("_rank"), F.col("_start")), F.lit(cap).cast("long")))
    names = {c: f"_keep_{i}" for i, c in enumerate(extra)}
    ours = (("_size", "size"), ("source_size", "source_size"), ("target", "target"), ("copies", "copies"))
    return out.select(*(F.col(names.get(c, c)).alias(c) for c in keep), *(F.col(c).alias(n) for c, n in ours if n not in keep))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir), ["doc_id"], draws=OFFSETS).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents
), s AS (
  SELECT *, [3.0::DOUBLE, 1.0, 2.0][(place - 1) % 3 + 1] AS weight, source_size * 2.0::DOUBLE AS top, sum(source_size) OVER () * 1.5::DOUBLE AS total
  FROM (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source)
), l AS (
  SELECT *, top / weight AS ratio, (total - coalesce(sum(top) OVER (ORDER BY top / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY top / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s
), t AS (
  SELECT source, source_size, least(top, max(CASE WHEN level <= ratio THEN level END) OVER () * weight) AS target FROM l
), r AS (
  SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate, row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) AS rank FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), u AS (
  SELECT *, ('0x' || substr(md5('0/' || i || '/' || CASE WHEN source IS NULL THEN '0' ELSE '1' || source END), 1, 12))::BIGINT / 281474976710656.0::DOUBLE * 0.999::DOUBLE AS start FROM r, range(16) k(i)
), c AS (
  SELECT *, (floor(rate * rank + start) - floor(rate * (rank - 1) + start))::BIGINT AS copies FROM u
), best AS (
  SELECT source, arg_min(i, {'off': abs(got - target), 'i': i}) AS i FROM (SELECT source, i, target, sum(copies * size) AS got FROM c GROUP BY ALL) GROUP BY source
)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM c JOIN best b ON b.i = c.i AND b.source IS NOT DISTINCT FROM c.source
"""
