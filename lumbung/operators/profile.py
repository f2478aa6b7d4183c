"""Aggregations that profile chunks: quality by file, global statistics, completeness, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse, strip

#: Lengths below which a chunk is short, and up to which it is medium.
SHORT, MEDIUM, LONG = 100, 500, 2000


def is_filled(value: Column, kind: str) -> Column:
    """Whether a value is there: not null, not NaN, not blank, not an empty collection."""
    if kind == "string":
        return value.isNotNull() & (strip(value) != "")
    if kind.startswith(("array", "map")):
        return value.isNotNull() & (F.size(value) > 0)
    if kind in ("double", "float"):
        return value.isNotNull() & ~F.isnan(value)
    return value.isNotNull()


def quality_stats(chunks: DataFrame, by: str) -> DataFrame:
    """A1, A2, A3: rows, raw lengths, length buckets and surplus copies of each group. Null texts are empty."""
    text = F.coalesce("text", F.lit(""))
    n = F.length(text)
    return chunks.groupBy(by).agg(
        F.count("*").alias("rows"), F.sum(n).alias("total_length"), F.avg(n).alias("mean_length"), F.median(n).alias("median_length"), F.min(n).alias("min_length"), F.max(n).alias("max_length"),
        F.count_if(n == 0).alias("empty"), F.count_if(n < SHORT).alias("short"), F.count_if((n >= SHORT) & (n <= MEDIUM)).alias("medium"), F.count_if(n > MEDIUM).alias("long"),
        (F.count("*") - F.count_distinct(F.md5(text))).alias("duplicates"),
    )


def missing_counts(chunks: DataFrame, by: str, columns: list[str], scope: Column | None = None) -> DataFrame:
    """A4: rows of each group that lack a column: null, or empty text. White space counts as there."""
    scope = F.lit(True) if scope is None else scope
    kinds = dict(chunks.dtypes)
    return chunks.groupBy(by).agg(*[F.count_if(scope & (F.col(c).isNull() | (F.col(c) == "" if kinds[c] == "string" else F.lit(False)))).alias(f"missing_{c}") for c in columns])


def top_values(chunks: DataFrame, by: str, value: str, order: str, k: int) -> DataFrame:
    """A5: the k most frequent values of each group; on a tie the one seen first."""
    counts = chunks.groupBy(by, value).agg(F.count("*").alias("n"), F.min(order).alias("seen"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "seen"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= k).select(by, value, "n", "rank")


def warnings(stats: DataFrame) -> DataFrame:
    """How many of the nine warning conditions hold for a row of statistics; a count not there is 0."""
    counts = ["invalid_json", "invalid_schema", "empty", "duplicates", "missing_core", "missing_clean", "invalid_type", "invalid_priority"]
    signs = [F.col(c) > 0 for c in counts if c in stats.columns] + [F.col("short") / F.col("rows") > 0.30]
    return stats.withColumn("warnings", sum((F.coalesce(s, F.lit(False)).cast("int") for s in signs), F.lit(0)))


def cross_summary(stats: DataFrame, by: str) -> DataFrame:
    """Totals over all groups, and the group of the greatest mean length (ties: first by name)."""
    best = F.min_by(by, F.struct(-F.col("mean_length"), F.col(by)))
    return stats.agg(F.count("*").alias("files"), F.sum("rows").alias("rows"), F.sum("duplicates").alias("duplicates"), best.alias("longest_mean"))


def global_stats(chunks: DataFrame) -> DataFrame:
    """A10: buckets, mean, median and sample deviation of stripped lengths of non-empty texts."""
    n = F.length(strip(F.coalesce("text", F.lit(""))))
    rows = chunks.select(n.alias("n")).filter("n > 0")
    return rows.agg(
        F.count("*").alias("rows"), F.count_if(F.col("n") < SHORT).alias("short"), F.count_if(F.col("n").between(SHORT, MEDIUM)).alias("medium"), F.count_if(F.col("n").between(MEDIUM + 1, LONG)).alias("long"), F.count_if(F.col("n") > LONG).alias("very_long"),
        F.avg("n").alias("mean_length"), F.median("n").alias("median_length"), F.coalesce(F.stddev_samp("n"), F.lit(0.0)).alias("deviation"),
    )


def file_summary(chunks: DataFrame, by: str) -> DataFrame:
    """Stripped lengths of the non-empty texts of each group; short ones include the empty."""
    n = F.length(strip(F.coalesce("text", F.lit(""))))
    some = F.when(n > 0, n)
    return chunks.groupBy(by).agg(F.count("*").alias("rows"), F.avg(some).alias("mean_length"), F.median(some).alias("median_length"), F.min(some).alias("min_length"), F.max(some).alias("max_length"), F.count_if(n < SHORT).alias("short"))


def completeness(chunks: DataFrame, columns: list[str]) -> DataFrame:
    """Percent of rows with each column filled, a row for each column; 0 for a column not there."""
    kinds = dict(chunks.dtypes)
    filled = [(F.count_if(is_filled(F.col(c), kinds[c])) if c in kinds else F.lit(0)).alias(c) for c in columns]
    one = chunks.agg(F.count(F.lit(1)).alias("_rows"), *filled)
    pairs = ", ".join(f"'{c}', cast(`{c}` as bigint)" for c in columns)
    return one.selectExpr("_rows", f"stack({len(columns)}, {pairs}) as (column_name, filled)").select("column_name", "filled", F.when(F.col("_rows") > 0, F.col("filled") * 100.0 / F.col("_rows")).otherwise(0.0).alias("percent"))


def value_counts(chunks: DataFrame, lists: str, fallback: str | None = None) -> DataFrame:
    """Rows of each value of a list column; of the fallback column if no list has any value."""
    main = chunks.select(F.explode(lists).alias("value")).filter("value is not null and value != ''")
    if fallback and main.isEmpty():
        main = chunks.select(F.col(fallback).alias("value")).filter("value is not null and value != ''")
    return main.groupBy("value").agg(F.count("*").alias("n"))


def page_listing(chunks: DataFrame, file: str, page: str, method: str, order: str) -> DataFrame:
    """Chunks and first method of each page of each file."""
    return chunks.groupBy(file, page).agg(F.count("*").alias("chunks"), F.min_by(method, order).alias("method"))


def file_listing(chunks: DataFrame, file: str, page: str) -> DataFrame:
    """Chunks, first and last page and distinct pages of each file."""
    return chunks.groupBy(file).agg(F.count("*").alias("chunks"), F.min(page).alias("first_page"), F.max(page).alias("last_page"), F.count_distinct(page).alias("pages"))


def label_distribution(chunks: DataFrame, lists: str, priority: list[str]) -> DataFrame:
    """Rows of each label, in order of priority, others after it by name."""
    counts = chunks.select(F.explode(lists).alias("label")).groupBy("label").count().withColumnRenamed("count", "n")
    at = F.array_position(F.array(*map(F.lit, priority)), F.col("label"))
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.when(at > 0, at).otherwise(F.lit(1 << 30)), "label")))


def length_histogram(chunks: DataFrame, bins: int = 40) -> DataFrame:
    """Rows in each of ``bins`` equal widths between the least and greatest length."""
    n = chunks.select(F.length("text").alias("n")).filter("n is not null")
    ends = n.agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    bin_ = F.least(F.floor((F.col("n") - F.col("lo")) * bins / F.greatest(F.col("hi") - F.col("lo"), F.lit(1))), F.lit(bins - 1)).cast("int")
    lo, hi = (x := ends.first())[0], x[1]
    return n.withColumns({"lo": F.lit(lo), "hi": F.lit(hi)}).select(bin_.alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def exact_duplicates(chunks: DataFrame, order: str) -> DataFrame:
    """Rows whose normalised text no earlier row has: first wins, over all files."""
    h = F.sha2(collapse(F.lower("text")), 256)
    return chunks.withColumn("hash", h).withColumn("_r", F.row_number().over(Window.partitionBy("hash").orderBy(order))).filter("_r = 1").drop("_r")
