"""Profiling queries over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import profile as P

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def tagged(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with a page, a title that some lack, and types by fixture words."""
    types = F.filter(F.array(F.when(F.contains("text", F.lit("the ")), "en_article"), F.when(F.contains("text", F.lit("der ")), "de_article"), F.when(F.contains("text", F.lit("la ")), "fr_article")), lambda x: x.isNotNull())
    return chunks(spark, d).select("doc_id", "text", "lang", "source", (F.col("doc_id") % 7 + 1).alias("page"), F.when(F.col("doc_id") % 5 != 0, F.substring("text", 1, 12)).alias("title"), types.alias("types"))


TAGGED = """WITH t AS (SELECT doc_id, text, lang, source, doc_id % 7 + 1 AS page, CASE WHEN doc_id % 5 <> 0 THEN substr(text, 1, 12) END AS title,
 list_filter([CASE WHEN contains(text, 'the ') THEN 'en_article' END, CASE WHEN contains(text, 'der ') THEN 'de_article' END, CASE WHEN contains(text, 'la ') THEN 'fr_article' END], lambda x: x IS NOT NULL) AS types FROM documents)"""

_STATS = """SELECT source, count(*) AS rows, sum(length(text)) AS total_length, avg(length(text)) AS mean_length, median(length(text)) AS median_length,
 min(length(text)) AS min_length, max(length(text)) AS max_length, count_if(length(text) = 0) AS empty, count_if(length(text) < 100) AS short,
 count_if(length(text) BETWEEN 100 AND 500) AS medium, count_if(length(text) > 500) AS long, count(*) - count(DISTINCT text) AS duplicates FROM documents GROUP BY source"""


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("a1_quality_stats_by_source", f"SELECT * REPLACE (round(mean_length, 6) AS mean_length, median_length::DOUBLE AS median_length, total_length::BIGINT AS total_length) FROM ({_STATS})")
def a1(spark, d):
    return _rounded(P.quality_stats(chunks(spark, d), "source"), "mean_length")


@query("a2_length_buckets", "SELECT CASE WHEN length(text) = 0 THEN 'empty' WHEN length(text) < 100 THEN 'short' WHEN length(text) <= 500 THEN 'medium' ELSE 'long' END AS bucket, count(*) AS n FROM documents GROUP BY 1")
def a2(spark, d):
    n = F.length("text")
    return chunks(spark, d).groupBy(F.when(n == 0, "empty").when(n < P.SHORT, "short").when(n <= P.MEDIUM, "medium").otherwise("long").alias("bucket")).agg(F.count("*").alias("n"))


@query("a3_duplicate_count", "SELECT count(*) - count(DISTINCT text) AS duplicates FROM documents")
def a3(spark, d):
    return chunks(spark, d).agg((F.count("*") - F.count_distinct(F.md5("text"))).alias("duplicates"))


@query("a4_missing_metadata", TAGGED + " SELECT source, count_if(lang <> 'de' AND (title IS NULL OR title = '')) AS missing_title, count_if(lang <> 'de' AND page IS NULL) AS missing_page FROM t GROUP BY source")
def a4(spark, d):
    return P.missing_counts(tagged(spark, d), "source", ["title", "page"], F.col("lang") != "de")


@query("a5_top_languages", "SELECT source, lang, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, seen) AS rank FROM (SELECT source, lang, count(*) AS n, min(doc_id) AS seen FROM documents GROUP BY ALL)) WHERE rank <= 3")
def a5(spark, d):
    return P.top_values(chunks(spark, d), "source", "lang", "doc_id", 3)


@query("a6_warning_score", f"SELECT source, (short / rows > 0.30)::INT + (empty > 0)::INT + (duplicates > 0)::INT AS warnings FROM ({_STATS})")
def a6(spark, d):
    return P.warnings(P.quality_stats(chunks(spark, d), "source")).select("source", "warnings")


@query("a7_cross_file_summary", f"SELECT count(*) AS files, sum(rows)::BIGINT AS rows, sum(duplicates)::BIGINT AS duplicates, first(source ORDER BY mean_length DESC, source) AS longest_mean FROM ({_STATS})")
def a7(spark, d):
    return P.cross_summary(P.quality_stats(chunks(spark, d), "source"), "source")


@query("a8_files_with_rows", "SELECT source, count(*) AS rows, count_if(length(text) < 10) AS bad FROM documents GROUP BY source HAVING count_if(length(text) >= 10) > 0 OR count_if(length(text) < 10) > 0")
def a8(spark, d):
    bad = F.length("text") < 10
    return chunks(spark, d).groupBy("source").agg(F.count("*").alias("rows"), F.count_if(bad).alias("bad"), F.count_if(~bad).alias("good")).filter("good > 0 or bad > 0").drop("good")


@query("a9_file_summary", "SELECT source, count(*) AS rows, round(avg(n) FILTER (n > 0), 6) AS mean_length, median(n) FILTER (n > 0)::DOUBLE AS median_length, min(n) FILTER (n > 0) AS min_length, max(n) FILTER (n > 0) AS max_length, count_if(n < 100) AS short FROM (SELECT source, length(trim(text)) AS n FROM documents) GROUP BY source")
def a9(spark, d):
    return _rounded(P.file_summary(chunks(spark, d), "source"), "mean_length")


@query("a10_global_stats", "SELECT count(*) AS rows, count_if(n < 100) AS short, count_if(n BETWEEN 100 AND 500) AS medium, count_if(n BETWEEN 501 AND 2000) AS long, count_if(n > 2000) AS very_long, round(avg(n), 6) AS mean_length, median(n)::DOUBLE AS median_length, round(coalesce(stddev_samp(n), 0), 6) AS deviation FROM (SELECT length(trim(text)) AS n FROM documents) WHERE n > 0")
def a10(spark, d):
    return _rounded(P.global_stats(chunks(spark, d)), "mean_length", "deviation")


@query("a11_completeness", TAGGED + ", f AS (SELECT count(*) AS r, count_if(trim(title) <> '') AS title, count_if(trim(lang) <> '') AS lang, count_if(len(types) > 0) AS types, count(page) AS page, 0 AS kategori FROM t), u AS (UNPIVOT f ON title, lang, types, page, kategori INTO NAME column_name VALUE filled) SELECT column_name, filled::BIGINT AS filled, round(filled * 100.0 / r, 6) AS percent FROM u")
def a11(spark, d):
    return _rounded(P.completeness(tagged(spark, d), ["title", "lang", "types", "page", "kategori"]), "percent")


@query("a12_structure_coverage", TAGGED + " SELECT count_if(title IS NOT NULL) AS with_title, count_if(len(types) > 0) AS with_types, count_if(title IS NOT NULL OR len(types) > 0) AS with_any FROM t")
def a12(spark, d):
    title, types = F.col("title").isNotNull(), F.size("types") > 0
    return tagged(spark, d).agg(F.count_if(title).alias("with_title"), F.count_if(types).alias("with_types"), F.count_if(title | types).alias("with_any"))


@query("a13_value_counts", TAGGED + " SELECT value, count(*) AS n FROM (SELECT unnest(types) AS value FROM t) GROUP BY value")
def a13(spark, d):
    return P.value_counts(tagged(spark, d), "types", "lang")


@query("a14_group_size", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def a14(spark, d):
    return chunks(spark, d).groupBy("source").agg(F.count("*").alias("n"))


@query("a15_quality_notes", TAGGED + " SELECT source, CASE WHEN p >= 95 THEN 'OK' WHEN p >= 70 THEN 'WARN' ELSE 'LOW' END AS note FROM (SELECT source, count(title) * 100.0 / count(*) AS p FROM t GROUP BY source)")
def a15(spark, d):
    p = F.count("title") * 100.0 / F.count("*")
    return tagged(spark, d).groupBy("source").agg(p.alias("p")).select("source", F.when(F.col("p") >= 95, "OK").when(F.col("p") >= 70, "WARN").otherwise("LOW").alias("note"))


@query("a16_page_listing", TAGGED + " SELECT source, page, count(*) AS chunks, arg_min(lang, doc_id) AS method FROM t GROUP BY ALL")
def a16(spark, d):
    return P.page_listing(tagged(spark, d), "source", "page", "lang", "doc_id")


@query("a16_file_listing", TAGGED + " SELECT source, count(*) AS chunks, min(page) AS first_page, max(page) AS last_page, count(DISTINCT page) AS pages FROM t GROUP BY source")
def a16b(spark, d):
    return P.file_listing(tagged(spark, d), "source", "page")


@query("a17_evaluation_averages", "SELECT source, round(avg(quality), 6) AS quality, round(avg(toxic), 6) AS toxic, list_sort(list(l.doc_id) FILTER (quality = 0)) AS failed FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY source")
def a17(spark, d):
    rows = spark.read.parquet(f"{d}/labels.parquet").join(chunks(spark, d).select("doc_id", "source"), "doc_id")
    failed = F.sort_array(F.collect_list(F.when(F.col("quality") == 0, F.col("doc_id"))))
    return _rounded(rows.groupBy("source").agg(F.avg("quality").alias("quality"), F.avg("toxic").alias("toxic"), F.when(F.size(failed) > 0, failed).alias("failed")), "quality", "toxic")


@query("a18_label_distribution", TAGGED + ", c AS (SELECT label, count(*) AS n FROM (SELECT unnest(types) AS label FROM t) GROUP BY label) SELECT label, n, row_number() OVER (ORDER BY CASE label WHEN 'fr_article' THEN 1 WHEN 'en_article' THEN 2 ELSE 99 END, label) AS place FROM c")
def a18(spark, d):
    return P.label_distribution(tagged(spark, d), "types", ["fr_article", "en_article"])


@query("a20_length_histogram", "SELECT least(floor((n - lo) * 40 / greatest(hi - lo, 1)), 39)::INT AS bin, count(*) AS n FROM (SELECT length(text) AS n, min(length(text)) OVER () AS lo, max(length(text)) OVER () AS hi FROM documents) GROUP BY bin")
def a20(spark, d):
    return P.length_histogram(chunks(spark, d))


@query("c8_dedup_first_wins", r"SELECT doc_id, hash FROM (SELECT doc_id, hash, row_number() OVER (PARTITION BY hash ORDER BY doc_id) AS r FROM (SELECT doc_id, sha256(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS hash FROM documents)) WHERE r = 1")
def c8(spark, d):
    return P.exact_duplicates(chunks(spark, d), "doc_id").select("doc_id", "hash")


@query("k2_completeness_csv_rows", "SELECT lang, count(*) AS n, round(avg(length(text)), 4) AS mean_length FROM documents GROUP BY lang")
def k2(spark, d):
    return chunks(spark, d).groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg(F.length("text")), 4).alias("mean_length"))
