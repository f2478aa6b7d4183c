"""Filtered exact top-k by cosine, pooling, filters of noise, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from .nearest import nearest


def cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def top_k(points: DataFrame, queries: DataFrame, k: int, threshold: float | None = 0.8, where: Column | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k points nearest to each query (columns ``query_id``, ``query_vector``) by cosine."""
    return nearest(points, queries, k, threshold, where, key, vector)


def program_filter(text: Column, first: str = "PKH Plus", second: str = "ASPD") -> Column:
    """The program of the greater score in a profile; the second on a tie; null without scores."""
    t = F.lower(text)
    a = F.coalesce(F.regexp_extract(t, r"(?:skor\s+)?pkh\s*\+?\s*(?:plus)?\s*:\s*([0-9.]+)", 1).try_cast("double"), F.lit(0.0))
    b = F.coalesce(F.regexp_extract(t, r"(?:skor\s+)?aspd\s*:\s*([0-9.]+)", 1).try_cast("double"), F.lit(0.0))
    return F.when((a == 0) & (b == 0), F.lit(None)).when(a > b, first).otherwise(second)


def best_of_type(points: DataFrame, queries: DataFrame, source: str, types: str, wanted: str, threshold: float | None = 0.8, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The best point of each source among those of the wanted type, for each query."""
    return nearest(points, queries, 1, threshold, F.array_contains(types, wanted), key, vector, group=source, each=True)


def append_distinct(first: DataFrame, second: DataFrame, text: str, order: str) -> DataFrame:
    """The second hits after the first; of equal texts of a query the one that comes first stays."""
    both = first.withColumn("_turn", F.lit(0)).unionByName(second.withColumn("_turn", F.lit(1)))
    seen = F.row_number().over(Window.partitionBy("query_id", text).orderBy("_turn", order))
    kept = both.withColumn("_s", seen).filter("_s = 1")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("_turn", order))).drop("_s", "_turn")


def pool(hits: DataFrame, profile: str, text: str, order: str) -> DataFrame:
    """Of each text of a profile's candidates the one of the greatest score; the first on a tie."""
    rank = F.row_number().over(Window.partitionBy(profile, text).orderBy(F.desc("score"), order))
    return hits.withColumn("_r", rank).filter("_r = 1").drop("_r")


def rerank(hits: DataFrame, score: Column, n: int, key: str) -> DataFrame:
    """Hits by another score, the best n of each query; the old score stays as ``embed_score``."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
    return hits.withColumn("embed_score", F.col("score")).withColumn("score", score).withColumn("rank", rank).filter(F.col("rank") <= n)


def final_filter(hits: DataFrame, threshold: float, n: int, least: int, order: list[Column]) -> DataFrame:
    """Forms alone and low-priority hits below the threshold go; then, once ``least`` are kept, all
    below the threshold; n stay. Exact as a window, since hits come in descending order of score."""
    form = F.array_contains("types", "lampiran_formulir") & (F.col("primary_type") == "lampiran_formulir") & ~F.arrays_overlap("types", F.array(F.lit("kriteria_penerima"), F.lit("nominal_bantuan")))
    able = hits.filter(~form & ~((F.col("priority") == "low") & (F.col("score") < threshold)))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), *order))
    return able.withColumn("place", rank).filter((F.col("place") <= n) & ((F.col("score") >= threshold) | (F.col("place") <= least)))


def shape(hits: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Program label (the file name without ending if unknown), page as text, rounded score, preview."""
    table = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return hits.select("query_id", "rank", F.coalesce(F.try_element_at(table, "source"), F.regexp_replace("source", r"\.pdf", "")).alias("program"), F.col("page").cast("string").alias("page"), F.round("score", 4).alias("score"), F.substring("text", 1, 200).alias("preview"))


def coverage(hits: DataFrame, known: list[str]) -> DataFrame:
    """Sources, and known sources, among each query's hits."""
    return hits.groupBy("query_id").agg(F.count_distinct("source").alias("sources"), F.count_distinct(F.when(F.col("source").isin(known), F.col("source"))).alias("known_sources"))


def citations(hits: DataFrame, order: str, most: int = 3) -> DataFrame:
    """Each source's pages in order of rank, each once, the first few."""
    pages = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("page").isNotNull(), F.struct(F.col(order).alias("o"), F.col("page").cast("string").alias("p"))))), lambda x: x["p"]))
    out = hits.groupBy("query_id", "source").agg(pages.alias("pages"))
    return out.select("query_id", "source", F.when(F.size("pages") > 0, F.concat("source", F.lit(", Hal. "), F.array_join(F.slice("pages", 1, most), ", "))).otherwise(F.col("source")).alias("citation"))


def first_by(hits: DataFrame, keys: list[Column], order: str) -> DataFrame:
    """The first hit of each key."""
    return hits.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("_r = 1").drop("_r")
