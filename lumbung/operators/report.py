"""The quality profile of chunk files from one scan: statistics, counters, warnings, summaries and notes."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as X
from .profile import LONG, MEDIUM, SHORT

#: Kinds of the unpivoted rows: one for each chunk, and one for each value that a counter counts.
ROW, SOURCE, PRIORITY, TYPE, FLAG, CATEGORY, PROGRAM = "row", "sumber", "retrieval_priority", "tipe_konten", "quality_flags", "kategori", "nama_bansos"
STRUCTURE = ("bab", "pasal", "ayat", "judul_halaman")


def _listed(value: Column) -> Column:
    """A field's values: those of a list, else the one value; none if null or empty."""
    items = F.coalesce(F.from_json(F.when(F.startswith(value, F.lit("[")), value), "array<string>"), F.when(value.isNotNull() & (value != "") & (value != "[]"), F.array(value)))
    return F.coalesce(items, F.array().cast("array<string>"))


def _counted(kind: str, value: Column) -> Column:
    """An entry (kind, value) for each value of a field that is not empty."""
    return F.transform(F.filter(_listed(value), lambda v: v.isNotNull() & (v != "")), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))


def entries(lines: DataFrame, by: str, order: str, core: tuple[str, ...] = fixed.CORE_FIELDS, clean: tuple[str, ...] = fixed.CLEAN_FIELDS, main: tuple[str, ...] = fixed.MAIN_SOURCES, priorities: tuple[str, ...] = fixed.PRIORITIES) -> DataFrame:
    """One aggregated row for each (``by``, kind, value) of scanned lines.

    ``lines``: ``by``, ``order`` and what the strict scan says: outcome, text, metadata (JSON text). Every
    line gives one entry that carries its measures and one for each value that is counted; they are
    aggregated together, so texts are read once and no text is shuffled (copies are told by hashes).
    White space fills a core or clean field, but not a structure field.
    """
    # explode_outer() over one struct: what is below is computed once a row, however often it is used.
    once = F.struct("outcome", F.col("text").alias("text"), X.strip(F.col("text")).alias("stripped"), F.from_json("metadata", "map<string,string>").alias("m"))
    read = lines.select(F.col(by), F.col(order).alias("seen"), F.explode_outer(F.array(once)).alias("_o")).select(by, "seen", "_o.*")
    get = lambda k: F.try_element_at("m", F.lit(k))
    lacks = lambda k: F.coalesce(get(k), F.lit("")).isin("", "[]")
    filled = lambda k: ~lacks(k) & (X.strip(get(k)) != "")
    due = F.coalesce(get(SOURCE).isin(*main), F.lit(False)) | ~lacks(PROGRAM)
    ok = F.col("outcome") == "row"
    n, stripped = F.length("text"), F.length("stripped")
    any_of_six = reduce(or_, [filled(k) for k in (*STRUCTURE, CATEGORY, PROGRAM)])
    measures = {
        "n": n, "stripped": stripped, "hash": F.md5("text"), "keys": F.size("m"),
        **{f"lacks_{k}": lacks(k) for k in core}, **{f"unclean_{k}": due & lacks(k) for k in clean},
        "bad_type": due & ~(F.startswith(F.coalesce(get(TYPE), F.lit("")), F.lit("[")) & (get(TYPE) != "[]")), "bad_priority": due & ~F.coalesce(get(PRIORITY).isin(*priorities), F.lit(False)),
        **{f"has_{k}": filled(k) for k in STRUCTURE}, "has_any": any_of_six, "has_source": filled(SOURCE), "has_page": filled("page_number"), "due": due,
    }
    source = F.coalesce(F.nullif(get(SOURCE), F.lit("")), F.nullif(get("filename"), F.lit("")), F.lit("(unknown)"))
    counted = F.concat(
        F.array(F.struct(F.lit(SOURCE).alias("kind"), source.alias("value"))),
        *[_counted(k, get(k)) for k in (PRIORITY, TYPE, FLAG, CATEGORY, PROGRAM)],
    )
    none = F.array().cast("array<struct<kind:string,value:string>>")
    own = F.array(F.struct(F.lit(ROW).alias("kind"), F.lit("").alias("value")))
    packed = read.select(by, "seen", "outcome", F.struct(*[F.when(ok, c).alias(k) for k, c in measures.items()]).alias("x"), F.concat(own, F.when(ok, counted).otherwise(none)).alias("e"))
    flat = packed.select(by, "seen", "outcome", "x", F.explode("e").alias("e")).select(by, "seen", "outcome", F.when(F.col("e.kind") == ROW, F.col("x")).alias("x"), "e.kind", "e.value")
    x = lambda k: F.col(f"x.{k}")
    some = F.when(x("stripped") > 0, x("stripped"))
    flags = [k for k in measures if k not in ("n", "stripped", "hash", "keys")]
    return flat.groupBy(by, "kind", "value").agg(
        F.count(F.lit(1)).alias("count"), F.min("seen").alias("seen"), F.count(x("n")).alias("rows"), F.count_if((F.col("kind") == ROW) & (F.col("outcome") == "invalid_json")).alias("invalid_json"), F.count_if((F.col("kind") == ROW) & (F.col("outcome") == "invalid_schema")).alias("invalid_schema"),
        F.sum(x("n")).alias("total_length"), F.avg(x("n")).alias("mean_length"), F.median(x("n")).alias("median_length"), F.min(x("n")).alias("min_length"), F.max(x("n")).alias("max_length"), F.avg(x("keys")).alias("mean_keys"),
        F.count_if(x("n") == 0).alias("empty"), F.count_if(x("n") < SHORT).alias("short"), F.count_if(x("n").between(SHORT, MEDIUM)).alias("medium"), F.count_if(x("n") > MEDIUM).alias("long"), (F.count(x("hash")) - F.count_distinct(x("hash"))).alias("duplicates"),
        F.round(F.avg(some), 1).alias("avg_len"), F.round(F.median(some), 1).alias("median_len"), F.min(some).alias("min_len"), F.max(some).alias("max_len"), F.count(some).alias("valid"), F.count_if(x("stripped") < SHORT).alias("short_stripped"), F.count_if(x("stripped") > LONG).alias("very_long"),
        *[F.count_if(x(k)).alias(k) for k in flags],
    )


def file_stats(found: DataFrame, by: str) -> DataFrame:
    """The statistics of each file with its warnings (0 to 9). A file without rows
    and without broken JSON has none, even if it has lines of another shape. Sizes of no rows are 0."""
    own = found.filter(F.col("kind") == ROW).filter("rows > 0 or invalid_json > 0").drop("kind", "value", "count", "seen")
    own = own.fillna(0)
    lacking, unclean = ([c for c in own.columns if c.startswith(p)] for p in ("lacks_", "unclean_"))
    signs = [F.col("invalid_json") > 0, F.col("invalid_schema") > 0, F.col("empty") > 0, F.col("short") > 0.30 * F.col("rows"), F.col("duplicates") > 0, reduce(add, map(F.col, lacking)) > 0, reduce(add, map(F.col, unclean)) > 0, F.col("bad_type") > 0, F.col("bad_priority") > 0]
    return own.withColumn("warnings", reduce(add, [s.cast("int") for s in signs]))


def counters(found: DataFrame, by: str, k: int | None = 5) -> DataFrame:
    """A5: the ``k`` most frequent values of each counter of each file; on a tie the one seen first."""
    rank = F.row_number().over(Window.partitionBy(by, "kind").orderBy(F.desc("count"), "seen", "value"))
    out = found.filter(F.col("kind") != ROW).select(by, "kind", "value", "count", "seen").withColumn("rank", rank)
    return (out if k is None else out.filter(F.col("rank") <= k)).drop("seen")


def file_summary(found: DataFrame, by: str, most: int = 60) -> DataFrame:
    """Lengths of stripped non-empty texts, short ones with the empty, and each file's number of
    sources and most frequent source, category and program, cut to ``most`` characters (``-`` without)."""
    own = found.filter(F.col("kind") == ROW).select(by, F.col("rows").alias("chunks"), "invalid_json", "invalid_schema", (F.col("rows") - F.col("valid")).alias("empty_chunks"), F.col("short_stripped").alias("short_chunks"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("avg_len", "median_len", "min_len", "max_len")])
    tops = counters(found, by, 1).filter(~((F.col("kind") == SOURCE) & (F.col("value") == "(unknown)")))
    v = X.strip(F.col("value"))
    short = F.when(F.length(v) <= most, v).otherwise(F.concat(F.substring(v, 1, most - 3), F.lit("...")))
    tops = tops.groupBy(by).agg(*[F.max(F.when(F.col("kind") == k, short)).alias(f"top_{k}") for k in (SOURCE, CATEGORY, PROGRAM)])
    sources = found.filter((F.col("kind") == SOURCE) & (F.col("value") != "(unknown)")).groupBy(by).agg(F.count(F.lit(1)).alias("sources"))
    out = own.join(tops, by, "left").join(sources, by, "left")
    return out.select(*own.columns, F.coalesce("sources", F.lit(0)).alias("sources"), *[F.coalesce(f"top_{k}", F.lit("-")).alias(f"top_{k}") for k in (SOURCE, CATEGORY, PROGRAM)])


def cross_summary(stats: DataFrame, by: str) -> DataFrame:
    """Totals over all files, the most descriptive file, the one of the richest metadata, and the
    files with warnings, most first; ties go by name."""
    risky = F.transform(F.array_sort(F.collect_list(F.when(F.col("warnings") > 0, F.struct((-F.col("warnings")).alias("w"), F.col(by).alias("f"))))), lambda r: F.concat_ws(": ", r["f"], (-r["w"]).cast("string")))
    best = lambda c: F.min_by(by, F.struct(-F.col(c), F.col(by)))
    return stats.agg(F.count(F.lit(1)).alias("files"), F.sum("rows").alias("rows"), F.sum("total_length").alias("total_length"), F.sum("warnings").alias("warnings"), best("mean_length").alias("most_descriptive"), best("mean_keys").alias("richest_metadata"), risky.alias("risky"))


def notes(found: DataFrame) -> DataFrame:
    """(place, level, note) of all files together: validity, empty and short chunks, sources,
    pages, copies, clean metadata and context, with the thresholds of the quality report."""
    rows = found.filter(F.col("kind") == ROW)
    unclean = [c for c in found.columns if c.startswith("unclean_")]
    names = ["rows", "valid", "invalid_json", "invalid_schema", "short_stripped", "duplicates", "bad_type", "bad_priority", "due", "has_any", "has_source", "has_page", *unclean]
    t = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])
    c = F.col
    n, valid = F.greatest(c("rows"), F.lit(1)), F.greatest(c("valid"), F.lit(1))
    pct = lambda part, of: F.format_string("%.1f", part * 100.0 / of)
    empty = c("rows") - c("valid")
    lacking = F.concat_ws(", ", *[F.when(c(u) > 0, F.concat(F.lit(u.removeprefix("unclean_") + "="), c(u).cast("string"))) for u in unclean])
    source, page = c("has_source") * 100.0 / n, c("has_page") * 100.0 / n
    said = [
        (F.when(c("invalid_json") + c("invalid_schema") == 0, "OK").otherwise("WARN"), F.concat_ws(" ", F.lit("invalid:"), c("invalid_json").cast("string"), c("invalid_schema").cast("string"))),
        (F.when(empty == 0, "OK").otherwise("WARN"), F.concat_ws(" ", F.lit("empty:"), empty.cast("string"), pct(empty, n))),
        (F.when(c("short_stripped") - empty <= 0.30 * valid, "OK").otherwise("WARN"), F.concat_ws(" ", F.lit("short:"), pct(c("short_stripped") - empty, valid))),
        (F.when(source >= 99, "OK").otherwise("WARN"), F.concat_ws(" ", F.lit("source:"), F.format_string("%.1f", source))),
        (F.when(page >= 90, "OK").otherwise("INFO"), F.concat_ws(" ", F.lit("page:"), F.format_string("%.1f", page))),
        (F.when(c("duplicates") == 0, "OK").otherwise("WARN"), F.concat_ws(" ", F.lit("duplicates:"), c("duplicates").cast("string"))),
        (F.when((lacking == "") & (c("bad_type") + c("bad_priority") == 0), "OK").otherwise("WARN"), F.concat_ws(" ", F.lit("clean:"), c("due").cast("string"), lacking, F.concat(F.lit("type="), c("bad_type").cast("string")), F.concat(F.lit("priority="), c("bad_priority").cast("string")))),
        (F.when(c("has_any") >= 0.90 * valid, "OK").otherwise("INFO"), F.concat_ws(" ", F.lit("context:"), pct(c("has_any"), valid))),
    ]
    return t.select(F.posexplode(F.array(*[F.struct(level.alias("level"), note.alias("note")) for level, note in said])).alias("place", "x")).select("place", "x.level", "x.note")
