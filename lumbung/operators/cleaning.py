"""The whole cleaning of chunks as one plan whose rows carry the stage that ended them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as X
from . import chunking as C


def recursive(size: int = 2000, overlap: int = 500) -> Callable[[Column], Column]:
    """The splitter of C1; only texts longer than ``size`` go to Python."""
    def split(text: Column) -> Column:
        long = C.recursive_split(F.when(F.length(text) > size, text), size, overlap)
        return F.when(F.length(text) > size, long).otherwise(F.array(text))

    return split


def staged(rows: DataFrame, split: Callable[[Column], Column] | None = None, types: dict = fixed.CONTENT_TYPES, policy: list[str] = fixed.POLICY_PATTERNS, whole: list[str] = fixed.WHOLE_WORDS, programs: dict[str, str] | None = None) -> DataFrame:
    """What becomes of each row (doc_id, text, source, page, title), a row for every part.

    ``stage`` tells where a part ended: error, short, empty, tiny, duplicate or kept; parts of a row that
    was split have idx from 0 and ``total``. In order: failed rows go, fences and titles are cleaned,
    texts under 20 characters go, the source names the program, texts are split and small tails joined,
    parts that say nothing go, the context is put before, and of parts with equal text, context
    included, the first by doc_id and idx stays. Types, flags and priority are those of the part alone.

    Duplicates are found over hashes: the first of each is a minimum, combined before it is shuffled, so
    a text with very many copies is no hot task; texts are met again by doc_id and idx, which no two
    parts share. Null texts are short. doc_id must be unique.
    """
    failed = X.is_error_row(F.col("text"), F.col("title"))
    # explode_outer() over one struct: what is below is computed once, and no filter is pushed through it.
    clean = F.struct(failed.alias("failed"), F.col("text").alias("raw"), X.strip_fences(F.coalesce("text", F.lit(""))).alias("text"), X.clean_title(F.col("title")).alias("title"))
    others = [c for c in rows.columns if c not in ("text", "title")]
    own = rows.select(*others, F.explode_outer(F.array(clean)).alias("_c")).select(*others, "_c.*")
    own = own.withColumn("short", F.length(X.strip(F.col("text"))) < 20).withColumn("fenced", ~F.col("failed") & F.coalesce(F.col("text") != F.col("raw"), F.lit(False))).drop("raw")
    parts = F.when(~F.col("failed") & ~F.col("short"), C.merge_small((split or recursive())(F.col("text"))))
    own = own.withColumn("_parts", parts).select(*own.columns, F.size("_parts").alias("total"), F.posexplode_outer("_parts").alias("idx", "sub"))
    own = own.withColumn("_tiny", X.skip_subchunk(F.col("sub"), policy)).withColumn("text", X.context_prefix(F.col("sub"), F.col("source"), F.col("page"), F.col("title")))
    first = (
        own.filter("sub is not null and not _tiny").select(X.content_hash(F.col("text")).alias("_hash"), F.struct("doc_id", "idx").alias("_at"))
        .groupBy("_hash").agg(F.min("_at").alias("_at")).select(F.col("_at.doc_id").alias("_doc"), F.col("_at.idx").alias("_idx"))
    )
    met = own.join(first, (F.col("doc_id") == F.col("_doc")) & (F.col("idx") == F.col("_idx")), "left")
    stage = F.when(F.col("failed"), "error").when(F.col("short"), "short").when(F.col("sub").isNull(), "empty").when(F.col("_tiny"), "tiny").when(F.col("_doc").isNull(), "duplicate").otherwise("kept")
    met = met.withColumn("stage", stage)
    kept = F.col("stage") == "kept"
    met = met.withColumn("types", F.when(kept, X.classify(F.col("sub"), types, whole)))
    met = met.withColumn("flags", F.when(kept, X.quality_flags(F.col("sub"), F.col("types"), policy)))
    table = F.create_map(*[F.lit(x) for kv in (programs or {"": ""}).items() for x in kv])
    return met.select(
        *others, "title", "idx", F.greatest("total", F.lit(0)).alias("total"), "stage", "fenced", (F.col("text") != F.col("sub")).alias("prefixed"), F.when(F.coalesce("idx", F.lit(0)) == 0, True).otherwise(False).alias("leads"),
        F.when(kept, F.col("text")).alias("text"), "types", "flags", F.get("types", F.lit(0)).alias("primary_type"), F.when(kept, X.priority(F.col("flags"))).alias("priority"), F.when(kept, F.nullif(F.try_element_at(table, "source"), F.lit(""))).alias("program"),
    )


def clean(rows: DataFrame, split: Callable[[Column], Column] | None = None, **rules) -> DataFrame:
    """The chunks that cleaning keeps, with their program, types, flags and place in a split text."""
    found = staged(rows, split, **rules).filter("stage = 'kept'")
    several = F.col("total") > 1
    return found.withColumn("chunk_index", F.when(several, F.col("idx") + 1)).withColumn("total_chunks", F.when(several, F.col("total"))).withColumn("resplit", several).drop("stage", "fenced", "prefixed", "leads", "total")


def counters(parts: DataFrame) -> DataFrame:
    """What cleaning counts, in one pass over the parts of :func:`staged`."""
    at = lambda *stages: F.col("stage").isin(*stages)
    split = F.col("leads") & (F.col("total") > 1)
    return parts.agg(
        F.count_if(at("error")).alias("error_removed"), F.count_if(F.col("leads") & F.col("fenced")).alias("fence_cleaned"), F.count_if(at("short")).alias("short_removed"), F.count_if(split).alias("resplit"),
        F.coalesce(F.sum(F.when(split, F.col("total"))), F.lit(0)).alias("resplit_new_chunks"), F.count_if(at("tiny")).alias("tiny_skipped"), F.count_if(at("duplicate", "kept") & F.col("prefixed")).alias("prefix_added"), F.count_if(at("duplicate")).alias("dupes_removed"),
        F.count_if(at("kept") & (F.col("priority") == "low")).alias("low_priority"), F.count_if(at("kept") & (F.col("primary_type") == fixed.NO_TYPE)).alias("tipe_lainnya"), F.count_if(at("kept") & F.col("program").isNotNull()).alias("program_tagged"), F.count_if(at("kept")).alias("final"),
    )
