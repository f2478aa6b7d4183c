"""The corpus pipeline: stages that turn raw documents into packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept. All but the last return
the columns of documents. Null texts are rejected by the first stage, as they have no letter. Other
columns are carried along, under any names. An empty table gives no rows at every stage. Very long
texts are worked on whole. Rows with a null doc_id pass the first three stages as they are, as texts of
their own; the mix takes them like others, and their pieces have a null doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumbung.llm import op4_jaccard, op6_langid, op7_mixing, op9_packing, op10_substrings
from lumbung.llm.common import cut, documents, new_folder, settle, small_batches

#: A text with at least MIN_BYTES bytes of words in learned letters that even the best language codes in
#: more bits a byte is noise.
MOST_BITS, MIN_BYTES = 6.5, 64
#: Dropped documents up to which their ids are broadcast (about 40 bytes each).
MOST_DROPPED = 500_000
#: Pieces whose ids a worker keeps: few, since workers hold them while other stages run.
MEMO = 100_000


_CORE = ("doc_id", "text", "lang", "source", "n_chars")


def _apart(docs: DataFrame) -> tuple[DataFrame, list]:
    """Docs with columns beyond those of documents under names that no operator uses, and the way back."""
    small_batches(docs.sparkSession)
    settle(docs.sparkSession)
    names = {c: c if c in _CORE else f"_extra_{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), [F.col(n).alias(c) for c, n in names.items()]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID. Documents without a language go: no letters, or noise to every language's model.

    Only words in letters that were learned can be noise; other scripts stay, and all text with letters
    where nothing was learned. Each row is judged by its text alone, so repeated rows fare alike; null
    and empty texts go.
    """
    docs, back = _apart(docs)
    found = op6_langid.identify(docs, docs.columns)
    noise = (F.coalesce("learned_bits", F.lit(0.0)) > MOST_BITS) & (F.col("learned_bytes") >= MIN_BYTES)
    return found.filter(F.col("learned_bytes").isNotNull() & ~noise).select(*back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join, five words and 0.8. The least doc_id of each group of linked documents stays.

    Of repeated rows (one doc_id, one text) one stays; texts without words link with nothing and stay.
    """
    docs, back = _apart(docs)
    found = cut(op4_jaccard.near_duplicates(docs, op4_jaccard.Rule(5, 80, 100)))
    dropped = found.filter("component_id != doc_id").select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie")).distinct()
    few = dropped.count() <= MOST_DROPPED
    same = (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_tie"))
    kept = docs.join(F.broadcast(dropped) if few else dropped, same, "left_anti")
    if found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty():
        return kept.select(*back)
    # Repeated rows of one doc_id and one text are copies, too; another text of the doc_id is not.
    return kept.withColumn("_tie", F.xxhash64("text")).dropDuplicates(["doc_id", "_tie"]).select(*back)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Substring dedup. Repeated passages go out of the texts; a document of which nothing is left goes.

    Two texts of one doc_id never take from each other. Null and wordless texts stay as they are.
    """
    docs, back = _apart(docs)
    found = op10_substrings.remove_repeats(docs, docs.columns)
    found = found.filter("kept_text is null or kept_text != ''").withColumn("text", F.coalesce("kept_text", "text"))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length("text").cast("long"))
    return found.select(*back)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights. A document comes once for each copy that the mix takes of it.

    Ties of size go by doc_id and a hash of the text; repeated rows are documents of their own; texts
    without words may be taken or left, as the sampling has it; sources without words give none.
    """
    docs, back = _apart(docs)
    found = op7_mixing.mix(docs, docs.columns).filter("copies > 0").withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return found.select(*back)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing into sequences of at most 4096 tokens; a row for each piece.

    Null and empty texts are the end id alone; each copy of a row is packed.
    """
    import public_tokenizers

    small_batches(spark)
    settle(spark)
    return op9_packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), memo=MEMO)


STAGES = [
    ("language_id", language),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", substrings),
    ("source_mixing", mixing),
    ("best_fit_packing", packing),
]

#: SQL cannot express the context trees or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet in the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        folder = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
