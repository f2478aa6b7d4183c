"""Quality rules whose thresholds follow each language and source, from mergeable quantile sketches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, documents, lean, small_batches
from .shingles import numbered

SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\v\f\r"
#: Documents from which a source of a language has thresholds of its own; below, the language's hold.
ENOUGH = 200
#: Spreads that a threshold lies beyond the quartile, and bits of a value that a sketch keeps.
FACTOR, BITS = 6, 8
#: Groups up to which thresholds are broadcast (about 100 bytes each); parts of a group where they are joined.
MOST_GROUPS, MOST_NAME_BYTES, SALTS = 50_000, 4_000_000, 64


class Rule(NamedTuple):
    """A measure (SQL over the columns of :func:`measured`), its least spread, and whether low values fail, too."""

    name: str
    value: str
    least: int
    low: bool = False


#: Symbols and repeated words in ten thousandths of the words, repeated lines of the lines, characters
#: of a word in thousandths.
RULES = (
    Rule("symbols", "10000 * n_symbols div greatest(n_words, 1)", 250),
    Rule("lines", "10000 * n_dup_lines div greatest(n_lines, 1)", 900),
    Rule("repeats", "10000 * n_repeat_words div greatest(n_words, 1)", 500),
    Rule("length", "1000 * word_chars div greatest(n_words, 1)", 200, True),
)


def repeat_words(words: list[bytes]) -> int:
    """Words in windows of three that the text holds twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids = numbered(words)
    m = int(ids.max()) + 1
    pairs = ids[:-2] * m + ids[1:-1]
    if m >= 1 << 21:  # three numbers do not fit 63 bits: pairs are numbered first
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, at, counts = np.unique(pairs * m + ids[2:], return_inverse=True, return_counts=True)
    twice = counts[at] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def measures(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of a whole text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return 0, 0, sum(map(data.count, SYMBOLS)), 0, 0, 0
    lines = [line for line in data.split(b"\n") if line.strip()]
    chars = len(text) - sum(map(data.count, _SPACES))
    return len(words), chars, sum(map(data.count, SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeat_words(words)


_MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns of ``keep`` (as _c0, _c1, ...), _lang, _source and the measures, one row a document."""
    small_batches(docs.sparkSession)
    own = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(keep)], F.col("lang").alias("_lang"), F.col("source").alias("_source"), F.col("text").alias("_text"))
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema[:-1]], *[f"{c} long" for c in _MEASURES]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([measures(t.as_py()) for t in batch.column(batch.num_columns - 1)], np.int64).reshape(-1, len(_MEASURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c) for c in rows.T)], names=[*batch.schema.names[:-1], *_MEASURES])

    return own.mapInArrow(lean("op12", run), schema)


def bucket(value: Column) -> Column:
    """The bucket of a value >= 0: its ``BITS`` highest bits stay, so a quantile is at most 1/128 too small."""
    shift = F.greatest(F.length(F.bin(value)) - BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketches(rows: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Quantile sketches: lang, source, rule, bucket, n from rows of _lang, _source and measures.

    A sketch is the counts of its buckets, at most about 4,000 for values below 2**35. Two sketches
    merge by adding counts, so partial aggregation makes one for each task before anything is shuffled,
    and sources merge into languages. Nothing is sampled: the same rows give the same sketch in any order.
    """
    each = F.array(*(F.struct(F.lit(r.name).alias("rule"), bucket(F.expr(r.value)).alias("bucket")) for r in rules))
    return (
        rows.select(F.col("_lang").alias("lang"), F.col("_source").alias("source"), F.explode(each).alias("m"))
        .groupBy("lang", "source", "m.rule", "m.bucket").agg(F.count(F.lit(1)).alias("n"))
    )


def fences(sketch: DataFrame, by: list[str], rules: tuple[Rule, ...] = RULES, factor: int = FACTOR) -> DataFrame:
    """``by``, n_docs and <rule>_low, <rule>_high of each group, from sketches merged by ``by``.

    A threshold lies ``factor`` times the spread beyond the quartile; the spread is what lies between
    the quartiles, or the rule's least spread, so that uniform groups lose nothing to small differences.
    """
    group = Window.partitionBy(*by, "rule")
    up_to = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = sketch.groupBy(*by, "rule", "bucket").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(up_to)).withColumn("total", F.sum("n").over(group))
    at = lambda k: F.min(F.when(4 * F.col("upto") >= k * F.col("total"), F.col("bucket")))
    quartiles = merged.groupBy(*by, "rule").agg(at(1).alias("q1"), at(3).alias("q3"), F.max("total").alias("total"))
    least = F.create_map(*[x for r in rules for x in (F.lit(r.name), F.lit(r.least).cast("long"))])[F.col("rule")]
    spread = F.lit(factor) * F.greatest(F.col("q3") - F.col("q1"), least)
    own = quartiles.select(*by, "rule", "total", (F.col("q1") - spread).alias("low"), (F.col("q3") + spread).alias("high"))
    pick = lambda r, side: F.max(F.when(F.col("rule") == r.name, F.col(side))).alias(f"{r.name}_{side}")
    return own.groupBy(*by).agg(F.max("total").alias("n_docs"), *[pick(r, side) for r in rules for side in ("low", "high")])


def thresholds(sketch: DataFrame, rules: tuple[Rule, ...] = RULES, factor: int = FACTOR, enough: int = ENOUGH) -> DataFrame:
    """lang, source and fences of every group: its own from ``enough`` documents on, else its language's."""
    own, whole = fences(sketch, ["lang", "source"], rules, factor), fences(sketch, ["lang"], rules, factor)
    names = [f"{r.name}_{side}" for r in rules for side in ("low", "high")]
    whole = whole.select(F.col("lang").alias("_l"), *[F.col(c).alias(f"_{c}") for c in names])
    choice = [F.when(F.col("n_docs") >= enough, F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in names]
    return own.join(whole, F.col("lang").eqNullSafe(F.col("_l"))).select("lang", "source", *choice)


def judged(docs: DataFrame, keep: list[str], rules: tuple[Rule, ...] = RULES, factor: int = FACTOR, enough: int = ENOUGH) -> DataFrame:
    """Columns of ``keep``, the measures, base_failed, rules_failed and kept of every document.

    Base rules are fixed: under 50 words, or more than half of the words in repeated windows of three.
    Documents that pass them fill the sketches of their language and source, all of them, and are then
    held against the thresholds that these give. ``rules_failed`` lists the rules that a document fails
    beside the base, by name, joined by commas; ``kept`` is true where nothing is failed.

    Texts are read once; measures of about 100 bytes a row are kept and joined with one row for each
    (language, source): broadcast where those are few, else joined by shuffle with each group in
    ``SALTS`` parts, so that a source with a third of all rows is many tasks. Null texts have no words
    and fail the base. A null language or source is a group of its own. Repeated rows count as often as
    they come and are judged alike. Columns of ``keep`` named like ours give way to ours. Empty tables
    give no rows. Of a very long text a worker holds its words.
    """
    ours = (*_MEASURES, "base_failed", "rules_failed", "kept")
    keep = [c for c in keep if c not in ours]
    rows = cut(measured(docs, keep)).withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))
    plan = cut(thresholds(sketches(rows.filter("not base_failed"), rules), rules, factor, enough))
    groups, names = plan.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.concat_ws("", "lang", "source"))), F.lit(0))).first()
    same = F.col("_lang").eqNullSafe(F.col("lang")) & F.col("_source").eqNullSafe(F.col("source"))
    if groups <= MOST_GROUPS and names <= MOST_NAME_BYTES:
        met = rows.join(F.broadcast(plan), same, "left")
    else:
        salt = F.pmod(F.xxhash64(*_MEASURES, *[c for c, t in rows.dtypes if c == "_c0" and not t.startswith("map")]), F.lit(SALTS))
        salted = plan.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        met = rows.withColumn("_salt", salt).join(salted, same & (F.col("_salt") == F.col("salt")), "left")
    fails = [F.when((F.expr(r.value) > F.col(f"{r.name}_high")) | (F.lit(r.low) & (F.expr(r.value) < F.col(f"{r.name}_low"))), F.lit(r.name)) for r in rules]
    failed = F.when(F.col("base_failed"), F.lit("")).otherwise(F.concat_ws(",", *fails))
    return met.withColumn("rules_failed", failed).select(
        *[F.col(f"_c{i}").alias(c) for i, c in enumerate(keep)], *_MEASURES, "base_failed", "rules_failed", (~F.col("base_failed") & (F.col("rules_failed") == "")).alias("kept")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(documents(spark, sf_dir), ["doc_id"])


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), l AS (
  SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d
), t AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, t) AS c FROM (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d))
), rep AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM t WHERE c > 1) GROUP BY r
), m AS (
  SELECT l.r, doc_id, lang, source, len(w)::BIGINT AS n_words, len(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM l LEFT JOIN rep USING (r)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    [10000 * n_symbols // greatest(n_words, 1), 10000 * n_dup_lines // greatest(n_lines, 1), 10000 * n_repeat_words // greatest(n_words, 1), 1000 * word_chars // greatest(n_words, 1)] AS v FROM m
), s AS (
  SELECT lang, source, rule, (v >> greatest(len(bin(v)) - 8, 0)) << greatest(len(bin(v)) - 8, 0) AS bucket, count(*) AS n
  FROM (SELECT lang, source, unnest(v) AS v, unnest([1, 2, 3, 4]) AS rule FROM b WHERE NOT base_failed) GROUP BY ALL
), merged AS (
  SELECT lang, source, true AS own, rule, bucket, n FROM s UNION ALL SELECT lang, NULL, false, rule, bucket, sum(n) FROM s GROUP BY lang, rule, bucket
), c AS (
  SELECT *, sum(n) OVER (PARTITION BY lang, source, own, rule ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY lang, source, own, rule) AS total FROM merged
), q AS (
  SELECT lang, source, own, rule, max(total) AS total, min(bucket) FILTER (4 * upto >= total) AS q1, min(bucket) FILTER (4 * upto >= 3 * total) AS q3 FROM c GROUP BY lang, source, own, rule
), f AS (
  SELECT lang, source, own, rule, total, q1 - 6 * greatest(q3 - q1, [250, 900, 500, 200][rule]) AS low, q3 + 6 * greatest(q3 - q1, [250, 900, 500, 200][rule]) AS high FROM q
), h AS (
  SELECT a.lang, a.source, a.rule, CASE WHEN a.total >= 200 THEN a.low ELSE g.low END AS low, CASE WHEN a.total >= 200 THEN a.high ELSE g.high END AS high
  FROM f a JOIN f g ON a.own AND NOT g.own AND a.lang IS NOT DISTINCT FROM g.lang AND a.rule = g.rule
), z AS (
  SELECT b.r, string_agg(['symbols', 'lines', 'repeats', 'length'][rule], ',' ORDER BY rule) AS failed
  FROM b JOIN h ON b.lang IS NOT DISTINCT FROM h.lang AND b.source IS NOT DISTINCT FROM h.source AND (b.v[h.rule] > h.high OR h.rule = 4 AND b.v[h.rule] < h.low) WHERE NOT base_failed GROUP BY b.r
)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed, coalesce(failed, '') AS rules_failed, NOT base_failed AND failed IS NULL AS kept FROM b LEFT JOIN z USING (r)
"""
