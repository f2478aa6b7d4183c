"""I-Match fingerprints over several randomised lexicon subsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import GAP, LOWER, UPPER, KeyRanges, cut, documents

#: Share of all documents that hold a term of the lexicon, and the least of each bound in documents.
BAND, LEAST = (0.001, 0.01), (2, 32)
#: Subsets of the lexicon: LEVELS levels of EACH subsets, which keep a term with odds 1/4, 1/16, ...
LEVELS, EACH = 4, 8
DIGITS = 6
#: Subsets of a level that must hold terms of either text before the level is heard.
HEARD = 4
#: Bytes of the lexicon up to which it is broadcast; beyond, it is joined by shuffle.
MOST_BYTES = 50_000_000
#: Documents of one range of doc_ids, and the most ranges.
ROWS_A_RANGE, MOST_RANGES = 2_000, 65_536


def terms(text: Column) -> Column:
    """Distinct words of a text, A-Z lower-cased; '' stands among them only for outer white space.

    Other capitals stay as they are, so only ASCII texts, and ASCII words of others, take lower().
    """
    def plain(x: Column) -> Column:
        return F.octet_length(x) == F.char_length(x)

    each = F.transform(F.array_distinct(F.split(text, GAP)), lambda w: F.when(plain(w), F.lower(w)).otherwise(F.translate(w, UPPER, LOWER)))
    return F.array_distinct(F.when(plain(text), F.split(F.lower(text), GAP)).otherwise(each))


def lexicon(docs: DataFrame, rows: int, band: tuple[float, float] = BAND) -> DataFrame:
    """term and mask of the terms whose document frequency, so inverse frequency, lies in the band.

    Counts cover all documents. A term held by at least a share s of the documents is one of at most
    (mean distinct terms of a document) / s, whatever the size of the corpus: that bounds the lexicon.
    Bit k of ``mask`` says that the k-th random subset keeps the term. The term '' is there with no
    subset, so that every document meets a row.
    """
    low, high = max(LEAST[0], -int(-band[0] * rows // 1)), max(LEAST[1], int(band[1] * rows))
    # explode() would have Spark compute the terms a second time, to filter out empty arrays; no array is empty.
    counts = docs.select(F.explode_outer(terms(F.coalesce("text", F.lit("")))).alias("term")).filter("term != ''").groupBy("term").count()
    odds = "shiftright(65536, 2 * (cast(k div {e} as int) + 1))".format(e=EACH)
    mask = f"aggregate(sequence(0, {LEVELS * EACH - 1}), 0L, (m, k) -> m + if(cast(conv(substr(md5(concat(k, ':', term)), 1, 4), 16, 10) as int) < {odds}, shiftleft(1L, k), 0L))"
    none = docs.sparkSession.range(1).select(F.lit("").alias("term"), F.lit(0).cast("long").alias("mask"))
    return counts.filter((F.col("count") >= low) & (F.col("count") <= high)).select("term", F.expr(mask).alias("mask")).unionByName(none)


def _hashes(items: str) -> str:
    """SQL: the subsets' hashes of sorted (term, mask) items, '-' where a subset has none; null if all have none."""
    one = f"substr(md5(array_join(transform(filter({items}, x -> x.mask & shiftleft(1L, k) != 0), x -> x.term), ' ')), 1, {DIGITS})"
    return f"if(size({items}) > 0, transform(sequence(0, {LEVELS * EACH - 1}), k -> if({items}_any & shiftleft(1L, k) != 0, {one}, '{'-' * DIGITS}')), null)"


def likeness(a: str, b: str) -> str:
    """SQL: share of the subsets holding terms of either text that hash alike, at the level where most do.

    ``a`` and ``b`` name columns of hashes (see :func:`_hashes`); ``a_print`` and ``b_print`` hold the
    fingerprints. Equal fingerprints have likeness 1. A level counts if at least HEARD of its subsets
    hold terms; without such a level, all subsets count together.
    """
    none = "-" * DIGITS
    told = f"transform(sequence(0, {LEVELS * EACH - 1}), k -> if({a}[k] = '{none}' and {b}[k] = '{none}', 0, if({a}[k] = {b}[k], 2, 1)))"
    level = "transform(sequence(0, {last}), i -> named_struct('n', size(filter(slice(t, i * {e} + 1, {e}), x -> x > 0)), 'same', size(filter(slice(t, i * {e} + 1, {e}), x -> x > 1))))".format(last=LEVELS - 1, e=EACH)
    rates = f"transform(filter(levels, r -> r.n >= {HEARD}), r -> r.same / r.n)"
    total = "aggregate(levels, 0, (s, r) -> s + r.{f})"
    whole = f"{total.format(f='same')} / nullif({total.format(f='n')}, 0)"
    # A lambda over one element binds what is used several times.
    graded = f"transform(transform(array({told}), t -> {level}), levels -> coalesce(array_max({rates}), {whole}, 0.0D))[0]"
    return f"case when {a}_print = {b}_print then 1.0D when {a} is null or {b} is null then 0.0D else {graded} end"


def fingerprints(docs: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likenesses.

    The edited text has the last third of the code points replaced by the start of the next document,
    in descending doc_id order (ties by text; after the last comes the first). Whole texts move once,
    by range of doc_ids; the next text is found in the same range, into which the first row of the
    range below is copied. Fingerprints are made where the texts are: the exploded distinct terms meet
    the broadcast lexicon and are gathered again by document within the range, without a shuffle.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    Null texts are empty and have the fingerprint of no terms. Repeated rows follow one another. A
    single document is its own next. Null doc_ids come last; other columns are ignored; an empty table
    gives no rows. Very long texts are fingerprinted whole: a task holds a text and its distinct terms.
    """
    ranges = KeyRanges(docs, ROWS_A_RANGE, MOST_RANGES)
    kept = cut(lexicon(docs, ranges.rows, band))
    n, size = kept.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
    if 80 * n + size <= MOST_BYTES:
        kept = F.broadcast(kept)
    bucket = ranges.of(F.col("doc_id"))
    # The first row of each range in descending order goes to the next range above that has rows, too.
    ids = docs.select("doc_id", bucket.alias("bucket"))
    firsts = ids.groupBy("bucket").agg(F.max("doc_id").alias("first"))
    up = Window.orderBy("bucket")
    firsts = cut(firsts.select(F.col("bucket").alias("own"), "first", F.coalesce(F.lead("bucket").over(up), F.first("bucket").over(up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("above")))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), bucket.alias("bucket"))
    # The copy is the least text of its doc_id, as the order has it.
    copied = texts.join(F.broadcast(firsts), (F.col("bucket") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("first")), "left")
    placed = copied.select("doc_id", "text", F.explode(F.expr("if(above is null, array(struct(bucket as b, 0 as ghost)), array(struct(bucket as b, 0 as ghost), struct(above as b, 1 as ghost)))")).alias("at")).select("doc_id", "text", "at.b", "at.ghost")
    order = Window.partitionBy("b").orderBy("ghost", F.col("doc_id").desc_nulls_last(), "text")
    edited = (
        placed.select("*", F.lead("text").over(order).alias("next"), F.row_number().over(order).alias("row"))
        .withColumn("n_chars", F.length("text").cast("long"))
        .withColumn("edited", F.when(F.col("ghost") == 0, F.expr("concat(substr(text, 1, int(n_chars - n_chars div 3)), substr(next, 1, int(n_chars div 3)))")))
    )
    nothing = F.lit(None).cast("struct<doc_id:bigint,ghost:int,n_chars:bigint,text:string,edited:string>")
    own = F.struct(F.col("doc_id").cast("long").alias("doc_id"), "ghost", "n_chars", "text", "edited")
    # The document itself rides along with one row alone. explode_outer(): see lexicon().
    sides = F.array(
        F.struct(F.lit(2).alias("tag"), own.alias("d"), F.array(F.lit("")).alias("terms")),
        F.struct(F.lit(0).alias("tag"), nothing.alias("d"), terms(F.col("text")).alias("terms")),
        F.struct(F.lit(1).alias("tag"), nothing.alias("d"), F.when(F.col("ghost") == 0, terms(F.col("edited"))).alias("terms")),
    )
    sided = edited.select("b", "row", F.explode_outer(sides).alias("x")).select("b", "row", "x.tag", "x.d", "x.terms")
    exploded = sided.select("b", "row", "tag", "d", F.explode_outer("terms").alias("term"))
    held = exploded.join(kept, "term")

    def side(tag: int) -> Column:
        return F.sort_array(F.collect_list(F.when((F.col("mask") != 0) & (F.col("tag") == tag), F.struct("term", "mask"))))

    def any_of(tag: int) -> Column:
        return F.coalesce(F.bit_or(F.when(F.col("tag") == tag, F.col("mask"))), F.lit(0))

    gathered = held.groupBy("b", "row").agg(F.first("d", ignorenulls=True).alias("d"), side(0).alias("own"), any_of(0).alias("own_any"), side(1).alias("other"), any_of(1).alias("other_any"))
    def whole(text: str) -> Column:
        return F.concat(F.lit("="), F.md5(F.array_join(F.sort_array(F.array_remove(terms(F.col(text)), "")), " ")))

    hashed = gathered.select("b", "row", "d", F.expr(_hashes("own")).alias("x"), F.expr(_hashes("other")).alias("y"))
    # All distinct terms of a text are sorted and hashed only where it has no term in any subset.
    printed = hashed.select(
        "b", "row", "d.doc_id", "d.ghost", "d.n_chars", F.sha2(F.col("d.edited").cast("binary"), 256).alias("edited_sha256"), "x", "y",
        F.when(F.col("x").isNull(), whole("d.text")).otherwise(F.array_join("x", "")).alias("x_print"),
        F.when(F.col("y").isNull(), whole("d.edited")).otherwise(F.array_join("y", "")).alias("y_print"),
    )
    following = Window.partitionBy("b").orderBy("row")
    result = printed.withColumn("z", F.lead("x").over(following)).withColumn("z_print", F.lead("x_print").over(following)).filter("ghost = 0")
    return result.select(
        "doc_id", "n_chars", "edited_sha256", F.col("x_print").alias("fingerprint"), F.col("y_print").alias("edited_fingerprint"),
        F.expr(likeness("x", "y")).alias("near_edited"), F.expr(likeness("x", "z")).alias("near_next"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))


SQL = r"""
WITH n AS (SELECT count(*) AS n FROM documents), d AS (
  SELECT doc_id, t AS text, length(t) AS n_chars, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS next FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
), e AS (
  SELECT *, substr(text, 1, (n_chars - n_chars // 3)::BIGINT) || substr(next, 1, (n_chars // 3)::BIGINT) AS edited FROM d
), sides AS (SELECT doc_id, 0 AS tag, text AS t FROM e UNION ALL SELECT doc_id, 1, edited FROM e
), terms AS MATERIALIZED (
  SELECT doc_id, tag, list_sort(list_filter(list_distinct(string_split_regex(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+')), lambda x: x <> '')) AS terms FROM sides
), df AS (SELECT term, count(*) AS df FROM (SELECT unnest(terms) AS term FROM terms WHERE tag = 0) GROUP BY term
), lexicon AS MATERIALIZED (
  SELECT term, k FROM df, n, range(32) r(k) WHERE df BETWEEN greatest(2, ceil(0.001 * n)) AND greatest(32, floor(0.01 * n)) AND ('0x' || substr(md5(k || ':' || term), 1, 4))::INT < 65536 >> (2 * (k // 8 + 1))::INT
), hashed AS (
  SELECT doc_id, tag, k, substr(md5(string_agg(term, ' ' ORDER BY term)), 1, 6) AS h FROM (SELECT doc_id, tag, unnest(terms) AS term FROM terms) JOIN lexicon USING (term) GROUP BY ALL
), joined AS (SELECT doc_id, tag, map(list(k), list(h)) AS m FROM hashed GROUP BY ALL
), print AS (
  SELECT doc_id, tag, CASE WHEN m IS NULL THEN '=' || md5(array_to_string(terms, ' ')) ELSE array_to_string(list_transform(range(32), lambda k: coalesce(m[k], '------')), '') END AS f FROM terms LEFT JOIN joined USING (doc_id, tag)
), p AS (
  SELECT a.doc_id, a.f, b.f AS g, coalesce(lead(a.f) OVER (ORDER BY a.doc_id DESC), first_value(a.f) OVER (ORDER BY a.doc_id DESC)) AS h FROM print a JOIN print b ON a.doc_id = b.doc_id AND a.tag = 0 AND b.tag = 1
), pairs AS (SELECT doc_id, 'e' AS kind, f AS x, g AS y FROM p UNION ALL SELECT doc_id, 'n', f, h FROM p
), levels AS (
  SELECT doc_id, kind, x, y, k // 8 AS level, count_if(substr(x, k * 6 + 1, 6) <> '------' OR substr(y, k * 6 + 1, 6) <> '------') AS used, count_if(substr(x, k * 6 + 1, 6) <> '------' AND substr(x, k * 6 + 1, 6) = substr(y, k * 6 + 1, 6)) AS same FROM pairs, range(32) r(k) GROUP BY ALL
), near AS (
  SELECT doc_id, kind, CASE WHEN x = y THEN 1.0 WHEN x[1] = '=' OR y[1] = '=' THEN 0.0 ELSE coalesce(max(same / used) FILTER (used >= 4), sum(same) / sum(used), 0.0) END::DOUBLE AS near FROM levels GROUP BY doc_id, kind, x, y
)
SELECT e.doc_id, e.n_chars, sha256(e.edited) AS edited_sha256, p.f AS fingerprint, p.g AS edited_fingerprint, a.near AS near_edited, b.near AS near_next
FROM e JOIN p USING (doc_id) JOIN near a ON a.doc_id = e.doc_id AND a.kind = 'e' JOIN near b ON b.doc_id = e.doc_id AND b.kind = 'n'
"""
