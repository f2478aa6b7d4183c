"""Scans of JSON lines in four strengths, and what belongs to reading and writing chunk files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import let, strip, whole_json


def _parsed(lines: DataFrame) -> DataFrame:
    """The lines with ``_line``, stripped, and ``_v``, its JSON, each made once a row however often it is
    used: no projection is merged through the explode of one struct."""
    own = lines.withColumn("_s", F.explode_outer(F.array(F.struct(strip(F.col("value")).alias("line"))))).withColumn("_line", F.col("_s.line")).drop("_s")
    return own.withColumn("_s", F.explode_outer(F.array(F.struct(whole_json(F.col("_line")).alias("v"))))).withColumn("_v", F.col("_s.v")).drop("_s")


def line_outcome(line: Column, v: Column | None = None) -> Column:
    """Blank, invalid_json, invalid_schema or row: an object with a string text and an object metadata.
    ``v`` is the stripped line's JSON, if that is there already."""
    if v is None:
        return let(strip(line), lambda x: let(whole_json(x), lambda j: line_outcome(x, j)))

    def kind(path: str) -> Column:
        return F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit("none"))

    return (
        F.when(line == "", "blank")
        .when(v.isNull(), "invalid_json")
        .when(~F.startswith(F.schema_of_variant(v), F.lit("OBJECT<")) | (kind("$.text") != "STRING") | ~F.startswith(kind("$.metadata"), F.lit("OBJECT<")), "invalid_schema")
        .otherwise("row")
    )


def scan_strict(lines: DataFrame) -> DataFrame:
    """The lines (column ``value``) with their outcome, text and metadata as JSON text."""
    v, ok = F.col("_v"), F.col("outcome") == "row"
    found = _parsed(lines).withColumn("outcome", line_outcome(F.col("_line"), v)).filter("outcome != 'blank'")
    return found.select(*lines.columns, "outcome", F.when(ok, F.try_variant_get(v, "$.text", "string")).alias("text"), F.when(ok, F.to_json(F.try_variant_get(v, "$.metadata", "variant"))).alias("metadata"))


def scan_lenient(lines: DataFrame) -> DataFrame:
    """Lines that are objects with the keys text and metadata, of whatever type; the rest is skipped."""
    v = whole_json(strip(F.col("value")))
    here = [F.try_variant_get(v, f"$.{k}", "variant").isNotNull() for k in ("text", "metadata")]
    return lines.filter(v.isNotNull() & here[0] & here[1]).withColumn("text", F.to_json(F.try_variant_get(v, "$.text", "variant")))


def scan_silent(lines: DataFrame) -> DataFrame:
    """S3: every line that parses, as compact JSON; the rest is dropped without a word."""
    v = whole_json(strip(F.col("value")))
    return lines.filter(v.isNotNull()).withColumn("json", F.to_json(v))


def scan_fail_fast(lines: DataFrame, path: Column, number: Column) -> DataFrame:
    """The first line that does not parse ends the query, its place named."""
    v = whole_json(strip(F.col("value")))
    json = F.when(v.isNotNull(), F.to_json(v)).otherwise(F.raise_error(F.concat(path, F.lit(":"), number.cast("string"), F.lit(": invalid JSON"))))
    return lines.filter(strip(F.col("value")) != "").withColumn("json", json)


def ingest_files(files: DataFrame, suffix: str = "_normalized", extension: str = ".jsonl", mode: str = "auto") -> DataFrame:
    """Files (column ``name``) with the extension, with their ``place`` in order of name: in mode ``all``
    every one, else less those that have a normalised twin. Names that come twice count once."""
    found = files.filter(F.endswith("name", F.lit(extension))).dropDuplicates(["name"])
    if mode != "all":
        stem = F.substr("name", F.lit(1), F.length("name") - len(extension))
        twins = found.select(F.col("name").alias("_twin"))
        found = found.withColumn("_twin", F.concat(stem, F.lit(suffix + extension))).join(twins, "_twin", "left_anti").select(*files.columns)
    # A file set is one row a file; its order is wanted as a whole.
    return found.withColumn("place", F.row_number().over(Window.orderBy("name")))


def explode_documents(documents: DataFrame) -> DataFrame:
    """Rows of (metadata map, items array of struct with text, isi, meta map) become a row for each
    item with text; the document's metadata goes over the item's."""
    item = documents.select("metadata", F.explode("items").alias("item"))
    text = strip(F.coalesce(F.nullif(F.col("item.text"), F.lit("")), F.col("item.isi")))
    own = F.map_filter(F.coalesce("item.meta", F.create_map().cast("map<string,string>")), lambda k, v: ~F.array_contains(F.map_keys("metadata"), k))
    return item.select(text.alias("text"), F.map_concat(own, "metadata").alias("metadata")).filter("text is not null and text != ''")


def page_route(lines: DataFrame, document: str, threshold: float = 50.0, problems: DataFrame | None = None) -> DataFrame:
    """Documents with fewer than ``threshold`` characters a page are scans and go to OCR.

    ``problems`` (document, unreadable, ocr_failed) adds documents that could not be opened or have no
    pages: they go to OCR, too; where OCR itself fails, the native text is taken.
    """
    own = lines.groupBy(document).agg(F.avg(F.length(strip(F.coalesce("text", F.lit(""))))).alias("mean_length"))
    if problems is None:
        return own.withColumn("route", F.when(F.col("mean_length") < threshold, "ocr").otherwise("native"))
    met = own.join(problems.select(document, "unreadable", "ocr_failed"), document, "full")
    scan = F.coalesce("unreadable", F.lit(False)) | F.col("mean_length").isNull() | (F.col("mean_length") < threshold)
    return met.select(document, "mean_length", F.when(scan & ~F.coalesce("ocr_failed", F.lit(False)), "ocr").otherwise("native").alias("route"))


def titled_response(raw: Column, page: Column | None = None, error: Column | None = None) -> Column:
    """Struct (title, content) of a page reader's answer with its two labels. Without a title label a
    stated one stands. With ``error``, a reader's failure gives the failure's title and a sentence."""
    title = F.regexp_extract(raw, r"\[JUDUL\]:\s*([^\n]*)", 1)
    titled = F.when(F.coalesce(raw, F.lit("")).rlike(r"\[JUDUL\]:"), strip(title)).otherwise(F.lit(fixed.UNTITLED))
    content = strip(F.element_at(F.split(raw, r"\[KONTEN\]:"), -1))
    if error is None:
        return F.struct((strip(title) if page is None else titled).alias("title"), content.alias("content"))
    told = F.concat(F.lit("[Halaman "), page.cast("string"), F.lit("] "), F.lit(fixed.FAILED_TEXT), F.lit(": "), error)
    return F.struct(F.when(error.isNotNull(), F.lit(fixed.FAILED_TITLE)).otherwise(titled).alias("title"), F.when(error.isNotNull(), told).otherwise(F.coalesce(content, F.lit(""))).alias("content"))


def first_success(attempts: list[Column], native: Column, least: int = 50) -> Column:
    """S11 for attempts in columns: the first that gave text, else the native text if long enough, else null."""
    return F.coalesce(*[F.nullif(strip(a), F.lit("")) for a in attempts], F.when(F.length(strip(native)) >= least, native))


#: The rungs of the retry ladder in order: scales of the page's image, and its two halves.
SCALES, HALVES = ("2.0", "1.5", "1.0"), ("half-1", "half-2")


def resolved_pages(pages: DataFrame, attempts: DataFrame, failed: DataFrame, least: int = 50) -> DataFrame:
    """What each page (document, page, native) comes to, by the first rung of the ladder that holds.

    ``attempts``: document, page, rung (of SCALES and HALVES), title, content; an attempt with the
    failure's title has failed. Pages of ``failed`` (document, page), the checkpoint's failed ones, skip the
    first scale. Then each scale in turn; both halves, joined under their names; the native text if it has
    at least ``least`` characters; else the page fails, and says what the last scale said. A rung that was
    tried more than once counts by its greatest content. Columns: document, page, title, content, rung, ok.
    """
    key = ["document", "page"]
    ok = F.col("title") != fixed.FAILED_TITLE
    said = F.struct(ok.alias("ok"), "title", "content")
    tried = attempts.groupBy(*key).agg(*[F.max(F.when(F.col("rung") == r, said)).alias(r) for r in (*SCALES, *HALVES)])
    known = failed.select(*key).distinct().withColumn("_known", F.lit(True))
    met = pages.select(*key, "native").join(tried, key, "left").join(known, key, "left")
    at = lambda r: F.col(f"`{r}`")
    use = {r: F.when(at(r)["ok"] & (F.lit(r != SCALES[0]) | F.col("_known").isNull()), F.struct(at(r)["title"].alias("title"), at(r)["content"].alias("content"), F.lit(r).alias("rung"))) for r in SCALES}
    halves = F.concat_ws("\n\n", *[F.concat(F.lit(f"[BAGIAN-{i + 1}]\n"), at(h)["content"]) for i, h in enumerate(HALVES)])
    split = F.when(at(HALVES[0])["ok"] & at(HALVES[1])["ok"], F.struct(F.lit(fixed.SPLIT_TITLE).alias("title"), halves.alias("content"), F.lit("halves").alias("rung")))
    native = strip(F.coalesce("native", F.lit("")))
    digital = F.when(F.length(native) >= least, F.struct(F.lit(fixed.NATIVE_TITLE).alias("title"), native.alias("content"), F.lit("native").alias("rung")))
    last = F.coalesce(*[at(r)["content"] for r in reversed(SCALES[1:])], F.when(F.col("_known").isNull(), at(SCALES[0])["content"]), F.lit(""))
    lost = F.struct(F.lit(fixed.FAILED_TITLE).alias("title"), last.alias("content"), F.lit("none").alias("rung"))
    return met.withColumn("_w", F.coalesce(*use.values(), split, digital, lost)).select(*key, "_w.*", (F.col("_w.rung") != "none").alias("ok"))


def cached_pages(chunks: DataFrame, method: str, order: str, keys: list[str]) -> DataFrame:
    """The last row of each page that the given method read."""
    return chunks.filter(F.col("method") == method).groupBy(*keys).agg(F.max_by("text", order).alias("text"))


# Incremental state


def files_to_process(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose content hash the manifest does not hold."""
    return found.join(manifest, ["name", "sha256"], "left_anti")


def pending_pages(documents: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """Pages 1 to ``pages`` of each document less those completed and not failed."""
    every = documents.select("document", F.explode(F.sequence(F.lit(1).cast("long"), F.col("pages").cast("long"))).alias("page"))
    done = checkpoint.groupBy("document", "page").agg(F.bool_or(F.col("status") == "completed").alias("ok"), F.bool_or(F.col("status") == "failed").alias("bad")).filter("ok and not bad")
    return every.join(done, ["document", "page"], "left_anti")


def bootstrap_checkpoint(chunks: DataFrame, source: str, page: str) -> DataFrame:
    """The pages that an existing output has."""
    return chunks.filter((F.col(source) != "") & F.col(page).isNotNull() & (F.col(page) != 0)).select(source, page).distinct()


def without_known(chunks: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the known."""
    return chunks.join(known, key, "left_anti")


# Point tables


def numbered(chunks: DataFrame, order: str, priority: str = "priority", parts: int = 256) -> DataFrame:
    """V2: rows that are not of low priority, numbered from 0 by ``order``, a number.

    No task sorts the whole table: quantiles of ``order`` (one action) cut it into ranges, rows are
    numbered within theirs, and the rows of the ranges before are added. Null orders come first.
    """
    kept = chunks.filter(F.col(priority) != "low")
    cuts = kept.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)], 32 * parts)).first()[0] if parts > 1 else None
    cuts = sorted(set(cuts or []))
    part = F.size(F.filter(F.lit(cuts), lambda c: c < F.col(order))) if cuts else F.lit(0)
    placed = kept.withColumn("_part", F.when(F.col(order).isNull(), 0).otherwise(part))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = sizes.select("_part", (F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")).alias("_before"))
    within = placed.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(order)))
    return within.join(F.broadcast(before), "_part").withColumn("id", F.col("_before") + F.col("_at") - 1).drop("_part", "_at", "_before")


def ingest_gate(chunks: DataFrame, required: list[str]) -> DataFrame:
    """V4: rows that lack each required column; an ingest goes on only if all are 0."""
    return chunks.agg(*[F.count_if(F.col(c).isNull() | (F.col(c).cast("string") == "")).alias(c) for c in required])


def vector_stats(points: DataFrame, vector: str) -> DataFrame:
    """V8: dimension, least, greatest, mean, population deviation, norm and first ten values."""
    v = F.transform(vector, lambda x: x.cast("double"))
    n = F.size(v)
    mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / n
    square = F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    return points.select(
        *[c for c in points.columns if c != vector], n.alias("dimension"), F.array_min(v).alias("least"), F.array_max(v).alias("greatest"), mean.alias("mean"),
        F.sqrt(F.greatest(F.lit(0.0), square / n - mean * mean)).alias("deviation"), F.sqrt(square).alias("norm"), F.slice(v, 1, 10).alias("head"),
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with the file each comes from."""
    return spark.read.text(path).select("value", F.input_file_name().alias("file"))


def write_lines(df: DataFrame, path: str, append: bool = False) -> None:
    """K1: rows as JSON lines."""
    df.write.mode("append" if append else "overwrite").json(path)
