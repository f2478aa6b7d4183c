"""Tables of points, rewritten bucket by bucket, and the lines of chunk files that are taken out."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import fixed
from ..functions import text as X

BUCKETS = 64
#: Updates from which a key may be hot, and the most hot keys.
HOT_ROWS, MOST_HOT = 1_000, 10_000
#: The title of a page whose extraction failed: a fixed value.
FAILED_TITLE = "Ekstraksi Gagal"


def shared_folder(spark: SparkSession, name: str) -> str:
    """URI of a fresh folder in the shared folder that ``spark.checkpoint.dir`` names; only under a local
    master, where it is unset, in a temporary folder."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lumbung-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def points_of(chunks: DataFrame, embed: Callable[[Column], Column], text: str = "text", program: str = "nama_bansos", rules: list = fixed.AUGMENT_RULES, tags: dict = fixed.PROGRAM_TAGS) -> DataFrame:
    """V1: id, embedding, payload and the other columns of chunks with ``text`` and ``metadata`` (a map).

    The id is the UUID of the original text, the vector that of the text with its tags (T17), and the
    payload the original text and the metadata, in which a key ``text`` overrides the text. Rows of low
    priority come along. A null text has a null id and is left out.
    """
    meta = F.coalesce(F.col("metadata"), F.create_map().cast("map<string,string>"))
    shown = F.map_concat(F.create_map(F.lit("text"), F.coalesce(F.try_element_at(meta, F.lit("text")), F.col(text))), F.map_filter(meta, lambda k, _: k != "text"))
    tagged = X.augment(F.col(text), F.coalesce(F.try_element_at(meta, F.lit(program)), F.lit("")), rules, tags)
    others = [c for c in chunks.columns if c not in (text, "metadata", "id", "embedding", "payload")]
    return chunks.filter(F.col(text).isNotNull()).select(X.uuid5(F.col(text)).alias("id"), embed(tagged).alias("embedding"), shown.alias("payload"), *others)


class PointTable:
    """A Parquet table of points at a path that Spark's file systems know.

    Rows lie in ``buckets`` folders by a hash of their key. An upsert or delete reads and rewrites the
    folders that hold a key concerned, and no other (dynamic partition overwrite): the new files are
    written beside the old and take their place when the job commits. A lost executor costs its tasks
    only. One writer at a time is assumed.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "id", buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets
        self._p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        return self._fs.exists(self._p(self.path))

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def _write(self, dealt: DataFrame, path: str) -> None:
        """Rows that are dealt by bucket and part already."""
        dealt.drop("_part").write.partitionBy("_bucket").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)

    def _parted(self, bucketed: DataFrame) -> DataFrame:
        """Dealt by bucket and ``_part``, a further hash of the key: a bucket is no task, and keys stay together."""
        parts = -(-4 * int(self.spark.conf.get("spark.sql.shuffle.partitions")) // self.buckets)
        return bucketed.withColumn("_part", F.pmod(F.hash(self.key), F.lit(parts))).repartition("_bucket", "_part")

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return self._parted(self._bucketed(rows))

    def _stored(self) -> DataFrame:
        return self.spark.read.option("basePath", self.path).parquet(self.path)

    def ensure(self, schema: StructType) -> int:
        """Make the table if it is not there; the number of points."""
        if not self.exists():
            self._declare(schema, self.path)
        return self.read().count()

    def _declare(self, schema: StructType, path: str) -> None:
        """An empty folder that keeps the schema while no other folder does."""
        self.spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/_bucket=-1")

    def read(self) -> DataFrame:
        return self._stored().drop("_bucket")

    def drop(self) -> None:
        """V6."""
        self._fs.delete(self._p(self.path), True)

    def replace(self, rows: DataFrame) -> None:
        """Write beside the table, then swap; the old table stays as it is until then."""
        fresh = f"{self.path}.{uuid.uuid4().hex}"
        self._write(self._dealt(rows), fresh)
        self._declare(rows.schema, fresh)
        self.drop()
        if not self._fs.rename(self._p(fresh), self._p(self.path)):
            raise OSError(f"could not move {fresh} to {self.path}")

    def fill_if_empty(self, rows: DataFrame) -> bool:
        """I8: write the rows unless the table holds any; whether it was written."""
        if self.exists() and not self.read().isEmpty():
            return False
        self.replace(rows)
        return True

    def _buckets_of(self, keys: DataFrame) -> list[int]:
        return sorted(r[0] for r in self._bucketed(keys.select(self.key)).select("_bucket").distinct().collect())  # at most `buckets`

    def _settled(self, ranked: DataFrame) -> DataFrame:
        """Updates (with ``_rank``) without those of hot keys that others overwrite, so that no bucket gets
        them. A key is hot from a ten-thousandth of all updates on; so at most ten thousand are, and their
        last ranks, found by a partial aggregation over keys and ranks, are broadcast."""
        sizes = ranked.groupBy(F.col(self.key).alias("_hot")).agg(F.count(F.lit(1)).alias("_n"), F.max("_rank").alias("_last"))
        rows = ranked.count()
        hot = sizes.filter(F.col("_n") >= max(HOT_ROWS, rows // MOST_HOT)).select("_hot", "_last")
        met = ranked.join(F.broadcast(hot), F.col(self.key) == F.col("_hot"), "left")
        return met.filter(F.col("_last").isNull() | (F.col("_rank") == F.col("_last"))).drop("_hot", "_last")

    def upsert(self, updates: DataFrame, order: str) -> list[int]:
        """V1: of each key the last update by ``order`` takes the place of what the table holds.

        Equal orders go by a hash of the row. Whole rows move once: what the touched buckets hold and the
        updates are dealt by bucket, and the last row of each key is found and written where it lands.
        Rows with a null key are left out. A table that is not there is made. Returns the numbers of the
        buckets rewritten.
        """
        columns = updates.columns
        if not self.exists():
            self.ensure(updates.schema)
        sound = updates.filter(F.col(self.key).isNotNull())
        touched = self._buckets_of(sound)
        if touched:
            hashed = F.xxhash64(*[F.map_entries(c) if t.startswith("map") else F.col(c) for c, t in updates.dtypes])
            ranked = self._settled(sound.withColumn("_rank", F.struct(F.lit(1).alias("turn"), F.col(order).alias("order"), hashed.alias("hash"))))
            old = self._stored().filter(F.col("_bucket").isin(touched)).drop("_bucket")
            stored = old.withColumn("_rank", F.struct(F.lit(0).alias("turn"), F.lit(None).cast(updates.schema[order].dataType).alias("order"), F.lit(0).cast("long").alias("hash")))
            both = self._dealt(stored.unionByName(ranked, allowMissingColumns=True))
            last = both.groupBy("_bucket", "_part", F.col(self.key).alias("_key")).agg(F.max_by(F.struct(*columns), F.col("_rank")).alias("_row"))
            self._write(last.select("_row.*", "_bucket"), self.path)
        return touched

    def delete(self, where: Column) -> list[int]:
        """V5: rows that meet the condition go; those for which it is null stay."""
        stored, hit = self._stored(), F.coalesce(where, F.lit(False))
        sizes = stored.groupBy("_bucket").agg(F.count_if(hit).alias("gone"), F.count_if(~hit).alias("left"))
        touched = {r["_bucket"]: r["left"] for r in sizes.filter("gone > 0").collect()}  # at most `buckets` rows
        full, empty = [b for b, n in touched.items() if n], [b for b, n in touched.items() if not n]
        if full:
            self._write(self._parted(stored.filter(F.col("_bucket").isin(full) & ~hit)), self.path)
        for b in empty:  # an overwrite leaves folders alone that get no row
            self._fs.delete(self._p(f"{self.path}/_bucket={b}"), True)
        return sorted(touched)


def _field(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _without_pages(lines: DataFrame, pages: DataFrame, also: Callable[[Column], Column] | None) -> DataFrame:
    v = X.whole_json(X.strip(F.col("value")))
    meta = _field(v, "$.metadata", "variant")
    sound = F.startswith(F.schema_of_variant(v), F.lit("OBJECT<")) & F.coalesce(F.startswith(F.schema_of_variant(meta), F.lit("OBJECT<")), F.lit(True))
    own = lines.filter(X.strip(F.col("value")) != "").withColumn("_v", v)
    v = F.col("_v")
    number = F.when(~F.schema_of_variant(_field(v, "$.metadata.page_number", "variant")).isin("STRING", "BOOLEAN", "VOID"), _field(v, "$.metadata.page_number", "double"))
    page = F.when(_field(v, "$.metadata.page_number", "variant").isNull(), F.lit(0.0)).otherwise(number)
    found = own.withColumn("_source", F.when(sound, F.coalesce(_field(v, "$.metadata.sumber", "string"), F.lit("")))).withColumn("_page", page)
    found = found.withColumn("_may", sound & (F.lit(True) if also is None else F.coalesce(also(v), F.lit(False)))).drop("_v")
    gone = pages.select(F.col("source").alias("_s"), F.col("page").cast("double").alias("_p")).distinct()
    same = F.col("_may") & (F.col("_source") == F.col("_s")) & (F.col("_page") == F.col("_p"))
    return found.join(gone, same, "left_anti").select(*lines.columns)


def reset_pages(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Lines (column ``value``) without those of the pages (source, page); a line without a source or
    page has "" and 0. Lines that do not parse, or are no objects, stay; blank lines go."""
    return _without_pages(lines, pages, None)


def reset_checkpoint(marks: DataFrame, pages: DataFrame) -> DataFrame:
    """The checkpoint (document, page, status) without the pages (source, page), completed or failed."""
    gone = pages.select(F.col("source").alias("document"), "page").distinct()
    return marks.join(gone, ["document", "page"], "left_anti").select(*marks.columns)


def cleanup_errors(lines: DataFrame, done: DataFrame, title: str = FAILED_TITLE) -> DataFrame:
    """Lines without the failure entries of pages (source, page) whose retry has succeeded."""
    return _without_pages(lines, done, lambda v: _field(v, "$.metadata.judul_halaman", "string") == title)
