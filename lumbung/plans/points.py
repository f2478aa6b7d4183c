"""Point tables and the upkeep of chunk files over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import points as S
from .cleaning import _UUID
from .profiles import chunks

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


#: Patterns of the driver's languages, and a program, with the tags that they add to what is embedded.
RULES = [("the|der", "[b]"), ("que", "[a]")]
TAGS = {"src3": "[c]"}


def _chunks(spark, d):
    """Whole texts with metadata; in every thirteenth row the metadata has a text of its own."""
    i = F.col("doc_id").cast("string")
    meta = F.create_map(F.lit("nama_bansos"), F.col("source"), F.lit("kategori"), F.coalesce("lang", F.lit("")), F.lit("row"), i)
    own = F.create_map(F.lit("text"), F.concat(F.lit("own "), i))
    empty = F.create_map().cast("map<string,string>")
    return chunks(spark, d).select("doc_id", "text", F.map_concat(meta, F.when(F.col("doc_id") % 13 == 0, own).otherwise(empty)).alias("metadata"))


def _embedded(text):
    """A vector that depends on every character: numbers from the digits of a hash."""
    return F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.conv(F.substr(F.md5(text), 4 * k + 1, F.lit(4)), 16, 10).cast("double"))


def _table(spark, d):
    """A table filled with the even rows, into which every third row is put."""
    table = S.PointTable(spark, S.shared_folder(spark, "points"), buckets=16)
    points = S.points_of(_chunks(spark, d), _embedded, rules=RULES, tags=TAGS)
    table.upsert(points.filter("doc_id % 2 = 0"), "doc_id")
    table.upsert(points.filter("doc_id % 3 = 0"), "doc_id")
    return table


_T = f"""WITH c AS (SELECT doc_id, text, source, coalesce(lang, '') AS lang, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS round, sha1(from_hex('6ba7b8109dad11d180b400c04fd430c8') || encode(text)) AS h,
 list_filter([CASE WHEN regexp_matches(text, '(?i)the|der') THEN '[b]' END, CASE WHEN regexp_matches(text, '(?i)que') THEN '[a]' END, CASE WHEN source = 'src3' THEN '[c]' END], lambda x: x IS NOT NULL) AS t
 FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0),
a AS (SELECT *, {_UUID} AS id, md5(text || CASE WHEN len(t) > 0 THEN chr(10) || array_to_string(list_sort(t), ' ') ELSE '' END) AS v FROM c),
p AS (SELECT id, doc_id, list_transform(range(4), lambda k: ('0x' || substr(v, 4 * k + 1, 4))::INT::DOUBLE) AS embedding, md5(CASE WHEN doc_id % 13 = 0 THEN 'own ' || doc_id ELSE text END) AS text, lang AS category, doc_id::VARCHAR AS row
 FROM a QUALIFY row_number() OVER (PARTITION BY id ORDER BY round DESC, doc_id DESC) = 1)"""


def _shown(table):
    payload = lambda k: F.try_element_at("payload", F.lit(k))
    return table.read().select("id", "doc_id", "embedding", F.md5(payload("text")).alias("text"), payload("kategori").alias("category"), payload("row").alias("row"))


@query("v1_upsert_last_wins", _T + " SELECT * FROM p")
def v1(spark, d):
    return _shown(_table(spark, d))


@query("v5_delete_by_filter", _T + " SELECT * FROM p WHERE NOT (category = 'fr' OR doc_id % 5 = 0)")
def v5(spark, d):
    table = _table(spark, d)
    table.delete((F.col("payload")["kategori"] == "fr") | (F.col("doc_id") % 5 == 0))
    return _shown(table)


@query("v10_ensure_collection", "SELECT 0 AS before, (SELECT count(*) FROM embeddings) AS after, (SELECT count(*) FROM embeddings) AS again")
def v10(spark, d):
    """A table is made, filled once, and a second fill leaves it as it is; then it is dropped."""
    points = spark.read.parquet(f"{d}/embeddings.parquet")
    table = S.PointTable(spark, S.shared_folder(spark, "points"), "vec_id", 8)
    before = table.ensure(points.schema)
    table.fill_if_empty(points)
    after = table.read().agg(F.count("*").alias("after"))
    table.fill_if_empty(points.limit(1))
    out = after.select(F.lit(before).cast("long").alias("before"), "after").crossJoin(F.broadcast(table.read().agg(F.count("*").alias("again"))))
    return out


@query("i7_backup_swap", "SELECT doc_id, md5(text) AS text FROM documents WHERE doc_id % 3 <> 0")
def i7(spark, d):
    """The table is read, filtered and written in its own place."""
    table = S.PointTable(spark, S.shared_folder(spark, "points"), "doc_id", 8)
    table.replace(chunks(spark, d).select("doc_id", "text"))
    table.replace(table.read().filter("doc_id % 3 <> 0"))
    return table.read().select("doc_id", F.md5("text").alias("text"))


def _lines(spark, d):
    """A line for each document: its row, the row of a failed page, lines that do not parse, a list, or blank."""
    i = F.col("doc_id")
    meta = F.struct(F.col("source").alias("sumber"), (i % 7).alias("page_number"), F.when(i % 4 == 0, S.FAILED_TITLE).alias("judul_halaman"))
    whole = F.to_json(F.struct("text", meta.alias("metadata")))
    value = F.when(i % 11 == 0, F.concat(whole, F.lit("}"))).when(i % 13 == 0, "[1]").when(i % 17 == 0, "  ").when(i % 19 == 0, F.to_json(F.struct("text"))).otherwise(whole)
    return chunks(spark, d).select("doc_id", value.alias("value"))


_L = """WITH l AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN w || '}' WHEN doc_id % 13 = 0 THEN '[1]' WHEN doc_id % 17 = 0 THEN '  ' WHEN doc_id % 19 = 0 THEN json_object('text', text)::VARCHAR ELSE w END AS value
 FROM (SELECT *, json_object('text', text, 'metadata', json_object('sumber', source, 'page_number', doc_id % 7, 'judul_halaman', CASE WHEN doc_id % 4 = 0 THEN 'Ekstraksi Gagal' END))::VARCHAR AS w FROM documents)),
j AS (SELECT doc_id, CASE WHEN json_valid(value) THEN value::JSON END AS j FROM l WHERE trim(value) <> ''),
f AS (SELECT doc_id, CASE WHEN json_type(j) = 'OBJECT' THEN coalesce(j->>'$.metadata.sumber', '') END AS source, coalesce((j->>'$.metadata.page_number')::INT, 0) AS page, coalesce(j->>'$.metadata.judul_halaman', '') AS title FROM j),
g AS (SELECT DISTINCT source, doc_id % 7 AS page FROM documents WHERE lang = 'es')"""


def _gone(spark, d):
    return chunks(spark, d).filter("lang = 'es'").select("source", (F.col("doc_id") % 7).alias("page"))


@query("i5_error_cleanup", _L + " SELECT doc_id FROM f WHERE NOT coalesce(title = 'Ekstraksi Gagal' AND EXISTS (SELECT 1 FROM g WHERE g.source = f.source AND g.page = f.page), false)")
def i5(spark, d):
    return S.cleanup_errors(_lines(spark, d), _gone(spark, d)).select("doc_id")


@query("i6_page_reset", _L + " SELECT doc_id FROM f WHERE NOT coalesce(EXISTS (SELECT 1 FROM g WHERE g.source = f.source AND g.page = f.page), false)")
def i6(spark, d):
    return S.reset_pages(_lines(spark, d), _gone(spark, d)).select("doc_id")


@query("i6_checkpoint_reset", "SELECT document, page, status FROM (SELECT DISTINCT source AS document, doc_id % 7 AS page, CASE WHEN lang = 'en' THEN 'completed' ELSE 'failed' END AS status FROM documents) c WHERE NOT EXISTS (SELECT 1 FROM documents g WHERE g.lang = 'es' AND g.source = c.document AND g.doc_id % 7 = c.page)")
def i6_checkpoint(spark, d):
    marks = chunks(spark, d).select(F.col("source").alias("document"), (F.col("doc_id") % 7).alias("page"), F.when(F.col("lang") == "en", "completed").otherwise("failed").alias("status")).distinct()
    return S.reset_checkpoint(marks, _gone(spark, d))


@query("k1_lines_written", "SELECT doc_id, source, md5(text) AS text FROM documents")
def k1(spark, d):
    """K1: whole rows written as JSON lines, in two appended parts, and read back."""
    from ..sources import jsonl

    path, rows = S.shared_folder(spark, "lines"), chunks(spark, d).select("doc_id", "source", "text")
    jsonl.write_lines(rows.filter("doc_id % 2 = 0"), path)
    jsonl.write_lines(rows.filter("doc_id % 2 = 1"), path, append=True)
    return spark.read.schema(rows.schema).json(path).select("doc_id", "source", F.md5("text").alias("text"))
