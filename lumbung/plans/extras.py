"""Title, prompt, template and browsing queries over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extras as E
from .answering import _money
from .profiles import chunks, tagged
from .serving import _P, _hits

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("h7_detect_title", "SELECT source AS document, 'PERATURAN DAERAH ' || source || ' TENTANG Lansia' AS title FROM documents GROUP BY source")
def h7(spark, d):
    docs = chunks(spark, d).select(F.col("source").alias("document")).distinct()
    lines = F.array(F.lit("SALINAN"), F.concat(F.lit("PERATURAN DAERAH "), "document"), F.lit("TENTANG Lansia, dengan"), F.lit("Menimbang : isi"))
    return E.detect_title(docs.select("document", F.lit(1).alias("page"), F.posexplode(lines).alias("line_no", "line")), "document", "page", "line_no")


@query("h8_shorten_title", "SELECT doc_id, 'Perda No. ' || doc_id || ' tentang Hak dan Lansia' AS title FROM documents")
def h8(spark, d):
    return chunks(spark, d).select("doc_id", E.shorten_title(F.concat(F.lit("PERATURAN  DAERAH NOMOR "), "doc_id", F.lit(" TENTANG HAK DAN LANSIA REPUBLIK INDONESIA"))).alias("title"))


@query("p12_prompt_for_sources", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'one' WHEN 1 THEN 'one two' ELSE 'default' END AS prompt FROM documents")
def p12(spark, d):
    k = F.col("doc_id") % 3
    s = F.when(k == 0, F.array(F.lit("a"))).when(k == 1, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("z")))
    return chunks(spark, d).select("doc_id", E.prompt_for(s, {"a": "one", "b": "two"}, "default").alias("prompt"))


@query("p13_template_parts", "SELECT doc_id, source AS profile, CASE WHEN doc_id % 2 = 0 THEN lang END AS instructions FROM documents")
def p13(spark, d):
    t = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("x === PROFIL WARGA ===\n"), "source", F.lit("\n=== AKHIR PROFIL WARGA ===\nINSTRUKSI EKSEKUSI: "), "lang")).otherwise(F.col("source"))
    return chunks(spark, d).select("doc_id", E.template_parts(t).alias("x")).select("doc_id", "x.*")


@query("p18_lifted_keys", "SELECT event_id, props AS parameter FROM events")
def p18(spark, d):
    payload = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"parameter":'), "props", F.lit("}"))).otherwise(F.concat(F.lit('{"laporan_evaluasi":{"parameter":'), "props", F.lit("}}")))
    out = spark.read.parquet(f"{d}/events.parquet").select("event_id", E.lifted(payload, ["parameter"]).alias("x"))
    return out.select("event_id", F.regexp_replace("x.parameter", ":", ": ").alias("parameter"))


@query("n13_profile_numbers", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN (doc_id % 9)::INT END AS decile, [(doc_id % 90)::INT, 7] AS ages FROM documents")
def n13(spark, d):
    i = F.col("doc_id")
    t = F.concat(F.when(i % 2 == 0, "Desil ").otherwise("Desil Nasional : "), i % 9, F.lit("; usia "), i % 90, F.lit(" tahun, anak 7 Tahun"))
    return chunks(spark, d).select("doc_id", E.plain_decile(t).alias("decile"), E.ages(t).alias("ages"))


@query("x7_facts_block", "SELECT program, '- Nominal resmi: ' || string_agg('Rp ' || replace(format('{:,}', a), ',', '.'), ', ' ORDER BY a) AS line FROM (SELECT DISTINCT source AS program, ((doc_id % 40 + 1) || '500000')::BIGINT AS a FROM documents) GROUP BY program")
def x7(spark, d):
    from ..functions import text as X

    rows = _money(spark, d).select("program", F.element_at(X.amounts(F.col("text")), 1).alias("amount")).distinct()
    return E.facts_block(rows.withColumn("display", X.amount_display(F.col("amount"))), "program")


@query("x10_parse_failures", "SELECT event_id FROM events WHERE event_id % 2 = 1")
def x10(spark, d):
    from ..operators.answers import json_block

    raw = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise("no json")
    return E.parse_failures(spark.read.parquet(f"{d}/events.parquet").select("event_id", json_block(raw).alias("json")), "json").select("event_id")


@query("e12_judge_context", _P + " SELECT query_id, list('Sumber: ' || source || ' | Halaman: ' || page || chr(10) || text ORDER BY rank) AS contexts FROM h WHERE rank <= 4 GROUP BY query_id")
def e12(spark, d):
    return E.judge_context(_hits(spark, d), 4)


@query("browse_word", "SELECT doc_id FROM documents WHERE contains(lower(text), 'tion')")
def browse_word(spark, d):
    return E.find_word(tagged(spark, d), "TION", ["text", "title"]).select("doc_id")


@query("browse_page", "SELECT doc_id FROM documents WHERE doc_id % 7 + 1 = 3 AND contains(source, 'src1')")
def browse_page(spark, d):
    return E.page_of(tagged(spark, d), 3, "SRC1").select("doc_id")


@query("browse_nth", "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 1 OFFSET 9")
def browse_nth(spark, d):
    return E.nth(chunks(spark, d), "doc_id", 10).select("doc_id", "source")


