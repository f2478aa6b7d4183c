"""Amount, context, parsing, hierarchy and scoring queries over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import answers as A
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


def _n(i):
    return (F.col("doc_id") * 500 + i).cast("string")


def _money(spark, d):
    """Texts with amounts made from doc_id: an aid amount with dots, and stamp duty in every third."""
    i = F.col("doc_id") % 40 + 1
    aid = F.concat(F.lit("Besaran bantuan sebesar Rp "), i, F.lit(".500.000,- per tahap"))
    duty = F.when(F.col("doc_id") % 3 == 0, F.lit("\nMaterai Rp. 10.000")).otherwise("")
    return chunks(spark, d).select("doc_id", F.col("source").alias("program"), F.col("lang").alias("query_id"), (F.col("doc_id") % 5).alias("page"), F.concat(aid, duty).alias("text"), (F.col("doc_id") % 2 == 0).alias("appendix"))


_M = "WITH m AS (SELECT doc_id, source AS program, lang AS query_id, doc_id % 5 AS page, doc_id % 2 = 0 AS appendix, (doc_id % 40 + 1) || '500000' AS a, doc_id % 3 = 0 AS duty, 'Besaran bantuan sebesar Rp ' || (doc_id % 40 + 1) || '.500.000,- per tahap' AS line FROM documents)"


@query("n1_amounts", _M + " SELECT doc_id, CASE WHEN duty THEN [a, '10000'] ELSE [a] END AS amounts FROM m")
def n1(spark, d):
    return _money(spark, d).select("doc_id", X.amounts(F.col("text")).alias("amounts"))


@query("n2_amount_display", "SELECT doc_id, replace(format('{:,}', doc_id * 500), ',', '.') AS display FROM documents")
def n2(spark, d):
    return chunks(spark, d).select("doc_id", X.amount_display(_n(0)).alias("display"))


@query("n4_aid_amount", _M + " SELECT doc_id, NOT duty AS aid FROM m")
def n4(spark, d):
    return _money(spark, d).select("doc_id", X.is_aid_amount(F.col("text")).alias("aid"))


@query("n5_amount_units", _M + " SELECT doc_id, [line] AS units FROM m")
def n5(spark, d):
    return _money(spark, d).select("doc_id", X.amount_units(F.col("text")).alias("units"))


@query("n7_amount_catalog", _M + ", x AS (SELECT program, doc_id, a AS amount FROM m UNION ALL SELECT program, doc_id, '10000' FROM m WHERE duty), y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY program, amount ORDER BY doc_id) <= 5) SELECT program, amount, list(doc_id ORDER BY doc_id) AS evidence FROM y GROUP BY ALL")
def n7(spark, d):
    return A.amount_catalog(_money(spark, d), "program", "doc_id").select("program", "amount", "evidence")


@query("n8_facts_per_program", _M + ", o AS (SELECT * FROM m WHERE NOT duty QUALIFY row_number() OVER (PARTITION BY query_id, program, page, line, duty ORDER BY doc_id) = 1), e AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY query_id, program ORDER BY doc_id) <= 4) SELECT query_id, program, doc_id FROM e QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY doc_id) <= 18")
def n8(spark, d):
    return A.facts(_money(spark, d), "program", "doc_id").select("query_id", "program", "doc_id")


@query("n9_tag_set", "SELECT doc_id, CASE WHEN lang = 'en' THEN ['en', 'x'] ELSE ['en', 'x', lang] END AS tags FROM documents")
def n9(spark, d):
    return chunks(spark, d).select("doc_id", X.tag_set(F.array(F.lit("en"), F.lit("x")), F.col("lang")).alias("tags"))


@query("x1_grouped_context", "SELECT program, coalesce(c, '(tidak ada)') AS context FROM (SELECT DISTINCT source AS program FROM documents) p LEFT JOIN (SELECT source, string_agg(lang || doc_id, chr(10) ORDER BY doc_id) AS c FROM documents GROUP BY source) h ON h.source = p.program")
def x1(spark, d):
    docs = chunks(spark, d)
    hits = docs.select(F.col("source").alias("program"), "doc_id", F.concat("lang", F.col("doc_id").cast("string")).alias("text"))
    return A.grouped_context(docs.select(F.col("source").alias("program")).distinct(), hits, "doc_id")


@query("x2_flat_context", "SELECT lang AS query_id, string_agg(source || doc_id, chr(10) || chr(10) ORDER BY doc_id) AS context FROM documents GROUP BY lang")
def x2(spark, d):
    hits = chunks(spark, d).select(F.col("lang").alias("query_id"), "doc_id", F.concat("source", F.col("doc_id").cast("string")).alias("text"))
    return A.flat_context(hits, "doc_id")


def _pick(n, *texts):
    return F.element_at(F.array(*[t if isinstance(t, Column) else F.lit(t) for t in texts]), (F.pmod(n, F.lit(len(texts))) + 1).cast("int"))


def _raw_answers(spark, d):
    """Tabular answers of several shapes: whole texts in quotes, cells over two lines, doubled and open
    quotes, short lines, headings, fences, open thinking, JSON in prose, and none of these."""
    i = F.col("doc_id")
    n = i.cast("string")
    told = F.concat(F.lit('ringkasan_profil,-,-,"'), F.regexp_replace("text", '"', '""'), F.lit('"\n'))
    good = F.concat(F.lit('rekomendasi, P'), n, F.lit(', ELIGIBLE,"Rank: '), (i % 9).cast("string"), F.lit(' | Dasar Hukum: a, b, c\n, d, e, f: g | Alasan: x, y: ""z"", w"\n'))
    poor = F.concat(F.lit("program_tidak_sesuai,Q"), n, F.lit(",TIDAK,"), _pick(i, '"Alasan: usia, desil"', "alasan: kurang", '"tanpa" sebab,more', '"open, Rank: 4\n'), F.lit("\n"))
    advice = F.concat(F.lit("rekomendasi_teknis_bansos,-,-,"), _pick(i, "null", "-", '"pakai, ""ini"""', ""), F.lit("\n"))
    head = F.lit("Hasil[4]{Kategori,Nilai/Program,Status,Detail/Alasan}:\n# note, a, b, c\nshort,row\n")
    table = F.concat(_pick(i, "<think>a,b,c,d</think>", "", "<THINK>x"), F.lit("```toon\n"), head, F.when(i % 3 == 0, told).otherwise(""), good, advice, F.when(i % 5 < 3, poor).otherwise(""), F.lit("```"))
    other = _pick(i, F.concat(F.lit("So: {"), F.lit('"id": '), n, F.lit("} end")), F.concat(F.lit('```json\n{"id": '), n, F.lit("}}\n```")), F.col("text"), "Hasil[0]{}: nothing")
    return chunks(spark, d).select("doc_id", F.when(i % 4 < 3, table).otherwise(F.concat(F.when(i % 8 == 3, "<think>never closed</think>").otherwise(""), other)).alias("raw"))


_ANSWERS = r'''WITH a AS (SELECT doc_id, CASE WHEN doc_id % 4 < 3 THEN concat(['<think>a,b,c,d</think>', '', '<THINK>x'][doc_id % 3 + 1], '```toon', chr(10), 'Hasil[4]{Kategori,Nilai/Program,Status,Detail/Alasan}:', chr(10), '# note, a, b, c', chr(10), 'short,row', chr(10),
  CASE WHEN doc_id % 3 = 0 THEN 'ringkasan_profil,-,-,"' || replace(text, '"', '""') || '"' || chr(10) ELSE '' END, 'rekomendasi, P', doc_id, ', ELIGIBLE,"Rank: ', doc_id % 9, ' | Dasar Hukum: a, b, c', chr(10), ', d, e, f: g | Alasan: x, y: ""z"", w"', chr(10),
  'rekomendasi_teknis_bansos,-,-,', ['null', '-', '"pakai, ""ini"""', ''][doc_id % 4 + 1], chr(10), CASE WHEN doc_id % 5 < 3 THEN concat('program_tidak_sesuai,Q', doc_id, ',TIDAK,', ['"Alasan: usia, desil"', 'alasan: kurang', '"tanpa" sebab,more', '"open, Rank: 4' || chr(10)][doc_id % 4 + 1], chr(10)) ELSE '' END, '```')
 ELSE concat(CASE WHEN doc_id % 8 = 3 THEN '<think>never closed</think>' ELSE '' END, [concat('So: {"id": ', doc_id, '} end'), concat('```json', chr(10), '{"id": ', doc_id, '}}', chr(10), '```'), text, 'Hasil[0]{}: nothing'][doc_id % 4 + 1]) END AS raw FROM documents),
t AS (SELECT doc_id, trim(regexp_replace(regexp_replace(raw, '(?is)<think>.*?</think>', '', 'g'), '(?is)<think>.*$', '', 'g'), chr(10) || ' ') AS raw FROM a),
l AS (SELECT doc_id, raw, contains(raw, 'Hasil[') OR contains(raw, 'ringkasan_profil,') OR contains(raw, 'rekomendasi,') AND contains(raw, 'program_tidak_sesuai,') AS tabular,
 list_filter(list_transform(string_split(trim(regexp_replace(trim(regexp_replace(raw, '```(?:toon)?\s*', '', 'g'), chr(10) || ' '), '`+\z', ''), chr(10) || ' '), chr(10)), lambda x: trim(x)), lambda x: len(regexp_replace(x, '[^,]', '', 'g')) >= 3 AND NOT regexp_matches(x, '^(Hasil\[|Hasil \{|#)|Kategori,Nilai/Program')) AS lines FROM t),
c AS (SELECT doc_id, unnest(regexp_extract_all(s, p, 1)) AS before, unnest(regexp_extract_all(s, p, 2)) AS cell, generate_subscripts(regexp_extract_all(s, p, 1), 1) AS pos FROM (SELECT doc_id, array_to_string(lines, chr(10)) AS s, '(\A|,|
)("[^"]*(?:""[^"]*)*(?:"[^,
]*|\z)|[^",
][^,
]*|)' AS p FROM l WHERE len(lines) > 0)),
u AS (SELECT doc_id, pos, sum(CASE WHEN before = ',' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS r, trim(CASE WHEN NOT starts_with(cell, '"') THEN cell WHEN regexp_matches(cell, '^"[^"]*(?:""[^"]*)*"(?:[^"]|$)') THEN replace(regexp_extract(cell, '^"([^"]*(?:""[^"]*)*)"', 1), '""', '"') || regexp_extract(cell, '^"[^"]*(?:""[^"]*)*"((?s).*)$', 1) ELSE replace(substr(cell, 2), '""', '"') END, chr(10) || ' ') AS cell FROM c),
k AS (SELECT * FROM (SELECT doc_id, r, list(cell ORDER BY pos) AS cells FROM u GROUP BY doc_id, r) WHERE len(cells) >= 4),
w AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY r) - 1 AS row, cells[1] AS category, cells[2] AS value, cells[3] AS status, cells[4] AS detail, list_transform(string_split(cells[4], '|'), lambda x: trim(x, chr(10) || ' ')) AS parts FROM k),
x AS (SELECT *, coalesce(regexp_extract(list_filter(parts, lambda p: starts_with(lower(p), 'rank:') AND regexp_matches(p, '\d'))[-1], '(\d+)', 1)::INT, 1) AS rank, coalesce(regexp_extract(list_filter(parts, lambda p: starts_with(lower(p), 'dasar hukum:'))[-1], '(?s)^[^:]*:(.*)$', 1), '') AS b0, regexp_extract(list_filter(parts, lambda p: starts_with(lower(p), 'alasan:'))[-1], '(?s)^[^:]*:(.*)$', 1) AS r0 FROM w),
z AS (SELECT * EXCLUDE (b0, r0), trim(b0, chr(10) || ' ') AS basis, coalesce(trim(r0, chr(10) || ' '), detail) AS reason FROM x)'''


@query("x3_answer_rows", _ANSWERS + " SELECT doc_id, row::INT AS row, category, value, status, md5(detail) AS detail, rank, md5(basis) AS basis, md5(reason) AS reason FROM z")
def x3(spark, d):
    rows = A.answer_rows(_raw_answers(spark, d), "doc_id")
    return rows.select("doc_id", "row", "category", "value", "status", *[F.md5(c).alias(c) for c in ("detail",)], "rank", F.md5("basis").alias("basis"), F.md5("reason").alias("reason"))


@query("x3_parsed_answers", _ANSWERS + r""", s AS (SELECT doc_id, arg_max(detail, row) FILTER (category = 'ringkasan_profil') AS summary, arg_max(detail, row) FILTER (category = 'rekomendasi_teknis_bansos') AS technical,
 string_agg(rank || '|' || value || '|' || status || '|' || basis || '|' || reason, ';' ORDER BY row) FILTER (category = 'rekomendasi') AS recommended,
 string_agg(value || '|' || status || '|' || CASE WHEN starts_with(lower(detail), 'alasan:') THEN trim(regexp_extract(detail, '(?s)^[^:]*:(.*)$', 1), chr(10) || ' ') ELSE detail END, ';' ORDER BY row) FILTER (category = 'program_tidak_sesuai') AS unsuitable FROM z JOIN l USING (doc_id) WHERE tabular GROUP BY doc_id),
f AS (SELECT l.doc_id, coalesce(summary, '') AS summary, technical, coalesce(recommended, '') AS recommended, coalesce(unsuitable, '') AS unsuitable, coalesce(summary, '') <> '' OR recommended IS NOT NULL OR unsuitable IS NOT NULL AS filled, trim(regexp_replace(raw, '```(?:json)?\s*|`+\s*\z', '', 'g'), chr(10) || ' ') AS body FROM l LEFT JOIN s USING (doc_id)),
j AS (SELECT *, CASE WHEN filled THEN NULL WHEN json_valid(body) THEN body WHEN json_valid(regexp_extract(body, '(?s)(\{.*\})', 1)) THEN regexp_extract(body, '(?s)(\{.*\})', 1) END AS json FROM f)
SELECT doc_id, CASE WHEN filled THEN md5(summary) END AS summary, CASE WHEN filled AND lower(technical) NOT IN ('', 'null', '-') THEN technical END AS technical, CASE WHEN filled THEN md5(recommended) END AS recommended, CASE WHEN filled THEN md5(unsuitable) END AS unsuitable, json, NOT filled AND json IS NULL AS parse_error FROM j""")
def x3_parsed(spark, d):
    joined = lambda c, f: F.md5(F.array_join(F.transform(c, f), ";"))
    p = A.parsed_answers(_raw_answers(spark, d), "doc_id")
    return p.select(
        "doc_id", F.md5("summary").alias("summary"), "technical", joined("recommended", lambda r: F.concat_ws("|", r["rank"].cast("string"), r["program"], r["status"], r["basis"], r["reason"])).alias("recommended"),
        joined("unsuitable", lambda r: F.concat_ws("|", r["program"], r["status"], r["reason"])).alias("unsuitable"), "json", "parse_error",
    )


@query("x4_json_block", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN props END AS json FROM events")
def x4(spark, d):
    raw = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("answer: "), "props", F.lit(" end"))).otherwise("no json {")
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", A.json_block(raw).alias("json"))


@query("x5_clean_answer", "SELECT doc_id, '### ASPD - STATUS: ELIGIBLE' || chr(10) || lang AS answer FROM documents")
def x5(spark, d):
    one = F.concat(F.lit("### ASPD - STATUS: ELIGIBLE\n"), "lang")
    raw = F.concat(one, F.lit("\n### aspd : STATUS: TIDAK ELIGIBLE\nagain\n## Bantuan Lain\nmore"))
    return chunks(spark, d).select("doc_id", A.clean_answer(raw).alias("answer"))


@query("x6_program_alias", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'KIP KPM Jawara' WHEN 1 THEN 'PKH Plus' END AS program FROM documents")
def x6(spark, d):
    t = F.when(F.col("doc_id") % 3 == 0, "Rank 1: KIP  KPM Jawara").when(F.col("doc_id") % 3 == 1, "pkh_plus").otherwise("lain")
    return chunks(spark, d).select("doc_id", X.program_name(t).alias("program"))


@query("x8_flat_spec", "SELECT doc_id, 'lang: ' || lang || '; source: ' || source AS spec FROM documents")
def x8(spark, d):
    return chunks(spark, d).select("doc_id", A.flat_spec(F.create_map(F.lit("source"), "source", F.lit("lang"), "lang")).alias("spec"))


@query("x9_chat_content", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source END AS content FROM documents")
def x9(spark, d):
    said = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("source").alias("content")).alias("message"))).alias("choices")))
    return chunks(spark, d).select("doc_id", A.chat_content(F.when(F.col("doc_id") % 2 == 0, said).otherwise('{"choices": []}')).alias("content"))


@query("h1_noise_lines", "SELECT doc_id, doc_id % 2 = 0 AS noise FROM documents")
def h1(spark, d):
    return chunks(spark, d).select("doc_id", X.is_noise_line(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("- "), F.col("doc_id"), F.lit(" -"))).otherwise("isi pasal")).alias("noise"))


@query("h2_embedded_ordinals", "SELECT doc_id, [lang || '.', 'KEDUA : ' || source] AS lines FROM documents")
def h2(spark, d):
    return chunks(spark, d).select("doc_id", A.embedded_ordinals(F.concat("lang", F.lit(". KEDUA : "), "source")).alias("lines"))


def _legal(spark, d):
    i = F.col("doc_id")
    line = F.when(i % 6 == 0, F.concat(F.lit("BAB IV "), "source")).when(i % 6 == 1, F.concat(F.lit("Pasal "), i, F.lit("."))).when(i % 6 == 2, F.concat(F.lit("("), i, F.lit(") isi."))).when(i % 6 == 3, "Pasal KEDUA BELAS : isi").when(i % 6 == 4, "a. isi").otherwise("Isi.")
    return chunks(spark, d).select(F.col("source").alias("document"), i.alias("line_no"), F.lit(1).cast("long").alias("page"), line.alias("line"))


_L = "WITH l AS (SELECT source AS document, doc_id AS line_no, doc_id % 6 AS k FROM documents)"


@query("h3_line_class", _L + " SELECT line_no, ['bab', 'pasal', 'ayat', 'diktum', 'huruf', 'none'][k + 1] AS level, CASE k WHEN 0 THEN 'BAB IV' WHEN 1 THEN 'Pasal ' || line_no WHEN 2 THEN line_no::VARCHAR WHEN 3 THEN 'Diktum KEDUA BELAS' WHEN 4 THEN 'a' ELSE '' END AS label FROM l")
def h3(spark, d):
    return _legal(spark, d).select("line_no", X.line_class(F.col("line")).alias("c")).select("line_no", "c.level", "c.label")


@query("h4_hierarchy_fill", _L + """, b AS (SELECT *, count_if(k = 0) OVER (PARTITION BY document ORDER BY line_no) AS b FROM l), a AS (SELECT *, count_if(k IN (1, 3)) OVER (PARTITION BY document, b ORDER BY line_no) AS a FROM b)
SELECT document, line_no, CASE WHEN b > 0 THEN 'BAB IV' END AS chapter, CASE WHEN a > 0 THEN last_value(CASE k WHEN 1 THEN 'Pasal ' || line_no WHEN 3 THEN 'Diktum KEDUA BELAS' END IGNORE NULLS) OVER (PARTITION BY document, b ORDER BY line_no) END AS article, last_value(CASE WHEN k = 2 THEN line_no::VARCHAR END IGNORE NULLS) OVER (PARTITION BY document, b, a ORDER BY line_no) AS clause FROM a""")
def h4(spark, d):
    return A.hierarchy_fill(_legal(spark, d), "document", "line_no").select("document", "line_no", "chapter", "article", "clause")


@query("h4_hierarchy_units")
def h4b(spark, d):
    return A.hierarchy(_legal(spark, d))


@query("h4_document_units", """WITH d AS (SELECT doc_id, doc_id % 3 AS k, coalesce(source, '-') AS s, 'BAB II – Hak dan ' || upper(substr(coalesce(lang, 'umum'), 1, 1)) || lower(substr(coalesce(lang, 'umum'), 2)) AS chapter FROM documents), u AS (
SELECT *, 1 AS row, 1 AS page, '1' AS article, '' AS clause, s || ' wajib.' AS text FROM d
UNION ALL SELECT *, 2, 1, '1', '2', 'Keluarga Penerima Manfaat (KPM) isi dua.' FROM d
UNION ALL SELECT *, 3, 2, 'KESATU', '', 'mulai.' FROM d
UNION ALL SELECT *, 4, 2, 'KEDUA', '', 'isi ' || s || '.' || CASE WHEN k = 2 THEN ' (1) tetap akhir kata' ELSE '' END FROM d
UNION ALL SELECT *, 5, 2, '9', '', 'akhir kata' FROM d WHERE k = 1)
SELECT doc_id::VARCHAR AS document, row, page::BIGINT AS page, chapter, article, clause, '[' || doc_id || ' | Bab ' || chapter || ' | Pasal/Diktum ' || article || CASE WHEN clause <> '' THEN ' | Ayat ' || clause ELSE '' END || '] ' || text AS content FROM u""")
def h4c(spark, d):
    k, source, lang = F.col("doc_id") % 3, F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("umum"))
    last = F.when(k == 0, "Ditetapkan di Surabaya").when(k == 1, "Pasal 9").otherwise("(1) tetap")
    lines = [
        (1, F.lit("BAB II")), (1, F.concat(F.lit("HAK DAN "), F.upper(lang))), (1, F.lit("Pasal 1")), (1, F.concat(source, F.lit("  wajib."))), (1, F.lit("(2) KPM isi . . . dua.")),
        (2, F.concat(F.lit("Pasal KESATU : mulai. Diktum KEDUA: isi "), source, F.lit("."))), (2, last), (2, F.lit("akhir kata")),
    ]
    each = F.array(*[F.struct(F.lit(p).cast("long").alias("page"), F.lit(i).alias("line_no"), x.alias("line")) for i, (p, x) in enumerate(lines)])
    rows = chunks(spark, d).select(F.col("doc_id").cast("string").alias("document"), F.inline(each))
    return A.document_units(rows).select("document", "row", "page", "chapter", "article", "clause", "content")


@query("h5_flush", "SELECT doc_id, source || ' isi' AS text FROM documents")
def h5(spark, d):
    return chunks(spark, d).select("doc_id", A.flushed(F.concat("source", F.lit(" . . . isi.  Ditetapkan di Surabaya tanggal"))).alias("text"))


@query("h6_context_path", "SELECT doc_id, 'Bab ' || lang || CASE WHEN doc_id % 2 = 0 THEN ' | Ayat 3' ELSE '' END AS path FROM documents")
def h6(spark, d):
    return chunks(spark, d).select("doc_id", X.context_path(F.col("lang"), F.lit("-"), F.when(F.col("doc_id") % 2 == 0, "3")).alias("path"))


@query("h9_chapter_title", "SELECT doc_id, 'BAB II – Hak dan ' || upper(substr(lang, 1, 1)) || substr(lang, 2) AS title FROM documents")
def h9(spark, d):
    return chunks(spark, d).select("doc_id", A.chapter_title(F.concat(F.lit("BAB II - HAK DAN "), F.upper("lang"))).alias("title"))


@query("h10_category", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Juknis (Petunjuk Teknis & SOP)' WHEN 1 THEN 'Pedoman Program (Rencana Kerja & Aksi)' WHEN 2 THEN 'Data dan Laporan Analisis' ELSE 'Regulasi (Aturan Hukum & Payung Kebijakan)' END AS category FROM documents")
def h10(spark, d):
    k = F.col("doc_id") % 4
    return chunks(spark, d).select("doc_id", X.category(F.when(k == 0, "JUKNIS 1").when(k == 1, "transaksi").when(k == 2, "Laporan").otherwise("Undang")).alias("category"))


@query("e1_expected_statuses", "SELECT doc_id AS case_id, 'A' AS program, CASE WHEN doc_id % 2 = 0 THEN 'tidak_eligible' ELSE 'eligible' END AS status FROM documents UNION ALL SELECT doc_id, 'B', 'mungkin_eligible' FROM documents")
def e1(spark, d):
    again = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("A"))).otherwise(F.array().cast("array<string>"))
    m = F.create_map(F.lit("eligible"), F.array(F.lit("A")), F.lit("mungkin_eligible"), F.array(F.lit("B")), F.lit("tidak_eligible"), again)
    return A.expected_statuses(chunks(spark, d).select(F.col("doc_id").alias("case_id"), m.alias("programs")))


def _answers(spark, d):
    k = F.col("doc_id") % 3
    said = F.when(k == 0, "ELIGIBLE").when(k == 1, "MUNGKIN  ELIGIBLE").otherwise("NON-ELIGIBLE")
    text = F.concat(F.lit("## Rank 1: ASPD — STATUS: "), said, F.lit("\nSumber "), "source", F.lit(" Hal. 13, 15 - 17. Bantuan Rp 500.000\n### PKH Plus: STATUS: ELIGIBLE\n"), F.when(k == 2, "Catatan untuk petugas").otherwise("ok"))
    return chunks(spark, d).select(F.col("doc_id").alias("case_id"), "source", text.alias("answer"))


_A = "WITH a AS (SELECT doc_id AS case_id, source, doc_id % 3 AS k FROM documents)"


@query("e2_status_sections", _A + " SELECT case_id, 'Rank 1: ASPD' AS title, ['eligible', 'mungkin eligible', 'non-eligible'][k + 1] AS status FROM a UNION ALL SELECT case_id, 'PKH Plus', 'eligible' FROM a")
def e2(spark, d):
    return _answers(spark, d).select("case_id", F.explode(A.status_sections(F.col("answer"))).alias("x")).select("case_id", "x.title", "x.status")


@query("e3_window_status", "SELECT doc_id, ['tidak_eligible', 'mungkin_eligible', 'eligible', 'unknown'][doc_id % 4 + 1] AS status FROM documents")
def e3(spark, d):
    k = F.col("doc_id") % 4
    return chunks(spark, d).select("doc_id", X.window_status(F.when(k == 0, "tidak memenuhi, eligible").when(k == 1, "perlu verifikasi").when(k == 2, "layak").otherwise("-")).alias("status"))


@query("e4_detected_status", _A + " SELECT case_id, CASE WHEN k = 2 THEN 'tidak_eligible' WHEN k = 1 THEN 'mungkin_eligible' ELSE 'eligible' END AS status FROM a")
def e4(spark, d):
    return _answers(spark, d).select("case_id", A.detected_status(X.evaluator_text(F.col("answer")), ["aspd", "asistensi sosial"]).alias("status"))


@query("e5_page_reference", _A + " SELECT case_id, (case_id % 20) IN (13, 15, 16, 17) AS cited FROM a")
def e5(spark, d):
    return _answers(spark, d).select("case_id", X.cites_page(X.evaluator_text(F.col("answer")), F.col("case_id") % 20).alias("cited"))


@query("e6_evidence_score", _A + " SELECT case_id, ((source = 'src1')::INT + 1) / 2.0::DOUBLE AS score FROM a")
def e6(spark, d):
    t = X.evaluator_text(F.col("answer"))
    needs = [F.contains(t, F.lit("src1 ")) & X.cites_page(t, F.lit(13)), X.cites_page(t, F.lit(16))]
    return _answers(spark, d).select("case_id", (sum((n.cast("int") for n in needs), F.lit(0)) / len(needs)).alias("score"))


#: For each program a form of section by a digit of doc_id: a heading that its body contradicts, a plain
#: heading with a decision, one with a phrase, none, and a mention without a heading.
_FORMS = ["### Rank 1: {} — STATUS: ELIGIBLE\nCatatan: tidak memenuhi syarat.\n", "## {}\n**Keputusan: Mungkin Eligible**, tidak sesuai\n", "## Program {}\nPemohon tidak memenuhi syarat.\n", "", "Program {} perlu verifikasi lapangan.\n"]


def _headed(spark, d):
    space = F.concat(F.lit("\n## Lain\n"), F.repeat(F.lit("kata "), F.lit(120)), F.lit("\n"))
    forms = [F.array(*[F.lit(f.format(name)) for f in _FORMS]) for name in ("ASPD", "PKH Plus")]
    text = F.concat(F.get(forms[0], (F.col("doc_id") % 5).cast("int")), space, F.get(forms[1], (F.floor(F.col("doc_id") / 5) % 5).cast("int")), space)
    return chunks(spark, d).select(F.col("doc_id").alias("case_id"), text.alias("answer"))


@query(
    "e4_program_statuses",
    "WITH p AS (SELECT doc_id, unnest([{'n': 'ASPD', 'f': doc_id % 5}, {'n': 'PKH Plus', 'f': doc_id // 5 % 5}]) AS x FROM documents)"
    " SELECT doc_id AS case_id, x.n AS program, ['eligible', 'mungkin_eligible', 'tidak_eligible', 'missing', 'mungkin_eligible'][x.f + 1] AS status, x.f < 3 AS has_section FROM p",
)
def e4_all(spark, d):
    return A.program_statuses(_headed(spark, d)).filter(F.col("program").isin("ASPD", "PKH Plus")).select("case_id", "program", "status", F.col("section").isNotNull().alias("has_section"))


@query(
    "e6_evidence_by_needs",
    "WITH n AS (SELECT doc_id, unnest([{'s': source, 'p': doc_id % 20}, {'s': 'src1', 'p': 16}, {'s': 'SRC  2', 'p': 13}]) AS x, source FROM documents WHERE doc_id % 4 > 0),"
    " m AS (SELECT doc_id, avg((contains('sumber ' || source || ' hal.', lower(x.s)) AND x.p IN (13, 15, 16, 17))::INT) AS share FROM n GROUP BY doc_id)"
    " SELECT d.doc_id AS case_id, coalesce(share, 1.0)::DOUBLE AS score FROM documents d LEFT JOIN m USING (doc_id)",
)
def e6_needs(spark, d):
    answers = _answers(spark, d)
    def need(s, p):
        return F.struct(s.alias("source_contains"), p.cast("int").alias("page_number"))

    needs = F.array(need(F.col("source"), F.col("case_id") % 20), need(F.lit("src1"), F.lit(16)), need(F.lit("SRC  2"), F.lit(13)))
    needs = answers.filter("case_id % 4 > 0").select("case_id", F.explode(needs).alias("x")).select("case_id", "x.*")
    return A.evidence_score(answers, needs)


@query("e7_contract_score", _A + " SELECT case_id, round((2 + 1 + (k <> 2)::INT) / 5.0::DOUBLE, 6) AS contract_score FROM a")
def e7(spark, d):
    a = _answers(spark, d)
    heads = a.select("case_id", F.explode(A.status_sections(F.col("answer"))).alias("x")).select("case_id", X.program_name(F.col("x.title")).alias("program"))
    expected = a.select("case_id", F.explode(F.array(*map(F.lit, ("ASPD", "PKH Plus", "KIP KPM Jawara")))).alias("program"))
    return A.contract_score(heads, expected, a).withColumn("contract_score", F.round("contract_score", 6))


def _scored_answers(spark, d):
    """Answers with a section for each of two programs, of varying status, amounts and denials, over whole texts."""
    i = F.col("doc_id")
    body = lambda n: _pick(n, "bantuan Rp 500.000 dan Rp 250.000", "Rp 500.000", "Rp 1.000 lain", "nominal  tidak tersebut", "Rp 500.000, nominal tidak disebut", "-", "Rp 250.000 Rp 500.000 Rp 9")
    status = lambda n: _pick(n, "ELIGIBLE", "TIDAK ELIGIBLE", "MUNGKIN ELIGIBLE")
    half = F.floor(i / 3)
    answer = F.concat(F.col("text"), F.lit("\n### PKH Plus — STATUS: "), status(i), F.lit("\n"), body(i), F.lit("\n"), F.when(i % 5 != 0, F.concat(F.lit("### ASPD - STATUS: "), status(half), F.lit("\n"), body(half), F.lit("\n"))).otherwise(""))
    return chunks(spark, d).select(i.alias("case_id"), answer.alias("answer"))


@query("e8_nominal_score", r"""WITH b AS (SELECT doc_id AS case_id, ['bantuan Rp 500.000 dan Rp 250.000', 'Rp 500.000', 'Rp 1.000 lain', 'nominal  tidak tersebut', 'Rp 500.000, nominal tidak disebut', '-', 'Rp 250.000 Rp 500.000 Rp 9'] AS o, ['ELIGIBLE', 'TIDAK ELIGIBLE', 'MUNGKIN ELIGIBLE'] AS st, doc_id // 3 AS h, text FROM documents),
a AS (SELECT case_id, concat(text, chr(10), '### PKH Plus — STATUS: ', st[case_id % 3 + 1], chr(10), o[case_id % 7 + 1], chr(10), CASE WHEN case_id % 5 <> 0 THEN concat('### ASPD - STATUS: ', st[h % 3 + 1], chr(10), o[h % 7 + 1], chr(10)) ELSE '' END) AS answer FROM b),
s AS (SELECT case_id, unnest(['PKH Plus', 'ASPD']) AS program, unnest([regexp_extract(answer, '(?s)(### PKH Plus .*?)(?:### ASPD|\z)', 1), regexp_extract(answer, '(?s)(### ASPD - STATUS.*)', 1)]) AS section FROM a),
f AS (SELECT case_id, program, list_distinct(list_transform(regexp_extract_all(section, '(?i)\bRp\.?\s*([0-9][0-9.,\s]*)(?:,-|,00)?', 1), lambda x: regexp_replace(x, '\D', '', 'g'))) AS found, CASE program WHEN 'PKH Plus' THEN ['250000', '500000'] ELSE [] END::VARCHAR[] AS allowed, regexp_matches(lower(section), 'nominal\s+tidak\s+(tersebut|disebut|ditemukan)') AS denied
 FROM s WHERE regexp_matches(section, 'STATUS: (ELIGIBLE|MUNGKIN)')),
g AS (SELECT *, list_filter(found, lambda x: NOT list_contains(allowed, x)) AS extra, list_filter(allowed, lambda x: NOT list_contains(found, x)) AS lacking FROM f),
r AS (SELECT case_id, avg(CASE WHEN len(extra) > 0 THEN 0 WHEN len(allowed) = 0 THEN 1 WHEN denied THEN 0 ELSE 1 - len(lacking)::DOUBLE / len(allowed) END) AS score, count(*) AS checks,
 string_agg(array_to_string(list_concat(list_transform(list_sort(extra), lambda x: 'nominal:' || program || ':unsupported_' || x), list_transform(list_sort(lacking), lambda x: 'nominal:' || program || ':missing_' || x), CASE WHEN denied AND len(allowed) > 0 THEN ['nominal:' || program || ':contradiction'] ELSE [] END), ' '), ' ' ORDER BY program) AS failed FROM g GROUP BY case_id)
SELECT a.case_id, coalesce(score, 1)::DOUBLE AS score, coalesce(checks, 0) AS checks, regexp_replace(trim(coalesce(failed, '')), ' +', ' ', 'g') AS failed FROM a LEFT JOIN r USING (case_id)""")
def e8(spark, d):
    catalog = spark.createDataFrame([("PKH Plus", "500000"), ("PKH Plus", "250000")], "program string, amount string")
    scores = A.nominal_scores(_scored_answers(spark, d), catalog, {"PKH Plus": ["pkh plus"], "ASPD": ["aspd"]})
    return scores.withColumn("failed", F.array_join("failed", " "))


@query("e9_overall_score", "SELECT doc_id, round(0.40 * q + 0.30 * (1 - t) + 0.20 * 1 + 0.10 * q, 6)::DOUBLE AS score FROM (SELECT doc_id, quality AS q, toxic AS t FROM labels)")
def e9(spark, d):
    return spark.read.parquet(f"{d}/labels.parquet").select("doc_id", F.round(A.overall(F.col("quality"), 1 - F.col("toxic"), F.lit(1), F.col("quality")), 6).alias("score"))


@query("e10_selected_cases", "SELECT doc_id AS case_id FROM documents WHERE doc_id IN (1, 5, 9, 12) ORDER BY doc_id LIMIT 3")
def e10(spark, d):
    return A.selected_cases(chunks(spark, d).select(F.col("doc_id").alias("case_id")), [1, 5, 9, 12], 3)


@query("e13_canonical_status", "SELECT doc_id, ['eligible', 'tidak_eligible', 'unknown'][doc_id % 3 + 1] AS status FROM documents")
def e13(spark, d):
    k = F.col("doc_id") % 3
    return chunks(spark, d).select("doc_id", X.canonical_status(F.when(k == 0, "ELIGIBLE").when(k == 1, "Non_Eligible").otherwise("?")).alias("status"))


@query("k3_json_report", "SELECT lang, '{\"lang\":\"' || lang || '\",\"n\":' || count(*) || '}' AS json FROM documents GROUP BY lang")
def k3(spark, d):
    n = chunks(spark, d).groupBy("lang").agg(F.count("*").alias("n"))
    return n.select("lang", F.to_json(F.struct("lang", "n")).alias("json"))
