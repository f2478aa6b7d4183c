"""Retrieval, payload and rule queries over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import nearest as N
from ..operators import retrieval as R
from ..operators import rules as G
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


def _points(spark, d):
    types = F.filter(F.array(F.when(F.col("vec_id") % 3 == 0, "nominal_bantuan"), F.when(F.col("vec_id") % 4 == 0, "lampiran_formulir")), lambda x: x.isNotNull())
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding", F.concat(F.lit("s"), "label").alias("source"), (F.col("vec_id") % 9).alias("page"), types.alias("types"), F.concat(F.lit("t"), (F.col("vec_id") % 50)).alias("text"))


def _queries(spark, d):
    """The stated query set: every vector whose id is divisible by 50."""
    return spark.read.parquet(f"{d}/embeddings.parquet").filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


def _hits(spark, d, k=8, threshold=0.1, where=None):
    return R.top_k(_points(spark, d), _queries(spark, d), k, threshold, where)


_P = """WITH p AS (SELECT vec_id, embedding::DOUBLE[] AS e, 's' || label AS source, vec_id % 9 AS page, 't' || (vec_id % 50) AS text, list_filter([CASE WHEN vec_id % 3 = 0 THEN 'nominal_bantuan' END, CASE WHEN vec_id % 4 = 0 THEN 'lampiran_formulir' END], lambda x: x IS NOT NULL) AS types FROM embeddings),
q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 50 = 0), m AS (SELECT query_id, p.* EXCLUDE (e), list_cosine_similarity(e, q) AS score FROM p, q),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM m WHERE score >= 0.1 QUALIFY rank <= 8)"""


def _r(df):
    return df.withColumn("score", F.round("score", 6))


@query("r1_topk_cosine", _P + " SELECT query_id, vec_id, rank, round(score, 6) AS score FROM h WHERE query_id % 150 <> 0")
def r1(spark, d):
    """Every third query has a blank text, so no hits."""
    asked = _queries(spark, d).withColumn("query_text", F.when(F.col("query_id") % 150 != 0, F.concat(F.lit("query "), "query_id")).when(F.col("query_id") % 300 == 0, " \t\n"))
    return _r(R.top_k(_points(spark, d), asked, 8, 0.1)).select("query_id", "vec_id", "rank", "score")


@query("r2_topk_source_filter", _P + " SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM m WHERE source IN ('s1', 's2') AND score >= 0.1 QUALIFY rank <= 8")
def r2(spark, d):
    return _hits(spark, d, where=F.col("source").isin("s1", "s2")).select("query_id", "vec_id", "rank")


@query("r3_program_filter", "SELECT doc_id, CASE WHEN a = 0 AND b = 0 THEN NULL WHEN a > b THEN 'PKH Plus' ELSE 'ASPD' END AS program FROM (SELECT doc_id, doc_id % 3 AS a, doc_id % 4 AS b FROM documents)")
def r3(spark, d):
    t = F.concat(F.lit("Skor PKH Plus: "), F.col("doc_id") % 3, F.lit(".0 | skor ASPD : "), F.col("doc_id") % 4)
    return chunks(spark, d).select("doc_id", R.program_filter(t).alias("program"))


@query("r4_nominal_guarantee", _P + " SELECT query_id, source, vec_id FROM m WHERE list_contains(types, 'nominal_bantuan') AND score >= 0.1 QUALIFY row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, vec_id) = 1")
def r4(spark, d):
    return R.best_of_type(_points(spark, d), _queries(spark, d), "source", "types", "nominal_bantuan", 0.1).select("query_id", "source", "vec_id")


@query("r5_first_n_of_k", _P + " SELECT query_id, vec_id FROM h WHERE rank <= 3")
def r5(spark, d):
    return _hits(spark, d, k=max(8, 3)).filter("rank <= 3").select("query_id", "vec_id")


@query("r6_append_distinct", _P + ", b AS (SELECT query_id, vec_id, text, rank, 0 AS turn FROM h UNION ALL SELECT query_id, vec_id, text, rank, 1 FROM h WHERE list_contains(types, 'nominal_bantuan')) SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY turn, rank) AS place FROM (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY query_id, text ORDER BY turn, rank) = 1)")
def r6(spark, d):
    hits = _hits(spark, d)
    return R.append_distinct(hits, hits.filter(F.array_contains("types", "nominal_bantuan")), "text", "rank").select("query_id", "vec_id", "place")


@query("r7_multi_query_pool", _P + """, a AS (SELECT query_id AS profile, CASE WHEN query_id % 150 = 0 THEN '  ' WHEN query_id % 150 = 50 THEN 'shared 1' ELSE 'own ' || query_id END AS own FROM q),
t AS (SELECT profile, list_filter([own, 'shared 1', 'shared 2'], lambda x, i: trim(x) <> '' AND list_position([own, 'shared 1', 'shared 2'], x) = i) AS texts FROM a),
u AS (SELECT profile, unnest(texts) AS query_text, generate_subscripts(texts, 1) - 1 AS turn FROM t),
v AS (SELECT CASE vec_id WHEN 1 THEN 'shared 1' WHEN 2 THEN 'shared 2' ELSE 'own ' || vec_id END AS query_text, e AS q FROM p WHERE vec_id % 50 = 0 OR vec_id IN (1, 2)),
n AS (SELECT query_text, vec_id, text, list_cosine_similarity(e, q) AS score FROM v, p QUALIFY row_number() OVER (PARTITION BY query_text ORDER BY score DESC, vec_id) <= 12),
k AS (SELECT *, row_number() OVER (PARTITION BY query_text ORDER BY score DESC, vec_id) AS rank FROM n)
SELECT profile, text, vec_id, turn::INT AS turn, rank::INT AS rank FROM u JOIN k USING (query_text) QUALIFY row_number() OVER (PARTITION BY profile, text ORDER BY score DESC, turn, rank) = 1""")
def r7(spark, d):
    """Profiles ask up to three queries: their own (some blank, some like a shared one) and two shared."""
    points = _points(spark, d)
    i = F.col("query_id")
    profiles = _queries(spark, d).select(i.alias("profile"), F.when(i % 150 == 0, "  ").when(i % 150 == 50, "shared 1").otherwise(F.concat(F.lit("own "), i)).alias("own"))
    name = F.when(F.col("vec_id") == 1, "shared 1").when(F.col("vec_id") == 2, "shared 2").otherwise(F.concat(F.lit("own "), "vec_id"))
    vectors = points.filter("vec_id % 50 = 0 or vec_id in (1, 2)").select(name.alias("query_text"), F.col("embedding").alias("query_vector"))
    asked = N.profile_queries(profiles, F.col("own"), ["shared 1", "shared 2"])
    return N.pooled(points, asked, vectors, 12, "text").select("profile", "text", "vec_id", "turn", "rank")


@query("r8_rerank", _P + " SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY page DESC, vec_id) AS rank FROM (SELECT * EXCLUDE (rank) FROM h) QUALIFY rank <= 4")
def r8(spark, d):
    return R.rerank(_hits(spark, d).drop("rank"), F.col("page").cast("double"), 4, "vec_id").select("query_id", "vec_id", "rank")


@query("r9_final_noise_filter", _P + """, f AS (SELECT *, CASE WHEN len(types) > 0 THEN types[len(types)] ELSE 'lainnya' END AS primary_type, CASE WHEN vec_id % 5 = 0 THEN 'low' ELSE 'normal' END AS priority FROM h)
, a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM f WHERE NOT (list_contains(types, 'lampiran_formulir') AND primary_type = 'lampiran_formulir' AND NOT list_contains(types, 'nominal_bantuan')) AND NOT (priority = 'low' AND score < 0.25)) SELECT query_id, vec_id, place FROM a WHERE place <= 5 AND (score >= 0.25 OR place <= 2)""")
def r9(spark, d):
    hits = _hits(spark, d).withColumn("primary_type", F.when(F.size("types") > 0, F.element_at("types", -1)).otherwise("lainnya")).withColumn("priority", F.when(F.col("vec_id") % 5 == 0, "low").otherwise("normal"))
    return R.final_filter(hits, 0.25, 5, 2, [F.col("vec_id")]).select("query_id", "vec_id", "place")


@query("r10_result_shape", _P + " SELECT query_id, rank, CASE source WHEN 's1' THEN 'One' ELSE source END AS program, page::VARCHAR AS page, text AS preview FROM h")
def r10(spark, d):
    return R.shape(_hits(spark, d), {"s1": "One"}).drop("score")


@query("r11_coverage", _P + " SELECT query_id, count(DISTINCT source) AS sources, count(DISTINCT source) FILTER (source IN ('s1', 's2', 's3')) AS known_sources FROM h GROUP BY query_id")
def r11(spark, d):
    return R.coverage(_hits(spark, d), ["s1", "s2", "s3"])


@query("r12_citations", _P + ", o AS (SELECT query_id, source, page, min(rank) AS r FROM h GROUP BY ALL) SELECT query_id, source, source || ', Hal. ' || array_to_string(list_slice(list(page::VARCHAR ORDER BY r), 1, 3), ', ') AS citation FROM o GROUP BY query_id, source")
def r12(spark, d):
    return R.citations(_hits(spark, d), "rank")


@query("r13_retrieval_recorder", _P + " SELECT source, page, text, min(vec_id) AS vec_id FROM h GROUP BY ALL")
def r13(spark, d):
    return R.first_by(_hits(spark, d), [F.col("source"), F.col("page"), F.substring("text", 1, 160)], "vec_id").select("source", "page", "text", "vec_id")


@query("r14_per_program_retrieval", _P + """, w AS (SELECT *, list_position(['s7', 's1', 's4'], source) AS turn FROM p WHERE source IN ('s7', 's1', 's4')),
o AS (SELECT query_id, vec_id, text, turn, row_number() OVER (PARTITION BY query_id, source ORDER BY list_cosine_similarity(e, q) DESC, vec_id) AS rank FROM w, q QUALIFY rank <= 5),
g AS (SELECT w.vec_id, w.text, 4 AS turn, row_number() OVER (ORDER BY list_cosine_similarity(w.e, n.e) DESC, w.vec_id) AS rank FROM w, p n WHERE n.vec_id = 3 QUALIFY rank <= 5),
b AS (SELECT * FROM o UNION ALL SELECT query_id, g.* FROM q, g),
f AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY query_id, substr(text, 1, 100) ORDER BY turn, rank) = 1)
SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY turn, rank)::INT AS place FROM f""")
def r14(spark, d):
    points = _points(spark, d)
    general = points.filter("vec_id = 3").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return N.by_program(points, _queries(spark, d), general, 5, ["s7", "s1", "s4"], "text").select("query_id", "vec_id", "place")


@query("r3_filtered_by_program", _P + """, a AS (SELECT *, query_id // 50 AS n FROM q), b AS (SELECT *, CASE WHEN n % 4 = 0 THEN ['s2', 's5'] WHEN n % 3 = 0 AND n % 5 = 0 THEN NULL WHEN n % 3 > n % 5 THEN ['s1', 's2'] ELSE ['s3'] END AS allowed FROM a)
SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY list_cosine_similarity(e, q) DESC, vec_id)::INT AS rank FROM b, p WHERE allowed IS NULL OR list_contains(allowed, source) QUALIFY rank <= 4""")
def r3_filtered(spark, d):
    """Every fourth query has a source list; for the others the scores in their text name a program, or none."""
    n = F.floor(F.col("query_id") / 50)
    text = F.concat(F.lit("- Umur : 70\n- Skor PKH Plus : "), n % 3, F.lit(" | Skor ASPD : "), n % 5)
    sources = F.when(n % 4 == 0, F.array(F.lit("s2"), F.lit("s5")))
    allowed = N.allowed_sources(sources, text, R.program_filter(text), {"PKH Plus": ["s1", "s2"], "ASPD": ["s3"]})
    return N.nearest(_points(spark, d), _queries(spark, d).withColumn("allowed", allowed), 4, None, group="source").select("query_id", "vec_id", "rank")


@query("r15_unfiltered_search", _P + " SELECT query_id, vec_id, rank FROM (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM m) WHERE rank <= 3")
def r15(spark, d):
    return _hits(spark, d, k=3, threshold=None).select("query_id", "vec_id", "rank")


@query("r16_program_listing", "SELECT 's' || label AS source, count(*) AS points FROM embeddings GROUP BY label")
def r16(spark, d):
    return _points(spark, d).groupBy("source").agg(F.count("*").alias("points"))


def _turns(spark, d):
    return spark.read.parquet(f"{d}/conversations.parquet")


@query("p1_payload_last_user", "SELECT conv_id, trim(arg_max(text, turn), chr(10) || ' ') AS text FROM conversations WHERE role = 'user' GROUP BY conv_id")
def p1(spark, d):
    return G.last_user_text(_turns(spark, d))


@query("p2_payload_first_user", "SELECT conv_id, trim(arg_min(text, turn), chr(10) || ' ') AS text FROM conversations WHERE role = 'user' AND trim(text) <> '' GROUP BY conv_id")
def p2(spark, d):
    return G.first_user_text(_turns(spark, d))


@query("p3_unwrap_payload", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN 'u' || user_id ELSE props END AS text FROM events")
def p3(spark, d):
    k = F.col("event_id") % 3
    payload = F.when(k == 0, F.to_json(F.struct(F.concat(F.lit(" "), "event_type").alias("content")))).when(k == 1, F.to_json(F.struct(F.array(F.struct(F.lit("user").alias("role"), F.lit(" ").alias("content")), F.struct(F.lit("user").alias("role"), F.concat(F.lit("u"), "user_id").alias("content"))).alias("messages")))).otherwise(F.col("props"))
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", G.unwrap(payload).alias("text"))


@query("p4_chat_parts", "SELECT conv_id, trim(coalesce(arg_max(CASE WHEN role = 'user' THEN text END, CASE WHEN role = 'user' THEN turn END), ''), chr(10) || ' ') AS profile, '' AS nik FROM conversations GROUP BY conv_id")
def p4(spark, d):
    return G.chat_parts(_turns(spark, d)).select("conv_id", "profile", "nik")


@query("p5_citizen_number", "SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN NULL ELSE 'N' || doc_id END AS nik FROM documents")
def p5(spark, d):
    t = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("- NIK / No. KK : N"), "doc_id", F.lit("/77"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("nik: N"), "doc_id", F.lit(" x"))).otherwise("none")
    return chunks(spark, d).select("doc_id", X.citizen_number(t).alias("nik"))


def _profiles(spark, d, every: int = 4):
    """Profiles made from doc_id: text lines, or JSON for every fourth (0: none)."""
    i = F.col("doc_id")
    age, decile = (i % 90 + 5), (i % 8 + 1)
    status = F.when(i % 3 == 0, "aktif").when(i % 3 == 1, "Tidak Aktif").otherwise("-")
    ability = F.when(i % 2 == 0, "Banyak kesulitan").otherwise("Tidak mengalami kesulitan")
    lines = F.concat(F.lit("- Umur : "), age, F.lit(" tahun\n- Desil Nasional : "), decile, F.lit("\n- Status DTSEN : "), status, F.lit("\n- Berjalan : "), ability)
    json = F.to_json(F.struct(age.alias("umur"), decile.alias("desil_nasional"), status.alias("status_dtsen"), F.struct(ability.alias("jalan")).alias("disabilitas")))
    return chunks(spark, d).select(i.alias("profile_id"), (F.when(i % every == 0, json).otherwise(lines) if every else lines).alias("profile"))


_S = "WITH s AS (SELECT doc_id AS profile_id, (doc_id % 90 + 5)::INT AS age, (doc_id % 8 + 1)::INT AS decile, CASE doc_id % 3 WHEN 0 THEN 'aktif' WHEN 1 THEN 'Tidak Aktif' ELSE '-' END AS status, doc_id % 2 = 0 AS disability FROM documents)"


@query("p6_p7_profile_signals", _S + " SELECT profile_id, age, decile, status, disability FROM s")
def p7(spark, d):
    return _profiles(spark, d).select("profile_id", G.signals(F.col("profile")).alias("s")).select("profile_id", "s.age", "s.decile", "s.status", "s.disability")


@query("p8_severe_disability", "SELECT doc_id, doc_id % 2 = 0 AS severe FROM documents")
def p8(spark, d):
    return chunks(spark, d).select("doc_id", X.is_severe(F.when(F.col("doc_id") % 2 == 0, "Sama sekali tidak bisa").otherwise("tidak membutuhkan bantuan")).alias("severe"))


def _pick(n, *texts):
    return F.element_at(F.array(*map(F.lit, texts)), (F.pmod(n, F.lit(len(texts))) + 1).cast("int"))


def _mixed_profiles(spark, d):
    """Profiles as JSON, nested and flat, with empty and zero fields; as lines; and whole texts."""
    i = F.col("doc_id")
    n = lambda c: c.cast("string")
    age, name, hard = _pick(i, "0", "null", '"71"', "65", '"tua"', "72.5"), _pick(i, "Budi", "Ibu Siti", "Nibung"), _pick(i, "", "banyak kesulitan", "mandiri")
    nested = F.concat(
        F.lit('{"laporan_evaluasi": {"profil_warga": {"umur": '), age, F.lit(', "nama": "'), name, F.lit('", "hubungan_kepala_keluarga": "'), _pick(i, "Istri", "Anak"), F.lit('"}, "analisis": {"disabilitas_fungsi": "'), hard,
        F.lit('"}}, "parameter": {"desil_nasional": '), _pick(i, "0", "3", '"5"', "null"), F.lit(', "status_dtsekolah": "'), _pick(i, "DTSEN Aktif", "", "dtks lama"), F.lit('", "lokasi": "'), _pick(i, "", " Kec. Genteng, Surabaya "),
        F.lit('"}, "umur": '), n(i % 90), F.lit(', "desil_nasional": '), n(i % 11), F.lit("}"),
    )
    flat = F.concat(F.lit('{"umur": '), n(i % 80), F.lit(', "disabilitas": {"jalan": "'), _pick(i, "tidak bisa jalan", "bisa"), F.lit('", "lihat": null}, "nama": "'), name, F.lit('"}'), F.when(i % 13 == 0, "}").otherwise(""))
    lines = F.concat(F.lit("- Umur : "), n(i % 100), F.lit(" tahun | Desil Nasional : "), n(i % 9), F.lit("\n- "), _pick(i, "Status : terdaftar DTKS", "Status : DTSEN", "Alamat Kelurahan Ngagel, Kota Surabaya 5; x", "sama sekali tidak bisa"))
    return chunks(spark, d).select("doc_id", F.when(i % 4 == 0, nested).when(i % 4 == 1, flat).when(i % 4 == 2, lines).otherwise(F.col("text")).alias("profile"))


_MIXED = r"""WITH m AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN concat('{"laporan_evaluasi": {"profil_warga": {"umur": ', ['0', 'null', '"71"', '65', '"tua"', '72.5'][doc_id % 6 + 1], ', "nama": "', ['Budi', 'Ibu Siti', 'Nibung'][doc_id % 3 + 1], '", "hubungan_kepala_keluarga": "', ['Istri', 'Anak'][doc_id % 2 + 1], '"}, "analisis": {"disabilitas_fungsi": "', ['', 'banyak kesulitan', 'mandiri'][doc_id % 3 + 1],
 '"}}, "parameter": {"desil_nasional": ', ['0', '3', '"5"', 'null'][doc_id % 4 + 1], ', "status_dtsekolah": "', ['DTSEN Aktif', '', 'dtks lama'][doc_id % 3 + 1], '", "lokasi": "', ['', ' Kec. Genteng, Surabaya '][doc_id % 2 + 1], '"}, "umur": ', doc_id % 90, ', "desil_nasional": ', doc_id % 11, '}')
 WHEN 1 THEN concat('{"umur": ', doc_id % 80, ', "disabilitas": {"jalan": "', ['tidak bisa jalan', 'bisa'][doc_id % 2 + 1], '", "lihat": null}, "nama": "', ['Budi', 'Ibu Siti', 'Nibung'][doc_id % 3 + 1], '"}', CASE WHEN doc_id % 13 = 0 THEN '}' ELSE '' END)
 WHEN 2 THEN concat('- Umur : ', doc_id % 100, ' tahun | Desil Nasional : ', doc_id % 9, chr(10), '- ', ['Status : terdaftar DTKS', 'Status : DTSEN', 'Alamat Kelurahan Ngagel, Kota Surabaya 5; x', 'sama sekali tidak bisa'][doc_id % 4 + 1]) ELSE text END AS profile FROM documents),
j AS (SELECT *, CASE WHEN json_valid(profile) THEN profile::JSON END AS j FROM m),
f AS (SELECT *, list_filter([j->'$.laporan_evaluasi.profil_warga.umur', j->'$.umur'], lambda x: x IS NOT NULL AND x::VARCHAR NOT IN ('null', '0', '0.0', '""', 'false'))[1] AS age, list_filter([j->>'$.parameter.desil_nasional', j->>'$.desil_nasional'], lambda x: x IS NOT NULL AND x NOT IN ('0', ''))[1] AS decile,
 lower(coalesce(j->>'$.parameter.status_dtsekolah', '')) AS registry, lower(concat_ws(' ', coalesce(nullif(j->>'$.laporan_evaluasi.profil_warga.nama', ''), j->>'$.nama'), j->>'$.laporan_evaluasi.profil_warga.hubungan_kepala_keluarga')) AS names,
 lower(concat_ws(' ', j->>'$.disabilitas.jalan', j->>'$.laporan_evaluasi.analisis.disabilitas_fungsi')) AS hard, substr(trim(coalesce(j->>'$.parameter.lokasi', '')), 1, 80) AS place, lower(profile) AS low FROM j),
a AS (SELECT *, CASE WHEN j IS NULL THEN nullif(regexp_extract(low, '(\d+)\s*tahun', 1), '')::INT WHEN age::VARCHAR LIKE '"%' THEN TRY_CAST(age->>'$' AS INT) ELSE trunc(TRY_CAST(age::VARCHAR AS DOUBLE))::INT END AS years, CASE WHEN j IS NULL THEN low ELSE hard END AS hard_in, CASE WHEN j IS NULL THEN low ELSE names END AS names_in FROM f),
t AS (SELECT *, list_filter(['usia ' || years || ' tahun', CASE WHEN years >= 70 THEN 'lanjut usia 70 tahun ke atas' END, 'desil ' || CASE WHEN j IS NULL THEN nullif(regexp_extract(low, 'desil\s*(?:nasional)?\s*[:\-]?\s*(\d+)', 1), '') ELSE decile END,
 CASE WHEN j IS NULL AND regexp_matches(low, 'dtsen aktif|dtks aktif|terdaftar dtks|terdaftar dtsen') OR j IS NOT NULL AND contains(registry, 'aktif') THEN 'terdaftar DTSEN DTKS' WHEN regexp_matches(CASE WHEN j IS NULL THEN low ELSE registry END, 'dtsen|dtks') THEN 'DTSEN DTKS' END,
 CASE WHEN regexp_matches(hard_in, 'banyak kesulitan|beberapa kesulitan|tidak bisa|tidak mampu') THEN 'penyandang disabilitas' END, CASE WHEN regexp_matches(names_in, '\bperempuan\b|\bistri\b|\bibu\b') THEN 'perempuan' END,
 nullif(CASE WHEN j IS NULL THEN substr(trim(regexp_extract(profile, '(?i)(?:kec\.?|kecamatan|kelurahan|kabupaten|kota)\s+[\w\s,]+')), 1, 80) ELSE place END, '')], lambda x: x IS NOT NULL) AS parts FROM a)"""


@query("p9_retrieval_query", _MIXED + " SELECT doc_id, 'syarat kriteria sasaran penerima bantuan sosial' || CASE WHEN len(parts) > 0 THEN ': ' || array_to_string(parts, ' ') ELSE ' ' || trim(substr(profile, 1, 300), ' ' || chr(10)) END AS query FROM t")
def p9(spark, d):
    return _mixed_profiles(spark, d).select("doc_id", G.retrieval_query(F.col("profile")).alias("query"))


@query("p10_is_profile", "SELECT doc_id AS profile_id, doc_id % 2 = 0 AS is_profile FROM documents")
def p10(spark, d):
    t = F.when(F.col("profile_id") % 2 == 0, F.col("profile")).otherwise("syarat bantuan")
    return _profiles(spark, d).select("profile_id", G.is_profile(t).alias("is_profile"))


@query("p11_inferred_sources", _S + " SELECT profile_id, CASE WHEN disability AND age <= 60 THEN 1 ELSE 0 END + CASE WHEN age >= 70 AND decile <= 4 THEN 1 ELSE 0 END AS n FROM s")
def p11(spark, d):
    return _profiles(spark, d).select("profile_id", F.coalesce(F.size(G.inferred_sources(G.signals(F.col("profile")))), F.lit(0)).alias("n")).withColumn("n", F.greatest("n", F.lit(0)))


_AID = (chr(34) + "-" + chr(34), '" Tidak ADA "', '"PKH"', "[]", '["x"]', "null", '""', "7", "{}", '"belum\\u0020menerima"')


def _aided(spark, d):
    """Profiles whose field of existing aid stands at several depths, in objects and lists, behind nulls, or in a line."""
    i = F.col("doc_id")
    a, b = _pick(i, *_AID), _pick(F.floor(i / 7), *_AID)
    text = F.to_json(F.struct("text"))
    t = (
        F.when(i % 6 == 0, F.concat(F.lit('{"a": {"Bansos": '), a, F.lit(', "x": {"bansos": "-"}}, "b": [1, {"bantuan_sosial": '), b, F.lit("}]}")))
        .when(i % 6 == 1, F.concat(F.lit('{"p": [{"n": "bansos"}, {" BANSOS ": '), a, F.lit('}], "bansos": '), b, F.lit("}")))
        .when(i % 6 == 2, F.concat(F.lit('[{"q": '), text, F.lit('}, {"bantuan sosial": '), a, F.lit("}]")))
        .when(i % 6 == 3, F.concat(F.lit("Nama: x\n  - Bansos : "), F.regexp_replace(a, '"', "")))
        .when(i % 6 == 4, F.concat(F.lit('{"bansos": '), a, F.lit("}}\nbansos: -")))
        .otherwise(text)
    )
    return chunks(spark, d).select("doc_id", t.alias("profile"))


_AIDS = "[" + ", ".join("'" + x + "'" for x in _AID) + "]"


@query("p14_no_existing_aid", rf"""WITH p AS (SELECT doc_id, {_AIDS}[doc_id % 10 + 1] AS a, {_AIDS}[doc_id // 7 % 10 + 1] AS b, json_object('text', text)::VARCHAR AS t FROM documents),
m AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '{{"a": {{"Bansos": ' || a || ', "x": {{"bansos": "-"}}}}, "b": [1, {{"bantuan_sosial": ' || b || '}}]}}' WHEN 1 THEN '{{"p": [{{"n": "bansos"}}, {{" BANSOS ": ' || a || '}}], "bansos": ' || b || '}}'
 WHEN 2 THEN '[{{"q": ' || t || '}}, {{"bantuan sosial": ' || a || '}}]' WHEN 3 THEN 'Nama: x' || chr(10) || '  - Bansos : ' || replace(a, '"', '') WHEN 4 THEN '{{"bansos": ' || a || '}}}}' || chr(10) || 'bansos: -' ELSE t END AS profile FROM p),
j AS (SELECT doc_id, profile, CASE WHEN json_valid(profile) THEN profile::JSON END AS j FROM m),
k AS (SELECT doc_id, x.id, x.path, x.type, x.value, x.atom FROM j, json_tree(j) x WHERE lower(trim(x.key)) IN ('bansos', 'bantuan_sosial', 'bantuan sosial') AND x.path NOT LIKE '%]' OR lower(trim(x.key)) IN ('bansos', 'bantuan_sosial', 'bantuan sosial')),
h AS (SELECT doc_id, arg_min(CASE WHEN type = 'VARCHAR' THEN lower(trim(value->>'$')) IN ('', '-', '[]', 'null', 'none', 'tidak ada', 'belum ada', 'belum menerima', 'belum mendapatkan', 'tidak menerima') ELSE type = 'ARRAY' AND json_array_length(value) = 0 END, id) AS none
 FROM k WHERE type <> 'NULL' AND NOT EXISTS (SELECT 1 FROM k n WHERE n.doc_id = k.doc_id AND n.type = 'NULL' AND n.id < k.id AND starts_with(k.path || '.', n.path || '.')) GROUP BY doc_id),
l AS (SELECT doc_id, regexp_matches(profile, '(?im)^\s*-?\s*bansos\s*:') AND lower(trim(regexp_extract(profile, '(?im)^\s*-?\s*bansos\s*:\s*([^\r\n]*)', 1))) IN ('', '-', '[]', 'null', 'none', 'tidak ada', 'belum ada', 'belum menerima', 'belum mendapatkan', 'tidak menerima') AS none FROM m)
SELECT l.doc_id, coalesce(h.none, l.none) AS none FROM l LEFT JOIN h USING (doc_id)""")
def p14(spark, d):
    return _aided(spark, d).select("doc_id", G.no_existing_aid(F.col("profile")).alias("none"))


@query("p15_key_points", _S + " SELECT profile_id, age >= 70 AS elderly FROM s")
def p15(spark, d):
    return _profiles(spark, d, 0).select("profile_id", G.key_points(F.col("profile"))["elderly"].alias("elderly"))


@query("p16_program_name", "SELECT source, CASE source WHEN 'src1' THEN 'PKH Plus (Lanjut Usia 70+)' WHEN 'src2' THEN 'Asistensi Sosial Penyandang Disabilitas (ASPD)' ELSE source END AS program FROM (SELECT DISTINCT source FROM documents)")
def p16(spark, d):
    raw = F.when(F.col("source") == "src1", "pkh PLUS 2026").when(F.col("source") == "src2", "Bantuan Disabilitas").otherwise(F.col("source"))
    return chunks(spark, d).select("source").distinct().select("source", X.program_label(raw).alias("program"))


@query("p17_spec_items", "SELECT doc_id, [lang, source] AS items FROM documents")
def p17(spark, d):
    return chunks(spark, d).select("doc_id", X.spec_items(F.concat("lang", F.lit(" ;,\n "), "source", F.lit(", "))).alias("items"))


_RULES = _S + """, r AS (SELECT profile_id, 'elderly' AS program, list_filter([CASE WHEN age < 70 THEN 'age below 70' END, CASE WHEN decile > 4 THEN 'decile above 4' END, CASE WHEN status = 'Tidak Aktif' THEN 'status inactive' END], lambda x: x IS NOT NULL) AS reasons FROM s
UNION ALL SELECT profile_id, 'disabled', list_filter([CASE WHEN age > 60 THEN 'age above 60' END, CASE WHEN decile > 5 THEN 'decile above 5' END, CASE WHEN NOT disability THEN 'no severe disability' END, CASE WHEN status = 'Tidak Aktif' THEN 'status inactive' END], lambda x: x IS NOT NULL) FROM s)"""


def _rules(spark, d):
    return G.hard_rules(_profiles(spark, d).select("profile_id", G.signals(F.col("profile")).alias("signals"))).withColumn("short", F.when(F.col("rule_order") == 0, "elderly").otherwise("disabled"))


@query("g1_eligibility_rules", _RULES + " SELECT profile_id, program, reasons, len(reasons) = 0 AS eligible FROM r")
def g1(spark, d):
    return _rules(spark, d).select("profile_id", F.col("short").alias("program"), "reasons", "eligible")


@query("g2_active_status", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS active FROM documents")
def g2(spark, d):
    s = F.when(F.col("doc_id") % 3 == 0, "DTSEN Aktif").when(F.col("doc_id") % 3 == 1, "NonAktif").otherwise(" ")
    return chunks(spark, d).select("doc_id", X.is_active_status(s).alias("active"))


@query("g3_enforce_rules", _RULES + ", e AS (SELECT *, len(reasons) = 0 AS eligible, profile_id % 2 = 0 AND program = 'disabled' AS said FROM r) SELECT profile_id, program, CASE WHEN eligible THEN 'recommended' ELSE 'rejected' END AS list, CASE WHEN eligible THEN row_number() OVER (PARTITION BY profile_id, eligible ORDER BY said DESC, program DESC) END AS rank FROM e")
def g3(spark, d):
    said = _profiles(spark, d).filter("profile_id % 2 = 0").select("profile_id", F.lit("recommended").alias("list"), F.lit("bansos ASPD").alias("program"), F.lit(1).alias("place"))
    short = F.when(F.col("program").startswith("PKH"), "elderly").otherwise("disabled")
    return G.enforce(said, _rules(spark, d)).select("profile_id", short.alias("program"), "list", "rank")


@query("g4_fallback", _S + " SELECT profile_id, age >= 70 AND decile <= 4 AND contains(lower(status), 'aktif') AS elderly, disability AND age <= 60 AND decile <= 5 AS disabled FROM s")
def g4(spark, d):
    return _profiles(spark, d).select("profile_id", G.fallback(G.signals(F.col("profile"))).alias("f")).select("profile_id", "f.elderly", "f.disabled")


@query("g4_fallback_answers", _S + """, f AS (SELECT *, age >= 70 AND decile <= 4 AND contains(lower(status), 'aktif') AS elderly, disability AND age <= 60 AND decile <= 5 AS disabled FROM s),
r AS (SELECT profile_id, 'PKH Plus (Lanjut Usia 70+)' AS program, elderly AS fits, CASE WHEN elderly THEN concat('Warga berusia ', age, ' tahun memenuhi syarat minimum lansia 70 tahun ke atas sesuai Juknis PKH Plus 2026 Pasal Sasaran Penerima. Desil nasional ', decile, ' masuk klaster prioritas 1–4 dan status DTSEN tercatat aktif.')
  ELSE concat('Tidak memenuhi kriteria PKH Plus: ', concat_ws('; ', CASE WHEN age < 70 THEN concat('usia warga ', age, ' tahun belum memenuhi syarat minimum 70 tahun yang ditetapkan Juknis PKH Plus 2026') END, CASE WHEN decile > 4 THEN concat('desil nasional ', decile, ' berada di luar klaster prioritas 1–4 PKH Plus') END, CASE WHEN NOT contains(lower(status), 'aktif') THEN 'status DTSEN tidak aktif atau tidak terdeteksi' END), '.') END AS reason FROM f
 UNION ALL SELECT profile_id, 'Asistensi Sosial Penyandang Disabilitas (ASPD)', disabled, CASE WHEN disabled THEN concat('Warga memiliki indikasi hambatan fungsi/disabilitas yang tercatat pada profil, usia ', age, ' tahun masuk rentang sasaran ASPD (hingga 60 tahun), dan desil nasional ', decile, ' masuk klaster prioritas sesuai Juklak ASPD 2026.')
  ELSE concat('Tidak memenuhi kriteria ASPD: ', concat_ws('; ', CASE WHEN NOT disability THEN 'tidak ditemukan indikasi hambatan fungsi/disabilitas pada profil warga (semua dimensi fungsional: ''Tidak mengalami kesulitan'')' END, CASE WHEN age > 60 THEN concat('usia warga ', age, ' tahun melebihi batas atas sasaran ASPD') END, CASE WHEN decile > 5 THEN concat('desil nasional ', decile, ' berada di luar klaster prioritas ASPD') END), '.') END FROM f)
SELECT profile_id, program, CASE WHEN fits THEN 'recommended' ELSE 'unsuitable' END AS list, CASE WHEN fits THEN 1 END AS rank, md5(reason) AS reason, bool_or(fits) OVER (PARTITION BY profile_id) AS planned FROM r""")
def g4_answers(spark, d):
    """The two programs exclude each other by age, so a recommended one is the first."""
    rows = G.fallback_answers(_profiles(spark, d))
    return rows.select("profile_id", "program", "list", "rank", F.md5("reason").alias("reason"), F.col("plan").isNotNull().alias("planned"))


@query("g5_upstream_flag", "SELECT doc_id, doc_id % 4 = 0 OR doc_id % 4 = 3 AS eligible FROM documents")
def g5(spark, d):
    k = F.col("doc_id") % 4
    return chunks(spark, d).select("doc_id", X.upstream_eligible(F.when(k == 0, "layak").when(k == 1, "Tidak layak").otherwise("x"), F.when(k == 3, 1)).alias("eligible"))


@query("g6_placeholders", "SELECT doc_id, doc_id % 2 = 0 AS unfilled FROM documents")
def g6(spark, d):
    return chunks(spark, d).select("doc_id", G.has_placeholder(F.array(F.lit("ok"), F.when(F.col("doc_id") % 2 == 0, "<Isi alasan>").otherwise("done")), ["<isi"]).alias("unfilled"))
