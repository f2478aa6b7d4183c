"""Hand-written cases at the boundaries of the rules, expected values from reading what they must do."""

import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from lumbung.functions import text as X
from lumbung.operators import answers as A
from lumbung.operators import chunking as C
from lumbung.operators import extras as E
from lumbung.operators import profile as P
from lumbung.operators import rules as G
from lumbung.operators.retrieval import program_filter, top_k
from lumbung.sources import jsonl as J
from lumbung.streaming.ingest import ingest_new


def values(spark, column, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.select(column(F.col("t")), "i").orderBy("i").collect()]


def test_normalisation(spark):
    assert values(spark, X.collapse, "  a \t b\n", "", "\x1cx") == ["a b", "", "x"]
    assert values(spark, X.content_hash, " A  b ") == [hashlib.sha256(b"a b").hexdigest()]
    assert values(spark, X.uuid5, "héllo", "") == [str(uuid.uuid5(uuid.NAMESPACE_DNS, t)) for t in ("héllo", "")]
    assert values(spark, X.expand_abbreviations, "PKH, XPKH dan KPM.") == ["Program Keluarga Harapan (PKH), XPKH dan Keluarga Penerima Manfaat (KPM)."]
    assert values(spark, X.evaluator_text, "A_b — C–d") == ["a b - c-d"]


def test_fences_and_titles(spark):
    assert values(spark, X.strip_fences, "```json\n{x}\n```", "**JUDUL**: T\n\n**KONTEN**:\nisi", "[JUDUL]: T\n[KONTEN]: isi") == ["{x}", "T\n\nisi", "T\nisi"]
    assert values(spark, X.clean_title, "## 12", " Tabel/Diagram ", "**Sasaran**", None, "iv") == ["", "", "Sasaran", "", ""]


def test_lengths(spark):
    signal = "desil " + "x" * 30
    assert values(spark, X.skip_subchunk, "x" * 19, "1" * 40, "x" * 79, "x" * 80, signal) == [True, True, True, False, False]
    flags = values(spark, lambda t: X.quality_flags(t, F.array(F.lit("lainnya"))), "x " * 109 + "y", ("x " * 110)[:219] + "y", "desil " + "kata " * 60)
    assert "pendek" in flags[0] and "pendek" not in flags[1] and flags[2] == ["tipe_tidak_terdeteksi"]


def test_keywords_and_classes(spark):
    assert values(spark, lambda t: X.keyword_hit(F.lower(t), "rab"), "Surabaya", "RAB 2026") == [False, True]
    assert values(spark, lambda t: X.keyword_hit(F.lower(t), "rp"), "Rp. 5", "harp") == [True, False]
    assert values(spark, X.classify, "Syarat penerima bantuan", "kata pengantar: penerima manfaat layak", "besaran bantuan", "surat dan dokumen", "surat dokumen berkas", "biaya dana", "x") == [
        ["kriteria_penerima"], ["pendahuluan_umum"], ["nominal_bantuan"], ["lainnya"], ["lampiran_formulir"], ["lainnya"], ["lainnya"]
    ]


def test_amounts(spark):
    assert values(spark, X.amounts, "Rp 500.000", "Rp. 2.000.000,-", "Rp 500.000,00", "Rp 500.000 4 tahap", "Rp x", "harp 5") == [["500000"], ["2000000"], ["50000000"], ["5000004"], [], []]
    assert values(spark, X.amount_display, "5000000", "12") == ["5.000.000", "12"]
    assert values(spark, X.is_aid_amount, "bantuan Rp 5.000", "bantuan, materai Rp 10.000", "harga Rp 5") == [True, False, False]
    assert values(spark, lambda t: F.to_json(X.decile_requirements(t)), "Desil 1 sampai dengan 4, desil 2, 3 dan 5; desil 11", "desil 4  - 2; desil 5 & 7; desil 99999999999") == [
        '[{"phrase":"desil 1 sampai dengan 4","deciles":[1,2,3,4]},{"phrase":"desil 2, 3 dan 5","deciles":[2,3,5]}]', '[{"phrase":"desil 4 - 2","deciles":[2,4]},{"phrase":"desil 5 & 7","deciles":[5,7]}]']
    assert values(spark, lambda t: F.to_json(X.age_requirements(t)), "Usia 60 s/d 70 tahun", "lanjut usia 70 tahun ke atas", "usia 9 - 5 tahun") == [
        '[{"kind":"range","low":60,"high":70,"phrase":"usia 60 s/d 70 tahun"}]', '[{"kind":"min","low":70,"phrase":"lanjut usia 70 tahun ke atas"}]', "[]"]


PROFILE = "- Nama : X | Umur : {age} tahun\n- Desil Nasional : {decile}\n- Status DTSEN : {status}\n- Berjalan : {ability}"


def test_profiles_and_rules(spark):
    cases = [(69, 4, "aktif", "-"), (70, 4, "aktif", "-"), (70, 5, "aktif", "-"), (70, 4, "TIDAK AKTIF", "-"), (60, 5, "-", "Banyak kesulitan"), (61, 5, "-", "Banyak kesulitan"), (60, 6, "-", "tidak bisa"), (60, 5, "-", "Tidak mengalami kesulitan")]
    texts = [PROFILE.format(age=a, decile=d, status=s, ability=x) for a, d, s, x in cases] + ['{"umur": 0, "desil_nasional": 2}', "Umur : 0", "kosong"]
    df = spark.createDataFrame(list(enumerate(texts)), "profile_id int, t string").select("profile_id", G.signals(F.col("t")).alias("signals"))
    s = {r.profile_id: r.signals for r in df.collect()}
    assert (s[0].age, s[0].decile, s[0].status, s[0].disability) == (69, 4, "aktif", False)
    assert s[8].age is None and s[9].age == 0 and s[10].age is None
    ok = {(r.profile_id, r.rule_order): r.eligible for r in G.hard_rules(df).collect()}
    assert [ok[i, 0] for i in range(4)] == [False, True, False, False]
    assert [ok[i, 1] for i in range(4, 8)] == [True, False, False, False]
    assert not any(ok[i, k] for i in (8, 10) for k in (0, 1))
    f = [r.f for r in df.select("profile_id", G.fallback(F.col("signals")).alias("f")).orderBy("profile_id").collect()]
    assert f[3].elderly and f[4].disabled and not f[5].disabled
    assert values(spark, X.is_severe, "tidak bisa", "sedikit kesulitan, tapi tidak membutuhkan bantuan", None) == [True, False, False]
    assert values(spark, G.is_profile, "teknik", "umur 5", "a: 1\nb: 2\nc", "a\nb\nc", "") == [True, True, True, False, False]
    assert values(spark, program_filter, "Skor PKH Plus: 0.7 | Skor ASPD : 0.7", "pkh+: 0.7.", "x", "ASPD: 0.2 PKH: 0.4") == ["ASPD", None, None, "PKH Plus"]
    assert values(spark, G.unwrap, ' {"content": " a "}', '{"messages": [{"role": "user", "content": ""}, {"role": "user", "query": "q"}]}', "[1", None) == ["a", "q", "[1", ""]


def test_payloads(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", " "), (2, 0, "user", ""), (2, 1, "user", "b"), (2, 2, "assistant", '{"laporan_evaluasi": {"kesimpulan": {"aspd": {"label": 1}}, "skor": {"skor_aspd": 0.5}}}')], "conv_id int, turn int, role string, text string")
    assert {r.conv_id: r.text for r in G.last_user_text(turns).collect()} == {1: "", 2: "b"}
    assert {r.conv_id: r.text for r in G.first_user_text(turns).collect()} == {1: "a", 2: "b"}
    r = G.chat_parts(turns).filter("conv_id = 2").first()
    assert (r.label_aspd, r.score_aspd, r.label_pkh_plus) == (1, 0.5, None)


def test_scans(spark, tmp_path):
    lines = ["", '{"text": "a", "metadata": {}}', "{broken", "[1]", '{"text": 5, "metadata": {}}', '{"text": "a", "metadata": "s"}', '{"text": "a"}']
    assert values(spark, J.line_outcome, *lines) == ["blank", "row", "invalid_json", *["invalid_schema"] * 4]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    assert J.scan_silent(df).count() == 5 and J.scan_lenient(df).count() == 3
    with pytest.raises(Exception, match="f:3"):
        J.scan_fail_fast(df.filter("value = '{broken'"), F.lit("f"), F.lit(3)).collect()
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.jsonl").write_text("\n".join(lines))
    for n in (1, 2):
        ingest_new(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "mark"))
        assert spark.read.parquet(str(tmp_path / "out")).count() == n
        (folder / "b.jsonl").write_text('{"text": "b", "metadata": {}}')


def test_chunks():
    text = "\n\n".join(f"Kalimat {i}. " + "kata " * 30 for i in range(40))
    parts = C.split_text(text, 800, 150)
    assert all(len(p) <= 800 for p in parts) and all(f"Kalimat {i}." in " ".join(parts) for i in range(40))
    assert C.split_text("x" * 900, 800, 150) == ["x" * 900] and C.split_text("  ", 8, 2) == []
    assert C.cap_text("a" * 10 + "\n" + "b" * 10, 15) == ["a" * 10, "b" * 10] and C.cap_text("c" * 12, 5) == ["ccccc", "ccccc", "cc"]
    assert C.tail_text("pendek", 200) == "pendek" and C.tail_text("A. " * 100 + "Akhir kalimat.", 20) == "A. Akhir kalimat."
    assert C.tail_text("y" * 50, 20) == "y" * 40


def test_columns_of_chunks(spark):
    assert values(spark, lambda t: C.merge_small(F.split(t, r"\|")), "kecil| |x|" + "y" * 180) == [["kecil\nx", "y" * 180]]
    got = values(spark, lambda t: C.fixed_split(t, 5, 2), "abcdefghij", "")
    assert got == [["abcde", "defgh", "ghij"], [""]]


def test_lines_and_hierarchy(spark):
    kinds = values(spark, lambda t: F.concat_ws("/", X.line_class(t)["level"], X.line_class(t)["label"], X.line_class(t)["rest"]), "BAB II - UMUM", "Pasal 3.", "Pasal KESATU : isi", "KEDUA BELAS", "2.000 orang", "(4) isi", "b. isi", "isi", "Bagian Kesatu")
    assert kinds == ["bab/BAB II/UMUM", "pasal/Pasal 3/", "diktum/Diktum KESATU/isi", "diktum/Diktum KEDUA BELAS/", "ayat/2/000 orang", "ayat/4/isi", "huruf/b/isi", "none//isi", "bagian/Bagian Kesatu/"]
    def units_of(*pages):
        rows = [("D", p + 1, n, x) for p, xs in enumerate(pages) for n, x in enumerate(xs)]
        df = spark.createDataFrame(rows, "document string, page int, line_no int, line string").repartition(3)
        return [(r.text, r.chapter, r.article, r.clause, r.page) for r in A.hierarchy(df).orderBy("row").collect()]

    doc = ["judul", "Menimbang : x", "BAB I", "KETENTUAN", "UMUM", "Pasal 1", "Isi satu", "(1) masih isi.", "(2) ayat dua.", "PRESIDEN", "Pasal 2", "Sesuai dengan pasal", "Pasal 9", "akhir.", "Ditetapkan di Surabaya", "lain"]
    title = "BAB I – KETENTUAN UMUM"
    assert units_of(doc) == [("Isi satu (1) masih isi.", title, "1", "", 1), ("ayat dua.", title, "1", "2", 1), ("Sesuai dengan pasal Pasal 9 akhir.", title, "2", "", 1)]
    # A part passes its next line over; decrees must rise; clauses under a decree stay; a preamble stops all until a heading.
    doc = ["(1) x.", "KEDUA : dua.", "KESATU : bukan.", "(2) tetap.", "a. huruf;", "Bagian Kesatu", "Ketentuan", ".: KETIGA", "KETIGA : tiga.", "Mengingat : y", "hilang.", "BAB II – PENUTUP", "isi bab.", "KESATU : ulang"]
    assert units_of(doc[:6], doc[6:]) == [
        ("dua. KESATU : bukan. (2) tetap. a. huruf; KETIGA", "", "KEDUA", "", 1), ("tiga.", "", "KETIGA", "", 2), ("isi bab.", "BAB II – PENUTUP", "", "", 2), ("ulang", "BAB II – PENUTUP", "KESATU", "", 2)]
    assert units_of(["BAB I", "Bagian Kesatu", "lewat", "(1) satu.", "2) bukan", "(31 tiga.", "", None, "- 5 -"]) == [("satu. 2) bukan (3) tiga.", "BAB I", "", "1", 1)]
    assert units_of(["tanpa", "(1) judul."]) == []
    assert values(spark, X.category, "Transaksi", "SOP x", "Laporan", "UU") == ["Pedoman Program (Rencana Kerja & Aksi)", "Juknis (Petunjuk Teknis & SOP)", "Data dan Laporan Analisis", "Regulasi (Aturan Hukum & Payung Kebijakan)"]


def test_document_units(spark):
    pages = {
        1: ["PERATURAN", "Menimbang : bahwa", "BAB II", "HAK DAN", "KEWAJIBAN", "Pasal 1", "KPM wajib.", "(2) Isi  ayat . . . dua.", "ab"],
        2: ["Pasal 2", "x", "Pasal KESATU : mulai. KEDUA: lanjut. Pasal KETIGA : akhir", "(1) tetap di sini. memerintahkan pengundangan ini", None, "Ditetapkan di Surabaya", "Pasal 9", "lain"],
    }
    rows = [("D", p, n, x) for p, xs in pages.items() for n, x in enumerate(xs)] + [("E", 1, 0, "tanpa pasal")]
    df = spark.createDataFrame(rows, "document string, page int, line_no int, line string")
    found = [(r.row, r.page, r.chapter, r.article, r.clause, r.content) for r in A.document_units(df).orderBy("row").collect()]
    title = "BAB II – Hak dan Kewajiban"
    assert found == [
        (1, 1, title, "1", "", f"[D | Bab {title} | Pasal/Diktum 1] Keluarga Penerima Manfaat (KPM) wajib."),
        (2, 1, title, "1", "2", f"[D | Bab {title} | Pasal/Diktum 1 | Ayat 2] Isi ayat dua. ab"),
        (3, 2, title, "KESATU", "", f"[D | Bab {title} | Pasal/Diktum KESATU] mulai."),
        (4, 2, title, "KEDUA", "", f"[D | Bab {title} | Pasal/Diktum KEDUA] lanjut."),
        (5, 2, title, "KETIGA", "", f"[D | Bab {title} | Pasal/Diktum KETIGA] akhir (1) tetap di sini"),
    ]
    assert A.document_units(df.filter("false")).count() == 0


def test_numbered(spark):
    ids = [None, -5, 10**15, *range(0, 900, 3)]
    df = spark.createDataFrame([(i, "low" if i and i % 2 else "normal") for i in ids], "k long, priority string")
    kept = sorted((i for i in ids if not i or i % 2 == 0), key=lambda i: (i is not None, i))
    for parts in (1, 7, 256):
        assert [r.k for r in J.numbered(df, "k", parts=parts).orderBy("id").collect()] == kept
    assert [r.id for r in J.numbered(df, "k").orderBy("id").collect()] == list(range(len(kept)))
    assert J.numbered(df.filter("false"), "k").count() == 0


def test_answers(spark):
    answer = "## ASPD — STATUS: ELIGIBLE\na\n## PKH Plus: STATUS: NON-ELIGIBLE\nb\n## aspd - STATUS: ELIGIBLE\nc\n## Bantuan Lain\nd"
    assert [(t, s) for t, s, _ in A.sections_of(answer)] == [("ASPD", "eligible"), ("PKH Plus", "non-eligible"), ("aspd", "eligible")]
    assert values(spark, A.clean_answer, answer) == ["## ASPD — STATUS: ELIGIBLE\na\n## PKH Plus: STATUS: NON-ELIGIBLE\nb"]
    assert values(spark, A.json_block, '<think>{</think>```json\n{"a": 1}\n```', 'x {"a": 2} y', "none", "<think>open") == ['{"a": 1}', '{"a": 2}', None, None]
    assert values(spark, lambda t: X.cites_page(t, F.lit(14)), "hal. 13-15", "hal. 13, 14", "halaman 14", "hal 140", "14") == [True, True, True, False, False]
    assert values(spark, X.window_status, "tidak eligible", "mungkin eligible", "eligible", "belum") == ["tidak_eligible", "mungkin_eligible", "eligible", "unknown"]
    rows = A.answer_rows(spark.createDataFrame([(1, 'Hasil[1]{x}:\nringkasan_profil,-,-,"a, b"\nshort,row\nrekomendasi, P, OK,"Rank: 2 | Alasan: c: d"')], "k int, raw string"), "k").orderBy("row").collect()
    assert [(r.category, r.detail, r["rank"], r.reason) for r in rows] == [("ringkasan_profil", "a, b", 1, "a, b"), ("rekomendasi", "Rank: 2 | Alasan: c: d", 2, "c: d")]


def test_profile_edges(spark):
    df = spark.createDataFrame([("a", ""), ("a", None), ("a", "x" * 99), ("a", "x" * 100), ("a", "x" * 500), ("a", "x" * 501)], "g string, text string")
    r = P.quality_stats(df, "g").first()
    assert (r.empty, r.short, r.medium, r.long, r.duplicates) == (2, 3, 2, 1, 1)
    assert P.global_stats(df.filter("length(text) = 99")).first().deviation == 0.0
    assert P.completeness(df.filter("false"), ["text", "none"]).count() == 2


def test_top_k_ties_and_threshold(spark):
    points = spark.createDataFrame([(2, [1.0, 0.0]), (1, [2.0, 0.0]), (3, [0.8, 0.6]), (4, [0.0, 1.0])], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, query_vector array<double>")
    assert [(r.vec_id, r["rank"]) for r in top_k(points, queries, 3, 0.8).orderBy("rank").collect()] == [(1, 1), (2, 2), (3, 3)]
