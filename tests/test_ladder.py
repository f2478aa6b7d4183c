"""The retry ladder of pages, routing with failures, and answers made without a model."""

from pyspark.sql import functions as F

from lumbung.functions import fixed
from lumbung.operators import rules as G
from lumbung.sources import jsonl as J


def test_retry_ladder(spark):
    long, failed = "x" * 50, fixed.FAILED_TITLE
    pages = [("d", k, long if k in (4, 5) else " short ") for k in range(1, 9)]
    tried = [
        ("d", 1, "2.0", "A", "a"), ("d", 1, "1.5", "B", "b"), ("d", 2, "2.0", "A", "a"), ("d", 2, "1.5", "B", "b"),
        ("d", 3, "2.0", failed, "f2"), ("d", 3, "1.5", failed, "f1"), ("d", 3, "1.0", failed, "f0"), ("d", 3, "half-1", "H", "up"), ("d", 3, "half-2", "H", "down"),
        ("d", 4, "2.0", failed, "f2"), ("d", 4, "half-1", "H", "up"), ("d", 4, "half-2", failed, "f"), ("d", 6, "2.0", failed, "f2"), ("d", 6, "1.0", failed, "f0"), ("d", 6, "1.0", failed, "f0"), ("d", 8, "2.0", failed, "f2"), ("d", 8, "half-2", "H", "down"),
    ]
    df = spark.createDataFrame(tried, "document string, page int, rung string, title string, content string")
    known = spark.createDataFrame([("d", 2), ("d", 2), ("d", 8), ("x", 1)], "document string, page int")
    found = {r.page: (r.title, r.content, r.rung, r.ok) for r in J.resolved_pages(spark.createDataFrame(pages, "document string, page int, native string"), df, known).collect()}
    assert found == {
        1: ("A", "a", "2.0", True), 2: ("B", "b", "1.5", True), 3: ("Halaman Split", "[BAGIAN-1]\nup\n\n[BAGIAN-2]\ndown", "halves", True), 4: ("Fallback Digital", long, "native", True),
        5: ("Fallback Digital", long, "native", True), 6: (failed, "f0", "none", False), 7: (failed, "", "none", False), 8: (failed, "", "none", False),
    }


def test_responses_and_routes(spark):
    df = spark.createDataFrame([("[JUDUL]: T \n[KONTEN]: a\n[KONTEN]: b ", None), ("only text", None), (None, "timeout")], "raw string, error string")
    found = [tuple(r.r) for r in df.select(J.titled_response(F.col("raw"), F.lit(7), F.col("error")).alias("r")).collect()]
    assert found == [("T", "b"), ("Tabel/Diagram", "only text"), ("Ekstraksi Gagal", "[Halaman 7] Gagal memuat menggunakan Vision LLM: timeout")]
    lines = spark.createDataFrame([("a", "x" * 49), ("b", "x" * 50), ("c", "x"), ("d", None)], "doc string, text string")
    problems = spark.createDataFrame([("b", True, False), ("c", False, True), ("e", False, False)], "doc string, unreadable boolean, ocr_failed boolean")
    assert {r.doc: r.route for r in J.page_route(lines, "doc", problems=problems).collect()} == {"a": "ocr", "b": "ocr", "c": "native", "d": "ocr", "e": "ocr"}
    files = spark.createDataFrame([("b.jsonl",), ("a.jsonl",), ("a_normalized.jsonl",), ("c.txt",), ("b.jsonl",)], "name string")
    assert [(r.name, r.place) for r in J.ingest_files(files).collect()] == [("a_normalized.jsonl", 1), ("b.jsonl", 2)]
    assert [r.name for r in J.ingest_files(files, mode="all").collect()] == ["a.jsonl", "a_normalized.jsonl", "b.jsonl"]


def test_fallback_answers(spark):
    rows = [(1, "Umur : 75\nDesil Nasional : 2\nStatus DTSEN : Aktif\nWilayah : Malang", None), (2, "Umur : 40\nDesil Nasional : 6\nKondisi : banyak kesulitan", "0.9"), (3, None, None), (4, "Umur : 50\nDesil Nasional : 5\nKondisi : tidak mampu", None)]
    df = spark.createDataFrame(rows, "profile_id int, profile string, score_disabled string")
    cited = spark.createDataFrame([(1, fixed.ELDERLY_SOURCE, "JUKNIS, Hal. 3")], "profile_id int, source string, citation string")
    found = {(r.profile_id, r.program): r for r in G.fallback_answers(df, cited).collect()}
    first, second = fixed.ELDERLY_PROGRAM, fixed.DISABILITY_PROGRAM
    assert len(found) == 8
    one = found[1, first]
    assert (one.list, one["rank"], one.status, one.source) == ("recommended", 1, "ELIGIBLE", "JUKNIS, Hal. 3") and "Warga berusia 75 tahun" in one.reason and first in one.plan
    assert one.summary == "Profil warga: umur 75 tahun; desil nasional 2; Aktif; Malang"
    assert found[1, second].reason.endswith("; usia warga 75 tahun melebihi batas atas sasaran ASPD.") and found[1, second].source is None
    assert found[2, second].reason == "Tidak memenuhi kriteria ASPD: desil nasional 6 berada di luar klaster prioritas ASPD. Skor Tim 1: 0.9." and found[2, second].plan is None
    assert found[3, first].reason == "Tidak memenuhi kriteria PKH Plus: data usia warga tidak terdeteksi dari profil; status DTSEN tidak aktif atau tidak terdeteksi." and found[3, first].summary == ""
    assert (found[4, second]["rank"], found[4, second].source) == (1, fixed.DISABILITY_SOURCE)
