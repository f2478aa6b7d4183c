"""Answers, profiles in JSON and nominal scores against Python's own parsers and brute force."""

import csv
import io
import json
import random

from pyspark.sql import functions as F

from lumbung.operators import answers as A
from lumbung.operators import rules as G


def test_csv_rows_as_python_reads_them(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(['"', '""', ",", ",", "\n", "a", "b c", '",', ',"', '"\n']) for _ in range(rng.randint(1, 25))) for _ in range(400)]
    texts += ['a,"b, c\nd",e', '"x""y",2', '"open, a\nb', 'a"b,"c"d,e', ",,", '"",""', "a,b,c"]
    found = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", A.csv_rows(F.col("t")).alias("rows")).collect()
    for r in found:
        want = [row for row in csv.reader(io.StringIO(texts[r.k], newline=""), strict=False)]
        own = [row for row in r.rows if row != [""]]  # Python leaves blank lines out
        assert own == [row for row in want if row and row != [""]], repr(texts[r.k])


def test_parsed_answers(spark):
    raws = [
        'Hasil[2]{Kategori,Nilai/Program,Status,Detail/Alasan}:\nringkasan_profil,-,-,first\nringkasan_profil,-,-,"lansia, 70"\nrekomendasi,PKH,OK,"Rank: 2 | Dasar Hukum: Juknis: 1 | Alasan: a: b"\nrekomendasi,ASPD,OK,plain',
        "Hasil[1]{}:\nprogram_tidak_sesuai,ASPD,TIDAK,Alasan: umur: 80\nrekomendasi_teknis_bansos,-,-,NULL",
        "Hasil[1]:\nlain,a,b,c", '<think>rekomendasi,a,b,c</think>{"a": 1}', "nothing", None, 'x {"a": {"b": 2}} y', "Hasil[1]\nrekomendasi_teknis_bansos,-,-,pakai",
    ]
    found = [r.asDict(recursive=True) for r in A.parsed_answers(spark.createDataFrame(list(enumerate(raws)), "k int, raw string"), "k").orderBy("k").collect()]
    assert found[0]["summary"] == "lansia, 70" and found[0]["technical"] is None and not found[0]["parse_error"]
    assert found[0]["recommended"] == [{"rank": 2, "program": "PKH", "status": "OK", "basis": "Juknis: 1", "reason": "a: b"}, {"rank": 1, "program": "ASPD", "status": "OK", "basis": "", "reason": "plain"}]
    assert found[1]["unsuitable"] == [{"program": "ASPD", "status": "TIDAK", "reason": "umur: 80"}] and found[1]["technical"] is None
    assert [(r["json"], r["parse_error"]) for r in found[2:]] == [(None, True), ('{"a": 1}', False), (None, True), (None, True), ('{"a": {"b": 2}}', False), (None, True)]


KEYS, NONE = {"bansos", "bantuan_sosial", "bantuan sosial"}, {"", "-", "[]", "null", "none", "tidak ada", "belum ada", "belum menerima", "belum mendapatkan", "tidak menerima"}


def first_aid(value):
    """The first field of existing aid depth first; None where it is null or missing."""
    for key, item in value.items() if isinstance(value, dict) else [(None, x) for x in value] if isinstance(value, list) else []:
        if key is not None and key.strip().lower() in KEYS:
            return item
        if (found := first_aid(item)) is not None:
            return found
    return None


def test_existing_aid_is_found_depth_first(spark):
    rng = random.Random(2)

    def value(depth):
        kind = rng.random()
        if depth > 3 or kind < 0.35:
            return rng.choice([None, "-", "PKH", "", " Tidak ADA ", [], 0, True, 'a "bansos": "-" {', "[]"])
        if kind < 0.55:
            return [value(depth + 1) for _ in range(rng.randint(0, 3))]
        return {rng.choice(["Bansos", "a", "b", "x", " bantuan_sosial ", "c\"d", "z"]): value(depth + 1) for _ in range(rng.randint(0, 4))}

    texts = [json.dumps(value(0)) for _ in range(500)]
    want = []
    for t in texts:
        found = first_aid(json.loads(t))
        want.append(False if found is None else found == [] if isinstance(found, list) else found.strip().lower() in NONE if isinstance(found, str) else False)
    assert sum(want) > 30
    lines = [("- Bansos : -", True), ("x\n Bansos: belum ada \ny", True), ("bansos: BPNT", False), ("tanpa", False), (None, False), ('{"bansos": "-"', False), ("{}\nbansos : -", True), ('{"bansos": null}', False)]
    rows = [*zip(texts, want, strict=True), *lines]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], "k int, t string")
    for r in df.select("k", G.no_existing_aid(F.col("t")).alias("none")).collect():
        assert r.none == rows[r.k][1], rows[r.k][0]


def test_retrieval_query(spark):
    lead = "syarat kriteria sasaran penerima bantuan sosial"
    cases = [
        ('{"laporan_evaluasi": {"profil_warga": {"umur": 71, "nama": "Ibu Ani"}, "analisis": {"disabilitas_fungsi": "Tidak mampu berdiri"}}, "parameter": {"desil_nasional": 2, "lokasi": " Kota Malang "}}', ": usia 71 tahun lanjut usia 70 tahun ke atas desil 2 penyandang disabilitas perempuan Kota Malang"),
        ('{"umur": "64", "desil_nasional": 0, "status_dtsekolah": "dtks", "disabilitas": {"a": null, "b": "banyak kesulitan"}}', ": usia 64 tahun DTSEN DTKS penyandang disabilitas"),
        ('{"umur": "64.5", "parameter": {"disabilitas": {}}, "disabilitas": {"x": "tidak bisa"}}', ": penyandang disabilitas"),
        ('{"umur": 64.9}', ": usia 64 tahun"), ("[1, 2]", " [1, 2]"), ('{"umur": 0}', ' {"umur": 0}'), ('{"content": "umur 80 tahun"}', ": usia 80 tahun lanjut usia 70 tahun ke atas"),
        ("Desil Nasional : 3, istri, dtsen aktif", ": desil 3 terdaftar DTSEN DTKS perempuan"), ("  halo  ", " halo"), (None, " "),
    ]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "k int, t string")
    for r in df.select("k", G.retrieval_query(F.col("t")).alias("q")).collect():
        assert r.q == lead + cases[r.k][1], cases[r.k][0]


def test_nominal_scores(spark):
    rows = [(1, "### PKH Plus — STATUS: ELIGIBLE\nRp 500.000\n### ASPD - STATUS: TIDAK ELIGIBLE\nRp 9"), (2, "### PKH Plus — STATUS: MUNGKIN ELIGIBLE\nRp 500.000 Rp 250.000\n### ASPD - STATUS: ELIGIBLE\nRp 9"), (3, "nothing"), (4, None), (5, "### PKH Plus: STATUS: ELIGIBLE\nnominal tidak tersebut")]
    answers = spark.createDataFrame(rows, "case_id int, answer string")
    catalog = spark.createDataFrame([("PKH Plus", "500000"), ("PKH Plus", "250000")], "program string, amount string")
    aliases = {"PKH Plus": ["pkh plus"], "ASPD": ["aspd"]}
    found = {r.case_id: (r.score, r.checks, r.failed) for r in A.nominal_scores(answers, catalog, aliases).collect()}
    assert found == {
        1: (0.5, 1, ["nominal:PKH Plus:missing_250000"]), 2: (0.5, 2, ["nominal:ASPD:unsupported_9"]), 3: (1.0, 0, []), 4: (1.0, 0, []),
        5: (0.0, 1, ["nominal:PKH Plus:missing_250000", "nominal:PKH Plus:missing_500000", "nominal:PKH Plus:contradiction"]),
    }
    assert {r.score for r in A.nominal_scores(answers, catalog.filter("false"), aliases).collect()} == {1.0}
