"""Stages of cleaning: what ends each part, and counts that equal the rows."""

from pyspark.sql import functions as F

from lumbung.operators import cleaning as K

LONG = " ".join(f"kriteria penerima bantuan nomor {k} wajib syarat." for k in range(90))


def test_every_part_carries_its_stage(spark):
    rows = [
        (1, "x" * 30 + " Gagal memuat menggunakan Vision LLM", "s", 1, None), (2, LONG, "s", 1, "Ekstraksi Gagal"), (3, "pendek", "s", 1, None), (4, None, "s", 1, None), (5, "1.2 3,4 / 5 (6) - 7.8 : 9.0 1", "s", 1, None),
        (6, "syarat kriteria penerima bantuan sosial adalah warga " * 3, "s", 1, "## Judul"), (7, "```markdown\n" + "syarat kriteria penerima bantuan sosial adalah warga " * 3 + "\n```", "s", 1, "Judul"),
        (8, "syarat kriteria penerima bantuan sosial adalah warga " * 3, "s", 2, "Judul"), (9, LONG, "t", 1, "12"), (10, LONG, "t", 1, "iv"), (11, "", "t", 1, None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, page int, title string").repartition(3)
    parts = K.staged(df, K.recursive(800, 150), programs={"s": "Program"}).cache()
    found = {}
    for r in parts.orderBy("doc_id", "idx").collect():
        found.setdefault(r.doc_id, []).append(r)
    assert {k: {r.stage for r in v} for k, v in found.items()} == {1: {"error"}, 2: {"error"}, 3: {"short"}, 4: {"short"}, 5: {"tiny"}, 6: {"kept"}, 7: {"duplicate"}, 8: {"kept"}, 9: {"kept"}, 10: {"duplicate"}, 11: {"short"}}
    assert found[6][0].text.startswith("[Sumber: s | Hal. 1 | Judul]\n") and found[6][0].program == "Program" and found[9][0].program is None
    assert [r.idx for r in found[9]] == list(range(len(found[9]))) and all(r.total == len(found[9]) > 3 for r in found[9])
    c = K.counters(parts).first().asDict()
    n = len(found[9])
    assert (c["error_removed"], c["fence_cleaned"], c["short_removed"], c["resplit"], c["resplit_new_chunks"], c["tiny_skipped"], c["dupes_removed"], c["final"]) == (2, 3, 3, 2, 2 * n, 1, 1 + n, 2 + n)  # fences, and two texts with white space at their ends
    assert c["prefix_added"] == 3 + 2 * n and c["program_tagged"] == 2
    kept = K.clean(df, K.recursive(800, 150))
    assert kept.count() == c["final"] and kept.filter("resplit").select("chunk_index").agg(F.max("chunk_index")).first()[0] == n
    none = K.counters(K.staged(df.filter("false"))).first().asDict()
    assert set(none.values()) == {0}
