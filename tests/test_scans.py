"""The lines that the scans read hold whole texts."""

import json

from lumbung.plans import catalog, cleaning

D = "/root/testdata/sf0.001"


def test_lines_hold_whole_texts(spark):
    texts = {r.doc_id: (r.text, r.source) for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    lines = {r.doc_id: r.value for r in cleaning._lines(spark, D).collect()}
    assert set(lines) == set(texts)
    for i in (i for i in texts if i % 5 == 0):
        assert json.loads(lines[i]) == {"text": texts[i][0], "metadata": {"source": texts[i][1]}}


def test_scans_take_quotes_and_line_ends(spark, tmp_path):
    texts = ['a "quoted" \\ word\r\n\tnext line', "}", '"x": 1}', "x" * 300_000, "\x00\x1f é 日本"]
    rows = [(5 * k + j, t, "en", "s", len(t)) for k, t in enumerate(texts) for j in range(5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    q = {name: catalog.QUERIES[name](spark, str(tmp_path)) for name in ("s1_strict_scan", "s2_lenient_scan", "s3_silent_scan", "s4_fail_fast_scan")}
    assert {r.outcome: r.n for r in q["s1_strict_scan"].collect()} == {"row": 5, "invalid_json": 5, "invalid_schema": 10, "blank": 5}
    for name, kinds in (("s2_lenient_scan", (0, 3)), ("s3_silent_scan", (0, 2, 3)), ("s4_fail_fast_scan", (0, 2))):
        assert sorted(r.doc_id for r in q[name].collect()) == [i for i, *_ in rows if i % 5 in kinds], name
