"""The quality profile of files on lines written by hand."""

import json

from lumbung.operators import report as R
from lumbung.sources import jsonl as J


def test_profile_of_files(spark):
    def line(text, **meta):
        return json.dumps({"text": text, "metadata": meta})

    full = dict(sumber="JUKNIS PKH PLUS 2026.pdf", page_number=1, nama_bansos="PKH", tipe_konten=["a", "b"], tipe_konten_primer="a", retrieval_priority="normal", kategori="K")
    lines = {
        "good": [line("x" * 600, **full), line("y" * 100, **full)],
        "bad": [line("", sumber=" ", page_number=None), line("short", filename="f.pdf", tipe_konten="one", quality_flags=["q"]), line("short", **{**full, "tipe_konten": [], "retrieval_priority": "odd"}), "{broken", "[1]", "  "],
        "shape": ["[1]", "{}"], "broken": ["{"],
    }
    rows = [(f, k, x) for f, xs in lines.items() for k, x in enumerate(xs)]
    found = R.entries(J.scan_strict(spark.createDataFrame(rows, "file string, ord int, value string").repartition(3)), "file", "ord").cache()
    stats = {r.file: r for r in R.file_stats(found, "file").collect()}
    assert set(stats) == {"good", "bad", "broken"}  # lines of another shape alone give no statistics
    good, bad = stats["good"], stats["bad"]
    assert (good.rows, good.warnings, good.mean_keys, good.medium, good.long) == (2, 0, 7.0, 1, 1)
    assert (bad.rows, bad.invalid_json, bad.invalid_schema, bad.empty, bad.short, bad.duplicates, bad.lacks_sumber, bad.lacks_page_number) == (3, 1, 1, 1, 3, 1, 1, 2)
    assert (bad.unclean_tipe_konten, bad.bad_type, bad.bad_priority, bad.due, bad.warnings) == (1, 1, 1, 1, 9)
    assert (stats["broken"].rows, stats["broken"].total_length, stats["broken"].warnings) == (0, 0, 1)
    tops = {(r.file, r.kind, r["rank"]): (r.value, r["count"]) for r in R.counters(found, "file").collect()}
    assert tops["good", "tipe_konten", 1] == ("a", 2) and tops["good", "tipe_konten", 2] == ("b", 2)
    assert [tops["bad", "sumber", k][0] for k in (1, 2, 3)] == [" ", "f.pdf", "JUKNIS PKH PLUS 2026.pdf"] and tops["bad", "quality_flags", 1] == ("q", 1)
    summary = R.cross_summary(R.file_stats(found, "file"), "file").first()
    assert (summary.files, summary.most_descriptive, summary.richest_metadata, summary.risky) == (3, "good", "good", ["bad: 9", "broken: 1"])
    assert {r.file: (r.top_sumber, r.top_kategori, r.sources) for r in R.file_summary(found, "file").collect()}["broken"] == ("-", "-", 0)
    assert [r.level for r in R.notes(found).orderBy("place").collect()] == ["WARN", "WARN", "WARN", "WARN", "INFO", "WARN", "WARN", "INFO"]
