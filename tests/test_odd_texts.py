"""Queries against their SQL on texts that the small tables lack: white space at the ends, or nothing else."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lumbung.plans import catalog
from lumbung.sources import jsonl as J

from .test_queries import plain

PROSE = "of the day und der Rest, que de la one, and what is said of it once more"
ENDS = ["abcdefghijk\n" + PROSE, "abcdefghijk " + PROSE, "abcdefghij \n" + PROSE, "abcdefghij\n " + PROSE, "abcdefghijk\t" + PROSE, "abcdefghijk\xa0" + PROSE, "abcdefghijkl" + PROSE]
BLANK = ["", " ", "\n", " \n ", "\t", "\xa0 ", " \t\n", "x", " " + PROSE + "\n", "\t" + PROSE + "\r\n", "|", "a|b", "|a|\n"]
CASES = {
    "a19_cleaning_counters": [(1, PROSE + " " + PROSE), (2, " "), (3, "\t"), (4, "\n" + PROSE), *((23 * k, text) for k, text in enumerate(ENDS, 1))],
    "c4_merge_small_tail": [*enumerate(BLANK + BLANK[1:] + [None, None])],
    "s10_titled_response": [*enumerate([*BLANK, None, " " * 16 + PROSE, "\n" * 15 + PROSE, "abcdefghijklmn\t" + PROSE, "a [KONTEN] b", "a [KONTEN]: b", "[JUDUL]: a", "\n[JUDUL]", "[KONTEN]:"])],
    "s6_document_explode": [*enumerate([*BLANK, *BLANK[1:], *BLANK[2:], None, None, None])],
}


@pytest.mark.parametrize("name", CASES)
def test_odd_texts(spark, tmp_path, name):
    rows = [(i, text, "en", f"src{i % 2}", len(text or "")) for i, text in CASES[name]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    df = catalog.QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    own = sorted(repr(tuple(plain(v) for v in r)) for r in df.collect())
    assert own == sorted(repr(tuple(plain(v) for v in r)) for r in con.execute(f"select {', '.join(df.columns)} from ({catalog.ORACLES[name]})").fetchall())


def test_labels_have_colons(spark):
    rows = [("[JUDUL] x [JUDUL]: T\n[KONTEN]: a [KONTEN] b",), ("[JUDUL] x",)]
    found = [tuple(r.r) for r in spark.createDataFrame(rows, "raw string").select(J.titled_response(F.col("raw"), F.lit(7)).alias("r")).collect()]
    assert found == [("T", "a [KONTEN] b"), ("Tabel/Diagram", "[JUDUL] x")]


def test_items_without_text(spark):
    items = [(" ", "isi", None), ("", " b ", {"k": "item", "source": "item"}), (None, "", None), (" a", "isi", None)]
    df = spark.createDataFrame([({"source": "doc"}, items)], "metadata map<string,string>, items array<struct<text:string,isi:string,meta:map<string,string>>>")
    assert [(r.text, r.metadata) for r in J.explode_documents(df).collect()] == [("b", {"k": "item", "source": "doc"}), ("a", {"source": "doc"})]
