"""Point tables that rewrite touched buckets only, and the upkeep of chunk files."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from lumbung.sources import jsonl as J
from lumbung.sources import points as S

SCHEMA = "id string, n int, t string"


def files(path):
    return {f"{d}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


@pytest.fixture
def table(spark, tmp_path):
    return S.PointTable(spark, f"file://{tmp_path}/points", buckets=8)


def stored(table):
    return sorted(map(tuple, table.read().select("id", "n", "t").collect()))


def test_upsert_rewrites_touched_buckets_only(spark, table, tmp_path):
    rows = [(f"k{k}", k, "old") for k in range(200)]
    assert table.upsert(spark.createDataFrame(rows, SCHEMA), "n") == list(range(8))
    before = files(tmp_path)
    updates = [("k7", 1, "lost"), ("k7", 9, "new"), ("k7", 5, "lost"), ("fresh", 1, "new"), (None, 3, "no key")]
    touched = table.upsert(spark.createDataFrame(updates, SCHEMA), "n")
    after = files(tmp_path)
    assert 1 <= len(touched) <= 2
    untouched = {f for f in before if not any(f"_bucket={b}/" in f for b in touched)}
    assert untouched and all(after.get(f) == before[f] for f in untouched)
    assert not any(f in after for f in set(before) - untouched)
    want = {r[0]: r for r in rows} | {"k7": ("k7", 9, "new"), "fresh": ("fresh", 1, "new")}
    assert stored(table) == sorted(want.values())
    assert table.upsert(spark.createDataFrame(updates, SCHEMA), "n") == touched  # once more: the same table
    assert stored(table) == sorted(want.values())
    assert table.upsert(spark.createDataFrame([], SCHEMA), "n") == [] and stored(table) == sorted(want.values())


def test_hot_keys_are_settled_first(spark, table, monkeypatch):
    monkeypatch.setattr(S, "HOT_ROWS", 10)
    rows = [("hot", k % 50, f"t{k}") for k in range(300)] + [(f"k{k}", k, "x") for k in range(40)] + [("hot", 99, "last")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("_rank", F.struct("n", "t"))
    assert table._settled(df).count() == 41
    table.upsert(df.drop("_rank"), "n")
    assert stored(table) == sorted([("hot", 99, "last"), *[(f"k{k}", k, "x") for k in range(40)]])


def test_delete_empties_buckets(spark, table, tmp_path):
    table.upsert(spark.createDataFrame([(f"k{k}", k, None if k % 3 else "t") for k in range(60)], SCHEMA), "n")
    before = files(tmp_path)
    touched = table.delete(F.col("t") == "t")  # null conditions stay
    assert [r[1] for r in stored(table)] and {r[1] for r in stored(table)} == {k for k in range(60) if k % 3}
    one = table._bucketed(table.read()).filter("id = 'k1'").first()["_bucket"]
    table.delete(F.col("id").isNotNull() & (F.pmod(F.xxhash64("id"), F.lit(8)) == one))
    assert not any(f"_bucket={one}/" in f for f in files(tmp_path)) and touched and before
    table.delete(F.lit(True))
    assert stored(table) == [] and table.read().columns == ["id", "n", "t"]
    assert table.delete(F.lit(True)) == []
    table.upsert(spark.createDataFrame([("a", 1, "x")], SCHEMA), "n")
    assert stored(table) == [("a", 1, "x")]


def test_life_of_a_table(spark, table):
    rows = spark.createDataFrame([("a", 1, "x")], SCHEMA)
    assert not table.exists() and table.ensure(rows.schema) == 0
    assert table.fill_if_empty(rows) and not table.fill_if_empty(rows.limit(0))
    table.replace(table.read().unionByName(spark.createDataFrame([("b", 2, None)], SCHEMA)))
    assert stored(table) == [("a", 1, "x"), ("b", 2, None)] and table.ensure(rows.schema) == 2
    table.replace(rows.limit(0))
    assert stored(table) == []
    table.drop()
    assert not table.exists()


def test_points_of(spark):
    rows = [("teks usia 70 tahun", {"nama_bansos": "ASPD", "x": "1"}), ("teks", {"text": "other"}), ("teks", None), (None, {"x": "1"})]
    df = spark.createDataFrame(rows, "text string, metadata map<string,string>")
    found = [r.asDict() for r in S.points_of(df, lambda t: F.array(F.length(t).cast("double")), rules=[("usia", "[umur]")], tags={"ASPD": "[aspd]"}).collect()]
    assert [r["id"] for r in found] == [str(uuid.uuid5(uuid.NAMESPACE_DNS, t)) for t, _ in rows[:3]]
    assert [r["payload"] for r in found] == [{"text": "teks usia 70 tahun", "nama_bansos": "ASPD", "x": "1"}, {"text": "other"}, {"text": "teks"}]
    assert [r["embedding"][0] for r in found] == [len("teks usia 70 tahun\n[aspd] [umur]"), 4, 4]


LINES = [
    '{"text": "a", "metadata": {"sumber": "x.pdf", "page_number": 2}}', '{"text": "b", "metadata": {"sumber": "x.pdf", "page_number": "2"}}', '{"text": "c", "metadata": {"sumber": "x.pdf", "page_number": 2.0}}',
    '{"text": "d", "metadata": {"sumber": "x.pdf"}}', '{"text": "e"}', "[1]", "{broken", '{"metadata": {"sumber": "x.pdf", "page_number": 2}} }', '{"metadata": "x.pdf"}', "   ",
    '{"metadata": {"sumber": "x.pdf", "page_number": 2, "judul_halaman": "Ekstraksi Gagal"}}',
]


def test_reset_pages_keeps_what_does_not_parse(spark):
    df = spark.createDataFrame([(x,) for x in LINES], "value string")
    gone = spark.createDataFrame([("x.pdf", 2), ("", 0), ("x.pdf", 2)], "source string, page long")
    assert sorted(r.value for r in S.reset_pages(df, gone).collect()) == sorted(LINES[k] for k in (1, 3, 5, 6, 7, 8))
    assert sorted(r.value for r in S.cleanup_errors(df, gone).collect()) == sorted(x for x in LINES[:10] if x.strip())


def test_json_with_more_behind_it_is_invalid(spark):
    lines = ['{"text": "a", "metadata": {}}', '{"text": "a", "metadata": {}}}', '{"text": "a", "metadata": {}} x', '{"text": "a", "metadata": {}}]', '{"text": "a", "metadata": {}}, 1', '{"text": "a", "metadata": {}},"b":1']
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    assert [r.outcome for r in J.scan_strict(df).collect()] == ["row"] + ["invalid_json"] * 5
