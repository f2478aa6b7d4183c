"""What a row costs, and what one task holds."""

import random

from pyspark.sql import functions as F

from lumbung.functions import fixed
from lumbung.functions import text as X
from lumbung.operators import answers as A
from lumbung.operators import hierarchy as H
from lumbung.operators import requirements as Q
from lumbung.sources import points as S


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_white_space_is_that_of_the_pattern(spark):
    """strip and collapse do what the pattern of white space says, for every character of it and beside it."""
    rng, edge = random.Random(3), rf"{X.WS}+\z|\A[\s\x1c-\x1f]+"
    marks = [chr(c) for c in [*range(0x20), 0x20, 0x20, 0x20, 0x7F, 0x85, 0xA0, 0x1680, 0x180E, *range(0x1FFF, 0x2010), *range(0x2027, 0x2031), 0x205F, 0x2060, 0x3000, 0xFEFF]] + ["a", "é", "𝄞"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randrange(12))) for _ in range(3000)] + marks + ["", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    old = F.regexp_replace(F.regexp_replace("t", f"{X.WS}+", " "), "^ | $", "")
    bad = df.filter(~X.strip(F.col("t")).eqNullSafe(F.regexp_replace("t", edge, "")) | ~X.collapse(F.col("t")).eqNullSafe(old))
    assert bad.count() == 0


def test_answers_are_normalised_once_for_all_programs(spark):
    df = spark.createDataFrame([(1, "aspd layak; kip kpm tidak memenuhi, aspd eligible"), (2, None)], "case_id long, answer string")
    text = X.evaluator_text(F.col("answer"))
    every = [A.detected_status(text, names).alias(name) for name, names in fixed.PROGRAM_ALIASES.items()]
    assert plan(df.select(every[0])).count("translate(") == 1
    found = {(r.case_id, r.program): r.status for r in A.program_statuses(df).collect()}
    assert found[1, "ASPD"] == "tidak_eligible" and found[1, "PKH Plus"] == "missing" and found[2, "ASPD"] == "missing"


def test_documents_are_no_python_groups(spark):
    rows = [(d, 1, i, x) for d in ("a", "b", None) for i, x in enumerate(["BAB II", "HAK", "Pasal 1", "isi satu.", "Ditetapkan di X", "Pasal 2", "nanti"])]
    units = H.hierarchy(spark.createDataFrame(rows, "document string, page long, line_no int, line string"))
    assert "FlatMapGroups" not in plan(units)
    assert sorted((r.document or "", r.row, r.text, r.article) for r in units.collect()) == [(d, 1, "isi satu.", "1") for d in ("", "a", "b")]


def test_parts_of_a_text_are_made_once(spark):
    df = spark.createDataFrame([("a\nbantuan Rp 1.000\nb. Rp 5",)], "text string")
    units = df.select(X.amount_units(F.col("text")).alias("u"))
    assert plan(units).count("split(") == 2
    assert units.first().u == ["bantuan Rp 1.000"]
    rows = [(i, "p", f"bantuan Rp {i}.000", None, "normal", None) for i in range(5)]
    chunks = spark.createDataFrame(rows, "ord long, program string, text string, tags array<string>, priority string, title string")
    assert [tuple(r) for r in Q.best_summaries(chunks).collect()] == [("p", 0, 0, "bantuan Rp 0.000")]


def test_a_bucket_is_no_task(spark):
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table = S.PointTable(spark, S.shared_folder(spark, "points"), "id", 1)
        table.replace(spark.range(1000))
        assert len(table.read().inputFiles()) > 2
        table.upsert(spark.range(500, 1500), "id")
        table.delete(F.col("id") < 10)
        assert len(table.read().inputFiles()) > 2
        assert sorted(r.id for r in table.read().collect()) == list(range(10, 1500))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)
