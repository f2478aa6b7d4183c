"""Requirements against profiles, and the ordered fold of summaries, against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lumbung.functions import text as X
from lumbung.operators import requirements as Q

AMOUNT = re.compile(r"\bRp\.?\s*([0-9][0-9.,\s]*)(?:,-|,00)?", re.I)


def amounts(t):
    return {re.sub(r"\D", "", m) for m in AMOUNT.findall(t)}


def brute_summary(units):
    best = None
    for at, unit, text, plain in units:
        n = len(amounts(text))
        cut = text[:60].rstrip()
        if n and (best is None or n > len(amounts(best[2])) or (n == len(amounts(best[2])) and plain and "lampiran" in best[2].lower())):
            best = (at, unit, cut)
    return best


@pytest.mark.parametrize("part", [1, 7, 1000])
def test_best_summaries(spark, part, monkeypatch):
    rng = random.Random(6)
    rows, units = [], {}
    for k in range(300):
        program = rng.choice(["a", "b", "c", "", None])
        lines = []
        for _ in range(rng.randint(1, 3)):
            line = "Lampiran " * rng.randint(0, 1) + "bantuan" + "".join(f" Rp {rng.randint(1, 30)}000" for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 9])))
            lines.append(line)
        title, priority = rng.choice([None, "LAMPIRAN", "Bab"]), rng.choice(["normal", "low", None])
        rows.append((k, program, "\n".join(lines), None, priority, title))
        own = [x for x in lines if amounts(x)]
        plain = priority == "normal" and title != "LAMPIRAN"
        if program:
            units.setdefault(program, []).extend((k, i, x, plain) for i, x in enumerate(own))
    df = spark.createDataFrame(rows, "ord long, program string, text string, tags array<string>, priority string, title string").repartition(5)
    monkeypatch.setattr(Q.summary_units, "__defaults__", (60, *Q.summary_units.__defaults__[1:]))
    found = {r.program: (r.ord, r.unit, r.summary) for r in Q.best_summaries(df, part=part).collect()}
    assert found == {p: brute_summary(u) for p, u in units.items()}
    assert Q.best_summaries(df.filter("false"), part=part).count() == 0


def test_ages_in_ranges(spark):
    rng = random.Random(8)
    people = [(k, [rng.choice([None, -3, 0, 5, 60, 70, 119, 120, 121, 300, rng.randint(0, 110)]) for _ in range(rng.randint(0, 3))]) for k in range(200)] + [(999, None)]
    needs = [(k, rng.choice([None, 0, 1, 60, 119, 120, 121, 250, rng.randint(0, 100)]), rng.choice([None, 0, 60, 120, 130, 400, rng.randint(0, 120)])) for k in range(80)]
    found = Q.of_ages(spark.createDataFrame(people, "profile long, ages array<int>"), spark.createDataFrame(needs, "need long, low int, high int"), 3)
    want = {(p, n) for p, ages in people for n, low, high in needs if low is not None and any(a is not None and low <= a and (high is None or a <= high) for a in ages or [])}
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(want) and set(rows) == want


def test_hints(spark):
    chunks = [(1, "P", 4, "Desil 1 - 4. Desil 7 dan 8", None), (2, "P", None, "usia 60 s/d 70 tahun; usia 1 tahun ke atas; Desil 9", None), (3, None, 1, "desil 1", None), (4, "Q", 1, "seumur hidup", ["kriteria_penerima"]), (5, "P", 5, "Desil 1 - 4, usia 60 s/d 70 tahun", None), (6, "Q", 1, None, None)]
    profiles = [("x", 3, [65, 2]), ("y", None, [80]), ("z", 5, []), ("w", None, None)]
    hits = [(p, c, r) for p, *_ in profiles for r, c in enumerate((1, 2, 3, 4, 5, 6))]
    found = Q.requirement_hints(
        spark.createDataFrame(profiles, "profile string, decile int, ages array<int>"), spark.createDataFrame(hits, "profile string, chunk int, rank int"),
        spark.createDataFrame(chunks, "chunk int, program string, page int, text string, tags array<string>"),
    )
    by = {}
    for r in found.orderBy("profile", "place").collect():
        by.setdefault(r.profile, []).append(r.hint)
    assert by == {
        "x": ["- P | Hal. 4 | syarat desil 1 - 4 (nilai: 1, 2, 3, 4); profil Desil 3 -> MEMENUHI.", "- P | Hal. ? | syarat desil 9 (nilai: 9); profil Desil 3 -> TIDAK MEMENUHI.", "- P | Hal. ? | syarat usia 60 s/d 70 tahun; usia pada profil: 65, 2 tahun -> MEMENUHI."],
        "y": ["- P | Hal. ? | syarat usia 60 s/d 70 tahun; usia pada profil: 80 tahun -> TIDAK MEMENUHI.", "- P | Hal. ? | syarat usia 1 tahun ke atas; usia pada profil: 80 tahun -> MEMENUHI."],
        "z": ["- P | Hal. 4 | syarat desil 1 - 4 (nilai: 1, 2, 3, 4); profil Desil 5 -> TIDAK MEMENUHI.", "- P | Hal. 4 | syarat desil 7 dan 8 (nilai: 7, 8); profil Desil 5 -> TIDAK MEMENUHI.", "- P | Hal. ? | syarat desil 9 (nilai: 9); profil Desil 5 -> TIDAK MEMENUHI."],
    }


def test_mentions(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice(["Rp 5.000", "Rp.2", "rp 7,-", " x ", "\n", "abc ", "Rp", "  "]) for _ in range(rng.randint(0, 60))) for _ in range(60)] + [None, "", "Rp 1", "xRp 1"]
    found = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", X.amount_mentions(F.col("t"), 14, 18).alias("m"))
    for r in found.collect():
        t = texts[r.k]
        if t is None:
            assert r.m is None
            continue
        want = [(d, " ".join(t[max(0, m.start() - 14) : m.end() + 18].split())) for m in AMOUNT.finditer(t) if (d := re.sub(r"\D", "", m[1]))]
        assert [(x.amount, x.context) for x in r.m] == want
