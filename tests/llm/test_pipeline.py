"""The pipeline's stages against what each must do."""

import re
from collections import defaultdict

import corpus_pipeline as P

from .test_operators import SCHEMA, TEXTS, WORD, roots, shingles


def test_stages(spark):
    rows = [(i, t, ["en", "fr"][i % 2], ["s1", "s0"][i % 2], len(t or ""), "x", "y", "z", "n", 1) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, SCHEMA)
    named = dict(P.STAGES)
    kept = named["language_id"](spark, docs, "").cache()
    assert kept.columns == docs.columns
    letters = {i for i, t in enumerate(TEXTS) if t and re.search(r"[^\W\d_]", t)}
    assert {r.doc_id for r in kept.collect()} == letters

    single = named["ngram_jaccard_join"](spark, kept, "").cache()
    sets = {i: shingles(TEXTS[i], 5) for i in letters}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    up = roots(list(sets), links)
    assert {r.doc_id for r in single.collect()} == {i for i in sets if up[i] == i}
    assert single.columns == docs.columns

    cleaned = named["substring_dedup"](spark, single, "").cache()
    seen = defaultdict(set)
    for r in cleaned.collect():
        w = WORD.findall(r.text)
        assert r.n_chars == len(r.text)
        for p in range(len(w) - 49):
            seen[tuple(w[p : p + 50])].add(r.doc_id)
    assert all(len(v) == 1 for v in seen.values())

    mixed = named["source_mixing"](spark, cleaned, "").cache()
    assert mixed.columns == docs.columns and max(r["count"] for r in mixed.groupBy("doc_id").count().collect()) <= 2
    packed = named["best_fit_packing"](spark, mixed, "")
    assert packed.filter("piece = 0").count() == mixed.count()


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0
