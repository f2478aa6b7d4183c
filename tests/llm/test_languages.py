"""Language ID learns every label, and the pipeline keeps clean text that no model has seen."""

import random

import corpus_pipeline as P
from lumbung.llm import op6_langid

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
RUSSIAN = "Съешь же ещё этих мягких французских булок, да выпей чаю. В чащах юга жил бы цитрус. " * 3
ENGLISH = "The quick brown fox jumps over the lazy dog, and then it sleeps in the warm sun. " * 3


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t)) for i, (t, lang) in enumerate(rows)], SCHEMA)


def test_every_label_is_learned(spark):
    rng = random.Random(1)
    words = {f"l{k:02}": ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(5)) for _ in range(12)] for k in range(70)}
    rows = [(" ".join(rng.choice(w) for _ in range(60)), lang) for lang, w in words.items() for _ in range(9)]
    docs = frame(spark, rows)
    assert set(op6_langid.sample(docs)) == set(words)
    found = {r.doc_id: r.lang_pred for r in op6_langid.identify(docs, ["doc_id"]).collect()}
    assert set(found.values()) == set(words)
    assert sum(found[i] == lang for i, (_, lang) in enumerate(rows)) >= 0.99 * len(rows)


def test_long_texts_alone_are_learned(spark):
    docs = frame(spark, [(ENGLISH, "en")] * 12 + [(RUSSIAN * 200, "ru")] * 12)
    learned = op6_langid.sample(docs)
    assert set(learned) == {"en", "ru"} and all(op6_langid.SAMPLE_BYTES - 4 < len(t) <= op6_langid.SAMPLE_BYTES for t in learned["ru"])
    assert all("�" not in t.decode() for t in learned["ru"])
    assert {r.doc_id: r.lang_pred for r in op6_langid.identify(docs, ["doc_id"]).collect()} == {i: "en" if i < 12 else "ru" for i in range(24)}


def test_pipeline_keeps_scripts_that_were_not_learned(spark):
    rng = random.Random(2)
    noise = "".join(rng.choice("qxzjkvQXZJKV#$%&!") for _ in range(400))
    rows = [(ENGLISH, "en")] * 12 + [(RUSSIAN, None), (ENGLISH + RUSSIAN, None), (noise, None), ("12 34 !!", None)]
    kept = {r.doc_id for r in P.language(spark, frame(spark, rows), "").collect()}
    assert kept == set(range(14))


def test_pipeline_keeps_rows_where_none_is_labelled(spark):
    rows = [(ENGLISH, None), (RUSSIAN, None), ("12 34 !!", None), ("", None)]
    assert {r.doc_id for r in P.language(spark, frame(spark, rows), "").collect()} == {0, 1}
