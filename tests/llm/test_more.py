"""Skewed keys, independent recomputations, and the pipeline from end to end."""

import math
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lumbung.llm import op1_imatch, op3_covertree, op4_jaccard, op6_langid, op7_mixing, op8_sharding, op9_packing, op10_substrings
from lumbung.llm.common import KeyRanges, shared_dir

from .test_operators import SCHEMA, TEXTS, WORD, roots, shingles


@pytest.mark.parametrize("each, most", [(1000, 64), (10, 2000), (10**9, 64)])
def test_key_ranges_with_outliers(spark, each, most):
    ids = [*range(10_000), 10**15, -(10**14), None]
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    ranges = KeyRanges(df, each, most)
    found = sorted(((r.doc_id, r.b) for r in df.select("doc_id", ranges.of(F.col("doc_id")).alias("b")).collect() if r.doc_id is not None))
    assert [b for _, b in found] == sorted(b for _, b in found) and 0 <= found[0][1] and found[-1][1] < ranges.count
    fair = len(ids) / max(1, min(most, len(ids) // each))
    assert max(Counter(b for _, b in found).values()) <= 2.5 * fair + 20
    assert KeyRanges(df.filter("false"), each, most).count == 1


def test_op1_with_an_outlier_id(spark):
    rows = [(i, f"w{i} common words here and there w{i + 1}") for i in (*range(40), 10**15)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    wide = {r.doc_id: r for r in op1_imatch.fingerprints(df).collect()}
    op1_rows, op1_imatch.ROWS_A_RANGE = op1_imatch.ROWS_A_RANGE, 5
    try:
        narrow = {r.doc_id: r for r in op1_imatch.fingerprints(df).collect()}
    finally:
        op1_imatch.ROWS_A_RANGE = op1_rows
    assert wide == narrow and len(wide) == 41


def test_op3_repeated_rows_and_null_ids(spark):
    v = [1.0, 2.0]
    df = spark.createDataFrame([(1, v, 0), (1, v, 0), (None, v, 0), (2, v, 0), (3, [-2.0, 1.0], 0)], "vec_id long, embedding array<double>, label int")
    found = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in op3_covertree.near_duplicates(df).collect())
    assert found == Counter({(1, 2, 1, True): 2, (2, 2, 1, False): 1, (None, 0, None, False): 1, (3, 0, 3, True): 1})


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b", "x", "y")], "doc_id long, text string, score string, n_words string")
    assert len(set(c := op6_langid.predict(df, None, ["doc_id", "score"]).columns)) == len(c)
    assert len(set(c := op10_substrings.remove_repeats(df, ["doc_id", "n_words"]).columns)) == len(c)


def test_op8_against_every_score(spark):
    weights = [1.0, 2.0, 0.5, 1.0]
    rows = [(i * 7 - 30, f"text {i % 5}") for i in range(300)] + [(5, "a"), (5, "b")]
    found = op8_sharding.shard_records(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), weights, 3.0).collect()

    def winner(key, own):
        def score(shard):
            h = xxhash.xxh64_intdigest(struct.pack("<i", shard), xxhash.xxh64_intdigest(str(key), 42)) >> 11
            return -math.log((h + 0.5) / 2**53) / own[shard], shard

        return min(map(score, range(len(own))))[1]

    expected = Counter((i, len(t) + 16, zlib.crc32(t.encode()), winner(i, weights), winner(i, [*weights, 3.0])) for i, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.shard, r.grown_shard) for r in found) == expected
    order = defaultdict(list)
    for r in found:
        order[r.shard].append((r.slot, r.doc_id, r.text_crc32))
    for own in order.values():
        assert [s for s, *_ in sorted(own)] == list(range(len(own))) and [x[1:] for x in sorted(own)] == sorted(x[1:] for x in own)


def test_best_fit_against_a_scan_of_all_bins():
    rng = random.Random(4)
    for capacity in (16, 100, 4096):
        sizes = np.array([rng.randint(1, capacity if rng.random() < 0.3 else capacity // 3) for _ in range(400)])
        order = np.argsort(-sizes, kind="stable")
        left: list[int] = []
        for s in sizes[order].tolist():
            able = [(r, k) for k, r in enumerate(left) if r >= s]
            if able:
                left[min(able)[1]] -= s
            else:
                left.append(capacity - s)
        bins = op9_packing.best_fit(sizes, order, capacity)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        assert sorted(capacity - int(sizes[b].sum()) for b in bins) == sorted(left)


def test_pipeline_end_to_end(spark, tmp_path):
    """Texts, copies and packing of the whole pipeline, each stage recomputed by brute force."""
    rows = [(i * 3 - 20, t, ["en", "fr", None][i % 3], ["s1", "s0", None, "s1", "s1"][i % 5], len(t or ""), "x", "y", "z", "n", 1) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {r.doc_id: (r.text, r.source) for r in corpus_pipeline.language(spark, docs, "").collect()}
    assert {i for i, t, *_ in rows if t and any(c.isalpha() for c in t)} >= set(kept)
    sets = {i: shingles(t, 5) for i, (t, _) in kept.items()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    kept = {i: kept[i] for i, root in roots(list(sets), links).items() if root == i}
    first, left = {}, {}
    words = {i: WORD.findall(t) for i, (t, _) in kept.items()}
    for i in sorted(words):
        for p in range(len(words[i]) - 49):
            first.setdefault(tuple(words[i][p : p + 50]), i)
    for i, w in words.items():
        gone = {p + k for p in range(len(w) - 49) if first[tuple(w[p : p + 50])] < i for k in range(50)}
        text = " ".join(x for k, x in enumerate(w) if k not in gone) if gone else kept[i][0]
        if text:
            left[i] = (text, kept[i][1])
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: [*library.encode(t, add_special_tokens=False).ids, 1] for i, (t, _) in left.items()}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    copies = Counter(r.doc_id for r in out if r.piece == 0)
    assert set(copies) <= set(left) and max(copies.values()) <= 2
    for r in out:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert (r.length, r.ids_crc32) == (len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert Counter(r.doc_id for r in out) == Counter({i: n * -(-len(ids[i]) // 4096) for i, n in copies.items()})
    mixed = spark.createDataFrame([(i, t, s) for i, (t, s) in left.items()], "doc_id long, text string, source string")
    assert copies == Counter({r.doc_id: r.copies for r in op7_mixing.mix(mixed, ["doc_id"]).collect() if r.copies})
    used = defaultdict(list)
    for r in out:
        used[r.sequence_id].append((r.offset, r.length))
    for own in used.values():
        ends = np.cumsum([n for _, n in sorted(own)])
        assert [at for at, _ in sorted(own)] == [0, *ends[:-1].tolist()] and ends[-1] <= 4096


def test_no_local_folder_off_local_masters():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError):
        shared_dir(Session())
