"""Retrieval where one source holds more points than any fixed number of hits."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lumbung.operators import nearest as N
from lumbung.plans import catalog


@pytest.fixture(scope="module")
def hot(spark, tmp_path_factory):
    """One query (id 0); over a million of its own direction in one source, three poorer points in another."""
    d = str(tmp_path_factory.mktemp("hot"))
    near = spark.range(1_000_010, numPartitions=4).select((F.col("id") * 150 + 3).alias("vec_id"), F.lit("1").alias("label"), F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"))
    far = spark.createDataFrame([(0, "1", [1.0, 0.0]), (9, "2", [1.0, 2.0]), (12, "2", [1.0, 1.0]), (11, "2", [1.0, 1.5])], near.schema)
    near.unionByName(far).write.parquet(f"{d}/embeddings.parquet")
    return d


def test_r4_keeps_a_source_below_a_million_hits(spark, hot):
    found = catalog.QUERIES["r4_nominal_guarantee"](spark, hot).collect()
    assert sorted((r.query_id, r.source, r.vec_id) for r in found) == [(0, "s1", 0), (0, "s2", 12)]


def test_ranks_within_sources_below_a_million_hits(spark, hot):
    points = spark.read.parquet(f"{hot}/embeddings.parquet")
    asked = points.filter("vec_id = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    found = N.nearest(points, asked, 2, None, group="label", each=True).collect()
    assert sorted((r.label, r["rank"], r.vec_id) for r in found) == [("1", 1, 0), ("1", 2, 3), ("2", 1, 12), ("2", 2, 11)]


def cosine(a, b):
    if not a or not b or len(a) != len(b) or any(x is None or not math.isfinite(x) for x in [*a, *b]) or not any(a) or not any(b):
        return None
    dot = lambda x, y: sum(float(p) * float(q) for p, q in zip(x, y, strict=True))
    return dot(a, b) / math.sqrt(dot(a, a) * dot(b, b))


def brute(points, queries, k, threshold, each):
    out = []
    for q, v, text, allowed in queries:
        if not text or not text.strip():
            continue
        groups = {}
        for key, p, g in points:
            s = cosine(p, v)
            if s is not None and (threshold is None or s >= threshold) and (allowed is None or g in allowed):
                groups.setdefault(g if each else 0, []).append((-s, key, g))
        for hits in groups.values():
            out += [(q, key, g, n + 1) for n, (_, key, g) in enumerate(sorted(hits, key=lambda h: h[:2])[:k])]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(7)
    points = [(k, [float(rng.choice([-1, 0, 1, 2])) for _ in range(4)], ["a", "b", None][k % 3]) for k in range(400)]
    points += [(1000 + k, [1.0, 2.0, 0.0, 1.0], "a") for k in range(300)]  # copies over all partitions
    points += [(2000, None, "a"), (2001, [], "a"), (2002, [1.0], "b"), (2003, [float("nan")] * 4, "b"), (2004, [1.0, None, 0.0, 0.0], "b"), (2005, [0.0] * 4, "a"), (2006, [float("inf"), 0.0, 0.0, 0.0], "b")]
    queries = [(k, p, "q", None) for k, p, _ in points[:20]] + [(50, [1.0, 2.0, 0.0, 1.0], "q", ["a"]), (51, [2.0, 4.0, 0.0, 2.0], "q", ["b"]), (52, [1.0, 0.0, 0.0, 0.0], "q", [])]
    queries += [(60, [1.0, 0.0, 0.0, 0.0], " \t", None), (61, [1.0, 0.0, 0.0, 0.0], None, None), (62, None, "q", None), (63, [0.0] * 4, "q", None)]
    return points, queries


@pytest.mark.parametrize("k,threshold,each,block_bytes", [(5, None, False, 64_000_000), (5, 0.9, True, 64_000_000), (3, 0.2, False, 400), (1, None, True, 900)])
def test_nearest(spark, vectors, k, threshold, each, block_bytes):
    points, queries = vectors
    p = spark.createDataFrame(points, "vec_id long, embedding array<double>, g string").repartition(5)
    q = spark.createDataFrame(queries, "query_id long, query_vector array<double>, query_text string, allowed array<string>")
    found = N.nearest(p, q, k, threshold, group="g", each=each, block_bytes=block_bytes).collect()
    assert sorted(((r.query_id, r.vec_id, r.g, r["rank"]) for r in found), key=repr) == brute(points, queries, k, threshold, each)
    assert all(abs(r.score - cosine(dict((x[0], x[1]) for x in points)[r.vec_id], dict((x[0], x[1]) for x in queries)[r.query_id])) < 1e-12 for r in found)
    assert N.nearest(p.filter("false"), q, k, threshold).count() == 0
    assert N.nearest(p, q.filter("false"), k, threshold).count() == 0


def test_no_scored_pair_is_shuffled(spark, vectors):
    points, queries = vectors
    p = spark.createDataFrame(points, "vec_id long, embedding array<double>, g string").repartition(3)
    q = spark.createDataFrame([x[:2] for x in queries], "query_id long, query_vector array<double>")
    plan = N.nearest(p, q, 2, None)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "MapInArrow" in plan


def test_string_keys(spark):
    p = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("c", [0.0, 1.0])], "id string, v array<float>")
    q = spark.createDataFrame([("x", [1.0, 0.0])], "query_id string, query_vector array<float>")
    assert [(r.id, r["rank"]) for r in N.nearest(p, q, 2, None, key="id", vector="v").orderBy("rank").collect()] == [("a", 1), ("b", 2)]
