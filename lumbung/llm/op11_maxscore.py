"""Ranked lexical search: an index of postings by shard, and MaxScore within each shard."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, documents, lean, release, small_batches

#: Results of an item.
TOP = 50
#: Documents and postings that close a shard, and shards that a task searches one after the other.
SHARD_DOCS, SHARD_POSTINGS, SHARDS_A_TASK = 32_768, 1_000_000, 16
#: (item, term) pairs, and bytes of their terms, that one pass over the documents answers.
BLOCK_PAIRS, BLOCK_BYTES = 500_000, 16_000_000
_SEPARATORS = bytes(c for c in range(128) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122))
#: Bytes of UTF-8: separators become spaces, A-Z become a-z; bytes of other code points stay.
_TABLE = bytes.maketrans(_SEPARATORS + bytes(range(65, 91)), b" " * len(_SEPARATORS) + bytes(range(97, 123)))


def terms_of(text: str | None) -> list[bytes]:
    """Terms in UTF-8: maximal runs of ASCII letters and digits and of all that is not ASCII, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term: the distinct terms of each item; rows with one item_id are one item."""
    small_batches(items.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, t) for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for t in dict.fromkeys(terms_of(text.as_py()))]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([t for _, t in found], pa.binary())], names=["item_id", "term"])

    return items.select(F.col("item_id").cast("long"), "text").mapInArrow(lean("op11", run), "item_id long, term binary").distinct()


_SHARD = "ids binary, valid binary, lengths binary, terms array<int>, df array<int>, most array<int>, short array<int>, ends array<int>, docs binary, tf binary, n_docs long, n_terms long"


class _Building:
    """The shard being built: documents with their lengths, and (document, term, count) triples."""

    def __init__(self) -> None:
        self.ids, self.lengths, self.keys, self.counts, self.postings = [], [], [], [], 0

    def row(self) -> tuple:
        ids, lengths = np.array([i or 0 for i in self.ids], np.int64), np.array(self.lengths, np.int64)
        valid = np.array([i is not None for i in self.ids], bool)
        none = np.zeros(0, np.int64)
        key, tf = np.concatenate([none, *self.keys]), np.concatenate([none, *self.counts])
        order = np.argsort(key)  # by term, then document
        key, tf = key[order], tf[order]
        term, doc = key >> 32, key & 0xFFFFFFFF
        first = np.flatnonzero(np.diff(term, prepend=-1))
        ends = np.append(first, len(key))[1:]
        most = np.maximum.reduceat(tf, first) if len(first) else none
        short = np.minimum.reduceat(lengths[doc], first) if len(first) else none
        return (
            ids.tobytes(), valid.tobytes(), lengths.tobytes(), term[first], ends - first, most, short, ends,
            doc.astype(np.uint32).tobytes(), tf.astype(np.uint32).tobytes(), int((lengths > 0).sum()), int(lengths.sum()),
        )


def index(docs: DataFrame, vocabulary: dict[bytes, int], shard_docs: int = SHARD_DOCS, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """One row for each shard of documents: ids, lengths and the postings of the vocabulary's terms.

    For each term a shard holds its documents and counts and, for upper bounds, the largest count and
    the least length among them. A partition makes its shards as it reads, each of bounded size, so
    nothing is shuffled. Documents without a term of the vocabulary count in n_docs and n_terms, too.
    """
    spark = docs.sparkSession
    small_batches(spark)
    words = spark.sparkContext.broadcast(vocabulary)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = words.value.get
        shard = _Building()

        def close() -> pa.RecordBatch:
            types = [*[pa.binary()] * 3, *[pa.list_(pa.int32())] * 5, *[pa.binary()] * 2, *[pa.int64()] * 2]
            names = [f.split()[0] for f in _SHARD.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(shard.row(), types, strict=True)], names=names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                terms = terms_of(text.as_py())
                found = np.fromiter(map(number, terms, repeat(-1)), np.int64, len(terms))
                numbers, counts = np.unique(found[found >= 0], return_counts=True)
                shard.keys.append(numbers << 32 | len(shard.ids))
                shard.counts.append(counts)
                shard.ids.append(doc_id)
                shard.lengths.append(len(terms))
                shard.postings += len(numbers)
                if len(shard.ids) >= shard_docs or shard.postings >= shard_postings:
                    yield close()
                    shard = _Building()
        if shard.ids:
            yield close()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean("op11", rows), _SHARD)


class Corpus(NamedTuple):
    """Counts over all documents: those with a term, and their terms."""

    docs: int
    terms: int

    def weight(self, df: int) -> int:
        return math.floor(1000 * math.log((2 * self.docs + 2) / (2 * df + 1)))

    def norms(self, lengths: np.ndarray) -> np.ndarray:
        """What stands beside the count in a score's denominator, 20 times m, for each length."""
        if self.docs * int(lengths.max(initial=0)) >= 1 << 56:  # beyond 64 bits: Python's integers
            return np.array([20 * (50 + 50 * int(n) * self.docs // max(self.terms, 1)) for n in lengths], np.int64)
        return 20 * (50 + 50 * lengths * self.docs // max(self.terms, 1))


def gain(weight: int, tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return weight * (1_000_000_000 * tf // (1000 * tf + norm))


class _Shard:
    """A shard's postings with what its terms add to a score, worked out as terms are asked for."""

    def __init__(self, row: dict, corpus: Corpus, weights: np.ndarray):
        self.ids, self.valid = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["valid"], bool)
        self.norm = corpus.norms(np.frombuffer(row["lengths"], np.int64))
        terms, most = np.array(row["terms"], np.int64), np.array(row["most"], np.int64)
        ends = np.array(row["ends"], np.int64)
        self.docs, self.tf = np.frombuffer(row["docs"], np.uint32), np.frombuffer(row["tf"], np.uint32)
        self.weights = weights
        bounds = weights[terms] * (1_000_000_000 * most // (1000 * most + corpus.norms(np.array(row["short"], np.int64))))
        starts = np.concatenate(([0], ends))[: len(ends)]
        self.lists = {t: (b, s, e) for t, b, s, e in zip(terms.tolist(), bounds.tolist(), starts.tolist(), ends.tolist(), strict=True)}
        self.gains: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def list_of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of a term, rising, and what it adds to each."""
        if term not in self.gains:
            _, a, b = self.lists[term]
            docs = self.docs[a:b].astype(np.int64)
            self.gains[term] = docs, gain(int(self.weights[term]), self.tf[a:b].astype(np.int64), self.norm[docs])
        return self.gains[term]


def search_shard(shard: _Shard, terms: list[int], top: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, documents) of a shard that can be among an item's ``top``: all with a score of at least
    what the ``top``-th reaches, ``floor`` being what ``top`` documents elsewhere reach.

    Terms come from the highest upper bound down. As long as the bounds of the terms that are left reach
    the threshold together, a document with those terms alone could qualify: the list is essential and
    is gone through. From then on the lists are non-essential: they are only probed for documents whose
    score so far and the bounds left reach the threshold. The threshold rises with the scores so far.
    """
    known = sorted(((shard.lists[t][0], t) for t in terms if t in shard.lists), reverse=True)
    left = sum(b for b, _ in known)
    score = np.zeros(len(shard.ids), np.int64)
    threshold, candidates = max(floor, 1), None

    def risen(values: np.ndarray) -> int:
        return max(threshold, int(np.partition(values, len(values) - top)[len(values) - top])) if len(values) >= top else threshold

    for bound, term in known:
        if candidates is None and left < threshold:
            candidates = np.flatnonzero(score + left >= threshold)
        docs, gains = shard.list_of(term)
        left -= bound
        if candidates is None:
            score[docs] += gains
            threshold = risen(score)
            continue
        if not len(candidates):
            break
        at = np.searchsorted(docs, candidates)
        at[at == len(docs)] = 0
        hit = docs[at] == candidates
        score[candidates[hit]] += gains[at[hit]]
        threshold = risen(score[candidates])
        candidates = candidates[score[candidates] + left >= threshold]
    found = np.flatnonzero(score >= threshold) if candidates is None else candidates[score[candidates] >= threshold]
    return score[found], found


class _Best:
    """The ``top`` best (score, doc_id) of an item; of equal scores, the least doc_id, null last."""

    def __init__(self, top: int):
        self.top, self.score, self.ids, self.valid = top, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, score: np.ndarray, ids: np.ndarray, valid: np.ndarray) -> None:
        score, ids, valid = np.concatenate((self.score, score)), np.concatenate((self.ids, ids)), np.concatenate((self.valid, valid))
        order = np.lexsort((ids, ~valid, -score))[: self.top]
        self.score, self.ids, self.valid = score[order], ids[order], valid[order]

    def floor(self) -> int:
        """A score that ``top`` documents reach; below it no other is wanted."""
        return int(self.score[-1]) if len(self.score) == self.top else 0


def _answered(docs: DataFrame, pairs: list, corpus: Corpus | None, top: int, shard_docs: int, shard_postings: int) -> tuple[DataFrame, Corpus]:
    spark = docs.sparkSession
    vocabulary: dict[bytes, int] = {}
    items: dict[int | None, list[int]] = {}
    for item_id, term in pairs:
        items.setdefault(item_id, []).append(vocabulary.setdefault(bytes(term), len(vocabulary)))
    shards = cut(index(docs, vocabulary, shard_docs, shard_postings))
    release(spark)
    count, n_docs, n_terms = shards.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    corpus = corpus or Corpus(n_docs, n_terms)
    each = shards.select(F.explode(F.arrays_zip("terms", "df")).alias("t"))
    df = dict(each.groupBy("t.terms").agg(F.sum("t.df")).collect())  # at most a block's vocabulary
    weights = np.array([corpus.weight(df.get(t, 0)) for t in range(len(vocabulary))], np.int64)
    shared = spark.sparkContext.broadcast((items, weights, corpus))

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, corpus = shared.value
        best = {i: _Best(top) for i in items}
        for batch in batches:
            for k in range(batch.num_rows):
                shard = _Shard({c: batch.column(c)[k].as_py() for c in batch.schema.names}, corpus, weights)
                for item_id, terms in items.items():
                    score, found = search_shard(shard, terms, top, best[item_id].floor())
                    if len(found):
                        best[item_id].add(score, shard.ids[found], shard.valid[found])
        for item_id, b in best.items():
            if len(b.score):
                n = len(b.score)
                yield pa.RecordBatch.from_arrays([pa.array([item_id] * n, pa.int64()), pa.array(b.ids, pa.int64(), mask=~b.valid), pa.array(b.score)], names=["item_id", "doc_id", "score"])

    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-count // SHARDS_A_TASK))
    slim = shards.drop("df", "n_docs", "n_terms").coalesce(tasks)
    return slim.mapInArrow(lean("op11", rows), "item_id long, doc_id long, score long"), corpus


def search(docs: DataFrame, items: DataFrame, top: int = TOP, shard_docs: int = SHARD_DOCS, shard_postings: int = SHARD_POSTINGS, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents of each item by their terms in common.

    The documents are read once: their postings of the items' terms become an index of shards, kept in
    the shared folder, with the counts over all documents. Then every shard gives its best by MaxScore,
    a task carrying each item's threshold from one shard to the next, and the best of all tasks are
    merged: at most ``top`` rows for each item and task. Items are answered in blocks of about
    ``block_pairs`` terms, each broadcast, so nothing that grows with the items is broadcast whole; more
    items than that take another pass.

    Null texts and items without terms have no terms and no rows; fewer rows than ``top`` come back where
    fewer documents score above 0. Rows with one item_id are one item; a null item_id is an item, too.
    Repeated documents score and rank each for themselves. Equal scores rank by doc_id, null last; a rank
    is given once. Other columns are ignored. Empty tables of either kind give no rows. Of a very long
    text a worker holds its terms.
    """
    spark = docs.sparkSession
    pairs = cut(item_terms(items))
    n, size = pairs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
    blocks = max(1, -(-n // block_pairs), -(-size // BLOCK_BYTES))
    block, out, corpus = F.pmod(F.xxhash64("item_id"), F.lit(blocks)), None, None
    for b in range(blocks if n else 0):
        own = pairs.filter(block == b).collect()  # about block_pairs rows
        if own:
            found, corpus = _answered(docs, own, corpus, top, shard_docs, shard_postings)
            out = found if out is None else out.unionAll(found)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    by_score = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return out.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
WITH t AS (
  SELECT r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)
), n AS (
  SELECT r, doc_id, count(*) AS n FROM t GROUP BY r, doc_id
), c AS (
  SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM n
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), p AS (
  SELECT r, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY r, term
), w AS (
  SELECT term, floor(1000 * ln((2 * max(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY term
), g AS (
  SELECT p.r, p.term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // terms))) AS gain FROM p JOIN w USING (term) JOIN n USING (r), c
), s AS (
  SELECT item_id, r, sum(gain)::BIGINT AS score FROM q JOIN g USING (term) GROUP BY item_id, r HAVING sum(gain) > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s JOIN n USING (r)) WHERE rank <= 50
"""
