"""Runs of words that repeat with a period, found behind a mask of repeated k-grams."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, lean, small_batches
from .shingles import mixed, numbered, run_hashes, words_of

#: Words of the shortest run.
LEAST = 12
Run = tuple[int, int, int]
Edit = Callable[[int | None, list[bytes]], list[bytes]]
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def overlap(least: int) -> int:
    """Words that a run of at least max(least, 2 * period) words has in common with itself, moved on by
    its period, at least: max(least, 2q) - q is smallest at q = least // 2."""
    return -(-least // 2)


def surviving(x: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Stretches of at least ``least`` words in which every word is in a k-gram that recurs in the text.

    ``x`` numbers the text's words, equal words alike.

    k is the least overlap. A run equals itself moved by its period in ``length - period >= k`` words, so
    every k-gram of that overlap recurs; as a run has two periods, overlap and moved overlap cover it. So
    words outside join no run. K-grams meet by 64-bit hashes: chance matches only let more words survive.
    """
    k = overlap(least)
    if len(x) < least:
        return []
    grams = run_hashes(mixed(x.astype(np.uint64)), k)
    order = np.argsort(grams)
    same = grams[order][1:] == grams[order][:-1]
    if not same.any():
        return []
    recurs = np.zeros(len(grams), bool)
    recurs[order[1:][same]] = True
    recurs[order[:-1][same]] = True
    steps = np.zeros(len(x) + 2, np.int64)  # +1 where a word begins to be covered, -1 past its end
    at = np.flatnonzero(recurs)
    np.add.at(steps, at + 1, 1)
    np.add.at(steps, at + k + 1, -1)
    edges = np.flatnonzero(np.diff((np.cumsum(steps) > 0).astype(np.int8)))
    return [(a, b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if b - a >= least]


def _z(x: list[int]) -> list[int]:
    """For each place, how many items from there equal the first items; the first place has all."""
    n = len(x)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        else:
            k = 0
        while i + k < n and x[k] == x[i + k]:
            k += 1
        z[i], left, right = k, i, i + k
    if n:
        z[0] = n
    return z


def _crossing(x: list[int], lo: int, mid: int, hi: int, least: int) -> Iterator[Run]:
    """(start, end, period) of repetitions within [lo, hi) that have a whole period on one side of mid."""
    u, v = x[lo:mid], x[mid:hi]
    a, b = len(u), len(v)
    back, both = u[::-1], x[lo:hi]
    into_u, into_v = _z([*back, -1, *reversed(both)]), _z([*v, -1, *both])
    ahead_v, back_u = [*into_v[:b], 0], [*into_u[:a], 0]  # what stands before the mark is the pattern itself
    for q in range(1, b + 1):  # a period to the right: v against v moved by q, u against what ends at q
        right, left = ahead_v[q], into_u[a + 1 + b - q]
        if left + right >= q and left + right + q >= least:
            yield mid - left, mid + q + right, q
    for q in range(1, a + 1):  # a period to the left
        left, right = back_u[q], into_v[b + 1 + a - q]
        if left + right >= q and left + right + q >= least:
            yield mid - q - left, mid + right, q


def runs_of(x: list[int], least: int) -> list[Run]:
    """All runs (start, length, smallest period) of a sequence by Main and Lorentz's halving.

    A run crosses the middle of one part, where the longest extensions for every period give it in
    linear time. What a neighbour within ``x`` extends was cut off by a part's edge and is found whole in
    a larger part. Multiples of a period give the same stretch: the smallest stays.
    """
    n, found = len(x), {}
    parts = [(0, n)]
    while parts:
        lo, hi = parts.pop()
        if hi - lo < least:
            continue
        mid = (lo + hi) // 2
        parts += [(lo, mid), (mid, hi)]
        for start, end, q in _crossing(x, lo, mid, hi, least):
            if (start == 0 or x[start - 1] != x[start - 1 + q]) and (end == n or x[end] != x[end - q]):
                found[start, end] = min(q, found.get((start, end), q))
    return [(start, end - start, q) for (start, end), q in sorted(found.items())]


def text_runs(words: list[bytes], least: int = LEAST) -> list[Run]:
    """Runs (start, length, period) of a text's words, by start and then period."""
    out, x = [], numbered(words)
    for start, end in surviving(x, least):
        out += [(start + s, length, q) for s, length, q in runs_of(x[start:end].tolist(), least)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic_runs(docs: DataFrame, keep: list[str], least: int = LEAST, edit: Edit | None = None) -> DataFrame:
    """Columns of ``keep``, n_words, runs and collapsed of every document.

    ``runs`` lists start (word number from 0), length and smallest period of every maximal stretch of
    words with length >= max(least, 2 * period), by start and then period. ``collapsed`` joins the words
    by one space, without those that any run holds after its first period. ``edit`` may change a
    document's words first, given doc_id and words.

    A document is worked on where it is read: nothing is shuffled, and a lost task is simply run anew.
    Null, empty and wordless texts have no words, no runs and an empty ``collapsed``. Repeated rows are
    documents of their own; ties of any kind cannot arise, as every run is returned. A null doc_id is
    passed to ``edit`` as None. Columns of ``keep`` named like ours give way to ours. Empty tables give
    no rows. Of a very long text a worker holds its words and, for surviving stretches, a few numbers a
    word; time is n log n in those.
    """
    small_batches(docs.sparkSession)
    keep = [c for c in keep if c not in ("n_words", "runs", "collapsed")]
    own = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(keep)], F.col("doc_id").alias("_doc"), F.col("text").alias("_text"))
    carried = own.select(*own.columns[:-2])
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in carried.schema], "n_words long", "runs array<struct<start:long,length:long,period:long>>", "collapsed string"])

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, runs, texts = [], [], []
            for doc_id, text in zip(batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1), strict=True):
                words = words_of(text.as_py())
                if edit is not None:
                    words = edit(doc_id.as_py(), words)
                own = text_runs(words, least)
                counts.append(len(words))
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in own])
                if own:
                    gone = np.zeros(len(words), bool)
                    for s, n, q in own:
                        gone[s + q : s + n] = True
                    words = [words[i] for i in np.flatnonzero(~gone).tolist()]
                texts.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            found = [pa.array(counts, pa.int64()), pa.array(runs, _RUNS), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *found], names=[*batch.schema.names[:-2], "n_words", "runs", "collapsed"])

    out = own.mapInArrow(lean("op13", find), schema)
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(keep)], "n_words", "runs", "collapsed")


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The query's stated edit: a tenth of the documents repeat a stretch of theirs to the end."""
    n, h = len(words), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def digests(found: DataFrame) -> DataFrame:
    """doc_id, number of runs, the longest run (ties: least start, then period) and two checksums."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], F.concat(r["period"].cast("string"), F.lit("\n")))), "")
    return found.select("doc_id", "runs", "collapsed", best.alias("best")).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.n")).alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * -best.n div best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(periodic_runs(documents(spark, sf_dir), ["doc_id"], edit=planted))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, doc_id::VARCHAR AS s FROM documents
), h AS (
  SELECT *, len(w) AS n, xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, len(s) + 1), lambda i: ascii(substr(s, i, 1))::BIGINT),
    lambda c, b: list_reduce([xor(c, b)] || range(8), lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384::BIGINT) ELSE y // 2 END)), 4294967295::BIGINT) AS h FROM d
), g AS (
  SELECT *, h % 10 = 0 AND n > 0 AS edited, (h // 10) % greatest(n, 1) AS a, 1 + (n - (h // 10) % greatest(n, 1)) // (3 + (h // 10) % 8) AS p FROM h
), e AS (
  SELECT r, doc_id, n, CASE WHEN edited THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) ELSE w END AS w FROM g
), x AS (
  SELECT r, n, unnest(w) AS word, unnest(range(n)) AS i FROM e
), pairs AS (
  SELECT b.r, b.i - a.i AS q, a.i FROM x a JOIN x b ON a.r = b.r AND a.word = b.word AND a.i < b.i AND 2 * (b.i - a.i) <= a.n
), islands AS (
  SELECT r, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM pairs) GROUP BY r, q, island
), runs AS (
  SELECT r, start, length, min(q) AS q FROM islands WHERE length >= greatest(12, 2 * q) GROUP BY r, start, length
), by_doc AS (
  SELECT r, count(*) AS n_runs, arg_min({'start': start, 'length': length, 'q': q}, {'n': -length, 's': start, 'q': q}) AS best, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS lines FROM runs GROUP BY r
), gone AS (
  SELECT DISTINCT r, unnest(range(start + q, start + length)) AS i FROM runs
), kept AS (
  SELECT x.r, string_agg(word, ' ' ORDER BY x.i) AS t FROM x ANTI JOIN gone ON gone.r = x.r AND gone.i = x.i GROUP BY x.r
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.q AS period, 1000 * best.length // best.q AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM e LEFT JOIN by_doc USING (r) LEFT JOIN kept USING (r)
"""
