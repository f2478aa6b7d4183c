"""Removal of long word runs that an earlier document holds, by fixed-block anchors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, lean, release
from .shingles import mixed, run_hashes, word_hashes, words_of

#: Words of a window; of a block: every window then holds a whole aligned block.
WINDOW, BLOCK = 50, 25
#: Hashes that a task holds at once, and those that a segment is meant for.
GROUP, SEGMENT = 400_000, 1_000_000
#: Bits of the anchor filter for each anchor, and at most (64 MB); slots of an anchor, by these factors.
BITS_EACH, MOST_BITS, FACTORS = 32, 1 << 29, (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
#: Bytes of spans up to which they are broadcast; beyond, they are joined by shuffle.
MOST_BYTES = 32_000_000
#: Bits of a hash that go beside its segment, and the most segments. A task holds at least EACH_SEGMENT
#: hashes for each segment, so that rows of the shuffle stay long when segments are many.
KEY_BITS, MOST_SEGMENTS, EACH_SEGMENT = 30, 1 << 18, 8


def _segments(rows: int, each: int) -> int:
    return min(MOST_SEGMENTS, 1 << max(6, int(rows * each / SEGMENT).bit_length()))


def _groups(batches: Iterable[pa.RecordBatch], window: int, segments: int) -> Iterator[list[tuple[int, int, np.ndarray]]]:
    """(doc_id, tie, word hashes) of documents that have a window, some at a time."""
    group, n, most = [], 0, max(GROUP, EACH_SEGMENT * segments)
    for batch in batches:
        for doc_id, text, tie in zip(*batch.columns, strict=True):
            words = words_of(text.as_py())
            if len(words) >= window and doc_id.is_valid:
                group.append((doc_id.as_py(), tie.as_py(), word_hashes(words)))
                n += len(words)
                if n >= most:
                    yield group
                    group, n = [], 0
    if group:
        yield group


def _by_segment(segment: np.ndarray, count: int) -> Iterator[tuple[int, slice]]:
    """Slices of each segment present in an array sorted by segment."""
    ends = np.searchsorted(segment, np.arange(count + 1))
    for s in np.flatnonzero(np.diff(ends)).tolist():
        yield s, slice(ends[s], ends[s + 1])


def _streamed(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """The rows of each segment, from rows sorted by segment."""
    now, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["segment"] != now:
                if rows:
                    yield now, rows
                now, rows = row["segment"], []
            rows.append(row)
    if rows:
        yield now, rows


def _slots(keys: np.ndarray, each: int) -> Iterator[np.ndarray]:
    """The slots of keys within a segment of ``each`` (a power of two) bits, one array for each factor."""
    for factor in FACTORS:
        yield (keys.astype(np.uint32) * np.uint32(factor)) >> np.uint32(33 - each.bit_length())


def _dealt(df: DataFrame) -> DataFrame:
    return df.repartition("segment").sortWithinPartitions("segment")


def _anchors(texts: DataFrame, window: int, block: int, segments: int) -> DataFrame:
    """segment, keys of the anchors: hashes of blocks that are aligned in one document and are in another.

    Every document gives its aligned blocks (the index) and all its rolling runs of a block's length
    (the probes), deduplicated where they are made. A segment of the hash space meets in one task.
    """
    bits = segments.bit_length() - 1

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, window, segments):
            runs = [run_hashes(h, block) for _, _, h in group]
            lengths = np.array([len(r) for r in runs])
            h = np.concatenate(runs)
            place = np.arange(len(h)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            doc = np.repeat(np.arange(len(runs), dtype=np.uint32), lengths)
            h = h >> np.uint64(64 - bits - KEY_BITS)
            order = np.argsort(h, kind="stable")
            h, doc, aligned = h[order], doc[order], (place % block == 0)[order]
            first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            last = np.concatenate((first[1:], [len(h)])) - 1
            several = doc[first] != doc[last]
            flagged = ((h[first] & np.uint64((1 << KEY_BITS) - 1)) << np.uint64(2)).astype(np.uint32)
            flagged |= np.logical_or.reduceat(aligned, first).astype(np.uint32) | (several.astype(np.uint32) << 1)
            out = [(s, flagged[at].tobytes()) for s, at in _by_segment(h[first] >> np.uint64(KEY_BITS), segments)]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.int32()), pa.array([d for _, d in out], pa.binary())], names=["segment", "keys"])

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for segment, rows in _streamed(batches):
            v = np.concatenate([np.frombuffer(r["keys"], np.uint32) for r in rows])
            v.sort()
            key = v >> 2
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            flags = np.bitwise_or.reduceat(v & 3, first)
            many = np.diff(np.concatenate((first, [len(v)]))) > 1
            found = key[first][((flags & 1) != 0) & (many | ((flags & 2) != 0))]
            yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([len(found)], pa.int64()), pa.array([found.tobytes()], pa.binary())], names=["segment", "n", "keys"])

    return cut(_dealt(texts.mapInArrow(lean("op10", emit), "segment int, keys binary")).mapInArrow(lean("op10", meet), "segment int, n long, keys binary"))


def _filter(anchors: DataFrame, segments: int) -> tuple[np.ndarray, int]:
    """Bitmap of the anchors and the bits of a segment. Its size is bounded by MOST_BITS at any scale;
    with fewer bits an anchor it only lets more windows through to the exact step."""
    n = anchors.agg(F.sum("n")).first()[0] or 0
    each = max(64, 1 << max(0, (min(n * BITS_EACH, MOST_BITS) // segments).bit_length()))
    each = min(each, MOST_BITS // segments)

    def bits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = np.zeros(each, bool)
                for slots in _slots(np.frombuffer(row["keys"], np.uint32), each):
                    own[slots] = True
                yield pa.RecordBatch.from_arrays([pa.array([row["segment"]], pa.int32()), pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())], names=["segment", "bits"])

    out = np.zeros((segments, each // 8), np.uint8)
    for segment, data in anchors.filter("n > 0").mapInArrow(lean("op10", bits), "segment int, bits binary").toLocalIterator():
        out[segment] = np.frombuffer(data, np.uint8)
    return out.reshape(-1), each


def repeated_spans(docs: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """doc_id, tie, spans of the documents that have words to remove.

    ``spans`` lists starts and ends of the maximal runs covered by windows that also start in a
    document with a smaller doc_id; ``tie`` is a hash of the text. 1. Aligned blocks are probed with
    every rolling run; what two documents share is an anchor. 2. Windows that hold an anchor are
    extended to whole windows: their hashes meet by segment, and the least doc_id of each window
    decides. Windows are equal if two independent hashes of 64 and 32 bits are: among 10**13 windows,
    two different ones agree with odds of about 1 in 1,500. 3. The windows found meet by document and are merged into maximal spans. Copies
    of a text within a task are settled there, so a large group of copies sends few windows.
    """
    if 2 * block - 1 > window:
        raise ValueError("a window must hold a whole aligned block: 2 * block - 1 <= window")
    spark = docs.sparkSession
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    rows = docs.count()
    segments, wide = _segments(rows, 600), _segments(rows, 200)
    anchors = _anchors(texts, window, block, segments)
    release(spark)
    bitmap, each = _filter(anchors, segments)
    shared = spark.sparkContext.broadcast(bitmap)
    bits, wide_bits = segments.bit_length() - 1, wide.bit_length() - 1

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for group in _groups(batches, window, wide):
            least: dict[tuple[int, int], int] = {}
            for doc_id, tie, h in group:
                key = (tie, len(h))
                least[key] = min(doc_id, least.get(key, doc_id))
            told, whole, ids, ties, hashes, checks, places, owners = set(), [], [], [], [], [], [], []
            for doc_id, tie, h in group:
                key = (tie, len(h))
                if doc_id > least[key]:
                    whole.append((doc_id, tie, len(h)))
                    continue
                if key in told:
                    continue
                told.add(key)
                run = run_hashes(h, block) >> np.uint64(64 - bits - KEY_BITS)
                base, hit = (run >> np.uint64(KEY_BITS)) * np.uint64(each), np.uint8(1)
                for slots in _slots(run & np.uint64((1 << KEY_BITS) - 1), each):
                    at = base + slots
                    hit = hit & (known[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8))
                before = np.concatenate(([0], np.cumsum(hit, dtype=np.int32)))
                found = np.flatnonzero(before[window - block + 1 :] > before[: len(before) - (window - block + 1)])
                if len(found):
                    hashes.append(run_hashes(h, window)[found])
                    checks.append((run_hashes(h, window, 1)[found] >> np.uint64(32)).astype(np.uint32))
                    places.append(found.astype(np.uint32))
                    owners.append(np.full(len(found), len(ids), np.uint32))
                    ids.append(doc_id)
                    ties.append(tie)
            out = []
            if hashes:
                h, check, place, owner = map(np.concatenate, (hashes, checks, places, owners))
                segment = (h >> np.uint64(64 - wide_bits)).astype(np.uint16 if wide <= 1 << 16 else np.uint32)
                order = np.argsort(segment, kind="stable")
                h, check, place, owner, segment = h[order], check[order], place[order], owner[order], segment[order]
                id_table, tie_table = np.array(ids, np.int64), np.array(ties, np.int64)
                for s, part in _by_segment(segment, wide):
                    used, index = np.unique(owner[part], return_inverse=True)
                    out.append((s, h[part].tobytes(), check[part].tobytes(), index.astype(np.uint32).tobytes(), place[part].tobytes(), id_table[used].tobytes(), tie_table[used].tobytes()))
            if whole:
                w = np.array(whole, np.int64)
                out.append((int(w[0, 0]) % wide, None, None, None, w[:, 2].tobytes(), w[:, 0].tobytes(), w[:, 1].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), *[pa.binary()] * 6), strict=True)], names=["segment", "hash", "check", "owner", "place", "ids", "ties"])

    def dealt_by_document(ids: np.ndarray, ties: np.ndarray, starts: np.ndarray, lengths: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        """Runs by document: each document once with the number of its runs, then 4 bytes a run."""
        part = (mixed(ids.view(np.uint64)) >> np.uint64(64 - wide_bits)).astype(np.int64)
        order = np.lexsort((starts, ties, ids, part))
        part, ids, ties, starts = part[order], ids[order], ties[order], starts[order].astype(np.uint32)
        new = np.concatenate(([True], (ids[1:] != ids[:-1]) | (ties[1:] != ties[:-1])))
        out = []
        for s, at in _by_segment(part, wide):
            own = np.flatnonzero(new[at])
            counts = np.diff(np.concatenate((own, [at.stop - at.start]))).astype(np.uint32)
            long = None if lengths is None else lengths[order][at].astype(np.uint32).tobytes()
            out.append((s, ids[at][own].tobytes(), ties[at][own].tobytes(), counts.tobytes(), starts[at].tobytes(), long))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), *[pa.binary()] * 5), strict=True)], names=["segment", "ids", "ties", "counts", "starts", "lengths"])

    def decide(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _streamed(batches):
            h, check, ids, ties, place = [], [], [], [], []
            for r in rows:
                table, tie = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["ties"], np.int64)
                if r["hash"] is None:
                    n = np.frombuffer(r["place"], np.int64)
                    yield from dealt_by_document(table, tie, np.zeros(len(n), np.int64), n)
                    continue
                owner = np.frombuffer(r["owner"], np.uint32)
                h.append(np.frombuffer(r["hash"], np.uint64)), check.append(np.frombuffer(r["check"], np.uint32)), place.append(np.frombuffer(r["place"], np.uint32))
                ids.append(table[owner]), ties.append(tie[owner])
            if not h:
                continue
            h, check, ids, ties, place = map(np.concatenate, (h, check, ids, ties, place))
            order = np.argsort(h, kind="stable")
            if ((h[order][1:] == h[order][:-1]) & (check[order][1:] != check[order][:-1])).any():
                order = np.lexsort((check, h))
            h, check, ids, ties, place = h[order], check[order], ids[order], ties[order], place[order].astype(np.int64)
            first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (check[1:] != check[:-1]))))
            least = np.repeat(np.minimum.reduceat(ids, first), np.diff(np.concatenate((first, [len(h)]))))
            gone = ids > least
            if gone.any():
                yield from dealt_by_document(ids[gone], ties[gone], place[gone], None)

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _streamed(batches):
            counts = np.concatenate([np.frombuffer(r["counts"], np.uint32) for r in rows])
            ids, ties = (np.repeat(np.concatenate([np.frombuffer(r[k], np.int64) for r in rows]), counts) for k in ("ids", "ties"))
            runs = [np.frombuffer(r["starts"], np.uint32) for r in rows]
            lengths = np.concatenate([np.full(len(x), window, np.int64) if r["lengths"] is None else np.frombuffer(r["lengths"], np.uint32) for r, x in zip(rows, runs, strict=True)])
            starts = np.concatenate(runs).astype(np.int64)
            ends = starts + lengths
            order = np.lexsort((starts, ties, ids))
            ids, ties, starts, ends = ids[order], ties[order], starts[order], ends[order]
            new_doc = np.concatenate(([True], (ids[1:] != ids[:-1]) | (ties[1:] != ties[:-1])))
            # Ends rise with starts, save for whole documents, whose span holds every other of theirs.
            group = np.cumsum(new_doc) - 1
            top = np.maximum.accumulate(ends + group * (1 << 40)) - group * (1 << 40)
            fresh = new_doc.copy()
            fresh[1:] |= starts[1:] > top[:-1]
            at = np.flatnonzero(fresh)
            spans = np.stack((starts[at], top[np.concatenate((at[1:], [len(ids)])) - 1]), axis=1).reshape(-1)
            own = np.flatnonzero(new_doc[at])
            offsets = np.concatenate((own * 2, [len(spans)]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[at][own]), pa.array(ties[at][own]), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(spans.astype(np.int32)))], names=["doc_id", "tie", "spans"]
            )

    windows = texts.mapInArrow(lean("op10", emit), "segment int, hash binary, check binary, owner binary, place binary, ids binary, ties binary")
    decided = _dealt(windows).mapInArrow(lean("op10", decide), "segment int, ids binary, ties binary, counts binary, starts binary, lengths binary")
    out = cut(_dealt(decided).mapInArrow(lean("op10", merge), "doc_id long, tie long, spans array<int>"))
    release(spark)
    return out


def remove_repeats(docs: DataFrame, keep: list[str], window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """``keep`` columns of every document with n_words, n_removed and kept_text.

    ``kept_text`` joins the words kept by one space; it is null if nothing is removed, since the text
    then stands as it is. Null texts have no words; texts shorter than a window lose none. Copies of a
    text lose all words but in the least doc_id; rows with one doc_id never take from each other. Rows
    without a doc_id lose nothing and take nothing. Empty tables give no rows. A column of ``keep``
    named like one of ours gives way to ours. Of a very long text a worker holds its words. Spans are
    broadcast up to MOST_BYTES, and else joined by shuffle.
    """
    keep = [c for c in keep if c not in ("n_words", "n_removed", "kept_text")]
    spans = repeated_spans(docs, window, block)
    n, ends = spans.agg(F.count("*"), F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()
    small = 40 * n + 4 * ends <= MOST_BYTES
    spans = spans.select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"), F.col("spans").alias("_spans"))
    own = docs.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(keep)], F.col("doc_id").alias("_doc"), F.col("text").alias("_text"))
    joined = own.join(F.broadcast(spans) if small else spans, (F.col("_doc") == F.col("_id")) & (F.xxhash64("_text") == F.col("_tie")), "left")
    first = joined.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(keep)], F.col("_text"), F.col("_spans"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, kept = [], [], []
            for text, spans in zip(batch.column(len(keep)), batch.column(len(keep) + 1), strict=True):
                words = words_of(text.as_py())
                total.append(len(words))
                cuts = spans.as_py() if spans.is_valid else None
                if not cuts:
                    removed.append(0), kept.append(None)
                    continue
                left, at = [], 0
                for start, end in zip(cuts[::2], cuts[1::2], strict=True):
                    left += words[at:start]
                    at = end
                left += words[at:]
                removed.append(len(words) - len(left))
                kept.append(b" ".join(left).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=[*keep, "n_words", "n_removed", "kept_text"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in first.schema.fields[: len(keep)])
    return first.mapInArrow(lean("op10", run), f"{schema}, n_words long, n_removed long, kept_text string")


def kept_digest(df: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 from the rows of :func:`remove_repeats` that keep text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = []
            for text, kept in zip(batch.column("text"), batch.column("kept_text"), strict=True):
                data = kept.as_py().encode("utf-8", "surrogatepass") if kept.is_valid else b" ".join(words_of(text.as_py()))
                digests.append(hashlib.sha256(data).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), batch.column("n_removed"), pa.array(digests)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return df.mapInArrow(lean("op10", run), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_digest(remove_repeats(documents(spark, sf_dir), ["doc_id", "text"]))


SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), windows AS MATERIALIZED (
  SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM w)
), first AS (SELECT h, min(doc_id) AS first FROM windows GROUP BY h
), gone AS (
  SELECT doc_id, list(DISTINCT p + k) AS gone FROM (SELECT doc_id, p, unnest(range(50)) AS k FROM windows JOIN first USING (h) WHERE doc_id > first) GROUP BY doc_id
), kept AS (
  SELECT doc_id, array_to_string(list(x ORDER BY i), ' ') AS kept FROM (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w) u
  WHERE NOT EXISTS (FROM (SELECT doc_id, unnest(gone) AS i FROM gone) g WHERE g.doc_id = u.doc_id AND g.i = u.i) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
