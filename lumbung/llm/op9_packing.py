"""Best-fit packing of token sequences by hierarchical residual packing."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import cut, documents, lean
from .encode import MEMO_ENTRIES, encoder

CAPACITY = 4096
#: A bin with at most this share of its capacity free is emitted before the last round.
NEARLY_FULL = 0.002
#: Items that one task packs at once, here and in later rounds.
ITEMS = 50_000

_MEMBER = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_BINS = pa.schema([("bin", pa.int64()), ("size", pa.int64()), ("done", pa.bool_()), ("members", pa.list_(_MEMBER))])
_BINS_SQL = "bin long, size long, done boolean, members array<struct<doc_id long, piece int, start long, length long, ids_crc32 long>>"


def best_fit(sizes: np.ndarray, order: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: ``order`` lists the items, largest first; each bin lists its items.

    ``free`` holds the distinct residuals in use, sorted: at most ``capacity`` of them, so an item
    costs a binary search and no scan of the bins.
    """
    bins: list[list[int]] = []
    by_residual: dict[int, list[int]] = {}
    free: list[int] = []
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        at = bisect_left(free, size)
        if at < len(free):
            residual = free[at]
            stack = by_residual[residual]
            b = stack.pop()
            if not stack:
                del by_residual[residual]
                free.pop(at)
            bins[b].append(i)
        else:
            residual, b = capacity, len(bins)
            bins.append([i])
        if rest := residual - size:
            if rest in by_residual:
                by_residual[rest].append(b)
            else:
                by_residual[rest] = [b]
                insort(free, rest)
    return bins


class _Packer:
    """Packs the items of one task and yields bins as record batches."""

    def __init__(self, level: int, capacity: int, slack: float):
        self.base = (level << 56) | (TaskContext.get().partitionId() << 32)
        self.capacity, self.full, self.n = capacity, capacity - int(capacity * slack), 0

    def pack(self, sizes: np.ndarray, lists: pa.ListArray) -> pa.RecordBatch:
        """Each item is a list of members. Ties of size go by the first member, so reruns agree."""
        members = lists.flatten()
        starts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        first = members.take(pa.array(starts[:-1]))
        keys = [first.field(k).to_numpy(zero_copy_only=False) for k in ("doc_id", "start")]
        order = np.lexsort((keys[1], keys[0], -sizes))
        bins = best_fit(sizes, order, self.capacity)
        flat = np.fromiter((i for b in bins for i in b), np.int64)
        counts = np.diff(starts)[flat]
        picks = np.repeat(starts[:-1][flat] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
        per_bin = np.add.reduceat(counts, np.concatenate(([0], np.cumsum([len(b) for b in bins])[:-1])))
        size = np.add.reduceat(sizes[flat], np.concatenate(([0], np.cumsum([len(b) for b in bins])[:-1])))
        ids = self.base + self.n + np.arange(len(bins))
        self.n += len(bins)
        offsets = pa.array(np.concatenate(([0], np.cumsum(per_bin))), pa.int32())
        out = pa.ListArray.from_arrays(offsets, members.take(pa.array(picks)))
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(size), pa.array(size >= self.full), out], schema=_BINS)


def _pieces(batch: pa.RecordBatch, tokenizer: str, end_id: int, capacity: int, memo: int) -> Iterator[pa.StructArray]:
    """The pieces of a batch's documents, for some documents at a time."""
    doc_ids, row = batch.column(0), 0
    for ids, bounds in encoder(tokenizer, memo).encode(batch.column(1), end_id):
        sizes = np.diff(bounds)
        pieces = -(-sizes // capacity)
        doc = np.repeat(np.arange(len(sizes)), pieces)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = piece * capacity
        length = np.minimum(capacity, sizes[doc] - start)
        data, at = memoryview(ids.astype("<u4")).cast("B"), (bounds[doc] + start) * 4
        crc = [zlib.crc32(data[i:j]) for i, j in zip(at.tolist(), (at + length * 4).tolist(), strict=True)]
        columns = (doc_ids.slice(row, len(sizes)).take(pa.array(doc)), piece.astype(np.int32), start, length, np.array(crc, np.int64))
        yield pa.StructArray.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=[f.name for f in _MEMBER])
        row += len(sizes)


def _first_round(tokenizer: str, end_id: int, capacity: int, slack: float, memo: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, held = _Packer(0, capacity, slack), []

        def packed() -> pa.RecordBatch:
            members = pa.concat_arrays(held)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(members) + 1), pa.int32()), members)
            return packer.pack(members.field("length").to_numpy(), lists)

        for batch in batches:
            for pieces in _pieces(batch, tokenizer, end_id, capacity, memo):
                held.append(pieces)
                if sum(map(len, held)) >= ITEMS:
                    yield packed()
                    held = []
        if held:
            yield packed()

    return run


def _later_round(level: int, capacity: int, slack: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, held, n = _Packer(level, capacity, slack), [], 0

        def packed() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            lists = table.column(1).chunk(0)
            return packer.pack(table.column(0).to_numpy(), lists)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= 4 * ITEMS:
                yield packed()
                held, n = [], 0
        if held:
            yield packed()

    return run


def _placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(1)
        members = lists.flatten()
        starts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        lengths = members.field("length").to_numpy()
        before = np.concatenate(([0], np.cumsum(lengths)))
        counts = np.diff(starts)
        offset = before[:-1] - np.repeat(before[starts[:-1]], counts)
        yield pa.RecordBatch.from_arrays(
            [*(members.field(f.name) for f in _MEMBER), pa.array(np.repeat(batch.column(0).to_numpy(), counts)), pa.array(offset)],
            names=[*(f.name for f in _MEMBER), "sequence_id", "offset"],
        )


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1, nearly_full: float = NEARLY_FULL, items: int = ITEMS, memo: int = MEMO_ENTRIES) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens; a row for each piece.

    A document's ids and ``end_id`` form its tokens; only documents longer than ``capacity`` are cut,
    into pieces of that length and a rest. Round 0 tokenizes and packs each partition's pieces
    best-fit and emits nearly full bins, before any shuffle. The bins left are the items of the next
    round, in fewer partitions, and so on down the tree until one partition holds them all or a round
    over partitions of full size no longer saves bins; then the rest is emitted too. Only ids, lengths
    and checksums move. A round's bins are checkpointed.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null texts are empty: one
    piece with the end id. ``memo`` is the number of words whose ids a worker keeps. Repeated rows are
    packed once each; null doc_ids stay null; other columns are ignored; an empty table gives no rows.
    Of a very long text a worker holds the ids, about 8 bytes for each of its bytes.
    """
    done: list[DataFrame] = []
    bins = cut(docs.select("doc_id", "text").mapInArrow(lean("op9", _first_round(tokenizer, end_id, capacity, nearly_full, memo)), _BINS_SQL))
    parts, level, before = None, 0, None
    while True:
        level += 1
        done.append(bins.filter("done"))
        rest = bins.filter("not done")
        n = rest.count()
        fair = -(-n // items)
        if n == 0 or parts == 1 or (before is not None and parts == fair and n > 0.98 * before):
            done.append(rest)
            break
        parts = max(1, fair)
        before = n
        bins = cut(rest.repartition(parts, "bin").select("size", "members").mapInArrow(lean("op9", _later_round(level, capacity, nearly_full)), _BINS_SQL))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return out.select("bin", "members").mapInArrow(lean("op9", _placed), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
