"""Token ids as length-delimited binary records with masked checksums and a separate offset index.

File format, little-endian. ``part-*.rec`` holds records one after the other::

    u64 payload length | u32 masked crc32 of those 8 bytes | payload | u32 masked crc32 of the payload
    payload: i64 doc_id | u8 bytes an id (2 or 4) | ids

A null doc_id is written as the least i64. ``part-*.idx`` holds, for each record, its u64 byte offset
in the ``.rec`` file, so that readers can take records in any order. The mask is the rotation by 15
bits plus 0xA282EAD8 that keeps checksums of data that hold checksums apart.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, documents, lean, new_folder
from .encode import encoder

MASK = 0xA282EAD8
NO_ID = -(1 << 63)
#: Rows of a batch that the reader returns.
ROWS = 5_000


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    """One record."""
    payload = struct.pack("<qB", NO_ID if doc_id is None else doc_id, ids.dtype.itemsize) + ids.tobytes()
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def parse(stream) -> tuple[int | None, np.ndarray] | None:
    """The record at the stream's place, or None at its end; ValueError if a checksum differs."""
    head = stream.read(12)
    if not head:
        return None
    n, crc = struct.unpack("<QI", head)
    if masked(head[:8]) != crc:
        raise ValueError("damaged record length")
    payload = stream.read(n)
    if len(payload) != n or struct.unpack("<I", stream.read(4))[0] != masked(payload):
        raise ValueError("damaged record")
    doc_id, width = struct.unpack_from("<qB", payload)
    return None if doc_id == NO_ID else doc_id, np.frombuffer(payload, f"<u{width}", offset=9)


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def read_record(store: fs.FileSystem, path: str, offset: int) -> tuple[int | None, np.ndarray]:
    """The record at a byte offset taken from the index: the way of a shuffled reader."""
    with store.open_input_file(path) as f:
        f.seek(offset)
        return parse(f)


def read_index(store: fs.FileSystem, path: str) -> np.ndarray:
    with store.open_input_stream(path) as f:
        return np.frombuffer(f.read(), "<u8")


def write_records(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 1) -> DataFrame:
    """Write the ids of all documents in ascending doc_id order; return the manifest.

    Documents are range-partitioned by doc_id and sorted within (ties by text), so file after file
    the order is global and only texts move, once. Each partition writes one pair of files whose
    name holds the attempt, so that a task that runs twice never writes over a committed file. The
    manifest has a row for each file that belongs to the result: part, rec, idx, n_records, n_ids;
    it is checkpointed, since computing it writes the files. Null texts are empty and get the end id
    alone; null doc_ids come first; other columns are ignored; an empty table gives no files. A very
    long text is one record: a worker holds its ids, about 4 bytes for each of its bytes.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part = task.partitionId()
        store, base = opened(folder)
        name = f"{base}/part-{part:06d}-{task.taskAttemptId()}"
        out, offsets, at, total = None, [], 0, 0
        try:
            for batch in batches:
                doc_ids, row = batch.column(0).to_pylist(), 0
                for ids, bounds in encoder(tokenizer).encode(batch.column(1), end_id):
                    if out is None:
                        store.create_dir(base, recursive=True)
                        out = store.open_output_stream(f"{name}.rec")
                    records = []
                    for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                        records.append(frame(doc_ids[row], ids[start:end]))
                        offsets.append(at)
                        at += len(records[-1])
                        row += 1
                    out.write(b"".join(records))
                    total += len(ids)
        finally:
            if out is not None:
                out.close()
        if out is not None:
            with store.open_output_stream(f"{name}.idx") as index:
                index.write(np.array(offsets, "<u8").tobytes())
            head = folder.rstrip("/") + name[len(base) :]
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "rec": [f"{head}.rec"], "idx": [f"{head}.idx"], "n_records": [len(offsets)], "n_ids": [total]}
            )

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return cut(ordered.mapInArrow(lean("op5", run), "part int, rec string, idx string, n_records long, n_ids long"))


def read_back(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every record, read from the files of the manifest.

    ``start`` is the number of ids in all files before plus those before it in its file; the running
    sum over files has a row for each file. Every checksum is verified.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

        for files in batches:
            for f in files.to_pylist():
                store, path = opened(f["rec"])
                start, rows = f["base"], []
                with store.open_input_stream(path, buffer_size=1 << 20) as stream:
                    while (record := parse(stream)) is not None:
                        doc_id, ids = record
                        rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(rows) >= ROWS:
                            yield batch(rows)
                            rows = []
                if rows:
                    yield batch(rows)

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))
    spread = files.select("rec", "base").repartition(max(1, manifest.count()))
    return spread.mapInArrow(lean("op5", run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    manifest = write_records(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), new_folder(spark, "records"))
    return read_back(manifest)
