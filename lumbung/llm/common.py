"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import functools
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, and what separates words: ASCII white space alone.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: Rows of an Arrow batch where the session says nothing else.
BATCH_ROWS = 2_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``. Only where that is unset and all tasks run on this
    machine (a ``local`` master, as in tests), a temporary folder is made and set.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            named = "file://" + tempfile.mkdtemp(prefix="lumbung-")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """URI of a fresh folder under :func:`shared_dir`."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder, its lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that are no longer referenced."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def settle(spark: SparkSession) -> None:
    """Between stages of a long job: executors collect garbage, so that their heaps shrink to what is in
    use before the Python workers of the next stage need memory beside them. A job of a few empty tasks."""
    release(spark)
    tasks = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, tasks, 1, tasks).filter(F.expr("java_method('java.lang.System', 'gc') = 'never'")).count()


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows, unless the session has its own setting.

    A batch stands in memory twice, in the executor and in its Python worker, for each running task.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def lowered(text: Column) -> Column:
    """``text`` with A-Z lower-cased and nothing else changed."""
    return F.translate(text, UPPER, LOWER)


class KeyRanges:
    """Ranges of an integer key that hold about as many rows each, wherever the keys lie.

    ``count`` ranges, about ``each`` rows a range and at most ``most`` ranges, are made in two levels:
    quantiles of the key cut it into at most COARSE parts, and each part is cut into ranges of equal
    width. So an outlier among the keys widens the ranges of its own part alone. One aggregation over
    the key finds them; ``rows`` counts all rows. An empty table has one range.
    """

    COARSE = 512

    def __init__(self, df: DataFrame, each: int, most: int, key: str = "doc_id"):
        parts = self.COARSE
        cuts = F.percentile_approx(F.col(key).cast("long"), [i / parts for i in range(1, parts)], 32 * parts)
        lo, hi, self.rows, cuts = df.agg(F.min(key), F.max(key), F.count(F.lit(1)), cuts).first()
        wanted = max(1, min(most, self.rows // each))
        step = max(1, parts // wanted)  # fewer ranges than parts: some of the cuts
        self.cuts = [] if wanted == 1 else sorted({x for x in (cuts or [])[step - 1 :: step] if lo < x <= hi})
        self.bounds = [lo or 0, *self.cuts, (hi or 0) + 1]
        self.inner = -(-wanted // len(self.cuts or [0]))
        self.count = (len(self.cuts) + 1) * self.inner

    def of(self, key: Column) -> Column:
        """Number (int) of the range that holds ``key``: it rises with ``key``; null is in the first."""
        if self.count == 1:
            return F.lit(0)
        bounds, last = F.lit(self.bounds), len(self.cuts)
        steps = F.lit([1 << i for i in reversed(range(last.bit_length()))] or [0])
        part = F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= last) & (F.get(bounds, at + s) <= key), at + s).otherwise(at)) if last else F.lit(0)
        if self.inner == 1:
            return F.coalesce(F.when(key.isNotNull(), part), F.lit(0)).cast("int")
        widths = F.lit([max(1, -(-(b - a) // self.inner)) for a, b in zip(self.bounds[:-1], self.bounds[1:], strict=True)])
        within = F.floor((key.cast("decimal(38,0)") - F.get(bounds, part)) / F.get(widths, part))
        within = F.least(within, F.lit(self.inner - 1))  # the quotient is rounded
        return F.coalesce(part * self.inner + within, F.lit(0)).cast("int")


def quiet_threads() -> None:
    """One thread for each Python worker: Spark's tasks already use all cores."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ.setdefault("OMP_NUM_THREADS", "1")


#: What drops the caches of this worker process, and the operator whose tasks filled them.
_droppers: list[Callable[[], None]] = []
_owner: str | None = None


def when_left(drop: Callable[[], None]) -> None:
    """Call ``drop`` in a worker process as soon as a task of another operator runs there."""
    _droppers.append(drop)


@functools.lru_cache(maxsize=1)
def _c_library() -> ctypes.CDLL | None:
    try:
        library = ctypes.CDLL(None)
        return library if hasattr(library, "malloc_trim") else None
    except OSError:
        return None


def give_back() -> None:
    """Return the memory that this process has freed to the machine."""
    pa.default_memory_pool().release_unused()
    if (library := _c_library()) is not None:
        library.malloc_trim(0)


def claim(owner: str) -> None:
    """From now on this process works for ``owner``: what tasks of others have cached is dropped."""
    global _owner
    if _owner != owner:
        for drop in _droppers:
            drop()
        _owner = owner
        gc.collect()


def lean(owner: str, run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for mapInArrow, in worker processes that many stages share: at its start what tasks of
    other operators have cached is dropped, at its end freed memory goes back to the machine."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(owner)
        try:
            yield from run(batches)
        finally:
            give_back()

    return task
