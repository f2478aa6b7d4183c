"""Exact nearest neighbours as a blocked join: a matrix product in each task, its best k, then a merge."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Bytes of query vectors that one pass over the points broadcasts, query vectors of one matrix product,
#: and hits that a task holds before it hands them on.
BLOCK_BYTES, PRODUCT, MOST_HITS = 64_000_000, 512, 1_000_000
#: How far a matrix product may lie from the sum in order of the components.
SLACK = 1e-9


def matrix(column: pa.Array, size: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(vectors as doubles, rows that are sound): null, empty, of another size, with null or non-finite
    components or zero means not sound; such rows are zeros. Without ``size``, that of the first sound row."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    if size is None:
        size = int(lengths[lengths > 0][0]) if (lengths > 0).any() else 0
    out = np.zeros((len(column), size))
    fits = (lengths == size) & (size > 0)
    flat = column.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become nan
    out[fits] = flat.reshape(-1, size)
    sound = fits & np.isfinite(out).all(axis=1) & out.any(axis=1)
    out[~sound] = 0
    return out, sound


def in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of rows, components added from first to last: equal vectors give equal sums anywhere."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += a[:, k] * b[:, k]
    return total


class _Hits:
    """The best ``k`` hits of each query, or of each query and group, as rows of points."""

    def __init__(self, k: int, key: str, group: str | None):
        self.k, self.group, self.rows = k, group, None
        self.order = [("_q", "ascending"), *([(group, "ascending")] if group else []), ("score", "descending"), (key, "ascending")]

    def add(self, rows: pa.Table) -> None:
        rows = rows if self.rows is None else pa.concat_tables([self.rows, rows])
        rows = rows.take(pc.sort_indices(rows, sort_keys=self.order))
        start = np.diff(rows["_q"].to_numpy(), prepend=-1) != 0
        if self.group:
            code = rows[self.group].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            start |= np.diff(code, prepend=-1) != 0
        first = np.flatnonzero(start)
        place = np.arange(len(start)) - np.repeat(first, np.diff(np.append(first, len(start))))
        self.rows = rows.filter(pa.array(place < self.k))

    def least(self, queries: int) -> np.ndarray:
        """For each query the score that a hit must reach now; only where groups are not told apart."""
        out = np.full(queries, -np.inf)
        if self.rows is not None and not self.group:
            q, score = self.rows["_q"].to_numpy(), self.rows["score"].to_numpy()
            n = np.bincount(q, minlength=queries)
            last = np.cumsum(n) - 1
            full = n >= self.k
            out[full] = score[last[full]]
        return out


def nearest(
    points: DataFrame, queries: DataFrame, k: int, threshold: float | None = 0.8, where: Column | None = None, key: str = "vec_id", vector: str = "embedding",
    group: str | None = None, each: bool = False, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The ``k`` points nearest to each query by cosine in double precision.

    ``queries`` has query_id and query_vector. With a column query_text, queries whose text is null or
    white space have no hits. With a column allowed (array of values of ``group``), a query meets points
    of those groups alone; null allows all. ``each`` ranks within each value of ``group``: k hits a group.

    The queries are dealt into blocks of at most ``block_bytes``, each broadcast for one pass over the
    points. A task multiplies a batch of points with the block, computes what can still be among the best
    in the exact order of components, and keeps k hits a query; only those leave it, and a window merges
    the tasks' hits. So neither points nor scored pairs are shuffled. Scores at the threshold stay; ties
    go by ``key``, also among copies in different tasks, since a score depends on the two vectors alone.

    Vectors that are null, empty, zero, of another size than the query's or hold null or non-finite
    components have no cosine: they hit nothing and are no hits. A null group is a group. Repeated points
    are points of their own. Returned are the points' columns but the vector, query_id, score and rank.
    """
    if "query_text" in queries.columns:
        queries = queries.filter(F.coalesce(F.col("query_text").rlike(r"(?U)\S"), F.lit(False)))
    asked = queries.select("query_id", F.col("query_vector"), *(["allowed"] if "allowed" in queries.columns else []))
    spark, rows = points.sparkSession, points if where is None else points.filter(where)
    carried = [f for f in rows.schema.fields if f.name != vector]
    fields = [*carried, StructField("query_id", asked.schema["query_id"].dataType), StructField("score", DoubleType())]
    own = rows.select(vector, *[f.name for f in carried])
    n, size = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("query_vector").cast("long") * 8 + 64), F.lit(0))).first()
    blocks = max(1, -(-size // block_bytes))
    out = None
    for b in range(blocks if n else 0):
        block = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        found = own.mapInArrow(_matcher(spark.sparkContext.broadcast(block.toArrow()), k, threshold, key, vector, group, each), StructType(fields))
        out = found if out is None else out.unionAll(found)
    if out is None:
        out = spark.createDataFrame([], StructType(fields))
    by = ["query_id", *([group] if each else [])]
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), key))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k)


def _matcher(shared, k: int, threshold: float | None, key: str, vector: str, group: str | None, each: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: pa.Table = shared.value
        q, sound = matrix(block["query_vector"])
        ids = block["query_id"].combine_chunks()
        lists = block["allowed"].to_pylist() if "allowed" in block.column_names else None
        q_square = in_order(q, q)
        units = q / np.sqrt(np.where(sound, q_square, 1))[:, None]
        hits = _Hits(k, key, group if each else None)

        def handed_on() -> Iterator[pa.RecordBatch]:
            if hits.rows is not None:
                rows = hits.rows
                rows = rows.append_column("query_id", ids.take(rows["_q"])).drop_columns("_q")
                rows = rows.select([*[c for c in rows.column_names if c not in ("query_id", "score")], "query_id", "score"])
                yield from rows.combine_chunks().to_batches(max_chunksize=10_000)
                hits.rows = None

        for batch in batches:
            points, fine = matrix(batch.column(0), q.shape[1])
            at = np.flatnonzero(fine)
            if not len(at) or not sound.any():
                continue
            m = points[at]
            square = in_order(m, m)
            scaled = m / np.sqrt(square)[:, None]
            names = batch.column(batch.schema.get_field_index(group)).take(pa.array(at)).to_pylist() if group else None
            parts = [np.arange(len(at))]
            if each:
                code = np.unique([repr(x) for x in names], return_inverse=True)[1]
                order = np.argsort(code, kind="stable")
                parts = np.split(order, np.flatnonzero(np.diff(code[order])) + 1)
            least = hits.least(len(q))
            found_q, found_p, found_s = [], [], []
            for lo in range(0, len(q), PRODUCT):
                product = units[lo : lo + PRODUCT] @ scaled.T
                product[~sound[lo : lo + PRODUCT]] = -np.inf
                if lists is not None:
                    for i, allowed in enumerate(lists[lo : lo + PRODUCT]):
                        if allowed is not None:
                            own = set(allowed)
                            product[i, [x not in own for x in names]] = -np.inf
                for part in parts:
                    near = product[:, part]
                    cut = least[lo : lo + PRODUCT]
                    if len(part) > k:
                        cut = np.maximum(cut, np.partition(near, len(part) - k, axis=1)[:, len(part) - k])
                    if threshold is not None:
                        cut = np.maximum(cut, threshold)
                    qi, pi = np.nonzero((near >= cut[:, None] - SLACK) & (near > -np.inf))
                    qi, pi = qi + lo, part[pi]
                    score = in_order(m[pi], q[qi]) / np.sqrt(square[pi] * q_square[qi])
                    if threshold is not None:
                        qi, pi, score = qi[score >= threshold], pi[score >= threshold], score[score >= threshold]
                    found_q.append(qi), found_p.append(at[pi]), found_s.append(score)
            qi, pi, score = map(np.concatenate, (found_q, found_p, found_s))
            if len(qi):
                rows = pa.Table.from_batches([batch]).drop_columns(vector).take(pa.array(pi))
                hits.add(rows.append_column("_q", pa.array(qi, pa.int64())).append_column("score", pa.array(score)))
            if hits.rows is not None and hits.rows.num_rows > MOST_HITS:
                yield from handed_on()
        yield from handed_on()

    return run


def profile_queries(profiles: DataFrame, own: Column, shared: list[str]) -> DataFrame:
    """Profile, turn, query_text: the profile's own query and then the shared ones, each text once
    and in that order, blank ones left out. Turns count from 0."""
    texts = F.array_distinct(F.filter(F.array(own, *map(F.lit, shared)), lambda t: t.isNotNull() & t.rlike(r"(?U)\S")))
    return profiles.select("profile", F.posexplode(texts).alias("turn", "query_text"))


def pooled(points: DataFrame, asked: DataFrame, vectors: DataFrame, k: int, text: str, threshold: float | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Each profile's candidates from all its queries; of equal texts the one of the greatest score.

    ``asked`` comes from :func:`profile_queries`; ``vectors`` has a query_vector for each query_text. A
    text that many profiles ask is searched once. Of equal scores the earlier query's better rank stays.
    Columns: those of the points but the vector, profile, turn, score, rank (within the query).
    """
    wanted = asked.select("query_text").distinct().join(vectors, "query_text").select(F.col("query_text").alias("query_id"), "query_vector")
    hits = nearest(points, wanted, k, threshold, key=key, vector=vector)
    met = hits.join(asked.withColumnRenamed("query_text", "query_id"), "query_id")
    best = F.row_number().over(Window.partitionBy("profile", text).orderBy(F.desc("score"), "turn", "rank"))
    return met.withColumn("_best", best).filter("_best = 1").drop("_best")


def by_program(points: DataFrame, queries: DataFrame, general: DataFrame, k: int, programs: list[str], text: str, threshold: float | None = None, source: str = "source", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Each query's hits program by program, then those of the general query across programs.

    Programs come in the order of ``programs``, hits within them by rank; ``general`` is one query (of
    amounts) for all, searched once. Of hits whose first hundred characters agree the first stays.
    Columns: those of the points but the vector, query_id, score, place (from 1).
    """
    among = F.col(source).isin(programs)
    turn = F.array_position(F.array(*map(F.lit, programs)), F.col(source))
    own = nearest(points, queries, k, threshold, among, key, vector, group=source, each=True).withColumn("_turn", turn)
    amounts = nearest(points, general, k, threshold, among, key, vector).drop("query_id").withColumn("_turn", F.lit(len(programs) + 1).cast("long"))
    known = queries.filter(F.coalesce(F.col("query_text").rlike(r"(?U)\S"), F.lit(False))) if "query_text" in queries.columns else queries
    # A few general hits meet the queries' ids: k rows a query, as the result has.
    everyone = known.select("query_id").withColumn("_hits", F.lit(1)).join(F.broadcast(amounts.withColumn("_hits", F.lit(1))), "_hits").drop("_hits")
    both = own.unionByName(everyone)
    first = F.row_number().over(Window.partitionBy("query_id", F.substring(text, 1, 100)).orderBy("_turn", "rank"))
    kept = both.withColumn("_first", first).filter("_first = 1")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("_turn", "rank"))).drop("_first", "_turn", "rank")


def allowed_sources(sources: Column, text: Column, detected: Column, of_program: dict[str, list[str]]) -> Column:
    """R3 with R2: what a query may meet. Its source list if it has one, else the sources of the program
    that its text names, else null (all). A program without sources allows none."""
    table = F.create_map(*[x for p, s in of_program.items() for x in (F.lit(p), F.array(*map(F.lit, s)).cast("array<string>"))])
    by_text = F.when(detected.isNotNull(), F.coalesce(F.try_element_at(table, detected), F.array().cast("array<string>")))
    return F.when(F.coalesce(F.size(sources), F.lit(0)) > 0, sources).otherwise(by_text)
