"""N-gram Jaccard join by prefix filters under several global orders."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh3_128_intdigest

from .common import cut, documents, lean, release
from .components import components
from .op10_substrings import EACH_SEGMENT, _by_segment, _dealt, _segments, _streamed
from .shingles import mixed, run_hashes, word_hashes

#: Orders under which candidates must share a prefix token.
ORDERS = 3
#: Hashes that a task holds at once; bits of a repeated-shingle filter for each entry and at most (32 MB).
GROUP, BITS_EACH, MOST_BITS = 400_000, 12, 1 << 28
KEY_BITS = 30
#: Documents that hold a shingle from which it counts as common and comes last in every order.
COMMON = 32
#: Documents of a block: a candidate group beyond one block is compared block by block.
BLOCK = 2048
#: Bytes of candidate documents' ids and places up to which they are broadcast to fetch the texts.
MOST_BYTES = 32_000_000


@dataclass(frozen=True)
class Rule:
    """``words`` a shingle; linked when ``den * intersection >= num * union``."""

    words: int = 5
    num: int = 80
    den: int = 100

    def set_of(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes of the shingles; of the whole sequence if it is shorter."""
        h = word_hashes(text.encode("utf-8", "surrogatepass").lower().split() if text else [])
        if not len(h):
            return h
        return np.unique(run_hashes(h, self.words) if len(h) >= self.words else mixed(run_hashes(h, len(h)) + np.uint64(len(h))))

    def prefix(self, n: int) -> int:
        return n - -(-self.num * n // self.den) + 1


def _sets(batches: Iterable[pa.RecordBatch], rule: Rule, segments: int) -> Iterator[list[tuple[int | None, int | None, np.ndarray]]]:
    group, n, most = [], 0, max(GROUP, EACH_SEGMENT * segments)
    for batch in batches:
        for doc_id, text, tie in zip(*batch.columns, strict=True):
            s = rule.set_of(text.as_py())
            group.append((doc_id.as_py(), tie.as_py(), s))
            n += len(s)
            if n >= most:
                yield group
                group, n, most = [], 0, max(GROUP, EACH_SEGMENT * segments)
    if group:
        yield group


def _key(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set in two halves; the first names it among the tokens."""
    high, low = divmod(xxh3_128_intdigest(s.tobytes()), 1 << 64)
    return high - (1 << 63), low - (1 << 63)


def _repeated(texts: DataFrame, rule: Rule, segments: int) -> tuple[np.ndarray, int]:
    """Two bits for each slot of a hash table: a shingle there is in several sets; is common.

    Counts cover all documents, a set within a task once. The table is bounded by MOST_BITS at any
    scale. Entries that meet in a slot only change the orders, alike for all documents.
    """
    bits = segments.bit_length() - 1

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _sets(batches, rule, segments):
            distinct = {_key(s): s for _, _, s in group if len(s)}
            if not distinct:
                continue
            h, counts = np.unique(np.concatenate(list(distinct.values())) >> np.uint64(64 - bits - KEY_BITS), return_counts=True)
            keys = ((h & np.uint64((1 << KEY_BITS) - 1)) << np.uint64(2)).astype(np.uint32) | ((counts > 1).astype(np.uint32) | ((counts >= COMMON).astype(np.uint32) << 1))
            out = [(s, keys[at].tobytes()) for s, at in _by_segment(h >> np.uint64(KEY_BITS), segments)]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.int32()), pa.array([d for _, d in out], pa.binary())], names=["segment", "keys"])

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for segment, rows in _streamed(batches):
            v = np.sort(np.concatenate([np.frombuffer(r["keys"], np.uint32) for r in rows]))
            first = np.flatnonzero(np.concatenate(([True], (v[1:] >> 2) != (v[:-1] >> 2))))
            flags = np.bitwise_or.reduceat(v & 3, first)
            times = np.diff(np.concatenate((first, [len(v)])))
            several = (times > 1) | (flags & 1 != 0)
            common = (times >= COMMON) | (flags & 2 != 0)
            found = (v[first] >> 2 << 1 | common.astype(np.uint32))[several]
            yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([len(found)], pa.int64()), pa.array([found.tobytes()], pa.binary())], names=["segment", "n", "keys"])

    met = cut(_dealt(texts.mapInArrow(lean("op4", emit), "segment int, keys binary")).mapInArrow(lean("op4", meet), "segment int, n long, keys binary"))
    n = met.agg(F.sum("n")).first()[0] or 0
    each = min(max(64, 1 << (min(n * BITS_EACH, MOST_BITS // 2) // segments).bit_length()), MOST_BITS // 2 // segments)

    def table(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys = np.frombuffer(row["keys"], np.uint32)
                own = np.zeros((2, each), bool)
                own[0, (keys >> 1) & np.uint32(each - 1)] = True
                own[1, (keys[keys & 1 == 1] >> 1) & np.uint32(each - 1)] = True
                yield pa.RecordBatch.from_arrays([pa.array([row["segment"]], pa.int32()), pa.array([np.packbits(own, axis=1, bitorder="little").tobytes()], pa.binary())], names=["segment", "bits"])

    out = np.zeros((2, segments, each // 8), np.uint8)
    for segment, data in met.filter("n > 0").mapInArrow(lean("op4", table), "segment int, bits binary").toLocalIterator():
        out[:, segment] = np.frombuffer(data, np.uint8).reshape(2, -1)
    return out.reshape(2, -1), each


def _groups_of(order: np.ndarray, token: np.ndarray, key: np.ndarray, size: np.ndarray, rule: Rule) -> tuple[np.ndarray, ...]:
    """Links (order, a, b) that join all sets sharing a token, as far as sizes allow a link."""
    at = np.lexsort((key, size, token, order))
    order, token, key, size = order[at], token[at], key[at], size[at]
    new = np.ones(len(at), bool)
    new[1:] = (order[1:] != order[:-1]) | (token[1:] != token[:-1]) | (size[:-1] * rule.den < rule.num * size[1:])
    start = np.flatnonzero(new)
    head = np.repeat(start, np.diff(np.concatenate((start, [len(at)]))))
    off = key != key[head]
    links = np.unique(np.stack((order[off], key[off], key[head][off])), axis=1)
    return links[0], links[1], links[2]


def _linked(left: list[np.ndarray], right: list[np.ndarray] | None, rule: Rule) -> Iterator[tuple[int, np.ndarray]]:
    """For each set of ``left`` the numbers of the sets it links with: those before it, or of ``right``."""
    inside = right is None
    right = left if inside else right
    sizes = np.array([len(s) for s in right])
    flat = np.concatenate(right)
    owner = np.repeat(np.arange(len(right)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    for i, s in enumerate(left):
        low, high = np.searchsorted(flat, s), np.searchsorted(flat, s, side="right")
        lengths = high - low
        reach = np.repeat(low - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        shared = np.bincount(owner[reach], minlength=len(right))
        if inside:
            shared = shared[:i]
        union = len(s) + sizes[: len(shared)] - shared
        yield i, np.flatnonzero((shared > 0) & (rule.den * shared >= rule.num * union))


def _compare(rule: Rule):
    """Exact verification of the candidate groups, block against block; links as a forest."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(rows: list[tuple[int, int, np.ndarray]], two: bool) -> Iterator[pa.RecordBatch]:
            ids = np.array([r[1] for r in rows], np.int64)
            if two:
                cutoff = sum(r[0] == rows[0][0] for r in rows)
                found = ((i, js + cutoff) for i, js in _linked([r[2] for r in rows[:cutoff]], [r[2] for r in rows[cutoff:]], rule)) if cutoff < len(rows) else ()
            else:
                found = _linked([r[2] for r in rows], None, rule)
            label = np.arange(len(rows))
            for i, js in found:
                roots = np.unique(np.append(label[js], label[i]))
                if len(roots) > 1:
                    label[np.isin(label, roots[1:])] = roots[0]
            off = label != np.arange(len(rows))
            if off.any():
                yield pa.RecordBatch.from_arrays([pa.array(ids[off]), pa.array(ids[label[off]])], names=["a", "b"])

        now, rows = None, []
        for batch in batches:
            for g, low, high, block, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (g, low, high) != now:
                    if rows:
                        yield from settle(rows, now[1] != now[2])
                    now, rows = (g, low, high), []
                rows.append((block, doc, rule.set_of(text)))
        if rows:
            yield from settle(rows, now[1] != now[2])

    return run


def near_duplicates(docs: DataFrame, rule: Rule = Rule(), orders: int = ORDERS) -> DataFrame:
    """doc_id, tie, n_shingles, class_id, component_id of every document.

    Documents with one shingle set form a class, named by its least doc_id; only classes are compared.
    1. A bounded table tells shingles held by several documents. In every global order, shingles held
    by one come first, common ones last, and a hash seeded by the order decides between.
    2. Each class gives the shared tokens of its prefix under each order. Two classes can link only if
    they share a prefix token under every order, so only if they stand in one group of every order's
    groups of token sharers: these groups are intersected.
    3. What is left together is verified exactly from the whole texts, block against block if a group
    is large; each task returns a forest of its links, never pairs.

    A shingle is known by 64 bits, so two different ones of a pair of texts of 10,000 words each are
    taken for one with odds of about 1 in 10**11; a set is known by 128 bits.

    Null, empty and wordless texts have no shingles and link with nothing, not even each other.
    Rows with a null doc_id get no component. Repeated rows share a class. ``tie`` is a hash of the
    text. Other columns are ignored; an empty table gives no rows. Of a very long text a worker holds
    its words and its set.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    rows = docs.count()
    segments, wide = _segments(rows, 600), _segments(rows, 100)
    table, each = _repeated(texts, rule, segments)
    release(spark)
    shared = spark.sparkContext.broadcast(table)
    bits, wide_bits = segments.bit_length() - 1, wide.bit_length() - 1

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        schema = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("n", pa.int64()), ("key", pa.int64()), ("key2", pa.int64()), ("segment", pa.int32()), *((c, pa.binary()) for c in ("tokens", "owners", "keys", "sizes", "orders"))])
        for group in _sets(batches, rule, wide):
            keys = [_key(s) if len(s) else (None, None) for _, _, s in group]
            none = [None] * len(group)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(([g[0] for g in group], [g[1] for g in group], [len(g[2]) for g in group], *zip(*keys, strict=True), *[none] * 6), schema, strict=True)], schema=schema)
            told, token_parts, owners, order_parts, own_keys, sizes = set(), [], [], [], [], []
            for (doc_id, _, s), (key, _) in zip(group, keys, strict=True):
                if key is None or doc_id is None or key in told:
                    continue
                told.add(key)
                at = s >> np.uint64(64 - bits - KEY_BITS)
                at = (at >> np.uint64(KEY_BITS)) * np.uint64(each) + (at & np.uint64(each - 1))
                shift = (at & np.uint64(7)).astype(np.uint8)
                level = ((known[0][at >> np.uint64(3)] >> shift) & 1) + ((known[1][at >> np.uint64(3)] >> shift) & 1)
                take = rule.prefix(len(s)) - int((level == 0).sum())
                if take <= 0:
                    continue
                able, level = s[level > 0], level[level > 0]
                for k in range(orders):
                    rank = mixed(able + np.uint64(k))
                    chosen = np.lexsort((rank, level))[:take]
                    token_parts.append(able[chosen])
                    order_parts.append(np.full(len(chosen), k, np.uint8))
                    owners.append(np.full(len(chosen), len(own_keys), np.uint32))
                own_keys.append(key)
                sizes.append(len(s))
            if not token_parts:
                continue
            token, owner, order = map(np.concatenate, (token_parts, owners, order_parts))
            segment = (token >> np.uint64(64 - wide_bits)).astype(np.uint16 if wide <= 1 << 16 else np.uint32)
            sort = np.argsort(segment, kind="stable")
            token, owner, order, segment = token[sort], owner[sort], order[sort], segment[sort]
            own_keys, sizes = np.array(own_keys, np.int64), np.array(sizes, np.int64)
            out = []
            for s, part in _by_segment(segment, wide):
                used, index = np.unique(owner[part], return_inverse=True)
                out.append((None, None, None, None, None, s, token[part].tobytes(), index.astype(np.uint32).tobytes(), own_keys[used].tobytes(), sizes[used].tobytes(), order[part].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _streamed(batches):
            token, order, key, size = [], [], [], []
            for r in rows:
                owner = np.frombuffer(r["owners"], np.uint32)
                token.append(np.frombuffer(r["tokens"], np.uint64)), order.append(np.frombuffer(r["orders"], np.uint8))
                key.append(np.frombuffer(r["keys"], np.int64)[owner]), size.append(np.frombuffer(r["sizes"], np.int64)[owner])
            k, a, b = _groups_of(np.concatenate(order).astype(np.int64), np.concatenate(token), np.concatenate(key), np.concatenate(size), rule)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(a), pa.array(b)], names=["k", "a", "b"])

    emitted = cut(texts.mapInArrow(lean("op4", emit), "doc_id long, tie long, n long, key long, key2 long, segment int, tokens binary, owners binary, keys binary, sizes binary, orders binary"))
    own = emitted.filter("segment is null").select("doc_id", "tie", "n", "key", "key2")
    postings = emitted.filter("segment is not null").select("segment", "tokens", "owners", "keys", "sizes", "orders")
    sharing = cut(_dealt(postings).mapInArrow(lean("op4", meet), "k int, a long, b long"))
    groups = None
    for k in range(orders):
        found = components(sharing.filter(F.col("k") == k).select("a", "b")).select(F.col("node").alias("key"), F.col("label").alias(f"g{k}"))
        groups = found if groups is None else groups.join(found, "key")
    groups = groups.select("key", F.xxhash64(*(f"g{k}" for k in range(orders))).alias("g"))
    classes = cut(own.filter("key is not null and doc_id is not null").groupBy("key", "key2").agg(F.min(F.struct("doc_id", "tie")).alias("first"), F.first("n").alias("n")).select("key", "key2", "first.doc_id", "first.tie", "n"))
    within = Window.partitionBy("g").orderBy("n", "doc_id")
    placed = classes.join(groups, "key").withColumn("place", F.row_number().over(within) - 1)
    placed = placed.withColumn("block", F.floor(F.col("place") / BLOCK).cast("int"))
    totals = placed.groupBy("g").agg(F.max("block").alias("last"), F.count("*").alias("members")).filter("members > 1")
    blocks = placed.groupBy("g", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    x, y = blocks.alias("x"), blocks.alias("y")
    # Blocks stand in order of size: a later one is met only if its least set is not too large.
    pairs = x.join(y, "g").filter(f"y.block >= x.block and x.most * {rule.den} >= {rule.num} * y.least").select("g", F.col("x.block").alias("low"), F.col("y.block").alias("high"))
    members = placed.join(totals.select("g"), "g").select("g", "block", "doc_id", "tie")
    sides = pairs.select("g", "low", "high", F.explode(F.array_distinct(F.array("low", "high"))).alias("block"))
    members = cut(members.join(sides, ["g", "block"]).groupBy("doc_id", "tie").agg(F.collect_list(F.struct("g", "low", "high", "block")).alias("at")))
    n, places = members.agg(F.count("*"), F.coalesce(F.sum(F.size("at")), F.lit(0))).first()
    few = 40 * n + 40 * places <= MOST_BYTES
    members = members.withColumnRenamed("doc_id", "_id").withColumnRenamed("tie", "_tie")
    fetched = texts.join(F.broadcast(members) if few else members, (F.col("doc_id") == F.col("_id")) & (F.col("tie") == F.col("_tie")))
    dealt = fetched.select("doc_id", "text", F.explode("at").alias("at")).select("at.g", "at.low", "at.high", "at.block", "doc_id", "text")
    dealt = dealt.repartition("g", "low", "high").sortWithinPartitions("g", "low", "high", "block", "doc_id")
    links = dealt.mapInArrow(lean("op4", _compare(rule)), "a long, b long")
    found = components(links).select(F.col("node").alias("doc_id"), "label")
    named = classes.join(found, "doc_id", "left").select("key", "key2", F.col("doc_id").alias("class_id"), F.coalesce("label", "doc_id").alias("component_id"))
    out = own.join(named, ["key", "key2"], "left")
    alone = F.when(F.col("key").isNull(), F.col("doc_id"))
    return out.select("doc_id", "tie", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", alone)).alias("class_id"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", alone)).alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), Rule(4, 85, 100)).select("doc_id", "n_shingles", "component_id", "class_id")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), same AS (
  SELECT p.a, p.b, p.c = x.n AND p.c = y.n AS equal FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.c >= 85 * (x.n + y.n - p.c)
), links AS MATERIALIZED (SELECT a, b FROM same UNION ALL SELECT b, a FROM same
), reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), least AS (SELECT a, min(b) AS c FROM reach GROUP BY a), class AS (SELECT b, min(a) AS c FROM same WHERE equal GROUP BY b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least.c AS component_id, coalesce(class.c, d.doc_id) AS class_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least ON least.a = d.doc_id LEFT JOIN class ON class.b = d.doc_id
"""
