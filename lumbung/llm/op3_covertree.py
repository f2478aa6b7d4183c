"""Embedding near-duplicates by dual traversal of cover trees."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, lean
from .components import components, labels_of

THRESHOLD = 0.98
#: Vectors of a block; labels with more are compared block against block, a task for each pair.
BLOCK = 4096
#: Rounding that the bounds leave room for; pairs so near the threshold are always computed.
SLACK = 1e-7


@dataclass
class Node:
    """Members ``start`` to ``end`` of the tree's order, all within ``radius`` of ``centre``."""

    centre: int
    start: int
    end: int
    radius: float
    children: list[Node] = field(default_factory=list)


class CoverTree:
    """Nested levels of centres over unit vectors.

    At the level of radius r a node's members are covered by centres more than r apart, the first of
    which is the node's own; r halves from level to level. Nodes of one member, or at a level of at
    most ``finest``, are leaves. Each node keeps the true largest distance from its centre.
    """

    def __init__(self, unit: np.ndarray, finest: float):
        self.unit = unit
        self.order = np.arange(len(unit))
        self.root = self._grow(0, len(unit), 2.0, finest)

    def _distances(self, centre: int, members: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (self.unit[members] @ self.unit[centre])))

    def _grow(self, start: int, end: int, r: float, finest: float) -> Node:
        root = Node(int(self.order[start]), start, end, 0.0)
        stack = [(root, r)]
        while stack:
            node, r = stack.pop()
            members = self.order[node.start : node.end]
            node.radius = float(self._distances(node.centre, members).max())
            if len(members) == 1 or r <= finest or node.radius <= finest:
                continue
            r /= 2
            while node.radius <= r and r > finest:  # levels at which nothing splits
                r /= 2
            parts, rest = [], members
            while len(rest):
                near = self._distances(int(rest[0]), rest) <= r
                near[0] = True
                parts.append(rest[near])
                rest = rest[~near]
            self.order[node.start : node.end] = np.concatenate(parts)
            at = node.start
            for part in parts:
                child = Node(int(part[0]), at, at + len(part), 0.0)
                node.children.append(child)
                if len(part) > 1:
                    stack.append((child, r))
                at += len(part)
        return root


class Links:
    """Counts of linked vectors, by multiplicity, and the links' forest, for the vectors of one task."""

    def __init__(self, raw: np.ndarray, norms: np.ndarray, times: np.ndarray, threshold: float):
        self.raw, self.norms, self.times, self.threshold = raw, norms, times, threshold
        self.count = np.zeros(len(raw), np.int64)
        self.a: list[np.ndarray] = []
        self.b: list[np.ndarray] = []

    def all_of(self, x: np.ndarray, y: np.ndarray) -> None:
        """Every vector of x links with every one of y."""
        self.count[x] += self.times[y].sum()
        self.count[y] += self.times[x].sum()
        self.a += [x, y]
        self.b += [np.full(len(x), y[0]), np.full(len(y), x[0])]

    def within(self, x: np.ndarray) -> None:
        """All vectors of x link with each other."""
        self.count[x] += self.times[x].sum() - self.times[x]
        self.a.append(x[1:])
        self.b.append(np.full(len(x) - 1, x[0]))

    def _cosines(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return (self.raw[x] @ self.raw[y].T) / (self.norms[x][:, None] * self.norms[y])

    def verify(self, x: np.ndarray, y: np.ndarray) -> None:
        for at in range(0, len(x), 1024):
            part = x[at : at + 1024]
            i, j = np.nonzero(self._cosines(part, y) >= self.threshold)
            self._found(part[i], y[j])

    def verify_within(self, x: np.ndarray) -> None:
        i, j = np.nonzero(np.triu(self._cosines(x, x) >= self.threshold, 1))
        self._found(x[i], x[j])

    def verify_pairs(self, x: np.ndarray, y: np.ndarray) -> None:
        cos = np.einsum("ij,ij->i", self.raw[x], self.raw[y]) / (self.norms[x] * self.norms[y])
        ok = cos >= self.threshold
        self._found(x[ok], y[ok])

    def _found(self, x: np.ndarray, y: np.ndarray) -> None:
        np.add.at(self.count, x, self.times[y])
        np.add.at(self.count, y, self.times[x])
        if len(x):
            self.a.append(x)
            self.b.append(y)


def traverse(one: CoverTree, two: CoverTree | None, links: Links, shift: int) -> None:
    """All links between the vectors of two trees, or within one.

    A pair of nodes is dropped if its centres are farther apart than the threshold and both covering
    radii allow, and taken whole if no two members can be farther than the threshold; otherwise the
    children meet, their centres' distances computed at once. Leaves are verified exactly. ``shift`` is
    the place of the second tree's vectors among those of ``links``.
    """
    reach = float(np.sqrt(2.0 - 2.0 * links.threshold))
    same = two is None
    other = one if same else two

    def members(tree: CoverTree, node: Node) -> np.ndarray:
        own = tree.order[node.start : node.end]
        return own if same or tree is one else own + shift

    stack = [(one.root, other.root)]
    while stack:
        p, q = stack.pop()
        if p is q:
            if 2 * p.radius <= reach - SLACK:
                if p.end - p.start > 1:
                    links.within(members(one, p))
                continue
            if not p.children:
                links.verify_within(members(one, p))
                continue
            left = right = p.children
        else:
            left, right = p.children or [p], q.children or [q]
            if not p.children and not q.children:
                links.verify(members(one, p), members(other, q))
                continue
        centres = other.unit[[n.centre for n in right]]
        radius = np.array([n.radius for n in right])
        alone = np.array([n.end - n.start for n in right]) == 1
        for at in range(0, len(left), 1024):
            part = left[at : at + 1024]
            distance = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (one.unit[[n.centre for n in part]] @ centres.T)))
            near = distance <= reach + np.array([n.radius for n in part])[:, None] + radius + SLACK
            i, j = np.nonzero(near)
            if left is right:
                keep = j > i + at
                stack += [(n, n) for n in part if n.end - n.start > 1]
                i, j = i[keep], j[keep]
            single = np.array([n.end - n.start for n in part]) == 1
            both = single[i] & alone[j]
            if both.any():
                x = np.array([part[k].centre for k in i[both]])
                y = np.array([right[k].centre for k in j[both]])
                links.verify_pairs(x, y if same else y + shift)
            for a, b in zip(i[~both].tolist(), j[~both].tolist(), strict=True):
                m, n = part[a], right[b]
                if distance[a, b] + m.radius + n.radius <= reach - SLACK:
                    links.all_of(members(one, m), members(other, n))
                else:
                    stack.append((m, n))


def _settle(ids: np.ndarray, raw: np.ndarray, times: np.ndarray, cutoff: int, two: bool, threshold: float) -> pa.RecordBatch:
    norms = np.sqrt(np.einsum("ij,ij->i", raw, raw))
    unit = raw / norms[:, None]
    links = Links(raw, norms, times, threshold)
    finest = float(np.sqrt(2.0 - 2.0 * threshold)) / 4
    if not two:
        traverse(CoverTree(unit, finest), None, links, 0)
    elif 0 < cutoff < len(ids):
        traverse(CoverTree(unit[:cutoff], finest), CoverTree(unit[cutoff:], finest), links, cutoff)
    label = np.arange(len(ids))
    if links.a:
        nodes, low = labels_of(np.concatenate(links.a), np.concatenate(links.b))
        label[nodes] = low
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links.count), pa.array(ids[label])], names=["id", "links", "root"])


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector.

    Equal vectors of a label are one vector with a multiplicity. A label's vectors are dealt into
    blocks by a hash of vec_id; each pair of blocks, and each block by itself, is a task that builds
    cover trees and traverses them together; it returns a row for each vector: linked vectors and a
    root in the links' forest, never pairs. Components are made of those forests.

    Vectors are compared if label and dimension are equal. A null label or vec_id, a null vector, one
    of norm zero, empty, or with a null or non-finite component links with nothing and is its own
    component. Repeated rows (one vec_id, one vector) link with each other like other equal vectors.
    Other columns are ignored; an empty table gives no rows.
    """
    v = F.col("embedding")
    double = F.transform(v, lambda x: x.cast("double"))
    sound = F.coalesce(
        F.col("label").isNotNull() & F.col("vec_id").isNotNull() & ~F.exists(double, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
        & (F.aggregate(double, F.lit(0.0), lambda s, x: s + F.coalesce(x * x, F.lit(0.0))) > 0),
        F.lit(False),
    )
    named = vectors.select("vec_id", F.col("label").alias("label"), v.alias("embedding"), sound.alias("sound")).withColumn("h", F.xxhash64("label", "embedding"))
    distinct = named.filter("sound").groupBy("h", "label", "embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("times"))
    distinct = cut(distinct.withColumn("dim", F.size("embedding")))
    blocks = distinct.groupBy("label", "dim").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    placed = distinct.join(blocks, ["label", "dim"]).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    tasks = placed.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select(
        "label", "dim", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "id", "times", F.col("embedding").cast("array<double>").alias("embedding")
    )
    dealt = tasks.repartition("label", "dim", "low", "high").sortWithinPartitions("label", "dim", "low", "high", "own", "id")
    order = dealt.select(F.xxhash64("label", "dim", "low", "high").alias("task"), F.col("low") != F.col("high"), "own", "id", "times", "embedding")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle() -> pa.RecordBatch:
            own, ids, times = (np.concatenate([h[k] for h in held]) for k in range(3))
            return _settle(ids, np.concatenate([h[3] for h in held]), times, int((own == own[0]).sum()), two, threshold)

        now, two, held = None, False, []
        for batch in batches:
            task = batch.column(0).to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(task[1:] != task[:-1]) + 1, [len(task)])) if len(task) else [0]
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                if task[start] != now:
                    if held:
                        yield settle()
                    now, two, held = task[start], batch.column(1)[start].as_py(), []
                part = batch.slice(start, end - start)
                lists = part.column(5)
                raw = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)
                held.append((part.column(2).to_numpy(), part.column(3).to_numpy(), part.column(4).to_numpy(), raw))
        if held:
            yield settle()

    found = cut(order.mapInArrow(lean("op3", run), "id long, links long, root long"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    groups = components(found.filter("id != root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    groups = groups.select(F.col("node").alias("id"), F.col("label").alias("least"))
    known = distinct.join(links, "id", "left").join(groups, "id", "left").select(
        F.lit(True).alias("sound"), "h", "label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n"), F.coalesce("least", "id").alias("c")
    )
    return named.join(known, ["sound", "h", "label", "embedding"], "left").select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"), F.coalesce(F.coalesce("c", "vec_id") == F.col("vec_id"), F.lit(False)).alias("kept")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), sound AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND list_sum(list_transform(e, lambda x: x * x)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.label = b.label AND len(a.e) = len(b.e)
    AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), least AS (SELECT a, min(b) AS c FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, least.c AS component_id, v.vec_id = least.c AS kept
FROM v LEFT JOIN least ON least.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""
