"""Connected components of links between integer nodes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lean, new_folder

#: Links up to which one task solves all (16 bytes each); beyond, rounds of joins do.
ONE_TASK = 2_000_000


def _written(df: DataFrame) -> DataFrame:
    """``df`` computed once, written to the shared folder and read again.

    A checkpoint keeps the size that Spark has estimated for its plan, and a join multiplies the sizes
    of its sides: over rounds of joins the estimate's digits double at each step, until the driver is
    full of them. Files have their own size.
    """
    folder = new_folder(df.sparkSession, "components")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def labels_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the least node that each reaches."""
    nodes, index = np.unique(np.concatenate((a, b)), return_inverse=True)
    left, right = index[: len(a)], index[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        # Roots hook to the least label seen across their links, then every node jumps to its root.
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        while (jumped := new[new]).tobytes() != new.tobytes():
            new = jumped
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def components(links: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """node, label: the least node that each node of ``links`` (a, b: long) reaches.

    A bounded number of links is solved in one task. Beyond, every round hooks the root of each link's
    larger side to the smaller root and lets all nodes jump to their root's root, until no root of a
    link differs; each round is two aggregations and joins by key and is written. Links with a
    null end are ignored; without links there are no nodes.
    """
    links = links.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a is not null and b is not null")

    def solve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches if x.num_rows]
        if parts:
            nodes, labels = labels_of(*(np.concatenate(c) for c in zip(*parts, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(labels)], names=["node", "label"])

    def thinned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                nodes, labels = labels_of(x.column(0).to_numpy(), x.column(1).to_numpy())
                off = nodes != labels
                yield pa.RecordBatch.from_arrays([pa.array(nodes[off]), pa.array(labels[off])], names=["a", "b"])

    links = cut(links.filter("a != b").mapInArrow(lean("components", thinned), "a long, b long"))
    if links.count() <= one_task:
        return links.coalesce(1).mapInArrow(lean("components", solve), "node long, label long")
    label = _written(links.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node")))
    open_links = links
    while True:
        x = label.select(F.col("node").alias("a"), F.col("label").alias("la"))
        y = label.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        open_links = _written(open_links.join(x, "a").join(y, "b").filter("la != lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct())
        if open_links.isEmpty():
            return label
        hooks = open_links.select(F.greatest("a", "b").alias("root"), F.least("a", "b").alias("to")).groupBy("root").agg(F.min("to").alias("to"))
        hooks = _written(hooks)
        while True:  # chains of hooks shrink to half at each step
            further = hooks.select(F.col("root").alias("to"), F.col("to").alias("next"))
            jumped = _written(hooks.join(further, "to", "left").select("root", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
            hooks = jumped.select("root", "to")
            if jumped.filter("moved").isEmpty():
                break
        label = _written(label.join(hooks, label["label"] == hooks["root"], "left").select("node", F.coalesce("to", "label").alias("label")))
