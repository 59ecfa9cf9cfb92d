"""Connected components of a table of links, by label propagation with pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, saved

#: Parts that the nodes of one label are dealt to.
SALTS = 16
#: Links that a task contracts at a time.
CHUNK = 1 << 18


def smallest_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its part) of a few links: labels fall along all links at once, then to their own labels."""
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(node))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            return node, node[label]
        label = new


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a < b) that connect what a task's links do: each node with the smallest one of its part, CHUNK links at a time."""
    held, n = [], 0

    def out():
        node, low = smallest_of(*(np.concatenate([h[i] for h in held]) for i in (0, 1)))
        other = node != low
        return pa.RecordBatch.from_arrays([pa.array(low[other]), pa.array(node[other])], ["a", "b"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        n += batch.num_rows
        if n >= CHUNK:
            yield out()
            held, n = [], 0
    if n:
        yield out()


def components(links: DataFrame) -> DataFrame:
    """(node, label): for each end of a link (columns a, b) the smallest node that it is connected to.

    Tasks first contract the links that they hold, so that chains get short. Then each round takes the smallest label among a
    node and its neighbours, then the label of that label. Only node and label move; each round's table is written to the
    shared folder. The driver sees one count a round.
    """
    short = links.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(_contracted, "a long, b long")
    both = saved(short.select("a", "b", F.explode(F.array(F.lit(0), F.lit(1))).alias("turn")).select(F.when(F.col("turn") == 0, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(F.col("turn") == 0, F.col("b")).otherwise(F.col("a")).alias("b")).distinct(), "links")
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        # merged at every size: a broadcast would pass through the driver in each round
        near = both.join(labels.hint("merge"), both["b"] == labels["node"]).groupBy(F.col("a").alias("n2")).agg(F.min("label").alias("near"))
        best = labels.join(near.hint("merge"), labels["node"] == near["n2"]).select("node", "label", F.least("label", "near").alias("best"))
        # in a giant component all nodes ask for the same few labels: each is looked up once and given out by salts
        far = best.select("best").distinct().join(labels.select(F.col("node").alias("best"), F.col("label").alias("far")).hint("merge"), "best")
        far = far.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = best.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
        step = saved(salted.join(far.hint("merge"), ["best", "salt"]).select("node", F.least("best", "far").alias("new"), "label"), "labels")
        drop(labels)
        labels = step.select("node", F.col("new").alias("label"))
        labels.saved_path = step.saved_path
        if step.where("new < label").limit(1).count() == 0:
            drop(both)
            return labels
