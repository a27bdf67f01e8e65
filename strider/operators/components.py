"""Connected components of an undirected graph by alternating large and small stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strider.storage import observed, remove, shared_dir, written

MAX_ROUNDS = 40
#: Edges that one task takes at once; more go through rounds of joins.
FINISH = 500_000


def _large(e: DataFrame) -> DataFrame:
    """Every node points its larger neighbours at the smallest of itself and its neighbours."""
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct()


def _small(e: DataFrame) -> DataFrame:
    """Every node points its smaller neighbours, and itself, at the smallest of them. Edges are a < b."""
    low = e.groupBy("b").agg(F.min("a").alias("m"))
    down = e.join(low, "b")
    return down.select(F.col("m").alias("a"), F.col("a").alias("_v")).where("a < _v").withColumnRenamed("_v", "b").unionByName(low.select(F.col("m").alias("a"), "b")).distinct()


def labels(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that each of n nodes is connected to by edges x - y."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        for at in (x, y, label[x], label[y]):
            np.minimum.at(new, at, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new


def _finished(edges: DataFrame) -> DataFrame:
    """node, component of at most FINISH edges, in one task."""
    kind = edges.schema["a"].dataType.simpleString()

    def run(batches):
        parts = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches]
        if parts:
            a, b = (np.concatenate(x) for x in zip(*parts))
            ids, code = np.unique(np.concatenate((a, b)), return_inverse=True)
            found = labels(code[: len(a)], code[len(a) :], len(ids))
            for i in range(0, len(ids), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + 100_000]), pa.array(ids[found[i : i + 100_000]])], ["node", "component"])

    return edges.coalesce(1).mapInArrow(run, f"node {kind}, component {kind}")


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b of any ordered type. Returns node, component (its smallest reachable node) for every node with an
    edge to another.

    Up to FINISH edges, counted first, are one task's work on arrays. Beyond: minima are aggregated before the shuffle and joined back, so a node with very many neighbours is split like any
    skewed join; every round is written to the shared folder. Ends when a round changes nothing, after O(log n) rounds."""
    spark, out = edges.sparkSession, shared_dir(edges.sparkSession)
    mark = {"n": F.count(F.lit(1)), "x": F.sum(F.hash("a", "b").cast("decimal(20,0)")), "y": F.sum(F.xxhash64("b", "a").cast("decimal(30,0)"))}
    e, before = observed(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), f"{out}/0", **mark)
    if 0 < before["n"] <= FINISH:
        return written(_finished(e), f"{out}/all")
    for i in range(1, MAX_ROUNDS + 1):
        if not before["n"]:
            break
        e, now = observed(_small(_large(e)), f"{out}/{i}", **mark)
        remove(spark, f"{out}/{i - 1}")
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return e.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
