"""Graph quality checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strider.operators.components import components
from strider.sources.graph import valid_edges

SAMPLES, SMALL = 10, 10


def duplicate_nodes(nodes: DataFrame) -> DataFrame:
    """Ids that occur more than once; a warning for each further occurrence."""
    return nodes.groupBy("id").agg((F.count(F.lit(1)) - 1).alias("warnings")).where("warnings > 0")


def dangling_ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Missing end points. Where the source is missing, that edge's target is not looked at."""
    ids = nodes.select("id").distinct()
    source = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_anti").select(F.col("source").alias("id"))
    rest = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi")
    target = rest.join(ids.withColumnRenamed("id", "target"), "target", "left_anti").select(F.col("target").alias("id"))
    return source.unionByName(target).distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Number of distinct neighbours of every node id; parallel edges count once, a loop once."""
    good = valid_edges(nodes, edges)
    both = good.select(F.col("source").alias("id"), F.col("target").alias("other")).unionByName(good.select(F.col("target").alias("id"), F.col("source").alias("other"))).distinct()
    n = both.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("id").distinct().join(n, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def isolated_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(degrees(nodes, edges).where("degree = 0").select("id"), "id", "left_semi")


def node_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Id, component of every node; a node without edges is its own."""
    found = components(valid_edges(nodes, edges).select(F.col("source").alias("a"), F.col("target").alias("b")))
    return nodes.select("id").distinct().join(found.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def component_sizes(placed: DataFrame) -> DataFrame:
    """T5: component, n_nodes, small (to be listed in full)."""
    return placed.groupBy("component").agg(F.count(F.lit(1)).alias("n_nodes")).withColumn("small", F.col("n_nodes") < SMALL)


def verify(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row with the counts and the verdict."""
    one = lambda df, *aggs: df.agg(*aggs)
    placed = node_components(nodes, edges)
    parts = [
        one(nodes, F.count(F.lit(1)).alias("n_nodes"), F.countDistinct("id").alias("n_unique")),
        one(edges, F.count(F.lit(1)).alias("n_edges")),
        one(dangling_ends(nodes, edges), F.count(F.lit(1)).alias("n_missing_ends")),
        one(degrees(nodes, edges), F.count_if(F.col("degree") == 0).alias("n_isolated")),
        one(placed, F.countDistinct("component").alias("n_components")),
    ]
    out = parts[0]
    for p in parts[1:]:  # single rows
        out = out.crossJoin(p)
    return out.withColumn("fully_connected", F.col("n_components") == 1)


def samples(df: DataFrame, key: str = "id", n: int = SAMPLES) -> DataFrame:
    """The first few by key."""
    return df.orderBy(key).limit(n)


def shown_edges(nodes: DataFrame, edges: DataFrame, level: str) -> DataFrame:
    """Edges that touch the shown level; those between levels are flagged."""
    at = lambda end: nodes.select(F.col("id").alias(end), F.col("level").alias(f"{end}_level"))
    e = edges.join(at("source"), "source").join(at("target"), "target")
    return e.where((F.col("source_level") == level) | (F.col("target_level") == level)).withColumn("transit", F.col("source_level") != F.col("target_level"))
