"""Walking graphs as JSON documents or tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strider.schemas import GRAPH_JSON


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and valid edges of a {nodes, edges} document."""
    doc = spark.read.schema(GRAPH_JSON).option("multiLine", True).json(path)
    nodes = doc.select(F.inline("nodes"))
    return nodes, valid_edges(nodes, doc.select(F.inline("edges")))


def valid_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose two ends are nodes."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select(edges.columns)


def directed(edges: DataFrame) -> DataFrame:
    """Both directions of every edge: src, dst, weight and pos, the order in which a node's neighbours are tried."""
    e = edges.select("source", "target", F.col("weight").cast("double").alias("weight"), F.monotonically_increasing_id().alias("pos")) if "pos" not in edges.columns else edges
    there = e.select(F.col("source").alias("src"), F.col("target").alias("dst"), "weight", "pos")
    back = e.select(F.col("target").alias("src"), F.col("source").alias("dst"), "weight", "pos")
    return there.unionByName(back)


def graph_document(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """K7: one row `value` with the JSON document; meant for a venue's graph, not for a table of venues."""
    n = nodes.agg(F.sort_array(F.collect_list(F.struct(*nodes.columns))).alias("nodes"))
    e = edges.agg(F.sort_array(F.collect_list(F.struct(*edges.columns))).alias("edges"))
    return n.crossJoin(e).select(F.to_json(F.struct("nodes", "edges")).alias("value"))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    graph_document(nodes, edges).write.mode("overwrite").text(path)


def write_graph_tables(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """The preferred form: two Parquet tables."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")
