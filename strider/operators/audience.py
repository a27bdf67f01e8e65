"""Audiences compared: pair overlap, reference similarity, two-panel comparison, vectors."""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strider.functions.similarity import normalized, similarity
from strider.functions.text import similarity_color

VECTOR_FORMATS = ("binary", "base64", "sparse")


def people(exposures: DataFrame) -> DataFrame:
    return exposures.where("contacts > 0").select("panel_id", "person").distinct()


def pair_overlap(exposures: DataFrame, panels: DataFrame) -> DataFrame:
    """All pairs of panels a < b, also those that share nobody: reaches, shared people, overlap coefficient.

    Pairs within a person come from the panels that person saw, at most all panels; the grid of pairs is the panel
    inventory squared, a report by definition."""
    seen = people(exposures)
    shared = seen.select(F.col("panel_id").alias("panel_a"), "person").join(seen.select(F.col("panel_id").alias("panel_b"), "person"), "person").where("panel_a < panel_b").groupBy("panel_a", "panel_b").agg(F.count(F.lit(1)).alias("_shared"))
    reach = seen.groupBy("panel_id").agg(F.count(F.lit(1)).alias("n"))
    sized = panels.select("panel_id").join(reach, "panel_id", "left").select("panel_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    a, b = (sized.select(F.col("panel_id").alias(f"panel_{k}"), F.col("n").alias(f"unique_reach_{k}")) for k in "ab")
    grid = a.join(b, F.col("panel_a") < F.col("panel_b")).join(shared, ["panel_a", "panel_b"], "left").withColumn("shared_agents", F.coalesce("_shared", F.lit(0)).cast("long")).drop("_shared")
    return grid.withColumn("overlap_coefficient", similarity("overlap_coef", F.col("unique_reach_a"), F.col("unique_reach_b"), F.col("shared_agents")))


def reference_similarity(exposures: DataFrame, panels: DataFrame, reference: str, metric: str) -> DataFrame:
    """Every panel against one: shared people, score, normalised score, colour."""
    seen = people(exposures)
    ref = seen.where(F.col("panel_id") == reference).select("person")
    shared = seen.join(ref, "person").groupBy("panel_id").agg(F.count(F.lit(1)).alias("_s"))
    reach = seen.groupBy("panel_id").agg(F.count(F.lit(1)).alias("_n"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    rows = panels.select("panel_id").join(reach, "panel_id", "left").join(shared, "panel_id", "left").select("panel_id", zero("_n").alias("unique_reach"), zero("_s").alias("shared"))
    rows = rows.crossJoin(ref.agg(F.count(F.lit(1)).alias("reference_reach")))  # a single row
    score = similarity(metric, F.col("reference_reach"), F.col("unique_reach"), F.col("shared"))
    rows = rows.withColumn("score", score).withColumn("normalized", normalized(metric, F.col("score"), F.col("reference_reach")))
    return rows.withColumn("color", similarity_color(F.col("normalized")))


def compare_panels(exposures: DataFrame, a: str, b: str) -> DataFrame:
    """One row: only a, only b, shared, and all similarities."""
    who = people(exposures.where(F.col("panel_id").isin(a, b))).groupBy("person").agg(F.max(F.col("panel_id") == a).alias("in_a"), F.max(F.col("panel_id") == b).alias("in_b"))
    n = who.agg(F.count_if(F.col("in_a") & ~F.col("in_b")).alias("only_a"), F.count_if(F.col("in_b") & ~F.col("in_a")).alias("only_b"), F.count_if(F.col("in_a") & F.col("in_b")).alias("shared"))
    n_a, n_b = F.col("only_a") + F.col("shared"), F.col("only_b") + F.col("shared")
    return n.select("only_a", "only_b", "shared", *[similarity(m, n_a, n_b, F.col("shared")).alias(m) for m in ("jaccard", "cosine", "overlap_coef")])


def sparse_vectors(exposures: DataFrame, offset: int = 0) -> DataFrame:
    """a panel's people in rising order, joined by semicolons; offset 1 numbers them from 1 (D5). Numbers
    beyond the pool are kept."""
    ids = F.transform(F.sort_array(F.collect_set(F.col("person") + offset)), lambda x: x.cast("string"))
    return people(exposures).groupBy("panel_id").agg(F.array_join(ids, ";").alias("data")).select("panel_id", F.lit("sparse").alias("format"), "data")


def dense_vectors(exposures: DataFrame, pool: int, fmt: str, offset: int = 0) -> DataFrame:
    """a panel's people as `pool` characters 0 and 1, or as base64 of bits, first person in the highest
    bit. Numbers outside 1..pool (after the offset) are dropped.

    A panel's people arrive as one bitmap row for each 32768 of them, so a group is the size of the output."""
    if fmt not in ("binary", "base64"):
        raise ValueError(fmt)
    at = F.col("person") + offset
    bits = people(exposures).where(at.between(1, pool)).select("panel_id", F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("bit")).groupBy("panel_id", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))

    def run(t: pa.Table) -> pa.Table:
        flags = np.zeros(pool, np.uint8)
        for bucket, raw in zip(t.column("bucket").to_pylist(), t.column("bits").to_pylist()):
            first = (bucket - 1) * 32768
            part = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")[: pool - first]
            flags[first : first + len(part)] = part
        data = (flags + 48).tobytes().decode() if fmt == "binary" else base64.b64encode(np.packbits(flags).tobytes()).decode()
        return pa.table({"panel_id": [t.column("panel_id")[0].as_py()], "format": [fmt], "data": [data]})

    return bits.groupBy("panel_id").applyInArrow(run, "panel_id string, format string, data string")


def vectors(exposures: DataFrame, panels: DataFrame, pool: int, fmt: str, offset: int = 0) -> DataFrame:
    """K4: a row for every panel, those without people included."""
    if fmt not in VECTOR_FORMATS:
        raise ValueError(fmt)
    some = sparse_vectors(exposures, offset) if fmt == "sparse" else dense_vectors(exposures, pool, fmt, offset)
    nobody = {"sparse": F.lit(""), "binary": F.repeat(F.lit("0"), F.lit(pool)), "base64": F.lit(base64.b64encode(bytes(-(-pool // 8))).decode())}[fmt]
    return panels.select("panel_id").join(some, "panel_id", "left").select("panel_id", F.lit(fmt).alias("format"), F.coalesce("data", nobody).alias("data"))
