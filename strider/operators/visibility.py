"""Who sees which panel: samples of edges, panel candidates, passages.

What a walker sees along a directed edge does not depend on the walker. `edge_views` summarises each (edge, panel) once:
in view at the first and at the last sample, and the number of times it comes into view between them. A trip's passages
follow from the summaries of its hops in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strider.config import LAT_DEG_TO_M, LON_DEG_TO_M, SimConfig
from strider.functions.geo import cell, distance_m, in_view


def directed_segments(nodes: DataFrame, directed: DataFrame) -> DataFrame:
    """src, dst, floor (of the source, for the whole edge), x1, y1, x2, y2."""
    a = nodes.select(F.col("id").alias("src"), F.col("level").alias("floor"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    b = nodes.select(F.col("id").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return directed.select("src", "dst").distinct().join(a, "src").join(b, "dst")


def samples(segments: DataFrame, step_m: float) -> DataFrame:
    """M6, F8: every segment's sample points, ends included: adds s, x, y."""
    steps = F.greatest(F.lit(1), F.floor(distance_m(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")) / F.lit(step_m)).cast("int"))
    s = segments.withColumn("_n", steps).withColumn("s", F.explode(F.sequence(F.lit(0), F.col("_n"))))
    t = F.col("s").cast("double") / F.col("_n")
    at = lambda a, b: F.col(a) + t * (F.col(b) - F.col(a))
    return s.withColumn("x", at("x1", "x2")).withColumn("y", at("y1", "y2")).drop("_n")


def candidates(points: DataFrame, panels: DataFrame, config: SimConfig) -> DataFrame:
    """Points (floor, x, y) with the panels that are looked at: all of the floor, or those of the 3x3 cells
    around. The panel inventory is broadcast only if Spark finds it small; the join has equality keys either way."""
    p = panels.select("panel_id", F.col("floor"), F.col("longitude").alias("px"), F.col("latitude").alias("py"), "orientation")
    if config.candidates == "floor":
        return points.join(p, "floor")
    cx, cy = cell(F.col("px"), LON_DEG_TO_M, config.cell_m), cell(F.col("py"), LAT_DEG_TO_M, config.cell_m)
    around = F.array(*[F.struct((cx + dx).alias("cx"), (cy + dy).alias("cy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    p = p.select("*", F.inline(around))
    points = points.withColumn("cx", cell(F.col("x"), LON_DEG_TO_M, config.cell_m)).withColumn("cy", cell(F.col("y"), LAT_DEG_TO_M, config.cell_m))
    return points.join(p, ["floor", "cx", "cy"]).drop("cx", "cy")


def with_hits(points: DataFrame, panels: DataFrame, config: SimConfig, heading=("x1", "y1", "x2", "y2")) -> DataFrame:
    """P5: candidate rows with `hit`."""
    c = F.col
    x1, y1, x2, y2 = heading
    hit = in_view(c("x"), c("y"), c(x2) - c(x1), c(y2) - c(y1), c("px"), c("py"), c("orientation"), config.view_dist, config.cos_cone)
    return candidates(points, panels, config).withColumn("hit", hit)


def rises(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Marks rows where `hit` turns from false (or nothing) to true."""
    before = F.coalesce(F.lag("hit").over(W.partitionBy(*key).orderBy(*order)), F.lit(False))
    return rows.withColumn("rise", F.col("hit") & ~before)


def edge_views(nodes: DataFrame, directed: DataFrame, panels: DataFrame, config: SimConfig) -> DataFrame:
    """src, dst, panel_id, first_hit, last_hit, rises (between samples of the edge). Rows without any hit are kept:
    they end a view that an earlier hop left open."""
    seen = with_hits(samples(directed_segments(nodes, directed), config.step_m), panels, config)
    marked = rises(seen, ["src", "dst", "panel_id"], ["s"])
    first = F.min_by("hit", "s")
    inner = F.sum(F.col("rise").cast("int")) - first.cast("int")
    return marked.groupBy("src", "dst", "panel_id").agg(first.alias("first_hit"), F.max_by("hit", "s").alias("last_hit"), inner.alias("rises"))


def passages(hops: DataFrame, views: DataFrame) -> DataFrame:
    """Trip, person, panel_id, contacts from hops (trip, person, leg, hop, src, dst) and edge summaries."""
    rows = hops.join(views, ["src", "dst"])
    before = F.coalesce(F.lag("last_hit").over(W.partitionBy("trip", "panel_id").orderBy("leg", "hop")), F.lit(False))
    new = F.col("rises") + (F.col("first_hit") & ~before).cast("int")
    return rows.withColumn("_new", new).groupBy("trip", "person", "panel_id").agg(F.sum("_new").cast("long").alias("contacts")).where("contacts > 0")


def passages_by_sample(hops: DataFrame, nodes: DataFrame, panels: DataFrame, config: SimConfig) -> DataFrame:
    """The same, sample by sample: the slow form that the summaries are tested against."""
    a = nodes.select(F.col("id").alias("src"), F.col("level").alias("floor"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    b = nodes.select(F.col("id").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    seen = with_hits(samples(hops.join(a, "src").join(b, "dst"), config.step_m), panels, config)
    marked = rises(seen, ["trip", "panel_id"], ["leg", "hop", "s"])
    return marked.groupBy("trip", "person", "panel_id").agg(F.sum(F.col("rise").cast("long")).alias("contacts")).where("contacts > 0")


def active(panels: DataFrame, ids) -> DataFrame:
    """The active panels; None keeps all."""
    return panels if ids is None else panels.where(F.col("panel_id").isin(list(ids)))


def trip_distance(hops: DataFrame, nodes: DataFrame) -> DataFrame:
    """Metres and hops of each trip."""
    seg = directed_segments(nodes, hops.select("src", "dst"))
    d = seg.select("src", "dst", distance_m(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")).alias("m"))
    return hops.join(d, ["src", "dst"]).groupBy("trip").agg(F.sum("m").alias("distance_m"), F.count(F.lit(1)).alias("hops"))
