"""From classified features to a walkable graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strider.config import LAT_DEG_TO_M, LON_DEG_TO_M
from strider.functions.geo import bbox, distance_m, point_in_polygon, ring_edges, segments_intersect, vertex_mean
from strider.sources.geojson import rings, vertices
from strider.storage import shared_dir, written

# Lattice steps in degrees (about 4 m), link lengths in metres, the weight of a change of level.
LON_STEP, LAT_STEP = 0.000045, 0.000036
MAX_LINK_M, NEAREST, SHORT_LINK_M = 10.0, 10, 5.0
ELEVATOR_M, ESCALATOR_M, VERTICAL_WEIGHT = 15.0, 20.0, 15.0
SPECIAL = ("mall_entrance", "shop_entry", "escalator", "elevator")


def lattice(boxes: DataFrame, lon_step: float = LON_STEP, lat_step: float = LAT_STEP) -> DataFrame:
    """rows with a box (min_x, min_y, max_x, max_y) as its lattice points: i, j, x, y, ends included, computed as
    min + i * step. Columns and then rows are exploded, so no value holds a whole lattice."""
    axis = lambda lo, hi, step: F.sequence(F.lit(0), F.floor((F.col(hi) - F.col(lo)) / F.lit(step)).cast("int"))
    points = boxes.withColumn("i", F.explode(axis("min_x", "max_x", lon_step))).withColumn("j", F.explode(axis("min_y", "max_y", lat_step)))
    return points.withColumn("x", F.col("min_x") + F.col("i") * F.lit(lon_step)).withColumn("y", F.col("min_y") + F.col("j") * F.lit(lat_step)).drop("min_x", "min_y", "max_x", "max_y")


def corridor_nodes(classified: DataFrame, lon_step: float = LON_STEP, lat_step: float = LAT_STEP) -> DataFrame:
    """Lattice points inside corridor polygons, numbered in corridor, column, row order: grid_<n>."""
    corridors = classified.where(F.col("class") == "corridor").select("feature_ord", "name", "level", rings(F.col("geometry_type"), F.col("coordinates")).alias("rings"))
    boxed = corridors.where(F.size(F.flatten("rings")) > 0).withColumn("_b", bbox(F.flatten("rings")))
    points = lattice(boxed.select("feature_ord", "name", "level", "rings", "_b.*"), lon_step, lat_step)
    inside = points.where(point_in_polygon(F.col("x"), F.col("y"), F.col("rings"))).drop("rings")
    # numbers run on over corridors: a corridor's first number is the count of the nodes before it
    counts = inside.groupBy("feature_ord").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select("feature_ord", F.coalesce(F.sum("_n").over(W.orderBy("feature_ord").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    ord_ = (F.col("_start") + F.row_number().over(W.partitionBy("feature_ord").orderBy("i", "j")) - 1).alias("grid_ord")
    return inside.join(F.broadcast(starts), "feature_ord").select(ord_, "x", "y", "level", F.col("name").alias("corridor_name")).withColumn("id", F.concat(F.lit("grid_"), F.col("grid_ord")))


def special_nodes(classified: DataFrame) -> DataFrame:
    """Entrances at their point, escalators and elevators at their vertex mean."""
    mean = vertex_mean(vertices(F.col("geometry_type"), F.col("coordinates")))
    return classified.where(F.col("class").isin(*SPECIAL)).select("id", mean["x"].alias("x"), mean["y"].alias("y"), "level", F.col("class").alias("type"), "name")


def boundary_segments(classified: DataFrame) -> DataFrame:
    """level and end points of every corridor ring edge."""
    r = classified.where(F.col("class") == "corridor").select("level", rings(F.col("geometry_type"), F.col("coordinates")).alias("rings"))
    return r.select("level", F.inline(F.flatten(F.transform("rings", ring_edges))))


def _cells(x1, y1, x2, y2, cell_m: float):
    """The cells that the box of a segment touches."""
    span = lambda a, b, k: F.sequence(F.floor(F.least(a, b) * F.lit(k / cell_m)), F.floor(F.greatest(a, b) * F.lit(k / cell_m)))
    return F.flatten(F.transform(span(x1, x2, LON_DEG_TO_M), lambda cx: F.transform(span(y1, y2, LAT_DEG_TO_M), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))))


def without_crossing(links: DataFrame, segments: DataFrame, key: list[str], cell_m: float = MAX_LINK_M) -> DataFrame:
    """Links (level, x1, y1, x2, y2 and key) that cross no boundary segment of their level.

    Both sides are dealt to the cells they touch, so only near ones meet."""
    put = lambda df, *c: df.select("*", F.inline(_cells(*(F.col(x) for x in c), cell_m)))
    s = put(segments.select("level", *[F.col(c).alias(f"s{c}") for c in ("x1", "y1", "x2", "y2")]), "sx1", "sy1", "sx2", "sy2")
    c = F.col
    hit = put(links, "x1", "y1", "x2", "y2").join(s, ["level", "cx", "cy"]).where(segments_intersect(c("x1"), c("y1"), c("x2"), c("y2"), c("sx1"), c("sy1"), c("sx2"), c("sy2"))).select(*key).distinct()
    return links.join(hit, key, "left_anti")


def near_pairs(nodes: DataFrame, radius_m: float, group: str = "level", order: str = "grid_ord") -> DataFrame:
    """Pairs of points of one group within a radius, first by order: a range join as an equi-join on cells."""
    cell = lambda c, k: F.floor(F.col(c) * F.lit(k / radius_m))
    at = nodes.select(group, order, "x", "y", cell("x", LON_DEG_TO_M).alias("cx"), cell("y", LAT_DEG_TO_M).alias("cy"))
    a = at.select(group, F.col(order).alias("a"), F.col("x").alias("x1"), F.col("y").alias("y1"), "cx", "cy")
    around = F.array(*[F.struct((F.col("cx") + dx).alias("cx"), (F.col("cy") + dy).alias("cy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    b = at.select(group, F.col(order).alias("b"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.inline(around))
    dist = distance_m(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    return a.join(b, [group, "cx", "cy"]).where("a < b").withColumn("dist", dist).where(F.col("dist") <= radius_m).drop("cx", "cy")


def corridor_edges(grid: DataFrame, segments: DataFrame) -> DataFrame:
    """Lattice points within MAX_LINK_M that see each other."""
    links = without_crossing(near_pairs(grid, MAX_LINK_M), segments, ["a", "b"])
    return links.select(F.concat(F.lit("grid_"), "a").alias("source"), F.concat(F.lit("grid_"), "b").alias("target"), F.col("dist").alias("weight"), "level", F.lit("corridor").alias("type"))


def nearest(points: DataFrame, targets: DataFrame, k: int = NEAREST, group: str = "level", order: str = "grid_ord", radius_m: float = MAX_LINK_M) -> DataFrame:
    """For each point (id, x, y) its k nearest targets of its group, ranked by distance, then order.

    Points meet the targets of the nine cells around them, so all within a cell's width are found; points that have k of
    these are done, the others go on with cells four times as wide, until a cell covers everything."""
    spark, out = points.sparkSession, shared_dir(points.sparkSession)
    left = written(points.select("id", group, F.col("x").alias("x1"), F.col("y").alias("y1")), f"{out}/points")
    t = written(targets.select(group, F.col(order).alias("target_ord"), F.col("x").alias("x2"), F.col("y").alias("y2")), f"{out}/targets")
    ends = left.select(F.col("x1").alias("x"), F.col("y1").alias("y")).unionByName(t.select(F.col("x2").alias("x"), F.col("y2").alias("y")))
    box = ends.agg(((F.max("x") - F.min("x")) * LON_DEG_TO_M).alias("w"), ((F.max("y") - F.min("y")) * LAT_DEG_TO_M).alias("h")).first()
    span = (box["w"] or 0.0) + (box["h"] or 0.0)
    dist = distance_m(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    found = []
    while True:
        cell = lambda c, m: F.floor(F.col(c) * F.lit(m / radius_m))  # noqa: E731,B023
        around = F.array(*[F.struct((cell("x2", LON_DEG_TO_M) + dx).alias("cx"), (cell("y2", LAT_DEG_TO_M) + dy).alias("cy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
        near = left.withColumn("cx", cell("x1", LON_DEG_TO_M)).withColumn("cy", cell("y1", LAT_DEG_TO_M)).join(t.select("*", F.inline(around)), [group, "cx", "cy"]).drop("cx", "cy").withColumn("dist", dist)
        last = radius_m > span
        near = near if last else near.where(F.col("dist") <= radius_m)
        near = near.withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy("dist", "target_ord"))).where(F.col("rank") <= k)
        near = written(near, f"{out}/near/{len(found)}")
        if last:
            found.append(near)
            break
        done = near.where(F.col("rank") == k).select("id")
        found.append(near.join(done, "id", "left_semi"))
        left = written(left.join(done, "id", "left_anti"), f"{out}/left/{len(found)}")
        if left.isEmpty():
            break
        radius_m *= 4
    ranked = found[0]
    for more in found[1:]:
        ranked = ranked.unionByName(more)
    return ranked


def first_usable(ranked: DataFrame, clear: DataFrame, short_m: float = SHORT_LINK_M) -> DataFrame:
    """Per point the first candidate that is clear or short, else its nearest, as a fallback."""
    ok = ranked.join(clear.select("id", "target_ord", F.lit(True).alias("_clear")), ["id", "target_ord"], "left").withColumn("_ok", F.coalesce("_clear", F.lit(False)) | (F.col("dist") < short_m))
    pick = F.struct("target_ord", "dist")
    best = ok.groupBy("id", "level").agg(F.min_by(pick, F.when(F.col("_ok"), F.col("rank"))).alias("_first"), F.min_by(pick, "rank").alias("_near"), F.max("_ok").alias("_any"))
    chosen = F.when(F.col("_any"), F.col("_first")).otherwise(F.col("_near"))
    return best.select("id", "level", chosen["target_ord"].alias("target_ord"), chosen["dist"].alias("dist"), F.when(F.col("_any"), "connection").otherwise("connection_fallback").alias("type"))


def special_edges(special: DataFrame, grid: DataFrame, segments: DataFrame) -> DataFrame:
    """Every special node to a lattice point of its level."""
    ranked = nearest(special, grid)
    linked = first_usable(ranked, without_crossing(ranked, segments, ["id", "target_ord"]))
    return linked.select(F.col("id").alias("source"), F.concat(F.lit("grid_"), "target_ord").alias("target"), F.col("dist").alias("weight"), "level", "type")


def vertical_edges(nodes: DataFrame, kind: str, radius_m: float) -> DataFrame:
    """Nodes of one kind on adjacent levels, close in plan. Levels must be whole numbers."""
    n = nodes.where(F.col("type") == kind).select("id", "x", "y", F.col("level").cast("int").alias("l"))
    a, b = n.alias("a"), n.withColumn("l", F.col("l") - 1).alias("b")
    near = distance_m(F.col("a.x"), F.col("a.y"), F.col("b.x"), F.col("b.y")) < radius_m
    return a.join(b, F.col("a.l") == F.col("b.l")).where(near & (F.col("a.id") != F.col("b.id"))).select(
        F.col("a.id").alias("source"), F.col("b.id").alias("target"), F.lit(VERTICAL_WEIGHT).alias("weight"), F.concat_ws("-", F.col("a.l"), F.col("a.l") + 1).alias("level"), F.lit(kind).alias("type")
    )


def connected_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that some edge touches."""
    ends = edges.select(F.col("source").alias("id")).unionByName(edges.select(F.col("target").alias("id"))).distinct()
    return nodes.join(ends, "id", "left_semi").select(nodes.columns)


def build_graph(classified: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a venue, as written tables: each part is computed once."""
    out = shared_dir(classified.sparkSession)
    classified = written(classified, f"{out}/classified")
    grid = written(corridor_nodes(classified), f"{out}/grid")
    special, segments = special_nodes(classified), boundary_segments(classified)
    nodes = grid.select("id", "x", "y", "level", F.lit("corridor").alias("type"), "corridor_name", F.lit(None).cast("string").alias("name")).unionByName(special, allowMissingColumns=True)
    edges = (
        corridor_edges(grid, segments)
        .unionByName(special_edges(special, grid, segments))
        .unionByName(vertical_edges(special, "elevator", ELEVATOR_M))
        .unionByName(vertical_edges(special, "escalator", ESCALATOR_M))
    )
    edges = written(edges, f"{out}/edges")
    return written(connected_nodes(nodes, edges), f"{out}/nodes"), edges


def build_report(classified: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """What, key, n: features by class, corridor nodes by corridor, edges by type."""
    count = lambda df, what, key: df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "key", "n")
    return count(classified, "features", "class").unionByName(count(nodes, "corridor_nodes", "corridor_name")).unionByName(count(edges, "edges", "type"))
