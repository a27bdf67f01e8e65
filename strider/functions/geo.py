"""Planar geometry as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from strider.config import LAT_DEG_TO_M, LON_DEG_TO_M

WORLD_M = 20037508.34
#: The printed map measures degrees of latitude in its own metres.
MAP_DEG_M = 111111.0


def distance_m(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """flat-earth metres between two lon/lat points."""
    return F.hypot((x1 - x2) * F.lit(LON_DEG_TO_M), (y1 - y2) * F.lit(LAT_DEG_TO_M))


def cell(coord: Column, deg_to_m: float, cell_m: float) -> Column:
    """grid cell of a coordinate, truncated toward zero."""
    return (coord * F.lit(deg_to_m) / F.lit(cell_m)).cast("int")


def mercator_lon(x: Column) -> Column:
    return x / F.lit(WORLD_M) * F.lit(180.0)


def mercator_lat(y: Column) -> Column:
    """F2."""
    lat = y / F.lit(WORLD_M) * F.lit(180.0)
    return F.lit(180.0 / math.pi) * (F.lit(2.0) * F.atan(F.exp(lat * F.lit(math.pi / 180.0))) - F.lit(math.pi / 2))


def in_view(x: Column, y: Column, hx: Column, hy: Column, panel_x: Column, panel_y: Column, orientation: Column, view_dist: float, cos_cone: float) -> Column:
    """P5 without the floor test: a walker at (x, y) heading along (hx, hy), in degrees, sees the panel.

    In range but not on the panel, inside the panel's cone, and facing the panel unless standing still."""
    dx, dy = (x - panel_x) * F.lit(LON_DEG_TO_M), (y - panel_y) * F.lit(LAT_DEG_TO_M)
    dist = F.hypot(dx, dy)
    safe = F.when(dist > 1e-6, dist)
    ux, uy = dx / safe, dy / safe
    theta = F.radians(orientation)
    faces = ux * F.sin(theta) + uy * F.cos(theta) >= F.lit(cos_cone)
    hxm, hym = hx * F.lit(LON_DEG_TO_M), hy * F.lit(LAT_DEG_TO_M)
    moved = F.hypot(hxm, hym)
    speed = F.when(moved > 1e-4, moved)
    looks = (-(hxm / speed) * ux - (hym / speed) * uy) >= F.lit(cos_cone)
    return F.coalesce((dist > 1e-6) & (dist <= F.lit(view_dist)) & faces & ((moved <= 1e-4) | looks), F.lit(False))


def ccw(ax, ay, bx, by, cx, cy) -> Column:
    return (cy - ay) * (bx - ax) > (by - ay) * (cx - ax)


def segments_intersect(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """proper crossing of ab and cd; a shared end point does not count."""
    return (ccw(ax, ay, cx, cy, dx, dy) != ccw(bx, by, cx, cy, dx, dy)) & (ccw(ax, ay, bx, by, cx, cy) != ccw(ax, ay, bx, by, dx, dy))


def ring_crossing(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """whether the ray from (px, py) to the right crosses a ring edge; lower end open, upper closed."""
    spans = (py > F.least(y1, y2)) & (py <= F.greatest(y1, y2)) & (px <= F.greatest(x1, x2))
    at = (py - y1) * (x2 - x1) / F.when(y1 != y2, y2 - y1) + x1
    return F.coalesce(spans & (y1 != y2) & ((x1 == x2) | (px <= at)), F.lit(False))


def ring_edges(ring: Column) -> Column:
    """A ring (array of points) as edges with the wrap-around one; empty under three points."""
    n = F.size(ring)
    at = lambda i: F.element_at(ring, i.cast("int"))
    edge = lambda i: F.struct(at(i)[0].alias("x1"), at(i)[1].alias("y1"), at(i % n + 1)[0].alias("x2"), at(i % n + 1)[1].alias("y2"))
    none = F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double>>")
    return F.when(n >= 3, F.transform(F.sequence(F.lit(1), n), edge)).otherwise(none)


def point_in_polygon(px: Column, py: Column, rings: Column) -> Column:
    """even-odd test of a polygon (array of rings): inside the first ring and in none of the others."""
    inside = lambda ring: F.aggregate(ring_edges(ring), F.lit(False), lambda acc, e: acc != ring_crossing(px, py, e["x1"], e["y1"], e["x2"], e["y2"]))
    holes = F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0)))
    return F.when(F.size(rings) > 0, inside(F.element_at(rings, 1)) & ~F.exists(holes, inside)).otherwise(F.lit(False))


def crosses(px1: Column, py1: Column, px2: Column, py2: Column, rings: Column) -> Column:
    """a segment properly crosses an edge of any ring."""
    return F.exists(F.flatten(F.transform(rings, ring_edges)), lambda e: segments_intersect(px1, py1, px2, py2, e["x1"], e["y1"], e["x2"], e["y2"]))


def vertex_mean(points: Column) -> Column:
    """(x, y) mean of all vertices, the closing one included; (0, 0) of none."""
    n = F.size(points)
    mean = lambda k: F.when(n > 0, F.aggregate(points, F.lit(0.0), lambda a, p: a + p[k]) / F.when(n > 0, n)).otherwise(F.lit(0.0))
    return F.struct(mean(0).alias("x"), mean(1).alias("y"))


def bbox(points: Column) -> Column:
    """Extent of all vertices; zeros of none."""
    side = lambda f, k: F.coalesce(f(F.transform(points, lambda p: p[k])), F.lit(0.0))
    return F.struct(side(F.array_min, 0).alias("min_x"), side(F.array_min, 1).alias("min_y"), side(F.array_max, 0).alias("max_x"), side(F.array_max, 1).alias("max_y"))


def mean_of(x: Column, y: Column) -> Column:
    """A13 as an aggregate, of points that are rows."""
    return F.struct(F.avg(x).alias("x"), F.avg(y).alias("y"))


def bbox_of(x: Column, y: Column) -> Column:
    """A14 as an aggregate, of points that are rows."""
    return F.struct(F.min(x).alias("min_x"), F.min(y).alias("min_y"), F.max(x).alias("max_x"), F.max(y).alias("max_y"))


def wedge(lat: Column, lon: Column, orientation: Column, view_dist: float, cone_angle: float) -> Column:
    """viewing wedge as (lat, lon) vertices: centre, arc every five degrees, centre."""
    n = int(2 * cone_angle // 5)
    centre = F.struct(lat.alias("lat"), lon.alias("lon"))
    angle = lambda i: F.radians(orientation - F.lit(cone_angle) + i * F.lit(5.0))
    arc = F.transform(
        F.sequence(F.lit(0), F.lit(n)),
        lambda i: F.struct((lat + F.lit(view_dist) * F.cos(angle(i)) / F.lit(LAT_DEG_TO_M)).alias("lat"), (lon + F.lit(view_dist) * F.sin(angle(i)) / F.lit(LON_DEG_TO_M)).alias("lon")),
    )
    return F.concat(F.array(centre), arc, F.array(centre))


def arrow(lat: Column, lon: Column, orientation: Column, shaft_m: float = 3.0, wing_m: float = 0.8, wing_deg: float = 150.0) -> Column:
    """orientation arrow as (lat, lon): start, tip, left and right wing."""
    theta = F.radians(orientation)
    step = lambda la, lo, a, m: (la + F.lit(m) * F.cos(a) / F.lit(MAP_DEG_M), lo + F.lit(m) * F.sin(a) / (F.lit(MAP_DEG_M) * F.cos(F.radians(la))))
    tip = step(lat, lon, theta, shaft_m)
    left, right = (step(*tip, theta + F.lit(s * math.radians(wing_deg)), wing_m) for s in (1, -1))
    return F.array(*[F.struct(la.alias("lat"), lo.alias("lon")) for la, lo in ((lat, lon), tip, left, right)])
