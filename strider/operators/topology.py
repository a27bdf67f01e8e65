"""Venue topology: reprojection, tags, classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strider.functions.geo import mercator_lat, mercator_lon, vertex_mean
from strider.sources.geojson import DEPTH, parsed, vertices

# The tags that a zone type stands for.
ZONE_TAGS = {
    "corridor": {"indoor": "corridor"},
    "shops": {"indoor": "room", "shop": "yes"},
    "food_court": {"indoor": "room", "amenity": "food_court"},
    "office": {"indoor": "room", "office": "yes"},
    "seats": {"indoor": "room", "amenity": "bench"},
    "parking": {"indoor": "room", "amenity": "parking"},
    "elevator": {"indoor": "room", "highway": "elevator", "room": "elevator"},
    "escalator": {"indoor": "room", "highway": "steps", "conveying": "yes"},
    "information": {"indoor": "room", "amenity": "information"},
}
ENTRY_ZONE, MALL_PREFIX, MAIN_MARK = "entry_exit", "entry_exit", "lv1"


def _deep(value: Column, depth: int) -> Column:
    if depth == 1:
        return F.array(mercator_lon(value[0]), mercator_lat(value[1]))
    return F.transform(value, lambda v: _deep(v, depth - 1))


def reproject(geometry_type: Column, coordinates: Column) -> Column:
    """coordinates (JSON) from web mercator to degrees; other types unchanged."""
    out = coordinates
    for kind, depth in DEPTH.items():
        out = F.when(geometry_type == kind, F.to_json(_deep(parsed(coordinates, depth), depth))).otherwise(out)
    return out


def _tags(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def convert(features: DataFrame) -> DataFrame:
    """Raw zones (properties fid, zone_type, zone_name, floor_level, in metres) to tagged features in degrees.
    Entries and exits become points at their vertex mean: those whose name starts with the mall prefix are mall
    entrances, the others shop entrances."""
    p = lambda k: F.col("properties")[k]
    kind, name, fid = p("zone_type"), p("zone_name"), F.coalesce(p("fid"), F.lit("None"))
    entry = kind == ENTRY_ZONE
    level = F.coalesce(p("floor_level"), F.lit("None"))
    base = F.create_map(F.lit("@id"), F.concat(F.when(entry, F.lit("node/")).otherwise(F.lit("way/")), fid), F.lit("level"), level, F.lit("name"), name)
    extra = F.create_map().cast("map<string,string>")
    for zone, tags in ZONE_TAGS.items():
        extra = F.when(kind == zone, _tags(tags)).otherwise(extra)
    mall = F.startswith(name, F.lit(MALL_PREFIX))
    entrance = F.when(mall, F.when(F.contains(name, F.lit(MAIN_MARK)), "main").otherwise("yes")).otherwise("shop")
    extra = F.when(entry, F.create_map(F.lit("entrance"), entrance)).otherwise(extra)
    mean = vertex_mean(vertices(F.col("geometry_type"), F.col("coordinates")))
    point = F.to_json(F.array(mercator_lon(mean["x"]), mercator_lat(mean["y"])))
    return features.select(
        "feature_ord", F.map_concat(base, extra).alias("properties"),
        F.when(entry, F.lit("Point")).otherwise(F.col("geometry_type")).alias("geometry_type"),
        F.when(entry, point).otherwise(reproject(F.col("geometry_type"), F.col("coordinates"))).alias("coordinates"),
    )


def feature_class(properties: Column) -> Column:
    """First match wins; null for features that take no part in the graph."""
    tag = lambda k: F.coalesce(properties[k], F.lit(""))
    return (
        F.when(tag("indoor") == "corridor", "corridor")
        .when((tag("highway") == "steps") & (tag("conveying") == "yes"), "escalator")
        .when(tag("highway") == "elevator", "elevator")
        .when(tag("entrance").isin("main", "yes"), "mall_entrance")
        .when(tag("entrance") == "shop", "shop_entry")
    )


def classify(features: DataFrame) -> DataFrame:
    p = F.col("properties")
    return features.select("feature_ord", p["@id"].alias("id"), p["name"].alias("name"), F.coalesce(p["level"], F.lit("1")).alias("level"), feature_class(p).alias("class"), "geometry_type", "coordinates")
