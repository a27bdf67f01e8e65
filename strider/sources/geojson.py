"""GeoJSON feature collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strider.schemas import GEOJSON

#: Nesting of coordinates by geometry type.
DEPTH = {"Point": 1, "LineString": 2, "MultiPoint": 2, "Polygon": 3, "MultiLineString": 3, "MultiPolygon": 4}


def array_type(depth: int) -> str:
    return "array<" * depth + "double" + ">" * depth


def parsed(coordinates: Column, depth: int) -> Column:
    return F.from_json(coordinates, array_type(depth))


def vertices(geometry_type: Column, coordinates: Column) -> Column:
    """All points of a geometry, whatever its nesting."""
    out = F.lit(None).cast(array_type(2))
    for kind, depth in DEPTH.items():
        value = parsed(coordinates, depth)
        points = F.array(value) if depth == 1 else value
        for _ in range(depth - 2):
            points = F.flatten(points)
        out = F.when(geometry_type == kind, points).otherwise(out)
    return out


def rings(geometry_type: Column, coordinates: Column) -> Column:
    """The rings of a polygon. A geometry of another type has none to give and is refused (D19): a corridor that is a
    MultiPolygon must be split into its polygons first."""
    wrong = F.raise_error(F.concat(F.lit("rings of a "), F.coalesce(geometry_type, F.lit("null")), F.lit(": only a Polygon has rings")))
    return F.when(geometry_type == "Polygon", parsed(coordinates, 3)).otherwise(wrong.cast(array_type(3)))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """feature_ord, properties (map), geometry_type, coordinates (JSON text)."""
    doc = spark.read.schema(GEOJSON).option("multiLine", True).json(path)
    return doc.select(F.posexplode("features").alias("feature_ord", "f")).select("feature_ord", F.col("f.properties").alias("properties"), F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates"))


def feature_document(features: DataFrame, name: str) -> DataFrame:
    """K8: one row `value` with the collection; coordinates stay the JSON they are."""
    quote = lambda c: F.to_json(F.struct(c.alias("v")))
    props = F.to_json("properties")
    kind = F.regexp_extract(quote(F.col("geometry_type")), r'^\{"v":(.*)\}$', 1)
    one = F.concat(F.lit('{"type":"Feature","properties":'), props, F.lit(',"geometry":{"type":'), kind, F.lit(',"coordinates":'), F.col("coordinates"), F.lit("}}"))
    rows = features.select("feature_ord", one.alias("_f")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("feature_ord", "_f"))), lambda s: s["_f"]), ",").alias("_all"))
    return rows.select(F.concat(F.lit('{"type":"FeatureCollection","name":"' + name + '","features":['), F.col("_all"), F.lit("]}")).alias("value"))


def write_features(features: DataFrame, name: str, path: str) -> None:
    feature_document(features, name).write.mode("overwrite").text(path)
