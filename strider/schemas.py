"""Schemas of the engine's tables."""

from pyspark.sql import types as T

_S, _D, _I, _L, _B = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType(), T.BooleanType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


PANEL_CSV = _struct(panel_id=_S, site_id=_S, latitude=_S, longitude=_S, orientation=_S, floor=_S)
PANELS = _struct(panel_id=_S, site_id=_S, latitude=_D, longitude=_D, orientation=_D, floor=_S, panel_ord=_I)
NODES = _struct(id=_S, x=_D, y=_D, level=_S, type=_S, corridor_name=_S, name=_S)
EDGES = _struct(source=_S, target=_S, weight=_D, level=_S, type=_S)
GRAPH_JSON = _struct(nodes=T.ArrayType(NODES), edges=T.ArrayType(EDGES))
TRIPS = _struct(trip=_L, person=_L)
HOPS = _struct(trip=_L, person=_L, leg=_I, hop=_I, src=_S, dst=_S)
EXPOSURES = _struct(trip=_L, person=_L, panel_id=_S, contacts=_L)
#: GeoJSON with coordinates of any depth kept as text; they are parsed per geometry type.
GEOJSON = _struct(
    type=_S,
    name=_S,
    features=T.ArrayType(_struct(type=_S, properties=T.MapType(_S, _S), geometry=_struct(type=_S, coordinates=_S))),
)
