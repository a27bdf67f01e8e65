"""An example venue of two floors, made by rule: corridors, shops, entrances, escalators, elevators and panels."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession

from strider.functions.geo import WORLD_M

LEVELS, LENGTH_M, WIDTH_M, SHOPS = 2, 60.0, 12.0, 10
LON, LAT = 174.777, -36.871
ANCHOR = "escalator_lv2_1"


def _mercator(lon: float, lat: float) -> list[float]:
    y = math.log(math.tan(math.pi / 4 + math.radians(lat) / 2)) * WORLD_M / math.pi
    return [lon * WORLD_M / 180.0, y]


def _at(x_m: float, y_m: float) -> tuple[float, float]:
    return LON + x_m / 88800.0, LAT + y_m / 111000.0


def _box(x: float, y: float, w: float, h: float) -> list:
    return [_mercator(*_at(x + a * w, y + b * h)) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))]


def zone_rows() -> list[tuple]:
    """(feature_ord, properties, geometry type, coordinates) of raw zones in web-mercator metres."""
    rows: list[tuple] = []

    def add(kind: str, name: str, level: int, rings: list) -> None:
        rows.append((len(rows), {"fid": str(len(rows)), "zone_type": kind, "zone_name": name, "floor_level": str(level)}, "Polygon", json.dumps(rings)))

    for level in range(1, LEVELS + 1):
        # a corridor with a hole, and one that leads off it
        add("corridor", f"main_lv{level}", level, [_box(0, 0, LENGTH_M, WIDTH_M), _box(26, 5, 8, 2)])
        for k in range(SHOPS):
            x = 3 + k * (LENGTH_M - 6) / (SHOPS - 1)
            add("entry_exit", f"{('farmers', 'jbhifi', 'hm', 'store', 'kiosk')[k % 5]}{k}_lv{level}_entry", level, [_box(x, -1.0 if k % 2 else WIDTH_M, 1, 1)])
        add("escalator", f"escalator_lv{level}_1", level, [_box(18, 5, 2, 2)])
        add("elevator", f"elevator_lv{level}_1", level, [_box(44, 5, 2, 2)])
        add("shops", f"room_lv{level}", level, [_box(0, 20, 10, 10)])
        add("entry_exit", f"entry_exit_lv{level}_a", level, [_box(-1, 5, 1, 1)])
        add("entry_exit", f"entry_exit_lv{level}_b", level, [_box(LENGTH_M, 5, 1, 1)])
    return rows


def zones(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(zone_rows(), "feature_ord int, properties map<string,string>, geometry_type string, coordinates string")


def panel_rows() -> list[tuple]:
    out = []
    for level in range(1, LEVELS + 1):
        for k in range(6):
            lon, lat = _at(5 + 10 * k, 0.5 if k % 2 else WIDTH_M - 0.5)
            out.append((str(27000 + len(out)), "17056", lat, lon, float(90 * (k % 4)), str(level), len(out)))
    return out


def panels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(panel_rows(), "panel_id string, site_id string, latitude double, longitude double, orientation double, floor string, panel_ord int")
