"""Result files: panel metrics, pair overlap, score report, exposure vectors (K1-K4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strider import config as C
from strider.functions.text import fixed, floor_label, panel_label, plain_number


def _csv(df: DataFrame, path: str, order: list) -> None:
    df.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_panel_metrics(ranked: DataFrame, path: str) -> None:
    """K1."""
    out = ranked.select("rank", "panel_id", "floor", "unique_reach", "contacts", fixed(F.col("efficiency_pct"), 2).alias("exposure_efficiency_pct"))
    _csv(out, path, ["rank"])


def write_pair_overlap(pairs: DataFrame, path: str) -> None:
    """K2."""
    _csv(pairs.withColumn("overlap_coefficient", fixed(F.col("overlap_coefficient"), 6)), path, ["panel_a", "panel_b"])


def score_report(ranked: DataFrame, panels: DataFrame, config: C.SimConfig, title: str, timestamp: str) -> DataFrame:
    """K3: numbered lines of the report: a commented head with the parameters, a header, a row for each panel."""
    import json

    counts = panels.agg(F.count_if("active").alias("active"), F.count(F.lit(1)).alias("all")).first()
    head = [
        title,
        f"Export Timestamp: {timestamp}",
        "",
        "--- SIMULATION CONFIGURATION PARAMETERS ---",
        f"Weekly Visits (non-unique): {config.weekly_visits:,}",
        f"Weekly Unique People: {config.weekly_uniques:,}",
        f"Daily Weights (Profile A): {', '.join(f'{w:g}' for w in config.daily_weights)}",
        f"Min Shop Visits: {config.min_visits}",
        f"Max Shop Visits: {config.max_visits}",
        f"Base Walking Speed (m/s): {config.walk_speed:g}",
        f"Huff Decay Exponent (alpha): {config.decay_exponent:g}",
        f"Routing Mode: {config.routing_mode}",
        f"Route Progress Beta: {config.beta_progress:g}",
        f"Route Randomness: {config.randomness:g}",
        f"Escalator Zone Boost: {config.zone_boost:g}",
        f"Route Vertical Beta: {config.beta_vertical:g}",
        f"Max Viewing Distance (m): {config.view_dist:g}",
        f"Viewing Cone Angle: {config.cone_angle:g}°",
        f"Active Sensors: {counts['active']} / {counts['all']}",
        f"Store Category Weights: {json.dumps(config.category_weights, separators=(',', ':'))}",
        "-------------------------------------------",
        "",
    ]
    lines = [f"# {x}".rstrip() for x in head] + ["Rank,Panel ID,Floor,Orientation,Latitude,Longitude,Active,Unique Reach,Contacts,Exposure Efficiency (%)"]
    top = panels.sparkSession.createDataFrame(list(enumerate(lines)), "line long, value string")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    row = F.concat_ws(
        ",", F.col("rank"), quoted(panel_label(F.col("panel_id"))), quoted(floor_label(F.col("floor"))), plain_number(F.col("orientation")), F.col("latitude").cast("string"), F.col("longitude").cast("string"),
        quoted(F.when(F.col("active"), "Yes").otherwise("No")), F.col("unique_reach"), F.col("contacts"), fixed(F.col("efficiency_pct"), 2),
    )
    body = ranked.select("rank", "panel_id", "floor", "unique_reach", "contacts", "efficiency_pct").join(panels.select("panel_id", "orientation", "latitude", "longitude", "active"), "panel_id").select((F.col("rank") + len(lines)).cast("long").alias("line"), row.alias("value"))
    return top.unionByName(body)


def write_lines(report: DataFrame, path: str) -> None:
    report.orderBy("line").coalesce(1).select("value").write.mode("overwrite").text(path)


def write_vectors(vectors: DataFrame, path: str) -> None:
    """K4."""
    out = vectors.select(panel_label(F.col("panel_id")).alias("Panel ID"), F.col("format").alias("Format"), F.col("data").alias("Interaction Data"))
    _csv(out, path, ["Panel ID"])
