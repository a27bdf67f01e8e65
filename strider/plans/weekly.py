"""The weekly run end to end: graph, distances, trips, walks, exposures, reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from strider.config import SimConfig
from strider.operators import audience, metrics, paths, trips, visibility, walk
from strider.sources import sinks
from strider.sources.graph import directed
from strider.storage import shared_dir, written


@dataclass
class Week:
    trips: DataFrame
    exposures: DataFrame  # trip, person, panel_id, contacts
    metrics: DataFrame
    legs: DataFrame


def simulate(spark: SparkSession, nodes: DataFrame, edges: DataFrame, panels: DataFrame, config: SimConfig, partitions: int = 0) -> Week:
    """One simulated week. Exposures are written once; every report reads them."""
    out = shared_dir(spark)
    nodes, both = written(nodes, f"{out}/nodes"), written(directed(edges), f"{out}/edges")
    watched = visibility.active(panels, config.active_panel_ids)
    views = written(visibility.edge_views(nodes, both, watched, config), f"{out}/views")
    plan = trips.trip_plan(spark, config.weekly_visits, config.weekly_uniques, config.seed)
    plan = plan.repartition(partitions) if partitions else plan
    kernel_views = walk.reachable_views(views) if config.candidates == "floor" else views
    w = walk.world(nodes, both, config, kernel_views, watched)
    legs = walk.simulate_legs(plan, w, config)
    if config.routing_mode == "segment_logit":
        seen = walk.simulate_exposures(plan, w, config)
    else:
        ends = paths.decision_nodes(nodes).select("id")
        hops = walk.shortest_hops(legs, paths.paths(ends, both, ends))
        seen = visibility.passages(hops, views)
    exposures = written(seen, f"{out}/exposures")
    return Week(plan, exposures, metrics.panel_metrics(exposures, panels, config.weekly_uniques), legs)


def report(week: Week, panels: DataFrame, config: SimConfig, path: str) -> None:
    """K1, K2 and the sparse vectors."""
    sinks.write_panel_metrics(metrics.ranked(week.metrics), f"{path}/panel_metrics")
    sinks.write_pair_overlap(audience.pair_overlap(week.exposures, panels), f"{path}/pair_overlap")
    sinks.write_vectors(audience.vectors(week.exposures, panels, config.weekly_uniques, "sparse", 1), f"{path}/vectors")


def console(week: Week, config: SimConfig) -> list[str]:
    """K9: the lines of the run's summary; a handful of rows are collected."""
    s = metrics.summary(week.exposures, config.weekly_uniques).first()
    lines = [f"unique reach {s['unique_reach']:,} ({s['coverage_pct']}%), contacts {s['contacts']:,}"]
    lines += [f"top: panel {r['panel_id']} L{r['floor']} reach {r['unique_reach']:,} contacts {r['contacts']:,}" for r in metrics.top_panels(week.metrics).collect()]
    lines += [f"watched: panel {r['panel_id']} reach {r['unique_reach']:,}" for r in metrics.watched(week.metrics).orderBy("panel_id").collect()]
    return lines
