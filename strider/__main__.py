"""python -m strider: a weekly run from a panel CSV and a graph document."""

import time

from pyspark.sql import SparkSession

from strider.config import from_args
from strider.plans import weekly
from strider.sources.graph import read_graph
from strider.sources.panels import read_panels

if __name__ == "__main__":
    config, args = from_args()
    spark = SparkSession.builder.appName("strider").getOrCreate()
    began = time.time()
    panels = read_panels(spark, args.panels)
    nodes, edges = read_graph(spark, args.graph)
    week = weekly.simulate(spark, nodes, edges, panels, config, args.partitions)
    weekly.report(week, panels, config, args.out)
    print("\n".join(weekly.console(week, config)))
    print(f"{config.weekly_visits / (time.time() - began):,.0f} trips/s")
