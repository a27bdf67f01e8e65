"""Audience metrics over exposures (trip, person, panel_id, contacts)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strider.functions.text import plain_number

WATCH_LIST = ("27052", "27053", "27054")


def panel_metrics(exposures: DataFrame, panels: DataFrame, pool: int | Column) -> DataFrame:
    """A1-A3: every panel with its unique reach, contacts and efficiency (percent of the pool), zeros included."""
    seen = exposures.where("contacts > 0").groupBy("panel_id").agg(F.countDistinct("person").alias("unique_reach"), F.sum("contacts").cast("long").alias("contacts"))
    out = panels.join(seen, "panel_id", "left").withColumn("unique_reach", F.coalesce("unique_reach", F.lit(0)).cast("long")).withColumn("contacts", F.coalesce("contacts", F.lit(0)).cast("long"))
    pool = pool if isinstance(pool, Column) else F.lit(pool)
    return out.withColumn("efficiency_pct", F.col("unique_reach") * F.lit(100.0) / F.when(pool > 0, pool))


def bitmap_reach(exposures: DataFrame) -> DataFrame:
    """Unique reach from mergeable bitmaps; people are whole numbers from 0."""
    at = F.col("person") + 1
    buckets = exposures.where("contacts > 0").select("panel_id", F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("bit"))
    bits = buckets.groupBy("panel_id", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    return bits.groupBy("panel_id").agg(F.sum(F.bitmap_count("bits")).alias("unique_reach"))


def bitmap_union_reach(exposures: DataFrame, key: list[str]) -> DataFrame:
    """A4, O1: unique people over all panels of a key, by merging the panels' bitmaps."""
    at = F.col("person") + 1
    buckets = exposures.where("contacts > 0").select(*key, "panel_id", F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("bit"))
    bits = buckets.groupBy(*key, "panel_id", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    merged = bits.groupBy(*key, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return merged.groupBy(*key).agg(F.sum(F.bitmap_count("bits")).alias("unique_reach"))


def ranked(metrics: DataFrame) -> DataFrame:
    """By reach, ties in file order. A report of panels: one task by design."""
    return metrics.withColumn("rank", F.row_number().over(W.orderBy(F.col("unique_reach").desc(), "panel_ord")))


def leaderboard(metrics: DataFrame, query: str = "") -> DataFrame:
    """Panels whose id or floor contains the text, ranked among themselves."""
    q = query.strip().lower()
    found = metrics.where(F.contains(F.lower("panel_id"), F.lit(q)) | F.contains(F.lower("floor"), F.lit(q))) if q else metrics
    return ranked(found)


def search_panels(panels: DataFrame, query: str) -> DataFrame:
    """P10: id contains the text in any case, or the orientation's text does."""
    q = query.strip().lower()
    return panels.where(F.contains(F.lower("panel_id"), F.lit(q)) | F.contains(plain_number(F.col("orientation")), F.lit(q)))


def select_panels(panels: DataFrame, which: str) -> DataFrame:
    """P8: "all", "none" or a floor."""
    if which == "all":
        return panels
    return panels.where(F.lit(False)) if which == "none" else panels.where(F.col("floor") == which)


def top_panels(metrics: DataFrame, k: int = 5) -> DataFrame:
    """A report of k rows."""
    return metrics.orderBy(F.col("unique_reach").desc(), "panel_ord").limit(k)


def watched(metrics: DataFrame, ids=WATCH_LIST) -> DataFrame:
    """A fixed list; ids that do not exist are left out."""
    return metrics.where(F.col("panel_id").isin(*ids))


def summary(exposures: DataFrame, pool: int | Column) -> DataFrame:
    """One row: people who saw any panel, all contacts, coverage in percent."""
    pool = pool if isinstance(pool, Column) else F.lit(pool)
    one = exposures.where("contacts > 0").agg(F.countDistinct("person").alias("unique_reach"), F.coalesce(F.sum("contacts"), F.lit(0)).cast("long").alias("contacts"))
    return one.withColumn("coverage_pct", F.round(F.col("unique_reach") * F.lit(100.0) / F.when(pool > 0, pool), 2))


def coverage(exposures: DataFrame, panels: DataFrame, ids, pool: int | Column) -> DataFrame:
    """The same over the active panels, with their number."""
    chosen = panels if ids is None else panels.where(F.col("panel_id").isin(list(ids)))
    counts = panels.agg(F.count(F.lit(1)).alias("all_panels")).crossJoin(chosen.agg(F.count(F.lit(1)).alias("active_panels")))  # single rows
    return summary(exposures.join(chosen.select("panel_id"), "panel_id", "left_semi"), pool).crossJoin(counts)


def floor_reach(exposures: DataFrame, panels: DataFrame, floors=("1", "2", "3")) -> DataFrame:
    """People per panel floor, zeros for floors without any."""
    seen = exposures.where("contacts > 0").join(panels.select("panel_id", "floor"), "panel_id").groupBy("floor").agg(F.countDistinct("person").alias("n"), F.sum("contacts").alias("c"))
    base = exposures.sparkSession.createDataFrame([(f,) for f in floors], "floor string")
    return base.join(seen, "floor", "left").select("floor", F.coalesce("n", F.lit(0)).cast("long").alias("unique_reach"), F.coalesce("c", F.lit(0)).cast("long").alias("contacts"))


def category_visits(visits: DataFrame, categories) -> DataFrame:
    """Visits (category, current, target) that led somewhere else, zeros included."""
    n = visits.where(~F.col("target").eqNullSafe(F.col("current"))).groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    base = visits.sparkSession.createDataFrame([(c,) for c in categories], "category string")
    return base.join(n, "category", "left").select("category", F.coalesce("n", F.lit(0)).cast("long").alias("visits"))


def panel_centre(panels: DataFrame) -> DataFrame:
    """Mean latitude and longitude."""
    return panels.agg(F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"))
