"""Panel inventories: CSV in and out, edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strider.functions.text import fixed
from strider.schemas import PANEL_CSV

DEFAULT_SITE = "17056"


def unquoted(col: Column) -> Column:
    """S3: trimmed, one quote taken off either end, missing as empty."""
    return F.coalesce(F.regexp_replace(F.regexp_replace(F.trim(col), '^"', ""), '"$', ""), F.lit(""))


def read_panels(spark: SparkSession, path: str) -> DataFrame:
    """A panel CSV with a header, BOM or not; blank lines skipped, columns found by name, the order
    of the file kept in panel_ord. Numbers that are none become null."""
    raw = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    names = {c.strip().lstrip("﻿").strip('"'): c for c in raw.columns}
    have = raw.select(*[(unquoted(F.col(f"`{names[f.name]}`")) if f.name in names else F.lit("")).alias(f.name) for f in PANEL_CSV], F.monotonically_increasing_id().alias("_at"))
    have = have.where("panel_id <> ''")
    num = lambda c: F.col(c).try_cast("double")
    # inventories are small: numbering them by place in the file is one task by design
    order = (F.row_number().over(W.orderBy("_at")) - 1).cast("int")
    site = F.coalesce(F.nullif(F.col("site_id"), F.lit("")), F.lit(DEFAULT_SITE))
    return have.select("panel_id", site.alias("site_id"), num("latitude").alias("latitude"), num("longitude").alias("longitude"), num("orientation").alias("orientation"), F.trim("floor").alias("floor"), order.alias("panel_ord"))


def read_map_table(spark: SparkSession, path: str) -> DataFrame:
    """Comma-separated, or tab-separated if that gives one column. All text."""
    df = spark.read.option("header", True).csv(path)
    return df if len(df.columns) > 1 else spark.read.option("header", True).option("sep", "\t").csv(path)


def edit_panels(panels: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits (panel_id and any of latitude, longitude, orientation, floor) replace a panel's values; null, and
    text that is no number, leaves them. Orientations are whole degrees."""
    have = [c for c in ("latitude", "longitude", "orientation", "floor") if c in edits.columns]
    new = edits.select("panel_id", *[F.col(c).alias(f"_{c}") for c in have]).dropDuplicates(["panel_id"])
    joined = panels.join(new, "panel_id", "left")
    for c in have:
        value = F.trim(F.col(f"_{c}").cast("string")) if c == "floor" else F.col(f"_{c}").try_cast("double")
        if c == "orientation":
            value = value.cast("bigint").cast("double")
        joined = joined.withColumn(c, F.coalesce(value, F.col(c)))
    return joined.select(panels.columns)


def panel_lines(panels: DataFrame) -> DataFrame:
    """K6: the panel table as written back, coordinates with eight decimals."""
    return panels.select("panel_id", "site_id", fixed(F.col("latitude"), 8).alias("latitude"), fixed(F.col("longitude"), 8).alias("longitude"), F.col("orientation").cast("bigint").alias("orientation"), "floor", "panel_ord")


def write_panels(panels: DataFrame, path: str) -> None:
    panel_lines(panels).orderBy("panel_ord").drop("panel_ord").coalesce(1).write.mode("overwrite").option("header", True).csv(path)
