"""Audience tables derived from the driver's tables, in Spark and in SQL.

Events are position samples: a user is a person, event type and event number give the panel, a value of 50 or more is a
hit. Embedding components 1 and 2, scaled, are positions in metres around an origin; the label gives the floor.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strider.operators.visibility import rises

PANELS_PER_TYPE, HIT = 11, 50.0
CSV_EXTRA = "kept apart"
ORIGIN_X, ORIGIN_Y = 174.777, -36.871
#: Degrees by unit of an embedding component: 100 m.
SCALE_X, SCALE_Y = 100.0 / 88800.0, 100.0 / 111000.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_samples(spark: SparkSession, sf_dir: str, people: int | None = None) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    person = F.col("user_id") % people if people else F.col("user_id")
    return e.select(person.alias("person"), F.concat_ws("_", "event_type", (F.col("event_id") % PANELS_PER_TYPE)).alias("panel_id"), (F.col("event_id") % PANELS_PER_TYPE).alias("num"), "ts", "event_id", (F.col("value") >= HIT).alias("hit"))


def event_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = event_samples(spark, sf_dir).select("panel_id", "num").distinct()
    num = F.col("num")
    return p.select(
        "panel_id", F.lit("17056").alias("site_id"), (F.lit(ORIGIN_Y) + (num - 5) * 0.00005).alias("latitude"), (F.lit(ORIGIN_X) + (F.length("panel_id") - 7) * 0.0001).alias("longitude"),
        (num * 37 % 360).cast("double").alias("orientation"), (num % 3 + 1).cast("string").alias("floor"), (F.row_number().over(W.orderBy("panel_id")) - 1).alias("panel_ord"),
    )


def event_exposures(spark: SparkSession, sf_dir: str, people: int | None = None) -> DataFrame:
    marked = rises(event_samples(spark, sf_dir, people), ["person", "panel_id"], ["ts", "event_id"])
    return marked.groupBy(F.col("person").alias("trip"), "person", "panel_id").agg(F.sum(F.col("rise").cast("long")).alias("contacts"))


def event_pool(spark: SparkSession, sf_dir: str) -> int:
    """People in the data; one number."""
    return table(spark, sf_dir, "events").agg(F.countDistinct("user_id")).first()[0]


def events_sql(people: int | None = None) -> str:
    person = f"user_id % {people}" if people else "user_id"
    return f"""s AS (SELECT {person} AS person, event_type || '_' || (event_id % {PANELS_PER_TYPE}) AS panel_id, event_id % {PANELS_PER_TYPE} AS num, ts, event_id, value >= {HIT} AS hit FROM events),
r AS (SELECT *, hit AND NOT coalesce(lag(hit) OVER (PARTITION BY person, panel_id ORDER BY ts, event_id), false) AS rise FROM s),
x AS (SELECT person, panel_id, CAST(sum(rise::INT) AS BIGINT) AS contacts FROM r GROUP BY ALL),
p AS (SELECT DISTINCT panel_id, num, {ORIGIN_Y} + (num - 5) * 0.00005 AS latitude, {ORIGIN_X} + (length(panel_id) - 7) * 0.0001 AS longitude, CAST(num * 37 % 360 AS DOUBLE) AS orientation, CAST(num % 3 + 1 AS VARCHAR) AS floor FROM s),
pool AS (SELECT count(DISTINCT user_id) AS n FROM events),
m AS (SELECT p.panel_id, floor, latitude, longitude, orientation, count(DISTINCT person) FILTER (contacts > 0) AS unique_reach, CAST(coalesce(sum(contacts), 0) AS BIGINT) AS contacts FROM p LEFT JOIN x USING (panel_id) GROUP BY ALL)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, x, y, level from embeddings; grid_ord numbers them."""
    e = table(spark, sf_dir, "embeddings")
    at = lambda i: F.element_at("embedding", i).cast("double")
    return e.select(F.col("vec_id").alias("grid_ord"), (F.lit(ORIGIN_X) + at(1) * SCALE_X).alias("x"), (F.lit(ORIGIN_Y) + at(2) * SCALE_Y).alias("y"), (F.col("label") % 3 + 1).cast("string").alias("level"))


POINTS_SQL = f"pt AS (SELECT vec_id AS grid_ord, {ORIGIN_X} + embedding[1]::DOUBLE * {SCALE_X!r} AS x, {ORIGIN_Y} + embedding[2]::DOUBLE * {SCALE_Y!r} AS y, CAST(label % 3 + 1 AS VARCHAR) AS level FROM embeddings)"


def distance_sql(x1: str, y1: str, x2: str, y2: str) -> str:
    return f"sqrt(power(({x1} - {x2}) * 88800.0, 2) + power(({y1} - {y2}) * 111000.0, 2))"


def point_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All points as panels."""
    p = points(spark, sf_dir)
    return p.select(F.col("grid_ord").cast("string").alias("panel_id"), F.lit("17056").alias("site_id"), F.col("y").alias("latitude"), F.col("x").alias("longitude"), (F.col("grid_ord") * 37 % 360).cast("double").alias("orientation"), F.col("level").alias("floor"), F.col("grid_ord").cast("int").alias("panel_ord"))


PANELS_SQL = f"pn AS (SELECT CAST(grid_ord AS VARCHAR) AS panel_id, y AS py, x AS px, CAST(grid_ord * 37 % 360 AS DOUBLE) AS orientation, level AS floor FROM pt)"
#: The inventory of the events: see event_panels.
INVENTORY_SQL = f"""pn AS (SELECT DISTINCT panel_id, {ORIGIN_Y} + (num - 5) * 0.00005 AS py, {ORIGIN_X} + (length(panel_id) - 7) * 0.0001 AS px, CAST(num * 37 % 360 AS DOUBLE) AS orientation, CAST(num % 3 + 1 AS VARCHAR) AS floor
  FROM (SELECT event_type || '_' || (event_id % {PANELS_PER_TYPE}) AS panel_id, event_id % {PANELS_PER_TYPE} AS num FROM events))"""


def view_sql(x: str, y: str, hx: str, hy: str, view_dist: float, cos_cone: float) -> str:
    """P5 over columns px, py, orientation."""
    dx, dy = f"(({x} - px) * 88800.0)", f"(({y} - py) * 111000.0)"
    d = f"sqrt({dx} * {dx} + {dy} * {dy})"
    mx, my = f"(({hx}) * 88800.0)", f"(({hy}) * 111000.0)"
    m = f"sqrt({mx} * {mx} + {my} * {my})"
    return f"""({d} > 1e-6 AND {d} <= {view_dist} AND {dx} / nullif({d}, 0) * sin(radians(orientation)) + {dy} / nullif({d}, 0) * cos(radians(orientation)) >= {cos_cone!r}
      AND ({m} <= 1e-4 OR -({mx} / nullif({m}, 0)) * ({dx} / nullif({d}, 0)) - ({my} / nullif({m}, 0)) * ({dy} / nullif({d}, 0)) >= {cos_cone!r}))"""


def part_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers, parts, customers, nations and regions as nodes. Every line item links a supplier and a part, which makes
    one large component with nodes of high degree; every order links its customer to one of the seven in its block of
    numbers, which makes many small ones, or, where that is itself, to an end that is no node; nations and regions are
    isolated."""
    named = lambda letter, c: F.concat(F.lit(letter), c)
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    links = li.select(named("s", F.col("l_suppkey")).alias("source"), named("p", F.col("l_partkey")).alias("target"), F.col("l_quantity").cast("double").alias("weight"))
    beside = F.floor(F.col("o_custkey") / 7) * 7 + F.col("o_orderkey") % 7
    other = F.when(beside == F.col("o_custkey"), named("x", beside)).otherwise(named("c", beside))
    links = links.unionByName(o.select(named("c", F.col("o_custkey")).alias("source"), other.alias("target"), F.col("o_totalprice").cast("double").alias("weight")))
    kinds = (("supplier", "supp", "shop_entry"), ("part", "part", "corridor"), ("customer", "cust", "mall_entrance"), ("nation", "nation", "elevator"), ("region", "region", "escalator"))
    nodes = [table(spark, sf_dir, t).select(named(t[0], F.col(f"{t[0]}_{k}key")).alias("id"), F.lit(kind).alias("type")) for t, k, kind in kinds]
    return reduce(DataFrame.unionByName, nodes), links.withColumn("level", F.lit("1")).withColumn("type", F.lit("corridor"))


PART_GRAPH_SQL = """ed AS MATERIALIZED (SELECT 's' || l_suppkey AS source, 'p' || l_partkey AS target, l_quantity::DOUBLE AS weight FROM lineitem
  UNION ALL SELECT 'c' || o_custkey, CASE WHEN o_custkey // 7 * 7 + o_orderkey % 7 = o_custkey THEN 'x' ELSE 'c' END || (o_custkey // 7 * 7 + o_orderkey % 7), o_totalprice::DOUBLE FROM orders),
nd AS MATERIALIZED (SELECT 's' || s_suppkey AS id FROM supplier UNION ALL SELECT 'p' || p_partkey FROM part UNION ALL SELECT 'c' || c_custkey FROM customer UNION ALL SELECT 'n' || n_nationkey FROM nation UNION ALL SELECT 'r' || r_regionkey FROM region),
ok AS MATERIALIZED (SELECT * FROM ed WHERE source IN (SELECT id FROM nd) AND target IN (SELECT id FROM nd)),
both_ AS MATERIALIZED (SELECT source AS a, target AS b FROM ok UNION SELECT target, source FROM ok)"""


def lattice_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers as a lattice ten wide: nodes (id, x, y, level, type, name) and edges to the right and down."""
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select(k, (k % 10).alias("i"), F.floor(k / 10).alias("j"))
    kind = F.when(k % 7 == 0, "mall_entrance").when(k % 3 == 0, "shop_entry").otherwise("corridor")
    nodes = s.select(k.cast("string").alias("id"), (F.lit(ORIGIN_X) + F.col("i") * 0.00005).alias("x"), (F.lit(ORIGIN_Y) + F.col("j") * 0.00005).alias("y"), F.lit("1").alias("level"), kind.alias("type"), F.concat(F.lit("store"), k).alias("name"), k.alias("num"))
    right = s.where("i < 9").select(k.alias("a"), (k + 1).alias("b"))
    down = s.select(k.alias("a"), (k + 10).alias("b"))
    ids = s.select(k.alias("b"))
    edges = right.unionByName(down).join(ids, "b", "left_semi")
    weight = F.lit(1.0) + ((F.col("a") * 7 + F.col("b") * 13) % 10) / 4
    return nodes, edges.select(F.col("a").cast("string").alias("source"), F.col("b").cast("string").alias("target"), weight.cast("double").alias("weight"), F.lit("1").alias("level"), F.lit("corridor").alias("type"), (F.col("a") * 100000 + F.col("b")).alias("pos"))


LATTICE_SQL = f"""ln AS (SELECT s_suppkey AS k, s_suppkey % 10 AS i, s_suppkey // 10 AS j, {ORIGIN_X} + (s_suppkey % 10) * 0.00005 AS x, {ORIGIN_Y} + (s_suppkey // 10) * 0.00005 AS y,
  CASE WHEN s_suppkey % 7 = 0 THEN 'mall_entrance' WHEN s_suppkey % 3 = 0 THEN 'shop_entry' ELSE 'corridor' END AS type FROM supplier),
le0 AS (SELECT k AS a, k + 1 AS b FROM ln WHERE i < 9 UNION ALL SELECT k, k + 10 FROM ln),
le AS (SELECT a, b, 1.0::DOUBLE + ((a * 7 + b * 13) % 10) / 4.0::DOUBLE AS w FROM le0 WHERE b IN (SELECT k FROM ln)),
ld AS (SELECT a AS src, b AS dst, w FROM le UNION ALL SELECT b, a, w FROM le)"""


def lcg(x):
    """A comparable draw in [0, 1) from a number."""
    return ((x.cast("bigint") * F.lit(1103515245) + F.lit(12345)) % F.lit(2147483648)).cast("double") / F.lit(2147483648.0)


def lcg_sql(x: str) -> str:
    return f"(((CAST({x} AS BIGINT) * 1103515245 + 12345) % 2147483648)::DOUBLE / 2147483648.0)"
