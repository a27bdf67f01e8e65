"""Mixing sources to target weights by capped water-filling.

Every source asks for `budget * weight / sum(weights)` words. Sources whose share exceeds `max_epochs` times their own
size are clamped there and their excess goes to the others in proportion to weight, until no share is above its cap. The
whole repetitions of a source take every document; the fractional repetition takes documents in a seeded order (md5 of
seed and doc_id) until the target is met, the last of them in part. So every source meets its target to the word, and
reruns agree whatever the partitioning.

Scale: texts are scanned once, for sizes, which are written; the rows shuffled hold id, size and an ordering key only. A source may hold any share of the rows: the
seeded order is cut into 4096 slices by the key's first hex digits, slice sums are added up first (partial aggregation),
and the running sum inside a slice starts from the sum of the slices before it. Only the table of sources (one row each)
passes through one task.

Defined cases: null or empty text has size 0 and takes 0; a text of any length counts in full; a null source is a source of its own and comes last; rows with
equal doc_id keep their own size and are ordered by (key, size), inside one slice; an empty table gives an empty result; further columns
are ignored by `mix` callers that select what they need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strider.llm.common import WORD_RE, table
from strider.storage import shared_dir, written

WEIGHTS, BUDGET, MAX_EPOCHS, SEED = (3.0, 1.0, 2.0), 1.5, 2.0, "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, budget: float, max_epochs: float) -> DataFrame:
    """Adds `target` to rows (source, weight, source_size).

    Ordered by cap / weight, the sources that end at their cap are a prefix: source k is clamped when the level
    (budget - caps before k) / (weights from k on) reaches its own cap / weight. What the clamped leave is shared by
    weight, which is where the rounds of redistribution end."""
    whole = W.partitionBy()
    order = W.orderBy("_full", F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    s = (
        sources.withColumn("_cap", F.col("source_size") * F.lit(max_epochs))
        .withColumn("_full", F.col("_cap") / F.col("weight"))
        .withColumn("_budget", F.sum("source_size").over(whole) * F.lit(budget))
        .withColumn("_left", F.col("_budget") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_weights", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("_clamped", F.col("_left") >= F.col("_full") * F.col("_weights"))
        .withColumn("_free_budget", F.max(F.when(~F.col("_clamped"), F.col("_left"))).over(whole))
        .withColumn("_free_weight", F.max(F.when(~F.col("_clamped"), F.col("_weights"))).over(whole))
    )
    level = F.col("_free_budget") / F.col("_free_weight")
    return s.withColumn("target", F.round(F.when(F.col("_clamped"), F.col("_cap")).otherwise(F.col("weight") * level), 6)).select("source", "weight", "source_size", "target")


def mix(sized: DataFrame, weights=WEIGHTS, budget: float = BUDGET, max_epochs: float = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """sized: doc_id, source, size. Weights repeat over the sources in code-point order, null last.
    Returns doc_id, source, size, source_size, target, taken, whole (full repetitions), part (words of the fractional one)."""
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    rows = sized.select("doc_id", "source", F.col("size").cast("long").alias("size"), key.alias("_key")).withColumn("_slice", F.substring("_key", 1, 3))
    rows = rows.withColumn("_source", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")))  # null-safe join key
    rows = written(rows, f"{shared_dir(sized.sparkSession)}/sized")  # texts are read once; what follows reads sizes
    slices = rows.groupBy("_source", "_slice").agg(F.sum("size").alias("_in_slice"), F.first("source").alias("source"))
    sums = slices.groupBy("_source").agg(F.sum("_in_slice").alias("source_size"), F.first("source").alias("source"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    sums = sums.select("source", "source_size", weight.alias("weight"))
    plan = water_fill(sums, budget, max_epochs).withColumn("_source", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))).drop("source")
    words = F.round(F.col("target")).cast("long")
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    plan = plan.withColumn("_extra", words - F.col("whole") * F.col("source_size"))
    before = F.coalesce(F.sum("_in_slice").over(W.partitionBy("_source").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = slices.select("_source", "_slice", before.alias("_before")).join(plan, "_source").select(
        F.col("_source"), F.col("_slice"), "_before", "source_size", "target", "whole", "_extra"
    )
    inside = F.coalesce(F.sum("size").over(W.partitionBy("_source", "_slice").orderBy("_key", "size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("_inside", inside).join(starts, ["_source", "_slice"])
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_extra") - F.col("_before") - F.col("_inside")))
    return placed.withColumn("part", part.cast("long")).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("part")).cast("long").alias("taken"), "whole", "part"
    )


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(sized(table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken")


def mix_sql(docs: str, budget: float = BUDGET, max_epochs: float = MAX_EPOCHS, seed: str = SEED) -> str:
    """The same in DuckDB over a relation with doc_id, source, text."""
    weight = "CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END"
    return rf"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE length(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
         md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k FROM {docs}),
w AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, {weight} AS weight FROM d GROUP BY source),
a AS (SELECT *, source_size * {max_epochs}::DOUBLE AS cap, source_size * {max_epochs}::DOUBLE / weight AS fl FROM w),
b AS (SELECT *, (sum(source_size) OVER ())::DOUBLE * {budget}::DOUBLE
        - coalesce(sum(cap) OVER (ORDER BY fl, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
      sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY fl, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ws FROM a),
c AS (SELECT *, lft >= fl * ws AS clamped FROM b),
t AS (SELECT source, source_size, round(CASE WHEN clamped THEN cap ELSE
        weight * ((SELECT max(lft) FROM c WHERE NOT clamped) / (SELECT max(ws) FROM c WHERE NOT clamped)) END, 6) AS target FROM c),
p AS (SELECT *, CAST(round(target) AS BIGINT) AS words, CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 0 END AS whole FROM t),
r AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM d)
SELECT r.doc_id, r.size, p.source_size, p.target,
       CAST(whole * r.size + greatest(0, least(r.size, words - whole * p.source_size - r.pos)) AS BIGINT) AS taken
FROM r JOIN p ON r.source IS NOT DISTINCT FROM p.source"""


QUERIES = {"op4_mixing": op4_mixing}
ORACLE = {"op4_mixing": mix_sql("documents")}
