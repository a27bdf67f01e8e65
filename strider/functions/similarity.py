"""Set similarity of audiences from their sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def similarity(metric: str, n_a: Column, n_b: Column, shared: Column) -> Column:
    """0 when a denominator is 0 and for an unknown metric."""
    d = lambda c: c.cast("double")
    if metric == "jaccard":
        return _ratio(d(shared), d(n_a + n_b - shared))
    if metric == "cosine":
        return _ratio(d(shared), F.sqrt(d(n_a) * d(n_b)))
    if metric == "overlap":
        return d(shared)
    if metric == "overlap_coef":
        return _ratio(d(shared), d(F.least(n_a, n_b)))
    return F.lit(0.0)


def normalized(metric: str, score: Column, n_reference: Column) -> Column:
    """F16: a count of shared people relative to the reference's reach; other metrics as they are."""
    return _ratio(score, n_reference.cast("double")) if metric == "overlap" else score
