"""Counter-based random numbers: the same draw for the same keys, wherever a row is computed."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

TWO53 = float(1 << 53)
TINY = 1e-12
_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def uniform(*keys: Column) -> Column:
    """In [0, 1), from the hash of the keys."""
    return F.xxhash64(*keys).bitwiseAND(F.lit((1 << 53) - 1)).cast("double") / F.lit(TWO53)


def gumbel(u: Column) -> Column:
    """M12, clamped away from 0 and 1."""
    c = F.least(F.greatest(u, F.lit(TINY)), F.lit(1 - TINY))
    return -F.log(-F.log(c))


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def np_uniform(*keys) -> np.ndarray:
    """The kernel's draws in [0, 1): keys are integers or arrays of them that broadcast."""
    out = np.uint64(0)
    with np.errstate(over="ignore"):
        for k in keys:
            out = _mix(out + np.asarray(k).astype(np.int64).view(np.uint64) + _GOLD)
    return (out >> np.uint64(11)).astype(np.float64) / TWO53


def np_gumbel(u: np.ndarray) -> np.ndarray:
    return -np.log(-np.log(np.clip(u, TINY, 1 - TINY)))
