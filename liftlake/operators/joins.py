"""Join helpers with an explicit, checked broadcast decision."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Largest side (bytes, by the optimizer's estimate) that is shipped to every
# executor. Scans are estimated by their compressed files; in memory their rows
# take up to some 25 times as much, and the driver holds them all.
BROADCAST_BYTES = 8 * 1024 * 1024
# Largest side by a known number of rows.
BROADCAST_ROWS = 200_000


def broadcast_if_bounded(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Mark ``df`` for broadcast only if the optimizer's size estimate, which
    bounds scans by their files, is within ``max_bytes``. No job runs; beyond
    the bound the join is left to Catalyst and AQE."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= max_bytes else df


def broadcast_if_few(df: DataFrame, rows: int | None, most: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a key list of a known number of rows for broadcast, or for a
    shuffled join beyond ``most``, whatever its files' size; without the number
    as :func:`broadcast_if_bounded`."""
    if rows is None:
        return broadcast_if_bounded(df)
    return F.broadcast(df) if rows <= most else df.hint("merge")


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equijoin on ``keys`` in which NULL equals NULL (as in grouping)."""
    if not keys:
        raise ValueError("a keyed join needs at least one key")
    cond = None
    for k in keys:
        right = right.withColumnRenamed(k, f"_r_{k}")
        same = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        cond = same if cond is None else cond & same
    return left.join(right, cond, how).drop(*[f"_r_{k}" for k in keys])
