"""Order-dependent scans that never put a whole key into one task.

A key (source, asset, pipeline) may hold a third of all rows, so a plain window over it would run in one task. Rows are
therefore cut into *blocks* of the order axis (fixed spans of time), scanned per (key, block), and the blocks of one key are
linked by a summary of one row per block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_known(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: str, value: Column, out: str, *, inclusive: bool = True, forward: bool = True) -> DataFrame:
    """Add ``out``: the last non-null ``value`` at or before each row (``inclusive``) or strictly before it.

    ``block`` must be a non-decreasing function of the order columns. ``forward=False`` looks towards later rows instead.
    Null keys form a group of their own. Ties in ``order`` are taken in an arbitrary order, so pass a unique order.
    """
    direction = (lambda c: F.col(c).asc()) if forward else (lambda c: F.col(c).desc())
    inside = Window.partitionBy(*keys, block).orderBy(*map(direction, order)).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    pick = F.max_by if forward else F.min_by
    rank = F.struct(*order)
    ends = df.groupBy(*keys, block).agg(pick(value, F.when(value.isNotNull(), rank)).alias("__end"))
    across = Window.partitionBy(*keys).orderBy(direction(block)).rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col(block).alias("__kb"), F.last("__end", True).over(across).alias("__carry"))
    on = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)] + [F.col(block).eqNullSafe(F.col("__kb"))]
    scanned = df.withColumn(out, F.last(value, True).over(inside))
    joined = scanned.join(carry, on, "left").withColumn(out, F.coalesce(out, "__carry"))
    return joined.drop("__carry", "__kb", *(f"__k{i}" for i in range(len(keys))))


def previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: str, columns: Sequence[str], out: str) -> DataFrame:
    """Add the struct ``out`` of ``columns`` of the row before (NULL at the first row of a key)."""
    return last_known(df, keys, order, block, F.struct(*columns), out, inclusive=False)
