"""Causal window functions over ordered bars: every window ends at the current row, or before it where said so.

``roll`` follows the strict rule of rolling windows: NULL unless all n values are known. All windows of a plan share one
partitioning and order, so that a plan of any number of features shuffles and sorts once. They run on bars, whose number
per symbol is bounded by the time grid, not by the events behind them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

BY, AT = "symbol", "ts"


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ordered() -> Window:
    return Window.partitionBy(BY).orderBy(AT)


def trailing(n: int, end: int = 0):
    """The n rows that end ``end`` rows before the current one."""
    return ordered().rowsBetween(-(n - 1) - end, -end)


def past():
    return ordered().rowsBetween(Window.unboundedPreceding, -1)


def upto():
    return ordered().rowsBetween(Window.unboundedPreceding, 0)


def lag(x: str | Column, n: int = 1) -> Column:
    return F.lag(col(x), n).over(ordered())


def lead(x: str | Column, n: int = 1) -> Column:
    return F.lead(col(x), n).over(ordered())


def roll(f: Callable[[Column], Column], x: str | Column, n: int) -> Column:
    w = trailing(n)
    return F.when(F.count(col(x)).over(w) == n, f(col(x)).over(w))


def div(a: str | Column, b: str | Column) -> Column:
    """Quotient, NULL where the divisor is 0."""
    return F.try_divide(col(a), col(b))


def quotient(a: str | Column, b: str | Column) -> Column:
    """Quotient as IEEE 754 and the SQL have it: infinite over 0, NaN for 0 over 0, NULL only for NULL."""
    return F.coalesce(div(a, b), col(a) * F.pow(col(b), F.lit(-1.0)))


def ln(x: str | Column) -> Column:
    """Natural logarithm that is minus infinite at 0 and NaN below, where Spark has NULL."""
    x = col(x)
    return F.when(x > 0, F.log(x)).when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan")))


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi))))


def nz(x: Column) -> Column:
    """NULL instead of 0, for divisors."""
    return F.nullif(x, F.lit(0.0))


def values(x: str | Column, n: int) -> Column:
    """Array of the n values of a window in order, NULL while there are fewer."""
    return F.when(F.count(col(x)).over(trailing(n)) == n, F.collect_list(col(x)).over(trailing(n)))
