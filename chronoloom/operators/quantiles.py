"""Exact quantiles of a whole column without putting it in order, or into one buffer.

Values are counted in cells of equal width; the cells that hold the wanted ranks are counted again more finely until they hold few
values or a single one, and only those values come to the driver. Interpolation is linear between the two ranks around a
quantile. NULL and NaN are left out; no values give NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS, FETCHED = 4_096, 20_000


def _at_ranks(values: DataFrame, lo: float, hi: float, ranks: dict[int, int]) -> dict[int, float]:
    """Value at each rank (key -> place among the values of [lo, hi])."""
    if lo == hi:
        return dict.fromkeys(ranks, lo)
    cell = F.least(F.floor((F.col("x") - lo) / (hi - lo) * CELLS), F.lit(CELLS - 1))
    counts = sorted(values.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect())
    inside: dict[tuple, dict[int, int]] = {}
    for key, rank in ranks.items():
        before = 0
        for row in counts:
            if rank < before + row.n:
                inside.setdefault((row.lo, row.hi, row.n), {})[key] = rank - before
                break
            before += row.n
    out: dict[int, float] = {}
    for (a, b, n), wanted in inside.items():
        part = values.where(F.col("x").between(a, b))
        if a != b and n <= FETCHED:
            found = sorted(r.x for r in part.collect())
            out |= {key: found[rank] for key, rank in wanted.items()}
        else:
            out |= _at_ranks(part, a, b, wanted)
    return out


def exact_quantiles(df: DataFrame, value: Column, shares: Sequence[float]) -> list[float | None]:
    """The quantiles of ``value`` at ``shares``."""
    values = df.select(value.cast("double").alias("x")).where("x is not null and not isnan(x)")
    n, lo, hi = values.agg(F.count("*"), F.min("x"), F.max("x")).first()
    if not n:
        return [None] * len(shares)
    places = [s * (n - 1) for s in shares]
    found = _at_ranks(values, lo, hi, {r: r for p in places for r in (int(p), min(int(p) + 1, n - 1))})
    return [found[int(p)] + (p - int(p)) * (found[min(int(p) + 1, n - 1)] - found[int(p)]) for p in places]
