"""Totals and averages over trailing calendar periods by binary doubling.

The rows of an entity are first reduced to one row per day (partial aggregation on every task), then put on the calendar from the
first to the last day with a value. Sums over 1, 2, 4, 8, ... days are built by adding a block to itself shifted by its own
length; a period of any length is the sum of the blocks of its binary digits, shifted to lie side by side. So a period of n
days costs about 2 log2(n) additions a day instead of n, and only daily rows, never the raw ones, are ordered.

Defined results: rows with NULL entity or timestamp are ignored; NULL and NaN values don't count; rows equal in all
columns but ``row_id`` count once; a period without any value has total NULL and average NULL and count 0; empty input gives
empty output.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def daily(rows: DataFrame, entity: str, ts: str, values: Sequence[str], row_id: str = "row_id") -> DataFrame:
    """entity, day, and per value its sum (s1_x) and count (n1_x) of the day; rows delivered twice count once."""
    once = rows.where(F.col(entity).isNotNull() & F.col(ts).isNotNull()).dropDuplicates([c for c in rows.columns if c != row_id])
    clean = {v: F.when(~F.isnan(v), F.col(v)) for v in values}
    aggs = [f(c).alias(f"{p}1_{v}") for v, c in clean.items() for p, f in (("s", F.sum), ("n", F.count))]
    return once.groupBy(entity, F.to_date(ts).alias("day")).agg(*aggs)


def on_calendar(days: DataFrame, entity: str, anchor: str) -> DataFrame:
    """Every day from the first to the last day on which ``anchor`` has a value; days without activity have sum NULL, count 0."""
    span = days.where(F.col(f"n1_{anchor}") > 0).groupBy(entity).agg(F.min("day").alias("a"), F.max("day").alias("b"))
    calendar = span.select(entity, F.explode(F.sequence("a", "b")).alias("day"))
    counts = [c for c in days.columns if c.startswith("n1_")]
    return calendar.join(days, [entity, "day"], "left").fillna(0, counts)


def doubled(days: DataFrame, entity: str, periods: Sequence[int], values: Sequence[str]) -> DataFrame:
    """One row per entity, day and period: total_x, n_x, avg_x of the trailing days, the day included."""
    w = Window.partitionBy(entity).orderBy("day")

    def plus(a: Column, b: Column) -> Column:
        return F.coalesce(a + b, a, b)

    def parts(kind: str) -> list[str]:
        return [f"{kind}_{v}" for v in values]

    size, df = 1, days
    while 2 * size <= max(periods):
        block = {f"{p}{2 * size}_{v}": plus(F.col(f"{p}{size}_{v}"), F.lag(f"{p}{size}_{v}", size).over(w)) for p in "sn" for v in values}
        df, size = df.withColumns(block), 2 * size
    out = {}
    for n in periods:
        for p in "sn":
            for v in values:
                total, behind = None, 0
                for bit in (b for b in (2**k for k in range(n.bit_length())) if n & b):
                    piece = F.lag(f"{p}{bit}_{v}", behind).over(w) if behind else F.col(f"{p}{bit}_{v}")
                    total, behind = piece if total is None else plus(total, piece), behind + bit
                out[f"{p}_{n}_{v}"] = total
    df = df.withColumns(out)
    rows = F.array(*(F.struct(F.lit(n).alias("period_days"), *(F.col(f"s_{n}_{v}").alias(f"total_{v}") for v in values), *(F.col(f"n_{n}_{v}").alias(f"n_{v}") for v in values)) for n in periods))
    df = df.select(entity, "day", F.explode(rows).alias("r")).select(entity, "day", "r.*")
    return df.withColumns({f"avg_{v}": F.when(F.col(f"n_{v}") > 0, F.col(f"total_{v}") / F.col(f"n_{v}")) for v in values})


def trailing(rows: DataFrame, entity: str, ts: str, values: Sequence[str], periods: Sequence[int]) -> DataFrame:
    """Totals, counts and averages of ``values`` over trailing ``periods`` for every day; the first value spans the calendar."""
    return doubled(on_calendar(daily(rows, entity, ts, values), entity, values[0]), entity, periods, values)
