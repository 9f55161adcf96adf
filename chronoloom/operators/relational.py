"""Joins and aggregations of keyed, ordered tables that Spark has no single operator for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.operators.blocks import last_known
from chronoloom.sources.tables import micros

MINUTE = 60_000_000


def dedupe_latest(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """One row per key: the first in ``order``. Partial aggregation keeps one candidate per key and task, so copies don't pile up in one."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return best.select(*keys, *(F.col("__r")[c].alias(c) for c in rest))


def asof_backward(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, columns: Sequence[str], available: Column | None = None, block_us: int = 86_400_000_000) -> DataFrame:
    """Each left row with ``columns`` of the last right row of its key that was available at or before its time.

    Both sides are unioned, ordered within blocks of time and scanned once; blocks are linked by their last right row. So there
    is no range join, no tolerance and no limit on the gap, and a key with most rows is scanned by many tasks. Right rows of
    the same time are taken in order of their columns, the last one counts.
    """
    right = right.withColumn("__at", micros(available if available is not None else at)).select(*keys, "__at", F.lit(0).alias("__side"), F.struct(*(F.col(c).alias(c) for c in columns)).alias("__r"))
    left = left.withColumn("__at", micros(at)).withColumn("__side", F.lit(1))
    both = left.unionByName(right, allowMissingColumns=True).withColumn("__block", F.floor(F.col("__at") / block_us))
    scanned = last_known(both, keys, ["__at", "__side", "__r"], "__block", F.col("__r"), "__found")
    clash = {c: f"{c}_asof" if c in left.columns else c for c in columns}
    kept = [c for c in left.columns if not c.startswith("__")]
    return scanned.where("__side = 1").select(*kept, *(F.col("__found")[c].alias(name) for c, name in clash.items()))


def sessions(df: DataFrame, keys: Sequence[str], at: str, gap_minutes: int, block_us: int = 86_400_000_000) -> DataFrame:
    """Rows with ``session``: a number per key that grows wherever the gap to the row before exceeds ``gap_minutes`` strictly.

    Breaks are found and counted per (key, block of time), and the counts of earlier blocks are added, so a key with most rows is no hot task.
    """
    rows = df.withColumn("__block", F.floor(micros(at) / block_us))
    rows = last_known(rows, keys, [at], "__block", micros(at), "__before", inclusive=False)
    rows = rows.withColumn("__b", F.coalesce((micros(at) - F.col("__before") > gap_minutes * MINUTE).cast("int"), F.lit(0)))
    totals = rows.groupBy(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col("__block").alias("__kb")).agg(F.sum("__b").alias("__t"))
    earlier = Window.partitionBy(*(f"__k{i}" for i in range(len(keys)))).orderBy("__kb").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.withColumn("__base", F.coalesce(F.sum("__t").over(earlier), F.lit(0))).drop("__t")
    inside = F.sum("__b").over(Window.partitionBy(*keys, "__block").orderBy(at))  # rows of one time share it
    on = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)] + [F.col("__block").eqNullSafe(F.col("__kb"))]
    joined = rows.withColumn("session", inside).join(base, on)
    return joined.withColumn("session", F.col("session") + F.col("__base")).drop("__b", "__before", "__block", "__base", "__kb", *(f"__k{i}" for i in range(len(keys))))


def covered(grid: DataFrame, events: DataFrame, at: str, start: str, end: str) -> DataFrame:
    """Grid rows with ``active``: whether any event interval [start, end) covers them, by a sweep over +1 and -1.

    No range join: starts and ends are counted per minute, and the running sum is made per day and shifted by the days before.
    """
    marks = events.select(F.col(start).alias(at), F.lit(1).alias("d")).unionByName(events.select(F.col(end).alias(at), F.lit(-1).alias("d")))
    marks = marks.groupBy(at).agg(F.sum("d").alias("d")).withColumn("__grid", F.lit(0))
    rows = grid.withColumn("d", F.lit(0)).withColumn("__grid", F.lit(1)).unionByName(marks, allowMissingColumns=True).withColumn("__day", F.to_date(at))
    days = rows.groupBy("__day").agg(F.sum("d").alias("t"))
    base = days.select("__day", F.coalesce(F.sum("t").over(Window.orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    inside = F.sum("d").over(Window.partitionBy("__day").orderBy(at, "__grid").rowsBetween(Window.unboundedPreceding, 0))
    out = rows.withColumn("__run", inside).join(base, "__day").withColumn("active", (F.col("__run") + F.col("__base") > 0).cast("int"))
    return out.where("__grid = 1").drop("d", "__grid", "__day", "__run", "__base")


def period_start(at: str, hours: int, anchor_us: int = 0) -> Column:
    """Start of the anchored period a time lies in, as microseconds: floor((t - anchor) / length) * length + anchor."""
    length = hours * 60 * MINUTE
    return (F.floor((micros(at) - anchor_us) / length) * length + anchor_us).cast("long")


def family_position(df: DataFrame, period: str, at: str, hours: int) -> DataFrame:
    """Position of a bar in its period: ordinal, rows of the period, share of the way through, first or later half."""
    w = Window.partitionBy("symbol", period)
    pos = F.row_number().over(w.orderBy(at)) - 1
    n = F.count("*").over(w)
    half = micros(at) - F.col(period) >= hours * 30 * MINUTE
    return df.withColumns({"bar_in_batch": pos, "actual_rows": n, "bar_in_batch_norm": F.when(n > 1, pos / (n - 1)).otherwise(F.lit(0.0)), "is_label_half": half, "n_entry": F.sum((~half).cast("int")).over(w)})


def resample_complete(df: DataFrame, width: str, expected: int, allow_partial: bool = False) -> DataFrame:
    """Bars of a longer width from bars; incomplete ones are dropped unless allowed; turnover is NULL if all of it is."""
    g = df.groupBy("symbol", F.window("ts", width).alias("w")).agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"), F.sum("turnover").alias("turnover"), F.count("*").alias("n"))
    whole = g if allow_partial else g.where(F.col("n") == expected)
    return whole.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume", "turnover", "n")


def average_rank(x: str, *by: str, ascending: bool = True) -> Column:
    """Rank with ties sharing the mean of their places."""
    order = F.col(x).asc_nulls_last() if ascending else F.col(x).desc_nulls_last()
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(order)) + (F.count("*").over(Window.partitionBy(*by, x)) - 1) / F.lit(2.0)
