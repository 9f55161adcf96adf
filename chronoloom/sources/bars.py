"""OHLCV bars from raw events, the common input of the window features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.sources.tables import load


def resample_events(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """symbol, ts, open, high, low, close, volume, turnover per bucket; open and close by (ts, event_id).

    One pass with partial aggregation on every task, so an event type that holds most events is no hot key.
    """
    order = F.struct("ts", "event_id")
    e = events.where("ts is not null and value is not null")
    b = e.groupBy(F.col("event_type").alias("symbol"), F.window("ts", width).alias("w")).agg(F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count("*").cast("double").alias("volume"), F.sum("value").alias("turnover"))
    return b.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume", "turnover")


def bars(spark: SparkSession, d: str, width: str = "1 hour") -> DataFrame:
    return resample_events(load(spark, d, "events", "event_id", "ts", "event_type", "value"), width)


def sql(width: str = "1 hour", name: str = "bars") -> str:
    """The same bars as a DuckDB common table expression."""
    return f"""{name} as (select event_type as symbol, time_bucket(interval '{width}', ts) as ts, first(value order by ts, event_id) as open, max(value) as high, min(value) as low,
  last(value order by ts, event_id) as close, count(*)::double as volume, sum(value) as turnover from events where ts is not null and value is not null group by 1, 2)"""
