"""Streaming queries run to the end of the events table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.functions import folds
from chronoloom.sources.tables import load
from chronoloom.streaming import streams

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
#: Rows may be this late against the newest row of the files read before theirs; state is kept as long.
LATE = "1 day"


def _stream(spark: SparkSession, d: str) -> DataFrame:
    return streams.event_stream(spark, f"{d}/events.parquet*", EVENTS)


def _run(spark: SparkSession, df: DataFrame) -> DataFrame:
    folder = streams.new_folder(spark)
    return streams.run_available(df, f"{folder}/out", f"{folder}/checkpoint")


def s01_stream_deduplicated(spark: SparkSession, d: str) -> DataFrame:
    twice = _stream(spark, d).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return _run(spark, streams.deduplicated(twice, ["event_id"], LATE).select("event_id", "event_type", "value"))


def s02_stream_kalman(spark: SparkSession, d: str) -> DataFrame:
    fold, start = folds.kalman()
    rows = _stream(spark, d).select("event_type", "event_id", "value")
    return _run(spark, streams.stateful_fold(rows, "event_type", "event_id", fold, start, "level double, slope double, innovation double"))


def _closed(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream that goes on: after the table's files comes one event far later, which lets every window close."""
    folder = streams.new_folder(spark)
    end = spark.sql("select cast(null as bigint) as event_id, timestamp_ntz '2999-01-01 00:00:00' as ts, cast(null as bigint) as user_id, '~end' as event_type, cast(null as double) as value, cast(null as string) as props")
    load(spark, d, "events").select(*end.columns).write.parquet(f"{folder}/in/a.parquet")
    end.write.parquet(f"{folder}/in/b.parquet")
    parts = [streams.event_stream(spark, f"{folder}/in/{name}.parquet", EVENTS, files) for name, files in (("a", 1_000_000), ("b", 1))]
    return parts[0].unionByName(parts[1])


def s03_stream_tumbling_bars(spark: SparkSession, d: str) -> DataFrame:
    """Hourly bars of the stream; a window is given out once the watermark has passed it."""
    bars = streams.tumbling_bars(_closed(spark, d).where("event_type = '~end' or value is not null"), "1 hour", LATE)
    return _run(spark, bars).where("symbol <> '~end'").select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "n")


def s04_stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    counts = streams.session_counts(_closed(spark, d), "45 minutes", LATE)
    return _run(spark, counts).where("event_type <> '~end'").select("event_type", F.col("first_ts").cast("timestamp_ntz").alias("first_ts"), "n")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (s01_stream_deduplicated, s02_stream_kalman, s03_stream_tumbling_bars, s04_stream_sessions)}
SQL: dict[str, str] = {
    "s01_stream_deduplicated": "select event_id, event_type, value from events",
    "s03_stream_tumbling_bars": "select event_type as symbol, time_bucket(interval '1 hour', ts) as ts, first(value order by ts, event_id) as open, max(value) as high, min(value) as low, last(value order by ts, event_id) as close, count(*) as n from events where ts is not null and value is not null group by 1, 2",
    "s04_stream_sessions": """with e as (select event_type, ts, event_id, lag(ts) over w as p from events where ts is not null window w as (partition by event_type order by ts, event_id)), s as (select *, sum((p is null or ts - p >= interval 45 minute)::int) over (partition by event_type order by ts, event_id) as session from e)
select event_type, min(ts) as first_ts, count(*) as n from s group by event_type, session""",
}
