"""Streams give what batches give, and a fold over parts gives what it gives over all rows."""

from pyspark.sql import functions as F

from chronoloom.functions import folds
from chronoloom.operators.scan import scan
from chronoloom.plans.stream_queries import EVENTS
from chronoloom.sources.bars import resample_events
from chronoloom.streaming import streams

SF = "/root/testdata/sf0.001/events.parquet"


def parts(spark, tmp_path, n):
    rows = [r.event_id for r in spark.read.parquet(SF).select("event_id").orderBy("ts", "event_id").collect()]
    size = -(-len(rows) // n)
    for i in range(n):
        chunk = rows[i * size : (i + 1) * size]
        spark.read.parquet(SF).where(F.col("event_id").isin(chunk)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return str(tmp_path / "in")


def test_tumbling_bars(spark, tmp_path):
    src = parts(spark, tmp_path, 3)
    stream = streams.tumbling_bars(streams.event_stream(spark, src, EVENTS, 10), "1 hour", "1 hour")
    got = streams.run_available(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    want = resample_events(spark.read.parquet(SF).withColumn("ts", F.col("ts").cast("timestamp"))).select("symbol", "ts", "open", "high", "low", "close", F.col("volume").cast("long").alias("n"))
    got, want = set(map(tuple, got.collect())), set(map(tuple, want.collect()))
    assert got <= want and len(want) - len(got) <= 10  # the last hours wait for the watermark


def test_fold_over_parts(spark, tmp_path):
    src = parts(spark, tmp_path, 4)
    fold, start = folds.kalman()
    rows = streams.event_stream(spark, src, EVENTS, 1).select("event_type", "ts", "value")
    got = streams.run_available(streams.stateful_fold(rows, "event_type", "ts", fold, start, "level double, slope double, innovation double"), str(tmp_path / "out"), str(tmp_path / "cp")).toPandas()
    batch = spark.read.parquet(SF).select("event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    want = scan(batch, ["event_type"], "ts", fold, start, "level double, slope double, innovation double").toPandas()
    m = got.merge(want, on=["event_type", "ts"])
    assert len(m) == len(want)
    assert (m.level_x - m.level_y).abs().max() < 1e-6


def test_duplicates_across_batches(spark, tmp_path):
    src = parts(spark, tmp_path, 2)
    spark.read.parquet(SF).limit(50).coalesce(1).write.mode("append").parquet(src)
    df = streams.deduplicated(streams.event_stream(spark, src, EVENTS, 1), ["event_id"], "100 days")
    assert streams.run_available(df, str(tmp_path / "out"), str(tmp_path / "cp")).count() == spark.read.parquet(SF).count()
