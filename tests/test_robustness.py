"""Extra columns with clashing names, null keys and hot keys don't change what the operators give."""

import datetime as dt

from pyspark.sql import functions as F

from chronoloom.operators import consolidate, grid, rolling, schema_drift, spikes
from chronoloom.sources.tables import load

SF = "/root/testdata/sf0.001"
CLASH = ("block", "slot", "at", "step", "own", "k", "d", "real", "before", "prev_id", "kind", "known", "copy", "score", "n", "day")


def widened(df):
    return df.withColumns({c: F.lit("x") for c in CLASH if c not in df.columns})


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_clashing_columns(spark):
    bars, feeds = load(spark, SF, "raw_bars"), load(spark, SF, "feeds")
    assert rows(grid.missing_slots(widened(bars), widened(feeds))) == rows(grid.missing_slots(bars, feeds))
    assert rows(spikes.implausible(widened(bars))) == rows(spikes.implausible(bars))
    runs = load(spark, SF, "run_configs")
    assert rows(schema_drift.drift(widened(runs))) == rows(schema_drift.drift(runs))
    labels = load(spark, SF, "label_bars")
    total = lambda df: rolling.trailing(df, "asset_id", "timestamp", ["close"], [7]).agg(F.count("*"), F.sum("n_close"))
    assert rows(total(widened(labels))) == rows(total(labels))
    f, b, key = load(spark, SF, "feature_batches"), load(spark, SF, "batch_files"), ["asset_id", "regime", "family", "batch_id", "timestamp"]
    assert rows(consolidate.repeated(widened(f), widened(b), key)) == rows(consolidate.repeated(f, b, key))


def test_one_hot_stream(spark):
    """A stream with nearly all files gives what it gives alone."""
    t0 = dt.datetime(2020, 1, 1)
    schema = "record_id long, pipeline_id long, config_kind string, file_path string, written_at timestamp_ntz, payload string"
    hot = [(i, 1, "k", f"h{i}", t0 + dt.timedelta(days=i), f'{{"f{i // 100}": {i}}}') for i in range(800)]
    cold = [(10_000 + i, 2 + i, "k", f"c{i}", t0, '{"a": 1}') for i in range(20)]
    alone = rows(schema_drift.drift(spark.createDataFrame(hot, schema)))
    assert alone == rows(schema_drift.drift(spark.createDataFrame(hot + cold, schema)))
    assert alone == [(100 * i, f"k.f{i}", "renamed") for i in range(1, 8)]
