"""Provider normalisation, sinks, sources and scans on small made-up frames."""

import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoloom.functions import folds, signals
from chronoloom.operators import relational as R
from chronoloom.operators.scan import affine_scan, ewm, scan
from chronoloom.sources import providers as S
from chronoloom.sources.bars import bars

T0 = dt.datetime(2024, 1, 1)


def test_json_values_and_inverse(spark):
    payload = json.dumps({"values": [{"datetime": "2024-03-05 10:07:00", "open": "3.25", "high": "8", "low": "2.75", "close": "5.5", "volume": "x"}, {"datetime": "bad", "open": "1", "high": "1", "low": "1", "close": "1"}]})
    got = S.bars_from_json_values(spark.createDataFrame([(payload,), (None,), ("{",)], "p string"), "p", "1m").collect()
    assert [(r.open, r.high, r.low, r.close, r.volume, r.turnover, r.interval) for r in got] == [(3.25, 8.0, 2.75, 5.5, None, None, "1m")]
    inv = S.inverted(spark.createDataFrame([(1.0, 4.0, 0.5, 0.0)], "open double, high double, low double, close double")).first()
    assert (inv.open, inv.high, inv.low, inv.close) == (1.0, 2.0, 0.25, None)


def test_discovery(tmp_path):
    for n in ("klines_1m", "klines_4h", "funding_8h", "other"):
        (tmp_path / n).mkdir()
    assert S.discovered(str(tmp_path)) == {"funding": ["8h"], "klines": ["1m", "4h"]}
    assert S.best_timeframe(["1m", "4h"], "15m") == "4h" and S.best_timeframe(["1m"], "1h") is None
    with pytest.raises(ValueError):
        S.minutes("1w")
    assert S.tail_route({"a": 10, "b": 5, "c": 1}, 10, 6) == {"a": "none", "b": "quick", "c": "full"}


def test_sinks(spark, tmp_path):
    schema = "k string, timestamp timestamp, v int, batch_id int"
    rows = [("a", T0 + dt.timedelta(minutes=i), i, i % 2) for i in range(6)]
    old, new = spark.createDataFrame(rows[:4], schema), spark.createDataFrame(rows[2:], schema)
    S.append_new(new, old, ["k"], str(tmp_path / "app"), 1)
    assert sorted(r.v for r in spark.read.parquet(str(tmp_path / "app")).collect()) == [4, 5]
    edge = lambda i: F.lit(T0 + dt.timedelta(minutes=i))
    out = S.replaced_window(old, old.withColumn("v", F.col("v") + 100).where("v in (101, 102)"), ["k"], edge(1), edge(2))
    assert sorted(r.v for r in out.collect()) == [0, 3, 101, 102]
    S.write_per_batch(old, str(tmp_path / "b"))
    S.write_per_batch(old.where("batch_id = 1").withColumn("v", F.lit(7)), str(tmp_path / "b"))
    assert sorted(r.v for r in spark.read.parquet(str(tmp_path / "b")).collect()) == [0, 2, 7, 7]
    S.write_report(old, str(tmp_path / "r"))
    assert spark.read.csv(str(tmp_path / "r/csv"), header=True).count() == 4
    S.write_sidecar(str(tmp_path / "m/x.json"), {"b": 1, "a": T0})
    assert json.loads((tmp_path / "m/x.json").read_text())["b"] == 1
    both = S.provider_scan(spark, [("p", 10, str(tmp_path / "b")), ("q", 20, str(tmp_path / "app"))])
    assert {r._source_provider for r in both.collect()} == {"p", "q"}


def test_affine_scan_equals_recursion(spark):
    rng = np.random.default_rng(3)
    rows = [(k, T0 + dt.timedelta(days=3 * i), None if rng.random() < 0.1 else float(rng.normal())) for k in ("x", "y") for i in range(60)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, v double")
    got = ewm(df, ["k"], "ts", {"m": (F.col("v"), 0.2)}).toPandas()
    for k in ("x", "y"):
        want, y = {}, None
        for _, t, v in (r for r in rows if r[0] == k):
            if v is not None:
                y = v if y is None else 0.8 * y + 0.2 * v
            want[pd.Timestamp(t)] = y
        part = got[got.k == k]
        assert all((np.isnan(m) and want[t] is None) or m == pytest.approx(want[t]) for t, m in zip(part.ts, part.m, strict=True))
    assert affine_scan(df.limit(0), ["k"], "ts", {"m": (F.lit(0.5), F.col("v"))}).count() == 0


def test_asof_is_inclusive_and_crosses_blocks(spark):
    left = spark.createDataFrame([("a", T0 + dt.timedelta(days=i), i) for i in range(0, 40, 3)] + [("b", T0, 0)], "k string, ts timestamp, v int")
    right = spark.createDataFrame([("a", T0 + dt.timedelta(days=i), i) for i in (6, 7, 30)], "k string, ts timestamp, v int")
    got = {(r.k, r.v): r.v_asof for r in R.asof_backward(left, right, ["k"], "ts", ["v"]).collect()}
    assert got["a", 6] == 6 and got["a", 9] == 7 and got["a", 27] == 7 and got["a", 30] == 30 and got["a", 3] is None and got["b", 0] is None


def test_folds():
    fold, start = folds.cusum(2.0, 0.0, 3)
    s, changes = start(), []
    for x in [0, 0, 3, 3, 3, 0, 3, 0]:
        s, out = fold(s, {"value": x})
        changes.append(out["change"])
    assert changes == [0, 0, 1, 0, 0, 1, 0, 0]
    fold, start = folds.bocpd()
    s = start()
    rng = np.random.default_rng(0)
    for i in range(80):
        s, out = fold(s, {"value": float(rng.normal(0 if i < 60 else 8, 0.5))})
    assert out["run_length"] <= 25
    fold, start = folds.adaptive_level(0.1, 0.05)
    assert fold(start(), {"error_rate": 0.5})[1]["next_level"] == pytest.approx(0.08)


def test_supertrend_flips(spark):
    close = [10 + i for i in range(15)] + [24 - 3 * i for i in range(8)]
    rows = [("s", T0 + dt.timedelta(hours=i), c + 0.5, c - 0.5, float(c), 1.0) for i, c in enumerate(close)]
    fold, start = folds.supertrend(2.0)
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, high double, low double, close double, atr double")
    got = [r.direction for r in scan(df, ["symbol"], "ts", fold, start, "direction int").orderBy("ts").collect()]
    assert got[10] == 1 and got[-1] == -1


def test_signals_against_pandas(spark):
    b = bars(spark, "/root/testdata/sf0.001").where("symbol = 'click'")
    got = signals.indicators(b).toPandas().sort_values("ts").reset_index(drop=True)
    p = b.toPandas().sort_values("ts").reset_index(drop=True)
    rma = lambda x, n: x.ewm(alpha=1 / n, adjust=False, min_periods=n).mean()
    delta = p.close.diff()
    rsi = 100 - 100 / (1 + rma(delta.clip(lower=0), 14) / rma((-delta).clip(lower=0), 14))
    macd = p.close.ewm(span=12, adjust=False, min_periods=12).mean() - p.close.ewm(span=26, adjust=False, min_periods=26).mean()
    hist = macd - macd.ewm(span=9, adjust=False, min_periods=9).mean()
    for mine, want in ((got.rsi, rsi), (got.macd_hist, hist), (got.bb_upper, p.close.rolling(20).mean() + 2 * p.close.rolling(20).std(ddof=0))):
        assert np.allclose(mine.to_numpy(float), want.to_numpy(float), equal_nan=True, atol=1e-6)
