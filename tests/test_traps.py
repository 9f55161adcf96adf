"""Rules of meaning that are easily got wrong, each against pandas, NumPy or a worked case (T numbers as in the blueprint)."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoloom.functions import folds, signals
from chronoloom.functions.features import compute
from chronoloom.operators import relational as R
from chronoloom.plans import metric_queries as M
from chronoloom.sources.bars import resample_events

T0 = dt.datetime(2024, 1, 1)
BAR = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double, turnover double"


def frame(close, spread=0.5, seed=0):
    rng = np.random.default_rng(seed)
    close = np.asarray(close, dtype=float)
    opened = np.r_[close[0], close[:-1]]
    return pd.DataFrame({"symbol": "a", "ts": [T0 + dt.timedelta(hours=i) for i in range(len(close))], "open": opened, "high": np.fmax(opened, close) + spread, "low": np.fmin(opened, close) - spread, "close": close, "volume": rng.lognormal(3, 0.3, len(close)), "turnover": rng.normal(0, 1, len(close))})


def features(spark, pdf, *names):
    return compute(spark.createDataFrame(pdf, BAR), list(names)).orderBy("ts").toPandas()


@pytest.fixture(scope="module")
def walk():
    return frame(100 * np.exp(np.cumsum(np.random.default_rng(4).normal(0, 0.01, 120))), seed=4)


def same(got, want):
    assert np.allclose(got.to_numpy(dtype=float), want.to_numpy(dtype=float), equal_nan=True, atol=1e-8)


def test_t1_windows_need_all_their_values(spark, walk):
    got = features(spark, walk, "return_std_20", "funding_ma_8")
    ret = np.log(walk.close).diff()
    same(got.return_std_20, ret.rolling(20).std())
    assert got.return_std_20.first_valid_index() == 20 and got.funding_ma_8.first_valid_index() in (0, 1)  # sums and means of funding may be partial


def test_t3_relative_strength_without_losses(spark):
    rising = frame(np.arange(1, 61) + 100.0)
    assert features(spark, rising, "rsi_14").rsi_14.isna().all()
    wilder = signals.indicators(spark.createDataFrame(rising, BAR)).orderBy("ts").toPandas()
    assert wilder.rsi.dropna().eq(100).all() and wilder.rsi.notna().any()


def test_t5_two_zscores(spark, walk):
    got = features(spark, walk, "zscore_pop_21", "zscore_samp_21")
    assert (got.zscore_pop_21[:15] == 0).all() and got.zscore_samp_21[:15].isna().all()
    assert got.zscore_samp_21.dropna().abs().max() <= 5


def test_t6_moments_are_bias_corrected(spark, walk):
    got = features(spark, walk, "skew_30", "kurtosis_30")
    ret = np.log(walk.close).diff()
    assert np.allclose(got.skew_30.dropna(), ret.rolling(30).skew().dropna().clip(got.skew_30.min(), got.skew_30.max()), atol=1e-6)
    assert np.allclose(got.kurtosis_30.dropna(), ret.rolling(30).kurt().dropna().clip(got.kurtosis_30.min(), got.kurtosis_30.max()), atol=1e-6)


def test_t7_win_rate_is_known_one_row_earlier(spark, walk):
    got = features(spark, walk, "win_rate_20", "return_std_20")
    assert got.win_rate_20.first_valid_index() == got.return_std_20.first_valid_index() - 1


def test_t8_as_of_is_inclusive_and_shifted(spark):
    left = spark.createDataFrame([("k", T0 + dt.timedelta(minutes=m)) for m in (0, 15, 29, 30, 31, 9000)], "k string, t timestamp_ntz")
    right = spark.createDataFrame([("k", T0, 1), ("k", T0 + dt.timedelta(minutes=15), 2)], "k string, t timestamp_ntz, v int")
    plain = [r.v for r in R.asof_backward(left, right, ["k"], "t", ["v"]).orderBy("t").collect()]
    shifted = [r.v for r in R.asof_backward(left, right, ["k"], "t", ["v"], F.col("t") + F.expr("interval 15 minutes")).orderBy("t").collect()]
    assert plain == [1, 2, 2, 2, 2, 2] and shifted == [None, 1, 1, 2, 2, 2]


def test_t17_buffered_rank_starts_at_the_second_value():
    fold, start = folds.ranked_buffer(3)
    s, ranks = start(), []
    for v in (5.0, None, 3.0, float("nan"), 4.0, 9.0, 1.0):
        s, out = fold(s, {"value": v})
        ranks.append(out["rank"])
    assert ranks == [None, None, 0.0, None, 0.5, 1.0, 0.0] and s["buf"] == [4.0, 9.0, 1.0]


def test_t21_dedupe_keeps_what_its_order_says(spark):
    df = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new")], "k string, n int, v string")
    assert R.dedupe_latest(df, ["k"], F.col("n")).first().v == "old" and R.dedupe_latest(df, ["k"], -F.col("n")).first().v == "new"


def test_t22_first_and_last_do_not_depend_on_row_order(spark):
    rows = [(i, T0 + dt.timedelta(minutes=i % 50), "a", float(i)) for i in range(100)]
    schema = "event_id long, ts timestamp_ntz, event_type string, value double"
    one = resample_events(spark.createDataFrame(rows, schema)).first()
    two = resample_events(spark.createDataFrame(rows[::-1], schema).repartition(7)).first()
    assert one == two and (one.open, one.close) == (0.0, 99.0)


def test_t24_ties_go_to_the_lowest_class(spark):
    df = spark.createDataFrame([(0.3, 0.3, 0.2, 0.2), (0.1, 0.4, 0.4, 0.1)], "a double, b double, c double, d double")
    assert [r.k for r in df.select(M._argmax("a", "b", "c", "d").alias("k")).collect()] == [0, 1]


def test_t25_deviations_have_their_own_degrees_of_freedom(spark, walk):
    ret = np.log(walk.close).diff()
    got = features(spark, walk, "sharpe_20").sharpe_20
    want = (ret.rolling(20).mean() / ret.rolling(20).std(ddof=1) * np.sqrt(20)).clip(-5, 5)
    same(got, want)


def test_t26_percentiles_are_linear(spark):
    x = [1.0, 2.0, 4.0, 8.0]
    df = spark.createDataFrame([(v,) for v in x], "v double")
    assert df.agg(F.percentile("v", F.lit(0.3)).alias("p")).first().p == pytest.approx(np.quantile(x, 0.3))


def test_t28_no_range_gives_no_infinity(spark):
    flat = frame(np.full(60, 100.0), spread=0.0)
    got = features(spark, flat, "stoch_k_14", "pct_b_20", "body_ratio", "price_zscore_20")
    assert not np.isinf(got[["stoch_k_14", "pct_b_20", "body_ratio", "price_zscore_20"]].to_numpy(dtype=float)).any()


def test_sessions_break_strictly_beyond_the_gap(spark):
    times = [0, 45, 91, 3000, 3000, 3045, 4500]
    df = spark.createDataFrame([("k", T0 + dt.timedelta(minutes=m)) for m in times], "k string, t timestamp_ntz")
    assert [r.session for r in R.sessions(df, ["k"], "t", 45).orderBy("t").collect()] == [0, 0, 1, 2, 2, 2, 3]
