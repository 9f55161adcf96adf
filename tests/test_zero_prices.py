"""Bars that reach 0: quotients and logarithms are what the SQL has for them, infinite or NaN, and no error."""

import datetime as dt
import math

import duckdb
import oracle
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from chronoloom.functions.windows import ln, quotient

T0 = dt.datetime(2024, 1, 1)


def events(folder, *bars):
    """Hourly bars of (open, low, close) as events of one kind."""
    values = [(T0 + dt.timedelta(hours=h, minutes=m), float(v)) for h, bar in enumerate(bars) for m, v in enumerate(bar)]
    ts, value = zip(*values, strict=True)
    pq.write_table(pa.table({"event_id": list(range(len(ts))), "ts": pa.array(ts, pa.timestamp("us")), "event_type": ["view"] * len(ts), "value": value}), folder / "events.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def low(tmp_path_factory):
    """Only the low of bars is 0, as in the events of sf0.1."""
    return events(tmp_path_factory.mktemp("low"), *((50 + h % 7, 0 if h in (30, 60) else 20 + h % 5, 40 + h % 9) for h in range(90)))


@pytest.fixture(scope="module")
def any_price(tmp_path_factory):
    """Opens, closes and whole bars are 0 too, and one price is negative."""
    odd = {30: (0, 5, 40), 60: (50, 20, 0), 90: (50, -3, 40)} | dict.fromkeys(range(120, 145), (0, 0, 0))
    return events(tmp_path_factory.mktemp("any"), *(odd.get(h, (50 + h % 7, 20 + h % 5, 40 + h % 9)) for h in range(190)))


def against_sql(spark, folder, name):
    got = entry.queries()[name](spark, folder).toArrow()
    return oracle.differences(got, oracle.database(folder).execute(entry.oracle_sql()[name]).to_arrow_table())


def test_quotient_and_logarithm_as_in_sql(spark):
    pairs = [(a, b) for a in (0.0, -0.0, 2.0, -2.0, math.inf, math.nan, None) for b in (0.0, -0.0, 4.0, -4.0, -math.inf, math.nan, None)]
    got = spark.createDataFrame(pairs, "a double, b double").select(quotient("a", "b").alias("q"), ln("a").alias("l")).collect()
    con = duckdb.connect()
    want = [con.execute("select ?::double / ?::double, ln(?::double)", [a, b, a]).fetchone() for a, b in pairs]
    assert [tuple(map(repr, r)) for r in got] == [tuple(map(repr, r)) for r in want]


def test_range_volatility_estimators(spark, low, any_price):
    assert against_sql(spark, low, "f37_range_volatility_estimators") == ""
    assert against_sql(spark, any_price, "f37_range_volatility_estimators") == ""


def test_feature_set(spark, low):
    assert against_sql(spark, low, "f42_feature_set") == ""


@pytest.mark.parametrize("name", ["f01_log_return", "f02_rate_of_change", "f05_return_std", "f14_close_vs_mark_volatility", "f20_vwap", "f24_max_drawdown", "f25_sharpe", "f27_calmar", "f28_autocorrelation", "f36_amihud", "f38_hurst", "f40_past_distances"])
def test_families_of_the_feature_set(spark, any_price, name):
    assert against_sql(spark, any_price, name) == ""


def test_shape_of_infinite_returns_is_unknown(spark, any_price):
    """DuckDB stops at them."""
    rows = entry.queries()["f23_skew_kurtosis"](spark, any_price).where(f"ts > '{T0 + dt.timedelta(hours=60)}' and ts < '{T0 + dt.timedelta(hours=89)}'").collect()
    assert rows and all(r.skew_30 is None and r.kurtosis_30 is None for r in rows)


def test_range_barriers(spark, low, any_price):
    assert against_sql(spark, low, "g09_range_barriers") == ""
    assert against_sql(spark, any_price, "g09_range_barriers") == ""
