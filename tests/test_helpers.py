"""Helper models, folds and canonical bars on small made-up series, and the rules of meaning that are easy to get wrong."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoloom.functions import folds, helpers
from chronoloom.operators import canonical
from chronoloom.plans import evaluation_queries as E

T0 = dt.datetime(2024, 1, 1)
BARS = "row_id long, source_id string, timestamp timestamp_ntz, open double, high double, low double, close double, volume double, ingested_at timestamp_ntz"
FEEDS = "source_id string, asset_id string, step_seconds int, calendar_id string"


def canon(spark, times, calendar, step=60, closes=None):
    rows = [(i, "s", t, 10.0 + i, 10.2 + i, 9.8 + i, (closes or {}).get(i, 10.1 + i), 5.0, t) for i, t in enumerate(times)]
    feeds = spark.createDataFrame([("s", "A", step, calendar)], FEEDS)
    return canonical.canonical_bars(spark.createDataFrame(rows, BARS), feeds), feeds


def test_canonical_fills_gaps_of_an_open_calendar(spark):
    df, feeds = canon(spark, [T0 + dt.timedelta(minutes=m) for m in (0, 1, 3)], "always_open")
    got = df.orderBy("timestamp").collect()
    assert [r.is_synthetic_no_trade for r in got] == [False, False, True, False]
    assert (got[2].open, got[2].close, got[2].volume, got[2].minutes_since_prev_real_bar) == (11.1, 11.1, 0.0, 1)
    assert [r.session_bar_pos for r in got] == [0, 1, 2, 3] and got[0].is_weekly_open_bar and got[3].is_weekly_close_bar
    assert {r.session_id for r in got} == {"A_1"} and len(df.columns) == 21


def test_canonical_sessions_are_not_bridged(spark):
    friday = dt.datetime(2024, 1, 5, 20, 59)
    times = [friday, dt.datetime(2024, 1, 7, 22, 0), dt.datetime(2024, 1, 8, 0, 0), dt.datetime(2024, 1, 8, 0, 2), dt.datetime(2024, 1, 8, 20, 59), dt.datetime(2024, 1, 8, 22, 0), dt.datetime(2024, 1, 8, 22, 1)]
    got = canon(spark, times, "session_week")[0].orderBy("timestamp").collect()
    assert not any(r.timestamp.weekday() == 5 for r in got)
    assert dt.datetime(2024, 1, 8, 0, 1) in {r.timestamp for r in got} and not any(r.timestamp.hour == 21 for r in got)
    week = {r.timestamp: (r.is_weekly_open_bar, r.is_weekly_close_bar) for r in got}
    assert week[friday] == (True, True) and week[dt.datetime(2024, 1, 7, 22, 0)][0] and not week[dt.datetime(2024, 1, 8, 0, 0)][0]


def test_canonical_close_is_carried_for_every_row(spark):
    df, _ = canon(spark, [T0 + dt.timedelta(minutes=m) for m in (0, 1, 2, 3)], "always_open", closes={0: None, 2: None})
    got = df.orderBy("timestamp").collect()
    assert [r.close for r in got] == [11.1, 11.1, 13.1] and got[0].is_session_open_bar and not got[1].is_synthetic_no_trade
    empty = spark.createDataFrame([], BARS)
    assert canonical.canonical_bars(empty, spark.createDataFrame([], FEEDS)).count() == 0


def test_longer_bars_drop_what_is_incomplete(spark):
    df, feeds = canon(spark, [T0 + dt.timedelta(minutes=m) for m in range(90) if m != 7], "always_open")
    hours = canonical.longer_bars(df, feeds).collect()
    assert len(hours) == 1 and hours[0].is_open_session_gap_fill and hours[0].volume == 59 * 5.0
    assert canonical.longer_bars(df, feeds, drop_incomplete=False).count() == 2


def test_kalman_in_two_parts_is_kalman_in_one():
    rng = np.random.default_rng(0)
    x = np.cumsum(rng.normal(0, 0.1, 300)) + 0.01 * np.arange(300)
    fold, start = folds.kalman_acceleration(1e-4, 1e-2)
    F_, Q = np.array([[1, 1, 0.5], [0, 1, 1], [0, 0, 1.0]]), 1e-4 * np.array([[1 / 20, 1 / 8, 1 / 6], [1 / 8, 1 / 3, 1 / 2], [1 / 6, 1 / 2, 1]])
    s, p, m = start(), np.eye(3), np.array([x[0], 0, 0])
    innovations = []
    for i, z in enumerate(x):
        if i == 150:
            s = {**s}  # handed over
        s, out = fold(s, {"value": float(z)})
        m, p = F_ @ m, F_ @ p @ F_.T + Q
        e, k = z - m[0], p[:, 0] / (p[0, 0] + 1e-2)
        m, p = m + k * e, p - np.outer(k, p[0])
        innovations.append(e)
        sd = math.sqrt(max(np.var(innovations), 1e-10))
        assert out["innovation"] == pytest.approx(e) and out["velocity"] == pytest.approx(m[1]) and out["filtered_dev"] == pytest.approx(m[0] - z)
        assert out["zscore"] == pytest.approx((e - np.mean(innovations)) / sd, abs=1e-6)
    assert fold(s, {"value": None}) == (s, {})


def test_egarch_filter_against_numpy():
    rng = np.random.default_rng(1)
    r = rng.normal(0, 0.5, 200)
    fold, start = folds.egarch(-0.1, 0.15, -0.05, 0.95)
    s, lv, vols = start(), -0.1 / 0.05, []
    for x in r:
        s, out = fold(s, {"value": float(x)})
        vols.append(math.exp(lv / 2))
        shock = x / vols[-1]
        assert out["volatility"] == pytest.approx(vols[-1]) and out["shock"] == pytest.approx(shock)
        assert out["zscore"] == pytest.approx((vols[-1] - np.mean(vols)) / math.sqrt(max(np.var(vols), 1e-10)), abs=1e-6)
        lv = min(10, max(-20, -0.1 + 0.95 * lv + 0.15 * (abs(shock) - math.sqrt(2 / math.pi)) - 0.05 * shock))


def test_bocpd_finds_a_break():
    rng = np.random.default_rng(2)
    x = np.r_[rng.normal(0, 0.3, 60), rng.normal(4, 0.3, 60)]
    fold, start = folds.bocpd()
    s, runs = start(), []
    for v in x:
        s, out = fold(s, {"value": float(v)})
        runs.append(out["run_length"])
        assert sum(s["p"]) == pytest.approx(1) and len(s["p"]) <= 100
    assert runs[58] > 50 and runs[70] < 15


def test_supertrend_holds_its_bands():
    fold, start = folds.supertrend(1.0)
    s, seen = start(), []
    for i, c in enumerate([10, 11, 12, 13, 9, 8, 7, 12, 14]):
        s, out = fold(s, {"high": c + 0.5, "low": c - 0.5, "close": float(c), "atr": 1.0})
        seen.append(out["direction"])
    assert seen == [1, 1, 1, 1, -1, -1, -1, 1, 1]


def test_garch_fit_finds_clusters():
    rng = np.random.default_rng(5)
    v, r = 1.0, []
    for _ in range(3000):
        r.append(rng.normal(0, math.sqrt(v)))
        v = 0.05 + 0.15 * r[-1] ** 2 + 0.8 * v
    omega, alpha, beta, ll = helpers.garch_fit(np.array(r))
    assert 0.1 <= alpha <= 0.2 and 0.7 <= beta <= 0.85 and omega == pytest.approx(np.var(r) * (1 - alpha - beta))
    assert helpers.garch_fit(np.zeros(100))[1:] == (0.1, 0.85, 0.0) and helpers.garch_fit(np.zeros(0))[3] == 0.0


def test_tail_risk_window_and_back_fill():
    rng = np.random.default_rng(6)
    r = rng.standard_t(3, 400) * 0.1
    out = helpers.tail_risk(r)
    w = -r[0:200]
    u = np.quantile(w, 0.9)
    assert out[200, 2] == pytest.approx((w > u).mean()) and out[200, 3] >= u and out[200, 4] >= out[200, 3]
    assert (out[:200, 4] == out[200, 4]).all() and (out[:200, 2] == 0).all() and (out[:200, 6] == 0.05).all()  # looks ahead, by definition
    assert np.isnan(helpers.tail_risk(r[:150])).all() and helpers.pareto(np.ones(3)) == (0.0, 1.0)


def test_hidden_states_find_the_volatile_stretch():
    rng = np.random.default_rng(7)
    x = np.r_[rng.normal(0, 0.1, 150), rng.normal(0, 1.5, 150), rng.normal(0, 0.1, 150)]
    out = pd.DataFrame(helpers.hidden_states(x), columns=helpers.STATES)
    assert out.p_volatile[170:290].mean() > 0.9 and out.p_volatile[:140].mean() < 0.1
    assert out.state[200] == 1 and out.changed.sum() <= 4 and out.duration.min() == 1
    *_, seen = helpers.baum_welch(x)
    assert all(b >= a - 1e-6 for a, b in zip(seen, seen[1:]))
    start, move = np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.2, 0.8]])
    like = rng.random((6, 2))
    best = max(range(64), key=lambda m: np.log(start[m & 1] * like[0, m & 1]) + sum(np.log(move[m >> (t - 1) & 1, m >> t & 1] * like[t, m >> t & 1]) for t in range(1, 6)))
    assert helpers.viterbi(like, start, move).tolist() == [best >> t & 1 for t in range(6)]
    assert helpers.hidden_states(np.zeros(0)).shape == (0, len(helpers.STATES))


def test_isolation_scores_rank_outliers_first():
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (500, 3))
    x[17] = 9
    s = helpers.isolation_scores(x)
    assert s.argmax() == 17 and ((s > 0) & (s < 1)).all() and helpers.isolation_scores(x[:1]).tolist() == [0.5]


def test_deflated_sharpe_and_greedy_choices():
    assert E.deflated_sharpe(0.1, 500, 0.0, 3.0, 1, 0.1) > E.deflated_sharpe(0.1, 500, 0.0, 3.0, 20, 0.1)
    assert E.deflated_sharpe(0.0, 100, 0.0, 3.0, 1, 0.0) == pytest.approx(0.5)
    assert E.correlation_filter({("a", "b"): 0.9, ("a", "c"): -0.5, ("b", "c"): 0.1}, {"a": 0.3, "b": 0.2, "c": 0.1}, 0.4) == ["a"]
    assert E.set_cover({"a": {1, 2, 3}, "b": {3, 4}, "c": {1, 4, 5}, "d": set()}, 9) == [("a", 3), ("c", 2)]


def test_overfitting_is_seen(spark, tmp_path):
    """A model that is best by luck in every half is not best in the other one."""
    rows = [(i, "train", "a", b, T0, b, m, 0, int((b // 2) % 2 != k), 0.25, 0.25, 0.25, 0.25) for k, m in enumerate(("even", "odd")) for b in range(16) for i in range(3)]
    cols = "row_id long, stage_split string, asset_id string, pred_batch int, timestamp timestamp_ntz, batch_id int, action_key string, y_true int, y_pred int, " + ", ".join(f"prob_class_{j} double" for j in range(4))
    spark.createDataFrame(rows, cols).write.parquet(str(tmp_path / "stage1_pred_batch_predictions.parquet"))
    r = E.l11_combinatorial_overfitting(spark, str(tmp_path)).first()
    assert r.n_splits == 70 and r.pbo > 0.4


def test_exact_quantiles(spark, monkeypatch):
    from chronoloom.operators import quantiles

    rng = np.random.default_rng(9)
    x = np.r_[rng.lognormal(0, 3, 700), np.full(400, 2.5), [np.nan]]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double")
    shares = [0.0, 0.1, 0.33, 0.5, 0.9, 0.999, 1.0]
    want = np.quantile(x[~np.isnan(x)], shares)
    assert quantiles.exact_quantiles(df, F.col("v"), shares) == pytest.approx(list(want))
    monkeypatch.setattr(quantiles, "FETCHED", 3)
    assert quantiles.exact_quantiles(df, F.col("v"), [0.1, 0.5, 0.62]) == pytest.approx(list(np.quantile(x[~np.isnan(x)], [0.1, 0.5, 0.62])))
    assert quantiles.exact_quantiles(df.limit(0), F.col("v"), [0.5]) == [None]


def test_exits_guards_and_groups():
    from chronoloom.plans import research_queries as Q

    fold, s, seen = Q.barrier_exit(1.0, 2.0, 9.0, 3), None, []
    for c, lo, hi, atr in ((10, 10, 10, None), (10, 10, 10, 1.0), (10, 9.5, 10.5, 1.0), (9, 8.9, 10, 1.0), (10, 10, 10, 1.0), (12, 11, 12.5, 1.0), (10, 10, 10, 1.0), (10, 10, 10, 1.0), (10, 10, 10, 1.0), (11, 10, 11, 1.0)):
        s, out = fold(s, {"close": float(c), "low": float(lo), "high": float(hi), "atr": atr})
        seen.append((out["event"], out["pnl"]))
    assert [e for e, _ in seen] == ["wait", "enter", "hold", "stop", "enter", "take", "enter", "hold", "hold", "time"]
    assert seen[3][1] == pytest.approx(-0.1) and seen[5][1] == pytest.approx(0.2) and seen[9][1] == pytest.approx(0.1)
    fold, start = Q.risk_manager(10.0, 5.0, 1.0)
    s, on = start(), []
    for day, r in (("a", -0.6), ("a", -0.6), ("a", 5.0), ("b", 1.0), ("b", None)):
        s, out = fold(s, {"ret": r, "day": day})
        on.append(out["trading"])
    assert on == [1, 1, 0, 1, 1] and s["equity"] == pytest.approx(-0.2)
    assert Q.groups([("b", "c"), ("a", "b"), ("x", "y")]) == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
