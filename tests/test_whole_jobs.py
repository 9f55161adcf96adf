"""Queries that do a whole job where an older one stops short, against plain Python."""

import datetime as dt
import itertools
import math
from collections import defaultdict

import numpy as np
import pytest

import __spark_entry__ as entry
from chronoloom.plans.research_queries import egarch_fit
from chronoloom.plans.series_queries import ffd_weights
from chronoloom.sources.bars import bars
from chronoloom.sources.tables import load

SF = "/root/testdata/sf0.001"


def test_every_subset_is_enumerated_with_a_pick_per_batch(spark):
    hits = defaultdict(list)
    for r in load(spark, SF, "stage1_pred_batch_predictions").collect():
        hits[r.pred_batch, r.action_key].append(r.y_true == r.y_pred)
    acc = {k: sum(v) / len(v) for k, v in hits.items()}
    keys, batches = sorted({k for _, k in acc}), sorted({b for b, _ in acc})
    cut = int(len(batches) * 0.7)
    want = {}
    for size in range(1, len(keys) + 1):
        for chosen in itertools.combinations(range(len(keys)), size):
            best = {b: max(a for a in (acc.get((b, keys[i])) for i in chosen) if a is not None) for b in batches if any((b, keys[i]) in acc for i in chosen)}
            parts = [[best[b] for b in part if b in best] for part in (batches[:cut], batches[cut:])]
            want[sum(1 << i for i in chosen)] = (size, *(sum(x) / len(x) if x else None for x in parts))
    got = {r["mask"]: (r["size"], r["train_mean_acc"], r["test_mean_acc"]) for r in entry.queries()["l31_every_subset"](spark, SF).collect()}
    assert len(got) == 2 ** len(keys) - 1 and got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-7) for k in want)


def test_greedy_prune_goes_on_until_two_are_left(spark, tmp_path):
    """Eight models that agree: no removal costs accuracy, so the search ends at the least number of candidates."""
    rows, t0 = [], dt.datetime(2024, 1, 1)
    for i in range(40):
        for k in range(8):
            truth = i % 2 * 3
            rows.append((i * 8 + k, "A", i // 4, t0 + dt.timedelta(hours=i), f"m{k}", truth, truth))
    df = spark.createDataFrame(rows, "row_id long, asset_id string, pred_batch int, timestamp timestamp_ntz, action_key string, y_true int, y_pred int")
    df.write.parquet(str(tmp_path / "stage1_pred_batch_predictions.parquet"))
    got = {r.action_key: r.kept for r in entry.queries()["m15_greedy_prune"](spark, str(tmp_path)).collect()}
    assert [k for k, kept in sorted(got.items()) if kept] == ["m6", "m7"]


def _egarch_likelihood(r, alpha, gamma, beta):
    e = [x - sum(r) / len(r) for x in r]
    start = math.log(sum(x * x for x in e) / len(e))
    lv, ll = start, 0.0
    for before, x in zip(e, e[1:]):
        shock = before / math.exp(lv / 2)
        lv = min(10.0, max(-20.0, (1 - beta) * start + alpha * (abs(shock) - math.sqrt(2 / math.pi)) + gamma * shock + beta * lv))
        ll -= 0.5 * (math.log(2 * math.pi) + lv + x * x / math.exp(lv))
    return ll


@pytest.mark.parametrize("seed", range(3))
def test_egarch_grid_is_searched_whole_on_demeaned_returns(seed):
    rng = np.random.default_rng(seed)
    r = rng.standard_t(4, 200) * 0.02 * np.exp(np.sin(np.arange(200) / 15)) + 0.05
    every = {(a, g, b): _egarch_likelihood(r.tolist(), a, g, b) for g in (-0.2, -0.1, -0.05, 0.0, 0.05) for b in (0.7, 0.8, 0.85, 0.9, 0.95) for a in (0.05, 0.1, 0.15, 0.2)}
    _, *point, ll = egarch_fit(r)
    assert len(every) == 100 and tuple(point) == max(every, key=every.get) and ll == pytest.approx(max(every.values()))


def test_egarch_grid_of_a_series_that_is_too_short_or_flat():
    assert egarch_fit(np.zeros(0)) == egarch_fit(np.ones(29)) == egarch_fit(np.ones(50)) == (0.0, 0.1, -0.1, 0.85, None)


def test_h04_gives_one_point_for_every_symbol(spark):
    got = entry.queries()["h04_egarch_grid"](spark, SF).collect()
    assert len(got) == len({r.symbol for r in got}) == 5 and all(r.log_likelihood is not None for r in got)


def _weights(order):
    w = [1.0]
    while len(w) < 100 and abs(nxt := w[-1] * (len(w) - 1 - order) / len(w)) >= 1e-5:
        w.append(nxt)
    return w


def test_fractional_difference_takes_the_whole_window(spark):
    assert len(_weights(0.4)) == 100 and ffd_weights(1.0, 100, 1e-5) == [1.0, -1.0]
    assert all(ffd_weights(k / 10, 100, 1e-5) == pytest.approx(_weights(k / 10)) for k in range(11))
    got = entry.queries()["e26_whole_fractional_difference"](spark, SF).toPandas().set_index(["symbol", "ts"]).ffd
    for symbol, pdf in bars(spark, SF).select("symbol", "ts", "close").toPandas().sort_values("ts").groupby("symbol"):
        x, w = np.log(pdf.close.to_numpy()), _weights(0.4)
        for i, ts in enumerate(pdf.ts):
            want = sum(w[k] * x[i - k] for k in range(100)) if i >= 99 else None
            assert (np.isnan(got[symbol, ts]) and want is None) or got[symbol, ts] == pytest.approx(want, abs=1e-6)


def test_optimal_difference_uses_the_whole_window(spark):
    from chronoloom.plans.pipeline_queries import adf_statistic

    got = {r.symbol: (r.difference_order, r.statistic) for r in entry.queries()["e27_optimal_difference"](spark, "/root/testdata/sf0.01").collect()}
    walks = {}
    for symbol, pdf in bars(spark, "/root/testdata/sf0.01").select("symbol", "ts", "close").toPandas().sort_values("ts").groupby("symbol"):
        walks[symbol] = np.log(pdf.close.to_numpy())
    for symbol, x in walks.items():
        tried = [(k / 10, adf_statistic(np.convolve(x, _weights(k / 10), mode="valid"))) for k in range(11) if len(x) - len(_weights(k / 10)) + 1 >= 50]
        passed = [t for t in tried if t[1] < -2.86]
        assert got[symbol] == pytest.approx(passed[0] if passed else (None, None))


def test_optimal_difference_of_a_walk(spark, tmp_path):
    """A walk that the filter of 20 weights made look stationary at another order than the whole one does."""
    from chronoloom.plans.pipeline_queries import adf_statistic

    x = first = whole = None
    for seed in range(200):
        x = np.cumsum(np.random.default_rng(seed).normal(0, 0.02, 400)) + 5
        orders = [k / 10 for k in range(11)]
        first = next(o for o in orders if adf_statistic(np.convolve(x, ffd_weights(o, 20), mode="valid")) < -2.86)
        whole = next(o for o in orders if adf_statistic(np.convolve(x, _weights(o), mode="valid")) < -2.86)
        if first != whole:
            break
    assert first != whole
    t0 = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(i, t0 + dt.timedelta(hours=i), "s", float(np.exp(v))) for i, v in enumerate(x)], "event_id long, ts timestamp_ntz, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    assert [r.difference_order for r in entry.queries()["e27_optimal_difference"](spark, str(tmp_path)).collect()] == [whole]


def test_helper_chunks_cover_every_row_and_only_look_back(spark, tmp_path):
    rng, t0 = np.random.default_rng(5), dt.datetime(2024, 1, 1)
    sizes = {"long": 637, "short": 143, "none": 100}
    events, walks = [], {}
    for symbol, n in sizes.items():
        walks[symbol] = np.exp(5 + np.cumsum(rng.normal(0, 0.02, n)))
        events += [(len(events) + i, t0 + dt.timedelta(hours=i), symbol, float(v)) for i, v in enumerate(walks[symbol])]

    def run(name, rows):
        spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string, value double").write.parquet(str(tmp_path / name / "events.parquet"))
        return {(r.symbol, int((r.ts - t0).total_seconds()) // 3600): r for r in entry.queries()["h14_helper_chunks"](spark, str(tmp_path / name)).collect()}

    got = run("whole", events)
    assert got.keys() == {(s, i) for s, n in sizes.items() for i in range(100, n)}
    assert all(r.chunk == (i - 100) // 10 and r.fitted_on == i // 100 * 100 for (_, i), r in got.items())
    r = np.concatenate([[0.0], np.diff(np.log(walks["long"]))])
    omega, alpha, gamma, beta, _ = egarch_fit(r[:600])
    e, lv = r - r[:600].mean(), math.log(r[:600].var())
    for i in range(637):
        if i >= 600:
            assert got["long", i].volatility == pytest.approx(math.exp(lv / 2))
        shock = e[i] / math.exp(lv / 2)
        lv = omega + beta * lv + alpha * (abs(shock) - math.sqrt(2 / math.pi)) + gamma * shock
    part = run("part", [e for e in events if e[2] == "long" and e[1] < t0 + dt.timedelta(hours=455)])
    assert len(part) == 355 and all(part[k].volatility == pytest.approx(got[k].volatility) for k in part)
