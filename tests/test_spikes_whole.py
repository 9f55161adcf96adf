"""Forests and thresholds of problem 2 come from all readings of a source, whatever its blocks."""

import numpy as np
import pytest
from test_problems import BARS, found, series

from chronoloom.operators import spikes

N = 4_000


@pytest.fixture(scope="module")
def raw(spark):
    rows = series(N, seed=5, source="one") + [[N + i, *r[1:]] for i, r in enumerate(series(301, seed=6, source="two"))]
    for i in range(2_000, 2_800):  # some blocks are unlike the others
        rows[i][8] *= 1 + i % 7
        rows[i][5] *= 1.004
    return spark.createDataFrame(rows, BARS).cache()


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(spikes, "BLOCK_SLOTS", 512)


def test_forest_is_grown_on_all_blocks(spark, raw, small_blocks):
    bars = spikes.bar_columns(raw)
    profile = spikes.source_profile(spikes.block_summary(bars)).where("source_id = 'one'").toPandas().iloc[0]
    one = bars.where("source_id = 'one'").toPandas().sort_values(["at", "row_id"])
    made = spikes.features(one, *spikes._profile(profile))
    drawn = np.argsort(spikes.lots(one))[: spikes.DRAWN]
    per_block = np.bincount(drawn * 8 // N, minlength=8)
    assert profile["n"] == N and per_block.min() > 0.5 * per_block.max()
    seed = int.from_bytes(b"one", "big")
    got = {(r.row_id, r.field_name): r.score for r in spikes.every_score(raw).where(f"row_id < {N}").collect()}
    assert len(got) == len(spikes.FIELDS) * N
    for i, name in enumerate(spikes.FIELDS):
        want = spikes.score(spikes.grow_forest(made[name][drawn], seed + i), made[name])
        assert np.array([got[k, name] for k in one["row_id"]]) == pytest.approx(want, rel=1e-6)


@pytest.mark.parametrize("above", [0.02, 0.05])
def test_threshold_is_of_the_median_of_all_readings(raw, small_blocks, above):
    scores = spikes.every_score(raw).join(raw.select("row_id", "source_id"), "row_id").toPandas()
    usual = scores.groupby(["source_id", "field_name"])["score"].transform("median")
    want = scores[scores["score"] >= usual + above * (1 - usual)]
    assert 0 < len(want) < len(scores) / 2
    assert found(spikes.scored(spikes.bar_columns(raw), above=above).select("row_id", "field_name")) == sorted(zip(want["row_id"], want["field_name"], strict=True))


def test_each_tree_has_readings_of_its_own():
    x = np.random.default_rng(0).lognormal(0, 0.5, (spikes.DRAWN, spikes.FEATURES)).astype(np.float32)
    seen = []
    grow, spikes.grow = spikes.grow, lambda part, rng: seen.append(part)
    try:
        spikes.grow_forest(x, 1)
    finally:
        spikes.grow = grow
    assert len(seen) == spikes.TREES and sorted(map(tuple, np.concatenate(seen))) == sorted(map(tuple, x))
