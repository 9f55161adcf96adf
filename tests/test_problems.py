"""The general problem operators on small made-up tables, edge cases included."""

import datetime as dt
import json
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoloom.operators import consolidate, grid, rolling, schema_drift, spikes
from chronoloom.operators.blocks import last_known
from chronoloom.plans import problems
from chronoloom.sources.tables import load

T0 = dt.datetime(2024, 1, 1)
RUNS = "record_id long, pipeline_id long, pipeline_name string, config_kind string, file_path string, written_at timestamp_ntz, ingested_at timestamp_ntz, payload string"
BARS = "row_id long, source_id string, asset_id string, timestamp timestamp_ntz, open double, high double, low double, close double, volume double, turnover double, bar_interval string, ingested_at timestamp_ntz"
FEEDS = "source_id string, asset_id string, provider string, bar_interval string, step_seconds int, calendar_id string"


def run_rows(payloads, pipeline=1, kind="k"):
    return [(i + 1, pipeline, "p", kind, f"f{i}", T0 + dt.timedelta(hours=i), T0, p if p is None or isinstance(p, str) else json.dumps(p)) for i, p in enumerate(payloads)]


def found(df):
    return sorted(map(tuple, df.collect()))


def test_drift_kinds(spark):
    rows = run_rows([{"a": 1, "args": {"x": "s"}}, {"b": 2, "args": {"x": 1.5}}, {"b": None, "c": True, "args": {"x": None}}, {"b": "t", "args": {"x": 2.5, "y": None}}])
    got = found(schema_drift.drift(spark.createDataFrame(rows, RUNS)))
    assert got == [(2, "k.args.x", "type_changed"), (2, "k.b", "renamed"), (3, "k.c", "added"), (4, "k.args.y", "added"), (4, "k.b", "type_changed"), (4, "k.c", "removed")]


def test_drift_null_keeps_last_type(spark):
    rows = run_rows([{"a": 1}, {"a": None}, {"a": 2}, {"a": None}, {"z": 3}])
    assert found(schema_drift.drift(spark.createDataFrame(rows, RUNS))) == [(5, "k.z", "renamed")]


def test_drift_torn_and_repeated_files(spark):
    rows = run_rows([{"a": 1}, '{"a": 1, ', None, "[1]", {"a": 1, "b": 2}])
    rows.append((9, 1, "p", "k", "f4", T0 + dt.timedelta(hours=9), T0, json.dumps({"a": "other"})))
    assert found(schema_drift.drift(spark.createDataFrame(rows, RUNS))) == [(5, "k.b", "added")]


def test_drift_empty_and_across_blocks(spark):
    assert found(schema_drift.drift(spark.createDataFrame([], RUNS))) == []
    rows = [(1, 1, "p", "k", "f", T0, T0, '{"a": 1}'), (2, 1, "p", "k", "g", T0 + dt.timedelta(days=900), T0, '{"a": "s"}'), (3, None, None, None, None, None, None, '{"a": 1}')]
    assert found(schema_drift.drift(spark.createDataFrame(rows, RUNS))) == [(2, "k.a", "type_changed")]


def table_of(spark, rows):
    return {r.record_id: r for r in schema_drift.consistent_table(spark.createDataFrame(rows, RUNS)).collect()}


def test_consistent_table_follows_renames(spark):
    rows = run_rows([{"a": 1}, {"b": 2}, {"c": 3}])
    rows[2] = (*rows[2][:5], T0 + dt.timedelta(days=500), *rows[2][6:])
    got = {k: (r.version, r.fields) for k, r in table_of(spark, rows).items()}
    assert got == {1: (1, {"k.c": "1"}), 2: (2, {"k.c": "2"}), 3: (3, {"k.c": "3"})}


def test_consistent_table_loses_nothing(spark):
    got = table_of(spark, run_rows([{"args": "fast", "k": 1}, {"args": {}, "k": 2}, {"args": {"x": [1, {"y": 2}]}, "k": None}]))
    assert got[1].fields == {"k.args": "fast", "k.k": "1", "k.args.x": None}
    assert got[2].fields == {"k.args": "{}", "k.k": "2", "k.args.x": None}
    assert got[3].fields == {"k.args": None, "k.k": None, "k.args.x": '[1, {"y": 2}]'} and "default k.args" in got[3].applied
    renamed = table_of(spark, run_rows([{"a": 1}, {"b": 2}, {"a": 3}, {"a": 9, "b": 1}, {"a": 4}, {"b": 5}]))
    assert sorted(renamed[4].fields.values()) == ["1", "9"] and renamed[4].fields["k.b"] == "1"
    assert "collision k.a -> k.b" in renamed[4].applied
    assert [renamed[i].fields["k.b"] for i in (1, 2, 3, 5, 6)] == ["1", "2", "3", "4", "5"]


def test_consistent_table_casts_and_records(spark):
    got = table_of(spark, run_rows([{"n": 1, "m": "x"}, {"n": 2.5, "m": 3}, {"n": None, "m": True, "extra": 1}]))
    assert all(r.kinds == {"k.n": "fraction", "k.m": "string", "k.extra": "integer"} for r in got.values())
    assert "cast k.n integer -> fraction" in got[1].applied and "default k.extra" in got[1].applied
    assert got[2].fields == {"k.n": "2.5", "k.m": "3", "k.extra": None} and "cast k.m integer -> string" in got[2].applied
    assert got[3].applied == ["cast k.m boolean -> string"]


def test_drift_matches_a_plain_walk(spark):
    """Random streams, one of them with most files within minutes, against one pass in file order; ranges must link up."""
    rng = np.random.default_rng(3)
    rows, values = [], [1, 2.5, "s", True, None, [1], {"z": 1}]
    state = {}
    for i in range(900):
        stream = 1 if i % 3 else int(rng.integers(2, 6))
        fields = state.setdefault(stream, {"a": 1, "args": {"b": 2}})
        for part in (fields, fields["args"]):
            for _ in range(int(rng.integers(0, 3))):
                name = str(rng.choice(list("abcdefg")))
                if rng.random() < 0.3 and name in part:
                    part[str(rng.choice(list("hij")))] = part.pop(name)
                elif rng.random() < 0.3:
                    part.pop(name, None)
                else:
                    part[name] = values[int(rng.integers(0, len(values)))]
        rows.append((i + 1, stream, "p", "k", f"f{i}", T0 + dt.timedelta(seconds=i // 2), T0, json.dumps(fields)))
    want, routes, known = set(), {}, {}
    for record, stream, *_, payload in rows:
        schema = known.setdefault(stream, schema_drift.Schema())
        _, steps = schema.take(schema_drift._shape(schema_drift.members(payload)))
        want |= {(record, schema_drift.path_of("k", o, n), c) for o, n, c, *_ in steps}
        routes.setdefault(stream, []).append((record, [(o, old, n) for o, n, c, old, *_ in steps if c == "renamed"]))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        df = spark.createDataFrame(rows, RUNS)
        assert set(found(schema_drift.drift(df))) == want
        got = table_of(spark, rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == 900
    for stream, files in routes.items():
        names = {}
        for record, renames in reversed(files):
            payload = schema_drift.members(rows[record - 1][-1])
            fields = [(o, n, schema_drift.json_kind(v)) for (o, n), v in sorted(payload.items())]
            made, _ = schema_drift.routed(fields, [schema_drift._text(payload[o, n]) for o, n, _ in fields], names, "k")
            assert {k: v for k, v in got[record].fields.items() if v is not None} == {p: v for p, v, _ in made if v is not None}
            for o, a, b in renames:
                names[o, a] = names.get((o, b), b)
        numbers = [got[record].version for record, _ in files]
        assert numbers[0] == 1 and all(b - a in (0, 1) for a, b in zip(numbers, numbers[1:]))
        assert all((got[a].fingerprint == got[b].fingerprint) == (got[a].version == got[b].version) for (a, _), (b, _) in zip(files, files[1:]))


def series(n, seed=0, source="s", step=60):
    rng = np.random.default_rng(seed)
    close = (100 * np.exp(np.cumsum(rng.normal(0, 1e-3, n)))).tolist()
    opened = [100.0, *close[:-1]]
    out = []
    for i in range(n):
        hi, lo = max(opened[i], close[i]) * (1 + abs(rng.normal(0, 1e-3))), min(opened[i], close[i]) * (1 - abs(rng.normal(0, 1e-3)))
        out.append([i, source, "A", T0 + dt.timedelta(seconds=step * i), opened[i], hi, lo, close[i], float(rng.lognormal(3, 0.3)), 1.0, "1m", T0])
    return out


def test_spikes_and_frozen_runs(spark):
    rows = series(1200)
    rows[300][5] *= 1.4
    rows[500][8] *= 200
    for i in range(700, 712):
        rows[i][6] = rows[700][6]
    rows[900][8] = -3.0
    rows[901][5] = None
    rows += [[5000, *rows[300][1:]], [5001, None, "A", None, 1.0, 0.5, 0.4, 1.0, 1.0, 1.0, None, None]]
    got = set(found(spikes.implausible(spark.createDataFrame(rows, BARS))))
    want = {(300, "high"), (5000, "high"), (500, "volume"), (900, "volume"), (5001, "high")} | {(i, "low") for i in range(700, 712)}
    assert want <= got
    assert len(got - want) <= 2


def test_spikes_leave_genuine_things(spark):
    rows = series(1500, seed=3)
    for i in range(400, 460):  # a busy stretch
        rows[i][8] *= 30
        rows[i][5] *= 1.01
    for i in range(800, 1500):  # a lasting level shift
        for k in (4, 5, 6, 7):
            rows[i][k] *= 1.5
    for i in range(1000, 1030):  # no trades
        rows[i][4] = rows[i][5] = rows[i][6] = rows[i][7] = rows[999][7]
        rows[i][8] = 0.0
    assert len(found(spikes.implausible(spark.createDataFrame(rows, BARS)))) <= 3


def test_spikes_empty(spark):
    assert found(spikes.implausible(spark.createDataFrame([], BARS))) == []


def test_isolation_scores_outliers_higher():
    rng = np.random.default_rng(1)
    x = rng.lognormal(0, 0.5, (2000, spikes.FEATURES)).astype(np.float32)
    x[0] = 60
    forest = spikes.grow_forest(x, 7)
    s = spikes.score(forest, x)
    assert s[0] > np.quantile(s, 0.999)
    for above in (0.2, 0.3, 0.5):  # stopping early loses nothing
        assert (np.where(s >= above, s, 0) == np.where((t := spikes.score(forest, x, above)) >= above, t, 0)).all()
    again = spikes.unpack_forests(spikes.pack_forests([forest] * 3))
    assert len(again) == 3 and all((a == b).all() for a, b in zip(again[2], forest, strict=True))


def test_the_forest_decides(spark):
    rows = series(1500, seed=4)
    rows[300][5] *= 1.4
    rows[700][8] = -1.0
    df = spark.createDataFrame(rows, BARS)
    assert found(spikes.implausible(df)) == [(300, "high"), (700, "volume")]
    assert found(spikes.implausible(df, above=1.01)) == [(700, "volume")]
    assert spikes.implausible(df, above=-1.0).count() == 3 * 1500


def test_grid_marks_and_fills(spark):
    rows = series(400)
    gone = {5, 6, 7, 200}
    kept = [r for i, r in enumerate(rows) if i not in gone]
    kept[50][7] = None
    kept += [[9000, "s", "A", None, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, "1m", None], [9001, None, "A", T0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, "1m", None]]
    feeds = spark.createDataFrame([("s", "A", "p", "1m", 60, "always_open")], FEEDS)
    g = grid.regular_grid(spark.createDataFrame(kept, BARS), feeds).toPandas()
    missing = {int(s - T0.replace(tzinfo=dt.timezone.utc).timestamp()) // 60 for s in g[g.is_missing].slot_start}
    assert missing == gone | {53}
    assert len(g) == 400 and g.close.notna().all() and g.volume.notna().all()
    assert abs(g[g.is_missing].close - 100).max() < 20


def test_grid_closed_hours_and_long_gaps(spark):
    friday = dt.datetime(2024, 1, 5, 20, 0)
    rows = [[i, "w", "A", t, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, "5m", T0] for i, t in enumerate([friday, friday + dt.timedelta(days=28)])]
    feeds = spark.createDataFrame([("w", "A", "p", "5m", 300, "session_week")], FEEDS)
    got = [r.slot_start for r in grid.missing_slots(spark.createDataFrame(rows, BARS), feeds).collect()]
    assert len(got) == len(set(got)) == 4 * (5 * 252 + 5 * 24) - 1
    assert not any(dt.datetime.fromtimestamp(s, dt.timezone.utc).weekday() == 5 for s in got)


def test_grid_without_close_and_empty(spark):
    feeds = spark.createDataFrame([], FEEDS)
    rows = [[i, "n", "A", T0 + dt.timedelta(minutes=15 * i), 1.0, 1.0, 1.0, None, 1.0, 1.0, "15m", None] for i in range(3)]
    g = grid.regular_grid(spark.createDataFrame(rows, BARS), feeds).toPandas()
    assert len(g) == 3 and g.is_missing.all() and g.close.isna().all()
    assert grid.missing_slots(spark.createDataFrame([], BARS), feeds).count() == 0


LABELS = "row_id long, asset_id string, timestamp timestamp_ntz, close double, bb_middle double"


def test_rolling_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    rows, k = [], 0
    for asset in ("a", "b"):
        for day in range(70):
            for _ in range(int(rng.integers(0, 3)) if 20 > day or day > 45 else 0):
                rows.append((k, asset, T0 + dt.timedelta(days=day, hours=int(rng.integers(0, 24))), float(rng.normal(10, 2)), None if rng.random() < 0.2 else float(rng.normal(5, 1))))
                k += 1
    rows += [(10_000, *rows[0][1:]), (10_001, None, T0, 1.0, 1.0), (10_002, "a", None, 1.0, 1.0), (10_003, "a", T0 + dt.timedelta(days=3), float("nan"), 2.0)]
    got = rolling.trailing(spark.createDataFrame(rows, LABELS), "asset_id", "timestamp", ["close", "bb_middle"], [1, 7, 13, 30]).toPandas()
    base = pd.DataFrame(rows[:-3], columns=["row_id", "asset_id", "ts", "close", "bb"]).drop_duplicates(["asset_id", "ts", "close", "bb"])
    base["day"] = base.ts.dt.normalize()
    for r in got.sample(200, random_state=1).itertuples():
        day = pd.Timestamp(r.day)
        part = base[(base.asset_id == r.asset_id) & (base.day <= day) & (base.day > day - pd.Timedelta(days=r.period_days))]
        assert r.n_close == part.close.notna().sum()
        assert (r.total_close == pytest.approx(part.close.sum())) if r.n_close else np.isnan(r.total_close)
    assert len(got) == sum((g.day.max() - g.day.min()).days + 1 for _, g in base.groupby("asset_id")) * 4


def test_rolling_empty(spark):
    assert rolling.trailing(spark.createDataFrame([], LABELS), "asset_id", "timestamp", ["close"], [7]).count() == 0


def test_consolidation_keeps_every_record_once(spark, tmp_path):
    schema = "row_id long, file_id long, k string, batch_id int, timestamp timestamp_ntz, v double"
    rows = [(i, i % 7, f"k{i % 3}", i % 5, T0 + dt.timedelta(minutes=i % 40), None if i % 11 == 0 else float(i % 40)) for i in range(400)]
    rows += [(1000 + i, 99, *rows[i][2:]) for i in range(20)]
    files = [(f, T0 + dt.timedelta(minutes=(f * 3) % 5)) for f in range(7)] + [(50, None)]
    df, fdf = spark.createDataFrame(rows, schema), spark.createDataFrame(files, "file_id long, written_at timestamp_ntz")
    key = ["k", "batch_id", "timestamp"]
    dropped = {r.row_id for r in consolidate.repeated(df, fdf, key).collect()}
    at = dict(files)
    best = {}
    for r in sorted(rows, key=lambda r: (r[1] not in at, at.get(r[1], T0), r[1], r[0])):
        best.setdefault(r[2:], r[0])
    assert dropped == {r[0] for r in rows} - set(best.values())
    ranges = consolidate.write(df, fdf, key, str(tmp_path / "out")).collect()
    assert sum(r.n_rows for r in ranges) == len(best)
    assert spark.read.parquet(str(tmp_path / "out")).select("row_id").distinct().count() == len(best)
    assert consolidate.repeated(df.limit(0), fdf, key).count() == 0


def test_written_files_are_cut_by_bytes_across_keys(spark, tmp_path):
    schema = "row_id long, file_id long, k string, batch_id int, timestamp timestamp_ntz, v string"
    rows = [(i, i % 9, "hot" if i % 3 else f"k{i % 60:02}", 1, T0 + dt.timedelta(minutes=i), ("wide" * 200 if i % 3 == 1 else "w") + str(i)) for i in range(3000)]
    df, fdf = spark.createDataFrame(rows, schema), spark.createDataFrame([(f, T0) for f in range(9)], "file_id long, written_at timestamp_ntz")
    key, path = ["k", "batch_id", "timestamp"], str(tmp_path / "out")
    got = sorted(consolidate.write(df, fdf, key, path, 100_000).collect(), key=lambda r: tuple(r.lowest))
    assert sum(r.n_rows for r in got) == 3000 and all(r.n_bytes > 0 for r in got)
    assert all(tuple(a.highest) < tuple(b.lowest) for a, b in zip(got, got[1:]))
    sizes = [r.n for r in spark.read.parquet(path).groupBy("file_no").agg(F.sum(F.length("k") + F.length("v") + 28).alias("n")).orderBy("file_no").collect()]
    assert len(sizes) == len(got) and all(50_000 < n < 150_000 for n in sizes)
    assert sum(r.lowest.k == r.highest.k == "hot" for r in got) > 3  # one batch over many files
    assert any(r.lowest.k != r.highest.k for r in got)  # many keys in one file
    assert consolidate.write(df.limit(0), fdf, key, str(tmp_path / "none")).count() == 0


def test_one_record_stored_very_often_is_spread_over_ranges(spark):
    schema = "row_id long, file_id long, k string, batch_id int, timestamp timestamp_ntz, v double, more array<int>"
    rows = [(i, i % 5, "hot", 1, T0, None, [1, 2]) if i % 3 else (i, i % 5, f"k{i % 50}", i, T0, float(i), None) for i in range(3000)]
    df, fdf = spark.createDataFrame(rows, schema), spark.createDataFrame([(f, T0 + dt.timedelta(days=-f)) for f in range(5)], "file_id long, written_at timestamp_ntz")
    whole = consolidate.merged(df, fdf, ["k", "batch_id", "timestamp"], ["row_id"], ranges=8)
    copies = {r.row_id: r["__part"] for r in whole.where("copied").collect()}
    hot = [r[0] for r in rows if r[2] == "hot"]
    assert set(copies) == set(hot) - {min(hot, key=lambda i: (-(i % 5), i))}
    assert len(set(copies.values())) > 3


def test_p5_files_reports_the_files_on_disk(spark):
    d = "/root/testdata/sf0.001"
    got = problems.p5_files(spark, d).collect()
    assert sum(r.n_rows for r in got) == load(spark, d, "feature_batches").count() - problems.p5_found(spark, d).count()
    assert len(got) == 1 and all(r.n_bytes == Path(r.file.removeprefix("file:").replace("%3D", "=")).stat().st_size for r in got)


def test_last_known_across_blocks(spark):
    rng = np.random.default_rng(2)
    rows = [(["x", "y", None][i % 3], i, int(i // 40), None if rng.random() < 0.7 else i) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, t long, b long, v long")
    for inclusive, forward in ((True, True), (False, True), (True, False)):
        got = {(r.k, r.t): r.o for r in last_known(df, ["k"], ["t"], "b", F.col("v"), "o", inclusive=inclusive, forward=forward).collect()}
        for key in ("x", "y", None):
            part = [(t, v) for k, t, _, v in rows if k == key]
            for t, _ in part:
                seen = [v for u, v in part if v is not None and ((u <= t if inclusive else u < t) if forward else u >= t)]
                assert got[key, t] == ((seen[-1] if forward else seen[0]) if seen else None)
