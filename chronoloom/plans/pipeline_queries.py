"""Training-set assembly, splits, selection and reports of the walk-forward pipeline (E, F, G, I, J, K, L, M, O, P), with their SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions.windows import div, lag, lead, nz, ordered, roll
from chronoloom.operators import relational as R
from chronoloom.operators.scan import ewm, scan
from chronoloom.operators.transformers import Interactions, PastWinsorizer, RollingScore, SignedLog
from chronoloom.plans.metric_queries import _LOSS, BARS, KNOWN, P, PROBS, _loss, _pred, _returns
from chronoloom.plans.relational_queries import Query
from chronoloom.plans.research_queries import HIT, UPP, _hit, _up
from chronoloom.plans.series_queries import _DIST, _ewm_sql, _TR, _true_range, g04_four_class_label
from chronoloom.sources import bars as source
from chronoloom.sources.tables import load, micros

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
B = f"with {source.sql()} "
TARGETS: dict[str, Callable[[DataFrame, int], Column]] = {}


def query(sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def target(name: str):
    """Register a target: a function of a frame of bars and a horizon that gives a column."""

    def keep(build):
        if name in TARGETS:
            raise ValueError(f"target {name} is registered twice")
        TARGETS[name] = build
        return build

    return keep


@target("direction")
def _direction(df: DataFrame, horizon: int) -> Column:
    return F.signum(lead("close", horizon) - F.col("close")).cast("int")


@target("forward_return")
def _forward(df: DataFrame, horizon: int) -> Column:
    return F.log(lead("close", horizon) / F.col("close"))


@target("range_ahead")
def _range_ahead(df: DataFrame, horizon: int) -> Column:
    w = ordered().rowsBetween(1, horizon)
    return F.when(F.count("high").over(w) == horizon, (F.max("high").over(w) - F.min("low").over(w)) / F.col("close"))


@query(B + "select symbol, ts, sign(lead(close, 3) over (partition by symbol order by ts) - close)::int as direction, round(ln(lead(close, 3) over (partition by symbol order by ts) / close), 6) as forward_return, round(case when count(high) over w = 3 then (max(high) over w - min(low) over w) / close end, 9) as range_ahead from bars window w as (partition by symbol order by ts rows between 1 following and 3 following)")
def g20_target_registry(spark, d):
    b = source.bars(spark, d)
    digits = {"forward_return": 6, "range_ahead": 9}
    return b.select("symbol", "ts", *(F.round(f(b, 3), digits[n]).alias(n) if n in digits else f(b, 3).alias(n) for n, f in TARGETS.items()))


def adf_statistic(x: np.ndarray) -> float:
    """t statistic of the lagged level in a regression of the differences on it, a constant and one lagged difference."""
    y = np.diff(x)
    if len(y) < 10:
        return math.nan
    z = np.column_stack([np.ones(len(y) - 1), x[1:-1], y[:-1]])
    beta, *_ = np.linalg.lstsq(z, y[1:], rcond=None)
    e = y[1:] - z @ beta
    cov = np.linalg.pinv(z.T @ z) * (e @ e) / max(1, len(e) - 3)
    return float(beta[1] / math.sqrt(cov[1, 1]))


@query()
def e27_optimal_difference(spark, d):
    """Smallest order of fractional differencing whose series passes the test at 5 %, per symbol; NULL where none does.

    Weights run to 1e-5 or 100 of them; orders that leave fewer than 50 values are passed over.
    """
    from chronoloom.plans.series_queries import ffd_weights

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.log(pdf.sort_values("ts")["close"].to_numpy())
        found = None, None
        for order in (0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0):
            w = np.array(ffd_weights(order, 100, 1e-5))
            if len(x) - len(w) + 1 < 50:
                continue
            s = adf_statistic(np.convolve(x, w, mode="valid"))
            if s < -2.86:
                found = order, s
                break
        return pd.DataFrame([(pdf["symbol"].iloc[0], *found)], columns=["symbol", "difference_order", "statistic"])

    return source.bars(spark, d).select("symbol", "ts", "close").groupBy("symbol").applyInPandas(run, "symbol string, difference_order double, statistic double")


@query(_ewm_sql({"atr": ("tr", 2 / 15)}, _TR).removesuffix("select symbol, ts, ") + "select r.symbol, r.ts, round((b.close - b.past) / nullif(atr, 0), 6) as momentum_atr, round(atr / b.close, 6) as atr_share from r join (select symbol, ts, close, lag(close, 6) over (partition by symbol order by ts) as past from bars) b on r.symbol = b.symbol and r.ts = b.ts")
def f04_momentum_in_atr(spark, d):
    df = _true_range(source.bars(spark, d)).withColumn("past", lag("close", 6)).select("symbol", "ts", "close", "past", "tr")
    df = ewm(df, ["symbol"], "ts", {"atr": (F.col("tr"), 2 / 15)})
    return df.select("symbol", "ts", F.round(div(F.col("close") - F.col("past"), nz(F.col("atr"))), 6).alias("momentum_atr"), F.round(F.col("atr") / F.col("close"), 6).alias("atr_share"))


_BB = "m as (select *, avg(close) over w as mid, stddev_samp(close) over w as sd, count(*) over w as n from bars window w as (partition by symbol order by ts rows between 19 preceding and current row))"


@query(B + f", {_BB} select symbol, ts, round(case when n = 20 then (close - (mid - 2 * sd)) / nullif(4 * sd, 0) * 100 end, 5) as bb_position, ((epoch_us(ts) % 28800000000) // 7200000000)::int as segment from m")
def g06_distance_metric_stage(spark, d):
    """Band position over the whole series, across period borders, and the two-hour segment of the bar in its period."""
    b, mid, sd = source.bars(spark, d), roll(F.avg, "close", 20), roll(F.stddev_samp, "close", 20)
    seg = F.floor(F.pmod(micros("ts"), F.lit(28_800_000_000)) / 7_200_000_000).cast("int")
    return b.select("symbol", "ts", F.round(div(F.col("close") - (mid - 2 * sd), nz(4 * sd)) * 100, 5).alias("bb_position"), seg.alias("segment"))


_X = f"with {source.sql()}, x as (select * from bars) "


@query(_X + f", {_DIST}, e as (select symbol, ts, epoch_us(ts) // 28800000000 as batch from bars), q as (select symbol, epoch_us(ts) // 28800000000 as batch, max(high) as hi, min(low) as lo from bars group by 1, 2) select e.symbol, e.ts, l.label, q.hi as next_hi, q.lo as next_lo from e join l on e.symbol = l.symbol and e.ts = l.ts left join q on q.symbol = e.symbol and q.batch = e.batch + 1")
def g07_label_stage(spark, d):
    """Labels joined with the window of the opposite family that begins where the entry period ends."""
    batch = F.floor(micros("ts") / 28_800_000_000)
    ahead = source.bars(spark, d).groupBy("symbol", (batch - 1).alias("batch")).agg(F.max("high").alias("next_hi"), F.min("low").alias("next_lo"))
    e = g04_four_class_label(spark, d).select("symbol", "ts", "label", batch.alias("batch"))
    return e.join(ahead, ["symbol", "batch"], "left").drop("batch")


@query()
def i03_expanded_exclusion(spark, d):
    """Compact flags on a grid of minutes: each holds for the hour after its bar; a minute on which both sides hold has neither."""
    from chronoloom.plans.signal_queries import i02_compact_events

    c = i02_compact_events(spark, d)
    grid = c.select("symbol", F.explode(F.sequence(F.col("ts").cast("timestamp") + F.expr("interval 1 hour"), F.col("ts").cast("timestamp") + F.expr("interval 119 minutes"), F.expr("interval 1 minute"))).alias("minute"), "trend_long", "trend_short")
    g = grid.groupBy("symbol", "minute").agg(F.max("trend_long").alias("l"), F.max("trend_short").alias("s"))
    return g.select("symbol", "minute", F.when(F.col("s") == 1, 0).otherwise(F.col("l")).alias("trend_long"), F.when(F.col("l") == 1, 0).otherwise(F.col("s")).alias("trend_short"))


_Z30 = "avg(close) over w as m, stddev_samp(close) over w as s, count(close) over w as n from bars window w as (partition by symbol order by ts rows between 29 preceding and current row)"


@query(B + f", z as (select *, {_Z30}) select symbol, ts, round(sign(open - 1) * ln(1 + abs(open - 1)), 6) + 0.0 as open_log, round(case when n = 30 and s > 0 then least(greatest((close - m) / s, -5), 5) end, 6) + 0.0 as close from z")
def j01_transformer_chain(spark, d):
    b = source.bars(spark, d).select("symbol", "ts", (F.col("open") - 1).alias("open_log"), "close")
    b = RollingScore(["close"], 30).fit(b).transform(SignedLog(["open_log"]).transform(b))
    return b.select("symbol", "ts", F.round("open_log", 6).alias("open_log"), F.round("close", 6).alias("close"))


@query()
def j03_interactions(spark, d):
    """Products of bar columns that correlate most with the next return, found on the frame and added to it."""
    b = _returns(spark, d).withColumn("target", lead("ret")).fillna(0.0, ["ret"])
    made = Interactions(["close", "volume", "ret"], "target", top=2).fit(b).transform(b)
    return PastWinsorizer(["close"]).transform(made)


@query()
def j06_rank_configurations(spark, d):
    """Rolling-rank windows and clips scored by binned mutual information with the sign of the next return; ranks are made once per window."""
    b = _returns(spark, d).withColumn("y", (lead("ret") > 0).cast("int"))
    for n in (20, 50):
        hist = F.collect_list("ret").over(ordered().rowsBetween(-n, -1))
        b = b.withColumn(f"h{n}", hist).withColumn(f"r{n}", F.when(F.size(f"h{n}") == n, F.size(F.filter(f"h{n}", lambda v: v <= F.col("ret"))) / n)).drop(f"h{n}")
    rows = b.where("y is not null").unpivot(["y"], ["r20", "r50"], "window", "r").where("r is not null")
    rows = rows.withColumn("clip", F.explode(F.array(F.lit(0.0), F.lit(0.05)))).withColumn("bin", F.floor(F.least(F.greatest(F.col("r"), F.col("clip")), 1 - F.col("clip")) * 10))
    n = rows.groupBy("window", "clip", "bin", "y").count()
    all_, by_bin, by_y = (F.sum("count").over(Window.partitionBy("window", "clip", *k)) for k in ((), ("bin",), ("y",)))
    mi = n.withColumn("i", F.col("count") / all_ * F.log(F.col("count") * all_ / (by_bin * by_y)))
    return mi.groupBy("window", "clip").agg(F.sum("i").alias("mutual_information"), F.sum("count").alias("n"))


@query(BARS + ", w as (select symbol, ts, lead(ret) over (partition by symbol order by ts) as y, " + ", ".join(f"case when count(close) over (partition by symbol order by ts rows between {n} preceding and 1 preceding) = {n} then avg(close) over (partition by symbol order by ts rows between {n} preceding and 1 preceding) / close - 1 end as d{n}" for n in (5, 10, 20)) + " from x), u as (select y, 5 as n, d5 as v from w union all select y, 10, d10 from w union all select y, 20, d20 from w), k as (select * from u where y is not null and v is not null), r as (select n, rank() over (partition by n order by v) + (count(*) over (partition by n, v) - 1) / 2.0 as a, rank() over (partition by n order by y) + (count(*) over (partition by n, y) - 1) / 2.0 as b from k) select n, round(corr(a, b), 6) as ic from r group by n")
def j08_distance_window_search(spark, d):
    w = lambda n: ordered().rowsBetween(-n, -1)
    x = _returns(spark, d).select(lead("ret").alias("y"), *(F.when(F.count("close").over(w(n)) == n, F.avg("close").over(w(n)) / F.col("close") - 1).alias(str(n)) for n in (5, 10, 20)))
    k = x.where("y is not null").unpivot(["y"], ["5", "10", "20"], "n", "v").where("v is not null").withColumn("n", F.col("n").cast("int"))
    r = k.select("n", R.average_rank("v", "n").alias("a"), R.average_rank("y", "n").alias("b"))
    return r.groupBy("n").agg(F.round(F.corr("a", "b"), 6).alias("ic"))


@query(P + ", b as (select distinct pred_batch from p), n as (select pred_batch, row_number() over (order by pred_batch) - 1 as i from b), s as (select i as step from n where i >= 12 and i % 5 = 0) select step::bigint as step, pred_batch, (i < step - 2)::int as in_expanding, (i >= step - 8 and i < step - 2)::int as in_sliding from s join n on i < step")
def k03_dual_windows(spark, d):
    n = _pred(spark, d, "pred_batch").distinct().withColumn("i", F.row_number().over(Window.orderBy("pred_batch")) - 1)  # one row per batch
    last = n.agg(F.max("i"))
    steps = n.withColumn("step", F.explode(F.sequence(F.greatest(F.col("i") + 1, F.lit(12)).cast("long"), F.greatest(last.scalar(), F.col("i") + 1, F.lit(12)).cast("long")))).where(F.col("step") <= last.scalar()).where("step % 5 = 0")
    i, s = F.col("i"), F.col("step")
    return steps.select(s.alias("step"), "pred_batch", (i < s - 2).cast("int").alias("in_expanding"), ((i >= s - 8) & (i < s - 2)).cast("int").alias("in_sliding"))


@query(P + ", c as (select stage_split, y_true, count(*) as n from p where y_true is not null group by 1, 2), s as (select stage_split, n / sum(n) over (partition by stage_split) as q from c) select stage_split, round(-sum(q * ln(q)) / ln(4), 8) as balance, (min(q) >= 0.05)::int as balanced from s group by 1")
def k05_class_balance(spark, d):
    c = _pred(spark, d, "stage_split", "y_true").where("y_true is not null").groupBy("stage_split", "y_true").agg(F.count("*").alias("n"))
    s = c.select("stage_split", (F.col("n") / F.sum("n").over(Window.partitionBy("stage_split"))).alias("q"))
    return s.groupBy("stage_split").agg(F.round(-F.sum(F.col("q") * F.log("q")) / math.log(4), 8).alias("balance"), (F.min("q") >= 0.05).cast("int").alias("balanced"))


@query()
def k10_stratified_split(spark, d):
    """A fifth of every class for validation, by the order of a hash: the same rows on every run, whatever the partitions."""
    p = _pred(spark, d, "row_id", "y_true").where("y_true is not null")
    share = F.pmod(F.xxhash64("row_id", F.lit(7)), F.lit(1_000_000)) / 1_000_000
    return p.withColumn("role", F.when(share < 0.2, "val").otherwise("train")).groupBy("y_true", "role").agg(F.count("*").alias("n"))


@query()
def k07_combo_grid(spark, d):
    """Training and validation lengths crossed; every combination is fitted with a logistic model and scored on the batches after it."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    p = _pred(spark, d, "pred_batch", "y_true", *PROBS).dropna().where("y_true between 0 and 3").withColumn("label", (F.col("y_true") >= 2).cast("double"))
    v = VectorAssembler(inputCols=PROBS, outputCol="features").transform(p).select("pred_batch", "label", "features")
    last = v.agg(F.max("pred_batch")).first()[0] or 0
    out = []
    for train in (6, 12):
        for val in (2, 4):
            fit = v.where((F.col("pred_batch") <= last - val) & (F.col("pred_batch") > last - val - train))
            if fit.select("label").distinct().count() < 2:
                continue
            scored = LogisticRegression(maxIter=10).fit(fit).transform(v.where(F.col("pred_batch") > last - val))
            out.append((train, val, scored.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]))
    return spark.createDataFrame(out, "train_batches int, val_batches int, accuracy double")


@query('select f.row_id, l.bb_middle, p.n_pred from feature_batches f left join (select asset_id, "timestamp", max(bb_middle) as bb_middle from label_bars group by all) l on f.asset_id = l.asset_id and f."timestamp" = l."timestamp" left join (select asset_id, "timestamp", count(*) as n_pred from stage1_pred_batch_predictions group by all) p on f.asset_id = p.asset_id and f."timestamp" = p."timestamp"')
def k14_aligned_targets(spark, d):
    key = ["asset_id", "timestamp"]
    f = load(spark, d, "feature_batches", "row_id", *key)
    l = load(spark, d, "label_bars", *key, "bb_middle").groupBy(*key).agg(F.max("bb_middle").alias("bb_middle"))  # noqa: E741
    p = _pred(spark, d, *key).groupBy(*key).agg(F.count("*").alias("n_pred"))
    return f.join(l, key, "left").join(p, key, "left").select("row_id", "bb_middle", "n_pred")


@query(BARS + ", q as (select symbol, ts, ret, quantile_cont(close, 0.9) over w - quantile_cont(close, 0.1) over w as width, count(*) over w as n from x window w as (partition by symbol order by ts rows between 60 preceding and 1 preceding)), m as (select symbol, median(width) as med from q where n = 60 group by 1) select q.symbol, round(avg(ret * least(med / nullif(width, 0), 2)), 6) + 0.0 as sized, round(avg(ret), 6) + 0.0 as fixed from q join m on q.symbol = m.symbol where n = 60 and ret is not null group by 1")
def l16_interval_sizing(spark, d):
    w = ordered().rowsBetween(-60, -1)
    q = _returns(spark, d).select("symbol", "ts", "ret", F.percentile("close", F.array(F.lit(0.1), F.lit(0.9))).over(w).alias("q"), F.count("*").over(w).alias("n")).where("n = 60").withColumn("width", F.col("q")[1] - F.col("q")[0])
    m = q.groupBy("symbol").agg(F.median("width").alias("med"))
    size = F.least(F.try_divide("med", F.nullif(F.col("width"), F.lit(0.0))), F.lit(2.0))
    return q.join(m, "symbol").where("ret is not null").groupBy("symbol").agg(F.round(F.avg(F.col("ret") * size), 6).alias("sized"), F.round(F.avg("ret"), 6).alias("fixed"))


@query()
def m15_greedy_prune(spark, d):
    """Candidates dropped one by one while the accuracy of the majority of the rest doesn't fall; votes are counted in Spark."""
    p = _pred(spark, d, "asset_id", "timestamp", "action_key", "y_pred", "y_true").dropna()
    up = p.groupBy("asset_id", "timestamp", "action_key").agg(F.max((F.col("y_pred") >= 2).cast("int")).alias("up"), F.max((F.col("y_true") >= 2).cast("int")).alias("truth"))
    votes = up.groupBy("asset_id", "timestamp").agg(F.map_from_entries(F.collect_list(F.struct("action_key", "up"))).alias("m"), F.max("truth").alias("truth"))
    keys = [r[0] for r in up.select("action_key").distinct().orderBy("action_key").collect()]

    def accuracies(sets: list[list[str]]) -> list[float]:
        def right(keep):
            own = [F.coalesce(F.try_element_at("m", F.lit(k)), F.lit(0)) for k in keep]
            here = [F.try_element_at("m", F.lit(k)).isNotNull().cast("int") for k in keep]
            n = sum(here[1:], here[0])
            return F.avg(F.when(n > 0, ((sum(own[1:], own[0]) * 2 >= n).cast("int") == F.col("truth")).cast("double")))

        return list(votes.agg(*(right(s).alias(str(i)) for i, s in enumerate(sets))).first())

    keep, best = keys, accuracies([keys])[0] if keys else 0.0
    while len(keep) > 2:
        sets = [[k for k in keep if k != x] for x in keep]
        acc = accuracies(sets)
        i = max(range(len(acc)), key=lambda j: acc[j] or 0.0)
        if (acc[i] or 0.0) < best:
            break
        keep, best = sets[i], acc[i]
    return spark.createDataFrame([(k, k in keep) for k in keys], "action_key string, kept boolean")


@query(P + f", {_LOSS}, k as (select pred_batch, split_part(action_key, '|', 1) as policy, avg(loss) as loss from loss group by 1, 2), c as (select pred_batch, policy, loss, exp(-3 * coalesce(sum(loss) over (partition by policy order by pred_batch rows between unbounded preceding and 1 preceding), 0)) as w from k), n as (select pred_batch, policy, loss, w / sum(w) over (partition by pred_batch) as q from c) select pred_batch, round(sum(q * loss), 8) as pool_loss, count(*) as n_policies from n group by 1")
def m18_policy_pool(spark, d):
    k = _loss(spark, d).groupBy("pred_batch", F.split_part("action_key", F.lit("|"), F.lit(1)).alias("policy")).agg(F.avg("loss").alias("loss"))
    past = Window.partitionBy("policy").orderBy("pred_batch").rowsBetween(Window.unboundedPreceding, -1)
    batch = Window.partitionBy("pred_batch")
    c = k.withColumn("s", -3 * F.coalesce(F.sum("loss").over(past), F.lit(0.0)))
    c = c.withColumn("w", F.exp(F.col("s") - F.max("s").over(batch)))
    return c.groupBy("pred_batch").agg(F.round(F.sum(F.col("w") * F.col("loss")) / F.sum("w"), 8).alias("pool_loss"), F.count("*").alias("n_policies"))


@query(P + f", {_LOSS} select pred_batch, action_key, round(avg(loss) over w3, 8) as loss3, round(coalesce(loss_before - lag(loss_before) over o, 0), 8) as delta from (select *, lag(loss) over (partition by action_key order by pred_batch) as loss_before from loss) window w3 as (partition by action_key order by pred_batch rows between 3 preceding and 1 preceding), o as (partition by action_key order by pred_batch)")
def m20_live_safe_features(spark, d):
    """Features of a batch from losses of earlier batches only."""
    w = Window.partitionBy("action_key").orderBy("pred_batch")
    t = _loss(spark, d).withColumn("before", F.lag("loss").over(w))
    return t.select("pred_batch", "action_key", F.round(F.avg("loss").over(w.rowsBetween(-3, -1)), 8).alias("loss3"), F.round(F.coalesce(F.col("before") - F.lag("before").over(w), F.lit(0.0)), 8).alias("delta"))


@query("select file_path, sha256(concat_ws('|', file_path, coalesce(n_rows, -1)::varchar, n_bytes::varchar)) as fingerprint from batch_files")
def o08_fingerprints(spark, d):
    f = load(spark, d, "batch_files", "file_path", "n_rows", "n_bytes")
    return f.select("file_path", F.sha2(F.concat_ws("|", "file_path", F.coalesce("n_rows", F.lit(-1)).cast("string"), F.col("n_bytes").cast("string")), 256).alias("fingerprint"))


@query("select t, n from (select 'feature_batches' as t, count(*) as n from feature_batches union all select 'label_bars', count(*) from label_bars union all select 'raw_bars', count(*) from raw_bars)")
def o09_preflight(spark, d):
    parts = [load(spark, d, t).agg(F.lit(t).alias("t"), F.count("*").alias("n")) for t in ("feature_batches", "label_bars", "raw_bars")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ---- research layer -----------------------------------------------------------------------------------------------------


@query(P + "select action_key, count(*) as n, sum(case when y_pred >= 2 and y_true < 2 then 1 else 0 end)::bigint as false_up, sum(case when y_pred < 2 and y_true >= 2 then 1 else 0 end)::bigint as false_down, round(sum(case when y_pred >= 2 and y_true < 2 then 3 when y_pred < 2 and y_true >= 2 then 2 when y_pred <> y_true then 1 else 0 end) / count(*), 8) as cost from p group by 1")
def research_p07_standard_metrics(spark, d):
    up, truth = F.col("y_pred") >= 2, F.col("y_true") >= 2
    cost = F.when(up & ~truth, 3).when(~up & truth, 2).when(F.col("y_pred") != F.col("y_true"), 1).otherwise(0)
    return _pred(spark, d, "action_key", "y_pred", "y_true").groupBy("action_key").agg(F.count("*").alias("n"), F.sum(F.when(up & ~truth, 1).otherwise(0)).alias("false_up"), F.sum(F.when(~up & truth, 1).otherwise(0)).alias("false_down"), F.round(F.sum(cost) / F.count("*"), 8).alias("cost"))


@query(P + f", a as (select asset_id, action_key, time_bucket(interval 1 hour, \"timestamp\") as anchor, \"timestamp\" as ts, row_id, {UPP} as up from p where {KNOWN} and asset_id is not null) select asset_id, action_key, anchor, round(arg_max(up, (ts, row_id)), 9) as at_close, round(avg(up), 9) as mean from a group by 1, 2, 3")
def research_p06_anchor_candidates(spark, d):
    p = _pred(spark, d, "asset_id", "action_key", "timestamp", "row_id", *PROBS).dropna(subset=[*PROBS, "asset_id", "timestamp"]).withColumn("up", _up())
    g = p.groupBy("asset_id", "action_key", F.window("timestamp", "1 hour").alias("w"))
    return g.agg(F.round(F.max_by("up", F.struct("timestamp", "row_id")), 9).alias("at_close"), F.round(F.avg("up"), 9).alias("mean")).select("asset_id", "action_key", F.col("w.start").alias("anchor"), "at_close", "mean")


@query()
def research_p10_weight_methods(spark, d):
    """Uniform, winner, accuracy and exponentially weighted accuracy weights of every model after the last batch."""
    loss = _loss(spark, d)
    smooth = scan(loss, ["action_key"], "pred_batch", lambda s, r: ((e := 1 - r["loss"] if s is None else 0.9 * s + 0.1 * (1 - r["loss"])), {"e": e}), lambda: None, "e double")
    m = smooth.groupBy("action_key").agg(F.avg(1 - F.col("loss")).alias("acc"), F.max_by("e", "pred_batch").alias("ewma"))
    every = Window.partitionBy()  # one row per model
    best = F.col("acc") == F.max("acc").over(every)
    return m.select("action_key", (1 / F.count("*").over(every)).alias("uniform"), best.cast("int").alias("winner"), (F.col("acc") / F.sum("acc").over(every)).alias("by_accuracy"), (F.col("ewma") / F.sum("ewma").over(every)).alias("by_ewma"))


@query(P + f", s as (select action_key, y_pred, count(*) as n, avg({HIT}) as q from p where y_pred is not null and action_key is not null group by 1, 2) select action_key, y_pred, n, round(q, 8) as quality, case when n < 20 then 'thin' when q >= 0.4 then 'good' else 'weak' end as grade from s")
def research_p12_specialist_quality(spark, d):
    s = _pred(spark, d, "action_key", "y_pred", "y_true").where("y_pred is not null and action_key is not null").groupBy("action_key", "y_pred").agg(F.count("*").alias("n"), F.avg(_hit()).alias("q"))
    return s.select("action_key", "y_pred", "n", F.round("q", 8).alias("quality"), F.when(F.col("n") < 20, "thin").when(F.col("q") >= 0.4, "good").otherwise("weak").alias("grade"))


@query(P + f"select row_id, case when y_pred >= 2 then 'up' when y_pred is not null then 'down' end as by_class, case when {UPP} >= 0.5 then 'up' else 'down' end as by_proba from p where {KNOWN}")
def research_p17_direction_columns(spark, d):
    p = _pred(spark, d, "row_id", "y_pred", *PROBS).dropna(subset=PROBS)
    return p.select("row_id", F.when(F.col("y_pred") >= 2, "up").when(F.col("y_pred").isNotNull(), "down").alias("by_class"), F.when(_up() >= 0.5, "up").otherwise("down").alias("by_proba"))


_SIG = 'sig as (select distinct action_key, asset_id, "timestamp" as ts from p where y_pred = 3 and action_key is not null and asset_id is not null)'


@query(P + f", {_SIG}, n as (select action_key, count(*) as n from sig group by 1), b as (select a.action_key as key_a, b.action_key as key_b, count(*) as n_both from sig a join sig b on a.asset_id = b.asset_id and a.ts = b.ts and a.action_key < b.action_key group by 1, 2) select key_a, key_b, n_both, round(n_both / (x.n + y.n - n_both), 8) as jaccard from b join n x on x.action_key = key_a join n y on y.action_key = key_b")
def research_p23_signal_overlap(spark, d):
    """Jaccard overlap of the signals of two models; models are paired within a bar, where each is listed once."""
    sig = _pred(spark, d, "action_key", "asset_id", "timestamp", "y_pred").where("y_pred = 3 and action_key is not null and asset_id is not null and timestamp is not null").select("action_key", "asset_id", "timestamp").distinct()
    n = sig.groupBy("action_key").agg(F.count("*").alias("n"))
    bar = sig.groupBy("asset_id", "timestamp").agg(F.sort_array(F.collect_list("action_key")).alias("m")).where("size(m) > 1")
    ab = bar.select("m", F.explode("m").alias("key_a")).select("key_a", F.explode(F.filter("m", lambda x: x > F.col("key_a"))).alias("key_b"))
    b = ab.groupBy("key_a", "key_b").agg(F.count("*").alias("n_both"))
    b = b.join(n.select(F.col("action_key").alias("key_a"), F.col("n").alias("na")), "key_a").join(n.select(F.col("action_key").alias("key_b"), F.col("n").alias("nb")), "key_b")
    return b.select("key_a", "key_b", "n_both", F.round(F.col("n_both") / (F.col("na") + F.col("nb") - F.col("n_both")), 8).alias("jaccard"))


@query(BARS + ", f as (select symbol, ts, case when count(ret) over w = 6 then avg(case when ret > 0 then 1.0 else 0.0 end) over w end as up_rate, stddev_samp(ret) over v as vol from x window w as (partition by symbol order by ts rows between 1 following and 6 following), v as (partition by symbol order by ts rows between 20 preceding and current row)) select symbol, ts, round(up_rate, 8) as up_rate, round(vol, 6) as vol, (up_rate >= 0.5)::int as label from f")
def research_p30_regime_table(spark, d):
    w = ordered().rowsBetween(1, 6)
    up = F.when(F.count("ret").over(w) == 6, F.avg(F.when(F.col("ret") > 0, 1.0).otherwise(0.0)).over(w))
    f = _returns(spark, d).select("symbol", "ts", up.alias("up_rate"), F.stddev_samp("ret").over(ordered().rowsBetween(-20, 0)).alias("vol"))
    return f.select("symbol", "ts", F.round("up_rate", 8).alias("up_rate"), F.round("vol", 6).alias("vol"), (F.col("up_rate") >= 0.5).cast("int").alias("label"))


@query(P + f", b as (select pred_batch, max({UPP}) as hi, min({UPP}) as lo from p where {KNOWN} group by 1) select pred_batch, case when hi >= 0.8 and hi - 0.5 >= 0.5 - lo then 'up' when lo <= 0.2 then 'down' else 'none' end as signal from b")
def research_p36_threshold_selection(spark, d):
    b = _pred(spark, d, "pred_batch", *PROBS).dropna(subset=PROBS).withColumn("up", _up()).groupBy("pred_batch").agg(F.max("up").alias("hi"), F.min("up").alias("lo"))
    return b.select("pred_batch", F.when((F.col("hi") >= 0.8) & (F.col("hi") - 0.5 >= 0.5 - F.col("lo")), "up").when(F.col("lo") <= 0.2, "down").otherwise("none").alias("signal"))


@query(P + f", c as (select split_part(action_key, '|', 1) as model, split_part(action_key, '|', 2) as lookback, avg({HIT}) as acc, count(*) as n from p where action_key is not null group by 1, 2) select model, lookback, n, round(acc, 8) as accuracy, rank() over (order by acc desc) as place from c")
def research_p41_run_ranking(spark, d):
    part = lambda i: F.split_part("action_key", F.lit("|"), F.lit(i))
    c = _pred(spark, d, "action_key", "y_true", "y_pred").where("action_key is not null").groupBy(part(1).alias("model"), part(2).alias("lookback")).agg(F.avg(_hit()).alias("acc"), F.count("*").alias("n"))
    return c.select("model", "lookback", "n", F.round("acc", 8).alias("accuracy"), F.rank().over(Window.orderBy(F.desc("acc"))).cast("long").alias("place"))


@query(P + f", s as (select split_part(action_key, '|', 3) as features, action_key, avg({HIT}) as acc, count(*) as n from p where action_key is not null group by 1, 2), k as (select *, row_number() over (partition by features order by acc desc, action_key) as place from s) select features, count(*) as n_combos, round(avg(acc), 8) as mean, max(case when place = 1 then action_key end) as best from k group by 1")
def research_p43_feature_policy(spark, d):
    s = _pred(spark, d, "action_key", "y_true", "y_pred").where("action_key is not null").groupBy("action_key").agg(F.avg(_hit()).alias("acc"))
    g = s.groupBy(F.split_part("action_key", F.lit("|"), F.lit(3)).alias("features"))
    return g.agg(F.count("*").alias("n_combos"), F.round(F.avg("acc"), 8).alias("mean"), F.min_by("action_key", F.struct(-F.col("acc"), "action_key")).alias("best"))


@query(P + f", a as (select asset_id, action_key, avg({HIT}) as acc, count(*) as n from p where asset_id is not null and action_key is not null group by 1, 2) select asset_id, action_key, place from (select *, row_number() over (partition by asset_id order by acc desc, n desc, action_key) as place from a) where place <= 2")
def research_p46_top_keys_per_root(spark, d):
    a = _pred(spark, d, "asset_id", "action_key", "y_true", "y_pred").where("asset_id is not null and action_key is not null").groupBy("asset_id", "action_key").agg(F.avg(_hit()).alias("acc"), F.count("*").alias("n"))
    w = Window.partitionBy("asset_id").orderBy(F.desc("acc"), F.desc("n"), "action_key")
    return a.withColumn("place", F.row_number().over(w).cast("long")).where("place <= 2").select("asset_id", "action_key", "place")


@query(P + f", q as (select asset_id, avg(1 - {HIT}) as noise, count(*) as n from p where asset_id is not null group by 1) select asset_id, round(noise, 8) as noise, (noise <= (select median(noise) from q))::int as keeps from q")
def research_p50_noise_gate(spark, d):
    q = _pred(spark, d, "asset_id", "y_true", "y_pred").where("asset_id is not null").groupBy("asset_id").agg(F.avg(1 - _hit()).alias("noise"))
    return q.select("asset_id", F.round("noise", 8).alias("noise"), (F.col("noise") <= q.agg(F.median("noise")).scalar()).cast("int").alias("keeps"))


@query(BARS + ", p as (select symbol, ret, lag(ret) over (partition by symbol order by ts) as guess from x), k as (select * from p where ret is not null and guess is not null) select symbol, count(*) as n, round(avg(power(ret - guess, 2)), 6) as mse, round(avg(abs(ret - guess)), 6) as mae, round(avg(case when sign(ret) = sign(guess) then 1.0 else 0.0 end), 8) as accuracy, round(corr(ret, guess), 6) as ic from k group by 1")
def research_p52_prediction_metrics(spark, d):
    k = _returns(spark, d).select("symbol", "ret", F.lag("ret").over(Window.partitionBy("symbol").orderBy("ts")).alias("guess")).where("ret is not null and guess is not null")
    e = F.col("ret") - F.col("guess")
    return k.groupBy("symbol").agg(F.count("*").alias("n"), F.round(F.avg(e * e), 6).alias("mse"), F.round(F.avg(F.abs(e)), 6).alias("mae"), F.round(F.avg(F.when(F.signum("ret") == F.signum("guess"), 1.0).otherwise(0.0)), 8).alias("accuracy"), F.round(F.corr("ret", "guess"), 6).alias("ic"))


@query(B + ", c as (select symbol, ts, close, epoch_us(ts) // 28800000000 as b_batch, (epoch_us(ts) - 14400000000) // 28800000000 as c_batch from bars) select symbol, c_batch, count(*) as n, count(distinct b_batch) as n_base, round(avg(close), 9) as mean from c group by 1, 2")
def research_p57_shifted_from_base(spark, d):
    """The shifted family takes its features from the base family by time, re-keyed, and recomputes none."""
    b = source.bars(spark, d).select("symbol", "close", F.floor(micros("ts") / 28_800_000_000).alias("b"), F.floor((micros("ts") - 14_400_000_000) / 28_800_000_000).alias("c_batch"))
    return b.groupBy("symbol", "c_batch").agg(F.count("*").alias("n"), F.count_distinct("b").alias("n_base"), F.round(F.avg("close"), 9).alias("mean"))
