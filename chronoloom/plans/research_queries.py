"""Selectors, online learning, simulations, audits and research-layer reports (H, J, K, L, M, N, O, P), with their SQL."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoloom.functions import folds
from chronoloom.functions.windows import lag, ordered
from chronoloom.operators.quantiles import exact_quantiles
from chronoloom.operators.scan import scan
from chronoloom.plans.metric_queries import _LOSS, _STEPS, BARS, KNOWN, P, PROBS, _loss, _pred, _ratio, _returns, _steps, _yes
from chronoloom.plans.relational_queries import Query
from chronoloom.sources import bars as source
from chronoloom.sources.tables import load, micros

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
HIT = "case when y_true = y_pred then 1.0 else 0.0 end"
UPP = "(prob_class_2 + prob_class_3)"


def query(sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def _hit():
    return F.when(F.col("y_true") == F.col("y_pred"), 1.0).otherwise(0.0)


def _up():
    return F.col("prob_class_2") + F.col("prob_class_3")


# ---- helper models ------------------------------------------------------------------------------------------------------


_EGARCH = np.array([(a, g, b) for g in (-0.2, -0.1, -0.05, 0.0, 0.05) for b in (0.7, 0.8, 0.85, 0.9, 0.95) for a in (0.05, 0.1, 0.15, 0.2)])


def egarch_fit(r: np.ndarray) -> tuple[float, float, float, float, float | None]:
    """omega, alpha, gamma, beta and log-likelihood of the best point of the grid on demeaned returns; all points are scanned at once.

    Fewer than 30 returns, or ones that don't vary, give the default parameters and no likelihood.
    """
    e = r - r.mean() if len(r) else r
    var = float((e * e).mean()) if len(r) else 0.0
    if len(r) < 30 or var <= 1e-10:
        return 0.0, 0.1, -0.1, 0.85, None
    alpha, gamma, beta = _EGARCH.T
    omega, lv, ll = (1 - beta) * math.log(var), np.full(len(_EGARCH), math.log(var)), np.zeros(len(_EGARCH))
    for before, x in zip(e[:-1], e[1:]):
        v = np.where(lv > -20, np.exp(lv), 1e-10)
        shock = np.where(v > 1e-10, before / np.sqrt(v), 0.0)
        lv = np.clip(omega + alpha * (np.abs(shock) - math.sqrt(2 / math.pi)) + gamma * shock + beta * lv, -20, 10)
        ll -= 0.5 * (math.log(2 * math.pi) + lv + x * x / np.exp(lv))
    i = len(ll) - 1 - int(ll[::-1].argmax())
    return float(omega[i]), *map(float, _EGARCH[i]), float(ll[i])


@query()
def h04_egarch_grid(spark, d):
    """Parameters of the best likelihood per symbol among all 100 of the grid."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        _, *best = egarch_fit(pdf.sort_values("ts")["ret"].dropna().to_numpy())
        return pd.DataFrame([(pdf["symbol"].iloc[0], *best)], columns=["symbol", "alpha", "gamma", "beta", "log_likelihood"])

    return _returns(spark, d).select("symbol", "ts", "ret").groupBy("symbol").applyInPandas(fit, "symbol string, alpha double, gamma double, beta double, log_likelihood double")


@query()
def h09_tail_risk_pareto(spark, d):
    """Rolling peaks over threshold: generalised Pareto by probability-weighted moments over the last 200 returns, value at risk at 99 %."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts").reset_index(drop=True)
        r, out = -pdf["ret"].fillna(0).to_numpy(), np.full(len(pdf), np.nan)
        for i in range(200, len(r)):
            w = np.sort(r[i - 200 : i])
            u = w[179]
            x = w[180:] - u
            n, b0 = len(x), x.mean()
            b1 = ((n - 1 - np.arange(n)) / (n - 1) * x).mean()
            xi = 2 - b0 / (b0 - 2 * b1) if b0 != 2 * b1 else 0.0
            scale = 2 * b0 * b1 / (b0 - 2 * b1) if b0 != 2 * b1 else b0
            q = 0.01 / 0.1
            out[i] = u + (scale * math.log(1 / q) if abs(xi) < 1e-6 else scale / xi * (q**-xi - 1))
        return pd.DataFrame({"symbol": pdf["symbol"], "ts": pdf["ts"], "value_at_risk": out})

    return _returns(spark, d).select("symbol", "ts", "ret").groupBy("symbol").applyInPandas(run, "symbol string, ts timestamp_ntz, value_at_risk double").where("value_at_risk is not null and not isnan(value_at_risk)")


@query()
def h11_hidden_states(spark, d):
    """Two-state Gaussian hidden Markov model per symbol: Baum-Welch, then the smoothed probability of the volatile state."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts").reset_index(drop=True)
        x = pdf["ret"].fillna(0).to_numpy()
        sd = x.std() or 1.0
        mu, var, a, pi = np.zeros(2), np.array([0.25, 2.0]) * sd**2, np.array([[0.95, 0.05], [0.05, 0.95]]), np.full(2, 0.5)
        gamma = np.full((len(x), 2), 0.5)
        for _ in range(15):
            like = np.exp(-0.5 * (x[:, None] - mu) ** 2 / var) / np.sqrt(2 * np.pi * var) + 1e-300
            alpha, beta, scale = np.zeros_like(like), np.ones_like(like), np.zeros(len(x))
            for t in range(len(x)):
                alpha[t] = (pi if t == 0 else alpha[t - 1] @ a) * like[t]
                scale[t] = alpha[t].sum()
                alpha[t] /= scale[t]
            for t in range(len(x) - 2, -1, -1):
                beta[t] = a @ (like[t + 1] * beta[t + 1]) / scale[t + 1]
            gamma = alpha * beta
            gamma /= gamma.sum(axis=1, keepdims=True)
            if len(x) < 2:
                break
            xi = (alpha[:-1, :, None] * a * (like[1:] * beta[1:])[:, None, :]) / scale[1:, None, None]
            a = xi.sum(axis=0) / gamma[:-1].sum(axis=0)[:, None]
            pi, weight = gamma[0], gamma.sum(axis=0)
            mu = (gamma * x[:, None]).sum(axis=0) / weight
            var = np.maximum((gamma * (x[:, None] - mu) ** 2).sum(axis=0) / weight, 1e-6)
        wild = int(var.argmax())
        return pd.DataFrame({"symbol": pdf["symbol"], "ts": pdf["ts"], "p_volatile": gamma[:, wild]})

    return _returns(spark, d).select("symbol", "ts", "ret").groupBy("symbol").applyInPandas(run, "symbol string, ts timestamp_ntz, p_volatile double")


@query("with recursive s as (select unnest(range(0, 40)) as i), c as (select i, 100 + i // 10 * 10 as refit_rows from s) select i::bigint as chunk, (100 + i * 10)::bigint as first_row, refit_rows::bigint as fitted_on from c where 100 + i * 10 < 500")
def h14_refit_chunks(spark, d):
    """Walk-forward chunks of 10 rows after 100 warm-up rows, refitted every 10 chunks on all rows up to then."""
    c = spark.range(40).select(F.col("id").alias("chunk"), (100 + F.col("id") * 10).alias("first_row"))
    return c.where("first_row < 500").withColumn("fitted_on", 100 + F.floor(F.col("chunk") / 10) * 10)


@query()
def h14_helper_chunks(spark, d):
    """Every row after 100 warm-up rows of each series, in chunks of 10: volatility by an EGARCH helper refitted every 10 chunks on all rows before.

    The helper goes on from its state at the end of the fitted rows and sees each row only after it has given that row's value.
    """
    warmup, size, every = 100, 10, 100

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts").reset_index(drop=True)
        r, out = pdf["ret"].fillna(0.0).to_numpy(), []
        for start in range(warmup, len(r), every):
            omega, alpha, gamma, beta, _ = egarch_fit(r[:start])
            mean, var = r[:start].mean(), r[:start].var()
            fold, _ = folds.egarch(omega, alpha, gamma, beta)
            state = {"lv": math.log(max(var, 1e-10))}
            for i in range(min(start + every, len(r))):
                state, now = fold(state, {"value": r[i] - mean})
                if i >= start:
                    out.append((pdf["symbol"][i], pdf["ts"][i], (i - warmup) // size, start, now["volatility"], now["shock"]))
        return pd.DataFrame(out, columns=["symbol", "ts", "chunk", "fitted_on", "volatility", "shock"])

    return _returns(spark, d).select("symbol", "ts", "ret").groupBy("symbol").applyInPandas(run, "symbol string, ts timestamp_ntz, chunk long, fitted_on long, volatility double, shock double")


@query(BARS + ", h as (select symbol, ts, avg(ret) over (partition by symbol order by ts rows between 9 preceding and current row) as full, row_number() over (partition by symbol order by ts) as k from x), q as (select * from x qualify row_number() over (partition by symbol order by ts) <= 200), p as (select symbol, ts, avg(ret) over (partition by symbol order by ts rows between 9 preceding and current row) as pre from q) select h.symbol, count(*) as n, round(max(abs(h.full - p.pre)), 9) + 0.0 as worst from h join p on h.symbol = p.symbol and h.ts = p.ts where h.k <= 200 group by 1")
def o13_prefix_causality(spark, d):
    """A causal feature computed on a prefix equals the one computed on the whole series."""
    mean = F.avg("ret").over(ordered().rowsBetween(-9, 0))
    x = _returns(spark, d).select("symbol", "ts", "ret").withColumn("k", F.row_number().over(ordered()))
    whole = x.withColumn("full", mean).where("k <= 200").select("symbol", "ts", "full")
    part = x.where("k <= 200").withColumn("pre", mean).select("symbol", "ts", "pre")
    return whole.join(part, ["symbol", "ts"]).groupBy("symbol").agg(F.count("*").alias("n"), F.round(F.max(F.abs(F.col("full") - F.col("pre"))), 9).alias("worst"))


# ---- normalisation and selection ----------------------------------------------------------------------------------------


@query(BARS + ", v as (select symbol, ts, volume * ret as inter, stddev_samp(ret) over (partition by symbol order by ts rows between 29 preceding and current row) as vol, median(abs(ret)) over (partition by symbol order by ts rows between 29 preceding and current row) as med, ret from x) select symbol, ts, round(case when vol > 1.2 * med then inter else 0 end, 6) + 0.0 as gated from v where inter is not null")
def j04_regime_conditioning(spark, d):
    w = ordered().rowsBetween(-29, 0)
    v = _returns(spark, d).withColumns({"inter": F.col("volume") * F.col("ret"), "vol": F.stddev_samp("ret").over(w), "med": F.percentile(F.abs("ret"), F.lit(0.5)).over(w)}).where("inter is not null")
    return v.select("symbol", "ts", F.round(F.when(F.col("vol") > 1.2 * F.col("med"), F.col("inter")).otherwise(0.0), 6).alias("gated"))


@query(f"with p as (select * from stage1_pred_batch_predictions where {KNOWN}) select 'prob_class_0' as a, 'prob_class_1' as b, round(corr(prob_class_0, prob_class_1), 6) as corr from p union all select 'prob_class_0', 'prob_class_2', round(corr(prob_class_0, prob_class_2), 6) from p union all select 'prob_class_1', 'prob_class_2', round(corr(prob_class_1, prob_class_2), 6) from p")
def j11_correlation_pairs(spark, d):
    p = _pred(spark, d, *PROBS).dropna()
    pairs = [("prob_class_0", "prob_class_1"), ("prob_class_0", "prob_class_2"), ("prob_class_1", "prob_class_2")]
    one = p.agg(*(F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs))
    return one.unpivot([], [f"{a}|{b}" for a, b in pairs], "k", "c").select(F.split("k", "[|]")[0].alias("a"), F.split("k", "[|]")[1].alias("b"), F.round("c", 6).alias("corr"))


@query()
def j12_selected_features(spark, d):
    """Features kept by variance, then ranked by the importance a gradient-boosted model gives them."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VarianceThresholdSelector, VectorAssembler

    p = _pred(spark, d, "y_true", *PROBS).dropna().withColumn("label", (F.col("y_true") >= 2).cast("double"))
    v = VectorAssembler(inputCols=PROBS, outputCol="raw").transform(p)
    chosen = VarianceThresholdSelector(featuresCol="raw", outputCol="features", varianceThreshold=1e-4).fit(v)
    model = GBTClassifier(maxIter=5, maxDepth=3, seed=7).fit(chosen.transform(v))
    return spark.createDataFrame([(PROBS[i], float(model.featureImportances[k])) for k, i in enumerate(chosen.selectedFeatures)], "feature string, importance double")


@query(P + ", b as (select distinct pred_batch from p), n as (select pred_batch, row_number() over (order by pred_batch) - 1 as i from b) select pred_batch, i // 5 as calibrated_at, i % 5 = 0 as recalibrates from n where i >= 5")
def research_p39_selection_schedule(spark, d):
    n = _pred(spark, d, "pred_batch").distinct().withColumn("i", F.row_number().over(Window.orderBy("pred_batch")) - 1).where("i >= 5")
    return n.select("pred_batch", F.floor(F.col("i") / 5).alias("calibrated_at"), (F.col("i") % 5 == 0).alias("recalibrates"))


# ---- metrics ------------------------------------------------------------------------------------------------------------


@query(P + f", s as (select action_key, avg(case when pred_batch % 2 = 0 then {HIT} end) as ins, avg(case when pred_batch % 2 = 1 then {HIT} end) as oos from p group by 1), r as (select *, rank() over (order by oos) / (count(*) over () + 1.0) as q from s where ins is not null and oos is not null) select round(q, 6) as oos_rank, (q < 0.5)::int as overfit from r order by ins desc, action_key limit 1")
def l11_overfitting(spark, d):
    """Rank out of sample of the model that is best in sample, batches split in halves."""
    s = _pred(spark, d, "action_key", "pred_batch", "y_true", "y_pred").groupBy("action_key").agg(F.avg(F.when(F.col("pred_batch") % 2 == 0, _hit())).alias("ins"), F.avg(F.when(F.col("pred_batch") % 2 == 1, _hit())).alias("oos")).where("ins is not null and oos is not null")
    r = s.withColumn("q", F.rank().over(Window.orderBy("oos")) / (F.count("*").over(Window.partitionBy()) + 1.0))  # one row per model
    return r.orderBy(F.desc("ins"), "action_key").limit(1).select(F.round("q", 6).alias("oos_rank"), (F.col("q") < 0.5).cast("int").alias("overfit"))


@query(BARS + "select symbol, count_if(ret > 0) as wins, round(avg(case when ret > 0 then ret end) / -avg(case when ret < 0 then ret end), 6) as payoff, round(sum(case when ret > 0 then ret else 0 end) / -sum(case when ret < 0 then ret else 0 end), 6) as profit_factor from x group by 1")
def l15_trade_metrics(spark, d):
    r = F.col("ret")
    return _returns(spark, d).groupBy("symbol").agg(F.count_if(r > 0).alias("wins"), F.round(F.try_divide(F.avg(F.when(r > 0, r)), -F.avg(F.when(r < 0, r))), 6).alias("payoff"), F.round(F.try_divide(F.sum(F.when(r > 0, r).otherwise(0.0)), -F.sum(F.when(r < 0, r).otherwise(0.0))), 6).alias("profit_factor"))


@query(P + f", {_STEPS}, n as (select *, row_number() over (order by pred_batch) as k from steps), e as (with recursive r as (select pred_batch, k, acc::double as ema, acc::double as slow from n where k = 1 union all select n.pred_batch, n.k, (1 - 2.0 / 21) * r.ema + 2.0 / 21 * n.acc, (1 - 2.0 / 51) * r.slow + 2.0 / 51 * n.acc from r join n on n.k = r.k + 1) select * from r) select pred_batch, round(ema, 8) as ema20, round(slow, 8) as ema50 from e")
def l20_rolling_metric_state(spark, d):
    def fold(s, row):
        e = [row["acc"] if s is None else (1 - 2 / (n + 1)) * before + 2 / (n + 1) * row["acc"] for n, before in zip((20, 50), s or (0, 0), strict=True)]
        return e, {"ema20": e[0], "ema50": e[1]}

    s = scan(_steps(spark, d).withColumn("all", F.lit(0)), ["all"], "pred_batch", fold, lambda: None, "ema20 double, ema50 double")
    return s.select("pred_batch", F.round("ema20", 8).alias("ema20"), F.round("ema50", 8).alias("ema50"))


@query(BARS + ", p as (select symbol, ts, ret, sign(lag(ret) over (partition by symbol order by ts)) as pos from x), c as (select symbol, ts, pos * ret - 0.001 * abs(pos - coalesce(lag(pos) over (partition by symbol order by ts), 0)) as net from p where pos is not null) select symbol, round(avg(net), 8) as mean_net, round(avg(net) / nullif(stddev_pop(net), 0) * sqrt(1095), 6) as sharpe from c group by 1")
def l21_economic_metrics(spark, d):
    w = Window.partitionBy("symbol").orderBy("ts")
    p = _returns(spark, d).withColumn("pos", F.signum(F.lag("ret").over(w))).where("pos is not null")
    net = F.col("pos") * F.col("ret") - 0.001 * F.abs(F.col("pos") - F.coalesce(F.lag("pos").over(w), F.lit(0.0)))
    return p.select("symbol", net.alias("net")).groupBy("symbol").agg(F.round(F.avg("net"), 8).alias("mean_net"), F.round(F.try_divide(F.avg("net"), F.nullif(F.stddev_pop("net"), F.lit(0.0))) * 1095**0.5, 6).alias("sharpe"))


@query(f"with m as (select target_4class, avg(bb_position_pct) as mu, stddev_samp(bb_position_pct) as sd from label_bars where bb_position_pct is not null group by 1) select l.row_id, round(abs(l.bb_position_pct - mu) / nullif(sd, 0), 6) as distance from label_bars l join m on l.target_4class = m.target_4class where l.bb_position_pct is not null")
def l24_class_outlier_distance(spark, d):
    l = load(spark, d, "label_bars", "row_id", "target_4class", "bb_position_pct").where("bb_position_pct is not null")  # noqa: E741
    m = l.groupBy("target_4class").agg(F.avg("bb_position_pct").alias("mu"), F.stddev_samp("bb_position_pct").alias("sd"))
    return l.join(m, "target_4class").select("row_id", F.round(F.try_divide(F.abs(F.col("bb_position_pct") - F.col("mu")), F.nullif(F.col("sd"), F.lit(0.0))), 6).alias("distance"))


@query()
def l26_block_bootstrap(spark, d):
    """Confidence interval of accuracy by resampling whole batches: a Poisson weight per batch and replicate, drawn from a hash."""
    steps = _pred(spark, d, "pred_batch", "y_true", "y_pred").groupBy("pred_batch").agg(F.sum(_hit()).alias("hits"), F.count("*").alias("n"))
    reps = steps.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(199))))
    u = F.pmod(F.xxhash64("rep", "pred_batch"), F.lit(2**31)) / F.lit(float(2**31))
    cum, weight = 0.0, F.lit(8)
    steps_cdf = []
    for k in range(8):
        cum += math.exp(-1) / math.factorial(k)
        steps_cdf.append((cum, k))
    for cut, k in reversed(steps_cdf):
        weight = F.when(u < cut, k).otherwise(weight)
    acc = reps.withColumn("w", weight).groupBy("rep").agg(F.try_divide(F.sum(F.col("w") * F.col("hits")), F.sum(F.col("w") * F.col("n"))).alias("acc"))
    return acc.agg(F.percentile("acc", F.lit(0.025)).alias("low"), F.percentile("acc", F.lit(0.975)).alias("high"), F.avg("acc").alias("mean"))


@query(P + ", c as (select action_key, sum(case when y_true = y_pred then 0 when (y_true >= 2) <> (y_pred >= 2) then 5 else 1 end)::bigint as cost, count(*) as n from p group by 1) select action_key, cost, round(cost / n, 8) as mean_cost from c")
def l27_custom_cost(spark, d):
    cost = F.when(F.col("y_true") == F.col("y_pred"), 0).when((F.col("y_true") >= 2) != (F.col("y_pred") >= 2), 5).otherwise(1)
    c = _pred(spark, d, "action_key", "y_true", "y_pred").groupBy("action_key").agg(F.sum(cost).alias("cost"), F.count("*").alias("n"))
    return c.select("action_key", "cost", F.round(F.col("cost") / F.col("n"), 8).alias("mean_cost"))


@query(P + f", k as (select action_key, avg({HIT}) as acc from p group by 1 order by 2 desc, 1 limit 4), m as (select action_key, acc, row_number() over (order by acc desc, action_key) - 1 as bit from k), s as (select unnest(range(1, 16)) as mask) select mask::bigint as mask, count(*) as size, round(max(acc), 8) as oracle, round(avg(acc), 8) as mean from s join m on (mask >> bit) & 1 = 1 group by 1")
def l31_subset_enumeration(spark, d):
    k = _pred(spark, d, "action_key", "y_true", "y_pred").groupBy("action_key").agg(F.avg(_hit()).alias("acc")).orderBy(F.desc("acc"), "action_key").limit(4)
    m = k.withColumn("bit", F.row_number().over(Window.orderBy(F.desc("acc"), "action_key")) - 1)  # four rows
    s = m.withColumn("mask", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(15).cast("long")))).where(F.expr("(shiftright(mask, bit) & 1) = 1"))
    return s.groupBy("mask").agg(F.count("*").alias("size"), F.round(F.max("acc"), 8).alias("oracle"), F.round(F.avg("acc"), 8).alias("mean"))


_SIDE = "(y_true >= 2) <> (y_pred >= 2)"
_F1 = [f"2.0 * count_if(y_true = {k} and y_pred = {k}) / nullif(count_if(y_true = {k}) + count_if(y_pred = {k}), 0)" for k in range(4)]
_SUBSET_MEANS = {"mean_dir_acc": "1.0 - cde", "mean_acc": "acc", "mean_macro_f1": "f1", "mean_rank": "rank", "top1_rate": "case when rank = 1 then 1.0 else 0.0 end", "top2_rate": "case when rank <= 2 then 1.0 else 0.0 end"}
_SUBSET_COLS = ", ".join(f"count_if({own}) as {part}_steps, " + ", ".join(f"round(avg(case when {own} then {x} end), 8) as {part}_{n}" for n, x in _SUBSET_MEANS.items()) for part, own in (("train", "in_train"), ("test", "not in_train")))
_SUBSET_F1 = f"({' + '.join(f'coalesce({x}, 0)' for x in _F1)}) / ({' + '.join(f'case when {x} is null then 0 else 1 end' for x in _F1)})"


@query(P + f""", m as (select pred_batch, action_key, avg({HIT}) as acc, avg(case when {_SIDE} then 1.0 else 0.0 end) as cde, {_SUBSET_F1} as f1 from p where pred_batch is not null and action_key is not null and y_true is not null and y_pred is not null group by 1, 2),
r as (select *, row_number() over (partition by pred_batch order by round(acc, 12) desc, round(f1, 12) desc, round(cde, 12), action_key) as rank, dense_rank() over (order by action_key) - 1 as bit, dense_rank() over (order by pred_batch) - 1 as i from m),
b as (select *, i < greatest(1, least((select max(i) from r), floor(0.7::double * (select max(i) + 1 from r)))) as in_train from r),
s as (select unnest(range(1, 1::bigint << (select (max(bit) + 1)::int from r))) as mask),
c as (select * from s join b on (s.mask >> b.bit) & 1 = 1 qualify row_number() over (partition by mask, pred_batch order by rank) = 1)
select mask::bigint as mask, bit_count(mask::bigint)::bigint as size, {_SUBSET_COLS} from c group by 1, 2""")
def l31_every_subset(spark, d):
    """Every non-empty set of models (bits of ``mask`` by action_key): its best model of each batch, averaged over the first 70 % of batches and the rest.

    A batch's models are ranked once, by accuracy, macro F1, wrong sides and name; a set takes the first that it holds.
    """
    p = _pred(spark, d, "pred_batch", "action_key", "y_true", "y_pred").dropna()
    m = p.groupBy("pred_batch", "action_key").agg(F.avg(_hit()).alias("acc"), F.expr(f"avg(case when {_SIDE} then 1.0D else 0.0D end)").alias("cde"), F.expr(_SUBSET_F1).cast("double").alias("f1"))
    r = m.withColumns({"rank": F.row_number().over(Window.partitionBy("pred_batch").orderBy(F.desc(F.round("acc", 12)), F.desc(F.round("f1", 12)), F.round("cde", 12), "action_key")), "bit": F.dense_rank().over(Window.orderBy("action_key")) - 1})  # one row per batch and model
    models = p.select("action_key").distinct().count()
    b = r.groupBy("pred_batch").agg(F.array_sort(F.collect_list(F.struct("rank", "bit", "acc", "cde", "f1"))).alias("ranked"))
    b = b.withColumns({"i": F.row_number().over(Window.orderBy("pred_batch")) - 1, "n": F.count("*").over(Window.partitionBy())})
    b = b.withColumn("in_train", F.col("i") < F.greatest(F.lit(1), F.least(F.col("n") - 1, F.floor(F.col("n") * 0.7))))
    s = spark.range(1, 2**models).withColumnRenamed("id", "mask")
    c = s.crossJoin(F.broadcast(b)).select("mask", "in_train", F.expr("get(filter(ranked, x -> (shiftright(mask, x.bit) & 1) = 1), 0)").alias("c")).where("c is not null").select("mask", "in_train", "c.*")
    means = [x for part, own in (("train", "in_train"), ("test", "not in_train")) for x in (F.expr(f"count_if({own})").alias(f"{part}_steps"), *(F.round(F.expr(f"avg(cast(case when {own} then {e} end as double))"), 8).alias(f"{part}_{n}") for n, e in _SUBSET_MEANS.items()))]
    return c.groupBy("mask", F.bit_count("mask").cast("long").alias("size")).agg(*means)


# ---- selectors and online learning --------------------------------------------------------------------------------------


@query(P + f", {_LOSS}, g as (select a.pred_batch, a.action_key, sum(power(0.9, a.pred_batch - b.pred_batch) * b.loss) / sum(power(0.9, a.pred_batch - b.pred_batch)) as score, count(*) as n from loss a join loss b on a.action_key = b.action_key and b.pred_batch < a.pred_batch group by 1, 2) select pred_batch, arg_min(action_key, (score, action_key)) as chosen from g where n >= 3 group by 1")
def m04_discounted_selector(spark, d):
    """The discounted past loss is a ratio of two recursions; here as sums over one row per batch and model."""
    past = Window.partitionBy("action_key").orderBy("pred_batch").rowsBetween(Window.unboundedPreceding, -1)
    hist = _loss(spark, d).withColumn("h", F.collect_list(F.struct("pred_batch", "loss")).over(past))
    w = lambda x: F.pow(F.lit(0.9), F.col("pred_batch") - x["pred_batch"])
    num = F.aggregate("h", F.lit(0.0), lambda s, x: s + w(x) * x["loss"])
    den = F.aggregate("h", F.lit(0.0), lambda s, x: s + w(x))
    g = hist.where("size(h) >= 3").select("pred_batch", "action_key", (num / den).alias("score"))
    return g.groupBy("pred_batch").agg(F.min_by("action_key", F.struct(F.round("score", 12), "action_key")).alias("chosen"))


@query(P + f", {_STEPS}, n as (select *, row_number() over (order by pred_batch) - 1 as i from steps), w as (select i as start from n where i % 5 = 0 and i + 10 <= (select count(*) from n)) select start, round(avg(acc), 8) as mean, round(min(acc), 8) as worst from w join n on n.i >= start and n.i < start + 10 group by 1")
def m06_audit_windows(spark, d):
    n = _steps(spark, d).withColumns({"i": F.row_number().over(Window.orderBy("pred_batch")) - 1, "n": F.count("*").over(Window.partitionBy())})
    starts = n.withColumn("start", F.explode(F.sequence(F.col("i") - 9, F.col("i")))).where("start >= 0 and start % 5 = 0 and start + 10 <= n")
    return starts.groupBy(F.col("start").cast("long").alias("start")).agg(F.round(F.avg("acc"), 8).alias("mean"), F.round(F.min("acc"), 8).alias("worst"))


@query()
def m07_diverse_subset(spark, d):
    """Greedy subset of models by accuracy and mean disagreement with those chosen; the matrix of models is small and fixed."""
    from chronoloom.plans.metric_queries import l29_pairwise_agreement

    acc = {r[0]: r[1] for r in _pred(spark, d, "action_key", "y_true", "y_pred").where("action_key is not null").groupBy("action_key").agg(F.avg(_hit())).collect()}
    dis = {frozenset((r.key_a, r.key_b)): 1 - r.agreement for r in l29_pairwise_agreement(spark, d).collect()}
    chosen: list[str] = []
    while len(chosen) < min(4, len(acc)):
        gain = {k: 0.6 * acc[k] + 0.4 * (sum(dis.get(frozenset((k, c)), 0.0) for c in chosen) / len(chosen) if chosen else 0.0) for k in acc if k not in chosen}
        chosen.append(max(sorted(gain), key=gain.__getitem__))
    return spark.createDataFrame([(i, k) for i, k in enumerate(chosen)], "place int, action_key string")


@query()
def m09_regime_router(spark, d):
    """Regimes by k-means on scaled bar features, and the best model of each."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    p = _pred(spark, d, "action_key", "y_true", "y_pred", *PROBS).dropna()
    v = VectorAssembler(inputCols=PROBS, outputCol="raw").transform(p)
    v = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(v).transform(v)
    v = KMeans(k=3, seed=11).fit(v).transform(v)
    g = v.groupBy("prediction", "action_key").agg(F.avg(_hit()).alias("acc"), F.count("*").alias("n"))
    return g.groupBy("prediction").agg(F.max_by("action_key", F.struct("acc", "n", "action_key")).alias("specialist"), F.sum("n").alias("n"))


@query()
def m10_stacking(spark, d):
    """Logistic meta model on the probabilities, fitted on valid, measured on test."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    p = _pred(spark, d, "stage_split", "y_true", *PROBS).dropna().where("y_true between 0 and 3").withColumn("label", F.col("y_true").cast("double"))
    v = VectorAssembler(inputCols=PROBS, outputCol="features").transform(p)
    model = LogisticRegression(maxIter=20, regParam=0.01).fit(v.where("stage_split = 'valid'"))
    scored = model.transform(v.where("stage_split = 'test'"))
    return scored.agg(F.count("*").alias("n"), F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"))


@query()
def m12_multiplicative_weights(spark, d):
    """Weights of four models, multiplied by exp(rate * (accuracy - mean)) per batch and floored."""
    acc = _loss(spark, d).withColumn("k", F.split_part("action_key", F.lit("|"), F.lit(1))).groupBy("pred_batch", "k").agg((1 - F.avg("loss")).alias("acc"))
    keys = [r[0] for r in acc.select("k").distinct().orderBy("k").collect()]
    wide = acc.groupBy("pred_batch").pivot("k", keys).agg(F.first("acc")).select(F.lit(0).alias("all"), "pred_batch", F.array(*(F.coalesce(F.col(f"`{k}`"), F.lit(0.25)) for k in keys)).alias("a"))

    def fold(w, row):
        a = list(row["a"])
        w = w or [1 / len(a)] * len(a)
        new = [max(0.05, x * math.exp(0.5 * (y - sum(a) / len(a)))) for x, y in zip(w, a, strict=True)]
        return [x / sum(new) for x in new], {"weights": w}

    return scan(wide, ["all"], "pred_batch", fold, lambda: None, "weights array<double>").select("pred_batch", "weights")


@query(P + ", b as (select asset_id, time_bucket(interval 15 minutes, \"timestamp\") as anchor, action_key, arg_max(y_pred, (\"timestamp\", row_id)) as y_pred from p where asset_id is not null group by all) select asset_id, anchor, count(*) as n_models, count_if(y_pred >= 2) as n_up from b group by 1, 2")
def m13_anchor_alignment(spark, d):
    b = _pred(spark, d, "asset_id", "timestamp", "action_key", "row_id", "y_pred").where("asset_id is not null and timestamp is not null").groupBy("asset_id", F.window("timestamp", "15 minutes").alias("w"), "action_key").agg(F.max_by("y_pred", F.struct("timestamp", "row_id")).alias("y_pred"))
    return b.groupBy("asset_id", F.col("w.start").alias("anchor")).agg(F.count("*").alias("n_models"), F.count_if(F.col("y_pred") >= 2).alias("n_up"))


@query(P + f", {_STEPS}, n as (select *, row_number() over (order by pred_batch) as k from steps), r as (with recursive r as (select pred_batch, k, 0.5 + (0.01 + 1.0) / (0.01 + 1.0 + 0.1) * (acc - 0.5) as x, (1 - (0.01 + 1.0) / (0.01 + 1.0 + 0.1)) * (0.01 + 1.0) as v from n where k = 1 union all select n.pred_batch, n.k, r.x + (r.v + 0.01) / (r.v + 0.01 + 0.1) * (n.acc - r.x), (1 - (r.v + 0.01) / (r.v + 0.01 + 0.1)) * (r.v + 0.01) from r join n on n.k = r.k + 1) select * from r) select pred_batch, round(x, 6) as estimate from r")
def m14_kalman_weight(spark, d):
    def fold(s, row):
        x, v = s
        v += 0.01
        k = v / (v + 0.1)
        x += k * (row["acc"] - x)
        return (x, (1 - k) * v), {"estimate": x}

    s = scan(_steps(spark, d).withColumn("all", F.lit(0)), ["all"], "pred_batch", fold, lambda: (0.5, 1.0), "estimate double")
    return s.select("pred_batch", F.round("estimate", 6).alias("estimate"))


@query()
def m16_activation_gate(spark, d):
    """A batch is active if its mean confidence reaches the 70 % quantile of the accepted confidences of the last 10 active batches."""
    conf = _pred(spark, d, "pred_batch", *PROBS).dropna().groupBy("pred_batch").agg(F.avg(F.greatest(*PROBS)).alias("conf")).withColumn("all", F.lit(0))

    def fold(h, row):
        ok = len(h) < 3 or row["conf"] >= float(np.quantile(h, 0.7))
        return ([*h, row["conf"]][-10:] if ok else h), {"active": int(ok)}

    return scan(conf, ["all"], "pred_batch", fold, list, "active int").select("pred_batch", "active")


@query(P + f", g as (select action_key, avg({HIT}) as m, count(*) as n from p group by 1) select action_key, round(greatest(m - sqrt(ln(1 / 0.05) / (2 * n)), 0), 8) as lower, round(least(m + sqrt(ln(1 / 0.05) / (2 * n)), 1), 8) as upper from g")
def m17_hoeffding_bounds(spark, d):
    g = _pred(spark, d, "action_key", "y_true", "y_pred").groupBy("action_key").agg(F.avg(_hit()).alias("m"), F.count("*").alias("n"))
    half = F.sqrt(math.log(1 / 0.05) / (2 * F.col("n")))
    return g.select("action_key", F.round(F.greatest(F.col("m") - half, F.lit(0.0)), 8).alias("lower"), F.round(F.least(F.col("m") + half, F.lit(1.0)), 8).alias("upper"))


# ---- conformal and strategy ---------------------------------------------------------------------------------------------


@query(BARS + ", q as (select symbol, ts, close, quantile_cont(close, 0.1) over w as lo, quantile_cont(close, 0.9) over w as hi, count(*) over w as n from x window w as (partition by symbol order by ts rows between 60 preceding and 1 preceding)), s as (select *, greatest(lo - close, close - hi) as score from q where n = 60), c as (select symbol, quantile_cont(score, 0.9) as widen from s where ts < '2024-01-20' group by 1) select s.symbol, round(c.widen, 6) as widen, round(avg(case when close >= lo - widen and close <= hi + widen then 1.0 else 0.0 end), 8) as coverage from s join c on s.symbol = c.symbol where ts >= '2024-01-20' group by 1, c.widen")
def n02_conformalised_quantiles(spark, d):
    w = ordered().rowsBetween(-60, -1)
    q = _returns(spark, d).select("symbol", "ts", "close", F.percentile("close", F.array(F.lit(0.1), F.lit(0.9))).over(w).alias("q"), F.count("*").over(w).alias("n")).where("n = 60")
    s = q.withColumn("score", F.greatest(F.col("q")[0] - F.col("close"), F.col("close") - F.col("q")[1]))
    split = F.lit("2024-01-20").cast("timestamp_ntz")
    c = s.where(F.col("ts") < split).groupBy("symbol").agg(F.percentile("score", F.lit(0.9)).alias("widen"))
    inside = (F.col("close") >= F.col("q")[0] - F.col("widen")) & (F.col("close") <= F.col("q")[1] + F.col("widen"))
    return s.where(F.col("ts") >= split).join(c, "symbol").groupBy("symbol", F.round("widen", 6).alias("widen")).agg(F.round(F.avg(F.when(inside, 1.0).otherwise(0.0)), 8).alias("coverage"))


@query(BARS + ", v as (select symbol, ts, close, ret, stddev_samp(ret) over (partition by symbol order by ts rows between 20 preceding and current row) as vol, lead(close, 8) over (partition by symbol order by ts) as later from x), s as (select *, case when vol < 1.2 and ret > 0.1 then 1 when vol < 1.2 and ret < -0.1 then -1 else 0 end as signal from v where vol is not null) select symbol, signal, count(*) as n, round(avg(signal * (later / close - 1)), 6) + 0.0 as mean_pnl from s where later is not null group by 1, 2")
def n05_regime_filtered_signal(spark, d):
    w = Window.partitionBy("symbol").orderBy("ts")
    v = _returns(spark, d).withColumns({"vol": F.stddev_samp("ret").over(w.rowsBetween(-20, 0)), "later": F.lead("close", 8).over(w)}).where("vol is not null and later is not null")
    calm, r = F.col("vol") < 1.2, F.col("ret")
    s = v.withColumn("signal", F.when(calm & (r > 0.1), 1).when(calm & (r < -0.1), -1).otherwise(0))
    return s.groupBy("symbol", "signal").agg(F.count("*").alias("n"), F.round(F.avg(F.col("signal") * (F.col("later") / F.col("close") - 1)), 6).alias("mean_pnl"))


def trailing_exit(stop: float, limit: int):
    """Enter long at any bar while flat; leave when close falls ``stop`` below its peak or after ``limit`` bars."""

    def fold(s, row):
        c = row["close"]
        if s is None:
            return {"entry": c, "peak": c, "age": 0}, {"event": "enter", "pnl": None}
        peak, age = max(s["peak"], c), s["age"] + 1
        if c <= peak * (1 - stop) or age >= limit:
            return None, {"event": "stop" if c <= peak * (1 - stop) else "time", "pnl": c / s["entry"] - 1}
        return s | {"peak": peak, "age": age}, {"event": "hold", "pnl": None}

    return fold


@query()
def n06_exit_barriers(spark, d):
    b = _returns(spark, d).select("symbol", "ts", "close")
    return scan(b, ["symbol"], "ts", trailing_exit(0.3, 12), lambda: None, "event string, pnl double").select("symbol", "ts", "event", "pnl")


def barrier_exit(stop: float, take: float, trail: float, limit: int):
    """Enter long while flat; leave at ``stop`` ranges below or ``take`` ranges above the entry, ``trail`` ranges below the peak, or after ``limit`` bars.

    A range is the average true range at the entry; a bar that meets both barriers counts as stopped.
    """

    def fold(s, row):
        c, lo, hi, atr = row["close"], row["low"], row["high"], row["atr"]
        if s is None:
            return ({"entry": c, "atr": atr, "peak": c, "age": 0} if atr == atr and atr is not None else None), {"event": "enter" if atr == atr and atr is not None else "wait", "pnl": None}
        floor = max(s["entry"] - stop * s["atr"], s["peak"] - trail * s["atr"])
        roof, age, peak = s["entry"] + take * s["atr"], s["age"] + 1, max(s["peak"], hi)
        if lo <= floor:
            return None, {"event": "stop" if floor == s["entry"] - stop * s["atr"] else "trail", "pnl": floor / s["entry"] - 1}
        if hi >= roof:
            return None, {"event": "take", "pnl": roof / s["entry"] - 1}
        if age >= limit:
            return None, {"event": "time", "pnl": c / s["entry"] - 1}
        return s | {"peak": peak, "age": age}, {"event": "hold", "pnl": None}

    return fold


@query()
def n06_atr_exits(spark, d):
    b = source.bars(spark, d)
    w = Window.partitionBy("symbol").orderBy("ts")
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.lag("close").over(w)), F.abs(F.col("low") - F.lag("close").over(w)))
    rows = b.withColumn("tr", tr).withColumn("atr", F.when(F.count("tr").over(w.rowsBetween(-13, 0)) == 14, F.avg("tr").over(w.rowsBetween(-13, 0)))).select("symbol", "ts", "high", "low", "close", "atr")
    return scan(rows, ["symbol"], "ts", barrier_exit(1.0, 1.5, 1.2, 12), lambda: None, "event string, pnl double").select("symbol", "ts", "event", "pnl")


def risk_manager(drawdown: float, resume: float, daily_loss: float):
    """Trading stops for the rest of a day once its loss passes ``daily_loss``, and while the drawdown is beyond ``drawdown`` until it is below ``resume``."""

    def fold(s, row):
        r = row["ret"]
        r, day = (0.0 if r is None or r != r else r), str(row["day"])
        today = r + (s["today"] if s["day"] == day else 0.0)
        shadow = s["shadow"] + r
        peak = max(s["peak"], shadow)
        calm = peak - shadow < (drawdown if s["calm"] else resume)
        active = s["calm"] and not (s["day"] == day and s["today"] <= -daily_loss)
        return {"day": day, "today": today, "shadow": shadow, "peak": peak, "calm": calm, "equity": s["equity"] + (r if active else 0.0)}, {"equity": s["equity"] + (r if active else 0.0), "trading": int(active)}

    return fold, lambda: {"day": "", "today": 0.0, "shadow": 0.0, "peak": 0.0, "calm": True, "equity": 0.0}


@query()
def n09_risk_manager(spark, d):
    fold, start = risk_manager(2.0, 1.0, 0.5)
    rows = _returns(spark, d).select("symbol", "ts", "ret", F.to_date("ts").alias("day"))
    return scan(rows, ["symbol"], "ts", fold, start, "equity double, trading int").select("symbol", "ts", "equity", "trading")


@query(BARS + ", v as (select symbol, stddev_samp(ret) as vol from x group by 1) select symbol, round(least(greatest(0.02 / vol, 0.1), 10), 6) as leverage, round(1 - 1 / least(greatest(0.02 / vol, 0.1), 10), 6) as liquidation_move from v")
def n07_safe_leverage(spark, d):
    lev = F.least(F.greatest(0.02 / F.stddev_samp("ret"), F.lit(0.1)), F.lit(10.0))
    return _returns(spark, d).groupBy("symbol").agg(F.round(lev, 6).alias("leverage"), F.round(1 - 1 / lev, 6).alias("liquidation_move"))


def drawdown_guard(limit: float, resume: float):
    """Trading stops once the drawdown passes ``limit`` and resumes below ``resume``."""

    def fold(s, row):
        r = row["ret"]
        r = 0.0 if r is None or r != r else r
        equity = s["equity"] + (r if s["on"] else 0.0)
        shadow = s["shadow"] + r
        peak = max(s["peak"], shadow)
        dd = peak - shadow
        on = dd < limit if s["on"] else dd < resume
        return {"equity": equity, "shadow": shadow, "peak": peak, "on": on}, {"equity": equity, "trading": int(on)}

    return fold, lambda: {"equity": 0.0, "shadow": 0.0, "peak": 0.0, "on": True}


@query()
def n09_drawdown_guard(spark, d):
    fold, start = drawdown_guard(2.0, 1.0)
    return scan(_returns(spark, d).select("symbol", "ts", "ret"), ["symbol"], "ts", fold, start, "equity double, trading int").select("symbol", "ts", "equity", "trading")


@query()
def n10_parameter_sweep(spark, d):
    """The simulator over a grid of stops and holding limits: every (symbol, setting) is a group of its own."""
    grid = F.array(*(F.struct(F.lit(s).alias("stop"), F.lit(n).alias("hold")) for s in (0.1, 0.2, 0.4) for n in (6, 12, 24)))
    b = _returns(spark, d).select("symbol", "ts", "close").withColumn("g", F.explode(grid)).select("symbol", "ts", "close", "g.stop", "g.hold")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        fold, s, pnl = trailing_exit(key[1], key[2]), None, []
        for c in pdf.sort_values("ts")["close"]:
            s, out = fold(s, {"close": c})
            if out["pnl"] is not None:
                pnl.append(out["pnl"])
        return pd.DataFrame([(*key, len(pnl), float(np.sum(pnl)))], columns=["symbol", "stop", "hold", "n_trades", "total"])

    return b.groupBy("symbol", "stop", "hold").applyInPandas(run, "symbol string, stop double, hold int, n_trades long, total double")


@query(BARS + ", s as (select symbol, ts, ret, sign(lag(ret) over (partition by symbol order by ts)) as dir, 1 / nullif(stddev_samp(ret) over (partition by symbol order by ts rows between 21 preceding and 1 preceding), 0) as inv from x) select symbol, round(sum(dir * ret), 4) as fixed, round(sum(dir * ret * least(inv, 2)), 4) as by_volatility from s where dir is not null and inv is not null group by 1")
def n11_sizing_comparison(spark, d):
    w = Window.partitionBy("symbol").orderBy("ts")
    s = _returns(spark, d).withColumns({"dir": F.signum(F.lag("ret").over(w)), "inv": F.try_divide(F.lit(1.0), F.nullif(F.stddev_samp("ret").over(w.rowsBetween(-21, -1)), F.lit(0.0)))}).where("dir is not null and inv is not null")
    return s.groupBy("symbol").agg(F.round(F.sum(F.col("dir") * F.col("ret")), 4).alias("fixed"), F.round(F.sum(F.col("dir") * F.col("ret") * F.least("inv", F.lit(2.0))), 4).alias("by_volatility"))


@query(P + f", c as (select asset_id, \"timestamp\", avg({UPP}) as up, count(*) as n from p where {KNOWN} group by all) select asset_id, \"timestamp\", case when up > 0.6 then 'long' when up < 0.4 then 'short' else 'flat' end as side, round(least(abs(up - 0.5) * 4, 1), 9) as size from c")
def n12_consensus_sizing(spark, d):
    c = _pred(spark, d, "asset_id", "timestamp", *PROBS).dropna(subset=PROBS).groupBy("asset_id", "timestamp").agg(F.avg(_up()).alias("up"))
    up = F.col("up")
    return c.select("asset_id", "timestamp", F.when(up > 0.6, "long").when(up < 0.4, "short").otherwise("flat").alias("side"), F.round(F.least(F.abs(up - 0.5) * 4, F.lit(1.0)), 9).alias("size"))


# ---- audits -------------------------------------------------------------------------------------------------------------


@query('with g as (select asset_id, "timestamp" as ts, lag("timestamp") over (partition by asset_id order by "timestamp", row_id) as p from label_bars where asset_id is not null) select asset_id, p as gap_start, ts as gap_end from g where ts - p > interval 2 day')
def o04_gaps(spark, d):
    from chronoloom.operators.blocks import previous

    l = load(spark, d, "label_bars", "asset_id", "timestamp", "row_id").where("asset_id is not null and timestamp is not null").withColumn("at", micros("timestamp")).withColumn("block", F.floor(F.col("at") / F.lit(30 * 86_400_000_000)))  # noqa: E741
    g = previous(l, ["asset_id"], ["at", "row_id"], "block", ["at", "timestamp"], "p")
    return g.where(F.col("at") - F.col("p.at") > 2 * 86_400_000_000).select("asset_id", F.col("p.timestamp").alias("gap_start"), F.col("timestamp").alias("gap_end"))


@query('select file_id, count(*) as n_rows, min("timestamp") as first_ts, max("timestamp") as last_ts, count(*) - count(distinct "timestamp") as n_repeated from feature_batches group by 1')
def o05_file_integrity(spark, d):
    per = load(spark, d, "feature_batches", "file_id", "timestamp").groupBy("file_id", "timestamp").agg(F.count("*").alias("n"))
    return per.groupBy("file_id").agg(F.sum("n").alias("n_rows"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"), (F.sum("n") - F.count("timestamp")).alias("n_repeated"))


@query("select 'files_without_rows' as rule, count(*) as n from batch_files b where not exists (select 1 from feature_batches f where f.file_id = b.file_id) union all select 'stale_counts', count(*) from batch_files b join (select file_id, count(*) as n from feature_batches group by 1) f on f.file_id = b.file_id where b.n_rows is not null and b.n_rows <> f.n union all select 'unknown_files', count(*) from feature_batches f where not exists (select 1 from batch_files b where b.file_id = f.file_id)")
def o07_assertion_table(spark, d):
    files, rows = load(spark, d, "batch_files", "file_id", "n_rows"), load(spark, d, "feature_batches", "file_id")
    counts = rows.groupBy("file_id").agg(F.count("*").alias("n"))
    checks = {"files_without_rows": files.join(counts, "file_id", "left_anti"), "stale_counts": files.join(counts, "file_id").where("n_rows is not null and n_rows <> n"), "unknown_files": rows.join(files, "file_id", "left_anti")}
    parts = [df.agg(F.lit(name).alias("rule"), F.count("*").alias("n")) for name, df in checks.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(BARS + ", l as (select symbol, ret, lag(ret) over (partition by symbol order by ts) as past, lead(ret) over (partition by symbol order by ts) as next from x), c as (select * from l where past is not null and next is not null) select symbol, round(corr(ret, past), 6) as corr_past, round(corr(ret, next), 6) as corr_next, (abs(corr(ret, next)) > abs(corr(ret, past)) + 0.1)::int as suspicious from c group by 1")
def o10_lookahead_check(spark, d):
    w = Window.partitionBy("symbol").orderBy("ts")
    c = _returns(spark, d).select("symbol", "ret", F.lag("ret").over(w).alias("past"), F.lead("ret").over(w).alias("next")).where("past is not null and next is not null")
    return c.groupBy("symbol").agg(F.round(F.corr("ret", "past"), 6).alias("corr_past"), F.round(F.corr("ret", "next"), 6).alias("corr_next"), (F.abs(F.corr("ret", "next")) > F.abs(F.corr("ret", "past")) + 0.1).cast("int").alias("suspicious"))


@query("select 'close' as name, (min(close) > 0)::int as positive, (stddev_samp(close) > 0)::int as varies, (count(close) > 0.5 * count(*))::int as known from feature_batches where close is null or not isnan(close) union all select 'bar_in_batch_norm', (min(bar_in_batch_norm) > 0)::int, (stddev_samp(bar_in_batch_norm) > 0)::int, (count(bar_in_batch_norm) > 0.5 * count(*))::int from feature_batches")
def o11_feature_expectations(spark, d):
    f = load(spark, d, "feature_batches", "close", "bar_in_batch_norm")
    one = f.agg(*(F.struct((F.min(c) > 0).cast("int").alias("positive"), (F.stddev_samp(c) > 0).cast("int").alias("varies"), (F.count(c) > 0.5 * F.count("*")).cast("int").alias("known")).alias(c) for c in f.columns))
    return one.unpivot([], f.columns, "name", "r").select("name", "r.*")


@query()
def o12_checksums(spark, d):
    """Order-free checksum of every table of the domain: rows and the exclusive or of their hashes."""
    names = ("raw_bars", "label_bars", "feature_batches", "batch_files")
    parts = [(df := load(spark, d, t)).agg(F.lit(t).alias("table_name"), F.count("*").alias("n"), F.bit_xor(F.xxhash64(*sorted(df.columns))).alias("checksum")) for t in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("with a as (select asset_id, count(distinct batch_id) as n_batches, max(\"timestamp\") as last_ts from feature_batches where asset_id is not null group by 1) select asset_id, n_batches, last_ts, (n_batches >= 3)::int as ready from a")
def o14_batch_readiness(spark, d):
    a = load(spark, d, "feature_batches", "asset_id", "batch_id", "timestamp").where("asset_id is not null").groupBy("asset_id").agg(F.count_distinct("batch_id").alias("n_batches"), F.max("timestamp").alias("last_ts"))
    return a.withColumn("ready", (F.col("n_batches") >= 3).cast("int"))


# ---- research layer -----------------------------------------------------------------------------------------------------


@query()
def research_p01_online_experts(spark, d):
    """Exponentially weighted experts on log loss, floored and renormalised per batch among those that predict."""
    pt = F.greatest(F.element_at(F.array(*PROBS), F.col("y_true") + 1), F.lit(1e-12))
    loss = _pred(spark, d, "pred_batch", "action_key", "y_true", *PROBS).dropna().where("y_true between 0 and 3").groupBy("pred_batch", "action_key").agg(F.avg(-F.log(pt)).alias("loss"))
    rows = loss.groupBy("pred_batch").agg(F.map_from_entries(F.collect_list(F.struct("action_key", "loss"))).alias("losses")).withColumn("all", F.lit(0))

    def fold(w, row):
        now = dict(row["losses"])
        have = {k: w.get(k, 1.0) for k in now}
        total = sum(have.values())
        new = w | {k: max(1e-12, v / total * math.exp(-0.5 * now[k])) for k, v in have.items()}
        return new, {"weights": {k: v / total for k, v in have.items()}}

    s = scan(rows, ["all"], "pred_batch", fold, dict, "weights map<string,double>")
    return s.select("pred_batch", F.explode("weights").alias("action_key", "weight"))


@query(P + f", t as (select asset_id, \"timestamp\", min(y_true) as y_true, count(distinct y_true) as n from p where y_true is not null group by all) select asset_id, \"timestamp\", y_true, y_true >= 2 as is_up, y_true % 2 = 1 as breakfree from t where n = 1")
def research_p05_truth_table(spark, d):
    t = _pred(spark, d, "asset_id", "timestamp", "y_true").where("y_true is not null").groupBy("asset_id", "timestamp").agg(F.min("y_true").alias("y_true"), F.count_distinct("y_true").alias("n")).where("n = 1")
    return t.select("asset_id", "timestamp", "y_true", (F.col("y_true") >= 2).alias("is_up"), (F.col("y_true") % 2 == 1).alias("breakfree"))


_W8 = f"w as (select action_key, avg({HIT}) as weight from p where stage_split = 'train' group by 1), e as (select p.asset_id, p.\"timestamp\", " + ", ".join(f"sum({c} * weight) / sum(weight) as e{j}" for j, c in enumerate(PROBS)) + f" from p join w on p.action_key = w.action_key where p.stage_split = 'test' and {KNOWN} group by all)"


def _weighted(spark, d):
    p = _pred(spark, d, "stage_split", "asset_id", "timestamp", "action_key", "y_true", "y_pred", *PROBS)
    w = p.where("stage_split = 'train'").groupBy("action_key").agg(F.avg(_hit()).alias("weight"))
    t = p.where("stage_split = 'test'").dropna(subset=PROBS).join(w, "action_key")
    return t.groupBy("asset_id", "timestamp").agg(*(F.try_divide(F.sum(F.col(c) * F.col("weight")), F.sum("weight")).alias(f"e{j}") for j, c in enumerate(PROBS)))


@query(P + f", {_W8} select asset_id, \"timestamp\", " + ", ".join(f"round(e{j}, 8) as e{j}" for j in range(4)) + " from e")
def research_p08_weighted_ensemble(spark, d):
    return _weighted(spark, d).select("asset_id", "timestamp", *(F.round(f"e{j}", 8).alias(f"e{j}") for j in range(4)))


@query(P + f", {_W8} select asset_id, \"timestamp\", case when e1 + e3 >= 0.5 and abs(e2 + e3 - 0.5) >= 0.1 then case when e2 + e3 > 0.5 then 'up' else 'down' end else 'hold' end as decision from e where e0 is not null")
def research_p09_composition_rules(spark, d):
    e = _weighted(spark, d).where("e0 is not null")
    up, breaks = F.col("e2") + F.col("e3"), F.col("e1") + F.col("e3")
    return e.select("asset_id", "timestamp", F.when((breaks >= 0.5) & (F.abs(up - 0.5) >= 0.1), F.when(up > 0.5, "up").otherwise("down")).otherwise("hold").alias("decision"))


@query(P + f", t as (select unnest([0.5, 0.55, 0.6, 0.65, 0.7]) as tau), g as (select tau, count(*) as n, avg(case when y_true >= 2 then 1.0 else 0.0 end) as precision from p join t on {UPP} >= tau where stage_split = 'valid' and {KNOWN} group by 1) select tau::double as tau, n, round(precision, 8) as precision from g where n >= 5 order by g.precision desc, tau limit 1")
def research_p13_threshold_selection(spark, d):
    p = _pred(spark, d, "stage_split", "y_true", *PROBS).where("stage_split = 'valid'").dropna(subset=PROBS)
    met = p.select("y_true", F.explode(F.filter(F.array(*map(F.lit, (0.5, 0.55, 0.6, 0.65, 0.7))), lambda t: t <= _up())).alias("tau"))
    g = met.groupBy("tau").agg(F.count("*").alias("n"), F.avg(F.when(F.col("y_true") >= 2, 1.0).otherwise(0.0)).alias("precision")).where("n >= 5")
    return g.orderBy(F.desc("precision"), "tau").limit(1).select("tau", "n", F.round("precision", 8).alias("precision"))


@query(P + f", q as (select quantile_cont({UPP}, [0.1, 0.3, 0.5, 0.7, 0.9]) as q from p where {KNOWN}), t as (select unnest([1, 2, 3, 4, 5]) as k), g as (select k, q[k] as cut from q, t) select k::int as k, round(cut, 6) as cut, count(*) as n, round(avg(case when y_true >= 2 then 1.0 else 0.0 end), 8) as precision from g join p on {UPP} >= cut where {KNOWN} group by 1, 2")
def research_p21_risk_guard_grid(spark, d):
    p = _pred(spark, d, "y_true", *PROBS).dropna(subset=PROBS).withColumn("up", _up())
    q = exact_quantiles(p, F.col("up"), (0.1, 0.3, 0.5, 0.7, 0.9))
    met = p.withColumn("q", F.array(*(F.lit(x).cast("double") for x in q))).select("y_true", "up", F.posexplode("q").alias("pos", "cut")).where("up >= cut")
    return met.groupBy((F.col("pos") + 1).alias("k"), F.round("cut", 6).alias("cut")).agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("y_true") >= 2, 1.0).otherwise(0.0)), 8).alias("precision"))


@query(P + ", s as (select action_key, y_pred >= 2 as side, count(*) as n, avg(case when (y_true >= 2) = (y_pred >= 2) then 1.0 else 0.0 end) as safe from p where y_pred is not null and action_key is not null group by 1, 2) select side, action_key, n, round(safe, 8) as safe from s where n >= 10 qualify row_number() over (partition by side order by s.safe desc, action_key) <= 3")
def research_p22_direction_specialists(spark, d):
    safe = F.when((F.col("y_true") >= 2) == (F.col("y_pred") >= 2), 1.0).otherwise(0.0)
    s = _pred(spark, d, "action_key", "y_true", "y_pred").where("y_pred is not null and action_key is not null").groupBy("action_key", (F.col("y_pred") >= 2).alias("side")).agg(F.count("*").alias("n"), F.avg(safe).alias("safe")).where("n >= 10")
    return s.withColumn("k", F.row_number().over(Window.partitionBy("side").orderBy(F.desc("safe"), "action_key"))).where("k <= 3").select("side", "action_key", "n", F.round("safe", 8).alias("safe"))


@query(P + f", {_LOSS}, s as (select action_key, pred_batch, loss, row_number() over (partition by action_key order by pred_batch) as k from loss), w as (select * from s where k <= 12), c as (select a.action_key as key_a, b.action_key as key_b, count(*) as n, corr(a.loss, b.loss) as c from w a join w b on a.pred_batch = b.pred_batch and a.action_key < b.action_key group by 1, 2) select key_a, key_b, n, round(c, 6) as corr from c where n >= 5 and c >= 0.5")
def research_p29_duplicate_configs(spark, d):
    """Pairs of models whose warm-up losses move together: models of a batch are paired within it, one row per batch and model."""
    k = F.row_number().over(Window.partitionBy("action_key").orderBy("pred_batch"))
    w = _loss(spark, d).withColumn("k", k).where("k <= 12").groupBy("pred_batch").agg(F.array_sort(F.collect_list(F.struct("action_key", "loss"))).alias("m"))
    ab = w.select("m", F.explode("m").alias("a")).select("a", F.explode(F.filter("m", lambda x: x["action_key"] > F.col("a.action_key"))).alias("b"))
    c = ab.groupBy(F.col("a.action_key").alias("key_a"), F.col("b.action_key").alias("key_b")).agg(F.count("*").alias("n"), F.try_divide(F.avg(F.col("a.loss") * F.col("b.loss")) - F.avg("a.loss") * F.avg("b.loss"), F.nullif(F.stddev_pop("a.loss") * F.stddev_pop("b.loss"), F.lit(0.0))).alias("c"))
    return c.where("n >= 5 and c >= 0.5").select("key_a", "key_b", "n", F.round("c", 6).alias("corr"))


@query(P + ", b as (select action_key, pred_batch, avg(case when y_true = y_pred then 1.0 else 0.0 end) as acc from p group by 1, 2), w as (select pred_batch, arg_max(action_key, (acc, action_key)) as winner from b group by 1) select winner as action_key, count(*) as wins, round(count(*) / sum(count(*)) over (), 8) as share from w group by 1")
def research_p42_winner_portfolio(spark, d):
    b = _pred(spark, d, "action_key", "pred_batch", "y_true", "y_pred").groupBy("action_key", "pred_batch").agg(F.avg(_hit()).alias("acc"))
    w = b.groupBy("pred_batch").agg(F.max_by("action_key", F.struct("acc", "action_key")).alias("action_key"))
    return w.groupBy("action_key").agg(F.count("*").alias("wins")).withColumn("share", F.round(F.col("wins") / F.sum("wins").over(Window.partitionBy()), 8))


@query(P + ", k as (select distinct action_key from p where action_key is not null), b as (select distinct pred_batch from p where pred_batch is not null) select k.action_key, count(*) as n_expected, count(s.action_key) as n_found from k cross join b left join (select distinct action_key, pred_batch from p) s on s.action_key = k.action_key and s.pred_batch = b.pred_batch group by 1")
def research_p44_combo_coverage(spark, d):
    seen = _pred(spark, d, "action_key", "pred_batch").dropna().distinct()
    n = seen.agg(F.count_distinct("pred_batch"))
    return seen.groupBy("action_key").agg(F.count("*").alias("n_found")).withColumn("n_expected", n.scalar()).select("action_key", "n_expected", "n_found")


@query(P + f", s as (select stage_split, asset_id, avg({HIT}) as acc, count(*) as n from p where asset_id is not null group by 1, 2) select a.asset_id, round(b.acc - a.acc, 8) as test_minus_train from s a join s b on a.asset_id = b.asset_id and a.stage_split = 'train' and b.stage_split = 'test'")
def research_p53_quality_degradation(spark, d):
    p = _pred(spark, d, "stage_split", "asset_id", "y_true", "y_pred").where("asset_id is not null")
    s = p.groupBy("asset_id").agg(F.avg(F.when(F.col("stage_split") == "train", _hit())).alias("a"), F.avg(F.when(F.col("stage_split") == "test", _hit())).alias("b"))
    return s.where("a is not null and b is not null").select("asset_id", F.round(F.col("b") - F.col("a"), 8).alias("test_minus_train"))


@query(BARS + ", e as (select symbol, ts, ret, epoch_us(ts) as us from x where ret > 1.0), g as (select *, case when us - lag(us) over (partition by symbol order by ts) > 6 * 3600000000 then 1 else 0 end as brk from e), c as (select *, sum(brk) over (partition by symbol order by ts) as cluster from g) select symbol, cluster::bigint as cluster, count(*) as n, arg_max(ts, (ret, ts)) as peak_ts from c group by 1, 2")
def research_p56_declustered_exceedances(spark, d):
    from chronoloom.operators.relational import sessions

    e = _returns(spark, d).where("ret > 1.0").select("symbol", "ts", "ret")
    return sessions(e, ["symbol"], "ts", 360).groupBy("symbol", F.col("session").cast("long").alias("cluster")).agg(F.count("*").alias("n"), F.max_by("ts", F.struct("ret", "ts")).alias("peak_ts"))


@query('with last as (select file_id, row_id, "timestamp", close, row_number() over (partition by file_id order by "timestamp" desc, row_id desc) as k from feature_batches) select file_id, row_id, "timestamp", close from last where k = 1')
def research_p51_last_row_per_file(spark, d):
    f = load(spark, d, "feature_batches", "file_id", "row_id", "timestamp", "close")
    return f.groupBy("file_id").agg(F.max_by(F.struct("row_id", "timestamp", "close"), F.struct("timestamp", "row_id")).alias("r")).select("file_id", "r.*")


def groups(pairs: list[tuple[str, str]]) -> dict[str, str]:
    """The first name of the group of every name in the pairs (union-find)."""
    parent: dict[str, str] = {}

    def root(k: str) -> str:
        parent.setdefault(k, k)
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {k: root(k) for k in parent}


@query()
def research_p29_duplicate_groups(spark, d):
    """Models that are linked by duplicates, with the one that is kept; the pairs of models are few, whatever the predictions."""

    def join(batches):
        pairs = [p for pdf in batches for p in zip(pdf["key_a"], pdf["key_b"], strict=True)]
        yield pd.DataFrame(sorted((k, g, int(k == g)) for k, g in groups(pairs).items()), columns=["action_key", "kept_key", "is_kept"])

    return research_p29_duplicate_configs(spark, d).select("key_a", "key_b").coalesce(1).mapInPandas(join, "action_key string, kept_key string, is_kept int")
