"""Splits, metrics, ensembles, conformal calibration and audits (K, L, M, N, O, P) over the prediction and bar tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoloom.functions import folds
from chronoloom.operators import relational as R
from chronoloom.operators.quantiles import exact_quantiles
from chronoloom.operators.scan import scan
from chronoloom.plans.relational_queries import Query
from chronoloom.sources import bars as source
from chronoloom.sources.tables import load, micros

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
PRED = "stage1_pred_batch_predictions"
P = f"with p as (select * from {PRED}) "
PROBS = [f"prob_class_{j}" for j in range(4)]
KNOWN = " and ".join(f"{c} is not null" for c in PROBS)


def query(sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def _pred(spark, d, *cols):
    return load(spark, d, PRED, *cols) if cols else load(spark, d, PRED)


def _yes(c):
    return F.sum(F.when(c, 1).otherwise(0))


def _ratio(a, b):
    return F.try_divide(a.cast("double"), b.cast("double"))


def _argmax(*cols: str):
    a = F.array(*cols)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


# ---- splits -------------------------------------------------------------------------------------------------------------


@query("""with b as (select distinct pred_batch from stage1_pred_batch_predictions), n as (select pred_batch, row_number() over (order by pred_batch) - 1 as i, count(*) over () as n from b), f as (select unnest([0, 1, 2, 3, 4]) as fold), r as (select fold, pred_batch, i, floor(fold * n / 5) as a, floor((fold + 1) * n / 5) as z from n, f)
select fold, pred_batch, case when i >= a and i < z then 'test' when i >= a - 2 and i < a then 'purge' when i >= z and i < z + 1 then 'embargo' else 'train' end as role from r""")
def k01_purged_folds(spark, d):
    b = _pred(spark, d, "pred_batch").distinct()  # one row per batch: the calendar, not the predictions
    n = b.withColumns({"i": F.row_number().over(Window.orderBy("pred_batch")) - 1, "n": F.count("*").over(Window.partitionBy())})
    r = n.withColumn("fold", F.explode(F.array(*map(F.lit, range(5))))).withColumns({"a": F.floor(F.col("fold") * F.col("n") / 5), "z": F.floor((F.col("fold") + 1) * F.col("n") / 5)})
    i, a, z = F.col("i"), F.col("a"), F.col("z")
    return r.select("fold", "pred_batch", F.when((i >= a) & (i < z), "test").when((i >= a - 2) & (i < a), "purge").when((i >= z) & (i < z + 1), "embargo").otherwise("train").alias("role"))


@query("""with b as (select distinct pred_batch from stage1_pred_batch_predictions), n as (select pred_batch, row_number() over (order by pred_batch) - 1 as i from b), s as (select i as step from n where i >= 12 and i % 4 = 0)
select step::bigint as step, pred_batch, case when i < step - 3 then 'train' when i < step - 2 then 'purge' when i < step then 'calibrate' else 'predict' end as role from s join n on n.i <= s.step and n.i >= s.step - 12""")
def k02_walk_forward_windows(spark, d):
    n = _pred(spark, d, "pred_batch").distinct().withColumn("i", F.row_number().over(Window.orderBy("pred_batch")) - 1)
    steps = n.withColumn("step", F.explode(F.sequence(F.col("i"), F.col("i") + 12))).where("step >= 12 and step % 4 = 0").join(n.select(F.col("i").alias("step")), "step", "left_semi")
    i, s = F.col("i"), F.col("step")
    return steps.select(s.cast("long").alias("step"), "pred_batch", F.when(i < s - 3, "train").when(i < s - 2, "purge").when(i < s, "calibrate").otherwise("predict").alias("role"))


@query(P + "select y_true, count(*) as n, round(sum(count(*)) over () / (count(*) over () * count(*)), 8) as balanced from p where y_true is not null group by y_true")
def k11_class_weights(spark, d):
    g = _pred(spark, d, "y_true").where("y_true is not null").groupBy("y_true").agg(F.count("*").alias("n"))
    every = Window.partitionBy()
    return g.select("y_true", "n", F.round(F.sum("n").over(every) / (F.count("*").over(every) * F.col("n")), 8).alias("balanced"))


@query("with b as (select distinct pred_batch from stage1_pred_batch_predictions), n as (select pred_batch, row_number() over (order by pred_batch) as i, count(*) over () as n from b) select pred_batch, case when i <= 0.6 * n then 'train' when i <= 0.8 * n then 'val' else 'test' end as split, round(power(2, (i - n) / 10.0), 8) as half_life_weight from n")
def k09_chronological_split(spark, d):
    n = _pred(spark, d, "pred_batch").distinct().withColumns({"i": F.row_number().over(Window.orderBy("pred_batch")), "n": F.count("*").over(Window.partitionBy())})
    return n.select("pred_batch", F.when(F.col("i") <= 0.6 * F.col("n"), "train").when(F.col("i") <= 0.8 * F.col("n"), "val").otherwise("test").alias("split"), F.round(F.pow(F.lit(2.0), (F.col("i") - F.col("n")) / 10.0), 8).alias("half_life_weight"))


@query("""select asset_id, batch_id, row_number() over (partition by asset_id order by start_ts, batch_id) - 1 as position from (select asset_id, batch_id, min("timestamp") as start_ts from feature_batches where batch_id is not null group by all)""")
def k06_sparse_batch_index(spark, d):
    b = load(spark, d, "feature_batches", "asset_id", "batch_id", "timestamp").where("batch_id is not null").groupBy("asset_id", "batch_id").agg(F.min("timestamp").alias("start_ts"))
    return b.select("asset_id", "batch_id", (F.row_number().over(Window.partitionBy("asset_id").orderBy("start_ts", "batch_id")) - 1).cast("long").alias("position"))


# ---- metrics ------------------------------------------------------------------------------------------------------------

_PRF = """c as (select k, sum(case when y_true = k and y_pred = k then 1 else 0 end) as tp, sum(case when y_pred = k then 1 else 0 end) as pp, sum(case when y_true = k then 1 else 0 end) as tt from p, (select unnest([0, 1, 2, 3]) as k) group by k)"""


@query(P + f", {_PRF} select k as class, round(coalesce(tp / nullif(tt, 0), 0), 8) as recall, round(coalesce(tp / nullif(pp, 0), 0), 8) as precision, round(coalesce(2 * tp / nullif(pp + tt, 0), 0), 8) as f1 from c")
def l01_class_metrics(spark, d):
    p = _pred(spark, d, "y_true", "y_pred")
    parts = [s for k in range(4) for s in (_yes((F.col("y_true") == k) & (F.col("y_pred") == k)).alias(f"tp{k}"), _yes(F.col("y_pred") == k).alias(f"pp{k}"), _yes(F.col("y_true") == k).alias(f"tt{k}"))]
    one = p.agg(*parts)
    rows = F.array(*(F.struct(F.lit(k).alias("class"), F.col(f"tp{k}").alias("tp"), F.col(f"pp{k}").alias("pp"), F.col(f"tt{k}").alias("tt")) for k in range(4)))
    c = one.select(F.explode(rows).alias("r")).select("r.*")
    zero = lambda a, b: F.round(F.coalesce(_ratio(a, F.nullif(b, F.lit(0))), F.lit(0.0)), 8)
    return c.select("class", zero(F.col("tp"), F.col("tt")).alias("recall"), zero(F.col("tp"), F.col("pp")).alias("precision"), zero(2 * F.col("tp"), F.col("pp") + F.col("tt")).alias("f1"))


_CDE = "sum(case when (y_true >= 2) <> (y_pred >= 2) then 1 else 0 end)"


@query(P + f"select action_key, count(*) as n, round(avg(case when y_true = y_pred then 1.0 else 0.0 end), 8) as accuracy, round({_CDE} / count(*), 8) as cross_direction_all, round({_CDE} / nullif(count(y_true), 0), 8) as cross_direction_known from p group by action_key")
def l02_directional_metrics(spark, d):
    p = _pred(spark, d, "action_key", "y_true", "y_pred")
    cross = _yes((F.col("y_true") >= 2) != (F.col("y_pred") >= 2))
    return p.groupBy("action_key").agg(F.count("*").alias("n"), F.round(_ratio(_yes(F.col("y_true") == F.col("y_pred")), F.count("*")), 8).alias("accuracy"), F.round(_ratio(cross, F.count("*")), 8).alias("cross_direction_all"), F.round(_ratio(cross, F.nullif(F.count("y_true"), F.lit(0))), 8).alias("cross_direction_known"))


_TOP = "greatest(" + ", ".join(PROBS) + ")"


@query(P + f"select stage_split, count(*) as n, count(case when {_TOP} >= 0.5 then 1 end) as n_active, round(count(case when {_TOP} >= 0.5 then 1 end) / count(*), 8) as coverage, round(avg(case when {_TOP} >= 0.5 then case when (y_true >= 2) = (y_pred >= 2) then 1.0 else 0.0 end end), 8) as active_accuracy from p group by stage_split")
def l03_coverage_aware(spark, d):
    p = _pred(spark, d, "stage_split", "y_true", "y_pred", *PROBS)
    active = F.greatest(*PROBS) >= 0.5
    right = F.when(active, F.when((F.col("y_true") >= 2) == (F.col("y_pred") >= 2), 1.0).otherwise(0.0))
    return p.groupBy("stage_split").agg(F.count("*").alias("n"), F.count(F.when(active, 1)).alias("n_active"), F.round(_ratio(F.count(F.when(active, 1)), F.count("*")), 8).alias("coverage"), F.round(F.avg(right), 8).alias("active_accuracy"))


_STEPS = "steps as (select pred_batch, avg(case when y_true = y_pred then 1.0 else 0.0 end) as acc from p group by 1)"


def _steps(spark, d):
    return _pred(spark, d, "pred_batch", "y_true", "y_pred").groupBy("pred_batch").agg(_ratio(_yes(F.col("y_true") == F.col("y_pred")), F.count("*")).alias("acc"))


@query(P + f", {_STEPS}, w as (select pred_batch, avg(acc) over (order by pred_batch rows between current row and 9 following) as acc, count(*) over (order by pred_batch rows between current row and 9 following) as n from steps) select pred_batch, round(acc, 8) as acc from w where n = 10 order by w.acc, pred_batch limit 5")
def l04_worst_windows(spark, d):
    w = Window.orderBy("pred_batch").rowsBetween(0, 9)  # over one row per batch
    return _steps(spark, d).select("pred_batch", F.avg("acc").over(w).alias("a"), F.count("*").over(w).alias("n")).where("n = 10").orderBy("a", "pred_batch").limit(5).select("pred_batch", F.round("a", 8).alias("acc"))


_BRIER = " + ".join(f"power({c} - case when y_true = {j} then 1 else 0 end, 2)" for j, c in enumerate(PROBS))


@query(P + f"select action_key, round(avg({_BRIER}), 8) as brier_sum, round(avg(({_BRIER}) / 4), 8) as brier_mean from p where {KNOWN} and y_true is not null group by 1")
def l05_brier(spark, d):
    p = _pred(spark, d, "action_key", "y_true", *PROBS).dropna()
    terms = [F.pow(F.col(c) - (F.col("y_true") == j).cast("int"), F.lit(2)) for j, c in enumerate(PROBS)]
    b = sum(terms[1:], terms[0])
    return p.groupBy("action_key").agg(F.round(F.avg(b), 8).alias("brier_sum"), F.round(F.avg(b / 4), 8).alias("brier_mean"))


_PT = "case y_true " + " ".join(f"when {j} then {c}" for j, c in enumerate(PROBS)) + " end"


@query(P + f"select action_key, round(avg(-ln(least(greatest({_PT}, 1e-12), 1))), 8) as log_loss from p where {KNOWN} and y_true between 0 and 3 group by 1")
def l06_log_loss(spark, d):
    p = _pred(spark, d, "action_key", "y_true", *PROBS).dropna().where("y_true between 0 and 3")
    pt = F.element_at(F.array(*PROBS), F.col("y_true") + 1)
    return p.groupBy("action_key").agg(F.round(F.avg(-F.log(F.least(F.greatest(pt, F.lit(1e-12)), F.lit(1.0)))), 8).alias("log_loss"))


_UP = "(prob_class_2 + prob_class_3)"


@query(P + f", r as (select action_key, y_true >= 2 as up, rank() over (partition by action_key order by {_UP}) + (count(*) over (partition by action_key, {_UP}) - 1) / 2.0 as rk from p where {KNOWN} and y_true is not null) select action_key, round((sum(case when up then rk end) - count_if(up) * (count_if(up) + 1) / 2.0) / nullif(count_if(up) * count_if(not up), 0), 6) as auc from r group by 1")
def l07_auc(spark, d):
    """Rank form of the area under the curve. Scores are counted per value first, so equal scores and hot models stay cheap."""
    p = _pred(spark, d, "action_key", "y_true", *PROBS).dropna()
    g = p.groupBy("action_key", (F.col("prob_class_2") + F.col("prob_class_3")).alias("s")).agg(F.count("*").alias("n"), F.count_if(F.col("y_true") >= 2).alias("up"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("action_key").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    g = g.withColumn("rk", before + (F.col("n") + 1) / F.lit(2.0))
    up, down = F.sum("up"), F.sum(F.col("n") - F.col("up"))
    return g.groupBy("action_key").agg(F.round(_ratio(F.sum(F.col("up") * F.col("rk")) - up * (up + 1) / F.lit(2.0), F.nullif(up * down, F.lit(0))), 6).alias("auc"))


@query(P + f", t as (select unnest([0.3, 0.4, 0.5, 0.6, 0.7, 0.8]) as threshold) select threshold::double as threshold, count(*) as n, round(avg(case when y_true = y_pred then 1.0 else 0.0 end), 8) as precision from p join t on {_TOP} >= threshold group by 1")
def l08_threshold_grid(spark, d):
    p = _pred(spark, d, "y_true", "y_pred", *PROBS)
    grid = F.array(*(F.lit(x) for x in (0.3, 0.4, 0.5, 0.6, 0.7, 0.8)))
    met = p.select("y_true", "y_pred", F.explode(F.filter(grid, lambda t: t <= F.greatest(*PROBS))).alias("threshold"))
    return met.groupBy("threshold").agg(F.count("*").alias("n"), F.round(_ratio(_yes(F.col("y_true") == F.col("y_pred")), F.count("*")), 8).alias("precision"))


@query(P + "select action_key, round(avg(case when y_true = y_pred then 1.0 when (y_true >= 2) = (y_pred >= 2) then 0.5 else 0.0 end), 8) as weighted_accuracy, sum(case when y_true = y_pred then 0 when (y_true >= 2) = (y_pred >= 2) then 1 else 3 end)::bigint as cost from p group by 1")
def l09_weighted_accuracy(spark, d):
    p = _pred(spark, d, "action_key", "y_true", "y_pred")
    same, side = F.col("y_true") == F.col("y_pred"), (F.col("y_true") >= 2) == (F.col("y_pred") >= 2)
    return p.groupBy("action_key").agg(F.round(F.avg(F.when(same, 1.0).when(side, 0.5).otherwise(0.0)), 8).alias("weighted_accuracy"), F.sum(F.when(same, 0).when(side, 1).otherwise(3)).alias("cost"))


BARS = f"with {source.sql()}, x as (select symbol, ts, close, volume, ln(close / lag(close) over (partition by symbol order by ts)) as ret from bars) "


def _returns(spark, d):
    w = Window.partitionBy("symbol").orderBy("ts")
    return source.bars(spark, d).select("symbol", "ts", "close", "volume", F.log(F.try_divide("close", F.lag("close").over(w))).alias("ret"))


@query(BARS + "select symbol, round(avg(ret) / stddev_samp(ret) * sqrt(1095), 6) as sharpe, round(avg(ret) / stddev_samp(case when ret < 0 then ret end) * sqrt(1095), 6) as sortino from x group by 1")
def l10_sharpe(spark, d):
    down = F.stddev_samp(F.when(F.col("ret") < 0, F.col("ret")))
    return _returns(spark, d).groupBy("symbol").agg(F.round(F.try_divide(F.avg("ret"), F.stddev_samp("ret")) * 1095**0.5, 6).alias("sharpe"), F.round(F.try_divide(F.avg("ret"), down) * 1095**0.5, 6).alias("sortino"))


@query(BARS + ", v as (select *, stddev_pop(ret) over (partition by symbol order by ts rows between 21 preceding and 1 preceding) as vol, count(ret) over (partition by symbol order by ts rows between 21 preceding and 1 preceding) as n from x), q as (select symbol, quantile_cont(vol, 0.33) as lo, quantile_cont(vol, 0.67) as hi from v where n = 21 group by 1) select v.symbol, case when vol <= lo then 'low' when vol >= hi then 'high' else 'mid' end as regime, count(*) as n, round(avg(ret), 6) as mean from v join q on v.symbol = q.symbol where v.n = 21 group by all")
def l12_regime_metrics(spark, d):
    w = Window.partitionBy("symbol").orderBy("ts").rowsBetween(-21, -1)
    v = _returns(spark, d).withColumns({"vol": F.stddev_pop("ret").over(w), "n": F.count("ret").over(w)}).where("n = 21")
    q = v.groupBy("symbol").agg(F.percentile("vol", F.array(F.lit(0.33), F.lit(0.67))).alias("q"))
    regime = F.when(F.col("vol") <= F.col("q")[0], "low").when(F.col("vol") >= F.col("q")[1], "high").otherwise("mid")
    return v.join(q, "symbol").groupBy("symbol", regime.alias("regime")).agg(F.count("*").alias("n"), F.round(F.avg("ret"), 6).alias("mean"))


@query(BARS + ", p as (select symbol, abs(avg(ret)) / stddev_samp(ret) * 20 as score from x group by 1), r as (select symbol, 1 / (1 + score) as pv from p), k as (select symbol, pv, row_number() over (order by pv, symbol) as k, count(*) over () as n from r) select symbol, least(round(pv * n, 6), 1) as bonferroni, k <= coalesce((select max(k) from k where pv <= k * 0.9 / n), 0) as rejected from k")
def l13_multiple_testing(spark, d):
    p = _returns(spark, d).groupBy("symbol").agg((1 / (1 + F.abs(F.avg("ret")) / F.stddev_samp("ret") * 20)).alias("pv"))
    k = p.withColumns({"k": F.row_number().over(Window.orderBy("pv", "symbol")), "n": F.count("*").over(Window.partitionBy())})
    top = F.coalesce(F.max(F.when(F.col("pv") <= F.col("k") * 0.9 / F.col("n"), F.col("k"))).over(Window.partitionBy()), F.lit(0))
    return k.select("symbol", F.least(F.round(F.col("pv") * F.col("n"), 6), F.lit(1.0)).alias("bonferroni"), (F.col("k") <= top).alias("rejected"))


@query(BARS + ", q as (select symbol, quantile_cont(ret, 0.05) as var95 from x where ret is not null group by 1), c as (select symbol, ts, sum(ret) over (partition by symbol order by ts) as cum from x), m as (select symbol, cum - greatest(0, max(cum) over (partition by symbol order by ts)) as dd from c) select q.symbol, round(var95, 6) as var95, round((select avg(ret) from x where x.symbol = q.symbol and ret <= var95), 6) as cvar95, round((select min(dd) from m where m.symbol = q.symbol), 6) as max_drawdown from q")
def l14_tail_risk(spark, d):
    x = _returns(spark, d)
    q = x.groupBy("symbol").agg(F.percentile("ret", F.lit(0.05)).alias("v"))
    w = Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    c = x.withColumn("cum", F.sum("ret").over(w)).withColumn("dd", F.col("cum") - F.greatest(F.lit(0.0), F.max("cum").over(w)))
    return c.join(q, "symbol").groupBy("symbol").agg(F.round(F.first("v"), 6).alias("var95"), F.round(F.avg(F.when(F.col("ret") <= F.col("v"), F.col("ret"))), 6).alias("cvar95"), F.round(F.min("dd"), 6).alias("max_drawdown"))


@query(P + f", b as (select stage_split, least(floor({_TOP} * 10), 9)::int as bin, count(*) as n from p where {KNOWN} and stage_split in ('train', 'test') group by 1, 2), g as (select unnest(range(0, 10))::int as bin), s as (select g.bin, coalesce(max(case when stage_split = 'train' then n end), 0) as a, coalesce(max(case when stage_split = 'test' then n end), 0) as b from g left join b on b.bin = g.bin group by 1), f as (select greatest(a / sum(a) over (), 1e-6) as fa, greatest(b / sum(b) over (), 1e-6) as fb from s) select round(sum((fb - fa) * ln(fb / fa)), 6) as psi from f")
def l17_stability_index(spark, d):
    p = _pred(spark, d, "stage_split", *PROBS).dropna()
    g = p.groupBy(F.least(F.floor(F.greatest(*PROBS) * 10), F.lit(9)).cast("int").alias("bin")).agg(F.count_if(F.col("stage_split") == "train").alias("a"), F.count_if(F.col("stage_split") == "test").alias("b"))
    every = Window.partitionBy()  # ten bins
    s = g.select(F.greatest(F.col("a") / F.sum("a").over(every), F.lit(1e-6)).alias("fa"), F.greatest(F.col("b") / F.sum("b").over(every), F.lit(1e-6)).alias("fb"))
    return s.agg(F.round(F.sum((F.col("fb") - F.col("fa")) * F.log(F.col("fb") / F.col("fa"))), 6).alias("psi"))


@query("with v as (select round(prob_class_0, 4) as v, stage_split from stage1_pred_batch_predictions where prob_class_0 is not null and stage_split in ('train', 'test')), g as (select v, count_if(stage_split = 'train') as a, count_if(stage_split = 'test') as b from v group by 1), c as (select sum(a) over (order by v) / sum(a) over () as fa, sum(b) over (order by v) / sum(b) over () as fb from g) select round(max(abs(fa - fb)), 6) as ks from c")
def l18_kolmogorov_smirnov(spark, d):
    """Counted per value at four digits first: at most 10,001 values are put in order, whatever the input."""
    p = _pred(spark, d, "stage_split", "prob_class_0").where("prob_class_0 is not null and stage_split in ('train', 'test')")
    g = p.groupBy(F.round("prob_class_0", 4).alias("v")).agg(F.count_if(F.col("stage_split") == "train").alias("a"), F.count_if(F.col("stage_split") == "test").alias("b"))
    upto, every = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    c = g.select(F.abs(F.sum("a").over(upto) / F.sum("a").over(every) - F.sum("b").over(upto) / F.sum("b").over(every)).alias("gap"))
    return c.agg(F.round(F.max("gap"), 6).alias("ks"))


@query(P + f", {_STEPS} select round(regr_slope(acc, pred_batch), 8) as slope, round(avg(acc), 8) as mean from steps")
def l19_metric_trend(spark, d):
    return _steps(spark, d).agg(F.round(F.regr_slope("acc", "pred_batch"), 8).alias("slope"), F.round(F.avg("acc"), 8).alias("mean"))


@query(P + f", b as (select least(floor({_TOP} * 10), 9)::int as bin, count(*) as n, avg({_TOP}) as conf, avg(case when y_true = y_pred then 1.0 else 0.0 end) as acc from p where {KNOWN} group by 1) select round(sum(n * abs(conf - acc)) / sum(n), 8) as ece from b")
def l22_calibration_error(spark, d):
    p = _pred(spark, d, "y_true", "y_pred", *PROBS).dropna(subset=PROBS).withColumn("c", F.greatest(*PROBS))
    b = p.groupBy(F.least(F.floor(F.col("c") * 10), F.lit(9)).alias("bin")).agg(F.count("*").alias("n"), F.avg("c").alias("conf"), _ratio(_yes(F.col("y_true") == F.col("y_pred")), F.count("*")).alias("acc"))
    return b.agg(F.round(F.sum(F.col("n") * F.abs(F.col("conf") - F.col("acc"))) / F.sum("n"), 8).alias("ece"))


_ENT = " + ".join(f"case when {c} > 0 then -{c} * ln({c}) else 0 end" for c in PROBS)


@query(P + f"select row_id, round({_PT}, 6) as p_true, round({_TOP} - list_sort([{', '.join(PROBS)}], 'DESC')[2], 6) as margin, round({_ENT}, 6) as entropy from p where {KNOWN} and y_true between 0 and 3")
def l23_confident_learning(spark, d):
    p = _pred(spark, d, "row_id", "y_true", *PROBS).dropna(subset=[*PROBS, "y_true"]).where("y_true between 0 and 3").withColumn("a", F.array(*PROBS))
    order = F.sort_array("a", asc=False)
    entropy = F.aggregate("a", F.lit(0.0), lambda s, x: s + F.when(x > 0, -x * F.log(x)).otherwise(0.0))
    return p.select("row_id", F.round(F.element_at("a", F.col("y_true") + 1), 6).alias("p_true"), F.round(order[0] - order[1], 6).alias("margin"), F.round(entropy, 6).alias("entropy"))


@query(P + ", g as (select pred_batch, action_key, avg(case when y_true = y_pred then 1.0 else 0.0 end) as reward from p group by 1, 2) select pred_batch, action_key, round(reward, 8) as reward, dense_rank() over (partition by pred_batch order by reward desc) as place from g")
def l25_reward_table(spark, d):
    g = _pred(spark, d, "pred_batch", "action_key", "y_true", "y_pred").groupBy("pred_batch", "action_key").agg(_ratio(_yes(F.col("y_true") == F.col("y_pred")), F.count("*")).alias("reward"))
    return g.select("pred_batch", "action_key", F.round("reward", 8).alias("reward"), F.dense_rank().over(Window.partitionBy("pred_batch").orderBy(F.desc("reward"))).cast("long").alias("place"))


_W = "sum(case when y_true = y_pred then 1 else 0 end)"


@query(P + f", c as (select action_key, {_W} as w, count(*) as n from p group by 1) select action_key, round((w / n + 1.9208 / n - 1.96 * sqrt(w / n * (1 - w / n) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n), 8) as wilson from c")
def l28_wilson_bound(spark, d):
    c = _pred(spark, d, "action_key", "y_true", "y_pred").groupBy("action_key").agg(_yes(F.col("y_true") == F.col("y_pred")).cast("double").alias("w"), F.count("*").cast("double").alias("n"))
    q, n = F.col("w") / F.col("n"), F.col("n")
    return c.select("action_key", F.round((q + 1.9208 / n - 1.96 * F.sqrt(q * (1 - q) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n), 8).alias("wilson"))


_ONE = "one as (select asset_id, \"timestamp\", action_key, min(y_pred) as y_pred, min(y_true) as y_true from p where asset_id is not null group by all)"


@query(P + f", {_ONE} select a.action_key as key_a, b.action_key as key_b, count(*) as n, round(avg(case when a.y_pred = b.y_pred then 1.0 else 0.0 end), 8) as agreement from one a join one b on a.asset_id = b.asset_id and a.\"timestamp\" = b.\"timestamp\" and a.action_key < b.action_key group by 1, 2")
def l29_pairwise_agreement(spark, d):
    """Models of one bar are listed once and paired within the bar: as many pairs as there are models squared, never as rows squared."""
    one = _pred(spark, d, "asset_id", "timestamp", "action_key", "y_pred").where("asset_id is not null and timestamp is not null and action_key is not null").groupBy("asset_id", "timestamp", "action_key").agg(F.min("y_pred").alias("y"))
    bar = one.groupBy("asset_id", "timestamp").agg(F.array_sort(F.collect_list(F.struct("action_key", "y"))).alias("m")).where("size(m) > 1")
    a = bar.select("m", F.explode("m").alias("a"))
    ab = a.select("a", F.explode(F.filter("m", lambda x: x["action_key"] > F.col("a.action_key"))).alias("b"))
    same = F.coalesce((F.col("a.y") == F.col("b.y")).cast("double"), F.lit(0.0))
    return ab.groupBy(F.col("a.action_key").alias("key_a"), F.col("b.action_key").alias("key_b")).agg(F.count("*").alias("n"), F.round(F.avg(same), 8).alias("agreement"))


@query(P + f", {_ONE} select asset_id, \"timestamp\", action_key, count(*) over (partition by asset_id, \"timestamp\", y_pred >= 2) - 1 as peers from one")
def l30_peer_support(spark, d):
    one = _pred(spark, d, "asset_id", "timestamp", "action_key", "y_pred").where("asset_id is not null").groupBy("asset_id", "timestamp", "action_key").agg(F.min("y_pred").alias("y_pred"))
    return one.select("asset_id", "timestamp", "action_key", (F.count("*").over(Window.partitionBy("asset_id", "timestamp", F.col("y_pred") >= 2)) - 1).alias("peers"))


# ---- ensembles ----------------------------------------------------------------------------------------------------------


def _mean_probs():
    return ", ".join(f"avg({c}) as m{j}" for j, c in enumerate(PROBS))


@query(P + f", m as (select asset_id, \"timestamp\", {_mean_probs()} from p where {KNOWN} group by all) select asset_id, \"timestamp\", round(greatest(m0, m1, m2, m3), 9) as top from m")
def m01_uniform_ensemble(spark, d):
    m = _pred(spark, d, "asset_id", "timestamp", *PROBS).dropna(subset=PROBS).groupBy("asset_id", "timestamp").agg(*(F.avg(c).alias(f"m{j}") for j, c in enumerate(PROBS)))
    return m.select("asset_id", "timestamp", F.round(F.greatest("m0", "m1", "m2", "m3"), 9).alias("top"))


_LOSS = "loss as (select pred_batch, action_key, avg(case when y_true = y_pred then 0.0 else 1.0 end) as loss from p where pred_batch is not null and action_key is not null group by 1, 2)"


def _loss(spark, d):
    p = _pred(spark, d, "pred_batch", "action_key", "y_true", "y_pred").where("pred_batch is not null and action_key is not null")
    miss = F.when(F.col("y_true") == F.col("y_pred"), 0.0).otherwise(1.0)
    return p.groupBy("pred_batch", "action_key").agg(F.avg(miss).alias("loss"))


@query(P + f", {_LOSS}, c as (select pred_batch, action_key, exp(-2 * coalesce(sum(loss) over (partition by action_key order by pred_batch rows between unbounded preceding and 1 preceding), 0)) as w from loss) select pred_batch, action_key, round(w / sum(w) over (partition by pred_batch), 8) as weight from c")
def m02_hedge_weights(spark, d):
    past = Window.partitionBy("action_key").orderBy("pred_batch").rowsBetween(Window.unboundedPreceding, -1)
    c = _loss(spark, d).withColumn("cum", -2 * F.coalesce(F.sum("loss").over(past), F.lit(0.0)))
    c = c.withColumn("w", F.exp(F.col("cum") - F.max("cum").over(Window.partitionBy("pred_batch"))))
    return c.select("pred_batch", "action_key", F.round(F.col("w") / F.sum("w").over(Window.partitionBy("pred_batch")), 8).alias("weight"))


@query()
def m03_discounted_averaging(spark, d):
    """Weights of every model per batch, discounted and floored; models without a loss in a batch count as average."""
    fold, start = folds.discounted_weights(0.95, 2.0, 0.01)
    loss = _loss(spark, d)
    keys = [r[0] for r in loss.select("action_key").distinct().orderBy("action_key").collect()]  # the fixed set of models
    wide = loss.groupBy("pred_batch").pivot("action_key", keys).agg(F.first("loss"))
    losses = wide.select(F.lit(0).alias("all"), "pred_batch", F.array(*(F.coalesce(F.col(f"`{k}`"), F.lit(0.5)) for k in keys)).alias("losses"))
    w = scan(losses, ["all"], "pred_batch", fold, start, "weights array<double>")
    names = F.array(*map(F.lit, keys))
    pairs = w.select("pred_batch", F.explode(F.arrays_zip(names.alias("action_key"), F.col("weights").alias("weight"))).alias("r"))
    return pairs.select("pred_batch", F.col("r.action_key").alias("action_key"), F.round("r.weight", 8).alias("weight"))


@query(P + f", {_LOSS}, o as (select pred_batch, min(loss) as best, arg_min(action_key, (loss, action_key)) as winner from loss group by 1), s as (select action_key from loss group by 1 order by avg(loss), action_key limit 1) select o.pred_batch, winner, round(l.loss - best, 8) as regret, (winner is distinct from lag(winner) over (order by o.pred_batch))::int as switched from o left join loss l on l.pred_batch = o.pred_batch and l.action_key = (select action_key from s)")
def m05_oracle_regret(spark, d):
    loss = _loss(spark, d)
    o = loss.groupBy("pred_batch").agg(F.min("loss").alias("best"), F.min_by("action_key", F.struct("loss", "action_key")).alias("winner"))
    static = loss.groupBy("action_key").agg(F.avg("loss").alias("m")).agg(F.min_by("action_key", F.struct("m", "action_key")))
    fixed = loss.where(F.col("action_key") == static.scalar()).select("pred_batch", F.col("loss").alias("own"))
    w = Window.orderBy("pred_batch")  # one row per batch
    return o.join(fixed, "pred_batch", "left").select("pred_batch", "winner", F.round(F.col("own") - F.col("best"), 8).alias("regret"), (~F.col("winner").eqNullSafe(F.lag("winner").over(w))).cast("int").alias("switched"))


@query(P + ", r as (select y_true, action_key, avg(case when y_pred = y_true then 1.0 else 0.0 end) as recall, count(*) as n from p where y_true is not null and action_key is not null group by 1, 2) select y_true, action_key, round(recall, 8) as recall from r where n >= 5 qualify row_number() over (partition by y_true order by recall desc, action_key) <= 2")
def m08_class_specialists(spark, d):
    r = _pred(spark, d, "y_true", "action_key", "y_pred").where("y_true is not null and action_key is not null").groupBy("y_true", "action_key").agg(_ratio(_yes(F.col("y_pred") == F.col("y_true")), F.count("*")).alias("recall"), F.count("*").alias("n"))
    w = Window.partitionBy("y_true").orderBy(F.desc("recall"), "action_key")
    return r.where("n >= 5").withColumn("k", F.row_number().over(w)).where("k <= 2").select("y_true", "action_key", F.round("recall", 8).alias("recall"))


@query(P + f", {_LOSS}, o as (select pred_batch, arg_min(action_key, (loss, action_key)) as winner from loss group by 1), t as (select lag(winner) over (order by pred_batch) as a, winner as b from o), c as (select a, b, count(*) as n from t where a is not null group by 1, 2) select a as from_key, b as to_key, n, round(n / sum(n) over (partition by a), 8) as share from c")
def m11_winner_transitions(spark, d):
    o = _loss(spark, d).groupBy("pred_batch").agg(F.min_by("action_key", F.struct("loss", "action_key")).alias("winner"))
    t = o.select(F.lag("winner").over(Window.orderBy("pred_batch")).alias("from_key"), F.col("winner").alias("to_key")).where("from_key is not null")
    c = t.groupBy("from_key", "to_key").agg(F.count("*").alias("n"))
    return c.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("from_key")), 8))


@query(P + f", t as (select unnest([0.5, 1.0, 2.0]) as temperature), z as (select temperature, {', '.join(f'power(greatest({c}, 1e-12), 1 / temperature) as e{j}' for j, c in enumerate(PROBS))}, y_true from p, t where {KNOWN} and y_true between 0 and 3) select temperature::double as temperature, round(avg(-ln(case y_true when 0 then e0 when 1 then e1 when 2 then e2 else e3 end / (e0 + e1 + e2 + e3))), 6) as nll from z group by 1")
def m19_temperature_grid(spark, d):
    p = _pred(spark, d, "y_true", *PROBS).dropna().where("y_true between 0 and 3")
    grid = p.withColumn("temperature", F.explode(F.array(F.lit(0.5), F.lit(1.0), F.lit(2.0))))
    e = [F.pow(F.greatest(F.col(c), F.lit(1e-12)), 1 / F.col("temperature")) for c in PROBS]
    nll = -F.log(F.element_at(F.array(*e), F.col("y_true") + 1) / (e[0] + e[1] + e[2] + e[3]))
    return grid.groupBy("temperature").agg(F.round(F.avg(nll), 6).alias("nll"))


# ---- conformal ----------------------------------------------------------------------------------------------------------


@query()
def n01_adaptive_level(spark, d):
    fold, start = folds.adaptive_level(0.6, 0.05)
    steps = _steps(spark, d).select(F.lit(0).alias("all"), "pred_batch", (1 - F.col("acc")).alias("error_rate"))
    return scan(steps, ["all"], "pred_batch", fold, start, "level double, next_level double").drop("all")


@query(P + f", s as (select quantile_cont(1 - {_PT}, 0.9) as q from p where stage_split = 'valid' and {KNOWN} and y_true between 0 and 3) select " + " + ".join(f"(case when 1 - {c} <= q then 1 else 0 end)" for c in PROBS) + f" as set_size, count(*) as n, round(avg(case when 1 - {_PT} <= q then 1.0 else 0.0 end), 8) as coverage from p, s where stage_split = 'test' and {KNOWN} and y_true between 0 and 3 group by 1")
def n03_split_conformal(spark, d):
    p = _pred(spark, d, "stage_split", "y_true", *PROBS).dropna(subset=[*PROBS, "y_true"]).where("y_true between 0 and 3").withColumn("pt", F.element_at(F.array(*PROBS), F.col("y_true") + 1))
    q = exact_quantiles(p.where("stage_split = 'valid'"), 1 - F.col("pt"), [0.9])[0]
    t = p.where("stage_split = 'test'").withColumn("q", F.lit(q))
    size = sum((F.when(1 - F.col(c) <= F.col("q"), 1).otherwise(0) for c in PROBS), F.lit(0))
    return t.groupBy(size.alias("set_size")).agg(F.count("*").alias("n"), F.round(F.avg(F.when(1 - F.col("pt") <= F.col("q"), 1.0).otherwise(0.0)), 8).alias("coverage"))


@query(P + f", {_STEPS}, c as (select pred_batch, avg(acc) over (order by pred_batch rows between 9 preceding and current row) as coverage from steps), g as (select *, sum(case when coverage < 0.4 then 0 else 1 end) over (order by pred_batch) as island from c) select pred_batch, round(coverage, 8) as coverage, sum(case when coverage < 0.4 then 1 else 0 end) over (partition by island order by pred_batch)::bigint as below_run from g")
def n04_coverage_monitor(spark, d):
    w = Window.orderBy("pred_batch")  # one row per batch
    c = _steps(spark, d).select("pred_batch", F.avg("acc").over(w.rowsBetween(-9, 0)).alias("coverage"))
    low = F.when(F.col("coverage") < 0.4, 1).otherwise(0)
    g = c.withColumn("low", low).withColumn("island", F.sum(1 - F.col("low")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return g.select("pred_batch", F.round("coverage", 8).alias("coverage"), F.sum("low").over(Window.partitionBy("island").orderBy("pred_batch")).alias("below_run"))


@query(BARS + ", t as (select symbol, count_if(ret > 0) as wins, count_if(ret < 0) as losses, avg(case when ret > 0 then ret end) as gain, -avg(case when ret < 0 then ret end) as loss from x group by 1) select symbol, round(least(greatest(wins / (wins + losses) - (losses / (wins + losses)) / (gain / loss), 0), 0.25), 6) as kelly from t")
def n08_kelly(spark, d):
    t = _returns(spark, d).groupBy("symbol").agg(F.count_if(F.col("ret") > 0).alias("w"), F.count_if(F.col("ret") < 0).alias("l"), F.avg(F.when(F.col("ret") > 0, F.col("ret"))).alias("g"), (-F.avg(F.when(F.col("ret") < 0, F.col("ret")))).alias("s"))
    n = F.col("w") + F.col("l")
    k = F.try_divide("w", n) - F.try_divide(F.try_divide("l", n), F.try_divide("g", "s"))
    return t.select("symbol", F.round(F.least(F.greatest(k, F.lit(0.0)), F.lit(0.25)), 6).alias("kelly"))


# ---- audits -------------------------------------------------------------------------------------------------------------

_CHECKS = {"high_below_body": "high < greatest(open, close)", "low_above_body": "low > least(open, close)", "not_positive": "open <= 0 or high <= 0 or low <= 0 or close <= 0", "negative_volume": "volume < 0", "null_turnover": "turnover is null"}


@query("with c as (select * replace (case when not isnan(close) then close end as close) from raw_bars where open is not null and close is not null and not isnan(close)) " + " union all ".join(f"select '{n}' as rule, count_if({c})::bigint as n_bad from c" for n, c in _CHECKS.items()))
def o01_schema_rules(spark, d):
    raw = load(spark, d, "raw_bars", "open", "high", "low", "close", "volume", "turnover").where("open is not null and close is not null")
    one = raw.agg(*(F.count_if(F.expr(c)).alias(n) for n, c in _CHECKS.items()))
    return one.unpivot([], list(_CHECKS), "rule", "n_bad")


@query("""with s as (select r.source_id, step_seconds, "timestamp" as ts, row_id from raw_bars r join feeds f on r.source_id = f.source_id), g as (select source_id, step_seconds, date_diff('microsecond', lag(ts) over (partition by source_id order by ts, row_id), ts) / 1e6 as gap from s)
select source_id, count_if(gap = 0) as n_repeated, count_if(gap > 1.5 * step_seconds) as n_gaps, round(max(gap), 3) as longest_gap from g group by 1""")
def o02_series_quality(spark, d):
    from chronoloom.operators.blocks import previous

    s = load(spark, d, "raw_bars", "source_id", "timestamp", "row_id").join(load(spark, d, "feeds", "source_id", "step_seconds"), "source_id").withColumn("at", micros("timestamp")).withColumn("block", F.floor(F.col("at") / F.lit(7 * 86_400_000_000)))
    g = previous(s, ["source_id"], ["at", "row_id"], "block", ["at"], "p").withColumn("gap", (F.col("at") - F.col("p.at")) / 1e6)
    return g.groupBy("source_id").agg(F.count_if(F.col("gap") == 0).alias("n_repeated"), F.count_if(F.col("gap") > 1.5 * F.col("step_seconds")).alias("n_gaps"), F.round(F.max("gap"), 3).alias("longest_gap"))


@query('select count(*) as n_only_features from (select distinct asset_id, "timestamp" from feature_batches) f where not exists (select 1 from label_bars l where l.asset_id = f.asset_id and l."timestamp" = f."timestamp")')
def o03_source_alignment(spark, d):
    f = load(spark, d, "feature_batches", "asset_id", "timestamp").distinct()
    return f.join(load(spark, d, "label_bars", "asset_id", "timestamp"), ["asset_id", "timestamp"], "left_anti").agg(F.count("*").alias("n_only_features"))


_AUDIT = ("open", "high", "low", "close", "volume", "turnover")


@query(" union all ".join(f"select '{c}' as name, count(*) - count(case when not isnan({c}) then {c} end) as n_null, (count(distinct case when not isnan({c}) then {c} end) <= 1)::int as constant from raw_bars" for c in _AUDIT))
def o06_null_and_constant_columns(spark, d):
    raw = load(spark, d, "raw_bars", *_AUDIT)
    one = raw.agg(*(F.struct((F.count("*") - F.count(c)).alias("n_null"), (F.min(c).eqNullSafe(F.max(c))).cast("int").alias("constant")).alias(c) for c in _AUDIT))
    return one.unpivot([], list(_AUDIT), "name", "r").select("name", "r.n_null", "r.constant")


@query("select bar_interval, count(*) as n, substring(sha1(string_agg(source_id, ',' order by source_id)), 1, 12) as set_hash from feeds group by 1")
def o15_context_hash(spark, d):
    g = load(spark, d, "feeds", "bar_interval", "source_id").groupBy("bar_interval")
    return g.agg(F.count("*").alias("n"), F.substring(F.sha1(F.concat_ws(",", F.sort_array(F.collect_list("source_id")))), 1, 12).alias("set_hash"))


# ---- research layer -----------------------------------------------------------------------------------------------------


@query(P + ", h as (select pred_batch, action_key, avg(case when y_true = y_pred then 1.0 else 0.0 end) as acc from p group by 1, 2), n as (select *, row_number() over (partition by action_key order by pred_batch) as up, row_number() over (partition by action_key order by pred_batch desc) as dn from h) select action_key, round(avg(case when dn <= 10 then acc end) - avg(case when up <= 10 then acc end), 8) as drift from n group by 1")
def research_p26_stability_delta(spark, d):
    h = _pred(spark, d, "pred_batch", "action_key", "y_true", "y_pred").groupBy("pred_batch", "action_key").agg(_ratio(_yes(F.col("y_true") == F.col("y_pred")), F.count("*")).alias("acc"))
    w = Window.partitionBy("action_key")
    n = h.withColumns({"up": F.row_number().over(w.orderBy("pred_batch")), "dn": F.row_number().over(w.orderBy(F.desc("pred_batch")))})
    return n.groupBy("action_key").agg(F.round(F.avg(F.when(F.col("dn") <= 10, F.col("acc"))) - F.avg(F.when(F.col("up") <= 10, F.col("acc"))), 8).alias("drift"))


@query(P + ", r as (select action_key, pred_batch, y_true, y_pred, row_number() over (partition by action_key, pred_batch order by \"timestamp\", row_id) as rn from p) select least(floor((rn - 1) * 10 / 240) + 1, 10)::int as decile, count(*) as n, round(avg(case when y_true = y_pred then 1.0 else 0.0 end), 8) as accuracy from r group by 1")
def research_p28_row_deciles(spark, d):
    w = Window.partitionBy("action_key", "pred_batch").orderBy("timestamp", "row_id")
    r = _pred(spark, d, "action_key", "pred_batch", "timestamp", "row_id", "y_true", "y_pred").withColumn("rn", F.row_number().over(w))
    return r.groupBy(F.least(F.floor((F.col("rn") - 1) * 10 / 240) + 1, F.lit(10)).cast("int").alias("decile")).agg(F.count("*").alias("n"), F.round(_ratio(_yes(F.col("y_true") == F.col("y_pred")), F.count("*")), 8).alias("accuracy"))


@query(P + ", v as (select asset_id, \"timestamp\", sum(case when y_pred >= 2 then 1 else 0 end)::bigint as votes_up, count(*) as n, min(y_true) as y_true from p group by all), t as (select unnest([0.5, 0.6, 0.75]) as share) select share::double as share, count(*) as n_signals, round(avg(case when y_true >= 2 then 1.0 else 0.0 end), 8) as precision from v join t on votes_up >= share * n group by 1")
def research_p24_vote_ladder(spark, d):
    v = _pred(spark, d, "asset_id", "timestamp", "y_pred", "y_true").groupBy("asset_id", "timestamp").agg(_yes(F.col("y_pred") >= 2).alias("votes_up"), F.count("*").alias("n"), F.min("y_true").alias("y_true"))
    met = v.select("y_true", F.explode(F.filter(F.array(F.lit(0.5), F.lit(0.6), F.lit(0.75)), lambda s: F.col("votes_up") >= s * F.col("n"))).alias("share"))
    return met.groupBy("share").agg(F.count("*").alias("n_signals"), F.round(F.avg(F.when(F.col("y_true") >= 2, 1.0).otherwise(0.0)), 8).alias("precision"))


@query(P + f", {_LOSS}, w as (select pred_batch, action_key, avg(1 - loss) over (partition by action_key order by pred_batch rows between unbounded preceding and 1 preceding) as past from loss) select pred_batch, action_key, round(past / nullif(sum(past) over (partition by pred_batch), 0), 8) as weight from w where past is not null")
def research_p19_past_only_weights(spark, d):
    past = Window.partitionBy("action_key").orderBy("pred_batch").rowsBetween(Window.unboundedPreceding, -1)
    w = _loss(spark, d).withColumn("past", F.avg(1 - F.col("loss")).over(past)).where("past is not null")
    return w.select("pred_batch", "action_key", F.round(F.try_divide("past", F.nullif(F.sum("past").over(Window.partitionBy("pred_batch")), F.lit(0.0))), 8).alias("weight"))
