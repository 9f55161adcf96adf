"""Scores, splits, metrics, selectors and research reports in full (C, J, K, L, M, P), with their SQL."""

from __future__ import annotations

import math
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from chronoloom.functions.windows import lead
from chronoloom.operators import relational as R
from chronoloom.operators.scan import affine_scan
from chronoloom.plans.metric_queries import BARS, KNOWN, PROBS, _pred, _ratio, _returns, _yes
from chronoloom.plans.relational_queries import Query
from chronoloom.sources.tables import load

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
P = "with p as (select * from stage1_pred_batch_predictions) "
ORD = "over (partition by symbol order by ts)"
TOP = "greatest(prob_class_0, prob_class_1, prob_class_2, prob_class_3)"


def _hit() -> Column:
    return F.when(F.col("y_true") == F.col("y_pred"), 1.0).otherwise(0.0)


def query(sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


# ---- joins --------------------------------------------------------------------------------------------------------------


@query(BARS + f", f as (select symbol, ts, ret from x where ret is not null), l as (select symbol, ts, lead(ret) {ORD} as target from x), j as (select f.*, target from f join l on f.symbol = l.symbol and f.ts = l.ts where target is not null) select symbol, count(*) as n_joined, count(distinct ts) as n_keys, round(avg(ret * target), 8) as product, (select count(*) from f where f.symbol = j.symbol) as n_features from j group by 1")
def c13_features_with_labels(spark, d):
    """Features and labels on their key; the join must neither lose nor repeat one, which the counts show."""
    x = _returns(spark, d)
    features = x.where("ret is not null").select("symbol", "ts", "ret")
    labels = x.select("symbol", "ts", lead("ret").alias("target")).where("target is not null")
    j = features.join(labels, ["symbol", "ts"]).groupBy("symbol").agg(F.count("*").alias("n_joined"), F.count_distinct("ts").alias("n_keys"), F.round(F.avg(F.col("ret") * F.col("target")), 8).alias("product"))
    return j.join(features.groupBy("symbol").agg(F.count("*").alias("n_features")), "symbol")


@query("select o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R')")
def c14_orders_without_returns(spark, d):
    returned = load(spark, d, "lineitem", "l_orderkey", where="l_returnflag = 'R'")
    return load(spark, d, "orders", "o_orderkey").join(returned, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")


# ---- feature scores -----------------------------------------------------------------------------------------------------

HORIZONS = (1, 3, 6)
_T = "ic * sqrt(greatest(n - 2, 0) / greatest(1 - ic * ic, 1e-12))"


@query(BARS + f""", s as (select symbol, ts, ret, volume, row_number() {ORD} as k, {', '.join(f'lead(ln(close), {h}) {ORD} - ln(close) as t{h}' for h in HORIZONS)} from x),
u as (select symbol, ts, 'ret' as feature, ret as v, h, t from (select *, unnest([{', '.join(map(str, HORIZONS))}]) as h, unnest([{', '.join(f't{h}' for h in HORIZONS)}]) as t from s) where k % h = 0 union all select symbol, ts, 'volume', volume, h, t from (select *, unnest([{', '.join(map(str, HORIZONS))}]) as h, unnest([{', '.join(f't{h}' for h in HORIZONS)}]) as t from s) where k % h = 0),
k as (select * from u where v is not null and t is not null), r as (select feature, h, v, t, rank() over (partition by feature, h order by v) + (count(*) over (partition by feature, h, v) - 1) / 2.0 as rv, rank() over (partition by feature, h order by t) + (count(*) over (partition by feature, h, t) - 1) / 2.0 as rt from k),
i as (select feature, h as horizon, count(*) as n, corr(rv, rt) as ic, avg(case when sign(v) = sign(t) then 1.0 else 0.0 end) as hit_rate from r group by 1, 2),
p as (select *, least(1, exp(-0.717 * abs({_T}) - 0.416 * power({_T}, 2))) as pv from i), q as (select *, row_number() over (order by pv, feature, horizon) as o, count(*) over () as m from p)
select feature, horizon::int as horizon, n, round(ic, 6) as ic, round(hit_rate, 6) as hit_rate, round(min(least(pv * m / o, 1)) over (order by o desc), 5) as q_value from q""")
def j09_feature_scores(spark, d):
    """Rank correlation, hit rate and false-discovery q-value of features at several horizons, on rows whose horizons don't overlap.

    Two-sided p-values of the t statistic are taken from exp(-0.717 t - 0.416 t^2), which is within a hundredth of the normal ones.
    """
    ahead = {f"t{h}": F.lead(F.log("close"), h).over(Window.partitionBy("symbol").orderBy("ts")) - F.log("close") for h in HORIZONS}
    s = _returns(spark, d).withColumns(ahead | {"k": F.row_number().over(Window.partitionBy("symbol").orderBy("ts"))})
    long = s.withColumn("f", F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), F.col(n).alias("v"), F.lit(h).alias("horizon"), F.col(f"t{h}").alias("t")) for n in ("ret", "volume") for h in HORIZONS)))).select("k", "f.*")
    long = long.where("k % horizon = 0 and v is not null and t is not null")
    r = long.select("feature", "horizon", "v", "t", R.average_rank("v", "feature", "horizon").alias("rv"), R.average_rank("t", "feature", "horizon").alias("rt"))
    same = F.when(F.signum("v") == F.signum("t"), 1.0).otherwise(0.0)
    i = r.groupBy("feature", "horizon").agg(F.count("*").alias("n"), F.corr("rv", "rt").alias("ic"), F.avg(same).alias("hit_rate"))
    t = F.col("ic") * F.sqrt(F.greatest(F.col("n") - 2, F.lit(0)) / F.greatest(1 - F.col("ic") * F.col("ic"), F.lit(1e-12)))
    p = i.withColumn("pv", F.least(F.lit(1.0), F.exp(-0.717 * F.abs(t) - 0.416 * t * t)))  # one row a feature and horizon from here on
    q = p.withColumns({"o": F.row_number().over(Window.orderBy("pv", "feature", "horizon")), "m": F.count("*").over(Window.partitionBy())})
    return q.select("feature", "horizon", "n", F.round("ic", 6).alias("ic"), F.round("hit_rate", 6).alias("hit_rate"), F.round(F.min(F.least(F.col("pv") * F.col("m") / F.col("o"), F.lit(1.0))).over(Window.orderBy(F.desc("o"))), 5).alias("q_value"))


_PAIRS = list(combinations(PROBS, 2))


@query(f"with p as (select * from stage1_pred_batch_predictions where {KNOWN}) " + " union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 6) as corr from p" for a, b in _PAIRS))
def j11_all_pairs(spark, d):
    one = _pred(spark, d, *PROBS).dropna().agg(*(F.corr(a, b).alias(f"{a}|{b}") for a, b in _PAIRS))
    pair = F.split("k", "[|]")
    return one.unpivot([], [f"{a}|{b}" for a, b in _PAIRS], "k", "c").select(pair[0].alias("a"), pair[1].alias("b"), F.round("c", 6).alias("corr"))


def correlation_filter(pairs: dict[tuple[str, str], float], score: dict[str, float], limit: float) -> list[str]:
    """Features that are left when, of the pair that correlates most, the one of the lower score goes until no pair lies above ``limit``."""
    left = set(score)
    while True:
        worst = max(((abs(c), a, b) for (a, b), c in pairs.items() if a in left and b in left and c is not None), default=(0.0, "", ""))
        if worst[0] <= limit:
            return sorted(left)
        left.remove(min(worst[1:], key=lambda f: (score[f], f)))


@query()
def j11_correlation_filter(spark, d):
    """Greedy choice among the class probabilities: correlations and scores are one row of aggregates."""
    p = _pred(spark, d, "y_true", *PROBS).dropna()
    own = [F.abs(F.corr(c, (F.col("y_true") == j).cast("double"))).alias(c) for j, c in enumerate(PROBS)]
    row = p.agg(*own, *(F.corr(a, b).alias(f"{a}|{b}") for a, b in _PAIRS)).first()
    kept = correlation_filter({(a, b): row[f"{a}|{b}"] for a, b in _PAIRS}, {c: row[c] or 0.0 for c in PROBS}, 0.3)
    return spark.createDataFrame([(c, row[c], int(c in kept)) for c in PROBS], "feature string, score double, kept int")


# ---- splits and weights -------------------------------------------------------------------------------------------------


@query(P + ", g as (select y_true, count(*) as n from p where y_true is not null group by 1) select y_true, n, round(sum(n) over () / (count(*) over () * n), 8) as balanced, round(sqrt(sum(n) over () / (count(*) over () * n)), 8) as root, round(ln(1 + sum(n) over () / n), 8) as logarithmic from g")
def k11_weight_methods(spark, d):
    g = _pred(spark, d, "y_true").where("y_true is not null").groupBy("y_true").agg(F.count("*").alias("n"))
    every = Window.partitionBy()  # one row a class
    share = F.sum("n").over(every) / (F.count("*").over(every) * F.col("n"))
    return g.select("y_true", "n", F.round(share, 8).alias("balanced"), F.round(F.sqrt(share), 8).alias("root"), F.round(F.log1p(F.sum("n").over(every) / F.col("n")), 8).alias("logarithmic"))


@query(P + ", b as (select distinct pred_batch from p), n as (select pred_batch, row_number() over (order by pred_batch) - 1 as t, count(*) over () as n from b) select pred_batch, round(power(2, (t - n + 1) / 20.0), 8) as by_step, (case when t - n + 1 > -20 then 1.0 else 0.5 end)::double as by_window, round((t + 1.0) / n, 8) as by_rank from n")
def k11_sample_weights(spark, d):
    """Three ways to let later batches count more: half-life of 20 batches, the last 20 in full, in proportion to their place."""
    n = _pred(spark, d, "pred_batch").distinct().withColumns({"t": F.row_number().over(Window.orderBy("pred_batch")) - 1, "n": F.count("*").over(Window.partitionBy())})
    age = F.col("t") - F.col("n") + 1
    return n.select("pred_batch", F.round(F.pow(F.lit(2.0), age / 20.0), 8).alias("by_step"), F.when(age > -20, 1.0).otherwise(0.5).alias("by_window"), F.round((F.col("t") + 1.0) / F.col("n"), 8).alias("by_rank"))


@query("""with p as (select row_id, y_true, md5(row_id::varchar) as h from stage1_pred_batch_predictions where y_true is not null), n as (select min(c) as least from (select count(*) as c from p group by y_true)), r as (select *, row_number() over (partition by y_true order by h, row_id) as k from p) select row_id, y_true from r, n where k <= least""")
def k10_balanced_sample(spark, d):
    """As many rows of every class as the smallest class has, first in the order of a hash.

    Rows are ranked inside 4,096 cells of the hash, whose counts are added up, so a class is never in one task.
    """
    p = _pred(spark, d, "row_id", "y_true").where("y_true is not null").withColumn("h", F.md5(F.col("row_id").cast("string"))).withColumn("cell", F.substring("h", 1, 3))
    cells = p.groupBy("y_true", "cell").agg(F.count("*").alias("n"))  # at most 4,096 rows a class
    before = F.coalesce(F.sum("n").over(Window.partitionBy("y_true").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    least = cells.groupBy("y_true").agg(F.sum("n").alias("t")).agg(F.min("t").alias("least"))
    start = cells.withColumn("before", before).join(F.broadcast(least)).select("y_true", "cell", "before", "least").where("before < least")
    r = p.join(start, ["y_true", "cell"]).withColumn("k", F.col("before") + F.row_number().over(Window.partitionBy("y_true", "cell").orderBy("h", "row_id")))
    return r.where("k <= least").select("row_id", "y_true")


_WF = """with b as (select distinct pred_batch from stage1_pred_batch_predictions), n as (select pred_batch, row_number() over (order by pred_batch) - 1 as i from b), s as (select i as step from n where i >= 12 and i % 4 = 0),
w as (select step, pred_batch, case when i < step - 3 then 'train' when i < step - 2 then 'purge' when i < step then 'calibrate' else 'predict' end as role from s join n on n.i <= s.step and n.i >= s.step - 12)"""


@query(_WF + " select step::bigint as step, max(case when role = 'train' then pred_batch end) as train_end, min(case when role = 'calibrate' then pred_batch end) as calibrate_start, min(case when role = 'predict' then pred_batch end) as predicted, max(case when role = 'train' then pred_batch end) < min(case when role = 'calibrate' then pred_batch end) and max(case when role = 'calibrate' then pred_batch end) < min(case when role = 'predict' then pred_batch end) as no_lookahead from w group by 1")
def k05_no_lookahead(spark, d):
    """For every step of the walk-forward windows, whether what it learns from ends before what it predicts."""
    from chronoloom.plans.metric_queries import k02_walk_forward_windows

    of = lambda role: F.when(F.col("role") == role, F.col("pred_batch"))
    g = k02_walk_forward_windows(spark, d).groupBy("step").agg(F.max(of("train")).alias("train_end"), F.min(of("calibrate")).alias("calibrate_start"), F.max(of("calibrate")).alias("z"), F.min(of("predict")).alias("predicted"))
    return g.select("step", "train_end", "calibrate_start", "predicted", ((F.col("train_end") < F.col("calibrate_start")) & (F.col("z") < F.col("predicted"))).alias("no_lookahead"))


# ---- metrics ------------------------------------------------------------------------------------------------------------


@query(P + f""", g as (select action_key, prob_class_2 + prob_class_3 as s, count(*) as n, count_if(y_true >= 2) as up from p where {KNOWN} and y_true is not null group by 1, 2),
c as (select action_key, up, sum(up) over w as cu, sum(n) over w as cn, sum(up) over (partition by action_key) as t from g window w as (partition by action_key order by s desc)) select action_key, round(sum(up / nullif(t, 0) * cu / cn), 6) as average_precision from c group by 1""")
def l07_average_precision(spark, d):
    """Precision at every score, weighted by the recall it adds; equal scores are counted first."""
    p = _pred(spark, d, "action_key", "y_true", *PROBS).dropna()
    g = p.groupBy("action_key", (F.col("prob_class_2") + F.col("prob_class_3")).alias("s")).agg(F.count("*").alias("n"), F.count_if(F.col("y_true") >= 2).alias("up"))
    w, every = Window.partitionBy("action_key").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("action_key")
    c = g.select("action_key", "up", F.sum("up").over(w).alias("cu"), F.sum("n").over(w).alias("cn"), F.sum("up").over(every).alias("t"))
    return c.groupBy("action_key").agg(F.round(F.sum(F.try_divide(F.col("up"), F.col("t")) * F.col("cu") / F.col("cn")), 6).alias("average_precision"))


@query(P + f", t as (select unnest([0.3, 0.4, 0.5, 0.6, 0.7, 0.8]) as threshold), g as (select threshold::double as threshold, count(*) as n, avg(case when y_true = y_pred then 1.0 else 0.0 end) as precision, count(*) / (select count(*) from p where {KNOWN}) as coverage from p join t on {TOP} >= threshold where {KNOWN} group by 1) select threshold, n, round(precision, 8) as precision, round(coverage, 8) as coverage from g where coverage >= 0.1 order by g.precision desc, threshold limit 1")
def l08_budgeted_threshold(spark, d):
    """The threshold of best precision among those that keep a tenth of all predictions."""
    p = _pred(spark, d, "y_true", "y_pred", *PROBS).dropna(subset=PROBS)
    grid = F.array(*(F.lit(x) for x in (0.3, 0.4, 0.5, 0.6, 0.7, 0.8)))
    met = p.select("y_true", "y_pred", F.explode(F.filter(grid, lambda t: t <= F.greatest(*PROBS))).alias("threshold")).groupBy("threshold").agg(F.count("*").alias("n"), _ratio(_yes(F.col("y_true") == F.col("y_pred")), F.count("*")).alias("precision"))
    met = met.join(F.broadcast(p.agg(F.count("*").alias("total")))).withColumn("coverage", F.col("n") / F.col("total")).where("coverage >= 0.1")
    return met.orderBy(F.desc("precision"), "threshold").limit(1).select("threshold", "n", F.round("precision", 8).alias("precision"), F.round("coverage", 8).alias("coverage"))


def deflated_sharpe(sharpe: float, n: int, skew: float, kurtosis: float, trials: int, spread: float) -> float:
    """Probability that a Sharpe ratio per row exceeds the best that ``trials`` ratios of standard deviation ``spread`` give by chance."""
    from statistics import NormalDist

    z = NormalDist()
    expected = spread * ((1 - 0.5772156649) * z.inv_cdf(1 - 1 / trials) + 0.5772156649 * z.inv_cdf(1 - 1 / (trials * math.e))) if trials > 1 else 0.0
    under = max(1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe * sharpe, 1e-12)
    return z.cdf((sharpe - expected) * math.sqrt(max(n - 1, 0)) / math.sqrt(under))


@query()
def l10_deflated_sharpe(spark, d):
    """Per symbol; the trials are the symbols. Moments come from one aggregate, one row a symbol."""
    r = F.col("ret")
    g = _returns(spark, d).groupBy("symbol").agg(F.count("ret").alias("n"), F.try_divide(F.avg(r), F.stddev_samp(r)).alias("sharpe"), F.skewness(r).alias("skew"), (F.kurtosis(r) + 3).alias("kurtosis"))
    every = Window.partitionBy()
    g = g.withColumns({"trials": F.count("*").over(every), "spread": F.coalesce(F.stddev_samp("sharpe").over(every), F.lit(0.0))})

    @F.pandas_udf("double")
    def chance(s: pd.Series, n: pd.Series, a: pd.Series, b: pd.Series, t: pd.Series, v: pd.Series) -> pd.Series:
        return pd.Series([deflated_sharpe(*row) if all(x == x and x is not None for x in row) else None for row in zip(s, n, a, b, t, v, strict=True)], dtype=float)

    return g.select("symbol", F.round("sharpe", 8).alias("sharpe"), F.round(chance("sharpe", "n", "skew", "kurtosis", "trials", "spread"), 6).alias("deflated"))


BLOCKS = 8
_MASKS = [sum(1 << i for i in c) for c in combinations(range(BLOCKS), BLOCKS // 2)]


@query(P + f""", b as (select pred_batch, ((row_number() over (order by pred_batch) - 1) * {BLOCKS} // count(*) over ())::int as block from (select distinct pred_batch from p)),
s as (select action_key, block, sum(case when y_true = y_pred then 1.0 else 0.0 end) as hit, count(*) as n from p join b on p.pred_batch = b.pred_batch group by 1, 2), c as (select unnest([{', '.join(map(str, _MASKS))}]) as mask),
m as (select mask, action_key, sum(case when (mask >> block) & 1 = 1 then hit end) / sum(case when (mask >> block) & 1 = 1 then n end) as fit, sum(case when (mask >> block) & 1 = 0 then hit end) / sum(case when (mask >> block) & 1 = 0 then n end) as test from s, c group by 1, 2),
r as (select mask, row_number() over (partition by mask order by fit desc nulls last, action_key) as best, rank() over (partition by mask order by test nulls first) / (count(*) over (partition by mask) + 1.0) as omega from m),
o as (select * from r where best = 1) select count(*) as n_splits, round(avg(case when omega <= 0.5 then 1.0 else 0.0 end), 8) as pbo, round(avg(ln(omega / (1 - omega))), 6) as mean_logit from o""")
def l11_combinatorial_overfitting(spark, d):
    """Probability of backtest overfitting: for every way to take half of eight blocks of time, the place out of sample of the model that is best in sample."""
    p = _pred(spark, d, "pred_batch", "action_key", "y_true", "y_pred")
    b = p.select("pred_batch").distinct().withColumn("block", F.floor((F.row_number().over(Window.orderBy("pred_batch")) - 1) * BLOCKS / F.count("*").over(Window.partitionBy())).cast("int"))
    s = p.join(b, "pred_batch").groupBy("action_key", "block").agg(F.sum(_hit()).alias("hit"), F.count("*").alias("n"))  # one row a model and block
    c = s.withColumn("mask", F.explode(F.array(*map(F.lit, _MASKS)))).withColumn("inside", F.expr("shiftright(mask, block) & 1") == 1)
    part = lambda side: F.sum(F.when(F.col("inside") == side, F.col("hit"))) / F.sum(F.when(F.col("inside") == side, F.col("n")))
    m = c.groupBy("mask", "action_key").agg(part(True).alias("fit"), part(False).alias("test"))
    w = Window.partitionBy("mask")
    r = m.select("mask", F.row_number().over(w.orderBy(F.desc_nulls_last("fit"), "action_key")).alias("best"), (F.rank().over(w.orderBy(F.asc_nulls_first("test"))) / (F.count("*").over(w) + 1.0)).alias("omega")).where("best = 1")
    return r.agg(F.count("*").alias("n_splits"), F.round(F.avg(F.when(F.col("omega") <= 0.5, 1.0).otherwise(0.0)), 8).alias("pbo"), F.round(F.avg(F.log(F.col("omega") / (1 - F.col("omega")))), 6).alias("mean_logit"))


@query(BARS + f""", q as (select symbol, quantile_cont(ret, 0.05) as v95, quantile_cont(ret, 0.01) as v99 from x where ret is not null group by 1), c as (select symbol, ts, sum(coalesce(ret, 0)) {ORD} as cum from x), m as (select symbol, ts, cum < greatest(0, max(cum) {ORD}) as under from c),
i as (select *, sum((not under)::int) {ORD} as island from m), l as (select symbol, island, count_if(under) as n from i group by 1, 2)
select q.symbol, round(v95, 6) as var95, round(v99, 6) as var99, round((select avg(ret) from x where x.symbol = q.symbol and ret <= v95), 6) as cvar95, round((select avg(ret) from x where x.symbol = q.symbol and ret <= v99), 6) as cvar99, (select max(n) from l where l.symbol = q.symbol)::bigint as longest_drawdown from q""")
def l14_tail_risk_levels(spark, d):
    x = _returns(spark, d)
    q = x.groupBy("symbol").agg(F.percentile("ret", F.array(F.lit(0.05), F.lit(0.01))).alias("v"))
    w = Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    c = x.withColumn("cum", F.sum(F.coalesce("ret", F.lit(0.0))).over(w)).withColumn("under", F.col("cum") < F.greatest(F.lit(0.0), F.max("cum").over(w)))
    runs = c.withColumn("island", F.sum((~F.col("under")).cast("int")).over(w)).groupBy("symbol", "island").agg(F.count_if("under").alias("n")).groupBy("symbol").agg(F.max("n").alias("longest_drawdown"))
    tail = lambda i: F.round(F.avg(F.when(F.col("ret") <= F.col("v")[i], F.col("ret"))), 6)
    r = x.join(q, "symbol").groupBy("symbol").agg(F.round(F.first(F.col("v")[0]), 6).alias("var95"), F.round(F.first(F.col("v")[1]), 6).alias("var99"), tail(0).alias("cvar95"), tail(1).alias("cvar99"))
    return r.join(runs, "symbol")


@query("with g as (select prob_class_0 as v, count_if(stage_split = 'train') as a, count_if(stage_split = 'test') as b from stage1_pred_batch_predictions where prob_class_0 is not null and stage_split in ('train', 'test') group by 1), c as (select sum(a) over (order by v) / sum(a) over () as fa, sum(b) over (order by v) / sum(b) over () as fb from g), k as (select max(abs(fa - fb)) as ks from c) select round(ks, 8) as ks, case when ks > 0.2 then 'severe' when ks > 0.1 then 'moderate' else 'none' end as severity from k")
def l18_distribution_shift(spark, d):
    """Largest gap of the two distributions at any value: values are put in order inside 4,096 cells whose counts are added up."""
    p = _pred(spark, d, "stage_split", "prob_class_0").where("prob_class_0 is not null and stage_split in ('train', 'test')")
    g = p.groupBy(F.col("prob_class_0").alias("v"), F.floor(F.col("prob_class_0") * 4096).alias("cell")).agg(F.count_if(F.col("stage_split") == "train").alias("a"), F.count_if(F.col("stage_split") == "test").alias("b"))
    cells = g.groupBy("cell").agg(F.sum("a").alias("ca"), F.sum("b").alias("cb"))
    back, every = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()  # one row a cell
    base = cells.select("cell", *(F.coalesce(F.sum(f"c{k}").over(back), F.lit(0)).alias(f"o{k}") for k in "ab"), *(F.sum(f"c{k}").over(every).alias(f"t{k}") for k in "ab"))
    w = Window.partitionBy("cell").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    gap = F.abs((F.col("oa") + F.sum("a").over(w)) / F.col("ta") - (F.col("ob") + F.sum("b").over(w)) / F.col("tb"))
    k = g.join(base, "cell").select(gap.alias("gap")).agg(F.max("gap").alias("ks"))
    return k.select(F.round("ks", 8).alias("ks"), F.when(F.col("ks") > 0.2, "severe").when(F.col("ks") > 0.1, "moderate").otherwise("none").alias("severity"))


@query(P + f"select least(floor({TOP} * 10), 9)::int as bin, count(*) as n, round(avg({TOP}), 8) as confidence, round(avg(case when y_true = y_pred then 1.0 else 0.0 end), 8) as accuracy, round(avg({TOP}) - avg(case when y_true = y_pred then 1.0 else 0.0 end), 7) as gap from p where {KNOWN} group by 1")
def l22_reliability_bins(spark, d):
    p = _pred(spark, d, "y_true", "y_pred", *PROBS).dropna(subset=PROBS).withColumn("c", F.greatest(*PROBS))
    return p.groupBy(F.least(F.floor(F.col("c") * 10), F.lit(9)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("c"), 8).alias("confidence"), F.round(F.avg(_hit()), 8).alias("accuracy"), F.round(F.avg("c") - F.avg(_hit()), 7).alias("gap"))


@query(P + ", s as (select pred_batch, avg(case when y_true = y_pred then 1.0 else 0.0 end) as acc, row_number() over (order by pred_batch) as i, count(*) over () as n from p group by 1), h as (select avg(case when i <= n / 2.0 then acc end) as a, avg(case when i > n / 2.0 then acc end) as b, stddev_samp(acc) as sd, count(*) as n, regr_slope(acc, i) as slope from s) select round(a, 8) as first_half, round(b, 8) as second_half, round(slope, 8) as slope, round((b - a) / nullif(sd * sqrt(4.0 / n), 0), 6) as z, coalesce(abs((b - a) / nullif(sd * sqrt(4.0 / n), 0)) > 2, false) as drifts from h")
def l19_concept_drift(spark, d):
    s = _pred(spark, d, "pred_batch", "y_true", "y_pred").groupBy("pred_batch").agg(F.avg(_hit()).alias("acc"))
    s = s.withColumns({"i": F.row_number().over(Window.orderBy("pred_batch")), "n": F.count("*").over(Window.partitionBy())})  # one row a batch
    late = F.col("i") > F.col("n") / 2
    h = s.agg(F.avg(F.when(~late, F.col("acc"))).alias("a"), F.avg(F.when(late, F.col("acc"))).alias("b"), F.stddev_samp("acc").alias("sd"), F.count("*").alias("n"), F.regr_slope("acc", "i").alias("slope"))
    z = F.try_divide(F.col("b") - F.col("a"), F.nullif(F.col("sd") * F.sqrt(4.0 / F.col("n")), F.lit(0.0)))
    return h.select(F.round("a", 8).alias("first_half"), F.round("b", 8).alias("second_half"), F.round("slope", 8).alias("slope"), F.round(z, 6).alias("z"), F.coalesce(F.abs(z) > 2, F.lit(False)).alias("drifts"))


# ---- selectors ----------------------------------------------------------------------------------------------------------

LOSSES, DISCOUNTS, HISTORY = ("zero_one", "brier", "log"), (0.5, 0.7, 0.8, 0.9, 0.95), (1, 5)
_PT = "list_extract([prob_class_0, prob_class_1, prob_class_2, prob_class_3], y_true + 1)"
_BRIER = " + ".join(f"power(prob_class_{j} - (case when y_true = {j} then 1 else 0 end), 2)" for j in range(4))


@query(P + f""", s as (select action_key, pred_batch, avg(case when y_true = y_pred then 0.0 else 1.0 end) as zero_one, avg({_BRIER}) as brier, avg(-ln(greatest({_PT}, 1e-12))) as log from p where {KNOWN} and y_true between 0 and 3 group by 1, 2),
o as (select pred_batch, row_number() over (order by pred_batch) as i from (select distinct pred_batch from s)), u as (select action_key, s.pred_batch, i, zero_one, loss, value, g from (select action_key, pred_batch, zero_one, unnest(['zero_one', 'brier', 'log']) as loss, unnest([zero_one, brier, log]) as value from s) s join o on s.pred_batch = o.pred_batch, (select unnest([{', '.join(map(str, DISCOUNTS))}])::double as g)),
w as (select *, sum(value * power(g, -i)) over past / sum(power(g, -i)) over past as score, count(*) over past as seen from u window past as (partition by action_key, loss, g order by i rows between unbounded preceding and 1 preceding)),
m as (select *, unnest([1, 5]) as history from w), r as (select *, row_number() over (partition by loss, g, history, pred_batch order by seen < history, score is null, round(score, 9), action_key) as k from m)
select loss, g as discount, history::int as history, count(*) as n, round(avg(1 - zero_one), 6) as accuracy, count(distinct action_key) as n_chosen from r where k = 1 group by 1, 2, 3""")
def m04_selector_policies(spark, d):
    """Thirty policies (three losses, five discounts, two lengths of history): each takes for every batch the model of the lowest discounted past loss.

    A discounted mean is the ratio of two affine recursions, which are scanned by blocks; ties go to models with enough history, then
    with a score, then by key. Scores are compared at nine digits.
    """
    p = _pred(spark, d, "pred_batch", "action_key", "y_true", "y_pred", *PROBS).dropna(subset=[*PROBS, "y_true"]).where("y_true between 0 and 3")
    brier = sum((F.pow(F.col(c) - F.when(F.col("y_true") == j, 1.0).otherwise(0.0), 2) for j, c in enumerate(PROBS)), F.lit(0.0))
    s = p.groupBy("action_key", "pred_batch").agg(F.avg(1 - _hit()).alias("zero_one"), F.avg(brier).alias("brier"), F.avg(-F.log(F.greatest(F.element_at(F.array(*PROBS), F.col("y_true") + 1), F.lit(1e-12)))).alias("log"))
    o = s.select("pred_batch").distinct().withColumn("at", F.timestamp_seconds(F.row_number().over(Window.orderBy("pred_batch"))))  # one row a batch
    s = s.join(o, "pred_batch")
    w = Window.partitionBy("action_key").orderBy("at")
    gap = F.floor(F.unix_seconds("at") - F.lag(F.unix_seconds("at")).over(w))
    s = s.withColumn("gap", gap)
    steps: dict[str, tuple[Column, Column]] = {}
    for k, g in enumerate(DISCOUNTS):
        decay = F.when(F.col("gap").isNull(), 0.0).otherwise(F.pow(F.lit(g), F.col("gap")))
        steps |= {f"n_{k}": (decay, F.lit(1.0))} | {f"{loss}_{k}": (decay, F.col(loss)) for loss in LOSSES}
    scanned = affine_scan(s, ["action_key"], "at", steps)
    past = {f"p_{loss}_{k}": F.lag(F.col(f"{loss}_{k}") / F.col(f"n_{k}")).over(w) for loss in LOSSES for k in range(len(DISCOUNTS))}
    scanned = scanned.withColumns(past | {"seen": F.row_number().over(w) - 1})
    scores = [F.struct(F.lit(loss).alias("loss"), F.lit(g).alias("discount"), F.lit(h).alias("history"), F.col(f"p_{loss}_{k}").alias("score")) for loss in LOSSES for k, g in enumerate(DISCOUNTS) for h in HISTORY]
    long = scanned.select("action_key", "pred_batch", "zero_one", "seen", F.explode(F.array(*scores)).alias("c")).select("*", "c.*")
    first = F.struct((F.col("seen") < F.col("history")).alias("a"), F.col("score").isNull().alias("b"), F.round("score", 9).alias("s"), "action_key")
    best = long.groupBy("loss", "discount", "history", "pred_batch").agg(F.min_by(F.struct("action_key", "zero_one"), first).alias("r"))
    return best.groupBy("loss", "discount", "history").agg(F.count("*").alias("n"), F.round(F.avg(1 - F.col("r.zero_one")), 6).alias("accuracy"), F.count_distinct("r.action_key").alias("n_chosen"))


# ---- research reports ---------------------------------------------------------------------------------------------------


@query(P + f", c as (select *, {TOP} as conf from p where {KNOWN} and y_true is not null and y_pred is not null) select stage_split, least(floor(conf * 5), 4)::int as bin, count(*) as n, round(avg(case when y_true = y_pred then 1.0 else 0.0 end), 8) as accuracy, round(avg(case when (y_true >= 2) = (y_pred >= 2) then 1.0 else 0.0 end), 8) as directional, round(avg(conf), 8) as confidence from c group by 1, 2")
def research_p18_stream_evaluation(spark, d):
    p = _pred(spark, d, "stage_split", "y_true", "y_pred", *PROBS).dropna(subset=[*PROBS, "y_true", "y_pred"]).withColumn("c", F.greatest(*PROBS))
    side = F.when((F.col("y_true") >= 2) == (F.col("y_pred") >= 2), 1.0).otherwise(0.0)
    return p.groupBy("stage_split", F.least(F.floor(F.col("c") * 5), F.lit(4)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg(_hit()), 8).alias("accuracy"), F.round(F.avg(side), 8).alias("directional"), F.round(F.avg("c"), 8).alias("confidence"))


@query(P + ", u as (select asset_id, pred_batch, action_key, avg(case when y_true = y_pred then 1.0 else 0.0 end) as acc from p where asset_id is not null group by 1, 2, 3), r as (select *, rank() over (partition by asset_id, pred_batch order by round(acc, 9) desc) as place from u) select asset_id, action_key, count(*) as n_units, round(avg(acc), 8) as accuracy, round(avg(place), 8) as mean_place, count_if(place = 1)::bigint as n_best from r group by 1, 2")
def research_p20_unit_scores(spark, d):
    """Every model's accuracy and place among the models, per unit (asset and batch)."""
    u = _pred(spark, d, "asset_id", "pred_batch", "action_key", "y_true", "y_pred").where("asset_id is not null").groupBy("asset_id", "pred_batch", "action_key").agg(F.avg(_hit()).alias("acc"))
    r = u.withColumn("place", F.rank().over(Window.partitionBy("asset_id", "pred_batch").orderBy(F.desc(F.round("acc", 9)))))
    return r.groupBy("asset_id", "action_key").agg(F.count("*").alias("n_units"), F.round(F.avg("acc"), 8).alias("accuracy"), F.round(F.avg("place"), 8).alias("mean_place"), F.count_if(F.col("place") == 1).alias("n_best"))


@query(P + "select asset_id, action_key, stage_split, count(*) as n, count(y_pred) as n_predicted, round(count_if(y_pred >= 2 and y_true >= 2) / nullif(count_if(y_pred >= 2), 0), 8) as up_precision, round(count_if(y_pred < 2 and y_true < 2) / nullif(count_if(y_pred < 2), 0), 8) as down_precision, round(count_if(y_pred >= 2 and y_true >= 2) / nullif(count_if(y_true >= 2), 0), 8) as up_recall from p where asset_id is not null group by 1, 2, 3")
def research_p25_directional_units(spark, d):
    p = _pred(spark, d, "asset_id", "action_key", "stage_split", "y_true", "y_pred").where("asset_id is not null")
    up, down = F.col("y_pred") >= 2, F.col("y_pred") < 2
    tu, td = F.col("y_true") >= 2, F.col("y_true") < 2
    part = lambda a, b: F.round(_ratio(F.count_if(a & b), F.nullif(F.count_if(a), F.lit(0))), 8)
    return p.groupBy("asset_id", "action_key", "stage_split").agg(F.count("*").alias("n"), F.count("y_pred").alias("n_predicted"), part(up, tu).alias("up_precision"), part(down, td).alias("down_precision"), part(tu, up).alias("up_recall"))


@query(P + ", e as (select action_key, pred_batch, avg(case when y_true = y_pred then 0.0 else 1.0 end) as err from p group by 1, 2) select a.action_key as a, b.action_key as b, count(*) as n, round(corr(a.err, b.err), 5) as error_corr, round(avg(abs(a.err - b.err)), 8) as error_distance from e a join e b on a.pred_batch = b.pred_batch and a.action_key < b.action_key group by 1, 2")
def research_p27_error_diversity(spark, d):
    """How alike two models' errors run over the batches: one row a model and batch is joined, not the predictions."""
    e = _pred(spark, d, "action_key", "pred_batch", "y_true", "y_pred").groupBy("action_key", "pred_batch").agg(F.avg(1 - _hit()).alias("err"))
    b = e.select("pred_batch", F.col("action_key").alias("b"), F.col("err").alias("err_b"))
    j = e.join(b, "pred_batch").where("action_key < b")
    corr = F.corr("err", "err_b")
    return j.groupBy(F.col("action_key").alias("a"), "b").agg(F.count("*").alias("n"), F.round(F.when(~F.isnan(corr), corr), 5).alias("error_corr"), F.round(F.avg(F.abs(F.col("err") - F.col("err_b"))), 8).alias("error_distance"))


def set_cover(wins: dict[str, set[int]], most: int) -> list[tuple[str, int]]:
    """Models in the order in which each adds the most steps that no model before it wins; with ties the first by name."""
    out, done = [], set()
    while len(out) < most:
        best = min(wins, key=lambda k: (-len(wins[k] - done), k), default=None)
        if best is None or not wins[best] - done:
            return out
        out.append((best, len(wins[best] - done)))
        done |= wins[best]
    return out


@query()
def research_p42_set_cover(spark, d):
    """A portfolio of winners: greedy cover of the steps by the models that win them. One row a step comes from the predictions."""
    u = _pred(spark, d, "action_key", "pred_batch", "y_true", "y_pred").groupBy("pred_batch", "action_key").agg(F.round(F.avg(_hit()), 9).alias("acc"))
    best = u.withColumn("top", F.max("acc").over(Window.partitionBy("pred_batch"))).where("acc = top").groupBy("action_key").agg(F.collect_set("pred_batch").alias("steps"))

    def cover(batches):
        wins = {k: set(s) for pdf in batches for k, s in zip(pdf["action_key"], pdf["steps"], strict=True)}
        yield pd.DataFrame([(i + 1, k, n) for i, (k, n) in enumerate(set_cover(wins, len(wins)))], columns=["place", "action_key", "n_new_steps"])

    return best.coalesce(1).mapInPandas(cover, "place int, action_key string, n_new_steps int")


@query(P + ", k as (select asset_id, timestamp, pred_batch, action_key, any_value(y_true) as y_true, min(y_pred) as y_pred from p where asset_id is not null and timestamp is not null and stage_split = 'test' group by 1, 2, 3, 4) select a.action_key as a, b.action_key as b, count(*) as n, count_if(a.y_pred <> b.y_pred)::bigint as n_disagree, count_if(a.y_pred <> b.y_pred and a.y_pred = a.y_true)::bigint as a_right, count_if(a.y_pred <> b.y_pred and b.y_pred = a.y_true)::bigint as b_right, count(*) >= 5 and count_if(a.y_pred <> b.y_pred) >= 1 as ready from k a join k b on a.asset_id = b.asset_id and a.timestamp = b.timestamp and a.pred_batch = b.pred_batch and a.action_key < b.action_key group by 1, 2")
def research_p48_pair_disagreement(spark, d):
    """Rows of two models of the same bar that disagree, and who was right; bars have a few models each, so the pairs of a bar are few."""
    p = _pred(spark, d, "asset_id", "timestamp", "pred_batch", "action_key", "stage_split", "y_true", "y_pred").where("asset_id is not null and timestamp is not null and stage_split = 'test'")
    k = p.groupBy("asset_id", "timestamp", "pred_batch", "action_key").agg(F.first("y_true").alias("y_true"), F.min("y_pred").alias("y_pred"))
    b = k.select("asset_id", "timestamp", "pred_batch", F.col("action_key").alias("b"), F.col("y_pred").alias("pred_b"))
    j = k.join(b, ["asset_id", "timestamp", "pred_batch"]).where("action_key < b")
    apart = F.col("y_pred") != F.col("pred_b")
    g = j.groupBy(F.col("action_key").alias("a"), "b").agg(F.count("*").alias("n"), F.count_if(apart).alias("n_disagree"), F.count_if(apart & (F.col("y_pred") == F.col("y_true"))).alias("a_right"), F.count_if(apart & (F.col("pred_b") == F.col("y_true"))).alias("b_right"))
    return g.withColumn("ready", (F.col("n") >= 5) & (F.col("n_disagree") >= 1))


@query("""with n as (select asset_id, target_4class, lag(target_4class) over (partition by asset_id order by "timestamp", row_id) as before from label_bars where asset_id is not null and "timestamp" is not null and target_4class is not null),
c as (select asset_id, target_4class as k, count(*) as n, sum(count(*)) over (partition by asset_id) as t from n group by 1, 2), h as (select asset_id, sum(-(n / t) * ln(n / t)) as entropy, max(n / t) as top_share from c group by 1)
select n.asset_id, count(*) as n, round(any_value(entropy), 6) as entropy, round(any_value(top_share), 8) as top_share, round(avg(case when before is not null then case when target_4class = before then 1.0 else 0.0 end end), 8) as persistence from n join h on n.asset_id = h.asset_id group by 1""")
def research_p49_target_survey(spark, d):
    """Balance and persistence of the target per asset; the row before comes from a scan by day, so an asset with most rows is no hot task."""
    from chronoloom.operators.blocks import last_known

    b = load(spark, d, "label_bars", "asset_id", "timestamp", "row_id", "target_4class").where("asset_id is not null and timestamp is not null and target_4class is not null").withColumn("day", F.to_date("timestamp"))
    n = last_known(b, ["asset_id"], ["timestamp", "row_id"], "day", F.col("target_4class"), "before", inclusive=False)
    c = b.groupBy("asset_id", "target_4class").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("asset_id"))  # four rows an asset
    h = c.withColumn("q", share).groupBy("asset_id").agg(F.sum(-F.col("q") * F.log("q")).alias("e"), F.max("q").alias("t"))
    same = F.when(F.col("before").isNotNull(), F.when(F.col("target_4class") == F.col("before"), 1.0).otherwise(0.0))
    g = n.groupBy("asset_id").agg(F.count("*").alias("n"), F.round(F.avg(same), 8).alias("persistence"))
    return g.join(h, "asset_id").select("asset_id", "n", F.round("e", 6).alias("entropy"), F.round("t", 8).alias("top_share"), "persistence")
