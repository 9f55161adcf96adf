"""Sequential helper models with all their outputs (H), over returns of bars, with SQL where it can say them."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.functions import folds, helpers
from chronoloom.functions.windows import clip, div, lag, nz, ordered, trailing
from chronoloom.operators.scan import affine_scan, scan
from chronoloom.plans.relational_queries import Query
from chronoloom.session import shared_folder
from chronoloom.sources import bars as source

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
ORD = "over (partition by symbol order by ts)"


def query(sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def _returns(spark, d) -> DataFrame:
    return source.bars(spark, d).withColumn("ret", F.log(div("close", nz(lag("close"))))).select("symbol", "ts", "close", "volume", "ret")


def _series(df: DataFrame, run, names: tuple[str, ...]) -> DataFrame:
    """Columns ``names`` of a helper over the ordered returns of a symbol (a missing return is 0); its rows are bars, bounded by the time grid."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts").reset_index(drop=True)
        out = pd.DataFrame(run(pdf), columns=list(names))
        return pd.concat([pdf[["symbol", "ts"]], out], axis=1)

    made = df.groupBy("symbol").applyInPandas(one, "symbol string, ts timestamp_ntz, " + ", ".join(f"{n} double" for n in names))
    return made.select("symbol", "ts", *(F.when(~F.isnan(n), F.col(n)).alias(n) for n in names))


# fixed values: parameters of the filter, its horizon, window and regimes
OMEGA, ALPHA, BETA, LONG_RUN, HORIZON, ZWINDOW, CALM, WILD = 0.05, 0.1, 0.85, 0.25, 5, 60, 0.8, 1.2
_P = ALPHA + BETA
_F60 = "over (partition by symbol order by ts rows between 60 preceding and 1 preceding)"


@query(f"""with recursive {source.sql()}, x as (select symbol, ts, coalesce(ln(close / lag(close) {ORD}), 0) as ret, row_number() {ORD} as k from bars),
r as (select symbol, ts, k, ret, {LONG_RUN}::double as var from x where k = 1 union all select x.symbol, x.ts, x.k, x.ret, {OMEGA} + {ALPHA} * r.ret * r.ret + {BETA} * r.var from r join x on x.symbol = r.symbol and x.k = r.k + 1),
v as (select symbol, ts, k, ret, sqrt(greatest(var, 1e-10)) as vol from r), w as (select *, lag(vol) {ORD} as before from v)
select symbol, ts, round(vol, 6) as volatility, round(sqrt({OMEGA} * (1 - power({_P}, {HORIZON})) / (1 - {_P}) + power({_P}, {HORIZON}) * vol * vol), 6) as forecast,
  round(case when k > {ZWINDOW} then (vol - avg(vol) {_F60}) / (stddev_pop(vol) {_F60} + 1e-10) else 0 end, 4) + 0.0 as zscore, round(coalesce(ret / (before + 1e-10), 0), 6) + 0.0 as shock, round({_P}::double, 6) as persistence,
  case when vol < {CALM} then 0 when vol > {WILD} then 2 else 1 end as regime, round(coalesce(vol - before, 0), 6) + 0.0 as change, round(vol / (sqrt({LONG_RUN}) + 1e-10), 6) as ratio from w""")
def h01_garch_features(spark, d):
    """All outputs of a GARCH(1,1) filter: the variance by blocks of an affine recursion, the rest by windows over it."""
    x = _returns(spark, d).select("symbol", "ts", F.coalesce("ret", F.lit(0.0)).alias("ret")).withColumn("last", lag("ret"))
    first = F.col("last").isNull()
    df = affine_scan(x, ["symbol"], "ts", {"var": (F.when(first, 0.0).otherwise(BETA), F.when(first, LONG_RUN).otherwise(OMEGA + ALPHA * F.col("last") * F.col("last")))})
    df = df.withColumns({"vol": F.sqrt(F.greatest("var", F.lit(1e-10)))}).withColumns({"before": lag("vol"), "k": F.row_number().over(ordered())})
    w, vol = trailing(ZWINDOW, 1), F.col("vol")
    z = F.when(F.col("k") > ZWINDOW, (vol - F.avg("vol").over(w)) / (F.stddev_pop("vol").over(w) + 1e-10)).otherwise(0.0)
    forecast = F.sqrt(OMEGA * (1 - _P**HORIZON) / (1 - _P) + _P**HORIZON * vol * vol)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return df.select("symbol", "ts", F.round(vol, 6).alias("volatility"), F.round(forecast, 6).alias("forecast"), F.round(z, 4).alias("zscore"), F.round(zero(F.col("ret") / (F.col("before") + 1e-10)), 6).alias("shock"), F.round(F.lit(_P), 6).alias("persistence"), F.when(vol < CALM, 0).when(vol > WILD, 2).otherwise(1).alias("regime"), F.round(zero(vol - F.col("before")), 6).alias("change"), F.round(vol / (LONG_RUN**0.5 + 1e-10), 6).alias("ratio"))


@query()
def h02_garch_fit(spark, d):
    """Parameters per symbol, from all its returns in order."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(pdf["symbol"].iloc[0], *helpers.garch_fit(pdf.sort_values("ts")["ret"].dropna().to_numpy()))], columns=["symbol", "omega", "alpha", "beta", "log_likelihood"])

    return _returns(spark, d).select("symbol", "ts", "ret").groupBy("symbol").applyInPandas(fit, "symbol string, omega double, alpha double, beta double, log_likelihood double")


@query()
def h06_kalman_acceleration(spark, d):
    fold, start = folds.kalman_acceleration()
    rows = _returns(spark, d).select("symbol", "ts", F.log("close").alias("value"))
    names = ("filtered_dev", "velocity", "acceleration", "pred_error", "innovation", "zscore")
    return scan(rows, ["symbol"], "ts", fold, start, ", ".join(f"{n} double" for n in names) + ", regime int").drop("value")


@query()
def h07_cusum_features(spark, d):
    """Change points of returns and of their volatility, rows since the last one, and how many in 21 rows."""
    fold, start = folds.cusum(6.0, 0.5, 5)
    vol = F.stddev_samp("ret").over(trailing(20))
    rows = _returns(spark, d).select("symbol", "ts", F.col("ret").alias("value"), vol.alias("vol"))
    of_return = scan(rows, ["symbol"], "ts", fold, start, "change int, since int").withColumnsRenamed({"change": "return_change", "since": "return_since"})
    every = scan(of_return.withColumn("value", F.col("vol") - lag("vol")), ["symbol"], "ts", fold, start, "change int, since int")
    return every.select("symbol", "ts", "return_change", "return_since", F.col("change").alias("volatility_change"), F.col("since").alias("volatility_since"), F.sum(F.col("return_change") + F.col("change")).over(trailing(21)).alias("count_21"))


_W62, _W63 = ("over (partition by symbol order by ts rows between 62 preceding and 1 preceding)", "over (partition by symbol order by ts rows between 63 preceding and 1 preceding)")


@query(f"""with {source.sql()}, l as (select symbol, ts, ln(close) as y, lag(ln(close)) {ORD} as x from bars),
m as (select symbol, ts, y, count(x) {_W62} as n, count(y) {_W63} as n63, avg(y) {_W62} as my, avg(x) {_W62} as mx, avg(y * x) {_W62} as mxy, avg(x * x) {_W62} as mxx, avg(y) {_F60} as mean, stddev_pop(y) {_F60} as sd from l),
f as (select *, case when 62 * (mxx - mx * mx) < 1e-10 then 0.9 else least(greatest((mxy - mx * my) / (mxx - mx * mx), -0.999), 0.999) end as phi, (y - mean) / greatest(sd, 1e-8) as z from m where n63 = 63),
k as (select *, case when phi <= 0 then 10.0 else least(greatest(-ln(phi), 0.001), 10) end as kappa from f)
select symbol, ts, round(phi, 4) as phi, round(kappa, 3) as kappa, round(least(greatest(0.693147 / kappa, 0.1), 1000), 1) as half_life, round(z, 4) as zscore, case when z * (z - lag(z) {ORD}) < 0 then 1 else 0 end as reverting from k""")
def h08_mean_reversion_features(spark, d):
    """Rolling AR(1) on the 63 rows before each row: coefficient, speed, half-life, distance from the mean, whether it closes in."""
    b = source.bars(spark, d).withColumn("y", F.log("close")).withColumn("x", lag(F.log("close")))
    w, w60, y, x = trailing(62, 1), trailing(60, 1), F.col("y"), F.col("x")
    spread = F.avg(x * x).over(w) - F.pow(F.avg(x).over(w), 2)
    slope = (F.avg(x * y).over(w) - F.avg(x).over(w) * F.avg(y).over(w)) / nz(spread)
    phi = F.when(62 * spread < 1e-10, 0.9).otherwise(clip(slope, -0.999, 0.999))
    z = (y - F.avg(y).over(w60)) / F.greatest(F.stddev_pop(y).over(w60), F.lit(1e-8))
    f = b.select("symbol", "ts", phi.alias("phi"), z.alias("z"), F.count(y).over(trailing(63, 1)).alias("n")).where("n = 63")
    f = f.withColumn("kappa", F.when(F.col("phi") <= 0, 10.0).otherwise(clip(-F.log("phi"), 0.001, 10.0)))
    back = F.when(F.col("z") * (F.col("z") - lag("z")) < 0, 1).otherwise(0)
    return f.select("symbol", "ts", F.round("phi", 4).alias("phi"), F.round("kappa", 3).alias("kappa"), F.round(clip(0.693147 / F.col("kappa"), 0.1, 1000.0), 1).alias("half_life"), F.round("z", 4).alias("zscore"), back.alias("reverting"))


@query()
def h09_tail_features(spark, d):
    return _series(_returns(spark, d), lambda pdf: helpers.tail_risk(pdf["ret"].fillna(0).to_numpy()), helpers.TAIL)


@query()
def h11_state_features(spark, d):
    """Fitted on all rows of a symbol, so not causal."""
    return _series(_returns(spark, d), lambda pdf: helpers.hidden_states(pdf["ret"].fillna(0).to_numpy()), helpers.STATES)


@query()
def h12_isolation_score(spark, d):
    def run(pdf: pd.DataFrame) -> np.ndarray:
        x = np.column_stack([pdf["ret"].fillna(0), pdf["ret"].abs().rolling(20, min_periods=1).mean().fillna(0), np.log1p(pdf["volume"])])
        return helpers.isolation_scores(x)[:, None]

    return _series(_returns(spark, d), run, ("isolation_score",))


@query(f"with {source.sql()} select symbol, count(*) as n_rows, count(*) as n_cached, 0::bigint as n_missing from bars group by 1")
def h15_helper_cache(spark, d):
    """Helper outputs are written as a table once, and bars are joined with it; what is missing is counted."""
    path = f"{shared_folder(spark)}/helpers-{uuid.uuid4().hex}"
    h01_garch_features(spark, d).write.parquet(path)
    cache = spark.read.parquet(path).select("symbol", "ts", "volatility")
    joined = source.bars(spark, d).select("symbol", "ts").join(cache, ["symbol", "ts"], "left")
    return joined.groupBy("symbol").agg(F.count("*").alias("n_rows"), F.count("volatility").alias("n_cached"), F.count_if(F.col("volatility").isNull()).alias("n_missing"))


@query()
def research_p55_hidden_parameters(spark, d):
    """What Baum-Welch fits per symbol: one row a state with its start, its moves, mean, variance, and the last log-likelihood."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        start, move, mean, var, seen = helpers.baum_welch(pdf.sort_values("ts")["ret"].fillna(0).to_numpy())
        return pd.DataFrame({"symbol": pdf["symbol"].iloc[0], "state": range(len(start)), "start": start, "to_calm": move[:, 0], "to_volatile": move[:, -1], "mean": mean, "variance": var, "log_likelihood": seen[-1]})

    return _returns(spark, d).groupBy("symbol").applyInPandas(fit, "symbol string, state int, start double, to_calm double, to_volatile double, mean double, variance double, log_likelihood double")
