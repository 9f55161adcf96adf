"""Order-dependent transforms, labels and normalisation (E, G, J) over bars, with their SQL."""

from __future__ import annotations

from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from chronoloom.functions import folds
from chronoloom.functions.windows import clip, div, lag, lead, nz, ordered, past, roll, trailing, upto, values
from chronoloom.operators import relational as R
from chronoloom.operators.scan import ewm, scan
from chronoloom.plans.relational_queries import Query
from chronoloom.sources import bars as source
from chronoloom.sources.tables import load, micros

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
B = f"with {source.sql()}, x as (select *, ln(close / lag(close) over (partition by symbol order by ts)) as ret from bars) "


def query(sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def _bars(spark, d):
    return source.bars(spark, d)


def _ret(spark, d):
    return _bars(spark, d).withColumn("ret", F.log(div("close", nz(lag("close")))))


def _pick(df, *cols, digits: int = 6):
    """symbol, ts and the given (name, column) pairs, rounded."""
    return df.select("symbol", "ts", *(F.round(c, digits).alias(n) for n, c in cols))


def _over(n: int, end: int = 0) -> str:
    return f"over (partition by symbol order by ts rows between {n - 1 + end} preceding and {end} preceding)" if end else f"over (partition by symbol order by ts rows between {n - 1} preceding and current row)"


ORD = "over (partition by symbol order by ts)"
PAST = "over (partition by symbol order by ts rows between unbounded preceding and 1 preceding)"
UPTO = "over (partition by symbol order by ts rows between unbounded preceding and current row)"


@query(B + f"select symbol, ts, lag(close, 2) {ORD} as lag2, lead(close) {ORD} as next, row_number() {ORD} as pos, dense_rank() over (partition by symbol order by volume) as dense, count(*) over (partition by symbol) as n from x")
def e01_window_functions(spark, d):
    v = Window.partitionBy("symbol")
    return _bars(spark, d).select("symbol", "ts", lag("close", 2).alias("lag2"), lead("close").alias("next"), F.row_number().over(ordered()).cast("long").alias("pos"), F.dense_rank().over(v.orderBy("volume")).cast("long").alias("dense"), F.count("*").over(v).alias("n"))


@query(B + "select symbol, ts, rank() over (partition by ts order by close desc) + (count(*) over (partition by ts, close) - 1) / 2.0 as place from x")
def e02_average_rank(spark, d):
    return _bars(spark, d).select("symbol", "ts", R.average_rank("close", "ts", ascending=False).alias("place"))


@query(B + f"select symbol, ts, round(case when count(close) {_over(25, 1)} = 25 then avg(close) {_over(25, 1)} end, 6) as mean25, round(case when count(close) {_over(50, 1)} = 50 then avg(close) {_over(50, 1)} end, 6) as mean50, round(case when count(close) {_over(100, 1)} = 100 then avg(close) {_over(100, 1)} end, 6) as mean100 from x")
def e03_lagged_means(spark, d):
    m = lambda n: F.when(F.count("close").over(trailing(n, 1)) == n, F.avg("close").over(trailing(n, 1)))
    return _pick(_bars(spark, d), ("mean25", m(25)), ("mean50", m(50)), ("mean100", m(100)))


@query(B + f"select symbol, ts, round(coalesce(close - lag(close) {ORD}, 0), 6) as delta1, round(coalesce(avg(close) {_over(3, 1)}, 0), 6) as mean3, round(coalesce(stddev_samp(close) {_over(6, 1)}, 0), 6) as sd6 from x")
def e04_temporal_features(spark, d):
    zero = F.lit(0.0)
    return _pick(_bars(spark, d), ("delta1", F.coalesce(F.col("close") - lag("close"), zero)), ("mean3", F.coalesce(F.avg("close").over(trailing(3, 1)), zero)), ("sd6", F.coalesce(F.stddev_samp("close").over(trailing(6, 1)), zero)))


@query(B + "select symbol, ts, close from x qualify row_number() over (partition by symbol, epoch_us(ts) // 28800000000 order by ts) = 8")
def e05_row_position(spark, d):
    w = Window.partitionBy("symbol", R.period_start("ts", 8)).orderBy("ts")
    return _bars(spark, d).withColumn("k", F.row_number().over(w)).where("k = 8").select("symbol", "ts", "close")


@query("""select asset_id, row_id, last_value(bb_middle ignore nulls) over (partition by asset_id order by "timestamp", row_id rows unbounded preceding) as forward, first_value(bb_middle ignore nulls) over (partition by asset_id order by "timestamp", row_id rows between current row and unbounded following) as backward from label_bars where asset_id is not null""")
def e06_fill(spark, d):
    from chronoloom.operators.blocks import last_known

    df = load(spark, d, "label_bars", "asset_id", "row_id", "timestamp", "bb_middle").where("asset_id is not null").withColumn("at", micros("timestamp")).withColumn("block", F.floor(F.col("at") / F.lit(30 * 86_400_000_000)))
    df = last_known(df, ["asset_id"], ["at", "row_id"], "block", F.col("bb_middle"), "forward")
    return last_known(df, ["asset_id"], ["at", "row_id"], "block", F.col("bb_middle"), "backward", forward=False).select("asset_id", "row_id", "forward", "backward")


@query(B + f"select symbol, ts, round(least(greatest((close - avg(close) {_over(30)}) / nullif(stddev_samp(close) {_over(30)}, 0), -5), 5), 6) as z from x qualify count(close) {_over(30)} = 30 and stddev_samp(close) {_over(30)} > 0")
def e07_rolling_zscore(spark, d):
    z = clip(div(F.col("close") - roll(F.avg, "close", 30), nz(roll(F.stddev_samp, "close", 30))), -5, 5)
    return _pick(_bars(spark, d), ("z", z)).where("z is not null")


@query(B + f"select symbol, ts, round(case when count(close) {PAST} >= 252 then (close - avg(close) {PAST}) / (stddev_samp(close) {PAST} + 1e-8) end, 6) as z from x")
def e08_expanding_zscore(spark, d):
    z = F.when(F.count("close").over(past()) >= 252, (F.col("close") - F.avg("close").over(past())) / (F.stddev_samp("close").over(past()) + 1e-8))
    return _pick(_bars(spark, d), ("z", z))


@query(B + f"select symbol, ts, round(case when count(close) {PAST} >= 252 then least(greatest(close, quantile_cont(close, 0.01) {PAST}), quantile_cont(close, 0.99) {PAST}) end, 6) as winsorized from x")
def e09_expanding_winsorize(spark, d):
    q = lambda p: F.percentile("close", F.lit(p)).over(past())
    return _pick(_bars(spark, d), ("winsorized", F.when(F.count("close").over(past()) >= 252, F.least(F.greatest("close", q(0.01)), q(0.99)))))


@query(B + ", n as (select symbol, ts, close, row_number() over (partition by symbol order by ts) as k from x) select a.symbol, a.ts, round(avg(case when b.close <= a.close then 1.0 else 0.0 end), 8) as past_rank from n a join n b on a.symbol = b.symbol and b.k < a.k where a.k > 252 group by a.symbol, a.ts")
def e10_expanding_rank(spark, d):
    """Share of past values not above the current one: a sorted list per symbol, log n per row."""
    import bisect

    def fold(s: list, row: dict):
        n = len(s)
        rank = bisect.bisect_right(s, row["close"]) / n if n >= 252 else None
        bisect.insort(s, row["close"])
        return s, {"past_rank": rank}

    df = scan(_bars(spark, d).select("symbol", "ts", "close"), ["symbol"], "ts", fold, list, "past_rank double")
    return df.where("past_rank is not null and not isnan(past_rank)").select("symbol", "ts", F.round("past_rank", 8).alias("past_rank"))


@query(B + "select symbol, ts, round(median(close) over (partition by symbol order by ts rows between 10 preceding and 9 following), 6) as med20 from x")
def e16_rolling_median(spark, d):
    return _pick(_bars(spark, d), ("med20", F.percentile("close", F.lit(0.5)).over(ordered().rowsBetween(-10, 9))))


_PAIR = f"p as (select symbol, ts, ret as x, lead(ret) {ORD} as y, row_number() {ORD} as k from x), q as (select * from p where x is not null and y is not null)"


@query(B + f", {_PAIR}, w as (select a.symbol, a.ts, b.k, b.x, b.y from p a join q b on a.symbol = b.symbol and b.k between a.k - 29 and a.k), r as (select symbol, ts, rank() over (partition by symbol, ts order by x) + (count(*) over (partition by symbol, ts, x) - 1) / 2.0 as rx, rank() over (partition by symbol, ts order by y) + (count(*) over (partition by symbol, ts, y) - 1) / 2.0 as ry from w) select symbol, ts, round(case when count(*) >= 10 then corr(rx, ry) end, 6) as ic from r group by 1, 2")
def e28_rolling_rank_correlation(spark, d):
    """Rank correlation of a return with the next one over the last 30 rows, from 10 pairs on."""
    pair = F.when(F.col("ret").isNotNull() & F.col("y").isNotNull(), F.struct("ret", "y"))

    @F.pandas_udf("double")
    def spearman(xs: pd.Series, ys: pd.Series) -> pd.Series:
        def one(x, y) -> float | None:
            if len(x) < 10:
                return None
            a, b = pd.Series(x).rank(), pd.Series(y).rank()
            return float(a.corr(b)) if a.std() > 0 and b.std() > 0 else None

        return pd.Series([one(x, y) for x, y in zip(xs, ys, strict=True)], dtype=float)

    r = _ret(spark, d).withColumn("y", lead("ret")).withColumn("w", F.collect_list(pair).over(trailing(30)))
    ic = r.where("size(w) > 0").select("symbol", "ts", spearman("w.ret", "w.y").alias("ic"))
    return ic.select("symbol", "ts", F.round(F.when(~F.isnan("ic"), F.col("ic")), 6).alias("ic"))


@query(B + f"select symbol, ts, round(case when count(ret) {_over(40, 1)} > 0 and row_number() {ORD} > 40 then len(list_filter(list(ret) {_over(40, 1)}, lambda v: v <= ret)) / count(ret) {_over(40, 1)} end, 8) as r from x")
def e11_rolling_rank(spark, d):
    hist = F.collect_list("ret").over(trailing(40, 1))
    rank = div(F.size(F.filter("hist", lambda v: v <= F.col("ret"))).cast("double"), F.size("hist").cast("double"))
    df = _ret(spark, d).withColumns({"hist": hist, "k": F.row_number().over(ordered())})
    return df.select("symbol", "ts", F.round(F.when((F.col("k") > 40), F.when(F.col("ret").isNotNull(), rank)), 8).alias("r"))


@query(B + ", k as (select symbol, ts, ret, row_number() over (partition by symbol order by ts) as k from x where ret is not null) select a.symbol, a.ts, round(avg(case when b.ret <= a.ret then 1.0 else 0.0 end), 8) as rank from k a join k b on a.symbol = b.symbol and b.k < a.k and b.k >= a.k - 50 group by a.symbol, a.ts")
def e12_buffered_rank(spark, d):
    fold, start = folds.ranked_buffer(50)
    df = scan(_ret(spark, d).select("symbol", "ts", F.col("ret").alias("value")), ["symbol"], "ts", fold, start, "rank double")
    return df.where("rank is not null and not isnan(rank)").select("symbol", "ts", F.round("rank", 8).alias("rank"))


@query()
def e13_rank_transforms(spark, d):
    """Uniform, signed and Gaussian forms of clipped ranks."""

    @F.pandas_udf("double")
    def gauss(p: pd.Series) -> pd.Series:
        return p.map(NormalDist().inv_cdf, na_action="ignore")

    ranks = e11_rolling_rank(spark, d).withColumn("u", clip(F.col("r"), 0.01, 0.99))
    return ranks.select("symbol", "ts", "u", (2 * F.col("u") - 1).alias("signed"), gauss("u").alias("gauss"))


@query(B + f"select symbol, ts, round((len(list_filter(list(volume) {_over(20)}, lambda v: v < volume)) + (len(list_filter(list(volume) {_over(20)}, lambda v: v = volume)) + 1) / 2) / 20, 8) as pct from x qualify count(volume) {_over(20)} = 20")
def e14_percentile_in_window(spark, d):
    df = _bars(spark, d).withColumn("w", values("volume", 20))
    below, same = F.size(F.filter("w", lambda v: v < F.col("volume"))), F.size(F.filter("w", lambda v: v == F.col("volume")))
    return df.where("w is not null").select("symbol", "ts", F.round((below + (same + 1) / F.lit(2.0)) / 20, 8).alias("pct"))


@query(B + "select symbol, ts, round(avg(close) over (partition by symbol order by ts rows between 4 preceding and 4 following), 6) as centred, round(median(close) over (partition by symbol order by ts rows between 10 preceding and 9 following), 6) as med from x")
def e15_centred(spark, d):
    return _pick(_bars(spark, d), ("centred", F.avg("close").over(ordered().rowsBetween(-4, 4))), ("med", F.percentile("close", F.lit(0.5)).over(ordered().rowsBetween(-10, 9))))


def _ewm_sql(cols: dict[str, tuple[str, float]], prepare: str = "") -> str:
    first = ", ".join(f"({x})::double as {n}" for n, (x, _) in cols.items())
    step = ", ".join(f"{1 - a} * r.{n} + {a} * ({x})" for n, (x, a) in cols.items())
    return f"""with recursive {source.sql()}, {prepare} n as (select *, row_number() over (partition by symbol order by ts) as k from {'prep' if prepare else 'bars'}),
r as (select symbol, ts, k, {first} from n where k = 1 union all select n.symbol, n.ts, n.k, {step} from r join n on n.symbol = r.symbol and n.k = r.k + 1) select symbol, ts, """


@query(_ewm_sql({"e12": ("close", 2 / 13), "e26": ("close", 2 / 27)}) + "round(e12, 6) as e12, round(e26, 6) as e26 from r")
def e17_exponential_mean(spark, d):
    df = ewm(_bars(spark, d).select("symbol", "ts", "close"), ["symbol"], "ts", {"e12": (F.col("close"), 2 / 13), "e26": (F.col("close"), 2 / 27)})
    return _pick(df, ("e12", F.col("e12")), ("e26", F.col("e26")))


@query(_ewm_sql({"rma": ("close", 1 / 14)}) + "case when k >= 14 then round(rma, 6) end as rma from r")
def e18_wilder_mean(spark, d):
    df = ewm(_bars(spark, d).select("symbol", "ts", "close"), ["symbol"], "ts", {"rma": (F.col("close"), 1 / 14)})
    return df.select("symbol", "ts", F.when(F.row_number().over(ordered()) >= 14, F.round("rma", 6)).alias("rma"))


@query(B + "select symbol, ts, round(sum(close * volume) over (partition by symbol, cast(ts as date) order by ts rows unbounded preceding) / sum(volume) over (partition by symbol, cast(ts as date) order by ts rows unbounded preceding), 9) as vwap from x")
def e19_session_vwap(spark, d):
    w = Window.partitionBy("symbol", F.to_date("ts")).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return _pick(_bars(spark, d), ("vwap", F.sum(F.col("close") * F.col("volume")).over(w) / F.sum("volume").over(w)), digits=9)


_SMA = f"avg(close) {_over(5)} as f, avg(close) {_over(20)} as s"


@query(B + f", m as (select symbol, ts, {_SMA} from x) select symbol, ts, coalesce(f > s and lag(f) {ORD} <= lag(s) {ORD}, false)::int as up, coalesce(f < s and lag(f) {ORD} >= lag(s) {ORD}, false)::int as down from m")
def e20_crosses(spark, d):
    m = _bars(spark, d).select("symbol", "ts", F.avg("close").over(trailing(5)).alias("f"), F.avg("close").over(trailing(20)).alias("s"))
    f, s = F.col("f"), F.col("s")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return m.select("symbol", "ts", flag((f > s) & (lag(f) <= lag(s))).alias("up"), flag((f < s) & (lag(f) >= lag(s))).alias("down"))


@query(B + f", l as (select symbol, ts, list(high) {_over(25)} as hs, list(low) {_over(25)} as ls from x) select symbol, ts, list_position(hs, list_max(hs)) - 1 as argmax, list_position(ls, list_min(ls)) - 1 as argmin from l where len(hs) = 25")
def e21_argmax_position(spark, d):
    df = _bars(spark, d).select("symbol", "ts", values("high", 25).alias("hs"), values("low", 25).alias("ls")).where("hs is not null")
    return df.select("symbol", "ts", (F.array_position("hs", F.array_max("hs")) - 1).cast("int").alias("argmax"), (F.array_position("ls", F.array_min("ls")) - 1).cast("int").alias("argmin"))


@query(B + f"select symbol, ts, round(case when count(close) {_over(100)} = 100 then quantile_cont(close, 0.15) {_over(100)} end, 6) as q15 from x")
def e22_rolling_quantile(spark, d):
    w = trailing(100)
    return _pick(_bars(spark, d), ("q15", F.when(F.count("close").over(w) == 100, F.percentile("close", F.lit(0.15)).over(w))))


@query(B + f", u as (select symbol, ts, coalesce(ret > 0, false) as up from x), g as (select *, sum(case when up then 0 else 1 end) {UPTO} as island from u) select symbol, ts, least(sum(case when up then 1 else 0 end) over (partition by symbol, island order by ts), 10)::bigint as run from g")
def e23_run_length(spark, d):
    up = F.coalesce(F.col("ret") > 0, F.lit(False))
    g = _ret(spark, d).withColumn("up", up).withColumn("island", F.sum(F.when(F.col("up"), 0).otherwise(1)).over(upto()))
    inside = Window.partitionBy("symbol", "island").orderBy("ts")
    return g.select("symbol", "ts", F.least(F.sum(F.col("up").cast("long")).over(inside), F.lit(10)).alias("run"))


@query(f"with recursive {source.sql()}, n as (select symbol, ts, (close > open)::int as flag, row_number() over (partition by symbol order by ts) as k from bars), r as (select symbol, ts, k, flag as emitted, case when flag = 1 then k else -1000 end as last from n where k = 1 union all select n.symbol, n.ts, n.k, case when n.flag = 1 and n.k - r.last > 3 then 1 else 0 end, case when n.flag = 1 and n.k - r.last > 3 then n.k else r.last end from r join n on n.symbol = r.symbol and n.k = r.k + 1) select symbol, ts, emitted from r")
def e24_cooldown(spark, d):
    fold, start = folds.cooldown(3)
    rows = _bars(spark, d).select("symbol", "ts", (F.col("close") > F.col("open")).cast("int").alias("flag"))
    return scan(rows, ["symbol"], "ts", fold, start, "emitted int").select("symbol", "ts", "emitted")


@query()
def e25_supertrend(spark, d):
    fold, start = folds.supertrend(3.0)
    rows = f03_average_true_range(spark, d).select("symbol", "ts", "atr").join(_bars(spark, d), ["symbol", "ts"])
    return scan(rows.select("symbol", "ts", "high", "low", "close", "atr"), ["symbol"], "ts", fold, start, "direction int").select("symbol", "ts", "direction")


def ffd_weights(order: float, size: int = 100, threshold: float = 0.0) -> list[float]:
    """Weights of fractional differencing, up to the first below ``threshold``."""
    w = [1.0]
    for k in range(1, size):
        nxt = -w[-1] * (order - k + 1) / k
        if abs(nxt) < threshold:
            break
        w.append(nxt)
    return w


_FFD = ffd_weights(0.4, 10)


@query(B + "select symbol, ts, round(" + " + ".join(f"{w!r} * lag(ln(close), {k}) {ORD}" if k else "ln(close)" for k, w in enumerate(_FFD)) + ", 6) as ffd from x")
def e26_fractional_difference(spark, d):
    terms = [F.lit(w) * (lag(F.log("close"), k) if k else F.log("close")) for k, w in enumerate(_FFD)]
    return _pick(_bars(spark, d), ("ffd", sum(terms[1:], terms[0])))


_FFD_WHOLE = ffd_weights(0.4, 100, 1e-5)


@query(B + "select symbol, ts, round(" + " + ".join(f"{w!r} * lag(ln(close), {k}) {ORD}" if k else "ln(close)" for k, w in enumerate(_FFD_WHOLE)) + ", 6) as ffd from x")
def e26_whole_fractional_difference(spark, d):
    """Order 0.4 with all weights of at least 1e-5, 100 at most; NULL until the window is full."""
    whole = ordered().rowsBetween(1 - len(_FFD_WHOLE), 0)
    x = _bars(spark, d).withColumn("past", F.reverse(F.collect_list(F.log("close")).over(whole)))
    terms = F.zip_with("past", F.array(*map(F.lit, _FFD_WHOLE)), lambda a, w: a * w)
    return _pick(x, ("ffd", F.when(F.size("past") == len(_FFD_WHOLE), F.aggregate(terms, F.lit(0.0), lambda s, v: s + v))))


@query(B + f"select symbol, ts, round(case when count(ret) {_over(30)} >= 10 then avg(ret) {_over(30)} / nullif(stddev_samp(ret) {_over(30)}, 0) end, 6) + 0.0 as sharpe from x")
def e28_rolling_sharpe(spark, d):
    w = trailing(30)
    return _pick(_ret(spark, d), ("sharpe", F.when(F.count("ret").over(w) >= 10, div(F.avg("ret").over(w), nz(F.stddev_samp("ret").over(w))))))


_TR = f"prep as (select *, case when lag(close) {ORD} is null then high - low else greatest(high - low, abs(high - lag(close) {ORD}), abs(low - lag(close) {ORD})) end as tr from bars),"


def _true_range(df):
    prev = lag("close")
    return df.withColumn("tr", F.when(prev.isNull(), F.col("high") - F.col("low")).otherwise(F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))))


@query(_ewm_sql({"atr": ("tr", 2 / 15)}, _TR) + "round(atr, 6) as atr from r")
def f03_average_true_range(spark, d):
    df = ewm(_true_range(_bars(spark, d)).select("symbol", "ts", "close", "tr"), ["symbol"], "ts", {"atr": (F.col("tr"), 2 / 15)})
    return _pick(df, ("atr", F.col("atr")))


@query(_ewm_sql({"s": ("close", 2 / 13), "l": ("close", 2 / 27)}) + "round((s - l) / nullif(l, 0) * 100, 6) as ppo from r")
def f07_ppo(spark, d):
    e = ewm(_bars(spark, d).select("symbol", "ts", "close"), ["symbol"], "ts", {"s": (F.col("close"), 2 / 13), "l": (F.col("close"), 2 / 27)})
    return _pick(e, ("ppo", div(F.col("s") - F.col("l"), nz(F.col("l"))) * 100))


_DM = f"""prep0 as (select *, high - lag(high) {ORD} as up, lag(low) {ORD} - low as dn, lag(close) {ORD} as pc from bars),
prep as (select *, case when pc is null then high - low else greatest(high - low, abs(high - pc), abs(low - pc)) end as tr, case when up > dn and up > 0 then up else 0 end as pdm, case when dn > up and dn > 0 then dn else 0 end as mdm from prep0),"""


@query(_ewm_sql({"a": ("tr", 2 / 15), "p": ("pdm", 2 / 15), "m": ("mdm", 2 / 15)}, _DM) + "round(100 * (p - m) / nullif(a, 0), 6) as di_diff from r")
def f33_directional_index(spark, d):
    up, dn = F.col("high") - lag("high"), lag("low") - F.col("low")
    df = _true_range(_bars(spark, d)).withColumns({"pdm": F.when((up > dn) & (up > 0), up).otherwise(0.0), "mdm": F.when((dn > up) & (dn > 0), dn).otherwise(0.0)})
    e = ewm(df.select("symbol", "ts", "tr", "pdm", "mdm"), ["symbol"], "ts", {"a": (F.col("tr"), 2 / 15), "p": (F.col("pdm"), 2 / 15), "m": (F.col("mdm"), 2 / 15)})
    return _pick(e, ("di_diff", 100 * div(F.col("p") - F.col("m"), nz(F.col("a")))))


# ---- labels -------------------------------------------------------------------------------------------------------------


_BATCH = "epoch_us(ts) // 28800000000"
_AHEAD = f"over (partition by symbol, {_BATCH} order by ts rows between 1 following and unbounded following)"


def _ahead():
    return Window.partitionBy("symbol", R.period_start("ts", 8)).orderBy("ts").rowsBetween(1, Window.unboundedFollowing)


def _top(x: str, largest: bool) -> Column:
    """Mean of the largest or smallest max(1, floor(5 %)) values ahead."""
    a = F.sort_array(F.collect_list(x).over(_ahead()), asc=not largest)
    k = F.greatest(F.lit(1), F.floor(F.size(a) * 0.05)).cast("int")
    return F.when(F.size(a) > 0, F.aggregate(F.slice(a, 1, k), F.lit(0.0), lambda p, q: p + q) / k)


@query(B + f""", a as (select symbol, ts, close, list(high) {_AHEAD} as hs, list(low) {_AHEAD} as ls from x)
select symbol, ts, round(list_avg(hs) / close - 1, 6) as up_mean, round(1 - list_avg(ls) / close, 6) as down_mean, round(list_avg(list_sort(hs, 'DESC')[1:greatest(1, floor(len(hs) * 0.05)::int)]) / close - 1, 6) as up_top, round(1 - list_avg(list_sort(ls)[1:greatest(1, floor(len(ls) * 0.05)::int)]) / close, 6) as down_top from a""")
def g01_forward_distances(spark, d):
    c = F.col("close")
    return _pick(_bars(spark, d), ("up_mean", F.avg("high").over(_ahead()) / c - 1), ("down_mean", 1 - F.avg("low").over(_ahead()) / c), ("up_top", _top("high", True) / c - 1), ("down_top", 1 - _top("low", False) / c))


_DIST = f"""a as (select symbol, ts, close, list(high) {_AHEAD} as hs, list(low) {_AHEAD} as ls from x),
m as (select symbol, ts, (list_avg(hs) - close) / close * 100 as ah, (close - list_avg(ls)) / close * 100 as al, (list_avg(list_sort(hs, 'DESC')[1:greatest(1, floor(len(hs) * 0.05)::int)]) - close) / close * 100 as th, (close - list_avg(list_sort(ls)[1:greatest(1, floor(len(ls) * 0.05)::int)])) / close * 100 as bl from a),
k as (select *, al < 0 as bu, ah < 0 as bd from m),
r as (select *, case when bu then true when bd then false else ah > al end as up, (case when bu then th > 2.1 when bd then false else th / (ah + 1e-10) > 2.5 end) or (case when bd then bl > 2.1 when bu then false else bl / (al + 1e-10) > 2.5 end) as risky from k),
l as (select symbol, ts, case when ah is null then -1 when up then case when risky then 3 else 2 end else case when risky then 1 else 0 end end as label from r)"""


@query(B + f", {_DIST} select symbol, ts, label, case label when 3 then 'UP_EXPANSION' when 2 then 'UP_BALANCED' when 1 then 'DOWN_EXPANSION' when 0 then 'DOWN_BALANCED' else 'INVALID' end as name, case when (epoch_us(ts) % 28800000000) >= 14400000000 then -1 else label end as gated from l")
def g04_four_class_label(spark, d):
    """Direction and expansion of the bars ahead; the late half of a period is gated, its name is not."""
    c = F.col("close")
    m = _bars(spark, d).select("symbol", "ts", ((F.avg("high").over(_ahead()) - c) / c * 100).alias("ah"), ((c - F.avg("low").over(_ahead())) / c * 100).alias("al"), ((_top("high", True) - c) / c * 100).alias("th"), ((c - _top("low", False)) / c * 100).alias("bl"))
    ah, al, th, bl = (F.col(x) for x in ("ah", "al", "th", "bl"))
    over, under = al < 0, ah < 0
    up = F.when(over, True).when(under, False).otherwise(ah > al)
    risky = F.when(over, th > 2.1).when(under, bl > 2.1).otherwise((th / (ah + 1e-10) > 2.5) | (bl / (al + 1e-10) > 2.5))
    label = F.when(ah.isNull(), -1).otherwise(F.when(up, 2).otherwise(0) + risky.cast("int"))
    names = F.create_map(*(F.lit(x) for kv in {3: "UP_EXPANSION", 2: "UP_BALANCED", 1: "DOWN_EXPANSION", 0: "DOWN_BALANCED", -1: "INVALID"}.items() for x in kv))
    late = micros("ts") % 28_800_000_000 >= 14_400_000_000
    return m.withColumn("label", label).select("symbol", "ts", "label", names[F.col("label")].alias("name"), F.when(late, -1).otherwise(F.col("label")).alias("gated"))


_TB = f"""t as (select *, case when lag(close) {ORD} is null then high - low else greatest(high - low, abs(high - lag(close) {ORD}), abs(low - lag(close) {ORD})) end as tr from x),
b as (select *, avg(tr) {_over(21)} as atr, count(*) {_over(21)} as n, {", ".join(f"lead({c}, {k}) {ORD} as {c[0]}{k}" for k in (1, 2, 3) for c in ("high", "low", "close"))} from t),
c as (select *, close + 2 * atr as ub, close - 2 * atr as lb from b where n = 21)"""
_HIT = " ".join(f"when h{k} >= ub and l{k} <= lb then case when c{k} >= close then 1 else -1 end when h{k} >= ub then 1 when l{k} <= lb then -1" for k in (1, 2, 3))


@query(B + f", {_TB} select symbol, ts, case {_HIT} else 0 end as label from c")
def g08_triple_barrier(spark, d):
    """First of an upper and a lower barrier met in three bars; a bar that meets both is decided by its close."""
    df = _true_range(_bars(spark, d)).withColumns({"atr": roll(F.avg, "tr", 21)} | {f"{c[0]}{k}": lead(c, k) for k in (1, 2, 3) for c in ("high", "low", "close")}).where("atr is not null")
    c, up, low = F.col("close"), F.col("close") + 2 * F.col("atr"), F.col("close") - 2 * F.col("atr")
    out = F.lit(0)
    for k in (3, 2, 1):
        over, under = F.col(f"h{k}") >= up, F.col(f"l{k}") <= low
        out = F.when(over & under, F.when(F.col(f"c{k}") >= c, 1).otherwise(-1)).when(over, 1).when(under, -1).otherwise(out)
    return df.select("symbol", "ts", out.alias("label"))


@query(B + f"select symbol, ts, sign(lead(close) {ORD} - lead(open) {ORD})::int as net, " + ", ".join(f"round(ln(lead(close, {h}) {ORD} / close), 6) as fwd_{h}" for h in (1, 3, 6, 12)) + " from x")
def g11_forward_returns(spark, d):
    net = F.signum(lead("close") - lead("open")).cast("int")
    return _bars(spark, d).select("symbol", "ts", net.alias("net"), *(F.round(F.log(lead("close", h) / F.col("close")), 6).alias(f"fwd_{h}") for h in (1, 3, 6, 12)))


@query(B + f", v as (select symbol, ts, stddev_samp(ret) {_over(20)} as vol, avg(close) {_over(10)} as fast, avg(close) {_over(40)} as slow, count(ret) {_over(20)} as n from x) select symbol, ts, round(case when n = 20 then lead(vol, 6) {ORD} end, 6) as vol_target, (fast > slow)::int as trend from v")
def g12_volatility_target(spark, d):
    v = _ret(spark, d).select("symbol", "ts", F.stddev_samp("ret").over(trailing(20)).alias("vol"), F.avg("close").over(trailing(10)).alias("fast"), F.avg("close").over(trailing(40)).alias("slow"), F.count("ret").over(trailing(20)).alias("n"))
    return v.select("symbol", "ts", F.round(F.when(F.col("n") == 20, lead("vol", 6)), 6).alias("vol_target"), (F.col("fast") > F.col("slow")).cast("int").alias("trend"))


_15 = f"with {source.sql('15 minutes', 'f')}, p as (select symbol, epoch_us(ts) // 28800000000 * 28800000000 as period, arg_min(open, ts) as open, arg_max(close, ts) as close, max(high) as high, min(low) as low, arg_max(epoch_us(ts), (high, -epoch_us(ts))) as at_high, arg_min(epoch_us(ts), (low, epoch_us(ts))) as at_low, count(*) as n from f group by 1, 2) "


@query(_15 + "select symbol, period, case when at_high < at_low then 'high' when at_low < at_high then 'low' else 'same' end as first_extreme, round(case when high > low then abs(close - open) / (high - low) end, 6) as efficiency, n from p")
def g13_intrabar(spark, d):
    f = source.bars(spark, d, "15 minutes").withColumn("period", R.period_start("ts", 8)).withColumn("at", micros("ts"))
    p = f.groupBy("symbol", "period").agg(F.min_by("open", "at").alias("open"), F.max_by("close", "at").alias("close"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("at", F.struct("high", -F.col("at"))).alias("ah"), F.min_by("at", F.struct("low", "at")).alias("al"), F.count("*").alias("n"))
    first = F.when(F.col("ah") < F.col("al"), "high").when(F.col("al") < F.col("ah"), "low").otherwise("same")
    return p.select("symbol", "period", first.alias("first_extreme"), F.round(F.when(F.col("high") > F.col("low"), F.try_divide(F.abs(F.col("close") - F.col("open")), F.col("high") - F.col("low"))), 6).alias("efficiency"), "n")


@query(B + f", t as (select symbol, ts, ret, case when count(ret) {_over(21)} >= 10 then least(greatest(stddev_samp(ret) {_over(21)}, 0.01), 2.0) end as thr from x), f as (select *, coalesce(thr, first_value(thr ignore nulls) over (partition by symbol order by ts rows between current row and unbounded following)) as thr2 from t) select symbol, ts, round(thr2, 6) as threshold, case when lead(ret) {ORD} > thr2 then 2 when lead(ret) {ORD} < -thr2 then 0 when lead(ret) {ORD} is null then null else 1 end as signal from f")
def g19_adaptive_threshold(spark, d):
    w = trailing(21)
    t = _ret(spark, d).withColumn("thr", F.when(F.count("ret").over(w) >= 10, clip(F.stddev_samp("ret").over(w), 0.01, 2.0)))
    t = t.withColumn("thr", F.coalesce("thr", F.first("thr", True).over(ordered().rowsBetween(0, Window.unboundedFollowing))))
    nxt = lead("ret")
    return t.select("symbol", "ts", F.round("thr", 6).alias("threshold"), F.when(nxt > F.col("thr"), 2).when(nxt < -F.col("thr"), 0).when(nxt.isNotNull(), 1).alias("signal"))


# ---- helper models ------------------------------------------------------------------------------------------------------


@query(f"""with recursive {source.sql()}, x as (select symbol, ts, coalesce(ln(close / lag(close) {ORD}), 0) as ret, row_number() {ORD} as k from bars), r as (select symbol, ts, k, ret, 0.25::double as var from x where k = 1 union all select x.symbol, x.ts, x.k, x.ret, 0.05 + 0.1 * r.ret * r.ret + 0.85 * r.var from r join x on x.symbol = r.symbol and x.k = r.k + 1) select symbol, ts, round(sqrt(var), 6) as volatility from r""")
def h01_garch(spark, d):
    from chronoloom.operators.scan import affine_scan

    x = _ret(spark, d).select("symbol", "ts", F.coalesce("ret", F.lit(0.0)).alias("ret"))
    x = x.withColumn("before", lag("ret"))
    first = F.col("before").isNull()
    df = affine_scan(x, ["symbol"], "ts", {"var": (F.when(first, 0.0).otherwise(0.85), F.when(first, 0.25).otherwise(0.05 + 0.1 * F.col("before") * F.col("before")))})
    return _pick(df, ("volatility", F.sqrt("var")))


def _fold(spark, d, made, outputs: str, value=None):
    fold, start = made
    rows = _ret(spark, d).select("symbol", "ts", (value if value is not None else F.col("ret")).alias("value"))
    return scan(rows, ["symbol"], "ts", fold, start, outputs).drop("value")


@query()
def h03_egarch(spark, d):
    return _fold(spark, d, folds.egarch(-0.1, 0.15, -0.05, 0.95), "volatility double, shock double, zscore double, shock_mean double")


@query()
def h06_kalman(spark, d):
    return _fold(spark, d, folds.kalman(), "level double, slope double, innovation double", F.log("close"))


@query(f"with recursive {source.sql()}, x as (select symbol, ts, ln(close / lag(close) {ORD}) as v, row_number() {ORD} as k from bars), r as (select symbol, ts, k, 0.0::double as up, 0.0::double as dn, -1000000 as last, 0 as change from x where k = 1 union all select q.symbol, q.ts, q.k, case when hit then 0 else u end, case when hit then 0 else w end, case when hit then q.k - 1 else last end, hit::int from (select *, (u > 6 or w > 6) and k - 1 - last >= 5 as hit from (select x.symbol, x.ts, x.k, r.last, greatest(0, r.up + x.v - 0.5) as u, greatest(0, r.dn - x.v - 0.5) as w from r join x on x.symbol = r.symbol and x.k = r.k + 1)) q) select symbol, ts, change from r")
def h07_cusum(spark, d):
    return _fold(spark, d, folds.cusum(6.0, 0.5, 5), "change int, since int").select("symbol", "ts", "change")


@query(B + f", l as (select symbol, ts, ln(close) as y, lag(ln(close)) {ORD} as y1 from x), m as (select symbol, ts, y, count(y1) {_over(62, 1)} as n, avg(y) {_over(62, 1)} as my, avg(y1) {_over(62, 1)} as mx, avg(y * y1) {_over(62, 1)} as mxy, avg(y1 * y1) {_over(62, 1)} as mxx from l) select symbol, ts, round(case when n = 62 then least(greatest(coalesce((mxy - mx * my) / nullif(mxx - mx * mx, 0), 0.9), 0.01), 0.999) else 0.9 end, 4) as phi from m")
def h08_mean_reversion(spark, d):
    w = trailing(62, 1)
    b = _bars(spark, d).withColumn("y", F.log("close")).withColumn("y1", lag(F.log("close")))
    y, x = F.col("y"), F.col("y1")
    slope = div(F.avg(x * y).over(w) - F.avg(x).over(w) * F.avg(y).over(w), nz(F.avg(x * x).over(w) - F.pow(F.avg(x).over(w), 2)))
    return _pick(b, ("phi", F.when(F.count(x).over(w) == 62, clip(F.coalesce(slope, F.lit(0.9)), 0.01, 0.999)).otherwise(F.lit(0.9))), digits=4)


@query()
def h10_online_change_points(spark, d):
    return _fold(spark, d, folds.bocpd(), "change_probability double, run_length int")


@query(B + f"select symbol, ts, round((close - avg(close) {UPTO}) / sqrt(greatest(var_pop(close) {UPTO}, 1e-10)), 5) as z from x")
def h16_running_zscore(spark, d):
    z = (F.col("close") - F.avg("close").over(upto())) / F.sqrt(F.greatest(F.var_pop("close").over(upto()), F.lit(1e-10)))
    return _pick(_bars(spark, d), ("z", z), digits=5)


# ---- feature scoring ----------------------------------------------------------------------------------------------------


@query(B + "select symbol, ts, round(sign(close - open) * ln(1 + abs(close - open)), 6) as body_log from x")
def j02_signed_log(spark, d):
    body = F.col("close") - F.col("open")
    return _pick(_bars(spark, d), ("body_log", F.signum(body) * F.log1p(F.abs(body))))


_IC = f"""s as (select symbol, ts, ret, volume, close - open as body, lead(ret) {ORD} as target from x), k as (select * from s where ret is not null and target is not null),
u as (select symbol, ts, target, 'body' as feature, body as v from k union all select symbol, ts, target, 'ret', ret from k union all select symbol, ts, target, 'volume', volume from k)"""


def _ic_rows(spark, d):
    s = _ret(spark, d).select("symbol", "ts", "ret", "volume", (F.col("close") - F.col("open")).alias("body"), lead("ret").alias("target")).where("ret is not null and target is not null")
    return s.unpivot(["symbol", "ts", "target"], ["body", "ret", "volume"], "feature", "v")


@query(B + f", {_IC}, r as (select feature, rank() over (partition by feature order by v) + (count(*) over (partition by feature, v) - 1) / 2.0 as rv, rank() over (partition by feature order by target) + (count(*) over (partition by feature, target) - 1) / 2.0 as rt from u) select feature, round(corr(rv, rt), 6) as ic from r group by feature")
def j09_information_coefficient(spark, d):
    r = _ic_rows(spark, d).select("feature", R.average_rank("v", "feature").alias("rv"), R.average_rank("target", "feature").alias("rt"))
    return r.groupBy("feature").agg(F.round(F.corr("rv", "rt"), 6).alias("ic"))


@query(B + f", {_IC}, w as (select feature, v, target, cast(ts as date) as block from u), r as (select feature, block, rank() over (partition by feature, block order by v) + (count(*) over (partition by feature, block, v) - 1) / 2.0 as rv, rank() over (partition by feature, block order by target) + (count(*) over (partition by feature, block, target) - 1) / 2.0 as rt from w), c as (select feature, block, (avg(rv * rt) - avg(rv) * avg(rt)) / nullif(stddev_pop(rv) * stddev_pop(rt), 0) as ic from r group by all) select feature, round(case when stddev_samp(ic) <= 1e-10 then sign(avg(ic)) * 10 else avg(ic) / stddev_samp(ic) end, 6) as icir, count(ic) as n_blocks from c group by feature")
def j10_icir(spark, d):
    w = _ic_rows(spark, d).withColumn("block", F.to_date("ts"))
    r = w.select("feature", "block", R.average_rank("v", "feature", "block").alias("rv"), R.average_rank("target", "feature", "block").alias("rt"))
    ic = F.try_divide(F.avg(F.col("rv") * F.col("rt")) - F.avg("rv") * F.avg("rt"), F.nullif(F.stddev_pop("rv") * F.stddev_pop("rt"), F.lit(0.0)))
    c = r.groupBy("feature", "block").agg(ic.alias("ic"))
    return c.groupBy("feature").agg(F.round(F.when(F.stddev_samp("ic") <= 1e-10, F.signum(F.avg("ic")) * 10).otherwise(F.try_divide(F.avg("ic"), F.stddev_samp("ic"))), 6).alias("icir"), F.count("ic").alias("n_blocks"))


@query(B + "select count(ret) as n, round(avg(ret), 6) as mean, round(stddev_samp(ret), 6) as sd, round(min(ret), 6) as lo, round(max(ret), 6) as hi, round(quantile_cont(ret, 0.5), 6) as med from x")
def j13_distribution(spark, d):
    return _ret(spark, d).agg(F.count("ret").alias("n"), F.round(F.avg("ret"), 6).alias("mean"), F.round(F.stddev_samp("ret"), 6).alias("sd"), F.round(F.min("ret"), 6).alias("lo"), F.round(F.max("ret"), 6).alias("hi"), F.round(F.median("ret"), 6).alias("med"))
