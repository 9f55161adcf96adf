"""Events, further labels and calendar bars (C, D, G, I) as queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoloom.functions import signals
from chronoloom.functions.windows import lag, lead, ln, ordered, quotient, roll, trailing
from chronoloom.operators import relational as R
from chronoloom.operators.grid import is_open
from chronoloom.plans.relational_queries import Query
from chronoloom.sources import bars as source
from chronoloom.sources.tables import load, micros, seconds

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
B = f"with {source.sql()} "
ORD = "over (partition by symbol order by ts)"


def query(sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def _bars(spark, d, width="1 hour"):
    return source.bars(spark, d, width)


@query("select row_id, epoch_ms(\"timestamp\") as ms, strftime(\"timestamp\", '%Y-%m-%d') as day, (hour(\"timestamp\") * 60 + minute(\"timestamp\"))::int as minute_of_day from raw_bars where \"timestamp\" is not null")
def b01_timestamp_normalisation(spark, d):
    r = load(spark, d, "raw_bars", "row_id", "timestamp").where("timestamp is not null")
    return r.select("row_id", F.floor(micros("timestamp") / 1000).alias("ms"), F.date_format("timestamp", "yyyy-MM-dd").alias("day"), (F.hour("timestamp") * 60 + F.minute("timestamp")).cast("int").alias("minute_of_day"))


@query("select l_orderkey, l_linenumber from lineitem where l_quantity between 5 and 7 and l_discount between 0.02 and 0.04")
def b04_inclusive_range(spark, d):
    return load(spark, d, "lineitem", "l_orderkey", "l_linenumber", where=F.col("l_quantity").between(5, 7) & F.col("l_discount").between(0.02, 0.04))


@query("select name, in_features, in_labels from (values ('asset_id', 1, 1), ('bar_in_batch_norm', 1, 0), ('bar_pos', 0, 1), ('batch_id', 1, 1), ('close', 1, 1), ('target_4class', 1, 1), ('timestamp', 1, 1)) t(name, in_features, in_labels)")
def b08_schema_intersection(spark, d):
    a, b = (set(load(spark, d, t).columns) for t in ("feature_batches", "label_bars"))
    shown = {"asset_id", "bar_in_batch_norm", "bar_pos", "batch_id", "close", "target_4class", "timestamp"} & (a | b)
    return spark.createDataFrame([(n, int(n in a), int(n in b)) for n in sorted(shown)], "name string, in_features int, in_labels int")


@query("select row_id, case when not isnan(close) then close end as close, bb_middle from label_bars")
def b09_policy_exclusion(spark, d):
    """Columns are left out by name patterns per stage: here the bands and everything about targets."""
    from fnmatch import fnmatch

    df = load(spark, d, "label_bars")
    banned = ("bb_upper", "bb_lower", "bb_position*", "target_*", "available_at", "batch_id", "bar_pos", "asset_id", "timestamp")
    return df.drop(*(c for c in df.columns if any(fnmatch(c, p) for p in banned)))


@query("select row_id, coalesce(is_label_half, false) as is_label_half, count(*) over (partition by asset_id, batch_id) as rows_in_batch, coalesce(minutes_since_prev_real_bar, 0) as minutes_since from feature_batches")
def b17_metadata_defaults(spark, d):
    f = load(spark, d, "feature_batches", "row_id", "asset_id", "batch_id", "is_label_half", "minutes_since_prev_real_bar")
    return f.select("row_id", F.coalesce("is_label_half", F.lit(False)).alias("is_label_half"), F.count("*").over(Window.partitionBy("asset_id", "batch_id")).alias("rows_in_batch"), F.coalesce("minutes_since_prev_real_bar", F.lit(0.0)).alias("minutes_since"))


@query(B + ", f as (select symbol, ts, 1 as flag from bars where volume >= 4) select b.symbol, b.ts, coalesce(f.flag, 0) as flag from bars b left join f on b.symbol = f.symbol and b.ts = f.ts")
def c12_flag_join(spark, d):
    b = _bars(spark, d)
    return b.select("symbol", "ts").join(b.where("volume >= 4").select("symbol", "ts", F.lit(1).alias("flag")), ["symbol", "ts"], "left").fillna(0, ["flag"])


@query('select f.asset_id, count(*) as n, count(l.asset_id) as n_found, count(*) - count(l.asset_id) as n_missing from feature_batches f left join (select distinct asset_id, "timestamp" from label_bars) l on f.asset_id = l.asset_id and f."timestamp" = l."timestamp" group by 1')
def c19_cache_join_audit(spark, d):
    f = load(spark, d, "feature_batches", "asset_id", "timestamp")
    cache = load(spark, d, "label_bars", "asset_id", "timestamp").distinct().withColumn("found", F.lit(1))
    return f.join(cache, ["asset_id", "timestamp"], "left").groupBy("asset_id").agg(F.count("*").alias("n"), F.count("found").alias("n_found"), (F.count("*") - F.count("found")).alias("n_missing"))


@query(B + ", w as (select symbol, epoch_us(ts) // 28800000000 as batch, max(high) as hi, min(low) as lo from bars group by all) select b.symbol, b.ts, round(w.hi / b.close - 1, 9) as up from bars b join w on b.symbol = w.symbol and epoch_us(b.ts) // 28800000000 + 1 = w.batch")
def c23_window_lookup(spark, d):
    batch = F.floor(micros("ts") / 28_800_000_000)
    w = _bars(spark, d).groupBy("symbol", (batch - 1).alias("batch")).agg(F.max("high").alias("hi"))
    return _bars(spark, d).withColumn("batch", batch).join(w, ["symbol", "batch"]).select("symbol", "ts", F.round(F.col("hi") / F.col("close") - 1, 9).alias("up"))


@query(B + "select symbol, time_bucket(interval 8 hours, ts) as ts, arg_min(open, ts) as open, max(high) as high, min(low) as low, arg_max(close, ts) as close, min(epoch_ms(ts)) as first_ms from bars group by 1, 2")
def d02_resample_without_volume(spark, d):
    g = _bars(spark, d).groupBy("symbol", F.window("ts", "8 hours").alias("w"))
    return g.agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.min(F.floor(micros("ts") / 1000)).alias("first_ms")).select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "first_ms")


@query(B + "select symbol, time_bucket(interval 8 hours, ts) as ts, round(avg(open), 9) as buy, round(avg(close), 9) as sell, round(avg(open) / avg(close), 9) as ratio from bars group by 1, 2")
def d04_mean_resample(spark, d):
    g = _bars(spark, d).groupBy("symbol", F.window("ts", "8 hours").alias("w")).agg(F.avg("open").alias("buy"), F.avg("close").alias("sell"))
    return g.select("symbol", F.col("w.start").alias("ts"), F.round("buy", 9).alias("buy"), F.round("sell", 9).alias("sell"), F.round(F.try_divide("buy", "sell"), 9).alias("ratio"))


_OPEN = "(f.calendar_id is distinct from 'session_week' or (isodow(s) <= 5 and hour(s) <= 20) or ((isodow(s) <= 4 or isodow(s) = 7) and hour(s) >= 22))"


@query(f"""with r as (select r.source_id, step_seconds, make_timestamp((epoch_us("timestamp") // 1000000) // step_seconds * step_seconds * 1000000) as s, f.calendar_id, high, low, volume from raw_bars r join feeds f on r.source_id = f.source_id),
o as (select source_id, step_seconds, s, max(high) as high, min(low) as low, max(volume) as volume from r f where {_OPEN} group by all)
select source_id, date_trunc('hour', s) as hour, count(*) as n_slots, max(high) as high, min(low) as low, round(sum(volume), 4) as volume, count(*) * max(step_seconds) = 3600 as is_complete from o group by 1, 2""")
def d06_canonical_resample(spark, d):
    feeds = load(spark, d, "feeds", "source_id", "step_seconds", "calendar_id")
    r = load(spark, d, "raw_bars", "source_id", "timestamp", "high", "low", "volume").where("timestamp is not null").join(feeds, "source_id")
    slot = (F.floor(seconds("timestamp") / F.col("step_seconds")) * F.col("step_seconds")).cast("long")
    o = r.withColumn("slot", slot).where(is_open(F.col("slot"), F.col("calendar_id"))).groupBy("source_id", "step_seconds", "slot").agg(F.max("high").alias("high"), F.min("low").alias("low"), F.max("volume").alias("volume"))
    hour = F.timestamp_seconds(F.floor(F.col("slot") / 3600) * 3600).cast("timestamp_ntz")
    return o.groupBy("source_id", hour.alias("hour")).agg(F.count("*").alias("n_slots"), F.max("high").alias("high"), F.min("low").alias("low"), F.round(F.sum("volume"), 4).alias("volume"), (F.count("*") * F.max("step_seconds") == 3600).alias("is_complete"))


@query(B + ", p as (select symbol, ts, close, (epoch_us(ts) - 14400000000) // 28800000000 as c_batch, min(epoch_us(ts)) over (partition by symbol) as first from bars) select symbol, ts, dense_rank() over (partition by symbol order by c_batch) as c_id from p where epoch_us(ts) >= first // 28800000000 * 28800000000 + 14400000000")
def d12_shifted_family(spark, d):
    first = F.min(micros("ts")).over(Window.partitionBy("symbol"))
    p = _bars(spark, d).select("symbol", "ts", R.period_start("ts", 8, 14_400_000_000).alias("period"), first.alias("first"))
    kept = p.where(micros("ts") >= F.floor(F.col("first") / 28_800_000_000) * 28_800_000_000 + 14_400_000_000)
    return kept.select("symbol", "ts", F.dense_rank().over(Window.partitionBy("symbol").orderBy("period")).cast("long").alias("c_id"))


@query("select o_orderkey as k, 'order' as kind from orders union all select l_orderkey, 'line' from lineitem")
def d28_vertical_concat(spark, d):
    return load(spark, d, "orders", "o_orderkey").select(F.col("o_orderkey").alias("k"), F.lit("order").alias("kind")).union(load(spark, d, "lineitem", "l_orderkey").select("l_orderkey", F.lit("line")))


@query("select asset_id, batch_id, count(*) as n, round(last(close order by \"timestamp\", row_id), 9) as last_close from feature_batches where close is not null and not isnan(close) group by 1, 2")
def d31_partitioned_frames(spark, d):
    f = load(spark, d, "feature_batches", "asset_id", "batch_id", "timestamp", "row_id", "close").where("close is not null")
    return f.groupBy("asset_id", "batch_id").agg(F.count("*").alias("n"), F.round(F.max_by("close", F.struct("timestamp", "row_id")), 9).alias("last_close"))


_H = f"with {source.sql()}, {source.sql('15 minutes', 'f')} "


@query(_H + ", w as (select symbol, epoch_us(ts) // 28800000000 as batch, row_number() over (partition by symbol, epoch_us(ts) // 28800000000 order by ts) as pos, high, low from f), e as (select symbol, ts, close, epoch_us(ts) // 28800000000 as batch, (epoch_us(ts) % 28800000000) // 900000000 as pos from bars) select e.symbol, e.ts, round(avg(w.high) / min(e.close) - 1, 9) as up, round(1 - avg(w.low) / min(e.close), 9) as down from e join w on e.symbol = w.symbol and e.batch = w.batch and w.pos > e.pos group by 1, 2")
def g02_entry_window_distances(spark, d):
    batch = F.floor(micros("ts") / 28_800_000_000)
    f = _bars(spark, d, "15 minutes").withColumn("batch", batch)
    w = f.select("symbol", "batch", F.row_number().over(Window.partitionBy("symbol", "batch").orderBy("ts")).alias("pos"), "high", "low")
    path = w.groupBy("symbol", "batch").agg(F.array_sort(F.collect_list(F.struct("pos", "high", "low"))).alias("w"))  # at most 32 bars
    e = _bars(spark, d).select("symbol", "ts", "close", batch.alias("batch"), F.floor((micros("ts") % 28_800_000_000) / 900_000_000).alias("epos"))
    ahead = e.join(path, ["symbol", "batch"]).withColumn("a", F.filter("w", lambda x: x["pos"] > F.col("epos"))).where("size(a) > 0")
    mean = lambda k: F.aggregate("a", F.lit(0.0), lambda s, x: s + x[k]) / F.size("a")
    return ahead.select("symbol", "ts", F.round(mean("high") / F.col("close") - 1, 9).alias("up"), F.round(1 - mean("low") / F.col("close"), 9).alias("down"))


_G02 = SQL["g02_entry_window_distances"]


@query(_G02)
def g03_suffix_distances(spark, d):
    """The same distances the fast way: means of all suffixes of a window are made once, entries look theirs up by position."""
    batch = F.floor(micros("ts") / 28_800_000_000)
    f = _bars(spark, d, "15 minutes").withColumn("batch", batch)
    ahead = Window.partitionBy("symbol", "batch").orderBy("ts").rowsBetween(0, Window.unboundedFollowing)
    suffix = f.select("symbol", "batch", F.row_number().over(Window.partitionBy("symbol", "batch").orderBy("ts")).alias("pos"), F.avg("high").over(ahead).alias("high"), F.avg("low").over(ahead).alias("low"))
    e = _bars(spark, d).select("symbol", "ts", "close", batch.alias("batch"), (F.floor((micros("ts") % 28_800_000_000) / 900_000_000) + 1).cast("int").alias("pos"))
    return e.join(suffix, ["symbol", "batch", "pos"]).select("symbol", "ts", F.round(F.col("high") / F.col("close") - 1, 9).alias("up"), F.round(1 - F.col("low") / F.col("close"), 9).alias("down"))


_G9 = "v as (select *, avg(ln(high / low)) over (partition by symbol order by ts rows between 20 preceding and current row) as vol, count(*) over (partition by symbol order by ts rows between 20 preceding and current row) as n, lead(high) over (partition by symbol order by ts) as nh, lead(low) over (partition by symbol order by ts) as nl, lead(close) over (partition by symbol order by ts) as nc from bars)"


@query(B + f", {_G9} select symbol, ts, case when nh >= close * (1 + 1.5 * vol) and nl <= close * (1 - vol) then case when nc > close then 2 else 0 end when nh >= close * (1 + 1.5 * vol) then 2 when nl <= close * (1 - vol) then 0 when nh is null then null else 1 end as label from v where n = 21")
def g09_range_barriers(spark, d):
    v = _bars(spark, d).withColumns({"vol": roll(F.avg, ln(quotient("high", "low")), 21), "nh": lead("high"), "nl": lead("low"), "nc": lead("close")}).where("vol is not null")
    c = F.col("close")
    up, down = F.col("nh") >= c * (1 + 1.5 * F.col("vol")), F.col("nl") <= c * (1 - F.col("vol"))
    return v.select("symbol", "ts", F.when(up & down, F.when(F.col("nc") > c, 2).otherwise(0)).when(up, 2).when(down, 0).when(F.col("nh").isNotNull(), 1).alias("label"))


_G10 = "w as (select symbol, epoch_us(ts) // 28800000000 as batch, epoch_us(ts) as at, high, low from f), e as (select symbol, ts, close, epoch_us(ts) // 28800000000 + 1 as batch, close * 1.5 as ub, close * 0.5 as lb from bars), h as (select e.symbol, e.ts, min(case when w.high >= ub then w.at end) as u, min(case when w.low <= lb then w.at end) as l from e join w on e.symbol = w.symbol and e.batch = w.batch group by 1, 2)"


@query(_H + f", {_G10} select symbol, ts, case when u is null and l is null then 'terminal' when l is null or u < l then 'upper' when u is null or l < u then 'lower' else 'both_same_bar' end as first_hit from h")
def g10_first_hit_in_window(spark, d):
    f = _bars(spark, d, "15 minutes").select("symbol", F.floor(micros("ts") / 28_800_000_000).alias("batch"), F.struct(micros("ts").alias("at"), "high", "low").alias("x"))
    path = f.groupBy("symbol", "batch").agg(F.collect_list("x").alias("w"))  # at most 32 bars
    e = _bars(spark, d).select("symbol", "ts", "close", (F.floor(micros("ts") / 28_800_000_000) + 1).alias("batch")).join(path, ["symbol", "batch"])
    first = lambda keep: F.array_min(F.transform(F.filter("w", keep), lambda x: x["at"]))
    u, l = first(lambda x: x["high"] >= F.col("close") * 1.5), first(lambda x: x["low"] <= F.col("close") * 0.5)  # noqa: E741
    h = e.select("symbol", "ts", u.alias("u"), l.alias("l"))
    return h.select("symbol", "ts", F.when(F.col("u").isNull() & F.col("l").isNull(), "terminal").when(F.col("l").isNull() | (F.col("u") < F.col("l")), "upper").when(F.col("u").isNull() | (F.col("l") < F.col("u")), "lower").otherwise("both_same_bar").alias("first_hit"))


_INTRA = "p as (select symbol, epoch_us(ts) // 28800000000 as period, arg_min(open, ts) as o, arg_max(close, ts) as c, max(high) as h, min(low) as l, arg_max(epoch_us(ts), (high, -epoch_us(ts))) as ah, arg_min(epoch_us(ts), (low, epoch_us(ts))) as al from f group by 1, 2), q as (select *, c / o - 1 as net, case when h > l then abs(c - o) / (h - l) end as er from p)"


def _intrabar(spark, d):
    f = _bars(spark, d, "15 minutes").withColumns({"period": F.floor(micros("ts") / 28_800_000_000), "at": micros("ts")})
    p = f.groupBy("symbol", "period").agg(F.min_by("open", "at").alias("o"), F.max_by("close", "at").alias("c"), F.max("high").alias("h"), F.min("low").alias("l"), F.max_by("at", F.struct("high", -F.col("at"))).alias("ah"), F.min_by("at", F.struct("low", "at")).alias("al"))
    return p.withColumns({"net": F.col("c") / F.col("o") - 1, "er": F.when(F.col("h") > F.col("l"), F.try_divide(F.abs(F.col("c") - F.col("o")), F.col("h") - F.col("l")))})


@query(_H + f", {_INTRA}, k as (select symbol, period, case when abs(net) <= 0.001 then 3 when net > 0 and al < ah and er < 0.35 then 2 when net < 0 and ah < al and er < 0.35 then 4 when net > 0 and er >= 0.224 and abs(net) >= 0.0152 then 0 when net > 0 then 1 when er >= 0.224 and abs(net) >= 0.0152 then 6 else 5 end as label from q) select symbol, period, lead(label) over (partition by symbol order by period) as label from k")
def g17_path_label(spark, d):
    """Seven classes of how the period moved; retracement is one minus the efficiency of its range, the threshold 0.65."""
    net, er, up = F.col("net"), F.col("er"), F.col("net") > 0
    strong = (er >= 0.224) & (F.abs(net) >= 0.0152)
    label = F.when(F.abs(net) <= 0.001, 3).when(up & (F.col("al") < F.col("ah")) & (er < 0.35), 2).when((net < 0) & (F.col("ah") < F.col("al")) & (er < 0.35), 4).when(up & strong, 0).when(up, 1).when(strong, 6).otherwise(5)
    k = _intrabar(spark, d).select("symbol", "period", label.alias("label"))
    return k.select("symbol", "period", F.lead("label").over(Window.partitionBy("symbol").orderBy("period")).alias("label"))


@query(_H + f", {_INTRA} select symbol, period, lead(case when ah < al then 1 when al < ah then 0 end) over (partition by symbol order by period) as high_first, lead(least(ah, al) - period * 28800000000) over (partition by symbol order by period) // 900000000 as bars_to_extreme from q")
def g15_first_extreme(spark, d):
    w = Window.partitionBy("symbol").orderBy("period")
    q = _intrabar(spark, d)
    return q.select("symbol", "period", F.lead(F.when(F.col("ah") < F.col("al"), 1).when(F.col("al") < F.col("ah"), 0)).over(w).alias("high_first"), F.floor(F.lead(F.least("ah", "al") - F.col("period") * 28_800_000_000).over(w) / 900_000_000).alias("bars_to_extreme"))


_Z = """z as (select *, avg(close) over (partition by symbol order by ts rows between 19 preceding and current row) as m, stddev_samp(close) over (partition by symbol order by ts rows between 19 preceding and current row) as s, count(*) over (partition by symbol order by ts rows between 19 preceding and current row) as n from f),
t as (select symbol, epoch_us(ts) // 28800000000 as period, min(case when close > m + 2 * s then epoch_us(ts) end) as u2, min(case when close > m + s then epoch_us(ts) end) as u1, min(case when close < m - s then epoch_us(ts) end) as l1, min(case when close < m - 2 * s then epoch_us(ts) end) as l2, arg_max(close, ts) / arg_min(open, ts) - 1 as net, avg(case when close > m + s then 1.0 else 0.0 end) as a1, avg(case when close > m then 1.0 else 0.0 end) as a0, avg(case when close < m - s then 1.0 else 0.0 end) as b1, arg_max((close - m) / nullif(s, 0), ts) as zc from z where n = 20 group by 1, 2)"""


def _zones(spark, d):
    w = ordered().rowsBetween(-19, 0)
    z = _bars(spark, d, "15 minutes").withColumns({"m": F.avg("close").over(w), "s": F.stddev_samp("close").over(w), "n": F.count("*").over(w)}).where("n = 20").withColumn("at", micros("ts"))
    c, m, s = F.col("close"), F.col("m"), F.col("s")
    when = lambda cond: F.min(F.when(cond, F.col("at")))
    share = lambda cond: F.avg(F.when(cond, 1.0).otherwise(0.0))
    return z.groupBy("symbol", F.floor(F.col("at") / 28_800_000_000).alias("period")).agg(when(c > m + 2 * s).alias("u2"), when(c > m + s).alias("u1"), when(c < m - s).alias("l1"), when(c < m - 2 * s).alias("l2"), (F.max_by("close", "at") / F.min_by("open", "at") - 1).alias("net"), share(c > m + s).alias("a1"), share(c > m).alias("a0"), share(c < m - s).alias("b1"), F.max_by(F.try_divide(c - m, F.nullif(s, F.lit(0.0))), "at").alias("zc"))


@query(_H + f", {_Z}, k as (select symbol, period, case when u1 is not null and not (u2 is not null and (l1 is null or u2 < l1)) and (l1 is null or u1 < l1) then 2 when u2 is not null and (l1 is null or u2 < l1) then 3 when not (l2 is not null and (u1 is null or l2 < u1)) and l1 is not null and (u1 is null or l1 < u1) then 1 when l2 is not null and (u1 is null or l2 < u1) then 0 when net >= 0 then 1 else 2 end as label from t) select symbol, period, lead(label) over (partition by symbol order by period) as label from k")
def g16_trade_setup(spark, d):
    """Order in which bands are first touched; later rules override earlier ones, so the short side wins."""
    u2, u1, l1, l2 = (F.col(x) for x in ("u2", "u1", "l1", "l2"))
    strong_long = l2.isNotNull() & (u1.isNull() | (l2 < u1))
    strong_short = u2.isNotNull() & (l1.isNull() | (u2 < l1))
    label = F.when(~strong_short & u1.isNotNull() & (l1.isNull() | (u1 < l1)), 2).when(strong_short, 3).when(~strong_long & l1.isNotNull() & (u1.isNull() | (l1 < u1)), 1).when(strong_long, 0).when(F.col("net") >= 0, 1).otherwise(2)
    k = _zones(spark, d).select("symbol", "period", label.alias("label"))
    return k.select("symbol", "period", F.lead("label").over(Window.partitionBy("symbol").orderBy("period")).alias("label"))


@query(_H + f", {_Z}, k as (select symbol, period, case when a1 > 0.5 and zc > 1 then 0 when a0 > 0.5 and zc > 0 then 1 when b1 > 0.5 and zc < -1 then 4 when a0 < 0.5 and zc < 0 then 3 else 2 end as label from t) select symbol, period, lead(label) over (partition by symbol order by period) as label from k")
def g14_direction_with_persistence(spark, d):
    a1, a0, b1, zc = (F.col(x) for x in ("a1", "a0", "b1", "zc"))
    label = F.when((a1 > 0.5) & (zc > 1), 0).when((a0 > 0.5) & (zc > 0), 1).when((b1 > 0.5) & (zc < -1), 4).when((a0 < 0.5) & (zc < 0), 3).otherwise(2)
    k = _zones(spark, d).select("symbol", "period", label.alias("label"))
    return k.select("symbol", "period", F.lead("label").over(Window.partitionBy("symbol").orderBy("period")).alias("label"))


_V = "v as (select symbol, ts, close, ln(close / lag(close) over (partition by symbol order by ts)) as ret from bars), s as (select *, stddev_samp(ret) over (partition by symbol order by ts rows between 20 preceding and current row) as s21, stddev_samp(ret) over (partition by symbol order by ts rows between 62 preceding and current row) as s63, count(ret) over (partition by symbol order by ts rows between 62 preceding and current row) as n, avg(close) over (partition by symbol order by ts rows between 20 preceding and current row) as sma from v)"


@query(B + f", {_V} select symbol, ts, case when s21 / nullif(s63, 0) > 1.3 then 4 when close > sma * 1.1 then 0 when close > sma then 1 when close < sma * 0.9 then 3 else 2 end as label from s where n = 63")
def g18_strategy_label(spark, d):
    v = _bars(spark, d).withColumn("ret", F.log(F.try_divide("close", lag("close"))))
    s = v.withColumns({"s21": F.stddev_samp("ret").over(trailing(21)), "s63": F.stddev_samp("ret").over(trailing(63)), "n": F.count("ret").over(trailing(63)), "sma": F.avg("close").over(trailing(21))}).where("n = 63")
    ratio = F.try_divide("s21", F.nullif(F.col("s63"), F.lit(0.0)))
    return s.select("symbol", "ts", F.when(ratio > 1.3, 4).when(F.col("close") > F.col("sma") * 1.1, 0).when(F.col("close") > F.col("sma"), 1).when(F.col("close") < F.col("sma") * 0.9, 3).otherwise(2).alias("label"))


@query()
def i01_ta_events(spark, d):
    return signals.events(signals.indicators(_bars(spark, d)))


@query()
def i02_compact_events(spark, d):
    return signals.compact(signals.events(signals.indicators(_bars(spark, d))))


@query()
def i05_event_diagnostics(spark, d):
    """Activation rate of every flag and share of bars on which it stands against its counterpart, with a grade."""
    ev = i01_ta_events(spark, d)
    flags = [c for c in ev.columns if c not in ("symbol", "ts", "available_ts")]
    clash = {c: F.avg((F.col(c) == 1).cast("int") * (F.col(c.removesuffix("_long") + "_short") == 1).cast("int")) if c.endswith("_long") else F.lit(0.0) for c in flags}
    one = ev.agg(*(F.struct(F.avg(c).alias("rate"), clash[c].alias("conflict")).alias(c) for c in flags))
    rows = one.unpivot([], flags, "flag", "r").select("flag", "r.rate", "r.conflict")
    return rows.withColumn("grade", F.when(F.col("rate") == 0, "dead").when(F.col("rate") > 0.95, "always_on").when(F.col("conflict") > 0.01, "conflicting").otherwise("good"))
