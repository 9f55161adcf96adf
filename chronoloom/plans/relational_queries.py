"""Scans, predicates, joins and aggregations (A, B, C, D) as queries over the driver tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoloom.operators import relational as R
from chronoloom.sources import bars as source
from chronoloom.sources.tables import load, micros

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def _bars(spark, d, width="1 hour"):
    return source.bars(spark, d, width)


def _hours(ts: str = "ts") -> str:
    return f"epoch_us({ts})"


B = f"with {source.sql()} "


@query("select source_id, \"timestamp\", case when not isnan(close) then close end as close, case when not isnan(volume) then volume end as volume from (select *, row_number() over (partition by source_id, \"timestamp\" order by ingested_at desc nulls last, row_id desc) as k from raw_bars where source_id is not null and \"timestamp\" is not null) where k = 1")
def a01_bar_scan(spark, d):
    raw = load(spark, d, "raw_bars", "source_id", "timestamp", "close", "volume", "ingested_at", "row_id").where("source_id is not null and timestamp is not null")
    late = F.struct("ingested_at", "row_id")
    return raw.groupBy("source_id", "timestamp").agg(F.max_by(F.struct("close", "volume"), late).alias("r")).select("source_id", "timestamp", "r.close", "r.volume")


@query("""select f.provider, case f.provider when 'nimbus' then 1 when 'quarry' then 2 else 3 end as source_priority, count(*) as n, min(r."timestamp") as first_ts, max(r."timestamp") as last_ts
from raw_bars r join feeds f on r.source_id = f.source_id group by all""")
def a04_multi_provider_scan(spark, d):
    bars, feeds = load(spark, d, "raw_bars", "source_id", "timestamp"), load(spark, d, "feeds", "source_id", "provider")
    rank = F.when(F.col("provider") == "nimbus", 1).when(F.col("provider") == "quarry", 2).otherwise(3)
    return bars.join(feeds, "source_id").groupBy("provider", rank.alias("source_priority")).agg(F.count("*").alias("n"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"))


@query("""select source_id, "timestamp", round(case when low > 0 and high > 0 then high / low end, 6) as ratio from (select *, row_number() over (partition by source_id, "timestamp" order by row_id) as k from raw_bars where source_id is not null and "timestamp" is not null) where k = 1""")
def a06_single_source(spark, d):
    raw = load(spark, d, "raw_bars", "source_id", "timestamp", "row_id", "high", "low").where("source_id is not null and timestamp is not null")
    first = raw.groupBy("source_id", "timestamp").agg(F.min_by(F.struct("high", "low"), "row_id").alias("r"))
    return first.select("source_id", "timestamp", F.round(F.when((F.col("r.low") > 0) & (F.col("r.high") > 0), F.try_divide("r.high", "r.low")), 6).alias("ratio"))


@query("""select row_id, round(1 / nullif(open, 0), 9) as open, round(1 / nullif(low, 0), 9) as high, round(1 / nullif(high, 0), 9) as low, round(1 / nullif(case when not isnan(close) then close end, 0), 9) as close from raw_bars where open is not null and high is not null and low is not null and close is not null and not isnan(close)""")
def a11_inverse_price(spark, d):
    raw = load(spark, d, "raw_bars", "row_id", "open", "high", "low", "close").dropna()
    inv = {"open": "open", "high": "low", "low": "high", "close": "close"}
    return raw.select("row_id", *(F.round(F.try_divide(F.lit(1.0), F.nullif(F.col(x), F.lit(0.0))), 9).alias(n) for n, x in inv.items()))


@query("""with last as (select source_id, max("timestamp") as m from raw_bars where row_id % 2 = 0 group by source_id)
select r.row_id from raw_bars r join last l on r.source_id = l.source_id where r.row_id % 2 = 1 and r."timestamp" > l.m""")
def a14_append_after_last(spark, d):
    raw = load(spark, d, "raw_bars", "row_id", "source_id", "timestamp")
    stored, new = raw.where("row_id % 2 = 0"), raw.where("row_id % 2 = 1")
    last = stored.groupBy("source_id").agg(F.max("timestamp").alias("m"))
    return new.join(last, "source_id").where("timestamp > m").select("row_id")


@query(B + """, newer as (select symbol, ts, close + 1 as close from bars where ts >= '2024-01-05' and ts <= '2024-01-07')
select symbol, ts, close from bars where not (ts >= '2024-01-05' and ts <= '2024-01-07') union all select symbol, ts, close from newer""")
def a15_replace_window(spark, d):
    b = _bars(spark, d).select("symbol", "ts", "close")
    inside = F.col("ts").between(F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-07").cast("timestamp"))
    replacement = b.where(inside).withColumn("close", F.col("close") + 1)
    return b.where(~inside).unionByName(replacement)


@query("""select r.source_id, bar_interval, count(*) as n_rows, min("timestamp") as first_ts, max("timestamp") as last_ts, count(distinct cast("timestamp" as date)) as n_days from raw_bars r group by all""")
def a20_inventory(spark, d):
    raw = load(spark, d, "raw_bars", "source_id", "bar_interval", "timestamp")
    return raw.groupBy("source_id", "bar_interval").agg(F.count("*").alias("n_rows"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"), F.countDistinct(F.to_date("timestamp")).alias("n_days"))


@query("""select count(*) as n from raw_bars where "timestamp" >= timestamp '2023-09-01' and "timestamp" <= timestamp '2023-09-30 23:59:59'""")
def a21_pruned_range(spark, d):
    raw = load(spark, d, "raw_bars", "timestamp")
    return raw.where((F.col("timestamp") >= F.lit("2023-09-01").cast("timestamp_ntz")) & (F.col("timestamp") <= F.lit("2023-09-30 23:59:59").cast("timestamp_ntz"))).agg(F.count("*").alias("n"))


@query("""select source_id, "timestamp", row_id from (select r.*, row_number() over (partition by r.source_id, "timestamp" order by case when provider = 'nimbus' then 2 else 1 end desc, r.row_id desc) as k from raw_bars r left join feeds f on r.source_id = f.source_id where r.source_id is not null and "timestamp" is not null) where k = 1""")
def b02_dedupe_by_priority(spark, d):
    raw = load(spark, d, "raw_bars", "row_id", "source_id", "timestamp").where("source_id is not null and timestamp is not null")
    feeds = load(spark, d, "feeds", "source_id", "provider")
    ranked = raw.join(feeds, "source_id", "left").withColumn("prio", F.when(F.col("provider") == "nimbus", 2).otherwise(1))
    return R.dedupe_latest(ranked.select("source_id", "timestamp", "row_id", "prio"), ["source_id", "timestamp"], -F.col("prio"), -F.col("row_id")).select("source_id", "timestamp", "row_id")


@query("select l_orderkey, l_linenumber from lineitem where l_shipdate >= '1995-01-01' and l_shipdate < '1996-01-01' and l_quantity between 10 and 20")
def b03_time_range(spark, d):
    li = load(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_shipdate", "l_quantity")
    return li.where("l_shipdate >= '1995-01-01' and l_shipdate < '1996-01-01' and l_quantity between 10 and 20").select("l_orderkey", "l_linenumber")


@query("select l_orderkey, l_linenumber from lineitem where l_orderkey in (select o_orderkey from orders where o_orderpriority = '1-URGENT')")
def b05_in_list_semi_join(spark, d):
    urgent = load(spark, d, "orders", "o_orderkey", "o_orderpriority").where("o_orderpriority = '1-URGENT'")
    return load(spark, d, "lineitem", "l_orderkey", "l_linenumber").join(urgent, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")


@query("select row_id from raw_bars where high is not null and low is not null and volume is not null and close is not null and not isnan(close)")
def b06_drop_null_rows(spark, d):
    return load(spark, d, "raw_bars", "row_id", "high", "low", "volume", "close").dropna(how="any", subset=["high", "low", "volume", "close"]).select("row_id")


@query(B + "select ts, close as T_click__close, volume as T_click__volume from bars where symbol = 'click'")
def b07_prefixed_projection(spark, d):
    return _bars(spark, d).where("symbol = 'click'").select("ts", F.col("close").alias("T_click__close"), F.col("volume").alias("T_click__volume"))


@query("select count(case when not isnan(close) then close end) as close, count(high) as high, count(turnover) as turnover, count(volume) as volume from raw_bars")
def b10_feature_columns(spark, d):
    raw = load(spark, d, "raw_bars", "close", "high", "turnover", "volume")
    return raw.agg(*(F.count(c).alias(c) for c, kind in raw.dtypes if kind == "double"))


@query("""select row_id, case when y_pred = y_true then 'hit' when (y_pred >= 2) = (y_true >= 2) then 'side' else 'miss' end as outcome from stage1_pred_batch_predictions""")
def b11_case_chain(spark, d):
    p = load(spark, d, "stage1_pred_batch_predictions", "row_id", "y_true", "y_pred")
    side = (F.col("y_pred") >= 2) == (F.col("y_true") >= 2)
    return p.select("row_id", F.when(F.col("y_pred") == F.col("y_true"), "hit").when(side, "side").otherwise("miss").alias("outcome"))


_NAMES = {0: "DOWN_BALANCED", 1: "DOWN_EXPANSION", 2: "UP_BALANCED", 3: "UP_EXPANSION"}


@query("select row_id, case target_4class when 0 then 'DOWN_BALANCED' when 1 then 'DOWN_EXPANSION' when 2 then 'UP_BALANCED' when 3 then 'UP_EXPANSION' else 'NONE' end as name from label_bars")
def b12_value_mapping(spark, d):
    table = F.create_map(*(F.lit(x) for kv in _NAMES.items() for x in kv))
    return load(spark, d, "label_bars", "row_id", "target_4class").select("row_id", F.coalesce(F.try_element_at(table, F.col("target_4class")), F.lit("NONE")).alias("name"))


@query("select row_id, greatest(high, low, open) as hi, least(high, low, open) as lo, coalesce(high, open) as first_known from raw_bars")
def b13_horizontal(spark, d):
    return load(spark, d, "raw_bars", "row_id", "high", "low", "open").select("row_id", F.greatest("high", "low", "open").alias("hi"), F.least("high", "low", "open").alias("lo"), F.coalesce("high", "open").alias("first_known"))


@query("select row_id, case when volume is not null then least(greatest(volume, 1.0), 1000.0) end as volume from raw_bars")
def b14_clip(spark, d):
    v = F.col("volume")
    return load(spark, d, "raw_bars", "row_id", "volume").select("row_id", F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(1.0)), F.lit(1000.0))).alias("volume"))


@query("select row_id, (y_true + 4 * (row_id % 2)) % 4 as y4, (y_true % 4) >= 2 as is_up, y_true % 2 = 1 as is_expansion from stage1_pred_batch_predictions")
def b15_class_collapse(spark, d):
    p = load(spark, d, "stage1_pred_batch_predictions", "row_id", "y_true")
    y8 = F.col("y_true") + 4 * (F.col("row_id") % 2)
    return p.select("row_id", (y8 % 4).alias("y4"), (F.col("y_true") % 4 >= 2).alias("is_up"), (F.col("y_true") % 2 == 1).alias("is_expansion"))


@query("select row_id, case when regexp_matches(upper(target_name), 'DOWN|BELOW|BEAR') then 0 when regexp_matches(upper(target_name), 'UP|ABOVE|BULL') then 1 else 0 end as direction from label_bars")
def b16_direction_from_name(spark, d):
    n = F.upper("target_name")
    return load(spark, d, "label_bars", "row_id", "target_name").select("row_id", F.when(n.rlike("DOWN|BELOW|BEAR"), 0).when(n.rlike("UP|ABOVE|BULL"), 1).otherwise(0).alias("direction"))


@query("""with days as (select cast(o_orderdate as date) as day, count(*) as n_orders, sum(o_totalprice) as total from orders group by 1), lines as (select cast(l_shipdate as date) as day, count(*) as n_lines from lineitem group by 1)
select d.day, n_orders, round(total, 2) as total, n_lines from days d left join lines l on d.day = l.day""")
def c01_left_join_sources(spark, d):
    days = load(spark, d, "orders", "o_orderdate", "o_totalprice").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    lines = load(spark, d, "lineitem", "l_shipdate").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.count("*").alias("n_lines"))
    return days.join(lines, "day", "left")


_SLOW = ", slow as (select symbol, ts + interval 8 hour as available, ts as bar_ts, close as slow_close from bars8)"


@query(f"with {source.sql()}, {source.sql('8 hours', 'bars8')}{_SLOW} select b.symbol, b.ts, b.close, s.slow_close, s.bar_ts from bars b asof left join slow s on b.symbol = s.symbol and b.ts >= s.available")
def c02_asof_backward(spark, d):
    slow = _bars(spark, d, "8 hours").select("symbol", F.col("ts").alias("bar_ts"), F.col("close").alias("slow_close"))
    fast = _bars(spark, d).select("symbol", "ts", "close")
    return R.asof_backward(fast, slow, ["symbol"], "ts", ["slow_close", "bar_ts"], F.col("bar_ts") + F.expr("interval 8 hours"))


@query(B + "select symbol, ts, (epoch_us(ts) - max(case when volume > 1 then epoch_us(ts) end) over (partition by symbol order by ts)) // 60000000 as minutes_since from bars")
def c03_minutes_since_real_bar(spark, d):
    w = Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    real = F.last(F.when(F.col("volume") > 1, micros("ts")), True).over(w)
    return _bars(spark, d).select("symbol", "ts", F.floor((micros("ts") - real) / R.MINUTE).alias("minutes_since"))


@query(f"with {source.sql()}, {source.sql('8 hours', 'bars8')} select b.symbol, b.ts, b.close, s.close as native_close from bars b left join bars8 s on b.symbol = s.symbol and b.ts = s.ts")
def c04_native_merge(spark, d):
    slow = _bars(spark, d, "8 hours").select("symbol", "ts", F.col("close").alias("native_close"))
    return _bars(spark, d).select("symbol", "ts", "close").join(slow, ["symbol", "ts"], "left")


@query(f"""with {source.sql()}, {source.sql('8 hours', 'bars8')}, j as (select b.symbol, b.ts, b.close, s.turnover as aux from bars b left join bars8 s on b.symbol = s.symbol and b.ts = s.ts)
select symbol, ts, close, round(last_value(aux ignore nulls) over (partition by symbol order by ts rows unbounded preceding), 6) as aux from j""")
def c05_augmented_sources(spark, d):
    slow = _bars(spark, d, "8 hours").select("symbol", "ts", F.col("turnover").alias("aux"))
    j = _bars(spark, d).select("symbol", "ts", "close").join(slow, ["symbol", "ts"], "left")
    w = Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return j.withColumn("aux", F.round(F.last("aux", True).over(w), 6))


@query(B + "select symbol, ts, dense_rank() over (partition by symbol order by epoch_us(ts) // 28800000000) as batch_id from bars")
def c06_batch_ids(spark, d):
    return _bars(spark, d).select("symbol", "ts", F.dense_rank().over(Window.partitionBy("symbol").orderBy(R.period_start("ts", 8))).cast("long").alias("batch_id"))


@query(f"""with {source.sql()}, {source.sql('15 minutes', 'bars15')}, a as (select symbol, epoch_us(ts) // 28800000000 as p, count(*) as n1 from bars group by all having count(*) = 8), b as (select symbol, epoch_us(ts) // 28800000000 as p, count(*) as n15 from bars15 group by all having count(*) >= 12)
select a.symbol, a.p * 28800000000 as period, n1, n15 from a join b on a.symbol = b.symbol and a.p = b.p""")
def c07_complete_periods(spark, d):
    one = _bars(spark, d).groupBy("symbol", R.period_start("ts", 8).alias("period")).agg(F.count("*").alias("n1")).where("n1 = 8")
    fine = _bars(spark, d, "15 minutes").groupBy("symbol", R.period_start("ts", 8).alias("period")).agg(F.count("*").alias("n15")).where("n15 >= 12")
    return one.join(fine, ["symbol", "period"])


@query(B + """, p as (select symbol, epoch_us(ts) // 28800000000 * 28800000000 as period, max(high) as hi, min(low) as lo from bars group by all)
select a.symbol, a.period, b.hi as next_hi, b.lo as next_lo from p a left join p b on a.symbol = b.symbol and a.period + 28800000000 = b.period""")
def c08_label_window_join(spark, d):
    p = _bars(spark, d).groupBy("symbol", R.period_start("ts", 8).alias("period")).agg(F.max("high").alias("hi"), F.min("low").alias("lo"))
    ahead = p.select("symbol", (F.col("period") - 28_800_000_000).alias("period"), F.col("hi").alias("next_hi"), F.col("lo").alias("next_lo"))
    return p.select("symbol", "period").join(ahead, ["symbol", "period"], "left")


@query(f"with {source.sql('15 minutes')}, {source.sql('1 hour', 'h')} select b.symbol, b.ts, b.close, h.close as hour_close from bars b left join h on b.symbol = h.symbol and date_trunc('hour', b.ts) = h.ts")
def c09_truncated_join(spark, d):
    hour = _bars(spark, d).select("symbol", F.col("ts").alias("hour"), F.col("close").alias("hour_close"))
    fine = _bars(spark, d, "15 minutes").select("symbol", "ts", "close").withColumn("hour", F.date_trunc("hour", "ts"))
    return fine.join(hour, ["symbol", "hour"], "left").drop("hour")


@query(B + "select t.ts, t.close as target, a.close as click, b.close as view from bars t join bars a on t.ts = a.ts and a.symbol = 'click' join bars b on t.ts = b.ts and b.symbol = 'view' where t.symbol = 'purchase'")
def c10_cross_asset_join(spark, d):
    b = _bars(spark, d)
    side = lambda s, n: b.where(F.col("symbol") == s).select("ts", F.col("close").alias(n))
    return side("purchase", "target").join(side("click", "click"), "ts").join(side("view", "view"), "ts")


@query(B + "select ts, coalesce(a.f, 0) as flag_a, coalesce(b.f, 0) as flag_b from (select ts, 1 as f from bars where symbol = 'click' and close > open) a full join (select ts, 1 as f from bars where symbol = 'view' and close > open) b using (ts)")
def c11_full_join_flags(spark, d):
    up = lambda s, n: _bars(spark, d).where((F.col("symbol") == s) & (F.col("close") > F.col("open"))).select("ts", F.lit(1).alias(n))
    return up("click", "flag_a").join(up("view", "flag_b"), "ts", "full").fillna(0, ["flag_a", "flag_b"])


@query("select f.row_id, l.target_name from feature_batches f join (select asset_id, \"timestamp\", batch_id, max(target_name) as target_name from label_bars group by all) l on f.asset_id = l.asset_id and f.\"timestamp\" = l.\"timestamp\" and f.batch_id = l.batch_id")
def c13_feature_label_join(spark, d):
    f = load(spark, d, "feature_batches", "row_id", "asset_id", "timestamp", "batch_id")
    labels = load(spark, d, "label_bars", "asset_id", "timestamp", "batch_id", "target_name").groupBy("asset_id", "timestamp", "batch_id").agg(F.max("target_name").alias("target_name"))
    return f.join(labels, ["asset_id", "timestamp", "batch_id"]).select("row_id", "target_name")


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def c14_anti_join(spark, d):
    return load(spark, d, "customer", "c_custkey").join(load(spark, d, "orders", "o_custkey"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("""with a as (select distinct asset_id from label_bars), b as (select distinct batch_id from label_bars) select asset_id, batch_id from a, b where not exists (select 1 from label_bars l where l.asset_id = a.asset_id and l.batch_id = b.batch_id) and asset_id is not null and batch_id is not null""")
def c15_completeness_matrix(spark, d):
    seen = load(spark, d, "label_bars", "asset_id", "batch_id").dropna().distinct()
    every = seen.agg(F.sort_array(F.collect_set("batch_id")))  # one number per batch of the calendar, for all assets
    expected = seen.select("asset_id").distinct().select("asset_id", F.explode(every.scalar()).alias("batch_id"))
    return expected.join(seen, ["asset_id", "batch_id"], "left_anti")


@query(B + "select a.symbol, round(max(abs(a.close - b.close) / b.close * 100), 6) as max_diff, round(median(abs(a.close - b.close) / b.close * 100), 6) as median_diff from bars a join bars b on a.ts = b.ts and b.symbol = 'click' and a.symbol <> 'click' group by a.symbol")
def c16_overlap_validation(spark, d):
    b = _bars(spark, d).select("symbol", "ts", "close")
    base = b.where("symbol = 'click'").select("ts", F.col("close").alias("base"))
    diff = F.abs(F.col("close") - F.col("base")) / F.col("base") * 100
    return b.where("symbol <> 'click'").join(base, "ts").groupBy("symbol").agg(F.round(F.max(diff), 6).alias("max_diff"), F.round(F.median(diff), 6).alias("median_diff"))


@query(B + """, ev as (select ts + interval 1 hour as s, ts + interval 4 hour as e from bars where symbol = 'click' and close > open), g as (select distinct ts from bars)
select g.ts, case when exists (select 1 from ev where g.ts >= s and g.ts < e) then 1 else 0 end as active from g""")
def c17_interval_coverage(spark, d):
    b = _bars(spark, d)
    events = b.where("symbol = 'click' and close > open").select((F.col("ts") + F.expr("interval 1 hour")).alias("s"), (F.col("ts") + F.expr("interval 4 hours")).alias("e"))
    return R.covered(b.select("ts").distinct(), events, "ts", "s", "e")


@query(B + """, days as (select symbol, cast(ts as date) as day, max(high) as h, min(low) as l, arg_max(close, ts) as c from bars group by all), piv as (select symbol, day, lag((h + l + c) / 3) over (partition by symbol order by day) as pivot from days)
select b.symbol, b.ts, round(p.pivot, 6) as pivot from bars b left join piv p on b.symbol = p.symbol and cast(b.ts as date) = p.day""")
def c18_previous_day_pivot(spark, d):
    b = _bars(spark, d).withColumn("day", F.to_date("ts"))
    days = b.groupBy("symbol", "day").agg(((F.max("high") + F.min("low") + F.max_by("close", "ts")) / 3).alias("p"))
    piv = days.select("symbol", "day", F.round(F.lag("p").over(Window.partitionBy("symbol").orderBy("day")), 6).alias("pivot"))
    return b.join(piv, ["symbol", "day"], "left").select("symbol", "ts", "pivot")


@query("with w as (select action_key, avg(case when y_true = y_pred then 1.0 else 0.0 end) as weight from stage1_pred_batch_predictions where stage_split = 'train' group by 1) select row_id, round(weight, 8) as weight from stage1_pred_batch_predictions p join w using (action_key) where stage_split = 'test'")
def c20_weights_join(spark, d):
    p = load(spark, d, "stage1_pred_batch_predictions", "row_id", "action_key", "stage_split", "y_true", "y_pred")
    w = p.where("stage_split = 'train'").groupBy("action_key").agg(F.round(F.avg((F.col("y_true") == F.col("y_pred")).cast("int")), 8).alias("weight"))
    return p.where("stage_split = 'test'").join(w, "action_key").select("row_id", "weight")


@query("select asset_id, count(*) as n, count(*) - count(distinct \"timestamp\") as n_repeated from label_bars where asset_id is not null group by 1")
def c21_one_to_one_check(spark, d):
    keys = load(spark, d, "label_bars", "asset_id", "timestamp").where("asset_id is not null").groupBy("asset_id", "timestamp").agg(F.count("*").alias("n"))
    return keys.groupBy("asset_id").agg(F.sum("n").alias("n"), (F.sum("n") - F.count("timestamp")).alias("n_repeated"))


@query(B + "select symbol, pos, a, b from (select symbol, row_number() over (partition by symbol order by ts) as pos, close as a from bars) join (select symbol, row_number() over (partition by symbol order by ts desc) as pos, close as b from bars) using (symbol, pos)")
def c22_positional_join(spark, d):
    b, w = _bars(spark, d), Window.partitionBy("symbol")
    up = b.select("symbol", F.row_number().over(w.orderBy("ts")).cast("long").alias("pos"), F.col("close").alias("a"))
    down = b.select("symbol", F.row_number().over(w.orderBy(F.desc("ts"))).cast("long").alias("pos"), F.col("close").alias("b"))
    return up.join(down, ["symbol", "pos"])


def _resample(n, agg):
    return f"with {source.sql()} select symbol, time_bucket(interval 8 hours, ts) as ts, {agg} from bars group by 1, 2"


@query(_resample(8, "arg_min(open, ts) as open, max(high) as high, min(low) as low, arg_max(close, ts) as close, sum(volume) as volume, round(sum(turnover), 4) as turnover, count(*) as n"))
def d01_resample_keep_incomplete(spark, d):
    return R.resample_complete(_bars(spark, d), "8 hours", 8, allow_partial=True).withColumn("turnover", F.round("turnover", 4))


@query(_resample(8, "arg_max(turnover, ts) as turnover, round(avg(open), 6) as open, round(avg(close), 6) as close, min(epoch_ms(ts)) as first_ms"))
def d03_last_and_mean(spark, d):
    g = _bars(spark, d).groupBy("symbol", F.window("ts", "8 hours").alias("w")).agg(F.max_by("turnover", "ts").alias("turnover"), F.round(F.avg("open"), 6).alias("open"), F.round(F.avg("close"), 6).alias("close"), F.min(F.floor(micros("ts") / 1000)).alias("first_ms"))
    return g.select("symbol", F.col("w.start").alias("ts"), "turnover", "open", "close", "first_ms")


@query(_resample(8, "arg_min(open, ts) as open, max(high) as high, min(low) as low, arg_max(close, ts) as close, sum(volume) as volume, round(sum(turnover), 4) as turnover, count(*) as n") + " having count(*) = 8")
def d05_resample_complete(spark, d):
    return R.resample_complete(_bars(spark, d), "8 hours", 8).withColumn("turnover", F.round("turnover", 4))


@query(B + """, s as (select symbol, min(ts) as a, max(ts) as z from bars group by 1), g as (select symbol, unnest(generate_series(a, z, interval 1 hour)) as ts from s), j as (select g.symbol, g.ts, b.close, b.volume from g left join bars b using (symbol, ts))
select symbol, ts, last_value(close ignore nulls) over (partition by symbol order by ts rows unbounded preceding) as close, coalesce(volume, 0) as volume, (volume is null)::int as is_synthetic from j""")
def d07_gap_fill(spark, d):
    b = _bars(spark, d).select("symbol", "ts", "close", "volume")
    span = b.groupBy("symbol").agg(F.min("ts").alias("a"), F.max("ts").alias("z"))
    grid = span.select("symbol", F.explode(F.sequence("a", "z", F.expr("interval 1 hour"))).alias("ts"))
    w = Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    j = grid.join(b, ["symbol", "ts"], "left")
    return j.select("symbol", "ts", F.last("close", True).over(w).alias("close"), F.coalesce("volume", F.lit(0.0)).alias("volume"), F.col("volume").isNull().cast("int").alias("is_synthetic"))


@query("""with e as (select event_type, ts, lag(ts) over (partition by event_type order by ts, event_id) as p, event_id from events), m as (select event_type, ts, event_id, case when ts - p > interval 45 minute then 1 else 0 end as brk from e), s as (select *, sum(brk) over (partition by event_type order by ts, event_id) as session from m)
select event_type, session, min(ts) as first_ts, max(ts) as last_ts, count(*) as n from s group by 1, 2""")
def d08_sessions(spark, d):
    e = load(spark, d, "events", "event_id", "event_type", "ts").withColumn("ts", F.col("ts").cast("timestamp"))
    return R.sessions(e, ["event_type"], "ts", 45).groupBy("event_type", "session").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))


@query(B + "select symbol, ts, (epoch_us(ts) - 345600000000) // 604800000000 * 604800000000 + 345600000000 as week_start, (epoch_us(ts) - 14400000000) // 28800000000 * 28800000000 + 14400000000 as shifted from bars")
def d09_period_start(spark, d):
    return _bars(spark, d).select("symbol", "ts", R.period_start("ts", 168, 345_600_000_000).alias("week_start"), R.period_start("ts", 8, 14_400_000_000).alias("shifted"))


@query(B + """, p as (select symbol, ts, epoch_us(ts) // 28800000000 * 28800000000 as period from bars), q as (select *, row_number() over (partition by symbol, period order by ts) - 1 as bar_in_batch, count(*) over (partition by symbol, period) as actual_rows, epoch_us(ts) - period >= 14400000000 as is_label_half from p)
select symbol, ts, bar_in_batch, actual_rows, round(case when actual_rows > 1 then bar_in_batch / (actual_rows - 1) else 0 end, 8) as bar_in_batch_norm, is_label_half, sum(case when not is_label_half then 1 else 0 end) over (partition by symbol, period)::bigint as n_entry from q""")
def d10_family_metadata(spark, d):
    p = _bars(spark, d).select("symbol", "ts").withColumn("period", R.period_start("ts", 8))
    return R.family_position(p, "period", "ts", 8).drop("period").withColumn("bar_in_batch_norm", F.round("bar_in_batch_norm", 8))


@query("select asset_id, batch_id, count(*) as n, count(distinct file_id) as n_files, sum(case when is_label_half then 1 else 0 end)::bigint as n_label from feature_batches group by all")
def d11_batch_counts(spark, d):
    f = load(spark, d, "feature_batches", "asset_id", "batch_id", "file_id", "is_label_half")
    return f.groupBy("asset_id", "batch_id").agg(F.count("*").alias("n"), F.countDistinct("file_id").alias("n_files"), F.sum(F.when(F.col("is_label_half"), 1).otherwise(0)).alias("n_label"))


@query("""select asset_id, batch_id, round(avg(close), 9) as mean, round(stddev_samp(close), 9) as sd, round(quantile_cont(close, 0.1), 9) as q10, round(quantile_cont(close, 0.5), 9) as q50, round(quantile_cont(close, 0.9), 9) as q90 from feature_batches where close is not null and not isnan(close) group by all""")
def d13_describe_per_batch(spark, d):
    f = load(spark, d, "feature_batches", "asset_id", "batch_id", "close").where("close is not null")
    q = F.percentile("close", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return f.groupBy("asset_id", "batch_id").agg(F.round(F.avg("close"), 9).alias("mean"), F.round(F.stddev_samp("close"), 9).alias("sd"), q.alias("q")).select("asset_id", "batch_id", "mean", "sd", *(F.round(F.col("q")[i], 9).alias(n) for i, n in enumerate(("q10", "q50", "q90"))))


P = "stage1_pred_batch_predictions"


@query(f"select asset_id, \"timestamp\", count(distinct y_pred) as n_classes, case when count(distinct y_pred) = 1 then min(y_pred) end as agreed from {P} group by all")
def d14_all_agree(spark, d):
    p = load(spark, d, P, "asset_id", "timestamp", "y_pred").groupBy("asset_id", "timestamp")
    return p.agg(F.countDistinct("y_pred").alias("n_classes"), F.when(F.countDistinct("y_pred") == 1, F.min("y_pred")).alias("agreed"))


@query(f"with u as (select list_sort(list(distinct action_key)) as u from {P}) select pred_batch, array_to_string(list_sort(list(distinct action_key)), ',') as have, (select len(u) from u) - count(distinct action_key) as n_missing from {P} group by 1")
def d15_missing_from_universe(spark, d):
    p = load(spark, d, P, "pred_batch", "action_key")
    universe = p.agg(F.count_distinct("action_key"))
    have = p.groupBy("pred_batch").agg(F.sort_array(F.collect_set("action_key")).alias("have"))
    return have.select("pred_batch", F.concat_ws(",", "have").alias("have"), (universe.scalar() - F.size("have")).alias("n_missing"))


_ACC = f"acc as (select pred_batch, action_key, avg(case when y_true = y_pred then 1.0 else 0.0 end) as acc, count(*) as n from {P} group by 1, 2)"


def _acc(spark, d):
    hit = (F.col("y_true") == F.col("y_pred")).cast("double")
    return load(spark, d, P, "pred_batch", "action_key", "y_true", "y_pred").groupBy("pred_batch", "action_key").agg(F.avg(F.coalesce(hit, F.lit(0.0))).alias("acc"), F.count("*").alias("n"))


def _best(k):
    return Window.partitionBy("pred_batch").orderBy(F.desc("acc"), F.desc("n"), "action_key")


@query(f"with {_ACC} select pred_batch, action_key, round(acc, 8) as acc from acc qualify row_number() over (partition by pred_batch order by acc desc, n desc, action_key) = 1")
def d16_grouped_best(spark, d):
    return R.dedupe_latest(_acc(spark, d), ["pred_batch"], -F.col("acc"), -F.col("n"), F.col("action_key")).select("pred_batch", "action_key", F.round("acc", 8).alias("acc"))


@query(f"with {_ACC} select pred_batch, action_key, row_number() over (partition by pred_batch order by acc desc, n desc, action_key) as place from acc qualify place <= 3")
def d17_grouped_top_k(spark, d):
    return _acc(spark, d).withColumn("place", F.row_number().over(_best(3)).cast("long")).where("place <= 3").select("pred_batch", "action_key", "place")


@query(f"with {_ACC}, t as (select *, row_number() over (partition by pred_batch order by acc desc, n desc, action_key) as place from acc) select pred_batch, count(*) as k, count(distinct split_part(action_key, '|', 1)) as n_kinds, max(case when place = 1 then action_key end) as first_key from t where place <= 3 group by 1")
def d18_top_k_consensus(spark, d):
    top = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("acc")).alias("a"), (-F.col("n")).alias("m"), "action_key"))), 1, 3)
    t = _acc(spark, d).groupBy("pred_batch").agg(top.alias("t"))
    kinds = F.transform("t", lambda x: F.split_part(x["action_key"], F.lit("|"), F.lit(1)))
    return t.select("pred_batch", F.size("t").cast("long").alias("k"), F.size(F.array_distinct(kinds)).cast("long").alias("n_kinds"), F.col("t")[0]["action_key"].alias("first_key"))


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
def d19_top_n(spark, d):
    return load(spark, d, "orders", "o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query(B + "select ts, " + ", ".join(f"coalesce(max(case when symbol = '{s}' then close end), 0) as {s}" for s in ("click", "purchase", "view")) + " from bars where symbol in ('click', 'purchase', 'view') group by ts")
def d20_pivot(spark, d):
    names = ["click", "purchase", "view"]
    return _bars(spark, d).where(F.col("symbol").isin(names)).groupBy("ts").pivot("symbol", names).agg(F.max("close")).fillna(0, names)


@query(f"select y_true, y_pred, count(*) as n from {P} group by 1, 2")
def d21_confusion(spark, d):
    return load(spark, d, P, "y_true", "y_pred").groupBy("y_true", "y_pred").agg(F.count("*").alias("n"))


@query("select target_4class, count(*) as n, round(count(*) / sum(count(*)) over (), 8) as share from label_bars group by 1")
def d22_class_distribution(spark, d):
    g = load(spark, d, "label_bars", "target_4class").groupBy("target_4class").agg(F.count("*").alias("n"))
    return g.select("target_4class", "n", F.round(F.col("n") / g.agg(F.sum("n")).scalar(), 8).alias("share"))


@query("select asset_id, count(*) as n, count_if(not isnan(close) and close > bb_lower) as n_pass, count_if(not isnan(close) and close <= bb_lower) as n_fail from label_bars group by 1")
def d23_validation_summary(spark, d):
    ok = F.col("close") > F.col("bb_lower")
    return load(spark, d, "label_bars", "asset_id", "close", "bb_lower").groupBy("asset_id").agg(F.count("*").alias("n"), F.count_if(ok).alias("n_pass"), F.count_if(~ok).alias("n_fail"))


@query("""with q as (select target_4class, quantile_cont(bb_position_pct, 0.9) as cut from label_bars where bb_position_pct is not null group by 1) select l.row_id, l.bb_position_pct > q.cut as extreme from label_bars l join q on l.target_4class = q.target_4class where l.bb_position_pct is not null""")
def d24_group_quantile(spark, d):
    l = load(spark, d, "label_bars", "row_id", "target_4class", "bb_position_pct").where("bb_position_pct is not null")  # noqa: E741
    q = l.groupBy("target_4class").agg(F.percentile("bb_position_pct", F.lit(0.9)).alias("cut"))
    return l.join(q, "target_4class").select("row_id", (F.col("bb_position_pct") > F.col("cut")).alias("extreme"))


_CONF = "greatest(prob_class_0, prob_class_1, prob_class_2, prob_class_3)"


@query(f"select least(floor({_CONF} * 10), 9)::int as bucket, count(*) as n, round(avg(case when y_true = y_pred then 1.0 else 0.0 end), 8) as accuracy from {P} where {_CONF} is not null group by 1")
def d25_confidence_buckets(spark, d):
    p = load(spark, d, P, "y_true", "y_pred", *(f"prob_class_{j}" for j in range(4)))
    conf = F.greatest(*(F.col(f"prob_class_{j}") for j in range(4)))
    hit = F.coalesce((F.col("y_true") == F.col("y_pred")).cast("double"), F.lit(0.0))
    return p.where(conf.isNotNull()).groupBy(F.least(F.floor(conf * 10), F.lit(9)).cast("int").alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg(hit), 8).alias("accuracy"))


@query("select l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 8) as wmean from lineitem group by 1")
def d26_weighted_mean(spark, d):
    return load(spark, d, "lineitem", "l_returnflag", "l_discount", "l_quantity").groupBy("l_returnflag").agg(F.round(F.sum(F.col("l_discount") * F.col("l_quantity")) / F.sum("l_quantity"), 8).alias("wmean"))


@query("select s_nationkey as nation, s_acctbal as balance, null::varchar as segment from supplier union all by name select c_nationkey as nation, c_acctbal as balance, c_mktsegment as segment from customer")
def d27_union_by_name(spark, d):
    s = load(spark, d, "supplier", "s_nationkey", "s_acctbal").toDF("nation", "balance")
    c = load(spark, d, "customer", "c_nationkey", "c_acctbal", "c_mktsegment").toDF("nation", "balance", "segment")
    return s.unionByName(c, allowMissingColumns=True)


@query(f"select distinct batch_id from label_bars where batch_id is not null intersect select distinct batch_id from {P}")
def d29_batch_intersection(spark, d):
    return load(spark, d, "label_bars", "batch_id").where("batch_id is not null").intersect(load(spark, d, P, "batch_id"))


@query(f"select distinct batch_id from {P} where batch_id is not null except select distinct batch_id from label_bars")
def d30_batch_difference(spark, d):
    return load(spark, d, P, "batch_id").where("batch_id is not null").distinct().join(load(spark, d, "label_bars", "batch_id"), "batch_id", "left_anti")
