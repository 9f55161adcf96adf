"""Canonical calendar bars and the sources and sinks around them (A, D), with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from chronoloom.operators import canonical
from chronoloom.plans.relational_queries import Query
from chronoloom.session import shared_folder
from chronoloom.sources.tables import load, seconds

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def _canonical(spark, d):
    return canonical.canonical_bars(load(spark, d, "raw_bars"), load(spark, d, "feeds"))


_N = lambda c: f"case when not isnan({c}) then {c} end"
_CANON = f"""
with s as (select r.source_id, f.asset_id, f.calendar_id, f.step_seconds::bigint as step, (epoch_us(r."timestamp") // 1000000) // f.step_seconds * f.step_seconds as slot, {_N('open')} as o, {_N('high')} as h, {_N('low')} as l, {_N('close')} as c, {_N('volume')} as v,
    row_number() over (partition by r.source_id, (epoch_us(r."timestamp") // 1000000) // f.step_seconds order by r.ingested_at desc nulls last, r."timestamp" desc, r.row_id desc) as k
  from raw_bars r join feeds f on r.source_id = f.source_id where r."timestamp" is not null),
r as (select *, lag(slot) over w as before from s where k = 1 window w as (partition by source_id order by slot)),
b as (select *, before is null or (calendar_id = 'session_week' and slot - before > greatest(2700, 3 * step)) as begins from r),
n as (select *, sum(begins::int) over (partition by source_id order by slot) - (case when calendar_id = 'session_week' then 1 else 0 end) as nth from b),
span as (select source_id, asset_id, calendar_id, step, nth, min(slot) as a, max(slot) as z from n group by all),
g as (select source_id, asset_id, calendar_id, step, nth, a, z, unnest(range(a, z + 1, step))::bigint as slot from span),
j as (select g.*, n.source_id is not null as is_real, n.o, n.h, n.l, n.c, n.v, last_value(n.c ignore nulls) over w as carry, last_value(n.slot ignore nulls) over w as real_slot from g left join n on g.source_id = n.source_id and g.slot = n.slot window w as (partition by g.source_id order by g.slot rows unbounded preceding)),
k as (select *, lag(slot) over w as prev_slot, lead(slot) over w as next_slot, row_number() over (partition by source_id, nth order by slot) - 1 as pos from j where carry is not null window w as (partition by source_id order by slot)),
canon as (select source_id, make_timestamp(slot * 1000000) as "timestamp", case when is_real then o else carry end as open, case when is_real then h else carry end as high, case when is_real then l else carry end as low, carry as close, case when is_real then coalesce(v, 0) else 0 end as volume, asset_id, calendar_id,
  true as is_market_open, not is_real as is_synthetic_no_trade, not is_real as is_open_session_gap_fill, ((slot - real_slot) // 60)::int as minutes_since_prev_real_bar, asset_id || '_' || nth as session_id, strftime(make_timestamp(slot * 1000000), '%Y-%m-%d') as session_date,
  pos::int as session_bar_pos, ((z - slot) // 60)::int as session_minutes_to_close, pos = 0 as is_session_open_bar, z = slot as is_session_close_bar, pos = 0 and coalesce(slot - prev_slot > 86400, true) as is_weekly_open_bar, z = slot and coalesce(next_slot - slot > 86400, true) as is_weekly_close_bar
  from k)
"""


@query(_CANON + "select * from canon")
def d07_canonical_bars(spark, d):
    return _canonical(spark, d)


@query(_CANON + """, x as (select c.*, f.step_seconds::bigint as step, epoch_us("timestamp") // 1000000 as slot, epoch_us("timestamp") // 3600000000 * 3600 as bucket from canon c join feeds f on c.source_id = f.source_id),
cl as (select source_id, (slot // 60) % 1440 as minute from x where is_session_close_bar and not is_synthetic_no_trade group by all having count(*) >= 2), lst as (select source_id, max(slot) as source_last from x group by 1),
hh as (select source_id, bucket, arg_min(open, slot) as open, max(high) as high, min(low) as low, arg_max(close, slot) as close, round(sum(volume), 4) as volume, arg_min(asset_id, slot) as asset_id, arg_min(calendar_id, slot) as calendar_id, bool_or(is_market_open) as is_market_open, bool_and(is_synthetic_no_trade) as is_synthetic_no_trade, bool_or(is_open_session_gap_fill) as is_open_session_gap_fill,
  max(minutes_since_prev_real_bar) as minutes_since_prev_real_bar, arg_min(session_id, slot) as session_id, arg_min(session_date, slot) as session_date, min(session_bar_pos) as session_bar_pos, min(session_minutes_to_close) as session_minutes_to_close, bool_or(is_session_open_bar) as is_session_open_bar, bool_or(is_session_close_bar) as is_session_close_bar, bool_or(is_weekly_open_bar) as is_weekly_open_bar, bool_or(is_weekly_close_bar) as is_weekly_close_bar,
  count(*) as n, max(slot) as ends, max(step) as step from x group by 1, 2)
select hh.* exclude (n, ends, step, bucket), make_timestamp(bucket * 1000000) as "timestamp" from hh join lst on hh.source_id = lst.source_id where n * step = 3600 or (calendar_id = 'session_week' and (bucket + 3600 <= source_last + step or (is_session_close_bar and exists (select 1 from cl where cl.source_id = hh.source_id and cl.minute = (ends // 60) % 1440))))""")
def d06_canonical_hours(spark, d):
    return canonical.longer_bars(_canonical(spark, d), load(spark, d, "feeds")).withColumn("volume", F.round("volume", 4))


# ---- sources and sinks --------------------------------------------------------------------------------------------------


@query("select source_id, count(*) as n_rows, count(distinct (epoch_us(\"timestamp\") // 86400000000)) as n_files, min(\"timestamp\") as first_ts, max(\"timestamp\") as last_ts from raw_bars where source_id is not null and \"timestamp\" is not null group by 1")
def a20_inventory_of_files(spark, d):
    """What is stored per source: a sink writes one folder per source and day, the inventory is read from the files themselves."""
    raw = load(spark, d, "raw_bars", "source_id", "timestamp").where("source_id is not null and timestamp is not null")
    path = f"{shared_folder(spark)}/bars-{uuid.uuid4().hex}"
    day = F.to_date("timestamp")
    raw.withColumns({"source": F.col("source_id"), "day": day}).repartition("source", "day").write.partitionBy("source", "day").parquet(path)
    back = spark.read.parquet(path)
    return back.groupBy("source_id").agg(F.count("*").alias("n_rows"), F.count_distinct("day").alias("n_files"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"))


@query("select asset_id, batch_id, count(*) as n_rows, round(sum(case when not isnan(close) then close end), 4) as close_sum from feature_batches where batch_id between 3 and 6 group by 1, 2")
def a16_batch_files(spark, d):
    """One folder per batch id, of which a reader of some batches opens only those (partition pruning)."""
    path = f"{shared_folder(spark)}/batches-{uuid.uuid4().hex}"
    load(spark, d, "feature_batches").where("batch_id is not null").withColumn("batch", F.col("batch_id")).repartition("batch").write.partitionBy("batch").parquet(path)
    return spark.read.parquet(path).where("batch between 3 and 6").groupBy("asset_id", "batch_id").agg(F.count("*").alias("n_rows"), F.round(F.sum("close"), 4).alias("close_sum"))


_RANGES = """with f as (select file_id, min("timestamp") as lo, max("timestamp") as hi, count(*) as n from feature_batches where "timestamp" is not null group by 1), m as (select min(lo) as a from f)"""


@query(_RANGES + " select file_id, n, lo, hi from f, m where hi >= a + interval 1 day and lo < a + interval 3 day")
def a21_overlapping_files(spark, d):
    """Files whose own range of time meets a window: only their metadata is looked at, one row a file."""
    f = load(spark, d, "feature_batches", "file_id", "timestamp").where("timestamp is not null").groupBy("file_id").agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"), F.count("*").alias("n"))
    a = f.agg(F.min("lo").alias("a"))  # one row
    return f.join(F.broadcast(a), F.expr("hi >= a + interval 1 day and lo < a + interval 3 day")).select("file_id", "n", "lo", "hi")


@query("""with p as (select f.provider, r.asset_id, max(r."timestamp") as last_ts from raw_bars r join feeds f on r.source_id = f.source_id where r."timestamp" is not null group by all), b as (select asset_id, max(last_ts) as newest from p group by 1)
select p.asset_id, provider, last_ts, case when last_ts = newest then 'none' when newest - last_ts <= interval 6 hour then 'quick' else 'full' end as route from p join b on p.asset_id = b.asset_id""")
def a19_tail_routes(spark, d):
    """How each provider's tail of an asset is to be topped up, by how far it lies behind the newest."""
    feeds = load(spark, d, "feeds", "source_id", "provider")
    p = load(spark, d, "raw_bars", "source_id", "asset_id", "timestamp").where("timestamp is not null").join(feeds, "source_id").groupBy("provider", "asset_id").agg(F.max("timestamp").alias("last_ts"))
    b = p.groupBy("asset_id").agg(F.max("last_ts").alias("newest"))
    behind = seconds("newest") * 1_000_000 - seconds("last_ts") * 1_000_000
    route = F.when(F.col("last_ts") == F.col("newest"), "none").when(behind <= 6 * 3_600_000_000, "quick").otherwise("full")
    return p.join(b, "asset_id").select("asset_id", "provider", "last_ts", route.alias("route"))


@query("""select provider, asset_id, "timestamp", case when not isnan(close) then close end as close, volume, case provider when 'nimbus' then 1 when 'quarry' then 2 else 3 end as source_priority
from (select r.*, f.provider from raw_bars r join feeds f on r.source_id = f.source_id where r."timestamp" is not null)""")
def a04_tagged_union(spark, d):
    """The rows of all providers, each scan tagged with its provider and priority, as one table; filters go on into the scans."""
    feeds = load(spark, d, "feeds", "source_id", "provider")
    raw = load(spark, d, "raw_bars", "source_id", "asset_id", "timestamp", "close", "volume").where("timestamp is not null")
    rank = F.when(F.col("provider") == "nimbus", 1).when(F.col("provider") == "quarry", 2).otherwise(3)
    return raw.join(feeds, "source_id").select("provider", "asset_id", "timestamp", "close", "volume", rank.alias("source_priority"))


@query("""select r.source_id, date_trunc('hour', "timestamp") as ts, max(case when not isnan(high) then high end) as RAW_nimbus_high, min(case when not isnan(low) then low end) as RAW_nimbus_low from raw_bars r join feeds f on r.source_id = f.source_id where f.provider = 'nimbus' and "timestamp" is not null group by all""")
def a07_renamed_source(spark, d):
    """A source's columns under names that say where they come from."""
    raw = load(spark, d, "raw_bars", "source_id", "timestamp", "high", "low").where("timestamp is not null").join(load(spark, d, "feeds", "source_id", "provider").where("provider = 'nimbus'"), "source_id")
    g = raw.groupBy("source_id", F.date_trunc("hour", "timestamp").cast("timestamp_ntz").alias("ts")).agg(F.max("high").alias("high"), F.min("low").alias("low"))
    return g.withColumnsRenamed({c: f"RAW_nimbus_{c}" for c in ("high", "low")})


@query("""select source_id, make_timestamp((epoch_us("timestamp") // 14400000000) * 14400000000) as ts, max(case when not isnan(high) then high end) as high, min(case when not isnan(low) then low end) as low, round(sum(case when not isnan(volume) then volume end), 4) as volume, count(*) as n from raw_bars where source_id is not null and "timestamp" is not null group by 1, 2""")
def a02_four_hour_scan(spark, d):
    """Bars of four hours by batch of the source's files."""
    raw = load(spark, d, "raw_bars", "source_id", "timestamp", "high", "low", "volume").where("source_id is not null and timestamp is not null")
    ts = F.timestamp_seconds(F.floor(seconds("timestamp") / 14_400) * 14_400).cast("timestamp_ntz")
    return raw.groupBy("source_id", ts.alias("ts")).agg(F.max("high").alias("high"), F.min("low").alias("low"), F.round(F.sum("volume"), 4).alias("volume"), F.count("*").alias("n"))


@query("""with s as (select r.asset_id, f.provider, make_timestamp((epoch_us("timestamp") // 14400000000) * 14400000000) as ts, max(case when not isnan(turnover) then turnover end) as turnover from raw_bars r join feeds f on r.source_id = f.source_id where r.asset_id is not null and "timestamp" is not null group by 1, 2, 3)
select asset_id, ts, arg_min(turnover, provider) as turnover, min(provider) as provider from s where turnover is not null group by 1, 2""")
def a03_auxiliary_scan(spark, d):
    """An auxiliary measure by four hours: of several providers the first that has it counts."""
    raw = load(spark, d, "raw_bars", "source_id", "asset_id", "timestamp", "turnover").where("asset_id is not null and timestamp is not null").join(load(spark, d, "feeds", "source_id", "provider"), "source_id")
    ts = F.timestamp_seconds(F.floor(seconds("timestamp") / 14_400) * 14_400).cast("timestamp_ntz")
    s = raw.groupBy("asset_id", "provider", ts.alias("ts")).agg(F.max("turnover").alias("turnover")).where("turnover is not null")
    return s.groupBy("asset_id", "ts").agg(F.min_by("turnover", "provider").alias("turnover"), F.min("provider").alias("provider"))


@query("""with s as (select source_id, bar_interval, count(*) as n from raw_bars where source_id is not null and bar_interval is not null group by all) select source_id, list_sort(list(bar_interval))::varchar as intervals, count(*) as n_intervals from s group by 1""")
def a05_available_intervals(spark, d):
    s = load(spark, d, "raw_bars", "source_id", "bar_interval").where("source_id is not null and bar_interval is not null").groupBy("source_id", "bar_interval").agg(F.count("*").alias("n"))
    return s.groupBy("source_id").agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("bar_interval")), ", "), F.lit("]")).alias("intervals"), F.count("*").alias("n_intervals"))


@query("""select row_id, "timestamp", case when open > 0 then open end as open, case when close > 0 and not isnan(close) then close end as close from raw_bars where source_id is not null and "timestamp" is not null""")
def a10_json_values(spark, d):
    """Readings as a provider's JSON answers, parsed back; values that are no numbers are NULL."""
    raw = load(spark, d, "raw_bars", "row_id", "source_id", "timestamp", "open", "close").where("source_id is not null and timestamp is not null")
    text = F.to_json(F.struct("row_id", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("datetime"), F.coalesce(F.col("open").cast("string"), F.lit("x")).alias("open"), F.coalesce(F.col("close").cast("string"), F.lit("x")).alias("close")))
    parsed = raw.select(F.from_json(text, "row_id long, datetime string, open string, close string").alias("v")).select("v.*")
    number = lambda c: F.expr(f"try_cast({c} as double)")
    price = lambda c: F.when(number(c) > 0, number(c)).alias(c)
    return parsed.select("row_id", F.col("datetime").cast("timestamp_ntz").alias("timestamp"), price("open"), price("close"))

