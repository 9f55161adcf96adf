"""Queries of the general problems (1, 2, 4, 5, 6) and the SQL they are held against."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.operators import consolidate, grid, rolling, schema_drift, spikes
from chronoloom.session import shared_folder
from chronoloom.sources.tables import load

BATCH_KEY = ["asset_id", "regime", "family", "batch_id", "timestamp"]
PERIODS = [1, 7, 30]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.drift(load(spark, d, "run_configs"))


def p1_table(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.consistent_table(load(spark, d, "run_configs"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return spikes.implausible(load(spark, d, "raw_bars"))


def p2_limits(spark: SparkSession, d: str) -> DataFrame:
    return spikes.physical_limits(load(spark, d, "raw_bars", "row_id", "open", "high", "low", "close", "volume"))


def p2_scores(spark: SparkSession, d: str) -> DataFrame:
    return spikes.every_score(load(spark, d, "raw_bars"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return grid.missing_slots(load(spark, d, "raw_bars"), load(spark, d, "feeds"))


def p4_grid(spark: SparkSession, d: str) -> DataFrame:
    return grid.regular_grid(load(spark, d, "raw_bars"), load(spark, d, "feeds"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return consolidate.repeated(load(spark, d, "feature_batches"), load(spark, d, "batch_files"), BATCH_KEY)


def _consolidated(spark: SparkSession, d: str) -> tuple[str, DataFrame]:
    """A new folder beside the checkpoints with the consolidated files, and their ranges."""
    path = f"{shared_folder(spark)}/consolidated-{uuid.uuid4().hex}"
    return path, consolidate.write(load(spark, d, "feature_batches"), load(spark, d, "batch_files"), BATCH_KEY, path)


def p5_files(spark: SparkSession, d: str) -> DataFrame:
    """Range metadata of the written files: name, rows, bytes on disk, first and last key."""
    return _consolidated(spark, d)[1]


def p5_content(spark: SparkSession, d: str) -> DataFrame:
    """What the written files hold per asset, regime and family, read back from them."""
    back = spark.read.schema(load(spark, d, "feature_batches").schema).parquet(_consolidated(spark, d)[0])
    return back.groupBy("asset_id", "regime", "family").agg(F.count("*").alias("n_rows"), F.sum("row_id").alias("row_id_sum"), F.min("batch_id").alias("first_batch_id"), F.max("batch_id").alias("last_batch_id"))


def _trailing(spark: SparkSession, d: str) -> DataFrame:
    return rolling.trailing(load(spark, d, "label_bars"), "asset_id", "timestamp", ["close", "bb_middle"], PERIODS)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _trailing(spark, d).where("n_close = 0").select("asset_id", F.date_format("day", "yyyy-MM-dd").alias("day_utc"), "period_days")


def p6_totals(spark: SparkSession, d: str) -> DataFrame:
    t = _trailing(spark, d)
    parts = [F.round(c, 6 if c.startswith("total") else 9).alias(c) for c in ("total_close", "total_bb_middle", "avg_close", "avg_bb_middle")]
    return t.select("asset_id", F.date_format("day", "yyyy-MM-dd").alias("day_utc"), "period_days", "n_close", "n_bb_middle", *parts)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_table, p2_found, p2_limits, p2_scores, p4_found, p4_grid, p5_found, p5_files, p5_content, p6_found, p6_totals)}

_SLOT_OPEN = """(calendar_id is distinct from 'session_week'
  or (isodow <= 5 and hour <= 20) or ((isodow <= 4 or isodow = 7) and hour >= 22))"""
_CONTENT = ", ".join(f"r.{c}" for c in ("asset_id", "regime", "family", '"timestamp"', "batch_id", "open", "close", "volume", "bar_in_batch_norm", "is_label_half", "minutes_since_prev_real_bar", "target_4class"))
_COPIES = f"""
select r.*, row_number() over (partition by {_CONTENT} order by (b.file_id is null), b.written_at nulls first, r.file_id, r.row_id) as copy
from feature_batches r left join batch_files b on r.file_id = b.file_id"""
_DAILY = """
with bars as (select distinct asset_id, "timestamp", batch_id, bar_pos, close, bb_middle, bb_upper, bb_lower, bb_position_pct, target_4class, target_name, available_at from label_bars where asset_id is not null and "timestamp" is not null),
daily as (select asset_id, cast("timestamp" as date) as day,
    count(case when not isnan(close) then close end) as n_close, sum(case when not isnan(close) then close end) as s_close,
    count(case when not isnan(bb_middle) then bb_middle end) as n_bb, sum(case when not isnan(bb_middle) then bb_middle end) as s_bb
  from bars group by all),
span as (select asset_id, min(day) as a, max(day) as z from daily where n_close > 0 group by asset_id),
calendar as (select asset_id, cast(unnest(generate_series(a, z, interval 1 day)) as date) as day from span),
period as (select unnest([1, 7, 30]) as period_days),
totals as (select c.asset_id, strftime(c.day, '%Y-%m-%d') as day_utc, p.period_days, coalesce(sum(d.n_close), 0)::bigint as n_close, coalesce(sum(d.n_bb), 0)::bigint as n_bb_middle,
    sum(d.s_close) as total_close, sum(d.s_bb) as total_bb_middle
  from calendar c cross join period p left join daily d on d.asset_id = c.asset_id and d.day <= c.day and d.day > c.day - p.period_days and d.day >= (select a from span s where s.asset_id = c.asset_id)
  group by all)
"""
_FIELDS = """
with parsed as (select *, row_number() over (partition by file_path order by record_id) as nth from run_configs where json_valid(payload) and json_type(payload) = 'OBJECT'),
files as (select record_id, pipeline_id, config_kind, payload, row_number() over (partition by pipeline_id, config_kind order by written_at, record_id) as seq from parsed where nth = 1),
members as (
  select record_id, pipeline_id, config_kind, seq, '' as owner, unnest(json_keys(payload)) as name, payload as j from files
  union all
  select record_id, pipeline_id, config_kind, seq, 'args', unnest(json_keys(payload, '$.args')), json_extract(payload, '$.args') from files where json_type(payload, '$.args') = 'OBJECT'),
typed as (select * exclude (j), json_type(j, '$."' || name || '"') as raw from members),
kinds as (select * exclude (raw), case when raw in ('BIGINT', 'UBIGINT', 'HUGEINT') then 'integer' when raw = 'NULL' then null else lower(raw) end as kind from typed),
known as (select *, last_value(kind ignore nulls) over (partition by pipeline_id, config_kind, owner, name order by seq rows unbounded preceding) as known from kinds),
now as (select * from known where seq > 1),
before as (select f.record_id, f.config_kind, k.owner, k.name, k.known from known k join files f on f.pipeline_id = k.pipeline_id and f.config_kind = k.config_kind and f.seq = k.seq + 1),
steps as (select coalesce(n.record_id, b.record_id) as record_id, coalesce(n.config_kind, b.config_kind) as config_kind, coalesce(n.owner, b.owner) as owner, coalesce(n.name, b.name) as name,
    case when b.name is null then 'came' when n.name is null then 'left' when n.kind <> b.known then 'type_changed' end as move, case when n.name is null then b.known else n.known end as kind
  from now n full join before b on n.record_id = b.record_id and n.owner = b.owner and n.name = b.name),
moves as (select *, count(*) filter (move = 'left') over (partition by record_id, owner) as n_left, max(kind) filter (move = 'left') over (partition by record_id, owner) as left_kind from steps where move is not null),
pairs as (select *, count(*) filter (move = 'came' and kind = left_kind) over (partition by record_id, owner) as n_alike from moves)
select record_id, config_kind || case when owner <> '' then '.' || owner else '' end || '.' || name as field_path,
  case when move = 'came' and n_left = 1 and n_alike = 1 and kind = left_kind then 'renamed' when move = 'came' then 'added' when move = 'left' then 'removed' else move end as change_kind
from pairs where not (move = 'left' and n_left = 1 and n_alike = 1)
"""

SQL: dict[str, str] = {
    "p1_found": _FIELDS,
    "p2_limits": """
select row_id, unnest(list_filter([case when high <= 0 or high < greatest(open, case when not isnan(close) then close end) then 'high' end,
  case when low <= 0 or low > least(open, case when not isnan(close) then close end) then 'low' end, case when volume < 0 then 'volume' end], lambda x: x is not null)) as field_name from raw_bars""",
    "p4_found": f"""
with slots as (select r.source_id, f.step_seconds::bigint as step, f.calendar_id, (epoch_us(r."timestamp") // 1000000) // f.step_seconds * f.step_seconds as slot, r.close is not null and not isnan(r.close) as known
  from raw_bars r join feeds f on r.source_id = f.source_id),
span as (select source_id, step, calendar_id, min(slot) as a, max(slot) as z from slots group by all),
grid as (select source_id, calendar_id, unnest(range(a, z + 1, step))::bigint as slot_start from span),
hours as (select *, isodow(make_timestamp(slot_start * 1000000)) as isodow, hour(make_timestamp(slot_start * 1000000)) as hour from grid)
select source_id, slot_start from hours where {_SLOT_OPEN} and not exists (select 1 from slots s where s.known and s.source_id = hours.source_id and s.slot = hours.slot_start)""",
    "p5_found": f"select row_id from ({_COPIES}) where copy > 1",
    "p5_content": f"select asset_id, regime, family, count(*) as n_rows, sum(row_id)::bigint as row_id_sum, min(batch_id) as first_batch_id, max(batch_id) as last_batch_id from ({_COPIES}) where copy = 1 group by all",
    "p6_found": _DAILY + "select asset_id, day_utc, period_days from totals where n_close = 0",
    "p6_totals": _DAILY + "select asset_id, day_utc, period_days, n_close, n_bb_middle, round(total_close, 6) as total_close, round(total_bb_middle, 6) as total_bb_middle, round(total_close / n_close, 9) as avg_close, round(total_bb_middle / n_bb_middle, 9) as avg_bb_middle from totals",
}
