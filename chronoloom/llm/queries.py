"""Queries of the text and record problems (3, 7, 8, 9) and the SQL that some of them can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronoloom.llm import contamination, overlap, packing, sentences
from chronoloom.sources.tables import load

_PRED = "stage1_pred_batch_predictions"


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.pairs(load(spark, d, _PRED))


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    return overlap.per_split(load(spark, d, _PRED))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.containers(load(spark, d, "documents"), load(spark, d, "container_sizes"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p7_containers(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return contamination.contaminated(load(spark, d, "documents"), load(spark, d, "eval_items")).select("doc_id", "item_id")


def p8_passages(spark: SparkSession, d: str) -> DataFrame:
    return contamination.contaminated(load(spark, d, "documents"), load(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_units(load(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p3_found, p3_counts, p7_containers, p7_fill, p8_found, p8_passages, p9_found)}

_NEAR = " and ".join(f"abs(t.prob_class_{j} - e.prob_class_{j}) <= 0.01 + 1e-9" for j in range(4))
_PAIRS = f"""
select least(t.row_id, e.row_id) as row_id_a, greatest(t.row_id, e.row_id) as row_id_b, e.row_id as held_id, e.stage_split, e.asset_id
from {_PRED} t join {_PRED} e
  on t.asset_id = e.asset_id and t.action_key = e.action_key and t.stage_split = 'train' and e.stage_split in ('valid', 'test')
  and t.timestamp > e.timestamp - interval 450 seconds and t.timestamp < e.timestamp + interval 450 seconds and {_NEAR}
"""

SQL: dict[str, str] = {
    "p3_found": f"select row_id_a, row_id_b from ({_PAIRS})",
    "p3_counts": f"select stage_split, asset_id, count(*) as n_pairs, count(distinct held_id) as n_leaked from ({_PAIRS}) group by stage_split, asset_id",
}
