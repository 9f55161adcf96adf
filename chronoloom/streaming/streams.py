"""Streaming forms of the batch operators: tumbling bars, sessions, late duplicates and stateful folds.

Every one takes and returns a streaming DataFrame, so sources and sinks are free; ``run_available`` drives one over the files that are
there, with its checkpoint in the cluster's shared folder. Results are those of the batch operators once the watermark
has passed; rows later than the watermark are dropped by windows and sessions, as declared by ``late``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chronoloom.session import prepare, shared_folder


def event_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """Files of a folder as a stream; ``ts`` becomes a timestamp with the zone UTC."""
    df = prepare(spark).readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling_bars(events: DataFrame, width: str, late: str) -> DataFrame:
    order = F.struct("ts", "event_id")
    g = events.withWatermark("ts", late).groupBy(F.col("event_type").alias("symbol"), F.window("ts", width).alias("w"))
    bars = g.agg(F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count("*").alias("n"))
    return bars.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "n")


def session_counts(events: DataFrame, gap: str, late: str) -> DataFrame:
    """Sessions by ``session_window``: a gap of exactly ``gap`` begins a new one, where the batch operator needs more than it."""
    g = events.withWatermark("ts", late).groupBy("event_type", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select("event_type", F.col("w.start").alias("first_ts"), "n")


def deduplicated(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def stateful_fold(rows: DataFrame, key: str, order: str, fold: Callable, start: Callable[[], object], outputs: str) -> DataFrame:
    """The fold of ``operators.scan.scan`` on a stream: state is kept per key between micro-batches, rows are ordered within one.

    One pass over all rows and several passes over consecutive parts give the same outputs.
    """
    names = [x.split()[0] for x in outputs.split(", ")]
    types = dict(rows.dtypes)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = json.loads(state.get[0]) if state.exists else start()
        pdf = pd.concat(list(batches)).sort_values(order)
        out = []
        for row in pdf.to_dict("records"):
            s, made = fold(s, row)
            out.append((k[0], row[order], *(made.get(n) for n in names)))
        state.update((json.dumps(s),))
        yield pd.DataFrame(out, columns=[key, order, *names])

    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {types[key]}, {order} {types[order]}, {outputs}", "state string", "append", GroupStateTimeout.NoTimeout)


def run_available(df: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Run a streaming plan over everything that is there, into Parquet files, and read them."""
    q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.parquet(out)


def new_folder(spark: SparkSession) -> str:
    """A new folder under the one all executors share."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
