"""Provider payloads and folders into one bar schema, and the sinks bars are kept in.

Fetching over a network is not part of the engine: every function starts from files or frames that are there.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PRICES = ("open", "high", "low", "close")
BAR = "timestamp timestamp, open double, high double, low double, close double, volume double, turnover double, interval string"


def bars_from_json_values(raw: DataFrame, payload: str, interval: str) -> DataFrame:
    """Bars from a JSON text column ``{"values": [{"datetime", "open", ...}]}`` of strings; rows without time or a price are dropped, turnover is NULL."""
    kind = "struct<values:array<struct<datetime:string,open:string,high:string,low:string,close:string,volume:string>>>"
    v = raw.select(F.explode(F.from_json(payload, kind)["values"]).alias("v")).select("v.*")
    number = {c: F.expr(f"try_cast({c} as double)").alias(c) for c in (*PRICES, "volume")}
    bars = v.select(F.try_to_timestamp("datetime").alias("timestamp"), *number.values(), F.lit(None).cast("double").alias("turnover"), F.lit(interval).alias("interval"))
    return bars.dropna(subset=["timestamp", *PRICES])


def inverted(bars: DataFrame) -> DataFrame:
    """Prices of the opposite quote: 1/x, with high and low changing places; a price of 0 gives NULL."""
    inv = lambda c: F.try_divide(F.lit(1.0), F.nullif(F.col(c), F.lit(0.0)))
    return bars.withColumns({"open": inv("open"), "high": inv("low"), "low": inv("high"), "close": inv("close")})


def renamed_source(df: DataFrame, names: dict[str, str], positive: Iterable[str] = ()) -> DataFrame:
    """Project and rename a source; values that must be positive and are not, or are infinite, become NULL."""
    df = df.select(*(F.col(a).alias(b) for a, b in names.items()))
    return df.withColumns({c: F.when((F.col(c) > 0) & (F.col(c) < float("inf")), F.col(c)) for c in positive})


def provider_scan(spark: SparkSession, groups: list[tuple[str, int, str]]) -> DataFrame:
    """Union of provider folders (name, priority, path): one lazy scan each, tagged with its name and priority."""
    parts = [spark.read.parquet(path).withColumns({"_source_provider": F.lit(name), "_source_priority": F.lit(priority)}) for name, priority, path in groups]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def discovered(root: str) -> dict[str, list[str]]:
    """Data types and their timeframes, from folders named ``<type>_<tf>``."""
    found: dict[str, list[str]] = {}
    for p in sorted(Path(root).iterdir()):
        m = re.fullmatch(r"(\w+)_(\d+[mhd])", p.name)
        if m and p.is_dir():
            found.setdefault(m[1], []).append(m[2])
    return {k: sorted(v, key=minutes) for k, v in found.items()}


def minutes(tf: str) -> int:
    m = re.fullmatch(r"(\d+)([mhd])", tf)
    if not m:
        raise ValueError(f"timeframe {tf!r} is no number followed by m, h or d")
    return int(m[1]) * {"m": 1, "h": 60, "d": 1440}[m[2]]


def best_timeframe(available: list[str], target: str) -> str | None:
    """The target itself, else the smallest larger one."""
    larger = [t for t in available if minutes(t) >= minutes(target)]
    return min(larger, key=minutes) if larger else None


def append_new(bars: DataFrame, stored: DataFrame, keys: list[str], path: str, per_file: int = 1_000_000) -> None:
    """Append only the rows after the last stored one of their key, in files of at most ``per_file`` rows."""
    last = stored.groupBy(*keys).agg(F.max("timestamp").alias("__last"))
    new = bars.join(last, keys, "left").where("__last is null or timestamp > __last").drop("__last")
    new.write.mode("append").option("maxRecordsPerFile", per_file).parquet(path)


def replaced_window(stored: DataFrame, replacement: DataFrame, keys: list[str], start: Column, end: Column) -> DataFrame:
    """Stored rows outside [start, end], with the replacement in their place; of equal keys and times the replacement counts."""
    kept = stored.where((F.col("timestamp") < start) | (F.col("timestamp") > end)).withColumn("__p", F.lit(0))
    both = kept.unionByName(replacement.withColumn("__p", F.lit(1)))
    w = Window.partitionBy(*keys, "timestamp").orderBy(F.desc("__p"))
    return both.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k", "__p")


def write_per_batch(df: DataFrame, path: str) -> None:
    """One folder per batch_id; rewriting some batches leaves the others as they are."""
    df.repartition("batch_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small report as CSV and Parquet side by side."""
    df.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    df.write.mode("overwrite").parquet(f"{path}/parquet")


def write_sidecar(path: str, payload: dict) -> None:
    """JSON metadata beside an artifact, replaced as a whole."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_suffix(".part")
    part.write_text(json.dumps(payload, indent=2, sort_keys=True, default=str))
    part.replace(target)


def tail_route(last: dict[str, int], now: int, near: int) -> dict[str, str]:
    """Provider for the missing tail of each asset: the quick one for short gaps, the full one else, none if up to date."""
    return {a: "none" if now <= t else "quick" if now - t <= near else "full" for a, t in last.items()}
