"""Canonical bars of a source: one row per slot of its sessions, with carried prices where nothing was traded.

Readings are put on their slot (of several the one ingested last counts). A source of the calendar ``session_week`` begins a new session
wherever two slots with readings lie more than ``BREAK_MINUTES`` and ``BREAK_STEPS`` steps apart; any other source has one session. Inside a
session missing slots are filled: prices carry the last close, volume is 0. Close is the carried close of every row, also of a
reading whose own close is NULL. Rows before a source's first close are left out.

Everything ordered is scanned per block of slots and linked by one row a block, and sessions are one row each, so a source with
most rows is no hot task.

Defined results: rows with NULL source_id or timestamp and sources unknown to feeds are left out; the first and last session of a source
count as a week's open and close; empty input gives empty output; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.operators.blocks import last_known
from chronoloom.operators.grid import BLOCK_SLOTS, _span
from chronoloom.sources.tables import seconds

BREAK_MINUTES, BREAK_STEPS, WEEK_GAP_MINUTES = 45, 3, 1_440
PRICES = ("open", "high", "low", "close")


def _minutes(c: Column) -> Column:
    return F.floor(c / 60).cast("int")


def canonical_bars(bars: DataFrame, feeds: DataFrame) -> DataFrame:
    """source_id and the twenty columns of a canonical bar."""
    known = feeds.select("source_id", F.col("step_seconds").cast("long").alias("step"), "calendar_id", F.col("asset_id").alias("asset")).where("step > 0").dropDuplicates(["source_id"])
    rows = bars.where("source_id is not null and timestamp is not null").select("source_id", seconds("timestamp").alias("second"), "timestamp", "ingested_at", "row_id", *PRICES, "volume").join(known, "source_id")
    slot = (F.floor(F.col("second") / F.col("step")) * F.col("step")).cast("long")
    real = rows.withColumn("slot", slot).groupBy("source_id", "slot", "step", "calendar_id", "asset").agg(F.max_by(F.struct(*PRICES, "volume"), F.struct("ingested_at", "timestamp", "row_id")).alias("r"))
    real = real.select("source_id", "slot", "step", "calendar_id", "asset", *(F.col("r")[c].alias(c) for c in (*PRICES, "volume"))).withColumn("block", F.floor(F.col("slot") / (F.col("step") * BLOCK_SLOTS)))
    real = last_known(real, ["source_id"], ["slot"], "block", F.col("slot"), "before", inclusive=False)
    real = last_known(real, ["source_id"], ["slot"], "block", F.col("close"), "carried", inclusive=False)
    far = F.col("slot") - F.col("before") > F.greatest(F.lit(BREAK_MINUTES * 60), BREAK_STEPS * F.col("step"))
    real = real.withColumn("begins", F.col("before").isNull() | ((F.col("calendar_id") == "session_week") & far))

    bounds = real.groupBy("source_id").agg(F.max("slot").alias("last"), F.min(F.when(F.col("close").isNotNull(), F.col("slot"))).alias("from"))
    in_order = Window.partitionBy("source_id").orderBy("slot")  # one row a session
    starts = real.where("begins").select("source_id", "slot", "calendar_id", F.col("before").alias("prev_end")).join(bounds, "source_id")
    following = F.lead(F.struct(F.col("slot").alias("start"), F.col("prev_end").alias("end"))).over(in_order)
    starts = starts.withColumn("next", following).withColumn("nth", F.row_number().over(in_order).cast("long") - F.when(F.col("calendar_id") == "session_week", 1).otherwise(0))
    session = F.struct(F.col("slot").alias("start"), "nth", "prev_end", F.coalesce("next.end", "last").alias("end"), F.col("next.start").alias("next_start"), "from")
    marked = real.join(starts.select("source_id", "slot", session.alias("begun")), ["source_id", "slot"], "left")
    marked = last_known(marked, ["source_id"], ["slot"], "block", F.col("begun"), "s")

    same = ["source_id", "step", "calendar_id", "asset", "s", "before", "carried"]
    gaps = marked.where("not begins and slot - before > step").select(*same, "slot", F.explode(_span(F.col("before") + F.col("step"), F.col("slot") - F.col("step"), F.col("step"))).alias("piece"))
    end = F.least(F.col("piece") + F.col("step") * (BLOCK_SLOTS - 1), F.col("slot") - F.col("step"))
    filled = gaps.select(*same, F.explode(F.sequence("piece", end, "step")).alias("slot"))
    filled = filled.withColumns({c: F.col("carried") for c in PRICES} | {"volume": F.lit(0.0), "is_real": F.lit(False)})
    kept = marked.withColumns({"close": F.coalesce("close", "carried"), "volume": F.coalesce("volume", F.lit(0.0)), "is_real": F.lit(True)})
    columns = [*same, "slot", *PRICES, "volume", "is_real"]
    every = kept.select(*columns).unionByName(filled.select(*columns)).where("close is not null")

    first = F.greatest(F.col("s.start"), F.col("s.from"))
    pos = F.floor((F.col("slot") - first) / F.col("step")).cast("int")
    opens, closes = F.col("slot") == first, F.col("slot") == F.col("s.end")
    shut = F.when(F.col("s.prev_end") >= F.col("s.from"), F.col("slot") - F.col("s.prev_end") > WEEK_GAP_MINUTES * 60).otherwise(F.lit(True))
    ahead = F.coalesce(F.col("s.next_start") - F.col("slot") > WEEK_GAP_MINUTES * 60, F.lit(True))
    at = F.timestamp_seconds("slot")
    return every.select(
        "source_id", at.cast("timestamp_ntz").alias("timestamp"), *PRICES, "volume", F.col("asset").alias("asset_id"), "calendar_id",
        F.lit(True).alias("is_market_open"), (~F.col("is_real")).alias("is_synthetic_no_trade"), (~F.col("is_real")).alias("is_open_session_gap_fill"),
        F.when(F.col("is_real"), F.lit(0)).otherwise(_minutes(F.col("slot") - F.col("before"))).alias("minutes_since_prev_real_bar"),
        F.concat_ws("_", "asset", F.col("s.nth").cast("string")).alias("session_id"), F.date_format(at, "yyyy-MM-dd").alias("session_date"),
        pos.alias("session_bar_pos"), _minutes(F.col("s.end") - F.col("slot")).alias("session_minutes_to_close"),
        opens.alias("is_session_open_bar"), closes.alias("is_session_close_bar"), (opens & shut).alias("is_weekly_open_bar"), (closes & ahead).alias("is_weekly_close_bar"),
    )


def longer_bars(canonical: DataFrame, feeds: DataFrame, seconds_: int = 3_600, drop_incomplete: bool = True) -> DataFrame:
    """Canonical bars of a longer width, with all their columns.

    A bucket is complete if it has every slot; for ``session_week`` also if the source goes on at or after its end, or if it ends with a
    session's close in a minute of the day in which the source's sessions have closed at least twice.
    """
    step = feeds.select("source_id", F.col("step_seconds").cast("long").alias("step")).dropDuplicates(["source_id"])
    at = seconds("timestamp")
    rows = canonical.join(step, "source_id").withColumns({"slot": at, "bucket": F.floor(at / seconds_) * seconds_})
    real_close = F.col("is_session_close_bar") & ~F.col("is_synthetic_no_trade")
    closes = rows.where(real_close).groupBy("source_id", F.pmod(F.floor(F.col("slot") / 60), F.lit(1_440)).alias("minute")).agg(F.count("*").alias("n")).where("n >= 2").groupBy("source_id").agg(F.collect_set("minute").alias("minutes"))
    last = rows.groupBy("source_id").agg(F.max("slot").alias("source_last"))
    flags = [f"is_{c}" for c in ("market_open", "open_session_gap_fill", "session_open_bar", "session_close_bar", "weekly_open_bar", "weekly_close_bar")]
    g = rows.groupBy("source_id", "bucket").agg(
        F.min_by("open", "slot").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "slot").alias("close"), F.sum("volume").alias("volume"),
        *(F.min_by(c, "slot").alias(c) for c in ("asset_id", "calendar_id", "session_id", "session_date")), *(F.bool_or(c).alias(c) for c in flags), F.bool_and("is_synthetic_no_trade").alias("is_synthetic_no_trade"),
        F.max("minutes_since_prev_real_bar").alias("minutes_since_prev_real_bar"), F.min("session_bar_pos").alias("session_bar_pos"), F.min("session_minutes_to_close").alias("session_minutes_to_close"),
        F.count("*").alias("n"), F.max("slot").alias("ends"), F.max("step").alias("step"),
    )
    g = g.join(last, "source_id").join(closes, "source_id", "left")
    seen = F.col("bucket") + seconds_ <= F.col("source_last") + F.col("step")
    closed = F.col("is_session_close_bar") & F.coalesce(F.array_contains("minutes", F.pmod(F.floor(F.col("ends") / 60), F.lit(1_440))), F.lit(False))
    whole = (F.col("n") * F.col("step") == seconds_) | ((F.col("calendar_id") == "session_week") & (seen | closed))
    return (g.where(whole) if drop_incomplete else g).select("source_id", F.timestamp_seconds("bucket").cast("timestamp_ntz").alias("timestamp"), *(c for c in canonical.columns if c not in ("source_id", "timestamp")))
