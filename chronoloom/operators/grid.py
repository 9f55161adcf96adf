"""Irregular readings onto the regular grid of a source's open hours, with missing slots predicted.

Close and volume of each source are regressed on trend and daily and weekly harmonics. The normal equations are plain sums
over the reading that counts of every slot, aggregated in parallel with partial sums on every task; only the small systems,
one row a source, are solved in Python. A missing slot gets the prediction plus the residual of its neighbours, bridged linearly
between the observed readings at both ends of the gap. The grid is never joined against the readings: slots without a
reading are generated from the gap between one observed slot and the next.

Defined results: rows with NULL source_id or timestamp are ignored; rows with NULL or NaN close don't fill a slot but do count
for a source's first and last slot; of several readings of a slot the one ingested last wins (then later timestamp, larger
row_id; NULL ingested_at comes first); readings in closed hours are left out; a source unknown to feeds is always
open and its step is read from bar_interval; a source without any close has only missing slots, with NULL close and volume.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.operators.blocks import last_known
from chronoloom.sources.tables import seconds

DAY, WEEK, YEAR = 86_400, 604_800, 31_557_600
#: Slots of one block of the ordered scan, and of one piece in which a gap is expanded.
BLOCK_SLOTS = 8_192


def is_open(slot: Column, calendar: Column) -> Column:
    """Open hours of a calendar at an epoch second: session_week is Mon-Fri 00:00-20:59, Mon-Thu and Sun 22:00-23:59."""
    day = F.pmod(F.floor(slot / DAY) + 3, F.lit(7))  # Monday is 0
    hour = F.floor(F.pmod(slot, F.lit(DAY)) / 3600)
    session = ((day <= 4) & (hour <= 20)) | (((day <= 3) | (day == 6)) & (hour >= 22))
    return F.when(calendar == "session_week", session).otherwise(F.lit(True))


def design(slot: Column) -> list[Column]:
    """Regressors at an epoch second: constant, trend, two daily harmonics, one weekly harmonic."""
    t = slot.cast("double")
    waves = [f(t * F.lit(2 * np.pi * k / period)) for period, k in ((DAY, 1), (DAY, 2), (WEEK, 1)) for f in (F.sin, F.cos)]
    return [F.lit(1.0), (t - F.lit(1_704_067_200.0)) / YEAR, *waves]


P = 8


def slotted(bars: DataFrame, feeds: DataFrame) -> DataFrame:
    """Every usable row with the slot it falls in, the step and the calendar of its source."""
    known = feeds.select("source_id", F.col("step_seconds").cast("long").alias("feed_step"), "calendar_id").dropDuplicates(["source_id"])
    rows = bars.where("source_id is not null and timestamp is not null").select("source_id", "row_id", "bar_interval", seconds("timestamp").alias("second"), "timestamp", "ingested_at", "close", "volume")
    own = F.when(F.col("bar_interval").rlike("^[0-9]+m$"), F.regexp_extract("bar_interval", "^([0-9]+)", 1).cast("long") * 60)
    rows = rows.join(known, "source_id", "left").withColumn("step", F.coalesce(F.when(F.col("feed_step") > 0, F.col("feed_step")), F.when(own > 0, own), F.lit(60)))
    slot = (F.floor(F.col("second") / F.col("step")) * F.col("step")).cast("long")
    return rows.select("source_id", slot.alias("slot"), "step", "calendar_id", "close", F.when(F.col("volume") >= 0, F.log1p("volume")).alias("lvolume"), "ingested_at", "timestamp", "row_id")


def readings(rows: DataFrame) -> DataFrame:
    """One row per source and slot with a close in it: close and volume of the reading that counts."""
    known = rows.where("close is not null")
    per_slot = known.groupBy("source_id", "slot", "step", "calendar_id").agg(F.max_by(F.struct("close", "lvolume"), F.struct("ingested_at", "timestamp", "row_id")).alias("r"))
    return per_slot.select("source_id", "slot", "step", "calendar_id", "r.close", "r.lvolume")


def normal_equations(obs: DataFrame) -> DataFrame:
    """source_id, beta_close, beta_volume: coefficients of the harmonic regressions of every source."""
    targets = ("close", "lvolume")
    x = [f"x{i}" for i in range(P)]
    rows = obs.select("source_id", *targets, *(c.alias(n) for n, c in zip(x, design(F.col("slot")), strict=True)))
    pairs = list(combinations_with_replacement(range(P), 2))
    sums = [F.sum(F.when(F.col(y).isNotNull(), F.col(x[i]) * F.col(x[j]))).alias(f"{y}_{i}_{j}") for y in targets for i, j in pairs]
    sums += [F.sum(F.col(x[i]) * F.col(y)).alias(f"{y}_{i}") for y in targets for i in range(P)]
    grams = rows.groupBy("source_id").agg(*sums)

    def solve(batches):
        for pdf in batches:
            out = {"source_id": pdf["source_id"]}
            for y in targets:
                a = np.zeros((len(pdf), P, P))
                for i, j in pairs:
                    a[:, i, j] = a[:, j, i] = pdf[f"{y}_{i}_{j}"].fillna(0)
                b = np.column_stack([pdf[f"{y}_{i}"].fillna(0) for i in range(P)])
                out[f"beta_{y}"] = [np.linalg.lstsq(m, v, rcond=1e-12)[0].tolist() if m.any() else None for m, v in zip(a, b, strict=True)]
            yield pd.DataFrame(out)

    return grams.mapInPandas(solve, "source_id string, beta_close array<double>, beta_lvolume array<double>")


def predicted(slot: Column, beta: str) -> Column:
    terms = [F.col(beta)[i] * c for i, c in enumerate(design(slot))]
    return sum(terms[1:], terms[0])


def _span(start: Column, stop: Column, step: Column) -> Column:
    """Pieces of the slots from start to stop (both inclusive): their first slots, BLOCK_SLOTS slots apart."""
    return F.when(start <= stop, F.sequence(start, stop, step * BLOCK_SLOTS))


def spans(every: DataFrame) -> DataFrame:
    """The reading of every slot that has one, and the end of every source (``real`` false), each with the reading ``before`` it and the first slot ``start`` after that."""
    bounds = every.groupBy("source_id").agg(F.min("slot").alias("first"), F.max("slot").alias("last"), F.max("step").alias("step"), F.max("calendar_id").alias("calendar_id"))
    nothing = F.lit(None).cast("double")
    ends = bounds.select("source_id", (F.col("last") + F.col("step")).alias("slot"), "step", "calendar_id", nothing.alias("close"), nothing.alias("lvolume"), F.lit(False).alias("real"))
    rows = readings(every).withColumn("real", F.lit(True)).unionByName(ends).withColumn("block", F.floor(F.col("slot") / (F.col("step") * BLOCK_SLOTS)))
    rows = last_known(rows, ["source_id"], ["slot"], "block", F.struct("slot", "close", "lvolume"), "before", inclusive=False)
    return rows.join(bounds.select("source_id", "first"), "source_id").withColumn("start", F.coalesce(F.col("before.slot") + F.col("step"), F.col("first"))).drop("first", "block")


def gaps(rows: DataFrame) -> DataFrame:
    """Every slot of the open hours (``slot_start``) between a row of ``spans`` and the reading before it, with the columns of that row."""
    columns = rows.columns
    pieces = rows.where(F.col("start") < F.col("slot")).select(*columns, F.explode(_span(F.col("start"), F.col("slot") - F.col("step"), F.col("step"))).alias("piece"))
    last = F.least(F.col("piece") + F.col("step") * (BLOCK_SLOTS - 1), F.col("slot") - F.col("step"))
    return pieces.select(*columns, F.explode(F.sequence("piece", last, "step")).alias("slot_start")).where(is_open(F.col("slot_start"), F.col("calendar_id")))


def regular_grid(bars: DataFrame, feeds: DataFrame) -> DataFrame:
    """source_id, slot_start, close, volume, is_missing, volume_is_filled: every slot of the open hours of every source.

    ``is_missing`` marks slots in which no row with a close falls; their close and volume are predicted. The regression sees the
    reading that counts of every slot in open hours, once.
    """
    every = slotted(bars, feeds)
    beta = normal_equations(readings(every).where(is_open(F.col("slot"), F.col("calendar_id"))))
    rows = spans(every).join(beta, "source_id", "left")
    rows = rows.withColumns({f"res_{y}": F.col(y) - predicted(F.col("slot"), f"beta_{y}") for y in ("close", "lvolume")} | {f"before_{y}": F.col(f"before.{y}") - predicted(F.col("before.slot"), f"beta_{y}") for y in ("close", "lvolume")})
    weight = (F.col("slot_start") - F.col("before.slot")) / (F.col("slot") - F.col("before.slot"))

    def bridged(y: str) -> Column:
        left, right = F.col(f"before_{y}"), F.col(f"res_{y}")
        return predicted(F.col("slot_start"), f"beta_{y}") + F.coalesce(left * (1 - weight) + right * weight, left, right, F.lit(0.0))

    filled = gaps(rows).select("source_id", "slot_start", bridged("close").alias("close"), F.greatest(F.expm1(bridged("lvolume")), F.lit(0.0)).alias("volume"), F.lit(True).alias("is_missing"), F.lit(True).alias("volume_is_filled"))
    own = F.coalesce(F.col("lvolume"), predicted(F.col("slot"), "beta_lvolume") + F.coalesce("before_lvolume", F.lit(0.0)))
    kept = rows.where("real").where(is_open(F.col("slot"), F.col("calendar_id"))).select("source_id", F.col("slot").alias("slot_start"), "close", F.greatest(F.expm1(own), F.lit(0.0)).alias("volume"), F.lit(False).alias("is_missing"), F.col("lvolume").isNull().alias("volume_is_filled"))
    return kept.unionByName(filled)


def missing_slots(bars: DataFrame, feeds: DataFrame) -> DataFrame:
    """source_id, slot_start of the slots that ``regular_grid`` marks as missing: its gaps, without the fit that only fills them."""
    return gaps(spans(slotted(bars, feeds))).select("source_id", "slot_start")
