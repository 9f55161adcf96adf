"""Same or near-same records across splits, by an exact prefix-filter join on rare shingles.

A record's shingles are its (asset, action, time cell, class, probability cell), one for each class. The cells are chosen such
that a record of an evaluation split knows every cell a matching training record can lie in: at most two time cells
(half a bar to either side) and two probability cells a class (the tolerance to either side). A training record matches only
if all of its shingles are among those, so the required overlap equals its own number of shingles and its *prefix* is its
single rarest shingle. Evaluation prefixes are indexed: of all shingles of an evaluation record only those are kept that can be
the rarest of a matching training record (the positional filter). Candidates are verified exactly.

The order of shingles is the number of training records in their (class, probability cell), a table of 4 x 28 numbers
whatever the input; any total order gives the same result. Each training record is
shuffled once, each evaluation record a few times, by asset, action, time and probability together, so that an asset or a
model repeating one output doesn't make a hot key.

Defined results: a record with NULL asset, action, timestamp or probability (NaN counts as NULL) matches none; batch_id
doesn't matter; repeated rows give a pair each; the length filter of a prefix join is exact here, as whole records all have as many
shingles as there are classes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HALF_BAR = 450_000_000
TIME_CELL = 7_200_000_000
NEAR, SLACK = 0.01, 1e-9
PROB_CELL = 0.04
CLASSES = 4


def _cell(p: Column) -> Column:
    return F.floor(p / F.lit(PROB_CELL)).cast("int")


def records(rows: DataFrame) -> DataFrame:
    """The columns that count, of records that can match at all."""
    probs = [f"prob_class_{j}" for j in range(CLASSES)]
    whole = rows.dropna(subset=["asset_id", "action_key", "timestamp", *probs])
    return whole.select("row_id", "stage_split", "asset_id", "action_key", F.unix_micros(F.col("timestamp").cast("timestamp")).alias("at"), *(F.col(c).alias(f"p{j}") for j, c in enumerate(probs)))


def _place(cell: Column) -> Column:
    """Position of a cell in the table of ranks; cells beyond 0..1 share the first and the last place."""
    return F.least(F.greatest(cell, F.lit(-1)), F.lit(PLACES - 2)) + 2


PLACES = int(1 / PROB_CELL) + 3


def rarity(train: DataFrame) -> list[list[int]]:
    """Training records by class and probability cell: the order of shingles, CLASSES x PLACES numbers whatever the input."""
    shingles = train.select(F.posexplode(F.array(*(_place(_cell(F.col(f"p{j}"))) for j in range(CLASSES)))).alias("j", "place"))
    table = [[0] * (PLACES + 1) for _ in range(CLASSES)]
    for j, place, n in shingles.groupBy("j", "place").count().collect():
        table[j][place - 1] = n
    return table


def overlaps(rows: DataFrame) -> DataFrame:
    """One row per pair of a training and an evaluation record that are the same or nearly so, with split and asset."""
    found = records(rows)
    train, held = found.where("stage_split = 'train'"), found.where("stage_split in ('valid', 'test')")
    order = [F.array(*map(F.lit, row)) for row in rarity(train)]
    probs = [F.col(f"p{j}") for j in range(CLASSES)]

    def _rank(j: int, cell: Column) -> Column:
        return F.element_at(order[j], _place(cell))

    own = F.array(*(F.struct(_rank(j, _cell(p)).alias("r"), F.lit(j).alias("j"), _cell(p).alias("c")) for j, p in enumerate(probs)))
    probe = train.withColumn("s", F.array_min(own)).withColumn("t", F.floor(F.col("at") / TIME_CELL))
    probe = probe.select("asset_id", "action_key", "t", "s.j", "s.c", F.col("row_id").alias("train_id"), F.col("at").alias("train_at"), *(F.col(f"p{j}").alias(f"q{j}") for j in range(CLASSES)))

    ends = [[_cell(p - F.lit(NEAR + SLACK)), _cell(p + F.lit(NEAR + SLACK))] for p in probs]
    reach = F.least(*(F.greatest(*(_rank(j, c) for c in two)) for j, two in enumerate(ends)))
    every = F.array_distinct(F.flatten(F.array(*(F.array(*(F.struct(_rank(j, c).alias("r"), F.lit(j).alias("j"), c.alias("c")) for c in two)) for j, two in enumerate(ends)))))
    index = held.withColumn("reach", reach).withColumn("every", every).withColumn("s", F.explode(F.filter("every", lambda s: s["r"] <= F.col("reach"))))
    times = F.array_distinct(F.array(F.floor((F.col("at") - HALF_BAR + 1) / TIME_CELL), F.floor((F.col("at") + HALF_BAR - 1) / TIME_CELL)))
    index = index.select("asset_id", "action_key", F.explode(times).alias("t"), "s.j", "s.c", F.col("row_id").alias("held_id"), F.col("stage_split"), F.col("at").alias("held_at"), *(f"p{j}" for j in range(CLASSES)))

    near = F.abs(F.col("train_at") - F.col("held_at")) < HALF_BAR
    for j in range(CLASSES):
        near = near & (F.abs(F.col(f"p{j}") - F.col(f"q{j}")) <= NEAR + SLACK)
    pairs = probe.join(index, ["asset_id", "action_key", "t", "j", "c"]).where(near)
    return pairs.select(F.least("train_id", "held_id").alias("row_id_a"), F.greatest("train_id", "held_id").alias("row_id_b"), "held_id", "stage_split", "asset_id")


def pairs(rows: DataFrame) -> DataFrame:
    """row_id_a < row_id_b of every pair; a training record has one prefix, so no pair is met twice."""
    return overlaps(rows).select("row_id_a", "row_id_b")


def per_split(rows: DataFrame) -> DataFrame:
    """Per evaluation split and asset the pairs and the evaluation records that leaked."""
    held = overlaps(rows)
    return held.groupBy("stage_split", "asset_id", "held_id").agg(F.count("*").alias("n")).groupBy("stage_split", "asset_id").agg(F.sum("n").alias("n_pairs"), F.count("*").alias("n_leaked"))
