"""Implausible values of high, low and volume, judged by what is normal for their source.

Every reading gets, per measured field, a score from an isolation forest that is grown for its source on level, difference,
seasonal and run-length features; explicit physical-limit rules are applied to every reading as well. A case is a value that breaks
a physical limit, or one whose score lies above the threshold of its source and field: ``ABOVE`` of the way from the exact median
score of all readings of the source to 1. Nothing else decides.

The features are made so that the genuine things lie close together: all but run length are multiples of the surroundings that
a busy stretch, a price level shift or the daily cycle carry along. A tree draws its cuts from the range of its readings,
widened upwards by ``PAD`` at every node, so that a reading far outside is isolated near the root even if the tree's few readings
hold none like it; few readings a tree keep frozen runs from hiding behind each other.

Sources are cut into blocks of a fixed number of slots with a margin of readings on both sides, so a source that holds
most rows is scored by many tasks. As the method has it, each of the ``TREES`` trees of a forest is grown on ``SAMPLE`` readings
of its own; all readings of all blocks of the source are in the draw, with equal chances. Every reading is scored in full, and
the usual score is counted from all of them.

Defined results: NULL and NaN values are no cases and take no part in medians; rows with NULL source_id or timestamp are only
held against the physical limits; repeated readings are judged each and copies of a case are cases; empty input gives
empty output; further columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.session import cut
from chronoloom.sources.tables import micros

FIELDS = ("high", "low", "volume")
TREES, SAMPLE, DEPTH = 80, 32, 8
BLOCK_SLOTS, MARGIN_SLOTS = 8_192, 96
#: Readings on each side that are the surrounding time of a reading, its nearest ones, and those a frozen value is looked for in.
NEAR, FOLLOW_NEAR, RUN_NEAR = 32, 6, 12
#: Equal values nearby that make a run, so that the closes they saw are counted.
RUN_MIN = 3
#: How far cuts go beyond the readings of a node: multiples of the surroundings for level, difference and season, readings for runs.
PAD = np.array([80, 80, 80, 8, 8], dtype=np.float32)
FEATURES = len(PAD)
#: Share of the way from the usual score of a source to 1 from which a score is a case.
ABOVE = 1 / 3
#: Readings that a source's forests are grown on; so many, and ten standard deviations more, are expected to leave the blocks.
DRAWN = TREES * SAMPLE


def bar_columns(bars: DataFrame) -> DataFrame:
    step = F.when(F.col("bar_interval").rlike("^[0-9]+m$"), F.regexp_extract("bar_interval", "^([0-9]+)m$", 1).cast("long") * 60)
    step = F.coalesce(F.when(step > 0, step), F.lit(60))
    return bars.select("row_id", "source_id", micros("timestamp").alias("at"), step.alias("step"), *("open", "high", "low", "close", "volume"))


def physical_limits(bars: DataFrame) -> DataFrame:
    """row_id, field_name of every value that no market can have produced."""
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    rules = {"high": (F.col("high") <= 0) | (F.col("high") < top), "low": (F.col("low") <= 0) | (F.col("low") > bottom), "volume": F.col("volume") < 0}
    bad = F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items())))
    return bars.select("row_id", F.explode(bad).alias("field_name"))


def blocked(bars: DataFrame) -> DataFrame:
    """Each reading in its block, and again in the neighbouring block whose margin it lies in (``own`` false)."""
    slot = F.floor(F.col("at") / (F.col("step") * 1_000_000))
    block = F.floor(slot / BLOCK_SLOTS)
    near = F.array_distinct(F.array(block, F.floor((slot - MARGIN_SLOTS) / BLOCK_SLOTS), F.floor((slot + MARGIN_SLOTS) / BLOCK_SLOTS)))
    usable = bars.where("source_id is not null and at is not null")
    return usable.select("*", block.alias("__home"), F.explode(near).alias("block")).withColumn("own", F.col("block") == F.col("__home")).drop("__home", "step")


def _near_median(x: np.ndarray, near: int = NEAR, least: int = 5) -> np.ndarray:
    """Median of the known values of up to ``near`` readings on either side."""
    return pd.Series(x).rolling(2 * near + 1, center=True, min_periods=least).median().to_numpy()


def _repeats(x: np.ndarray, close: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many readings nearby have exactly this value, and how many different closes those readings have."""
    n, near = len(x), RUN_NEAR
    pad = np.full(near, np.nan)
    px, pc = np.concatenate([pad, x, pad]), np.concatenate([pad, close, pad])
    count = np.zeros(n, dtype=np.int16)
    for d in range(-near, near + 1):
        count += px[near + d : near + d + n] == x
    moves = np.zeros(n, dtype=np.int16)
    for i in np.flatnonzero(count >= RUN_MIN):
        same = px[i : i + 2 * near + 1] == x[i]
        c = pc[i : i + 2 * near + 1][same]
        moves[i] = len(np.unique(c[~np.isnan(c)]))
    return count, moves


def features(pdf: pd.DataFrame, hourly: dict[str, np.ndarray], usual: dict[str, float]) -> dict[str, np.ndarray]:
    """Per field an array of ``FEATURES`` columns: level, difference, seasonal, run length, run length while close moves.

    What is measured is the wick (the part of the bar beyond open and close) for high and low, so that price level shifts don't
    matter, and the value itself for volume. Level is its multiple of the surrounding median; difference the same against the
    nearest readings too, if those are high themselves; seasonal that against the mean of the hour of day, again above what
    the nearest readings have. Run lengths are counted in readings beyond the first; bars without trades have none.
    """
    o, h, lo, c, v = (pdf[k].to_numpy(dtype=float, na_value=np.nan) for k in ("open", "high", "low", "close", "volume"))
    hour = (pdf["at"].to_numpy() // 3_600_000_000 % 24).astype(int)
    flat = (v == 0) & (h == lo) & (h == c)
    out = {}
    with np.errstate(all="ignore"):
        wick = {"high": np.log(h / np.fmax(o, c)), "low": np.log(np.fmin(o, c) / np.where(lo > 0, lo, np.nan))}
        for name, x in (("high", wick["high"]), ("low", wick["low"]), ("volume", v)):
            x = np.where(flat | ~(x > 0), np.nan, x)
            base = _near_median(x)
            base = np.where(np.isnan(base) | (base <= 0), usual[name], base)
            level, season = np.log(x / base), np.log(x) - hourly[name][hour]
            parts = [np.nan_to_num(level, nan=0.0, posinf=0.0, neginf=0.0)]
            for part in (level, season):
                follow = _near_median(np.where(np.isfinite(part), part, np.nan), FOLLOW_NEAR, 1)
                parts.append(np.nan_to_num(part - np.fmax(follow, 0.0), nan=0.0, posinf=0.0, neginf=0.0))
            count, moves = _repeats({"high": h, "low": lo, "volume": v}[name], c)
            runs = [np.where(flat, 0, np.maximum(r - 1, 0)) for r in (count, np.minimum(count, moves))]
            out[name] = np.column_stack([*(np.exp(np.clip(p, -6, 6)) for p in parts), *runs]).astype(np.float32)
    return out


#: A node of a tree: what is asked (feature, cut), its left child (the right one follows it; a leaf has itself) and the path length there.
NODE = np.dtype([("feature", "i1"), ("cut", "f4"), ("left", "i2"), ("path", "f4")])


def grow(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """One isolation tree over a sample."""
    nodes = [(0, np.inf, 0, 0.0)]
    todo = [(0, 0, x)]
    while todo:
        at, depth, part = todo.pop()
        if depth == DEPTH or not len(part):
            nodes[at] = (0, np.inf, at, depth + average_path(len(part)))
            continue
        f = int(rng.integers(FEATURES))
        own = part[:, f]
        where = rng.uniform(own.min(), own.max() + PAD[f])
        left = len(nodes)
        nodes[at] = (f, where, left, 0.0)
        nodes += [(0, np.inf, 0, 0.0)] * 2
        todo += [(left, depth + 1, part[own <= where]), (left + 1, depth + 1, part[own > where])]
    return np.array(nodes, dtype=NODE)


def average_path(n: int) -> float:
    """Mean path length of an unsuccessful search in a binary tree of n readings, which normalises the depths."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def grow_forest(x: np.ndarray, seed: int) -> list[np.ndarray]:
    """Trees on readings of their own, or, where there are too few for that, on samples that share some."""
    rng = np.random.default_rng(seed)
    if len(x) >= DRAWN:
        return [grow(x[part], rng) for part in np.split(rng.permutation(len(x))[:DRAWN], TREES)]
    return [grow(x[rng.choice(len(x), SAMPLE, replace=len(x) < SAMPLE)], rng) for _ in range(TREES)]


def score(forest: Sequence[np.ndarray], x: np.ndarray, above: float = 0.0) -> np.ndarray:
    """Isolation scores between 0 and 1 of the rows of x.

    A row that can't reach ``above`` any more, even if all further trees isolated it at once, gets 0 and is left there.
    """
    scale = len(forest) * average_path(SAMPLE)
    longest = np.inf if above <= 0 else -np.log2(above) * scale
    shortest = np.cumsum([t["path"][t["left"] == np.arange(len(t))].min() for t in forest][::-1])[::-1].tolist() + [0.0]
    alive, part = np.arange(len(x)), np.ascontiguousarray(x)
    total = np.zeros(len(x))
    for k, tree in enumerate(forest):
        if k % 8 == 0 and k:
            keep = total + shortest[k] <= longest
            alive, part, total = alive[keep], part[keep], total[keep]
        flat, row = part.ravel(), np.arange(len(part)) * FEATURES
        feature, where, left, path = (np.ascontiguousarray(tree[c]) for c in NODE.names)
        node = np.zeros(len(part), dtype=np.int16)
        for _ in range(DEPTH):
            node = left.take(node) + (flat.take(row + feature.take(node)) > where.take(node))
        total = total + path.take(node)
    out = np.zeros(len(x))
    out[alive] = np.power(2.0, -total / scale)
    return out


def pack_forests(forests: Sequence[list[np.ndarray]]) -> bytes:
    """Number of nodes of every tree, then the nodes."""
    trees = [t for f in forests for t in f]
    return np.array([len(t) for t in trees], dtype=np.int16).tobytes() + b"".join(t.tobytes() for t in trees)


@functools.lru_cache(maxsize=4)
def unpack_forests(data: bytes) -> list[list[np.ndarray]]:
    n = len(FIELDS) * TREES
    ends = np.cumsum(np.frombuffer(data, dtype=np.int16, count=n))
    nodes = np.frombuffer(data, dtype=NODE, offset=2 * n)
    trees = np.split(nodes, ends[:-1])
    return [trees[i : i + TREES] for i in range(0, n, TREES)]


def block_summary(bars: DataFrame) -> DataFrame:
    """Per source, block and hour of day the sums and counts of the logarithms of wicks and volume; one row for some hundred readings."""
    up, down = F.log(F.col("high") / F.greatest("open", "close")), F.log(F.least("open", "close") / F.col("low"))
    known = {"high": F.when((F.col("high") > F.greatest("open", "close")) & (F.greatest("open", "close") > 0), F.log(up)), "low": F.when((F.col("low") > 0) & (F.col("low") < F.least("open", "close")), F.log(down)), "volume": F.when(F.col("volume") > 0, F.log("volume"))}
    hour = F.pmod(F.floor(F.col("at") / F.lit(3_600_000_000)), F.lit(24)).alias("hour")
    own = blocked(bars).where("own")
    return own.groupBy("source_id", "block", hour).agg(*(f(x).alias(f"{p}_{k}") for k, x in known.items() for p, f in (("s", F.sum), ("n", F.count))), F.count("*").alias("n"))


def source_profile(summary: DataFrame) -> DataFrame:
    """Per source its number of readings, and by hour of day the mean logarithm of wicks and volume, from all of them."""
    by_hour = summary.groupBy("source_id", "hour").agg(*(F.try_divide(F.sum(f"s_{k}"), F.sum(f"n_{k}")).alias(k) for k in FIELDS), F.sum("n").alias("n"))
    return by_hour.groupBy("source_id").agg(F.collect_list(F.struct("hour", *FIELDS)).alias("hours"), F.sum("n").alias("n"))


def _profile(row: pd.Series) -> tuple[dict[str, np.ndarray], dict[str, float]]:
    hourly = {}
    for name in FIELDS:
        a = np.full(24, np.nan)
        for h in row["hours"]:
            a[int(h["hour"])] = np.nan if h[name] is None else h[name]
        hourly[name] = np.where(np.isnan(a), np.nanmean(a) if not np.isnan(a).all() else 0.0, a)
    return hourly, {name: float(np.exp(hourly[name].mean())) for name in FIELDS}


def _of(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"source_id": "of_source", "block": "of_block"})


def lots(pdf: pd.DataFrame) -> np.ndarray:
    """A 64-bit number for every reading, as if by chance, from its time and row_id."""
    ids = pdf["row_id"].fillna(-1).to_numpy().astype(np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        x = pdf["at"].to_numpy().astype(np.int64).view(np.uint64) + ids * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return x ^ (x >> np.uint64(31))


def train(bars: DataFrame, pieces: DataFrame, profile: DataFrame) -> DataFrame:
    """source_id, forest (packed forests of all fields), hours; grown on the readings of the source with the lowest lots."""

    def draw(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame(columns=["source_id", "lot", "x"])
        if left.empty or right.empty:
            return none
        left = left.sort_values(["at", "row_id"])
        lot, share = lots(left), (DRAWN + 10 * DRAWN**0.5) / int(right["n"].iloc[0])
        take = left["own"].to_numpy(dtype=bool) & ((lot < np.uint64(share * 2.0**64)) if share < 1 else True)
        if not take.any():
            return none
        made = features(left, *_profile(right.iloc[0]))
        x = np.concatenate([made[name] for name in FIELDS], axis=1)[take]
        return pd.DataFrame({"source_id": [key[0]], "lot": [lot[take].tobytes()], "x": [x.tobytes()]})

    drawn = blocked(bars).groupBy("source_id", "block").cogroup(pieces.groupBy("of_source", "of_block")).applyInPandas(draw, "source_id string, lot binary, x binary")

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        lot = np.concatenate([np.frombuffer(b, dtype=np.uint64) for b in pdf["lot"]])
        x = np.concatenate([np.frombuffer(b, dtype=np.float32).reshape(-1, FEATURES * len(FIELDS)) for b in pdf["x"]])
        x = x[np.lexsort((*x.T, lot))[:DRAWN]]
        seed = int.from_bytes(str(key[0]).encode()[-6:], "big")
        forests = [grow_forest(x[:, FEATURES * i : FEATURES * (i + 1)], seed + i) for i in range(len(FIELDS))]
        return pd.DataFrame({"source_id": [key[0]], "forest": [pack_forests(forests)]})

    return drawn.groupBy("source_id").applyInPandas(fit, "source_id string, forest binary").join(profile, "source_id")


def usual_scores(judged: DataFrame) -> DataFrame:
    """of_source, of_field, usual: the exact median of all scores, of which ``scored`` has a packed row and its counts a block.

    The bits of positive floats are in the order of the floats: they are counted by their upper half, which the blocks did, and
    then by the lower half in the one or two cells that hold the middle.
    """
    w = Window.partitionBy("source_id", "field_name")  # one row per cell, 65,536 at most
    counted = judged.where("cell is not null").groupBy("source_id", "field_name", "cell").agg(F.sum("n").alias("n"))
    before, total = F.sum("n").over(w.orderBy("cell")) - F.col("n"), F.sum("n").over(w)
    ranked = counted.select("*", before.alias("before"), F.floor((total - 1) / 2).alias("lo"), F.floor(total / 2).alias("hi"))
    middle = ranked.where("before + n > lo and before <= hi").select(F.col("source_id").alias("of_source"), F.col("field_name").alias("of_field"), "cell", "before", "lo", "hi")
    held = judged.where("scores is not null").select("source_id", "field_name", "scores").join(middle, (F.col("source_id") == F.col("of_source")) & (F.col("field_name") == F.col("of_field")))

    def lower(parts):
        for pdf in parts:
            out = []
            for row in pdf.itertuples():
                bits = np.frombuffer(row.scores, dtype=np.uint32)
                bits, n = np.unique(bits[bits >> 16 == row.cell], return_counts=True)
                out.append(pd.DataFrame({"of_source": row.of_source, "of_field": row.of_field, "cell": row.cell, "before": row.before, "lo": row.lo, "hi": row.hi, "x": bits.view(np.float32).astype(float), "n": n}))
            if out:
                yield pd.concat(out)

    key = ["of_source", "of_field", "cell", "before", "lo", "hi"]
    fine = held.select(*key, "scores").mapInPandas(lower, "of_source string, of_field string, cell long, before long, lo long, hi long, x double, n long").groupBy(*key, "x").agg(F.sum("n").alias("n"))
    end = F.col("before") + F.sum("n").over(Window.partitionBy("of_source", "of_field", "cell").orderBy("x"))
    times = sum(((F.col("end") > F.col(k)) & (F.col("end") - F.col("n") <= F.col(k))).cast("int") for k in ("lo", "hi"))
    return fine.withColumn("end", end).groupBy("of_source", "of_field").agg((F.sum(F.col("x") * times) / 2).alias("usual"))


def scored(bars: DataFrame, every: bool = False, above: float = ABOVE) -> DataFrame:
    """row_id, field_name, score of the readings whose score lies above the threshold of their source (``every``: of all readings)."""
    summary = cut(block_summary(bars))
    profile = source_profile(summary)
    blocks = summary.select("source_id", "block").distinct()
    models = train(bars, _of(blocks.join(profile, "source_id")), profile)
    pieces = _of(blocks.join(models, "source_id"))
    least = -np.inf if every else min(above, 1.0)  # no threshold lies lower, as scores lie between 0 and 1

    def judge(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=["source_id", "field_name", "row_id", "score", "scores", "cell", "n"])
        left = left.sort_values(["at", "row_id"])
        made = features(left, *_profile(right.iloc[0]))
        forests = unpack_forests(bytes(right["forest"].iloc[0]))
        ids, own = left["row_id"].astype("Int64").array, left["own"].to_numpy(dtype=bool)
        out = []
        for i, name in enumerate(FIELDS):
            known = left[name].notna().to_numpy() & own
            s = score(forests[i], made[name][known]).astype(np.float32)
            take = s >= least
            cells, n = np.unique(s.view(np.uint32) >> 16, return_counts=True)
            high, rest = int(take.sum()), len(cells)
            columns = {"row_id": [*ids[known][take], *[None] * (1 + rest)], "score": [*s[take].tolist(), *[None] * (1 + rest)], "scores": [*[None] * high, s.tobytes(), *[None] * rest]}
            counted = {"cell": [*[None] * (high + 1), *cells.tolist()], "n": [*[None] * (high + 1), *n.tolist()]}
            out.append(pd.DataFrame({k: pd.array(v, dtype="Int64") if k in ("row_id", "cell", "n") else pd.Series(v, dtype=object) for k, v in (columns | counted).items()}).assign(source_id=key[0], field_name=name))
        return pd.concat(out)

    judged = blocked(bars).groupBy("source_id", "block").cogroup(pieces.groupBy("of_source", "of_block")).applyInPandas(judge, "source_id string, field_name string, row_id long, score double, scores binary, cell long, n long")
    if every:
        return judged.where("score is not null").select("row_id", "field_name", "score")
    judged = cut(judged)
    usual = usual_scores(judged)
    high = judged.where("score is not null").join(usual, (F.col("source_id") == F.col("of_source")) & (F.col("field_name") == F.col("of_field")))
    return high.where(F.col("score") >= F.col("usual") + above * (1 - F.col("usual"))).select("row_id", "field_name", "score")


def implausible(raw: DataFrame, above: float = ABOVE) -> DataFrame:
    """row_id, field_name of every value of high, low and volume that does not come from the market."""
    bars = bar_columns(raw)
    return physical_limits(bars).unionByName(scored(bars, above=above).select("row_id", "field_name")).distinct()


def every_score(raw: DataFrame) -> DataFrame:
    """Isolation score of every known value of every reading."""
    return scored(bar_columns(raw), every=True)
