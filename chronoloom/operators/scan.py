"""Sequential folds over ordered keys: one operator behind every recursive filter.

``scan`` runs a pure fold (state, row) -> (state, outputs) in order. ``affine_scan`` is for recursions y[t] = a[t] * y[t-1] + b[t]
(exponential means, GARCH variances): such steps compose to one step of the same form, so a key is cut into blocks, every
block is reduced to its (a, b), the blocks of a key are chained, and all blocks run in parallel from their starting values. A key
with most rows is therefore no hot task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_US = 7 * 86_400_000_000


def affine_fold(a: np.ndarray, b: np.ndarray, y: float) -> np.ndarray:
    """y[t] = a[t] * y[t-1] + b[t] from a starting value; a step with NaN keeps the value."""
    out = np.empty(len(a))
    for i in range(len(a)):
        if a[i] == a[i] and b[i] == b[i]:
            y = a[i] * y + b[i] if y == y else b[i] / (1 - a[i]) if a[i] != 1 else b[i]
        out[i] = y
    return out


def _schema(df: DataFrame, drop: Sequence[str] = ()) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in df.dtypes if n not in drop)


def affine_scan(df: DataFrame, keys: Sequence[str], order: str, steps: dict[str, tuple], block_us: int = BLOCK_US) -> DataFrame:
    """Add a column per entry of ``steps``: name -> (a, b) columns of the recursion; before the first known step it is NULL.

    The first known step of a key starts at its fixed point b / (1 - a): an exponential mean starts at its first value.
    """
    rows = df.withColumns({f"__a_{n}": a for n, (a, _) in steps.items()} | {f"__b_{n}": b for n, (_, b) in steps.items()})
    rows = rows.withColumn("__block", F.floor(F.unix_micros(F.col(order).cast("timestamp")) / block_us))
    names, keys = list(steps), list(keys)
    helper = [f"__{p}_{n}" for n in names for p in "ab"]
    key_types = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes if n in keys)

    def reduce_block(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        out = dict(zip([*keys, "__block"], key, strict=True))
        for n in names:
            a, b, first = 1.0, 0.0, np.nan
            for x, y in zip(pdf[f"__a_{n}"].to_numpy(float), pdf[f"__b_{n}"].to_numpy(float), strict=True):
                if x == x and y == y:
                    first = (y / (1 - x) if x != 1 else y) if first != first else x * first + y
                    a, b = a * x, x * b + y
            out |= {f"__ra_{n}": a, f"__rb_{n}": b, f"__rf_{n}": first}
        return pd.DataFrame([out])

    def chain(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__block").reset_index(drop=True)
        for n in names:
            y, starts = np.nan, []
            for a, b, first in zip(pdf[f"__ra_{n}"], pdf[f"__rb_{n}"], pdf[f"__rf_{n}"], strict=True):
                starts.append(y)
                y = first if y != y else a * y + b
            pdf[f"__y_{n}"] = starts
        return pdf[[*keys, "__block", *(f"__y_{n}" for n in names)]]

    doubles = lambda *p: ", ".join(f"__{x}_{n} double" for n in names for x in p)
    thin = rows.select(*keys, "__block", order, *helper)
    reduced = thin.groupBy(*keys, "__block").applyInPandas(reduce_block, f"{key_types}, __block long, {doubles('ra', 'rb', 'rf')}")
    starts = reduced.groupBy(*keys).applyInPandas(chain, f"{key_types}, __block long, {doubles('y')}")
    starts = starts.withColumnsRenamed({k: f"__k_{k}" for k in keys} | {"__block": "__start_block"})

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values(order)
        for n in names:
            y = right[f"__y_{n}"].iloc[0] if len(right) else np.nan
            left[n] = affine_fold(left[f"__a_{n}"].to_numpy(float), left[f"__b_{n}"].to_numpy(float), y)
        return left.drop(columns=[*helper, "__block"])

    schema = _schema(rows, [*helper, "__block"]) + ", " + ", ".join(f"`{n}` double" for n in names)
    out = rows.groupBy(*keys, "__block").cogroup(starts.groupBy(*(f"__k_{k}" for k in keys), "__start_block")).applyInPandas(run, schema)
    return out.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in names})


def ewm(df: DataFrame, keys: Sequence[str], order: str, means: dict[str, tuple]) -> DataFrame:
    """Exponential means: name -> (column, alpha). NULL values are skipped; they neither decay nor change the mean."""
    return affine_scan(df, keys, order, {n: (F.when(x.isNotNull(), F.lit(1.0 - alpha)), x * alpha) for n, (x, alpha) in means.items()})


def scan(df: DataFrame, keys: Sequence[str], order: str, fold: Callable, start: Callable[[], object], outputs: str) -> DataFrame:
    """Run ``fold(state, row as dict) -> (state, dict of outputs)`` over the ordered rows of every key.

    For folds whose state can't be summarised; the rows of a key are bounded by the time grid they lie on.
    """
    names = [x.split()[0] for x in outputs.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        state, out = start(), []
        pdf = pdf.sort_values(order)
        for row in pdf.to_dict("records"):
            state, made = fold(state, row)
            out.append([made.get(n) for n in names])
        return pd.concat([pdf.reset_index(drop=True), pd.DataFrame(out, columns=names)], axis=1)

    return df.groupBy(*keys).applyInPandas(run, f"{_schema(df)}, {outputs}")
