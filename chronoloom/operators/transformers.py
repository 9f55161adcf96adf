"""Causal feature transformers with one interface: ``fit`` learns from a frame, ``transform`` adds columns, ``evaluate`` scores them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.operators.relational import average_rank


class CausalTransformer:
    """Base of all transformers; ``columns`` are what it changes, in place."""

    def __init__(self, columns: Sequence[str], by: str = "symbol", at: str = "ts"):
        self.columns, self.by, self.at = list(columns), by, at

    def fit(self, df: DataFrame) -> CausalTransformer:
        return self

    def column(self, name: str) -> Column:
        raise NotImplementedError

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self.column(c) for c in self.columns})

    def window(self):
        return Window.partitionBy(self.by).orderBy(self.at)

    def evaluate(self, before: DataFrame, after: DataFrame, target: str) -> dict[str, tuple[float, float]]:
        """Rank correlation with the target of every column, before and after."""
        return {c: (rank_correlation(before, c, target), rank_correlation(after, c, target)) for c in self.columns}


def rank_correlation(df: DataFrame, a: str, b: str) -> float:
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return both.select(average_rank(a).alias("x"), average_rank(b).alias("y")).agg(F.corr("x", "y")).first()[0]


class SignedLog(CausalTransformer):
    def column(self, name: str) -> Column:
        return F.signum(name) * F.log1p(F.abs(name))


class RollingScore(CausalTransformer):
    """Distance from the mean of the last n rows in standard deviations, the row included, held within the limit."""

    def __init__(self, columns: Sequence[str], n: int, limit: float = 5.0, **kw):
        super().__init__(columns, **kw)
        self.n, self.limit = n, limit

    def column(self, name: str) -> Column:
        w = self.window().rowsBetween(-(self.n - 1), 0)
        z = F.try_divide(F.col(name) - F.avg(name).over(w), F.nullif(F.stddev_samp(name).over(w), F.lit(0.0)))
        return F.when((F.count(name).over(w) == self.n) & z.isNotNull(), F.least(F.greatest(z, F.lit(-self.limit)), F.lit(self.limit)))


class PastWinsorizer(CausalTransformer):
    """Values held within quantiles of the past only; unchanged until ``warm_up`` past values are known."""

    def __init__(self, columns: Sequence[str], low: float = 0.01, high: float = 0.99, warm_up: int = 60, **kw):
        super().__init__(columns, **kw)
        self.low, self.high, self.warm_up = low, high, warm_up

    def column(self, name: str) -> Column:
        w = self.window().rowsBetween(Window.unboundedPreceding, -1)
        lo, hi = (F.percentile(name, F.lit(q)).over(w) for q in (self.low, self.high))
        return F.when(F.count(name).over(w) >= self.warm_up, F.least(F.greatest(name, lo), hi)).otherwise(F.col(name))


class Interactions(CausalTransformer):
    """Products of the pairs of columns whose product correlates most with the target on the fitted frame."""

    def __init__(self, columns: Sequence[str], target: str, top: int = 3, **kw):
        super().__init__(columns, **kw)
        self.target, self.top, self.chosen = target, top, []

    def fit(self, df: DataFrame) -> Interactions:
        pairs = [(a, b) for i, a in enumerate(self.columns) for b in self.columns[i + 1 :]]
        known = df.where(F.col(self.target).isNotNull())
        products = known.select(self.target, *((F.col(a) * F.col(b)).alias(f"{a}*{b}") for a, b in pairs))
        scores = {p: abs(rank_correlation(products, p, self.target) or 0.0) for p in products.columns[1:]}
        self.chosen = [tuple(p.split("*")) for p in sorted(scores, key=lambda p: (-scores[p], p))[: self.top]]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({f"{a}_x_{b}": F.col(a) * F.col(b) for a, b in self.chosen})
