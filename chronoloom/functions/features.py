"""Registry of scalar and window features over bars (open, high, low, close, volume, turnover)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.functions.windows import clip, col, div, lag, ln, nz, quotient, roll, trailing, upto, values



class _Lazy:
    """Columns by short names, made when a builder runs: a Column needs a session, the registry doesn't."""

    def __getattr__(self, name: str) -> Column:
        x = F.col
        return {"o": lambda: x("open"), "h": lambda: x("high"), "l": lambda: x("low"), "c": lambda: x("close"), "v": lambda: x("volume"), "t": lambda: x("turnover"), "typical": lambda: (x("high") + x("low") + x("close")) / 3}[name]()


bar = _Lazy()


@dataclass(frozen=True)
class Feature:
    """A named column builder; ``needs`` are columns that must be added first, by other features."""

    name: str
    build: Callable[[], Column]
    needs: tuple[str, ...] = ()
    domain: str = "price"


FEATURES: dict[str, Feature] = {}


def feature(name: str, *needs: str, domain: str = "price"):
    def keep(build: Callable[[], Column]) -> Callable[[], Column]:
        if name in FEATURES:
            raise ValueError(f"feature {name} is registered twice")
        FEATURES[name] = Feature(name, build, needs, domain)
        return build

    return keep


def add(name: str, build: Callable[[], Column], *needs: str, domain: str = "price") -> None:
    feature(name, *needs, domain=domain)(build)


def compute(df: DataFrame, names: list[str]) -> DataFrame:
    """Add features in as few stages as their dependencies allow; every stage is one projection over the same sort."""
    wanted: dict[str, None] = {}

    def visit(name: str) -> None:
        if name not in FEATURES:
            raise KeyError(f"unknown feature {name}; registered are {sorted(FEATURES)}")
        for n in FEATURES[name].needs:
            visit(n)
        wanted[name] = None

    for n in names:
        visit(n)
    done = set(df.columns)
    while todo := [n for n in wanted if n not in done]:
        stage = [n for n in todo if all(x in done for x in FEATURES[n].needs)]
        df = df.withColumns({n: FEATURES[n].build() for n in stage})
        done |= set(stage)
    return df


def r() -> Column:
    return F.col("ret")


def sma(x, n):
    return roll(F.avg, x, n)


def sd(x, n):
    return roll(F.stddev_samp, x, n)


def hi(x, n):
    return roll(F.max, x, n)


def lo(x, n):
    return roll(F.min, x, n)


def total(x, n):
    return roll(F.sum, x, n)


add("ret", lambda: ln(div(bar.c, nz(lag(bar.c)))), domain="return")
add("roc_6", lambda: quotient(bar.c - lag(bar.c, 6), lag(bar.c, 6)))
add("roc_accel_6", lambda: F.col("roc_6") - lag("roc_6", 6), "roc_6")
add("return_std_20", lambda: sd("ret", 20), "ret", domain="volatility")
add("pct_b_20", lambda: div(bar.c - (sma(bar.c, 20) - 2 * sd(bar.c, 20)), nz(4 * sd(bar.c, 20))))
add("bandwidth_20", lambda: div(4 * sd(bar.c, 20), nz(sma(bar.c, 20))))
add("sma_deviation_20", lambda: div(bar.c - sma(bar.c, 20), nz(sma(bar.c, 20))))
add("funding_sum_8", lambda: F.sum(bar.t).over(trailing(8)), domain="funding")
add("funding_ma_8", lambda: F.avg(bar.t).over(trailing(8)), domain="funding")
add("funding_ma_diff", lambda: F.avg(bar.t).over(trailing(8)) - F.avg(bar.t).over(trailing(24)), domain="funding")
add("zscore_pop_21", lambda: F.coalesce(F.when(roll(F.stddev_pop, bar.t, 21) > 1e-8, div(bar.t - sma(bar.t, 21), roll(F.stddev_pop, bar.t, 21))), F.lit(0.0)), domain="funding")
add("zscore_samp_21", lambda: clip(div(bar.t - sma(bar.t, 21), nz(sd(bar.t, 21))), -5, 5), domain="funding")
add("premium_ma_8", lambda: F.avg(bar.c - bar.o).over(trailing(8)), domain="premium")
add("premium_change", lambda: (bar.c - bar.o) - lag(bar.c - bar.o), domain="premium")
add("premium_range_8", lambda: F.max(bar.c - bar.o).over(trailing(8)) - F.min(bar.c - bar.o).over(trailing(8)), domain="premium")
add("vwap", lambda: div(bar.t, nz(bar.v)))
add("basis", lambda: div(bar.c - F.col("vwap"), nz(F.col("vwap"))), "vwap")
add("mark_close_range", lambda: div(bar.h - bar.l, nz(F.col("vwap"))), "vwap")
add("mark_return_diff", lambda: ln(div("vwap", nz(lag("vwap")))) - r(), "vwap", "ret")
add("close_vs_mark_vol_20", lambda: div(sd("ret", 20), nz(sd("mark_return_diff", 20))), "ret", "mark_return_diff", domain="volatility")
add("oi_pct_change", lambda: div(bar.t - lag(bar.t), nz(lag(bar.t))), domain="interest")
add("oi_to_sma_20", lambda: div(bar.t, nz(sma(bar.t, 20))), domain="interest")
add("volume_to_oi", lambda: div(bar.v, nz(bar.t)), domain="interest")
add("oi_weighted_return", lambda: r() * F.signum(bar.t - lag(bar.t)), "ret", domain="interest")
add("body_ratio", lambda: F.when(bar.h == bar.l, 0.0).otherwise(div(F.abs(bar.c - bar.o), bar.h - bar.l)))
add("upper_shadow", lambda: F.when(bar.h == bar.l, 0.0).otherwise(div(bar.h - F.greatest(bar.o, bar.c), bar.h - bar.l)))
add("lower_shadow", lambda: F.when(bar.h == bar.l, 0.0).otherwise(div(F.least(bar.o, bar.c) - bar.l, bar.h - bar.l)))
add("candle_sign", lambda: F.signum(bar.c - bar.o))

add("gain_known", lambda: F.when(lag(bar.c).isNull(), 0.0).otherwise(F.greatest(bar.c - lag(bar.c), F.lit(0.0))))
add("loss_known", lambda: F.when(lag(bar.c).isNull(), 0.0).otherwise(F.greatest(lag(bar.c) - bar.c, F.lit(0.0))))
add("rsi_14", lambda: 100 - div(F.lit(100.0), 1 + div(sma("gain_known", 14), nz(sma("loss_known", 14)))), "gain_known", "loss_known")
add("stoch_k_14", lambda: 100 * div(bar.c - lo(bar.l, 14), nz(hi(bar.h, 14) - lo(bar.l, 14))))
add("stoch_d_14", lambda: sma("stoch_k_14", 3), "stoch_k_14")
add("volume_roc_6", lambda: div(bar.v - lag(bar.v, 6), nz(lag(bar.v, 6))), domain="volume")
add("volume_ratio_20", lambda: div(bar.v, nz(sma(bar.v, 20))), domain="volume")
add("vwap_deviation", lambda: div(bar.c - F.col("vwap"), nz(F.col("vwap"))), "vwap")
add("vwap_return", lambda: ln(div("vwap", nz(lag("vwap")))), "vwap")
add("cycle_position", lambda: F.floor(F.hour("ts") / 8).cast("int"), domain="calendar")
add("weekday", lambda: F.weekday("ts"), domain="calendar")
add("range_expansion_20", lambda: div(bar.h - bar.l, nz(sma(bar.h - bar.l, 20))), domain="volatility")
add("vol_6", lambda: sd("ret", 6), "ret", domain="volatility")
add("vol_of_vol_20", lambda: sd("vol_6", 20), "vol_6", domain="volatility")
add("vol_10", lambda: sd("ret", 10), "ret", domain="volatility")
add("vol_momentum_20", lambda: clip(div(F.col("vol_10") - lag("vol_10", 10), nz(lag("vol_10", 10))), -1, 15), "vol_10", domain="volatility")


def _skew(n):
    g1 = F.nullif(roll(F.skewness, "ret", n), F.lit(float("nan")))  # infinite returns have none
    return clip((n * (n - 1)) ** 0.5 / (n - 2) * g1, -5, 5)


def _kurt(n):
    g2 = F.nullif(roll(F.kurtosis, "ret", n), F.lit(float("nan")))
    return clip((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6), -10, 30)


add("skew_30", lambda: _skew(30), "ret", domain="distribution")
add("kurtosis_30", lambda: _kurt(30), "ret", domain="distribution")
add("max_drawdown_20", lambda: F.aggregate(values(bar.c, 20), F.struct(F.lit(float("-inf")).alias("peak"), F.lit(float("nan")).alias("dd")), lambda s, x: F.struct(F.greatest(s["peak"], x).alias("peak"), F.least(s["dd"], quotient(x, F.greatest(s["peak"], x)) - 1).alias("dd")), lambda s: s["dd"]), domain="risk")
add("sharpe_20", lambda: clip(div(sma("ret", 20), nz(sd("ret", 20))) * 20**0.5, -5, 5), "ret", domain="risk")


def _sortino(n):
    w = trailing(n)
    neg = F.when(r() < 0, r())
    return F.when((F.count(r()).over(w) == n) & (F.count(neg).over(w) >= 2), div(F.avg(r()).over(w), nz(F.stddev_samp(neg).over(w))))


add("sortino_20", lambda: _sortino(20), "ret", domain="risk")
add("calmar_20", lambda: div(quotient(bar.c - lag(bar.c, 20), lag(bar.c, 20)), nz(F.abs(F.col("max_drawdown_20")))), "max_drawdown_20", domain="risk")
add("ret_lag", lambda: lag("ret"), "ret", domain="return")


def _autocorr(n):
    w = trailing(n - 1)
    both = F.col("ret_lag").isNotNull() & r().isNotNull()
    x, y = F.when(both, F.col("ret_lag")), F.when(both, r())
    cov = F.avg(x * y).over(w) - F.avg(x).over(w) * F.avg(y).over(w)
    return F.when(F.count(x).over(w) == n - 1, div(cov, nz(F.stddev_pop(x).over(w) * F.stddev_pop(y).over(w))))


add("autocorr_20", lambda: _autocorr(20), "ret", "ret_lag", domain="distribution")
add("price_zscore_20", lambda: clip(div(bar.c - sma(bar.c, 20), nz(sd(bar.c, 20))), -4, 4))
add("up", lambda: F.when(r() > 0, 1.0).otherwise(0.0), "ret", domain="return")
add("win_rate_20", lambda: sma("up", 20), "up", domain="return")
add("signed_volume", lambda: F.signum(bar.c - lag(bar.c)) * bar.v, domain="volume")
add("obv", lambda: F.when(F.col("signed_volume").isNotNull(), F.sum("signed_volume").over(upto())), "signed_volume", domain="volume")
add("obv_zscore_20", lambda: clip(div(F.col("obv") - sma("obv", 20), nz(sd("obv", 20))), -4, 4), "obv", domain="volume")
add("flow_up", lambda: F.when(bar.typical > lag(bar.typical), bar.typical * bar.v).otherwise(0.0), domain="volume")
add("flow_down", lambda: F.when(bar.typical < lag(bar.typical), bar.typical * bar.v).otherwise(0.0), domain="volume")
add("mfi_14", lambda: 100 - div(F.lit(100.0), 1 + div(total("flow_up", 14), nz(total("flow_down", 14)))), "flow_up", "flow_down", domain="volume")
add("cmf_20", lambda: div(total(F.coalesce(div((bar.c - bar.l) - (bar.h - bar.c), nz(bar.h - bar.l)), F.lit(0.0)) * bar.v, 20), nz(total(bar.v, 20))), domain="volume")
add("tp_sma_20", lambda: sma(bar.typical, 20))
add("tp_deviation", lambda: F.abs(bar.typical - F.col("tp_sma_20")), "tp_sma_20")
add("cci_20", lambda: div(bar.typical - F.col("tp_sma_20"), nz(0.015 * sma("tp_deviation", 20))), "tp_sma_20", "tp_deviation")
add("long_short_ratio", lambda: div(bar.h - bar.o, nz(bar.o - bar.l)), domain="sentiment")
add("long_short_change", lambda: clip(F.col("long_short_ratio") - lag("long_short_ratio"), -1, 1), "long_short_ratio", domain="sentiment")
add("amihud_20", lambda: sma(div(F.abs(r()), nz(bar.t)), 20), "ret", domain="liquidity")


def _rooted(x, n):
    return F.sqrt(F.abs(sma(x, n)))


def _log_ratio(x: str, y: str) -> Column:
    return ln(quotient(getattr(bar, x), getattr(bar, y)))


def _rogers_satchell() -> Column:
    return _log_ratio("h", "c") * _log_ratio("h", "o") + _log_ratio("l", "c") * _log_ratio("l", "o")


add("parkinson_20", lambda: _rooted(F.pow(_log_ratio("h", "l"), 2) / (4 * F.log(F.lit(2.0))), 20), domain="volatility")
add("garman_klass_20", lambda: _rooted(0.5 * F.pow(_log_ratio("h", "l"), 2) - (2 * F.log(F.lit(2.0)) - 1) * F.pow(_log_ratio("c", "o"), 2), 20), domain="volatility")
add("rogers_satchell_20", lambda: _rooted(_rogers_satchell(), 20), domain="volatility")
add("overnight", lambda: ln(div(bar.o, nz(lag(bar.c)))), domain="return")
add("yang_zhang_20", lambda: F.sqrt(F.abs(roll(F.var_samp, "overnight", 20) + 0.34 / (1.34 + 21 / 19) * roll(F.var_samp, _log_ratio("c", "o"), 20) + (1 - 0.34 / (1.34 + 21 / 19)) * sma(_rogers_satchell(), 20))), "overnight", domain="volatility")
add("pressure_20", lambda: sma(F.col("candle_sign") * F.col("volume_ratio_20"), 20), "candle_sign", "volume_ratio_20", domain="composite")


def _hurst(n):
    x = values("ret", n)
    mean = F.aggregate(x, F.lit(0.0), lambda a, b: a + b) / n
    start = F.struct(F.lit(0.0).alias("run"), F.lit(0.0).alias("hi"), F.lit(0.0).alias("lo"), F.lit(0.0).alias("ss"))

    def step(s, y):
        run = s["run"] + y - mean
        return F.struct(run.alias("run"), F.greatest(s["hi"], run).alias("hi"), F.least(s["lo"], run).alias("lo"), (s["ss"] + F.pow(y - mean, 2)).alias("ss"))

    end = F.aggregate(x, start, step)
    return clip(div(F.log(div(end["hi"] - end["lo"], nz(F.sqrt(end["ss"] / (n - 1))))), F.log(F.lit(float(n)))), 0, 1)


add("hurst_30", lambda: _hurst(30), "ret", domain="distribution")


def _top_mean(x, n, largest: bool):
    k = max(1, int(0.05 * n))
    ranked = F.sort_array(F.collect_list(x).over(trailing(n, 1)), asc=not largest)
    return F.when(F.count(x).over(trailing(n, 1)) == n, F.aggregate(F.slice(ranked, 1, k), F.lit(0.0), lambda a, b: a + b) / k)


add("past_high_20", lambda: quotient(F.when(F.count(bar.h).over(trailing(20, 1)) == 20, F.avg(bar.h).over(trailing(20, 1))) - bar.c, bar.c))
add("past_low_20", lambda: quotient(bar.c - F.when(F.count(bar.l).over(trailing(20, 1)) == 20, F.avg(bar.l).over(trailing(20, 1))), bar.c))
add("past_top_40", lambda: quotient(_top_mean(bar.h, 40, True) - bar.c, bar.c))
add("past_bottom_40", lambda: quotient(bar.c - _top_mean(bar.l, 40, False), bar.c))
