"""Technical-analysis events on closed bars: indicators and long, short and state flags, available when their bar closes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions import folds
from chronoloom.functions.windows import div, lag, nz, ordered, roll, trailing, upto, values
from chronoloom.operators.scan import ewm, scan


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("byte")


def _ready(name: str, x: str, n: int) -> Column:
    """An exponential mean, NULL until n values of its input are known."""
    return F.when(F.count(x).over(upto()) >= n, F.col(name))


def indicators(bars: DataFrame) -> DataFrame:
    """Indicator columns of every bar. Recursive means run as affine scans, three deep; all else is windows over one sort."""
    h, low, c, v, prev = F.col("high"), F.col("low"), F.col("close"), F.col("volume"), lag("close")
    up, down, delta = h - lag("high"), lag("low") - low, c - prev
    df = bars.withColumns({
        "tr": F.when(prev.isNull(), h - low).otherwise(F.greatest(h - low, F.abs(h - prev), F.abs(low - prev))),
        "pdm": F.when((up > down) & (up > 0), up).otherwise(0.0), "mdm": F.when((down > up) & (down > 0), down).otherwise(0.0),
        "gain": F.greatest(delta, F.lit(0.0)) + F.when(delta.isNull(), None).otherwise(0.0), "loss": F.greatest(-delta, F.lit(0.0)) + F.when(delta.isNull(), None).otherwise(0.0),
        "obv": F.sum(F.signum(F.coalesce(delta, F.lit(0.0))) * v).over(upto()),
    })
    rma = {n: (F.col(x), 1 / k) for n, x, k in (("r_tr", "tr", 14), ("r_tr10", "tr", 10), ("r_p", "pdm", 14), ("r_m", "mdm", 14), ("r_g", "gain", 14), ("r_l", "loss", 14))}
    ema = {n: (F.col(x), 2 / (k + 1)) for n, x, k in (("e12", "close", 12), ("e26", "close", 26), ("e_obv", "obv", 20))}
    df = ewm(df, ["symbol"], "ts", rma | ema)
    atr, rise, fall = _ready("r_tr", "tr", 14), _ready("r_g", "gain", 14), _ready("r_l", "loss", 14)
    rsi = F.when(fall == 0, F.when(rise > 0, 100.0)).otherwise(100 - 100 / (1 + div(rise, nz(fall))))
    df = df.withColumns({"atr10": _ready("r_tr10", "tr", 10), "plus_di": 100 * div(F.col("r_p"), nz(atr)), "minus_di": 100 * div(F.col("r_m"), nz(atr)), "rsi": rsi, "macd": _ready("e12", "close", 12) - _ready("e26", "close", 26), "obv_ma": _ready("e_obv", "obv", 20)})
    df = df.withColumn("dx", 100 * div(F.abs(F.col("plus_di") - F.col("minus_di")), nz(F.col("plus_di") + F.col("minus_di"))))
    df = ewm(df, ["symbol"], "ts", {"r_dx": (F.col("dx"), 1 / 14), "e_macd": (F.col("macd"), 2 / 10)})
    day = Window.partitionBy("symbol", F.to_date("ts")).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    mid, sd = roll(F.avg, "close", 20), roll(F.stddev_pop, "close", 20)
    rng = nz(roll(F.max, "high", 14) - roll(F.min, "low", 14))
    df = df.withColumns({
        "adx": _ready("r_dx", "dx", 14), "macd_hist": F.col("macd") - _ready("e_macd", "macd", 9),
        "vwap": div(F.sum((h + low + c) / 3 * v).over(day), nz(F.sum(v).over(day))),
        "donchian_hi": F.when(F.count("high").over(trailing(20, 1)) == 20, F.max("high").over(trailing(20, 1))), "donchian_lo": F.when(F.count("low").over(trailing(20, 1)) == 20, F.min("low").over(trailing(20, 1))),
        "bb_upper": mid + 2 * sd, "bb_lower": mid - 2 * sd, "bb_width": div(4 * sd, nz(mid)), "stoch_raw": 100 * div(c - roll(F.min, "low", 14), rng),
        "aroon_up": (F.array_position(values("high", 14), F.array_max(values("high", 14))) - 1) / 14.0 * 100, "aroon_down": (F.array_position(values("low", 14), F.array_min(values("low", 14))) - 1) / 14.0 * 100,
    })
    squeeze = F.col("bb_width") <= F.when(F.count("bb_width").over(trailing(100)) == 100, F.percentile("bb_width", F.lit(0.15)).over(trailing(100)))
    df = df.withColumns({"squeeze": F.coalesce(squeeze, F.lit(False)), "stoch_k": roll(F.avg, "stoch_raw", 3)}).withColumn("stoch_d", roll(F.avg, "stoch_k", 3))
    fold, start = folds.supertrend(3.0)
    trend = scan(df.select("symbol", "ts", "high", "low", "close", F.col("atr10").alias("atr")), ["symbol"], "ts", fold, start, "direction int").select("symbol", "ts", "direction")
    helpers = ("tr", "pdm", "mdm", "gain", "loss", "dx", "stoch_raw", "e12", "e26", "e_obv", "e_macd", "r_tr", "r_tr10", "r_p", "r_m", "r_g", "r_l", "r_dx")
    return df.drop(*helpers).join(trend, ["symbol", "ts"])


def _cross(a: str | Column, b: str | Column) -> tuple[Column, Column]:
    x, y = (F.col(k) if isinstance(k, str) else k for k in (a, b))
    return (x > y) & (lag(x) <= lag(y)), (x < y) & (lag(x) >= lag(y))


def events(ind: DataFrame) -> DataFrame:
    """Flags of every bar; a flag with an unknown input is 0."""
    c, x = F.col("close"), F.col
    zero = F.lit(0.0)
    rising = x("adx") - lag("adx") > 0
    pairs = {
        "adx_trend": ((x("plus_di") > x("minus_di")) & (x("adx") > 25) & rising, (x("minus_di") > x("plus_di")) & (x("adx") > 25) & rising),
        "rsi_reentry": ((lag("rsi") < 30) & (x("rsi") >= 30), (lag("rsi") > 70) & (x("rsi") <= 70)),
        "macd_cross": _cross("macd_hist", zero), "vwap_cross": _cross("close", "vwap"), "donchian_breakout": (c > x("donchian_hi"), c < x("donchian_lo")), "obv_cross": _cross("obv", "obv_ma"),
        "bollinger_reentry": ((lag("close") < lag("bb_lower")) & (c >= x("bb_lower")), (lag("close") > lag("bb_upper")) & (c <= x("bb_upper"))),
        "squeeze_breakout": (lag(x("squeeze").cast("int")).eqNullSafe(F.lit(1)) & (c > x("bb_upper")), lag(x("squeeze").cast("int")).eqNullSafe(F.lit(1)) & (c < x("bb_lower"))),
        "supertrend_flip": (lag("atr10").isNotNull() & (x("direction") > 0) & (lag("direction") < 0), lag("atr10").isNotNull() & (x("direction") < 0) & (lag("direction") > 0)),
        "aroon_cross": ((x("aroon_up") > x("aroon_down")) & (lag("aroon_up") <= lag("aroon_down")) & (x("aroon_up") > 50), (x("aroon_down") > x("aroon_up")) & (lag("aroon_down") <= lag("aroon_up")) & (x("aroon_down") > 50)),
        "stoch_cross": ((x("stoch_k") > x("stoch_d")) & (lag("stoch_k") <= lag("stoch_d")) & (x("stoch_k") < 20), (x("stoch_k") < x("stoch_d")) & (lag("stoch_k") >= lag("stoch_d")) & (x("stoch_k") > 80)),
    }
    states = {"adx_trend_state": x("adx") >= 25, "adx_range_state": x("adx") <= 20, "rsi_oversold_state": x("rsi") < 30, "rsi_overbought_state": x("rsi") > 70, "squeeze_state": x("squeeze"), "supertrend_long_state": x("atr10").isNotNull() & (x("direction") > 0), "vwap_above_state": c > x("vwap"), "obv_above_state": x("obv") > x("obv_ma"), "stoch_oversold_state": x("stoch_k") < 20, "stoch_overbought_state": x("stoch_k") > 80}
    cols = {f"{n}_{side}": _flag(f) for n, both in pairs.items() for side, f in zip(("long", "short"), both, strict=True)} | {n: _flag(f) for n, f in states.items()}
    return ind.select("symbol", "ts", (x("ts") + F.expr("interval 1 hour")).alias("available_ts"), *(f.alias(n) for n, f in cols.items()))


def compact(ev: DataFrame, cooldown_bars: int = 3) -> DataFrame:
    """Trend, range and value families gated by regime, cooled down, and never long and short at once."""
    x = F.col
    raw = {
        "trend_long": (x("adx_trend_state") == 1) & ((x("donchian_breakout_long") == 1) | (x("macd_cross_long") == 1)) & (x("obv_above_state") == 1), "trend_short": (x("adx_trend_state") == 1) & ((x("donchian_breakout_short") == 1) | (x("macd_cross_short") == 1)) & (x("obv_above_state") == 0),
        "range_long": (x("adx_range_state") == 1) & ((x("rsi_reentry_long") == 1) | (x("bollinger_reentry_long") == 1)), "range_short": (x("adx_range_state") == 1) & ((x("rsi_reentry_short") == 1) | (x("bollinger_reentry_short") == 1)),
    }
    df = ev.select("symbol", "ts", *(_flag(f).alias(n) for n, f in raw.items()))
    for family in ("trend", "range"):
        both = (x(f"{family}_long") == 1) & (x(f"{family}_short") == 1)
        df = df.withColumns({f"{family}_{s}": F.when(both, 0).otherwise(x(f"{family}_{s}")).cast("byte") for s in ("long", "short")})
    made = {n: folds.cooldown(cooldown_bars) for n in raw}

    def fold(state: dict, row: dict):
        out, new = {}, {}
        for n, (f, _) in made.items():
            new[n], emitted = f(state[n], {"flag": row[n]})
            out[f"{n}_out"] = emitted["emitted"]
        return new, out

    return scan(df, ["symbol"], "ts", fold, lambda: {n: s() for n, (_, s) in made.items()}, ", ".join(f"{n}_out int" for n in raw)).select("symbol", "ts", *(x(f"{n}_out").alias(n) for n in raw))
