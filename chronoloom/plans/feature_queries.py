"""One query per family of window features, over hourly bars of the events, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.functions.features import compute
from chronoloom.sources import bars as source

FAMILIES: dict[str, list[str]] = {
    "f01_log_return": ["ret"],
    "f02_rate_of_change": ["roc_6", "roc_accel_6"],
    "f05_return_std": ["return_std_20"],
    "f06_bollinger": ["pct_b_20", "bandwidth_20"],
    "f08_sma_deviation": ["sma_deviation_20"],
    "f09_funding_sums": ["funding_sum_8", "funding_ma_8", "funding_ma_diff"],
    "f10_zscore_population": ["zscore_pop_21"],
    "f11_zscore_sample": ["zscore_samp_21"],
    "f12_premium": ["premium_ma_8", "premium_change", "premium_range_8"],
    "f13_basis": ["basis", "mark_close_range", "mark_return_diff"],
    "f14_close_vs_mark_volatility": ["close_vs_mark_vol_20"],
    "f15_open_interest": ["oi_pct_change", "oi_to_sma_20", "volume_to_oi", "oi_weighted_return"],
    "f16_candlestick": ["body_ratio", "upper_shadow", "lower_shadow", "candle_sign"],
    "f17_rsi_sma": ["rsi_14"],
    "f18_stochastic": ["stoch_k_14", "stoch_d_14"],
    "f19_volume": ["volume_roc_6", "volume_ratio_20"],
    "f20_vwap": ["vwap_deviation", "vwap_return"],
    "f21_cycle_position": ["cycle_position", "weekday"],
    "f22_range_volatility": ["range_expansion_20", "vol_of_vol_20", "vol_momentum_20"],
    "f23_skew_kurtosis": ["skew_30", "kurtosis_30"],
    "f24_max_drawdown": ["max_drawdown_20"],
    "f25_sharpe": ["sharpe_20"],
    "f26_sortino": ["sortino_20"],
    "f27_calmar": ["calmar_20"],
    "f28_autocorrelation": ["autocorr_20"],
    "f29_price_zscore": ["price_zscore_20"],
    "f30_win_rate": ["win_rate_20"],
    "f31_on_balance_volume": ["obv", "obv_zscore_20"],
    "f32_money_flow": ["mfi_14", "cmf_20"],
    "f34_cci": ["cci_20"],
    "f35_long_short": ["long_short_ratio", "long_short_change"],
    "f36_amihud": ["amihud_20"],
    "f37_range_volatility_estimators": ["parkinson_20", "garman_klass_20", "rogers_satchell_20", "yang_zhang_20"],
    "f38_hurst": ["hurst_30"],
    "f39_pressure": ["pressure_20"],
    "f40_past_distances": ["past_high_20", "past_low_20", "past_top_40", "past_bottom_40"],
}
DIGITS = 5


#: Plain ratios of a few prices: their decimals can end right at a rounding tie, so they are compared with more digits.
RATIOS = ("past_", "roc_", "body_", "upper_", "lower_", "vwap_dev", "basis", "mark_close_range", "oi_pct", "oi_to", "volume_", "long_short", "premium_", "stoch_", "funding_", "sma_dev", "range_exp", "win_rate", "rsi_", "max_drawdown")


def digits(name: str) -> int:
    return 8 if name.startswith(RATIOS) else DIGITS


def _family(names: list[str]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        df = compute(source.bars(spark, d), names)
        return df.select("symbol", "ts", *(F.round(n, digits(n)).alias(n) if dict(df.dtypes)[n] == "double" else F.col(n) for n in names))

    return run


def f42_feature_set(spark: SparkSession, d: str) -> DataFrame:
    """All registered families in one plan: one shuffle by symbol and one sort for all windows."""
    names = [n for family in FAMILIES.values() for n in family]
    df = compute(source.bars(spark, d), names)
    return df.select("symbol", "ts", *(F.round(n, digits(n)).alias(n) if dict(df.dtypes)[n] == "double" else F.col(n) for n in names))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _family(names) for name, names in FAMILIES.items()} | {"f42_feature_set": f42_feature_set}


def _w(n: int, end: int = 0) -> str:
    return f"over (partition by symbol order by ts rows between {n - 1 + end} preceding and {end} preceding)" if end else f"over (partition by symbol order by ts rows between {n - 1} preceding and current row)"


def _r(f: str, x: str, n: int) -> str:
    return f"case when count({x}) {_w(n)} = {n} then {f}({x}) {_w(n)} end"


def _lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) over (partition by symbol order by ts)"


def _clip(x: str, lo: float, hi: float) -> str:
    return f"case when ({x}) is not null then least(greatest({x}, {lo}), {hi}) end"


TP = "((high + low + close) / 3)"
#: Helper columns in three stages; every later stage may use the earlier ones.
STAGES = [
    {
        "ret": f"ln(close / nullif({_lag('close')}, 0))", "vwap": "turnover / nullif(volume, 0)", "prem": "close - open",
        "chg": f"close - {_lag('close')}", "tp": TP, "tp_prev": _lag(TP), "pc": _lag("close"), "ov": f"ln(open / nullif({_lag('close')}, 0))",
        "rs": "ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open)", "lsr": "(high - open) / nullif(open - low, 0)",
        "clv": "coalesce(((close - low) - (high - close)) / nullif(high - low, 0), 0) * volume",
    },
    {
        "gain": "coalesce(greatest(chg, 0), 0)", "loss": "coalesce(greatest(-chg, 0), 0)", "ret1": _lag("ret"), "mrd": f"ln(vwap / nullif({_lag('vwap')}, 0))",
        "k14": f"100 * (close - {_r('min', 'low', 14)}) / nullif({_r('max', 'high', 14)} - {_r('min', 'low', 14)}, 0)",
        "v6": _r("stddev_samp", "ret", 6), "v10": _r("stddev_samp", "ret", 10), "obv": f"case when chg is not null then sum(sign(chg) * volume) over (partition by symbol order by ts) end",
        "fu": "case when tp > tp_prev then tp * volume else 0 end", "fd": "case when tp < tp_prev then tp * volume else 0 end", "tps": _r("avg", "tp", 20),
        "up": "case when ret > 0 then 1.0 else 0.0 end", "roc6": f"(close - {_lag('close', 6)}) / {_lag('close', 6)}",
        "vr": f"volume / nullif({_r('avg', 'volume', 20)}, 0)", "lst": f"list(close) {_w(20)}", "rl": f"list(ret) {_w(30)}",
        "hl": f"list_sort(list(high) {_w(40, 1)}, 'DESC')", "ll": f"list_sort(list(low) {_w(40, 1)}, 'ASC')",
    },
    {
        "mdiff": "mrd - ret", "tpd": "abs(tp - tps)", "rx": "case when ret1 is not null and ret is not null then ret1 end", "ry": "case when ret1 is not null and ret is not null then ret end", "neg": "case when ret < 0 then ret end", "press": "sign(close - open) * vr",
        "dd": "case when len(lst) = 20 then list_min(list_transform(generate_series(1, 20), lambda i: lst[i] / list_max(lst[1:i]) - 1)) end",
        "dev": "case when count(ret) over (partition by symbol order by ts rows between 29 preceding and current row) = 30 then list_transform(generate_series(1, 30), lambda i: list_sum(rl[1:i]) - i * list_avg(rl)) end",
    },
]
EXPR: dict[str, str] = {
    "ret": "ret", "roc_6": "roc6", "roc_accel_6": f"roc6 - {_lag('roc6', 6)}", "return_std_20": _r("stddev_samp", "ret", 20),
    "pct_b_20": f"(close - ({_r('avg', 'close', 20)} - 2 * {_r('stddev_samp', 'close', 20)})) / nullif(4 * {_r('stddev_samp', 'close', 20)}, 0)",
    "bandwidth_20": f"4 * {_r('stddev_samp', 'close', 20)} / nullif({_r('avg', 'close', 20)}, 0)",
    "sma_deviation_20": f"(close - {_r('avg', 'close', 20)}) / nullif({_r('avg', 'close', 20)}, 0)",
    "funding_sum_8": f"sum(turnover) {_w(8)}", "funding_ma_8": f"avg(turnover) {_w(8)}", "funding_ma_diff": f"avg(turnover) {_w(8)} - avg(turnover) {_w(24)}",
    "zscore_pop_21": f"coalesce(case when {_r('stddev_pop', 'turnover', 21)} > 1e-8 then (turnover - {_r('avg', 'turnover', 21)}) / ({_r('stddev_pop', 'turnover', 21)}) end, 0)",
    "zscore_samp_21": _clip(f"(turnover - {_r('avg', 'turnover', 21)}) / nullif({_r('stddev_samp', 'turnover', 21)}, 0)", -5, 5),
    "premium_ma_8": f"avg(prem) {_w(8)}", "premium_change": f"prem - {_lag('prem')}", "premium_range_8": f"max(prem) {_w(8)} - min(prem) {_w(8)}",
    "basis": "(close - vwap) / nullif(vwap, 0)", "mark_close_range": "(high - low) / nullif(vwap, 0)", "mark_return_diff": "mdiff",
    "close_vs_mark_vol_20": f"({_r('stddev_samp', 'ret', 20)}) / nullif({_r('stddev_samp', 'mdiff', 20)}, 0)",
    "oi_pct_change": f"(turnover - {_lag('turnover')}) / nullif({_lag('turnover')}, 0)", "oi_to_sma_20": f"turnover / nullif({_r('avg', 'turnover', 20)}, 0)", "volume_to_oi": "volume / nullif(turnover, 0)",
    "oi_weighted_return": f"ret * sign(turnover - {_lag('turnover')})",
    "body_ratio": "case when high = low then 0 else abs(close - open) / (high - low) end", "upper_shadow": "case when high = low then 0 else (high - greatest(open, close)) / (high - low) end",
    "lower_shadow": "case when high = low then 0 else (least(open, close) - low) / (high - low) end", "candle_sign": "sign(close - open)::double",
    "rsi_14": f"100 - 100 / (1 + ({_r('avg', 'gain', 14)}) / nullif({_r('avg', 'loss', 14)}, 0))",
    "stoch_k_14": "k14", "stoch_d_14": _r("avg", "k14", 3), "volume_roc_6": f"(volume - {_lag('volume', 6)}) / nullif({_lag('volume', 6)}, 0)", "volume_ratio_20": "vr",
    "vwap_deviation": "(close - vwap) / nullif(vwap, 0)", "vwap_return": "mrd", "cycle_position": "(hour(ts) // 8)::int", "weekday": "(isodow(ts) - 1)::int",
    "range_expansion_20": f"(high - low) / nullif({_r('avg', 'high - low', 20)}, 0)", "vol_of_vol_20": _r("stddev_samp", "v6", 20),
    "vol_momentum_20": _clip(f"(v10 - {_lag('v10', 10)}) / nullif({_lag('v10', 10)}, 0)", -1, 15),
    "skew_30": _clip(_r("skewness", "ret", 30), -5, 5), "kurtosis_30": _clip(_r("kurtosis", "ret", 30), -10, 30),
    "max_drawdown_20": "dd", "sharpe_20": _clip(f"({_r('avg', 'ret', 20)}) / nullif({_r('stddev_samp', 'ret', 20)}, 0) * sqrt(20)", -5, 5),
    "sortino_20": f"case when count(ret) {_w(20)} = 20 and count(neg) {_w(20)} >= 2 then avg(ret) {_w(20)} / nullif(stddev_samp(neg) {_w(20)}, 0) end",
    "calmar_20": f"(close - {_lag('close', 20)}) / {_lag('close', 20)} / nullif(abs(dd), 0)",
    "autocorr_20": f"case when count(rx) {_w(19)} = 19 then (avg(rx * ry) {_w(19)} - avg(rx) {_w(19)} * avg(ry) {_w(19)}) / nullif(stddev_pop(rx) {_w(19)} * stddev_pop(ry) {_w(19)}, 0) end",
    "price_zscore_20": _clip(f"(close - {_r('avg', 'close', 20)}) / nullif({_r('stddev_samp', 'close', 20)}, 0)", -4, 4),
    "win_rate_20": _r("avg", "up", 20), "obv": "obv", "obv_zscore_20": _clip(f"(obv - {_r('avg', 'obv', 20)}) / nullif({_r('stddev_samp', 'obv', 20)}, 0)", -4, 4),
    "mfi_14": f"100 - 100 / (1 + ({_r('sum', 'fu', 14)}) / nullif({_r('sum', 'fd', 14)}, 0))", "cmf_20": f"({_r('sum', 'clv', 20)}) / nullif({_r('sum', 'volume', 20)}, 0)",
    "cci_20": f"(tp - tps) / nullif(0.015 * ({_r('avg', 'tpd', 20)}), 0)", "long_short_ratio": "lsr", "long_short_change": _clip(f"lsr - {_lag('lsr')}", -1, 1),
    "amihud_20": _r("avg", "(abs(ret) / nullif(turnover, 0))", 20),
    "parkinson_20": f"sqrt(abs({_r('avg', '(ln(high / low) ** 2 / (4 * ln(2)))', 20)}))",
    "garman_klass_20": f"sqrt(abs({_r('avg', '(0.5 * ln(high / low) ** 2 - (2 * ln(2) - 1) * ln(close / open) ** 2)', 20)}))",
    "rogers_satchell_20": f"sqrt(abs({_r('avg', 'rs', 20)}))",
    "yang_zhang_20": f"sqrt(abs(({_r('var_samp', 'ov', 20)}) + 0.34 / (1.34 + 21.0 / 19) * ({_r('var_samp', '(ln(close / open))', 20)}) + (1 - 0.34 / (1.34 + 21.0 / 19)) * ({_r('avg', 'rs', 20)})))",
    "hurst_30": _clip("case when dev is not null then ln((greatest(list_max(dev), 0) - least(list_min(dev), 0)) / nullif(list_stddev_samp(rl), 0)) / ln(30) end", 0, 1),
    "pressure_20": _r("avg", "press", 20),
    "past_high_20": f"(case when count(high) {_w(20, 1)} = 20 then avg(high) {_w(20, 1)} end - close) / close", "past_low_20": f"(close - case when count(low) {_w(20, 1)} = 20 then avg(low) {_w(20, 1)} end) / close",
    "past_top_40": "case when len(hl) = 40 then (list_avg(hl[1:2]) - close) / close end", "past_bottom_40": "case when len(ll) = 40 then (close - list_avg(ll[1:2])) / close end",
}


def _sql(names: list[str]) -> str:
    parts, last = [source.sql()], "bars"
    for i, stage in enumerate(STAGES):
        parts.append(f"s{i} as (select *, " + ", ".join(f"{x} as {n}" for n, x in stage.items()) + f" from {last})")
        last = f"s{i}"
    whole = {"cycle_position", "weekday"}
    outs = ", ".join(f"{EXPR[n]} as {n}" if n in whole else f"round(({EXPR[n]})::double, {digits(n)}) as {n}" for n in names)
    return "with " + ",\n".join(parts) + f"\nselect symbol, ts, {outs} from {last}"


SQL: dict[str, str] = {name: _sql(names) for name, names in FAMILIES.items()} | {"f42_feature_set": _sql([n for family in FAMILIES.values() for n in family])}
