"""The metrics of one symbol over time, in NumPy, computed by need. Workers import this module: it has no Spark columns.

Each step names the columns that it needs and those that it makes; steps_for() finds the steps that a wanted set of
columns needs, so asking for one average computes one average's step and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import types as T

from barloom.config import MONTH, QUARTER, RETURNS, WEEK, YEAR, Settings
from barloom.functions import fib
from barloom.functions import recurrences as r
from barloom.functions import windows as w
from barloom.functions.windows import NAN, known, lagged, over, tri

Columns = dict[str, np.ndarray]

#: Adjusted bars.
BARS = ("trade_date", "open", "high", "low", "close", "volume", "delivery_pct")
SMAS = (20, 50, 100, 150, 200)


@dataclass(frozen=True)
class Step:
    needs: tuple[str, ...]
    makes: dict[str, T.DataType]
    run: Callable[[Columns, Settings], Columns]


STEPS: list[Step] = []
NUMBER, WHOLE, FLAG, DATE, TEXT = T.DoubleType(), T.LongType(), T.BooleanType(), T.DateType(), T.StringType()


def step(needs: str, numbers: str = "", wholes: str = "", flags: str = "", dates: str = "", texts: str = ""):
    kinds = ((numbers, NUMBER), (wholes, WHOLE), (flags, FLAG), (dates, DATE), (texts, TEXT))
    makes = {name: kind for names, kind in kinds for name in names.split()}

    def add(run):
        STEPS.append(Step(tuple(needs.split()), makes, run))
        return run

    return add


def change(p: Columns, near: int, far: int) -> np.ndarray:
    """Return from far to near sessions ago; unknown without a positive price then."""
    return over(lagged(p["close"], near), lagged(p["close"], far)) - 1


@step("close", " ".join([*RETURNS, "ret_12m_1m", "ret_3m_2m"]))
def returns(p: Columns, s: Settings) -> Columns:
    made = {name: change(p, 0, n) for name, n in RETURNS.items()}
    return made | {"ret_12m_1m": change(p, MONTH, YEAR), "ret_3m_2m": change(p, 2 * MONTH, QUARTER)}


@step("close", " ".join([f"sma_{n}" for n in SMAS] + ["sma_200_slope_1m"]), flags="ma_alignment is_long_term_uptrend")
def averages(p: Columns, s: Settings) -> Columns:
    """Moving averages of the close, and what follows from them."""
    c, made = p["close"], {f"sma_{n}": w.mean(p["close"], n) for n in SMAS}
    s50, s100, s200 = (made[f"sma_{n}"] for n in (50, 100, 200))
    return made | {
        "sma_200_slope_1m": over(s200, lagged(s200, MONTH)) - 1,
        "ma_alignment": tri((c > s50) & (s50 > s100) & (s100 > s200), s50, s100, s200, c),
        "is_long_term_uptrend": tri((c > s200) & (s50 > s200), c, s50, s200),
    }


@step(
    "high low close",
    "high_52w low_52w high_period pct_from_52w_high pct_above_52w_low range_position_52w pct_from_period_high",
    "history_days days_since_52w_high",
)
def ranges(p: Columns, s: Settings) -> Columns:
    """52-week range and the highest price before today."""
    c, top, bottom, before = p["close"], w.highest(p["high"], YEAR), w.lowest(p["low"], YEAR), w.highest_before(p["high"])
    return {
        "history_days": np.arange(1, len(c) + 1).astype(float),
        "high_52w": top,
        "low_52w": bottom,
        "high_period": before,
        "pct_from_52w_high": over(c, top) - 1,
        "pct_above_52w_low": over(c, bottom) - 1,
        "range_position_52w": over(c - bottom, top - bottom),
        "days_since_52w_high": np.where(known(top), w.since_highest(p["high"], YEAR), NAN),
        "pct_from_period_high": over(c, before) - 1,
    }


@step("close ret_1d", "exp_reg_slope_90 exp_reg_r2_90 momentum_score", flags="gap_disqualified")
def momentum(p: Columns, s: Settings) -> Columns:
    """Exponential regression over 90 sessions, and whether a gap disqualifies it."""
    slope, r2 = w.log_regression(p["close"], s.momentum_lookback)
    jump = w.highest(np.abs(np.nan_to_num(p["ret_1d"])), s.momentum_lookback)
    yearly = np.expm1(slope * YEAR)
    return {
        "exp_reg_slope_90": yearly,
        "exp_reg_r2_90": r2,
        "gap_disqualified": tri(jump > s.gap_limit, jump),
        "momentum_score": np.where(jump <= s.gap_limit, yearly * r2, NAN),
    }


@step("close", "stdev_21 stdev_63")
def volatility(p: Columns, s: Settings) -> Columns:
    c = np.where(p["close"] > 0, p["close"], NAN)
    gain = np.log(over(c, lagged(c)))
    return {"stdev_21": w.deviation(gain, MONTH), "stdev_63": w.deviation(gain, QUARTER)}


@step("high low close volume delivery_pct", "adr_pct_20 rel_volume turnover_20d_median delivery_pct_sma_20", "vol_sma_20 vol_sma_50")
def volume(p: Columns, s: Settings) -> Columns:
    v20, v50 = w.mean(p["volume"], 20), w.mean(p["volume"], 50)
    return {
        "adr_pct_20": w.mean(over(p["high"], p["low"]) - 1, 20),
        "rel_volume": over(p["volume"], v50),
        "turnover_20d_median": w.rolled(p["close"] * p["volume"], 20, np.median),
        "delivery_pct_sma_20": w.mean(p["delivery_pct"], 20),
        "vol_sma_20": v20,
        "vol_sma_50": v50,
    }


@step("high close high_52w rel_volume", flags="is_n_day_breakout_20 is_n_day_breakout_50 is_52w_high_breakout")
def breakouts(p: Columns, s: Settings) -> Columns:
    c, busy = p["close"], p["rel_volume"]
    tops = {"is_n_day_breakout_20": w.highest(p["high"], 20, 1), "is_n_day_breakout_50": w.highest(p["high"], 50, 1)}
    tops["is_52w_high_breakout"] = lagged(p["high_52w"])
    return {name: tri((c > top) & (busy >= s.rel_volume_min), top, busy) for name, top in tops.items()}


@step(
    "high close sma_50 sma_150 sma_200 sma_200_slope_1m low_52w high_52w",
    "pullback_from_high_pct",
    "trend_template_partial",
)
def template(p: Columns, s: Settings) -> Columns:
    """Criteria 1 to 7 of the trend template, unknown only without sma_200; and the depth of the last month's pullback."""
    c, s50, s150, s200 = p["close"], p["sma_50"], p["sma_150"], p["sma_200"]
    rules = [
        (c > s150) & (c > s200),
        s150 > s200,
        p["sma_200_slope_1m"] > 0,
        (s50 > s150) & (s50 > s200),
        c > s50,
        c >= 1.30 * p["low_52w"],
        c >= 0.75 * p["high_52w"],
    ]
    return {
        "trend_template_partial": np.where(known(s200), np.sum(rules, axis=0), NAN),
        "pullback_from_high_pct": over(c, w.highest(p["high"], MONTH)) - 1,
    }


@step("close", "ema_21 ema_50")
def exponential(p: Columns, s: Settings) -> Columns:
    return {f"ema_{n}": r.ema(p["close"], n) for n in (21, 50)}


@step("high low close", "atr_14 atr_pct_14")
def true_ranges(p: Columns, s: Settings) -> Columns:
    atr = r.wilder(r.true_range(p["high"], p["low"], p["close"]), 14)
    return {"atr_14": atr, "atr_pct_14": over(atr, p["close"])}


@step("close", "rsi_14 macd macd_signal macd_hist")
def oscillators(p: Columns, s: Settings) -> Columns:
    line, signal, hist = r.macd(p["close"])
    return {"rsi_14": r.rsi(p["close"]), "macd": line, "macd_signal": signal, "macd_hist": hist}


@step("high low close", "adx_14")
def directional(p: Columns, s: Settings) -> Columns:
    return {"adx_14": r.adx(p["high"], p["low"], p["close"])}


@step("high low close atr_14", "base_depth_pct", "base_length_days", "is_in_base")
def base(p: Columns, s: Settings) -> Columns:
    """A shallow range, with less volatility than the quarter before it, after an advance."""
    c, n = p["close"], s.base_window
    top = w.highest(p["high"], n)
    depth = over(top - w.lowest(p["low"], n), top)
    peak = w.highest(p["atr_14"], QUARTER, 1)
    gain = lagged(over(c, w.lowest(c, QUARTER)) - 1, n - 1)
    valid = known(depth, peak, gain) & (np.arange(len(c)) >= n - 1 + QUARTER)
    inside = valid & (depth <= s.base_depth) & (p["atr_14"] < s.base_contraction * peak) & (gain >= s.base_advance)
    return {
        "base_depth_pct": depth,
        "is_in_base": np.where(valid, inside.astype(object), None),
        "base_length_days": np.where(valid, r.runs(inside), NAN),
    }


@step("low close sma_50 ema_21", "support_level support_distance_pct", flags="is_at_support")
def supports(p: Columns, s: Settings) -> Columns:
    delay = s.swing_reach if s.support_mode == "confirmed" else 0
    lows = r.swings(p["low"], s.swing_reach, low=True)
    level = r.support(p["close"], p["low"], lows, [p["sma_50"], p["ema_21"]], QUARTER, delay)
    away = over(p["close"], level) - 1
    return {"support_level": level, "support_distance_pct": away, "is_at_support": tri(away <= s.support_tolerance, away)}


@step(
    "open high low close sma_200 ema_21 rsi_14 macd_hist rel_volume support_distance_pct pullback_from_high_pct",
    wholes="reversal_score",
    flags="is_reversal is_pullback_reversal",
)
def reversal(p: Columns, s: Settings) -> Columns:
    """Signs that a pullback to support has turned."""
    open_, close, rsi, hist, ema = p["open"], p["close"], p["rsi_14"], p["macd_hist"], p["ema_21"]
    # the weakest known RSI of the last week, even where the week isn't whole
    weakest = w.views(np.concatenate([np.full(WEEK - 1, np.inf), np.where(np.isnan(rsi), np.inf, rsi)]), WEEK).min(axis=1)
    signs = [
        (rsi > lagged(rsi)) & (weakest <= s.reversal_rsi),
        (hist > lagged(hist)) & (lagged(hist) > lagged(hist, 2)),
        (close > ema) & (lagged(close) <= lagged(ema)),
        (close > open_) & (over(close - p["low"], p["high"] - p["low"]) >= s.reversal_close_position),
        (close > lagged(close)) & (p["rel_volume"] >= s.reversal_volume_ratio),
    ]
    score = np.sum(signs, axis=0)
    turned, depth, away = score >= s.reversal_min_score, -p["pullback_from_high_pct"], p["support_distance_pct"]
    deep = (depth >= s.pullback_min) & (depth <= s.pullback_max)
    both = turned & deep & (away <= s.support_tolerance) & (close > p["sma_200"])
    return {
        "reversal_score": np.where(known(rsi, hist, ema), score, NAN),
        "is_reversal": tri(turned, rsi, hist, ema),
        "is_pullback_reversal": tri(both, rsi, hist, ema, away),
    }


_WHOLE = ("fib_leg_sessions", "fib_sessions_in_zone")


@step(
    "trade_date open high low close volume atr_14 ret_1d",
    " ".join(c for c in fib.NUMBERS if c not in _WHOLE),
    " ".join(_WHOLE),
    " ".join(fib.FLAGS),
    " ".join(fib.DATES),
    " ".join(fib.TEXTS),
)
def retracement(p: Columns, s: Settings) -> Columns:
    return fib.fib_metrics(*(p[c] for c in ("trade_date", "open", "high", "low", "close", "volume", "atr_14", "ret_1d")), s)


#: Every metric in order, with its type.
KINDS: dict[str, T.DataType] = {name: kind for x in STEPS for name, kind in x.makes.items()}


def steps_for(wanted: list[str] | tuple[str, ...]) -> list[Step]:
    """The steps that make the wanted columns, and those that they need, in order."""
    missing = [c for c in wanted if c not in KINDS]
    if missing:
        raise ValueError(f"no such metrics: {', '.join(missing)}")
    open_, used = set(wanted), []
    for x in reversed(STEPS):
        if open_ & x.makes.keys():
            used.append(x)
            open_ |= set(x.needs)
    return used[::-1]


def inputs_of(steps: list[Step]) -> list[str]:
    """The columns of the bars that steps need."""
    needed = {c for x in steps for c in x.needs}
    return [c for c in BARS if c in needed]


def compute(p: Columns, steps: list[Step], s: Settings) -> Columns:
    """p (the bars of one symbol, in date order) and what the steps make of it."""
    out = dict(p)
    with np.errstate(divide="ignore", invalid="ignore"):
        for x in steps:
            out |= x.run(out, s)
    return out
