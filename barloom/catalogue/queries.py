"""Every registered query over the driver's tables, with the SQL that checks it where SQL can."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.catalogue import sql as q
from barloom.config import COMPOSITE_WEIGHTS, DEMO, RETURNS, SETUP_WEIGHTS
from barloom.functions import fib
from barloom.functions.frames import by
from barloom.functions.symbol import SMAS, STEPS
from barloom.operators import calendar, cross_section, indices, quality, risk, series, store
from barloom.operators.adjust import unreconciled, with_factors
from barloom.plans import backtest, nightly, presets, screens
from barloom.plans.engine import metrics
from barloom.sources import bars as source

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def num(c: str | Column, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return (F.round(col, 6) + F.lit(0.0)).alias(name or c)


def whole(c: str) -> Column:
    return F.col(c).cast("long").alias(c)


def bars(spark, d) -> DataFrame:
    return with_factors(source.bars(spark, d), source.corporate_actions(spark, d))


def adj(spark, d) -> DataFrame:
    return series.adjusted(bars(spark, d))


def measured(spark, d, *names) -> DataFrame:
    """Adjusted bars with the named metrics."""
    return series.measured(adj(spark, d), names)


def rows(df: DataFrame, *columns) -> DataFrame:
    return df.select("symbol", "trade_date", *columns)


# Bars and adjustment


@query("bars_daily", f"WITH {q.WALK} SELECT symbol, trade_date, open, high, low, close, volume, delivery_pct FROM bars")
def bars_daily(spark, d):
    return rows(source.bars(spark, d), "open", "high", "low", "close", "volume", "delivery_pct")


@query("adj_factors", f"WITH {q.WALK} SELECT symbol, trade_date, {q.num('adj_factor')} FROM fbars")
def adj_factors(spark, d):
    return rows(bars(spark, d), num("adj_factor"))


@query("bars_adjusted", f"WITH {q.WALK} SELECT symbol, trade_date, {', '.join(map(q.num, ('open', 'high', 'low', 'close', 'volume')))} FROM adj")
def bars_adjusted(spark, d):
    return rows(adj(spark, d), *map(num, ("open", "high", "low", "close", "volume")))


@query("corporate_actions", f"WITH {q.WALK} SELECT token, ex_date, action_type, ratio_from, ratio_to FROM actions")
def corporate_actions(spark, d):
    return source.corporate_actions(spark, d).drop("amount")


@query("index_level", f"WITH {q.WALK} SELECT trade_date, {q.num('close')} FROM idx")
def index_level(spark, d):
    return source.index_series(source.walk(spark, d)).select("trade_date", num("close"))


@query("instruments", f"WITH {q.WALK} SELECT token, symbol, series, industry, float_shares FROM instruments")
def instruments(spark, d):
    return source.instruments(spark, d).drop("name")


@query("unadjusted_ex_dates", f"""WITH {q.WALK} SELECT r.token, r.trade_date, a.action_type, round(ret, 6) + 0.0 AS ret
FROM (SELECT token, trade_date, close / {q.lag("close")} - 1 AS ret FROM bars) r JOIN actions a ON a.token = r.token AND a.ex_date = r.trade_date WHERE abs(ret) > 0.25""")
def unadjusted_ex_dates(spark, d):
    raw = source.bars(spark, d).withColumn("adj_factor", F.lit(1.0))
    return unreconciled(raw, source.corporate_actions(spark, d), 0.25).select("token", "trade_date", "action_type", num("ret"))


# Metrics with fixed windows


@query("returns_all", q.select(*map(q.num, RETURNS)))
def returns_all(spark, d):
    return rows(series.returns(adj(spark, d)), *map(num, RETURNS))


@query("returns_lagged", q.select(q.num("ret_12m_1m"), q.num("ret_3m_2m")))
def returns_lagged(spark, d):
    return rows(series.returns(adj(spark, d)), num("ret_12m_1m"), num("ret_3m_2m"))


_AVERAGES = [f"sma_{n}" for n in SMAS] + ["sma_200_slope_1m"]


@query("sma_family", q.select(*[f"round({c}, 8) + 0.0 AS {c}" for c in _AVERAGES]))
def sma_family(spark, d):
    return rows(measured(spark, d, *_AVERAGES), *[(F.round(c, 8) + 0.0).alias(c) for c in _AVERAGES])


@query("ma_alignment", q.select("ma_alignment", "is_long_term_uptrend"))
def ma_alignment(spark, d):
    return rows(measured(spark, d, "ma_alignment", "is_long_term_uptrend"), "ma_alignment", "is_long_term_uptrend")


_RANGE = ("high_52w", "low_52w", "pct_from_52w_high", "pct_above_52w_low", "range_position_52w", "high_period", "pct_from_period_high")


@query("range_52w", q.select(*map(q.num, _RANGE), q.whole("days_since_52w_high"), q.whole("history_days")))
def range_52w(spark, d):
    made = measured(spark, d, *_RANGE, "days_since_52w_high", "history_days")
    return rows(made, *map(num, _RANGE), whole("days_since_52w_high"), whole("history_days"))


@query("log_regression_90", q.select(*map(q.num, ("exp_reg_slope_90", "exp_reg_r2_90", "momentum_score")), "gap_disqualified"))
def log_regression_90(spark, d):
    made = measured(spark, d, "exp_reg_slope_90", "exp_reg_r2_90", "momentum_score", "gap_disqualified")
    return rows(made, *map(num, ("exp_reg_slope_90", "exp_reg_r2_90", "momentum_score")), "gap_disqualified")


_VOLATILITY = ("stdev_21", "stdev_63", "adr_pct_20", "rel_volume", "turnover_20d_median", "delivery_pct_sma_20")


@query(
    "volatility_volume",
    q.select(*map(q.num, _VOLATILITY), q.whole("vol_sma_20", "round_even(v20, 0)"), q.whole("vol_sma_50", "round_even(v50, 0)")),
)
def volatility_volume(spark, d):
    return rows(measured(spark, d, *_VOLATILITY, "vol_sma_20", "vol_sma_50"), *map(num, _VOLATILITY), "vol_sma_20", "vol_sma_50")


#: Metrics that need no recurrence.
FIXED = [c for x in STEPS if x.run.__name__ in ("returns", "averages", "ranges", "momentum", "volatility", "volume", "breakouts", "template") for c in x.makes]


_BREAKOUTS = ("is_n_day_breakout_20", "is_n_day_breakout_50", "is_52w_high_breakout")


@query("breakouts", q.select(*_BREAKOUTS))
def breakouts(spark, d):
    return rows(measured(spark, d, *_BREAKOUTS), *_BREAKOUTS)


@query("trend_template_partial", q.select(q.whole("trend_template_partial"), q.num("pullback_from_high_pct")))
def trend_template_partial(spark, d):
    made = measured(spark, d, "trend_template_partial", "pullback_from_high_pct")
    return rows(made, whole("trend_template_partial"), num("pullback_from_high_pct"))


# Recurrences


def _left(*parts: tuple[str, str]) -> str:
    return " ".join(f"LEFT JOIN {t} {a} ON {a}.token = s.token AND {a}.rn = s.rn" for t, a in parts)


@query("ema_21_50", q.recursive(q.EMAS[21] + "," + q.EMAS[50], f"{q.num('ema_21', 'a.v')}, {q.num('ema_50', 'b.v')}", _left(("ema_21", "a"), ("ema_50", "b"))))
def ema_21_50(spark, d):
    return rows(measured(spark, d, "ema_21", "ema_50"), num("ema_21"), num("ema_50"))


@query("atr_14", q.recursive(q.ATR, f"{q.num('atr_14', 'a.v')}, {q.num('atr_pct_14', 'a.v / s.close')}", _left(("atr", "a"))))
def atr_14(spark, d):
    return rows(measured(spark, d, "atr_14", "atr_pct_14"), num("atr_14"), num("atr_pct_14"))


@query("rsi_14", q.recursive(q.RSI, q.num("rsi_14", "CASE WHEN d.v = 0 THEN 100 ELSE 100 - 100 / (1 + u.v / d.v) END"), _left(("up", "u"), ("down", "d"))))
def rsi_14(spark, d):
    return rows(measured(spark, d, "rsi_14"), num("rsi_14"))


@query("adx_14", q.recursive(q.ADX, q.num("adx_14", "a.v"), _left(("adx", "a"))))
def adx_14(spark, d):
    return rows(measured(spark, d, "adx_14"), num("adx_14"))


@query("macd", q.recursive(q.MACD, f"{q.num('macd', 'l.line')}, {q.num('macd_signal', 'g.v')}, {q.num('macd_hist', 'l.line - g.v')}", _left(("line", "l"), ("signal", "g"))))
def macd(spark, d):
    names = ("macd", "macd_signal", "macd_hist")
    return rows(measured(spark, d, *names), *map(num, names))


_BASE_SQL = f"""WITH RECURSIVE {q.WALK}, {q.SERIES}, {q.ATR}, b0 AS (
  SELECT s.token, s.symbol, s.trade_date, s.rn, s.close, a.v AS atr, {q.full("s.high", 15, "max").replace("token", "s.token").replace("trade_date", "s.trade_date")} AS top,
         {q.full("s.low", 15, "min").replace("token", "s.token").replace("trade_date", "s.trade_date")} AS bottom,
         {q.full("s.close", 63, "min").replace("token", "s.token").replace("trade_date", "s.trade_date")} AS trough
  FROM s0 s {_left(("atr", "a"))}
), b1 AS (
  SELECT *, CASE WHEN top > 0 THEN (top - bottom) / top END AS depth, CASE WHEN trough > 0 THEN close / trough - 1 END AS rise, {q.full("atr", 63, "max", 1)} AS peak FROM b0
), b2 AS (
  SELECT *, {q.lag("rise", 14)} AS gain FROM b1
), b3 AS (
  SELECT *, rn - 1 >= 77 AND depth IS NOT NULL AND peak IS NOT NULL AND gain IS NOT NULL AS known FROM b2
), b4 AS (
  SELECT *, known AND coalesce(depth <= 0.15 AND atr < 0.75 * peak AND gain >= 0.25, false) AS inside FROM b3
)
SELECT symbol, trade_date, {q.num("base_depth_pct", "depth")}, CASE WHEN known THEN inside END AS is_in_base,
       CASE WHEN known THEN CAST(rn - coalesce(max(CASE WHEN NOT inside THEN rn END) OVER ({q.BY} ROWS UNBOUNDED PRECEDING), 0) AS BIGINT) END AS base_length_days
FROM b4"""


@query("base_detection", _BASE_SQL)
def base_detection(spark, d):
    return rows(measured(spark, d, "base_depth_pct", "is_in_base", "base_length_days"), num("base_depth_pct"), "is_in_base", "base_length_days")


def _fractal(x: str, sign: str, agg: str) -> str:
    lo = f"{agg}({x}) OVER ({q.BY} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)"
    hi = f"{agg}({x}) OVER ({q.BY} ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)"
    n = f"count({x}) OVER ({q.BY} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"
    return f"coalesce({n} = 7 AND {x} {sign} {lo} AND {x} {sign} {hi}, false)"


def swing_flags(spark, d):
    """Swings as windows: strictly beyond the three bars on either side."""
    made = adj(spark, d)
    whole_window = by().rowsBetween(-3, 3)
    flags = {}
    for name, c, agg, beyond in (("swing_low", "low", F.min, lambda a, b: a < b), ("swing_high", "high", F.max, lambda a, b: a > b)):
        sides = [agg(c).over(by().rowsBetween(-3, -1)), agg(c).over(by().rowsBetween(1, 3))]
        test = (F.count(c).over(whole_window) == 7) & beyond(F.col(c), sides[0]) & beyond(F.col(c), sides[1])
        flags[name] = F.coalesce(test, F.lit(False))
    return made.withColumns(flags)


@query("swings", f"WITH {q.WALK} SELECT symbol, trade_date, {_fractal('low', '<', 'min')} AS swing_low, {_fractal('high', '>', 'max')} AS swing_high FROM adj")
def swings(spark, d):
    return rows(swing_flags(spark, d), "swing_low", "swing_high")


@query(
    "swing_confirmed",
    f"""WITH {q.WALK}, f AS (SELECT *, {_fractal('low', '<', 'min')} AS s FROM adj)
SELECT symbol, trade_date, coalesce({q.lag("s", 3)}, false) AS low_confirmed FROM f""",
)
def swing_confirmed(spark, d):
    return rows(swing_flags(spark, d), F.coalesce(F.lag("swing_low", 3).over(by()), F.lit(False)).alias("low_confirmed"))


_SUPPORT_SQL = f"""WITH RECURSIVE {q.WALK}, {q.M1}, {q.SERIES}, {q.EMAS[21]}, f AS (SELECT token, history_days, low, {_fractal('low', '<', 'min')} AS s FROM adj),
lows AS (SELECT * FROM f WHERE s),
best AS (
  SELECT m.token, m.history_days, max(l.low) AS swing FROM m3 m JOIN lows l ON l.token = m.token AND l.history_days BETWEEN m.history_days - 62 AND m.history_days AND l.low <= m.close
  GROUP BY m.token, m.history_days
), lined AS (
  SELECT m.symbol, m.trade_date, m.close, greatest(b.swing, CASE WHEN m.sma_50 <= m.close THEN m.sma_50 END, CASE WHEN e.v <= m.close THEN e.v END) AS level
  FROM m3 m LEFT JOIN best b USING (token, history_days) LEFT JOIN ema_21 e ON e.token = m.token AND e.rn = m.history_days
)
SELECT symbol, trade_date, {q.num("support_level", "level")}, {q.num("support_distance_pct", "close / level - 1")}, CASE WHEN level > 0 THEN close / level - 1 <= 0.03 END AS is_at_support FROM lined"""


@query("nearest_support", _SUPPORT_SQL)
def nearest_support(spark, d):
    names = ("support_level", "support_distance_pct", "is_at_support")
    return rows(measured(spark, d, *names), num("support_level"), num("support_distance_pct"), "is_at_support")


#: Everything by symbol that SQL needs recursion for, next to m3: r0 has a row for each bar.
_RECURRENT = f"""{q.M1}, {q.SERIES}, {q.EMAS[21]}, {q.ATR}, {q.RSI}, {q.MACD}, f AS (SELECT token, history_days, low, {_fractal('low', '<', 'min')} AS s FROM adj),
lows AS (SELECT token, history_days AS rn, low FROM f WHERE s),
best AS (
  SELECT m.token, m.history_days, max(l.low) AS swing FROM m3 m JOIN lows l ON l.token = m.token AND l.rn BETWEEN m.history_days - 62 AND m.history_days AND l.low <= m.close
  GROUP BY m.token, m.history_days
), r0 AS (
  SELECT m.*, m.history_days AS rn, e.v AS ema_21, a.v AS atr_14, CASE WHEN dn.v = 0 THEN 100 ELSE 100 - 100 / (1 + u.v / dn.v) END AS rsi_14, ml.line - sg.v AS hist,
         greatest(b.swing, CASE WHEN m.sma_50 <= m.close THEN m.sma_50 END, CASE WHEN e.v <= m.close THEN e.v END) AS support_level
  FROM m3 m LEFT JOIN best b USING (token, history_days) LEFT JOIN ema_21 e ON e.token = m.token AND e.rn = m.history_days
  LEFT JOIN atr a ON a.token = m.token AND a.rn = m.history_days LEFT JOIN up u ON u.token = m.token AND u.rn = m.history_days
  LEFT JOIN down dn ON dn.token = m.token AND dn.rn = m.history_days LEFT JOIN line ml ON ml.token = m.token AND ml.rn = m.history_days
  LEFT JOIN signal sg ON sg.token = m.token AND sg.rn = m.history_days
), r1 AS (
  SELECT *, close / support_level - 1 AS away, rsi_14 IS NOT NULL AND hist IS NOT NULL AND ema_21 IS NOT NULL AS scored,
         coalesce((rsi_14 > {q.lag("rsi_14")} AND min(rsi_14) {q.frame(5)} <= 45)::INT, 0) + coalesce((hist > {q.lag("hist")} AND {q.lag("hist")} > {q.lag("hist", 2)})::INT, 0)
         + coalesce((close > ema_21 AND {q.lag("close")} <= {q.lag("ema_21")})::INT, 0) + coalesce((close > open AND high > low AND (close - low) / (high - low) >= 0.66)::INT, 0)
         + coalesce((close > {q.lag("close")} AND rel_volume >= 1.2)::INT, 0) AS signs
  FROM r0
), rev AS (
  SELECT *, CASE WHEN scored THEN signs END AS reversal_score, CASE WHEN scored THEN signs >= 2 END AS is_reversal,
         CASE WHEN scored AND away IS NOT NULL THEN coalesce(signs >= 2 AND away <= 0.03 AND -pullback_from_high_pct BETWEEN 0.03 AND 0.25 AND close > sma_200, false) END AS is_pullback_reversal
  FROM r1
)"""


def _recurrent(tail: str, more: str = "") -> str:
    return f"WITH RECURSIVE {q.WALK}, {_RECURRENT}{more} {tail}"


@query("reversal_score", _recurrent(f"SELECT symbol, trade_date, {q.whole('reversal_score')}, is_reversal, is_pullback_reversal FROM rev"))
def reversal_score(spark, d):
    names = ("reversal_score", "is_reversal", "is_pullback_reversal")
    return rows(measured(spark, d, *names), *names)


#: The retracement rule in relations: legs, the three newest known for each session, the first valid one.
_FIB = f""", tops AS (SELECT token, history_days AS rn, high, row_number() OVER (PARTITION BY token ORDER BY history_days) AS k FROM (SELECT *, {_fractal('high', '>', 'max')} AS s FROM adj) WHERE s),
pairs AS (SELECT t.token, t.rn AS b, t.high AS top, t.k, arg_min(l.rn, (l.low, l.rn)) AS a FROM tops t JOIN lows l ON l.token = t.token AND l.rn >= t.rn - 250 AND l.rn < t.rn GROUP BY ALL),
shocks AS (SELECT p.token, p.b, max(abs(m.ret_1d)) AS shock FROM pairs p JOIN m3 m ON m.token = p.token AND m.history_days > p.a AND m.history_days <= p.b GROUP BY ALL),
valid AS (
  SELECT p.*, m.low AS bottom FROM pairs p JOIN shocks s USING (token, b) JOIN m3 m ON m.token = p.token AND m.history_days = p.a
  WHERE (p.top - m.low) / m.low >= 0.20 AND p.b - p.a >= 15 AND s.shock <= 0.20
),
beaten AS (SELECT v.token, v.b, min(m.history_days) AS at FROM valid v JOIN m3 m ON m.token = v.token AND m.history_days >= v.a AND m.high > v.top + 1e-12 GROUP BY ALL),
known AS (SELECT r.token, r.rn, max(t.k) AS newest FROM r0 r JOIN tops t ON t.token = r.token AND t.rn <= r.rn - 3 GROUP BY ALL),
served AS (
  SELECT n.token, n.rn, max(v.b) AS b FROM known n JOIN valid v ON v.token = n.token AND v.k BETWEEN n.newest - 2 AND n.newest
  LEFT JOIN beaten x ON x.token = v.token AND x.b = v.b WHERE n.rn - v.b <= 60 AND (x.at IS NULL OR x.at > n.rn) GROUP BY ALL
),
vol AS (SELECT token, history_days AS rn, sum(volume) OVER ({q.BY} ROWS UNBOUNDED PRECEDING) AS total FROM adj),
shaped AS (
  SELECT v.*, v.top - v.bottom AS span, (vb.total - coalesce(va.total, 0)) / (v.b - v.a + 1) AS advance,
         (coalesce(va.total, v1.total) - coalesce(vp.total, 0)) / (greatest(v.a - 1, 1) - greatest(v.a - 50, 1) + 1) AS prior
  FROM valid v JOIN vol vb ON vb.token = v.token AND vb.rn = v.b LEFT JOIN vol va ON va.token = v.token AND va.rn = v.a - 1 JOIN vol v1 ON v1.token = v.token AND v1.rn = 1
  LEFT JOIN vol vp ON vp.token = v.token AND vp.rn = greatest(v.a - 50, 1) - 1
),
z0 AS (
  SELECT r.*, g.a, g.b, g.top, g.bottom, g.span, g.advance, g.prior, g.b IS NOT NULL AS found, max(g.b) OVER (PARTITION BY r.token) IS NOT NULL AS ever_found,
         count(*) OVER (PARTITION BY r.token) AS n,
         g.top - 0.5::DOUBLE * g.span AS l500, g.top - 0.618::DOUBLE * g.span AS l618, g.top - 0.382::DOUBLE * g.span AS l382, g.top - 0.786::DOUBLE * g.span AS l786
  FROM r0 r LEFT JOIN served s ON s.token = r.token AND s.rn = r.rn LEFT JOIN shaped g ON g.token = s.token AND g.b = s.b
),
turns AS (SELECT z.token, z.rn, min(l.low) AS turn FROM z0 z JOIN lows l ON l.token = z.token AND l.rn BETWEEN z.b AND z.rn - 3 AND l.low BETWEEN z.l618 AND z.l500 GROUP BY ALL),
deep AS (SELECT z.token, z.rn, min(m.low) AS deepest FROM z0 z JOIN m3 m ON m.token = z.token AND m.history_days BETWEEN z.b AND z.rn GROUP BY ALL),
z1 AS (
  SELECT z.*, d.deepest, t.turn, found AND close BETWEEN l618 AND l500 AS inside, rn - b - 1 AS resting, (w.total - vb.total) / (rn - b - 1) AS pullback
  FROM z0 z LEFT JOIN deep d USING (token, rn) LEFT JOIN turns t USING (token, rn) LEFT JOIN vol vb ON vb.token = z.token AND vb.rn = z.b
  LEFT JOIN vol w ON w.token = z.token AND w.rn = z.rn - 1 AND z.rn - z.b - 1 >= 1
),
z2 AS (
  SELECT *, coalesce(inside, false) AS inz, CASE WHEN found AND prior > 0 THEN advance / prior END AS impulse, CASE WHEN found AND advance > 0 THEN pullback / advance END AS dryup,
         CASE WHEN found AND resting >= 3 AND pullback > 0 THEN volume / pullback END AS turn_ratio, CASE WHEN found THEN least(l786, turn - 0.5 * atr_14) END AS stop
  FROM z1
),
z3 AS (
  SELECT *, coalesce(found AND close > open AND high > low AND (close - low) / (high - low) >= 0.60 AND turn_ratio >= 1.5 AND low <= l500, false) AS turned,
         coalesce(impulse >= 1.20 AND dryup <= 0.80, false) AS shape, CASE WHEN close > stop THEN (top - close) / (close - stop) END AS rr, found AND close < bottom AS broken,
         rn - max(CASE WHEN NOT inz THEN rn ELSE 0 END) OVER ({q.BY} ROWS UNBOUNDED PRECEDING) AS run,
         coalesce(lag(inz) OVER ({q.BY}), false) AS was, coalesce(max(inz::INT) OVER ({q.BY} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS ever, {q.lag("low")} AS low_1
  FROM z2
), fz AS (
  SELECT *, CASE WHEN found AND low_1 > l500 AND high < l618 THEN 'GAP_THROUGH' WHEN inz AND ever AND NOT was THEN 'RE_ENTERED' WHEN inz THEN 'TRADED_INTO' END AS entry_type,
         CASE WHEN inz AND shape AND turned AND NOT broken THEN 'TRIGGERED' WHEN inz AND shape AND NOT broken THEN 'ARMED' ELSE 'NONE' END AS status,
         CASE WHEN n < 65 THEN 'INSUFFICIENT_HISTORY' WHEN broken THEN 'LEG_BROKEN' WHEN NOT found THEN 'NO_VALID_LEG' WHEN NOT inz THEN 'OUT_OF_ZONE' WHEN NOT shape THEN 'VOLUME_UNCONFIRMED'
              WHEN NOT turned THEN 'NO_REVERSAL_BAR' WHEN rr >= 2.0 THEN NULL ELSE 'RR_BELOW_FLOOR' END AS reason
  FROM z3
)"""


@query("fib_leg", _recurrent(f"""SELECT f.symbol, f.trade_date, {q.num("fib_leg_low_price", "bottom")}, {q.num("fib_leg_high_price", "top")}, da.trade_date AS fib_leg_low_date, db.trade_date AS fib_leg_high_date,
dc.trade_date AS fib_leg_confirmed_date, {q.num("fib_leg_amplitude_pct", "span / bottom")}, {q.whole("fib_leg_sessions", "b - a")}
FROM fz f LEFT JOIN adj da ON da.token = f.token AND da.history_days = f.a LEFT JOIN adj db ON db.token = f.token AND db.history_days = f.b LEFT JOIN adj dc ON dc.token = f.token AND dc.history_days = f.b + 3""", _FIB))
def fib_leg(spark, d):
    prices, rest = ("fib_leg_low_price", "fib_leg_high_price", "fib_leg_amplitude_pct"), (*fib.DATES, "fib_leg_sessions")
    return rows(measured(spark, d, *prices, *rest), *map(num, prices), *rest)


_ZONE = {
    **{f"fib_level_{k}": f"l{k}" for k in ("382", "500", "618", "786")},
    "fib_retracement_ratio": "CASE WHEN span > 0 THEN (top - close) / span END",
    "fib_max_retracement": "CASE WHEN span > 0 THEN (top - deepest) / span END",
    "vol_impulse_ratio": "impulse",
    "vol_dryup_ratio": "dryup",
    "fib_turn_vol_ratio": "turn_ratio",
    "fib_stop": "stop",
    "fib_target": "top",
    "fib_reward_risk": "rr",
}


@query("fib_zone", _recurrent(f"""SELECT symbol, trade_date, {", ".join(q.num(k, x) for k, x in _ZONE.items())}, CASE WHEN ever_found THEN run::BIGINT END AS fib_sessions_in_zone, inz AS in_fib_zone,
turned AS is_fib_reversal_bar, status AS fib_zone_status, entry_type AS fib_zone_entry_type, reason AS fib_exclusion_reason FROM fz""", _FIB))
def fib_zone(spark, d):
    rest = ("fib_sessions_in_zone", *fib.FLAGS, *fib.TEXTS)
    return rows(measured(spark, d, *_ZONE, *rest), *map(num, _ZONE), *rest)


# Cross-section


def named(spark, d, *recurrences):
    made = measured(spark, d, *FIXED, *recurrences)
    made = made.join(source.instruments(spark, d).select("token", "series", "industry", "float_shares"), "token")
    return cross_section.eligibility(made, DEMO)


@query("eligibility", q.select("is_eligible", "ineligible_reason", source="x1", parts=q.ELIGIBLE))
def eligibility(spark, d):
    return rows(named(spark, d), "is_eligible", "ineligible_reason")


_RS = "".join(
    f", CASE WHEN i{n} > -1 THEN round((1 + ret_{k}) / (1 + i{n}) - 1, 6) + 0.0 END AS rs_{k}" for k, n in (("1m", 21), ("3m", 63), ("6m", 126), ("12m", 252))
)
_IDX = ", ".join(f"close / lag(close, {n}) OVER (ORDER BY trade_date) - 1 AS i{n}" for n in (21, 63, 126, 252))


@query("relative_strength", f"WITH RECURSIVE {q.WALK}, {q.M1}, ir AS (SELECT trade_date, {_IDX} FROM idx) SELECT symbol, trade_date{_RS} FROM m3 LEFT JOIN ir USING (trade_date)")
def relative_strength(spark, d):
    made = cross_section.relative_strength(series.returns(adj(spark, d)), source.index_series(source.walk(spark, d)))
    return rows(made, *map(num, cross_section.INDEX_RETURNS))


@query("rs_rating", q.select(q.whole("rs_rating"), source="x3", parts=q.ELIGIBLE))
def rs_rating(spark, d):
    return rows(cross_section.rs_rating(named(spark, d)), "rs_rating")


@query("momentum_rank", q.select(q.whole("momentum_rank"), source="x3", parts=q.ELIGIBLE))
def momentum_rank(spark, d):
    return rows(cross_section.momentum_rank(named(spark, d)), "momentum_rank")


@query("trend_template", q.select(q.whole("trend_template_score"), "trend_template_score >= 8 AS is_trend_template", source="x4", parts=q.ELIGIBLE))
def trend_template(spark, d):
    made = cross_section.trend_template(cross_section.rs_rating(named(spark, d)))
    return rows(made, whole("trend_template_score"), "is_trend_template")


_ATR_PART = f""", s0 AS (
  SELECT token, trade_date, history_days AS rn, close,
         CASE WHEN history_days = 1 THEN high - low ELSE greatest(high - low, abs(high - {q.lag("close")}), abs(low - {q.lag("close")})) END AS tr FROM adj
), {q.ATR}, xa AS (SELECT x4.*, a.v / x4.close AS atr_pct_14 FROM x4 LEFT JOIN atr a ON a.token = x4.token AND a.rn = x4.history_days)"""


@query("composite_z", q.select(q.num("composite_z"), source="scored", parts=q.ELIGIBLE + _ATR_PART + q.scored("composite_z", COMPOSITE_WEIGHTS, "xa")))
def composite_z(spark, d):
    made = cross_section.rs_rating(named(spark, d, "atr_pct_14"))
    return rows(cross_section.weighted(made, "composite_z", COMPOSITE_WEIGHTS), num("composite_z"))


def all_metrics(spark, d, key="brand", as_of=None):
    walked = source.walk(spark, d, key)
    return metrics(source.bars(spark, d, key), source.actions_of(walked), source.instruments(spark, d, key), source.index_series(walked), DEMO, as_of)


#: All by-symbol columns, base included, then everything across symbols: x5.
_WHOLE = _FIB + f""", fb0 AS (SELECT *, {q.full("close", 63, "min")} AS trough, {q.full("atr_14", 63, "max", 1)} AS peak FROM fz),
fb1 AS (SELECT *, {q.lag("CASE WHEN trough > 0 THEN close / trough - 1 END", 14)} AS gain FROM fb0),
fb2 AS (SELECT *, rn - 1 >= 77 AND base_depth_pct IS NOT NULL AND peak IS NOT NULL AND gain IS NOT NULL AS base_known FROM fb1),
fb3 AS (SELECT *, base_known AND coalesce(base_depth_pct <= 0.15 AND atr_14 < 0.75 * peak AND gain >= 0.25, false) AS in_base FROM fb2),
fb AS (
  SELECT *, CASE WHEN base_known THEN in_base END AS is_in_base, atr_14 / close AS atr_pct_14, CASE WHEN ever_found THEN run END AS fib_sessions_in_zone,
         CASE WHEN base_known THEN rn - coalesce(max(CASE WHEN NOT in_base THEN rn END) OVER ({q.BY} ROWS UNBOUNDED PRECEDING), 0) END AS base_length_days,
         CASE WHEN dryup > 0 THEN 1 / dryup END AS inv_vol_dryup, close / support_level - 1 AS support_distance_pct
  FROM (SELECT f.*, v.reversal_score, v.is_reversal, v.is_pullback_reversal FROM fb3 f JOIN rev v USING (token, history_days))
){q.ELIGIBLE.replace("m3", "fb")}, x5 AS (
  SELECT *, trend_template_score >= 8 AS is_trend_template,
         CASE WHEN close IS NOT NULL AND ema_21 IS NOT NULL AND sma_50 IS NOT NULL AND ret_1w IS NOT NULL AND rsi_14 IS NOT NULL AND trend_template_score IS NOT NULL
              THEN coalesce(ma_alignment, false) AND trend_template_score >= 8 AND (abs(close / ema_21 - 1) <= 0.03 OR abs(close / sma_50 - 1) <= 0.03) AND ret_1w < 0 AND rsi_14 BETWEEN 40 AND 55 END AS is_pullback
  FROM x4
)"""


def all_metrics(spark, d, key="brand", as_of=None):
    walked = source.walked(spark, d, key)
    return metrics(source.bars_of(walked), source.actions_of(walked), source.instruments_of(walked), source.index_series(walked), DEMO, as_of)


_TEMPLATE = ("momentum_score", "atr_pct_14", "rel_volume", "rsi_14", "ema_21", "support_level", "support_distance_pct")
_MARKS = ("is_trend_template", "is_pullback", "is_eligible", "ineligible_reason", "is_in_base", "is_reversal", "is_pullback_reversal")
_COUNTS = ("rs_rating", "momentum_rank", "trend_template_score", "base_length_days", "reversal_score", "fib_sessions_in_zone")


@query("metrics_all", _recurrent(f"SELECT symbol, trade_date, {', '.join(map(q.num, (*RETURNS, *_RANGE, *_TEMPLATE)))}, {', '.join(f'round({c}, 8) + 0.0 AS {c}' for c in _AVERAGES)}, {', '.join(map(q.whole, _COUNTS))}, {', '.join(_MARKS)}, reason AS fib_exclusion_reason FROM x5", _WHOLE))
def metrics_all(spark, d):
    """All metrics of all sessions are computed, as they are stored; those that have no query of their own side by side."""
    made = all_metrics(spark, d)
    means = [(F.round(c, 8) + 0.0).alias(c) for c in _AVERAGES]
    return rows(made, *map(num, (*RETURNS, *_RANGE, *_TEMPLATE)), *means, *map(whole, _COUNTS), *_MARKS, "fib_exclusion_reason")


@query("pullback_flag", _recurrent("SELECT symbol, trade_date, is_pullback FROM x5", _WHOLE))
def pullback_flag(spark, d):
    return rows(all_metrics(spark, d), "is_pullback")


@query("fib_setup_score", _recurrent(f"SELECT symbol, trade_date, {q.num('fib_setup_score')} FROM scored", _WHOLE + q.scored("fib_setup_score", SETUP_WEIGHTS, "x5")))
def fib_setup_score(spark, d):
    return rows(all_metrics(spark, d), num("fib_setup_score"))


# Screens. The session is the last one; the table of windows and ranks is enough for them.

LAST = "(SELECT max(trade_date) FROM x4)"


def session(spark, d) -> DataFrame:
    made = cross_section.trend_template(cross_section.momentum_rank(cross_section.rs_rating(named(spark, d))))
    # the last session of all: one row, compared by value
    last = source.trades(spark, d).agg(F.max("trade_date").alias("_last"))
    return made.join(F.broadcast(last), F.col("trade_date") == F.col("_last")).drop("_last")


def screen_sql(where: str, tail: str = "", eligible: bool = True) -> str:
    guard = " AND is_eligible" if eligible else ""
    return q.select(q.num("close"), q.whole("momentum_rank"), source=f"x4 WHERE trade_date = {LAST} AND ({where}){guard} {tail}", parts=q.ELIGIBLE)


def screened(spark, d, conditions, op="AND", sort=(("close", "desc"), ("instrument_token", "asc")), limit=None, everyone=False):
    definition = presets.screen_of("query", [], sort, limit, op, everyone)
    definition["filters"]["conditions"] = [c if isinstance(c, dict) else dict(zip(("field", "operator", "value"), c)) for c in conditions]
    definition["universe"]["exclude_ineligible"] = not everyone
    return definition


def register_screen(name: str, sql: str, *conditions, **options):
    @query(name, sql)
    def run(spark, d):
        found = screens.run_screen(session(spark, d), screened(spark, d, conditions, **options))
        return rows(found, num("close"), whole("momentum_rank"))


register_screen("screen_compare", screen_sql("ret_1m > 0 AND rs_rating >= 30"), ("ret_1m", ">", 0), ("rs_rating", ">=", 30))
register_screen("screen_not_equal", screen_sql("momentum_rank <> 1"), ("momentum_rank", "!=", 1))
register_screen("screen_between", screen_sql("range_position_52w BETWEEN 0.2 AND 0.8"), ("range_position_52w", "between", [0.2, 0.8]))
register_screen("screen_in", screen_sql("industry IN ('Sector 1', 'Sector 3')"), ("industry", "in", ["Sector 1", "Sector 3"]))
register_screen("screen_not_in", screen_sql("industry NOT IN ('Sector 1', 'Sector 3')"), ("industry", "not in", ["Sector 1", "Sector 3"]))
register_screen("screen_null", screen_sql("momentum_score IS NULL", eligible=False), ("momentum_score", "is null", None), everyone=True)
register_screen("screen_not_null", screen_sql("momentum_score IS NOT NULL", eligible=False), ("momentum_score", "is not null", None), everyone=True)
register_screen(
    "screen_or_nested",
    screen_sql("ret_1w > 0.01 OR (sma_50 > sma_200 AND ret_1m < 0)".replace("sma_50 > sma_200", "is_long_term_uptrend")),
    ("ret_1w", ">", 0.01),
    {"op": "AND", "conditions": [{"field": "is_long_term_uptrend", "operator": "=", "value": True}, {"field": "ret_1m", "operator": "<", "value": 0}]},
    op="OR",
)


def ranked_sql(order: str, keep: str) -> str:
    inner = f"SELECT *, row_number() OVER (ORDER BY {order}, close DESC, token) AS place, count(*) OVER () AS n FROM x4 WHERE trade_date = {LAST} AND is_eligible AND ret_3m IS NOT NULL"
    return q.select(q.num("close"), q.whole("momentum_rank"), source=f"({inner}) WHERE place <= {keep}", parts=q.ELIGIBLE)


register_screen("screen_top_n", ranked_sql("ret_3m DESC", "7"), ("ret_3m", "top n", 7))
register_screen("screen_bottom_n", ranked_sql("ret_3m", "5"), ("ret_3m", "bottom n", 5))
register_screen("screen_top_pct", ranked_sql("ret_3m DESC", "greatest(1, round_even(n * 0.25, 0))"), ("ret_3m", "top n%", 25))
register_screen("screen_sort_limit", screen_sql("true", "ORDER BY rs_rating DESC NULLS LAST, token LIMIT 6"), sort=[("rs_rating", "desc"), ("instrument_token", "asc")], limit=6)


@query("screen_matched_count", f"WITH RECURSIVE {q.WALK}, {q.M1}{q.ELIGIBLE} SELECT count(*)::BIGINT AS n FROM x4 WHERE trade_date = {LAST} AND ret_1m > 0 AND is_eligible")
def screen_matched_count(spark, d):
    return screens.count_matches(session(spark, d), screened(spark, d, [("ret_1m", ">", 0)], limit=3))


for _name, _sql in {
    "Momentum Leaders": screen_sql("momentum_rank <= 20 AND NOT gap_disqualified", "ORDER BY momentum_rank LIMIT 20"),
    "Trend Template": screen_sql("trend_template_score >= 8", "ORDER BY rs_rating DESC NULLS LAST LIMIT 100"),
    "Approaching High": screen_sql("pct_from_period_high >= -0.03 AND pct_from_period_high < 0 AND trend_template_score >= 5 AND rel_volume >= 0.8 AND NOT gap_disqualified"),
    "All Constituents": screen_sql("true", eligible=False),
    "Momentum Breakdown": screen_sql("momentum_rank > 250 OR pct_from_52w_high <= -0.20", eligible=False),
}.items():

    def _add(name=_name, sql=_sql):
        @query("preset_" + name.lower().replace(" ", "_"), sql)
        def run(spark, d):
            return rows(screens.run_screen(session(spark, d), presets.PRESETS[name]), num("close"), whole("momentum_rank"))

    _add()

def signals_sql(where: str, order: str, first: str, limit: int | None, more: str = "", source: str = "x5") -> str:
    """All matches of all sessions, in the order of the definition."""
    inner = f"SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY {order}, token) AS place FROM {source} WHERE ({where}) AND is_eligible"
    cut = f" WHERE place <= {limit}" if limit else ""
    return _recurrent(f"SELECT trade_date, token, symbol, {q.num('score', f'{first}::DOUBLE')}, place FROM ({inner}){cut}", _WHOLE + more)


for _name, _sql in {
    "52-Week High Breakout": signals_sql("is_52w_high_breakout AND rel_volume >= 1.5 AND atr_pct_14 <= 0.07", "momentum_score DESC NULLS LAST", "momentum_score", 50),
    "Volatility Contraction": signals_sql(
        "is_in_base AND base_length_days >= 10 AND rs_rating >= 70 AND range_position_52w >= 0.7", "base_length_days DESC NULLS LAST", "base_length_days", 50
    ),
    "Pullback to Support": signals_sql("is_pullback", "momentum_score DESC NULLS LAST", "momentum_score", 50),
    "Pullback + Reversal": signals_sql(
        "is_pullback_reversal", "reversal_score DESC NULLS LAST, rs_rating DESC NULLS LAST, support_distance_pct ASC NULLS LAST", "reversal_score", None
    ),
    "Fibonacci Reversal Zone": signals_sql(
        "is_long_term_uptrend AND sma_200_slope_1m > 0 AND rs_rating >= 70 AND inz AND impulse >= 1.20 AND dryup <= 0.80 AND turned AND rr >= 2.0",
        "fib_setup_score DESC NULLS LAST", "fib_setup_score", 25, q.scored("fib_setup_score", SETUP_WEIGHTS, "x5"), "scored",
    ),
}.items():

    def _add_all(name=_name, sql=_sql):
        @query("preset_" + "".join(c if c.isalnum() else "_" for c in name.lower()), sql)
        def run(spark, d):
            """Matches of every session: on one session these screens are mostly empty."""
            found = screens.signals(all_metrics(spark, d), presets.PRESETS[name], order="definition")
            return found.select("trade_date", "token", "symbol", num("score"), "place")

    _add_all()


_GATED = "is_eligible AND is_long_term_uptrend AND sma_200_slope_1m > 0 AND rs_rating >= 70"
_FUNNEL = {
    "gated": _GATED,
    "valid_leg": f"{_GATED} AND found",
    "in_zone": f"{_GATED} AND inz",
    "volume_shape": f"{_GATED} AND inz AND shape",
    "reversal_bar": f"{_GATED} AND inz AND shape AND turned",
    "passed_rr": f"{_GATED} AND inz AND shape AND turned AND rr >= 2.0",
}


@query("fib_funnel", _recurrent(f"SELECT trade_date, count(*)::BIGINT AS universe, {', '.join(f'count_if({x})::BIGINT AS {k}' for k, x in _FUNNEL.items())} FROM x5 GROUP BY trade_date", _WHOLE))
def fib_funnel(spark, d):
    return presets.fib_funnel(all_metrics(spark, d), DEMO)


_BREADTH = f"""WITH RECURSIVE {q.WALK}, {q.M1}{q.ELIGIBLE}, br AS (
  SELECT trade_date, coalesce(count_if(is_52w_high_breakout), 0)::BIGINT AS new_highs, coalesce(count_if(pct_from_52w_high IS NOT NULL AND pct_above_52w_low <= 0.001), 0)::BIGINT AS new_lows,
         coalesce(count_if(ret_1d > 0), 0)::BIGINT AS advances, coalesce(count_if(ret_1d < 0), 0)::BIGINT AS declines, count(*)::BIGINT AS universe
  FROM x4 WHERE is_eligible GROUP BY trade_date
)"""


@query("breadth", _BREADTH + " SELECT *, new_highs - new_lows AS net_new_highs FROM br")
def breadth(spark, d):
    return presets.breadth(named(spark, d))


_MEAN = "CASE WHEN count(*) OVER (ORDER BY trade_date ROWS BETWEEN {p} PRECEDING AND CURRENT ROW) = {n} THEN avg(close) OVER (ORDER BY trade_date ROWS BETWEEN {p} PRECEDING AND CURRENT ROW) END"


@query(
    "market_regime",
    _BREADTH
    + f""", ix AS (SELECT trade_date, close AS index_close, {_MEAN.format(p=49, n=50)} AS sma_50, {_MEAN.format(p=199, n=200)} AS sma_200 FROM idx)
SELECT trade_date, {q.num("index_close")}, round(sma_50, 8) + 0.0 AS sma_50, round(sma_200, 8) + 0.0 AS sma_200, coalesce(new_highs - new_lows, 0) AS net_new_highs,
       CASE WHEN sma_200 IS NULL THEN 'Unknown' WHEN index_close < sma_200 THEN 'Risk-off' WHEN sma_50 > sma_200 AND coalesce(new_highs - new_lows, 0) > 0 THEN 'Risk-on' ELSE 'Neutral' END AS regime
FROM ix LEFT JOIN br USING (trade_date)""",
)
def market_regime(spark, d):
    made = presets.market_regime(source.index_series(source.walk(spark, d)), presets.breadth(named(spark, d)))
    means = [(F.round(c, 8) + 0.0).alias(c) for c in ("sma_50", "sma_200")]
    return made.select("trade_date", num("index_close"), *means, "net_new_highs", "regime")


@query(
    "sector_heatmap",
    f"WITH RECURSIVE {q.WALK}, {q.M1}{q.ELIGIBLE} SELECT trade_date, industry, {q.num('median_ret_1w', 'median(ret_1w)')}, count(*)::BIGINT AS n FROM x4 WHERE is_eligible GROUP BY ALL HAVING count(*) >= 3",
)
def sector_heatmap(spark, d):
    return presets.sector_heatmap(named(spark, d)).select("trade_date", "industry", num("median_ret_1w"), "n")


# Quality

CAL = """cal AS (
  SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS trade_date FROM (SELECT min(trade_date) AS a, max(trade_date) AS b FROM walk)
)"""


def every_day(spark, d):
    ends = source.trades(spark, d).agg(F.min("trade_date").alias("a"), F.max("trade_date").alias("b"))
    return ends.select(F.explode(F.sequence("a", "b")).alias("trade_date"), F.lit(True).alias("is_trading_day"))


def spoiled(spark, d):
    """Bars with what the gate looks for: some rows twice, some out of order, without price or volume."""
    made = bars(spark, d)
    day = F.dayofyear("trade_date")
    bad = made.withColumns(
        {
            "high": F.when((F.col("token") == 11) & (day % 50 == 0), F.col("low") * 0.9).otherwise(F.col("high")),
            "open": F.when((F.col("token") == 12) & (day % 60 == 0), F.lit(None)).otherwise(F.col("open")),
            "volume": F.when((F.col("token") == 13) & (day % 40 == 0), F.lit(0)).otherwise(F.col("volume")),
        }
    )
    return bad.union(bad.where((F.col("token") == 14) & (day % 90 == 0)))


SPOILED = """sp AS (
  SELECT token, symbol, trade_date, CASE WHEN token = 12 AND dayofyear(trade_date) % 60 = 0 THEN NULL ELSE open END AS open,
         CASE WHEN token = 11 AND dayofyear(trade_date) % 50 = 0 THEN low * 0.9 ELSE high END AS high, low, close,
         CASE WHEN token = 13 AND dayofyear(trade_date) % 40 = 0 THEN 0 ELSE volume END AS volume
  FROM fbars
), sb AS (SELECT * FROM sp UNION ALL SELECT * FROM sp WHERE token = 14 AND dayofyear(trade_date) % 90 = 0)"""


def gate_query(name: str, run: Callable[[DataFrame], DataFrame], check: str, severity: str, affected: str):
    text = f"WITH {q.WALK}, {CAL}, {SPOILED}, n AS ({affected}) SELECT '{check}' AS check_id, '{severity}' AS severity, affected = 0 AS passed, affected FROM (SELECT coalesce(affected, 0)::BIGINT AS affected FROM n)"

    @query(name, text)
    def f(spark, d):
        return run(spark, d)


gate_query("gate_v2", lambda s, d: quality.duplicates(spoiled(s, d)), "V2", "BLOCK", "SELECT count(*) AS affected FROM (SELECT token, trade_date FROM sb GROUP BY ALL HAVING count(*) > 1)")
gate_query("gate_v3", lambda s, d: quality.ohlc_order(spoiled(s, d)), "V3", "BLOCK", "SELECT count_if(low > least(open, close) OR high < greatest(open, close)) AS affected FROM sb")
gate_query("gate_v4", lambda s, d: quality.positive(spoiled(s, d)), "V4", "BLOCK", "SELECT count_if(open IS NULL OR open <= 0 OR high IS NULL OR high <= 0 OR low IS NULL OR low <= 0 OR close IS NULL OR close <= 0) AS affected FROM sb")
gate_query("gate_v6", lambda s, d: quality.zero_volume(spoiled(s, d)), "V6", "WARN", "SELECT count_if(coalesce(volume, 0) = 0) AS affected FROM sb")
gate_query(
    "gate_v7",
    lambda s, d: quality.session_validity(bars(s, d), every_day(s, d).withColumn("is_trading_day", F.weekday("trade_date") < 5)),
    "V7",
    "BLOCK",
    "SELECT count(DISTINCT trade_date) AS affected FROM walk WHERE isodow(trade_date) > 5",
)


@query("quarantine_v5", f"""WITH {q.WALK} SELECT token, trade_date, round(ret, 6) + 0.0 AS ret FROM (SELECT token, trade_date, close / {q.lag("close")} - 1 AS ret FROM bars) r
WHERE abs(ret) > 0.35 AND NOT EXISTS (SELECT 1 FROM actions a WHERE a.token = r.token AND a.ex_date = r.trade_date AND a.action_type = 'BONUS')""")
def quarantine_v5(spark, d):
    raw = source.bars(spark, d).withColumn("adj_factor", F.lit(1.0))
    return quality.outliers(raw, source.corporate_actions(spark, d).where("action_type = 'BONUS'")).select("token", "trade_date", num("ret"))


@query("missing_sessions", f"""WITH {q.WALK}, {CAL}, spans AS (SELECT token, min(trade_date) AS a, max(trade_date) AS b FROM walk GROUP BY token)
SELECT token, c.trade_date FROM spans s JOIN cal c ON c.trade_date BETWEEN a AND b WHERE isodow(c.trade_date) < 6
AND NOT EXISTS (SELECT 1 FROM walk w WHERE w.token = s.token AND w.trade_date = c.trade_date)""")
def missing_sessions(spark, d):
    weekdays = every_day(spark, d).withColumn("is_trading_day", F.weekday("trade_date") < 5)
    return quality.missing_bars(source.bars(spark, d), weekdays)


def other_source(spark, d):
    """Another source's closes: every thirtieth day of a year token 15's are off by 0.2 %."""
    off = (F.col("token") == 15) & (F.dayofyear("trade_date") % 30 == 0)
    return source.bars(spark, d).select("token", "trade_date", (F.col("close") * F.when(off, 1.002).otherwise(1.0)).alias("close"))


_CHECKS = {
    "V1": ("BLOCK", "SELECT CASE WHEN abs(n - 25) > 0.05 * 25 THEN abs(n - 25) ELSE 0 END FROM (SELECT count_if(trade_date = DATE '1998-06-01') AS n FROM sb)"),
    "V2": ("BLOCK", "SELECT count(*) FROM (SELECT token, trade_date FROM sb GROUP BY ALL HAVING count(*) > 1)"),
    "V3": ("BLOCK", "SELECT count_if(low > least(open, close) OR high < greatest(open, close)) FROM sb"),
    "V4": ("BLOCK", "SELECT count_if(open IS NULL OR open <= 0 OR high IS NULL OR high <= 0 OR low IS NULL OR low <= 0 OR close IS NULL OR close <= 0) FROM sb"),
    "V5": ("WARN", """SELECT count(*) FROM (SELECT token, trade_date, c / lag(c) OVER (PARTITION BY token ORDER BY trade_date) - 1 AS ret FROM (SELECT s.token, s.trade_date, s.close * f.adj_factor AS c
FROM sb s JOIN fbars f USING (token, trade_date))) r WHERE abs(ret) > 0.35 AND NOT EXISTS (SELECT 1 FROM actions a WHERE a.token = r.token AND a.ex_date = r.trade_date)"""),
    "V6": ("WARN", "SELECT count_if(coalesce(volume, 0) = 0) FROM sb"),
    "V7": ("BLOCK", "SELECT count(DISTINCT trade_date) FROM sb WHERE trade_date NOT IN (SELECT trade_date FROM cal)"),
    "V8": ("WARN", "SELECT count(*) FROM cal WHERE trade_date NOT IN (SELECT trade_date FROM walk)"),
    "V9": ("WARN", "SELECT count_if(abs(s.close / b.close - 1) > 0.001) FROM sb s JOIN (SELECT token, trade_date, close * CASE WHEN token = 15 AND dayofyear(trade_date) % 30 = 0 THEN 1.002::DOUBLE ELSE 1 END AS close FROM bars) b USING (token, trade_date)"),
}
_GATE = f"WITH {q.WALK}, {CAL}, {SPOILED}, gate AS (" + " UNION ALL ".join(
    f"SELECT '{k}' AS check_id, '{severity}' AS severity, ({sql})::BIGINT AS affected" for k, (severity, sql) in _CHECKS.items()
) + "), checked AS (SELECT check_id, severity, affected = 0 AS passed, affected FROM gate)"


@query("gate_all", _GATE + " SELECT * FROM checked")
def gate_all(spark, d):
    return quality.gate(spoiled(spark, d), source.corporate_actions(spark, d), every_day(spark, d), dt.date(1998, 6, 1), 25, other_source(spark, d))


@query("gate_decision", _GATE + """ SELECT bool_or(NOT passed AND severity = 'BLOCK') AS blocked, coalesce(string_agg(check_id, ',' ORDER BY check_id) FILTER (WHERE NOT passed AND severity = 'BLOCK'), '') AS failed_blocks,
coalesce(string_agg(check_id, ',' ORDER BY check_id) FILTER (WHERE NOT passed AND severity = 'WARN'), '') AS warnings FROM checked""")
def gate_decision(spark, d):
    return quality.decision(gate_all(spark, d))


gate_query("gate_v1", lambda s, d: quality.row_count(spoiled(s, d), dt.date(1998, 6, 1), 25), "V1", "BLOCK", _CHECKS["V1"][1].replace("FROM (SELECT count_if", "AS affected FROM (SELECT count_if"))
gate_query("gate_v9", lambda s, d: quality.cross_source(spoiled(s, d), other_source(s, d)), "V9", "WARN", _CHECKS["V9"][1].replace(" FROM sb s", " AS affected FROM sb s"))


@query("discontinuities", f"""WITH {q.WALK}, r AS (SELECT token, trade_date, row_number() OVER ({q.BY}) AS rn, close / {q.lag("close")} - 1 AS ret FROM bars),
l AS (SELECT token, trade_date, rn, max(CASE WHEN abs(ret) > 0.35 THEN rn END) OVER ({q.BY} ROWS UNBOUNDED PRECEDING) AS at FROM r)
SELECT l.token, l.trade_date, 'price break on ' || CAST(b.trade_date AS VARCHAR) AS note FROM l JOIN r b ON b.token = l.token AND b.rn = l.at WHERE l.rn - l.at < 252""")
def discontinuities(spark, d):
    raw = source.bars(spark, d).withColumn("adj_factor", F.lit(1.0))
    none = source.corporate_actions(spark, d).where("false")
    return quality.discontinuities(raw, quality.outliers(raw, none))


# Store


@query("upsert_bars", f"""WITH {q.WALK}, old AS (SELECT * FROM bars WHERE year(trade_date) <= 1998), new AS (SELECT token, symbol, trade_date, open, high, low, close + 1 AS close, volume, CASE WHEN token % 2 = 0 THEN delivery_pct END AS delivery_pct FROM bars WHERE year(trade_date) >= 1998)
SELECT token, trade_date, coalesce(n.close, o.close) AS close, coalesce(n.delivery_pct, o.delivery_pct) AS delivery_pct FROM old o FULL JOIN new n USING (token, trade_date)""")
def upsert_bars(spark, d):
    made = source.bars(spark, d).drop("source")
    year = F.year("trade_date")
    new = made.where(year >= 1998).withColumns({"close": F.col("close") + 1, "delivery_pct": F.when(F.col("token") % 2 == 0, F.col("delivery_pct"))})
    merged = store.upsert(made.where(year <= 1998), new, ["token", "trade_date"], ["delivery_pct"])
    return merged.select("token", "trade_date", "close", "delivery_pct")


@query("upsert_instruments", f"""WITH {q.WALK} SELECT token, CASE WHEN token % 2 = 0 THEN symbol || '-N' ELSE symbol END AS symbol, series, CASE WHEN token % 4 = 0 THEN 'moved' ELSE industry END AS industry,
token % 3 <> 0 OR token % 2 = 0 AS is_active, DATE '1995-01-02' AS first_seen, CASE WHEN token % 2 = 0 THEN DATE '1998-01-05' ELSE DATE '1995-01-02' END AS last_seen FROM instruments
UNION ALL SELECT 99, 'NEW', 'EQ', NULL, true, DATE '1998-01-05', DATE '1998-01-05'""")
def upsert_instruments(spark, d):
    """Every second name is listed again, under a new symbol; some with a new industry; one is new."""
    old = source.instruments(spark, d).selectExpr("token", "symbol", "series", "industry", "token % 3 != 0 as is_active", "date'1995-01-02' as first_seen", "date'1995-01-02' as last_seen")
    seen = old.where("token % 2 = 0").selectExpr("token", "symbol || '-N' as symbol", "cast(null as string) as series", "if(token % 4 = 0, 'moved', null) as industry")
    new = spark.createDataFrame([(99, "NEW", "EQ", None)], "token long, symbol string, series string, industry string")
    return store.upsert_instruments(old, seen.unionByName(new), dt.date(1998, 1, 5))


_LATE = "trade_date >= DATE '1998-08-01'"


@query("end_of_day", f"""WITH {q.WALK}, touched AS (SELECT DISTINCT trade_date FROM bars WHERE {_LATE} AND token % 2 = 0)
SELECT token, trade_date, {q.num("close", f"CASE WHEN {_LATE} AND token % 2 = 0 THEN close * 1.01 ELSE close END")}, delivery_pct, trade_date IN (SELECT trade_date FROM touched) AS touched FROM bars""")
def end_of_day(spark, d):
    """Corrected closes of the members' last sessions are merged; which sessions have to be computed again."""
    stored = source.bars(spark, d)
    named = source.instruments(spark, d)
    fetched = stored.where(_LATE).withColumn("close", F.col("close") * 1.01).drop("token", "delivery_pct")
    day = nightly.end_of_day(stored, fetched, named.where("token % 2 = 0"), source.corporate_actions(spark, d), named, source.index_series(source.walk(spark, d)), DEMO)
    touched = F.broadcast(day.sessions.withColumn("touched", F.lit(True)))
    return day.bars.join(touched, "trade_date", "left").select("token", "trade_date", num("close"), "delivery_pct", F.coalesce("touched", F.lit(False)).alias("touched"))


@query("to_backfill", f"""WITH {q.WALK}, k AS (SELECT token, count(*) AS n, min(trade_date) AS a FROM bars WHERE token % 3 <> 0 OR trade_date > DATE '1995-06-01' GROUP BY token)
SELECT i.token FROM instruments i LEFT JOIN k USING (token) WHERE NOT coalesce(n >= 252 AND a <= DATE '1994-12-01' + 45, false)""")
def to_backfill(spark, d):
    held = source.bars(spark, d).where("token % 3 != 0 or trade_date > date'1995-06-01'")
    return nightly.to_backfill(source.instruments(spark, d), held, dt.date(1994, 12, 1)).select("token")


@query("refetch_from", f"WITH {q.WALK} SELECT min(trade_date) AS start FROM (SELECT DISTINCT trade_date FROM bars ORDER BY trade_date DESC LIMIT 5)")
def refetch_from(spark, d):
    return nightly.refetch_from(source.bars(spark, d))


@query("relative_strength_as_of", f"WITH RECURSIVE {q.WALK}, {q.M1}, ix AS (SELECT * FROM idx WHERE day(trade_date) % 5 <> 0), ir AS (SELECT trade_date, {_IDX} FROM ix) SELECT symbol, trade_date{_RS} FROM m3 ASOF LEFT JOIN ir USING (trade_date)")
def relative_strength_as_of(spark, d):
    """Dates that the index hasn't got take its last session before."""
    index = source.index_series(source.walk(spark, d)).where("day(trade_date) % 5 != 0")
    return rows(cross_section.relative_strength(series.returns(adj(spark, d)), index), *map(num, cross_section.INDEX_RETURNS))


@query("replace_actions", f"WITH {q.WALK} SELECT token, ex_date, CASE WHEN token % 2 = 0 THEN 'BONUS' ELSE action_type END AS action_type FROM actions")
def replace_actions(spark, d):
    old = source.corporate_actions(spark, d)
    new = old.where("token % 2 = 0").withColumn("action_type", F.lit("BONUS"))
    return store.replace_keys(old, new, ["token", "ex_date"]).select("token", "ex_date", "action_type")


@query("scd2_membership", f"""WITH {q.WALK}, t AS (SELECT DISTINCT token FROM traded)
SELECT 'I' AS index_name, token, DATE '1995-01-02' AS valid_from, CASE WHEN token % 3 = 0 THEN DATE '1998-01-05' END AS valid_to FROM t WHERE token < 40
UNION ALL SELECT 'I', token, DATE '1998-01-05', NULL FROM t WHERE token >= 40 AND token % 3 <> 0""")
def scd2_membership(spark, d):
    tokens = source.trades(spark, d).select("token").distinct()
    old = tokens.where("token < 40").selectExpr("'I' as index_name", "token", "date'1995-01-02' as valid_from", "cast(null as date) as valid_to")
    return store.sync_members(old, tokens.where("token % 3 != 0").withColumn("index_name", F.lit("I")), dt.date(1998, 1, 5))


@query("membership_changes", f"""WITH {q.WALK}, t AS (SELECT DISTINCT token FROM traded)
SELECT 'I' AS index_name, token, 'removed' AS change FROM t WHERE token < 40 AND token % 3 = 0 UNION ALL SELECT 'I', token, 'added' FROM t WHERE token >= 40 AND token % 3 <> 0""")
def membership_changes(spark, d):
    tokens = source.trades(spark, d).select("token").distinct()
    old = tokens.where("token < 40").selectExpr("'I' as index_name", "token", "date'1995-01-02' as valid_from", "cast(null as date) as valid_to")
    return store.changes(old, tokens.where("token % 3 != 0").withColumn("index_name", F.lit("I")))


@query("latest_bars", f"WITH {q.WALK} SELECT symbol, trade_date, close FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY trade_date DESC) AS p FROM bars) WHERE p <= 30")
def latest_bars(spark, d):
    return rows(store.latest_bars(source.bars(spark, d), 30), "close")


@query("chart_candles", f"WITH {q.WALK} SELECT token, trade_date, {', '.join(q.num(c, f'{c} * adj_factor') for c in ('open', 'high', 'low', 'close'))}, CAST(round_even(volume / adj_factor, 0) AS BIGINT) AS volume FROM fbars")
def chart_candles(spark, d):
    return store.chart(bars(spark, d)).select("token", "trade_date", *map(num, ("open", "high", "low", "close")), "volume")


@query("trading_days", "SELECT CAST(d AS DATE) AS trade_date FROM generate_series(DATE '2024-01-01', DATE '2024-03-31', INTERVAL 1 DAY) t(d) WHERE isodow(d) < 6")
def trading_days(spark, d):
    none = spark.createDataFrame([], "trade_date date, is_trading_day boolean, note string")
    return calendar.trading_days(none, dt.date(2024, 1, 1), dt.date(2024, 3, 31))


# Indices

IBY = "PARTITION BY index_name ORDER BY trade_date"
SEGMENTS = f"""
o0 AS (SELECT c_mktsegment AS index_name, CAST(o_orderdate AS DATE) AS trade_date, round(avg(o_totalprice), 6) AS mean FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
o1 AS (SELECT *, round(coalesce(0.01 * (mean / avg(mean) OVER ({IBY} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1), 0), 9) AS move FROM o0),
o2 AS (SELECT *, round(5000 * exp(sum(move) OVER ({IBY} ROWS UNBOUNDED PRECEDING)), 4) AS close FROM o1),
seg AS (SELECT index_name, trade_date, round(close * 1.005, 4) AS high, round(close * 0.995, 4) AS low, close, round(15 + (mean % 1000.0) / 100, 4) AS pe, row_number() OVER ({IBY}) AS rn FROM o2)"""


def _ifull(x, n, agg):
    f = f"OVER ({IBY} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {f} = {n} THEN {agg}({x}) {f} END"


_IR = ("high_52w", "low_52w", "period_high", "range_position", "pct_from_52w_high", "pct_from_period_high")


@query("index_range", f"""WITH {SEGMENTS}, r AS (
  SELECT *, {_ifull("high", 252, "max")} AS high_52w, {_ifull("low", 252, "min")} AS low_52w, max(high) OVER p AS period_high, arg_max(rn, (high, -rn)) OVER p AS top_rn FROM seg
  WINDOW p AS ({IBY} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
) SELECT index_name, trade_date, {q.num("high_52w")}, {q.num("low_52w")}, {q.num("period_high")}, {q.num("range_position", "(close - low_52w) / (high_52w - low_52w)")},
       {q.num("pct_from_52w_high", "close / high_52w - 1")}, {q.num("pct_from_period_high", "close / period_high - 1")}, (rn - top_rn)::BIGINT AS sessions_since_high FROM r""")
def index_range(spark, d):
    made = indices.index_ranges(source.segment_index(spark, d))
    return made.select("index_name", "trade_date", *map(num, _IR), "sessions_since_high")


@query("index_trend_state", f"""WITH {SEGMENTS}, r AS (SELECT *, {_ifull("close", 50, "avg")} AS s50, {_ifull("close", 200, "avg")} AS s200 FROM seg),
t AS (SELECT *, s200 / lag(s200, 21) OVER ({IBY}) - 1 AS slope FROM r),
u AS (SELECT *, CASE WHEN slope IS NOT NULL THEN CASE WHEN close > s200 AND s50 > s200 AND slope > 0.001 THEN 'UPTREND' WHEN close < s200 AND s50 < s200 AND slope < -0.001 THEN 'DOWNTREND' ELSE 'TRANSITIONAL' END END AS state FROM t),
v AS (SELECT *, state IS DISTINCT FROM lag(state) OVER ({IBY}) OR rn = 1 AS turned FROM u)
SELECT index_name, trade_date, state, CASE WHEN state IS NOT NULL THEN (rn - max(CASE WHEN turned THEN rn END) OVER ({IBY} ROWS UNBOUNDED PRECEDING) + 1)::BIGINT END AS sessions_in_state FROM v""")
def index_trend_state(spark, d):
    return indices.trend_states(source.segment_index(spark, d)).select("index_name", "trade_date", "state", "sessions_in_state")


_SUMMARY = f"""WITH {SEGMENTS}, r AS (
  SELECT *, {_ifull("high", 252, "max")} AS high_52w, {_ifull("low", 252, "min")} AS low_52w, max(high) OVER p AS period_high, arg_max(rn, (high, -rn)) OVER p AS top_rn,
         {_ifull("close", 50, "avg")} AS s50, {_ifull("close", 200, "avg")} AS s200 FROM seg WINDOW p AS ({IBY} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (SELECT *, s200 / lag(s200, 21) OVER ({IBY}) - 1 AS slope FROM r),
u AS (SELECT *, CASE WHEN slope IS NOT NULL THEN CASE WHEN close > s200 AND s50 > s200 AND slope > 0.001 THEN 'UPTREND' WHEN close < s200 AND s50 < s200 AND slope < -0.001 THEN 'DOWNTREND' ELSE 'TRANSITIONAL' END END AS state FROM t),
v AS (SELECT *, state IS DISTINCT FROM lag(state) OVER ({IBY}) OR rn = 1 AS turned FROM u),
w AS (SELECT *, rn - max(CASE WHEN turned THEN rn END) OVER ({IBY} ROWS UNBOUNDED PRECEDING) + 1 AS held, max(rn) OVER (PARTITION BY index_name) AS n, lag(trade_date, 251) OVER ({IBY}) AS since FROM v),
x AS (SELECT *, n >= 252 AND trade_date - since <= 460 AS available FROM w WHERE rn = n)
SELECT index_name, trade_date, {q.num("close")}, n::BIGINT AS sessions, available, {", ".join(f"CASE WHEN available THEN round({y}, 6) + 0.0 END AS {k}" for k, y in
  (("high_52w", "high_52w"), ("low_52w", "low_52w"), ("period_high", "period_high"), ("range_position", "(close - low_52w) / (high_52w - low_52w)"), ("pct_from_52w_high", "close / high_52w - 1"), ("pct_from_period_high", "close / period_high - 1")))},
       CASE WHEN available THEN (rn - top_rn)::BIGINT END AS sessions_since_high, CASE WHEN available THEN state END AS state, CASE WHEN available AND state IS NOT NULL THEN held::BIGINT END AS sessions_in_state,
       CASE WHEN NOT available OR state IS NULL THEN 3 WHEN state = 'UPTREND' THEN 0 WHEN state = 'TRANSITIONAL' THEN 1 ELSE 2 END::INT AS sort_key FROM x"""


@query("index_summary", _SUMMARY)
def index_summary(spark, d):
    made = indices.index_metrics(source.segment_index(spark, d))
    return made.select("index_name", "trade_date", num("close"), "sessions", "available", *map(num, _IR), "sessions_since_high", "state", "sessions_in_state", "sort_key")


@query("index_coverage", f"""WITH {SEGMENTS}, a AS (SELECT index_name, min(trade_date) AS first_date, max(trade_date) AS last_date, count(*)::BIGINT AS sessions FROM seg GROUP BY index_name),
e AS (SELECT a.*, (SELECT count(*) FROM generate_series(first_date, last_date, INTERVAL 1 DAY) g(x) WHERE isodow(x) < 6)::BIGINT AS expected,
             (SELECT min(trade_date) FROM (SELECT trade_date FROM seg s WHERE s.index_name = a.index_name ORDER BY trade_date DESC LIMIT 252)) AS since FROM a)
SELECT index_name, first_date, last_date, sessions, expected, sessions >= 252 AND last_date - since <= 460 AS daily, {q.num("density", "sessions / expected")} FROM e""")
def index_coverage(spark, d):
    return indices.coverage(source.segment_index(spark, d)).select("index_name", "first_date", "last_date", "sessions", "expected", "daily", num("density"))


@query("valuation_medians", f"""WITH {SEGMENTS}, l AS (SELECT index_name, max(trade_date) AS as_of, arg_max(pe, trade_date) AS cur FROM seg GROUP BY index_name),
h AS (SELECT *, unnest([3, 7]) AS years FROM l),
obs AS (SELECT h.*, s.trade_date, s.pe FROM h JOIN seg s USING (index_name) WHERE s.trade_date BETWEEN as_of - (365 * years)::INT AND as_of),
m AS (SELECT index_name, years, date_trunc('month', trade_date) AS month, median(pe) AS pe, count(*) AS n FROM obs GROUP BY ALL),
w AS (SELECT index_name, years, median(pe) AS med, sum(n)::BIGINT AS observations, count(DISTINCT date_trunc('quarter', month))::BIGINT AS quarters, count(*)::BIGINT AS months FROM m GROUP BY ALL)
SELECT index_name, as_of, round(cur, 6) + 0.0 AS pe, CAST(years AS INTEGER) AS years, observations, quarters, months,
       CASE WHEN quarters >= years * 4 * 0.8 AND observations >= 40 THEN round(med, 6) + 0.0 END AS median_pe,
       CASE WHEN quarters >= years * 4 * 0.8 AND observations >= 40 THEN round((cur / med - 1) * 100, 6) + 0.0 END AS pe_vs_pct
FROM h JOIN w USING (index_name, years)""")
def valuation_medians(spark, d):
    made = indices.valuation(source.segment_index(spark, d), (3, 7))
    return made.select("index_name", "as_of", num("pe"), "years", "observations", "quarters", "months", num("median_pe"), num("pe_vs_pct"))


@query("tier_tagging", f"WITH {q.WALK} SELECT token, symbol, CASE WHEN token % 2 = 0 THEN 'TIER ' || (token // 10)::VARCHAR END AS index_tier FROM instruments")
def tier_tagging(spark, d):
    known = source.instruments(spark, d).select("token", "symbol")
    tiers = known.where("token % 2 = 0").select(F.lower("symbol").alias("symbol"), F.concat(F.lit("TIER "), F.floor(F.col("token") / 10).cast("string")).alias("tier"))
    return indices.tag_tiers(known, tiers)


@query("valuation_sampling", f"WITH {SEGMENTS} SELECT index_name, trade_date FROM seg s WHERE ((rn - 1) % 20 = 0 OR trade_date = (SELECT max(trade_date) FROM seg t WHERE t.index_name = s.index_name)) AND year(trade_date) > 1996")
def valuation_sampling(spark, d):
    index = source.segment_index(spark, d)
    return indices.sample_sessions(index, index.where("year(trade_date) <= 1996"), 20)


@query("benchmark_buy_hold", f"""WITH {SEGMENTS}, p AS (SELECT *, close / max(close) OVER ({IBY} ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM seg),
a AS (SELECT index_name, count(*)::BIGINT AS sessions, arg_min(close, trade_date) AS x, arg_max(close, trade_date) AS y, min(dd) AS dd FROM p GROUP BY index_name)
SELECT index_name, sessions, {q.num("total_return_pct", "(y / x - 1) * 100")}, {q.num("cagr_pct", "((y / x) ^ (252.0 / sessions) - 1) * 100")}, {q.num("max_drawdown_pct", "dd * 100")} FROM a""")
def benchmark_buy_hold(spark, d):
    made = indices.buy_and_hold(source.segment_index(spark, d))
    return made.select("index_name", "sessions", *map(num, ("total_return_pct", "cagr_pct", "max_drawdown_pct")))


# Risk


@query("stop_suggestion", q.recursive(q.ATR, f"""{q.num("atr_stop", "s.close - 2 * a.v")}, {q.num("atr_stop_distance", "2 * a.v / s.close")}, CASE WHEN s.low * 0.97 < s.close THEN round(s.low * 0.97, 6) + 0.0 END AS structural_stop,
CASE WHEN a.v IS NULL THEN 'structural' WHEN s.low * 0.97 < s.close - 2 * a.v THEN 'structural' ELSE 'atr' END AS wider_stop""", _left(("atr", "a"))))
def stop_suggestion(spark, d):
    made = measured(spark, d, "atr_14").withColumns(risk.suggest_stop(F.col("close"), F.col("atr_14"), F.col("low") * 0.97))
    return rows(made, num("atr_stop"), num("atr_stop_distance"), num("structural_stop"), "wider_stop")


@query("position_size", f"""WITH {q.WALK}, s AS (SELECT symbol, trade_date, close, low * 0.98 AS stop FROM adj), w AS (SELECT *, floor(7500 / (close - stop)) AS n FROM s)
SELECT symbol, trade_date, CASE WHEN n * close > 100000 THEN floor(100000 / close) ELSE n END::BIGINT AS quantity,
       round(CASE WHEN n * close > 100000 THEN floor(100000 / close) ELSE n END * close, 6) + 0.0 AS position_value, n * close > 100000 AS capped FROM w""")
def position_size(spark, d):
    made = adj(spark, d).withColumns(risk.size_position(F.col("close"), F.col("low") * 0.98, F.lit(1e6)))
    return rows(made, whole("quantity"), num("position_value"), "capped")


_FRICTION = "(2 * (0.0000297 + 0.000001) + 0.001 + 0.00015 + 0.18 * 2 * 0.0000297)::DOUBLE"


@query("round_trip_cost", f"""WITH {q.WALK}, g AS (SELECT symbol, trade_date, {q.over("close", q.lag("close", 5))} - 1 AS gain, history_days AS n FROM adj), t AS (SELECT *, greatest(gain - {_FRICTION}, 0) * CASE WHEN n >= 365 THEN 0.1495 ELSE 0.2392 END::DOUBLE AS tds FROM g WHERE gain IS NOT NULL)
SELECT symbol, trade_date, round(tds, 9) + 0.0 AS tds, round({_FRICTION} + tds, 9) + 0.0 AS round_trip_cost, round(greatest(gain - {_FRICTION} - tds, 0), 9) + 0.0 AS net_gain FROM t""")
def round_trip_cost(spark, d):
    made = measured(spark, d, "ret_1w", "history_days").where("ret_1w is not null")
    made = made.withColumns(risk.round_trip(F.col("ret_1w"), F.col("history_days")))
    return rows(made, *[(F.round(c, 9) + 0.0).alias(c) for c in ("tds", "round_trip_cost", "net_gain")])


@query("sellable_date", f"WITH {q.WALK} SELECT DISTINCT trade_date, CAST(trade_date + CASE isodow(trade_date) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END::INT AS DATE) AS sellable FROM walk")
def sellable_date(spark, d):
    return source.bars(spark, d).select("trade_date").distinct().select("trade_date", risk.sellable_date(F.col("trade_date")).alias("sellable"))


@query("tax_on_gain", f"WITH {q.WALK} SELECT symbol, trade_date, round(CASE WHEN close > 100 THEN (close - 100) * CASE WHEN history_days >= 365 THEN 0.1495 ELSE 0.2392 END::DOUBLE ELSE 0 END, 9) + 0.0 AS tax FROM adj")
def tax_on_gain(spark, d):
    return rows(measured(spark, d, "history_days"), (F.round(risk.tax_on_gain(F.col("close") - 100, F.col("history_days")), 9) + 0.0).alias("tax"))


# Backtest


def leaders(spark, d):
    """Signals of all sessions: the strongest names in an uptrend."""
    definition = screened(spark, d, [("momentum_rank", "<=", 5), ("is_long_term_uptrend", "=", True)], sort=[("momentum_rank", "asc")], limit=5)
    made = cross_section.momentum_rank(named(spark, d, "atr_14", "support_level"))
    return made, screens.signals(made, definition, order="definition")


@query("signals_over_range", q.select("token", q.num("score", "momentum_rank::DOUBLE"), "place", source="""(SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY momentum_rank NULLS LAST, token) AS place
FROM x4 WHERE momentum_rank <= 5 AND is_long_term_uptrend AND is_eligible) WHERE place <= 5""", parts=q.ELIGIBLE))
def signals_over_range(spark, d):
    return leaders(spark, d)[1].select("symbol", "trade_date", "token", num("score"), "place")


_PRICES = {"open": "open", "high": "high", "low": "low", "close": "close", "atr": "atr_14", "support": "support_level"}


@query("price_panel", _recurrent(f"""SELECT trade_date, token, {", ".join(q.num(k, x) for k, x in _PRICES.items())} FROM r0
WHERE token IN (SELECT token FROM x4 WHERE momentum_rank <= 5 AND is_long_term_uptrend AND is_eligible)""", q.ELIGIBLE))
def price_panel(spark, d):
    made, signals = leaders(spark, d)
    return backtest.price_panel(made, signals).select("trade_date", "token", *map(num, _PRICES))


@query("simulate_atr")
def simulate_atr(spark, d):
    made, signals = leaders(spark, d)
    return backtest.backtests(made, signals, None, backtest.with_and_without_tax(backtest.Config(max_positions=5)))


@query("simulate_tiered")
def simulate_tiered(spark, d):
    made, signals = leaders(spark, d)
    return backtest.backtests(made, signals, None, [backtest.Config(exit_rule="tiered", cooldown=5)])


@query("performance", f"""WITH {SEGMENTS}, e AS (SELECT *, close / lag(close) OVER ({IBY}) - 1 AS ret, close / max(close) OVER ({IBY} ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM seg),
u AS (SELECT *, rn - coalesce(max(CASE WHEN dd >= 0 THEN rn END) OVER ({IBY} ROWS UNBOUNDED PRECEDING), 0) AS under FROM e),
s AS (SELECT index_name, count(*)::BIGINT AS sessions, arg_max(close, trade_date) AS f, min(dd) AS dd, max(under)::BIGINT AS max_drawdown_days, avg(ret) AS m, stddev_samp(ret) AS sd, stddev_samp(CASE WHEN ret < 0 THEN ret END) AS down FROM u GROUP BY index_name)
SELECT index_name AS config_id, sessions, {q.num("final_equity", "f")}, {q.num("total_return_pct", "(f / 5000 - 1) * 100")}, {q.num("cagr_pct", "((f / 5000) ^ (252.0 / sessions) - 1) * 100")}, {q.num("max_drawdown_pct", "dd * 100")},
       max_drawdown_days, {q.num("sharpe", "m / sd * sqrt(252)")}, {q.num("sortino", "m / down * sqrt(252)")}, {q.num("volatility_pct", "sd * sqrt(252) * 100")} FROM s""")
def performance(spark, d):
    equity = source.segment_index(spark, d).select(F.col("index_name").alias("config_id"), "trade_date", F.col("close").alias("equity"))
    made = backtest.performance(equity, 5000.0)
    return made.select("config_id", "sessions", *[num(c) for c in made.columns if c not in ("config_id", "sessions", "max_drawdown_days")], "max_drawdown_days")


@query("trade_stats", """WITH t AS (SELECT l_suppkey % 10 AS config_id, l_discount * 100 - 5 AS r, CAST(l_quantity AS INTEGER) AS h, l_tax AS c FROM lineitem)
SELECT config_id, count(*)::BIGINT AS trades, count_if(r > 0)::BIGINT AS winners, count_if(r <= 0)::BIGINT AS losers, round(count_if(r > 0) / count(*) * 100, 6) + 0.0 AS hit_rate_pct,
       round(avg(r) FILTER (WHERE r > 0), 6) + 0.0 AS avg_win_pct, round(avg(r) FILTER (WHERE r <= 0), 6) + 0.0 AS avg_loss_pct,
       round(abs(avg(r) FILTER (WHERE r > 0) / avg(r) FILTER (WHERE r <= 0)), 6) + 0.0 AS win_loss_ratio, round(avg(h), 6) + 0.0 AS avg_holding_days, round(median(h), 6) + 0.0 AS median_holding_days
FROM t GROUP BY config_id""")
def trade_stats(spark, d):
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    trades = lines.select((F.col("l_suppkey") % 10).alias("config_id"), (F.col("l_discount") * 100 - 5).alias("net_return_pct"), F.col("l_quantity").cast("int").alias("holding_days"), F.col("l_tax").alias("costs"), F.col("l_tax").alias("tds"))
    made = backtest.trade_stats(trades)
    return made.select("config_id", "trades", "winners", "losers", *map(num, ("hit_rate_pct", "avg_win_pct", "avg_loss_pct", "win_loss_ratio", "avg_holding_days", "median_holding_days")))


@query("sweep")
def sweep(spark, d):
    made, signals = leaders(spark, d)
    return backtest.sweep(made, signals, None, backtest.Config(max_positions=5), "atr_multiple", [1.5, 2.0, 2.5, 3.0])


@query("walk_forward")
def walk_forward(spark, d):
    """Windows of two years and one: the multiple that did best is measured on the year after."""
    made, signals = leaders(spark, d)
    made = made.checkpoint() if spark.conf.get("spark.checkpoint.dir", None) else made
    return backtest.walk_forward(made, signals, backtest.Config(max_positions=5), "atr_multiple", [1.5, 2.5], 504, 252)


@query("survivorship", f"WITH {q.WALK} SELECT 10::BIGINT AS closed_memberships, DATE '1995-01-02' AS first_membership, min(trade_date) AS first_bar, DATE '1995-01-02' <= min(trade_date) AS reconstructable FROM walk")
def survivorship(spark, d):
    members = spark.range(25).selectExpr("date'1995-01-02' as valid_from", "if(id < 10, date'1998-01-05', null) as valid_to")
    return backtest.survivorship(members, source.bars(spark, d))
