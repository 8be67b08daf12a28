"""DuckDB SQL that says what the queries over the driver's tables return."""

from __future__ import annotations

BY = "PARTITION BY token ORDER BY trade_date"


def frame(n: int, ahead: int = 0) -> str:
    """The last n sessions; ahead = 1 leaves today out."""
    end = "CURRENT ROW" if not ahead else f"{ahead} PRECEDING"
    return f"OVER ({BY} ROWS BETWEEN {n - 1 + ahead} PRECEDING AND {end})"


def full(x: str, n: int, agg: str = "avg", ahead: int = 0) -> str:
    return f"CASE WHEN count({x}) {frame(n, ahead)} = {n} THEN {agg}({x}) {frame(n, ahead)} END"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER ({BY})"


def over(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN ({a}) / ({b}) END"


WALK = f"""
traded AS (
  SELECT CAST(substr(p_brand, 7, 2) AS BIGINT) AS token, p_brand AS symbol, CAST(l_shipdate AS DATE) AS trade_date,
         l_extendedprice / l_quantity AS price, l_quantity AS qty
  FROM lineitem JOIN part ON l_partkey = p_partkey
), daily AS (
  SELECT token, symbol, trade_date, round(sum(price * qty) / sum(qty), 6) AS vwap, min(price) AS lo, max(price) AS hi, sum(qty) AS qty
  FROM traded GROUP BY token, symbol, trade_date
), moved AS (
  SELECT *, row_number() OVER ({BY}) AS rn,
         round(coalesce(0.01 * (vwap / avg(vwap) OVER ({BY} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1), 0), 9) AS move
  FROM daily
), closed AS (
  SELECT *, round(100 * exp(sum(move) OVER ({BY} ROWS UNBOUNDED PRECEDING)), 4) AS close FROM moved
), opened AS (
  SELECT *, coalesce({lag("close")}, close) AS open FROM closed
), walk AS (
  SELECT token, symbol, trade_date, rn, open, round(greatest(open, close) * (1 + 0.00512345678 * least(hi / vwap - 1, 1.0)), 4) AS high,
         round(least(open, close) * (1 - 0.00512345678 * least(1 - lo / vwap, 1.0)), 4) AS low, close,
         CAST(round(qty * 100) AS BIGINT) AS volume,
         CASE WHEN CAST(round(qty * 100) AS BIGINT) % 700 <> 0 THEN round(40 + 20 * lo / hi, 4) END AS delivery_pct
  FROM opened
), actions AS (
  SELECT token, trade_date AS ex_date, 'SPLIT' AS action_type, 1.0::DOUBLE AS ratio_from, 2.0::DOUBLE AS ratio_to FROM walk WHERE token % 5 = 0 AND rn = 60
  UNION ALL
  SELECT token, trade_date, 'BONUS', 1.0, 4.0 FROM walk WHERE token % 7 = 0 AND rn = 90
), factored AS (
  SELECT *, (CASE WHEN token % 5 = 0 AND rn < 60 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END)
          * (CASE WHEN token % 7 = 0 AND rn < 90 THEN 0.25::DOUBLE ELSE 1.0::DOUBLE END) AS f
  FROM walk
), bars AS (
  SELECT token, symbol, trade_date, round(open / f, 4) AS open, round(high / f, 4) AS high, round(low / f, 4) AS low, round(close / f, 4) AS close,
         CAST(round(volume * f) AS BIGINT) AS volume, delivery_pct
  FROM factored
), instruments AS (
  SELECT DISTINCT token, symbol, CASE WHEN token = 33 THEN 'XX' ELSE 'EQ' END AS series, 'Sector ' || substr(symbol, 7, 1) AS industry,
         CASE WHEN token % 4 <> 0 THEN token * 1e6 END AS float_shares
  FROM traded
), idx AS (
  SELECT trade_date, round(1000 * exp(sum(g) OVER (ORDER BY trade_date ROWS UNBOUNDED PRECEDING)), 4) AS close
  FROM (SELECT trade_date, coalesce(avg(g), 0) AS g
        FROM (SELECT trade_date, ln(close / {lag("close")}) AS g FROM walk) GROUP BY trade_date)
), fbars AS (
  SELECT b.*, coalesce((SELECT product(a.ratio_from / a.ratio_to) FROM actions a WHERE a.token = b.token AND b.trade_date < a.ex_date), 1.0)::DOUBLE AS adj_factor
  FROM bars b
), adj AS (
  SELECT token, symbol, trade_date, open * adj_factor AS open, high * adj_factor AS high, low * adj_factor AS low, close * adj_factor AS close,
         volume / adj_factor AS volume, delivery_pct, close AS raw_close, row_number() OVER ({BY}) AS history_days
  FROM fbars
)"""

RETURNS = {"ret_1d": 1, "ret_1w": 5, "ret_2w": 10, "ret_3w": 15, "ret_1m": 21, "ret_2m": 42, "ret_3m": 63, "ret_6m": 126, "ret_9m": 189, "ret_12m": 252}
_returns = ", ".join(f"{over('close', lag('close', n))} - 1 AS {k}" for k, n in RETURNS.items())
_smas = ", ".join(f"{full('close', n)} AS sma_{n}" for n in (20, 50, 100, 150, 200))
LAST90 = frame(90)

M1 = f"""
m0 AS (
  SELECT *, {over("close", lag("close"))} - 1 AS r1, {lag("close")} AS c1, ln({over("close", lag("close"))}) AS log_ret, ln(close) AS log_close,
         {over("high", "low")} - 1 AS day_range, close * volume AS turnover
  FROM adj
), m1 AS (
  SELECT *, {_returns}, {over(lag("close", 21), lag("close", 252))} - 1 AS ret_12m_1m, {over(lag("close", 42), lag("close", 63))} - 1 AS ret_3m_2m,
         {_smas}, {full("high", 252, "max")} AS high_52w, {full("low", 252, "min")} AS low_52w,
         max(high) OVER ({BY} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high_period,
         arg_max(history_days, (high, history_days)) {frame(252)} AS top_at,
         CASE WHEN count(*) {LAST90} = 90 THEN CASE WHEN min(close) {LAST90} = max(close) {LAST90} THEN 0 ELSE exp(252 * regr_slope(log_close, history_days) {LAST90}) - 1 END END AS exp_reg_slope_90,
         CASE WHEN count(*) {LAST90} = 90 AND min(close) {LAST90} <> max(close) {LAST90} THEN least(greatest(regr_r2(log_close, history_days) {LAST90}, 0), 1) END AS exp_reg_r2_90,
         CASE WHEN count(*) {LAST90} = 90 THEN max(abs(coalesce(r1, 0))) {LAST90} > 0.15 END AS gap_disqualified,
         {full("log_ret", 21, "stddev_samp")} AS stdev_21, {full("log_ret", 63, "stddev_samp")} AS stdev_63, {full("day_range", 20)} AS adr_pct_20,
         {full("volume", 20)} AS v20, {full("volume", 50)} AS v50, {full("turnover", 20, "median")} AS turnover_20d_median,
         {full("delivery_pct", 20)} AS delivery_pct_sma_20, {full("high", 20, "max", 1)} AS top_20, {full("high", 50, "max", 1)} AS top_50,
         {full("high", 21, "max")} AS top_21, {full("high", 15, "max")} AS top_15, {full("low", 15, "min")} AS bottom_15
  FROM m0
), m2 AS (
  SELECT *, {over("sma_200", lag("sma_200", 21))} - 1 AS sma_200_slope_1m,
         CASE WHEN sma_200 IS NOT NULL THEN close > sma_50 AND sma_50 > sma_100 AND sma_100 > sma_200 END AS ma_alignment,
         CASE WHEN sma_200 IS NOT NULL THEN close > sma_200 AND sma_50 > sma_200 END AS is_long_term_uptrend,
         {over("close", "high_52w")} - 1 AS pct_from_52w_high, {over("close", "low_52w")} - 1 AS pct_above_52w_low,
         {over("close - low_52w", "high_52w - low_52w")} AS range_position_52w,
         CASE WHEN high_52w IS NOT NULL THEN history_days - top_at END AS days_since_52w_high,
         {over("close", "high_period")} - 1 AS pct_from_period_high,
         CASE WHEN NOT gap_disqualified THEN exp_reg_slope_90 * exp_reg_r2_90 END AS momentum_score,
         {over("volume", "v50")} AS rel_volume, {over("close", "top_21")} - 1 AS pullback_from_high_pct,
         {over("top_15 - bottom_15", "top_15")} AS base_depth_pct, {lag("high_52w")} AS top_52w
  FROM m1
), m3 AS (
  SELECT *, CASE WHEN top_20 IS NOT NULL AND rel_volume IS NOT NULL THEN close > top_20 AND rel_volume >= 1.5 END AS is_n_day_breakout_20,
         CASE WHEN top_50 IS NOT NULL AND rel_volume IS NOT NULL THEN close > top_50 AND rel_volume >= 1.5 END AS is_n_day_breakout_50,
         CASE WHEN top_52w IS NOT NULL AND rel_volume IS NOT NULL THEN close > top_52w AND rel_volume >= 1.5 END AS is_52w_high_breakout,
         CASE WHEN sma_200 IS NOT NULL THEN
           coalesce((close > sma_150 AND close > sma_200)::INT, 0) + coalesce((sma_150 > sma_200)::INT, 0) + coalesce((sma_200_slope_1m > 0)::INT, 0)
           + coalesce((sma_50 > sma_150 AND sma_50 > sma_200)::INT, 0) + coalesce((close > sma_50)::INT, 0)
           + coalesce((close >= 1.30 * low_52w)::INT, 0) + coalesce((close >= 0.75 * high_52w)::INT, 0) END AS trend_template_partial
  FROM m2
)"""


def smoothed(name: str, source: str, value: str, alpha: float, seed: int, first: int = 1) -> str:
    """A recursive average of value over source (token, rn, ...), from its first row `first` on; for WITH RECURSIVE."""
    start = first + seed - 1
    return f"""
{name} AS (
  SELECT token, {start}::BIGINT AS rn, avg({value}) AS v FROM {source} WHERE rn BETWEEN {first} AND {start} GROUP BY token HAVING count(*) = {seed}
  UNION ALL
  SELECT s.token, s.rn, p.v + {alpha!r} * (s.{value} - p.v) FROM {name} p JOIN {source} s ON s.token = p.token AND s.rn = p.rn + 1
)"""


SERIES = f"""
s0 AS (
  SELECT token, symbol, trade_date, history_days AS rn, close, high, low, open,
         CASE WHEN history_days = 1 THEN high - low ELSE greatest(high - low, abs(high - {lag("close")}), abs(low - {lag("close")})) END AS tr,
         greatest(close - {lag("close")}, 0) AS gain, greatest({lag("close")} - close, 0) AS loss,
         CASE WHEN high - {lag("high")} > {lag("low")} - low AND high - {lag("high")} > 0 THEN high - {lag("high")} ELSE 0 END AS plus_dm,
         CASE WHEN {lag("low")} - low > high - {lag("high")} AND {lag("low")} - low > 0 THEN {lag("low")} - low ELSE 0 END AS minus_dm
  FROM adj
)"""
EMAS = {n: smoothed(f"ema_{n}", "s0", "close", 2 / (n + 1), n) for n in (12, 21, 26, 50)}
ATR = smoothed("atr", "s0", "tr", 1 / 14, 14)
RSI = smoothed("up", "s0", "gain", 1 / 14, 14, 2) + "," + smoothed("down", "s0", "loss", 1 / 14, 14, 2)
ADX = (
    smoothed("dtr", "s0", "tr", 1 / 14, 14, 2)
    + ","
    + smoothed("dplus", "s0", "plus_dm", 1 / 14, 14, 2)
    + ","
    + smoothed("dminus", "s0", "minus_dm", 1 / 14, 14, 2)
    + """,
dx AS (
  SELECT t.token, t.rn, CASE WHEN p.v + m.v > 0 THEN 100 * abs(100 * p.v / t.v - 100 * m.v / t.v) / (100 * p.v / t.v + 100 * m.v / t.v) END AS dx
  FROM dtr t JOIN dplus p USING (token, rn) JOIN dminus m USING (token, rn)
),"""
    + smoothed("adx", "dx", "dx", 1 / 14, 14, 15)
)
MACD = (
    EMAS[12]
    + ","
    + EMAS[26]
    + """,
line AS (SELECT token, rn, a.v - b.v AS line FROM ema_12 a JOIN ema_26 b USING (token, rn)),"""
    + smoothed("signal", "line", "line", 2 / 10, 9, 26)
)


def num(name: str, x: str | None = None) -> str:
    return f"round({x or name}, 6) + 0.0 AS {name}"


def whole(name: str, x: str | None = None) -> str:
    return f"CAST({x or name} AS BIGINT) AS {name}"


def select(*columns: str, source: str = "m3", parts: str = "") -> str:
    return f"WITH RECURSIVE {WALK}, {M1}{parts} SELECT symbol, trade_date, {', '.join(columns)} FROM {source}"


def recursive(parts: str, columns: str, joins: str) -> str:
    return f"WITH RECURSIVE {WALK}, {SERIES}, {parts} SELECT s.symbol, s.trade_date, {columns} FROM s0 s {joins}"


# Cross-section

ELIGIBLE = """,
named AS (SELECT m3.*, i.series, i.industry, i.float_shares FROM m3 JOIN instruments i USING (token)),
x0 AS (
  SELECT *, CASE WHEN series NOT IN ('EQ', 'BE') THEN 'series ' || series
                 WHEN history_days < 252 THEN 'insufficient history'
                 WHEN turnover_20d_median IS NULL OR turnover_20d_median < 2e5 THEN 'below liquidity floor' END AS ineligible_reason
  FROM named
), x1 AS (
  SELECT *, ineligible_reason IS NULL AS is_eligible,
         CASE WHEN ineligible_reason IS NULL THEN 0.4 * ret_3m + 0.2 * ret_6m + 0.2 * ret_9m + 0.2 * ret_12m END AS blend,
         CASE WHEN ineligible_reason IS NULL THEN momentum_score END AS em
  FROM x0
), x2 AS (
  SELECT *, CASE WHEN blend IS NOT NULL THEN CASE WHEN count(blend) OVER d = 1 THEN 1.0::DOUBLE
              ELSE (rank() OVER (PARTITION BY trade_date ORDER BY blend NULLS LAST) - 1 + (count(*) OVER (PARTITION BY trade_date, blend) - 1) / 2) / (count(blend) OVER d - 1) END END AS pct,
         CASE WHEN em IS NOT NULL THEN dense_rank() OVER (PARTITION BY trade_date ORDER BY em DESC NULLS LAST) END AS momentum_rank
  FROM x1 WINDOW d AS (PARTITION BY trade_date)
), x3 AS (
  SELECT *, CASE WHEN pct IS NOT NULL THEN greatest(ceil(99.0::DOUBLE * pct), 1) END AS rs_rating FROM x2
), x4 AS (
  SELECT *, trend_template_partial + CASE WHEN rs_rating >= 70 THEN 1 ELSE 0 END AS trend_template_score FROM x3
)"""


def scored(name: str, weights: dict[str, float], source: str = "x4") -> str:
    """A weighted sum of z-scores of winsorised columns over eligible names."""
    low = ", ".join(f"quantile_cont({c}, 0.01) FILTER (WHERE is_eligible) AS lo{k}, quantile_cont({c}, 0.99) FILTER (WHERE is_eligible) AS hi{k}" for k, c in enumerate(weights))
    held = ", ".join(f"CASE WHEN is_eligible AND {c} IS NOT NULL THEN least(greatest({c}, lo{k}), hi{k}) END AS w{k}" for k, c in enumerate(weights))
    total = " + ".join(
        f"{w!r}::DOUBLE * coalesce(CASE WHEN w{k} IS NOT NULL AND count(w{k}) OVER d > 1 THEN CASE WHEN stddev_samp(w{k}) OVER d > 0 THEN (w{k} - avg(w{k}) OVER d) / stddev_samp(w{k}) OVER d ELSE 0 END END, 0)"
        for k, w in enumerate(weights.values())
    )
    return f""",
bounds AS (SELECT trade_date, {low} FROM {source} GROUP BY trade_date),
held AS (SELECT s.*, {held} FROM {source} s JOIN bounds USING (trade_date)),
scored AS (SELECT *, CASE WHEN is_eligible THEN {total} END AS {name} FROM held WINDOW d AS (PARTITION BY trade_date))"""
