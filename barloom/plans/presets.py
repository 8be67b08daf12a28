"""Built-in screens and market-wide readings. Names, fields and thresholds are fixed values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.config import DEFAULT, Settings


def screen_of(
    name: str, conditions: list[tuple], sort: list[tuple[str, str]], limit: int | None, op: str = "AND", everyone: bool = False
) -> dict:
    """conditions: (field, operator, value); sort: (field, direction)."""
    made = {
        "name": name,
        "version": 1,
        "universe": {"index": DEFAULT.index_name, "exclude_ineligible": not everyone},
        "filters": {"op": op, "conditions": [{"field": f, "operator": o, "value": v} for f, o, v in conditions]},
        "sort": [{"field": f, "direction": d} for f, d in sort],
    }
    return made if limit is None else made | {"limit": limit}


PRESETS = {
    p["name"]: p
    for p in (
        screen_of("Momentum Leaders", [("momentum_rank", "<=", 20), ("gap_disqualified", "=", False)], [("momentum_rank", "asc")], 20),
        screen_of("Trend Template", [("is_trend_template", "=", True)], [("rs_rating", "desc")], 100),
        screen_of(
            "52-Week High Breakout",
            [("is_52w_high_breakout", "=", True), ("rel_volume", ">=", 1.5), ("atr_pct_14", "<=", 0.07)],
            [("momentum_score", "desc")],
            50,
        ),
        screen_of(
            "Volatility Contraction",
            [("is_in_base", "=", True), ("base_length_days", ">=", 10), ("rs_rating", ">=", 70), ("range_position_52w", ">=", 0.7)],
            [("base_length_days", "desc")],
            50,
        ),
        screen_of("Pullback to Support", [("is_pullback", "=", True)], [("momentum_score", "desc")], 50),
        screen_of(
            "Pullback + Reversal",
            [("is_pullback_reversal", "=", True)],
            [("reversal_score", "desc"), ("rs_rating", "desc"), ("support_distance_pct", "asc"), ("instrument_token", "asc")],
            None,
        ),
        screen_of(
            "Approaching High",
            [
                ("pct_from_period_high", ">=", -0.03),
                ("pct_from_period_high", "<", 0.0),
                ("trend_template_score", ">=", 5),
                ("rel_volume", ">=", 0.8),
                ("gap_disqualified", "=", False),
            ],
            [("pct_from_period_high", "desc"), ("rs_rating", "desc"), ("instrument_token", "asc")],
            50,
        ),
        screen_of(
            "Fibonacci Reversal Zone",
            [
                ("is_long_term_uptrend", "=", True),
                ("sma_200_slope_1m", ">", 0.0),
                ("rs_rating", ">=", 70),
                ("in_fib_zone", "=", True),
                ("vol_impulse_ratio", ">=", DEFAULT.fib_impulse_min),
                ("vol_dryup_ratio", "<=", DEFAULT.fib_dryup_max),
                ("is_fib_reversal_bar", "=", True),
                ("fib_reward_risk", ">=", DEFAULT.fib_min_reward_risk),
            ],
            [("fib_setup_score", "desc"), ("instrument_token", "asc")],
            25,
        ),
        screen_of("All Constituents", [], [("market_cap", "desc"), ("tradingsymbol", "asc")], 500, everyone=True),
        screen_of(
            "Momentum Breakdown",
            [("momentum_rank", ">", 250), ("pct_from_52w_high", "<=", -0.20)],
            [("momentum_rank", "desc")],
            100,
            op="OR",
            everyone=True,
        ),
    )
}


def fib_funnel(rows: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(trade_date, stage counts): how many names pass each gate of the retracement screen, in one aggregation."""
    gated = F.col("is_eligible") & F.col("is_long_term_uptrend") & (F.col("sma_200_slope_1m") > 0) & (F.col("rs_rating") >= 70)
    zone = gated & F.col("in_fib_zone")
    shaped = zone & (F.col("vol_impulse_ratio") >= s.fib_impulse_min) & (F.col("vol_dryup_ratio") <= s.fib_dryup_max)
    turned = shaped & F.col("is_fib_reversal_bar")
    stages = {
        "gated": gated,
        "valid_leg": gated & F.col("fib_leg_high_price").isNotNull(),
        "in_zone": zone,
        "volume_shape": shaped,
        "reversal_bar": turned,
        "passed_rr": turned & (F.col("fib_reward_risk") >= s.fib_min_reward_risk),
    }
    return rows.groupBy("trade_date").agg(F.count("*").alias("universe"), *[F.count_if(c).alias(k) for k, c in stages.items()])


def breadth(rows: DataFrame) -> DataFrame:
    """(trade_date, new_highs, new_lows, net_new_highs, advances, declines, universe) over eligible names."""
    low = F.col("pct_from_52w_high").isNotNull() & (F.col("pct_above_52w_low") <= 0.001)
    highs, lows = F.count_if("is_52w_high_breakout"), F.count_if(low)
    return (
        rows.where("is_eligible")
        .groupBy("trade_date")
        .agg(
            highs.alias("new_highs"),
            lows.alias("new_lows"),
            (highs - lows).alias("net_new_highs"),
            F.count_if(F.col("ret_1d") > 0).alias("advances"),
            F.count_if(F.col("ret_1d") < 0).alias("declines"),
            F.count("*").alias("universe"),
        )
    )


def market_regime(index: DataFrame, read: DataFrame) -> DataFrame:
    """(trade_date, index_close, sma_50, sma_200, net_new_highs, regime) of each index session.

    read is breadth(); without a row for the session there are no net new highs.
    """
    line = Window.orderBy("trade_date")  # a row for each session of one index

    def mean(n: int):
        return F.when(F.count("close").over(line.rowsBetween(1 - n, 0)) == n, F.avg("close").over(line.rowsBetween(1 - n, 0)))

    known = index.select("trade_date", F.col("close").alias("index_close"), mean(50).alias("sma_50"), mean(200).alias("sma_200"))
    joined = known.join(read.select("trade_date", "net_new_highs"), "trade_date", "left").na.fill(0, ["net_new_highs"])
    regime = (
        F.when(F.col("sma_200").isNull(), "Unknown")
        .when(F.col("index_close") < F.col("sma_200"), "Risk-off")
        .when((F.col("sma_50") > F.col("sma_200")) & (F.col("net_new_highs") > 0), "Risk-on")
        .otherwise("Neutral")
    )
    return joined.withColumn("regime", regime)


def sector_heatmap(rows: DataFrame, least: int = 3) -> DataFrame:
    """(trade_date, industry, median_ret_1w, n) of industries with enough eligible names."""
    return (
        rows.where(F.col("is_eligible") & F.col("industry").isNotNull())
        .groupBy("trade_date", "industry")
        .agg(F.median("ret_1w").alias("median_ret_1w"), F.count("*").alias("n"))
        .where(F.col("n") >= least)
    )
