"""Metrics across symbols on each date: eligibility first, then ranks and scores over eligible names only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.config import COMPOSITE_WEIGHTS, DEFAULT, SETUP_WEIGHTS, Settings
from barloom.functions.frames import by_date, over, percentile_rank, tri, winsorised, zscore

INDEX_RETURNS = {"rs_1m": 21, "rs_3m": 63, "rs_6m": 126, "rs_12m": 252}


def eligibility(rows: DataFrame, s: Settings = DEFAULT, excluded: DataFrame | None = None, breaks: DataFrame | None = None) -> DataFrame:
    """is_eligible and ineligible_reason: the first rule that a row fails.

    excluded: (symbol) under surveillance. breaks: (token, trade_date, note) of price breaks that a row's windows span.
    """
    if excluded is not None:
        rows = rows.join(excluded.select("symbol", F.lit(True).alias("_out")).distinct(), "symbol", "left")
    else:
        rows = rows.withColumn("_out", F.lit(None).cast("boolean"))
    if breaks is not None:
        rows = rows.join(breaks.select("token", "trade_date", F.col("note").alias("_note")), ["token", "trade_date"], "left")
    else:
        rows = rows.withColumn("_note", F.lit(None).cast("string"))
    turnover, days = F.col("turnover_20d_median"), F.col("history_days")
    reason = (
        F.when(F.col("series").isNull() | ~F.col("series").isin(*s.allowed_series), F.concat(F.lit("series "), F.coalesce("series", F.lit(""))))
        .when(F.col("_out"), "surveillance (ASM/GSM/T2T/suspended)")
        .when(days.isNull() | (days < s.min_history_days), "insufficient history")
        .when(turnover.isNull() | (turnover < s.liquidity_floor), "below liquidity floor")
        .otherwise(F.col("_note"))
    )
    rows = rows.withColumn("ineligible_reason", reason).drop("_out", "_note")
    return rows.withColumn("is_eligible", F.col("ineligible_reason").isNull())


def index_returns(index: DataFrame) -> DataFrame:
    """(since, until, _rs_1m ..): the index's returns of each session, which hold until the next session begins.

    index (trade_date, close) has one row a session, so a window over all of it is small and bounded.
    """
    line = Window.orderBy("trade_date")
    c = F.col("close")
    made = [(over(c, F.lag(c, n).over(line)) - 1).alias(f"_{k}") for k, n in INDEX_RETURNS.items()]
    return index.select(F.col("trade_date").alias("since"), F.lead("trade_date").over(line).alias("until"), *made)


def relative_strength(rows: DataFrame, index: DataFrame) -> DataFrame:
    """rs_1m .. rs_12m against index (trade_date, close), as of each row's date: a date that the index hasn't got takes the
    last session before it."""
    day, spans = F.col("trade_date"), index_returns(index)
    months = F.sequence(F.trunc("since", "MM"), F.trunc(F.date_sub("until", 1), "MM"), F.expr("interval 1 month"))
    # one row a session of one index: a few thousand rows of 50 bytes
    closed = spans.where("until is not null").withColumn("_month", F.explode(months))
    here = (F.trunc(day, "MM") == F.col("_month")) & (day >= F.col("since")) & (day < F.col("until"))
    latest = spans.where("until is null").select(F.col("since").alias("_last"), *[F.col(f"_{k}").alias(f"_last_{k}") for k in INDEX_RETURNS])
    joined = rows.join(F.broadcast(closed), here, "left").join(F.broadcast(latest), day >= F.col("_last"), "left")
    joined = joined.withColumns({f"_{k}": F.when(F.col("_last").isNotNull(), F.col(f"_last_{k}")).otherwise(F.col(f"_{k}")) for k in INDEX_RETURNS})
    joined = joined.drop("since", "until", "_month", "_last", *[f"_last_{k}" for k in INDEX_RETURNS])
    made = {k: F.when(F.col(f"_{k}") > -1, (1 + F.col(k.replace("rs_", "ret_"))) / (1 + F.col(f"_{k}")) - 1) for k in INDEX_RETURNS}
    return joined.withColumns(made).drop(*[f"_{k}" for k in INDEX_RETURNS])


def rs_rating(rows: DataFrame) -> DataFrame:
    blend = 0.4 * F.col("ret_3m") + 0.2 * F.col("ret_6m") + 0.2 * F.col("ret_9m") + 0.2 * F.col("ret_12m")
    rows = rows.withColumn("_blend", F.when(F.col("is_eligible"), blend))
    rating = F.greatest(F.ceil(99.0 * percentile_rank("_blend", ["trade_date"])), F.lit(1))
    return rows.withColumn("rs_rating", F.when(F.col("_blend").isNotNull(), rating).cast("long")).drop("_blend")


def momentum_rank(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("_m", F.when(F.col("is_eligible"), F.col("momentum_score")))
    rank = F.dense_rank().over(by_date().orderBy(F.desc_nulls_last("_m"))).cast("long")
    return rows.withColumn("momentum_rank", F.when(F.col("_m").isNotNull(), rank)).drop("_m")


def weighted(rows: DataFrame, name: str, weights: dict[str, float]) -> DataFrame:
    """Sum of weights times z-scores of winsorised columns, over eligible names; an unknown component adds nothing."""
    own = {f"_x{k}": F.when(F.col("is_eligible"), F.col(c)) for k, c in enumerate(weights)}
    rows = rows.withColumns(own).withColumns({f"_w{k}": winsorised(F.col(f"_x{k}"), by_date()) for k in range(len(own))})
    total: Column = F.lit(0.0)
    for k, w in enumerate(weights.values()):
        total = total + w * F.coalesce(zscore(F.col(f"_w{k}"), by_date()), F.lit(0.0))
    return rows.withColumn(name, F.when(F.col("is_eligible"), total)).drop(*own, *[f"_w{k}" for k in range(len(own))])


def scores(rows: DataFrame) -> DataFrame:
    """composite_z and, where the fib columns are there, fib_setup_score."""
    rows = weighted(rows, "composite_z", COMPOSITE_WEIGHTS)
    if "vol_dryup_ratio" in rows.columns:
        dryup = F.col("vol_dryup_ratio")
        rows = weighted(rows.withColumn("inv_vol_dryup", over(F.lit(1.0), dryup)), "fib_setup_score", SETUP_WEIGHTS).drop("inv_vol_dryup")
    return rows


def trend_template(rows: DataFrame) -> DataFrame:
    score = F.col("trend_template_partial") + F.coalesce((F.col("rs_rating") >= 70).cast("int"), F.lit(0))
    rows = rows.withColumn("trend_template_score", score)
    return rows.withColumn("is_trend_template", tri(F.col("trend_template_score") >= 8, F.col("trend_template_score")))


def pullback(rows: DataFrame) -> DataFrame:
    c, e, s50, week, rsi = (F.col(x) for x in ("close", "ema_21", "sma_50", "ret_1w", "rsi_14"))
    near = (F.abs(c / e - 1) <= 0.03) | (F.abs(c / s50 - 1) <= 0.03)
    rule = F.coalesce("ma_alignment", F.lit(False)) & F.col("is_trend_template") & near & (week < 0) & rsi.between(40, 55)
    return rows.withColumn("is_pullback", tri(rule, c, e, s50, week, rsi, F.col("is_trend_template")))


def cross_section(rows: DataFrame, index: DataFrame, s: Settings = DEFAULT, excluded: DataFrame | None = None, breaks: DataFrame | None = None) -> DataFrame:
    """All cross-sectional metrics, from the series pass with the symbols' `series`; one shuffle by date."""
    rows = relative_strength(eligibility(rows, s, excluded, breaks), index)
    return pullback(trend_template(scores(momentum_rank(rs_rating(rows)))))
