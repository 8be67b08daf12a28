"""Split and bonus adjustment, and its reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.frames import by

FACTOR_TYPES = ("SPLIT", "BONUS")


def with_factors(bars: DataFrame, actions: DataFrame, adjusted_sources: tuple[str, ...] = ()) -> DataFrame:
    """bars with adj_factor: the product of from / to over a symbol's splits and bonuses after the bar.

    An action counts for bars before its ex-date that weren't adjusted for it already: a source of pre-adjusted bars is
    adjusted through the day it was read (ingested_at), others through their own date. Actions with a ratio that isn't
    positive are skipped. A symbol has few actions: they come as one array, so no bar is multiplied by the join.
    """
    ratio = F.col("ratio_from") / F.col("ratio_to")
    events = (
        actions.where(F.col("action_type").isin(*FACTOR_TYPES) & (F.col("ratio_from") > 0) & (F.col("ratio_to") > 0))
        .groupBy("token")
        .agg(F.array_sort(F.collect_list(F.struct("ex_date", ratio.alias("f")))).alias("_events"))
    )
    through = F.col("trade_date")
    if adjusted_sources and "ingested_at" in bars.columns:
        through = F.when(F.col("source").isin(*adjusted_sources), F.to_date("ingested_at")).otherwise(through)
    joined = bars.join(events, "token", "left").withColumn("_through", through)
    later = F.filter("_events", lambda e: (F.col("trade_date") < e["ex_date"]) & (F.col("_through") < e["ex_date"]))
    factor = F.aggregate(later, F.lit(1.0), lambda acc, e: acc * e["f"])
    return joined.withColumn("adj_factor", F.coalesce(factor, F.lit(1.0))).drop("_events", "_through")


def unreconciled(bars: DataFrame, actions: DataFrame, limit: float = 0.35) -> DataFrame:
    """Ex-dates on which the adjusted close still moves by more than limit: a missing or wrong ratio."""
    close = F.col("close") * F.col("adj_factor")
    moved = bars.withColumn("_c", close).withColumn("ret", F.col("_c") / F.lag("_c").over(by()) - 1)
    named = actions.select("token", F.col("ex_date").alias("trade_date"), "action_type")
    return moved.join(named, ["token", "trade_date"]).where(F.abs("ret") > limit).select("token", "trade_date", "action_type", "ret")
