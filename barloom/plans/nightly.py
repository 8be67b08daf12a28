"""The end of a day as one plan: what to fetch again, the merge of what was fetched, and the sessions to recompute."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.config import DEFAULT, Settings
from barloom.operators.store import upsert
from barloom.plans.engine import metrics

#: Sessions that are fetched again for late corrections, and days that a history may begin late. Fixed values.
OVERLAP, LATE_START = 5, 45


def refetch_from(bars: DataFrame, overlap: int = OVERLAP) -> DataFrame:
    """(start): the first of the last `overlap` stored sessions; of fewer, the latest; null without bars."""
    back = Window.orderBy(F.desc("trade_date"))  # a row for each session
    days = bars.select("trade_date").distinct().withColumn("n", F.row_number().over(back))
    return days.agg(F.coalesce(F.max(F.when(F.col("n") == overlap, F.col("trade_date"))), F.max("trade_date")).alias("start"))


def to_backfill(instruments: DataFrame, bars: DataFrame, start, s: Settings = DEFAULT) -> DataFrame:
    """The instruments whose history has to be loaded: fewer bars than metrics need, or begun too long after start."""
    known = bars.groupBy("token").agg(F.count("*").alias("_n"), F.min("trade_date").alias("_first"))
    enough = (F.col("_n") >= s.min_history_days) & (F.col("_first") <= F.date_add(F.lit(start).cast("date"), LATE_START))
    return instruments.join(known, "token", "left").where(~F.coalesce(enough, F.lit(False))).drop("_n", "_first")


@dataclass
class Day:
    bars: DataFrame
    sessions: DataFrame
    metrics: DataFrame


def end_of_day(
    bars: DataFrame,
    fetched: DataFrame,
    members: DataFrame,
    actions: DataFrame,
    instruments: DataFrame,
    index: DataFrame,
    s: Settings = DEFAULT,
    delivery: DataFrame | None = None,
) -> Day:
    """All bars after the merge, the sessions that were touched, and their metrics.

    fetched (symbol, trade_date, open, high, low, close, volume, ...) counts for symbols of members (token) alone, and
    replaces what is stored of its sessions' symbols; delivery (symbol, trade_date, delivery_pct) comes with it, and a
    delivery that is known isn't lost. Symbols of one session are expected once. Metrics read the whole history and are
    kept for the touched sessions: write them with store.replace_partitions, and a rerun changes nothing.
    """
    tokens = instruments.join(members.select("token"), "token", "left_semi").select("token", "symbol")
    new = fetched.join(tokens, "symbol")
    if delivery is not None:
        new = new.drop("delivery_pct").join(delivery.select("symbol", "trade_date", "delivery_pct"), ["symbol", "trade_date"], "left")
    new = new.select(*[F.col(c) if c in new.columns else F.lit(None).cast(kind).alias(c) for c, kind in bars.dtypes])
    sessions = new.select("trade_date").distinct()
    whole = upsert(bars, new, ["token", "trade_date"], ["delivery_pct"])
    made = metrics(whole, actions, instruments, index, s, sessions=[r[0] for r in sessions.collect()])  # a few dates
    return Day(whole, sessions, made)
