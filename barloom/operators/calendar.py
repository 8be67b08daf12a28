"""The trading calendar: stored days, with weekdays where none are stored."""

from __future__ import annotations

import hashlib
from datetime import date, datetime, timedelta
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The session's figures are complete at 18:45 Indian time (UTC + 5:30). Fixed values.
CUT_OFF, OFFSET = (18, 45), timedelta(hours=5, minutes=30)


def days(spark: SparkSession, first: date, final: date) -> DataFrame:
    span = spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(final))).alias("trade_date"))
    return span.withColumn("is_weekday", F.weekday("trade_date") < 5)


def populate_weekdays(calendar: DataFrame, first: date, final: date) -> DataFrame:
    """calendar (trade_date, is_trading_day, note) and the weekdays that it doesn't know."""
    fresh = days(calendar.sparkSession, first, final).where("is_weekday").join(calendar.select("trade_date"), "trade_date", "left_anti")
    return calendar.unionByName(fresh.select("trade_date", F.lit(True).alias("is_trading_day"), F.lit(None).cast("string").alias("note")))


def mark_holidays(calendar: DataFrame, holidays: DataFrame) -> DataFrame:
    """calendar with holidays (trade_date, note) as days without trade."""
    from barloom.operators.store import upsert

    return upsert(calendar, holidays.select("trade_date", F.lit(False).alias("is_trading_day"), "note"), ["trade_date"])


def trading_days(calendar: DataFrame, first: date, final: date) -> DataFrame:
    """Trading days from first to final: the stored ones, or the weekdays if no day of the span is stored."""
    stored = calendar.where(F.col("trade_date").between(F.lit(first), F.lit(final)))
    n = stored.agg(F.count("*").alias("n"))  # one row
    usual = days(calendar.sparkSession, first, final).where("is_weekday").join(F.broadcast(n), F.col("n") == 0).select("trade_date")
    return stored.where("is_trading_day").select("trade_date").union(usual)


def is_trading_day(stored: bool | None, day: date) -> bool:
    return day.weekday() < 5 if stored is None else stored


def previous_trading_day(known: dict[date, bool], day: date, probe: int = 30) -> date | None:
    for back in range(1, probe + 1):
        d = day - timedelta(days=back)
        if is_trading_day(known.get(d), d):
            return d
    return None


def expected_session(known: dict[date, bool], now_utc: datetime) -> date | None:
    """The last session whose figures should be there: today's after the cut-off, else the one before."""
    local = now_utc + OFFSET
    today = local.date()
    if is_trading_day(known.get(today), today) and (local.hour, local.minute) >= CUT_OFF:
        return today
    return previous_trading_day(known, today)


def staleness(data_as_of: date | None, expected: date | None, stamped: str | None, current: str) -> tuple[bool, str | None]:
    """Whether stored metrics are stale, and why."""
    if data_as_of is None:
        return True, "no metrics stored"
    if expected is not None and data_as_of < expected:
        return True, f"data as of {data_as_of}, expected {expected}"
    if stamped is None:
        return True, "metrics carry no engine stamp"
    if stamped != current:
        return True, "metrics were computed by another engine version"
    return False, None


#: The modules that define the metrics.
DEFINING = (
    "config.py",
    "functions/fib.py",
    "functions/frames.py",
    "functions/recurrences.py",
    "functions/symbol.py",
    "functions/windows.py",
    "operators/adjust.py",
    "operators/cross_section.py",
    "operators/series.py",
    "plans/engine.py",
)


def engine_fingerprint(root: Path | None = None) -> str:
    """A digest of the modules that define the metrics (under root); line ends don't count."""
    root, digest = root or Path(__file__).resolve().parent.parent, hashlib.blake2b(digest_size=16)
    for name in DEFINING:
        digest.update((root / name).read_bytes().replace(b"\r\n", b"\n"))
    return digest.hexdigest()
