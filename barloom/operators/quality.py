"""The quality gate over bars: nine checks, each one row; failed blocking checks stop the pipeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.frames import by

OUTLIER, ROWS_OFF, SOURCES_OFF = 0.35, 0.05, 0.001


def _row(checked: DataFrame, check: str, severity: str, affected: Column) -> DataFrame:
    """One row from one aggregation: a check passes if nothing is affected."""
    n = F.coalesce(affected, F.lit(0)).cast("long")
    return checked.agg(n.alias("affected")).select(
        F.lit(check).alias("check_id"), F.lit(severity).alias("severity"), (F.col("affected") == 0).alias("passed"), "affected"
    )


def bad_order() -> Column:
    """V3's condition: a low above the open or close, or a high under them."""
    return (F.col("low") > F.least("open", "close")) | (F.col("high") < F.greatest("open", "close"))


def bad_price() -> Column:
    """V4's condition: a price that isn't there or not above 0."""
    bad = F.lit(False)
    for c in ("open", "high", "low", "close"):
        bad = bad | F.col(c).isNull() | (F.col(c) <= 0)
    return bad


def no_volume() -> Column:
    """V6's condition."""
    return F.coalesce("volume", F.lit(0)) == 0


def rows_off(as_of, expected: int) -> Column:
    """V1's count: how far the session's rows are from what is expected; null within 5 %."""
    n = F.count_if(F.col("trade_date") == F.lit(as_of))
    return F.when(F.abs(n - expected) > ROWS_OFF * expected, F.abs(n - expected))


def row_count(bars: DataFrame, as_of, expected: int) -> DataFrame:
    """V1: the session has a number of rows within 5 % of what is expected."""
    return _row(bars, "V1", "BLOCK", rows_off(as_of, expected))


def duplicates(bars: DataFrame) -> DataFrame:
    """V2: one row for each symbol and session."""
    return _row(bars.groupBy("token", "trade_date").count(), "V2", "BLOCK", F.count_if(F.col("count") > 1))


def ohlc_order(bars: DataFrame) -> DataFrame:
    """V3: low <= open, close <= high."""
    return _row(bars, "V3", "BLOCK", F.count_if(bad_order()))


def positive(bars: DataFrame) -> DataFrame:
    """V4: prices are there and above 0."""
    return _row(bars, "V4", "BLOCK", F.count_if(bad_price()))


def by_row(bars: DataFrame, as_of, expected: int) -> DataFrame:
    """V1, V3, V4 and V6, which look at each row alone, in one aggregation."""
    counts = {"V1": rows_off(as_of, expected), "V3": F.count_if(bad_order()), "V4": F.count_if(bad_price()), "V6": F.count_if(no_volume())}
    sums = bars.agg(*[F.coalesce(n, F.lit(0)).cast("long").alias(k) for k, n in counts.items()])
    found = [F.struct(F.lit(k).alias("check_id"), F.lit("WARN" if k == "V6" else "BLOCK").alias("severity"), (F.col(k) == 0).alias("passed"), F.col(k).alias("affected")) for k in counts]
    return sums.select(F.inline(F.array(*found)))


def outliers(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """(token, trade_date, ret): adjusted closes that move by more than 35 % without a corporate action; to be quarantined."""
    close = F.col("close") * F.col("adj_factor")
    moved = bars.withColumn("_c", close).withColumn("ret", F.col("_c") / F.lag("_c").over(by()) - 1)
    named = actions.select("token", F.col("ex_date").alias("trade_date"))
    return moved.where(F.abs("ret") > OUTLIER).join(named, ["token", "trade_date"], "left_anti").select("token", "trade_date", "ret")


def zero_volume(bars: DataFrame) -> DataFrame:
    """V6."""
    return _row(bars, "V6", "WARN", F.count_if(no_volume()))


def session_validity(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """V7: every bar is on a trading day of calendar (trade_date, is_trading_day)."""
    days = bars.select("trade_date").distinct()
    return _row(days.join(calendar.where("is_trading_day"), "trade_date", "left_anti"), "V7", "BLOCK", F.count("*"))


def missing_sessions(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Trading days between the first and last bar without any bar."""
    ends = bars.agg(F.min("trade_date").alias("a"), F.max("trade_date").alias("b"))  # one row
    days = calendar.where("is_trading_day").join(F.broadcast(ends), F.col("trade_date").between(F.col("a"), F.col("b")))
    return days.select("trade_date").join(bars.select("trade_date").distinct(), "trade_date", "left_anti")


def missing_bars(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """(token, trade_date): trading days between a symbol's first and last bar without a bar of it."""
    spans = bars.groupBy("token").agg(F.min("trade_date").alias("a"), F.max("trade_date").alias("b"))
    days = spans.select("token", F.explode(F.sequence("a", "b")).alias("trade_date"))
    open_days = days.join(calendar.where("is_trading_day").select("trade_date"), "trade_date")
    return open_days.join(bars.select("token", "trade_date"), ["token", "trade_date"], "left_anti").select("token", "trade_date")


def cross_source(bars: DataFrame, other: DataFrame) -> DataFrame:
    """V9: closes of two sources differ by over 0.1 %."""
    theirs = other.select("token", "trade_date", F.col("close").alias("theirs"))
    both = bars.join(theirs, ["token", "trade_date"]).where(F.col("theirs") > 0)
    return _row(both, "V9", "WARN", F.count_if(F.abs(F.col("close") / F.col("theirs") - 1) > SOURCES_OFF))


def gate(bars: DataFrame, actions: DataFrame, calendar: DataFrame, as_of, expected: int, other: DataFrame | None = None) -> DataFrame:
    """(check_id, severity, passed, affected) of V1 to V9; bars have adj_factor. Without another source V9 isn't run: its
    passed and affected are null."""
    not_run = bars.sparkSession.createDataFrame([("V9", "WARN", None, None)], "check_id string, severity string, passed boolean, affected long")
    checks = [
        duplicates(bars),
        _row(outliers(bars, actions), "V5", "WARN", F.count("*")),
        session_validity(bars, calendar),
        _row(missing_sessions(bars, calendar), "V8", "WARN", F.count("*")),
        cross_source(bars, other) if other is not None else not_run,
    ]
    whole = by_row(bars, as_of, expected)
    for c in checks:
        whole = whole.union(c)
    return whole


def decision(checks: DataFrame) -> DataFrame:
    """(blocked, failed_blocks, warnings): blocked if any blocking check failed; one that wasn't run hasn't failed."""
    failed = F.coalesce(~F.col("passed"), F.lit(False))
    names = {k: F.array_join(F.array_sort(F.collect_list(F.when(failed & (F.col("severity") == k), F.col("check_id")))), ",") for k in ("BLOCK", "WARN")}
    return checks.agg(
        F.coalesce(F.bool_or(failed & (F.col("severity") == "BLOCK")), F.lit(False)).alias("blocked"),
        names["BLOCK"].alias("failed_blocks"),
        names["WARN"].alias("warnings"),
    )


def discontinuities(rows: DataFrame, quarantined: DataFrame, span: int = 252) -> DataFrame:
    """(token, trade_date, note): bars whose last `span` sessions hold a quarantined break of their symbol."""
    marked = rows.select("token", "trade_date").join(quarantined.select("token", "trade_date", F.lit(True).alias("_b")), ["token", "trade_date"], "left")
    rn = F.row_number().over(by())
    latest = F.max(F.when(F.col("_b"), F.struct(F.col("_rn").alias("rn"), F.col("trade_date").alias("d")))).over(by().rowsBetween(Window.unboundedPreceding, 0))
    dated = marked.withColumn("_rn", rn).withColumn("_l", latest).where(F.col("_rn") - F.col("_l.rn") < span)
    return dated.select("token", "trade_date", F.concat(F.lit("price break on "), F.col("_l.d").cast("string")).alias("note"))
