"""Index analytics: ranges and trend states, coverage, valuation against its own history, tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.frames import over

SLOPE, BACK, YEAR = 0.001, 21, 252
#: Longest calendar span of 252 rows that still counts as a daily series; least share of sessions; fixed values.
DAILY_SPAN, QUARTER_SHARE, LEAST_READINGS = 460, 0.8, 40


def by():
    return Window.partitionBy("index_name").orderBy("trade_date")


def _full(c: str, n: int, agg):
    frame = by().rowsBetween(1 - n, 0)
    return F.when(F.count(c).over(frame) == n, agg(c).over(frame))


def index_ranges(index: DataFrame) -> DataFrame:
    """index (index_name, trade_date, high, low, close) with its 52-week range, today included, and earlier period high.

    A null high or low, as in a series of closes alone, is the close.
    """
    c = F.col("close")
    index = index.withColumns({"high": F.coalesce("high", "close"), "low": F.coalesce("low", "close")})
    made = index.withColumns(
        {
            "rn": F.row_number().over(by()).cast("long"),
            "high_52w": _full("high", YEAR, F.max),
            "low_52w": _full("low", YEAR, F.min),
            "period_high": F.max("high").over(by().rowsBetween(Window.unboundedPreceding, -1)),
        }
    )
    # the earliest of equal highs
    first = F.max_by(F.col("rn"), F.struct("high", (-F.col("rn")).alias("r"))).over(by().rowsBetween(Window.unboundedPreceding, -1))
    return made.withColumns(
        {
            "range_position": over(c - F.col("low_52w"), F.col("high_52w") - F.col("low_52w")),
            "pct_from_52w_high": over(c, F.col("high_52w")) - 1,
            "pct_from_period_high": over(c, F.col("period_high")) - 1,
            "sessions_since_high": F.col("rn") - first,
        }
    )


def trend_states(index: DataFrame) -> DataFrame:
    """state (UPTREND, DOWNTREND, TRANSITIONAL, or null without 221 sessions) and sessions_in_state."""
    c = F.col("close")
    made = index.withColumns({"_rn": F.row_number().over(by()), "sma_50": _full("close", 50, F.avg), "sma_200": _full("close", 200, F.avg)})
    made = made.withColumn("slope", over(F.col("sma_200"), F.lag("sma_200", BACK).over(by())) - 1)
    up = (c > F.col("sma_200")) & (F.col("sma_50") > F.col("sma_200")) & (F.col("slope") > SLOPE)
    down = (c < F.col("sma_200")) & (F.col("sma_50") < F.col("sma_200")) & (F.col("slope") < -SLOPE)
    state = F.when(F.col("slope").isNotNull(), F.when(up, "UPTREND").when(down, "DOWNTREND").otherwise("TRANSITIONAL"))
    made = made.withColumn("state", state)
    turned = F.when(~F.col("state").eqNullSafe(F.lag("state").over(by())) | (F.col("_rn") == 1), F.col("_rn"))
    began = F.max(turned).over(by().rowsBetween(Window.unboundedPreceding, 0))
    return made.withColumn("sessions_in_state", F.when(F.col("state").isNotNull(), F.col("_rn") - began + 1).cast("long")).drop("_rn")


MEASURED = ("high_52w", "low_52w", "period_high", "range_position", "pct_from_52w_high", "pct_from_period_high", "sessions_since_high", "state", "sessions_in_state", "sma_50", "sma_200")


def index_metrics(index: DataFrame) -> DataFrame:
    """The latest row of each index with ranges and trend, uptrends first, then by range position.

    available is false, and all measures are null, where the last 252 sessions aren't daily (coverage()): a 52-week window
    would then measure another span than it names. reason says why something isn't there.
    """
    rows = trend_states(index_ranges(index))
    latest = rows.withColumn("_p", F.row_number().over(Window.partitionBy("index_name").orderBy(F.desc("trade_date")))).where("_p = 1").drop("_p")
    known = coverage(index).select("index_name", "daily", "sessions", F.datediff("last_date", "window_from").alias("span"))
    joined = latest.join(known, "index_name").withColumnRenamed("daily", "available")
    joined = joined.withColumns({c: F.when(F.col("available"), F.col(c)) for c in MEASURED})
    thin = F.concat(F.lit("the last sessions span "), F.col("span").cast("string"), F.lit(" days: not a daily series"))
    short = F.concat(F.col("sessions").cast("string"), F.lit(" sessions; a trend state needs 221"))
    rank = F.when(F.col("state") == "UPTREND", 0).when(F.col("state") == "TRANSITIONAL", 1).when(F.col("state") == "DOWNTREND", 2).otherwise(3)
    made = joined.withColumns({"reason": F.when(~F.col("available"), thin).when(F.col("state").isNull(), short), "sort_key": rank})
    return made.drop("rn", "slope", "span").orderBy("sort_key", F.desc_nulls_last("range_position"), "index_name")


def weekdays_between(first: Column, last: Column) -> Column:
    """Monday to Friday, both ends included: whole weeks, and those of the rest from the first day on."""
    span = F.datediff(last, first) + 1
    extra = F.size(F.filter(F.sequence(F.lit(0), F.lit(6)), lambda k: (k < span % 7) & ((F.weekday(first) + k) % 7 < 5)))
    return (F.floor(span / 7) * 5 + extra).cast("long")


def coverage(index: DataFrame, calendar: DataFrame | None = None, inception: DataFrame | None = None) -> DataFrame:
    """(index_name, first_date, last_date, sessions, window_from, expected, density, daily, reaches_inception).

    expected counts the trading days of calendar (trade_date, is_trading_day) where it spans the whole series, else
    weekdays. daily: the last 252 sessions lie within 460 days. inception (index_name, inception) says when an index
    began; unknown counts as not reached.
    """
    back = Window.partitionBy("index_name").orderBy(F.desc("trade_date"))
    recent = index.withColumn("_p", F.row_number().over(back))
    made = recent.groupBy("index_name").agg(
        F.min("trade_date").alias("first_date"),
        F.max("trade_date").alias("last_date"),
        F.count("*").alias("sessions"),
        F.min(F.when(F.col("_p") <= YEAR, F.col("trade_date"))).alias("window_from"),
    )
    usual = weekdays_between(F.col("first_date"), F.col("last_date"))
    if calendar is not None:
        span = F.col("trade_date").between(F.col("first_date"), F.col("last_date"))
        # a row for each index, and a calendar of a few thousand days
        within = made.join(F.broadcast(calendar), span).groupBy("index_name").agg(F.count_if("is_trading_day").alias("_open"))
        ends = calendar.agg(F.min("trade_date").alias("_a"), F.max("trade_date").alias("_b"))
        made = made.join(within, "index_name", "left").join(F.broadcast(ends), (F.col("_a") <= F.col("first_date")) & (F.col("_b") >= F.col("last_date")), "left")
        usual = F.when(F.col("_a").isNotNull(), F.coalesce("_open", F.lit(0))).otherwise(usual)
    reached = F.lit(False)
    if inception is not None:
        made = made.join(F.broadcast(inception.select("index_name", F.col("inception").alias("_began"))), "index_name", "left")
        reached = F.coalesce(F.col("first_date") <= F.col("_began"), F.lit(False))
    daily = (F.col("sessions") >= YEAR) & (F.datediff("last_date", "window_from") <= DAILY_SPAN)
    made = made.withColumns({"expected": usual, "daily": daily, "reaches_inception": reached})
    return made.withColumn("density", F.col("sessions") / F.col("expected")).drop("_open", "_a", "_b", "_began")


def valuation(history: DataFrame, horizons: tuple[int, ...] = (7, 10)) -> DataFrame:
    """(index_name, as_of, pe, years, observations, quarters, months, median_pe, pe_vs_pct) for each horizon.

    The median of monthly medians over 365 * years days back; null with under 80 % of the quarters or 40 readings.
    """
    latest = history.groupBy("index_name").agg(F.max("trade_date").alias("as_of"), F.max_by("pe", "trade_date").alias("current"))
    spans = latest.withColumn("years", F.explode(F.array(*[F.lit(y) for y in horizons])))
    read = history.where("pe is not null").select("index_name", "trade_date", "pe")
    obs = read.join(spans, "index_name").where(F.col("trade_date").between(F.date_sub("as_of", F.col("years") * 365), F.col("as_of")))
    keys = ["index_name", "years"]
    monthly = obs.groupBy(*keys, F.trunc("trade_date", "MM").alias("month")).agg(F.median("pe").alias("pe"), F.count("*").alias("n"))
    whole = monthly.groupBy(*keys).agg(
        F.median("pe").alias("_median"),
        F.sum("n").alias("observations"),
        F.countDistinct(F.trunc("month", "QUARTER")).alias("quarters"),
        F.count("*").alias("months"),
    )
    enough = (F.col("quarters") >= F.col("years") * 4 * QUARTER_SHARE) & (F.col("observations") >= LEAST_READINGS)
    made = spans.join(whole, keys, "left").withColumn("median_pe", F.when(enough, F.col("_median")))
    gap = F.when((F.col("median_pe") != 0) & (F.col("current") != 0), (F.col("current") / F.col("median_pe") - 1) * 100)
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("observations", "quarters", "months")}
    return made.withColumns(counts | {"pe_vs_pct": gap}).withColumnRenamed("current", "pe").drop("_median")


def tag_tiers(instruments: DataFrame, tiers: DataFrame) -> DataFrame:
    """instruments with index_tier of tiers (symbol, tier), matched whatever the case; the first tier of a repeated symbol."""
    known = tiers.groupBy(F.upper("symbol").alias("_s")).agg(F.min("tier").alias("index_tier"))
    return instruments.drop("index_tier").join(known, F.upper("symbol") == F.col("_s"), "left").drop("_s")


def sample_sessions(sessions: DataFrame, stored: DataFrame, every: int, force: bool = False) -> DataFrame:
    """Every k-th session of sessions (index_name, trade_date) and the latest, without those stored already unless forced."""
    back = Window.partitionBy("index_name").orderBy(F.desc("trade_date"))
    marked = sessions.withColumns({"_n": F.row_number().over(by()) - 1, "_l": F.row_number().over(back)})
    chosen = marked.where((F.col("_n") % every == 0) | (F.col("_l") == 1)).select("index_name", "trade_date")
    return chosen if force else chosen.join(stored.select("index_name", "trade_date"), ["index_name", "trade_date"], "left_anti")


def close_only(valuations: DataFrame) -> DataFrame:
    """An index series from valuations: closes alone, the rest null."""
    none = [F.lit(None).cast("double").alias(c) for c in ("open", "high", "low")]
    return valuations.where("close is not null").select("index_name", "trade_date", *none, "close")


def buy_and_hold(index: DataFrame) -> DataFrame:
    """(index_name, sessions, total_return_pct, cagr_pct, max_drawdown_pct)."""
    peak = F.max("close").over(by().rowsBetween(Window.unboundedPreceding, 0))
    made = index.withColumn("_dd", F.col("close") / peak - 1).groupBy("index_name").agg(
        F.count("*").alias("sessions"),
        F.min_by("close", "trade_date").alias("_a"),
        F.max_by("close", "trade_date").alias("_b"),
        (F.min("_dd") * 100).alias("max_drawdown_pct"),
    )
    gain = F.col("_b") / F.col("_a")
    return made.select(
        "index_name",
        "sessions",
        ((gain - 1) * 100).alias("total_return_pct"),
        ((F.pow(gain, YEAR / F.col("sessions")) - 1) * 100).alias("cagr_pct"),
        "max_drawdown_pct",
    )
