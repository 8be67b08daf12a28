"""Market-shaped tables from the driver's star schema: bars, corporate actions, instruments and an index series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F



def by_day():
    return Window.partitionBy("token").orderBy("trade_date")


def trades(spark: SparkSession, sf_dir: str, key: str = "brand") -> DataFrame:
    """(token, symbol, trade_date, price, qty) of every line item; key "brand" has 25 symbols, "supplier" grows with sf."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    day = F.col("l_shipdate").cast("date").alias("trade_date")
    price = (F.col("l_extendedprice") / F.col("l_quantity")).alias("price")
    if key == "supplier":
        name = F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))
        return lines.select(F.col("l_suppkey").alias("token"), name.alias("symbol"), day, price, F.col("l_quantity").alias("qty"))
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand")
    token = F.substring("p_brand", 7, 2).cast("long").alias("token")
    joined = lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(token, F.col("p_brand").alias("symbol"), day, price, F.col("l_quantity").alias("qty"))


def walk(spark: SparkSession, sf_dir: str, key: str = "brand") -> DataFrame:
    """Daily bars on a price walk: each day's average price against the average of all days before moves the close."""
    day = (
        trades(spark, sf_dir, key)
        .groupBy("token", "symbol", "trade_date")
        .agg(
            F.round(F.sum(F.col("price") * F.col("qty")) / F.sum("qty"), 6).alias("vwap"),
            F.min("price").alias("lo"),
            F.max("price").alias("hi"),
            F.sum("qty").alias("qty"),
        )
    )
    before = F.avg("vwap").over(by_day().rowsBetween(Window.unboundedPreceding, -1))
    move = F.round(F.coalesce(0.01 * (F.col("vwap") / before - 1), F.lit(0.0)), 9)
    moved = day.withColumns({"rn": F.row_number().over(by_day()).cast("long"), "move": move})
    path = F.sum("move").over(by_day().rowsBetween(Window.unboundedPreceding, 0))
    closed = moved.withColumn("close", F.round(100 * F.exp(path), 4))
    opened = closed.withColumn("open", F.coalesce(F.lag("close").over(by_day()), F.col("close")))
    up = 1 + 0.00512345678 * F.least(F.col("hi") / F.col("vwap") - 1, F.lit(1.0))
    down = 1 - 0.00512345678 * F.least(1 - F.col("lo") / F.col("vwap"), F.lit(1.0))
    volume = F.round(F.col("qty") * 100).cast("long")
    return opened.select(
        "token",
        "symbol",
        "trade_date",
        "rn",
        "open",
        F.round(F.greatest("open", "close") * up, 4).alias("high"),
        F.round(F.least("open", "close") * down, 4).alias("low"),
        "close",
        volume.alias("volume"),
        F.when(volume % 700 != 0, F.round(40 + 20 * F.col("lo") / F.col("hi"), 4)).alias("delivery_pct"),
    )


def walked(spark: SparkSession, sf_dir: str, key: str = "brand") -> DataFrame:
    """walk(), written to the checkpoint folder where there is one, since bars, actions, names and index all read it."""
    made = walk(spark, sf_dir, key)
    if spark.conf.get("spark.checkpoint.dir", None):
        return made.checkpoint()
    return made


def actions_of(walked: DataFrame) -> DataFrame:
    """Corporate actions: a 1:2 split at session 60 of every fifth token, a 1:4 bonus at session 90 of every seventh."""
    split = walked.where("token % 5 = 0 and rn = 60").selectExpr("token", "trade_date as ex_date", "'SPLIT' as action_type", "1.0D as ratio_from", "2.0D as ratio_to", "cast(null as double) as amount")
    bonus = walked.where("token % 7 = 0 and rn = 90").selectExpr("token", "trade_date as ex_date", "'BONUS' as action_type", "1.0D as ratio_from", "4.0D as ratio_to", "cast(null as double) as amount")
    return split.union(bonus)


def corporate_actions(spark: SparkSession, sf_dir: str, key: str = "brand") -> DataFrame:
    return actions_of(walk(spark, sf_dir, key))


def bars(spark: SparkSession, sf_dir: str, key: str = "brand") -> DataFrame:
    return bars_of(walk(spark, sf_dir, key))


def bars_of(walked: DataFrame) -> DataFrame:
    """Raw bars: prices before a split or bonus are as they traded then."""
    factor = F.when((F.col("token") % 5 == 0) & (F.col("rn") < 60), 0.5).otherwise(1.0) * F.when(
        (F.col("token") % 7 == 0) & (F.col("rn") < 90), 0.25
    ).otherwise(1.0)
    raw = {c: F.round(F.col(c) / F.col("f"), 4) for c in ("open", "high", "low", "close")}
    return (
        walked.withColumn("f", factor)
        .withColumns(raw)
        .withColumn("volume", F.round(F.col("volume") * F.col("f")).cast("long"))
        .select("token", "symbol", "trade_date", "open", "high", "low", "close", "volume", "delivery_pct", F.lit("WALK").alias("source"))
    )


def instruments(spark: SparkSession, sf_dir: str, key: str = "brand") -> DataFrame:
    return instruments_of(trades(spark, sf_dir, key))


def instruments_of(traded: DataFrame) -> DataFrame:
    """One row for each (token, symbol) of traded."""
    return traded.select("token", "symbol").distinct().select(
        "token",
        "symbol",
        F.concat(F.lit("Company "), F.col("token").cast("string")).alias("name"),
        F.when(F.col("token") == 33, "XX").otherwise("EQ").alias("series"),
        F.concat(F.lit("Sector "), F.substring("symbol", 7, 1)).alias("industry"),
        F.when(F.col("token") % 4 != 0, F.col("token") * 1e6).alias("float_shares"),
    )


def index_series(walked: DataFrame) -> DataFrame:
    """(trade_date, open, high, low, close): the mean log-return of all symbols, cumulated from 1000; O, H, L from closes."""
    gain = F.ln(F.col("close") / F.lag("close").over(by_day()))
    mean = walked.withColumn("g", gain).groupBy("trade_date").agg(F.coalesce(F.avg("g"), F.lit(0.0)).alias("g"))
    # one row for each session, whatever the number of symbols
    line = Window.orderBy("trade_date")
    close = F.round(1000 * F.exp(F.sum("g").over(line.rowsBetween(Window.unboundedPreceding, 0))), 4)
    closed = mean.select("trade_date", close.alias("close"))
    return closed.withColumn("open", F.coalesce(F.lag("close").over(line), F.col("close"))).select(
        "trade_date", "open", F.greatest("open", "close").alias("high"), F.least("open", "close").alias("low"), "close"
    )


def segment_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(index_name, trade_date, high, low, close, pe): five index series from orders, one for each market segment."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_totalprice", F.col("o_orderdate").cast("date").alias("trade_date"))
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_mktsegment")
    day = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("c_mktsegment").alias("index_name"), "trade_date")
        .agg(F.round(F.avg("o_totalprice"), 6).alias("mean"), F.count("*").alias("n"))
    )
    by = Window.partitionBy("index_name").orderBy("trade_date")
    before = F.avg("mean").over(by.rowsBetween(Window.unboundedPreceding, -1))
    moved = day.withColumn("move", F.round(F.coalesce(0.01 * (F.col("mean") / before - 1), F.lit(0.0)), 9))
    close = F.round(5000 * F.exp(F.sum("move").over(by.rowsBetween(Window.unboundedPreceding, 0))), 4)
    return moved.withColumn("close", close).select(
        "index_name",
        "trade_date",
        F.round(F.col("close") * 1.005, 4).alias("high"),
        F.round(F.col("close") * 0.995, 4).alias("low"),
        "close",
        F.round(15 + F.pmod(F.col("mean"), F.lit(1000.0)) / 100, 4).alias("pe"),
    )
