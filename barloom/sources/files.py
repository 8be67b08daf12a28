"""Readers for market files: CSV folders, exchange day files, delivery, index close and constituent lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class SchemaDrift(ValueError):
    """A file without the columns that it used to have."""


def require(df: DataFrame, columns: set[str], what: str) -> DataFrame:
    missing = columns - {c.strip() for c in df.columns}
    if missing:
        raise SchemaDrift(f"{what} lacks {sorted(missing)}")
    return df.toDF(*[c.strip() for c in df.columns])


def _csv(spark: SparkSession, path: str, **options) -> DataFrame:
    """A CSV file with header as text columns; a byte order mark in front is dropped."""
    df = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, **options)
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])


def number(c: str | Column) -> Column:
    """A number with thousands separators; "-", "NA" and other text give null."""
    c = F.col(f"`{c}`") if isinstance(c, str) else c
    return F.regexp_replace(c, ",", "").try_cast("double")


def instruments(spark: SparkSession, folder: str) -> DataFrame:
    df = require(_csv(spark, f"{folder}/instruments.csv"), {"tradingsymbol"}, "instruments")
    for c in ("name", "isin", "series", "industry", "sector"):
        df = df if c in df.columns else df.withColumn(c, F.lit(None).cast("string"))
    key = F.when(F.length("isin") > 0, F.col("isin")).otherwise(F.concat(F.lit("SYM:"), F.col("tradingsymbol")))
    # 63 bits of a hash: stable between runs
    return df.withColumn("token", F.xxhash64(key).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF)))


def _filled(df: DataFrame) -> DataFrame:
    """Candles as numbers; missing open, high and low are the close, missing volume is 0."""
    for c in ("open", "high", "low", "volume"):
        df = df if c in df.columns else df.withColumn(c, F.lit(None).cast("string"))
    close = number("close")
    prices = {c: F.coalesce(number(c), close) for c in ("open", "high", "low")}
    return df.withColumns({"trade_date": F.to_date("trade_date"), **prices, "volume": F.coalesce(number("volume"), F.lit(0.0)).cast("long"), "close": close})


def candles(spark: SparkSession, folder: str, first=None, final=None) -> DataFrame:
    """All candles/<symbol>.csv of a folder, dates from first to final."""
    df = require(_csv(spark, f"{folder}/candles/*.csv"), {"trade_date", "close"}, "candles")
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv$", 1)
    df = _filled(df.withColumn("symbol", F.url_decode(name)))
    df = df if first is None else df.where(F.col("trade_date") >= F.lit(first))
    df = df if final is None else df.where(F.col("trade_date") <= F.lit(final))
    return df.select("symbol", "trade_date", "open", "high", "low", "close", "volume")


def actions(spark: SparkSession, folder: str) -> DataFrame:
    df = require(_csv(spark, f"{folder}/actions/*.csv"), {"ex_date", "action_type"}, "actions")
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv$", 1)
    return df.select(
        F.url_decode(name).alias("symbol"),
        F.to_date("ex_date").alias("ex_date"),
        F.upper("action_type").alias("action_type"),
        *[number(c).alias(c) for c in ("ratio_from", "ratio_to", "amount")],
    )


#: Column names of the exchange's day file before and after its change of layout. Fixed values.
OLD_DAY = {"symbol": "SYMBOL", "series": "SERIES", "open": "OPEN", "high": "HIGH", "low": "LOW", "close": "CLOSE", "volume": "TOTTRDQTY", "value": "TOTTRDVAL", "isin": "ISIN"}
NEW_DAY = {"symbol": "TckrSymb", "series": "SctySrs", "open": "OpnPric", "high": "HghPric", "low": "LwPric", "close": "ClsPric", "volume": "TtlTradgVol", "value": "TtlTrfVal", "isin": "ISIN"}
CHANGED_ON = "2024-07-08"
TRADE_COUNT = "TtlNbOfTxsExctd"


def day_file(spark: SparkSession, path: str, day: str) -> DataFrame:
    """A day file, unzipped; its layout follows from the day (ISO). EQ and BE only; a zero open, high or low is the close.

    Rows without a symbol or a close are left out.
    """
    names = NEW_DAY if day >= CHANGED_ON else OLD_DAY
    df = require(_csv(spark, path), set(names.values()) - {"ISIN"}, "day file")
    close = number(names["close"])
    prices = {c: F.when(number(names[c]) > 0, number(names[c])).otherwise(close).alias(c) for c in ("open", "high", "low")}
    isin = F.col("ISIN") if "ISIN" in df.columns else F.lit(None).cast("string")
    count = number(TRADE_COUNT).cast("long") if TRADE_COUNT in df.columns else F.lit(None).cast("long")
    named = (F.trim(names["symbol"]) != "") & close.isNotNull()
    return df.where(F.trim(names["series"]).isin("EQ", "BE") & named).select(
        F.trim(names["symbol"]).alias("symbol"),
        F.trim(names["series"]).alias("series"),
        F.lit(day).cast("date").alias("trade_date"),
        *prices.values(),
        close.alias("close"),
        number(names["volume"]).cast("long").alias("volume"),
        number(names["value"]).alias("traded_value"),
        F.when(count > 0, count).alias("trades"),
        isin.alias("isin"),
    )


def delivery_file(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, series, delivery_quantity, delivery_pct as a share) from records of type 20 that have a percentage."""
    parts = F.transform(F.split("value", ","), lambda x: F.trim(x))
    rows = spark.read.text(path).select(parts.alias("p")).where((F.get("p", F.lit(0)) == "20") & F.get("p", F.lit(3)).isin("EQ", "BE"))
    made = rows.select(
        F.get("p", F.lit(2)).alias("symbol"),
        F.get("p", F.lit(3)).alias("series"),
        number(F.get("p", F.lit(5))).cast("long").alias("delivery_quantity"),
        (number(F.get("p", F.lit(6))) / 100).alias("delivery_pct"),
    )
    return made.where("delivery_pct is not null")


INDEX_COLUMNS = {"Index Name", "Closing Index Value", "P/E", "P/B", "Div Yield"}


def index_close_file(spark: SparkSession, path: str, day: str) -> DataFrame:
    """Closes and valuations of all indices; a P/E or P/B that isn't positive is null, a yield of 0 is kept."""
    df = require(_csv(spark, path), INDEX_COLUMNS, "index close file")

    def some(c):
        return number(c) if c in df.columns else F.lit(None).cast("double")

    ratio = {"pe": "P/E", "pb": "P/B"}
    return df.where(number("Closing Index Value").isNotNull()).select(
        F.trim(F.col("`Index Name`")).alias("index_name"),
        F.lit(day).cast("date").alias("trade_date"),
        some("Open Index Value").alias("open"),
        some("High Index Value").alias("high"),
        some("Low Index Value").alias("low"),
        number("Closing Index Value").alias("close"),
        *[F.when(number(c) > 0, number(c)).alias(k) for k, c in ratio.items()],
        F.when(number("Div Yield") >= 0, number("Div Yield")).alias("div_yield"),
    )


def constituents(spark: SparkSession, path: str, least: int = 400) -> DataFrame:
    """(symbol, name, industry, isin, series) of an index; placeholders go; a list that is too short is refused."""
    df = require(_csv(spark, path), {"Symbol", "Company Name"}, "constituent list")
    for c in ("Industry", "ISIN Code", "Series"):
        df = df if c in df.columns else df.withColumn(c, F.lit(None).cast("string"))
    rows = df.where(~F.upper("Symbol").startswith("DUMMY")).select(
        F.upper(F.trim("Symbol")).alias("symbol"), F.col("`Company Name`").alias("name"), F.col("Industry").alias("industry"), F.col("`ISIN Code`").alias("isin"), F.col("Series").alias("series")
    )
    n = rows.count()
    if n < least:
        raise SchemaDrift(f"constituent list has {n} rows, {least} expected")
    return rows
