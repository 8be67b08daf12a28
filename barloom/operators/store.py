"""Idempotent writes over immutable tables: merges as joins, SCD-2 as interval bookkeeping, partitions replaced whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_known: list[str] = ()) -> DataFrame:
    """old with new's rows in place of those with their keys; in keep_known columns a null of new's keeps what is known.

    new must have one row for each key.
    """
    a, b = old.alias("a"), new.withColumn("_new", F.lit(True)).alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]

    def pick(c: str):
        was, now = F.col(f"a.{c}"), F.col(f"b.{c}") if c in new.columns else F.lit(None)
        if c in keys or c in keep_known:
            return F.coalesce(now, was).alias(c)
        return F.when(F.col("b._new"), now).otherwise(was).alias(c)

    return a.join(b, on, "full").select(*[pick(c) for c in old.columns])


def upsert_instruments(old: DataFrame, seen: DataFrame, day) -> DataFrame:
    """old (token, symbol, ..., is_active, first_seen, last_seen) after `seen` was listed on day.

    A listed instrument takes the new symbol, keeps what is known where the list says nothing, and is active again; a new
    one was first seen on day; the rest stay as they are. seen must have one row for each token.
    """
    on = F.lit(day).cast("date")
    marks = {"is_active": F.lit(True), "last_seen": on, "first_seen": on}
    given = seen.withColumns({c: v for c, v in marks.items() if c in old.columns})
    kept = [c for c in old.columns if c not in ("token", "symbol", *marks)]
    first = old.select("token", F.col("first_seen").alias("_first"))
    merged = upsert(old, given, ["token"], kept).join(first, "token", "left")
    return merged.withColumn("first_seen", F.coalesce("_first", "first_seen")).select(*old.columns)


def replace_keys(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old without any row of the keys that new has, and new."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new.select(*old.columns))


def sync_members(members: DataFrame, current: DataFrame, on_date) -> DataFrame:
    """SCD-2: members (index_name, token, valid_from, valid_to) after `current` (index_name, token) was seen on on_date.

    Open rows that are gone are closed on on_date; new ones open then; a key that was opened on on_date isn't again.
    """
    day = F.lit(on_date).cast("date")
    keys = ["index_name", "token"]
    seen = current.select(*keys).distinct().withColumn("_in", F.lit(True))
    touched = current.select("index_name").distinct().withColumn("_touched", F.lit(True))
    marked = members.join(seen, keys, "left").join(touched, "index_name", "left")
    gone = F.col("valid_to").isNull() & F.col("_in").isNull() & F.col("_touched").isNotNull()
    kept = marked.withColumn("valid_to", F.when(gone, day).otherwise(F.col("valid_to"))).select(*members.columns)
    known = members.where(F.col("valid_to").isNull() | (F.col("valid_from") == day)).select(*keys)
    added = seen.join(known, keys, "left_anti").select(*keys, day.alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    return kept.unionByName(added.select(*members.columns))


def changes(members: DataFrame, current: DataFrame) -> DataFrame:
    """(index_name, token, change): what a sync would add and remove."""
    keys = ["index_name", "token"]
    open_ = members.where("valid_to is null").select(*keys)
    return (
        current.select(*keys).exceptAll(open_).withColumn("change", F.lit("added"))
        .union(open_.exceptAll(current.select(*keys)).withColumn("change", F.lit("removed")))
    )


def current_members(members: DataFrame, index_name: str) -> DataFrame:
    return members.where((F.col("index_name") == index_name) & F.col("valid_to").isNull()).select("token")


def replace_partitions(df: DataFrame, path: str, by: str = "trade_date") -> None:
    """Write df over the partitions that it has rows of, and no other; a rerun leaves the same files' worth of rows."""
    df.repartition(by).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(by).parquet(path)


def deterministic_sample(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The n rows whose keys hash lowest."""
    return df.orderBy(F.xxhash64(*keys), *keys).limit(n)


def latest_bars(bars: DataFrame, n: int) -> DataFrame:
    """The last n bars of each symbol."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("token").orderBy(F.desc("trade_date")))
    return bars.withColumn("_p", place).where(F.col("_p") <= n).drop("_p")


def chart(bars: DataFrame) -> DataFrame:
    """Adjusted candles: prices times the factor, volumes through it, rounded half to even."""
    f = F.col("adj_factor")
    return bars.select(
        "token", "trade_date", *[(F.col(c) * f).alias(c) for c in ("open", "high", "low", "close")], F.bround(F.col("volume") / f).cast("long").alias("volume")
    )
