"""An extension: bars that arrive as files are merged in micro-batches, and their sessions written again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.store import replace_partitions

BAR = "token long, symbol string, trade_date date, open double, high double, low double, close double, volume long"


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def merge_batch(batch: DataFrame, table: str) -> None:
    """Put a batch's bars into the table of sessions: of a symbol's several bars of a session the last written counts.

    Only the partitions of the batch's sessions are read and written again.
    """
    spark = batch.sparkSession
    last = batch.groupBy("token", "trade_date").agg(F.max_by(F.struct(*batch.columns), F.col("read_at")).alias("r")).select("r.*").drop("read_at")
    days = [r[0] for r in last.select("trade_date").distinct().collect()]  # the sessions of one batch
    if not days:
        return
    whole = last
    if _exists(spark, table):
        old = spark.read.parquet(table).where(F.col("trade_date").isin(days))
        kept = old.join(last.select("token", "trade_date"), ["token", "trade_date"], "left_anti")
        whole = last.unionByName(kept.select(*last.columns))
    replace_partitions(whole, table)


def start(spark: SparkSession, folder: str, table: str, progress: str):
    """Take all files of folder that haven't been read yet, then stop; progress is the stream's own checkpoint folder."""
    bars = spark.readStream.schema(BAR).parquet(folder).withColumn("read_at", F.current_timestamp())
    return (
        bars.writeStream.foreachBatch(lambda batch, _: merge_batch(batch, table))
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )
