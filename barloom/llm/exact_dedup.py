"""Exact deduplication by a tree-merge of sorted digest runs, in DataFrame operations only.

Each partition of the input is a run: one record for each digest in it, with the identifier that stays and the number of
rows. In each round fan_in neighbouring runs meet and are merged, run number r going to r / fan_in, so the number of
rounds is the logarithm of the number of partitions. Spark aggregates structs by sorting, so a round is a multiway merge
of sorted runs, and the records of a digest are verified by the text's length and a second hash. After the last round
one record for each digest is left. The outcome then travels down the same tree, so that no task ever meets all the rows
of a large group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import checkpoint, free_name, lower_ascii

KEY = ["digest", "n_bytes", "check"]


def digests(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, rid (unique row number), run and the key of the normalised text: SHA-256, its length and XXH64 to verify it."""
    text = lower_ascii(F.coalesce(F.col(text_col), F.lit("")))
    return df.select(F.col(id_col).alias("id"), text.alias("text")).select(
        "id",
        F.monotonically_increasing_id().alias("rid"),
        F.spark_partition_id().alias("run"),
        F.unhex(F.sha2("text", 256)).alias("digest"),
        F.octet_length("text").alias("n_bytes"),
        F.xxhash64("text").alias("check"),
    )


def tree_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", fan_in: int = 8) -> DataFrame:
    """One row for each row of df: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. Of equal texts the row with the smallest (keep="min") or the
    largest (keep="max") identifier stays. fan_in runs are merged at a time, until one is left.

    Null text counts as empty. A null identifier stays only if its group has no other. Of rows with the same text and
    identifier one stays. An empty table gives an empty result; other columns of df are not looked at.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep must be 'min' or 'max'")
    rows = checkpoint(digests(df, id_col, text_col))
    if keep == "min":
        best, mark = F.min, F.struct(F.col("id").isNull().alias("rank"), "id", "rid")
    else:
        best, mark = F.max, F.struct(F.col("id").isNotNull().alias("rank"), "id", "rid")
    level = rows.withColumn("mark", mark).groupBy("run", *KEY).agg(best("mark").alias("mark"), F.count("*").alias("n"))
    levels = [level]
    runs = rows.rdd.getNumPartitions()
    while runs > 1:
        runs = -(-runs // fan_in)
        merged = level.withColumn("run", F.floor(F.col("run") / fan_in))
        level = merged.groupBy("run", *KEY).agg(best("mark").alias("mark"), F.sum("n").alias("n"))
        levels.append(level)
    known = levels.pop()
    while levels:
        below = levels.pop().select("run", F.floor(F.col("run") / fan_in).alias("above"), *KEY)
        known = below.join(known.withColumnRenamed("run", "above"), ["above", *KEY]).select("run", *KEY, "mark", "n")
    return rows.join(known, ["run", *KEY]).select(
        F.col("id").alias(id_col),
        F.col("mark.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("rid") == F.col("mark.rid")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The rows of df that stay, with all their columns.

    Of rows that agree in identifier and text one stays: the first in order of all columns as JSON.
    """
    made = tree_dedup(df, id_col, text_col, keep).select(F.col(id_col).alias("id"), "keep_id", F.col("text_sha256").alias("sha"))
    plan = checkpoint(made)
    name = free_name(df, "copy")
    own_id, own_sha = F.col(f"{name}id"), F.col(f"{name}sha")
    same = F.col(id_col).eqNullSafe(own_id) & (F.sha2(lower_ascii(F.coalesce(F.col(text_col), F.lit(""))), 256) == own_sha)
    named = [F.col("id").alias(f"{name}id"), F.col("sha").alias(f"{name}sha")]
    stays = F.col("id").eqNullSafe(F.col("keep_id"))
    left = df.join(plan.where(~stays).select(*named), same, "left_anti")
    again = checkpoint(plan.where(stays).groupBy("id", "sha").count().where("count > 1").select(*named))
    if again.isEmpty():
        return left
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    tied = left.join(again, same).groupBy(own_id, own_sha).agg(F.min_by(whole, F.to_json(whole)).alias("row"))
    return left.join(again, same, "left_anti").union(tied.select(*[F.col("row").getField(c).alias(c) for c in df.columns]))
