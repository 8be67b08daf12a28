"""Quality classifier by compression.

Two zstandard dictionaries are built, from good and from bad labelled texts. A text compresses better with the dictionary
of its own kind; the difference of its two compressed sizes, normalised by its plain compressed size and by its length,
is turned into a probability by a logistic regression. For that, labelled texts are measured with dictionaries that were
built without them.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import labelled
from barloom.llm.common import releasing, remainder, small_batches

LEVEL = 3


def dictionary(texts: list[bytes], size: int) -> bytes:
    """A zstandard dictionary; texts too few to train one are its content as they are."""
    try:
        return zstandard.train_dictionary(size, texts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[-size:]


@functools.lru_cache(maxsize=16)
def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    if not content:
        return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
    kind = zstandard.DICT_TYPE_AUTO
    known = zstandard.ZstdCompressionDict(content, dict_type=kind)
    known.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_dict_id=False)


def measures(texts: list[bytes], good: bytes, bad: bytes) -> np.ndarray:
    """For each text: normalised differences of the compressed sizes, its plain ratio and its length, as features."""
    sizes = np.array(
        [[len(t), *(len(_compressor(c).compress(t)) for c in (good, bad, b""))] for t in texts], dtype=np.float64
    ).reshape(-1, 4)
    n, g, b, plain = sizes.T
    by_plain, by_length = (b - g) / np.maximum(plain, 1), (b - g) / np.maximum(n, 1)
    ratio = np.log(np.maximum(plain, 1) / np.maximum(n, 1))
    x = np.stack([by_plain, by_length, ratio, np.log1p(n)], axis=1)
    x = np.stack([np.clip(x[:, 0], -1, 1), np.clip(x[:, 1], -0.5, 0.5) * 4, np.clip(ratio, -5, 1), x[:, 3] / 8], axis=1)
    both = [x[:, i] * x[:, j] for i in range(4) for j in range(i, 4)]
    return np.hstack([x, np.stack(both, axis=1)])


class Model:
    """Dictionaries and weights; a few hundred KB, whatever the corpus."""

    def __init__(self, good: bytes, bad: bytes, weights: np.ndarray):
        self.good, self.bad, self.weights = good, bad, weights

    def score(self, texts: list[bytes]) -> np.ndarray:
        return labelled.chance(measures(texts, self.good, self.bad), self.weights)


def fit(texts: list[bytes], y: np.ndarray, size: int = 112_640, folds: int = 3) -> Model:
    """Fit on the driver. Without texts of either class the score is the smoothed share of the class."""
    place = np.arange(len(texts)) % folds
    y = np.asarray(y, dtype=np.float64)

    def two(use: np.ndarray) -> tuple[bytes, bytes]:
        return tuple(dictionary([t for t, u, k in zip(texts, use, y) if u and k == kind], size) for kind in (1, 0))

    if not (y == 1).any() or not (y == 0).any():
        share = ((y == 1).sum() + 1) / (len(y) + 2)
        return Model(b"", b"", np.array([np.log(share / (1 - share))] + [0.0] * 14))
    x = np.zeros((len(texts), 14))
    for k in range(folds):
        out = np.flatnonzero(place == k)
        if len(out):
            x[out] = measures([texts[i] for i in out], *two(place != k))
    return Model(*two(place >= 0), labelled.fit_logistic(x, y, penalty=0.1))


def train(
    df: DataFrame,
    labels: DataFrame,
    id_col: str,
    text_col: str,
    label_col: str,
    divisor: int,
    held: int,
    most: int = 4000,
    most_bytes: int = 24 << 20,
    most_text: int = 1 << 18,
) -> Model:
    """Fit on a bounded sample: at most `most` labelled texts and most_bytes of each class, none over most_text bytes.

    The classes are sampled apart; the regression's constant is corrected for their true shares.
    """
    spark = df.sparkSession
    chosen = labelled.sample(labels, id_col, label_col, divisor, held, most, by_class=True)
    wanted = spark.createDataFrame(chosen, "_id long, y int")  # at most 2 * most rows of 12 bytes
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    found = df.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).join(F.broadcast(wanted), F.col("id") == F.col("_id"))
    found = found.withColumn("n", F.octet_length("text")).where(F.col("n") <= most_text)
    ids: set[int] = set()
    used = {0: 0, 1: 0}
    for r in sorted(found.select("id", "y", "n").dropDuplicates(["id"]).collect(), key=lambda r: (r["id"] * 2654435761) % 2**32):
        if used[r["y"]] + r["n"] <= most_bytes:
            used[r["y"]] += r["n"]
            ids.add(r["id"])
    kept = spark.createDataFrame([(i,) for i in ids], "_kept long")
    rows = found.join(F.broadcast(kept), F.col("id") == F.col("_kept")).select("id", "y", "text").collect()
    rows = sorted({r["id"]: r for r in rows}.values(), key=lambda r: (r["id"] * 2654435761) % 2**32)
    y = np.array([r["y"] for r in rows])
    model = fit([bytes(r["text"]) for r in rows], y)
    is_good = F.sum(F.when(F.col(label_col) == 1, 1).otherwise(0)).alias("good")
    valid = labels.where(F.col(label_col).isNotNull() & (remainder(F.col(id_col), divisor) != held))
    whole = valid.agg(F.count("*").alias("n"), is_good).first()
    if (y == 1).any() and (y == 0).any() and 0 < (whole["good"] or 0) < whole["n"]:
        here = np.log((y == 1).sum() / (y == 0).sum())
        model.weights[0] += np.log(whole["good"] / (whole["n"] - whole["good"])) - here
    return model


def classify(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    divisor: int = 5,
    held: int = 0,
    limit: float = 0.3,
) -> DataFrame:
    """One row for each row of df: id_col, held_out, score, predicted.

    score is the probability of label 1; predicted is 1 from `limit` on. Rows whose crc32 of the identifier as text,
    modulo divisor, is `held` are held out: their labels aren't looked at. Null text counts as empty and is scored.
    Identifiers may be null or repeat. Whole texts are compressed, however long.
    """
    kind = dict(df.dtypes)[id_col]
    model = train(df, labels, id_col, text_col, label_col, divisor, held)
    rows = small_batches(df).select(
        F.col(id_col).alias("id"),
        (remainder(F.col(id_col), divisor) == held).alias("held_out"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"),
    )

    def run(batches):
        for batch in batches:
            score = model.score(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("held_out"),
                    pa.array(score, pa.float64()),
                    pa.array((score >= limit).astype(np.int32)),
                ],
                ["id", "held_out", "score", "predicted"],
            )

    out = rows.mapInArrow(releasing(run), f"id {kind}, held_out boolean, score double, predicted int")
    return out.withColumnRenamed("id", id_col)
