"""What the corpus operators share: columns, checkpoints, sizes."""

from __future__ import annotations

import ctypes
import functools
import tempfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def remainder(id_col: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo divisor; a null id counts as the empty string."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % divisor


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that the cluster names in spark.checkpoint.dir; without one, one machine (tests) makes a folder, and a
    cluster is refused: its executors don't share any."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="barloom-checkpoint-"))


#: Bits of the largest size that an estimate can tell apart: Spark's own for tables of unknown size.
ESTIMATE_BITS = 63


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder; every executor can read the files again.

    A checkpoint keeps the optimizer's estimate of its size, and joins multiply those of their sides. From round to round
    the number has twice the digits or more, until it alone fills the driver, so one beyond all measure is cut, too.
    """
    ensure_checkpoint_dir(df.sparkSession)
    out = df.checkpoint()
    return unsized(out) if input_bytes(out).bit_length() > ESTIMATE_BITS else out


def unsized(df: DataFrame) -> DataFrame:
    """The same rows, partitioning and order of a checkpoint, as a table of unknown size."""
    session, plan = df.sparkSession, df._jdf.queryExecution().analyzed()
    jvm, none = session._jvm, session._jvm.scala.Option.empty()
    known = plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), plan.isStreaming(), plan.stream()
    bare = jvm.org.apache.spark.sql.execution.LogicalRDD(*known, session._jsparkSession, none, none)
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(session._jsparkSession, bare), session)


def free_name(df: DataFrame, stem: str) -> str:
    """A name that no column of df begins with, whatever its case."""
    name = f"_{stem}_"
    while any(c.lower().startswith(name) for c in df.columns):
        name += "_"
    return name


def input_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the size of df in bytes."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def spread(df: DataFrame, bytes_each: int, most: int) -> int:
    """How many buckets keep each at about bytes_each of input, at least one for each shuffle partition and at most `most`:
    where the size isn't known, the estimate is beyond all measure."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(most, -(-input_bytes(df) // bytes_each)))


#: Most texts that go to a Python worker at once: the default of 10,000 is 30 MB of usual texts, and any amount of long ones.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
MOST_TEXTS = 500


def small_batches(df: DataFrame) -> DataFrame:
    """df, with the session's Arrow batches held to MOST_TEXTS rows (a smaller setting stays)."""
    conf = df.sparkSession.conf
    now = int(conf.get(BATCH))
    if not 0 < now <= MOST_TEXTS:
        conf.set(BATCH, str(MOST_TEXTS))
    return df


#: What this worker process keeps between tasks, a store for each operator; at most one is filled.
STORES: list[dict] = []


def store() -> dict:
    """A store for what an operator keeps between tasks."""
    STORES.append({})
    return STORES[-1]


def alone(mine: dict) -> dict:
    """The store, with all others emptied: workers stay for the stages of other operators and would hold what each keeps."""
    for other in STORES:
        if other is not mine:
            other.clear()
    return mine


def kept(mine: dict, what: str, digest: str, make: Callable):
    """What was made for this digest the last time, or a new one in its place."""
    if what not in mine or mine[what][0] != digest:
        alone(mine)[what] = (digest, make())
    return mine[what][1]


def release() -> None:
    """Give memory back that a Python worker has freed but holds: the worker stays for other tasks and stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def releasing(run: Callable) -> Callable:
    """A function over batches that releases memory at its end."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped
