"""Blocks: documents packed in bounded pieces, and the exchange of a block's distinct keys with a table dealt by key.

Operators that look up every word of every document (in a word table, an n-gram table) can send either one row for each
word occurrence or, as here, one row for each (block, bucket): a block of documents lists each distinct key once, the
keys are dealt to buckets by hash, a bucket answers each list in the list's own order, and the answers meet the block
again. No row stands for more than a block's keys, so frequent words and copied documents make no hot task.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import release, releasing, small_batches

#: Most bytes of text, and most documents, in a block; a single longer text is a block of its own.
BLOCK_BYTES = 6 << 20
BLOCK_DOCS = 1 << 16

#: Most buckets that lists are dealt to where a bucket answers them one by one: from there on rows grow with the input.
MOST_BUCKETS = 4096

Docs = tuple[list, list]  # identifiers (integers or None) and texts as UTF-8


def columns(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return small_batches(df).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))


def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, Docs]]:
    """The blocks of a partition, with their numbers."""
    first = TaskContext.get().partitionId() << 24
    ids: list = []
    texts: list = []
    size = 0
    for batch in batches:
        for i, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
            if ids and (size + len(t) > BLOCK_BYTES or len(ids) >= BLOCK_DOCS):
                yield first, (ids, texts)
                first, ids, texts, size = first + 1, [], [], 0
            ids.append(i)
            texts.append(t)
            size += len(t)
    if ids:
        yield first, (ids, texts)


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def swell(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack_docs(docs: Docs) -> bytes:
    ids, texts = docs
    known = np.array([i is not None for i in ids], dtype=np.uint8)
    numbers = np.array([i or 0 for i in ids], dtype="<i8")
    sizes = np.array([len(t) for t in texts], dtype="<u4")
    return squeeze(struct.pack("<I", len(ids)) + known.tobytes() + numbers.tobytes() + sizes.tobytes() + b"".join(texts))


def unpack_docs(data: bytes) -> Docs:
    data = swell(data)
    n = struct.unpack_from("<I", data)[0]
    known = np.frombuffer(data, np.uint8, n, 4)
    numbers = np.frombuffer(data, "<i8", n, 4 + n)
    sizes = np.frombuffer(data, "<u4", n, 4 + 9 * n)
    at, texts = 4 + 13 * n, []
    for s in sizes.tolist():
        texts.append(data[at : at + s])
        at += s
    return [i if k else None for i, k in zip(numbers.tolist(), known.tolist())], texts


BLOCK = pa.schema([("block", pa.int64()), ("docs", pa.binary()), ("bytes", pa.int64())])
ASK = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("keys", pa.binary())])
ANSWER = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("answers", pa.binary())])


def blocks(df: DataFrame) -> DataFrame:
    """(block, docs, bytes) of a table made by columns(); bytes is the size of the texts."""

    def run(batches):
        for number, docs in cut(batches):
            yield pa.RecordBatch.from_pydict({"block": [number], "docs": [pack_docs(docs)], "bytes": [sum(map(len, docs[1]))]}, BLOCK)

    return df.mapInArrow(releasing(run), "block long, docs binary, bytes long")


def ask(df: DataFrame, keys: Callable[[Docs], list[bytes]]) -> DataFrame:
    """(block, bucket, keys): for each block its lists of keys by bucket, as the function keys writes them."""

    def run(batches):
        for number, docs in cut(batches):
            lists = keys(docs)
            used = [k for k, x in enumerate(lists) if x]
            yield pa.RecordBatch.from_pydict(
                {"block": [number] * len(used), "bucket": used, "keys": [lists[k] for k in used]}, ASK
            )

    return df.mapInArrow(releasing(run), "block long, bucket int, keys binary")


def answer(asked: DataFrame, begin: Callable[[], Callable[[bytes], bytes]]) -> DataFrame:
    """(block, bucket, answers): begin() makes a function for a bucket, which answers each of its lists in turn.

    Lists come and go one by one, in order of bucket, so a bucket may be of any size.
    """

    def run(batches):
        bucket, reply = None, None
        for batch in batches:
            told = []
            for b, keys in zip(batch.column("bucket").to_pylist(), batch.column("keys").to_pylist()):
                if b != bucket:
                    bucket, reply = b, begin()
                told.append(reply(keys))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("bucket"), pa.array(told, pa.binary())], schema=ANSWER)

    dealt = asked.repartition("bucket").sortWithinPartitions("bucket", "block")
    return dealt.mapInArrow(releasing(run), "block long, bucket int, answers binary")


def answer_together(asked: DataFrame, reply: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """(block, bucket, answers): reply gets all lists of a bucket, as many as spread() deals it, and answers each."""

    def run(group: pa.Table) -> pa.Table:
        return pa.table([group["block"], group["bucket"], pa.array(reply(group["keys"].to_pylist()), pa.binary())], schema=ANSWER)

    return asked.groupBy("bucket").applyInArrow(run, "block long, bucket int, answers binary")


def meet(packed: DataFrame, answers: DataFrame, use: Callable[[Docs, dict[int, bytes]], pa.Table], schema: str) -> DataFrame:
    """The rows that use makes of each block's documents and the answers to its lists by bucket.

    A block that isn't there any more, since the input came in another order when it was read again, has no rows.
    """
    empty = schema_of(schema).empty_table()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        told = dict(zip(right["bucket"].to_pylist(), right["answers"].to_pylist()))
        try:
            return use(unpack_docs(left["docs"][0].as_py()), told) if left.num_rows else empty
        finally:
            release()

    return packed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


#: Types of the columns that blocks return.
TYPES = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}


def schema_of(text: str) -> pa.Schema:
    return pa.schema([(name, TYPES[kind]) for name, kind in (c.split() for c in text.split(", "))])


# Lists of words: the distinct words of a block, dealt by hash, in the order of their first occurrence.


def word_lists(words: Iterable[bytes], buckets: int) -> list[list[bytes]]:
    lists: list[list[bytes]] = [[] for _ in range(buckets)]
    for w in words:
        lists[zlib.crc32(w) % buckets].append(w)
    return lists


def distinct_words(texts: Iterable[bytes]) -> dict[bytes, None]:
    """The words of the texts: bytes.split() cuts at ASCII white space only."""
    seen: dict[bytes, None] = {}
    for t in texts:
        seen.update(dict.fromkeys(t.split()))
    return seen


def word_keys(buckets: int) -> Callable[[Docs], list[bytes]]:
    def keys(docs: Docs) -> list[bytes]:
        return [squeeze(b"\n".join(x)) if x else b"" for x in word_lists(distinct_words(docs[1]), buckets)]

    return keys


def mark(words: list[bytes]) -> bytes:
    """What a list's answer begins with; tells a block whether the answer is to the list that it has now."""
    return struct.pack("<II", len(words), zlib.crc32(b"\n".join(words)))
