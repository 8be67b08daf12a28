"""BPE encoding through a table of distinct words, and decoding through an id-to-piece join.

Words (runs of anything but ASCII white space; the tokenizer's own pre-tokens never cross white space) are split and
made distinct by block, dealt to buckets by hash and encoded there, each distinct word once. The ids come back to the
blocks and are joined by position. Each distinct word's ids are joined with the vocabulary's pieces for decoding.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import blocks
from barloom.llm.common import kept, spread, store

RESULT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_tokens", pa.int64()),
        ("ids", pa.binary()),
        ("decoded", pa.binary()),
        ("ids_sha256", pa.string()),
        ("decoded_sha256", pa.string()),
    ]
)


#: What this worker process keeps between tasks: the last tokenizer and its pieces, by its file's text.
LIVE: dict[str, tuple[str, object]] = store()


def tokenizer(spec: str):
    return kept(LIVE, "tokenizer", spec, lambda: _tokenizer(spec))


def _tokenizer(spec: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_str(spec)
    loaded.no_truncation()
    loaded.no_padding()
    return loaded


def load(path: str) -> str:
    """A tokenizer's file as text (a few MB, whatever the corpus); read on the driver, sent with the tasks."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def pieces(spec: str) -> np.ndarray:
    """Piece by id, as UTF-8; ids without a piece have the empty string."""
    return kept(LIVE, "pieces", spec, lambda: _pieces(spec))


def _pieces(spec: str) -> np.ndarray:
    read = json.loads(spec)
    by_id = {i: p for p, i in read["model"]["vocab"].items()} | {t["id"]: t["content"] for t in read["added_tokens"]}
    table = np.full(max(by_id) + 1, b"", dtype=object)
    for i, p in by_id.items():
        table[i] = p.encode()
    return table


def encode_words(spec: str, words: list[bytes], at_once: int = 1000) -> list[np.ndarray]:
    """Ids of each word; a few at a time, since the library's results are large."""
    known, found = tokenizer(spec), []
    for k in range(0, len(words), at_once):
        part = known.encode_batch_fast([w.decode() for w in words[k : k + at_once]], add_special_tokens=False)
        found.extend([np.array(e.ids, dtype="<u4") for e in part])
    return found


#: Ids that a bucket keeps of words that it has encoded: 64 MB or so; beyond, it begins anew.
KEPT_IDS = 4 << 20


def replies(spec: str):
    """A function that answers a list with its mark, its words' lengths and ids; each distinct word is encoded once."""
    ids: dict[bytes, np.ndarray] = {}
    size = 0

    def reply(data: bytes) -> bytes:
        nonlocal size
        words = blocks.swell(data).split(b"\n")
        if size > KEPT_IDS:
            ids.clear()
            size = 0
        new = [w for w in words if w not in ids]
        made = encode_words(spec, new)
        ids.update(zip(new, made))
        size += sum(len(x) + 8 for x in made)
        found = [ids[w] for w in words]
        sizes = np.array([len(x) for x in found], dtype="<u4")
        return blocks.squeeze(blocks.mark(words) + sizes.tobytes() + np.concatenate(found).astype("<u4").tobytes())

    return reply


def joined(spec: str, docs: blocks.Docs, told: dict[int, bytes], buckets: int, keep: tuple[str, ...]) -> pa.Table:
    """Ids by position, and their pieces, for each document of a block."""
    names, bodies = docs
    table = pieces(spec)
    ids: dict[bytes, bytes] = {}
    spoken: dict[bytes, bytes] = {}
    for k, words in enumerate(blocks.word_lists(blocks.distinct_words(bodies), buckets)):
        if not words:
            continue
        data = blocks.swell(told[k]) if k in told else b""
        if data[:8] == blocks.mark(words):
            sizes = np.frombuffer(data, "<u4", len(words), 8)
            flat = np.frombuffer(data, "<u4", offset=8 + 4 * len(words))
        else:  # the input was dealt otherwise when it was read again: encode this list here
            found = encode_words(spec, words)
            sizes, flat = np.array([len(x) for x in found]), np.concatenate(found)
        ends = np.cumsum(sizes).tolist()
        raw, said = flat.astype("<u4").tobytes(), table[flat].tolist()
        at = 0
        for w, end in zip(words, ends):
            ids[w] = raw[4 * at : 4 * end]
            spoken[w] = b"".join([b" " + p for p in said[at:end]])
            at = end
    rows: dict[str, list] = {name: [] for name in RESULT.names}
    for name, body in zip(names, bodies):
        words = body.split()
        coded = b"".join([ids[w] for w in words])
        decoded = b"".join([spoken[w] for w in words])[1:]
        rows["doc_id"].append(name)
        rows["n_tokens"].append(len(coded) // 4)
        rows["ids"].append(coded if "ids" in keep else None)
        rows["decoded"].append(decoded if "decoded" in keep else None)
        rows["ids_sha256"].append(hashlib.sha256(coded).hexdigest())
        rows["decoded_sha256"].append(hashlib.sha256(decoded).hexdigest())
    return pa.Table.from_pydict(rows, RESULT)


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """One row for each row of df: id_col, n_tokens, ids, decoded, ids_sha256, decoded_sha256.

    ids has the ids as little-endian unsigned 32-bit integers, decoded the decoded text; each null unless named in keep. Ids are
    those of the tokenizers library for the file at path with add_special_tokens=False; special tokens in a text are
    recognised as it does. Decoding joins the pieces by a space, as the library does for files without a decoder; files
    with one, and files whose pre-tokens can cross white space, are refused.

    Null text counts as empty: no ids, decoded to the empty string. Identifiers are integers and may be null or repeat.
    """
    spec = load(path)
    _check(spec)
    rows = blocks.columns(df, id_col, text_col)
    buckets = spread(df, 4 << 20, blocks.MOST_BUCKETS)
    asked = blocks.ask(rows, blocks.word_keys(buckets))
    told = blocks.answer(asked, lambda: replies(spec))
    out = blocks.meet(
        blocks.blocks(rows),
        told,
        lambda docs, answers: joined(spec, docs, answers, buckets, keep),
        "doc_id long, n_tokens long, ids binary, decoded binary, ids_sha256 string, decoded_sha256 string",
    )
    return out.withColumnRenamed("doc_id", id_col)


def _check(spec: str) -> None:
    read = json.loads(spec)
    if read.get("decoder") is not None:
        raise ValueError("a tokenizer with a decoder can't be decoded by joining pieces")
    if any(t["lstrip"] or t["rstrip"] for t in read["added_tokens"]):
        raise ValueError("added tokens that take white space can't be encoded by word")
    split = [p for p in (read.get("pre_tokenizer") or {}).get("pretokenizers", []) if p.get("type") == "Split"]
    if not (split and split[0]["behavior"] == "Removed" and split[0]["invert"]):
        raise ValueError("pre-tokens could cross white space")


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col and text: the pieces of an array of ids, joined by a space.

    The vocabulary (a few MB, whatever the corpus) is the small side of an id-to-piece join made within each batch of
    rows. Null and empty arrays give the empty string; a null id, or one without a piece, raises.
    """
    spec = load(path)
    _check(spec)

    def run(batches):
        table = pa.array([p.decode() for p in pieces(spec)], pa.string())
        for batch in batches:
            ids = batch.column("ids")
            said = pa.ListArray.from_arrays(ids.offsets, table.take(ids.values))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.compute.binary_join(said, " ")], ["id", "text"])

    import pyarrow.compute  # noqa: F401

    kind = dict(df.dtypes)[id_col]
    rows = df.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(ids_col).cast("array<int>"), F.array().cast("array<int>")).alias("ids")
    )
    return rows.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
