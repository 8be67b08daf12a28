"""Language-model scoring with a weighted backoff automaton.

States are the root and one state for each history: the start of a text, or a word that another token followed in
training. The arc of token w from history h has the smoothed weight (c(h, w) + T(h) P(w)) / (c(h) + T(h)), T(h) being how
many kinds of tokens followed h (Witten and Bell); where h has no arc for w, its failure arc of weight T(h) / (c(h) + T(h))
leads to the root, whose arcs have P(w) = (c(w) + 1) / (N + V + 1). The weights of each state sum to one. One pass over a
text from left to right carries the state and adds up log-probabilities.

The counts of words and of pairs of words never meet in one place: blocks of documents exchange their distinct words and
pairs with buckets that hold the counts (barloom.llm.blocks). Pairs are dealt by their history, so a bucket knows c(h) and
T(h), and a block gets the arcs of its own texts, exactly.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import blocks
from barloom.llm.common import checkpoint, releasing

START = np.uint64(0x9E3779B97F4A7C15)
#: After one history tokens are told apart by so many bits of their hash.
NEXT = np.uint64((1 << 48) - 1)
#: Packed text for which there is one bucket.
BUCKET_BYTES = 2 << 20


def pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """64-bit keys of (history, token) from their hashes; multiplication wraps."""
    x = (before * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (word + np.uint64(0x165667B19E3779F9))
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Tokens:
    """The tokens of a block (each text's words and one end), and its distinct words, histories and pairs, sorted by hash."""

    def __init__(self, docs: blocks.Docs, train: list[bool]):
        number: dict[bytes, int] = {b"": 0}  # the end
        parts, sizes = [], []
        for t in docs[1]:
            words = t.lower().split()
            for w in words:
                if w not in number:
                    number[w] = len(number)
            words.append(b"")
            parts.append(np.array([number[w] for w in words], dtype=np.int64))
            sizes.append(len(words))
        self.sizes = np.array(sizes, dtype=np.int64)
        self.train = np.repeat(np.array(train, dtype=bool), self.sizes)
        hashes = np.array([xxhash.xxh64_intdigest(w, 7) for w in number], dtype=np.uint64)
        self.words, by_number = np.unique(hashes, return_inverse=True)
        self.word_at = by_number[np.concatenate(parts)]
        before = np.roll(self.words[self.word_at], 1)
        before[np.cumsum(self.sizes) - self.sizes] = START
        self.histories, self.history_at = np.unique(before, return_inverse=True)
        pairs, self.pair_at = np.unique(self.history_at * len(self.words) + self.word_at, return_inverse=True)
        self.pair_history, self.pair_word = np.divmod(pairs, len(self.words))

    def seen(self, at: np.ndarray, n: int) -> np.ndarray:
        """How often each of n kinds is met in training."""
        return np.bincount(at[self.train], minlength=n)


def planes(values: np.ndarray, width: int = 8) -> bytes:
    """Integers by byte planes: those of high bytes are mostly zeros."""
    raw = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)
    return np.ascontiguousarray(raw[:, :width].T).tobytes()


class Reader:
    """Reads what planes() wrote, one array after the other."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def sizes(self, form: str) -> tuple[int, ...]:
        got = struct.unpack_from(form, self.data, self.at)
        self.at += struct.calcsize(form)
        return got

    def planes(self, n: int, width: int = 8) -> np.ndarray:
        raw = np.zeros((n, 8), np.uint8)
        raw[:, :width] = np.frombuffer(self.data, np.uint8, n * width, self.at).reshape(width, n).T
        self.at += n * width
        return raw.view("<u8").reshape(n).astype(np.uint64)


def bounds(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's share of the sorted keys begins: buckets are equal ranges of hashes."""
    edges = np.array([(k << 64) // buckets for k in range(1, buckets)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


class Lists:
    """A block's lists by bucket: words, histories, and the pairs of those histories."""

    def __init__(self, tokens: Tokens, buckets: int):
        self.t = tokens
        self.words, self.histories = bounds(tokens.words, buckets), bounds(tokens.histories, buckets)
        self.pairs = np.searchsorted(tokens.pair_history, self.histories)

    def cuts(self, k: int) -> tuple[slice, slice, slice]:
        return tuple(slice(b[k], b[k + 1]) for b in (self.words, self.histories, self.pairs))

    def keys(self, k: int) -> bytes:
        """What list k asks for: its words, its histories, how many pairs each has, and the pairs' tokens."""
        w, h, p = self.cuts(k)
        words, histories = self.t.words[w], self.t.histories[h]
        each = np.bincount(self.t.pair_history[p] - self.histories[k], minlength=len(histories))
        following = self.t.words[self.t.pair_word[p]] & NEXT
        steps = [planes(np.diff(x, prepend=np.uint64(0))) for x in (words, histories)]
        return struct.pack("<III", len(words), len(histories), len(following)) + steps[0] + steps[1] + planes(each, 4) + planes(following, 6)


def ask_counts(tokens: Tokens, buckets: int) -> list[bytes]:
    """Each list's keys, and how often each word and pair is met in training."""
    lists = Lists(tokens, buckets)
    n_word, n_pair = tokens.seen(tokens.word_at, len(tokens.words)), tokens.seen(tokens.pair_at, len(tokens.pair_word))
    out = []
    for k in range(buckets):
        w, h, p = lists.cuts(k)
        empty = w.stop == w.start and h.stop == h.start
        out.append(b"" if empty else blocks.squeeze(lists.keys(k) + planes(n_word[w]) + planes(n_pair[p])))
    return out


def total(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, their summed counts and where each is first."""
    kinds, first, place = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    sums = np.zeros(len(kinds), np.int64)
    np.add.at(sums, place, np.concatenate(counts).astype(np.int64))
    return kinds, sums, first


def sum_counts(lists: list[bytes]) -> list[bytes]:
    """A bucket's answers to all its lists: each word's c(w), each history's c(h) and T(h), each pair's c(h, w)."""
    words, histories, pairs, word_n, pair_n, owners, marks = [], [], [], [], [], [], []
    for data in lists:
        r = Reader(blocks.swell(data))
        a, b, c = r.sizes("<III")
        words.append(np.cumsum(r.planes(a), dtype=np.uint64))
        histories.append(np.cumsum(r.planes(b), dtype=np.uint64))
        owner = np.repeat(histories[-1], r.planes(b, 4).astype(np.int64))
        pairs.append(pair_keys(owner, r.planes(c, 6)))
        owners.append(owner)
        marks.append(struct.pack("<IIII", a, b, c, zlib.crc32(r.data[: r.at])))
        word_n.append(r.planes(a))
        pair_n.append(r.planes(c))
    w_keys, w_sum, _ = total(words, word_n)
    p_keys, p_sum, p_first = total(pairs, pair_n)
    known = np.unique(np.concatenate(histories))
    of = np.searchsorted(known, np.concatenate(owners)[p_first])
    met, kinds = np.zeros(len(known), np.int64), np.zeros(len(known), np.int64)
    np.add.at(met, of, p_sum)
    np.add.at(kinds, of, p_sum > 0)
    out = []
    for mark, w, h, p in zip(marks, words, histories, pairs):
        at = np.searchsorted(known, h)
        told = [w_sum[np.searchsorted(w_keys, w)], met[at], kinds[at], p_sum[np.searchsorted(p_keys, p)]]
        out.append(blocks.squeeze(mark + b"".join(planes(x) for x in told)))
    return out


class Automaton:
    """The states and arcs that a block's texts meet: c(w) by word, c(h) and T(h) by history, c(h, w) by pair."""

    def __init__(self, tokens: Tokens, told: dict[int, bytes], buckets: int):
        lists = Lists(tokens, buckets)
        self.word, self.pair = np.zeros(len(tokens.words)), np.zeros(len(tokens.pair_word))
        self.met, self.kinds = np.zeros(len(tokens.histories)), np.zeros(len(tokens.histories))
        for k in range(buckets):
            w, h, p = lists.cuts(k)
            if w.stop == w.start and h.stop == h.start:
                continue
            r = Reader(blocks.swell(told[k]))
            keys = lists.keys(k)
            if r.sizes("<IIII") != (*struct.unpack_from("<III", keys), zlib.crc32(keys)):
                raise RuntimeError("an answer is to other words than this block has")
            for into, cut in ((self.word, w), (self.met, h), (self.kinds, h), (self.pair, p)):
                into[cut] = r.planes(cut.stop - cut.start)

    def log_weights(self, tokens: Tokens, z: float) -> np.ndarray:
        """log10 of what the path of each token weighs: its state's arc, or the failure arc and the root's.

        The state before a token is its history; a history that nothing followed in training has none, and the root
        stands for it.
        """
        root = (self.word + 1)[tokens.word_at] / z
        met, kinds = self.met[tokens.history_at], self.kinds[tokens.history_at]
        arc = self.pair[tokens.pair_at]
        return np.log10(np.where(met > 0, (arc + kinds * root) / np.maximum(met + kinds, 1), root))


SCORED = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def walk(docs: blocks.Docs, told: dict[int, bytes], train: list[bool], buckets: int, n: int, z: float) -> pa.Table:
    """Walk the automaton over each text of a block."""
    tokens = Tokens(docs, train)
    automaton = Automaton(tokens, told, buckets)
    first = np.cumsum(tokens.sizes) - tokens.sizes
    count = automaton.word[tokens.word_at]

    def summed(values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, first)

    return pa.table(
        {
            "id": pa.array(docs[0], pa.int64()),
            "held_out": pa.array([not t for t in train], pa.bool_()),
            "n_tokens": pa.array(tokens.sizes),
            "n_known": pa.array(summed((count > 0).astype(np.int64))),
            "train_tokens": pa.array([n] * len(train), pa.int64()),
            "base_score": pa.array(summed(np.log10((count + 1) / z))),
            "score": pa.array(summed(automaton.log_weights(tokens, z))),
        }
    )


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", divisor: int = 7, held: int = 2) -> DataFrame:
    """One row for each row of df: id_col, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words (A-Z lower-cased; runs of anything but ASCII white space) and one end. The model learns from
    the rows whose crc32 of the identifier as text, modulo divisor, isn't held. base_score is the add-one unigram's log10
    probability, score the automaton's. Null and empty texts have the end alone. Identifiers are integers and may be null
    (the empty string's crc32 then decides) or repeat. Without training rows every P(w) is 1 / (N + V + 1) = 1. Words are
    told apart by a 64-bit hash; counts have 64 bits.
    """
    rows = blocks.columns(df, id_col, text_col)
    # read by all that follows: the blocks are cut once, whatever order the input comes in
    packed = checkpoint(blocks.blocks(rows))
    size = packed.agg(F.sum(F.octet_length("docs"))).first()[0] or 0
    buckets = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))

    def training(docs: blocks.Docs) -> list[bool]:
        return [zlib.crc32(b"" if i is None else str(i).encode()) % divisor != held for i in docs[0]]

    def kinds(batches):
        for batch in batches:
            for data in batch.column("docs").to_pylist():
                docs = blocks.unpack_docs(data)
                tokens = Tokens(docs, training(docs))
                n = tokens.seen(tokens.word_at, len(tokens.words))
                yield pa.RecordBatch.from_pydict({"word": tokens.words[n > 0].view(np.int64), "n": n[n > 0]})

    def asking(batches):
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("docs").to_pylist()):
                docs = blocks.unpack_docs(data)
                lists = ask_counts(Tokens(docs, training(docs)), buckets)
                used = [k for k, x in enumerate(lists) if x]
                yield pa.RecordBatch.from_pydict({"block": [block] * len(used), "bucket": used, "keys": [lists[k] for k in used]}, blocks.ASK)

    counts = packed.mapInArrow(releasing(kinds), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    sums = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n, v = sums["n"] or 0, sums["v"]
    asked = packed.mapInArrow(releasing(asking), "block long, bucket int, keys binary")
    told = blocks.answer_together(asked, sum_counts)
    out = blocks.meet(packed, told, lambda docs, answers: walk(docs, answers, training(docs), buckets, n, float(n + v + 1)), SCORED)
    return out.withColumnRenamed("id", id_col)
