"""Token counts under a unigram model, with one dynamic program over a trie of distinct pre-tokens.

Distinct pre-tokens (words, each after the vocabulary's word mark) are dealt to buckets and inserted in a trie there. The
forward score of a prefix (the best sum of piece scores over its segmentations) and its number of tokens depend on the
prefix alone, so they are computed once at its trie node and shared by all pre-tokens below; terminal nodes store their
counts. The counts come back to the blocks of documents and are added up over each whole text.

The pieces are a public vocabulary's. Their probabilities are fitted to the corpus: segmentations under Zipf's law over
the pieces' rank are counted over all pre-tokens of all documents, and the counts are the model's (one round of hard
expectation-maximisation).
"""

from __future__ import annotations

import functools
import math
import struct
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import blocks
from barloom.llm.common import releasing, spread

MARK = "▁"
COUNTS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64())])


def load(path: str) -> bytes:
    """A sentencepiece model's file (under a MB, whatever the corpus)."""
    with open(path, "rb") as f:
        return f.read()


@functools.lru_cache(maxsize=2)
def vocabulary(model: bytes) -> tuple[str, ...]:
    """The pieces by rank. Byte, control and unknown pieces aren't part of segmentations; see BYTE."""
    import sentencepiece

    read = sentencepiece.SentencePieceProcessor(model_proto=model)
    plain = [i for i in range(read.vocab_size()) if not (read.is_byte(i) or read.is_control(i) or read.is_unknown(i))]
    return tuple(read.id_to_piece(i) for i in plain)


def zipf(model: bytes) -> dict[str, float]:
    """Log-probability of each piece by Zipf's law over its rank."""
    pieces = vocabulary(model)
    whole = math.log(sum(1 / r for r in range(1, len(pieces) + 1)))
    return {p: -math.log(r) - whole for r, p in enumerate(pieces, 1)}


#: Score of each byte of a character that no piece covers: under any piece's, so pieces win.
BYTE = -30.0
#: Characters of a word that are trie nodes; the rest of a longer word is scored without being kept.
DEPTH = 64
#: Nodes of a trie, about 300 bytes each; beyond, a bucket begins a new one.
NODES = 400_000


class Trie:
    """Prefixes of pre-tokens as numbered nodes with their forward score, number of tokens and last piece's length."""

    def __init__(self, score: dict[str, float]):
        # ends of pieces that aren't pieces have no score: what isn't even an end is in no longer piece
        self.ends: dict[str, float | None] = {p[k:]: None for p in score for k in range(1, len(p))}
        self.ends.update(score)
        self.clear()

    def clear(self) -> None:
        self.below: dict[tuple[int, str], int] = {}
        self.best, self.tokens, self.back = [0.0], [0], [0]
        self.terminal: dict[int, int] = {}

    def _step(self, word: str, end: int, best, at) -> tuple[float, int, int]:
        """Score of the prefix that ends at end, its last piece's length (0: a character spelled in bytes) and tokens.

        best[at[k]] is the score of the prefix of k characters.
        """
        top, size, cost = -math.inf, 0, 1
        ends, covered = self.ends, False
        for k in range(1, end + 1):
            s = ends.get(word[end - k : end], False)
            if s is False:
                break
            if s is not None:
                covered |= k == 1
                if (s := s + best[at[end - k]]) >= top:
                    top, size = s, k
        if not covered:
            spelled = len(word[end - 1].encode())
            if (s := best[at[end - 1]] + BYTE * spelled) > top:
                top, size, cost = s, 0, spelled
        return top, size, cost

    def walk(self, word: str) -> list[int]:
        """Insert a word, as far as nodes go: the nodes of its prefixes, from the empty one."""
        below, best, tokens, node, path = self.below, self.best, self.tokens, 0, [0]
        for end, char in enumerate(word[:DEPTH], 1):
            at = below.get((node, char))
            if at is None:
                top, size, cost = self._step(word, end, best, path)
                at = below[node, char] = len(best)
                best.append(top)
                tokens.append(tokens[path[end - (size or 1)]] + cost)
                self.back.append(size)
            path.append(at)
            node = at
        return path

    def beyond(self, word: str, path: list[int]) -> tuple[int, array]:
        """Number of tokens and last pieces' lengths by prefix of a word that is longer than the trie is deep."""
        best, tokens, back = (array(kind, [x[k] for k in path]) for kind, x in (("d", self.best), ("q", self.tokens), ("i", self.back)))
        for end in range(len(path), len(word) + 1):
            top, size, cost = self._step(word, end, best, range(end))
            best.append(top)
            tokens.append(tokens[end - (size or 1)] + cost)
            back.append(size)
        return tokens[-1], back

    def count(self, word: str) -> int:
        """A word's number of tokens, stored at its terminal node."""
        path = self.walk(word)
        if len(word) > DEPTH:
            return self.beyond(word, path)[0]
        n = self.terminal[path[-1]] = self.tokens[path[-1]]
        if len(self.best) > NODES:
            self.clear()
        return n

    def pieces(self, word: str) -> list[str]:
        """The pieces of a word's best segmentation, from the last to the first, without what is spelled in bytes."""
        path = self.walk(word)
        back = self.beyond(word, path)[1] if len(word) > DEPTH else [self.back[k] for k in path]
        found, end = [], len(word)
        while end:
            size = back[end]
            if size:
                found.append(word[end - size : end])
            end -= size or 1
        if len(self.best) > NODES:
            self.clear()
        return found


def counted_keys(buckets: int):
    """Lists of a block's words as for counting, each word with how often the block has it."""

    def keys(docs: blocks.Docs) -> list[bytes]:
        times = Counter()
        for t in docs[1]:
            times.update(t.split())
        lists = blocks.word_lists(times, buckets)
        return [blocks.squeeze(struct.pack("<I", len(x)) + np.array([times[w] for w in x], "<u8").tobytes() + b"\n".join(x)) if x else b"" for x in lists]

    return keys


def fit(rows: DataFrame, model: bytes, buckets: int) -> dict[str, float]:
    """The pieces' log-probabilities from all documents; a row for each piece of the vocabulary comes to the driver."""
    start = zipf(model)

    def run(batches):
        trie, found, words, bucket = Trie(start), Counter(), Counter(), None

        def flush():
            for w, n in words.items():
                for p in trie.pieces(MARK + w.decode()):
                    found[p] += n
            words.clear()

        for batch in batches:
            for b, data in zip(batch.column("bucket").to_pylist(), batch.column("keys").to_pylist()):
                if b != bucket:
                    flush()
                    trie.clear()
                    bucket = b
                data = blocks.swell(data)
                (n,) = struct.unpack_from("<I", data)
                for w, k in zip(data[4 + 8 * n :].split(b"\n"), np.frombuffer(data, "<u8", n, 4).tolist()):
                    words[w] += k
                if len(words) > 100_000:
                    flush()
        flush()
        yield pa.RecordBatch.from_pydict({"piece": pa.array(list(found), pa.string()), "n": pa.array(list(found.values()), pa.int64())})

    asked = blocks.ask(rows, counted_keys(buckets)).select("bucket", "keys")
    dealt = asked.repartition("bucket").sortWithinPartitions("bucket")
    sums = dealt.mapInArrow(releasing(run), "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    times = {r["piece"]: r["n"] for r in sums}
    whole = math.log(sum(times.values()) + len(start))
    return {p: math.log(times.get(p, 0) + 1) - whole for p in start}


def replies(score: dict[str, float]):
    """A function that answers a list of words with its mark and the words' numbers of tokens."""
    trie = Trie(score)

    def reply(data: bytes) -> bytes:
        words = blocks.swell(data).split(b"\n")
        counts = np.array([trie.count(MARK + w.decode()) for w in words], dtype="<u4")
        return blocks.squeeze(blocks.mark(words) + counts.tobytes())

    return reply


def added(score: dict[str, float], docs: blocks.Docs, told: dict[int, bytes], buckets: int) -> pa.Table:
    names, bodies = docs
    counts: dict[bytes, int] = {}
    for k, words in enumerate(blocks.word_lists(blocks.distinct_words(bodies), buckets)):
        if words:
            data = blocks.swell(told[k]) if k in told else b""
            if data[:8] != blocks.mark(words):  # dealt otherwise when read again: count this list here
                data = blocks.swell(replies(score)(blocks.squeeze(b"\n".join(words))))
            counts.update(zip(words, np.frombuffer(data, "<u4", offset=8).tolist()))
    split = [t.split() for t in bodies]
    return pa.Table.from_pydict(
        {"doc_id": names, "n_words": [len(w) for w in split], "n_tokens": [sum([counts[x] for x in w]) for w in split]}, COUNTS
    )


def count_tokens(
    df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", score: dict[str, float] | None = None
) -> DataFrame:
    """One row for each row of df: id_col, n_words, n_tokens.

    n_tokens is the number of pieces in the best segmentation of each word (a run of anything but ASCII white space, after
    the mark U+2581), added up over the text. score has the pieces' log-probabilities; without it they are fitted to df.
    Of equal scores the longer last piece counts. A character that no piece covers counts as one token for each byte. Null
    text counts as empty and has no tokens. Identifiers are integers and may be null or repeat; each row is counted.
    """
    model = load(path)
    rows = blocks.columns(df, id_col, text_col)
    buckets = spread(df, 4 << 20, blocks.MOST_BUCKETS)
    known = score or fit(rows, model, buckets)
    told = blocks.answer(blocks.ask(rows, blocks.word_keys(buckets)), lambda: replies(known))
    out = blocks.meet(
        blocks.blocks(rows),
        told,
        lambda docs, answers: added(known, docs, answers, buckets),
        "doc_id long, n_words long, n_tokens long",
    )
    return out.withColumnRenamed("doc_id", id_col)
