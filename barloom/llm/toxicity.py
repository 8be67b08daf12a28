"""Toxicity by noisy-channel deobfuscation.

A noisy word (leetspeak, separators, single letters with spaces between them, repeated letters) is a lattice: each of its
characters may stand for itself, for the letters that it looks like, or for nothing. The Viterbi path through the lattice
under a character language model of the corpus is the restored word. Restored words and their beginnings are then weighed
by their log-odds among labelled documents, and the sum is turned into a probability.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import blocks, labelled
from barloom.llm.common import checkpoint, kept, releasing, remainder, small_batches, store

#: Letters that a character may stand for. Fixed values.
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "*": "aeiou", "#": "h",
}
#: Costs in nats: of a letter for a look-alike, of dropping a digit, another look-alike, a separator, a repeated letter.
LOOK, DROP_DIGIT, DROP_LOOK, DROP_OTHER, DROP_REPEAT = 0.5, 6.0, 4.0, 2.0, 2.0
#: Cost of a word break inside single letters with spaces between them.
BREAK = 3.0
BOUND = 26
SIGNS = BOUND + 1
CONTEXTS = SIGNS**3
EDGE = re.compile(r"^[\W_]+|[\W_]+$")
EDGE_PLAIN = re.compile(r"^[\"'(\[{«¿¡.,;:|*_~#&%-]+|[\"')\]}».,;:?|*_~#&%-]+$|([^\w\s])\1+$|!$")
REPEAT = re.compile(r"(.)\1\1")
DOUBLE = re.compile(r"([a-z])\1")
ALIKE = re.compile(r"([a-z])\1+")
CLEAN = re.compile(r"[^\W\d_]+(?:['’.,;:/_\-][^\W\d_]{2,})*\Z")
#: Letters whose decomposition isn't a letter and marks. Fixed values.
FOLDS = str.maketrans({"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ł": "l", "ı": "i"})


def fold(text: str) -> str:
    """Lower case, compatibility forms, no accents."""
    if text.isascii():
        return text.lower()
    parts = unicodedata.normalize("NFKD", text.lower().translate(FOLDS))
    return "".join([c for c in parts if not unicodedata.combining(c)])


def trimmed(chunk: str) -> str:
    """A chunk without what only decorates its ends: punctuation, or one sign again and again."""
    while (cut := EDGE_PLAIN.sub("", chunk)) != chunk:
        chunk = cut
    return chunk


def is_noisy(word: str) -> bool:
    """Whether a trimmed word needs a lattice: it has a letter or two, and signs inside or letters three times in a row."""
    if word.isalpha():
        return REPEAT.search(word) is not None
    letters = sum(map(str.isalpha, word))
    return letters > 1 and not (CLEAN.match(word) and not REPEAT.search(word))


def is_doubtful(word: str) -> bool:
    """Whether a trimmed word may be noisy: doubled letters, letters on both sides of a sign, or a letter among look-alikes."""
    if word.isalpha():
        return DOUBLE.search(word) is not None
    letters = sum(map(str.isalpha, word))
    return letters > 1 or (letters == 1 and sum(c in LOOKS for c in word) > 1)


def plain(chunk: str) -> str | None:
    """The folded word of a chunk that is letters and at most some marks at its end; None if it needs a closer look."""
    word = chunk if chunk.isalpha() else chunk.rstrip(".,;:?!")
    if word.isalpha():
        if word.isascii():
            word = word.lower()
        elif not (word := fold(word)).isalpha():
            return None
        if REPEAT.search(word) is None:
            return word
    return None


def single(word: str) -> str:
    """The word with one letter for each run of the same letter: the same for all ways to drop repeated letters."""
    return ALIKE.sub(r"\1", word)


class Channel:
    """Character model (27^4 log-probabilities: a fixed size) and decoder; remembers words that it has restored."""

    def __init__(self, logp: np.ndarray):
        self.logp = logp
        self.known: dict[str, tuple[str, ...]] = {}

    def words(self, chunk: str) -> tuple[str, ...]:
        """The restored words of a chunk between white spaces."""
        found = self.known.get(chunk)
        if found is None:
            if len(self.known) > 150_000:
                self.known.clear()
            word = plain(chunk)
            if word is not None:
                found = self.letters(word)
            else:
                word = trimmed(fold(chunk))
                if is_noisy(word):
                    found = tuple(self.decode(word, False).split())
                else:
                    found = tuple(w for w in re.split(r"[\W\d_]+", word) if w)
                    if is_doubtful(word):
                        found = self.likelier(word, found)
            self.known[chunk] = found
        return found

    def letters(self, word: str) -> tuple[str, ...]:
        """The restored words of a word that plain() has found: itself but for doubled letters."""
        return (word,) if DOUBLE.search(word) is None else self.likelier(word, (word,))

    def likelier(self, word: str, split: tuple[str, ...]) -> tuple[str, ...]:
        """The word as its lattice restores it or, where the character model finds that no less likely, as it is split."""
        if not all("a" <= c <= "z" for w in split for c in w):
            return split
        if split == (word,):
            return (self.without_doubles(word),)
        value, restored = self.best(word, False)
        dropped = sum(DROP_DIGIT for c in word if c.isdigit())
        unrestored = sum(self.best(w, False, False)[0] for w in split) - dropped
        return split if unrestored >= value else tuple(restored.split())

    def without_doubles(self, word: str) -> str:
        """The best path of a word of a-z alone: of all ways to drop repeated letters, each scored as a whole.

        The same as best(), in a fiftieth of its time; a word of many doubled letters still goes to best().
        """
        doubles = [i for i in range(1, len(word)) if word[i] == word[i - 1]]
        if len(doubles) > 5:
            value, restored = self.best(word, False)
            return word if self.best(word, False, False)[0] >= value else restored
        logp, signs = self.logp, [ord(c) - 97 for c in word] + [BOUND]
        top, chosen = -np.inf, 0
        for mask in range(1 << len(doubles)):
            dropped = {d for k, d in enumerate(doubles) if mask >> k & 1}
            state, value = CONTEXTS - 1, 0.0
            for i, sign in enumerate(signs):
                if i in dropped:
                    value -= DROP_REPEAT
                else:
                    at = state * SIGNS + sign
                    value += logp[at]
                    state = at % CONTEXTS
            if value > top:
                top, chosen = value, mask
        dropped = {d for k, d in enumerate(doubles) if chosen >> k & 1}
        return "".join([c for i, c in enumerate(word) if i not in dropped])

    def decode(self, word: str, spaced: bool) -> str:
        """The word of the best path through the lattice."""
        return self.best(word, spaced)[1]

    def best(self, word: str, spaced: bool, drops: bool = True) -> tuple[float, str]:
        """The best path through the word's lattice, from left to right, with the last three letters as the state: its
        score and word. Without drops, repeated letters stay."""
        logp = self.logp
        start = CONTEXTS - 1  # three bounds
        now: dict[int, tuple[float, tuple | None]] = {start: (0.0, None)}
        before = ""
        for char in word:
            options: list[tuple[int, float]] = []
            if "a" <= char <= "z":
                options.append((ord(char) - 97, 0.0))
                if drops and char == before:
                    options.append((-1, DROP_REPEAT))
            else:
                looks = LOOKS.get(char, "")
                options.extend((ord(c) - 97, LOOK + (1.0 if len(looks) > 2 else 0.0)) for c in looks)
                options.append((-1, DROP_DIGIT if char.isdigit() else DROP_LOOK if looks else DROP_OTHER))
            then: dict[int, tuple[float, tuple | None]] = {}
            for state, (score, path) in now.items():
                ways = [(state, score, path)]
                if spaced and path is not None:
                    at = state * SIGNS + BOUND
                    ways.append((start, score + logp[at] - BREAK, (path, BOUND)))
                for s, v, p in ways:
                    for sign, cost in options:
                        if sign < 0:
                            to, value, road = s, v - cost, p
                        else:
                            at = s * SIGNS + sign
                            to, value, road = at % CONTEXTS, v + logp[at] - cost, (p, sign)
                        if to not in then or then[to][0] < value:
                            then[to] = (value, road)
            now, before = then, char
        value, path = max(((v + logp[s * SIGNS + BOUND], p) for s, (v, p) in now.items()), key=lambda x: x[0])
        signs = []
        while path is not None:
            path, sign = path
            signs.append(" " if sign == BOUND else chr(97 + sign))
        return value, "".join(reversed(signs))

    def text(self, text: str) -> list[str]:
        """All restored words of a text, in order; runs of three or more single characters are one lattice."""
        chunks = text.split()
        out: list[str] = []
        at = 0
        for a, b in spaced(chunks):
            for c in chunks[at:a]:
                out.extend(self.words(c))
            out.extend(self.decode(fold("".join(chunks[a:b])), True).split())
            at = b
        for c in chunks[at:]:
            out.extend(self.words(c))
        return out


def spaced(chunks: list[str]) -> list[tuple[int, int]]:
    """(from, to) of the runs of single characters that have two letters or more."""
    single = [i for i, c in enumerate(chunks) if len(c) == 1]
    return [(a, b) for a, b in runs(single) if sum(map(str.isalpha, chunks[a:b])) > 1]


def runs(places: list[int], least: int = 3) -> list[tuple[int, int]]:
    """(from, to) of at least so many places in a row."""
    found, k = [], 0
    while k < len(places):
        e = k
        while e + 1 < len(places) and places[e + 1] == places[e] + 1:
            e += 1
        if e - k + 1 >= least:
            found.append((places[k], places[e] + 1))
        k = e + 1
    return found


def char_counts(texts: list[bytes]) -> np.ndarray:
    """Counts of four letters in a row (bounds around each word) over all occurrences of clean words."""
    counts: Counter[str] = Counter()
    for t in texts:
        counts.update(t.decode("utf-8", "replace").split())
    clean: dict[str, int] = {}
    for chunk, n in counts.items():
        word = plain(chunk)
        if word is None:
            word = trimmed(fold(chunk))
            if not word.isalpha() or REPEAT.search(word):
                continue
        if word.isascii():
            clean[word] = clean.get(word, 0) + n
    if not clean:
        return np.zeros(SIGNS**4, np.int64)
    signs = np.frombuffer(("{{{" + "{{{".join(clean) + "{{{").encode(), np.uint8).astype(np.int64) - 97
    at = ((signs[:-3] * SIGNS + signs[1:-2]) * SIGNS + signs[2:-1]) * SIGNS + signs[3:]
    # a word of n letters has n + 3 windows, the last two of which only see the bounds of its end
    sizes = np.array([len(w) for w in clean])
    times = np.repeat(np.array(list(clean.values())), sizes + 3)
    ends = np.cumsum(sizes + 3)
    use = np.ones(len(times), bool)
    use[ends - 1] = use[ends - 2] = False
    return np.bincount(at[: len(times)][use], weights=times[use], minlength=SIGNS**4).astype(np.int64)


def char_model(df: DataFrame, text_col: str) -> np.ndarray:
    """Log-probability of a letter after three, from all texts: counts backed off by Witten and Bell's rule.

    At most 27^4 sums reach the driver.
    """
    rows = small_batches(df).select(F.lit(None).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def run(batches):
        whole = np.zeros(SIGNS**4, np.int64)
        for _, (_, texts) in blocks.cut(batches):
            whole += char_counts(texts)
        used = np.flatnonzero(whole)
        yield pa.RecordBatch.from_pydict({"at": used.astype(np.int32), "n": whole[used]})

    sums = rows.mapInArrow(releasing(run), "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(SIGNS**4)
    counts[sums["at"].to_numpy(dtype=np.int64)] = sums["n"].to_numpy(dtype=np.float64)
    return smooth(counts)


def smooth(counts: np.ndarray) -> np.ndarray:
    p = np.full(SIGNS, 1 / SIGNS)
    for order in (1, 2, 3, 4):
        n = counts.reshape(-1, *[SIGNS] * order).sum(0)
        whole, kinds = n.sum(-1, keepdims=True), (n > 0).sum(-1, keepdims=True)
        p = (n + kinds * p) / np.maximum(whole + kinds, 1) + np.where(whole + kinds > 0, 0, p)
    return np.log(np.maximum(p, 1e-12)).reshape(-1).astype(np.float32)


#: Lengths of the beginnings that words are known by.
LEAST, MOST = 4, 8


def beginnings(word: str) -> list[str]:
    """What a restored word is known by: itself, and its beginnings (marked by a *)."""
    return [word, *[word[:n] + "*" for n in range(LEAST, min(MOST, len(word)) + 1)]]


def odds(pos, neg, n_pos: float, n_neg: float):
    """Log-odds of a feature less one standard error."""
    return (
        np.log((pos + 0.5) / (n_pos + 1)) - np.log((neg + 0.5) / (n_neg + 1)) - np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))
    )


#: What this worker process keeps between tasks: the last channel and the last model's weighed chunks, by digest.
LIVE: dict[str, tuple[str, object]] = store()


class Weighed:
    """Chunks that have been restored and weighed, and what was found in them."""

    def __init__(self):
        self.seen: set[str] = set()
        self.hits: dict[str, list[tuple[str, float]]] = {}


class Model:
    """Character model, lexicon of weights and regression: bounded by the sample, whatever the corpus."""

    def __init__(self, logp: np.ndarray, lexicon: dict[str, float], weights: np.ndarray):
        self.logp, self.lexicon, self.weights = logp, lexicon, weights
        self.language = hashlib.blake2b(logp.tobytes(), digest_size=16).hexdigest()
        words = repr(sorted(lexicon.items())).encode()
        self.name = hashlib.blake2b(words, digest_size=16, key=self.language.encode()).hexdigest()
        # how all words begin that weigh anything, as they are and without repeated letters
        self.heads = {f[:LEAST] for f in lexicon}
        self.singles = {single(f.rstrip("*")[:LEAST]) for f in lexicon}

    def start(self) -> Channel:
        return kept(LIVE, "channel", self.language, lambda: Channel(self.logp.tolist()))

    def words(self, text: str) -> list[str]:
        return self.start().text(text)

    def weight(self, word: str) -> float:
        if word[:LEAST] not in self.heads:
            return 0.0
        get = self.lexicon.get
        w = get(word, 0.0)
        for n in range(LEAST, min(MOST, len(word)) + 1):
            w = max(w, get(word[:n] + "*", 0.0))
        return w

    def weighed(self, words) -> list[tuple[str, float]]:
        return [(w, x) for w in words if (x := self.weight(w))]

    def chunk(self, chunk: str) -> list[tuple[str, float]]:
        """The weighed words of a chunk; doubled letters are only restored where some way to drop them may weigh."""
        word = plain(chunk)
        if word is None:
            return self.weighed(self.start().words(chunk))
        if DOUBLE.search(word) is None:
            return [(word, x)] if (x := self.weight(word)) else []
        bare = single(word[: 2 * LEAST])
        if not any(bare[:n] in self.singles for n in range(1, LEAST + 1)):
            return []
        return self.weighed(self.start().letters(word))

    def found(self, text: str) -> tuple[list[tuple[str, float]], int]:
        """The weighed words of a text, and its number of chunks; each distinct chunk is restored and weighed once."""
        channel, known = self.start(), kept(LIVE, "weighed", self.name, Weighed)
        hits = known.hits
        chunks = text.split()
        new = set(chunks) - known.seen
        if new:
            if len(known.seen) > 200_000:
                known.seen, new = set(), set(chunks)
                hits.clear()
            for c in new:
                if here := self.chunk(c):
                    hits[c] = here
            known.seen |= new
        out = [x for c in chunks if c in hits for x in hits[c]]
        for a, b in spaced(chunks):
            out.extend(self.weighed(channel.decode(fold("".join(chunks[a:b])), True).split()))
        return out, len(chunks)

    def score(self, texts: list[str]) -> np.ndarray:
        x = np.array([evidence(*self.found(t)) for t in texts]).reshape(-1, 3)
        return labelled.chance(x, self.weights)


def evidence(found: list[tuple[str, float]], n: int) -> tuple[float, float, float]:
    """Features of a text of n chunks: the sum of its words' weights, the sum by chunk, and how many words weigh."""
    s = sum(x for _, x in found)
    return np.log1p(s), np.sqrt(s / (n + 10)), np.log1p(len({w for w, _ in found}))


def train(
    df: DataFrame,
    labels: DataFrame,
    id_col: str,
    text_col: str,
    label_col: str,
    divisor: int,
    held: int,
    most: int = 20_000,
    least_docs: int = 5,
    least_odds: float = 1.5,
) -> Model:
    """Character model of all texts; lexicon and regression of a bounded sample of at most `most` labelled rows.

    The lexicon has every feature of the sample with log-odds of least_odds or more in least_docs toxic documents or more.
    When a document of the sample is weighed for the regression, its own label is taken out of the counts.
    """
    spark = df.sparkSession
    logp = char_model(df, text_col)
    chosen = labelled.sample(labels, id_col, label_col, divisor, held, most, by_class=False)
    wanted = spark.createDataFrame(chosen, "_id long, y int")  # at most `most` rows of 12 bytes
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = df.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).join(
        F.broadcast(wanted), F.col("id") == F.col("_id")
    )
    found = checkpoint(found.select("text", "y"))  # read three times
    bare = Model(logp, {}, np.zeros(4))

    def count(batches):
        sums: dict[str, list[int]] = {}
        for batch in batches:
            for t, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                for f in {f for w in set(bare.words(t)) for f in beginnings(w)}:
                    sums.setdefault(f, [0, 0])[y] += 1
        yield pa.RecordBatch.from_pydict(
            {"f": list(sums), "neg": [v[0] for v in sums.values()], "pos": [v[1] for v in sums.values()]},
            pa.schema([("f", pa.string()), ("neg", pa.int64()), ("pos", pa.int64())]),
        )

    sums = found.select("text", "y").mapInArrow(releasing(count), "f string, neg long, pos long")
    sums = sums.groupBy("f").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    docs = {r["y"]: r["count"] for r in found.groupBy("y").count().collect()}
    n_neg, n_pos = docs.get(0, 0), docs.get(1, 0)
    if not n_pos or not n_neg:
        share = (n_pos + 1) / (n_pos + n_neg + 2)
        return Model(logp, {}, np.array([np.log(share / (1 - share)), 0.0, 0.0, 0.0]))
    pos, neg = F.col("pos"), F.col("neg")
    lean = (
        F.log((pos + 0.5) / (n_pos + 1)) - F.log((neg + 0.5) / (n_neg + 1)) - F.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))
    )
    rows = (
        sums.where(pos >= least_docs)
        .withColumn("lean", lean)
        .where(F.col("lean") >= least_odds)
        .collect()  # words of the sample's texts: bounded as it is
    )
    lexicon = {r["f"]: r["lean"] for r in rows}
    counts = {r["f"]: (r["pos"], r["neg"]) for r in rows}

    def weigh(batches):
        left_out = [
            {f: max(0.0, float(odds(p - y, n - (1 - y), n_pos - y, n_neg - (1 - y)))) for f, (p, n) in counts.items() if p >= y and n >= 1 - y}
            for y in (0, 1)
        ]
        # a feature that only its own document has is left out altogether
        left_out[1] = {f: w for f, w in left_out[1].items() if counts[f][0] - 1 >= least_docs - 1}
        for batch in batches:
            out: list[tuple[float, float, float]] = []
            ys = batch.column("y").to_pylist()
            for t, y in zip(batch.column("text").to_pylist(), ys):
                words = bare.words(t)
                seen = {w: max((left_out[y].get(f, 0.0) for f in beginnings(w)), default=0.0) for w in set(words)}
                out.append(evidence([(w, seen[w]) for w in words if seen[w]], len(t.split())))
            a, b, c = ([float(o[k]) for o in out] for k in range(3))
            yield pa.RecordBatch.from_pydict({"a": a, "b": b, "c": c, "y": pa.array(ys, pa.int32())})

    x = found.select("text", "y").mapInArrow(releasing(weigh), "a double, b double, c double, y int").toPandas()
    weights = labelled.fit_logistic(x[["a", "b", "c"]].to_numpy(), x["y"].to_numpy(dtype=np.float64), penalty=0.1)
    return Model(logp, lexicon, weights)


def classify(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    divisor: int = 4,
    held: int = 2,
    limit: float = 0.3,
) -> DataFrame:
    """One row for each row of df: id_col, held_out, score, predicted.

    score is the probability of label 1; predicted is 1 from `limit` on. Rows whose crc32 of the identifier as text,
    modulo divisor, is `held` are held out: their labels aren't looked at. Null text counts as empty and is scored.
    Identifiers may be null or repeat. Whole texts are read, however long. Without labels of both classes the score is
    the smoothed share of the class.
    """
    kind = dict(df.dtypes)[id_col]
    model = train(df, labels, id_col, text_col, label_col, divisor, held)
    rows = df.select(
        F.col(id_col).alias("id"),
        (remainder(F.col(id_col), divisor) == held).alias("held_out"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
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


def drop_toxic(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    divisor: int = 4,
    held: int = 2,
    limit: float = 0.3,
) -> DataFrame:
    """The rows of df that score under `limit`, with all their columns; null texts are scored as empty ones."""
    model = train(df, labels, id_col, text_col, label_col, divisor, held)

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            yield batch.filter(pa.array(model.score(texts) < limit, pa.bool_()))

    return df.mapInArrow(releasing(run), df.schema)


def restore(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", logp: np.ndarray | None = None) -> DataFrame:
    """id_col and restored: each whole text's restored words, joined by spaces; null text gives the empty string."""
    model = Model(char_model(df, text_col) if logp is None else logp, {}, np.zeros(4))
    kind = dict(df.dtypes)[id_col]

    def run(batches):
        for batch in batches:
            said = [" ".join(model.words(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(said, pa.string())], ["id", "restored"])

    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(releasing(run), f"id {kind}, restored string").withColumnRenamed("id", id_col)
