"""Near-deduplication by SimHash and by the Jaccard likeness of word shingles; no pair that reaches the likeness is lost.

1. How many documents have each shingle: blocks of documents exchange their sorted, shortened hashes with buckets
   (barloom.llm.blocks), a byte or two for each shingle. Shortened hashes can only make a shingle seem more common. A text
   of n shingles can't reach likeness t with any other unless t * n of its shingles are in other texts, too; all others
   go no further.
2. Proposals among those that are left are verified by the Jaccard likeness of whole texts; only verified links count.
   SimHash: texts of one fingerprint, and of fingerprints that the pivot tables leave (barloom.llm.simhash), are proposed.
   That finds most copies, and all of large groups, at one comparison each; but no Hamming limit is sure to reach every
   pair of a given Jaccard likeness.
3. So each text also has its first hashes: sets sorted by the same order, rarest first, share one of their first
   n - ceil(t * n) + 1 hashes if they are alike. Under each such hash the text of the smallest component is proposed to the
   other components.
4. What then still meets under a hash without being linked is compared text by text, so that nothing is left out. Hashes
   under which the same components meet are one place. A place with many texts is split in tiles, and pairs of tiles are
   compared in different tasks. A task returns the links that joined something, never all pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm import blocks
from barloom.llm.common import alone, checkpoint, free_name, releasing, store
from barloom.llm.components import Forest, components
from barloom.llm.lm import Reader, planes
from barloom.llm.simhash import near_links

#: A shortened hash has so many bits more than it takes to number all shingles: under 1 % seem more common than they are.
SPARE_BITS = 7
#: Packed text for which there is one bucket of shortened hashes.
BUCKET_BYTES = 2 << 20
#: Counts end here; shingles in more texts are as good as each other.
MOST_COUNTED = 255
#: Most texts of a place in one tile.
TILE = 256
#: Times that the texts under a hash are proposed to the smallest component there before all others are compared.
ROUNDS = 2


#: An odd multiplier, what it is divided by, and odd numbers for the finish. Fixed values.
BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)
FINISH = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


#: Powers that a worker keeps: those of the longest text or group of texts so far, up to so many.
POWERS: dict[int, np.ndarray] = store()
MOST_KEPT = 1 << 23


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1), modulo 2 ** 64."""
    known = POWERS.get(base)
    if known is None or len(known) < n:
        known = np.full(n + n // 8 + 1, base, dtype=np.uint64)
        known[0] = 1
        np.cumprod(known, dtype=np.uint64, out=known)
        if len(known) <= MOST_KEPT:
            alone(POWERS)[base] = known
    return known[:n]


#: Bytes of text that are hashed at once, and a single longer text: it takes some 40 bytes for each byte.
HASHED = 1 << 20


def grouped(texts: list[bytes]) -> Iterator[list[bytes]]:
    """The texts in groups of HASHED bytes."""
    group: list[bytes] = []
    size = 0
    for t in texts:
        if group and size + len(t) > HASHED:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    yield group


def run_hashes(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each run of width words of each text, A-Z lower-cased, and where each text's runs begin.

    Words are what white space separates; a text of fewer words is one run, as is one without any. A run's hash is the
    polynomial of its bytes (words with one space between them) modulo 2 ** 64, mixed, wherever the text stands.
    """
    found, sizes = zip(*[(h, np.diff(at)) for h, at in (_hashed(group, width) for group in grouped(texts))])
    return np.concatenate(found), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def _hashed(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """run_hashes of one group: sums up to each byte give the polynomials of all runs at once."""
    whole = b"\n".join([b" ".join(t.lower().split()) for t in texts])
    data = np.frombuffer(whole, np.uint8)
    upto = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(data * powers(BASE, len(data)), out=upto[1:])
    cuts = np.flatnonzero(data == 10)
    first, last = np.concatenate([[0], cuts + 1]), np.concatenate([cuts, [len(data)]])
    between = np.flatnonzero((data == 32) | (data == 10))
    starts, ends = np.concatenate([[0], between + 1]), np.concatenate([between, [len(data)]])
    of = np.searchsorted(first, starts, side="right") - 1
    n = len(starts) - width + 1
    inside = np.flatnonzero(of[:n] == of[width - 1 :]) if n > 0 else np.zeros(0, np.int64)
    short = np.flatnonzero(np.bincount(of, minlength=len(texts)) < width)
    a, b = np.concatenate([starts[inside], first[short]]), np.concatenate([ends[inside + width - 1], last[short]])
    owner = np.concatenate([of[inside], short])
    order = np.argsort(owner, kind="stable")
    a, b, owner = a[order], b[order], owner[order]
    found = (upto[b] - upto[a]) * powers(UNBASE, len(data) + 1)[a]
    found = (found ^ (found >> np.uint64(30))) * FINISH[0]
    found = (found ^ (found >> np.uint64(27))) * FINISH[1]
    return found ^ (found >> np.uint64(31)), np.searchsorted(owner, np.arange(len(texts) + 1))


def shingles(text: bytes, width: int) -> np.ndarray:
    """The sorted, distinct hashes of a text's runs of words."""
    return np.unique(run_hashes([text], width)[0])


def majority(hashes: np.ndarray) -> int:
    """The SimHash fingerprint: bits set in over half of the hashes, repeats included."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    over = bits.sum(0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(over, bitorder="little").view("<u8")[0])


class Block:
    """The shingles of a block's texts, and its distinct shortened hashes with how many of its texts have each."""

    def __init__(self, texts: list[bytes], width: int, bits: int):
        self.drop = np.uint64(64 - bits)
        found, at = run_hashes(texts, width)
        self.runs = np.split(found, at[1:-1])
        owner = np.repeat(np.arange(len(texts)), np.diff(at))
        found = np.concatenate([np.sort(r) for r in self.runs])
        new = np.concatenate([[True], (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])])
        found, owner = found[new], owner[new]
        self.sets = np.split(found, np.searchsorted(owner, np.arange(1, len(texts))))
        short = found >> self.drop
        new = np.concatenate([[True], (short[1:] != short[:-1]) | (owner[1:] != owner[:-1])])
        self.keys, self.counts = np.unique(short[new], return_counts=True)

    def cuts(self, buckets: int, bits: int) -> np.ndarray:
        edges = np.array([(k << bits) // buckets for k in range(1, buckets)], dtype=np.uint64)
        return np.concatenate([[0], np.searchsorted(self.keys, edges), [len(self.keys)]])

    def lists(self, buckets: int, bits: int) -> list[bytes]:
        at = self.cuts(buckets, bits)
        return [
            blocks.squeeze(planes(np.diff(self.keys[a:b], prepend=np.uint64(0))) + planes(np.minimum(self.counts[a:b], MOST_COUNTED), 1)) if b > a else b""
            for a, b in zip(at, at[1:])
        ]

    def told(self, answers: dict[int, bytes], buckets: int, bits: int) -> np.ndarray:
        """For each key in how many texts of all blocks it is, up to MOST_COUNTED."""
        at = self.cuts(buckets, bits)
        parts = [np.frombuffer(blocks.swell(answers[k]), np.uint8) if b > a else np.zeros(0, np.uint8) for k, (a, b) in enumerate(zip(at, at[1:]))]
        return np.concatenate(parts)


def count_texts(lists: list[bytes]) -> list[bytes]:
    """A bucket's answers: in how many texts each key of each list is, over all lists."""
    keys, counts = [], []
    for data in lists:
        reader = Reader(blocks.swell(data))
        n = len(reader.data) // 9
        keys.append(np.cumsum(reader.planes(n), dtype=np.uint64))
        counts.append(reader.planes(n, 1).astype(np.float64))
    kinds, place = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.minimum(np.bincount(place, weights=np.concatenate(counts)), MOST_COUNTED).astype(np.uint8)
    ends = np.cumsum([len(k) for k in keys])
    return [blocks.squeeze(x.tobytes()) for x in np.split(sums[place], ends[:-1])]


def first(hashes: np.ndarray, counts: np.ndarray, likeness: Fraction) -> np.ndarray:
    """Of the n hashes of a set, the rarest n - ceil(likeness * n) + 1, as far as other texts have them; none if over
    n - ceil(likeness * n) are the text's own, since then no other set reaches the likeness."""
    n = len(hashes)
    least = -(-likeness.numerator * n // likeness.denominator)
    order = np.lexsort((hashes, counts))[: n - least + 1]
    return hashes[order[counts[order] > 1]]


def alike(a: np.ndarray, b: np.ndarray, likeness: Fraction) -> bool:
    """Whether two sets of hashes have that Jaccard likeness."""
    if min(len(a), len(b)) * likeness.denominator < max(len(a), len(b)) * likeness.numerator:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * likeness.denominator >= (len(a) + len(b) - both) * likeness.numerator


def key(id_col: str, text_col: str) -> tuple[Column, Column]:
    """What tells rows apart: the identifier, and for identifiers that repeat a hash of the text."""
    return F.col(id_col), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def profiles(df: DataFrame, id_col: str, text_col: str, likeness: Fraction, width: int) -> DataFrame:
    """(node, id, h, fp, first, text): a number, the key, the fingerprint, the first hashes and the text of each distinct
    key whose text other texts can reach."""
    packed = checkpoint(blocks.blocks(blocks.columns(df, id_col, text_col)))
    sizes = packed.agg(F.sum(F.octet_length("docs")), F.sum("bytes")).first()
    buckets = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(sizes[0] or 0) // BUCKET_BYTES))
    # a shingle has a word, so texts have no more shingles than half their bytes
    bits = min(64, ((sizes[1] or 0) // 2 + 1).bit_length() + SPARE_BITS)

    def asking(batches):
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("docs").to_pylist()):
                lists = Block(blocks.unpack_docs(data)[1], width, bits).lists(buckets, bits)
                used = [k for k, x in enumerate(lists) if x]
                yield pa.RecordBatch.from_pydict({"block": [block] * len(used), "bucket": used, "keys": [lists[k] for k in used]}, blocks.ASK)

    def use(docs: blocks.Docs, answers: dict[int, bytes]) -> pa.Table:
        here = Block(docs[1], width, bits)
        counts = here.told(answers, buckets, bits)
        rows = []
        for i, text, runs, hashes in zip(docs[0], docs[1], here.runs, here.sets):
            found = first(hashes, counts[np.searchsorted(here.keys, hashes >> here.drop)], likeness)
            if len(found):
                h = xxhash.xxh64_intdigest(text, 42)
                rows.append((i, h, majority(runs) if text.split() else 0, found.astype("<u8").tobytes(), text))
        ids, hs, fps, firsts, texts = zip(*rows) if rows else ([],) * 5
        return pa.table(
            [pa.array(ids, pa.int64()), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (hs, fps)), pa.array(firsts, pa.binary()), pa.array(texts, pa.binary())],
            names=["id", "h", "fp", "first", "text"],
        )

    asked = packed.select("block", "docs").mapInArrow(releasing(asking), "block long, bucket int, keys binary")
    told = blocks.answer_together(asked, count_texts)
    made = blocks.meet(packed.select("block", "docs"), told, use, "id long, h long, fp long, first binary, text binary")
    made = checkpoint(made.withColumn("node", F.monotonically_increasing_id()))
    once = checkpoint(made.groupBy("id", "h").agg(F.min("node").alias("node")).select("node"))
    return made.join(once, "node", "left_semi")


def exploded(nodes: DataFrame) -> DataFrame:
    """(hash, node): a row for each of the first hashes of nodes."""

    def run(batches):
        for batch in batches:
            found = [np.frombuffer(x, "<i8") for x in batch.column("first").to_pylist()]
            if found:
                node = np.repeat(batch.column("node").to_numpy(), [len(f) for f in found])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(node)], ["hash", "node"])

    return nodes.select("node", "first").mapInArrow(releasing(run), "hash long, node long")


def verified(proposed: DataFrame, texts: DataFrame, likeness: Fraction, width: int) -> DataFrame:
    """The pairs of nodes of proposed (a, b) whose texts (node, text) are alike."""

    def run(batches):
        for batch in batches:
            keep = []
            last, held = None, None
            for a, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "x", "y"))):
                if a != last:
                    last, held = a, shingles(x, width)
                keep.append(alike(held, shingles(y, width), likeness))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x = texts.select(F.col("node").alias("a"), F.col("text").alias("x"))
    y = texts.select(F.col("node").alias("b"), F.col("text").alias("y"))
    return checkpoint(proposed.join(y, "b").join(x, "a").select("a", "b", "x", "y").mapInArrow(releasing(run), "a long, b long"))


def rooted(met: DataFrame, roots: DataFrame) -> DataFrame:
    """met with root: the smallest node that a node is linked to."""
    return met.join(roots.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").select(*met.columns, F.coalesce("root", "node").alias("root"))


def _meet(nodes: list[int], sets: list[np.ndarray], sides: list[bool], cross: bool, likeness: Fraction, forest: Forest) -> None:
    """Link what is alike among the texts of one place; where tiles cross, texts of different sides only."""
    trees: dict[int, list[int]] = {}
    for k in sorted(range(len(nodes)), key=lambda k: len(sets[k])):
        for tree in list(trees.values()):
            if forest.root(nodes[tree[0]]) == forest.root(nodes[k]):
                continue
            for m in reversed(tree):  # the longest first
                if len(sets[m]) * likeness.denominator < len(sets[k]) * likeness.numerator:
                    break
                if not (cross and sides[m] == sides[k]) and alike(sets[m], sets[k], likeness):
                    forest.link(nodes[m], nodes[k])
                    break
        joined = [k]
        root = forest.root(nodes[k])
        for r in [r for r, tree in trees.items() if forest.root(nodes[tree[0]]) == root]:
            joined.extend(trees.pop(r))
        trees[root] = sorted(joined, key=lambda m: len(sets[m])) if len(joined) > 1 else joined


def compared(met: DataFrame, texts: DataFrame, likeness: Fraction, width: int) -> DataFrame:
    """(a, b): links between the nodes of met (hash, node, root) that have a hash in common and are alike; enough of them
    to connect what is connected, given that nodes of one root are."""
    here = met.groupBy("hash", "root").agg(F.lit(1).alias("one"))
    several = here.groupBy("hash").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("root")).alias("which")).where("n > 1")
    several = checkpoint(several.select("hash", F.xxhash64("n", "which").alias("spot")))
    placed = checkpoint(met.join(several, "hash").select("spot", "node", "root").distinct())
    tiles = checkpoint(placed.groupBy("spot").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles")))
    own = F.pmod(F.xxhash64("node"), "tiles").cast("int")
    # A tile meets itself and every other one; the smaller number names the place's first side.
    dealt = placed.join(tiles, "spot").select("spot", "node", "root", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    dealt = dealt.select(
        F.xxhash64("spot", F.least("own", "other"), F.greatest("own", "other")).alias("place"),
        (F.col("own") > F.col("other")).alias("side"),
        (F.col("own") != F.col("other")).alias("cross"),
        "node",
        "root",
    )

    def run(batches):
        forest, sent, kept = Forest(), 0, None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                kept = batch if kept is None else pa.concat_batches([kept, batch])
                place = kept.column("place").to_numpy()
                if place[0] == place[-1]:
                    continue
                end = int(np.searchsorted(place, place[-1]))
            elif kept is None:
                return
            else:
                end, place = len(kept), kept.column("place").to_numpy()
            nodes, roots = kept.column("node").to_pylist(), kept.column("root").to_pylist()
            side, cross = (kept.column(c).to_pylist() for c in ("side", "cross"))
            texts = kept.column("text")
            cuts = [0, *(np.flatnonzero(np.diff(place[:end])) + 1).tolist(), end]
            for a, b in itertools.pairwise(cuts):
                for x, r in zip(nodes[a:b], roots[a:b]):
                    forest.join(x, r)
                if b - a > 1 and len({forest.root(x) for x in nodes[a:b]}) > 1:
                    sets = [shingles(texts[k].as_py(), width) for k in range(a, b)]
                    _meet(nodes[a:b], sets, side[a:b], cross[a], likeness, forest)
            kept = kept.slice(end)
            new = forest.links[sent:]
            sent = len(forest.links)
            if new:
                ends = np.array(new, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])

    n = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    full = dealt.join(texts, "node").repartition(n, "place").sortWithinPartitions("place")
    return full.select("place", "side", "cross", "node", "root", "text").mapInArrow(releasing(run), "a long, b long")


def linked(df: DataFrame, id_col: str, text_col: str, likeness: Fraction, width: int, limit: int, n_pivots: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, roots): nodes has node, id and h of distinct keys; roots (node, root) the nodes that aren't their own."""
    nodes = profiles(df, id_col, text_col, likeness, width)
    texts, nodes = nodes.select("node", "text"), nodes.drop("text")
    met = checkpoint(exploded(nodes).withColumn("n", F.count("*").over(Window.partitionBy("hash"))).where("n > 1").select("hash", "node"))
    # SimHash: a text and the smallest of its fingerprint, and the smallest ones of near fingerprints.
    found = checkpoint(nodes.groupBy("fp").agg(F.min("node").alias("least")))
    same = nodes.join(found, "fp").where("node != least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    near = near_links(found.select("fp"), limit, n_pivots)
    ends = [found.select(F.col("fp").alias(c), F.col("least").alias(f"of_{c}")) for c in "ab"]
    near = near.join(ends[0], "a").join(ends[1], "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    proposed = checkpoint(same.union(near))
    links = verified(proposed, texts, likeness, width)
    roots = components(links)
    for _ in range(ROUNDS):
        here = rooted(met, roots)
        # written first, so that a hash with many texts is a skewed key of a plain join, which Spark splits
        lead = checkpoint(here.groupBy("hash").agg(F.min(F.struct("root", "node")).alias("lead")))
        pairs = here.join(lead, "hash").select("node", "root", "lead").where("root != lead.root")
        turn = F.min(F.struct(F.col("node").alias("a"), F.col("lead.node").alias("b"))).alias("e")
        proposed = checkpoint(pairs.groupBy("root", F.col("lead.root").alias("to")).agg(turn).select("e.a", "e.b"))
        more = verified(proposed, texts, likeness, width)
        if more.isEmpty():
            break
        links = links.union(more)
        roots = components(links)
    more = checkpoint(compared(rooted(met, roots), texts, likeness, width))
    if not more.isEmpty():
        roots = components(links.union(more))
    return nodes, roots


def keep_one(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", likeness: float = 0.8, width: int = 5, limit: int = 4, n_pivots: int = 16
) -> DataFrame:
    """The rows of df, with all their columns, without those linked to a row of smaller identifier.

    Rows are linked at a Jaccard likeness of `likeness` or more between their sets of width-word shingles, and over other
    rows. Null text counts as empty, and texts without words are alike. Of each component one row stays: the smallest
    identifier, nulls last, then the smallest hash of the text; rows that agree in identifier and text stay or go together.
    limit and n_pivots are those of the SimHash fingerprints that propose links; they don't change the result.
    """
    ratio = Fraction(likeness).limit_denominator(1000)
    nodes, roots = linked(df, id_col, text_col, ratio, width, limit, n_pivots)
    members = roots.union(roots.select("root", "root").distinct())
    named = checkpoint(members.join(nodes.select(F.col("node").alias("_n"), "id", "h"), F.col("node") == F.col("_n")).drop("_n"))
    turn = F.struct(F.col("id").isNull().alias("last"), "id", "h", "node")
    best = checkpoint(named.groupBy("root").agg(F.min(turn)["node"].alias("best")))
    gone = checkpoint(named.join(best, "root").where("node != best").select(F.col("id").alias("id"), "h"))
    own, h = key(id_col, text_col)
    mark = free_name(df, "gone")
    gone = gone.toDF(f"{mark}i", f"{mark}h")
    return df.join(gone, own.eqNullSafe(F.col(f"{mark}i")) & (h == F.col(f"{mark}h")), "left_anti")
