"""SimHash near-deduplication with pivot distance tables.

A fingerprint's table has its Hamming distances to many fixed reference fingerprints (pivots). By the triangle inequality
two fingerprints whose distances to any pivot differ by more than the limit are further apart than the limit, so a pair
is discarded by its largest coordinate difference; survivors are verified bit by bit.

Pairs are looked at within buckets only. The 64 bits are cut in m parts; fingerprints that differ in up to four bits
agree on at least m - 4 whole parts, so each fingerprint goes to a bucket for each choice of m - 4 parts, and no link is
lost. m follows the number of distinct fingerprints, so that the chance members of a bucket stay few at any size. A bucket
that holds many fingerprints all the same goes on, to be split in tiles, and pairs of tiles are compared in different
tasks. A task returns the links of a spanning forest of what it has found, never all pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import checkpoint, releasing, small_batches
from barloom.llm.components import Forest, components

#: Most bits that linked fingerprints differ in; m - MOST whole parts survive them.
MOST = 4
#: Chance members of a bucket that are fine, and most distinct fingerprints of a bucket (or of a tile) compared at once.
CHANCE, TILE = 64, 2048
#: Rows that are gathered from Arrow batches before they are compared.
GATHER = 1 << 15


def pivots(n: int, seed: int = 42) -> np.ndarray:
    """n reference fingerprints from a seeded generator."""
    return np.random.default_rng(seed).integers(0, 2**64, n, dtype=np.uint64)


def fingerprint(text: bytes, width: int = 4) -> int:
    """Bits set in over half of the XXH64 (seed 42) of the text's word shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(whole, 42)]
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts = ends - sizes
        digest = xxhash.xxh64_intdigest
        hashes = [digest(whole[a:b], 42) for a, b in zip(starts[: 1 - width].tolist(), ends[width - 1 :].tolist())]
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    over = bits.sum(0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(over, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str, text_col: str, width: int = 4) -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed 64-bit integer."""
    kind = dict(df.dtypes)[id_col]
    rows = small_batches(df).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(t, width) for t in batch.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found.view(np.int64))], ["id", "fp"])

    return rows.mapInArrow(releasing(run), f"id {kind}, fp long")


def parts_for(n: int) -> tuple[int, ...]:
    """Lengths of the parts (6 to 12 of them) that n fingerprints are bucketed by."""
    for m in range(6, 13):
        lengths = tuple(64 // m + (k < 64 % m) for k in range(m))
        if n <= CHANCE << sum(sorted(lengths)[: m - MOST]):
            break
    return lengths


def _keys(fp: np.ndarray, lengths: tuple[int, ...]) -> np.ndarray:
    """The bucket of each fingerprint (rows) for each choice of len(lengths) - MOST whole parts."""
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).tolist()
    out = []
    for k, chosen in enumerate(itertools.combinations(range(len(lengths)), len(lengths) - MOST)):
        key = np.full(len(fp), k, dtype=np.uint64)
        for c in chosen:
            key = (key << np.uint64(lengths[c])) | ((fp >> np.uint64(starts[c])) & np.uint64((1 << lengths[c]) - 1))
        out.append(key)
    return np.stack(out, axis=1).view(np.int64)


def spread_out(found: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """(bucket, fp): each distinct fingerprint in its buckets."""

    def run(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            if len(fp):
                keys = _keys(fp, lengths)
                again = np.repeat(fp, keys.shape[1]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(again)], ["bucket", "fp"])

    return found.select("fp").mapInArrow(releasing(run), "bucket long, fp long")


def distances(fp: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """The pivot distance table of fingerprints."""
    return np.bitwise_count(fp[:, None] ^ marks[None, :]).astype(np.int16)


def _near(fp: np.ndarray, table: np.ndarray, left: np.ndarray, right: np.ndarray, limit: int):
    """Of the pairs of row numbers, those that no pivot discards and whose bits verify."""
    first = np.abs(table[left, 0] - table[right, 0]) <= limit
    left, right = left[first], right[first]
    far = np.abs(table[left] - table[right]).max(axis=1, initial=0) > limit
    left, right = left[~far], right[~far]
    true = np.bitwise_count(fp[left] ^ fp[right]) <= limit
    return left[true], right[true]


def _compare(place: np.ndarray, side: np.ndarray, cross: np.ndarray, fp, table, limit: int, forest: Forest) -> None:
    """Link near fingerprints within each run of equal places; runs that cross compare side 0 with side 1 only."""
    n = len(fp)
    for step in range(1, n):
        left = np.flatnonzero(place[step:] == place[: n - step])
        if not len(left):
            return
        right = left + step
        wanted = ~cross[left] | (side[left] != side[right])
        a, b = _near(fp, table, left[wanted], right[wanted], limit)
        for x, y in zip(fp[a].tolist(), fp[b].tolist()):
            forest.link(x, y)


def gathered(batches, columns: list[str]) -> Iterator[list[np.ndarray]]:
    """The columns of Arrow batches, about GATHER rows at once."""
    held: list = []
    for batch in batches:
        held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in columns])
        if sum(len(h[0]) for h in held) >= GATHER:
            yield [np.concatenate(c) for c in zip(*held)]
            held = []
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def _pairs_of(forest: Forest, sent: int) -> tuple[np.ndarray, np.ndarray]:
    ends = np.array(forest.links[sent:], dtype=np.uint64).view(np.int64).reshape(-1, 2)
    return ends[:, 0], ends[:, 1]


def _buckets(limit: int, marks: np.ndarray):
    """Compares what is in order of bucket; rows of a bucket of over TILE go on as (bucket, fp, null)."""

    def run(batches):
        forest = Forest()
        over = None
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64)]

        def done(bucket, fp):
            nonlocal over
            starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])[: len(bucket)])
            sizes = np.diff(np.append(starts, len(bucket)))
            large = sizes > TILE
            if over is not None:
                large |= bucket[starts] == over
            by_row = np.repeat(large, sizes)
            if len(large) and large[-1]:
                over = bucket[-1]
            several = np.repeat((sizes > 1) & ~large, sizes)
            sent = len(forest.links)
            if several.any():
                kept = fp[several].view(np.uint64)
                same = np.zeros(len(kept), bool)
                _compare(bucket[several], same, same, kept, distances(kept, marks), limit, forest)
            a, b = _pairs_of(forest, sent)
            nothing = [None] * len(a)
            on, rows = bucket[by_row], fp[by_row]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([*nothing, *on.tolist()], pa.int64()),
                    pa.array(np.concatenate([a, rows])),
                    pa.array([*b.tolist(), *[None] * len(rows)], pa.int64()),
                ],
                ["bucket", "a", "b"],
            )

        for got in gathered(batches, ["bucket", "fp"]):
            bucket, fp = (np.concatenate(x) for x in zip(held, got))
            end = int(np.searchsorted(bucket, bucket[-1]))
            if len(bucket) - end > TILE or bucket[-1] == over:
                end = len(bucket)  # a large bucket isn't held
            held = [bucket[end:], fp[end:]]
            yield done(bucket[:end], fp[:end])
        yield done(*held)

    return releasing(run)


def _tiles(limit: int, marks: np.ndarray):
    """Compares what is in order of place; a place has one or two tiles of a bucket."""

    def run(batches):
        forest = Forest()
        columns = ["place", "side", "cross", "fp"]
        held: list | None = None
        for got in itertools.chain(gathered(batches, columns), [None]):
            rows = held if got is None else got if held is None else [np.concatenate(x) for x in zip(held, got)]
            if rows is None:
                return
            place, side, cross, fp = rows
            end = len(place) if got is None else int(np.searchsorted(place, place[-1]))
            held = [x[end:] for x in rows]
            if not end:
                continue
            sent = len(forest.links)
            kept = fp[:end].view(np.uint64)
            _compare(place[:end], side[:end], cross[:end], kept, distances(kept, marks), limit, forest)
            a, b = _pairs_of(forest, sent)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return releasing(run)


def near_links(found: DataFrame, limit: int, n_pivots: int) -> DataFrame:
    """(a, b): enough links between the distinct fingerprints of found (fp) to connect what is connected.

    found is read twice, so it should be a written table.
    """
    if not 0 <= limit <= MOST:
        raise ValueError(f"limit must be 0 to {MOST}: more changed bits could touch all parts but too few")
    marks = pivots(n_pivots)
    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = spread_out(found, parts_for(found.count())).repartition(n, "bucket").sortWithinPartitions("bucket")
    made = checkpoint(dealt.mapInArrow(_buckets(limit, marks), "bucket long, a long, b long"))
    links = made.where("bucket is null").select("a", "b")
    rest = made.where("bucket is not null").select("bucket", F.col("a").alias("fp"))
    sizes = checkpoint(rest.groupBy("bucket").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles")))
    if sizes.isEmpty():
        return links
    own = F.pmod(F.xxhash64("fp"), "tiles").cast("int")
    # A tile meets itself and every other one; the smaller number names the place's first side.
    dealt = rest.join(sizes, "bucket").select("bucket", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    placed = dealt.select(
        F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("place"),
        (F.col("own") > F.col("other")).alias("side"),
        (F.col("own") != F.col("other")).alias("cross"),
        "fp",
    )
    more = placed.repartition(n, "place").sortWithinPartitions("place").mapInArrow(_tiles(limit, marks), "a long, b long")
    return links.union(more)


def near_groups(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 4, n_pivots: int = 16, width: int = 4
) -> DataFrame:
    """One row for each row of df: id_col, fingerprint, component_id.

    fingerprint is 16 hex digits; documents are linked at limit (up to 4) or fewer differing bits, and component_id is the
    smallest identifier reachable, the document's own included. Null text counts as empty; texts without words have the
    fingerprint zero, which is linked like any other. Texts of up to width words have one shingle. Null identifiers are
    linked, too, but are no component's identifier unless it has no other. Repeated rows each keep a row.
    """
    rows = checkpoint(fingerprints(df, id_col, text_col, width))
    found = checkpoint(rows.groupBy("fp").agg(F.min("id").alias("least")))
    linked = components(near_links(found, limit, n_pivots))
    # Of the fingerprints in links alone: all others are components of their own.
    members = linked.union(linked.select("root", "root").distinct())
    rooted = checkpoint(members.join(found, F.col("node") == F.col("fp")).select("fp", "root", "least"))
    smallest = checkpoint(rooted.groupBy("root").agg(F.min("least").alias("reached")))
    reached = rooted.select("fp", "root").join(smallest, "root").select(F.col("fp").alias("of"), "reached")
    by_fp = checkpoint(found.join(reached, F.col("fp") == F.col("of"), "left").select("fp", F.coalesce("reached", "least").alias("component_id")))
    return rows.join(by_fp, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
