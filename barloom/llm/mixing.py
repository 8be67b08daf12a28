"""Mixing sources to target weights by a min-cost flow over membership patterns.

Documents are aggregated by the set of sources that they belong to (their pattern). A network carries tokens from the
patterns to the sources' quotas: the k-th pass over a pattern's documents costs (k - 1) ** 2 a token, which is convex, so
documents repeat only where a quota can't be met otherwise, and evenly. The flow from a pattern to a source is then
filled with documents in a seeded order. Only sums by pattern and by source reach the driver; documents don't.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import WORD, checkpoint, free_name, spread

#: Most membership patterns whose sums the driver takes for the flow.
MOST_PATTERNS = 100_000


def targets(sizes: dict[str | None, int], weights=(5, 2, 1), most_passes: int = 3) -> dict[str | None, float]:
    """Share the whole size among the sources by weight (in code point order, null last, the weights repeating).

    A target stops at most_passes times its source's size; the excess is shared by weight among the others until none is
    above.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed = float(sum(sizes.values())), {}
    while True:
        free = [s for s in order if s not in fixed]
        left = max(0.0, total - sum(fixed.values()))
        whole = sum(weight[s] for s in free)
        share = {s: left * weight[s] / whole for s in free}
        over = [s for s in free if share[s] > most_passes * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: float(most_passes * sizes[s]) for s in over}


def min_cost_flow(patterns: list[tuple[int, list[int]]], quotas: list[int], passes: int = 3) -> dict[tuple[int, int], int]:
    """Tokens from each pattern (size, its sources' numbers) to each source's quota, at least cost.

    Successive shortest paths with potentials over start -> pattern (one arc a pass, dearer each time) -> source -> end.
    """
    n_p, n_q = len(patterns), len(quotas)
    start, end = n_p + n_q, n_p + n_q + 1
    arcs: list[list] = []
    out: list[list[int]] = [[] for _ in range(end + 1)]

    def arc(a: int, b: int, room: int, cost: int) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            out[x].append(len(arcs))
            arcs.append([y, r, c])
        return len(arcs) - 2

    routes = {}
    for i, (size, members) in enumerate(patterns):
        for k in range(passes):
            arc(start, i, size, k * k)
        for j in members:
            routes[i, j] = arc(i, n_p + j, passes * size, 0)
    for j, quota in enumerate(quotas):
        arc(n_p + j, end, quota, 0)
    height = [0] * (end + 1)
    while True:
        far, via = [None] * (end + 1), [-1] * (end + 1)
        far[start], queue = 0, [(0, start)]
        while queue:
            d, x = heapq.heappop(queue)
            if d > far[x]:
                continue
            for e in out[x]:
                y, room, cost = arcs[e]
                step = d + cost + height[x] - height[y]
                if room > 0 and (far[y] is None or step < far[y]):
                    far[y], via[y] = step, e
                    heapq.heappush(queue, (step, y))
        if far[end] is None:
            break
        height = [h + (f if f is not None else far[end]) for h, f in zip(height, far)]
        path, x = [], end
        while x != start:
            path.append(via[x])
            x = arcs[via[x] ^ 1][0]
        room = min(arcs[e][1] for e in path)
        for e in path:
            arcs[e][1] -= room
            arcs[e ^ 1][1] += room
    return {k: arcs[e ^ 1][1] for k, e in routes.items() if arcs[e ^ 1][1]}


def _plan(spark, sums: list, weights, passes: int) -> tuple[DataFrame, DataFrame]:
    """From the sums by pattern: (pattern, whole passes, rest) and (source, its size, target)."""
    sizes: dict[str | None, int] = {}
    for row in sums:
        for s in row["pattern"]:
            sizes[s] = sizes.get(s, 0) + row["size"]
    order = list(sizes)
    goal = targets(sizes, weights, passes) if sizes else {}
    at = {s: i for i, s in enumerate(order)}
    flow = min_cost_flow(
        [(r["size"], [at[s] for s in r["pattern"]]) for r in sums], [round(goal[s]) for s in order], passes
    )
    take = [0] * len(sums)
    for (i, _), n in flow.items():
        take[i] += n
    routed = [
        (list(r["pattern"]), *(divmod(take[i], r["size"]) if r["size"] else (0, 0))) for i, r in enumerate(sums)
    ]
    return (
        spark.createDataFrame(routed, "pattern array<string>, whole long, rest long"),
        spark.createDataFrame([(s, sizes[s], goal[s]) for s in order], "source string, source_size long, target double"),
    )


def pattern_of(df: DataFrame, members_col: str) -> Column:
    """The sorted sources that a document belongs to; the source null if there is none."""
    several = dict(df.dtypes)[members_col].startswith("array")
    members = F.array_sort(F.array_distinct(members_col)) if several else F.array(F.col(members_col))
    return F.when(members.isNull() | (F.size(members) == 0), F.array(F.lit(None).cast("string"))).otherwise(members)


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    members_col: str = "source",
    weights=(5, 2, 1),
    passes: int = 3,
    seed: int = 42,
    buckets: int | None = None,
    carry: Column | None = None,
) -> DataFrame:
    """One row for each row of df: id_col, pattern, size, copies, taken, source_size, target, and carried: what carry is.

    members_col is the document's source, or an array of the sources that it belongs to. size is the number of words
    (null text: 0), copies how often the mix takes the document (0 to passes), taken = copies * size. target and
    source_size are those of the document's first source. A null source is a source of its own, last in order; repeated
    members of an array count once, and an empty array is the source null. Documents of equal identifier and text are
    taken in any order among themselves; the result is the same. An empty table gives an empty result.
    """
    spark = df.sparkSession
    buckets = buckets or spread(df, 1 << 18, 1 << 20)
    members = pattern_of(df, members_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = checkpoint(
        df.select(
            F.col(id_col).alias("id"),
            (F.lit(None).cast("long") if carry is None else carry).alias("carried"),
            F.monotonically_increasing_id().alias("rid"),
            members.alias("pattern"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
            F.xxhash64(F.col(id_col).cast("string"), F.xxhash64(text), F.lit(seed)).alias("turn"),
        )
    )
    by_pattern = rows.groupBy("pattern").agg(F.sum("size").alias("size"))
    sums = by_pattern.limit(MOST_PATTERNS + 1).collect()
    if len(sums) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} membership patterns")
    routed, goal = _plan(spark, sorted(sums, key=lambda r: str(r["pattern"])), weights, passes)
    # At most MOST_PATTERNS rows of a few words each: small enough to broadcast.
    dealt = rows.join(F.broadcast(routed), rows["pattern"].eqNullSafe(routed["pattern"])).drop(routed["pattern"])
    # A bucket is a range of turns, so the choice doesn't depend on how many there are.
    dealt = dealt.withColumn("bucket", F.shiftrightunsigned("turn", 64 - max(1, (buckets - 1).bit_length())))
    # Whole buckets, in order, while the rest of the pattern's flow has room; then single documents of the next bucket.
    inner = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        dealt.groupBy("pattern", "bucket", "rest")
        .agg(F.sum("size").alias("in_bucket"))
        .withColumn("before", F.coalesce(F.sum("in_bucket").over(inner), F.lit(0)))
        .select("pattern", "bucket", "before", (F.col("before") + F.col("in_bucket") <= F.col("rest")).alias("whole_bucket"))
    )
    placed = dealt.join(before, ["pattern", "bucket"])
    in_cut = ~F.col("whole_bucket") & (F.col("before") < F.col("rest"))
    line = Window.partitionBy("pattern", "bucket").orderBy("turn", "id", "rid").rowsBetween(Window.unboundedPreceding, 0)
    columns = ["id", "rid", "carried", "pattern", "size", "whole", "rest", "one_more"]
    cut = placed.where(in_cut).withColumn("one_more", F.col("before") + F.sum("size").over(line) <= F.col("rest"))
    picked = cut.select(columns).union(placed.where(~in_cut).withColumn("one_more", F.col("whole_bucket")).select(columns))
    # What is still missing then, and the one document that fills it best; a row for each pattern.
    missing = (F.col("rest") - F.col("got")).alias("missing")
    got = F.coalesce(F.sum(F.when(F.col("one_more"), F.col("size"))), F.lit(0)).alias("got")
    gap = picked.groupBy("pattern", "rest").agg(got).select(F.col("pattern").alias("of"), missing)
    off = F.abs(F.col("size") - F.col("missing")).alias("off")
    best = (
        picked.where(~F.col("one_more"))
        .join(F.broadcast(gap), F.col("pattern").eqNullSafe(F.col("of")))
        .where(off < F.col("missing"))
        .groupBy("pattern")
        .agg(F.min(F.struct(off, "id", "rid")).alias("b"))
        .select(F.col("b.rid").alias("fills"))
    )
    result = picked.join(F.broadcast(best), F.col("rid") == F.col("fills"), "left")
    result = result.withColumn("one_more", F.col("one_more") | F.col("fills").isNotNull())
    copies = F.col("whole") + F.col("one_more").cast("long")
    first = F.element_at("pattern", 1)
    return result.join(F.broadcast(goal), first.eqNullSafe(F.col("source"))).select(
        F.col("id").alias(id_col),
        "pattern",
        "size",
        copies.alias("copies"),
        (copies * F.col("size")).alias("taken"),
        "source_size",
        "target",
        *([] if carry is None else ["carried"]),
    )


def mixed_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", members_col: str = "source", **options) -> DataFrame:
    """The rows of df that the mix takes, with all their columns, each as often as the mix repeats it.

    Rows that agree in identifier, text and sources share what the mix takes of them evenly; what is over goes to the
    first in order of all columns as JSON.
    """
    sha = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    name = free_name(df, "mix")
    taken = mix(df, id_col, text_col, members_col, carry=sha, **options).select(F.col(id_col).alias("id"), "carried", "pattern", "copies")
    shared = checkpoint(taken.groupBy("id", "carried", "pattern").agg(F.sum("copies").alias("copies"), F.count("*").alias("n")))
    shared = shared.where("copies > 0").toDF(*[name + c for c in ("id", "sha", "pattern", "copies", "n")])
    copies, n = F.col(f"{name}copies"), F.col(f"{name}n")
    same = F.col(id_col).eqNullSafe(F.col(f"{name}id")) & (sha == F.col(f"{name}sha")) & pattern_of(df, members_col).eqNullSafe(F.col(f"{name}pattern"))
    columns = [F.col(f"`{c}`") for c in df.columns]

    def repeated(rows: DataFrame, times: Column) -> DataFrame:
        return rows.select(*columns, F.explode(F.sequence(F.lit(1), times.cast("int"))).alias(f"{name}k")).select(*columns)

    once = repeated(df.join(shared.where(n == 1), same), copies)
    if shared.where(n > 1).isEmpty():
        return once
    whole = F.struct(*columns)
    keys = [f"{name}id", f"{name}sha", f"{name}pattern"]
    alike = df.join(shared.where(n > 1), same).groupBy(*keys, copies, n, F.to_json(whole).alias(f"{name}json"))
    alike = alike.agg(F.any_value(whole).alias(f"{name}row"), F.count("*").alias(f"{name}here"))
    here, until = F.col(f"{name}here"), F.sum(f"{name}here").over(Window.partitionBy(*keys).orderBy(f"{name}json"))
    over = F.least(F.greatest(copies % n - (until - here), F.lit(0)), here)
    counted = alike.withColumn(f"{name}times", F.floor(copies / n) * here + over).where(F.col(f"{name}times") > 0)
    rows = counted.select(*[F.col(f"{name}row").getField(c).alias(c) for c in df.columns], f"{name}times")
    return once.union(repeated(rows, F.col(f"{name}times")))
