"""SpotSigs document fingerprints, in DataFrame operations only.

A signature is an anchor and the chain of content words that follows it, up to the next anchor or the chain's length.
Anchors are common words, the beginning of a text, and, so that texts of any language have some, words whose hash says so
(one in eight). The rule is the same for all texts, long or short. A document's fingerprint is the sorted set of its
signatures' 32-bit hashes; fingerprints are compared by Jaccard.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import spread

#: Common words of English, German, French and Spanish. Fixed values.
ANCHORS = (
    "the of and to in a is that it for on was be with as by this from are at or an not have has had but which you "
    "der die das und den von zu mit sich des ist auf für nicht ein eine als auch dem im es war bei oder wird "
    "le la les de et en un une du que qui dans est pour pas par sur au avec ce il elle ne se sont plus ou "
    "el los las y por con no su para es al lo como o fue ha sus pero este"
).split()
#: A rare character that no word has, in front of anchors.
SPOT = "\u0001"
#: One in so many words is an anchor whatever it means.
SAMPLED = 8
#: Most ranges that identifiers are cut in to find each document's next one.
MOST_RANGES = 1 << 16


def with_signatures(df: DataFrame, text: str, out: str, chain: int = 2, anchors=tuple(ANCHORS)) -> DataFrame:
    """df with out: the sorted, distinct hashes (0 to 2^32 - 1) of the signatures of column text.

    Words are runs of letters and digits, lower-cased. An anchor right before another one has no chain. A text without
    words has no signature, any other at least one: its beginning's, or its anchors alone if it has only those.
    """
    words, chains = f"_{out}_words", f"_{out}_chains"

    def spotted(w: Column) -> Column:
        sampled = F.pmod(F.xxhash64(w), F.lit(SAMPLED)) == 0
        return F.when(w.isin(*anchors) | sampled, F.concat(F.lit(SPOT), w)).otherwise(w)

    marked = F.split(F.array_join(F.transform(F.filter(words, lambda w: w != ""), spotted), " "), SPOT)
    first = F.concat(F.lit("^ "), F.element_at(marked, 1))
    cut = F.transform(F.concat(F.array(first), F.slice(marked, 2, 1 << 30)), lambda s: F.substring_index(F.rtrim(s), " ", chain + 1))
    whole = F.filter(cut, lambda s: F.contains(s, F.lit(" ")))
    # A column for each step: the optimizer then computes none of them twice.
    return (
        df.withColumn(words, F.split(F.lower(text), r"[^\p{L}\p{N}]+"))
        .withColumn(chains, F.when(F.size(whole) > 0, whole).otherwise(F.filter(cut, lambda s: s != "^")))
        .withColumn(out, F.array_sort(F.array_distinct(F.transform(chains, lambda s: F.xxhash64(s).bitwiseAND(F.lit(0xFFFFFFFF))))))
        .drop(words, chains)
    )


def spelled(signature: Column) -> Column:
    """A fingerprint as text: its hashes in 8 hex digits each, separated by spaces."""
    return F.array_join(F.transform(signature, lambda h: F.lower(F.lpad(F.hex(h), 8, "0"))), " ")


def length_partition(n: Column, least: float) -> Column:
    """Number of a set's length partition: sets more than one apart can't reach the likeness least."""
    return F.floor(F.log(F.greatest(n, F.lit(1)).cast("double")) / math.log(1 / least))


def jaccard(a: Column, b: Column, least: float | None = None) -> Column:
    """Jaccard likeness of two sorted sets; 1 for two empty ones. Sets that have no number range in common aren't intersected.

    With least, likenesses under it are null: pairs whose length partitions are more than one apart, or whose lengths rule
    it out, aren't intersected either.
    """
    n, m = F.size(a), F.size(b)
    disjoint = (n == 0) | (m == 0) | (F.element_at(a, -1) < F.get(b, F.lit(0))) | (F.element_at(b, -1) < F.get(a, F.lit(0)))
    both = F.size(F.array_intersect(a, b))
    exact = F.when((n == 0) & (m == 0), 1.0).when(F.coalesce(disjoint, F.lit(True)), 0.0).otherwise(both / (n + m - both))
    if least is None:
        return exact
    far = F.abs(length_partition(n, least) - length_partition(m, least)) > 1
    return F.when(~far & (F.least(n, m) >= F.greatest(n, m) * least), F.when(exact >= least, exact))


def _range(key: Column, cuts: list[int]) -> Column:
    """How many of the cuts (largest first) are above key, found in two steps over about their square root of numbers."""
    fan = math.isqrt(len(cuts)) + 1
    bounds = [cuts[k : k + fan] for k in range(0, len(cuts), fan)]
    firsts = F.array(*[F.lit(b[0]).cast("long") for b in bounds])
    lists = F.array(*[F.array(*[F.lit(x).cast("long") for x in b]) for b in bounds])
    outer = F.size(F.filter(firsts, lambda x: x > key))
    inner = F.size(F.filter(F.get(lists, outer - 1), lambda x: x > key))
    return F.when(outer == 0, 0).otherwise((outer - 1) * fan + inner)


def with_next(df: DataFrame, carried: list[str], derive, id_col: str = "id", ranges: int = 64) -> DataFrame:
    """derive(df) with next_<c> for each carried column c: that of the row with the next smaller id; after the last, the
    first's.

    df has id_col (integer) and tie (a hash of the row); derive adds columns row by row, as the rows go to the ranges. Rows are dealt to ranges of ids; the first
    row of a range is a guest in the range before it, where the last row finds it. Rows of equal id follow by tie, null
    ids come last.
    """
    spark = df.sparkSession
    ranges = min(MOST_RANGES, ranges)
    share = [k / ranges for k in range(ranges - 1, 0, -1)]
    cuts = df.agg(F.percentile_approx(id_col, share, 10 * ranges).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts), reverse=True)
    last = MOST_RANGES + 1
    by_id = _range(F.col(id_col), cuts) if cuts else F.lit(0)
    # Null ids: ranges of their own, by tie.
    by_tie = last + F.shiftrightunsigned(F.col("tie").bitwiseXOR(F.lit(-(2**63))), 58)
    ranged = df.withColumn("range", F.when(F.col(id_col).isNull(), by_tie).otherwise(by_id).cast("int"))
    turn = F.struct(F.coalesce(F.col(id_col), F.lit(0)).alias("id"), (-1 - F.col("tie")).alias("back"))
    heads = [
        (r["range"], r["h"]["id"], -1 - r["h"]["back"])
        for r in sorted(ranged.groupBy("range").agg(F.max(turn).alias("h")).collect(), key=lambda r: r["range"])
    ]
    # Each range's first row visits the range before it; a row for each range, MOST_RANGES + 66 at most.
    visits = [(at[0], at[1], at[2], heads[k - 1][0]) for k, at in enumerate(heads)]
    visit = spark.createDataFrame(visits, "v_range int, v_id long, v_tie long, host int")
    met = (F.col("range") == F.col("v_range")) & (F.coalesce(F.col(id_col), F.lit(0)) == F.col("v_id")) & (F.col("tie") == F.col("v_tie"))
    guests = ranged.join(F.broadcast(visit), met).dropDuplicates(["v_range"])
    rows = ranged.select("range", F.lit(0).alias("guest"), *df.columns).union(
        guests.select(F.col("host"), F.lit(1).alias("guest"), *df.columns)
    )
    line = Window.partitionBy("range").orderBy("guest", F.col(id_col).desc_nulls_last(), "tie")
    return derive(rows).withColumns({f"next_{c}": F.lead(c).over(line) for c in carried}).where("guest = 0").drop("guest", "range")


def compare_edited(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many (or all) of the next
    document's, in descending order of id_col, the first coming after the last. near_edited and near_next are the likeness
    of the document's fingerprint to the edited text's and to the next document's.

    Null text counts as empty; the fingerprint is then the empty string, and two empty ones are alike (1). Rows of equal
    identifier are in the order of their text's hash; null identifiers come last. A single row is its own next. Given pairs
    are compared, so no likeness is too small to be told.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    ranges = max(4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), spread(df, 2 << 20, MOST_RANGES))
    follow = with_next(rows, ["text", "sig"], lambda d: with_signatures(d, "text", "sig"), ranges=ranges)
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))
    made = follow.select("id", n.cast("long").alias("n_chars"), "sig", "next_sig", edited.alias("edited"))
    return with_signatures(made, "edited", "edited_sig").select(
        F.col("id").alias(id_col),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        spelled(F.col("sig")).alias("fingerprint"),
        spelled(F.col("edited_sig")).alias("edited_fingerprint"),
        jaccard(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        jaccard(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
