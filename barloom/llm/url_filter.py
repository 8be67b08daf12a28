"""URL filter by empirical-Bayes host reputation, in DataFrame operations only.

Outcomes of labelled pages (1 bad, 0 good) are counted by host, registered domain and public suffix. The suffix is the
last label, or the last two where the first of them is one under which countries' registries sell names (co.uk); the
registered domain is the suffix and the label before it. Each level's rate is shrunk toward the level above by a beta prior whose weight comes from the spread of the
groups (method of moments for the beta-binomial). A host is blocked if the lower posterior bound of its bad rate is
over the limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import lower_ascii

#: (verdict, host, path): fixed values of the query's contract.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Most rules that one call compiles into its plan.
MOST_RULES = 1000
#: Labels that are part of a public suffix before a country's label of two letters. Fixed values.
SECOND = ("ac", "co", "com", "edu", "gob", "gov", "gv", "ltd", "me", "mil", "ne", "net", "nhs", "nom", "or", "org", "plc", "sch")
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty if url is null or has no ://."""
    url = F.coalesce(url, F.lit(""))
    return lower_ascii(F.regexp_extract(url, URL, 1)), F.regexp_extract(url, URL, 2)


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host + path, and its verdict; null where none fits.

    Of rules as long as each other the first in text order counts.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, at, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), [-ord(c) for c in r[1] + r[2]])):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(start)
        name, verdict = F.when(fits, at + start).otherwise(name), F.when(fits, said).otherwise(verdict)
    return name, verdict


def shrunk(groups: DataFrame, above: DataFrame, key: str, up: str, least: float, most: float) -> DataFrame:
    """groups (key, up, n, bad) with the posterior mean under a beta prior at the mean of the level above.

    The prior's weight k comes from the spread of the groups' rates: var = (S - (G - 1) p (1 - p)) / (N - sum n^2 / N),
    k = p (1 - p) / var - 1, held between least and most; most if the groups don't differ by more than chance.
    """
    n, rate = F.sum("n"), F.sum("bad") / F.sum("n")
    whole = groups.where("n > 0").agg(
        n.alias("all_n"),
        F.count("*").alias("g"),
        rate.alias("p"),
        F.sum(F.col("bad").cast("double") * F.col("bad") / F.col("n")).alias("sq"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("n2"),
    )
    p, total = F.col("p"), F.col("all_n").cast("double")
    room = total - F.col("n2") / total
    var = F.when(room > 0, (F.col("sq") - total * p * p - (F.col("g") - 1) * p * (1 - p)) / room)
    weight = F.when(var > 0, F.greatest(F.lit(least), F.least(F.lit(most), p * (1 - p) / var - 1))).otherwise(most)
    mean = above.select(F.col(above.columns[0]).alias(up), F.col("mean").alias("up_mean"))
    # the aggregate has one row, always
    joined = groups.join(mean, up, "left").crossJoin(F.broadcast(whole.select(weight.alias("k"))))
    prior = F.coalesce(F.col("k"), F.lit(most))
    return joined.select(
        key,
        up,
        ((F.col("bad") + prior * F.col("up_mean")) / (F.col("n") + prior)).alias("mean"),
        (F.col("n") + prior).alias("weight"),
    )


def reputation(pages: DataFrame, host: str = "host", outcome: str = "outcome", least: float = 1.0, most: float = 1000.0) -> DataFrame:
    """host, mean, weight: the posterior of the bad rate of each host.

    outcome is 1 (bad), 0 (good) or null (not labelled); hosts without labelled pages get their domain's posterior mean.
    """
    labels = F.split(F.col("host"), r"\.")
    country = (F.size(labels) > 2) & (F.length(F.element_at(labels, -1)) == 2) & F.element_at(labels, -2).isin(*SECOND)
    suffix = F.substring_index("host", ".", -1)
    suffix = F.when(country, F.substring_index("host", ".", -2)).otherwise(suffix)
    domain = F.when(country, F.substring_index("host", ".", -3)).otherwise(F.substring_index("host", ".", -2))
    hosts = (
        pages.select(F.col(host).alias("host"), F.col(outcome).cast("long").alias("bad"))
        .groupBy("host")
        .agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
        .withColumns({"domain": domain, "suffix": suffix})
    )
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    suffixes = domains.groupBy("suffix").agg(*sums).withColumn("root", F.lit(""))
    root = suffixes.agg(*sums).select(
        F.lit("").alias("root"),
        ((F.coalesce("bad", F.lit(0)) + 1) / (F.coalesce("n", F.lit(0)) + 2)).alias("mean"),
    )
    by_suffix = shrunk(suffixes, root, "suffix", "root", least, most)
    by_domain = shrunk(domains, by_suffix.select("suffix", "mean"), "domain", "suffix", least, most)
    return shrunk(hosts, by_domain.select("domain", "mean"), "host", "domain", least, most).select("host", "mean", "weight")


def judge_urls(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    outcome_col: str | None = None,
    rules=RULES,
    limit: float = 0.5,
    z: float = 1.645,
) -> DataFrame:
    """One row for each row of pages: id_col, host, path, rule, verdict, bad_bound.

    A fitting rule decides; else the host's reputation: block if the lower bound, mean - z * sd of its posterior, is over
    limit. Labelled outcomes come from outcome_col (1 bad, 0 good, null unknown) or, without one, from the pages that a
    rule decides. A null url or one without :// has empty host and path and is judged as the host "". An empty table
    gives an empty result; other columns of pages are not looked at.
    """
    host, path = host_path(F.col(url_col))
    seen = pages.select(
        F.col(id_col).alias("_id"),
        host.alias("host"),
        path.alias("path"),
        (F.col(outcome_col).cast("int") if outcome_col else F.lit(None).cast("int")).alias("outcome"),
    )
    rule, said = longest_rule(F.col("host"), F.col("path"), rules)
    ruled = seen.withColumns({"rule": rule, "said": said})
    if outcome_col is None:
        ruled = ruled.withColumn("outcome", F.when(F.col("said") == "block", 1).when(F.col("said") == "allow", 0))
    known = reputation(ruled)
    bound = F.col("mean") - z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("weight") + 1))
    return (
        ruled.join(known, "host", "left")
        .withColumn("bad_bound", bound)
        .select(
            F.col("_id").alias(id_col),
            "host",
            "path",
            "rule",
            F.coalesce("said", F.when(F.col("bad_bound") > limit, "block").otherwise("allow")).alias("verdict"),
            "bad_bound",
        )
    )
