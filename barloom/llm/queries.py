"""The registered queries of the corpus operators and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import (
    bpe,
    exact_dedup,
    lm,
    mixing,
    quality,
    simhash,
    spotsigs,
    token_trie,
    toxicity,
    url_filter,
)
from barloom.llm.common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), keep=())
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.tree_dedup(table(spark, sf_dir, "documents"), keep="max")


OP4_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept,
       text_sha256
FROM t
"""


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge_urls(table(spark, sf_dir, "pages"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def _shrunk_sql(level: str, above: str, up: str) -> str:
    """Posterior means of one level, as barloom.llm.url_filter.shrunk computes them."""
    return f"""
{level}_all AS (
  SELECT sum(n)::DOUBLE AS t, count(*) AS g, sum(bad)::DOUBLE / sum(n) AS p,
         sum(bad::DOUBLE * bad / n) AS sq, sum(n::DOUBLE * n) AS n2
  FROM {level}_n WHERE n > 0
), {level}_k AS (
  SELECT coalesce(CASE WHEN var > 0 THEN greatest(1.0, least(1000.0, p * (1 - p) / var - 1)) ELSE 1000.0 END, 1000.0)::DOUBLE AS k
  FROM (SELECT p, CASE WHEN t - n2 / t > 0 THEN (sq - t * p * p - (g - 1) * p * (1 - p)) / (t - n2 / t) END AS var
        FROM {level}_all)
), {level}_m AS (
  SELECT x.*, (x.bad + k * a.mean) / (x.n + k) AS mean, x.n + k AS weight
  FROM {level}_n x JOIN {above} a USING ({up}), {level}_k
)"""


OP9_SQL = rf"""
WITH parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 1, 's'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 2, 's') AS path
  FROM pages
), ruled AS (
  SELECT *, (host = 'org' OR ends_with(host, '.org')) AS is_org,
         (host = 'com' OR ends_with(host, '.com')) AS is_com,
         (host = 'example.org' OR ends_with(host, '.example.org')) AS is_ex
  FROM parts
), said AS (
  SELECT page_id, host, path,
         CASE WHEN is_ex AND starts_with(path, '/en/1') THEN 'example.org/en/1'
              WHEN is_ex AND starts_with(path, '/es/') THEN 'example.org/es/'
              WHEN is_com AND starts_with(path, '/fr/') THEN 'com/fr/'
              WHEN is_com AND starts_with(path, '/de/') THEN 'com/de/'
              WHEN is_org AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM ruled
), outcomes AS (
  SELECT *, CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 1
                 WHEN rule IS NOT NULL THEN 0 END AS bad
  FROM said
), host_n AS (
  SELECT host, count(bad) AS n, coalesce(sum(bad), 0)::BIGINT AS bad,
         any_value(CASE WHEN regexp_matches(host, '__CO__') THEN regexp_extract(host, '[^.]*[.][^.]*[.][^.]*$') WHEN contains(host, '.') THEN regexp_extract(host, '[^.]*[.][^.]*$') ELSE host END) AS domain,
         any_value(CASE WHEN regexp_matches(host, '__CO__') THEN regexp_extract(host, '[^.]*[.][^.]*$') ELSE split_part(host, '.', -1) END) AS suffix
  FROM outcomes GROUP BY host
), domain_n AS (
  SELECT domain, suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM host_n GROUP BY domain, suffix
), suffix_n AS (
  SELECT suffix, '' AS root, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM domain_n GROUP BY suffix
), root_m AS (
  SELECT '' AS root, (coalesce(sum(bad), 0) + 1)::DOUBLE / (coalesce(sum(n), 0) + 2) AS mean FROM suffix_n
), {_shrunk_sql("suffix", "root_m", "root")}, {_shrunk_sql("domain", "suffix_up", "suffix").replace("domain_all AS", "suffix_up AS (SELECT suffix, mean FROM suffix_m), domain_all AS", 1)},
{_shrunk_sql("host", "domain_up", "domain").replace("host_all AS", "domain_up AS (SELECT domain, mean FROM domain_m), host_all AS", 1)}
SELECT page_id, host, path, rule,
       CASE WHEN bad = 1 THEN 'block' WHEN bad = 0 THEN 'allow'
            WHEN mean - 1.645 * sqrt(mean * (1 - mean) / (weight + 1)) > 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM (SELECT o.*, h.mean, h.weight FROM outcomes o JOIN host_m h ON o.host = h.host)
""".replace("__CO__", "[.](" + "|".join(url_filter.SECOND) + ")[.][^.][^.]$")

def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op8_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.compare_edited(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_trie.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_bpe": op2_bpe,
    "op3_lm": op3_lm,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_mixing": op5_mixing,
    "op6_quality": op6_quality,
    "op7_simhash": op7_simhash,
    "op8_spotsigs": op8_spotsigs,
    "op9_url_filter": op9_url_filter,
    "op10_token_counts": op10_token_counts,
}
ORACLE_SQL = {"op4_exact_dedup": OP4_SQL, "op9_url_filter": OP9_SQL}
