"""The queries of this subpackage and the SQL that their results are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import langid, mixing, ngram_join, packing, pii, quality, sharding, substring, topk, urlfilter


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_documents(spark, sf_dir))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir)).drop("times", "_key")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_documents(spark, sf_dir))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.held_out_predictions(_documents(spark, sf_dir))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(_documents(spark, sf_dir))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(_documents(spark, sf_dir))


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": op1_pii,
        "op2_mixing": op2_mixing,
        "op3_packing": op3_packing,
        "op4_sharding": op4_sharding,
        "op5_language": op5_language,
        "op6_near_duplicates": op6_near_duplicates,
        "op7_topk": op7_topk,
        "op8_urls": op8_urls,
        "op9_quality": op9_quality,
        "op10_passages": op10_passages,
    }


_OP7 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(range(1, len(c.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

_OP8 = r"""
WITH RECURSIVE p AS (
  SELECT page_id, url, html,
         translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), k AS (
  SELECT *, CASE WHEN contains(url, '://') THEN
      regexp_replace(host, '^www\.', '') || regexp_replace(path, '(/index\.html?|/)$', '')
      || CASE WHEN q = '' THEN '' ELSE '?' || q END END AS key
  FROM (SELECT *, array_to_string(list_filter(string_split(regexp_extract(coalesce(url, ''), '://[^?#]*\?([^#]*)', 1), '&'),
        lambda x: NOT regexp_matches(x, '^(utm_[^=&]*|ref|fbclid|gclid)=')), '&') AS q FROM p)
), r AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM k
), o AS (
  SELECT *, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS own FROM r
), e AS (
  SELECT key AS a, regexp_replace(host2, '^www\.', '') || regexp_replace(path2, '(/index\.html?|/)$', '') AS b
  FROM (
    SELECT key, lower(regexp_extract(t, '://([^/?#]*)', 1)) AS host2, regexp_extract(t, '://[^/?#]*([^?#]*)', 1) AS path2
    FROM (SELECT key, regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS t FROM k)
    WHERE contains(t, '://')
  ) WHERE key IS NOT NULL
), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(k, dst) AS (
  SELECT DISTINCT key, key FROM o WHERE own = 'block'
  UNION
  SELECT reach.k, u.b FROM reach JOIN u ON reach.dst = u.a
), bad AS (SELECT DISTINCT dst AS key FROM reach)
SELECT page_id, host, path, rule,
       coalesce(own, CASE WHEN key IN (SELECT key FROM bad) THEN 'block' ELSE 'allow' END) AS verdict
FROM o
"""

_OP9 = r"""
WITH w AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), win AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i : i + 4]) AS n
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)
), rep AS (
  SELECT doc_id, sum(least(5, i - last)) AS n
  FROM (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -5) AS last FROM win WHERE n > 1)
  GROUP BY doc_id
), m AS (
  SELECT w.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(len(l) AS BIGINT) AS n_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id
), f AS (
  SELECT m.*, g.symbols, g.length, g.lines
  FROM m JOIN (
    SELECT doc_id, max(CASE WHEN feature = 'symbols' THEN v END) AS symbols, max(CASE WHEN feature = 'length' THEN v END) AS length,
           max(CASE WHEN feature = 'lines' THEN v END) AS lines
    FROM (
      SELECT doc_id, feature, CASE WHEN v < 1024 THEN v ELSE (v >> (length(bin(v)) - 10)) << (length(bin(v)) - 10) END AS v
      FROM (
        SELECT doc_id, 'symbols' AS feature, CASE WHEN n_words > 0 THEN n_symbols * 1000 // word_chars END AS v FROM m
        UNION ALL SELECT doc_id, 'length', CASE WHEN n_words > 0 THEN word_chars * 10 // n_words END FROM m
        UNION ALL SELECT doc_id, 'lines', CASE WHEN n_words > 0 THEN n_dup_lines * 1000 // n_lines END FROM m
      )
    )
    GROUP BY doc_id
  ) g USING (doc_id)
), long AS (
  SELECT lang, source, 'symbols' AS feature, 60 AS slack, symbols AS v FROM f WHERE n_words > 0
  UNION ALL SELECT lang, source, 'length', 30, length FROM f WHERE n_words > 0
  UNION ALL SELECT lang, source, 'lines', 300, lines FROM f WHERE n_words > 0
), q AS (
  SELECT lang, source, feature, slack, count(*) AS n, quantile_disc(v, 0.25) AS q1, quantile_disc(v, 0.75) AS q3
  FROM long GROUP BY ALL
), qa AS (
  SELECT feature, quantile_disc(v, 0.25) AS q1, quantile_disc(v, 0.75) AS q3 FROM long GROUP BY ALL
), t AS (
  SELECT lang, source, feature, n + 50 AS weight,
         n * (q.q1 - 3 * (q.q3 - q.q1) - slack) + 50 * (qa.q1 - 3 * (qa.q3 - qa.q1) - slack) AS low,
         n * (q.q3 + 3 * (q.q3 - q.q1) + slack) + 50 * (qa.q3 + 3 * (qa.q3 - qa.q1) + slack) AS high
  FROM q JOIN qa USING (feature)
), j AS (
  SELECT f.*, coalesce(n_words < 10 OR 100 * n_repeat_words > 20 * n_words, false) AS base_failed,
         coalesce(symbols * s.weight < s.low OR symbols * s.weight > s.high, false)
           OR coalesce(length * c.weight < c.low OR length * c.weight > c.high, false)
           OR coalesce(lines * d.weight < d.low OR lines * d.weight > d.high, false) AS beyond
  FROM f
  LEFT JOIN t s ON s.feature = 'symbols' AND s.lang IS NOT DISTINCT FROM f.lang AND s.source IS NOT DISTINCT FROM f.source
  LEFT JOIN t c ON c.feature = 'length' AND c.lang IS NOT DISTINCT FROM f.lang AND c.source IS NOT DISTINCT FROM f.source
  LEFT JOIN t d ON d.feature = 'lines' AND d.lang IS NOT DISTINCT FROM f.lang AND d.source IS NOT DISTINCT FROM f.source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT beyond AS kept
FROM j
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_topk": _OP7, "op8_urls": _OP8, "op9_quality": _OP9}
