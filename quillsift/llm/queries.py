"""The queries of this subpackage, one ``opN_<name>`` each, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillsift.llm.common import table
from quillsift.llm.impact_search import top_k
from quillsift.llm.lm_scoring import lm_scores
from quillsift.llm.mixing import mix
from quillsift.llm.packing import best_fit_pack
from quillsift.llm.quality_classifier import quality
from quillsift.llm.quality_rules import HIGH, MIDDLE, PRIOR, REACH, quality_rules
from quillsift.llm.simhash import near_duplicates
from quillsift.llm.suffix_dedup import suffix_dedup
from quillsift.llm.token_counts import token_counts
from quillsift.llm.toxicity import toxicity


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_quality_rules": op2_quality_rules,
    "op3_simhash": op3_simhash,
    "op4_impact_search": op4_impact_search,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_token_counts": op6_token_counts,
    "op7_mixing": op7_mixing,
    "op8_packing": op8_packing,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_quality_classifier": op10_quality_classifier,
}

_INK = "[^\\x20\\x09-\\x0D]"
_RATIOS = {
    "symbol_permille": ("n_symbols", "word_chars"),
    "dup_line_permille": ("n_dup_lines", "n_lines"),
    "repeat_permille": ("n_repeat_words", "n_words"),
    "word_length_permille": ("word_chars", "n_words"),
}
_PER = ", ".join(f"CASE WHEN {w} > 0 THEN 1000 * {p} // {w} ELSE 0 END AS {r}" for r, (p, w) in _RATIOS.items())
_LONG = " UNION ALL ".join(f"SELECT lang, source, '{r}' AS feature, ({r} >> d) << d AS bucket FROM (SELECT *, greatest(length(bin({r})) - 6, 0) AS d FROM rated WHERE NOT base_failed)" for r in _RATIOS)
_CUTS = ", ".join(f"CAST(max(CASE WHEN feature = '{r}' THEN high + {REACH} * (high - middle) END) AS BIGINT) AS {r}_cut" for r in _RATIOS)
_CUT_NAMES = ", ".join(f"{r}_cut" for r in _RATIOS)
_WITHIN = " AND ".join(f"coalesce({r} <= {r}_cut, false)" for r in _RATIOS)

SQL: dict[str, str] = {
    "op2_quality_rules": f"""
WITH split AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '{_INK}+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_INK}')) AS ls
  FROM documents
), grams AS (
  SELECT rid, unnest(range(1, greatest(len(ws) - 6, 1))) AS place, unnest(list_transform(range(1, greatest(len(ws) - 6, 1)), lambda i: array_to_string(ws[i:i + 7], ' '))) AS gram FROM split
), again AS (
  SELECT rid, place FROM (SELECT rid, place, count(*) OVER (PARTITION BY rid, gram) AS n FROM grams) WHERE n > 1
), covered AS (
  SELECT rid, count(DISTINCT place + k) AS n_repeat_words FROM again, range(0, 8) AS r(k) GROUP BY rid
), base AS (
  SELECT doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(len(ls) AS BIGINT) AS n_lines
  FROM split LEFT JOIN covered USING (rid)
), rated AS (
  SELECT *, {_PER}, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base
), sketch AS (
  SELECT lang, source, feature, bucket, count(*) AS n FROM ({_LONG}) GROUP BY ALL
), whole AS (
  SELECT feature, bucket, sum(n) AS n_all, sum(sum(n)) OVER (PARTITION BY feature) AS n_total FROM sketch GROUP BY feature, bucket
), mixed AS (
  SELECT lang, source, feature, bucket, sum(w) AS w FROM (
    SELECT lang, source, feature, bucket, CAST(n AS DOUBLE) AS w FROM sketch
    UNION ALL SELECT lang, source, feature, bucket, {PRIOR}.0 * CAST(n_all AS DOUBLE) / CAST(n_total AS DOUBLE) FROM (SELECT DISTINCT lang, source, feature FROM sketch) JOIN whole USING (feature)
  ) GROUP BY ALL
), walk AS (
  SELECT *, sum(w) OVER (PARTITION BY lang, source, feature ORDER BY bucket) AS seen, sum(w) OVER (PARTITION BY lang, source, feature) AS all_w FROM mixed
), ends AS (
  SELECT lang, source, feature, seen, all_w, bucket + (1 << greatest(length(bin(bucket)) - 6, 0)) - 1 AS last FROM walk
), levels AS (
  SELECT lang, source, feature, min(last) FILTER (seen * 1000 >= all_w * {MIDDLE} - 1e-6) AS middle, min(last) FILTER (seen * 1000 >= all_w * {HIGH} - 1e-6) AS high
  FROM ends GROUP BY ALL
), cuts AS (
  SELECT lang, source, {_CUTS} FROM levels GROUP BY lang, source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_WITHIN} AS kept, {_CUT_NAMES}
FROM rated r LEFT JOIN cuts c ON r.lang IS NOT DISTINCT FROM c.lang AND r.source IS NOT DISTINCT FROM c.source
""",
    "op4_impact_search": """
WITH v AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
""",
}
