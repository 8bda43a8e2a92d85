"""The thin queries of the operators, over their whole tables with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from glossa.llm import bpe, chat, exact_dedup, mixing, pii, quality_classifier, quality_rules, sharding, simhash, substring_dedup
from glossa.llm.common import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_spans(table(spark, sf_dir, "documents"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(exact_dedup.in_two_batches(table(spark, sf_dir, "documents")))


def op7_kd_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_format(table(spark, sf_dir, "conversations"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


#: Whitespace of the contracts as an RE2 class, and the uniform of an id as in the operator.
ORACLE: dict[str, str] = {
    "op3_mix_sources": r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
k AS (
  SELECT doc_id, source, size,
    -ln((CAST(('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12)) AS BIGINT) + 0.5) / 281474976710656.0::DOUBLE)
      / (1.0::DOUBLE / (1.0::DOUBLE + abs(length(t)::DOUBLE / greatest(size, 1) - 6.5::DOUBLE) / 6.5::DOUBLE)) AS key FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY source),
w AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0))
      / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level
  FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT *, first_value(level) OVER (ORDER BY (CASE WHEN level * w < cap THEN 0 ELSE 1 END), cap / w, source NULLS LAST) AS lv, max(CASE WHEN level * w < cap THEN 1 ELSE 0 END) OVER () AS any_held FROM l),
p AS (SELECT source, source_size, round(CASE WHEN any_held = 0 THEN cap ELSE least(lv * w, cap) END, 6) AS target FROM h),
r AS (
  SELECT k.doc_id, k.size, p.source_size, p.target,
    CAST(CASE WHEN p.source_size > 0 THEN floor(p.target / p.source_size) ELSE 0 END AS BIGINT) AS e,
    CAST(coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ahead
  FROM k JOIN p ON k.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
  CAST(e * size + greatest(0, least(size, CAST(floor(target + 1e-6) AS BIGINT) - e * source_size - ahead)) AS BIGINT) AS taken FROM r""",
    "op9_chat_format": r"""
WITH u AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
t AS (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM u),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, alone ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k, count(*) OVER (PARTITION BY conv_id, alone) AS n,
    coalesce(role, chr(1)) || chr(2) || coalesce(text, chr(1)) || chr(3) AS enc FROM t),
p AS (
  SELECT conv_id, k, n, string_agg(enc, '') OVER (PARTITION BY conv_id, alone ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pre,
    string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || replace(coalesce(text, ''), '<|', '< |') || '<|im_end|>' || chr(10), '')
      OVER (PARTITION BY conv_id, alone ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS chat FROM o),
w AS (SELECT n AS n_turns, pre, any_value(chat) AS chat, min(conv_id) AS conv_id, count(*) AS n_copies FROM p WHERE k = n GROUP BY n, pre)
SELECT conv_id, n_turns, n_copies, chat FROM w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.k < p.n AND p.k = w.n_turns AND p.pre = w.pre)""",
    "op6_exact_dedup": r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM d""",
}
