"""The queries of the training-data operators, each over its whole table, and their SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftql.llm import bag_minhash, bpe_automaton, lm_scoring, mixing, multi_index, prefix_counts, quality_classifier, quality_rules, secret_scan, sorted_tables
from siftql.llm._shared import materialize, read_table


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_texts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op3_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.near_vectors(read_table(spark, sf_dir, "embeddings"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality_rules.ledger(read_table(spark, sf_dir, "documents"))
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", quality_rules.rejected(quality_rules.BASE).alias("base_failed"), (~quality_rules.rejected(quality_rules.DEFAULT)).alias("kept"), "failures")


OP4_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
g AS (SELECT doc_id, i, ws[i] || chr(32) || ws[i + 1] || chr(32) || ws[i + 2] AS tri
      FROM w, unnest(range(1, len(ws) - 1)) AS t(i)),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, tri) AS c FROM g) WHERE c > 1),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM d, (VALUES (0), (1), (2)) AS o(k) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
         len(ls)::BIGINT AS n_lines, length(regexp_replace(text, '[^A-Z]+', '', 'g'))::BIGINT AS n_upper
  FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
f AS (
  SELECT *, ((n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (4 * n_symbols > n_words)::BIGINT
    + 8 * (2 * n_upper > word_chars)::BIGINT + 16 * (2 * n_dup_lines > n_lines)::BIGINT
    + 32 * (word_chars < 2 * n_words OR word_chars > 25 * n_words)::BIGINT)::BIGINT AS failures
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failures & 3) <> 0 AS base_failed, failures = 0 AS kept, failures FROM f
"""


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix tables are stored, and counts and budgets are read from them."""
    got = materialize(prefix_counts.prefix_token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), budgets=(512,)), "prefix-tables")
    return got.select("doc_id", "n_bytes", "n_tokens", prefix_counts.over_budget(F.col("n_tokens"), 512).alias("over_limit"), "chars_within_512")


def op7_sorted_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = sorted_tables.write_token_tables(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return sorted_tables.read_token_tables(spark, manifest)


def op8_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bag_minhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op9_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_automaton.encode_decode(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = secret_scan.scan(read_table(spark, sf_dir, "documents"), dictionary=public_tokenizers.path("word_bpe_49k.json"))
    return got.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base_spans"), 256).alias("base_sha256"), "spans", "n_guess")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_source_mixing, op2_lm_scoring, op3_multi_index, op4_quality_rules, op5_quality_classifier, op6_token_counts, op7_sorted_tables, op8_bag_minhash, op9_bpe_automaton, op10_secret_scan)}
ORACLE_SQL: dict[str, str] = {"op4_quality_rules": OP4_SQL}
