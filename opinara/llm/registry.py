"""The corpus queries and, where SQL can express them, their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.llm import chat_format, cross_polytope, html_text, mixing, piece_sampling, quality_model, quality_rules, secret_scan, simhash, warc
from opinara.session import spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(_table(spark, sf_dir, "pages"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_classes(_table(spark, sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_conversations(_table(spark, sf_dir, "conversations"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(_table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(_table(spark, sf_dir, "documents"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op8_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_table(spark, sf_dir, "documents"))


def op10_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_sampling.encode_sampled(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_cross_polytope": op1_cross_polytope,
    "op2_warc": op2_warc,
    "op3_simhash": op3_simhash,
    "op4_chat_format": op4_chat_format,
    "op5_secret_scan": op5_secret_scan,
    "op6_quality_rules": op6_quality_rules,
    "op7_html_text": op7_html_text,
    "op8_quality_model": op8_quality_model,
    "op9_mixing": op9_mixing,
    "op10_piece_sampling": op10_piece_sampling,
}

ORACLES: dict[str, str] = {
    "op2_warc": """
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
        ), r AS (
            SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS best FROM p
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN best IS DISTINCT FROM page_id AND best IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN best IS DISTINCT FROM page_id THEN best END AS refers_to
        FROM r
    """,
    "op6_quality_rules": """
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS t,
                   regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
                   list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS l
            FROM documents
        ), win AS (
            SELECT doc_id, i, array_to_string(list_slice(w, i, i + 7), ' ') AS g
            FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 7)) AS i FROM d WHERE len(w) >= 8)
        ), hit AS (
            SELECT doc_id, i FROM win
            QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
        ), cov AS (
            SELECT doc_id, count(DISTINCT i + k) AS n
            FROM hit, (SELECT unnest(generate_series(0, 7)) AS k) GROUP BY doc_id
        ), c AS (
            SELECT d.doc_id, t, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
                   length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                   len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words
            FROM d LEFT JOIN cov USING (doc_id)
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
               (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
               NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words
                    OR 100 * n_symbols > 30 * n_words
                    OR 100 * n_dup_lines > 50 * len(string_split(t, chr(10)))
                    OR 2 * word_chars < 3 * n_words OR word_chars > 25 * n_words
                    OR 100 * len(regexp_extract_all(t, '!!+')) > 40 * n_words) AS kept
        FROM c
    """,
}
