"""One query for each operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, language, packing, quality, simhash, simple8b, spans, tiff, tokencount, vectors
from .common import table
from .sample import remainder


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2048, 0)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score_quality(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.text_media(table(spark, sf_dir, "documents"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"), 0.9)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple8b.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 1)


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, bits=64, most=4)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.fit_languages(docs))
    return found.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    return spans.remove_repeated_spans(docs, removed_col="removed_sentences")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_best_fit_packing, op2_quality_classifier, op3_media_columns, op4_embedding_near_dedup, op5_token_counts, op6_token_id_output, op7_bpe_round_trip, op8_simhash_near_dedup, op9_language_id, op10_substring_dedup, pipeline]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """Operators that DuckDB's SQL can express; the others are tested against brute force in tests/llm."""
    return {
        "op4_embedding_near_dedup": OP4_SQL,
    }


# Cosines of all pairs in double precision, then components by repeated minima over links.
OP4_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), ok AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v
  WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id
  WHERE len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM ok UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b
), comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, coalesce(comp.c, v.vec_id) AS component_id, v.vec_id = coalesce(comp.c, v.vec_id) AS kept
FROM v LEFT JOIN (SELECT a, count(*) AS n FROM link GROUP BY a) n ON n.a = v.vec_id LEFT JOIN comp ON comp.a = v.vec_id
"""
