"""The corpus pipeline: language ID, quality, near duplicates, repeated passages, packing.

Each stage gets what its predecessor kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pelago.llm import language, packing, quality, simhash, spans
from pelago.llm.common import drop, scratch, stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose language can't be told: no letters, or no language that gets a share of 0.4."""
    return language.keep_identified(docs, language.fit_languages(docs))


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that the classifier, learned from the labels of this stage's documents, takes for bad."""
    return quality.keep_good(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    return simhash.keep_one(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sentences covered by a run that occurred before are taken out of the texts."""
    return spans.remove_repeated_spans(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents' tokens placed in sequences of 2048."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 2048, 0)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("quality", classify_quality),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("packing", pack_sequences),
]

#: SQL can't express the trained stages.  tests/llm holds run()'s rows against the models' own decisions, all pairs of texts,
#: all runs of sentences and the tokenizer's library on a small corpus.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(lambda name=name, stage=stage, docs=docs: stored(stage(spark, docs, sf_dir), f"pipeline-{name}")) as after:
            if name != STAGES[0][0]:
                drop(docs)
            docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
