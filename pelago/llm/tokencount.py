"""Operator 5: token counts through a cache keyed by digests of the normalised content and of the tokenizer's version.

Content is normalised as the tokenizer itself does it first (null is empty; a vocabulary that changes no character, as
those with an identity normaliser, leaves the text as it is), so texts that it can't tell apart share a count and no others
do.  A count is stored once for each (SHA-256 of that, SHA-256 of the vocabulary file and the library's version).  A run
joins the digests to the cache, encodes one text for each digest that is missing, appends those counts, and reads
all counts back from the cache.  Texts are shuffled by row, never by digest, so a text with many copies is no hot key, and
only if digests are missing.
"""

from __future__ import annotations

import functools
import hashlib
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, per_batch, shared_dir, stored, text_or_empty
from .library import counter

CACHE = "digest binary, version string, n_tokens long"
COUNTED = pa.schema([("digest", pa.binary()), ("n_tokens", pa.int64())])


def tokenizer_version(path: str) -> str:
    """A digest that changes with the vocabulary file or the library that reads it."""
    if path.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + library.__version__.encode()).hexdigest()


def normaliser(path: str) -> Callable[[str], str] | None:
    """What the tokenizer does to a text before it looks for tokens; None where that is nothing."""
    if path.endswith(".model"):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        norm = spec.normalizer_spec
        if not norm.precompiled_charsmap and not norm.remove_extra_whitespaces:
            return None
        return sentencepiece.SentencePieceNormalizer(model_file=path).normalize
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path).normalizer
    return None if found is None else found.normalize_str


def _digests(docs: DataFrame, path: str, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text, digest`` of every row."""
    text = text_or_empty(docs[text_col])
    picked = docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    if normaliser(path) is None:
        return picked
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("digest", pa.binary())])

    def make(batch):
        change = _normaliser(path)
        digests = [hashlib.sha256(change(x or "").encode()).digest() for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.string()), pa.array(digests, pa.binary())], schema=schema)

    return picked.select("doc_id", "text").mapInArrow(per_batch(make, schema), "doc_id long, text string, digest binary")


@functools.lru_cache(maxsize=2)
def _normaliser(path: str) -> Callable[[str], str]:
    """One for each Python worker."""
    return normaliser(path)


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """``(digest, n_tokens)`` stored for ``version``; empty where there is no cache yet."""
    try:
        held = spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        held = spark.createDataFrame([], CACHE)
    return held.where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, path: str, cache: str | None = None, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row; null texts count as empty (0 tokens).

    ``cache`` is a folder that outlives the run (None: a new one in the shared folder).  Repeated rows, null ids and
    extra columns change nothing: every input row gives one row.
    """
    spark = docs.sparkSession
    cache = cache or f"{shared_dir(spark)}/token-counts-{uuid.uuid4().hex}"
    version = tokenizer_version(path)
    found = _digests(docs, path, id_col, text_col)
    rows = found.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    known = read_cache(spark, cache, version)
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    asked = rows.groupBy("digest").agg(F.min(key).alias("row"))
    misses = stored(asked.join(known, "digest", "left_anti"), "token-misses")
    todo = found.withColumn("row", key).join(misses, ["row", "digest"], "left_semi").select("digest", "text")

    def make(batch):
        found = counter(path)
        texts = [x or "" for x in batch.column(1).to_pylist()]
        counts = found.counts(texts) if hasattr(found, "counts") else [len(x) for x in found.encode(texts)]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.binary()), pa.array(counts, pa.int64())], schema=COUNTED)

    if misses.head(1):
        new = todo.mapInArrow(per_batch(make, COUNTED), "digest binary, n_tokens long")
        new.select("digest", F.lit(version).alias("version"), "n_tokens").write.mode("append").parquet(cache)
    drop(misses)
    counts = stored(read_cache(spark, cache, version), "token-counts-read")
    return rows.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
