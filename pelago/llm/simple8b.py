"""Operator 6: token ids as Simple-8b words in shard files, written in document order and read back.

A 64-bit word is a 4-bit selector and 60 bits that hold as many ids as the selector says.  Ids go in blocks of ``BLOCK``;
a block's last word may be padded, and the offset of each block's first word is kept, so all blocks are packed and
unpacked side by side with numpy.  A value over 60 bits is an escape: a zero in the words, and place and value in a list.
A shard is one binary value of a Parquet table, so writing needs no file system but Spark's, and commits are Spark's.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, text_or_empty
from .library import tokenizer

BLOCK = 1024
SHARD_IDS = 1 << 19
MAGIC = b"S8B1"
_HEAD = struct.Struct("<4sIQQQQ")

# Fixed values of the format: selector -> (values in a word, bits of each).
SELECTORS = ((240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
_COUNT = np.array([c for c, _ in SELECTORS])
_BITS = [b for _, b in SELECTORS]


def _bit_lengths(v: np.ndarray) -> np.ndarray:
    high = v >> np.uint64(32)
    big = high > 0
    out = np.frexp((v & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]
    if big.any():
        out[big] = 32 + np.frexp(high[big].astype(np.float64))[1]
    return out.astype(np.uint8)


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(words, first word of each block and the end, escapes as (place, value) rows)`` of unsigned 64-bit values."""
    v = np.ascontiguousarray(values, dtype=np.uint64)
    large = np.flatnonzero(v >> np.uint64(60))
    escapes = np.stack([large.astype(np.uint64), v[large]], axis=1) if len(large) else np.empty((0, 2), np.uint64)
    if len(large):
        v = v.copy()
        v[large] = 0
    blocks = -(-len(v) // BLOCK)
    flat = np.zeros(blocks * BLOCK + 240, dtype=np.uint64)
    flat[: len(v)] = v
    size = np.full(blocks, BLOCK, dtype=np.int64)
    if blocks:
        size[-1] = len(v) - (blocks - 1) * BLOCK
    bits = np.zeros((blocks, BLOCK + 240), dtype=np.uint8)
    bits[:, :BLOCK] = _bit_lengths(flat[: blocks * BLOCK]).reshape(blocks, BLOCK)
    runs = {1: bits}  # runs[n][:, i]: the most bits of n values from i on (columns past the block are zero)
    while (n := max(runs)) < 128:
        wide = bits.copy() if n == 1 else runs[n].copy()
        np.maximum(runs[n][:, :-n], runs[n][:, n:], out=wide[:, :-n])
        runs[2 * n] = wide
    selector = np.full((blocks, BLOCK), 15, dtype=np.uint8)
    for s in range(14, -1, -1):
        count, most = SELECTORS[s]
        p = 1 << (count.bit_length() - 1)
        span = np.maximum(runs[p][:, :BLOCK], runs[p][:, count - p : count - p + BLOCK])
        selector[span <= most] = s
    place, rows = np.zeros(blocks, dtype=np.int64), np.arange(blocks)
    found_row, found_at = [], []
    while len(rows):
        at = place[rows]
        found_row.append(rows)
        found_at.append(at)
        at = at + _COUNT[selector[rows, at]]
        place[rows] = at
        rows = rows[at < size[rows]]
    row = np.concatenate(found_row) if found_row else np.empty(0, np.int64)
    at = np.concatenate(found_at) if found_at else np.empty(0, np.int64)
    order = np.argsort(row, kind="stable")
    row, at = row[order], at[order]
    chosen = selector[row, at]
    words = chosen.astype(np.uint64) << np.uint64(60)
    base = row * BLOCK + at
    end = row * BLOCK + BLOCK
    for s in range(2, 16):
        here = np.flatnonzero(chosen == s)
        for i in range(SELECTORS[s][0] if len(here) else 0):
            j = base[here] + i
            words[here] |= np.where(j < end[here], flat[j], 0) << np.uint64(i * _BITS[s])
    return words, np.searchsorted(row, np.arange(blocks + 1)), escapes


def decode(words: np.ndarray, offsets: np.ndarray, total: int, escapes: np.ndarray) -> np.ndarray:
    """The ``total`` values of :func:`encode`'s words; every word unpacks on its own from its block's offset."""
    chosen = (words >> np.uint64(60)).astype(np.int64)
    counts = _COUNT[chosen]
    blocks = len(offsets) - 1
    row = np.repeat(np.arange(blocks), np.diff(offsets))
    sums = np.cumsum(counts) - counts
    at = row * BLOCK + sums - sums[offsets[:-1]][row] if blocks else sums
    out = np.zeros(blocks * BLOCK + 240, dtype=np.uint64)
    end = np.minimum((row + 1) * BLOCK, total)
    for s in range(2, 16):
        here = np.flatnonzero(chosen == s)
        count, bits = SELECTORS[s]
        for i in range(count if len(here) else 0):
            j = at[here] + i
            inside = j < end[here]
            out[j[inside]] = (words[here[inside]] >> np.uint64(i * bits)) & np.uint64((1 << bits) - 1)
    out = out[:total]
    if len(escapes):
        out[escapes[:, 0].astype(np.int64)] = escapes[:, 1]
    return out


def pack_shard(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """A shard's bytes: head, document ids and counts, block offsets, escapes, words."""
    flat = np.concatenate(ids) if ids else np.empty(0, np.uint32)
    words, offsets, escapes = encode(flat)
    docs = np.array([x or 0 for x in doc_ids], dtype="<i8")
    null = np.array([x is None for x in doc_ids], dtype=np.uint8)
    counts = np.fromiter(map(len, ids), dtype="<u8", count=len(ids))
    head = _HEAD.pack(MAGIC, BLOCK, len(docs), len(flat), len(words), len(escapes))
    return b"".join([head, docs.tobytes(), null.tobytes(), counts.tobytes(), offsets.astype("<u8").tobytes(), escapes.astype("<u8").tobytes(), words.astype("<u8").tobytes()])


def open_shard(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """``(document ids, counts, all ids)`` of a shard's bytes."""
    magic, block, n_docs, total, n_words, n_escapes = _HEAD.unpack_from(data)
    if magic != MAGIC or block != BLOCK:
        raise ValueError("not a Simple-8b shard of this version")
    at = _HEAD.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, dtype=kind, count=count, offset=at)
        at += out.nbytes
        return out

    docs, null, counts = take("<i8", n_docs), take("u1", n_docs), take("<u8", n_docs)
    offsets = take("<u8", -(-total // BLOCK) + 1).astype(np.int64)
    escapes, words = take("<u8", 2 * n_escapes).reshape(-1, 2), take("<u8", n_words)
    return [None if n else x for x, n in zip(docs.tolist(), null.tolist(), strict=True)], counts.astype(np.int64), decode(words, offsets, total, escapes)


SHARDS = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("data", pa.large_binary())])


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, append ``end_id``, and write shards in ascending document order under ``path``.

    Texts of equal ids are ordered by their hash and then themselves, null ids come first, null texts hold just the end
    id.  Rows with one id, or copies of a row, may lie in several partitions, so none of them has to hold them all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, before = TaskContext.get().partitionId(), 0, 0
        held_docs: list[int | None] = []
        held: list[np.ndarray] = []
        size = 0

        def close():
            nonlocal shard, before, held_docs, held, size
            row = {"part": [part], "shard": [shard], "before": [before], "n_ids": [size], "data": [pack_shard(held_docs, held)]}
            shard, before, held_docs, held, size = shard + 1, before + size, [], [], 0
            return pa.RecordBatch.from_pydict(row, schema=SHARDS)

        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                for doc, ids in zip(batch.column(0).to_pylist(), tokenizer(vocabulary).encode([x or "" for x in batch.column(1).to_pylist()]), strict=True):
                    held_docs.append(doc)
                    held.append(np.append(ids, np.uint32(end_id)).astype(np.uint32))
                    size += len(held[-1])
                    if size >= SHARD_IDS:
                        yield close()
        if held:
            yield close()

    text = text_or_empty(docs[text_col])
    picked = docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("body"), F.monotonically_increasing_id().alias("row"))
    ordered = picked.repartitionByRange("doc_id", "body", "row").sortWithinPartitions("doc_id", "body", "text").select("doc_id", "text")
    ordered.mapInArrow(run, "part int, shard int, before long, n_ids long, data binary").write.parquet(path)


TOKENS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the shards under ``path``: ``doc_id, start, n_tokens, ids_crc32``, all from the files.

    ``start`` counts the ids of all documents before it.  The sums of the write's partitions (a row for each of its
    tasks) are added up on the driver; places within a partition are in its shards.
    """
    shards = spark.read.schema("part int, shard int, before long, n_ids long, data binary").parquet(path)
    sums = sorted((r["part"], r["n"]) for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    total, first = 0, []
    for part, n in sums:
        first.append((part, total))
        total += n
    starts = F.broadcast(spark.createDataFrame(first, "part int, first long"))  # a row for each task that wrote

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                docs, counts, ids = open_shard(data.as_py())
                ids = ids.astype("<u4")
                ends = np.cumsum(counts)
                crc = [zlib.crc32(ids[e - n : e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(base + ends - counts), pa.array(counts), pa.array(crc, pa.int64())], schema=TOKENS)

    placed = shards.join(starts, "part").select((F.col("first") + F.col("before")).alias("base"), "data")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """Write the documents' shards into the shared folder and return what they hold."""
    path = f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, vocabulary, end_id)
    return read_tokens(docs.sparkSession, path)
