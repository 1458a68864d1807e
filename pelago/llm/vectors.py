"""Operator 4: near-duplicate vectors by random-hyperplane signs, exact cosines, and connected components.

A vector's sign bits against k random hyperplanes are its key in each of several tables; k follows the number of vectors
(about ``BUCKET`` a bucket) and the number of tables the wanted recall at the threshold.  Equal vectors are one class.
Within a bucket cosines are computed in double precision in blocks, and a pair counts only in the first table where its
keys meet, so nothing has to be made distinct and no task emits pairs: a row's links are added up, and a bucket's
components leave as one edge a vector.  A crowded bucket is split into blocks that are compared two by two.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import split_crowded
from .common import drop, per_batch, stored, whole_keys
from .components import named_components

BUCKET = 512
CROWDED = 4096


def tables_for(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """``(bits, tables)`` for n vectors: a pair at the threshold meets in some table with probability ``recall``."""
    bits = min(30, max(4, math.ceil(math.log2(max(n, 1) / BUCKET + 1))))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - meet))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision, without overflow on the way."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


SIGNED = pa.schema([("vec_id", pa.int64()), ("digest", pa.binary()), ("dim", pa.int32()), ("vec", pa.binary()), ("signs", pa.list_(pa.int32()))])


def _signed(vectors: DataFrame, id_col: str, vec_col: str, bits: int, tables: int, seed: int) -> DataFrame:
    """Each vector's bytes, their digest and its table keys; digest null for vectors that link with nothing."""
    kind = np.dtype("<f4" if "float" in vectors.schema[vec_col].dataType.simpleString() else "<f8")
    sql = "array<float>" if kind.itemsize == 4 else "array<double>"

    def make(batch):
        lists = batch.column(1)
        n = batch.num_rows
        sizes = np.asarray(lists.value_lengths().fill_null(0))
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(kind)  # null components become NaN
        starts = np.cumsum(sizes) - sizes
        digest, dim, vec, signs = [None] * n, [None] * n, [None] * n, [None] * n
        for d in np.unique(sizes[sizes > 0]).tolist():
            rows = np.flatnonzero(sizes == d)
            x = flat[starts[rows][:, None] + np.arange(d)]
            ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            rows, x = rows[ok], x[ok] + kind.type(0)  # -0.0 becomes 0.0
            if not len(rows):
                continue
            planes = np.random.default_rng([seed, d]).standard_normal((d, tables * bits))
            above = (unit(x) @ planes > 0).reshape(len(rows), tables, bits)
            keys = (above << np.arange(bits)).sum(axis=2).astype(np.int32)
            for i, row, key in zip(rows.tolist(), x, keys, strict=True):
                vec[i] = row.tobytes()
                digest[i], dim[i], signs[i] = hashlib.blake2b(vec[i], digest_size=16).digest(), d, key
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digest, pa.binary()), pa.array(dim, pa.int32()), pa.array(vec, pa.binary()), pa.array(signs, pa.list_(pa.int32()))], schema=SIGNED)

    picked = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vec_col].cast(sql).alias("vec"))
    return picked.mapInArrow(per_batch(make, SIGNED, 2048), "vec_id long, digest binary, dim int, vec binary, signs array<int>")


FOUND = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def _least_label(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row of each row's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, label[a], low)
        np.minimum.at(after, label[b], low)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def _bucket(x: np.ndarray, signs: np.ndarray, block: np.ndarray, table: int, one: int, two: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows at or above the threshold that have met in no table before this one."""
    left = np.flatnonzero(block == one)
    right = left if one == two else np.flatnonzero(block == two)
    found = []
    for at in range(0, len(left), 1024):
        part = left[at : at + 1024]
        near = x[part] @ x[right].T >= threshold
        if one == two:
            near &= part[:, None] < right[None, :]
        for rows in range(0, len(part), 64):  # dense groups make many pairs; a few rows' worth at a time
            i, j = np.nonzero(near[rows : rows + 64])
            i, j = part[i + rows], right[j]
            if table:
                new = np.ones(len(i), dtype=bool)
                for t in range(table):
                    new &= signs[i, t] != signs[j, t]
                i, j = i[new], j[new]
            if len(i):
                found.append((i, j))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.int64))


def near_vectors(vectors: DataFrame, threshold: float = 0.9, recall: float = 0.9995, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 4) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors``.

    ``n_links`` counts the other rows linked directly (equal vectors among them), ``component_id`` is the smallest id
    reachable, ``kept`` says whether it is the row's own.  Vectors that are null, empty, zero or hold null or non-finite
    components link with nothing; vectors of different lengths don't link.  Repeated rows count as rows of their own, and
    so do different vectors with one id.  A component is named by its smallest id, null only if all of its ids are.
    """
    bits, tables = tables_for(vectors.count(), threshold, recall)
    rows = stored(_signed(vectors, id_col, vec_col, bits, tables, seed).withColumn("row", F.monotonically_increasing_id()), "vectors-signed")
    kind = np.dtype("<f4" if "float" in vectors.schema[vec_col].dataType.simpleString() else "<f8")
    classes = stored(rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min("row").alias("rep"), F.min("vec_id").alias("id"), F.count("*").alias("n")), "vector-classes")
    one = stored(rows.join(classes.select("rep", "n"), F.col("row") == F.col("rep")).select("rep", "n", "dim", "vec", "signs"), "vector-representatives")
    keyed = one.select("*", F.posexplode("signs").alias("tab", "sign")).withColumn("key", F.col("dim").cast("long") * (1 << 32) + F.col("sign")).drop("sign", "dim")
    signs = one.select(F.posexplode("signs").alias("tab", "sign"), "dim").select("tab", (F.col("dim").cast("long") * (1 << 32) + F.col("sign")).alias("key"))
    keyed = split_crowded(keyed, ["tab", "key"], "rep", CROWDED, signs)
    keys = ["tab", "key", "one", "two"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in whole_keys(batches, keys, 8192):
            k = np.stack([whole.column(c).to_numpy() for c in keys], axis=1)
            cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist(), len(k)]
            rep, n, block = (whole.column(c).to_numpy() for c in ("rep", "n", "block"))
            vec = whole.column("vec")
            signs = np.stack(whole.column("signs").to_numpy())
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi - lo < 2:
                    continue
                rows = np.arange(lo, hi)
                x = unit(np.stack([np.frombuffer(vec[i].as_py(), dtype=kind) for i in rows.tolist()]))
                tab, _, b1, b2 = k[lo].tolist()
                i, j = _bucket(x, signs[rows], block[rows], tab, b1, b2, threshold)
                if not len(i):
                    continue
                links = np.zeros(len(rows), dtype=np.int64)
                np.add.at(links, i, n[rows[j]])
                np.add.at(links, j, n[rows[i]])
                root = _least_label(len(rows), i, j)
                some = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(rep[rows[some]]), pa.array(links[some]), pa.array(rep[rows[root[some]]])], schema=FOUND)

    dealt = keyed.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "block", "rep", "n", "vec", "signs")
    found = stored(dealt.mapInArrow(run, "node long, links long, root long"), "vector-links")
    sums = found.groupBy("node").agg(F.sum("links").alias("links"))
    components = named_components(classes.select(F.col("rep").alias("node"), "id"), found, "node", "root").withColumnRenamed("node", "member")
    of = classes.join(sums, classes["rep"] == sums["node"], "left").join(components, classes["rep"] == components["member"])
    of = stored(of.select(F.col("digest").alias("d"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "component_id"), "vector-components")
    drop(one, found)
    out = rows.select("vec_id", "digest").join(of, F.col("digest") == of["d"], "left")
    component = F.when(F.col("d").isNotNull(), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
