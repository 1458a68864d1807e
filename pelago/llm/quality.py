"""Operator 2: a factorisation machine for text quality.

Features are hashed words (each distinct word of a text once, all together of length 1), statistics of the text's
structure, and its recorded size.  A score is ``w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)``: all
pairwise interactions, at low rank, in time linear in the number of features.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, per_batch, text_or_empty
from .sample import bounded_sample, remainder
from .wordtable import _M1, _M2, KEPT_BYTES, Words

HASHED_BITS = 15
RANK = 6
#: Bound of the training sample.
SAMPLE_TEXTS = 6000
STATS = ("upper", "digit", "mark", "symbol", "blank", "line", "high", "word_length", "long_words", "distinct", "most_common", "size", "recorded_size", "marked_words")
_SETS = {"upper": range(65, 91), "digit": range(48, 58), "mark": b".,;:!?'\"", "symbol": b"#$%&*|<>{}[]=+~^@\\/_", "blank": b" \t", "line": b"\n", "high": range(128, 256)}
_IS = np.zeros((len(_SETS), 256), dtype=bool)
for _i, _s in enumerate(_SETS.values()):
    _IS[_i, list(_s)] = True


def features(texts: list[str], recorded: list[int | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(text number, hashed word, value, statistics)``: sparse words and a dense row for each text."""
    n = len(texts)
    words = Words([t.encode("utf-8", "surrogatepass") for t in texts])
    b = words.raw
    starts = words.ends - words.sizes
    counted = np.add.reduceat(_IS[:, b[: words.stop]], starts, axis=1, dtype=np.int64)
    share = counted / np.maximum(words.sizes, 1)
    b[(b >= 9) & (b <= 13)] = 32
    b[(b >= 65) & (b <= 90)] += 32
    at, sizes = words.blanks()
    doc = np.searchsorted(words.ends, at)
    k1, k2 = words.keys(at, np.minimum(sizes, KEPT_BYTES))
    h = (k1 ^ (k2 * _M2)) * _M1
    for i in np.flatnonzero(sizes > KEPT_BYTES).tolist():  # rare; their keys tell apart the first bytes only
        h[i] = xxhash.xxh64_intdigest(b[at[i] : at[i] + sizes[i]].tobytes())
    h = ((h ^ (h >> np.uint64(32))) * _M2 >> np.uint64(64 - HASHED_BITS)).astype(np.int64)
    key, times = np.unique(doc << HASHED_BITS | h, return_counts=True)
    row, col = key >> HASHED_BITS, key & ((1 << HASHED_BITS) - 1)
    total = np.bincount(doc, minlength=n)
    distinct = np.bincount(row, minlength=n)
    most = np.zeros(n, dtype=np.int64)
    np.maximum.at(most, row, times)
    some = np.maximum(total, 1)
    last = b[at + sizes - 1] if len(at) else np.empty(0, np.uint8)
    stats = np.stack([
        *share, np.bincount(doc, weights=np.minimum(sizes, 20), minlength=n) / some / 20, np.bincount(doc, weights=sizes > 20, minlength=n) / some,
        distinct / np.sqrt(some * np.maximum(some, 30)), most / some, np.log2(some + 1) / 16, np.array([np.log2((x or 0) + 1) / 20 if (x or 0) >= 0 else 0 for x in recorded]),
        np.bincount(doc, weights=_IS[2, last] | _IS[3, last], minlength=n) / some,
    ], axis=1)
    return row, col, (1 / np.sqrt(np.maximum(distinct, 1)))[row], stats


@dataclass
class FactorisationMachine:
    w0: float
    w: np.ndarray  # hashed words, then statistics
    v: np.ndarray  # the same x RANK
    mean: np.ndarray
    spread: np.ndarray

    def _dense(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.spread, -4, 4) / np.sqrt(stats.shape[1])

    def score(self, row: np.ndarray, col: np.ndarray, x: np.ndarray, stats: np.ndarray) -> np.ndarray:
        """Chances of label 1, by the sum-of-squares identity."""
        n, words = len(stats), 1 << HASHED_BITS
        d = self._dense(stats)
        z = self.w0 + np.bincount(row, weights=self.w[col] * x, minlength=n) + d @ self.w[words:]
        for f in range(self.v.shape[1]):
            vx = self.v[col, f] * x
            s = np.bincount(row, weights=vx, minlength=n) + d @ self.v[words:, f]
            q = np.bincount(row, weights=vx * vx, minlength=n) + (d * d) @ (self.v[words:, f] ** 2)
            z += 0.5 * (s * s - q)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    @classmethod
    def fit(cls, rows: list[tuple[np.ndarray, np.ndarray]], stats: np.ndarray, y: np.ndarray, epochs: int = 12, rate: float = 0.05, seed: int = 2) -> FactorisationMachine:
        """Adagrad over single texts' (words, values), statistics and labels; the two labels weigh the same at most 3:1."""
        rng = np.random.default_rng(seed)
        words, size = 1 << HASHED_BITS, (1 << HASHED_BITS) + stats.shape[1]
        ok = max(float(y.mean()), 1e-3)
        model = cls(float(np.log(ok / max(1 - ok, 1e-3))), np.zeros(size), rng.normal(0, 0.05, (size, RANK)), stats.mean(0), stats.std(0) + 1e-6)
        dense = model._dense(stats)
        tail = np.arange(words, size)
        weight = np.where(y == 1, 1.0, min(3.0, ok / max(1 - ok, 1e-3)))
        gw, gv, g0 = np.full(size, 1e-2), np.full((size, RANK), 1e-2), 1.0
        for _ in range(epochs):
            for i in rng.permutation(len(y)).tolist():
                col = np.concatenate([rows[i][0], tail])
                x = np.concatenate([rows[i][1], dense[i]])
                v = model.v[col]
                s = x @ v
                z = model.w0 + x @ model.w[col] + 0.5 * float(s @ s - (x * x) @ (v * v).sum(1))
                g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[i]) * weight[i]
                dw = g * x + 1e-5 * model.w[col]
                dv = g * x[:, None] * (s - x[:, None] * v) + 1e-4 * v
                gw[col] += dw * dw
                gv[col] += dv * dv
                g0 += g * g
                model.w0 -= rate * g / np.sqrt(g0)
                model.w[col] -= rate * dw / np.sqrt(gw[col])
                model.v[col] -= rate * dv / np.sqrt(gv[col])
        return model


SPARSE = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("col", pa.list_(pa.int32())), ("x", pa.list_(pa.float32())), ("stats", pa.list_(pa.float64()))])


def _recorded(docs: DataFrame, chars_col: str | None):
    return docs[chars_col].cast("long") if chars_col in docs.columns else F.lit(None).cast("long")


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", label_col: str = "quality", held_out: int = 1, of: int = 3) -> FactorisationMachine | None:
    """Learn from labelled rows whose id's crc32 leaves another remainder than ``held_out``.

    At most about ``SAMPLE_TEXTS`` texts are taken, and only their features reach the driver.  Null labels and ids teach
    nothing; of several labels for an id the larger counts; different texts of one id are texts apart, copies of a row are
    one.  None if there is nothing to learn from.
    """
    marked = labels.select(labels[id_col].cast("long").alias("id"), labels[label_col].cast("int").alias("label"))
    marked = marked.where("id IS NOT NULL AND label IS NOT NULL").where(remainder(F.col("id"), of) != held_out).groupBy("id").agg((F.max("label") > 0).cast("int").alias("label"))
    text = text_or_empty(docs[text_col])
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(text, _recorded(docs, chars_col)).alias("body"), text.alias("text"), _recorded(docs, chars_col).alias("recorded"))
    keys = texts.select("doc_id", "body").join(marked, F.col("doc_id") == F.col("id")).select("id", "body", "label")
    chosen = bounded_sample(keys, ["id", "body"], SAMPLE_TEXTS, 2).withColumnRenamed("body", "of")

    def make(batch):
        row, col, x, stats = features([t or "" for t in batch.column(2).to_pylist()], batch.column(3).to_pylist())
        cut = np.searchsorted(row, np.arange(batch.num_rows + 1))
        lists = [[a[i:j] for i, j in zip(cut[:-1], cut[1:], strict=True)] for a in (col.astype(np.int32), x.astype(np.float32))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lists[0], SPARSE[2].type), pa.array(lists[1], SPARSE[3].type), pa.array(list(stats), SPARSE[4].type)], schema=SPARSE)

    joined = texts.join(F.broadcast(chosen), (F.col("doc_id") == F.col("id")) & (F.col("body") == F.col("of")))  # about SAMPLE_TEXTS rows
    joined = joined.groupBy("doc_id", "body").agg(F.first("label").alias("label"), F.first("text").alias("text"), F.first("recorded").alias("recorded")).select("doc_id", "label", "text", "recorded")
    found = joined.mapInArrow(per_batch(make, SPARSE), "doc_id long, label int, col array<int>, x array<float>, stats array<double>").toArrow()
    found = found.take(np.lexsort([*np.array(found.column("stats").to_pylist(), dtype=np.float64).reshape(found.num_rows, -1).T, found.column("doc_id").to_numpy()])) if found.num_rows else found
    if not found.num_rows or len(set(found.column("label").to_pylist())) < 2:
        return None
    rows = [(np.asarray(a.values), np.asarray(b.values, dtype=np.float64)) for a, b in zip(found.column("col"), found.column("x"), strict=True)]
    return FactorisationMachine.fit(rows, np.array(found.column("stats").to_pylist()), np.array(found.column("label").to_pylist(), dtype=np.float64))


def _chances(model: FactorisationMachine | None, texts: list[str], recorded: list[int | None]) -> np.ndarray:
    if model is None:
        return np.ones(len(texts))
    return model.score(*features(texts, recorded))


SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])


def score_quality(docs: DataFrame, model: FactorisationMachine | None, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """``doc_id, score, predicted`` of every whole text; null texts count as empty, and an empty text is scored by its
    statistics alone.  Without a model every score is 1.  Every row gives a row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size, about 2 MB

    def make(batch):
        score = _chances(shared.value, [t or "" for t in batch.column(1).to_pylist()], batch.column(2).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], schema=SCORED)

    picked = docs.select(docs[id_col].cast("long").alias("doc_id"), text_or_empty(docs[text_col]).alias("text"), _recorded(docs, chars_col).alias("recorded"))
    return picked.mapInArrow(per_batch(make, SCORED, 256), "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, model: FactorisationMachine | None, floor: float = 0.5, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The rows whose text scores at least ``floor``; columns stay as they are."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    at, size = names.index(text_col), names.index(chars_col) if chars_col in names else None

    def make(batch):
        recorded = batch.column(size).to_pylist() if size is not None else [None] * batch.num_rows
        yield batch.filter(pa.array(_chances(shared.value, [t or "" for t in batch.column(at).to_pylist()], recorded) >= floor))

    return docs.mapInArrow(per_batch(make, None, 256), docs.schema)
