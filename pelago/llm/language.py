"""Operator 9: language ID by a convolutional network over bytes, trained here in numpy.

A text's UTF-8 bytes are cut into windows of ``WINDOW`` places.  In each window filters of several widths slide over
learned byte vectors, every filter keeps its largest response, and a softmax gives the shares of the languages.  A
text's answer is the mean over all its windows.  For scoring, filters become tables over byte pairs, so a window costs a
few gathers a byte.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, per_batch, text_or_empty
from .sample import bounded_sample, remainder

WINDOW = 256
REACH = 4  # the widest filter
STEP = WINDOW - REACH + 1
#: Bounds of the training sample: texts, and windows of each.
SAMPLE_TEXTS, SAMPLE_WINDOWS = 4000, 3
_LETTER = regex.compile(r"\p{L}")


def windows(raw: bytes) -> np.ndarray:
    """All windows of a text as rows of bytes; zero stands for "no byte" (a zero in the text counts as a space).  Windows
    overlap so that every run of REACH bytes lies in one."""
    b = np.frombuffer(raw, np.uint8)
    n = max(1, -(-max(len(b) - REACH + 1, 1) // STEP))
    whole = np.zeros((n - 1) * STEP + WINDOW, dtype=np.uint8)
    whole[: len(b)] = np.where(b == 0, 32, b)
    return np.lib.stride_tricks.sliding_window_view(whole, WINDOW)[::STEP]


@dataclass
class ByteNet:
    labels: list[str]
    vectors: np.ndarray  # 256 x E
    filters: dict[int, np.ndarray]  # width -> width x E x F
    bias: np.ndarray  # of all filters
    out: np.ndarray  # filters x labels
    out_bias: np.ndarray

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Responses of all filters by the first byte pair, and what the third byte and the second pair add."""
        v, f = self.vectors, self.filters
        part = {(w, i): v @ f[w][i] for w in f for i in range(w)}

        def pair(w: int, i: int) -> np.ndarray:
            return (part[w, i][:, None, :] + part[w, i + 1][None, :, :]).reshape(65536, -1)

        first = np.concatenate([pair(w, 0) for w in (2, 3, 4)], axis=1)
        return first.astype(np.float32), part[3, 2].astype(np.float32), pair(4, 2).astype(np.float32)

    def scores(self, rows: np.ndarray, tables: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """Shares of the labels for each window."""
        first, third, second = tables
        n2 = self.filters[2].shape[2]
        n3 = n2 + self.filters[3].shape[2]
        out = np.empty((len(rows), first.shape[1]), dtype=np.float32)
        for at in range(0, len(rows), 64):
            w = rows[at : at + 64]
            pairs = w[:, :-1].astype(np.int32) * 256 + w[:, 1:]
            r = np.take(first, pairs[:, :STEP], axis=0)
            r[:, :, n2:n3] += np.take(third, w[:, 2 : STEP + 2], axis=0)
            r[:, :, n3:] += np.take(second, pairs[:, 2 : STEP + 2], axis=0)
            out[at : at + 64] = r.max(axis=1)
        return _softmax(np.maximum(out + self.bias, 0) @ self.out + self.out_bias)

    @classmethod
    def fit(cls, rows: np.ndarray, y: np.ndarray, labels: list[str], dims: int = 8, per_width: int = 12, epochs: int = 6, rate: float = 0.01, seed: int = 9) -> ByteNet:
        """Train on windows with Adam; gradients pass through each filter's largest response."""
        rng = np.random.default_rng(seed)
        widths = (2, 3, 4)
        p = {"v": rng.normal(0, 0.5, (256, dims)), "b": np.zeros(per_width * len(widths)), "o": rng.normal(0, 0.2, (per_width * len(widths), len(labels))), "ob": np.zeros(len(labels))}
        p |= {w: rng.normal(0, (2 / (w * dims)) ** 0.5, (w, dims, per_width)) for w in widths}
        p = {k: x.astype(np.float32) for k, x in p.items()}
        m, s = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), 64):
                here = order[at : at + 64]
                w, t = rows[here].astype(np.int64), y[here]
                n = len(here)
                x = p["v"][w]
                best, pooled = {}, []
                for k in widths:
                    r = sum(x[:, i : i + STEP] @ p[k][i] for i in range(k))
                    best[k] = r.argmax(axis=1)
                    pooled.append(np.take_along_axis(r, best[k][:, None, :], axis=1)[:, 0])
                z = np.concatenate(pooled, axis=1) + p["b"]
                a = np.maximum(z, 0)
                g = _softmax(a @ p["o"] + p["ob"])
                g[np.arange(n), t] -= 1
                g /= n
                back = (g @ p["o"].T) * (z > 0)
                grad = {"o": a.T @ g, "ob": g.sum(0), "b": back.sum(0), "v": np.zeros_like(p["v"])}
                for c, k in enumerate(widths):
                    part = back[:, c * per_width : (c + 1) * per_width]
                    grad[k] = np.zeros_like(p[k])
                    for i in range(k):
                        bytes_at = w[np.arange(n)[:, None], best[k] + i]
                        grad[k][i] = np.einsum("nfe,nf->ef", p["v"][bytes_at], part)
                        np.add.at(grad["v"], bytes_at.ravel(), (part[:, :, None] * p[k][i].T[None]).reshape(-1, dims))
                step += 1
                for k in p:
                    m[k] = 0.9 * m[k] + 0.1 * grad[k]
                    s[k] = 0.99 * s[k] + 0.01 * grad[k] ** 2
                    p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return cls(labels, p["v"], {k: p[k] for k in widths}, p["b"], p["o"], p["ob"])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: int = 2, of: int = 4) -> ByteNet | None:
    """Train on rows with a text, a language and an id whose crc32 leaves another remainder than ``held_out``.

    The sample is bounded by ``SAMPLE_TEXTS`` texts; of each, ``SAMPLE_WINDOWS`` stretches are taken from hashed places
    anywhere in it.  Different texts of one id are texts apart, copies of a row are one.  None if there is nothing to
    learn from.
    """
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"))
    rows = rows.where("id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").where(remainder(F.col("id"), of) != held_out)
    room = F.greatest(F.length("text") - WINDOW, F.lit(1)).cast("long")
    cuts = F.array(*[F.substring("text", (F.pmod(F.xxhash64("id", F.lit(i)), room) + 1).cast("int"), F.lit(WINDOW)) for i in range(SAMPLE_WINDOWS)])
    rows = rows.select("id", "lang", F.xxhash64("text").alias("body"), cuts.alias("cuts"))
    found = bounded_sample(rows, ["id", "lang", "body"], SAMPLE_TEXTS, 9).collect()  # about SAMPLE_TEXTS short rows at most
    found.sort(key=lambda r: (r["id"], r["lang"], r["cuts"]))
    labels = sorted({r["lang"] for r in found})
    pairs = [(windows(c.encode("utf-8", "surrogatepass"))[0], labels.index(r["lang"])) for r in found for c in r["cuts"] if _LETTER.search(c)]
    if not pairs:
        return None
    return ByteNet.fit(np.stack([w for w, _ in pairs]), np.array([y for _, y in pairs]), labels)


def _predict(net: ByteNet | None, tables, texts: list[str]) -> tuple[list[str], list[float]]:
    langs, scores = ["und"] * len(texts), [0.0] * len(texts)
    which = [i for i, t in enumerate(texts) if net is not None and t and _LETTER.search(t)]
    at = 0
    while at < len(which):  # texts of about 2 MB at a time
        part, cut, size = [], [], 0
        while at < len(which) and size < 2_000_000:
            cut.append(windows(texts[which[at]].encode("utf-8", "surrogatepass")))
            part.append(which[at])
            size += cut[-1].size
            at += 1
        shares = net.scores(np.concatenate(cut), tables)
        starts = np.cumsum([0, *map(len, cut[:-1])])
        mean = np.add.reduceat(shares.astype(np.float64), starts, axis=0) / np.array([len(c) for c in cut])[:, None]
        for i, row in zip(part, mean, strict=True):
            best = int(row.argmax())
            langs[i], scores[i] = net.labels[best], min(1.0, float(row[best]))
    return langs, scores


PREDICTED = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def identify(docs: DataFrame, net: ByteNet | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` of every whole text.  Texts that are null or have no letter, and all texts where
    nothing could be learned, are ``und`` with score 0; every row gives a row."""
    tables = net.tables() if net else None
    shared = docs.sparkSession.sparkContext.broadcast((net, tables))  # of fixed size, about 20 MB

    def make(batch):
        langs, scores = _predict(*shared.value, [x or "" for x in batch.column(1).to_pylist()])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], schema=PREDICTED)

    picked = docs.select(docs[id_col].cast("long").alias("doc_id"), text_or_empty(docs[text_col]).alias("text"))
    return picked.mapInArrow(per_batch(make, PREDICTED), "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, net: ByteNet | None, floor: float = 0.4, text_col: str = "text") -> DataFrame:
    """The rows whose text has a language with a score of at least ``floor``; columns stay as they are.  Where nothing
    could be learned, the rows whose text has a letter."""
    bounded_batches(docs.sparkSession)
    tables = net.tables() if net else None
    shared = docs.sparkSession.sparkContext.broadcast((net, tables))
    at = docs.columns.index(text_col)

    def make(batch):
        langs, scores = _predict(*shared.value, [x or "" for x in batch.column(at).to_pylist()])
        if shared.value[0] is None:
            keep = [bool(x and _LETTER.search(x)) for x in batch.column(at).to_pylist()]
        else:
            keep = [a != "und" and b >= floor for a, b in zip(langs, scores, strict=True)]
        yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(per_batch(make, None), docs.schema)
