"""Operator 7: byte-level BPE, encoded by a segment tree over the ranks of adjacent pairs, and decoded.

The leaf at position p of a word's tree holds ``rank(symbol at p, next symbol) * width + p``, or "none" where that pair
has no merge.  The root of a tree of minima is therefore the lowest rank and, among equal ranks, the leftmost place.  A
merge changes three leaves (the pair itself, the pair before it, and the place that vanishes), and each costs one walk
to the root: O(log n) per merge until the root says "none".

Words are independent of one another, so the trees of many words of one width are rows of one numpy array and every
step works on all of them at once; words longer than ``WIDE`` bytes get a tree of their own.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import per_batch, text_or_empty
from .wordtable import TextCodec

#: Words of more symbols than this are merged one by one.
WIDE = 64
NONE = np.iinfo(np.int64).max

# The public byte-level alphabet shows these bytes as themselves, and the others, in order, as the
# characters from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_REST = [b for b in range(256) if b not in set(_SHOWN)]
BYTE_CHAR = {b: chr(b) for b in _SHOWN} | {b: chr(256 + i) for i, b in enumerate(_REST)}
CHAR_BYTE = {c: b for b, c in BYTE_CHAR.items()}

class SegmentTreeBPE:
    """Merges for one vocabulary file of the tokenizers library (byte-level BPE without word-end marks)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.size = max(vocab.values()) + 1 + len(spec["added_tokens"])
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.rank_of = dict(zip(keys.tolist(), range(len(keys)), strict=True))
        self.byte_id = np.array([vocab[BYTE_CHAR[b]] for b in range(256)], dtype=np.int64)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = [b""] * self.size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(CHAR_BYTE[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()

    # -- many words of one width ------------------------------------------------------------------------------------

    def _leaf(self, a: np.ndarray, b: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
        """Leaf values for pairs (a, b) at places ``at``; a symbol of -1 is no symbol."""
        key = a * self.size + b
        i = np.searchsorted(self.keys, key)
        i[i == len(self.keys)] = 0
        found = (self.keys[i] == key) & (a >= 0) & (b >= 0)
        return np.where(found, self.ranks[i] * width + at, NONE)

    def _merge_rows(self, sym: np.ndarray) -> np.ndarray:
        """Merge every row of ``sym`` (rows x width symbols, -1 after a row's end) to its end; vanished places become -1."""
        rows, width = sym.shape
        tree = np.full((rows, 2 * width), NONE, dtype=np.int64)
        tree[:, width : 2 * width - 1] = self._leaf(sym[:, :-1].ravel(), sym[:, 1:].ravel(), np.tile(np.arange(width - 1), rows), width).reshape(rows, -1)
        at = width
        while at > 1:
            tree[:, at // 2 : at] = np.minimum(tree[:, at : 2 * at : 2], tree[:, at + 1 : 2 * at : 2])
            at //= 2
        after = np.tile(np.arange(1, width + 2, dtype=np.int64), (rows, 1))  # place of the next symbol; width: none
        before = np.tile(np.arange(-1, width, dtype=np.int64), (rows, 1))
        live = np.flatnonzero(tree[:, 1] != NONE)
        while len(live):
            root = tree[live, 1]
            rank, p = np.divmod(root, width)
            q = after[live, p]
            r = after[live, q]
            sym[live, p] = self.merged[rank]
            sym[live, q] = -1
            after[live, p] = r
            before[live, r] = p  # column ``width`` takes it where there is no next symbol
            prev = before[live, p]
            follow = np.where(r < width, sym[live, np.minimum(r, width - 1)], -1)
            leaves = width + np.stack([q, p, np.maximum(prev, 0)])
            value_p = self._leaf(sym[live, p], follow, p, width)
            value_prev = np.where(prev >= 0, self._leaf(np.where(prev >= 0, sym[live, np.maximum(prev, 0)], -1), sym[live, p], prev, width), NONE)
            tree[live, leaves[0]] = NONE
            tree[live, np.where(prev >= 0, leaves[2], leaves[0])] = value_prev
            tree[live, leaves[1]] = value_p
            node = leaves >> 1
            while node[0, 0] >= 1:
                for k in range(3):
                    tree[live, node[k]] = np.minimum(tree[live, 2 * node[k]], tree[live, 2 * node[k] + 1])
                node = node >> 1
            live = live[tree[live, 1] != NONE]
        return sym

    # -- one long word ----------------------------------------------------------------------------------------------

    def _merge_long(self, sym: list[int]) -> list[int]:
        n = len(sym)
        width = 1 << (n - 1).bit_length()
        size, rank_of, merged = self.size, self.rank_of, self.merged
        none = float("inf")
        tree = [none] * (2 * width)
        for p in range(n - 1):
            rank = rank_of.get(sym[p] * size + sym[p + 1])
            if rank is not None:
                tree[width + p] = rank * width + p
        for i in range(width - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n))

        def put(p: int, value: float) -> None:
            i = width + p
            tree[i] = value
            while i > 1:
                i >>= 1
                least = min(tree[2 * i], tree[2 * i + 1])
                if tree[i] == least:
                    break
                tree[i] = least

        def pair(p: int) -> float:
            q = after[p]
            rank = rank_of.get(sym[p] * size + sym[q]) if q < n else None
            return none if rank is None else rank * width + p

        while tree[1] != none:
            rank, p = divmod(tree[1], width)
            q = after[p]
            sym[p], sym[q] = int(merged[rank]), -1
            after[p] = after[q]
            before[after[p]] = p
            put(q, none)
            put(p, pair(p))
            if before[p] >= 0:
                put(before[p], pair(before[p]))
        return [s for s in sym if s >= 0]

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each word (non-empty bytes that no merge may cross)."""
        out = [b""] * len(words)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        low = 0
        for width in (4, 8, 16, 32, WIDE):
            these = np.flatnonzero((sizes > low) & (sizes <= width))
            low = width
            for at in range(0, len(these), 8192):
                part = these[at : at + 8192]
                n = sizes[part]
                flat = np.frombuffer(b"".join([words[i] for i in part.tolist()]), dtype=np.uint8)
                sym = np.full((len(part), width), -1, dtype=np.int64)
                inside = np.arange(width) < n[:, None]
                sym[inside] = self.byte_id[flat]
                sym = self._merge_rows(sym)
                kept = sym >= 0
                ends = 4 * np.cumsum(kept.sum(1))
                ids = sym[kept].astype("<u4").tobytes()
                for i, a, b in zip(part.tolist(), np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True):
                    out[i] = ids[a:b]
        for i in np.flatnonzero(sizes > WIDE).tolist():
            out[i] = np.array(self._merge_long(self.byte_id[np.frombuffer(words[i], np.uint8)].tolist()), dtype="<u4").tobytes()
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ``ids``, special tokens included; bytes that are no UTF-8 show as U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", errors="replace")


class TextEncoder:
    """Whole texts to ids: special strings, then words by the public pattern, then the segment tree."""

    def __init__(self, path: str):
        self.bpe = SegmentTreeBPE(path)
        self.path, self._library = path, None
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.bpe.special, key=len, reverse=True))) + ")")
        self.codec = TextCodec("spaced", self.bpe.encode_words, self._whole)
        self.encode_all = self.codec.encode

    def _whole(self, text: str) -> np.ndarray:
        """A text that may hold special strings or characters beyond Latin-1, word by word."""
        if self._library is None:  # which characters are letters is a matter of the library's Unicode version
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path).pre_tokenizer
        out = []
        for segment in self.special.split(text) if self.bpe.special else [text]:
            if segment in self.bpe.special:
                out.append(self.bpe.special[segment].to_bytes(4, "little"))
            elif segment:
                out += self.bpe.encode_words([bytes(map(CHAR_BYTE.__getitem__, w)) for w, _ in self._library.pre_tokenize_str(segment)])
        return np.frombuffer(b"".join(out), dtype="<u4")

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> TextEncoder:
    """One encoder and its word cache for each Python worker."""
    return TextEncoder(path)


ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.uint32()))])
ROUND_TRIP = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids)`` of every text; null and empty texts give no ids, every input row one row (repeats too)."""

    def make(batch):
        found = encoder(path).encode_all([x or "" for x in batch.column(1).to_pylist()])
        ends = np.cumsum([0, *map(len, found)])
        ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found) if found else np.empty(0, np.uint32), pa.uint32()))
        yield pa.RecordBatch.from_arrays([batch.column(0), ids.cast(pa.list_(pa.int32()))], names=["doc_id", "ids"])

    picked = docs.select(docs[id_col].cast("long").alias("doc_id"), text_or_empty(docs[text_col]).alias("text"))
    return picked.mapInArrow(per_batch(make, ENCODED), "doc_id long, ids array<int>")


def bpe_decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(doc_id, text)`` of every row of ids, special tokens kept; null or empty ids give an empty text."""

    def make(batch):
        bpe = encoder(path).bpe
        yield {"doc_id": batch.column(0), "text": [bpe.decode(np.array(x or [], dtype=np.int64)) for x in batch.column(1).to_pylist()]}

    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
    picked = tokens.select(tokens[id_col].cast("long").alias("doc_id"), tokens[ids_col].cast("array<int>").alias("ids"))
    return picked.mapInArrow(per_batch(make, schema), "doc_id long, text string")


def bpe_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, decode the ids again, and return both as digests, in one pass without a shuffle.

    Null text: as empty (no ids; digests of the empty string).  A row comes back for every input row.
    """

    def make(batch):
        enc = encoder(path)
        if not hasattr(enc, "decimal"):
            enc.decimal = [b"%d" % i for i in range(enc.bpe.size)]
        n, ids_sha, text_sha = [], [], []
        for ids in enc.encode_all([x or "" for x in batch.column(1).to_pylist()]):
            listed = ids.tolist()
            n.append(len(listed))
            ids_sha.append(hashlib.sha256(b",".join(map(enc.decimal.__getitem__, listed))).hexdigest())
            raw = b"".join(map(enc.bpe.bytes_of.__getitem__, listed))
            try:
                raw.decode("utf-8")
            except UnicodeDecodeError:
                raw = raw.decode("utf-8", errors="replace").encode()
            text_sha.append(hashlib.sha256(raw).hexdigest())
        yield {"doc_id": batch.column(0), "n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": text_sha}

    picked = docs.select(docs[id_col].cast("long").alias("doc_id"), text_or_empty(docs[text_col]).alias("text"))
    return picked.mapInArrow(per_batch(make, ROUND_TRIP), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
