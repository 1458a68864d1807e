"""Whole texts to token ids, a batch of texts at a time, with numpy over their bytes.

The words of a tokenizer (which no merge may cross) are found by comparing the classes of neighbouring bytes.  Words of up
to 15 bytes are keyed by 128 bits that hold all of them and their number, so two words never share a key, and are looked up
in an open-addressed table of numpy arrays; longer ones are rare and are looked up by their bytes.  Only words not seen
before go to the tokenizer's own merge step.  Both tables are bounded; a full one is emptied and learned anew, which costs
time and never changes a result.  Texts beyond Latin-1, with rare white space or with special strings go to the tokenizer
whole.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

SPACE, LETTER, DIGIT, OTHER, END = range(5)
#: Words of so many bytes are their own key; longer ones are looked up by their bytes, and those over KEPT_BYTES are
#: encoded each time and never kept.
OWN_KEY_BYTES, KEPT_BYTES = 15, 64
#: Words kept by their bytes, about 250 bytes each.
LONG_WORDS = 1 << 16

_CLASS = np.full(256, OTHER, dtype=np.uint8)
for _c in range(256):
    if _c in (9, 10, 11, 12, 13, 32, 0x85, 0xA0):
        _CLASS[_c] = SPACE
    elif chr(_c).isalpha():
        _CLASS[_c] = LETTER
    elif chr(_c).isnumeric():
        _CLASS[_c] = DIGIT
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [2**64 - 1], dtype=np.uint64)


def is_plain(text: str, special: str = "<|") -> bool:
    """Whether the byte classes decide this text's words: Latin-1, no two-byte white space, no special string."""
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        if "\x85" in text or "\xa0" in text:
            return False
    return special not in text


class Words:
    """Starts and lengths of the words of several texts in one buffer, and the text each belongs to."""

    def __init__(self, texts: list[bytes]):
        self.sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.raw = np.frombuffer(b"\0".join(texts) + b"\0" * 9, dtype=np.uint8).copy()
        self.ends = np.cumsum(self.sizes + 1) - 1  # places of the separators
        self.stop = int(self.ends[-1]) + 1

    def classes(self) -> np.ndarray:
        b = self.raw[: self.stop]
        cls = _CLASS[b]
        lead = np.flatnonzero(b >= 0xC2)
        if len(lead):
            cls[lead] = cls[lead + 1] = _CLASS[((b[lead] & 3) << 6) | (b[lead + 1] & 63)]
        cls[self.ends] = END
        return cls

    def _apostrophes(self, cls: np.ndarray, after_space: bool) -> list[tuple[np.ndarray, int]]:
        """Places of apostrophes that begin 's 't 'm 'd 're 've 'll, with the number of letters."""
        b = self.raw
        at = np.flatnonzero(b[: self.stop] == 39)
        if not len(at):
            return []
        at = at[cls[at] != END]
        before = np.where(at > 0, cls[at - 1], END)
        ok = before != OTHER
        if not after_space:
            ok &= (at == 0) | (b[at - 1] != 32) | (before == END)
        at = at[ok]
        x, y = b[at + 1], b[at + 2]
        one = np.isin(x, np.frombuffer(b"stmd", np.uint8))
        two = ((x == 114) | (x == 118)) & (y == 101) | (x == 108) & (y == 108)
        return [(at[one], 1), (at[two], 2)]

    def spaced(self) -> tuple[np.ndarray, np.ndarray]:
        """Words of the byte-level pattern: one space belongs to the run of letters, digits or marks after it."""
        cls, b = self.classes(), self.raw
        start = np.empty(len(cls), dtype=bool)
        start[0] = True
        np.not_equal(cls[1:], cls[:-1], out=start[1:])
        e = np.flatnonzero((cls[1:] != SPACE) & (cls[1:] != END) & (cls[:-1] == SPACE)) + 1
        start[e - 1] = True
        start[e] = b[e - 1] != 32
        for at, n in self._apostrophes(cls, False):
            start[at + 1] = False
            start[at + 1 + n] = True
        start[self.ends] = True
        return self._cut(start, cls != END)

    def unspaced(self) -> tuple[np.ndarray, np.ndarray]:
        """Words of the pattern that drops white space and takes digits one by one; ASCII and Latin-1 letters are folded in place."""
        b = self.raw
        upper = (b >= 65) & (b <= 90)
        b[upper] += 32
        lead = np.flatnonzero(b[: self.stop] == 0xC3)
        if len(lead):
            low = b[lead + 1]
            b[lead[(low >= 0x80) & (low <= 0x9E) & (low != 0x97)] + 1] += 32
        cls = self.classes()
        start = np.empty(len(cls), dtype=bool)
        start[0] = True
        np.not_equal(cls[1:], cls[:-1], out=start[1:])
        start |= (cls == DIGIT) & ((b[: self.stop] < 0x80) | (b[: self.stop] >= 0xC0))
        for at, n in self._apostrophes(cls, True):
            start[at + 1] = False
            start[at + 1 + n] = True
        start[self.ends] = True
        return self._cut(start, (cls != END) & (cls != SPACE))

    def blanks(self) -> tuple[np.ndarray, np.ndarray]:
        """Words between single spaces, whatever else they hold."""
        b = self.raw[: self.stop]
        start = np.empty(len(b), dtype=bool)
        start[0] = True
        gap = b == 32
        gap[self.ends] = True
        start[1:] = gap[:-1] | gap[1:]
        return self._cut(start, ~gap)

    def _cut(self, start: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(start)
        sizes = np.diff(at, append=self.stop)
        keep = wanted[at]
        return at[keep], sizes[keep]

    def keys(self, at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits for each word of at most KEPT_BYTES bytes: its bytes and their number up to OWN_KEY_BYTES, and no other
        such word has them; beyond, a mix of its bytes that others may share."""
        lanes = np.ndarray(shape=(len(self.raw) - 7,), dtype="<u8", buffer=self.raw, strides=(1,))
        k1 = lanes[at] & _MASKS[np.minimum(sizes, 8)]
        k2 = sizes.astype(np.uint64) << np.uint64(56)
        more = np.flatnonzero(sizes > 8)
        k2[more] ^= lanes[at[more] + 8] & _MASKS[np.minimum(sizes[more] - 8, 8)]
        for j in range(16, KEPT_BYTES, 8):
            more = more[sizes[more] > j]
            if not len(more):
                break
            lane = lanes[at[more] + j] & _MASKS[np.minimum(sizes[more] - j, 8)]
            k1[more] = _mix((k1[more] ^ lane) * _M1)
            k2[more] = _mix((k2[more] + lane) * _M2)
        return k1, k2


def _mix(x: np.ndarray) -> np.ndarray:
    return x ^ (x >> np.uint64(29))


class WordTable:
    """Ids of words; ``encode_new`` gets distinct words and returns each one's little-endian 32-bit ids."""

    def __init__(self, encode_new: Callable[[list[bytes]], list[bytes]], bits: int = 20):
        self.encode_new, self.bits = encode_new, bits
        self.long: dict[bytes, bytes] = {}
        self._empty()

    def _empty(self) -> None:
        n = 1 << self.bits
        self.k1, self.k2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        self.at, self.size = np.full(n, -1, np.int32), np.zeros(n, np.int32)
        self.pool, self.used, self.words = np.empty(n, np.uint32), 0, 0

    def _slot(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        h = (k1 ^ (k2 * _M3)) * _M1
        return ((h ^ (h >> np.uint64(32))) * _M2 >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        """The slot of each key, or -1."""
        slot = self._slot(k1, k2)
        out = np.where((self.k1[slot] == k1) & (self.k2[slot] == k2) & (self.at[slot] >= 0), slot, -1)
        todo = np.flatnonzero((out < 0) & (self.at[slot] >= 0))
        slot = slot[todo]
        last = (1 << self.bits) - 1
        while len(todo):
            slot = (slot + 1) & last
            hit = (self.k1[slot] == k1[todo]) & (self.k2[slot] == k2[todo]) & (self.at[slot] >= 0)
            out[todo[hit]] = slot[hit]
            on = ~hit & (self.at[slot] >= 0)
            todo, slot = todo[on], slot[on]
        return out

    def _insert(self, k1: np.ndarray, k2: np.ndarray, ids: list[bytes]) -> None:
        flat = np.frombuffer(b"".join(ids), dtype="<u4")
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty(len(self.pool), np.uint32)])
        self.pool[self.used : self.used + len(flat)] = flat
        at = self.used + np.cumsum(sizes) - sizes
        self.used += len(flat)
        self.words += len(ids)
        slot, todo = self._slot(k1, k2), np.arange(len(ids))
        last = (1 << self.bits) - 1
        while len(todo):
            free = self.at[slot] < 0
            self.at[slot[free]] = at[todo[free]]  # of several words for one slot, the last stays
            won = free & (self.at[slot] == at[todo])
            s, w = slot[won], todo[won]
            self.k1[s], self.k2[s], self.size[s] = k1[w], k2[w], sizes[w]
            todo, slot = todo[~won], (slot[~won] + 1) & last

    def encode(self, words: Words, at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and the number of ids of each word."""
        keyed = np.flatnonzero(sizes <= OWN_KEY_BYTES)
        other = np.flatnonzero(sizes > OWN_KEY_BYTES)
        slot = self._slots(words, at[keyed], sizes[keyed])
        counts, places = np.empty(len(at), dtype=np.int64), np.empty(len(at), dtype=np.int64)
        counts[keyed], places[keyed] = self.size[slot], self.at[slot]
        pool = self.pool
        if len(other):
            ids = self._long_ids(self._bytes(words, at[other], sizes[other]))
            n = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
            counts[other], places[other] = n, self.used + np.cumsum(n) - n
            pool = np.concatenate([pool[: self.used], np.frombuffer(b"".join(ids), dtype="<u4")])
        total = np.cumsum(counts)
        where = np.repeat(places - (total - counts), counts)
        where += np.arange(len(where))
        return pool[where], counts

    def _slots(self, words: Words, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The slot of each word, new ones encoded and put in."""
        k1, k2 = words.keys(at, sizes)
        if self.words > 0.55 * len(self.k1):
            self._empty()
        slot = self._find(k1, k2)
        miss = np.flatnonzero(slot < 0)
        if len(miss):
            order = miss[np.lexsort((k2[miss], k1[miss]))]
            first = np.ones(len(order), dtype=bool)
            first[1:] = (k1[order[1:]] != k1[order[:-1]]) | (k2[order[1:]] != k2[order[:-1]])
            new = order[first]
            if self.words + len(new) > 0.7 * len(self.k1):
                while len(new) > 0.5 * (1 << self.bits):
                    self.bits += 1
                self._empty()
                return self._slots(words, at, sizes)
            self._insert(k1[new], k2[new], self.encode_new(self._bytes(words, at[new], sizes[new])))
            slot[miss] = self._find(k1[miss], k2[miss])
        return slot

    def _long_ids(self, found: list[bytes]) -> list[bytes]:
        """Ids of words by their bytes."""
        if len(self.long) > LONG_WORDS:
            self.long = {}
        new = [w for w in dict.fromkeys(found) if w not in self.long]
        here = dict(zip(new, self.encode_new(new), strict=True)) if new else {}
        ids = [here[w] if w in here else self.long[w] for w in found]
        for w in new:
            if len(w) <= KEPT_BYTES and len(self.long) <= LONG_WORDS:
                self.long[w] = here[w]
        return ids

    @staticmethod
    def _bytes(words: Words, at: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        raw = words.raw.tobytes()
        return [raw[a : a + n] for a, n in zip(at.tolist(), sizes.tolist(), strict=True)]


class TextCodec:
    """``encode`` gives the ids of whole texts: plain ones through the table, the others by ``whole``."""

    BATCH_BYTES = 4 << 20

    def __init__(self, cut: str, encode_new: Callable[[list[bytes]], list[bytes]], whole: Callable[[str], np.ndarray], plain: Callable[[str], bool] = is_plain):
        self.cut, self.whole, self.plain = cut, whole, plain
        self.table = WordTable(encode_new)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(texts)
        part: list[int] = []
        held: list[bytes] = []
        size = 0
        for i, text in enumerate(texts):
            if not text:
                continue
            if self.plain(text):
                part.append(i)
                held.append(text.encode())
                size += len(held[-1])
                if size >= self.BATCH_BYTES:
                    self._flush(part, held, out)
                    part, held, size = [], [], 0
            else:
                out[i] = self.whole(text)
        self._flush(part, held, out)
        return out

    def _flush(self, part: list[int], held: list[bytes], out: list[np.ndarray]) -> None:
        if not part:
            return
        words = Words(held)
        at, sizes = getattr(words, self.cut)()
        ids, counts = self.table.encode(words, at, sizes)
        ends = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(at, words.ends)]
        start = 0
        for i, end in zip(part, ends.tolist(), strict=True):
            out[i] = ids[start:end]
            start = end
