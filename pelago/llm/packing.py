"""Operator 1: pack documents' tokens into as few fixed-size sequences as possible.

Only lengths matter to a packing, and there are at most ``capacity`` different ones, so the whole corpus is planned from
one histogram, whatever its size: first Martello-Toth style dominance reduction fixes small sets that provably dominate
every other way to fill a sequence with their largest piece, then best-fit (largest first) packs what remains.  Both work
on classes of equal lengths and equal fillings, so a plan has a few thousand rows at most.  Pieces find their place by
their rank within their length; each task that cuts pieces counts them by length and leaves its counts beside them, and
sums of these over the tasks before are joined back.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, per_batch, stored, text_or_empty
from .library import tokenizer

Pattern = tuple[tuple[int, int], ...]  # (length, times) in order of placement


class _Histogram:
    def __init__(self, counts: dict[int, int]):
        self.n = {w: c for w, c in counts.items() if c > 0}
        self.sizes = sorted(self.n)

    def take(self, w: int, c: int) -> None:
        self.n[w] -= c
        if not self.n[w]:
            del self.n[w]
            del self.sizes[bisect_left(self.sizes, w)]

    def largest(self, most: int, without: tuple[int, ...] = ()) -> int:
        """The largest size of at most ``most`` of which there is one besides ``without``; 0 if none."""
        i = bisect_right(self.sizes, most)
        while i:
            i -= 1
            w = self.sizes[i]
            if self.n[w] > without.count(w):
                return w
        return 0

    def smallest_sum(self, count: int, without: tuple[int, ...]) -> float:
        """The sum of the ``count`` smallest pieces besides ``without``."""
        total, need = 0, count
        for w in self.sizes:
            here = min(self.n[w] - without.count(w), need)
            total, need = total + here * w, need - here
            if not need:
                return total
        return float("inf")

    def best_sum(self, most: int, without: tuple[int, ...]) -> int:
        """The largest sum of pieces, besides ``without``, that is at most ``most``."""
        reach, mask = 1, (1 << (most + 1)) - 1
        for w in self.sizes:
            if w > most:
                break
            left, step = min(self.n[w] - without.count(w), most // w), 1
            while left > 0:
                step = min(step, left)
                reach |= (reach << (w * step)) & mask
                left, step = left - step, step * 2
            if reach >> most & 1:
                return most
        return reach.bit_length() - 1


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[Pattern, int]], dict[int, int]]:
    """Fix sets that dominate: ``[(pattern, number of sequences)]`` and the counts that are left.

    A set F with piece j dominates another set with j if the other's remaining pieces can be put, in groups, in the
    places of F's.  Then some best packing uses F, and its pieces can be taken out of the instance.  With r the room
    beside j and k the largest piece that fits in it:

    * nothing fits: {j};
    * k fills r, or no two pieces fit, or no sum of pieces within r is over k: {j, k};
    * no three pieces fit, and with b the largest piece beside j and k, for every pair x >= y that fits, y <= b or
      x + y <= k: {j, k, b}.
    """
    h, fixed = _Histogram(counts), []

    def fix(*sizes: int) -> None:
        times: dict[int, int] = {}
        for w in sizes:
            times[w] = times.get(w, 0) + 1
        n = min(h.n[w] // t for w, t in times.items())
        for w, t in times.items():
            h.take(w, n * t)
        fixed.append((tuple(times.items()), n))

    for j in sorted(h.n, reverse=True):
        while j in h.n:
            room = capacity - j
            k = h.largest(room, (j,))
            if not k:
                fix(j)
            elif k == room or h.smallest_sum(2, (j,)) > room or h.best_sum(room, (j,)) == k:
                fix(j, k)
            elif h.smallest_sum(3, (j,)) > room and (b := h.largest(room - k, (j, k))) and _pair_dominates(h, j, k, b, room):
                fix(j, k, b)
            else:
                break
    return fixed, dict(h.n)


def _pair_dominates(h: _Histogram, j: int, k: int, b: int, room: int) -> bool:
    for x in h.sizes[: bisect_right(h.sizes, k)]:
        if h.n[x] > (j == x):
            y = h.largest(min(x, room - x), (j, x))
            if y > b and x + y > k:
                return False
    return True


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit with the largest piece first, over classes of sequences with the same filling."""
    groups: dict[int, list[tuple[Pattern, int]]] = {}
    rooms: list[int] = []
    done: list[tuple[Pattern, int]] = []

    def put(pattern: Pattern, n: int, room: int) -> None:
        if not n:
            return
        if not room:
            done.append((pattern, n))
            return
        if room not in groups:
            groups[room] = []
            insort(rooms, room)
        groups[room].append((pattern, n))

    for w in sorted(counts, reverse=True):
        c = counts[w]
        while c:
            i = bisect_left(rooms, w)
            if i < len(rooms):
                room = rooms[i]
                pattern, n = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[i]
            else:
                room, pattern, n = capacity, (), c
            fit = room // w
            whole = min(n, c // fit)
            put((*pattern, (w, fit)), whole, room - fit * w)
            c -= whole * fit
            n -= whole
            if n and c and c < fit:
                put((*pattern, (w, c)), 1, room - c * w)
                c, n = 0, n - 1
            if pattern:
                put(pattern, n, room)
    return done + [x for g in groups.values() for x in g]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """The whole packing as ``[(pattern, number of sequences)]``."""
    fixed, rest = reduce_by_dominance(counts, capacity)
    return fixed + best_fit(rest, capacity)


def _segments(patterns: list[tuple[Pattern, int]]) -> dict[str, np.ndarray]:
    """For each length and run of ranks: the first sequence, pieces a sequence, and the first offset."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, n in patterns:
        offset = 0
        for w, times in pattern:
            rank = used.get(w, 0)
            rows.append((w, rank, sequence, times, offset))
            used[w] = rank + n * times
            offset += w * times
        sequence += n
    rows.sort()
    a = np.array(rows, dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "sequence", "times", "offset"), a.T, strict=True))


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("rank", pa.int64())])
PLACED = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
_SQL = {pa.int64(): "long", pa.int32(): "int"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"`{f.name}` {_SQL[f.type]}" for f in schema)


def cut_pieces(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's tokens and ``end_id``, cut into pieces of ``capacity`` (the first may be shorter), with the
    piece's rank among those of its length in its partition.  Null text: just the end id.

    Rows with piece -1 close a partition: ``rank`` is its number of pieces of ``length``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ranks = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)

        def make(batch):
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), tokenizer(path).encode([x or "" for x in batch.column(1).to_pylist()]), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                first = len(ids) % capacity or capacity
                start = 0
                for i, end in enumerate(range(first, len(ids) + 1, capacity)):
                    rows.append((doc, i, start, end - start, zlib.crc32(ids[start:end]), part, ranks[end - start]))
                    ranks[end - start] += 1
                    start = end
            columns = list(zip(*rows, strict=True)) or [()] * len(PIECES)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PIECES, strict=True)], schema=PIECES)

        yield from per_batch(make, PIECES)(batches)
        length = np.flatnonzero(ranks)
        n = len(length)
        counted = {"doc_id": [None] * n, "piece": [-1] * n, "start": [None] * n, "length": length, "ids_crc32": [None] * n, "part": [part] * n, "rank": ranks[length]}
        yield pa.RecordBatch.from_pydict(counted, schema=PIECES)

    picked = docs.select(docs[id_col].cast("long").alias("doc_id"), text_or_empty(docs[text_col]).alias("text"))
    return picked.mapInArrow(run, _ddl(PIECES))


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Place every piece of every document: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Pieces of a sequence follow one another from offset 0 without gaps.  Null and empty texts are one piece (the end
    id); repeated rows and null ids are packed like any others; no documents give no rows.
    """
    bounded_batches(docs.sparkSession)
    pieces = stored(cut_pieces(docs, path, capacity, end_id, id_col, text_col), "pieces")
    sums = pieces.where("piece = -1").select("part", "length", F.col("rank").alias("n"))
    counts = {r["length"]: r["n"] for r in sums.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    seg = _segments(plan(counts, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))

    def make(batch):
        length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
        at = np.searchsorted(seg["length"] * (1 << 44) + seg["rank"], length * (1 << 44) + rank, side="right") - 1
        nth = rank - seg["rank"][at]
        sequence = seg["sequence"][at] + nth // seg["times"][at]
        offset = seg["offset"][at] + nth % seg["times"][at] * length
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], schema=PLACED)

    # a merge join: the counts grow with the partitions, so they aren't broadcast; a piece's row is some 50 bytes
    ranked = pieces.where("piece >= 0").join(offsets.hint("merge"), ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("rank")).alias("rank"))
    return ranked.mapInArrow(per_batch(make, PLACED, 65536), _ddl(PLACED))
