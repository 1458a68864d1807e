"""Operator 8: near duplicates by SimHash fingerprints, with pigeonring filtering before the Hamming check.

Pigeonring: cut a fingerprint into m segments on a ring.  If two fingerprints differ in at most t bits, some segment
starts a chain in which, for every length l, the first l segments differ in at most l*t/m bits.  With m > t the first
segment must be equal, so equal segments are the join key; the longer chains prune candidates before the full check.

Only components are asked for, so no task emits pairs: it links what it finds in a bucket and emits the tree edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import split_near_pivot
from .common import bounded_batches, drop, free_name, per_batch, stored, text_or_empty, whole_keys
from .components import connected_components, named_components

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BLANKS = bytes(range(9, 14)) + b" "
_SPREAD = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``words`` words, repeats included; A-Z folded, words joined by single spaces.
    Fewer words: of all of them; none: no hash."""
    raw = text.encode("utf-8", "surrogatepass").translate(_LOWER)
    raw = b" ".join(raw.split())  # bytes.split() cuts at exactly space and \t \n \v \f \r
    if not raw:
        return np.empty(0, np.uint64)
    ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32).tolist()
    starts = [0] + [e + 1 for e in ends]
    ends.append(len(raw))
    if len(starts) <= words:
        return np.array([xxhash.xxh64_intdigest(raw, 42)], dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(raw[a:b], 42) for a, b in zip(starts, ends[words - 1 :], strict=False)], dtype=np.uint64)


def _more(h: np.ndarray, i: int) -> np.ndarray:
    """The i-th 64 bits for hashes ``h``: the hashes themselves, then mixes of them."""
    if not i:
        return h
    x = h + np.uint64(0x9E3779B97F4A7C15 * i & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * _SPREAD[0]
    x = (x ^ (x >> np.uint64(27))) * _SPREAD[1]
    return x ^ (x >> np.uint64(31))


def fingerprint(h: np.ndarray, bits: int = 64) -> list[int]:
    """Words of 64 bits; a bit is 1 if it is set in over half the hashes.  No hashes: zero."""
    out = []
    for i in range(bits // 64):
        if not len(h):
            out.append(0)
            continue
        counts = np.zeros(64, dtype=np.int64)
        for at in range(0, len(h), 1 << 16):
            part = _more(h[at : at + (1 << 16)], i)
            counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0]))
    return out


def fingerprints(docs: DataFrame, words: int, bits: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, f0, f1, ...)``: the fingerprint of every whole text as signed 64-bit words."""
    n = bits // 64
    schema = pa.schema([("doc_id", pa.int64())] + [(f"f{i}", pa.int64()) for i in range(n)])

    def make(batch):
        found = np.array([fingerprint(shingle_hashes(x or "", words), bits) for x in batch.column(1).to_pylist()], dtype=np.uint64).reshape(-1, n).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(found[:, i]) for i in range(n)]], schema=schema)

    picked = docs.select(docs[id_col].cast("long").alias("doc_id"), text_or_empty(docs[text_col]).alias("text"))
    return picked.mapInArrow(per_batch(make, schema), ", ".join(f"{f.name} long" for f in schema))


# -- linking within a bucket ----------------------------------------------------------------------------------------


class Ring:
    """Segments of a fingerprint and the budgets of chains of them."""

    def __init__(self, bits: int, segments: int, most: int):
        self.most, self.segments = most, segments
        edges = [round(i * bits / segments) for i in range(segments + 1)]
        masks = np.zeros((segments, bits // 64), dtype=np.uint64)
        for s in range(segments):
            for b in range(edges[s], edges[s + 1]):
                masks[s, b // 64] |= np.uint64(1 << (b % 64))
        self.masks, self.starts, self.sizes = masks, edges[:-1], np.diff(edges).tolist()

    def parts(self, x: np.ndarray) -> np.ndarray:
        """Differing bits in each segment."""
        if set(self.sizes) == {16}:
            return np.bitwise_count(np.ascontiguousarray(x).view("<u2")).astype(np.int64)
        return np.stack([np.bitwise_count(x & m).sum(axis=1) for m in self.masks], axis=1).astype(np.int64)

    def budget(self, length: int) -> int:
        return length * self.most // self.segments

    def close(self, x: np.ndarray, start: int | None) -> np.ndarray:
        """Which rows of differing bits ``x`` stay within every chain budget (from ``start``, or from any segment), and
        then within the whole."""
        alive = np.arange(len(x))
        if start is not None:
            total = np.zeros(len(x), dtype=np.int64)
            for length in range(1, self.segments + 1):
                mask = self.masks[(start + length - 1) % self.segments]
                total = total + np.bitwise_count(x[alive] & mask).sum(axis=1)
                ok = total <= self.budget(length)
                alive, total = alive[ok], total[ok]
            return alive
        parts = self.parts(x)
        ring = np.concatenate([parts, parts], axis=1)
        chain = np.ones(parts.shape, dtype=bool)
        total = np.zeros(parts.shape, dtype=np.int64)
        for length in range(1, min(4, self.segments) + 1):
            total += ring[:, length - 1 : length - 1 + self.segments]
            chain &= total <= self.budget(length)
        alive = alive[chain.any(axis=1)]
        return alive[parts[alive].sum(axis=1) <= self.most]


class Links:
    """Union-find over row numbers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


BROAD, VAST = 192, 4096


def link_rows(key: np.ndarray, f: np.ndarray, ring: Ring, start_of) -> Iterator[tuple[int, int]]:
    """Tree edges (row, row) of the links between rows with equal ``key`` (sorted), found by differences of ``f``.

    Small buckets are compared all at once, row by row distance; a broad one is walked from row to row, and each step
    looks only at rows that no walk has reached, so a dense group of g rows costs about g steps' worth and no g*g.
    """
    n = len(key)
    cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if n else np.zeros(1, int)
    sizes = np.diff(cuts)
    links = Links(n)
    small = np.repeat(sizes <= BROAD, sizes)
    last = np.repeat(cuts[1:], sizes)
    rows = np.flatnonzero(small)
    for step in range(1, BROAD):
        rows = rows[rows + step < last[rows]]
        if not len(rows):
            break
        for at in range(0, len(rows), 1 << 16):
            a = rows[at : at + (1 << 16)]
            x = f[a] ^ f[a + step]
            for start in np.unique(start_of[a]) if start_of is not None else [None]:
                here = np.flatnonzero(start_of[a] == start) if start is not None else np.arange(len(a))
                for i in a[here[ring.close(x[here], start)]].tolist():
                    if links.join(i, i + step):
                        yield i, i + step
    for lo, hi in zip(cuts[:-1][sizes > BROAD].tolist(), cuts[1:][sizes > BROAD].tolist(), strict=True):
        yield from walk_rows(np.arange(lo, hi), f, ring, int(start_of[lo]) if start_of is not None else None)


def walk_rows(rest: np.ndarray, f: np.ndarray, ring: Ring, start: int | None) -> Iterator[tuple[int, int]]:
    """Tree edges of the links among ``rest``, from row to row."""
    while len(rest):
        walk, rest = [int(rest[0])], rest[1:]
        while walk and len(rest):
            i = walk.pop()
            near = ring.close(f[rest] ^ f[i], start)
            if len(near):
                found = rest[near].tolist()
                for j in found:
                    yield i, j
                walk += found
                rest = np.delete(rest, near)


EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _bucket_edges(rows: DataFrame, ring: Ring) -> DataFrame:
    """Tree edges between ``rep``s of rows (tab, key, one, two, rep, f0) with equal keys, which begin with a table's
    number; the table is the segment that a chain starts from."""
    keys = ["tab", "key", "one", "two"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in whole_keys(batches, keys):
            table = whole.column("tab").to_numpy()
            f = whole.column("f0").to_numpy().view(np.uint64).reshape(-1, 1)
            rep = whole.column("rep").to_numpy()
            pairs = np.array(list(link_rows(_groups(whole, keys), f, ring, table)), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(rep[pairs[:, 0]]), pa.array(rep[pairs[:, 1]])], schema=EDGES)

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.select(*keys, "rep", "f0").mapInArrow(run, "a long, b long")


def _groups(whole: pa.Table, keys: list[str]) -> np.ndarray:
    """The number of each row's group in a sorted table."""
    values = np.stack([whole.column(k).to_numpy() for k in keys], axis=1)
    return np.concatenate([[0], np.cumsum((values[1:] != values[:-1]).any(axis=1))])


#: A bucket with more rows is refined by the next segment of its chain.
CROWDED = 1 << 16
#: A bucket of the candidate search with more rows is split into blocks.
DENSE = 20_000


def hamming_edges(prints: DataFrame, bits: int, most: int) -> DataFrame:
    """Edges that link all fingerprints ``(rep, f0)`` of 64 bits within ``most`` differing bits; exact.

    Keys are (segment, its value).  In a crowded bucket the next segment may differ in at most budget(2) <= 1 bits, so
    rows are dealt on by that segment with each single bit masked in turn; where that is still crowded, rows within
    ``most`` of one of them are linked with it, and the rest is compared with all by pairs of blocks; no link is lost.
    """
    if bits != 64:
        raise ValueError("exact search is for fingerprints of 64 bits")
    ring = Ring(bits, most + 1, most)

    def segment(s: int):
        size = ring.sizes[s]
        return F.shiftrightunsigned("f0", ring.starts[s]).bitwiseAND(F.lit((1 << size) - 1))

    keyed = prints.select("rep", "f0", F.explode(F.array(*[F.struct(F.lit(s).alias("tab"), segment(s).alias("key")) for s in range(ring.segments)])).alias("k")).select("rep", "f0", "k.tab", "k.key")
    counts = keyed.groupBy("tab", "key").agg(F.count("*").alias("n")).where(F.col("n") > CROWDED)
    crowded = stored(counts, "simhash-crowded")
    whole_buckets = {"one": F.lit(0), "two": F.lit(0)}
    if not crowded.head(1):
        return _bucket_edges(keyed.withColumns(whole_buckets), ring).select("a", "b")
    marked = keyed.join(crowded, ["tab", "key"], "left")
    plain = marked.where("n IS NULL").select("tab", "key", "rep", "f0").withColumns(whole_buckets)

    def refined(s: int) -> DataFrame:
        follow = (s + 1) % ring.segments
        masked = [segment(follow).bitwiseAND(F.lit(~(1 << i))) + F.lit((i + 1) << 20) + F.shiftleft(F.col("key"), 32) for i in range(ring.sizes[follow])]
        return marked.where(F.col("n").isNotNull() & (F.col("tab") == s)).select("tab", F.explode(F.array(*masked)).alias("key"), "rep", "f0")

    dense = refined(0) if ring.budget(2) <= 1 else marked.where("n IS NOT NULL").select("tab", "key", "rep", "f0")
    for s in range(1, ring.segments if ring.budget(2) <= 1 else 1):
        dense = dense.union(refined(s))
    dense, near = split_near_pivot(dense, ["tab", "key"], "rep", ["f0"], most, CROWDED)
    found = _bucket_edges(plain.unionByName(dense.select("tab", "key", "rep", "f0", "one", "two")), ring)
    return found if near is None else found.union(near.select("a", "b"))


def forest_rows(key: np.ndarray, f: np.ndarray, ring: Ring, sure: int = 0, forests: int = 3) -> Iterator[tuple[int, int, int]]:
    """(row, row, differing bits): in each bucket a spanning forest of least distances, over pairs within the ring.

    Between any two rows such a forest has a path without an edge longer than the best path's longest, so a stricter test
    of its edges later loses few links; and since distances only estimate what the test measures, edges over ``sure``
    come from ``forests`` forests without a common edge, so that a pair stays linked though some of its edges fail.
    Broad buckets grow their trees row by row, each from its nearest rows so far, with memory for a few rows of distances;
    those of over ``VAST`` rows are walked instead, which costs a dense group about its rows and no square, and links the
    same rows by other pairs.
    """
    n = len(key)
    cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if n else np.zeros(1, int)
    sizes = np.diff(cuts)
    last = np.repeat(cuts[1:], sizes)
    rows = np.flatnonzero(np.repeat(sizes <= BROAD, sizes))
    found = []
    for step in range(1, BROAD):
        rows = rows[rows + step < last[rows]]
        if not len(rows):
            break
        for at in range(0, len(rows), 1 << 15):
            a = rows[at : at + (1 << 15)]
            x = f[a] ^ f[a + step]
            near = ring.close(x, None)
            found.append(np.stack([a[near], a[near] + step, np.bitwise_count(x[near]).sum(axis=1)], axis=1).astype(np.int64))
    if found:
        pairs = np.concatenate(found)
        links = [Links(n) for _ in range(forests)]
        for i, j, d in pairs[np.argsort(pairs[:, 2], kind="stable")].tolist():
            if d <= sure:
                if links[0].join(i, j):
                    yield i, j, d
                for other in links[1:]:
                    other.join(i, j)
            elif any(forest.join(i, j) for forest in links):
                yield i, j, d
    for lo, hi in zip(cuts[:-1][sizes > VAST].tolist(), cuts[1:][sizes > VAST].tolist(), strict=True):
        for i, j in walk_rows(np.arange(lo, hi), f, ring, None):
            yield i, j, int(np.bitwise_count(f[i] ^ f[j]).sum())
    broad = (sizes > BROAD) & (sizes <= VAST)
    for lo, hi in zip(cuts[:-1][broad].tolist(), cuts[1:][broad].tolist(), strict=True):
        rest = np.arange(lo + 1, hi)
        best, source = np.full((forests, len(rest)), 1 << 30), np.full((forests, len(rest)), lo)
        new = lo
        while len(rest):
            d, by = np.bitwise_count(f[rest] ^ f[new]).sum(axis=1).astype(np.int64), np.full(len(rest), new)
            for t in range(forests):  # keep the nearest ones in order
                closer = d < best[t]
                best[t], d = np.where(closer, d, best[t]), np.where(closer, best[t], d)
                source[t], by = np.where(closer, by, source[t]), np.where(closer, source[t], by)
            k = int(best[0].argmin())
            new = int(rest[k])
            for t in range(forests if best[0, k] > sure else 1):
                if best[t, k] <= ring.most:
                    yield int(source[t, k]), new, int(best[t, k])
            rest, best, source = np.delete(rest, k), np.delete(best, k, axis=1), np.delete(source, k, axis=1)


def candidate_edges(prints: DataFrame, bits: int, most: int, share: float, recall: float = 0.9995, seed: int = 8) -> DataFrame:
    """``(a, b, d)``: forest edges among wide fingerprints (rep, f0, f1, ...) within ``most`` differing bits; whatever pair
    meets within them is linked by a path of such edges, so its loose component holds it.

    At such distances no segment need be equal, so candidates share the bits at k sampled places in one of several
    tables: k follows the number of fingerprints (about 128 a bucket), the number of tables the wanted recall at a
    ``share`` of differing bits.  Every bucket is compared whole; of a crowded one, rows near a pivot are linked with it and
    the rest is compared with all by pairs of blocks.
    """
    words = bits // 64
    n = max(prints.count(), 2)
    k = int(min(28, max(8, np.ceil(np.log2(n / 128)))))
    tables = int(np.ceil(np.log(1 - recall) / np.log(1 - (1 - share) ** k)))
    rng = np.random.default_rng(seed)
    places = [sorted(rng.choice(bits, size=k, replace=False).tolist()) for _ in range(tables)]
    names = [f"f{i}" for i in range(words)]
    schema = pa.schema([("tab", pa.int32()), ("key", pa.int64()), ("rep", pa.int64())] + [(c, pa.int64()) for c in names])
    ring = Ring(bits, bits // 16, most)

    def make(batch):
        f = [batch.column(1 + i).to_numpy().view(np.uint64) for i in range(words)]
        for t, chosen in enumerate(places):
            key = np.zeros(batch.num_rows, dtype=np.uint64)
            for j, b in enumerate(chosen):
                key |= ((f[b // 64] >> np.uint64(b % 64)) & np.uint64(1)) << np.uint64(j)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, t, np.int32)), pa.array(key.view(np.int64)), *batch.columns], schema=schema)

    bare = pa.schema([("tab", pa.int32()), ("key", pa.int64())])

    def keys_only(batch):
        for part in make(batch):
            yield part.select([0, 1])

    out = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("d", pa.int32())])
    keys = ["tab", "key", "one", "two"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in whole_keys(batches, keys):
            f = np.stack([whole.column(c).to_numpy() for c in names], axis=1).view(np.uint64)
            rep = whole.column("rep").to_numpy()
            edges = np.array(list(forest_rows(_groups(whole, keys), f, ring, forests=1)), dtype=np.int64).reshape(-1, 3)
            ends = np.sort(rep[edges[:, :2]], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1]), pa.array(edges[:, 2].astype(np.int32))], schema=out)

    picked = prints.select("rep", *names)
    rows = picked.mapInArrow(per_batch(make, schema, 4096), "tab int, key long, rep long, " + ", ".join(f"{c} long" for c in names))
    counted = picked.mapInArrow(per_batch(keys_only, bare, 4096), "tab int, key long")
    rows, near = split_near_pivot(rows, ["tab", "key"], "rep", names, most, DENSE, counted)
    dealt = rows.select(*keys, "rep", *names).repartition(*keys).sortWithinPartitions(*keys)
    found = dealt.mapInArrow(run, "a long, b long, d int")
    if near is not None:
        found = found.union(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "d"))
    return found.groupBy("a", "b").agg(F.min("d").alias("d"))


def jaccard(x: str, y: str, words: int) -> float:
    """Similarity of two texts' sets of shingles; of two texts without words 1."""
    a, b = np.unique(shingle_hashes(x, words)), np.unique(shingle_hashes(y, words))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


#: Bits of the filter that keeps texts which no open edge asks for out of the shuffle; a fixed 8 MB.
FILTER_BITS = 1 << 26


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, body, text`` of the rows with an id; ``body`` tells apart the texts of rows that share one."""
    text = text_or_empty(docs[text_col])
    return docs.select(docs[id_col].cast("long").alias("id"), F.xxhash64(text).alias("body"), text.alias("text")).where("id IS NOT NULL")


def _asked_for(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``texts`` whose (id, body) is in ``wanted``, each once, and by chance a few others.

    A filter keeps texts out of the shuffle that nothing asks for; the chance that it lets one pass grows with what is
    asked for, and a row that passes is joined exactly afterwards.
    """

    def place():
        return F.pmod(F.xxhash64("id", "body"), F.lit(FILTER_BITS))

    spots = wanted.select(place().alias("h"))
    maps = spots.groupBy(F.shiftright("h", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("h").bitwiseAND(F.lit(32767))).alias("bits")).collect()
    whole = np.zeros(FILTER_BITS // 8, dtype=np.uint8)  # at most 2048 rows of 4 KB, whatever the input
    for r in maps:
        whole[r["part"] * 4096 : (r["part"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    shared = texts.sparkSession.sparkContext.broadcast(whole)
    schema = pa.schema([("id", pa.int64()), ("body", pa.int64()), ("text", pa.string())])

    def make(batch):
        h = batch.column(3).to_numpy()
        yield batch.filter(pa.array((shared.value[h >> 3] >> (h & 7).astype(np.uint8) & 1).astype(bool))).select([0, 1, 2])

    passed = texts.select("id", "body", "text", place().alias("h")).mapInArrow(per_batch(make, schema), "id long, body long, text string")
    return passed.groupBy("id", "body").agg(F.first("text").alias("text"))  # copies of a row meet before the shuffle


#: A loose component with more texts is dealt into pairs of blocks.
BLOCK = 2048


def similar_rows(sets: list[np.ndarray], part: np.ndarray, similarity: float) -> Iterator[tuple[int, int]]:
    """Tree edges (row, row) that link all rows whose ``sets`` are at least as similar, beyond the links within a ``part``.

    Every pair of rows of different components is measured, all of a row's at once by the rows that hold its members; rows
    of the largest part need not ask, as each pair between components has a row outside it."""
    n = len(sets)
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    row = np.repeat(np.arange(n), sizes)
    place = np.unique(np.concatenate(sets), return_inverse=True)[1]
    order = np.argsort(place, kind="stable")
    holders, cuts = row[order], np.concatenate([[0], np.cumsum(np.bincount(place))])
    at = np.concatenate([[0], np.cumsum(sizes)])
    of = np.unique(part, return_inverse=True)[1]
    for i in np.flatnonzero(of != np.bincount(of).argmax()).tolist():
        if (of == of[i]).all():
            return
        v = place[at[i] : at[i + 1]]
        lengths = cuts[v + 1] - cuts[v]
        v, lengths = v[lengths > 1], lengths[lengths > 1]
        spots = np.repeat(cuts[v] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        both = np.bincount(holders[spots], minlength=n)
        near = both / np.maximum(sizes + sizes[i] - both, 1) >= similarity
        for j in np.flatnonzero(near & (of != of[i])).tolist():
            if of[j] != of[i]:
                yield i, j
                of[of == of[j]] = of[i]


def _dealt(members: DataFrame) -> DataFrame:
    """Members (id, loose, tight) of loose components that aren't one tight component, as (id, loose, tight, one, two): any two
    of different tight components meet in a group (loose, one, two).  In a large loose component the largest tight one is
    dealt into blocks, the rest into others, and all pairs of blocks but those within the largest are groups."""
    counts = members.groupBy("loose", "tight").agg(F.count("*").alias("n"))
    open_ = counts.groupBy("loose").agg(F.sum("n").alias("rows"), F.count("*").alias("parts"), F.max(F.struct("n", "tight")).alias("top")).where("parts > 1")
    open_ = open_.select("loose", "rows", F.col("top.tight").alias("largest"), F.ceil(F.col("top.n") / BLOCK).cast("int").alias("k"), F.ceil((F.col("rows") - F.col("top.n")) / BLOCK).cast("int").alias("s"))
    rows = members.join(open_, "loose").withColumn("inner", F.col("tight") == F.col("largest"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.when(F.col("inner"), F.col("k")).otherwise(F.col("s")).cast("long")).cast("int"))
    own, k = F.col("own"), F.col("k")

    def pair(one, two):
        return F.struct(one.cast("int").alias("one"), two.cast("int").alias("two"))

    others = F.sequence(F.lit(0), F.col("s") - 1)
    outer = F.concat(
        F.transform(F.sequence(F.lit(0), k - 1), lambda x: pair(x, own)),
        F.transform(others, lambda j: pair(k + F.least(j, own), F.greatest(j, own))),
    )
    groups = F.when(F.col("rows") <= BLOCK, F.array(pair(F.lit(0), F.lit(0)))).when(F.col("inner"), F.transform(others, lambda j: pair(own, j))).otherwise(outer)
    return rows.select("id", "loose", "tight", F.explode(groups).alias("g")).select("id", "loose", "tight", "g.one", "g.two")


def closing_links(members: DataFrame, nodes: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """``(a, b)``: the links by the texts' own similarity that ``tight`` components of a ``loose`` one still lack; exact.
    ``nodes`` say which text (id, body) stands for a node."""
    keys = ["loose", "one", "two"]
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in whole_keys(batches, keys, 2 * BLOCK):
            cuts = np.searchsorted(group := _groups(whole, keys), np.arange(group[-1] + 2))
            ids, tight = whole.column("id").to_numpy(), whole.column("tight").to_numpy()
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                sets = [np.unique(shingle_hashes(x or "", words)) for x in whole.column("text").slice(lo, hi - lo).to_pylist()]
                found = np.array(list(similar_rows(sets, tight[lo:hi], similarity)), dtype=np.int64).reshape(-1, 2) + lo
                yield pa.RecordBatch.from_arrays([pa.array(ids[found[:, 0]]), pa.array(ids[found[:, 1]])], schema=schema)

    dealt = stored(_dealt(members).join(nodes.select(F.col("node").alias("id"), F.col("id").alias("doc"), "body"), "id"), "similar-open")
    wanted = _asked_for(texts, dealt.select(F.col("doc").alias("id"), "body")).withColumnRenamed("id", "doc")
    rows = dealt.join(wanted, ["doc", "body"]).repartition(*keys).sortWithinPartitions(*keys)
    found = stored(rows.select(*keys, "id", "tight", "text").mapInArrow(run, "a long, b long"), "similar-closing")
    drop(dealt)
    return found


def set_prints(docs: DataFrame, words: int, bits: int, id_col: str, text_col: str) -> DataFrame:
    """``(id, body, h0, h1, size, f0, f1, ...)`` of every row with an id: of its text's set of shingles 128 bits that name
    it, its size, and its fingerprint, for which a repeated shingle counts once."""
    n = bits // 64
    schema = pa.schema([(c, pa.int64()) for c in ("id", "body", "h0", "h1", "size", *(f"f{i}" for i in range(n)))])

    def make(batch):
        found = []
        for x in batch.column(2).to_pylist():
            h = np.unique(shingle_hashes(x or "", words))
            name = xxhash.xxh128_intdigest(h.tobytes())
            found.append([name >> 64, name & (2**64 - 1), len(h), *fingerprint(h, bits)])
        columns = np.array(found, dtype=np.uint64).reshape(-1, n + 3).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(columns[:, i]) for i in range(n + 3)]], schema=schema)

    return _texts(docs, id_col, text_col).mapInArrow(per_batch(make, schema), ", ".join(f"{f.name} long" for f in schema))


#: Sets with at most so many shingles are short: their majorities often hang on one shingle, most of all those of four and
#: five shingles, which differ in 3/16 of the bits at a similarity of 0.8.
SHORT, SHORT_SHARE = 32, 0.1875


def similar_rows_of(docs: DataFrame, words: int, similarity: float, bits: int, id_col: str, text_col: str) -> DataFrame:
    """``(id, body, component_id)`` of every row with an id; see :func:`similar_texts`."""
    bounded_batches(docs.sparkSession)
    names, key = [f"f{i}" for i in range(bits // 64)], ["h0", "h1"]
    share = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    short = max(share, SHORT_SHARE)
    prints = stored(set_prints(docs, words, bits, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "fingerprints")
    grouped = prints.groupBy(*key, "size", *names).agg(F.min("row").alias("node"), F.min(F.struct("id", "body")).alias("first"))
    classes = stored(grouped.select("node", *key, "size", *names, "first.id", "first.body"), "fingerprint-classes")
    reps = classes.select(F.col("node").alias("rep"), "size", *names)
    few = candidate_edges(reps.where(F.col("size") <= SHORT), bits, round(bits * short + 5 * (bits * short * (1 - short)) ** 0.5), short)
    edges = stored(candidate_edges(reps, bits, round(bits * share * 1.35), share).union(few).select("a", "b").distinct(), "similar-candidates")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def make(batch):
        x, y = (batch.column(i).to_pylist() for i in (2, 3))
        yield batch.filter(pa.array([jaccard(p or "", q or "", words) >= similarity for p, q in zip(x, y, strict=True)], pa.bool_())).select([0, 1])

    nodes, texts = classes.select("node", "id", "body"), _texts(docs, id_col, text_col)
    ends = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    wanted = _asked_for(texts, nodes.join(ends, "node").select("id", "body"))

    def end(name: str, text: str) -> tuple[DataFrame, DataFrame]:
        """Which text stands at an end of an edge, and the texts, under names of their own."""
        which = nodes.select(F.col("node").alias(name), F.col("id").alias(f"{name}_id"), F.col("body").alias(f"{name}_body"))
        return which, wanted.select(F.col("id").alias(f"{name}_id"), F.col("body").alias(f"{name}_body"), F.col("text").alias(text))

    (a, left), (b, right) = end("a", "x"), end("b", "y")
    open_ = edges.join(a, "a").join(b, "b").join(left, ["a_id", "a_body"]).join(right, ["b_id", "b_body"]).select("a", "b", "x", "y")
    checked = stored(open_.mapInArrow(per_batch(make, schema), "a long, b long"), "similar-checked")
    tight = connected_components(checked, "a", "b").withColumnRenamed("component", "tight")
    loose = connected_components(edges, "a", "b").withColumnRenamed("component", "loose")
    members = stored(loose.join(tight, "node", "left").select(F.col("node").alias("id"), "loose", F.coalesce("tight", "node").alias("tight")), "similar-members")
    more = closing_links(members, nodes, texts, words, similarity)
    links = members.select(F.col("id").alias("a"), F.col("tight").alias("b")).union(more)
    of = stored(classes.select("node", *key).join(named_components(nodes, links, "a", "b"), "node").select(*key, "component_id"), "fingerprint-components")
    drop(edges, checked, members, more)
    return prints.join(of, key).select("id", "body", "component_id")


def similar_texts(docs: DataFrame, words: int = 5, similarity: float = 0.8, bits: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, component_id)`` of every row with an id: components of texts whose shingle sets are at least as similar,
    named by their smallest id.

    Texts with equal sets are one node, and the different texts of rows that share an id are nodes apart.  Fingerprints of
    the sets, of ``bits`` bits, find candidates, pigeonring chains prune them, and all edges are checked against the texts.
    Where that leaves a component of candidates in parts, all pairs of texts between the parts are measured, so a failed
    edge costs no link.  At a similarity s the share of differing bits is acos(c)/pi with c = 2s/(1+s), give or take; edges
    well over it are none, and short sets get a wider bound.
    """
    return similar_rows_of(docs, words, similarity, bits, id_col, text_col).select(F.col("id").alias("doc_id"), "component_id")


def near_duplicates(docs: DataFrame, words: int = 4, bits: int = 64, most: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row; equal fingerprints are one node, whatever their copies.

    The fingerprint shows as 16 hex digits for each 64 bits.  Null and empty texts have fingerprint zero and link like
    any others; a component is named by its smallest id, null only if all of its ids are.  Rows that share an id go by
    their own texts.
    """
    names = [f"f{i}" for i in range(bits // 64)]
    prints = stored(fingerprints(docs, words, bits, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "fingerprints")
    classes = stored(prints.groupBy(*names).agg(F.min("row").alias("node"), F.min("doc_id").alias("id")), "fingerprint-classes")
    edges = hamming_edges(classes.select(F.col("node").alias("rep"), *names), bits, most)
    named = named_components(classes.select("node", "id"), edges, "a", "b")
    of = stored(classes.select("node", *names).join(named, "node").drop("node"), "fingerprint-components")
    shown = F.concat(*[F.lpad(F.lower(F.hex(c)), 16, "0") for c in names])
    return prints.join(of, names).select("doc_id", shown.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept if one document of each group of similar texts stays (the smallest id).

    Columns stay as they are.  Rows with a null id stay.  Rows that share an id are decided by their own texts; in the
    group whose smallest id they have, all of them stay.
    """
    found = similar_rows_of(docs, words, similarity, 512, id_col, text_col)
    own = [free_name(docs, n) for n in ("gone_id", "gone_body")]
    gone = found.where("id <> component_id").select("id", "body").distinct().toDF(*own)
    return docs.join(gone, (docs[id_col].cast("long") == gone[own[0]]) & (F.xxhash64(text_or_empty(docs[text_col])) == gone[own[1]]), "left_anti")
