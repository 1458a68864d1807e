"""Operators 4 and 8, and the components they share."""

import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from pelago.llm import simhash, vectors
from pelago.llm.components import connected_components


def closure(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, x) for x in range(2001, 2100)]
    edges += edges[:5] + [(7, 7)]
    found = connected_components(spark.createDataFrame([*edges, (None, 3), (4, None)], "p long, q long"), "p", "q").collect()
    real = [(a, b) for a, b in edges if a != b]
    nodes = {x for e in real for x in e}
    assert dict(map(tuple, found)) == closure(nodes, real) and len(found) == len(nodes)
    assert connected_components(spark.createDataFrame([], "p long, q long"), "p", "q").collect() == []


def plain_fingerprint(text, words):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    runs = [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aB é\x0b\x1c \n中", max_size=40), st.integers(1, 5))
def test_fingerprint(text, words):
    assert simhash.fingerprint(simhash.shingle_hashes(text, words))[0] == plain_fingerprint(text, words)


def corpus():
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    texts = [None, "", "  ", "one", "One", "two words"]
    for _ in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(5, 200))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    return texts


def test_near_duplicates(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)] + [(3, "one", "again"), (None, "one", "no id")], "doc_id long, text string, component_id string")
    prints = {i: plain_fingerprint(t, 4) for i, t in enumerate(texts)}
    links = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    want = closure(prints, links)
    rows = simhash.near_duplicates(df).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        if r.doc_id is not None:
            assert r.fingerprint == f"{prints[r.doc_id]:016x}" and r.component_id == want[r.doc_id]
        else:
            assert r.component_id == 3
    assert simhash.near_duplicates(df.limit(0)).collect() == []


@pytest.mark.parametrize("crowded", [1 << 16, 3])
def test_links_of_dense_and_refined_buckets(spark, monkeypatch, crowded):
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    rng = random.Random(4)
    center = rng.getrandbits(64)
    prints = {center ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 6))) & (2**64 - 1) for _ in range(500)} | {rng.getrandbits(64) for _ in range(100)}
    prints = sorted(prints)
    df = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(prints)], "rep long, f0 long")
    links = [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4]
    edges = simhash.hamming_edges(df, 64, 4)
    assert all((prints[r.a] ^ prints[r.b]).bit_count() <= 4 for r in edges.collect())
    found = {r.node: r.component for r in connected_components(edges, "a", "b").collect()}
    assert {i: found.get(i, i) for i in range(len(prints))} == closure(range(len(prints)), links)


def test_keep_one_of_each_group(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(3000)]
    rows, groups = [], 0
    for g in range(30):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(150, 400))]
        groups += 1
        for c in range(rng.randint(1, 4)):
            copy = list(base)
            for _ in range(c):  # a change touches five shingles: similarity stays over 0.9
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((100 * g + c, " ".join(copy), f"s{g}"))
    df = spark.createDataFrame([*rows, (None, rows[0][1], "null id stays")], "doc_id long, text string, source string")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [100 * g for g in range(groups)]
    assert kept.where("doc_id IS NULL").count() == 1


@pytest.mark.parametrize("dense", [20_000, 4])
def test_similar_texts_against_all_pairs(spark, monkeypatch, dense):
    monkeypatch.setattr(simhash, "DENSE", dense)
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(2000)]
    texts = ["", None, "one", "one", "few words here"]
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(100, 300))]
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randint(0, len(base) // 15)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, component_id string")
    similar = {(a, b): simhash.jaccard(texts[a] or "", texts[b] or "", 5) for a in range(len(texts)) for b in range(a)}
    want = closure(range(len(texts)), [p for p, s in similar.items() if s >= 0.8])
    found = dict(map(tuple, simhash.similar_texts(df).collect()))
    assert sum(found[i] == want[i] for i in want) >= len(want) - 2  # the candidate search misses about one link in a hundred
    assert sum(0.7 < s < 0.9 for s in similar.values()) > 30
    for i, c in found.items():  # and never links what isn't similar
        assert want[i] == want[c]


@pytest.mark.parametrize("block", [2048, 24])
def test_pairs_among_texts_just_under_the_similarity(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block, raising=False)
    rng = random.Random(21)
    shared = [f"w{i}" for i in range(1000)]
    rows = []
    for g in range(60):  # a common template, and an ending of one's own that pairs share in part
        ending = [f"e{g}x{i}" for i in range(133)]
        rows.append(shared + ending)
        if g < 20:
            rows.append(shared + ending[:40] + [f"f{g}x{i}" for i in range(93)])
    rng.shuffle(rows)
    texts = [" ".join(r) for r in rows]
    similar = {(a, b): simhash.jaccard(texts[a], texts[b], 5) for a in range(len(texts)) for b in range(a)}
    assert sum(s >= 0.8 for s in similar.values()) == 20 and sum(0.76 < s < 0.8 for s in similar.values()) > 3000
    want = closure(range(len(texts)), [p for p, s in similar.items() if s >= 0.8])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert dict(map(tuple, simhash.similar_texts(df).collect())) == want


def test_similarity_is_that_of_sets(spark):
    def words(name, n):
        return " ".join(f"{name}{i}" for i in range(n))

    line = " ".join(f"line{i}" for i in range(14))
    texts = [words("a", 104) + f" {line}" * 31, words("a", 104) + f" {line}" * 2]  # the same shingles but for some seams
    texts += [words("b", 104) + f" {line}" * 500, words("c", 104) + f" {line}" * 500]  # one line's shingles, and others
    rng = random.Random(5)
    for g in range(40):  # sets of four and five shingles
        texts += [words(f"s{g}x", 8), words(f"s{g}x", 8) + f" more{rng.random()}"]
    similar = [(a, b) for a in range(len(texts)) for b in range(a) if simhash.jaccard(texts[a], texts[b], 5) >= 0.8]
    assert len(similar) == 41
    found = dict(map(tuple, simhash.similar_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()))
    want = closure(range(len(texts)), similar)
    assert all(found[i] == want[i] for i in range(4)) and sum(found[i] == want[i] for i in want) >= len(want) - 2
    assert all(want[i] == want[c] for i, c in found.items())


def test_forests_of_broad_and_small_buckets_agree(monkeypatch):
    rng = np.random.default_rng(3)
    f = rng.integers(0, 2**63, (60, 8), dtype=np.uint64)
    f = np.concatenate([f, f ^ np.uint64(1 << 40), f ^ np.uint64(0xFF00FF)])
    ring = simhash.Ring(512, 32, 100)
    key = np.sort(rng.integers(0, 3, len(f)))
    small = list(simhash.forest_rows(key, f, ring, forests=1))
    monkeypatch.setattr(simhash, "BROAD", 1)
    broad = list(simhash.forest_rows(key, f, ring, forests=1))
    assert sorted(d for *_, d in small) == sorted(d for *_, d in broad)
    assert closure(range(len(f)), [e[:2] for e in small]) == closure(range(len(f)), [e[:2] for e in broad])


def brute(rows, threshold):
    ok = {}
    for i, v in rows:
        x = None if v is None or not v or any(c is None for c in v) else np.array(v, dtype=np.float64)
        if x is not None and np.isfinite(x).all() and (x != 0).any():
            ok[i] = x / np.linalg.norm(x / np.abs(x).max()) / np.abs(x).max()
    links = [(a, b) for a in ok for b in ok if a < b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= threshold]
    n = dict.fromkeys((i for i, _ in rows), 0)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return n, closure(n, links)


@pytest.mark.parametrize("crowded", [4096, 7])
@pytest.mark.parametrize("kind", ["float", "double"])
def test_near_vectors(spark, monkeypatch, crowded, kind):
    monkeypatch.setattr(vectors, "CROWDED", crowded)
    rng = np.random.default_rng(7)
    rows = []
    for _ in range(30):
        base = rng.standard_normal(24)
        rows += [base + rng.standard_normal(24) * rng.choice([0, 0.05, 0.3]) for _ in range(rng.integers(1, 9))]
    rows = [(i, np.float32(x).tolist()) for i, x in enumerate(rows)]
    extra = [None, [], [0.0] * 24, [1.0, None] + [0.0] * 22, [float("nan")] * 24, [float("inf")] * 24, [1.0, 2.0], [2.0, 4.0], [-0.0, 1.0], [0.0, 1.0]]
    rows += [(1000 + i, v) for i, v in enumerate(extra)]
    df = spark.createDataFrame([(i, v, "l") for i, v in rows], f"vec_id long, embedding array<{kind}>, kept string")
    links, components = brute(rows, 0.9)
    found = vectors.near_vectors(df, 0.9, recall=1 - 1e-7).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found} == {i: (links[i], components[i], components[i] == i) for i, _ in rows}
    assert vectors.near_vectors(df.limit(0)).collect() == []
