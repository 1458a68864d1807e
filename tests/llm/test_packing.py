import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pelago.llm.packing import best_fit, pack_documents, plan, reduce_by_dominance

PATH = public_tokenizers.path("byte_bpe_50k.json")


def total(patterns, counts):
    used = {}
    for pattern, n in patterns:
        for w, t in pattern:
            used[w] = used.get(w, 0) + n * t
    return used == counts


def fewest(sizes, capacity):
    """Brute force: the fewest bins, by placing pieces one after another."""
    best = len(sizes)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for k in {r: j for j, r in enumerate(rooms) if r >= sizes[i]}.values():
            place(i + 1, [r - sizes[i] if j == k else r for j, r in enumerate(rooms)])
        place(i + 1, [*rooms, capacity - sizes[i]])

    place(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=9))
def test_reduction_keeps_the_optimum(sizes):
    sizes = sorted(sizes, reverse=True)
    counts = {w: sizes.count(w) for w in sizes}
    fixed, rest = reduce_by_dominance(counts, 12)
    left = sorted((w for w, c in rest.items() for _ in range(c)), reverse=True)
    assert sum(n for _, n in fixed) + fewest(left, 12) == fewest(sizes, 12)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 60), max_size=20))
def test_plan_places_all_pieces_within_capacity(counts):
    patterns = plan(counts, 40)
    assert total(patterns, counts)
    assert all(sum(w * t for w, t in p) <= 40 for p, _ in patterns)
    assert total(best_fit(counts, 40), counts)


def test_best_fit_takes_the_tightest_room():
    # 4 goes to the 6 and fills it, though the 5 has room too; 3 then goes to the 5
    assert sorted(sorted(p) for p, _ in best_fit({6: 1, 5: 1, 4: 1, 3: 1}, 10)) == [[(3, 1), (5, 1)], [(4, 1), (6, 1)]]
    # of two open rooms, 3 and 2, the tighter one takes the 2
    assert sorted(sorted(p) for p, _ in best_fit({8: 1, 7: 1, 2: 1}, 10)) == [[(2, 1), (8, 1)], [(7, 1)]]


@pytest.fixture(scope="module")
def docs(spark):
    texts = ["", None, "one two three", "one two three", "word " * 700, "x" * 50, "Ünï cödé 中文 " * 40, "a", "b c"]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(4, "word " * 700, "repeat"), (None, "no id", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, sequence_id string")


def test_pack_documents(docs):
    rows = pack_documents(docs, PATH, 128, 0).collect()
    tokenizer = Tokenizer.from_file(PATH)
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for r in docs.collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
        copies = 2 if r.doc_id == 4 else 1
        pieces = sorted(by_doc[r.doc_id], key=lambda x: x.piece)
        assert sum(p.length for p in pieces) == copies * len(ids)
        for p in pieces:
            assert zlib.crc32(np.array(ids[p.start : p.start + p.length], dtype="<u4").tobytes()) == p.ids_crc32
            assert p.length == 128 or p.piece == 0
    at = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
        assert at[r.sequence_id] <= 128
    assert len(at) == -(-sum(r.length for r in rows) // 128)


def test_no_documents(docs):
    assert pack_documents(docs.limit(0), PATH).collect() == []
