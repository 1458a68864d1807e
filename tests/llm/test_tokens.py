"""Operators 5, 6 and 7 against the libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pelago.llm import bpe, simple8b, tokencount
from pelago.llm.library import LibraryEncoder, PieceCounter
from pelago.llm.wordtable import TextCodec, WordTable

BYTE, WORD, PIECE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
PARTS = [" ", "  ", "\n", "\t", "\r", "a", "b", "é", "ß", "ñ", "1", "²", "'s", "'LL", "'ll", "'", "!", "<", "the", "aaaa", "A", "Ñ", "\0", "\x1c", "\x0b", "'re", "µ", "ª", "×", "÷", "Ý", "ÿ", "«", "\xad", "¼", " of", "xyz" * 30, "Σ", "ς", "İ", "ſ", "中", "🙂", "́", "\xa0", "　", "\x85", "٣", "<|endoftext|>", "<|startoftext|>", "<|", "​", "ﬁ", "ͅ", "▁"]
FIXED = ["", "a" * 3000, "ab" * 500 + " " + "!" * 2000, "plain text, with marks.\nAnd lines", None, "ends with space ", " starts"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    return FIXED + ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(1500)]


@pytest.mark.parametrize(("path", "make"), [(BYTE, bpe.TextEncoder), (BYTE, LibraryEncoder), (WORD, LibraryEncoder)])
def test_ids_are_the_librarys(texts, path, make):
    library, own = Tokenizer.from_file(path), make(path)
    encode = own.encode_all if make is bpe.TextEncoder else own.encode
    for text, ids in zip(texts, encode([t or "" for t in texts]), strict=True):
        assert ids.tolist() == library.encode(text or "", add_special_tokens=False).ids, text


def test_decoding_is_the_librarys(texts):
    library, own = Tokenizer.from_file(BYTE), bpe.TextEncoder(BYTE).bpe
    rng = random.Random(6)
    for _ in range(300):
        ids = [rng.randrange(own.size) for _ in range(rng.randint(0, 8))]
        assert own.decode(np.array(ids, dtype=np.int64)) == library.decode(ids, skip_special_tokens=False)


def test_piece_counts_are_the_librarys(texts):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    assert PieceCounter(PIECE).counts([t or "" for t in texts]) == [len(model.encode(t or "")) for t in texts]


def test_a_small_word_table_gives_the_same_ids(texts):
    library, own = Tokenizer.from_file(BYTE), bpe.SegmentTreeBPE(BYTE)
    codec = TextCodec("spaced", own.encode_words, lambda t: np.array(library.encode(t, add_special_tokens=False).ids))
    codec.table = WordTable(own.encode_words, bits=4)
    for text in texts[:200]:
        assert codec.encode([text or ""])[0].tolist() == library.encode(text or "", add_special_tokens=False).ids


def test_words_that_only_differ_past_their_ends():
    """Every word of 9 to 15 bytes against its extensions by control bytes to 16 bytes, each after the other in one batch."""
    byte, word, piece = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    pairs = []
    for n in range(9, 16):
        for c in range(1, 32):
            for base in ("-" * n, "a" * n):
                pairs += [base, base + chr(0) * (15 - n) + chr(c), base + chr(c) * (16 - n)]
    for texts in (pairs, pairs[::-1]):
        for path, make in ((BYTE, bpe.TextEncoder), (BYTE, LibraryEncoder), (WORD, LibraryEncoder)):
            own = make(path)
            ids = (own.encode_all if make is bpe.TextEncoder else own.encode)(texts)
            assert [x.tolist() for x in ids] == [(byte if path == BYTE else word).encode(t, add_special_tokens=False).ids for t in texts]
        assert PieceCounter(PIECE).counts(texts) == [len(piece.encode(t)) for t in texts]


def test_words_with_one_key(monkeypatch):
    """Whatever a key mixes of a longer word, ids come by its bytes."""
    monkeypatch.setattr("pelago.llm.wordtable._mix", lambda x: x & np.uint64(1))
    texts = [c * n + d for c in "ab-" for n in range(14, 66) for d in ("", "x", "-", "é")]
    library, own = Tokenizer.from_file(BYTE), bpe.TextEncoder(BYTE)
    assert [x.tolist() for x in own.encode_all(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("\0\x01\x0f\x10\x1f -aé!"), max_size=40), min_size=1, max_size=12))
def test_random_bytes_are_the_librarys(texts):
    library, own = Tokenizer.from_file(BYTE), bpe.encoder(BYTE)
    assert [x.tolist() for x in own.encode_all(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "x") for i, t in enumerate(texts[:150])]
    rows += [(3, FIXED[3], "again"), (None, "null id", "y"), (900, "word " * 5000, "long")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(4)


def test_bpe_round_trip(spark, docs):
    library = Tokenizer.from_file(BYTE)
    want = sorted(((r.doc_id if r.doc_id is not None else -1), len(ids := library.encode(r.text or "", add_special_tokens=False).ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()) for r in docs.collect())
    assert sorted((r[0] if r[0] is not None else -1, *r[1:]) for r in bpe.bpe_round_trip(docs, BYTE).collect()) == want
    encoded = bpe.bpe_encode(docs, BYTE)
    back = {r.doc_id: r.text for r in bpe.bpe_decode(encoded, BYTE).collect()}
    assert back[900] == "word " * 5000
    assert back[4] == ""
    assert bpe.bpe_round_trip(docs.limit(0), BYTE).collect() == []


def test_token_counts_and_cache(spark, docs, tmp_path):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    cache = str(tmp_path / "cache")
    want = sorted((-1 if r.doc_id is None else r.doc_id, len((r.text or "").encode()), n := len(model.encode(r.text or "")), n > 20) for r in docs.collect())
    for _ in range(2):  # the second run finds every count in the cache
        found = tokencount.count_tokens(docs, PIECE, cache, limit=20).collect()
        assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in found) == want
    held = spark.read.parquet(cache)
    texts = {r.text or "" for r in docs.collect()}
    assert held.count() >= len(texts) and held.select("digest", "version").distinct().count() == len(texts)
    assert held.count() <= len(texts) + 1  # a repeated row may be encoded twice, a second run adds nothing
    assert tokencount.count_tokens(docs.limit(0), PIECE).collect() == []


def test_token_files(spark, docs):
    library = Tokenizer.from_file(WORD)
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    want, start = [], 0
    for r in rows:
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 1]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    found = simple8b.token_files(docs, WORD, 1).collect()
    assert sorted(map(tuple, found), key=lambda r: r[1]) == want
    assert simple8b.token_files(docs.limit(0), WORD, 1).collect() == []


@settings(max_examples=120, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.just(0), st.integers(0, 70_000), st.integers(0, 2**64 - 1)), max_size=2600))
def test_simple8b_round_trip(values):
    v = np.array(values, dtype=np.uint64)
    words, offsets, escapes = simple8b.encode(v)
    assert (simple8b.decode(words, offsets, len(v), escapes) == v).all()
    assert len(offsets) == -(-len(v) // simple8b.BLOCK) + 1
    assert len(escapes) == sum(x >= 1 << 60 for x in values)


def test_simple8b_packs_runs_of_zeros():
    words, _, _ = simple8b.encode(np.zeros(simple8b.BLOCK, dtype=np.uint64))
    assert len(words) == 5  # 4 x 240 and the rest


def test_shard_round_trip():
    ids = [np.array(x, dtype=np.uint32) for x in ([1, 2, 3], [], [7] * 3000)]
    docs, counts, flat = simple8b.open_shard(simple8b.pack_shard([5, None, 9], ids))
    assert docs == [5, None, 9] and counts.tolist() == [3, 0, 3000] and flat.tolist() == [1, 2, 3] + [7] * 3000
    with pytest.raises(ValueError):
        simple8b.open_shard(b"XXXX" + bytes(60))
