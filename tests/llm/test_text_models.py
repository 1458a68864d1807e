"""Operators 2, 9 and 10, and the pipeline."""

import random
import re
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from pelago.llm import language, quality, simhash, spans
from pelago.llm.sample import bounded_sample

SYLLABLES = {"en": ["the", "ing", "er", "on", "th", "wh"], "de": ["sch", "ung", "keit", "ein", "ä", "ver"], "es": ["ción", "ñ", "que", "ado", "os", "la"]}


def prose(rng, lang, words=60):
    out = []
    for i in range(words):
        out.append("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) + ("." if i % 9 == 8 else ""))
    return " ".join(out)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    rows = []
    for i in range(240):
        lang = rng.choice(sorted(SYLLABLES))
        text = prose(rng, lang, rng.randint(20, 120))
        good = rng.random() < 0.7
        if not good:
            text = " ".join(w.upper() + "!!" for w in text.split())
        rows.append((i, text, lang, "s", len(text), int(good)))
    rows += [(1000, None, "en", "s", None, None), (1001, "", None, "s", 0, None), (1002, "123 456 !!", "en", "s", -5, None), (None, prose(rng, "de"), "de", "s", 9, None), (5, rows[5][1], rows[5][2], "s", 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, n_chars long, quality int").cache()


def held(i, by, r):
    return i is not None and zlib.crc32(str(i).encode()) % by == r


def test_language(spark, docs):
    net = language.fit_languages(docs)
    rows = language.identify(docs, net).collect()
    assert len(rows) == docs.count()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    tested = [r for r in rows if held(r.doc_id, 4, 2) and r.doc_id < 1000]
    assert sum(r.lang_pred == truth[r.doc_id] for r in tested) >= 0.95 * len(tested) > 20
    by = {r.doc_id: r for r in rows}
    assert [by[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and all(0 <= r.score <= 1 for r in rows)
    kept = language.keep_identified(docs, net)
    assert kept.columns == docs.columns and kept.where("doc_id BETWEEN 1000 AND 1002").count() == 0
    assert kept.where("doc_id < 1000").count() >= 235
    assert language.fit_languages(docs.limit(0)) is None
    assert {r.lang_pred for r in language.identify(docs.limit(3), None).collect()} == {"und"}
    assert language.keep_identified(docs, None).count() == docs.count() - 3


def test_windows_cover_every_byte():
    for n in (0, 1, 3, 255, 256, 257, 700, 5000):
        raw = bytes((i % 250) + 1 for i in range(n))
        rows = language.windows(raw)
        whole = b"".join(bytes(r[: language.STEP]) for r in rows[:-1]) + bytes(rows[-1])
        assert whole.rstrip(b"\0") == raw and len(rows) == max(1, -(-max(n - 3, 1) // language.STEP))


def test_scoring_tables_agree_with_the_filters():
    rng = np.random.default_rng(0)
    rows = rng.integers(1, 256, (40, language.WINDOW), dtype=np.uint8)
    net = language.ByteNet.fit(rows, rng.integers(0, 2, 40), ["a", "b"], epochs=1)
    x = net.vectors[rows]
    pooled = np.concatenate([sum(x[:, i : i + language.STEP] @ net.filters[w][i] for i in range(w)).max(axis=1) for w in (2, 3, 4)], axis=1)
    want = language._softmax(np.maximum(pooled + net.bias, 0) @ net.out + net.out_bias)
    assert np.allclose(net.scores(rows, net.tables()), want, atol=1e-5)


def test_quality(spark, docs):
    labels = docs.select("doc_id", "quality").where("quality IS NOT NULL")
    model = quality.fit_quality(docs, labels)
    rows = quality.score_quality(docs, model).collect()
    truth = {r.doc_id: r.quality for r in docs.collect()}
    tested = [r for r in rows if held(r.doc_id, 3, 1) and truth[r.doc_id] is not None]
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert sum(r.predicted == truth[r.doc_id] for r in tested) >= 0.95 * len(tested) > 40
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns
    assert quality.fit_quality(docs, labels.limit(0)) is None and quality.score_quality(docs.limit(2), None).count() == 2


def test_long_words_are_hashed_whole():
    texts = ["x" * 64 + "a" * 40, "x" * 64 + "b" * 40, "X" * 64 + "A" * 40, "x" * 64, f"{'x' * 70}a {'x' * 70}b {'x' * 70}a"]
    row, col, _, stats = quality.features(texts, [None] * 5)
    first = {int(r): int(c) for r, c in zip(row, col, strict=True)}
    assert len({first[0], first[1], first[3]}) == 3 and first[0] == first[2]
    assert (row == 4).sum() == 2 and stats[4, quality.STATS.index("most_common")] == pytest.approx(2 / 3)


def test_sum_of_squares_identity():
    rng = np.random.default_rng(2)
    texts = ["a b c a d", "e f", "", "a"]
    row, col, x, stats = quality.features(texts, [9, None, 0, -3])
    size = (1 << quality.HASHED_BITS) + stats.shape[1]
    model = quality.FactorisationMachine(0.3, rng.normal(size=size), rng.normal(size=(size, quality.RANK)), stats.mean(0), stats.std(0) + 1e-6)
    dense = model._dense(stats)
    for n, got in enumerate(model.score(row, col, x, stats)):
        at = np.concatenate([col[row == n], np.arange(1 << quality.HASHED_BITS, size)])
        value = np.concatenate([x[row == n], dense[n]])
        z = model.w0 + value @ model.w[at]
        for i in range(len(at)):
            for j in range(i):
                z += (model.v[at[i]] @ model.v[at[j]]) * value[i] * value[j]
        assert got == pytest.approx(1 / (1 + np.exp(-z)))


def plain_sentences(text, window=15):
    """Sentences and the gaps after them, character by character and window by window."""
    pieces, at, i = [], 0, 0
    while i < len(text):
        j = i
        while j < len(text) and text[j] in ".!?":
            j += 1
        k = j
        while j > i and k < len(text) and text[k] in " \t":
            k += 1
        if k > j > i:
            pieces.append((text[at:i], text[i:k]))
            at = i = k
        elif text[i] == "\n":
            k = i + 1
            while k < len(text) and text[k].isspace():
                k += 1
            pieces.append((text[at:i], text[i:k]))
            at = i = k
        else:
            i += 1
    pieces.append((text[at:], ""))
    out = []
    for sentence, gap in pieces:
        words = [(m.start(), m.end()) for m in re.finditer(r"\S+", sentence)]
        h = [xxhash.xxh64_intdigest(sentence[a:b].encode()) for a, b in words]
        cuts = {max(range(i, i + window), key=lambda k: (-h[k], k)) for i in range(len(words) - window + 1)} - {0}
        at = 0
        for c in sorted(cuts):
            out.append((sentence[at : words[c - 1][1]], sentence[words[c - 1][1] : words[c][0]]))
            at = words[c][0]
        out.append((sentence[at:], gap))
    return out


def brute_spans(rows, min_words):
    """Texts of rows ``(id, text)`` without the sentences of runs that have occurred before, by comparing the runs' words."""
    seen, out = set(), {}
    order = {(9**20 if d is None else d, xxhash.xxh64_intdigest(t.encode(), 42) - (xxhash.xxh64_intdigest(t.encode(), 42) >> 63 << 64), t, d) for d, t in rows if t is not None}
    for _, _, text, doc in sorted(order):
        parts = plain_sentences(text)
        core = [s.strip(" \t.!?,;") for s, _ in parts]
        full = [i for i, c in enumerate(core) if c.split()]
        gone = [False] * len(parts)
        runs = [(i, j) for i in range(len(full)) for j in range(i + 1, len(full)) if sum(len(core[full[k]].split()) for k in range(i, j + 1)) >= min_words]
        for i, j in sorted({min(r for r in runs if r[0] == a) for a, _ in runs} | {max(r for r in runs if r[1] == b) for _, b in runs}):
            key = tuple(core[k] for k in full[i : j + 1])
            if key in seen:
                gone[full[i] : full[j] + 1] = [True] * (full[j] + 1 - full[i])
            seen.add(key)
        out[doc, text] = "".join(s + g for (s, g), x in zip(parts, gone, strict=True) if not x)
    return out


def test_spans(spark):
    rng = random.Random(9)
    pool = [" ".join("".join(rng.choice("abcde") for _ in range(3)) for _ in range(rng.randint(1, 9))) for _ in range(60)]
    pool += [" ".join("".join(rng.choice("abcde") for _ in range(4)) for _ in range(n)) for n in (14, 15, 16, 30, 60)]
    texts = {}
    passage = pool[0] + ". " + ". ".join(pool[1:14]) + "!"
    for d in range(60):
        parts = [rng.choice(pool) + rng.choice([". ", "! ", ", ", "; ", "\n", ".\n\n", "... ", " . ", "? \t"]) for _ in range(rng.randint(0, 25))]
        if d % 7 == 0:
            parts.insert(rng.randint(0, len(parts)), passage + "\n")
        texts[d] = "".join(parts)
    texts[70] = "Is here. " * 200
    texts[71] = ""
    texts[72] = "One sentence without an end goes on " * 20
    texts[73] = texts[72]
    rows = [*texts.items(), (None, texts[0]), (None, texts[1]), (90, None), (5, texts[7]), (5, texts[5]), (5, texts[14]), (7, texts[7]), (6, "An own text. " + texts[3])]
    for t in texts.values():
        assert list(zip(*spans.split_sentences(t), strict=True)) == plain_sentences(t)
    df = spark.createDataFrame([(d, t, None if t is None else len(t), "x", i, 1) for i, (d, t) in enumerate(rows)], "doc_id long, text string, n_chars long, __doc string, places int, h int")
    found = spans.remove_repeated_spans(df, 20, removed_col="removed")
    assert found.columns == [*df.columns, "removed"]
    got = {r.places: r for r in found.collect()}
    want = brute_spans(rows, 20)
    assert len(got) == len(rows)
    for i, (d, t) in enumerate(rows):
        left = want.get((d, t))
        assert got[i].doc_id == d and got[i].text == left and got[i].n_chars == (None if left is None else len(left))
    inner = ". ".join(pool[1:14])
    assert len({(r.doc_id, r.text) for r in got.values() if inner in (r.text or "")}) == 1
    assert spans.remove_repeated_spans(df.limit(0)).collect() == []


def test_texts_are_cut_together():
    rng = random.Random(12)
    pool = ["a", "b", "aa", "\u00e9", "\u00fc.", "\u65e5\u672c", "x,", "...", ".", "!", "? ", ",", ";", "\n", "\r", "\t", "  ", "\x0b", "\u2028", "\xa0", "\0", "\U0001f600", "\u3000", ". \n", " \n ", "Is here."]
    texts = ["", ".", " ", "\n", "one. ", "a" * 40] * 2
    for _ in range(200):
        some = rng.sample(pool, rng.randint(1, len(pool)))
        texts.append(rng.choice(["", " ", " "]).join(rng.choice(some) for _ in range(rng.choice([3, 30, 300]))))
    calls = 0

    def count(frame, event, _):
        nonlocal calls
        calls += event == "call" and frame.f_code.co_filename == spans.__file__

    sys.setprofile(count)
    try:
        s = spans.sentences_of(texts)
        start, end, text, some = spans.spans_of(s, 20)
        h, g = spans.span_hashes(s, start, end, some)
        again = spans.seen_before(text, h, g)
        spans.split_sentences("A line of some words. And more.\n" * 2000)
    finally:
        sys.setprofile(None)
    assert calls < 100  # the work must not be done sentence by sentence
    seen = set()
    for i, t in enumerate(texts):
        k = slice(s.first[i], s.first[i + 1])
        parts = [(s.joined[a:b], s.joined[b:c]) for a, b, c in zip(s.start[k], s.end[k], s.after[k], strict=True)]
        assert parts == plain_sentences(t)
        core = [x.strip(" \t.!?,;") for x, _ in parts]
        size = [len(c.split()) for c in core]
        assert s.words[k].tolist() == size and [s.joined[a:b] for a, b, n in zip(s.core[k], s.core_end[k], size, strict=True) if n] == [c for c, n in zip(core, size, strict=True) if n]
        full = [j for j, n in enumerate(size) if n]
        total = np.cumsum([0, *(size[j] for j in full)]).tolist()
        runs = [(a, b) for a in range(len(full)) for b in range(a + 1, len(full)) if total[b + 1] - total[a] >= 20]
        want = sorted({*{a: (a, b) for a, b in reversed(runs)}.values(), *{b: (a, b) for a, b in runs}.values()})
        mine = np.flatnonzero(text == i)
        assert [(some[start[j]] - k.start, some[end[j] - 1] - k.start) for j in mine] == [(full[a], full[b]) for a, b in want]
        for j, (a, b) in zip(mine, want, strict=True):
            key = (i, *(core[x] for x in full[a : b + 1]))
            assert again[j] == (key in seen)
            seen.add(key)
    keys = {}
    for j, hg in enumerate(zip(h.tolist(), g.tolist(), strict=True)):
        keys.setdefault(hg, set()).add(tuple(s.joined[s.core[x] : s.core_end[x]] for x in some[start[j] : end[j]]))
    assert again.any() and all(len(x) == 1 for x in keys.values()) and len(keys) == len({c for x in keys.values() for c in x})


def test_any_fifty_common_words_show(spark):
    rng = random.Random(31)

    def words(n):
        return ["".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(n)]

    texts, passages = {}, []
    for d in range(0, 200, 2):  # the passage's first and last fragments run on into other words
        passage = words(50)
        for i in rng.sample(range(5, 45), rng.randint(0, 3)):
            passage[i] += rng.choice([",", ".", ";"])
        passages.append(passage)
        for e in (d, d + 1):
            texts[e] = " ".join(words(rng.randint(1, 40)) + passage + words(rng.randint(1, 40)))
    for t in texts.values():
        sentences, gaps = spans.split_sentences(t)
        assert "".join(s + g for s, g in zip(sentences, gaps, strict=True)) == t
    df = spark.createDataFrame([(d, t, len(t)) for d, t in texts.items()], "doc_id long, text string, n_chars long")
    left = {r.doc_id: r.text for r in spans.remove_repeated_spans(df, 20).collect()}
    for d in range(0, 200, 2):
        assert left[d] == texts[d]
        kept, passage = set(left[d + 1].split()), passages[d // 2]
        assert not kept & set(passage[14:35]) and len(kept & set(passage)) <= 29
        assert kept >= set(texts[d + 1].split()) - set(passage)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(150):
        lang = rng.choice(sorted(SYLLABLES))
        words = [rng.choice(SYLLABLES[lang]) + rng.choice(SYLLABLES[lang]) + rng.choice("abcdefghijklm") + rng.choice("nopqrstuv") + ("." if n % 8 == 7 else "") for n in range(rng.randint(80, 200))]
        bad = i % 5 == 4
        text = " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words)
        rows.append((i, text, lang, "src", len(text)))
        labels.append((i, int(not bad), 0))
    rows += [(500 + i, rows[i][1], rows[i][2], "copy", 1) for i in range(0, 20)] + [(700, "12 34", "en", "x", 5), (701, None, "en", "x", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_pipeline(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality", "near_dedup", "substring_dedup", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()}
    good = {i for i in range(150) if i % 5 != 4}
    assert kept <= good | {4, 9, 14, 19} and len(kept & good) >= 0.98 * len(good)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns


def plain_shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_pipeline_rows_against_brute_force(spark, folder):
    """run()'s rows: the models decide as they do alone, near duplicates by all pairs, passages by comparing words, token
    ids by the library."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    named = language.keep_identified(docs, language.fit_languages(docs))
    good = quality.keep_good(named, quality.fit_quality(named, spark.read.parquet(f"{folder}/labels.parquet")))
    texts = {r.doc_id: r.text for r in good.collect()}
    sets, up = {i: plain_shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in texts:
        for b in texts:
            if a < b and (len(sets[a] & sets[b]) / len(sets[a] | sets[b]) if sets[a] | sets[b] else 1) >= 0.8:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    kept = [(i, t) for i, t in texts.items() if root(i) == i]
    left = brute_spans(kept, 20)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows, filled = {}, {}
    for r in sorted(corpus_pipeline.run(spark, folder).collect(), key=lambda r: (r.sequence_id, r.offset)):
        rows.setdefault(r.doc_id, {})[r.piece] = r
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 2048 and set(rows) == {i for i, _ in kept} and len(kept) < len(texts)
    for i, t in kept:
        ids, start = [*tokenizer.encode(left[i, t], add_special_tokens=False).ids, 0], 0
        for _, r in sorted(rows[i].items()):
            assert r.start == start and r.ids_crc32 == zlib.crc32(np.array(ids[start : start + r.length], dtype="<u4").tobytes())
            start += r.length
        assert start == len(ids)


def test_rows_that_share_an_id_and_odd_columns(spark, folder):
    """Rows with one id go by their own texts through every stage, whatever other columns are called."""
    rng = random.Random(14)
    long = [prose(rng, "en", 80) for _ in range(4)]
    near = long[0] + " one more word"
    rows = [(3, long[0], "en", "s", 1), (5, near, "en", "s", 1), (5, long[1], "en", "s", 1), (5, long[1], "en", "s", 1), (5, long[2], "de", "s", 1), (7, long[2], "en", "s", 1), (None, long[3], "en", "s", 1), (8, None, None, None, None), (8, "", "en", "", 0)]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, gone_id int, body int, row int, node int, held_out int")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    found = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert found == sorted([(3, long[0]), (5, long[1]), (5, long[1]), (5, long[2]), (None, long[3]), (8, None), (8, "")], key=str)
    net = language.fit_languages(df)
    assert language.identify(df, net).count() == language.identify(df, None).count() == len(rows)
    assert language.keep_identified(df, net).columns == df.columns
    labels = spark.createDataFrame([(3, 1), (5, 0), (5, 1), (7, 0), (None, 1), (8, None)], "doc_id long, quality int")
    model = quality.fit_quality(df, labels, of=1, held_out=9)
    assert model is not None and quality.score_quality(df, model).count() == len(rows) and quality.keep_good(df, model).columns == df.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, folder)
        assert out.count() <= len(rows) if name != "packing" else out.count() >= len(rows)
        assert stage(spark, df.limit(0), folder).collect() == []


def test_samples_are_of_rows(spark):
    rows = spark.range(3000).selectExpr("CAST(4 AS long) AS id", "concat('text ', id) AS text")
    assert 50 < bounded_sample(rows, ["id", "text"], 100).count() < 200
    copies = spark.range(3000).selectExpr("CAST(4 AS long) AS id", "'same' AS text")
    assert bounded_sample(copies, ["id", "text"], 100).count() == 1
    assert bounded_sample(rows.limit(0), ["id"], 100).count() == 0
