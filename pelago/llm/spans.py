"""Operator 10: remove sentences covered by runs of sentences that have occurred before, anywhere in the corpus.

Sentences end at full stops, exclamation and question marks and at line ends; long ones are also cut at words chosen by
their hashes: of any WINDOW words in a row that no end parts, a sentence begins at the one with the least hash.  Such
places depend on the words around them alone, so 50 words that two texts share have the same cuts but for less than WINDOW
words at either end, and the whole sentences between have at least 51 - 2 * WINDOW words, in two sentences or more.

A window of several sentences slides over the text: from every sentence on, and up to every sentence, the shortest run of
at least two sentences with at least ``min_words`` words is a span, so the spans within a passage reach all of its whole
sentences.  Every span is hashed, the hashes meet globally, and the first occurrence (by document id, then text, then
place) stays; the sentences of all others go.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, drop, free_name, per_batch, stored

#: With 15, fifty common words hold whole sentences of at least 21 words.
WINDOW = 15
#: Characters of texts that are cut together (or one text).
TOGETHER = 1 << 18
_M1, _M2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_SPACE, _BLANK, _MARK, _EDGE, _LINE, _END = 1, 2, 4, 8, 16, 32


def _classes() -> np.ndarray:
    """Bits of every character up to the last white space, and of all beyond: white space, space or tab, end mark, what is
    stripped from a sentence, line end."""
    last = 0x3000
    out = np.zeros(last + 2, dtype=np.uint8)
    for c in map(chr, range(last + 1)):
        out[ord(c)] = _SPACE * c.isspace() | _BLANK * (c in " \t") | _MARK * (c in ".!?") | _EDGE * (c in " \t.!?,;") | _LINE * (c == "\n")
    return out


_CLASS = _classes()


@lru_cache(maxsize=4)
def _powers(m: int, n: int) -> np.ndarray:
    """The powers of ``m`` from 0 up to ``n``, itself a power of 2."""
    out = np.ones(n, dtype=np.uint64)
    have = 1
    while have < n:
        out[have : 2 * have] = out[:have] * np.uint64(pow(m, have, 2**64))
        have *= 2
    return out


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs in ``mask``, whose last is False."""
    change = np.flatnonzero(mask[1:] != mask[:-1]) + 1
    if mask[0]:
        change = np.concatenate([[0], change])
    return change[::2], change[1::2]


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.concatenate([a, b])
    out.sort()
    return out


class Sentences(NamedTuple):
    """The sentences of several texts: sentence ``k`` is ``joined[start[k]:end[k]]``, ``after[k]`` is where the gap after it
    ends, and those of text ``i`` are ``first[i]`` up to ``first[i + 1]``.  A sentence without the marks and blanks around it
    is ``joined[core[k]:core_end[k]]``, of ``words[k]`` words (0: blank)."""

    joined: str
    start: np.ndarray
    end: np.ndarray
    after: np.ndarray
    first: np.ndarray
    core: np.ndarray
    core_end: np.ndarray
    words: np.ndarray


def sentences_of(texts: list[str]) -> Sentences:
    """The sentences of ``texts``, all cut together: the work is on arrays of characters and of words."""
    joined = "\0".join([*texts, ""])
    ends = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1) - 1
    begins = np.concatenate([np.zeros(1, np.int64), ends[:-1] + 1])
    kind = np.empty(len(joined), dtype=np.uint8)
    for at in range(0, len(kind), 1 << 20):
        points = np.frombuffer(joined[at : at + (1 << 20)].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        kind[at : at + len(points)] = _CLASS[np.minimum(points, len(_CLASS) - 1)]
    kind[ends] = _END | _EDGE  # what stands between texts ends every run
    space, blank, mark = (kind & _SPACE).view(bool), (kind & _BLANK) != 0, (kind & _MARK) != 0

    # end marks with blanks after them, and the rest of white space from its first line end on
    marks_at = np.flatnonzero(mark[:-1] & blank[1:]) + 1
    mark_start, _ = _runs(mark)
    _, blank_end = _runs(blank)
    stop = mark_start[np.searchsorted(mark_start, marks_at) - 1]
    space_start, space_end = _runs(space)
    lines = np.flatnonzero(kind & _LINE)
    run = np.searchsorted(space_start, lines, side="right") - 1
    new = np.ones(len(lines), dtype=bool)
    new[1:] = run[1:] != run[:-1]
    start = _merged(begins, np.concatenate([blank_end[np.searchsorted(blank_end, marks_at, side="right")], space_end[run[new]]]))
    end = _merged(ends, np.concatenate([stop, lines[new]]))

    # words: what is between white space, without such end marks
    word, word_end = _runs((kind & (_SPACE | _END)) == 0)
    word_end[np.searchsorted(word_end, marks_at)] = stop
    some = word_end > word
    word, word_end = word[some], word_end[some]

    # of any WINDOW words in a row within a sentence, one begins at the one with the least hash, as the last of equal ones
    at = np.searchsorted(word, start)
    count = np.diff(at, append=len(word))
    long = np.flatnonzero(count >= WINDOW)
    if len(long):
        found = chain.from_iterable(map(str.split, map(joined.__getitem__, map(slice, start[long].tolist(), end[long].tolist()))))
        h = np.fromiter(map(xxhash.xxh64_intdigest, found), dtype=np.uint64, count=int(count[long].sum()))
        least, width = np.arange(len(h)), 1
        while width < WINDOW:
            step = min(width, WINDOW - width)
            left, right = least[:-step], least[step:]
            least = np.where(h[right] <= h[left], right, left)
            width += step
        head = np.cumsum(count[long]) - count[long]
        whole = np.ones(len(h), dtype=bool)  # windows that lie in one sentence
        whole[((head + count[long])[:, None] - np.arange(1, WINDOW)).ravel()] = False
        cut = np.zeros(len(h), dtype=bool)
        cut[least[whole[: len(least)]]] = True
        cut[head] = False
        place = (np.arange(len(h)) + np.repeat(at[long] - head, count[long]))[cut]
        start, end = _merged(start, word[place]), _merged(end, word_end[place - 1])

    last = kind[end] == _END | _EDGE
    after = np.where(last, end, np.append(start[1:], 0))
    first = np.concatenate([np.zeros(1, np.int64), np.flatnonzero(last) + 1])
    edge = (kind & _EDGE) != 0
    inside = np.flatnonzero(edge[1:] != edge[:-1]) + 1
    core, core_end = start.copy(), end.copy()
    trim = np.flatnonzero(edge[start])
    core[trim] = np.append(inside, len(kind))[np.searchsorted(inside, start[trim], side="right")]
    trim = np.flatnonzero((end > start) & edge[end - 1])
    core_end[trim] = np.append(inside, 0)[np.searchsorted(inside, end[trim] - 1, side="right") - 1]
    words = np.where(core < core_end, np.searchsorted(word, core_end) - np.searchsorted(word_end, core, side="right"), 0)
    return Sentences(joined, start, end, after, first, core, core_end, words)


def split_sentences(text: str) -> tuple[list[str], list[str]]:
    """Sentences, and what stands after each (marks and white space); their alternation is the text."""
    s = sentences_of([text])
    start, end, after = s.start.tolist(), s.end.tolist(), s.after.tolist()
    return [text[a:b] for a, b in zip(start, end, strict=True)], [text[a:b] for a, b in zip(end, after, strict=True)]


def spans_of(s: Sentences, min_words: int, least: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(first, end, text, some)`` of every span, text by text and in order: from each sentence on, and up to each sentence,
    the shortest run of at least ``least`` sentences with ``min_words`` words.  Blank sentences count for nothing: first and
    end are places in ``some``, the numbers of the others."""
    some = np.flatnonzero(s.words)
    n = len(some)
    first = np.searchsorted(some, s.first)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(s.words[some])])
    here = np.arange(n)
    end = np.maximum(np.searchsorted(total, total[:-1] + min_words), here + least)
    start = np.minimum(np.searchsorted(total, total[1:] - min_words, side="right") - 1, here + 1 - least)
    forth, back = np.flatnonzero(end <= first[text + 1]), np.flatnonzero(start >= first[text])
    pairs = np.unique(np.concatenate([forth, start[back]]) * (n + 1) + np.concatenate([end[forth], back + 1]))
    start, end = np.divmod(pairs, n + 1)
    return start, end, text[start], some


def span_hashes(s: Sentences, start: np.ndarray, end: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64 and 31 bits of every span that :func:`spans_of` gives."""
    cores = map(s.joined.__getitem__, map(slice, s.core[some].tolist(), s.core_end[some].tolist()))
    h = np.fromiter(map(xxhash.xxh64_intdigest, cores), dtype=np.uint64, count=len(some))
    first = np.searchsorted(some, s.first)
    place = np.arange(len(some)) - np.repeat(first[:-1], np.diff(first))
    size = 1 << max(10, int(place.max(initial=0)).bit_length())
    out = []
    for m in (_M1, _M2):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _powers(m, size)[place], dtype=np.uint64)])
        x = (sums[end] - sums[start]) * _powers(pow(m, -1, 2**64), size)[place[start]]
        x = (x ^ (end - start).astype(np.uint64)) * np.uint64(_M2)
        out.append(x ^ (x >> np.uint64(32)))
    return out[0].view(np.int64), (out[1] >> np.uint64(33)).astype(np.int32)


def seen_before(text: np.ndarray, h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Whether a row with the same three values stands before."""
    out = np.zeros(len(h), dtype=bool)
    key = h ^ (text * np.int64(_M1 >> 1))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if same.any():  # equal rows are among these
        rows = np.sort(order[np.append(same, False) | np.append(False, same)])
        out[rows] = True
        out[rows[np.unique(np.stack([text[rows], h[rows], g[rows]], axis=1), axis=0, return_index=True)[1]]] = False
    return out


def together(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of ``texts`` of about TOGETHER characters (or one text)."""
    at = size = 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > TOGETHER:
            yield at, i
            at, size = i, 0
        size += len(t)
    if texts:
        yield at, len(texts)


SPANS = pa.schema([("h", pa.int64()), ("g", pa.int32()), ("doc_id", pa.int64()), ("body", pa.int64()), ("place", pa.int32()), ("again", pa.bool_())])


def _identity(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column]:
    """What tells a row's text from others: the id (null: after all others) and 64 bits of the text."""
    return F.coalesce(docs[id_col].cast("long"), F.lit((1 << 63) - 1)), F.xxhash64(docs[text_col].cast("string"))


def span_rows(docs: DataFrame, min_words: int, id_col: str, text_col: str) -> DataFrame:
    """Every span of every text; ``again`` marks those that occurred before in the same text."""

    def make(batch):
        doc, body = (batch.column(i).to_numpy() for i in (0, 1))
        texts = batch.column(2).to_pylist()
        for a, b in together(texts):
            s = sentences_of(texts[a:b])
            start, end, text, some = spans_of(s, min_words)
            h, g = span_hashes(s, start, end, some)
            place = np.arange(len(h)) - np.searchsorted(text, np.arange(b - a))[text]
            columns = (h, g, doc[a:b][text], body[a:b][text], place, seen_before(text, h, g))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SPANS, strict=True)], schema=SPANS)

    doc, body = _identity(docs, id_col, text_col)
    picked = docs.where(docs[text_col].isNotNull()).select(doc.alias("doc_id"), body.alias("body"), docs[text_col].cast("string").alias("text"))
    return picked.mapInArrow(per_batch(make, SPANS), "h long, g int, doc_id long, body long, place int, again boolean")


def repeated_places(docs: DataFrame, min_words: int, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, body, places)``: the numbers of the spans of a text that are not the first of their kind."""
    rows = stored(span_rows(docs, min_words, id_col, text_col), "spans")
    here = F.struct("doc_id", "body")
    first = rows.where("NOT again").groupBy("h", "g").agg(F.min(here).alias("first"), F.max(here).alias("last")).where("first < last")
    repeated = stored(first.select("h", "g", "first"), "spans-repeated")
    others = rows.where("NOT again").join(repeated, ["h", "g"]).where(here != F.col("first")).select("doc_id", "body", "place")
    every = others.union(rows.where("again").select("doc_id", "body", "place"))
    places = stored(every.groupBy("doc_id", "body").agg(F.collect_set("place").alias("places")), "spans-places")
    drop(rows, repeated)
    return places


def remove_repeated_spans(docs: DataFrame, min_words: int = 20, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", removed_col: str | None = None) -> DataFrame:
    """``docs`` with the covered sentences taken out of ``text_col`` (and ``chars_col``, if there, counted anew).

    ``removed_col`` names a column for the number of sentences removed.  Null texts and texts without repeated spans
    stay as they are.  Rows with the same id and the same text are one document and lose the same sentences; of different
    texts with one id, and among rows without an id (which come after all others), the text with the least hash is first.
    A text that is repeated as a whole becomes empty; its row stays.
    """
    bounded_batches(docs.sparkSession)
    names, chars = docs.columns, chars_col if chars_col in docs.columns else None
    own = [free_name(docs, n) for n in ("doc_key", "body_key", "places")]
    doc, body = _identity(docs, id_col, text_col)
    places = repeated_places(docs, min_words, id_col, text_col).toDF(*own)
    joined = docs.join(places, (doc == places[own[0]]) & (body == places[own[1]]), "left").drop(*own[:2])
    schema = T.StructType([*docs.schema.fields, *([T.StructField(removed_col, T.IntegerType())] if removed_col else [])])

    def make(batch):
        texts, marks = batch.column(names.index(text_col)).to_pylist(), batch.column(len(names)).to_pylist()
        removed, sizes = [0] * len(texts), batch.column(names.index(chars)).to_pylist() if chars else []
        marked = [i for i, (t, m) in enumerate(zip(texts, marks, strict=True)) if t is not None and m]
        for a, b in together([texts[i] for i in marked]):
            here = marked[a:b]
            s = sentences_of([texts[i] for i in here])
            start, end, text, some = spans_of(s, min_words)
            at = np.searchsorted(text, np.arange(len(here)))
            places = np.concatenate([np.asarray(marks[i], dtype=np.int64) + x for i, x in zip(here, at.tolist(), strict=True)])
            edge = np.zeros(len(s.start) + 1, dtype=np.int64)
            np.add.at(edge, some[start[places]], 1)
            np.add.at(edge, some[end[places] - 1] + 1, -1)
            gone = np.cumsum(edge)[:-1] > 0
            lost = np.concatenate([[0], np.cumsum(gone & (s.end > s.start))])[s.first]
            begin, after, left = s.start.tolist(), s.after.tolist(), (~gone).tolist()
            for j, i in enumerate(here):
                of = range(s.first[j], s.first[j + 1])
                texts[i] = "".join([s.joined[begin[k] : after[k]] for k in of if left[k]])
                removed[i] = int(lost[j + 1] - lost[j])
                if chars:
                    sizes[i] = len(texts[i])
        out = dict(zip(names, batch.columns[: len(names)], strict=True))
        out[text_col] = pa.array(texts, out[text_col].type)
        if chars:
            out[chars] = pa.array(sizes, out[chars].type)
        if removed_col is not None:
            out[removed_col] = pa.array(removed, pa.int32())
        yield pa.RecordBatch.from_pydict(out)

    return joined.mapInArrow(per_batch(make, None), schema)
