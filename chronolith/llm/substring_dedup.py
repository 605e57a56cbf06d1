"""Substring dedup: repeated runs of 50 words by recompression.

Round 0 names words, round 1 runs of equal words as (word, length), and rounds 2 and 3 pairs of neighbouring symbols
whose left name is in one half of all names and whose right name is in the other (a bit of the name
decides, anew in each round).  A name is a hash of the round and of what it joins, so that every task
gives the same name to the same thing: naming is global, and equal substrings have the same symbols but for
a few at their edges.  What the rounds lead up to, the high-level symbols by which windows meet, goes through a
Spark job: shuffled by name, each with another hash of its words, they show whether a name means two things in
the corpus; then all rounds are named anew with the next salt (``name_rounds``).

A round's choice at a place looks at the neighbouring symbols alone, whose spans are bounded (2, 4
and 8 words).  A run of three words or more is one symbol that joins no pair and is named by its word: how long it is can't
be seen from a window inside of it.  So in any two occurrences of a 50-word window the symbol boundaries between words
8 and 42 agree, and with them the symbols between.  Three in a row (five to eight words long, or any if there are none
such) are a *high-level symbol*; the least one of a window is its anchor, by which equal windows
meet (see ``anchored``).  A window without any lies mostly in a long run, whose name is its anchor.  Windows
that share an anchor are verified by their words: the words, then runs of 2, 4, .. 32 and 50 of them, get dense numbers
that are equal for equal words only, and windows that also start in a document with a smaller id repeat.

Defined results: a null text has no words; texts of fewer than 50 words stay whole; windows that repeat
only within their document stay; rows without an id come first in order; rows that repeat an id
are documents of their own, ordered by their texts; other columns are ignored.  A text is held whole in memory, with
about 30 bytes for each of its bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchored import Method, _lists, _parts, keyed, repeated, restored, spans
from .suffix_dedup import sliding_min
from .text_arrays import CHUNK_BYTES, U64, byte_view, chunks, join64, mix64, owner, range_hash, same_ranges, word_hashes, words

WINDOW = 50
#: Boundaries agree from this many words inside of a window; spans of three symbols; spans that anchors prefer.
MARGIN, TRIPLE, PREFERRED = 8, 24, (5, 8)
#: The rounds: words, runs, and pairs twice.
ROUNDS = 4
#: Names that a task remembers.
SEEN = 1 << 18
_MAX = U64(0xFFFFFFFFFFFFFFFF)
_SALT = 0x9E3779B97F4A7C15


def _salt(round_: int, salts) -> U64:
    return U64((1 + round_ + ROUNDS * salts[round_]) * _SALT & 0xFFFFFFFFFFFFFFFF)


def recompress(names: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, first word of each) after the rounds; a symbol never reaches over two documents."""
    return _rounds(names, doc)[:2]


def _rounds(names: np.ndarray, doc: np.ndarray, salts=(0,) * ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, first word of each, whether it is a long run)."""
    n = len(names)
    new = np.ones(n, bool)
    new[1:] = (names[1:] != names[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    length = np.minimum(np.diff(np.append(begin, n)), 3)
    names, run = names[begin], np.flatnonzero(length > 1)
    names[run] = join64(names[run] + _salt(1, salts), mix64(length[run].astype(U64)))
    long_ = length > 2
    for round_ in (2, 3):
        side = mix64(names ^ _salt(round_, salts)) & U64(1) == 1
        pair = np.flatnonzero(~side[:-1] & side[1:] & ~long_[:-1] & ~long_[1:] & (doc[begin[:-1]] == doc[begin[1:]]))
        names = names.copy()
        names[pair] = join64(names[pair] + _salt(round_, salts), names[pair + 1])
        keep = np.ones(len(names), bool)
        keep[pair + 1] = False
        names, begin, long_ = names[keep], begin[keep], long_[keep]
    return names, begin, long_


def _high_level(h: np.ndarray, of_word: np.ndarray, salts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end, name) of the high-level symbols.

    Names are ranked by kind: three symbols of a preferred span, three of any, long runs.
    """
    symbol, begin, long_ = _rounds(h, of_word, salts)
    end = np.append(begin[1:], len(h))
    first, last, plain = begin[:-2], end[2:], ~long_
    three = np.flatnonzero((of_word[first] == of_word[last - 1]) & plain[:-2] & plain[1:-1] & plain[2:])
    first, last = first[three], last[three]
    good = (last - first >= PREFERRED[0]) & (last - first <= PREFERRED[1])
    name = join64(join64(symbol[three], symbol[three + 1]), symbol[three + 2]) >> U64(2) | np.where(good, U64(0), U64(1 << 62))
    return np.concatenate((first, begin[long_])), np.concatenate((last, end[long_])), np.concatenate((name, symbol[long_] >> U64(2) | U64(2 << 62)))


def _names(raw, starts, ends, salts) -> np.ndarray:
    """Round 0."""
    h = word_hashes(raw, starts, ends)
    return join64(h, _salt(0, salts)) if salts[0] else h


def _windows(raw, off, salts):
    """(words' names, place of each window, its document, its start in the document, its anchor), None without any window."""
    starts, ends, first = words(raw, off)
    count = np.diff(first)
    fits = np.maximum(count - WINDOW + 1, 0)
    if not fits.any():
        return None
    h, n = _names(raw, starts, ends, salts), len(starts)
    begin, end, name = _high_level(h, owner(first), salts)
    kind, by_kind = (name >> U64(62)).astype(np.int64), np.full((3, n), _MAX)
    for k in (0, 1):
        some = np.flatnonzero(kind == k)
        by_kind[k][begin[some]] = name[some]
    some = np.flatnonzero(kind == 2)
    size = end[some] - begin[some]
    by_kind[2][np.repeat(begin[some] - np.cumsum(size) + size, size) + np.arange(size.sum())] = np.repeat(name[some], size)
    doc = np.repeat(np.arange(len(count)), fits)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(fits) - fits, fits)
    place = start + first[:-1][doc]
    inner = WINDOW - 2 * MARGIN
    best = sliding_min(by_kind[0], inner - PREFERRED[1] + 1)[place + MARGIN]
    if (best == _MAX).any():
        best = np.minimum(best, sliding_min(by_kind[1], inner - TRIPLE + 1)[place + MARGIN])
        best = np.minimum(best, sliding_min(by_kind[2], inner)[place + MARGIN])
    return h, place, doc, start, best


def _proposals(salts):
    """What the anchors of a task mean: (name, thing), where ``thing`` is a second hash of the words, or of a long run's word.

    What a table of ``SEEN`` names remembers isn't told again.
    """

    def run(batches):
        known = np.zeros((2, SEEN), np.int64)
        for b in batches:
            for _, _, raw, off, _ in _parts(slices, b.column(0)):
                found = _windows(raw, off, salts)
                if found is None:
                    continue
                starts, ends, first = words(raw, off)
                begin, end, name = _high_level(found[0], owner(first), salts)
                some = np.flatnonzero(np.isin(name, np.unique(found[4])))
                begin, end, name = begin[some], end[some], name[some].view(np.int64)
                end = np.where(name < 0, begin + 1, end)  # the third kind has the highest bit
                thing = range_hash(word_hashes(raw, starts, ends, 1), 2)(begin, end).view(np.int64)
                slot = name & (SEEN - 1)
                new = np.flatnonzero((known[0, slot] != name) | (known[1, slot] != thing))
                known[0, slot[new]], known[1, slot[new]] = name[new], thing[new]
                yield pa.RecordBatch.from_arrays([pa.array(name[new]), pa.array(thing[new])], ["name", "thing"])

    return run


def name_rounds(texts: DataFrame, salts=(0,) * ROUNDS, propose=_proposals, tries: int = 8) -> tuple[int, ...]:
    """The salts with which each high-level symbol that is an anchor means one thing in all of ``texts`` (one column).

    The rounds are named anew until it does, ``tries`` times at most: windows are compared by their words, so that a
    name of two meanings costs time and nothing else.
    """
    for _ in range(tries):
        told = texts.mapInArrow(propose(salts), "name long, thing long")
        per = told.groupBy("name").agg(F.min("thing").alias("least"), F.max("thing").alias("most"))
        if per.where("least <> most").isEmpty():
            break
        salts = tuple(x + 1 for x in salts)
    return salts


def _anchors(salts):
    def anchors(raw, off):
        found = _windows(raw, off, salts)
        if found is None:
            z = np.zeros(0, np.int64)
            return z.view(U64), z, z, None
        h, place, doc, start, best = found
        of, of2 = range_hash(h, 1), range_hash(h, 2)

        def hashed(a, b):
            return of(place[a], place[b] + WINDOW), of2(place[a], place[b] + WINDOW), np.zeros(len(a), bool)

        return best, doc, start, hashed

    return anchors


def slices(raw):
    """A long document's parts of about ``CHUNK_BYTES``; each goes on for the words of one window but one."""
    starts, ends, _ = words(raw, np.array([0, len(raw)]))
    edges = np.unique(np.searchsorted(starts, np.arange(0, len(raw), CHUNK_BYTES)))
    for i, a in enumerate(edges.tolist()):
        z = int(edges[i + 1]) if i + 1 < len(edges) else len(starts)
        last = min(z + WINDOW - 1, len(starts)) - 1
        if a < z:
            yield int(starts[a]), int(ends[last]), a


def _payload(raw, off, doc, start, n):
    """The segments' words, joined by blanks."""
    starts, ends, first = words(raw, off)
    a = first[doc] + start
    z = a + n.astype(np.int64) + WINDOW - 1
    each = np.repeat(a - np.concatenate(([0], np.cumsum(z - a)[:-1])), z - a) + np.arange(int((z - a).sum()))
    size = ends[each] - starts[each] + 1
    to = np.concatenate(([0], np.cumsum(size)))
    data = raw[np.minimum(np.repeat(starts[each] - to[:-1], size) + np.arange(to[-1]), len(raw) - 1)]
    data[to[1:] - 1] = 32
    at = to[np.concatenate(([0], np.cumsum(z - a)))]
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])


def _numbers(raw, starts, ends) -> np.ndarray:
    """A dense number for each word, equal for equal words alone."""
    _, one, number = np.unique(word_hashes(raw, starts, ends), return_index=True, return_inverse=True)
    head, size = one[number], ends - starts
    same = size == size[head]
    same[same] = same_ranges(raw, starts[same], raw, starts[head[same]], size[same])
    if not same.all():  # words that share a hash
        data = raw.tobytes()
        known = {}
        return np.array([known.setdefault(data[i:j], len(known)) for i, j in zip(starts.tolist(), ends.tolist())])
    return number


def _verify(contents, n, key, start):
    raw, off = byte_view(contents)
    starts, ends, first = words(raw, off)
    number, blocks = _numbers(raw, starts, ends), []
    renamed = lambda a, b: np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1]
    width = 1
    while True:
        if WINDOW & width:
            blocks.append((width, number))
        if 2 * width > WINDOW:
            break
        number = renamed(number[:-width], number[width:])
        width *= 2
    of = np.repeat(key, n)
    place = np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(len(of))
    window, at = np.zeros(len(of), np.int64), 0
    for width, number in blocks:
        window, at = renamed(window, number[place + at]), at + width
    least = np.full(int(window.max(initial=0)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, window, of)
    return of > least[window]


def method(salts=(0,) * ROUNDS) -> Method:
    return Method(_anchors(salts), slices, _payload, _verify, False)


def _finish(rewrite: bool):
    def run(batches):
        for b in batches:
            at, marks = _lists(b.column(2))
            for row, end, raw, off in chunks(b.column(1)):
                starts, ends, first = words(raw, off)
                data = raw.tobytes()
                gone = {}
                for r, s, e in spans(at, marks, range(row, end)):
                    change = np.zeros(first[r - row + 1] - first[r - row] + 1, np.int32)
                    np.add.at(change, s, 1)
                    np.add.at(change, e + WINDOW - 1, -1)
                    gone[r] = np.cumsum(change[:-1]) > 0
                count, out, kept = np.diff(first), np.zeros(end - row, np.int64), []
                for r in range(row, end):
                    a, z = first[r - row], first[r - row + 1]
                    place = np.arange(a, z)
                    if r in gone:
                        out[r - row] = gone[r].sum()
                        place = place[~gone[r]]
                    text = b" ".join([data[i:j] for i, j in zip(starts[place].tolist(), ends[place].tolist())])
                    kept.append(text.decode("utf-8", "replace") if rewrite else hashlib.sha256(text).hexdigest())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(row, end - row), pa.array(count), pa.array(out), pa.array(kept, pa.string()), *[b.column(i).slice(row, end - row) for i in range(3, b.num_columns)]], ["id", "n_words", "n_removed", "kept", *b.schema.names[3:]])

    return run


SCHEMA = "n_words long, n_removed long, kept string"


def _schema(rows: DataFrame) -> str:
    """What becomes of ``rows``: the id, the figures and the other columns."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return f"id {kinds['id']}, {SCHEMA}" + (f", rest {kinds['rest']}" if "rest" in kinds else "")


def repeated_words(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) of each row."""
    rows = keyed(documents, id_col, text_col)
    return repeated(rows, method(name_rounds(rows.select("text"))), _finish(False), _schema(rows)).withColumnsRenamed({"id": id_col, "kept": "kept_sha256"})


def without_repeats(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``documents`` with the kept words, joined by blanks, as its texts; null texts become empty."""
    rows = keyed(documents, id_col, text_col, rest=True)
    return restored(repeated(rows, method(name_rounds(rows.select("text"))), _finish(True), _schema(rows)), documents, text_col)


ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, s, sha256(array_to_string(w[s:s + {WINDOW - 1}], ' ')) AS win FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - {WINDOW - 1})) AS s FROM d WHERE len(w) >= {WINDOW})),
r AS (SELECT doc_id, s FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY win) AS least FROM p) WHERE least < doc_id),
c AS (SELECT doc_id, list(DISTINCT pos) AS gone FROM (SELECT doc_id, unnest(generate_series(s, s + {WINDOW - 1})) AS pos FROM r) GROUP BY doc_id),
t AS (SELECT doc_id, pos, w[pos] AS word FROM (SELECT d.doc_id, w, unnest(generate_series(1, len(w))) AS pos FROM d JOIN c USING (doc_id))),
k AS (SELECT t.doc_id, string_agg(word, ' ' ORDER BY pos) AS kept FROM t JOIN c USING (doc_id) WHERE NOT list_contains(gone, pos) GROUP BY t.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE coalesce(kept, '') END) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)
"""
