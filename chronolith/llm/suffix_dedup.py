"""Suffix-array dedup: repeated strings of 100 bytes by interval expansion on a Burrows-Wheeler transform.

Texts are UTF-8 bytes. Every byte that lies in a 100-byte string which also starts earlier (in a
document with a smaller id, or in the same document before) is removed; strings are judged on the
input.  Strings that are alike meet through their anchors, the least hashed 24-gram in them (see
``anchored``).  The different segments that share an anchor are joined to one text, whose suffix
array is sorted to the depth needed.  On its Burrows-Wheeler transform the intervals of
suffixes with a common prefix are expanded breadth-first by backward extension: an interval of depth d
that a boundary splits also splits, one symbol earlier, the suffixes that reach into both
parts, so that each round finds exactly the common prefixes of value d + 1.  The expansion stops
at the minimum length; what is still undivided then shares at least 100 bytes, and all but its
earliest member repeat.

Defined results: a null text is empty; texts shorter than 100 bytes stay whole; rows without an id come
first in order; rows that repeat an id are documents of their own, ordered by their texts;
columns beside id and text are ignored by the report and kept by the rewriting form.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from .anchored import BUCKET, Method, _lists, keyed, repeated, restored, spans
from .text_arrays import CHUNK_BYTES, U64, byte_view, chunks, eights, gram_names

LENGTH, GRAM = 100, 24
_MAX = U64(0xFFFFFFFFFFFFFFFF)


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by doubling."""
    done = 1
    while done * 2 <= width:
        v = np.minimum(v[:-done], v[done:])
        done *= 2
    return np.minimum(v[: len(v) - (width - done)], v[width - done :]) if done < width else v


def _anchors(length: int, gram: int):
    def anchors(raw, off):
        if len(raw) < length:
            z = np.zeros(0, np.int64)
            return z.view(U64), z, z, None
        names = gram_names(raw, gram)
        least = sliding_min(names, length - gram + 1)
        size = np.diff(off)
        fits = np.maximum(size - length + 1, 0)
        doc = np.repeat(np.arange(len(size)), fits)
        start = np.arange(len(doc)) - np.repeat(np.cumsum(fits) - fits, fits)
        place = start + off[:-1][doc]
        data = raw.tobytes()
        # Equal windows in one segment hold its anchor at two places: one starts a window, another ends one.
        starts = place[names[place] == least[place]]
        ends = place[names[place + length - gram] == least[place]]

        def hashed(first, last):
            a, z = place[first], place[last]
            one = np.append(starts, len(raw))[np.searchsorted(starts, a)]
            other = np.append(ends, -length)[np.searchsorted(ends, z, side="right") - 1]
            inner = (one <= z) & (other >= a) & (other + length - gram > one)
            digests = np.frombuffer(b"".join([xxh3_128_digest(data[i:j]) for i, j in zip(a.tolist(), (z + length).tolist())]), U64).reshape(-1, 2)
            return digests[:, 0], digests[:, 1], inner

        return least[place], doc, start, hashed

    return anchors


def _slices(length: int):
    def slices(raw):
        for a in range(0, len(raw) - length + 1, CHUNK_BYTES):
            yield a, min(a + CHUNK_BYTES + length - 1, len(raw)), a

    return slices


def _payload(length: int):
    def payload(raw, off, doc, start, n):
        size = n.astype(np.int64) + length - 1
        at = np.concatenate(([0], np.cumsum(size)))
        data = raw[np.repeat(off[doc] + start - at[:-1], size) + np.arange(at[-1])]
        return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])

    return payload


def _buckets(length: int, gram: int):
    core = length - BUCKET + 1

    def buckets(content, n, anchor):
        data, off = byte_view(content)
        of = np.repeat(np.arange(len(n)), n)
        within = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        window = off[:-1][of] + within
        # The anchor's first place in each window; equal windows hold it at the same.
        places = np.flatnonzero(gram_names(data, gram) == np.repeat(anchor.view(U64), np.diff(off))[: len(data) - gram + 1])
        hold = places[np.searchsorted(places, window)]
        bucket, back = np.divmod(hold - window, BUCKET)
        new = np.ones(len(of), bool)
        new[1:] = (of[1:] != of[:-1]) | (hold[1:] != hold[:-1]) | (bucket[1:] != bucket[:-1])
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(of)))
        text = data.tobytes()
        begin = window[head] + back[head]
        names = np.array([xxh3_64_intdigest(text[i : i + core]) for i in begin.tolist()], U64)
        at = np.concatenate(([0], np.cumsum(size + length - 1)))
        inside = data[np.repeat(window[head] - at[:-1], size + length - 1) + np.arange(at[-1])]
        out = pa.Array.from_buffers(pa.binary(), len(head), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(inside)])
        return names, of[head], within[head], size, BUCKET - 1 - back[head], out

    return buckets


def _cores(length: int):
    def cores(raw, off, place):
        return raw[(off[:-1] + BUCKET - 1 - place)[:, None] + np.arange(length - BUCKET + 1)]

    return cores


def _codes(length: int):
    def codes(raw, off, n, place):
        of = np.repeat(np.arange(len(n)), n)
        within = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        window, at = off[:-1][of] + within, (place[of] + within).astype(U64)
        # Of BUCKET - 1 bytes outside of the core those before it, then those behind it, then the place.
        eight, before = eights(raw), U64(8) * (U64(BUCKET - 1) - at)
        left = eight[window] & ((U64(1) << before) - U64(1))
        right = eight[window + length - at.astype(np.int64)] & ((U64(1) << (U64(8) * at)) - U64(1))
        return (left | right << before) << U64(8) | at

    return codes


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes' starts, sorted by their first ``depth`` bytes at least (prefix doubling from eight bytes)."""
    n = len(text)
    padded = np.concatenate((text, np.zeros(8, np.uint8))).astype(U64)
    first = np.zeros(n, U64)
    for i in range(8):
        first = (first << U64(8)) | padded[i : i + n]
    order, known = np.argsort(first), 8
    value = first
    while True:
        ranked = value[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(ranked[1:] != ranked[:-1])))
        if known >= depth or rank[order[-1]] == n - 1:
            return order
        second = np.zeros(n, np.int64)
        second[: max(0, n - known)] = rank[known:] + 1
        value = rank * (n + 1) + second
        order = np.argsort(value)
        known *= 2


_ONES = U64(0x0101010101010101)
_UP_TO = U64(0xFFFFFFFFFFFFFFFF) >> (U64(56) - U64(8) * np.arange(8, dtype=U64))


def _boundaries(eight: np.ndarray, before: np.ndarray, place: np.ndarray) -> np.ndarray:
    """How many boundaries stand up to each place; ``eight`` holds one byte for each place, ``before`` the number before each eight."""
    block = place >> 3
    return before[block] + (((eight[block] & _UP_TO[place & 7]) * _ONES) >> U64(56))


def common_prefix_classes(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, class of each rank): suffixes are in one class if their first ``length`` bytes agree."""
    n = len(text)
    sa = suffix_array(text, length + 1)
    rank = np.empty(n, np.int64)
    rank[sa] = np.arange(n)
    # psi undoes the transform's last-to-first mapping: the rank of the suffix one symbol later.
    psi = rank[np.minimum(sa + 1, n - 1)]
    symbol = text[sa]
    eight = np.zeros(n // 8 + 1, U64)
    boundary = eight.view(bool)[:n]
    boundary[0] = True
    boundary[1:] = symbol[1:] != symbol[:-1]
    ends = np.flatnonzero(sa == n - 1)
    boundary[ends] = True
    boundary[np.minimum(ends + 1, n - 1)] = True
    open_ = np.flatnonzero(~boundary)
    low, high = psi[open_ - 1], psi[open_]
    near = high == low + 1  # no boundary but that at ``high`` can part them
    one, far = (open_[near], high[near]), (open_[~near], low[~near], high[~near])
    count = -1
    for _ in range(1, length):
        per = (eight * _ONES) >> U64(56)
        before = np.cumsum(per) - per
        if before[-1] + per[-1] == count:
            break
        count = before[-1] + per[-1]
        split = np.take(boundary, one[1], mode="clip")
        parted = _boundaries(eight, before, far[2]) != _boundaries(eight, before, far[1])
        boundary[one[0][split]] = True
        boundary[far[0][parted]] = True
        # Those that are parted stay so, and may wait.
        if np.count_nonzero(split) * 8 > len(split):
            one = tuple(x[~split] for x in one)
        if np.count_nonzero(parted) * 8 > len(parted):
            far = tuple(x[~parted] for x in far)
    return sa, np.cumsum(boundary) - 1


def _verify(length: int):
    def verify(contents, n, key, start):
        raw, off = byte_view(contents)
        size = np.diff(off)
        text = np.full(len(raw) + len(size), 0xFF, np.uint8)  # a byte that no UTF-8 text holds ends each segment
        shift = np.repeat(np.arange(len(size)), size)
        text[np.arange(len(raw)) + shift] = raw
        sa, classes = common_prefix_classes(text, length)
        begin = off[:-1] + np.arange(len(size))
        of = np.repeat(np.arange(len(n)), n)
        within = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        window = begin[of] + within
        turn = np.empty(len(of), np.int64)
        turn[np.lexsort((start[of] + within, key[of]))] = np.arange(len(of))
        rank = np.empty(len(text), np.int64)
        rank[sa] = np.arange(len(sa))
        cls = classes[rank[window]]
        first = np.full(int(classes[-1]) + 1, len(of), np.int64)
        np.minimum.at(first, cls, turn)
        return turn > first[cls]

    return verify


def method(length: int = LENGTH, gram: int = GRAM) -> Method:
    parts = (_buckets(length, gram), _cores(length), _codes(length)) if length > 2 * BUCKET else ()
    return Method(_anchors(length, gram), _slices(length), _payload(length), _verify(length), True, *parts)


def _finish(length: int, rewrite: bool):
    def run(batches):
        for b in batches:
            at, marks = _lists(b.column(2))
            for row, end, raw, off in chunks(b.column(1)):
                removed = {}
                for r, s, e in spans(at, marks, range(row, end)):
                    change = np.zeros(off[r - row + 1] - off[r - row] + 1, np.int32)
                    np.add.at(change, s, 1)
                    np.add.at(change, e + length - 1, -1)
                    removed[r] = np.cumsum(change[:-1]) > 0
                n, out, runs, kept = np.diff(off), np.zeros(end - row, np.int64), np.zeros(end - row, np.int64), []
                for r in range(row, end):
                    data = raw[off[r - row] : off[r - row + 1]]
                    if r in removed:
                        gone = removed[r]
                        out[r - row] = gone.sum()
                        runs[r - row] = (gone & ~np.concatenate(([False], gone[:-1]))).sum()
                        data = data[~gone]
                    kept.append(data.tobytes() if rewrite else hashlib.sha256(data.data).hexdigest())
                last = pa.array([x.decode("utf-8", "ignore") for x in kept] if rewrite else kept, pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(row, end - row), pa.array(n), pa.array(out), pa.array(runs), last, *[b.column(i).slice(row, end - row) for i in range(3, b.num_columns)]], ["id", "n_bytes", "n_removed", "n_spans", "kept", *b.schema.names[3:]])

    return run


SCHEMA = "n_bytes long, n_removed long, n_spans long, kept string"


def _schema(rows: DataFrame) -> str:
    """What becomes of ``rows``: the id, the figures and the other columns."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return f"id {kinds['id']}, {SCHEMA}" + (f", rest {kinds['rest']}" if "rest" in kinds else "")


def repeated_bytes(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of each row."""
    rows = keyed(documents, id_col, text_col)
    return repeated(rows, method(length, gram), _finish(length, False), _schema(rows)).withColumnsRenamed({"id": id_col, "kept": "kept_sha256"})


def without_repeats(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``documents`` with its repeated bytes taken out of the texts, a character cut in two whole; null texts become empty."""
    rows = keyed(documents, id_col, text_col, rest=True)
    return restored(repeated(rows, method(length, gram), _finish(length, True), _schema(rows)), documents, text_col)


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, s, substr(h, CAST(2 * s + 1 AS BIGINT), {2 * LENGTH}) AS w FROM (SELECT doc_id, h, unnest(generate_series(0, length(h) // 2 - {LENGTH})) AS s FROM d WHERE length(h) >= {2 * LENGTH})),
r AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY w ORDER BY doc_id, s) AS n FROM p) WHERE n > 1),
g AS (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM (SELECT doc_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= {LENGTH} THEN 0 ELSE 1 END AS fresh FROM r)),
x AS (SELECT doc_id, min(s) AS a, max(s) + {LENGTH} AS z FROM g GROUP BY doc_id, run),
y AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS following FROM x),
k AS (SELECT y.doc_id, sum(z - a) AS n_removed, count(*) AS n_spans,
        string_agg(substr(h, CAST(2 * before + 1 AS BIGINT), CAST(2 * (a - before) AS BIGINT)) || CASE WHEN following IS NULL THEN substr(h, CAST(2 * z + 1 AS BIGINT)) ELSE '' END, '' ORDER BY a) AS kept
      FROM y JOIN d USING (doc_id) GROUP BY y.doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
