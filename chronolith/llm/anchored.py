"""Repeated windows across a corpus: content-defined segments meet by their anchors and are verified.

The frame that the suffix-array and the recompression operators share.  A *window* is a fixed number of units
(bytes, words) of one document.  Each window has an *anchor*, a name computed from the window's own
content, so that equal windows have equal anchors; a *segment* is a run of windows with one anchor.

1. ``segments``: documents give segments (anchor, two hashes of the content, place).  Equal segments of
   one task are merged before the shuffle: all but the first are known to repeat.  Those of a chunk are
   merged all, those of the task as far as a table of ``SEEN`` contents remembers them, so that a content
   that very many documents share costs about a row for each task.
2. ``meet``: segments sorted by anchor and content stream through; later equal segments repeat whole, and
   a segment that shares its anchor with different ones is a candidate.  Nothing else goes on.
3. ``payloads``: documents joined with their candidates emit these segments' contents.
4. ``verify``: contents that share an anchor are compared by the operator's own method, which says for each
   window whether it repeats an earlier one.
5. ``cover``: documents joined with all that repeats in them are handed to the operator's last step.

Segments are equal if their anchors and both hashes are, 192 bits; windows are compared by bytes or words.
A group of copies costs a row for each task and segment, not pairs, and candidates are
different contents only.  Step 4 holds one anchor's different contents at a time, and they are bounded: an
anchor with more than ``HOT_ROWS`` candidates (a passage that very many documents share, in surroundings that
differ) is *hot*, and the more of a corpus' anchors are, the larger it is.  The candidates of a hot anchor go on in one of two forms.
Equal rows of either are merged in each chunk before the shuffle, and no contents are ever gathered.

* An operator with ``buckets`` cuts them in *buckets*, up to a few neighbouring windows, by the place of the anchor in the window,
  each under a hash of the core that all windows of the bucket hold.  In step 4 the buckets of a core stream past it; the core is compared
  by bytes, and a window is told by the few bytes of it outside of the core, of which the distinct ones are kept.
* Else they go on as single windows, each under a hash of its whole content, and in step 4 stream past the earliest of
  them, compared with it byte by byte.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from xxhash import xxh3_128_digest

from .components import cut
from .text_arrays import CHUNK_BYTES, U64, byte_view, chunks

#: Windows of a bucket, at most: what they hold outside of the core, and their place, are one number of 64 bits.
BUCKET = 8
#: Kinds of segments: known to repeat whole; with equal windows inside.
WHOLE, INNER = 1, 2
#: A run of windows with one anchor is cut after so many.
LONGEST_RUN = 512
#: Contents of so many bytes, and of whole anchors, are verified together.
BATCH_BYTES = 1 << 19
#: An anchor with more candidates is split by its windows; so many windows are written out at a time.
HOT_ROWS, WINDOWS_AT_ONCE = 1 << 11, 1 << 13
#: Contents that a task remembers; candidates whose contents are written out at a time.
SEEN, CONTENTS_AT_ONCE = 1 << 16, 1 << 13


@dataclass(frozen=True)
class Method:
    """What an operator adds.

    ``anchors(bytes, offsets)``: for each window of a chunk its anchor, its document and its start in units from the
    document's start, and a function (first windows, last windows) that gives two hashes of each segment and whether a
    segment may hold equal windows itself.
    ``slices(bytes)``: a very long document's parts (from, to, units before), such that each window lies whole in one
    and no two parts hold the same window.
    ``payload(bytes, offsets, documents, starts, numbers of windows)``: segments' contents, as an Arrow binary array.
    ``verify(contents, numbers of windows, documents, starts)``: one flag for each window of each segment in turn.
    ``within``: whether windows of one document repeat each other, too.
    ``buckets(contents, numbers of windows, anchors)``: segments' buckets: the core's name, the segment, the first window in it, the number
    of windows, the first one's place in the bucket, and contents.  Only for ``within``.
    ``cores(bytes, offsets, places)``: a row of units for each bucket, its core.
    ``codes(bytes, offsets, numbers of windows, places)``: for each window of each bucket in turn a number; windows are equal if cores and numbers are.
    """

    anchors: Callable
    slices: Callable
    payload: Callable
    verify: Callable
    within: bool
    buckets: Callable | None = None
    cores: Callable | None = None
    codes: Callable | None = None


def keyed(documents: DataFrame, id_col: str, text_col: str, rest: bool = False) -> DataFrame:
    """(key, id, text[, rest]) with unique keys in the order of the ids; rows that repeat an id follow each other by text.

    Whole numbers are ids as longs, other ids keep their type and its order.  ``rest`` holds all columns but the text, as they were.
    """
    whole = isinstance(documents.schema[id_col].dataType, IntegralType)
    others = [F.struct(*[documents[c].alias(f"c{i}") for i, c in enumerate(documents.columns) if c != text_col]).alias("rest")] if rest else []
    named = documents[id_col].cast("long") if whole else documents[id_col]
    rows = documents.select(named.alias("id"), documents[text_col].cast("string").alias("text"), *others)
    if not whole or rows.groupBy("id").count().where((F.col("count") > 1) | F.col("id").isNull()).limit(1).count():
        rows = cut(rows.repartitionByRange("id", "text").sortWithinPartitions("id", "text"))
        return cut(rows.select(F.monotonically_increasing_id().alias("key"), *rows.columns))
    return rows.select(F.col("id").alias("key"), *rows.columns).where(F.col("key").isNotNull())  # none is null here


def restored(out: DataFrame, documents: DataFrame, text_col: str, *more: str) -> DataFrame:
    """The columns of ``documents`` from (text, rest) and ``more`` behind them."""
    names = documents.columns
    return out.select(*[F.col("kept").alias(c) if c == text_col else F.col(f"rest.c{i}").alias(c) for i, c in enumerate(names)], *more)


def _runs(anchor: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) window of each segment."""
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(anchor)))
    parts = -(-size // LONGEST_RUN)
    if len(parts) and parts.max() > 1:
        step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first = np.repeat(first, parts) + step * LONGEST_RUN
    return first, np.append(first[1:], len(anchor)) - 1


class _Seen:
    """The earliest place of contents that a task has met, by a table in which each newer content takes its slot."""

    def __init__(self, size: int):
        self.size = size
        self.names, self.key, self.start = np.zeros((3, size), U64), np.zeros(size, np.int64), np.full(size, -1, np.int64)

    def later(self, a, h, h2, key, start, within: bool) -> np.ndarray:
        """Which rows repeat a content that was met before at an earlier place; the others are met now."""
        slot = ((a ^ h) % U64(self.size)).astype(np.int64)
        known = (self.start[slot] >= 0) & (self.names[0, slot] == a) & (self.names[1, slot] == h) & (self.names[2, slot] == h2)
        again = known & (key > self.key[slot])
        if within:
            again |= known & (key == self.key[slot]) & (start > self.start[slot])
        new = ~again
        for column, values in zip((*self.names, self.key, self.start), (a, h, h2, key, start)):
            column[slot[new]] = values[new]
        return again


def _parts(slices: Callable, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
    """Chunks (first row, end row, bytes, offsets, units before); a very long document comes in parts."""
    for row, end, raw, off in chunks(column):
        if len(raw) <= 2 * CHUNK_BYTES:
            yield row, end, raw, off, 0
        else:
            for a, z, before in slices(raw):
                yield row, end, raw[a:z], np.array([0, z - a]), before


def _segments(method: Method):
    def run(batches):
        seen = _Seen(SEEN)
        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False)
            for row, end, raw, off, before in _parts(method.slices, b.column(1)):
                anchor, doc, start, hashed = method.anchors(raw, off)
                if not len(anchor):
                    continue
                first, last = _runs(anchor, doc)
                a, (h, h2, inner) = anchor[first], hashed(first, last)
                key, start, n = keys[row:end][doc[first]], start[first] + before, last - first + 1
                order = np.lexsort((start, key, h, a))
                a, h, h2, key, start, n, inner = (x[order] for x in (a, h, h2, key, start, n, inner))
                same = np.concatenate(([False], (a[1:] == a[:-1]) & (h[1:] == h[:-1]) & (h2[1:] == h2[:-1])))
                head = np.maximum.accumulate(np.where(same, 0, np.arange(len(a))))
                whole = same if method.within else same & (key > key[head])
                some = np.flatnonzero(~whole)
                whole[some] = seen.later(a[some], h[some], h2[some], key[some], start[some], method.within)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.where(whole, key.view(U64), a).view(np.int64)), pa.array(h.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(key), pa.array(start), pa.array(n.astype(np.int32)), pa.array(np.where(whole, WHOLE, np.where(inner, INNER, 0)).astype(np.int8))],
                    ["anchor", "content", "content2", "key", "start", "n", "kind"],
                )

    return run


class _Counted:
    """Candidates in the order of their anchors, each with the flag whether its anchor has more than ``most`` of them."""

    def __init__(self, most: int):
        self.most, self.waiting, self.hot = most, [], None  # the last anchor's rows, until they end or are too many; the last hot anchor

    def push(self, rows: list[tuple], end: bool = False) -> tuple:
        """Columns (key, start, n, anchor, hot) that are decided by now."""
        columns = [np.concatenate(x) for x in zip(*self.waiting, *rows)] or [np.zeros(0, np.int64)] * 4
        anchor = columns[3]
        first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1]))) if len(anchor) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(anchor)))
        hot = size > self.most
        if len(first) and anchor[0] == self.hot:
            hot[0] = True
        done = len(anchor)
        if len(first) and hot[-1]:
            self.hot = anchor[-1]
        elif len(first) and not end:
            done = first[-1]
        self.waiting = [tuple(c[done:] for c in columns)] if done < len(anchor) else []
        return *(c[:done] for c in columns), np.repeat(hot, size)[:done]


def _marks(key, start, n, anchor, hot=None) -> pa.RecordBatch:
    """Rows known to repeat whole, or candidates if ``hot`` is given."""
    whole = np.full(len(key), hot is None)
    hot = np.zeros(len(key), bool) if hot is None else hot
    return pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(start.astype(np.int64)), pa.array(n.astype(np.int32)), pa.array(whole), pa.array(anchor.astype(np.int64)), pa.array(hot)], ["key", "start", "n", "whole", "anchor", "hot"])


def _meet(method: Method):
    """Marks rows sorted by anchor, content, key and start: those that repeat whole, and candidates."""

    def run(batches):
        counted = _Counted(HOT_ROWS)
        held = None  # the first row of the last anchor, while all of that anchor's rows were equal to it
        last = None  # (anchor, both hashes, key) that the last content began with
        for b in batches:
            if not b.num_rows:
                continue
            a, h, h2, key, start, n, kind = (b.column(i).to_numpy(zero_copy_only=False) for i in range(7))
            whole = kind == WHOLE
            yield _marks(key[whole], start[whole], n[whole], a[whole])
            a, h, h2, key, start, n, inner = (x[~whole] for x in (a, h, h2, key, start, n, kind == INNER))
            if len(a):
                before_a, before_h = np.concatenate(([last[0] if last else ~a[0]], a[:-1])), np.concatenate(([last[1] if last else ~h[0]], h[:-1]))
                same_a = a == before_a
                before_2 = np.concatenate(([last[2] if last else ~h2[0]], h2[:-1]))
                same = same_a & (h == before_h) & (h2 == before_2)
                head = np.maximum.accumulate(np.where(same, -1, np.arange(len(a))))
                head_key = np.where(head >= 0, key[np.maximum(head, 0)], last[3] if last else 0)
                full = same & (method.within | (key > head_key))
                fresh = ~same
                cand = (fresh & same_a) | (same & ~full)
                opener = np.flatnonzero(fresh & ~same_a)  # the first row of each anchor
                following = np.flatnonzero(fresh)
                nxt = following[np.searchsorted(following, opener, side="right") % max(1, len(following))]
                cand[opener] = (nxt > opener) & (a[nxt] == a[opener]) | inner[opener]
                yield _marks(key[full], start[full], n[full], a[full])
                rows = [(key[cand], start[cand], n[cand], a[cand])]
                if held is not None and len(following) and following[0] < len(a) and a[following[0]] == held[0]:
                    rows.insert(0, tuple(np.array([x]) for x in (held[1], held[2], held[3], held[0])))
                yield _marks(*counted.push(rows))
                if len(following):
                    held = None
                    if len(opener) and opener[-1] == following[-1] and not inner[opener[-1]]:
                        i = opener[-1]
                        held = (a[i], key[i], start[i], n[i])
                last = (a[-1], h[-1], h2[-1], head_key[-1])
        yield _marks(*counted.push([], end=True))

    return run


def _lists(column: pa.Array) -> tuple[np.ndarray, pa.StructArray]:
    """(offsets, values) of a list column; nulls are empty."""
    return np.concatenate(([0], np.cumsum(_sizes(column), dtype=np.int64))), column.flatten()


def _sizes(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)


def _contents(anchor, key, start, n, content=None, place=None) -> pa.RecordBatch:
    """Rows of the table of contents; without ``content`` they are known to repeat whole, and with ``place`` they are buckets."""
    content = pa.nulls(len(key), pa.binary()) if content is None else content
    place = np.full(len(key), -1) if place is None else place
    return pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(key), pa.array(start), pa.array(n.astype(np.int32)), content, pa.array(place.astype(np.int8))], ["anchor", "key", "start", "n", "content", "place"])


def _runs_of(row, start, n) -> tuple[np.ndarray, np.ndarray]:
    """(first, total of windows) of neighbouring segments in order of row and start."""
    new = np.concatenate(([True], (row[1:] != row[:-1]) | (start[1:] != start[:-1] + n[:-1])))
    head = np.flatnonzero(new)
    return head, np.add.reduceat(n.astype(np.int64), head)


def _digests(content: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each content."""
    data, ends = byte_view(content)
    text = data.tobytes()
    return tuple(np.frombuffer(b"".join([xxh3_128_digest(text[i:j]) for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]), U64).reshape(-1, 2).T)


def _windows(method: Method, raw, off, row, keys, start, n, at_once) -> Iterator[pa.RecordBatch]:
    """Contents of each single window of hot segments, under its hash; equal ones but the earliest repeat whole."""
    begin = np.concatenate(([0], np.cumsum(n, dtype=np.int64)))
    for a in range(0, int(begin[-1]), at_once):
        at = np.arange(a, min(a + at_once, int(begin[-1])))
        of = np.searchsorted(begin, at, side="right") - 1
        place, doc, one = start[of] + at - begin[of], row[of], np.ones(len(at), np.int32)
        content = method.payload(raw, off, doc, place, one)
        names = _digests(content)
        yield from _merged(method, names[0], names, doc, keys[doc], place, one, content, np.full(len(at), -1))


def _buckets(method: Method, raw, off, row, keys, start, n, anchor, at_once) -> Iterator[pa.RecordBatch]:
    """Contents of the buckets of hot segments, under their cores' names; equal ones but the earliest repeat whole."""
    ends = np.cumsum(n, dtype=np.int64)
    a = 0
    while a < len(n):
        some = slice(a, max(a + 1, int(np.searchsorted(ends, ends[a] - n[a] + at_once, side="right"))))
        core, of, first, size, place, content = method.buckets(method.payload(raw, off, row[some], start[some], n[some]), n[some].astype(np.int64), anchor[some])
        of += a
        yield from _merged(method, core, _digests(content), row[of], keys[row[of]], start[of] + first, size, content, place)
        a = some.stop


def _merged(method: Method, anchor, names, doc, key, start, n, content, place) -> Iterator[pa.RecordBatch]:
    """Rows of one chunk with two hashes (``names``) of their contents; those that equal an earlier one repeat whole."""
    order = np.lexsort((start, key, place, *names[::-1]))
    x, y, p, k = names[0][order], names[1][order], place[order], key[order]
    same = np.concatenate(([False], (x[1:] == x[:-1]) & (y[1:] == y[:-1]) & (p[1:] == p[:-1])))
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(x))))
    whole = same if method.within else same & (k > k[head])
    w = np.flatnonzero(whole)
    if len(w):
        equal = pc.equal(content.take(pa.array(order[w])), content.take(pa.array(order[head[w]])))
        whole[w] = equal.to_numpy(zero_copy_only=False)
    some = order[~whole]
    yield _contents(anchor[some].view(np.int64), key[some], start[some], n[some], content.take(pa.array(some)), place[some])
    some = order[whole]
    if len(some):
        some = some[np.lexsort((start[some], doc[some]))]
        head, total = _runs_of(doc[some], start[some], n[some])
        some = some[head]
        yield _contents(key[some], key[some], start[some], total)


def _payloads(method: Method):
    def run(batches):
        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False)
            at, marks = _lists(b.column(2))
            start, n, whole, anchor, hot = (marks.field(i).to_numpy(zero_copy_only=False) for i in range(5))
            row = np.repeat(np.arange(len(keys)), np.diff(at))
            order = np.lexsort((start, row))
            start, n, whole, anchor, hot, row = start[order], n[order], whole[order].astype(bool), anchor[order], hot[order].astype(bool), row[order]
            w = np.flatnonzero(whole)
            if len(w):  # neighbouring segments that repeat whole are one
                head, total = _runs_of(row[w], start[w], n[w])
                key = keys[row[w][head]]
                yield _contents(key, key, start[w][head], total)
            c = np.flatnonzero(~whole)
            for first, end, raw, off in chunks(b.column(1)):
                some = c[np.searchsorted(row[c], first) : np.searchsorted(row[c], end)]
                split, some = some[hot[some]], some[~hot[some]]
                for i in range(0, len(some), CONTENTS_AT_ONCE):
                    part = some[i : i + CONTENTS_AT_ONCE]
                    content = method.payload(raw, off, row[part] - first, start[part], n[part])
                    yield _contents(anchor[part], keys[row[part]], start[part], n[part], content)
                if len(split) and method.buckets:
                    yield from _buckets(method, raw, off, row[split] - first, keys[first:end], start[split], n[split], anchor[split], WINDOWS_AT_ONCE)
                elif len(split):
                    yield from _windows(method, raw, off, row[split] - first, keys[first:end], start[split], n[split], WINDOWS_AT_ONCE)

    return run


class _Cores:
    """Buckets in the order of their cores' names, past the codes met of each; only the last core's are kept from batch to batch."""

    def __init__(self, method: Method):
        self.method, self.name, self.core, self.codes = method, None, None, None

    def push(self, b: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray]:
        """(key, start, n, bits) of those that hold repeated windows, and which rows have another core than the first of their name."""
        name, key, start, n, place = (b.column(i).to_numpy() for i in (0, 1, 2, 3, 5))
        raw, off = byte_view(b.column(4))
        goes_on = self.name == name[0]
        new = np.concatenate(([not goes_on], name[1:] != name[:-1]))
        group = np.cumsum(new) - (not goes_on)
        cores = self.method.cores(raw, off, place)
        first = cores[new]
        if goes_on:
            first = np.concatenate((self.core[None], first))
        odd = (cores != first[group]).any(1)
        codes = self.method.codes(raw, off, n, place)
        of = np.repeat(np.arange(len(n)), n)
        group = np.where(odd, -1, group)[of]
        order = np.lexsort((codes, group))  # stable, and rows come in the order of key and start
        c, g = codes[order], group[order]
        again = np.zeros(len(codes), bool)
        again[order[1:]] = (c[1:] == c[:-1]) & (g[1:] == g[:-1])
        if goes_on:
            some = np.flatnonzero(group == 0)
            again[some] |= np.isin(codes[some], self.codes)
        again[group < 0] = False
        last = len(first) - 1
        met = np.unique(codes[group == last])
        self.codes = np.union1d(self.codes, met) if goes_on and not last else met
        self.name, self.core = name[-1], first[last]
        at = np.concatenate(([0], np.cumsum(n)))
        hits = np.add.reduceat(again, at[:-1], dtype=np.int64)
        some = np.flatnonzero(hits)
        bits = [None if hits[i] == n[i] else np.packbits(again[at[i] : at[i + 1]]).tobytes() for i in some]
        return pa.RecordBatch.from_arrays([pa.array(key[some]), pa.array(start[some]), pa.array(n[some]), pa.array(bits, pa.binary())], ["key", "start", "n", "bits"]), odd


def _verify(method: Method):
    names = ["key", "start", "n", "bits"]

    def check(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        key, start, n = (t.column(i).to_numpy() for i in (1, 2, 3))
        content = t.column(4).combine_chunks()
        flags = method.verify(content.chunk(0) if isinstance(content, pa.ChunkedArray) else content, n.astype(np.int64), key, start)
        at = np.concatenate(([0], np.cumsum(n)))
        some = np.flatnonzero(np.add.reduceat(flags, at[:-1], dtype=np.int64) > 0) if len(n) else np.zeros(0, np.int64)
        bits = [np.packbits(flags[at[i] : at[i + 1]]).tobytes() for i in some]
        return pa.RecordBatch.from_arrays([pa.array(key[some]), pa.array(start[some]), pa.array(n[some].astype(np.int32)), pa.array(bits, pa.binary())], names)

    def past_first(b: pa.RecordBatch, held: pa.RecordBatch | None) -> tuple[np.ndarray, pa.RecordBatch]:
        """Which single windows repeat the first row of their anchor, and the last anchor's first row; ``held`` is the one before."""
        anchor, key, n = (b.column(i).to_numpy() for i in (0, 1, 3))
        goes_on = held is not None and held.column(0)[0].as_py() == anchor[0]
        new = np.concatenate(([not goes_on], anchor[1:] != anchor[:-1]))
        head = np.maximum.accumulate(np.where(new, np.arange(len(anchor)), -1))  # -1: the row held
        one = n == 1
        held_one, held_key = (held.column(3)[0].as_py() == 1, held.column(1)[0].as_py()) if goes_on else (False, 0)
        later = method.within | (key > np.where(head < 0, held_key, key[head]))
        some = np.flatnonzero(~new & one & np.where(head < 0, held_one, one[head]) & later)
        gone = np.zeros(len(anchor), bool)
        if len(some):
            pool = pa.concat_arrays([(held if goes_on else b.slice(0, 1)).column(4), b.column(4)])
            equal = pc.equal(b.column(4).take(pa.array(some)), pool.take(pa.array(head[some] + 1)))
            gone[some[equal.to_numpy(zero_copy_only=False)]] = True
        return gone, held if head[-1] < 0 else b.take(pa.array(head[-1:]))

    def run(batches):
        parts, size, held, cores = [], 0, None, _Cores(method)
        for b in batches:
            through = b.column(4).is_null()
            whole = b.filter(through)
            if whole.num_rows:
                yield pa.RecordBatch.from_arrays([whole.column(1), whole.column(2), whole.column(3), whole.column(4)], names)
            b = b.filter(through.to_numpy(zero_copy_only=False) == 0) if whole.num_rows else b
            if not b.num_rows:
                continue
            cut_up = b.column(5).to_numpy() >= 0
            if cut_up.any():
                found, odd = cores.push(b.filter(pa.array(cut_up)))
                yield found
                cut_up[cut_up] = ~odd  # cores of one name that differ are compared like segments
                b = b.filter(pa.array(~cut_up))
                if not b.num_rows:
                    continue
            gone, held = past_first(b, held)
            if gone.any():
                rest = b.filter(pa.array(gone))
                yield pa.RecordBatch.from_arrays([rest.column(1), rest.column(2), rest.column(3), pa.nulls(rest.num_rows, pa.binary())], names)
                b = b.filter(pa.array(~gone))
                if not b.num_rows:
                    continue
            anchor = b.column(0).to_numpy()
            # Cut where an anchor ends and enough is gathered.
            edges = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
            lengths = np.concatenate(([0], np.cumsum(pc.binary_length(b.column(4)).to_numpy(zero_copy_only=False))))
            done = 0
            if parts and parts[-1].column(0)[-1].as_py() != anchor[0] and size >= BATCH_BYTES:
                yield check(parts)
                parts, size = [], 0
            for e in edges:
                if size + lengths[e] - lengths[done] >= BATCH_BYTES:
                    yield check([*parts, b.slice(done, e - done)])
                    parts, size, done = [], 0, e
            if done < b.num_rows:
                parts.append(b.slice(done))
                size += lengths[-1] - lengths[done]
        if parts:
            yield check(parts)

    return run


def spans(marks_at: np.ndarray, marks: pa.StructArray, rows: range) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, starts, ends) of runs of repeated windows, in windows, for each row with any; unordered."""
    start, n = marks.field(0).to_numpy(zero_copy_only=False), marks.field(1).to_numpy(zero_copy_only=False)
    bits = marks.field(2).slice(marks_at[rows.start], marks_at[rows.stop] - marks_at[rows.start]).to_pylist()
    base = marks_at[rows.start]
    for row in rows:
        a, z = marks_at[row], marks_at[row + 1]
        if a == z:
            continue
        s, e = [], []
        for i in range(a, z):
            flags = bits[i - base]
            if flags is None:
                s.append(start[i : i + 1])
                e.append(start[i : i + 1] + n[i])
            else:
                on = np.unpackbits(np.frombuffer(flags, np.uint8))[: n[i]].astype(np.int8)
                edge = np.flatnonzero(np.diff(on, prepend=0, append=0))
                s.append(start[i] + edge[::2])
                e.append(start[i] + edge[1::2])
        yield row, np.concatenate(s), np.concatenate(e)


def repeated(rows: DataFrame, method: Method, finish, schema: str) -> DataFrame:
    """``finish`` applied to (id, text, marks, others) of each row of ``rows`` (key, id, text, others); see the module's text for the steps."""
    seg = rows.where(F.col("text").isNotNull()).select("key", "text").mapInArrow(_segments(method), "anchor long, content long, content2 long, key long, start long, n int, kind byte")
    met = seg.repartition("anchor").sortWithinPartitions("anchor", "content", "content2", "key", "start").mapInArrow(_meet(method), "key long, start long, n int, whole boolean, anchor long, hot boolean")
    marked = met.groupBy("key").agg(F.collect_list(F.struct("start", "n", "whole", "anchor", "hot")).alias("marks"))
    # Both joins read the same columns, so that the texts are shuffled once and the exchange is used again.
    others = [c for c in rows.columns if c not in ("key", "text")]
    wanted = rows.join(marked.hint("shuffle_hash"), "key").select("key", "text", "marks", *others)
    contents = wanted.mapInArrow(_payloads(method), "anchor long, key long, start long, n int, content binary, place byte")
    found = contents.repartition("anchor").sortWithinPartitions("anchor", "key", "start").mapInArrow(_verify(method), "key long, start long, n int, bits binary")
    per = found.groupBy("key").agg(F.collect_list(F.struct("start", "n", "bits")).alias("marks"))
    out = rows.join(per.hint("shuffle_hash"), "key", "left").select("id", "text", "marks", *[c for c in others if c != "id"])
    return out.mapInArrow(finish, schema)
