"""NumPy views of Arrow text columns, shared by the operators that scan whole texts.

Every helper works on a *chunk*: some consecutive documents of one Arrow batch whose
texts together stay near ``CHUNK_BYTES`` (a longer document is a chunk of its own) and ``CHUNK_ROWS``
rows, so that memory follows the chunk and not the batch.  A null text counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

CHUNK_BYTES, CHUNK_ROWS = 1 << 19, 1 << 12
U64 = np.uint64


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; offsets has one entry more than rows."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    elif not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def chunks(column: pa.Array, size: int = CHUNK_BYTES, rows: int = CHUNK_ROWS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for runs of documents of about ``size`` bytes and ``rows`` rows at most."""
    raw, off = byte_view(column)
    n, row = len(off) - 1, 0
    while row < n:
        end = int(np.searchsorted(off, off[row] + size, side="right")) - 1
        end = min(n, max(end, row + 1), row + rows)
        yield row, end, raw[off[row] : off[end]], off[row : end + 1] - off[row]
        row = end


def same_ranges(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether a[at : at + size] and b[bt : bt + size] are equal, for each range."""
    ends = np.cumsum(size)
    before, step = ends - size, np.arange(int(ends[-1]) if len(ends) else 0)
    differs = a[np.repeat(at - before, size) + step] != b[np.repeat(bt - before, size) + step]
    if not differs.any():
        return np.ones(len(size), bool)
    wrong = np.concatenate(([0], np.cumsum(differs)))
    return wrong[ends] == wrong[ends - size]


def owner(off: np.ndarray) -> np.ndarray:
    """For each position, the number of the document that holds it."""
    return np.repeat(np.arange(len(off) - 1), np.diff(off))


def parts(raw: np.ndarray, over: int, step: int = 1, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, int]]:
    """(from, to, end) of parts of one long text: whole numbers of ``step`` code points, but for the last, and ``over`` more behind them up to ``end``."""
    a = 0
    while a < len(raw):
        first = np.flatnonzero((raw[a : a + size] & 0xC0) != 0x80)
        n = (len(first) - 1) // step * step
        z = a + int(first[n]) if a + size < len(raw) and n > 0 else min(len(raw), a + size) if n <= 0 else len(raw)
        behind = np.flatnonzero((raw[z : z + 4 * over + 4] & 0xC0) != 0x80)
        yield a, z, z + int(behind[over]) if len(behind) > over else len(raw)
        a = z


def is_long(off: np.ndarray) -> bool:
    """Whether a chunk is one text that is worked off in parts."""
    return len(off) == 2 and off[1] > 2 * CHUNK_BYTES


@lru_cache(maxsize=1)
def _lower_table() -> np.ndarray:
    table = np.arange(1 << 16, dtype=np.uint32)
    for i in range(1 << 16):
        if not 0xD800 <= i < 0xE000 and len(low := chr(i).lower()) == 1:
            table[i] = ord(low)
    return table


def code_points(raw: np.ndarray, off: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a chunk with the documents' offsets in them; ill-formed UTF-8 is read as Latin-1."""
    try:
        cp = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        starts = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
        coff = starts[off]
    except UnicodeDecodeError:
        cp, coff = raw.astype(np.uint32), off
    if lower:
        table = _lower_table()
        small = cp < (1 << 16)
        cp = table[cp] if small.all() else np.where(small, table[np.where(small, cp, 0)], cp)
    return cp, coff


def gram_index(cp: np.ndarray, doc: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed index (``bits`` wide) of each character n-gram, with the document it lies in whole."""
    size = len(cp) - n + 1
    if size <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.full(size, 0x9E3779B1 * n & 0xFFFFFFFF, np.uint32)
    for i in range(n):
        h *= np.uint32(0x85EBCA6B)
        h += cp[i : i + size]
        h ^= h >> np.uint32(15)
    h *= np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x27D4EB2F)
    h >>= np.uint32(32 - bits)
    first = doc[:size]
    inside = first == doc[n - 1 :]
    if inside.all():
        return h.astype(np.int64), first
    return h[inside].astype(np.int64), first[inside]


#: Bytes that end a word: the blank and the control characters from tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word number of each document and the total) of maximal runs of non-space bytes."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    word = ~SPACE[raw]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


#: Seeds of independent hashes.
SEEDS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0x94D049BB133111EB)


def join64(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Names of pairs by the names of their parts; the order matters."""
    h = x * U64(0x9FB21C651E98DF25)
    h += y
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(29)
    return h


def range_hash(values: np.ndarray, which: int = 0):
    """A function of (starts, ends) that gives 64-bit hashes of ranges of ``values`` (uint64).

    Equal ranges get equal hashes wherever they stand.  Blocks of 1, 2, 4, .. values are named by joining the
    names of their halves, and a range by the two blocks of the greatest such length that cover it.  Each
    join is mixed, so that the hash isn't linear in the values: polynomials modulo a power of two give equal
    hashes to whole families of words (those of Thue and Morse), whatever the base.
    """
    single = mix64(values + U64(SEEDS[which]))

    def of(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        length = ends - starts
        out = np.zeros(len(starts), U64)
        if len(length) and (length == length[0]).all():
            present = np.array([int(length[0]).bit_length() - 1])
        else:
            level = np.frexp(length.astype(float))[1] - 1  # -1 for empty ranges
            present = np.flatnonzero(np.bincount(level + 1)) - 1
        h = single
        for k in range(int(present.max(initial=-1)) + 1):
            if k:
                half = 1 << (k - 1)
                h = join64(h[:-half], h[half:])
            if k in present:
                some = slice(None) if len(present) == 1 else np.flatnonzero(level == k)
                a, z = starts[some], ends[some]
                out[some] = join64(h[a], h[z - (1 << k)]) + (z - a).astype(U64) * U64(0x632BE59BD9B4E019)
        return mix64(out)

    return of


@lru_cache(maxsize=1)
def byte_values() -> np.ndarray:
    """A fixed 64-bit value for each byte."""
    return mix64((np.arange(256, dtype=U64) + U64(1)) * U64(0x9E3779B97F4A7C15))


def eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, with zeros behind the end."""
    return np.ndarray(len(raw) + 1, "<u8", np.concatenate((raw, np.zeros(8, np.uint8))), strides=(1,))


def gram_names(raw: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` (8 or more) bytes from each place on."""
    n, eight = len(raw) - gram + 1, eights(raw)
    h = np.full(n, SEEDS[0], U64)
    for at in [*range(0, gram - 8, 8), gram - 8]:
        h = join64(h, eight[at : at + n])
    return mix64(h)


#: Longer words are hashed one by one.
LONG_WORD = 256


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hashes of words by their bytes."""
    eight, size = eights(raw), ends - starts
    h = mix64(size.astype(U64) + U64(SEEDS[which]))
    some = np.flatnonzero((size > 0) & (size <= LONG_WORD))
    at, left = starts[some], size[some]
    while len(some):
        w = eight[at]
        short = np.flatnonzero(left < 8)
        w[short] &= (U64(1) << (left[short] * 8).astype(U64)) - U64(1)
        h[some] = join64(h[some], w)
        on = np.flatnonzero(left > 8)
        some, at, left = some[on], at[on] + 8, left[on] - 8
    for i in np.flatnonzero(size > LONG_WORD):
        h[i] = xxhash.xxh64_intdigest(raw[starts[i] : ends[i]].tobytes(), SEEDS[which])
    return mix64(h)
