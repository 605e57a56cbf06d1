"""SentencePiece encoding and decoding: distinct sampled segmentations by Gumbel top-k.

A text's segmentations into pieces of the vocabulary are the paths of a lattice.  A path's weight is
the product of its pieces' weights: ``exp(score)`` in a unigram model; a BPE model's scores
are merge ranks, of which Zipf's law makes weights, ``1 / (2 + rank)``.  Characters outside of the
vocabulary are spelled in byte pieces.

Sampling without replacement perturbs the paths' log probabilities with Gumbel noise and takes the
``k`` largest, as a best-first (A*) search over sets of paths: a set's bound is the largest
perturbed value in it, which needs only the set's probability, and that is exact from the
lattice's backward sums.  The first set holds all paths.  The set with the best bound gives up
the path that attains it, drawn edge by edge, and is split into the sets of paths that leave it at
each of its edges, whose bounds are Gumbel values cut off at the path's own.  After ``k`` paths the
best bound left is the threshold ``kappa``, and a path's inclusion score is
``1 - exp(-exp(log_prob - kappa))`` (1 if no path is left).  The noise comes from a hash of the row
key, the seed and the step, so that a row gets the same samples wherever it is computed.

Pieces don't reach over the start of a run of blanks, so that the lattice falls into units (blanks
and what follows); backward sums are computed once for each distinct unit of a chunk of documents.

Defined results: a null or empty text has one segmentation, the empty one (log_prob 0, inclusion 1);
a text with fewer than ``k`` segmentations gives as many rows as it has (sets of paths of a share under 1e-13 count
as empty, so that a text could give fewer: none of the 10,000 of sf0.1 does for k = 2); rows that repeat are sampled
each, alike if their keys are; other columns are ignored. A text that holds U+2581 itself decodes with
blanks in its place, as the library does it, and NUL bytes and blanks come back as they were.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text_arrays import U64, chunks, join64, mix64, owner, same_ranges, word_hashes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES, SEED = 2, 1
#: What the hashes of pieces begin with.
FIRST = U64(0x9E3779B97F4A7C15)
BLANK = 0x2581
CHUNK = 1 << 18
#: The log factor for each code point, and the length from which sums are kept as logs.
TILT, LONG = 2.5, 150
SCHEMA = "sample int, ids array<int>, log_prob double, inclusion double, exact boolean"


class Vocabulary:
    """Pieces by the hash of their code points, with log weights."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        probe = "a  b \n"
        assert sp.decode(sp.encode(probe)) == probe, "a model that changes texts has no exact decoding"
        assert sp.id_to_piece(sp.encode("a"))[0].startswith("▁"), "a model without the leading blank isn't supported"
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        usable = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        assert not any("▁" in pieces[i].lstrip("▁") for i in usable), "a piece reaches over a blank"
        self.bytes_of = np.full(256, -1, np.int64)
        for i in range(n):
            if sp.is_byte(i):
                self.bytes_of[int(pieces[i][3:5], 16)] = i
        assert (self.bytes_of >= 0).all(), "a model without byte pieces can't spell every text"
        scores = np.array([sp.get_score(i) for i in usable])
        bpe = (scores == np.round(scores)).all() and scores.min() < -1000  # log probabilities are neither
        self.weights = -np.log(2 + np.abs(scores)) if bpe else scores
        self.tilted = np.exp(self.weights + TILT * np.array([len(pieces[i]) for i in usable]))
        self.byte_weight = float(self.weights.min()) - 1.0
        self.ids, self.longest = np.array(usable), -(-max(len(pieces[i]) for i in usable) // 8) * 8
        texts = [pieces[i] for i in usable]
        h = self._hash(texts)
        assert len(np.unique(h)) == len(h)
        self.hashes = h
        # A slot for each piece by its hash, and in a second table for those whose slot is taken.
        self.slots, late = [], np.arange(len(h))
        while len(late):
            slot = np.full(1 << 20, -1, np.int32)
            slot[self._slot(h[late], len(self.slots))] = late
            self.slots.append(slot)
            late = late[slot[self._slot(h[late], len(self.slots) - 1)] != late]
        self.begins = np.zeros(1 << 22, bool)  # hashes of what longer pieces begin with
        starts = self._hash(sorted({x[:i] for x in texts for i in range(1, len(x))}))
        self.begins[(starts & U64((1 << 22) - 1)).astype(np.int64)] = True
        self.bytes_by_id = [pieces[i].replace("▁", " ").encode() for i in range(n)]
        for b, i in enumerate(self.bytes_of):
            self.bytes_by_id[i] = bytes([b])
        self.lengths = np.array([len(x) for x in self.bytes_by_id])
        self.text = np.frombuffer(b"".join(self.bytes_by_id), np.uint8)
        self.text_at = np.concatenate(([0], np.cumsum(self.lengths)))

    @staticmethod
    def _hash(texts: list[str]) -> np.ndarray:
        """Each text's code points, joined one by one."""
        flat = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(U64)
        size = np.array([len(x) for x in texts])
        begin, h, on = np.cumsum(size) - size, np.full(len(texts), FIRST, U64), np.arange(len(texts))
        for i in range(int(size.max(initial=0))):
            on = on[size[on] > i]
            h[on] = join64(h[on], flat[begin[on] + i])
        return h

    @staticmethod
    def _slot(h: np.ndarray, table: int) -> np.ndarray:
        return ((h >> U64(20 * table % 44)) & U64((1 << 20) - 1)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """For each hash the usable piece's number, or -1."""
        out = self.slots[0][self._slot(h, 0)]
        open_ = np.flatnonzero(out >= 0)
        open_ = open_[self.hashes[out[open_]] != h[open_]]  # another piece's slot, so that it may be in a later table
        for table, slot in enumerate(self.slots[1:], 1):
            out[open_] = found = slot[self._slot(h[open_], table)]
            open_ = open_[found >= 0]
            open_ = open_[self.hashes[out[open_]] != h[open_]]
        out[open_] = -1
        return out

    def goes_on(self, h: np.ndarray) -> np.ndarray:
        """Whether longer pieces may begin with what has these hashes."""
        return self.begins[(h & U64((1 << 22) - 1)).astype(np.int64)]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Lattice:
    """Edges and backward sums of units by position.

    Units stay from chunk to chunk while there is room (frequent ones come early); those beyond it are
    worked out anew for each chunk, in a part that each chunk overwrites.  ``piece`` holds the
    piece of each length from a position on (-1: none, or bytes for one character), ``cum`` the running
    shares of the edges, and ``total`` the log of the sum over all ways from there to the unit's end.
    """

    def __init__(self, voc: Vocabulary, most: int = 250_000):
        m = voc.longest
        self.voc, self.most, self.used, self.top = voc, most, 0, 0
        kind = np.int16 if len(voc.ids) < 1 << 15 else np.int32
        self.piece, self.cum = np.full((0, m), -1, kind), np.ones((0, m), np.float32)
        self.total, self.cp = np.zeros(m + 1), np.zeros(0, np.uint32)
        self.hashes, self.starts, self.sizes = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._room(most + (1 << 17))

    def _room(self, n: int):
        more = n - len(self.cp)
        self.piece = np.concatenate((self.piece, np.full((more, self.voc.longest), -1, self.piece.dtype)))
        self.cum = np.concatenate((self.cum, np.ones((more, self.voc.longest), np.float32)))
        self.total, self.cp = np.concatenate((self.total, np.zeros(more))), np.concatenate((self.cp, np.zeros(more, np.uint32)))

    def place(self, h: np.ndarray, cp: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The positions at which units (hashes, ranges of ``cp``) start; good until the next call."""
        self.piece[self.used : self.top], self.cum[self.used : self.top] = -1, 1
        self.top = self.used
        at = np.minimum(np.searchsorted(self.hashes, h), max(0, len(self.hashes) - 1))
        size = end - begin
        known = np.full(len(h), -1, np.int64)
        if len(self.hashes):
            met = np.flatnonzero((self.hashes[at] == h) & (self.sizes[at] == size))
            met = met[same_ranges(self.cp, self.starts[at[met]], cp, begin[met], size[met])]
            known[met] = self.starts[at[met]]
        lost = np.flatnonzero(known < 0)
        if not len(lost):
            return known
        some, first, which = np.unique(h[lost], return_index=True, return_inverse=True)
        head, plain = lost[first[which]], len(some)
        same = size[lost] == size[head]
        same[same] = same_ranges(cp, begin[lost[same]], cp, begin[head[same]], size[lost[same]])
        if not same.all():  # units that share a hash and differ: each is a unit of its own
            which = which.copy()
            odd = np.flatnonzero(~same)
            which[odd] = len(first) + np.arange(len(odd))
            first, some = np.concatenate((first, odd)), np.concatenate((some, h[lost[odd]]))
        begin, size = begin[lost[first]], size[lost[first]]
        order = np.argsort(-size, kind="stable")
        off = np.concatenate(([0], np.cumsum(size[order])))
        base, need = self.used, int(off[-1])
        if base + need > len(self.cp):
            self._room(base + need)
        self._fill(base, cp[np.repeat(begin[order] - off[:-1], size[order]) + np.arange(need)], off)
        starts = np.empty(len(some), np.int64)
        starts[order] = off[:-1] + base
        self.top = base + need
        if self.top <= self.most:
            self.used = self.top
            fresh = np.flatnonzero(~np.isin(some[:plain], self.hashes))  # a hash that is taken by another unit stays with it
            at = np.searchsorted(self.hashes, some[fresh])
            self.hashes = np.insert(self.hashes, at, some[fresh])
            self.starts, self.sizes = np.insert(self.starts, at, starts[fresh]), np.insert(self.sizes, at, size[fresh])
        known[lost] = starts[which]
        return known

    def _fill(self, base: int, cp: np.ndarray, off: np.ndarray):
        """Enters units, the longest first, from position ``base`` on."""
        voc, n = self.voc, len(cp)
        size = np.diff(off)
        end = np.repeat(off[1:], size)
        values = cp.astype(U64)
        at, h, hits = np.arange(n), np.full(n, FIRST, U64), []
        for length in range(1, min(voc.longest, int(size[0])) + 1):
            h = join64(h, values[at + (length - 1)])
            found = voc.find(h)
            hit = np.flatnonzero(found >= 0)
            hits.append((at[hit], found[hit]))
            on = np.flatnonzero(voc.goes_on(h))
            on = on[at[on] + length < end[at[on]]]
            at, h = at[on], h[on]
            if not len(at):
                break
        m = max(i for i, (x, _) in enumerate(hits, 1) if len(x) or i == 1)
        # Weights times TILT to the power of the length: all ways through a unit are as long, so that shares stay
        # as they are, and sums over units of common length stay within a float's range.
        w = np.zeros((n, m))
        for i, (x, found) in enumerate(hits[:m]):
            self.piece[base + x, i] = found
            w[x, i] = voc.tilted[found]
        lone = np.flatnonzero(self.piece[base : base + n, 0] < 0)
        w[lone, 0] = np.exp(voc.byte_weight * byte_count(cp[lone]) + TILT)
        long_ = int(np.searchsorted(-size, -LONG))  # units of LONG code points or more come first
        total = np.empty(n)
        for units, run in ((off[: long_ + 1], self._log_sums), (off[long_:], self._sums)):
            if len(units) > 1:
                a, z = units[0], units[-1]
                total[a:z] = run(base + a, w[a:z], units - a)
        self.total[base : base + n], self.cp[base : base + n] = total - TILT * (end - np.arange(n)), cp

    def _sums(self, base: int, w: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Logs of the backward sums of units, the longest first; fills ``cum``."""
        n, m = w.shape
        size = np.diff(off)
        sums = np.zeros(n + m + 1)
        ahead = np.lib.stride_tricks.sliding_window_view(sums, m)
        for step in range(1, int(size[0]) + 1):
            p = off[1 : 1 + np.searchsorted(-size, -step, side="right")] - step
            reach = min(step, m)
            x = w[p, :reach]
            if step > 1:
                behind = ahead[p + 1, :reach]
                if step <= m:
                    behind[:, -1] = 1  # the unit's end
                x *= behind
            np.cumsum(x, 1, out=x)
            sums[p] = x[:, -1]
            self.cum[base + p, :reach] = x / x[:, -1:]
        return np.log(sums[:n])

    def _log_sums(self, base: int, w: np.ndarray, off: np.ndarray) -> np.ndarray:
        """The same for long units, whose sums could leave a float's range."""
        n, m = w.shape
        size = np.diff(off)
        total = np.zeros(n + m + 1)
        for step in range(1, int(size[0]) + 1):
            p = off[1 : 1 + np.searchsorted(-size, -step, side="right")] - step
            reach = min(step, m)
            behind = total[p[:, None] + np.arange(1, reach + 1)]
            if step <= m:
                behind[:, -1] = 0
            with np.errstate(divide="ignore"):
                x = np.log(w[p, :reach]) + behind
            top = x.max(1)
            x = np.exp(x - top[:, None])
            np.cumsum(x, 1, out=x)
            total[p] = top + np.log(x[:, -1])
            self.cum[base + p, :reach] = x / x[:, -1:]
        return total[:n]

    def weight(self, pos: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Log weights of edges."""
        piece = self.piece[pos, length - 1]
        out = self.voc.weights[piece]
        spelled = np.flatnonzero(piece < 0)
        out[spelled] = self.voc.byte_weight * byte_count(self.cp[pos[spelled]])
        return out

    def logs(self, pos: np.ndarray, length: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Logs of the edges' shares."""
        to = pos + length
        out = self.total[to]
        out[to >= end] = 0
        out += self.weight(pos, length)
        out -= self.total[pos]
        return np.minimum(out, 0, out=out)

    def shares(self, pos: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The shares of all edges that leave the positions."""
        reach = np.arange(1, self.voc.longest + 1)
        pos, end = pos[:, None], end[:, None]
        piece = self.piece[pos, reach - 1]
        w = np.where(piece >= 0, self.voc.weights[piece], -np.inf)
        w[:, 0] = self.weight(pos[:, 0], np.ones(len(pos), np.int64))
        fits = pos + reach <= end
        after = np.where(pos + reach < end, self.total[np.minimum(pos + reach, len(self.total) - 1)], 0)
        return np.where(fits, np.exp(np.where(fits, w, -np.inf) + np.where(fits, after, 0) - self.total[pos]), 0)


@lru_cache(maxsize=1)
def lattice(path: str) -> Lattice:
    """One for each Python worker, which keeps it from task to task."""
    return Lattice(vocabulary(path))


def byte_count(cp: np.ndarray) -> np.ndarray:
    """The bytes of code points in UTF-8."""
    return 1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000)


def _salted(key: np.ndarray, salt: int) -> np.ndarray:
    return mix64(key + U64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))


def _uniform(h: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) that depend on ``h`` alone."""
    return ((mix64(h) >> U64(11)).astype(float) + 0.5) / (1 << 53)


def _single(u: np.ndarray) -> np.ndarray:
    """``u`` in single precision and still below 1, to which one of 2 ** 25 would be rounded; an edge's share ends at 1."""
    return np.minimum(u.astype(np.float32), np.nextafter(np.float32(1), np.float32(0)))


def _cut_off(log_mass: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel values of location ``log_mass``, cut off at ``bound``."""
    with np.errstate(over="ignore", divide="ignore"):
        return np.where(np.isneginf(log_mass), -np.inf, log_mass - np.logaddexp(log_mass - bound, np.log(-np.log(u))))


def _walk(lat: Lattice, pos: np.ndarray, end: np.ndarray, key: np.ndarray, tag: np.ndarray, salt: int):
    """Draws edges from ``pos`` to ``end`` for each instance: (instance, position, length) in order."""
    live = np.argsort(pos)  # equal units stand together, so that what is read of them is near
    key = _salted(key, salt) + tag.astype(U64) * U64(0xD6E8FEB86659FD93)
    got, now, to, key, step = [], pos[live], end[live], key[live], 0
    while len(live):
        u = _single(_uniform(key + U64(step)))
        below = (lat.cum[now] <= u[:, None]).view(U64)
        pick = np.bitwise_count(below[:, 0]) + np.bitwise_count(below[:, 1]) if below.shape[1] == 2 else np.bitwise_count(below).sum(1)
        pick = np.minimum(pick.astype(np.int64) + 1, to - now)
        got.append((live, now, pick))
        now = now + pick
        on = now < to
        live, now, to, key, step = live[on], now[on], to[on], key[on], step + 1
    if not got:
        z = np.zeros(0, np.int64)
        return z, z, z
    count = np.bincount(np.concatenate([x[0] for x in got]), minlength=len(pos))
    at = np.cumsum(count) - count
    out = tuple(np.empty(int(count.sum()), np.int64) for _ in range(3))
    for i, part in enumerate(got):
        to = at[part[0]] + i
        for o, x in zip(out, part):
            o[to] = x
    return out


def sample_chunk(lat: Lattice, raw: np.ndarray, off: np.ndarray, keys: np.ndarray, k: int, seed: int):
    """For each sample of each document of a chunk: (document, rank, ids, log_prob, inclusion, decodes exactly)."""
    n_docs, voc = len(off) - 1, lat.voc
    try:
        text = raw.tobytes().decode("utf-8")
        head = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))[off]
    except UnicodeDecodeError:
        text = "".join(raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(off[:-1], off[1:]))
        head = np.concatenate(([0], np.cumsum([len(raw[a:b].tobytes().decode("utf-8", "replace")) for a, b in zip(off[:-1], off[1:])])))
    cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    cp = np.where(cp == 32, BLANK, cp)
    full = np.diff(head) > 0
    # A blank before each text that isn't empty.
    cp = np.insert(cp, head[:-1][full], BLANK)
    head = head + np.concatenate(([0], np.cumsum(full)))
    n = len(cp)
    blank = cp == BLANK
    first = np.zeros(n, bool)
    first[head[:-1][full]] = True
    first[1:] |= blank[1:] & ~blank[:-1]
    begin = np.flatnonzero(first)
    end = np.append(begin[1:], n)[: len(begin)]
    doc_of = owner(head)[begin] if n else np.zeros(0, np.int64)
    # Units are looked up by a hash and then compared.
    h = word_hashes(cp.view(np.uint8), 4 * begin, 4 * end)
    start_of = lat.place(h, cp, begin, end)
    end_of = start_of + end - begin
    key = mix64(keys.astype(np.int64).view(U64) + U64(seed))
    number = np.arange(len(begin)) - np.searchsorted(doc_of, np.arange(n_docs))[doc_of] if n else begin

    docs = np.arange(n_docs)
    root = -np.log(-np.log(_uniform(_salted(key, 1))))
    inst, pos, length = _walk(lat, start_of, end_of, key[doc_of], number, 2)
    found = []  # (documents, offsets, edges) of each rank
    paths = []

    def state(of, doc, unit, pos, length, g, born, barred):
        """Bounds of the sets that leave a path at each edge from ``born`` on; ``barred`` are edges taken already, by index."""
        count = np.bincount(doc, minlength=n_docs)
        at = np.concatenate(([0], np.cumsum(count)))
        logs = lat.logs(pos, length, end_of[unit])
        run = np.concatenate(([0], np.cumsum(logs)))
        before = run[:-1] - np.repeat(run[at[:-1]], count)
        place = np.arange(len(doc)) - np.repeat(at[:-1], count)
        left = -np.expm1(logs)
        if barred:
            e = np.array(list(barred), np.int64)
            bits = np.array(list(barred.values()), np.int64) | 1 << (length[e] - 1)
            left[e] = np.where(bits[:, None] >> np.arange(voc.longest) & 1, 0, lat.shares(pos[e], end_of[unit[e]])).sum(1)
        live = left > 1e-13
        if len(barred):
            live &= place >= born[doc]
        with np.errstate(divide="ignore"):
            mass = np.where(live, before + np.log(left), -np.inf)
        bound = _cut_off(mass, g[doc], _uniform(_salted(key, 100 + len(paths))[doc] + place.astype(U64)))
        return {"doc": doc, "unit": unit, "pos": pos, "length": length, "at": at, "bound": bound, "barred": barred, "log_prob": run[at[1:]] - run[at[:-1]]}

    paths.append(state(docs, doc_of[inst] if n else inst, inst, pos, length, root, None, {}))
    ranks = [(docs, 0)]
    active = docs
    kappa = np.full(n_docs, -np.inf)
    for rank in range(1, k + 1):
        best, source, edge = np.full(n_docs, -np.inf), np.zeros(n_docs, np.int64), np.zeros(n_docs, np.int64)
        for i, p in enumerate(paths):
            some = np.flatnonzero(np.diff(p["at"]) > 0)
            if not len(some):
                continue
            top = np.full(n_docs, -np.inf)
            top[some] = np.maximum.reduceat(p["bound"], p["at"][some])
            better = top > best
            hit = np.flatnonzero((p["bound"] == np.repeat(top, np.diff(p["at"]))) & better[p["doc"]])
            _, one = np.unique(p["doc"][hit], return_index=True)
            hit = hit[one]
            d = p["doc"][hit]
            best[d], source[d], edge[d] = p["bound"][hit], i, hit
        if rank == k:
            kappa = best
            break
        active = np.flatnonzero(best > -np.inf)
        # The new paths: the old one's edges before, another edge there, and edges drawn anew behind it.
        parts = {x: [] for x in ("doc", "unit", "pos", "length")}
        born, taken = np.zeros(n_docs, np.int64), np.zeros(n_docs, np.int64)
        for i, p in enumerate(paths):
            d = active[source[active] == i]
            if not len(d):
                continue
            e = edge[d]
            bits = np.array([p["barred"].get(x, 0) for x in e.tolist()], np.int64) | 1 << (p["length"][e] - 1)
            unit = p["unit"][e]
            share = np.where(bits[:, None] >> np.arange(voc.longest) & 1, 0, lat.shares(p["pos"][e], end_of[unit]))
            run = np.cumsum(share, 1)
            pick = (run <= (_uniform(_salted(key, 1000 + rank)[d]) * run[:, -1])[:, None]).sum(1)
            pick = np.minimum(pick, voc.longest - 1)
            zero = share[np.arange(len(d)), pick] <= 0  # rounding at the upper end
            pick[zero] = share[zero].argmax(1)
            born[d], taken[d] = e - p["at"][d], bits
            keep = born[d]
            old = np.repeat(p["at"][d] - np.concatenate(([0], np.cumsum(keep)))[:-1], keep) + np.arange(keep.sum())
            p["bound"][e] = -np.inf
            # What is left of the unit, then the document's later units.
            rest = p["pos"][e] + pick + 1
            open_ = rest < end_of[unit]
            after = np.searchsorted(doc_of, d, side="right") - unit - 1
            later = np.repeat(unit + 1 - np.concatenate(([0], np.cumsum(after)))[:-1], after) + np.arange(after.sum())
            units, froms = np.concatenate((unit[open_], later)), np.concatenate((rest[open_], start_of[later]))
            w, pos2, length2 = _walk(lat, froms, end_of[units], key[doc_of[units]], number[units], 2000 + rank)
            for x, v in (("unit", units[w]), ("pos", pos2), ("length", length2)):
                parts[x] += [p[x][old], p[x][e] if x != "length" else pick + 1, v]
            parts["doc"] += [p["doc"][old], d, doc_of[units[w]]]
        if not len(active):
            break
        cols = {x: np.concatenate(v) for x, v in parts.items()}
        order = np.argsort(cols["unit"] * (int((end_of - start_of).max()) + 1) + cols["pos"] - start_of[cols["unit"]], kind="stable")
        cols = {x: v[order] for x, v in cols.items()}
        at = np.searchsorted(cols["doc"], active)
        barred = dict(zip((at + born[active]).tolist(), taken[active].tolist()))
        paths.append(state(active, cols["doc"], cols["unit"], cols["pos"], cols["length"], best, born, barred))
        ranks.append((active, rank))

    for (of, rank), p in zip(ranks, paths):
        piece = lat.piece[p["pos"], p["length"] - 1].astype(np.int64)
        spelled = piece < 0
        ids = np.where(spelled, -1, voc.ids[piece])
        if spelled.any():
            chars = np.flatnonzero(spelled)
            byte = [chr(c).encode() for c in lat.cp[p["pos"][chars]].tolist()]
            reps = np.ones(len(ids), np.int64)
            reps[chars] = [len(b) for b in byte]
            wide = np.repeat(ids, reps)
            wide[wide < 0] = voc.bytes_of[np.frombuffer(b"".join(byte), np.uint8)]
            at = np.concatenate(([0], np.cumsum(reps)))
            bounds = at[p["at"]]
            ids = wide
        else:
            bounds = p["at"]
        exact = decoded_equal(voc, ids, bounds, raw, off)
        with np.errstate(over="ignore"):
            inclusion = -np.expm1(-np.exp(p["log_prob"] - kappa))
        found.append((of, rank, ids, bounds, p["log_prob"], inclusion, exact))
    return found


def decode_ids(voc: Vocabulary, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts of runs of ids, without their leading blanks."""
    size = voc.lengths[ids]
    at = np.concatenate(([0], np.cumsum(size)))
    raw = voc.text[np.repeat(voc.text_at[ids] - at[:-1], size) + np.arange(at[-1])]
    off = at[bounds]
    first = off[:-1][np.diff(off) > 0]
    first = first[raw[first] == 32]
    keep = np.ones(len(raw), bool)
    keep[first] = False
    return raw[keep], np.concatenate(([0], np.cumsum(keep)))[off]


def decoded_equal(voc, ids, bounds, raw, off) -> np.ndarray:
    """For each document, whether its ids decode to its bytes."""
    got, goff = decode_ids(voc, ids, bounds)
    if len(got) == len(raw) and (goff == off).all():
        wrong = np.flatnonzero(got != raw)
        same = np.ones(len(off) - 1, bool)
        same[np.searchsorted(off, wrong, side="right") - 1] = False
        return same
    same = np.diff(goff) == np.diff(off)
    size = np.where(same, np.diff(off), 0)
    at = np.concatenate(([0], np.cumsum(size)))
    step = np.arange(at[-1])
    a = got[np.repeat(goff[:-1] - at[:-1], size) + step]
    b = raw[np.repeat(off[:-1] - at[:-1], size) + step]
    wrong = np.concatenate(([0], np.cumsum(a != b)))
    return same & (wrong[at[1:]] == wrong[at[:-1]])


def sample_segmentations(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, k: int = SAMPLES, seed: int = SEED) -> DataFrame:
    """(id, sample, ids, log_prob, inclusion, exact): up to ``k`` distinct segmentations of each row, best perturbed value first.

    ``model`` is a path that every executor has; ``exact`` tells whether the ids decode to the text's bytes.
    """
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches):
        lat = lattice(model)
        for b in batches:
            keys = b.column(2).to_numpy(zero_copy_only=False)
            for row, end, raw, off in chunks(b.column(1), CHUNK):
                for of, rank, ids, bounds, log_prob, inclusion, exact in sample_chunk(lat, raw, off, keys[row:end], k, seed):
                    size = np.diff(bounds)
                    if len(of) < end - row:
                        assert size.sum() == size[of].sum()
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size[of]))), pa.int32()), pa.array(ids, pa.int32()))
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(of + row)), pa.array(np.full(len(of), rank + 1), pa.int32()), lists, pa.array(log_prob[of]), pa.array(inclusion[of]), pa.array(exact[of])],
                        ["id", "sample", "ids", "log_prob", "inclusion", "exact"],
                    )

    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(id_col).alias("key"))
    return rows.mapInArrow(run, f"id {kind}, {SCHEMA}").withColumnRenamed("id", id_col)


def encode(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """(id, ids) of each row: the model's own segmentation."""
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches):
        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        for b in batches:
            ids = [sp.encode(x or "", num_threads=1) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    return documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string")).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, *, ids_col: str = "ids", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """``encoded`` with the text of its ids in ``text_col``; null ids give null."""
    names = [c for c in encoded.columns if c != text_col]
    schema = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in names)

    def run(batches):
        voc = vocabulary(model)
        for b in batches:
            lists = b.column(b.schema.get_field_index(ids_col)).to_pylist()
            size = [len(x or ()) for x in lists]
            raw, off = decode_ids(voc, np.array([i for x in lists for i in x or ()], np.int64), np.concatenate(([0], np.cumsum(size))).astype(np.int64))
            data = raw.tobytes()
            texts = [None if x is None else data[a:z].decode("utf-8", "replace") for x, a, z in zip(lists, off[:-1], off[1:])]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, text_col])

    return encoded.select(*names).mapInArrow(run, f"{schema}, `{text_col}` string")
