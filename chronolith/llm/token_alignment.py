"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes of a text.

Tokenizer A reads a blank and the text, tokenizer B the text, before which it puts a blank itself, so that the
tokens of both join to the same bytes.  The elementary intervals of these bytes are those between
neighbours in the union of both tokenizers' token ends.  Each interval lies in one token of A and one of B, its
owners, which are searched among the sorted ends, and it is one overlap (*link*); ends that both share close
groups of tokens.

Texts are cut before blanks that stand behind a visible character.  No pre-token of A and no piece of B reaches over such a
place (checked when the tokenizers are loaded), so a text's tokens are those of its segments, and
a task aligns each different segment once.  The links of each pair of ids are counted over the corpus, in
tasks first; the counts that may be wanted are then looked up for each segment.  Pairs of a share of
the links above one in ``most`` (no more than ``most`` can be) are known to every task, the others are joined by pair.

Defined results: texts that are null, empty or whose joined tokens aren't a blank and the text have no tokens, zeros
and the digest ''; rows that repeat an id are texts of their own; a text without a place to cut is held whole; other columns are ignored; an empty table gives an empty
result.  The tokenizers' files are shipped to the executors from the driver's folder.
"""

from __future__ import annotations

import hashlib
import json
import os
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import cut
from .text_arrays import chunks

FOLDER, A_FILE, B_FILE = "/opt/tokenizers", "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Pairs that may be known to every task; segments and bytes of segments that a task remembers.
MOST, REMEMBERED, REMEMBERED_BYTES = 1 << 20, 1 << 18, 1 << 24
#: An id pair as one number.
BITS = 24


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it is visible, else one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """The bytes of each id, one after the other, and its digits."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        names = np.char.add(np.arange(len(tokens)).astype("S10"), b" ")  # room for what follows an id
        self.digits = names.view(np.uint8).reshape(len(tokens), -1)
        self.digits = self.digits[:, : int((self.digits > 0).sum(1).max(initial=1))]
        self.n_digits = (self.digits > 0x20).sum(1)

    def joined(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The bytes of a row of ids whose tokens end at ``ends``."""
        size = self.size[ids]
        return self.bytes[np.repeat(self.start[ids] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]


#: The pattern of pre-tokens that goes with byte-level vocabularies (a fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


class Pair:
    """Both tokenizers.

    A's vocabulary is read from its own file and merged by rank, which is what its list of merges says as long
    as each merge is what lower ranks leave of its token; the tests hold the ids against the other library's.
    """

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tiktoken

        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["normalizer"] or spec["model"]["type"] != "BPE" or not spec["pre_tokenizer"].items() >= {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}.items():
            raise ValueError("the first tokenizer must be a byte-level BPE that splits at blanks before bytes")
        letters, added = _byte_letters(), {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)
        entries: list[bytes] = [b""] * (max([*ranks.values(), *added.values()]) + 1)
        for token, i in [*ranks.items(), *((t.encode(), i) for t, i in added.items())]:
            entries[i] = token
        self.va = Vocabulary(entries)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.vb = Vocabulary([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece of the second tokenizer holds a blank behind another character")

    def encode(self, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(A's ids, how many of each segment, B's ids, how many) for segments that start with a blank."""
        texts = [s.decode("utf-8", "replace") for s in segments]
        # Segments behind which a text may be cut are encoded in one go, then the others.
        whole = np.array([0x20 < s[-1] < 0x7F for s in segments], bool)
        together = "".join([t for t, w in zip(texts, whole.tolist()) if w])
        first = self.a.encode_to_numpy(together, allowed_special=set(), disallowed_special=()).astype(np.int64) if together else np.zeros(0, np.int64)
        size = np.array([len(t.encode()) for t in texts], np.int64)
        upto = np.searchsorted(np.cumsum(self.va.size[first]), np.cumsum(size[whole]), side="right")
        n_a = np.zeros(len(texts), np.int64)
        n_a[whole] = np.diff(upto, prepend=0)
        rest = [self.a.encode_ordinary(t) for t, w in zip(texts, whole.tolist()) if not w]
        n_a[~whole] = [len(x) for x in rest]
        ids_a = np.empty(int(n_a.sum()), np.int64)
        of_whole = np.repeat(whole, n_a)
        ids_a[of_whole], ids_a[~of_whole] = first, np.fromiter(chain.from_iterable(rest), np.int64)
        found = self.b.encode([t[1:] for t in texts], num_threads=1)
        return ids_a, n_a, np.fromiter(chain.from_iterable(found), np.int64), np.fromiter(map(len, found), np.int64, len(found))


@lru_cache(maxsize=2)
def _pair(a: str, b: str) -> Pair:
    return Pair(a, b)


def cut_places(raw: np.ndarray) -> np.ndarray:
    """Where blanks stand behind a visible ASCII character, or behind a letter of two bytes from U+00C0 to U+07FF."""
    blank = raw[2:] == 0x20
    before, ahead = raw[1:-1], raw[:-2]
    seen = ((before > 0x20) & (before < 0x7F)) | ((before >= 0x80) & (ahead >= 0xC3) & (ahead <= 0xDF))
    return np.flatnonzero(blank & seen) + 2


class Aligned:
    """Alignments of different segments, in rows: numbers of tokens, groups and links, and the links' pairs one segment after the other."""

    def __init__(self, pair: Pair, segments: list[bytes], groups: bool):
        ia, na, ib, nb = pair.encode(segments)
        size = np.fromiter(map(len, segments), np.int64, len(segments))
        la, lb = pair.va.size[ia], pair.vb.size[ib]
        owner = np.arange(len(segments))
        of_a, of_b = np.repeat(owner, na), np.repeat(owner, nb)
        good = (np.bincount(of_a, la, len(size)) == size) & (np.bincount(of_b, lb, len(size)) == size)
        if not good.all():
            ka, kb = good[of_a], good[of_b]
            ia, la, of_a, ib, lb, of_b = ia[ka], la[ka], of_a[ka], ib[kb], lb[kb], of_b[kb]
        ends_a, ends_b = np.cumsum(la), np.cumsum(lb)
        text = np.frombuffer(b"".join(s for s, g in zip(segments, good) if g), np.uint8)
        # Segments of the right lengths, but other bytes.
        other = (pair.va.joined(ia, ends_a) != text) | (pair.vb.joined(ib, ends_b) != text)
        wrong = np.unique(np.repeat(owner, np.where(good, size, 0))[other])
        self.good = good
        self.good[wrong] = False
        ends = np.union1d(ends_a, ends_b)
        at_a, at_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        shared = (ends_a[at_a] == ends) & (ends_b[at_b] == ends) if len(ends) else np.zeros(0, bool)
        of = of_a[at_a] if len(ends) else np.zeros(0, np.int64)
        kept = self.good[of]
        self.keys = ((ia[at_a] << BITS) | ib[at_b])[kept]
        count = lambda rows: np.bincount(rows, minlength=len(size))
        self.n_a, self.n_b, self.n_links, self.n_groups = (np.where(self.good, count(x), 0) for x in (of_a, of_b, of, of[shared]))
        self.groups = self._groups(pair, ia, ib, at_a[shared] + 1, at_b[shared] + 1, of[shared]) if groups else None

    def _groups(self, pair: Pair, ia, ib, to_a, to_b, of) -> list[bytes]:
        """The groups of each segment as digits: A's ids, a bar, B's ids, a semicolon before the next group."""
        each_a, each_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
        number = np.arange(len(of))
        # A token stands behind all tokens of earlier groups, B's behind A's of the same group.
        at_a = np.arange(len(ia)) + np.repeat(to_b - each_b, each_a)
        at_b = np.arange(len(ib)) + np.repeat(to_a, each_b)
        wide = max(pair.va.digits.shape[1], pair.vb.digits.shape[1])
        cells, size = np.zeros((len(ia) + len(ib), wide), np.uint8), np.empty(len(ia) + len(ib), np.int64)
        for at, ids, v in ((at_a, ia, pair.va), (at_b, ib, pair.vb)):
            cells[at, : v.digits.shape[1]] = v.digits[ids]
            size[at] = v.n_digits[ids]
        behind = np.full(len(size), 0x2C, np.uint8)
        behind[to_a + (to_b - each_b) - 1] = 0x7C
        behind[to_a + to_b - 1] = 0x3B
        cells[np.arange(len(size)), size] = behind
        text = cells[cells > 0].tobytes()
        ends = np.cumsum(size + 1)[to_a + to_b - 1] if len(of) else number
        last = np.append(of[1:] != of[:-1], True) if len(of) else np.zeros(0, bool)
        out, begin = [b""] * len(self.good), 0
        for i, end in zip(of[last].tolist(), ends[last].tolist()):
            out[i], begin = text[begin : end - 1], end
        return out


class Known:
    """The segments that a task remembers; forgotten all at once when they are too many."""

    def __init__(self, pair: Pair, groups: bool = False):
        self.pair, self.with_groups = pair, groups
        self.forget()

    def forget(self) -> None:
        self.number, self.bytes, self.keys, self.groups = {}, 0, [], []
        self.columns = np.zeros((5, 0), np.int64)  # good, n_a, n_b, n_groups, n_links

    def full(self) -> bool:
        return len(self.number) > REMEMBERED or self.bytes > REMEMBERED_BYTES

    def numbers(self, segments: list[bytes]) -> np.ndarray:
        get = self.number.get
        found = [get(s, -1) for s in segments]
        fresh = list(dict.fromkeys(s for s, i in zip(segments, found) if i < 0))
        if fresh:
            new = Aligned(self.pair, fresh, self.with_groups)
            first = len(self.number)
            self.number.update(zip(fresh, range(first, first + len(fresh))))
            self.bytes += sum(map(len, fresh))
            self.keys.append(new.keys)
            self.groups += new.groups or []
            self.columns = np.concatenate((self.columns, [new.good, new.n_a, new.n_b, new.n_groups, new.n_links]), 1)
            found = [get(s) for s in segments]
        return np.array(found, np.int64)

    def all_keys(self) -> np.ndarray:
        self.keys = [np.concatenate(self.keys)] if self.keys else [np.zeros(0, np.int64)]
        return self.keys[0]

    def links_of(self, numbers: np.ndarray) -> np.ndarray:
        """Places in ``all_keys`` of the links of segments, one segment after the other."""
        n = self.columns[4]
        start, size = (np.cumsum(n) - n)[numbers], n[numbers]
        return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def segmented(column, known: Known):
    """(first row, rows, segments' numbers, first segment of each row and the total) of runs of texts; texts that can't be cut well are one segment."""
    for row, end, raw, off in chunks(column):
        size = np.diff(off)
        ahead = np.cumsum(size > 0)  # a blank goes before each text that isn't empty
        place = np.arange(len(raw)) + np.repeat(ahead, size)
        stream = np.full(len(raw) + int(ahead[-1]), 0x20, np.uint8)
        stream[place] = raw
        begin = off[:-1] + ahead - (size > 0)
        stop = begin + size + (size > 0)
        cuts = np.union1d(cut_places(stream), begin[size > 0])
        data, bounds = stream.tobytes(), [*cuts.tolist(), len(stream)]
        numbers = known.numbers([data[i:j] for i, j in zip(bounds, bounds[1:])])
        first = np.searchsorted(cuts, np.append(begin, len(stream)))
        bad = np.add.reduceat(np.append(known.columns[0][numbers] == 0, 0), first[:-1]) * (np.diff(first) > 0) if len(numbers) else np.zeros(end - row, int)
        if bad.any():  # the whole text decides
            parts = np.split(numbers, first[1:-1])
            for i in np.flatnonzero(bad):
                parts[i] = known.numbers([data[begin[i] : stop[i]]])
            numbers, first = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(x) for x in parts])))
        yield row, end, numbers, first


def _files(documents: DataFrame, a_path: str, b_path: str):
    """A function that gives both tokenizers in a task; their files go to the executors with the job."""
    context = documents.sparkSession.sparkContext
    for path in (a_path, b_path):
        context.addFile(path)
    names = [os.path.basename(p) for p in (a_path, b_path)]
    return lambda: _pair(*[SparkFiles.get(x) for x in names])


def pair_counts(documents: DataFrame, *, text_col: str = "text", a_path: str = f"{FOLDER}/{A_FILE}", b_path: str = f"{FOLDER}/{B_FILE}") -> DataFrame:
    """(a, b, links): how many links of all texts hold each pair of ids."""
    pair = _files(documents, a_path, b_path)

    def run(batches):
        known, seen = Known(pair()), np.zeros(0, np.int64)

        def counted():
            each = np.repeat(seen, known.columns[4])
            keys, place = np.unique(known.all_keys()[each > 0], return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys >> BITS), pa.array(keys & ((1 << BITS) - 1)), pa.array(np.bincount(place, each[each > 0], len(keys)).astype(np.int64))], ["a", "b", "n"])

        for batch in batches:
            for _, _, numbers, _ in segmented(batch.column(0), known):
                more = np.bincount(numbers, minlength=len(known.number))
                more[: len(seen)] += seen
                seen = more
                if known.full():
                    yield from counted()
                    known.forget()
                    seen = np.zeros(0, np.int64)
        yield from counted()

    found = documents.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "a long, b long, n long")
    return found.groupBy("a", "b").agg(F.sum("n").alias("links"))


def alignment_report(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", a_path: str = f"{FOLDER}/{A_FILE}", b_path: str = f"{FOLDER}/{B_FILE}", most: int = MOST) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row."""
    counts = cut(pair_counts(documents, text_col=text_col, a_path=a_path, b_path=b_path))
    total, different = counts.agg(F.coalesce(F.sum("links"), F.lit(0)), F.count(F.lit(1))).first()
    least = 1 if different <= most else total // most + 1
    best = counts.groupBy("b").agg(F.max("links").alias("best"))  # no more rows than B has ids
    often = counts.where(F.col("links") >= least).join(F.broadcast(best), "b").select(((F.col("a") * (1 << BITS)) + F.col("b")).alias("key"), "links", (F.col("links") == F.col("best")).alias("is_best")).toArrow()
    key, links, is_best = (np.asarray(often.column(c).to_numpy()) for c in ("key", "links", "is_best"))
    order = np.argsort(key)
    table = documents.sparkSession.sparkContext.broadcast((key[order], links[order], is_best[order].astype(np.int64)))
    pair = _files(documents, a_path, b_path)
    sums = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")

    def run(batches):
        known, (key, links, is_best) = Known(pair(), groups=True), table.value
        scores, rare = np.zeros((3, 0), np.int64), np.zeros(0, bool)  # of each segment, of each link

        def scored(scores, rare):
            """``scores`` (best links, sum of counts, rare links) and ``rare`` with the segments that are new."""
            n, keys = known.columns[4][scores.shape[1] :], known.all_keys()[len(rare) :]
            at = np.minimum(np.searchsorted(key, keys), max(len(key) - 1, 0))
            there = key[at] == keys if len(key) else np.zeros(len(keys), bool)
            of = np.repeat(np.arange(len(n)), n)
            add = lambda x: np.bincount(of[there], x[at[there]], len(n)).astype(np.int64)  # noqa: E731  sums below 2 ** 53
            more = np.array([add(is_best), add(links), np.bincount(of[~there], minlength=len(n))])
            return np.concatenate((scores, more), 1), np.concatenate((rare, ~there))

        for batch in batches:
            ids = batch.column(0)
            for row, end, numbers, first in segmented(batch.column(1), known):
                if scores.shape[1] < len(known.number):
                    scores, rare = scored(scores, rare)
                rows = np.concatenate((known.columns[1:, numbers], scores[:, numbers]))
                upto = np.concatenate((np.zeros((len(rows), 1), np.int64), np.cumsum(rows, 1)), 1)
                each = upto[:, first[1:]] - upto[:, first[:-1]]
                good = known.columns[0][numbers]
                names, bounds = known.groups, first.tolist()
                listed = numbers.tolist()
                digest = [hashlib.sha256(b";".join([names[i] for i in listed[x:y]])).hexdigest() if x < y and good[x] else "" for x, y in zip(bounds, bounds[1:])]
                if each[-1].any():
                    some = numbers[scores[2][numbers] > 0]
                    places = known.links_of(some)
                    loose = known.all_keys()[places[rare[places]]]
                else:
                    loose = np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(each[-1]))).astype(np.int32)), pa.array(loose))
                yield pa.RecordBatch.from_arrays([ids.slice(row, end - row), *[pa.array(x) for x in each[:-1]], pa.array(digest, pa.string()), lists], ["id", *sums, "groups_sha256", "rare"])
                if known.full():
                    known.forget()
                    scores, rare = scores[:, :0], rare[:0]

    kind = documents.schema[id_col].dataType.simpleString()
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(run, f"id {kind}, {', '.join(f'{c} long' for c in sums)}, groups_sha256 string, rare array<long>")
    if least > 1:
        out = cut(out.withColumn("row", F.monotonically_increasing_id()))
        wanted = out.select("row", F.explode("rare").alias("key")).groupBy("row", "key").agg(F.count(F.lit(1)).alias("times"))
        few = counts.where(F.col("links") < least).join(F.broadcast(best), "b").select((F.col("a") * (1 << BITS) + F.col("b")).alias("key"), "links", (F.col("links") == F.col("best")).cast("long").alias("is_best"))
        more = wanted.join(few, "key").groupBy("row").agg(F.sum(F.col("times") * F.col("links")).alias("_sum"), F.sum(F.col("times") * F.col("is_best")).alias("_best"))
        out = out.join(more, "row", "left").withColumns({"count_sum": F.col("count_sum") + F.coalesce("_sum", F.lit(0)), "n_best": F.col("n_best") + F.coalesce("_best", F.lit(0))})
    return out.select(F.col("id").alias(id_col), *sums, "groups_sha256")


def align_tokens(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", a_path: str = f"{FOLDER}/{A_FILE}", b_path: str = f"{FOLDER}/{B_FILE}") -> DataFrame:
    """(id, groups) of each row: the groups in order, each the ids of A and of B between two ends that both share."""
    pair = _files(documents, a_path, b_path)

    def run(batches):
        known = Known(pair(), groups=True)
        for batch in batches:
            ids = batch.column(0)
            for row, end, numbers, first in segmented(batch.column(1), known):
                texts = [b";".join([known.groups[i] for i in numbers[x:y].tolist() if known.columns[0][i]]).decode() for x, y in zip(first, first[1:])]
                yield pa.RecordBatch.from_arrays([ids.slice(row, end - row), pa.array(texts, pa.string())], ["id", "groups"])
                if known.full():
                    known.forget()

    kind = documents.schema[id_col].dataType.simpleString()
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, groups string")
    side = lambda g, i: F.split(F.get(F.split(g, r"\|"), F.lit(i)), ",").cast("array<int>")
    groups = F.when(F.col("groups") == "", F.array().cast("array<struct<a:array<int>,b:array<int>>>")).otherwise(F.transform(F.split("groups", ";"), lambda g: F.struct(side(g, 0).alias("a"), side(g, 1).alias("b"))))
    return rows.select(F.col("id").alias(id_col), groups.alias("groups"))


def group_products(aligned: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """(id, group, a, b): every id of A of a group with every id of B of it, from the rows of ``align_tokens``."""
    rows = aligned.select(id_col, F.posexplode("groups").alias("group", "g"))
    return rows.select(id_col, "group", F.explode("g.a").alias("a"), "g.b").select(id_col, "group", "a", F.explode("b").alias("b"))
