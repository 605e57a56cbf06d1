"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A text's fingerprint has 64 bits: bit b is set if it is set in more than half of the XXH64 hashes
(seed 42) of its word shingles.  Fingerprints that differ in at most three bits are linked, and
the links' connected components are the groups.

Links are found on the distinct fingerprints, so that copies never multiply:

1. Every fingerprint emits all variants within one bit, half the radius rounded down (65
   of them), and the variants are shuffled.  All that meet in a variant are within two bits of each
   other, so that linking each to the least of them loses nothing and emits no pairs within
   a group.  Every two fingerprints within two bits meet.
2. Fingerprints exactly three bits apart differ in at most one bit in one of their halves (32 bits).
   Each fingerprint emits, for both halves, the variants of the half within one bit; they meet the
   other's half as it is, and the pair is verified on all 64 bits.  Only pairs whose ends are not yet in one
   component of step 1 are kept; of three fingerprints no more than two can be three apart
   pairwise (the distances' sum is even), so dense groups are already joined by then.  Where very
   many fingerprints share a half, the other halves' variants meet instead of pairs (``linked``).

Defined results: a text without words (null, empty) has fingerprint 0 and is linked like any other; a
text of fewer words than a shingle has its whole sequence as the only shingle; rows that repeat an
id are documents of their own with that id; a row without id keeps its fingerprint and takes
its group's id. Other columns are ignored by ``fingerprint_groups`` and kept by ``deduplicate``.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components, cut
from .text_arrays import SPACE, chunks, words

SEED = 42
SHINGLE = 3
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32


#: A half key that more fingerprints share is hot; fingerprints of a partition that is exploded.
HEAVY, EXPLODED = 1 << 8, 1 << 15
#: Shingles that are handled together, so that a very long text needs little more than its bytes and hashes.
STEP = 1 << 15


def shingle_hashes(raw: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle of the chunk's documents, and the offsets of the documents in them."""
    starts, ends, first = words(raw, off)
    n = len(starts)
    # Words joined by single blanks: the words' bytes in turn fill all places but those behind the words.
    to = np.concatenate(([0], np.cumsum(ends - starts + 1)))
    inside = np.ones(to[-1], bool)
    inside[to[1:] - 1] = False
    joined = np.full(to[-1], 32, np.uint8)
    joined[inside] = _LOW[raw[~SPACE[raw]]]
    text, count = joined.tobytes(), np.diff(first)
    shingles = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    out = np.concatenate(([0], np.cumsum(shingles)))
    begin = np.repeat(first[:-1] - out[:-1], shingles) + np.arange(out[-1])
    last = np.minimum(begin + size, np.repeat(first[1:], shingles)) if n else begin
    digest = xxhash.xxh64_intdigest
    hashes = np.empty(len(begin), ">u8")
    for i in range(0, len(begin), STEP):
        ends = (to[last[i : i + STEP]] - 1).tolist()
        hashes[i : i + STEP] = [digest(text[a:b], SEED) for a, b in zip(to[begin[i : i + STEP]].tolist(), ends)]
    return hashes, out


def fingerprints(raw: np.ndarray, off: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each document of a chunk."""
    hashes, out = shingle_hashes(raw, off, size)
    packed = hashes.view(np.uint8).reshape(-1, 8)
    got = np.zeros((len(off) - 1, 64), np.uint8)
    for i, (a, b) in enumerate(zip(out[:-1].tolist(), out[1:].tolist())):
        ones = sum((np.unpackbits(packed[j : min(j + STEP, b)], axis=1).sum(0, dtype=np.int64) for j in range(a, b, STEP)), np.zeros(64, np.int64))
        got[i] = 2 * ones > b - a
    return np.packbits(got, axis=1).view(">u8").ravel().astype(np.uint64)


def with_fingerprints(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp) of each row, the fingerprint as a signed 64-bit number."""

    def run(batches):
        for b in batches:
            fp = [fingerprints(raw, off, shingle) for _, _, raw, off in chunks(b.column(1), 1 << 19)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(fp or [np.zeros(0, np.uint64)]).view(np.int64))], ["id", "fp"])

    kind = documents.schema[id_col].dataType.simpleString()
    return documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _halves(state: DataFrame) -> DataFrame:
    """(side, key, other, fp, root): each fingerprint under its upper half and under its lower one."""
    upper, lower = F.shiftright("fp", 32).cast("int"), F.shiftright(F.shiftleft("fp", 32), 32).cast("int")
    both = F.array(F.struct(F.lit(0).alias("side"), upper.alias("key"), lower.alias("other")), F.struct(F.lit(1).alias("side"), lower.alias("key"), upper.alias("other")))
    return state.select("fp", "root", F.explode(both).alias("h")).select("h.side", "h.key", "h.other", "fp", "root")


def _masks(bits: int) -> Column:
    """All 32-bit masks of up to so many bits."""
    signed = [sum(1 << i for i in c) for n in range(bits + 1) for c in combinations(range(32), n)]
    return F.array(*[F.lit(m - (1 << 32) if m >> 31 else m) for m in signed])


def _flipped(column: str, bits: int) -> Column:
    return F.explode(F.transform(_masks(bits), lambda m: F.col(column).bitwiseXOR(m)))


def linked(fps: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """(fp, root): groups of distinct fingerprints (column fp) linked by three or fewer differing bits, those of one member left out.

    Half keys that more than ``heavy`` fingerprints share, and keys a bit away, are *hot*: their fingerprints meet by the
    variants of their other halves, up to 529 each, so that the work follows their number and not its square.
    """
    fps = fps.repartition(max(1, -(-fps.count() // EXPLODED)), "fp")  # 65 rows come of each
    balls = fps.select("fp", F.explode(F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(64)])).alias("m"))
    met = balls.select(F.col("fp").bitwiseXOR(F.col("m")).alias("variant"), "fp").groupBy("variant").agg(F.collect_list("fp").alias("all"))  # 65 at most
    near = met.where(F.size("all") > 1).select(F.array_min("all").alias("a"), F.explode("all").alias("b")).where("a != b")
    one = cut(components(near))
    state = cut(fps.join(one, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root")))
    whole = _halves(state.repartition(max(1, -(-state.count() // EXPLODED)), "fp"))
    balls = whole.select("side", _flipped("key", 1).alias("key"), F.col("key").alias("from"), F.col("other").alias("other2"), F.col("fp").alias("fp2"), F.col("root").alias("root2"))
    many = whole.groupBy("side", "key").count().where(F.col("count") > heavy)
    hot = cut(many.select("side", _flipped("key", 1).alias("key")).distinct())
    three = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) == 3
    cold = balls.join(whole, ["side", "key"]) if hot.isEmpty() else balls.join(hot, ["side", "key"], "left_anti").join(whole, ["side", "key"])
    links = cold.where((F.col("root") < F.col("root2")) & three).select("root", "root2").distinct()
    if not hot.isEmpty():
        # One bit of the other half of those that stand at the key, which makes all that meet there one group already.
        at = whole.join(hot, ["side", "key"], "left_semi").select("side", "key", _flipped("other", 1).alias("variant"), "root")
        at = at.groupBy("side", "key", "variant").agg(F.min("root").alias("root"))
        # Of those that come from a bit away one bit, too; of those that stand there two.
        from_ = balls.join(hot, ["side", "key"], "left_semi")
        own = F.col("key") == F.col("from")
        to = from_.where(own).select("side", "key", _flipped("other2", 2).alias("variant"), "root2").union(from_.where(~own).select("side", "key", _flipped("other2", 1).alias("variant"), "root2"))
        met = to.distinct().join(at, ["side", "key", "variant"]).where("root <> root2")
        links = links.union(met.select(F.least("root", "root2"), F.greatest("root", "root2"))).distinct()
    two = components(links.select(F.col("root").alias("a"), F.col("root2").alias("b")))
    return (
        state.join(two.select("node", F.col("root").alias("to")), F.col("root") == F.col("node"), "left")
        .select("fp", F.coalesce("to", "root").alias("root"))
    )


def fingerprint_groups(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp, component_id) of each row: the least id among the documents reachable over links."""
    rows = cut(with_fingerprints(documents, id_col=id_col, text_col=text_col, shingle=shingle))
    fps = cut(rows.groupBy("fp").agg(F.min("id").alias("least")))
    root = cut(linked(fps.select("fp")))
    ids = fps.join(root, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(root.join(ids, "root").select("fp", "component_id"), "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def deduplicate(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, one_row: bool = False) -> DataFrame:
    """The rows with the least id of each group, with all their columns.

    Rows of a group that repeat its least id stay, and so do rows without an id.  With ``one_row`` each group
    keeps one row: of the least id (none: the last), then of the least text hash.
    """
    if not documents.groupBy(id_col).count().where((F.col("count") > 1) | F.col(id_col).isNull()).limit(1).count():
        groups = fingerprint_groups(documents, id_col=id_col, text_col=text_col, shingle=shingle)
        gone = groups.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_gone"))
        return documents.join(gone, documents[id_col] == gone["_gone"], "left_anti")
    rows = cut(documents.withColumn("_row", F.monotonically_increasing_id()))
    place = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("text"), F.col("_row").alias("row"))
    groups = fingerprint_groups(rows.select(place.alias("_place"), F.col(text_col).alias("_text")), id_col="_place", text_col="_text", shingle=shingle)
    later = F.col("_place") != F.col("component_id") if one_row else F.col("_place.id") != F.col("component_id.id")
    gone = groups.where(later).select(F.col("_place.row").alias("_gone"))
    return rows.join(gone, rows["_row"] == gone["_gone"], "left_anti").drop("_row")
