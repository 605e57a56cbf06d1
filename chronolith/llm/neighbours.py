"""Approximate nearest neighbours by collision-counting hashing.

Unit vectors are projected on ``projections`` seeded random directions, and each projection's
values are kept as one sorted array.  A query's window on each array is centred on the query's own
value; virtual rehashing widens the windows with a growing radius, and each vector that enters
a window collides once more.  Vectors with ``threshold * projections`` collisions are verified
by their exact cosine; a query stops when enough verified vectors lie within the radius, so
that vectors nearer than those had every chance to collide, or when all were verified.

The vectors are indexed in blocks (every vector is in one).  A block's vectors are shuffled once and indexed
once; the stated query rows stream past each block's index, so that they are shuffled once for each
block, and the blocks' best are merged.  Equal vectors are indexed once, with their ``k + 1`` least
ids: nearness ties go to lesser ids, so the others can't be among any query's ``k`` nearest.

Defined results: vectors that are null, zero, empty or holding null or non-finite components take no part, as queries
or as candidates, nor do rows without an id; vectors of each length are searched among themselves, in blocks of their own; rows
that repeat an id are each a candidate under it, except for that id's query.  A query id has one result, of ranks 1 to
``k``: if its rows hold different vectors, a candidate counts with the nearest of them.  Other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PROJECTIONS, THRESHOLD, WIDTH, GROWTH, FIRST = 64, 0.7, 2.4, 1.25, 0.3
LEAST_BLOCK, MOST_BLOCK = 1 << 14, 1 << 17


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return scaled(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)) if n else np.zeros((0, 0))


def scaled(x: np.ndarray) -> np.ndarray:
    """Each row over the power of two next to its largest component: cosines stay the same to the last bit, and no square over- or underflows."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(1))


def cosine(x: np.ndarray, lengths: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosines of the rows of ``x`` with ``q``, each row summed alike, so that equal rows get equal values."""
    return (x * q).sum(1) / (lengths * norms(q[None])[0])


class Index:
    """Sorted arrays of one block's projections."""

    def __init__(self, x: np.ndarray, projections: int = PROJECTIONS, seed: int = 5):
        self.x, self.m, self.lengths = x, projections, norms(x)
        self.a = np.random.default_rng(seed).standard_normal((x.shape[1], projections))
        values = (_unit(x) @ self.a).T
        order = np.argsort(values, axis=1, kind="stable")
        # One ascending array: each projection's sorted values, shifted beyond those before it.
        self.shift = np.arange(projections) * (4 * np.abs(values).max(initial=1.0) + 64)
        self.order = order.ravel()
        self.sorted = (np.take_along_axis(values, order, 1) + self.shift[:, None]).ravel()
        self.first = np.arange(projections) * len(x)

    def search(self, q: np.ndarray, k: int, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
        """(rows verified, their cosines); among them the ``k`` nearest, unless they collided too rarely."""
        n, need = len(self.x), int(np.ceil(threshold * self.m))
        at = (_unit(q[None]) @ self.a)[0] + self.shift
        low = np.searchsorted(self.sorted, at)
        high, counts, done = low.copy(), np.zeros(n, np.int64), np.zeros(n, bool)
        rows, scores, radius = np.zeros(0, np.int64), np.zeros(0), FIRST
        while len(rows) < n:
            half = WIDTH / 2 * radius
            a = np.minimum(low, np.maximum(np.searchsorted(self.sorted, at - half), self.first))
            b = np.maximum(high, np.minimum(np.searchsorted(self.sorted, at + half), self.first + n))
            fresh = [self.order[i:j] for i, j in zip([*a.tolist(), *high.tolist()], [*low.tolist(), *b.tolist()]) if i < j]
            low, high = a, b
            if fresh:
                counts += np.bincount(np.concatenate(fresh), minlength=n)
            new = np.flatnonzero((counts >= need) & ~done)
            if len(new):
                done[new] = True
                rows, scores = np.concatenate((rows, new)), np.concatenate((scores, cosine(self.x[new], self.lengths[new], q)))
            if len(rows) >= k:
                kth = -np.partition(-scores, k - 1)[k - 1]
                if np.sqrt(max(0.0, 2 - 2 * kth)) <= radius:
                    break
            radius *= GROWTH
        return rows, scores


def usable(vector: Column) -> Column:
    """Whether a vector has components, all finite, and not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _search(k: int, projections: int, threshold: float):
    """Searches blocks that stream by, each with its vectors (side 0) before its queries (side 1)."""

    def answers(index: Index, ids, copies, queries: dict):
        out = {"query_id": [], "vec_id": [], "copy": [], "score": []}
        least = np.array([x[0] for x in ids])
        for q, vectors in queries.items():
            best = {}
            for v in vectors:
                found, scores = index.search(v, k + 1, threshold)
                # One vector more than wanted: the query's own may be among them.
                for i in np.lexsort((least[found], -scores))[: k + 1]:
                    best[found[i]] = max(best.get(found[i], -2.0), scores[i])
            near = sorted((-s, x, c) for i, s in best.items() for x, n in zip(ids[i], copies[i]) if x != q for c in range(n))[:k]
            for s, x, c in near:
                for name, value in zip(out, (q, x, c, -s)):
                    out[name].append(value)
        return pa.RecordBatch.from_pydict(out, pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("copy", pa.int32()), ("score", pa.float64())]))

    def run(batches):
        block, index, parts, ids, copies = None, None, [], [], []
        held = {}  # queries whose rows may go on in the next batch
        for b in batches:
            blocks = b.column(0).to_numpy()
            for at in np.split(np.arange(b.num_rows), np.flatnonzero(np.diff(blocks)) + 1):
                if not len(at):
                    continue
                part = b.slice(at[0], len(at))
                if blocks[at[0]] != block:
                    if held:
                        yield answers(index, ids, copies, held)
                    block, index, parts, ids, copies, held = blocks[at[0]], None, [], [], [], {}
                side = part.column(1).to_numpy()
                n = int((side == 0).sum())
                if n:
                    first = part.slice(0, n)
                    parts.append(_matrix(first.column(5)))
                    ids += first.column(3).to_pylist()
                    copies += first.column(4).to_pylist()
                if n < len(side) and parts:
                    if index is None:
                        index, parts = Index(np.concatenate(parts), projections), parts[:1]
                    rest = part.slice(n)
                    for q, v in zip(rest.column(2).to_pylist(), _matrix(rest.column(5))):
                        if held and q not in held:
                            yield answers(index, ids, copies, held)
                            held = {}
                        held.setdefault(q, []).append(v)
        if held:
            yield answers(index, ids, copies, held)

    return run


def nearest(vectors: DataFrame, is_query, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, block_rows: int | None = None, projections: int = PROJECTIONS, threshold: float = THRESHOLD) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each id for which ``is_query(id column)`` holds.

    ``block_rows``: vectors of a block; by default a 64th of all, from 16,384 to 131,072.
    """
    kind = vectors.schema[vector_col].dataType.elementType.simpleString()
    assert kind in ("float", "double"), kind
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    first, plan = 0, []  # (length, first block, blocks)
    for n, total in sorted(rows.groupBy(F.size("v").alias("n")).count().collect()):
        plan.append((n, first, max(1, -(-total // (block_rows or min(max(LEAST_BLOCK, total // 64), MOST_BLOCK))))))
        first += plan[-1][2]
    blocks = max(1, first)
    lengths = F.broadcast(vectors.sparkSession.createDataFrame(plan, "length int, first long, blocks long"))
    of_length = lambda df: df.join(lengths, F.size("v") == F.col("length"))
    # A vector's k + 1 least ids, each with up to k of its rows: whichever id is left out, k rows stay.
    each = rows.groupBy("v", "id").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("n"))
    few = each.withColumn("place", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("place") <= k + 1)
    distinct = few.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("all"))
    none = F.lit(None)
    left = of_length(distinct).select((F.col("first") + F.pmod(F.xxhash64("all.id", "v"), F.col("blocks"))).alias("block"), F.lit(0).alias("side"), none.cast("long").alias("id"), F.col("all.id").alias("ids"), F.col("all.n").alias("copies"), "v")
    queries = rows.where(is_query(F.col("id"))).distinct()
    right = of_length(queries).select(F.explode(F.sequence(F.col("first"), F.col("first") + F.col("blocks") - 1)).alias("block"), F.lit(1).alias("side"), "id", none.cast("array<long>").alias("ids"), none.cast("array<int>").alias("copies"), "v")
    both = left.unionByName(right).repartitionById(blocks, F.col("block").cast("int")).sortWithinPartitions("block", "side", "id")
    found = both.mapInArrow(_search(k, projections, threshold), "query_id long, vec_id long, copy int, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "copy")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
