"""Embedding whitening by a randomised range finder and Rayleigh-Ritz.

Components c of a vector become whole numbers floor(``scale`` * c).  The *fit list* holds each distinct
vector of whole numbers once; its covariance V (centred, divisor n) is never taken from raw moments.  A
range finder multiplies V by random directions, ``oversample`` more than the components wanted, by
a pass over all centred vectors; each further pass multiplies by the orthonormal range once more and gives, by
Rayleigh-Ritz, eigenvalues and vectors of V in that range together with their residuals.  Passes go on until
the residuals, against the gaps between the values, allow no error above ``tolerance``; if they don't after ``passes``
of them, the range is expanded to the full dimension, where one pass gives V itself.

What is gathered doesn't grow with the rows: a pass adds up matrices of dimension x range in each task, then in a square root as many
tasks, then on the driver.  The fit list is written once to the shared folder, a byte for each component where the numbers are small.

Defined results: vectors that are null, empty or hold null or non-finite entries are dropped; rows of each length are
whitened among themselves, with some jobs for each length; rows that repeat an id, or have none, have a result each;
components without variance can't be scaled to one and have no row, so that a list of one vector gives no row at all;
``deviation`` is null where the sum is beyond a long; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import cut

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
OVERSAMPLE, PASSES, TOLERANCE = 16, 6, 1e-11
#: Components that are handled at once.
STEP = 1 << 19
_KINDS = ("<i1", "<i2", "<i4", "<i8")


def usable(vector: Column) -> Column:
    """Whether a vector has components, all finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad, F.lit(False))


def whole_numbers(column, dim: int, scale: float) -> np.ndarray:
    """floor(scale * c) of a list column; numbers beyond a quarter of a long count as that."""
    x = np.asarray(column.flatten()).astype(np.float64).reshape(-1, dim)
    return np.clip(np.floor(scale * x), -(2.0**61), 2.0**61).astype(np.int64)


def pack(x: np.ndarray) -> list[bytes]:
    """Each row in the least of four widths that holds it, so that equal rows and no others have equal bytes."""
    big = np.maximum(np.abs(x).max(1), 0)
    width = np.searchsorted([127, 32767, 2**31 - 1], big)
    out = [b""] * len(x)
    for w in np.unique(width):
        kind = x[width == w].astype(_KINDS[w])
        for i, row in zip(np.flatnonzero(width == w), kind):
            out[i] = row.tobytes()
    return out


def unpack(column, dim: int) -> np.ndarray:
    """The rows of ``pack``, by the lengths of their bytes."""
    rows = column.to_pylist()
    size = np.array([len(r) for r in rows])
    out = np.empty((len(rows), dim), np.int64)
    for w, kind in enumerate(_KINDS):
        some = np.flatnonzero(size == dim << w)
        if len(some):
            out[some] = np.frombuffer(b"".join(rows[i] for i in some), kind).reshape(-1, dim)
    return out


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - sums / n with one rounding: the difference n * x - sums is whole."""
    if float(np.abs(x).max(initial=0)) * n < 2.0**62:
        return (x * n - np.array(sums, np.int64)) / n
    return ((x.astype(object) * n - np.array(sums, object)) / n).astype(float)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list:
    """The exact sums of (n * x - sums) ** 2; None beyond a long."""
    if (float(np.abs(x).max(initial=0)) * 2 * n) ** 2 * x.shape[1] < 2.0**62:
        d = x * n - np.array(sums, np.int64)
        return (d * d).sum(1).tolist()
    found = [sum((a * n - s) ** 2 for a, s in zip(row, sums)) for row in x.tolist()]
    return [v if v < 2**63 else None for v in found]


def _added(rows: DataFrame, work, shape: tuple) -> np.ndarray:
    """The sum over all rows of ``work(packed column)``, added in tasks, in fewer tasks, on the driver."""

    def each(batches):
        total = np.zeros(shape)
        for b in batches:
            step = max(1, STEP // shape[0])
            for i in range(0, b.num_rows, step):
                total += work(b.column(0).slice(i, step))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sum"])

    def together(batches):
        total = np.zeros(shape)
        for b in batches:
            for part in b.column(0):
                total += np.frombuffer(part.as_buffer(), float).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sum"])

    parts = rows.select("x").mapInArrow(each, "sum binary")
    few = parts.repartition(max(1, isqrt(parts.rdd.getNumPartitions()))).mapInArrow(together, "sum binary")
    return sum((np.frombuffer(r[0], float).reshape(shape) for r in few.toLocalIterator()), np.zeros(shape))


def _sums(rows: DataFrame, dim: int) -> tuple[int, list[int]]:
    """(rows, exact sum of each dimension)."""

    def each(batches):
        n, total = 0, [0] * dim
        for b in batches:
            for i in range(0, b.num_rows, max(1, STEP // dim)):
                x = unpack(b.column(0).slice(i, max(1, STEP // dim)), dim)
                # Halves of 32 bits, whose sums can't overflow here.
                high, low = (x >> 32).sum(0).tolist(), (x & 0xFFFFFFFF).sum(0).tolist()
                total = [t + (h << 32) + v for t, h, v in zip(total, high, low)]
                n += len(x)
        yield pa.RecordBatch.from_pydict({"d": [-1, *range(dim)], "s": [str(v) for v in (n, *total)]}, pa.schema([("d", pa.int32()), ("s", pa.string())]))

    found = rows.select("x").mapInArrow(each, "d int, s string").groupBy("d").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    by = {r.d: int(r.s) for r in found}
    return by.get(-1, 0), [by.get(d, 0) for d in range(dim)]


def ritz(q: np.ndarray, vq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(falling Ritz values, their unit vectors, norms of their residuals) of V in the range ``q``, by V q."""
    small = q.T @ vq
    value, vector = np.linalg.eigh((small + small.T) / 2)
    value, vector = value[::-1], vector[:, ::-1]
    found = q @ vector
    return value, found, np.linalg.norm(vq @ vector - found * value, axis=0)


def converged(value: np.ndarray, residual: np.ndarray, k: int, tolerance: float) -> bool:
    """Whether the first ``k`` pairs' residuals are below ``tolerance`` of the gaps to all other values."""
    gap = np.abs(value[:k, None] - value[None, :]) + np.eye(len(value))[:k] * max(value[0], 0)
    if len(value) > k:  # what lies outside of the range is below its last value, at least as it was found
        gap = np.minimum(gap, np.abs(value[:k, None] - value[-1]))
    return bool((residual[:k] <= tolerance * gap.min(1)).all())


def fit_whitening(vectors: DataFrame, dim: int, *, vector_col: str = "embedding", components: int = COMPONENTS, scale: float = SCALE, oversample: int = OVERSAMPLE, passes: int = PASSES, tolerance: float = TOLERANCE, seed: int = 3) -> dict:
    """The whitening of the usable rows of length ``dim``: n, sums, values, vectors, explained, identity_error, passes, full."""

    def packed(batches):
        for b in batches:
            for i in range(0, b.num_rows, max(1, STEP // dim)):
                yield pa.RecordBatch.from_arrays([pa.array(pack(whole_numbers(b.column(0).slice(i, max(1, STEP // dim)), dim, scale)), pa.binary())], ["x"])

    rows = cut(vectors.select(vector_col).mapInArrow(packed, "x binary").distinct())
    n, sums = _sums(rows, dim)
    k = min(components, dim)
    if n < 2:
        return {"n": n, "sums": sums, "values": np.zeros(0), "vectors": np.zeros((dim, 0)), "explained": np.zeros(0), "identity_error": 0.0, "passes": 0, "full": False}

    def times(q: np.ndarray) -> np.ndarray:
        """(V q, and the variances below it)."""

        def work(column):
            c = centred(unpack(column, dim), n, sums)
            return np.concatenate((c.T @ (c @ q), (c * c).sum(0)[:, None]), 1)

        return _added(rows, work, (dim, q.shape[1] + 1)) / n

    wide, count = min(dim, k + oversample), 1
    full = wide == dim
    q = np.eye(dim) if full else np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, wide)))[0]
    got = times(q)
    trace = float(got[:, -1].sum())
    value, vector, residual = ritz(q, got[:, :-1])
    while not full and not converged(value, residual, k, tolerance):
        if count < passes:
            q = np.linalg.qr(got[:, :-1])[0]
        else:
            q, full = np.eye(dim), True
        got, count = times(q), count + 1
        value, vector, residual = ritz(q, got[:, :-1])
    some = value[:k] > max(value[0], 0) * 1e-12
    value, vector = value[:k][some], vector[:, :k][:, some]
    model = {"n": n, "sums": sums, "values": value, "vectors": vector, "explained": value / trace if trace else value, "passes": count, "full": full}

    def work(column):
        w = projected(unpack(column, dim), model)
        return np.concatenate((w.T @ w, w.sum(0)[:, None]), 1)

    m = len(value)
    second = _added(rows, work, (m, m + 1)) / n if m else np.zeros((0, 1))
    apart = second[:, :-1] - second[:, -1:] * second[:, -1] - np.eye(m)
    return model | {"identity_error": float(np.abs(apart).max(initial=0.0))}


def projected(x: np.ndarray, model: dict) -> np.ndarray:
    """Centred whole numbers on the components, over the roots of their values."""
    return centred(x, model["n"], model["sums"]) @ model["vectors"] / np.sqrt(model["values"])


def whiten(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = SCALE, **options) -> DataFrame:
    """(id, n, deviation, whitened array, explained array, identity_error) of each usable row."""
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(usable(F.col("v")))
    lengths = [r[0] for r in rows.select(F.size("v").alias("n")).distinct().orderBy("n").toLocalIterator()]
    schema = f"id {kind}, n long, deviation long, whitened array<double>, explained array<double>, identity_error double"
    out = vectors.sparkSession.createDataFrame([], schema)
    for place, dim in enumerate(lengths):
        these = rows.where(F.size("v") == dim)
        found = these.mapInArrow(_whitener(fit_whitening(these, dim, vector_col="v", scale=scale, **options), dim, scale), schema)
        out = out.unionByName(found) if place else found
    return out.withColumnRenamed("id", id_col)


def _whitener(model: dict, dim: int, scale: float):
    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, max(1, STEP // dim)):
                part = b.slice(i, max(1, STEP // dim))
                x, m = whole_numbers(part.column(1), dim, scale), part.num_rows
                w = projected(x, model)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * w.shape[1]), pa.array(v.ravel())) for v in (w, np.tile(model["explained"], (m, 1)))]
                fixed = [pa.array(np.full(m, model["n"], np.int64)), pa.array(deviations(x, model["n"], model["sums"]), pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column(0), *fixed, *lists, pa.array(np.full(m, model["identity_error"]))], ["id", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def whitened_components(vectors: DataFrame, *, id_col: str = "vec_id", **options) -> DataFrame:
    """(id, component from 1, n, deviation, whitened, explained, identity_error): a row for each usable row and component."""
    rows = whiten(vectors, id_col=id_col, **options)
    rows = rows.select(id_col, "n", "deviation", "identity_error", "explained", F.posexplode("whitened").alias("_at", "whitened"))
    return rows.select(id_col, (F.col("_at") + 1).alias("component"), "n", "deviation", "whitened", F.get("explained", "_at").alias("explained"), "identity_error")
