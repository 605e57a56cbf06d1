"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A document's features are the distinct hashed character n-grams (of lower-cased code
points) that it holds.  From labelled documents the operator counts, for each n-gram, the
toxic and the other documents that hold it; the log of the ratio of the two smoothed
shares scales the feature.  N-grams seen in at least ``MIN_DOCS`` documents compete by
``|ratio| * sqrt(documents)`` for ``FEATURES`` places, and a logistic regression with an L2
penalty is fitted on the scaled features.  Fitting takes at most ``max_train_rows``
labelled ids, one row of each, and ``max_bytes`` of their texts; scoring reads every text whole.

Defined results: a null or empty text has no feature and gets the model's base rate; rows
that repeat are scored each; other columns of the input are ignored, and an empty table gives
an empty result.  Without any labelled row, or with one class only, the score is the
share of toxic labels (0 without labels).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fitting import MAX_BYTES, fit, labelled_sample
from .text_arrays import chunks, code_points, gram_index, is_long, owner, parts

GRAMS = (3, 4, 5)
BITS = 19
MIN_DOCS = 3
FEATURES = 1 << 13
THRESHOLD = 0.3


def _pairs(raw, off, allowed=None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, feature) pairs of a chunk, by document; a long text is worked off in parts."""
    if not is_long(off):
        return _pairs_of(raw, off, allowed)
    found = np.unique(np.concatenate([_pairs_of(raw[a:end], np.array([0, end - a]), allowed)[1] for a, _, end in parts(raw, max(GRAMS) - 1)]))
    return np.zeros(len(found), np.int64), found


def _pairs_of(raw, off, allowed) -> tuple[np.ndarray, np.ndarray]:
    cp, coff = code_points(raw, off)
    doc = owner(coff)
    keys = []
    for n in GRAMS:
        index, of = gram_index(cp, doc, n, BITS)
        if allowed is not None:
            hit = allowed[index]
            index, of = index[hit], of[hit]
        keys.append((of << BITS) | index)
    pairs = np.unique(np.concatenate(keys))
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def train(texts, labels, steps: int = 150, penalty: float = 1e-4) -> dict:
    y = np.concatenate([np.asarray(x, float) for x in labels]) if labels else np.zeros(0)
    if not len(y) or y.min() == y.max():
        rate = float(y.mean()) if len(y) else 0.0
        return {"bias": float(np.log((rate + 1e-6) / (1 - rate + 1e-6))), "index": np.zeros(0, np.int64), "weight": np.zeros(0, np.float32)}
    counts, base = np.zeros((2, 1 << BITS)), 0
    for column in texts:
        for row, end, raw, off in chunks(column):
            doc, index = _pairs(raw, off)
            toxic = y[base + row : base + end][doc] > 0
            counts[1] += np.bincount(index[toxic], minlength=1 << BITS)
            counts[0] += np.bincount(index[~toxic], minlength=1 << BITS)
        base += len(column)
    seen = counts.sum(0)
    ratio = np.log((counts[1] + 1) / (y.sum() + 2)) - np.log((counts[0] + 1) / ((1 - y).sum() + 2))
    worth = np.where(seen >= MIN_DOCS, np.abs(ratio) * np.sqrt(seen), 0)
    kept = np.flatnonzero(worth > 0)
    kept = np.sort(kept[np.argsort(-worth[kept], kind="stable")[:FEATURES]])
    place = np.full(1 << BITS, -1, np.int64)
    place[kept] = np.arange(len(kept))
    allowed, rows, cols, base = place >= 0, [], [], 0
    for column in texts:
        for row, _, raw, off in chunks(column):
            doc, index = _pairs(raw, off, allowed)
            rows.append(doc + base + row)
            cols.append(place[index])
        base += len(column)
    rows, cols = np.concatenate(rows), np.concatenate(cols)
    value = ratio[kept][cols]
    w, b = np.zeros(len(kept)), float(np.log(y.mean() / (1 - y.mean())))
    m, v = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    for t in range(1, steps + 1):  # Adam on the whole sample
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, w[cols] * value, len(y)) + b, -40, 40)))
        g = (p - y) / len(y)
        grad = np.append(np.bincount(cols, g[rows] * value, len(kept)) + penalty * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = 0.02 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return {"bias": float(b), "index": kept, "weight": (w * ratio[kept]).astype(np.float32), "ratio": ratio[kept]}


def _scores(model: dict):
    """A function that gives the scores of a column of texts."""
    weight = np.zeros(1 << BITS)
    weight[model["index"]] = model["weight"]
    allowed = np.zeros(1 << BITS, bool)
    allowed[model["index"]] = True

    def scores(column) -> np.ndarray:
        margin = np.full(len(column), model["bias"])
        for row, end, raw, off in chunks(column):
            doc, index = _pairs(raw, off, allowed)
            margin[row:end] += np.bincount(doc, weight[index], end - row)
        return 1 / (1 + np.exp(-np.clip(margin, -700, 700)))

    return scores


def scorer(model: dict):
    """A function for mapInArrow: (id, text) to (id, score)."""

    def run(batches):
        scores = _scores(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores(b.column(1)))], ["id", "score"])

    return run


def fit_toxicity(documents: DataFrame, labels: DataFrame, *, train_rows=lambda key: F.lit(True), label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", max_train_rows: int = 6000, max_bytes: int = MAX_BYTES) -> dict:
    """The fitted model; ``train_rows`` tells from an id's text form whether its label may be learned."""
    return fit(labelled_sample(documents, labels, label, max_train_rows, train_rows, id_col, text_col, max_bytes), train)


def score_toxicity(documents: DataFrame, model: dict, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, score, predicted) of each row."""
    kind = documents.schema[id_col].dataType.simpleString()
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(scorer(model), f"id {kind}, score double").select(
        F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def drop_toxic(documents: DataFrame, model: dict, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score below ``threshold``, with all their columns."""

    def run(batches):
        scores = _scores(model)
        for b in batches:
            yield b.filter(pa.array(scores(b.select([text_col]).column(0)) < threshold))

    return documents.mapInArrow(run, documents.schema)


def bucket(key: Column, n: int) -> Column:
    """The fold of an id: the CRC-32 of its text form, modulo ``n``."""
    return F.crc32(key.cast("binary")) % n
