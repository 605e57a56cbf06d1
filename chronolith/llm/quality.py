"""Quality: attention-based multiple-instance learning over a document's passages.

A document is a bag of passages of ``PASSAGE`` code points (the last may be shorter).  A passage
is described by its hashed character bigrams and by shares of character classes, repeated
words' traces (distinct four-grams and bytes equal to those a few places before) and length; an
encoder (one tanh layer) gives its representation, gated attention
``softmax(w . (tanh(V z) * sigmoid(U z)))`` its weight, and a logistic layer scores the
weighted mean.  All weights are learned from document labels alone, by back-propagation.

Fitting takes at most ``max_train_rows`` labelled ids, one row of each, and ``max_bytes`` of their texts; scoring reads every text whole, a long one part by part.
Defined results: a null or empty text is one passage of zeros and is scored like any other; rows
that repeat are scored each; other columns are ignored.  Without labels of both classes the
score is the share of label 1 (0 without labels).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fitting import MAX_BYTES, fit, labelled_sample
from .text_arrays import chunks, code_points, is_long, parts

PASSAGE = 400
BIGRAM_BITS = 8
EXTRA = 14
WIDTH, GATE = 24, 12
THRESHOLD = 0.3


def passages(raw, off, part: tuple[int, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(features of each passage, its document) for a chunk.

    ``part``: of a longer text of so many code points, those behind the byte are the start of the next part.
    """
    cp, coff = code_points(raw, off, lower=False)
    if part:
        following, total = cp[int(((raw[: part[0]] & 0xC0) != 0x80).sum()) :], part[1]
        cp = cp[: len(cp) - len(following)]
        coff = np.array([0, len(cp)])
    size = np.diff(coff)
    bags = np.maximum(1, -(-size // PASSAGE))
    first = np.concatenate(([0], np.cumsum(bags)))
    doc_of = np.repeat(np.arange(len(size)), bags)
    place = np.arange(len(cp)) - np.repeat(coff[:-1], size)
    of = np.repeat(first[:-1], size) + place // PASSAGE
    n = first[-1]
    length = np.bincount(of, minlength=n).astype(float)
    per = np.maximum(length, 1)
    hist = np.zeros(n << BIGRAM_BITS)
    extra = np.zeros((n, EXTRA))
    if len(cp):
        pair = (cp[:-1] * np.uint32(0x85EBCA6B) + cp[1:]) * np.uint32(0xC2B2AE35) >> np.uint32(32 - BIGRAM_BITS)
        inside = of[:-1] == of[1:]
        hist += np.bincount(((of[:-1] << BIGRAM_BITS) | pair)[inside], minlength=n << BIGRAM_BITS)
        space = (cp == 32) | (cp == 10)
        classes = (
            (cp >= 65) & (cp <= 90), (cp >= 97) & (cp <= 122), (cp >= 48) & (cp <= 57), cp == 32, cp == 10, cp > 127, cp == 46,
            ((cp > 32) & (cp < 48) & (cp != 46) & (cp != 44)) | ((cp > 57) & (cp < 65)) | ((cp > 90) & (cp < 97)) | ((cp > 122) & (cp < 128)),
        )
        for i, x in enumerate(classes):
            extra[:, i] = np.bincount(of[x], minlength=n) / per
        same = np.concatenate(([False], (cp[1:] == cp[:-1]) & inside))
        extra[:, 8] = np.bincount(of[same], minlength=n) / per
        if len(cp) > 3:
            four = ((cp[:-3] * np.uint32(0x9E3779B1) + cp[1:-2]) * np.uint32(0x85EBCA6B) + cp[2:-1]) * np.uint32(0xC2B2AE35) + cp[3:]
            four = (four * np.uint32(0x27D4EB2F)) >> np.uint32(21)
            held = np.zeros(n << 11, bool)
            inner = of[:-3] == of[3:]
            held[((of[:-3] << 11) | four)[inner]] = True
            extra[:, 9] = held.reshape(n, -1).sum(1) / per
        stops = np.append(space[1:], True)  # behind a place comes a blank or the document's end
        stops[coff[1:][size > 0] - 1] = True
        if part and len(following):
            stops[-1] = following[0] in (32, 10)
        extra[:, 10] = np.bincount(of[stops & ~space], minlength=n) / per * 5
    extra[:, 11] = length / PASSAGE
    extra[:, 12] = np.log1p(total if part else size[doc_of]) / 10
    extra[:, 13] = 1
    share = np.sqrt(hist.reshape(n, -1) / per[:, None])
    return np.concatenate((share, extra), 1).astype(np.float32), doc_of


def _encoded(x, p):
    """(representation, both gates, attention before the softmax) of passages."""
    z = np.tanh(x @ p["W"])
    t, s = np.tanh(z @ p["V"]), 1 / (1 + np.exp(-(z @ p["U"])))
    return z, t, s, (t * s) @ p["w"]


def _part_by_part(raw) -> tuple[np.ndarray, np.ndarray]:
    """The passages of one long text."""
    count = int(((raw & 0xC0) != 0x80).sum())
    x = np.concatenate([passages(raw[a:end], np.array([0, end - a]), (z - a, count))[0] for a, z, end in parts(raw, 1, PASSAGE)])
    return x, np.zeros(len(x), np.int64)


def _long(raw, model: dict) -> tuple[float, int]:
    """(score, passage weighted most) of one long text, part by part."""
    p, count = model["p"], int(((raw & 0xC0) != 0x80).sum())
    top, best, number, mass, bag = -np.inf, 0, 0, 0.0, np.zeros(WIDTH)
    for a, z, end in parts(raw, 1, PASSAGE):
        x, _ = passages(raw[a:end], np.array([0, end - a]), (z - a, count))
        code, _, _, e = _encoded((x - model["mean"]) / model["sd"], p)
        e = e.astype(float)
        if e.max() > top:
            shrink = np.exp(top - e.max())
            mass, bag, best, top = mass * shrink, bag * shrink, number + int(e.argmax()), float(e.max())
        w = np.exp(e - top)
        mass, bag, number = mass + w.sum(), bag + w @ code, number + len(e)
    out = float(bag / mass @ p["c"] + p["b"][0])
    return 1 / (1 + np.exp(-np.clip(out, -700, 700))), best


def _forward(x, start, of, p):
    z, t, s, e = _encoded(x, p)
    a = np.exp(e - np.maximum.reduceat(e, start)[of])
    a = a / np.add.reduceat(a, start)[of]
    bag = np.add.reduceat(z * a[:, None], start)
    return z, t, s, a, bag, bag @ p["c"] + p["b"][0]


def train(texts, labels, steps: int = 150, penalty: float = 1e-4, seed: int = 11) -> dict:
    y = np.concatenate([np.asarray(x, float) for x in labels]) if labels else np.zeros(0)
    if not len(y) or y.min() == y.max():
        return {"rate": float(y.mean()) if len(y) else 0.0}
    xs, ofs, base = [], [], 0
    for column in texts:
        for row, _, raw, off in chunks(column):
            x, of = _part_by_part(raw) if is_long(off) else passages(raw, off)
            xs.append(x)
            ofs.append(of + base + row)
        base += len(column)
    x, of = np.concatenate(xs), np.concatenate(ofs)
    mean, sd = x.mean(0), x.std(0) + 1e-3
    mean[-1], sd[-1] = 0, 1
    x = (x - mean) / sd
    start = np.searchsorted(of, np.arange(len(y)))
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    p = {"W": draw(x.shape[1], WIDTH), "V": draw(WIDTH, GATE), "U": draw(WIDTH, GATE), "w": draw(GATE), "c": draw(WIDTH), "b": np.full(1, np.log(y.mean() / (1 - y.mean())), np.float32)}
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    for i in range(1, steps + 1):
        z, t, s, a, bag, out = _forward(x, start, of, p)
        d = ((1 / (1 + np.exp(-out)) - y) / len(y)).astype(np.float32)
        dbag = d[:, None] * p["c"]
        dz = a[:, None] * dbag[of]
        da = (z * dbag[of]).sum(1)
        de = a * (da - np.add.reduceat(a * da, start)[of])
        dt, ds = de[:, None] * p["w"] * s * (1 - t**2), de[:, None] * p["w"] * t * s * (1 - s)
        dz += dt @ p["V"].T + ds @ p["U"].T
        grads = {"c": bag.T @ d, "b": d.sum(keepdims=True), "w": (t * s).T @ de, "V": z.T @ dt, "U": z.T @ ds, "W": x.T @ (dz * (1 - z**2))}
        for k, g in grads.items():
            g = g + (penalty * p[k] if k != "b" else 0)
            m, v = state[k]
            m += 0.1 * (g - m)
            v += 0.001 * (g**2 - v)
            p[k] = (p[k] - 0.01 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)).astype(np.float32)
    return {"p": p, "mean": mean, "sd": sd}


def scorer(model: dict):
    def run(batches):
        for b in batches:
            score = np.full(b.num_rows, model.get("rate", 0.0))
            top = np.zeros(b.num_rows, np.int32)
            if "p" in model:
                for row, end, raw, off in chunks(b.column(1)):
                    if is_long(off):
                        score[row], top[row] = _long(raw, model)
                        continue
                    x, of = passages(raw, off)
                    start = np.searchsorted(of, np.arange(end - row))
                    *_, a, _, out = _forward((x - model["mean"]) / model["sd"], start, of, model["p"])
                    score[row:end] = 1 / (1 + np.exp(-np.clip(out.astype(float), -700, 700)))
                    best = np.maximum.reduceat(a, start)[of] <= a
                    where = np.flatnonzero(best)
                    top[row:end] = (where - start[of[where]])[np.searchsorted(of[where], np.arange(end - row))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array(top, pa.int32())], ["id", "score", "top_passage"])

    return run


def fit_quality(documents: DataFrame, labels: DataFrame, *, train_rows=lambda key: F.lit(True), label: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_train_rows: int = 5000, max_bytes: int = MAX_BYTES) -> dict:
    """The fitted model; ``train_rows`` tells from an id's text form whether its label may be learned."""
    return fit(labelled_sample(documents, labels, label, max_train_rows, train_rows, id_col, text_col, max_bytes), train)


def score_quality(documents: DataFrame, model: dict, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, score, predicted, top_passage) of each row; top_passage is the number of the passage weighted most."""
    kind = documents.schema[id_col].dataType.simpleString()
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(scorer(model), f"id {kind}, score double, top_passage int").select(
        F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "top_passage"
    )
