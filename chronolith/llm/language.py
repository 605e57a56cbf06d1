"""Language identification with error-correcting output codes.

Each language learned gets a codeword of bits: the exhaustive code (2 ** (k - 1) - 1 bits)
up to five languages, beyond that seeded random bits whose rows were chosen far apart.  One
logistic classifier on hashed character n-grams (one to three code points, square roots of
their relative frequencies) predicts each bit.  Decoding sums each codeword's logistic loss
over the bits, each bit weighted by how well its classifier did on the sample; the codeword of
least loss wins, the score is its share in the softmax of the negative losses, and a
document is flagged ambiguous if the runner-up's share is within ``margin`` of it.

Fitting takes the ``per_language`` rows of each language whose ids have the least hashes, one row of an id and language; of
these the languages in turn give one each until there are ``max_train_rows``, or ``max_bytes`` of texts (both bounds are on rows: with more
languages than rows, those of the least hashes are learned).  Prediction reads every text
whole, a long one part by part, and holds the counts of ``ROWS`` documents at most.

Defined results: a null text, or one without any letter, gets ``und`` with score 0 and is
ambiguous; repeated rows are predicted each; other columns are ignored; without a learnable row
everything is ``und``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .fitting import MAX_BYTES, fit, rows_to_learn, with_texts
from .text_arrays import chunks, code_points, gram_index, is_long, owner, parts

GRAMS = (1, 2, 3)
BITS = 13
#: Documents whose counts are held together.
ROWS = 256
UNKNOWN = "und"


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """A k-row matrix of -1 and 1; no column is constant or the opposite of another for k <= 5."""
    if k <= 1:
        return np.ones((k, 1))
    if k <= 5:
        columns = np.arange(2 ** (k - 1) - 1)
        rows = [np.ones(len(columns))] + [np.where(columns >> i & 1, 1, -1) for i in range(k - 1)]
        return np.array(rows, float)
    rng, best, apart = np.random.default_rng(seed), None, -1
    width = max(15, 4 * int(np.ceil(np.log2(k))))
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (k, width))
        code[:, np.abs(code.sum(0)) == k] *= rng.choice([-1.0, 1.0], (k, 1))
        gap = ((width - code @ code.T) / 2 + np.eye(k) * width).min()
        if gap > apart:
            best, apart = code, gap
    return best


def _counts(raw, off, before: int | None = None) -> np.ndarray:
    """How often each document has each hashed n-gram; of one text only those that start before the byte ``before``."""
    cp, coff = code_points(raw, off)
    doc, n = owner(coff), len(off) - 1
    first = len(cp) if before is None else int(((raw[:before] & 0xC0) != 0x80).sum())
    counts = np.zeros(n << BITS)
    for g in GRAMS:
        index, of = gram_index(cp, doc, g, BITS)
        if before is not None:
            index, of = index[:first], of[:first]
        counts += np.bincount((of << BITS) | index, minlength=n << BITS)
    return counts.reshape(n, 1 << BITS)


def features(raw, off) -> np.ndarray:
    """A row for each document of a chunk: square roots of the relative frequencies of its hashed n-grams."""
    if is_long(off):
        counts = sum(_counts(raw[a:end], np.array([0, end - a]), z - a) for a, z, end in parts(raw, max(GRAMS) - 1))
    else:
        counts = _counts(raw, off)
    return np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1)).astype(np.float32)


def train(texts, labels, steps: int = 120, penalty: float = 1e-5) -> dict:
    names = sorted({x for column in labels for x in column.to_pylist()})
    if not names:
        return {"names": [], "code": np.ones((0, 1)), "w": np.zeros((1 << BITS, 1), np.float32), "b": np.zeros(1), "trust": np.ones(1)}
    x = np.concatenate([features(raw, off) for column in texts for _, _, raw, off in chunks(column, rows=ROWS)])
    y = np.array([names.index(v) for column in labels for v in column.to_pylist()])
    code = codewords(len(names))
    target = code[y].astype(np.float32)
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    for t in range(1, steps + 1):
        g = -target / (1 + np.exp(np.clip(target * (x @ w + b), -40, 40))) / len(y)
        for p, grad, a, s in ((w, x.T @ g + penalty * w, m, v), (b, g.sum(0), mb, vb)):
            a += 0.1 * (grad - a)
            s += 0.001 * (grad**2 - s)
            p -= 0.3 * (a / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    right = ((x @ w + b) * target > 0).mean(0)
    return {"names": names, "code": code, "w": w, "b": b, "trust": np.maximum(2 * right - 1, 1e-3)}


def decode(f: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codeword, its share, the runner-up's share) for rows of bit margins."""
    loss = np.stack([(np.logaddexp(0, -f * row) * model["trust"]).sum(1) for row in model["code"]], 1)
    share = np.exp(loss.min(1, keepdims=True) - loss)
    share /= share.sum(1, keepdims=True)
    order = np.argsort(-share, axis=1, kind="stable")
    rows = np.arange(len(f))
    second = share[rows, order[:, 1]] if share.shape[1] > 1 else np.zeros(len(f))
    return order[:, 0], share[rows, order[:, 0]], second


def predictor(model: dict, margin: float):
    names = np.array(model["names"] or [UNKNOWN], object)

    def run(batches):
        for b in batches:
            n = b.num_rows
            lang, score, unsure = np.full(n, UNKNOWN, object), np.zeros(n), np.ones(n, bool)
            known = b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            if model["names"]:
                for row, end, raw, off in chunks(b.column(1), rows=ROWS):
                    best, share, second = decode(features(raw, off) @ model["w"] + model["b"], model)
                    ok = known[row:end]
                    lang[row:end][ok], score[row:end][ok], unsure[row:end][ok] = names[best][ok], share[ok], (share - second < margin)[ok]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(unsure)], ["id", "lang_pred", "score", "ambiguous"])

    return run


def fit_language(documents: DataFrame, *, train_rows=lambda key: F.lit(True), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 1000, max_train_rows: int = 6000, max_bytes: int = MAX_BYTES) -> dict:
    """Learn from rows with an id, a text and a language; ``train_rows`` is a condition on the id's text form."""
    docs = documents.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("label"), F.col(text_col).cast("string").alias("text"))
    docs = docs.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("text").isNotNull() & train_rows(F.col("id").cast("string")))
    # Each task passes on no more than the first rows of each language, so that a common one isn't gathered.
    turn = F.row_number().over(Window.partitionBy("label").orderBy("ord", "id", "mark"))
    chosen = rows_to_learn(docs).withColumn("turn", turn).where(F.col("turn") <= min(per_language, 1000)).orderBy("turn", "ord", "label").limit(max_train_rows)
    one = chosen.groupBy("id", "label", "ord").agg(F.min(F.struct("mark", "size", "turn")).alias("m")).select("id", "label", "ord", "m.*")
    return fit(with_texts(one, docs, ["turn", "ord", "label", "id"], max_bytes), train)


def identify_language(documents: DataFrame, model: dict, *, id_col: str = "doc_id", text_col: str = "text", margin: float = 0.2) -> DataFrame:
    """(id, lang_pred, score, ambiguous) of each row."""
    kind = documents.schema[id_col].dataType.simpleString()
    text = F.col(text_col).cast("string")
    rows = documents.select(F.col(id_col).alias("id"), text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    out = rows.mapInArrow(predictor(model, margin), f"id {kind}, lang_pred string, score double, ambiguous boolean")
    return out.withColumnRenamed("id", id_col)
