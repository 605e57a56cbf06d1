"""Rows that repeat an id, bounds of samples, extreme vectors, ids of other types; and the classifiers worked out naively."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronolith.llm import decontaminate, fitting, language, neighbours, quality, substring_dedup, suffix_dedup, toxicity
from chronolith.llm.text_arrays import chunks

from .helpers import documents, removed_bytes, removed_words


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_BYTES, 0])
def test_hits_are_a_rows_own(spark, limit):
    item = " ".join(f"bench{i}" for i in range(15))
    clean = " ".join(f"word{i}" for i in range(20))
    rows = [(1, item), (1, clean), (1, "three clean words"), (1, f"{clean} {item}"), (2, clean), (None, item), (None, clean), (1, item)]
    docs = documents(spark, [t for _, t in rows], [i for i, _ in rows]).withColumnRenamed("key", "mark").withColumnRenamed("rest", "w")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = Counter((r.doc_id, r.n_words, r.n_hit, r.contaminated) for r in decontaminate.contamination(docs, items, broadcast_bytes=limit).collect())
    assert got == Counter({(1, 15, 15, True): 2, (1, 20, 0, False): 1, (1, 3, 0, False): 1, (1, 35, 15, True): 1, (2, 20, 0, False): 1, (None, 15, 15, True): 1, (None, 20, 0, False): 1})
    kept = decontaminate.remove_contaminated(docs, items, broadcast_bytes=limit)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(1, clean), (1, "three clean words"), (2, clean), (None, clean)])
    spans = decontaminate.remove_spans(docs, items, broadcast_bytes=limit)
    assert spans.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in spans.collect()) == Counter([(1, ""), (1, ""), (1, clean), (1, clean), (1, "three clean words"), (2, clean), (None, ""), (None, clean)])


def test_samples_are_bounded(spark):
    docs = documents(spark, [f"text number {i}" for i in range(500)] + ["other words", "x" * 3000], [5] * 500 + [6, 7])
    labels = spark.createDataFrame([(5, 1), (5, 0), (6, 0), (7, 1), (None, 1)], "doc_id long, toxic int")
    rows = fitting.labelled_sample(docs, labels, "toxic", 3, lambda key: F.lit(True), "doc_id", "text").collect()
    assert Counter(r.label for r in rows) == {1: 2, 0: 1} and sum(r.text.startswith("text number") for r in rows) == 1
    assert len(fitting.labelled_sample(docs, labels, "toxic", 2, lambda key: F.lit(True), "doc_id", "text").collect()) == 2
    # The long text is over a sixteenth of the bytes; the others are taken in order while they fit.
    few = fitting.labelled_sample(docs, labels, "toxic", 3, lambda key: F.lit(True), "doc_id", "text", max_bytes=16 * 100).collect()
    assert len(few) == 2 and max(len(r.text) for r in few) < 100
    repeated = documents(spark, ["the same"] * 300 + ["that"] * 3, [1] * 300 + [2] * 3)
    assert len(fitting.labelled_sample(repeated, spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int"), "toxic", 5, lambda key: F.lit(True), "doc_id", "text").collect()) == 2


def test_every_language_is_learned(spark):
    say = {f"l{i:03d}": f"{chr(0x100 + i)}{chr(0x101 + i)} {chr(0x300 + 2 * i)}" for i in range(40)}
    rows = [(50 * i + k, f"{t} {t * 4} {k}", name) for i, (name, t) in enumerate(say.items()) for k in range(3)]
    docs = spark.createDataFrame([*rows, (9999, None, "l001"), (9998, "x", None), (None, "x", "l001")], "doc_id long, text string, lang string")
    model = language.fit_language(docs.withColumn("label", F.lit(1)).withColumn("ord", F.lit(2)), per_language=2, max_train_rows=80)
    assert model["names"] == sorted(say)
    assert len(language.fit_language(docs, per_language=2, max_train_rows=7)["names"]) == 7
    got = language.identify_language(docs.withColumn("score", F.lit("x")), model)
    assert got.count() == docs.count() and got.where("doc_id = 9999").first().lang_pred == "und"
    assert language.identify_language(docs.limit(0), model).count() == 0


def test_cosines_of_extreme_vectors(spark):
    rows = [(0, [1e200, 0.0]), (1, [1e200, 1e200]), (2, [0.0, 1e200]), (50, [1e-200, 0.0]), (51, [3e-320, 3e-320]), (100, [1.0, 2.0, 3.0]), (101, [2.0, 4.0, 6.5]), (102, [1.0, 0.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in neighbours.nearest(frame, lambda i: i % 50 == 0).collect()}
    half = math.sqrt(0.5)
    assert [got[0, k][0] for k in (1, 2, 3, 4)] == [50, 1, 51, 2]
    assert all(abs(got[0, k][1] - s) < 1e-12 for k, s in ((1, 1.0), (2, half), (3, half), (4, 0.0)))
    assert got[100, 1][0] == 101 and got[100, 2][0] == 102 and (100, 3) not in got  # three components meet three only


@pytest.mark.parametrize("kind", ["string", "double"])
def test_ids_of_other_types(spark, kind):
    passage = " ".join(f"word{i}" for i in range(70))
    texts = [passage, f"before {passage}", "short", None, f"{passage} after"]
    names = ["b10", "a2", "zz", "a1", "b9"] if kind == "string" else [2.5, 1.5, 9.0, 0.5, 3.5]
    docs = documents(spark, texts).drop("doc_id").withColumn("doc_id", F.element_at(F.array(*[F.lit(n) for n in names]), (1 - F.col("id")).cast("int")))
    order = sorted(zip(names, texts))
    assert sorted(tuple(r) for r in suffix_dedup.repeated_bytes(docs).collect()) == removed_bytes(order)
    assert sorted(tuple(r) for r in substring_dedup.repeated_words(docs).collect()) == removed_words(order)
    assert suffix_dedup.without_repeats(docs).columns == docs.columns


TEXTS = ["The quick brown fox", "THE QUICK grün fox fox", "", "ab", "zzz zzz zzz zzz", "x" * 900 + " end.\nnew 123", "é à 漢字 text 漢字"]
M = 0xFFFFFFFF


def _gram(chars, bits):
    h = 0x9E3779B1 * len(chars) & M
    for c in chars:
        h = (h * 0x85EBCA6B + ord(c)) & M
        h ^= h >> 15
    h = h * 0xC2B2AE35 & M
    h ^= h >> 16
    return (h * 0x27D4EB2F & M) >> (32 - bits)


def _grams(text, sizes, bits):
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return Counter(_gram(low[i : i + n], bits) for n in sizes for i in range(len(low) - n + 1))


def test_toxicity_is_naive_bayes_scaled():
    texts = [f"{t} {w}" for w in ("bad bad word", "nice thing", "plain") for t in TEXTS] * 2
    y = np.array([("bad" in t) * 1 for t in texts])
    model = toxicity.train([pa.array(texts)], [pa.array(y)])
    held = [set(_grams(t, toxicity.GRAMS, toxicity.BITS)) for t in texts]
    count = [Counter(g for h, v in zip(held, y) if v == side for g in h) for side in (0, 1)]
    ratio = {g: math.log((count[1][g] + 1) / (y.sum() + 2)) - math.log((count[0][g] + 1) / (len(y) - y.sum() + 2)) for g in set().union(*held)}
    kept = {g for g in ratio if count[0][g] + count[1][g] >= toxicity.MIN_DOCS and ratio[g]}
    assert set(model["index"].tolist()) == kept
    assert all(abs(ratio[g] - r) < 1e-12 for g, r in zip(model["index"].tolist(), model["ratio"]))
    weight = dict(zip(model["index"].tolist(), model["weight"].tolist()))
    want = [1 / (1 + math.exp(-(model["bias"] + sum(weight.get(g, 0.0) for g in _grams(t, toxicity.GRAMS, toxicity.BITS))))) for t in TEXTS]
    assert np.allclose(toxicity._scores(model)(pa.array(TEXTS)), want, atol=1e-9)


def test_language_features_and_decoding_are_naive():
    rows = np.concatenate([language.features(raw, off) for _, _, raw, off in chunks(pa.array(TEXTS))])
    for text, row in zip(TEXTS, rows):
        want, grams = np.zeros(1 << language.BITS), _grams(text, language.GRAMS, language.BITS)
        for g, n in grams.items():
            want[g] = math.sqrt(n / sum(grams.values()))
        assert np.allclose(row, want, atol=1e-6)
    r = np.random.default_rng(4)
    for k in (2, 4, 9):
        code = language.codewords(k)
        model = {"code": code, "trust": r.random(code.shape[1]) + 0.1}
        margins = r.standard_normal((6, code.shape[1])) * 3
        best, share, second = language.decode(margins, model)
        for i, f in enumerate(margins):
            loss = [sum(t * math.log1p(math.exp(-x * c)) for x, c, t in zip(f, word, model["trust"])) for word in code]
            odds = [math.exp(-v) for v in loss]
            ranked = sorted(odds, reverse=True)
            assert best[i] == int(np.argmin(loss)) and abs(share[i] - ranked[0] / sum(odds)) < 1e-9 and abs(second[i] - ranked[1] / sum(odds)) < 1e-9


def test_quality_attention_is_naive():
    texts = [f"{t} number {i}" * (1 + i % 9) for i in range(8) for t in TEXTS]
    y = np.array([i % 2 for i in range(len(texts))])
    model = quality.train([pa.array(texts)], [pa.array(y)], steps=5)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])
    got = next(iter(quality.scorer(model)([batch])))
    p = {k: v.astype(float) for k, v in model["p"].items()}
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    for i, text in enumerate(texts):
        bag = [text[a : a + quality.PASSAGE] for a in range(0, len(text), quality.PASSAGE)] or [""]
        x = np.concatenate([quality.passages(raw, off)[0] for _, _, raw, off in chunks(pa.array([text]))])
        assert len(x) == len(bag)
        codes, energy = [], []
        for row in (x - model["mean"]) / model["sd"]:
            z = np.tanh(row @ p["W"])
            codes.append(z)
            energy.append(float((np.tanh(z @ p["V"]) * sigmoid(z @ p["U"])) @ p["w"]))
        weights = [math.exp(e) / sum(math.exp(f) for f in energy) for e in energy]
        score = sigmoid(sum(a * z for a, z in zip(weights, codes)) @ p["c"] + p["b"][0])
        assert abs(got.column(1)[i].as_py() - score) < 1e-4
