import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.llm import language, quality, toxicity

from .helpers import documents


def _say(r, words, k):
    return " ".join(r.choice(words) for _ in range(k))


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(1)
    words = [f"{a}{b}{c}" for a in ("ba", "re", "to", "li") for b in ("n", "sh", "v") for c in ("er", "ing", "al")]
    texts, labels = [], []
    for i in range(400):
        t, toxic, good = _say(r, words, r.choice([8, 40, 300])), i % 8 == 0, i % 3 != 0
        if toxic:
            t += f" zqurk{r.choice(['s', 'ed', 'isch'])} " + _say(r, words, 5)
        if not good:
            t = t.replace(" ", "%%% ") if i % 2 else t.upper().replace(" ", "!! ")
        texts.append(t)
        labels.append((i, int(good), int(toxic)))
    return documents(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_held_out(labelled):
    docs, labels = labelled
    model = toxicity.fit_toxicity(docs, labels, train_rows=lambda k: toxicity.bucket(k, 4) != 2)
    out = toxicity.score_toxicity(docs, model).join(labels, "doc_id").where(toxicity.bucket(F.col("doc_id").cast("string"), 4) == 2)
    right = out.select(F.avg((F.col("predicted") == F.col("toxic")).cast("int"))).first()[0]
    assert right > 0.97
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and 300 < kept.count() < 400


def test_quality_held_out(labelled):
    docs, labels = labelled
    model = quality.fit_quality(docs, labels, train_rows=lambda k: toxicity.bucket(k, 5) != 0)
    out = quality.score_quality(docs, model).join(labels, "doc_id").where(toxicity.bucket(F.col("doc_id").cast("string"), 5) == 0)
    assert out.select(F.avg(((F.col("score") >= 0.5).cast("int") == F.col("quality")).cast("int"))).first()[0] > 0.95


def test_attention_is_learned():
    """Training goes down the loss."""
    import pyarrow as pa

    texts = pa.array([_say(random.Random(i), ["ab", "cd", "EF!"], 300) if i % 2 else "x" * 900 for i in range(20)])
    y = pa.array([i % 2 for i in range(20)])
    short, longer = (quality.train([texts], [y], steps=n) for n in (1, 80))

    def loss(m):
        from chronolith.llm.text_arrays import chunks

        _, _, raw, off = next(iter(chunks(texts)))
        x, of = quality.passages(raw, off)
        *_, out = quality._forward((x - m["mean"]) / m["sd"], np.searchsorted(of, np.arange(20)), of, m["p"])
        return np.logaddexp(0, -out * (2 * y.to_numpy() - 1)).mean()

    assert loss(longer) < 0.1 < loss(short)


def test_language(spark):
    r = random.Random(3)
    sounds = {"aa": ["kalo", "mira", "tuna"], "bb": ["zwsch", "krtz", "strpf"], "cc": ["élan", "où", "çava"], "dd": ["öl", "über", "straße"], "ee": ["niño", "año", "señal"], "ff": ["xiq", "qox", "xaxa"]}
    langs = [list(sounds)[i % 6] for i in range(300)]
    docs = documents(spark, [_say(r, sounds[x], r.choice([2, 20])) for x in langs]).drop("lang")
    docs = docs.withColumn("lang", F.element_at(F.array(*[F.lit(x) for x in sounds]), (F.col("doc_id") % 6 + 1).cast("int")))
    model = language.fit_language(docs, train_rows=lambda k: toxicity.bucket(k, 3) != 1)
    out = language.identify_language(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(toxicity.bucket(F.col("doc_id").cast("string"), 3) == 1)
    assert out.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    odd = {r.doc_id: r for r in language.identify_language(documents(spark, [None, "", "123 !?", "kalo"]), model).collect()}
    assert [odd[i].lang_pred for i in range(3)] == ["und"] * 3 and odd[3].lang_pred == "aa" and odd[0].score == 0 and odd[0].ambiguous
    none = language.fit_language(docs.where("doc_id < 0"))
    assert {r.lang_pred for r in language.identify_language(documents(spark, ["kalo"]), none).collect()} == {"und"}


@pytest.mark.parametrize("k", [1, 2, 4, 5, 9])
def test_codewords_are_apart(k):
    code = language.codewords(k)
    assert len({tuple(r) for r in code.tolist()}) == k


@pytest.mark.parametrize("fit,score", [(toxicity.fit_toxicity, toxicity.score_toxicity), (quality.fit_quality, quality.score_quality)])
def test_degenerate_inputs(spark, labelled, fit, score):
    docs, labels = labelled
    model = fit(docs, labels)
    odd = documents(spark, [None, "", "x", "y " * 50_000, "dup", "dup"], [1, 2, None, 4, 5, 5])
    got = score(odd, model).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 5}) == 1
    assert score(odd.limit(0), model).count() == 0
    name = "toxic" if fit is toxicity.fit_toxicity else "quality"
    one = fit(docs, labels.where(F.col(name) == 1).withColumn("text", F.lit("clash")))
    assert all(r.score > 0.99 for r in score(odd, one).collect())
    none = fit(docs, labels.limit(0))
    assert all(r.score < 0.01 for r in score(odd, none).collect())
