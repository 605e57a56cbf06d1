"""Very many short texts, and long ones that are worked off in parts."""

import random
import resource

import numpy as np
import pyarrow as pa
import pytest

from chronolith.llm import language, quality, text_arrays, toxicity

from .helpers import corpus


def _model(kind):
    texts = [x or "" for x in corpus(n=40, seed=2)]
    if kind is language:
        return kind.train([pa.array(texts)], [pa.array(["en" if i % 2 else "de" for i in range(len(texts))])])
    return kind.train([pa.array(texts)], [pa.array([i % 2 for i in range(len(texts))])])


def _run(kind, model, texts):
    column = pa.array(texts, pa.string())
    ids = pa.array(range(len(texts)))
    if kind is language:
        batch, run = pa.RecordBatch.from_arrays([ids, column, pa.array([bool(t) for t in texts])], ["id", "text", "lettered"]), kind.predictor(model, 0.2)
    else:
        batch, run = pa.RecordBatch.from_arrays([ids, column], ["id", "text"]), kind.scorer(model)
    return pa.Table.from_batches(list(run(iter([batch])))).to_pylist()


@pytest.mark.parametrize("kind", [language, quality, toxicity])
def test_parts_give_what_the_whole_gives(kind, monkeypatch):
    r = random.Random(3)
    texts = ["".join(r.choice("aé日 b.\nc1\U0001f600") for _ in range(n)) for n in (3000, 2401, 2400, 4003, 9)]
    model = _model(kind)
    want = _run(kind, model, texts)
    for size in (500, 900):
        with monkeypatch.context() as m:
            m.setattr(text_arrays, "CHUNK_BYTES", size)
            m.setattr(text_arrays.parts, "__defaults__", (1, max(size, 2000)))
            m.setattr(text_arrays.chunks, "__defaults__", (size, 4))
            got = _run(kind, model, texts)
        for a, b in zip(want, got):
            assert abs(a["score"] - b["score"]) < 1e-5 and a | {"score": 0} == b | {"score": 0}


@pytest.mark.parametrize("kind", [language, quality, toxicity])
def test_memory_follows_neither_rows_nor_lengths(kind):
    """10,000 texts without a word, 10,000 of eight bytes and one of 20 MB in one batch: less than 900 MB more than before."""
    model = _model(kind)
    _run(kind, model, ["warm"])
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    texts = [None] * 5000 + [""] * 5000 + ["ab cd ef"] * 10_000 + ["some words in a long text, " * 750_000]
    out = _run(kind, model, texts)
    assert len(out) == len(texts) and all(np.isfinite(x["score"]) for x in out)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 900 << 10
