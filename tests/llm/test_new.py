"""Whitening, line dedup and token alignment against brute-force versions on small fixtures."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.llm import line_dedup, token_alignment, whitening

from .helpers import corpus, documents

LINES = "doc_id long, text string, id long, key string, line string, pos int, h1 long, _gone string"


def _lines(items, least=line_dedup.MIN_LENGTH, docs=line_dedup.MIN_DOCS):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    key = lambda x: x.strip(line_dedup.BLANK).translate(low)
    holders, out = {}, []
    for i, t in items:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least and i is not None:
                holders.setdefault(key(x), set()).add(i)
    for i, t in items:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < docs or max(holders[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest(), "\n".join(kept)))
    return out


def _line_items():
    a, b = "A line of forty code points and a few more", "ä" * 40
    items = [(i, f"{a}\n own {i}\n{b if i % 2 else a.upper()} \t\n{a}") for i in range(12)]
    items += [(12, None), (13, ""), (14, "\n\n"), (15, "x" * 39 + "\n" + "é" * 39), (16, f"{a}\r\n{a}\x0b"), (3, f"{b}\nsecond text of an id"), (3, f"{b}\nsecond text of an id"), (3, items[3][1]), (None, f"{a}\nnone"), (None, f"{a}\nnone"), (None, "other")]
    items += [(20 + i, "\n".join(["x" * 39, "y" * 40, f"{a}{i % 3}"] * 3)) for i in range(9)] + [(-5, "\n".join(f"{a} {k}" for k in range(5000)))] + [(-6 - i, f"{a} {i}\n{a} 4999") for i in range(6)]
    return items


@pytest.mark.parametrize("heavy", [line_dedup.HEAVY, 2])
def test_lines_are_brute_force(spark, heavy):
    items = _line_items()
    frame = spark.createDataFrame([(i, t, 1, "k", "l", 2, 3, "g") for i, t in items], LINES)
    want = _lines(items)
    got = sorted(tuple(r) for r in line_dedup.line_report(frame, heavy=heavy).collect() if r.doc_id is not None)
    assert got == sorted(w[:4] for w in want if w[0] is not None)
    nameless = Counter(tuple(r)[1:] for r in line_dedup.line_report(frame, heavy=heavy).collect() if r.doc_id is None)
    assert nameless == Counter(w[1:4] for w in want if w[0] is None)
    kept = line_dedup.drop_lines(frame, heavy=heavy)
    assert kept.columns == frame.columns
    assert Counter((r.doc_id, r.text or "") for r in kept.collect()) == Counter((w[0], w[4]) for w in want)
    assert kept.where("doc_id = 12 and text is null and _gone = 'g'").count() == 1
    assert line_dedup.line_report(frame.limit(0)).count() == 0


def test_lines_of_one_long_text(spark):
    """Time follows the number of lines, not its square."""
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(200_000)), lambda k: F.concat(F.lit("a line of a very long text, of which many are alike "), (k % 50000).cast("string"))), "\n")
    rows = line_dedup.line_report(spark.range(5).select(F.col("id").alias("doc_id"), text.alias("text")), heavy=2).orderBy("doc_id").collect()
    assert [(r.n_lines, r.n_dropped) for r in rows] == [(200_000, 200_000)] * 4 + [(200_000, 0)]


def _vectors(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, "x", 7, 0.5) for i, v in rows], f"vec_id long, embedding array<{kind}>, n string, component int, whitened double")


def _whitened(x, k):
    fit = np.unique(x, axis=0)
    c = fit - fit.mean(0)
    e, u = np.linalg.eigh(c.T @ c / len(fit))
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return len(fit), (x - fit.mean(0)) @ u / np.sqrt(e), e / np.trace(c.T @ c / len(fit)), [sum((len(fit) * int(a) - int(s)) ** 2 for a, s in zip(row, fit.sum(0))) for row in x]


@pytest.mark.parametrize("dim,decay", [(64, 1.0), (96, 0.7), (5, 0.9)])
def test_whitening_is_brute_force(spark, dim, decay):
    r = np.random.default_rng(dim)
    v = (r.standard_normal((700, dim)) * 3 * decay ** np.arange(dim)).astype(np.float32)
    v[600:] = v[:100]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(1000, None), (1001, [float("nan")] * dim), (1002, [float("inf")] + [0.0] * (dim - 1)), (1003, []), (1004, [None] + [0.0] * (dim - 1))]
    frame = _vectors(spark, rows)
    got = whitening.whitened_components(frame).toPandas()
    k = min(16, dim)
    n, w, share, deviation = _whitened(np.floor(64 * v.astype(float)) + 1_000_000, k)
    table = got.pivot(index="vec_id", columns="component", values="whitened").loc[range(700)].to_numpy()
    assert len(got) == 700 * k and set(got.n) == {n} and got.identity_error.max() < 1e-9 and got.identity_error.nunique() == 1
    sign = np.sign((table * w).sum(0))
    assert np.abs(table * sign - w).max() < 1e-7
    assert np.allclose(got[got.vec_id == 0].sort_values("component").explained, share, rtol=1e-9)
    assert got.drop_duplicates("vec_id").sort_values("vec_id").deviation.tolist() == deviation


def test_whitening_stops_early_or_expands(spark):
    """A falling spectrum is found in the range, a flat one only in the full dimension."""
    r = np.random.default_rng(1)
    for scale, full in ((0.5 ** np.arange(80) * 1e5, False), (np.ones(80), True)):
        v = r.standard_normal((900, 80)) * scale
        rows = _vectors(spark, [(i, x.tolist()) for i, x in enumerate(v)], "double")
        model = whitening.fit_whitening(rows, 80, components=8, oversample=8)
        assert model["full"] == full and model["identity_error"] < 1e-9
        x = np.floor(64 * v)
        e = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1][:8]
        assert np.allclose(model["values"], e, rtol=1e-9)


def test_whitening_edges(spark):
    assert whitening.whitened_components(_vectors(spark, []).limit(0)).count() == 0
    assert whitening.whitened_components(_vectors(spark, [(1, [0.5, 1.0]), (2, [0.5, 1.0])])).count() == 0  # one vector has no variance
    # Two lengths, repeated and missing ids, one component without variance, and sums beyond a long.
    rows = [(1, [0.0, 5.0]), (1, [1.0, 5.0]), (None, [1.0, 5.0]), (4, [3.0]), (5, [9.0])]
    got = whitening.whitened_components(_vectors(spark, rows)).collect()
    assert sorted((r.vec_id or 0, r.component, r.n) for r in got) == [(0, 1, 2), (1, 1, 2), (1, 1, 2), (4, 1, 2), (5, 1, 2)]
    assert all(abs(abs(r.whitened) - 1) < 1e-12 for r in got)
    big = whitening.whitened_components(_vectors(spark, [(1, [0.0]), (2, [1e30]), (3, [-1e17])], "double")).collect()
    assert sorted((r.vec_id, r.deviation) for r in big) == [(1, 0), (2, None), (3, None)]
    x = np.array([[1, -3], [200, 4], [40_000, 5], [-(2**40), 6], [127, -128]])
    import pyarrow as pa

    assert (whitening.unpack(pa.array(whitening.pack(x), pa.binary()), 2) == x).all()


def _tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{token_alignment.FOLDER}/{token_alignment.A_FILE}")
    t.encode_special_tokens = True
    return t


def test_vocabulary_is_merged_by_rank():
    """Each merge is what lower ranks leave of its token; the pre-tokens are the same for all characters."""
    import json

    path = f"{token_alignment.FOLDER}/{token_alignment.A_FILE}"
    pair = token_alignment.Pair(path, f"{token_alignment.FOLDER}/{token_alignment.B_FILE}")
    model = json.load(open(path, encoding="utf-8"))["model"]
    letters = token_alignment._byte_letters()
    rank = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if t != "<|endoftext|>"}
    for merge in model["merges"]:
        x, y = (bytes(letters[c] for c in t) for t in (merge.split(" ") if isinstance(merge, str) else merge))
        parts, top = [bytes([c]) for c in x + y], rank[x + y]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: rank.get(parts[i] + parts[i + 1], top))
            if rank.get(parts[best] + parts[best + 1], top) >= top:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        assert parts == [x, y]
    text = "".join(f"a{chr(c)} b {chr(c)}1{chr(c)}{chr(c)}" for c in range(0x3100) if not 0xD800 <= c < 0xE000)
    assert pair.a.encode_ordinary(text) == _tokenizer().encode(text, add_special_tokens=False).ids


def _alignment(pair, items):
    """By walking along both rows of tokens, text by text; A's ids are the tokenizer file's own."""
    reference = _tokenizer()
    out, counts = [], Counter()
    token = lambda v, i: v.bytes[v.start[i] : v.start[i] + v.size[i]].tobytes()
    for i, t in items:
        a = reference.encode(" " + t, add_special_tokens=False).ids if t else []
        b = pair.b.encode(t) if t else []
        la, lb = [token(pair.va, x) for x in a], [token(pair.vb, x) for x in b]
        if not t or b"".join(la) != (" " + t).encode() or b"".join(lb) != (" " + t).encode():
            out.append((i, [], [], [], []))
            continue
        spans = lambda rows: [(sum(map(len, rows[:0])) + e - len(r), e) for r, e in zip(rows, np.cumsum([len(r) for r in rows]).tolist())]
        sa, sb = spans(la), spans(lb)
        links, j0 = [], 0
        for x, (p, q) in enumerate(sa):
            while sb[j0][1] <= p:
                j0 += 1
            j = j0
            while j < len(sb) and sb[j][0] < q:
                links.append((a[x], b[j]))
                j += 1
        shared = sorted({e for _, e in sa} & {e for _, e in sb})
        groups = [([x for x, (p, q) in zip(a, sa) if s < q <= e], [y for y, (p, q) in zip(b, sb) if s < q <= e]) for s, e in zip([0, *shared], shared)]
        counts.update(links)
        out.append((i, a, b, links, groups))
    best = Counter()
    for (_, y), c in counts.items():
        best[y] = max(best[y], c)
    said = lambda groups: ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
    return [(i, len(a), len(b), len(g), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(said(g).encode()).hexdigest() if a else "") for i, a, b, links, g in out], {i: g for i, _, _, _, g in out}, counts


def _texts():
    odd = ["a  b   c", " lead and trail ", "\n\nx\t y\r\n z ", "tab\t end", "x  y   z", "Grüße über Straßen é à", "汉字 文字 混合text 中 文", "😀 smile 👩‍👩‍👧 x", "<|endoftext|> <s> </s> <unk> it's we'll 've", "▁ marked ▁word", "nul \x00 byte \x1c \x1f z", "é combining ̈ x", "https://example.org/a?b=c  1,234.50 --- ***", "don't 's  's", "abc᠎ d​ e﻿ f", "\x85 next   line", "i" * 3000, "no_blank_" * 200, "word " * 500, " ", "   ", "аб вг 中 ߿ x ࠀ y"]
    return [*corpus(n=25, seed=5), *odd, "the same text", "the same text", None]


@pytest.mark.parametrize("most", [token_alignment.MOST, 100])
def test_alignment_is_brute_force(spark, most):
    pair = token_alignment.Pair(f"{token_alignment.FOLDER}/{token_alignment.A_FILE}", f"{token_alignment.FOLDER}/{token_alignment.B_FILE}")
    texts = _texts()
    want, groups, counts = _alignment(pair, list(enumerate(texts)))
    frame = documents(spark, texts).withColumnRenamed("key", "n_a").withColumnRenamed("score", "row")
    got = sorted(tuple(r) for r in token_alignment.alignment_report(frame, most=most).collect())
    assert got == want and sum(w[1] == 0 for w in want) >= 3
    if most == 100:
        return
    assert {(r.a, r.b): r.links for r in token_alignment.pair_counts(frame).collect()} == counts
    aligned = token_alignment.align_tokens(frame)
    assert {r.doc_id: [(g.a, g.b) for g in r.groups] for r in aligned.collect()} == groups
    products = token_alignment.group_products(aligned).where("doc_id = 0").count()
    assert products == sum(len(a) * len(b) for a, b in groups[0])
    repeated = documents(spark, [texts[0], texts[1], texts[0]], [1, 1, None])
    assert sorted(r.n_a for r in token_alignment.alignment_report(repeated).collect()) == sorted(want[i][1] for i in (0, 1, 0))
    assert token_alignment.alignment_report(frame.limit(0)).count() == 0


def test_alignment_forgets_segments(spark, monkeypatch):
    """A task that remembers few segments gives the same rows."""
    pair = token_alignment.Pair(f"{token_alignment.FOLDER}/{token_alignment.A_FILE}", f"{token_alignment.FOLDER}/{token_alignment.B_FILE}")
    import pyarrow as pa

    column = pa.array(_texts())
    monkeypatch.setattr(token_alignment, "chunks", lambda c: __import__("chronolith.llm.text_arrays", fromlist=["chunks"]).chunks(c, 500))
    out = []
    for limit in (1 << 17, 10):
        monkeypatch.setattr(token_alignment, "REMEMBERED", limit)
        known, rows = token_alignment.Known(pair, groups=True), []
        for row, end, numbers, first in token_alignment.segmented(column, known):
            rows += [b";".join(known.groups[i] for i in numbers[x:y]) for x, y in zip(first, first[1:])]
            if known.full():
                known.forget()
        out.append(rows)
    assert out[0] == out[1] and len(out[0]) == len(column)
