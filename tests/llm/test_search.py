import numpy as np
import pyarrow as pa
import pytest

from chronolith.llm import neighbours
from chronolith.llm import sentencepiece_sampling as sp
from chronolith.llm.text_arrays import chunks

from .helpers import corpus, documents


def _vectors(n=1200, seed=0):
    r = np.random.default_rng(seed)
    centre = r.standard_normal((10, 24))
    x = (centre[r.integers(0, 10, n)] + r.standard_normal((n, 24))).astype(np.float32)
    x[100:160] = x[100]
    return x


def test_neighbours_recall_and_ties(spark):
    x = _vectors()
    rows = [(i, v.tolist(), 0.0, i) for i, v in enumerate(x)]
    rows += [(2000, None, 0.0, 0), (2001, [0.0] * 24, 0.0, 0), (2002, [1.0, None] + [0.0] * 22, 0.0, 0), (2003, [float("nan")] + [1.0] * 23, 0.0, 0), (2050, [1.0, 2.0], 0.0, 0), (None, x[0].tolist(), 0.0, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score double, rank long")
    got = neighbours.nearest(df, lambda c: c % 50 == 0, block_rows=400).orderBy("query_id", "rank").collect()
    u = x.astype(float)
    u /= np.sqrt((u * u).sum(1, keepdims=True))
    right = total = 0
    for q in range(0, 1200, 50):
        mine = [r for r in got if r.query_id == q]
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        s = u @ u[q]
        s[q] = -9
        best = np.lexsort((np.arange(len(s)), -np.round(s, 12)))[:5].tolist()
        right += len(set(best) & {r.vec_id for r in mine})
        total += 5
        assert all(abs(r.score - s[r.vec_id]) < 1e-9 for r in mine)
    assert right / total >= 0.9 and {r.query_id for r in got} == set(range(0, 1200, 50))
    assert [r.vec_id for r in got if r.query_id == 150] == [100, 101, 102, 103, 104]
    assert neighbours.nearest(df.limit(0), lambda c: c % 50 == 0).count() == 0


def _segmentations(voc, text):
    t = "▁" + text.replace(" ", "▁")
    import sentencepiece

    s = sentencepiece.SentencePieceProcessor(model_file=sp.MODEL)
    known = {s.id_to_piece(int(i)): (int(i), w) for i, w in zip(voc.ids, voc.weights)}
    out = []

    def go(i, ids, w):
        if i == len(t):
            out.append((tuple(ids), w))
            return
        for n in range(1, voc.longest + 1):
            if i + n <= len(t) and t[i : i + n] in known:
                a, b = known[t[i : i + n]]
                go(i + n, [*ids, a], w + b)
        if t[i] not in known:
            b = t[i].encode()
            go(i + 1, ids + [int(voc.bytes_of[x]) for x in b], w + voc.byte_weight * len(b))

    go(0, [], 0.0)
    return out


def test_samples_follow_the_distribution_without_replacement():
    voc, text, n = sp.vocabulary(sp.MODEL), "an  ing é\n☃o", 6000
    all_ = _segmentations(voc, text)
    w = np.array([x for _, x in all_])
    p = np.exp(w - w.max())
    share = {s: x for (s, _), x in zip(all_, p / p.sum())}
    raw = np.frombuffer(text.encode() * n, np.uint8)
    off = np.arange(n + 1) * len(text.encode())
    per, weight = [[None] * n for _ in range(3)], {}
    for _, rank, ids, bounds, log_prob, inclusion, exact in sp.sample_chunk(sp.Lattice(voc), raw, off, np.arange(n), 3, 1):
        assert exact.all()
        for d in range(n):
            s = tuple(ids[bounds[d] : bounds[d + 1]].tolist())
            per[rank][d] = s
            assert abs(np.log(share[s]) - log_prob[d]) < 1e-8
            weight[s] = weight.get(s, 0) + 1 / inclusion[d] / n
    assert all(len({per[r][d] for r in range(3)}) == 3 for d in range(n))
    top = sorted(share, key=share.get)[::-1][:3]
    for t in top:
        assert abs(sum(x == t for x in per[0]) / n - share[t]) < 0.02
        second = sum(share[s] * share[t] / (1 - share[s]) for s in share if s != t)
        assert abs(sum(x == t for x in per[1]) / n - second) < 0.03
    assert abs(weight[top[0]] - 1) < 0.05 and abs(weight[top[1]] - 1) < 0.1  # an inclusion-weighted count of one segmentation is one


def test_long_units_and_scratch_room(monkeypatch):
    voc = sp.vocabulary(sp.MODEL)
    text = ("x" * 400 + "ingthe" * 60 + " ab").encode()
    raw, off = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    found = []
    for long_, most in ((150, 10_000), (10**9, 10_000), (150, 10)):
        monkeypatch.setattr(sp, "LONG", long_)
        lat = sp.Lattice(voc, most)
        sp.sample_chunk(lat, raw[:200], np.array([0, 200]), np.arange(1), 1, 1)
        got = sp.sample_chunk(lat, raw, off, np.arange(1), 2, 1)
        found.append([(r, ids.tolist(), round(float(lp[0]), 6)) for _, r, ids, _, lp, *_ in got])
    assert found[0] == found[1] == found[2]


@pytest.mark.parametrize("text", ["x" * 40, "zqxjkv"])
def test_draws_that_round_to_one_stay_on_edges(text):
    """Of 2 ** 25 draws one is 1 in single precision; this row's first draw is, and no piece is as long as the unit."""

    def unmix(h):
        for factor in (0xC4CEB9FE1A85EC53, 0xFF51AFD7ED558CCD):
            h = (h ^ h >> 33) * pow(factor, -1, 1 << 64) % (1 << 64)
        return h ^ h >> 33

    seed, key = 1, unmix(unmix((1 << 64) - 1)) - 2 * 0x9E3779B97F4A7C15
    key = np.array([(unmix(key % (1 << 64)) - seed) % (1 << 64)], np.uint64).view(np.int64)
    raw, off = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)])
    assert np.float32(sp._uniform(unmix((1 << 64) - 1) * np.ones(1, np.uint64))[0]) == 1
    got = sp.sample_chunk(sp.lattice(sp.MODEL), raw, off, key, 2, seed)
    share = dict((tuple(s), w) for s, w in _segmentations(sp.vocabulary(sp.MODEL), text)) if len(text) < 10 else {}
    assert len(got) == 2
    for _, _, ids, _, log_prob, _, exact in got:
        assert exact.all() and np.isfinite(log_prob).all()
        if share:
            assert abs(share[tuple(ids.tolist())] - np.logaddexp.reduce(list(share.values())) - log_prob[0]) < 1e-8


def test_sampling_table(spark):
    texts = corpus(n=20) + ["▁ marked", "tab\tnew\nline  two", "日本語 mixed"]
    docs = documents(spark, texts)
    rows = sp.sample_segmentations(docs, k=3).collect()
    again = {(r.doc_id, r.sample): r.ids for r in sp.sample_segmentations(docs.repartition(5), k=3).collect()}
    assert {(r.doc_id, r.sample): r.ids for r in rows} == again
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == set(range(len(texts)))
    marked = len(texts) - 3
    for d, rs in by.items():
        assert len({tuple(r.ids) for r in rs}) == len(rs) and all(r.exact == (d != marked) for r in rs)
        assert all(0 < r.inclusion <= 1 + 1e-12 for r in rs)
        if not texts[d]:
            assert [(r.ids, r.log_prob, r.inclusion) for r in rs] == [([], 0, 1)]
    back = sp.decode(sp.sample_segmentations(docs, k=1)).collect()
    assert all(r.text == (texts[r.doc_id] or "").replace("▁", " ") for r in back)
    own = sp.decode(sp.encode(docs)).collect()
    assert all(r.text == (texts[r.doc_id] or "").replace("▁", " ") for r in own)
    assert sp.sample_segmentations(docs.limit(0)).count() == 0


@pytest.mark.parametrize("texts", [["a", None, "b c"], [None], [""]])
def test_chunks_cover_all_rows(texts):
    got = [(a, b) for a, b, _, _ in chunks(pa.array(texts, pa.string()), 2)]
    assert got[0][0] == 0 and got[-1][1] == len(texts) and all(x[1] == y[0] for x, y in zip(got, got[1:]))


def test_units_with_one_hash_are_told_apart():
    """Thue-Morse words, and hashes of three bits: a unit's lattice is never another's."""
    lat = sp.lattice(sp.MODEL)
    one = "".join("a⁡"[i.bit_count() & 1] for i in range(1024))
    texts = [one, one.translate({0x61: 0x2061, 0x2061: 0x61}), *[f"word{i} next{i % 7}" for i in range(50)], "word1 next1"]
    few = sp.Lattice(lat.voc)
    place = few.place
    few.place = lambda h, cp, begin, end: place(h & np.uint64(7), cp, begin, end)
    for _ in range(2):
        for _, _, raw, off in chunks(pa.array(texts)):
            for a, b in zip(sp.sample_chunk(few, raw, off, np.arange(len(texts)), 2, 1), sp.sample_chunk(lat, raw, off, np.arange(len(texts)), 2, 1)):
                assert a[6].all() and b[6].all() and (a[2] == b[2]).all() and np.allclose(a[4], b[4])


def test_neighbours_of_repeated_ids(spark):
    """Repeated ids as queries and as candidates: one list for each query id, its own rows left out."""
    a, b, c, d = [1.0, 0.0], [0.8, 0.6], [0.0, 1.0], [-1.0, 0.2]
    rows = [(50, a)] * 7 + [(51, a), (52, b), (100, c), (100, d), (100, c), (53, d), (53, d)] + [(60, b)] * 9 + [(None, a), (150, None)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda x: x % 50 == 0, block_rows=2)
    by = {}
    for r in got.orderBy("query_id", "rank").collect():
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, round(r.score, 9)))
    cos = lambda x, y: sum(i * j for i, j in zip(x, y)) / (sum(i * i for i in x) * sum(i * i for i in y)) ** 0.5
    want = {}
    for q in (50, 100):
        mine = [v for i, v in rows if i == q]
        near = sorted((-max(cos(v, m) for m in mine), i) for i, v in rows if i is not None and v and i != q)[:5]
        want[q] = [(n + 1, i, round(-s, 9)) for n, (s, i) in enumerate(near)]
    assert by == want
