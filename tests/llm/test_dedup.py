import dataclasses
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from chronolith.llm import anchored, components, simhash, substring_dedup, suffix_dedup

from .helpers import corpus, documents, linked_components, removed_bytes, removed_words


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_dedup_is_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(anchored, "BATCH_BYTES", 4000)
    texts = corpus(seed=seed)
    ids = list(range(len(texts)))
    random.Random(seed).shuffle(ids)
    got = suffix_dedup.repeated_bytes(documents(spark, texts, ids)).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == removed_bytes(sorted(zip(ids, texts)))


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup_is_brute_force(spark, seed):
    texts = corpus(seed=seed)
    ids = list(range(len(texts)))
    random.Random(seed).shuffle(ids)
    got = substring_dedup.repeated_words(documents(spark, texts, ids)).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == removed_words(sorted(zip(ids, texts)))


@pytest.mark.parametrize("rows, batch", [(0, 1 << 19), (0, 300), (3, 4000)])
def test_hot_anchors_are_brute_force(spark, rows, batch, monkeypatch):
    """Anchors with more than so many candidates are split by windows; Arrow batches of few rows cut the groups."""
    monkeypatch.setattr(anchored, "HOT_ROWS", rows)
    monkeypatch.setattr(anchored, "WINDOWS_AT_ONCE", 97)
    monkeypatch.setattr(anchored, "BATCH_BYTES", batch)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        texts = corpus(n=40, seed=8, long=600)
        ids = list(range(len(texts)))
        random.Random(8).shuffle(ids)
        docs = documents(spark, texts, ids)
        got = suffix_dedup.repeated_bytes(docs).orderBy("doc_id").collect()
        assert [tuple(r) for r in got] == removed_bytes(sorted(zip(ids, texts)))
        got = substring_dedup.repeated_words(docs).orderBy("doc_id").collect()
        assert [tuple(r) for r in got] == removed_words(sorted(zip(ids, texts)))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def _in_steps(items, method, finish, rows):
    """The steps of ``anchored.repeated`` in this process, in batches of so many rows: (result, contents, segments)."""

    def step(run, table, by=()):
        out = pa.Table.from_batches(list(run(table.combine_chunks().to_batches(rows))))
        return out.sort_by([(c, "ascending") for c in by]) if by else out

    def gathered(marks, schema, whole):
        by = {}
        for m in marks.to_pylist():
            by.setdefault(m.pop("key"), []).append(m)
        some = [(k, t) for k, t in items if whole or k in by]
        return pa.table({"key": pa.array([k for k, _ in some], pa.int64()), "text": pa.array([t for _, t in some], pa.string()), "marks": pa.array([by.get(k) for k, _ in some], pa.list_(pa.struct(schema)))})

    documents = pa.table({"key": pa.array([k for k, _ in items], pa.int64()), "text": pa.array([t for _, t in items], pa.string())})
    met = step(anchored._meet(method), step(anchored._segments(method), documents, ("anchor", "content", "content2", "key", "start")))
    wanted = gathered(met, [("start", pa.int64()), ("n", pa.int32()), ("whole", pa.bool_()), ("anchor", pa.int64()), ("hot", pa.bool_())], False)
    contents = step(anchored._payloads(method), wanted, ("anchor", "key", "start"))
    found = step(anchored._verify(method), contents)
    out = step(finish, gathered(found, [("start", pa.int64()), ("n", pa.int32()), ("bits", pa.binary())], True))
    return sorted(tuple(r.values()) for r in out.to_pylist()), contents, met


@pytest.mark.parametrize("rows, bits", [(7, 64), (7, 1), (10_000, 64), (10_000, 0)])
def test_hot_anchors_are_compared_without_all_their_windows(rows, bits, monkeypatch):
    """Windows of hot anchors go on in buckets and don't reach the transform; cores whose names (of so many bits) agree are told apart."""
    monkeypatch.setattr(anchored, "HOT_ROWS", 0)
    monkeypatch.setattr(anchored, "BATCH_BYTES", 3000)
    name = xxhash.xxh3_64_intdigest
    monkeypatch.setattr(suffix_dedup, "xxh3_64_intdigest", lambda b: name(b) & ((1 << bits) - 1))
    r = random.Random(9)
    say = lambda k: "".join(r.choice("abcdefgh é") for _ in range(k))
    shared = say(150)
    texts = [say(r.randrange(40)) + shared + say(r.randrange(140)) for _ in range(60)] + [shared[20:130] * 2, "ha ho " * 80, "x" * 400, "x" * 300, "ab" * 160 + shared]
    ids = list(range(len(texts)))
    r.shuffle(ids)
    items = sorted(zip(ids, texts))
    method, compared = suffix_dedup.method(), []
    counts = lambda *a: compared.append(len(a[1])) or method.verify(*a)
    got, contents, met = _in_steps(items, dataclasses.replace(method, verify=counts), suffix_dedup._finish(100, False), rows)
    assert got == removed_bytes(items)
    hot = met.filter(met["hot"])
    size = sum(len(x) for x in contents["content"].to_pylist() if x)
    assert hot.num_rows > 100 and size < 40 * sum(hot["n"].to_pylist())  # a window has 100
    assert compared == [] or bits < 64


def thue_morse(n, letters):
    word = "".join(letters[i.bit_count() & 1] for i in range(n))
    return word, word.translate(str.maketrans(letters, letters[::-1]))


@pytest.mark.parametrize("n", [512, 1024, 4096])
def test_words_that_polynomial_hashes_confuse(spark, n):
    """Two documents that differ in a Thue-Morse word and its complement, as one word, as a text, and as words."""
    rest = " ".join(f"word{i}" for i in range(49))
    texts = []
    for letters in ("<_", "ab"):
        one, other = thue_morse(n, letters)
        texts += [f"{one} {rest}", f"{other} {rest}", one, other, " ".join(one[:400]), " ".join(other[:400])]
    docs = documents(spark, texts)
    got = suffix_dedup.repeated_bytes(docs).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == removed_bytes(list(enumerate(texts)))
    got = substring_dedup.repeated_words(docs).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == removed_words(list(enumerate(texts)))


def test_long_runs_and_long_texts_are_brute_force(spark, monkeypatch):
    """Runs of one word and of two, inside of which no boundary can be seen, and texts that come in parts."""
    r = random.Random(6)
    say = lambda k: " ".join(f"w{r.randrange(50)}" for _ in range(k))
    shared, texts = say(120), []
    for k in (45, 49, 50, 60, 130):
        texts += [f"{say(9)} {'ha ' * k}{say(7)}", f"{say(30)} {'ha ho ' * k}{say(40)}", f"{say(22)} {'ha ha ha ' * 12}{shared}", "ha " * k + shared, shared + " ho" * k]
    texts += [say(900) + " " + shared + " " + say(700), say(300) + " " + texts[4] + " " + "x" * 700 + " " + shared]
    want = removed_bytes(list(enumerate(texts))), removed_words(list(enumerate(texts)))
    for size in (1 << 19, 700):
        monkeypatch.setattr(anchored, "CHUNK_BYTES", size)
        monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", size)
        monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", size)
        docs = documents(spark, texts)
        assert [tuple(x) for x in suffix_dedup.repeated_bytes(docs).orderBy("doc_id").collect()] == want[0]
        assert [tuple(x) for x in substring_dedup.repeated_words(docs).orderBy("doc_id").collect()] == want[1]


def test_names_that_mean_two_things_are_named_anew(spark):
    docs = documents(spark, corpus(n=20, seed=4, long=300))
    assert substring_dedup.name_rounds(docs.select("text")) == (0, 0, 0, 0)

    def few(salts):  # eight names with the first salts
        def run(batches):
            for b in substring_dedup._proposals(salts)(batches):
                yield b if salts[0] else b.set_column(0, "name", pa.array(b.column(0).to_numpy() & 7))

        return run

    assert substring_dedup.name_rounds(docs.select("text"), propose=few) == (1, 1, 1, 1)


def test_anchors_are_counted_over_batches():
    anchors = [1, 1, 2, 2, 2, 2, 2, 3, 4, 4, 4, 5, 5, 5, 5]
    for width in (1, 2, 4, 20):
        counted, got = anchored._Counted(3), []
        for i in range(0, len(anchors), width):
            a = np.array(anchors[i : i + width])
            got.append(counted.push([(a, a, a, a)]))
        got.append(counted.push([], end=True))
        assert [int(x) for g in got for x in g[3]] == anchors
        assert [bool(x) for g in got for x in g[4]] == [x in (2, 5) for x in anchors]


def test_common_prefix_classes_are_the_prefixes():
    r = np.random.default_rng(0)
    text = r.integers(97, 99, 600).astype(np.uint8)
    text = np.concatenate((text, text[100:300], [0xFF])).astype(np.uint8)
    for length in (1, 3, 9, 40):
        sa, classes = suffix_dedup.common_prefix_classes(text, length)
        by = {}
        for s, c in zip(sa.tolist(), classes.tolist()):
            if s + length <= len(text):
                by.setdefault(c, set()).add(text[s : s + length].tobytes())
        assert all(len(x) == 1 for x in by.values())
        assert len({next(iter(x)) for x in by.values()}) == len(by)


def test_equal_runs_get_equal_inner_symbols():
    r = np.random.default_rng(1)
    inner = r.integers(0, 5, 50).astype(np.uint64)
    names = []
    for _ in range(2):
        x = np.concatenate((r.integers(0, 5, 40), inner, r.integers(0, 5, 40))).astype(np.uint64)
        s, begin = substring_dedup.recompress(x, np.zeros(len(x), np.int64))
        inside = (begin >= 48) & (begin <= 82)
        names.append((s[inside][:-1], begin[inside]))
    assert (names[0][1] == names[1][1]).all() and (names[0][0] == names[1][0]).all()


def test_dedup_keeps_columns_and_repeated_ids(spark):
    long = "the quick brown fox jumps over it " * 5
    docs = documents(spark, [long, long, "short", None], [1, 1, None, 2])
    out = suffix_dedup.without_repeats(docs)
    assert out.columns == docs.columns
    got = sorted(out.select("doc_id", "text", "key").collect(), key=str)
    assert len(got) == 4 and all(r.key == "k" for r in got)
    one = [r.text for r in got if r.doc_id == 1]
    assert sorted(map(len, one))[0] == 0 and len(max(one, key=len)) < len(long)
    assert suffix_dedup.without_repeats(docs.limit(0)).count() == 0
    assert substring_dedup.without_repeats(docs).count() == 4


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 99), (99, 100), (7, 7), (None, 3)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 99: 99, 100: 99}


def _fingerprint(t):
    low = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(low))
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_groups(spark):
    texts = corpus(seed=5)
    got = simhash.fingerprint_groups(documents(spark, texts)).orderBy("doc_id").collect()
    fps = [_fingerprint(t) for t in texts]
    assert [r.fp % 2**64 for r in got] == fps
    near = [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3]
    assert [r.component_id for r in got] == linked_components(len(fps), near)
    kept = simhash.deduplicate(documents(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r.component_id for r in got})


@pytest.mark.parametrize("heavy", [256, 3, 0])
def test_linked_fingerprints_up_to_three_bits(spark, heavy):
    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(60)]
    fps = list(base)
    for b in base:
        for d in (1, 2, 3, 3, 3, 4):
            x = b
            for i in r.sample(range(64), d):
                x ^= 1 << i
            fps.append(x)
    for b in base[:6]:  # families that share a half
        for _ in range(12):
            x = b
            for i in r.sample(range(32), r.choice([2, 3, 5])):
                x ^= 1 << i
            fps.append(x)
    fps = sorted(set(fps) | {0, 7, 2**64 - 1})
    near = [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3]
    want = linked_components(len(fps), near)
    signed = [x - 2**64 if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {r.fp: r.root for r in simhash.linked(df, heavy).collect()}
    groups = {}
    for x, w in zip(signed, want):
        groups.setdefault(w, set()).add(got.get(x, x))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_simhash_edges(spark):
    docs = documents(spark, [None, "", "same words here", "same words here"], [None, 4, 9, 9])
    got = simhash.fingerprint_groups(docs).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in got) == [(0, 4), (4, 4), (9, 9), (9, 9)]
    assert simhash.deduplicate(docs).count() == 4
    assert simhash.fingerprint_groups(docs.limit(0)).count() == 0
    assert docs.where(F.col("doc_id") > 100).count() == 0
