"""Canonical spellings and cover density against brute-force versions."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from chronolith.operators import consolidation, retrieval


def _score(a, b):
    if a.lower() == b.lower():
        return 1.0
    x, y = set(a.lower().split()), set(b.lower().split())
    if not x or not y:
        return 0.0
    share = len(x & y) / len(x | y)
    share = max(share, 0.85) if x <= y or y <= x else share
    return max(share, SequenceMatcher(None, a.lower(), b.lower()).ratio())


def test_canonical_values_are_those_of_all_pairs(spark):
    r = random.Random(6)
    words = ["oat", "milk", "latte", "morning", "yoga", "colour", "running", "tea", "green", "book", "café", "straße"]
    known = {"colour", "oat milk latte", "yoga", "Green Tea", "abc", "a", "x y z", "running shoes", "morning run"} | {" ".join(r.sample(words, r.randrange(1, 4))) for _ in range(30)}

    def misspelt(t):
        i = r.randrange(len(t))
        return [t[:i] + t[i + 1 :], t[:i] + r.choice("aeiou") + t[i:], t[:i] + r.choice("xyz") + t[i + 1 :], t.upper(), t[::-1], t + " extra words here"][r.randrange(6)]

    values = {misspelt(r.choice(sorted(known))) for _ in range(120)} | {"color", "oat latte", "yoga", "GREEN TEA", "abd", "b", "zz", "  ", "ab" * 400} | set(sorted(known)[:5])
    values -= {""}
    want = {}
    for v in values:
        best = max(((_score(v, k), [-ord(c) for c in k], k) for k in known), key=lambda x: (x[0], x[1] + [1]))
        scores = {k: _score(v, k) for k in known}
        top = max(scores.values())
        if top >= 0.75:
            want[v] = (min(k for k, s in scores.items() if s == top), top)
        assert best[0] == top
    got = consolidation.canonical(spark.createDataFrame([("e", v) for v in values], "entity string, value string"), spark.createDataFrame([("e", k) for k in known], "entity string, canon string"), ["entity"])
    got = {x.value: (x.canon, x.score) for x in got.collect()}
    assert got.keys() == want.keys() and len(want) > 60
    assert all(got[v][0] == want[v][0] and abs(got[v][1] - want[v][1]) < 1e-9 for v in want)
    assert got["color"][0] == "colour" and abs(got["color"][1] - 10 / 11) < 1e-9


def test_consolidation_keeps_all_rows(spark):
    items = spark.createDataFrame([(1, "a", "color"), (2, "a", None), (3, "b", "color"), (4, "a", "color"), (5, None, "color")], "id long, entity string, content string")
    known = spark.createDataFrame([("a", "colour"), ("a", None), ("b", "tea")], "entity string, canon string")
    got = {x.id: x.canon for x in consolidation.consolidated(items, known.where("canon is not null"), ["entity"]).collect()}
    assert got == {1: "colour", 2: None, 3: None, 4: "colour", 5: None}
    assert consolidation.consolidated(items.limit(0), known, ["entity"]).count() == 0


def _covers(words, terms):
    total, spans = 0.0, []
    for i in range(len(words)):
        for j in range(i, len(words)):
            if set(terms) <= set(words[i : j + 1]):
                spans.append((i, j))
                break
    least = [s for s in spans if not any(o != s and s[0] <= o[0] and o[1] <= s[1] for o in spans)]
    for i, j in least:
        held = sum(w in terms for w in words[i : j + 1])
        total += 0.1 / (1 + j - i + 1 - held)
    return total


def test_covers_are_the_smallest_spans(spark):
    r = random.Random(3)
    texts = [[r.choice("abcdxyz") for _ in range(r.randrange(25))] for _ in range(60)] + [[], ["a"], ["a", "b", "c"], ["a", "a", "b", "b", "c", "a"]]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, w array<string>")
    for terms in (["a"], ["a", "b"], ["a", "b", "c"]):
        got = {x.id: x.c for x in frame.select("id", retrieval.cover_density(F.col("w"), terms).alias("c")).collect()}
        assert all(abs(got[i] - _covers(w, terms)) < 1e-9 for i, w in enumerate(texts))
