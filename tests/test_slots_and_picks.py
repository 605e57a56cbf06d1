"""Slots, change dates, greedy picks, gated roll-ups and text measures against brute-force versions, and at sizes where pairing would stand still."""

import random
import time
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronolith.functions import answers, text
from chronolith.operators import hierarchy, questions, selection


def test_slots_are_those_of_a_scan(spark):
    r = random.Random(2)
    st = [(f"u{r.randrange(6)}", i, r.randrange(30)) for i in range(150)] + [("none", 999, 3)]
    se = sorted({(f"u{r.randrange(6)}", r.randrange(35)) for _ in range(50)})
    want = {}
    for user in {s[0] for s in st}:
        room = {d: 2 for u, d in se if u == user}
        for _, i, e in sorted((s for s in st if s[0] == user), key=lambda s: (s[2], s[1])):
            day = next((d for d in sorted(room) if d >= e and room[d]), None)
            want[i] = day
            if day is not None:
                room[day] -= 1
    got = selection.scheduled(spark.createDataFrame(st, "user string, id long, effective_day long"), spark.createDataFrame([*se, se[0]], "user string, day long"), 2)
    assert {x.id: x.stated_day for x in got.collect()} == want


@pytest.mark.parametrize("before", [False, True])
def test_change_dates_are_those_of_all_pairs(spark, before):
    r = random.Random(5)
    values, rows = ["a", "b", "c"], []
    for k in range(12):
        true, rotation = r.randrange(12, 18), r.randrange(3)
        for _ in range(r.choice([2, 6, 14])):
            day = r.randrange(60)
            rows.append((f"k{k}", day, values[((day - true) // 7 + rotation) % 3] if day >= true else "a" if k % 3 else "x"))
    rows += [("k0", None, "a"), ("odd", 30, "z"), ("late", 50, "b")]
    want = set()
    for key in {x[0] for x in rows}:
        mine = [x[1:] for x in rows if x[0] == key and x[1] is not None]
        old = min(mine)[1]
        for s in range(10, 21):
            for rot in range(3):
                after = [(d, v) for d, v in mine if d >= s]
                ok = all(v == values[((d - s) // 7 + rot) % 3] for d, v in after) and (not before or all(v == old for d, v in mine if d < s))
                if ok and after:
                    want.add((key, s, rot, len(after)))
    got = selection.change_dates(spark.createDataFrame(rows, "key string, day int, value string"), 10, 20, values, keys=["key"], before=before)
    assert {tuple(x) for x in got.collect()} == want and len(want) > 20


def _greedy(rows, n, decay=0.5, cap=0.4):
    rows, chosen, weight, answers_ = sorted(rows), [], {}, Counter()
    weight = {x[0]: x[3] for x in rows}
    while len(chosen) < min(n, len(rows)):
        rest = [x for x in rows if x[0] not in chosen]
        open_ = [x for x in rest if answers_[x[1]] < max(1, int(cap * n))] or rest
        best = max(open_, key=lambda x: (weight[x[0]], -x[0]))
        chosen.append(best[0])
        answers_[best[1]] += 1
        for x in rows:
            if x[2] == best[2]:
                weight[x[0]] *= decay
    return chosen


def test_pruned_picks_are_the_greedy_ones(spark):
    r = random.Random(8)
    rows = [(i, f"a{r.randrange(3)}", f"s{r.randrange(3)}", float(r.randrange(1, 9))) for i in range(120)]
    for some in (rows, rows[:7], [x for x in rows if x[1] == "a0"]):
        frame = spark.createDataFrame([("g", *x) for x in some], "g string, id long, answer string, stratum string, weight double")
        got = selection.greedy_sample(frame, "g", 6).orderBy("pick").collect()
        assert [x.id for x in got] == _greedy(some, 6)
    hits = [(1, i, r.random(), [f"t{r.randrange(12)}" for _ in range(4)]) for i in range(60)]
    chosen, like = [], lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    while len(chosen) < 5:
        rest = sorted((h for h in hits if h not in chosen), key=lambda h: (-h[2], h[1]))
        chosen.append(max(rest, key=lambda h: 0.7 * h[2] - 0.3 * max([like(h[3], c[3]) for c in chosen], default=0.0)))
    got = selection.diversified(spark.createDataFrame(hits, "q long, id long, score double, tokens array<string>"), "q", 5).orderBy("rank").collect()
    assert [x.id for x in got] == [c[1] for c in chosen]


def test_a_million_rows_of_one_group(spark):
    """What reaches Python is bounded by the combinations, whatever the group holds."""
    n = F.col("id")
    rows = spark.range(1_000_000).select(F.lit("g").alias("g"), n, (n % 7).cast("string").alias("answer"), (n % 5).cast("string").alias("stratum"), (n % 1000).cast("double").alias("weight"))
    order = (F.desc("weight"), "id")
    assert selection.first_of_each(rows, ["g", "stratum", "answer"], 5, *order).count() == 35 * 5
    assert len(selection.greedy_sample(rows, "g", 5).collect()) == 5
    assert [x.id for x in questions.diverse_pick(rows.select("g", "id", "answer", "stratum"), "g", 7, ["answer", "stratum"]).orderBy("pick").collect()][:2] == [0, 1]


def test_changes_stop_where_the_summary_stays(spark):
    rows = [("a", 1, "w1", "m1", "v1", "e1", "t1"), ("a", 2, "w2", "m1", "v2", "e1", "t1"), ("b", 3, "w1", "m1", "v1", "e1", "t1")]
    schema = "s string, id long, w string, m string, v string, e string, t string"
    old = spark.createDataFrame(rows, schema)
    layers = [("week", F.col("w"), ["v"]), ("month", F.col("m"), ["e"]), ("lifetime", F.lit("all"), ["t"])]
    stored = hierarchy.rollup(old, ["s"], layers, ["id", "v"])

    def built(more):
        new = spark.createDataFrame(more, schema)
        found = hierarchy.gated_cascade(old.unionByName(new), new.select("s", F.col("w").alias("period")), stored, ["s"], layers, ["id", "v"])
        return sorted((r.s, r.layer, r.period) for r in found.collect())

    assert built([("a", 9, "w1", "m1", "v1", "e1", "t1")]) == [("a", 1, "w1")]
    assert built([("a", 9, "w1", "m1", "v7", "e1", "t1")]) == [("a", 1, "w1"), ("a", 2, "m1")]
    assert built([("b", 9, "w5", "m2", "v7", "e2", "t2")]) == [("b", 1, "w5"), ("b", 2, "m2"), ("b", 3, "all")]
    assert built([rows[0]]) == []  # the same row again: its source hashes as it did
    assert {k: v.count() for k, v in stored.items()} == {"week": 3, "month": 2, "lifetime": 2}


def test_long_texts_through_the_measures(spark):
    r = random.Random(1)
    a, b = (" ".join(f"word{r.randrange(4000)}" for _ in range(20_000)) for _ in range(2))
    want = Counter(a.split()) & Counter(b.split())
    f1 = 2 * sum(want.values()) / 40_000
    pair = spark.createDataFrame([(a, b)], "a string, b string")
    words = [F.split(F.col(c), " ") for c in "ab"]
    for measure, exact in ((text.token_f1(F.col("a"), F.col("b")), f1), (text.score_answer(F.col("a"), F.col("b"), F.lit(2)), f1), (answers.bleu(*words, 2), None), (text.rouge_l(*words), None)):
        frame = pair.select(measure.alias("x"))
        frame.collect()
        began = time.time()
        got = frame.first().x
        assert time.time() - began < 8  # the naive way doesn't end in minutes
        assert exact is None or abs(got - exact) < 1e-9
    rows = [("a b c a", "a a d"), ("", "x"), ("same same", "same same"), ("x", "y"), (None, "x")]
    small = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "id int, a string, b string")
    common = [x[0] for x in small.orderBy("id").select(text.multiset_common(*words)).collect()]
    assert common[:4] == [2, 0, 2, 0]


def test_common_subsequences_are_those_of_the_table():
    r = random.Random(4)
    for _ in range(60):
        x, y = ([r.choice("abcd") for _ in range(r.randrange(90))] for _ in range(2))
        row = [0] * (len(y) + 1)
        for t in x:
            last = 0
            for j, u in enumerate(y, 1):
                last, row[j] = row[j], last + 1 if t == u else max(row[j], row[j - 1])
        assert text.common_subsequence(x, y) == row[-1]
    assert text.rouge_l.func(pd.Series([None, []]), pd.Series([["a"], ["a"]])).tolist() == [0.0, 0.0]


def test_paths_meet_in_the_middle(spark):
    """Against a search from one side, on a graph with circles, loops and double edges."""
    r = random.Random(7)
    edges = [(i, f"n{r.randrange(9)}", f"n{r.randrange(9)}") for i in range(16)] + [(90, "n0", "n1"), (91, "n0", "n1"), (92, "lone", "lone")]
    frame = spark.createDataFrame(edges, "id long, src string, dst string")
    pairs = [(f"n{i}", f"n{j}") for i in range(3) for j in range(4, 7)] + [("n0", "n1"), ("n1", "lone"), ("n2", "n2")]

    def walks(a, b, depth):
        out, front = [], [(a, ())]
        for _ in range(depth):
            new = []
            for at, used in front:
                for i, x, y in edges:
                    for to in {y} if x == at and y == at else [y] if x == at else [x] if y == at else []:
                        if i not in used:
                            (out if to == b else new).append((to, (*used, i)))
            front = new
        return sorted((len(u), u) for _, u in out)

    got = {}
    for x in selection.paths_between(frame, spark.createDataFrame(pairs, "a string, b string"), 4, 10_000).collect():
        got.setdefault((x.a, x.b), []).append((x.hops, tuple(x.edges)))
    want = {(a, b): walks(a, b, 4) for a, b in pairs if a != b}
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v} and len(got) > 5
