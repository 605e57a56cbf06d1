"""Forms of answers, dates and objects on texts of many shapes, each with what it must give."""

import pytest
from pyspark.sql import functions as F

from chronolith.functions import answers, dates, queries, text

#: text, normalised, lowered first, spaced, set of words
ANSWERS = [
    ("The Cat, and a dog!", "cat dog", "cat dog", "cat and dog", ["cat", "dog"]),
    ("  A   an the  ", "", "", "", []),
    ("Straße, Über THE Äpfel", "straße über äpfel", "straße über äpfel", "straße über äpfel", ["straße", "äpfel", "über"]),
    ("", "", "", "", []),
    (None, None, None, None, None),
    ("2026-13-45 odd", "20261345 odd", "20261345 odd", "2026 13 45 odd", ["20261345", "odd"]),
    ("an apple\nthe pear", "apple pear", "apple pear", "apple pear", ["apple", "pear"]),
    ("band stand and, the-end", "band stand end", "band stand theend", "band stand and end", ["band", "stand", "theend"]),
    ("theatre and-and android", "theatre android", "theatre andand android", "theatre and and android", ["andand", "android", "theatre"]),
    ("1,000.5 the", "10005", "10005", "1 000 5", ["10005"]),
]

#: text, days named, last day named by an ISO date or a month
DATES = [
    ("Mar 3, 2026 and 3 March 2026", ["2026-03-03"], "2026-03-31"),
    ("on 2026-02-30 or 2026-02-28.", ["2026-02-28"], "2026-02-28"),
    ("march 3rd 2026; Sept. 9, 2025", ["2025-09-09", "2026-03-03"], None),
    ("December 1999", [], "1999-12-31"),
    ("in May 2024, after 2024-06-01", ["2024-06-01"], "2024-06-01"),
    ("31 apr 2024", [], None),
    ("x2026-01-01", [], None),
    ("1 jan 2020 2 feb 2021 2019-12-31", ["2019-12-31", "2020-01-01", "2021-02-02"], "2019-12-31"),
    ("mar. 3 2026", ["2026-03-03"], None),
    (None, None, None),
    ("", [], None),
    ("JANUARY 5, 2024", ["2024-01-05"], None),
]


def test_answers(spark):
    c = F.col("t")
    frame = spark.createDataFrame([(i, x[0]) for i, x in enumerate(ANSWERS)], "i int, t string")
    got = frame.orderBy("i").select(c, text.normalize_answer(c), text.normalize_answer_lower_first(c), text.normalize_answer_spaced(c), answers.token_set(c)).collect()
    assert [tuple(r) for r in got] == ANSWERS


def test_same_sets_and_bodies(spark):
    rows = [("the cat and dog", "Dog, cat!", True), ("a a b", "b", True), ("cat", "cats", False), ("", "the", True), ("x y", "y z", False)]
    got = spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(rows)], "i int, a string, b string").orderBy("i").select(answers.set_exact(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [r[2] for r in rows]
    bodies = {"head\n\nbody": "body", "head\n\nbody\n\nmore": "body\n\nmore", "no header\nline": "no header\nline", "\n\nbody": "body", "head\n\n": "", "": ""}
    got = spark.createDataFrame([(x,) for x in bodies], "t string").select("t", answers.without_header(F.col("t")).alias("b")).collect()
    assert {r.t: r.b for r in got} == bodies


def test_dates_named(spark):
    frame = spark.createDataFrame([(i, x[0]) for i, x in enumerate(DATES)], "i int, t string")
    c = F.col("t")
    got = frame.orderBy("i").select(c, F.transform(text.dates_in_text(c), lambda d: d.cast("string")), dates.latest_named(c).cast("string")).collect()
    assert [tuple(r) for r in got] == DATES
    spelled = {"2026-03-01": "march 1 2026", "2026-02-30": "20260230", "March 1, 2026": "march 1 2026", "The 2026": "2026"}
    got = spark.createDataFrame([(x,) for x in spelled], "t string").select("t", answers.date_aware(F.col("t")).alias("a")).collect()
    assert {r.t: r.a for r in got} == spelled


def test_strict_checks(spark):
    rows = [("It was on Mar 3, 2026.", ["2026-03-03"], "date_exact", True), ("It was in March.", ["2026-03-03"], "date_exact", False), ("3 march 2026 or 2026-04-01", ["2026-04-01"], "date_exact", True), ("a green TEA cup", ["Tea", "milk"], "exact", True), ("steak", ["tea"], "exact", False), ("über-Tee", ["tee"], "exact", True), ("a+b", ["a+b"], "exact", True), ("tea", ["tea"], "llm_judge", None)]
    frame = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], "i int, p string, a array<string>, g string")
    got = frame.orderBy("i").select(text.strict_check(F.col("p"), F.col("a"), F.col("g"))).collect()
    assert [r[0] for r in got] == [r[3] for r in rows]


@pytest.mark.parametrize("raw,repeated", [('{"a":1,"b":2}', False), ('{"a":1,"a":2}', True), ("[1]", None), ('{"a":{"b":1,"b":2}}', False), ("", None), ("{bad", None), (None, None), ("{}", False), ('{"a":1, "A":2}', False)])
def test_repeated_keys(spark, raw, repeated):
    assert spark.createDataFrame([(raw,)], "t string").select(answers.has_repeated_keys(F.col("t"))).first()[0] is repeated


def test_time_phrases_have_their_own_places(spark):
    asked = "In 2024 or 2024? Last week, 2024-05-06 and again last week"
    got = spark.createDataFrame([(asked,), ("",), (None,)], "q string").select(queries.time_entities(F.col("q")).alias("e")).collect()
    found = [(x.start, x.text) for x in got[0].e]
    assert all(asked.lower()[s - 1 : s - 1 + len(t)] == t for s, t in found) and len(set(found)) == len(found)
    assert [s for s, t in found if t == "last week"] == [18, 50] and [s for s, t in found if t == "2024"] == [4, 12, 29]
    assert got[1].e == [] and got[2].e is None
