"""Queries without SQL on small tables, against brute force over all of their rows and texts."""

import datetime as dt
import difflib
from collections import Counter

from pyspark.sql import functions as F

from chronolith.functions import text
from chronolith.operators import selection
from chronolith.plans import QUERIES

OPENING = "one opening that is the same for all of the turns, sixty-odd long; "
TURNS = [OPENING + "then quite another subject: ponies hopping " * 8, OPENING + "relational adjustment of seventeen dogs " * 9, OPENING + "nothing more"]


def conversations(spark, folder, texts):
    """Turn 0 of one session for each text."""
    spark.createDataFrame([(i, 0, "user", t) for i, t in enumerate(texts)], "conv_id long, turn int, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


def test_sequence_similarity_reads_whole_turns(spark, tmp_path):
    d = conversations(spark, tmp_path, TURNS)
    got = {r.id: r.ratio for r in QUERIES["sequence_similarity"].run(spark, d).collect()}
    assert got == {i * 100: round(difflib.SequenceMatcher(None, TURNS[i].lower(), TURNS[i + 1].lower()).ratio(), 6) for i in range(2)}


def test_stemmed_f1_reads_whole_turns(spark, tmp_path):
    d = conversations(spark, tmp_path, TURNS)
    bags = []
    for t in TURNS:
        words = "".join(c for c in t.lower() if c.isalnum() or c == " ").split()
        bags.append(Counter(text._stem(w) for w in words if w not in ("a", "an", "the", "and")))
    want = {i * 100: 2 * (bags[i] & bags[i + 1]).total() / (bags[i].total() + bags[i + 1].total()) for i in range(2)}
    got = {r.id: r.f1 for r in QUERIES["stemmed_f1"].run(spark, d).collect()}
    assert {k: round(v, 9) for k, v in got.items()} == {k: round(v, 9) for k, v in want.items()}


def test_greedy_sample_draws_from_all_days(spark, tmp_path):
    rows = [(i, "click", f"p{i % 3}", 1, dt.datetime(2024, 1, day)) for i, day in enumerate([2, 5, 12, 20, 30])]
    spark.createDataFrame(rows, "event_id long, event_type string, props string, user_id long, ts timestamp").write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES["greedy_sample"].run(spark, str(tmp_path)).orderBy("pick").collect()
    assert sorted(r.id for r in got) == [0, 1, 2, 3, 4]


def test_greedy_sample_falls_back_to_capped_answers(spark):
    rows = [("ann", i, "same" if i < 4 else "other", "s", float(9 - i)) for i in range(5)]
    items = spark.createDataFrame(rows, "speaker string, id long, answer string, stratum string, weight double")
    got = selection.greedy_sample(items, "speaker", 5).orderBy("pick").collect()
    assert [r.id for r in got] == [0, 1, 4, 2, 3]


def test_texts_keep_their_letters(spark, tmp_path):
    d = conversations(spark, tmp_path, ["die Straße é the über façade", "eine Straße über Flüsse façades", "Straße"])
    got = {r.id: r.f1 for r in QUERIES["stemmed_f1"].run(spark, d).collect()}
    assert {k: round(v, 6) for k, v in got.items()} == {0: 0.6, 100: round(2 / 6, 6)}
    got = {r.id: r.ratio for r in QUERIES["sequence_similarity"].run(spark, d).collect()}
    assert got[100] == round(difflib.SequenceMatcher(None, "eine straße über flüsse façades", "straße").ratio(), 6)


def test_words_are_those_of_unicode(spark, tmp_path):
    one = spark.range(1).select(text.words(F.lit("Straße, ÜBER naïve_2")).alias("w"), text.normalize_answer(F.lit("éa\u00a0the Öl")).alias("n")).first()
    assert one.w == ["straße", "über", "naïve_2"] and one.n == "éa öl"


def test_diverse_rerank_reads_unchanged_texts(spark, tmp_path):
    d = conversations(spark, tmp_path, ["ü" * 30 + "ab"])
    (got,) = QUERIES["diverse_rerank"].run(spark, d).collect()
    assert got.score == 32 / 50
