import datetime as dt

import pytest
from pyspark.sql import functions as F

from chronolith.api import MemoryStore
from chronolith.functions import dates, queries, text
from chronolith.operators import hierarchy, metrics, questions, retrieval, selection, timeline
from chronolith.sources import loaders

D = dt.date
SCHEMA = "id long, content string, entity string, type string, speaker string, source_date date"


def memories(spark, rows):
    return spark.createDataFrame([(i, c, e, "preference", s, D.fromisoformat(d)) for i, c, e, s, d in rows], SCHEMA)


@pytest.fixture(scope="module")
def seq(spark):
    days = ["2024-01-01", "2024-01-02", "2024-01-03", "2024-01-04", "2024-01-06"]
    return memories(spark, [(i, c, "drink", "ann", d) for i, (c, d) in enumerate(zip(["A", "A", "B", "B", "A"], days))])


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_sequences(seq):
    k = ["speaker", "entity"]
    assert [r.content for r in timeline.transitions(seq, k).orderBy("id").collect()] == ["A", "B", "A"]
    p = timeline.phase_durations(seq, k).orderBy("start").collect()
    assert [(r.content, r.days, r.current) for r in p] == [("A", 2, False), ("B", 3, False), ("A", None, True)]
    assert [(r.content, r.n) for r in timeline.run_lengths(seq, k).orderBy("run").collect()] == [("A", 2), ("B", 2), ("A", 1)]
    v = timeline.validity_intervals(seq, k).orderBy("start").collect()
    assert [(r.content, str(r.start), str(r.end), r.days) for r in v] == [("A", "2024-01-01", "2024-01-02", 2), ("B", "2024-01-03", "2024-01-04", 2), ("A", "2024-01-06", "2024-01-06", 1)]


def test_row_order_does_not_matter(seq):
    k = ["speaker", "entity"]
    a = timeline.run_lengths(seq, k).orderBy("run").collect()
    assert a == timeline.run_lengths(seq.orderBy(F.desc("id")).repartition(3), k).orderBy("run").collect()


def test_filters_and_limits(seq):
    assert timeline.query_memories(seq, entity=" Drink ", start="2024-01-02", end="2024").count() == 4
    with pytest.raises(ValueError):
        timeline.query_memories(seq, start="2025", end="2024")
    with pytest.raises(ValueError):
        timeline.query_memories(seq, limit=0)
    few = timeline.limit_plus_one(seq, 3, "source_date", "id").collect()
    assert len(few) == 3 and all(r.truncated for r in few)
    assert not any(r.truncated for r in timeline.limit_plus_one(seq, 5, "id").collect())
    assert timeline.widened("2022") == "2022-01-01" and timeline.widened("2024-02", True) == "2024-02-29"


def test_dedupe_rules(spark):
    batch = memories(spark, [(1, "Latte", "drink", "ann", "2024-01-01"), (2, "latte", "drink", "ann", "2024-01-01"), (3, "latte", "drink", "ann", "2024-01-02"), (4, "latte", "drink", None, "2024-01-01")])
    key = [F.col("entity"), F.lower("content"), F.col("source_date"), F.col("speaker")]
    kept = timeline.dedupe_batch(batch, key, "id")
    assert sorted(r.id for r in kept.collect()) == [1, 3, 4]
    store = memories(spark, [(9, "LATTE", "drink", "ann", "2024-01-01"), (10, "latte", "drink", None, "2024-01-01")])
    assert sorted(r.id for r in timeline.not_stored(kept, store).collect()) == [3]


def test_split_ingest_equals_one(spark, seq):
    chunks = spark.createDataFrame([], "id long, date date, content string, embedding array<float>")
    empty = MemoryStore(seq.limit(0), chunks, chunks)
    more = seq.unionByName(seq.withColumn("id", F.col("id") + 100))
    once, _ = empty.ingest(more)
    half, _ = empty.ingest(more.where("source_date < DATE '2024-01-03'"))
    twice, fresh = half.ingest(more.where("source_date >= DATE '2024-01-03'"))
    assert sorted(r.id for r in once.memories.collect()) == sorted(r.id for r in twice.memories.collect()) == [0, 1, 2, 3, 4]
    assert sorted(r.period for r in once.affected_periods(fresh).collect()) == ["month:2024-01", "week:2024-01-01"]
    assert [r.entity for r in once.list_entities().collect()] == ["drink"]
    assert once.search_memories(entity="drink", limit=2).where("truncated").count() == 2
    names = spark.createDataFrame([("Drink",), ("food",)], "name string")
    assert [r.name for r in once.unknown_names(names, "entity").collect()] == ["food"]


def test_iso_weeks_and_partial_dates(spark):
    r = one(spark, *[dates.iso_week(F.lit(d).cast("date")).alias(d) for d in ("2026-12-31", "2027-01-03", "2027-01-04")])
    assert list(r) == ["2026-W53", "2026-W53", "2027-W01"]
    r = one(spark, dates.widened(F.lit("2022")), dates.widened(F.lit("2022-05"), True), dates.widened(F.lit("2022-05-10")), dates.widened(F.lit("bad")))
    assert list(r) == [D(2022, 1, 1), D(2022, 5, 31), D(2022, 5, 10), None]
    r = one(spark, dates.parsed_time(F.lit("1:56 pm on 8 May, 2023")), dates.parsed_time(F.lit("2023/05/20 (Sat) 02:21")), dates.parsed_time(F.lit("?")))
    assert [str(x) for x in r] == ["2023-05-08 13:56:00", "2023-05-20 02:21:00", "None"]
    assert dates.relative_window("2 weeks ago", "2024-03-15") == ("2024-02-23", "2024-03-08")


def test_rules(spark):
    day, anchor = F.col("d"), F.lit("2024-01-01").cast("date")
    days = spark.createDataFrame([(D(2023, 12, 31),), (D(2024, 1, 1),), (D(2024, 1, 8),), (D(2024, 1, 6),)], "d date")
    week = dict.fromkeys(dates.WEEKDAYS, "in") | {"saturday": "out"}
    rules = {
        "constant": ({"type": "constant", "value": "x"}, [None, "x", "x", "x"]),
        "weekly": ({"type": "weekly_alternate", "values": ["a", "b"]}, [None, "a", "b", "a"]),
        "cycle": ({"type": "n_day_cycle", "segments": [{"value": "p", "days": 2}, {"value": "q", "days": 3}]}, [None, "p", "q", "p"]),
        "dow": ({"type": "day_of_week", "map": week}, [None, "in", "in", "out"]),
        "nested": ({"type": "nested", "block_days": 7, "blocks": [{"type": "constant", "value": "1"}, {"type": "day_of_week", "map": week}]}, [None, "1", "in", "1"]),
        "conditional": ({"type": "conditional", "condition": "season", "cases": {"winter": "w", "default": "s"}}, [None, "w", "w", "w"]),
    }
    for rule, want in rules.values():
        got = days.select(dates.rule_value(rule, day, anchor, {"season": F.lit("winter")})).collect()
        assert [r[0] for r in got] == want


def test_regimes(spark):
    rows = [("d", "a", D(2024, 1, 1), False, None, "A"), ("d", "b", D(2024, 1, 10), True, D(2024, 1, 12), "B"), ("d", "c", D(2024, 1, 20), False, None, "C")]
    regimes = spark.createDataFrame(rows, "domain string, id string, start date, temporary boolean, end date, label string")
    got = timeline.resolve_regimes(regimes, "2024-01-31")
    assert [(r.id, r.kind, r.start.day, r.end.day, r.label) for r in got.orderBy("start").collect()] == [("a", "initial", 1, 9, "A"), ("b", "temporary", 10, 12, "B"), ("b.revert", "reversion", 13, 19, "A"), ("c", "shift", 20, 31, "C")]
    assert timeline.coverage_violations(got, ["domain"], "2024-01-01", "2024-01-31").count() == 0


def test_as_of_and_next_session(spark):
    log = spark.createDataFrame([("u", 1, D(2024, 1, 2), "x"), ("u", 2, D(2024, 1, 2), "y"), ("u", 3, D(2024, 1, 5), "z")], "user string, id long, at date, value string")
    probes = spark.createDataFrame([("u", 1, D(2024, 1, 1)), ("u", 2, D(2024, 1, 4)), ("u", 3, D(2024, 1, 5)), ("v", 4, D(2024, 1, 5))], "user string, q long, day date")
    got = timeline.as_of(probes, log, ["user"], "day", "at", ["value"], "id").orderBy("q").collect()
    assert [r.as_of_value for r in got] == [None, "y", "z", None]
    nxt = timeline.next_session(probes, log.select("user", "at").distinct(), ["user"], "day", "at").orderBy("q").collect()
    assert [r.next_session for r in nxt] == [D(2024, 1, 2), D(2024, 1, 5), D(2024, 1, 5), None]


def test_plans_avoid_pair_loops(spark, seq):
    intervals = seq.select(F.col("id").alias("r"), F.col("source_date").alias("a"), F.date_add("source_date", 2).alias("b"))
    days = seq.select(F.col("source_date").alias("day"))
    plan = timeline.interval_join(days, intervals, "day", "a", "b", 3)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_texts(spark):
    f = lambda c: one(spark, c)[0]
    assert f(text.normalize_answer(F.lit("The cat, and  a Dog's!"))) == "cat dogs"
    assert f(text.clean_text(F.lit("<b>Hi</b> see https://a.b/c or x@y.org 555-123-4567 ok"))) == "Hi see or ok"
    assert [str(x) for x in f(text.dates_in_text(F.lit("on 2026-03-01, Mar 3rd, 2026 or 5 March 2026; 2026-02-31")))] == ["2026-03-01", "2026-03-03", "2026-03-05"]
    assert f(text.token_jaccard(F.lit("oat latte"), F.lit("oat milk latte"))) == 0.85
    assert f(text.strict_check(F.lit("It was Oat (milk)."), F.array(F.lit("oat"), F.lit("soy")), F.lit("exact"))) is True
    assert f(text.strict_check(F.lit("on Mar 3, 2026"), F.array(F.lit("2026-03-03")), F.lit("date_exact"))) is True
    assert f(text.strict_check(F.lit("x"), F.array(F.lit("x")), F.lit("judge"))) is None
    assert f(text.score_answer(F.lit("red, blue"), F.lit("blue, green"), F.lit(1))) == 0.5
    assert f(text.score_answer(F.lit("There is no record"), F.lit(""), F.lit(5))) == 1.0
    assert f(text.stems(F.array(*map(F.lit, ["caresses", "ponies", "relational", "hopping", "happy", "adjustment"])))) == ["caress", "poni", "relat", "hop", "happi", "adjust"]
    assert f(text.rouge_l(F.array(*map(F.lit, "abcd")), F.array(*map(F.lit, "acd")))) == pytest.approx(6 / 7)
    assert f(text.sequence_ratio(F.lit("yoga"), F.lit("Yoga"))) == 1.0
    assert "".join(f(text.window_split(20, 0)(F.lit("One two three. Four five six. Seven.")))).replace(" ", "") == "Onetwothree.Fourfivesix.Seven."
    assert f(text.cjk_estimate(F.lit("ab 12 日本"))) == 4
    assert f(queries.named_in(F.lit("met A. Smith"), F.lit("Anna Jones"))) is True
    assert [tuple(x) for x in f(queries.time_entities(F.lit("What changed yesterday or 2 weeks ago?")))] == [(14, "yesterday"), (27, "2 weeks ago")]
    assert f(queries.expanded(F.array(F.lit("tea"), F.lit("x")), {"tea": ["chai"]})) == ["tea", "x", "chai"]


def test_retrieval_cases(spark):
    docs = spark.createDataFrame([(1, "all red"), (2, "all blue"), (3, "all red red")], "id long, text string")
    got = {r.id: r.score for r in retrieval.bm25(docs, ["all", "red", "red"]).collect()}
    assert got[2] == 0 and got[3] > got[1] > 0
    once = {r.id: r.score for r in retrieval.bm25(docs, ["red"]).collect()}
    assert got[1] == pytest.approx(2 * once[1])
    k = spark.createDataFrame([(1, 0.0), (2, 0.0)], "id long, score double")
    v = spark.createDataFrame([(2, 4.0), (3, 1.0)], "id long, score double")
    assert {r.id: (round(r.fused, 4), r.strategy) for r in retrieval.fuse(k, v).collect()} == {1: (0, "keyword"), 2: (0.1, "both"), 3: (0.025, "semantic")}
    w = spark.createDataFrame([("a", 5.0), ("b", 3.0), ("c", 1.0)], "type string, weight double")
    assert {r.type: r.seats for r in retrieval.apportioned(w, 6).collect()} == {"a": 4, "b": 2}


def test_hierarchy_gaps(spark):
    d = D(2024, 1, 1)
    rows = [("o1", "L1", d, "s1"), ("o2", "L1", d, "s2"), ("s1", "L2", d, "d1"), ("d1", "L3", d, "w1"), ("m1", "L5", d, None)]
    nodes = spark.createDataFrame(rows, "id string, level string, period date, parent string")
    chain = {r.L1: tuple(r)[1:] for r in hierarchy.parent_chain(nodes).collect()}
    assert chain == {"o1": ("s1", "d1", None, None), "o2": (None,) * 4}
    assert [r.id for r in hierarchy.missing_parents(nodes, "L1").collect()] == ["s2"]
    assert [r.id for r in hierarchy.missing_parents(nodes, "L3").collect()] == ["w1"]
    edges = spark.createDataFrame([(1, "a", "b"), (2, "b", "c"), (3, "a", "c")], "id long, src string, dst string")
    assert [(r.hops, r.edges) for r in selection.paths(edges, "a", "c", 3).collect()] == [(1, [3]), (2, [1, 2])]
    assert {r.id for r in hierarchy.neighbours(edges, "b").collect()} == {"a", "c"}


def test_metric_cases(spark):
    rows = spark.createDataFrame([("a", float(x)) for x in range(1, 21)] + [("b", 7.0)], "k string, v double")
    got = {r.k: r for r in metrics.floor_percentiles(rows, ["k"], "v", {"p50": 0.5, "p95": 0.95}).collect()}
    assert (got["a"].p50, got["a"].p95, got["b"].p95) == (11.0, 20.0, 7.0)
    e = spark.createDataFrame([("x", "tea"), ("y", "not mentioned"), ("z", "tea"), ("w", "tea")], "k string, value string")
    x = spark.createDataFrame([("x", "TEA"), ("y", "milk"), ("z", "milk"), ("v", "q")], "k string, value string")
    assert {r.k: r.kind for r in metrics.claim_diff(e, x, ["k"]).collect()} == {"y": "leak", "z": "wrong", "w": "absent", "v": "invention"}
    blocks = spark.createDataFrame([("u", "m1", 1, 1.0), ("u", "m2", 3, 0.0)], "user string, month string, n long, acc double")
    total = metrics.micro_average(blocks, ["user", "month"], "acc").where("user IS NULL").first()
    assert (total.n, total["mean"]) == (4, 0.25)


def test_change_dates_and_schedule(spark):
    seen = spark.createDataFrame([(10, "a"), (14, "b"), (21, "a")], "day long, value string")
    got = {(r.start, r.rotation) for r in selection.change_dates(seen, 4, 10, ["a", "b"]).collect() if r.n == 3}
    assert got == {(s, 0) for s in (7,)} | {(s, r) for s, r in got if s != 7}
    assert all(seen.count() == 3 for _ in got) and (7, 0) in got
    st = spark.createDataFrame([("u", 1, 1), ("u", 2, 1), ("u", 3, 9)], "user string, id long, effective_day long")
    se = spark.createDataFrame([("u", 2), ("u", 5)], "user string, day long")
    assert {r.id: r.stated_day for r in selection.scheduled(st, se, 1).collect()} == {1: 2, 2: 5, 3: None}


def test_files(spark, tmp_path):
    log = tmp_path / "log.jsonl"
    log.write_text('{"id":"a","v":1}\n{"id":"b","v":2}\n{"id":"b","v":3}\n{"id":"c","v"')
    good, bad = loaders.read_log(spark, str(log), "id string, v long")
    assert [r.id for r in good.collect()] == ["a"] and sorted(r.why for r in bad.collect()) == ["repeated", "repeated", "torn"]
    (tmp_path / "u.json").write_text('{"user_id":"u1","name":"n","sessions":{"2024-01-02":{"day":2,"turns":[{"speaker":"a","text":"hi"},{"speaker":"b","text":"yo"}]}}}')
    assert [(str(r.date), r.position, r.text) for r in loaders.read_day_sessions(spark, str(tmp_path / "u.json")).collect()] == [("2024-01-02", 0, "hi"), ("2024-01-02", 1, "yo")]
    raw = spark.createDataFrame([('{"session_2":"[{\\"speaker\\":\\"a\\",\\"text\\":\\"x\\",\\"blip_caption\\":\\"cat\\"}]","session_2_date_time":"1:00 pm on 2 May, 2023"}',)], "j string")
    assert [tuple(r) for r in loaders.numbered_sessions(raw, "j").collect()] == [(2, "1:00 pm on 2 May, 2023", 0, "a", "x [cat]")]
    assert len(loaders.file_hashes(spark, str(log)).first().sha256) == 64
    rec = spark.createDataFrame([("Tea", " Drink ", "", None, "")], "content string, entity string, type string, speaker string, date string")
    assert tuple(loaders.cleaned_records(rec, "2024-01-05").first()) == ("Tea", "drink", "preference", "user", D(2024, 1, 5))


def test_dirty_weeks_only(spark, seq):
    week = dates.week_start(F.col("source_date"))
    args = (week, ["content"], ["source_date", "id"])
    old = metrics.source_hash(seq, *args)
    late = seq.unionByName(memories(seq.sparkSession, [(50, "A", "drink", "ann", "2024-01-09")]))
    assert [str(r.period) for r in metrics.dirty_periods(metrics.source_hash(late, *args), old).collect()] == ["2024-01-08"]
    assert metrics.dirty_periods(metrics.source_hash(seq.repartition(3), *args), old).count() == 0


def test_malformed_lines_before_the_last(spark, tmp_path):
    log = tmp_path / "log.jsonl"
    log.write_text('{"id":"a","v":1}\n{"id":"b",\n{"id":"c","v":2}\n{"id":')
    good, bad = loaders.read_log(spark, str(log), "id string, v long")
    assert sorted(r.id for r in good.collect()) == ["a", "c"] and sorted(r.why for r in bad.collect()) == ["malformed", "torn"]


def test_diverse_pick_is_the_greedy_one(spark):
    rows = [("p", i, "xyz"[i % 3], f"d{i % 2}") for i in range(9)] + [("q", 1, "x", "d0")]
    got = questions.diverse_pick(spark.createDataFrame(rows, "pool string, id long, answer string, domain string"), "pool", 5, ["answer", "domain"]).collect()
    assert [r.id for r in sorted((r for r in got if r.pool == "p"), key=lambda r: r.pick)] == [0, 1, 2, 3, 4]
    same = spark.createDataFrame([("p", i, "x", "d0" if i < 4 else "d1") for i in range(6)], "pool string, id long, answer string, domain string")
    assert [r.id for r in questions.diverse_pick(same, "pool", 4, ["answer", "domain"]).orderBy("pick").collect()] == [0, 4, 1, 5]


def test_loaders_and_writers(spark, tmp_path):
    """Every loader's rows on a small file or table of its own."""
    zipped = spark.createDataFrame([("q", ["s1", "s2"], ["2023/05/02", "2023/05/01"], [["a"], ["b"]])], "question_id string, haystack_session_ids array<string>, haystack_dates array<string>, haystack_sessions array<array<string>>")
    assert [(r.session_id, r.turns) for r in loaders.zipped_sessions(zipped).collect()] == [("s2", ["b"]), ("s1", ["a"])]
    asked = spark.createDataFrame([(1, D(2024, 1, 2)), (1, D(2024, 1, 3)), (2, D(2025, 1, 1)), (3, None)], "id long, asked_on date")
    found = loaders.violations(asked, F.lit(D(2024, 1, 1)), F.lit(D(2024, 12, 31))).collect()
    assert sorted((r.id, r.rule) for r in found) == [(1, "repeated id"), (2, "date out of range"), (3, "date out of range")]
    rows = spark.createDataFrame([("b", "y", "L4:2024-W02"), ("a", "x", "L3:2024-01-02")], "category string, title string, identifier string")
    loaders.write_rows(rows, str(tmp_path / "csv"), "csv")
    loaders.write_rows(rows, str(tmp_path / "json"))
    assert {tuple(r) for r in loaders.read_activity_csv(spark, str(tmp_path / "csv")).collect()} == {tuple(r) for r in rows.collect()}
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    assert [(r.identifier, r.level) for r in loaders.summary_dump(rows).collect()] == [("L3:2024-01-02", "L3"), ("L4:2024-W02", "L4")]
    items = spark.createDataFrame([("c", 2, "y"), ("c", 1, "x"), ("d", 3, "z")], "category string, item_id long, title string")
    assert {r["category"]: [i.item_id for i in r["items"]] for r in loaders.grouped_items(items).collect()} == {"c": [1, 2], "d": [3]}
    stores = spark.createDataFrame([("legacy/a", 9), ("b", 1), ("c", 2)], "path string, modified long")
    assert [r.path for r in loaders.stores_by_age(stores).collect()] == ["c", "b", "legacy/a"]
    bank = spark.createDataFrame([("u", {"2024-01-01": [("q1", "r1"), ("q2", "r2")]})], "user string, history map<string, array<struct<query:string,response:string>>>")
    assert [(r.date, r.position, r["query"]) for r in loaders.memory_bank(bank).orderBy("position").collect()] == [("2024-01-01", 0, "q1"), ("2024-01-01", 1, "q2")]


def test_ranks_without_a_single_task(spark):
    rows = spark.createDataFrame([(i, (i * 7919) % 50) for i in range(300)], "id long, score long")
    got = {r.id: r["rank"] for r in timeline.ranked(rows, F.desc("score"), F.col("id").asc()).collect()}
    order = sorted(range(300), key=lambda i: (-((i * 7919) % 50), i))
    assert got == {i: n for n, i in enumerate(order, 1)}


def test_islands_over_borders(spark):
    numbers = [*range(0, 9), *range(11, 30), 40, 41, 63, 64, *range(-7, -2)]
    rows = spark.createDataFrame([(k, x) for k in ("a", "b") for x in numbers + ([100] if k == "b" else [])], "k string, x long")
    for width in (4, 1 << 16):
        got = sorted((r.k, r["first"], r["last"], r.n) for r in timeline.islands(rows, ["k"], F.col("x"), width).collect())
        want = [(k, a, z, z - a + 1) for k in ("a", "b") for a, z in [(-7, -3), (0, 8), (11, 29), (40, 41), (63, 64)]] + [("b", 100, 100, 1)]
        assert got == sorted(want)


def test_values_at_indices(spark):
    """Exact indices of groups of several sizes, with ties, nulls and a null key."""
    import random

    r = random.Random(5)
    groups = {"a": [r.randrange(40) * 0.5 for _ in range(4001)], "b": [1.0], "c": [3.0, 1.0], None: [r.random() for _ in range(999)]}
    rows = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in [*vs, None]], "k string, v double")
    got = {x.k: x for x in metrics.floor_percentiles(rows.where("v is not null"), ["k"], "v", {"p0": 0.0, "p50": 0.5, "p99": 0.99, "p100": 1.0}).collect()}
    stats = {x.k: x for x in metrics.metric_stats(rows, ["k"], "v").collect()}
    for k, vs in groups.items():
        vs = sorted(vs)
        assert [got[k][n] for n in ("p0", "p50", "p99", "p100")] == [vs[min(int(len(vs) * p), len(vs) - 1)] for p in (0, 0.5, 0.99, 1)]
        assert stats[k].n == len(vs) and abs(stats[k].median - (vs[(len(vs) - 1) // 2] + vs[len(vs) // 2]) / 2) < 1e-4
