"""Queries on answer measures, calendar helpers, vectors and counters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import answers, dates, queries, text, vectors
from ..operators import metrics, selection
from ..sources.tables import levels, memories, sql, table, turns
from .registry import query
from .texts import COS, QV, _vector


def _day():
    return F.col("source_date")


@query(sql("SELECT id, CASE WHEN id % 2 = 0 THEN lower(strftime(source_date, '%B %-d %Y')) ELSE content || ' more' END AS answer FROM m", "m"))
def date_aware_answer(s, d):
    prose = F.when(F.col("id") % 2 == 0, _day().cast("string")).otherwise(F.concat(F.lit("The "), "content", F.lit(", and more!")))
    return memories(s, d).select("id", answers.date_aware(prose).alias("answer"))


@query(sql("SELECT id, id % 3 <> 0 AS same FROM m", "m"))
def set_exact_match(s, d):
    a = F.concat(F.lit("The "), "content", F.lit(" of "), "entity")
    b = F.when(F.col("id") % 3 != 0, F.concat("entity", F.lit(", "), "content", F.lit(" of an "), "entity")).otherwise(F.col("content"))
    return memories(s, d).select("id", answers.set_exact(a, b).alias("same"))


TOKENS = r"chr(10) || array_to_string(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}\p{{M}}]+|[^\p{{L}}\p{{N}}\p{{M}}\p{{Z}}\p{{C}}]'), chr(10)) || chr(10)"


@query(sql(f"SELECT session, turn, contains({TOKENS.format('text')}, {TOKENS.format(chr(39) + 'of the' + chr(39))}) AS held FROM t", "t"))
def token_containment(s, d):
    return turns(s, d).select("session", "turn", answers.holds_tokens(F.col("text"), F.lit("of the")).alias("held"))


@query(sql("SELECT id, CASE WHEN id % 2 = 0 THEN content || chr(10) || chr(10) || entity ELSE content END AS body FROM m", "m"))
def summary_body(s, d):
    m = memories(s, d)
    raw = F.when(F.col("id") % 2 == 0, F.concat(F.lit("head\n\n"), "content", F.lit("\n\n"), "entity")).otherwise(F.col("content"))
    return m.select("id", answers.without_header(raw).alias("body"))


@query(sql("SELECT session, turn // 2 AS fragment, string_agg(speaker || ': ' || text, chr(10) ORDER BY turn) AS content FROM t GROUP BY 1, 2", "t"))
def two_turn_fragments(s, d):
    lines = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "speaker", "text").alias("line"))))  # two of them
    g = turns(s, d).groupBy("session", F.floor(F.col("turn") / 2).alias("fragment")).agg(lines.alias("l"))
    return g.select("session", "fragment", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("content"))


def _word_pairs(s, d):
    """The blank-separated words of each turn and of the next session's at the same turn."""
    split = lambda c: F.filter(F.split(F.lower(c), " "), lambda x: x != "")
    t = turns(s, d).select((F.col("session") * 100 + F.col("turn")).alias("id"), split(F.col("text")).alias("a"))
    return t.join(t.select((F.col("id") - 100).alias("id"), F.col("a").alias("b")), "id")


PAIR = ", w AS (SELECT session * 100 + turn AS id, list_filter(string_split(lower(text), ' '), lambda x: x <> '') AS a FROM t), p AS (SELECT x.id, x.a, y.a AS b FROM w x JOIN w y ON y.id = x.id + 100)\n"
COMMON = "CAST(coalesce(list_sum(list_transform(list_distinct({0}), lambda y: least(len(list_filter({0}, lambda z: z = y)), len(list_filter({1}, lambda z: z = y))))), 0) AS BIGINT)"
TWO = "list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1])"


@query(sql(PAIR + f""", g AS (SELECT *, {TWO.format('a')} AS a2, {TWO.format('b')} AS b2 FROM p), h AS (SELECT id, len(a) AS la, len(b) AS lb, {COMMON.format('a', 'b')} AS h1, {COMMON.format('a2', 'b2')} AS h2 FROM g)
SELECT id, round(CASE WHEN la = 0 OR h1 = 0 THEN 0 ELSE CASE WHEN la > lb THEN 1 ELSE exp(1 - lb / la) END * exp((ln(CASE WHEN h1 > 0 THEN h1 ELSE 0.1 END / greatest(la, 1)) + ln(CASE WHEN h2 > 0 THEN h2 ELSE 0.1 END / greatest(la - 1, 1))) / 2) END, 6) AS score FROM h""", "t"))  # fmt: skip
def bleu_2(s, d):
    return _word_pairs(s, d).select("id", F.round(answers.bleu(F.col("a"), F.col("b"), 2), 6).alias("score"))


@query(sql(PAIR + f", h AS (SELECT len(a) AS la, len(b) AS lb, {COMMON.format('a', 'b')} AS k, list_sum(list_transform(a, lambda x: length(x))) AS n FROM p) SELECT round(sum(k) / sum(la), 6) AS precision, round(sum(k) / sum(lb), 6) AS recall, round(2 * sum(k) / (sum(la) + sum(lb)), 6) AS f1, round(sum(n) / sum(la), 6) AS mean_length FROM h", "t"))
def corpus_scores(s, d):
    k, la, lb = text.multiset_common(F.col("a"), F.col("b")), F.size("a"), F.size("b")
    n = F.aggregate("a", F.lit(0), lambda x, y: x + F.length(y))
    p = _word_pairs(s, d).select(k.alias("k"), la.alias("la"), lb.alias("lb"), n.alias("n"))
    return p.agg(*[F.round(metrics.ratio(x, y), 6).alias(name) for name, x, y in (("precision", F.sum("k"), F.sum("la")), ("recall", F.sum("k"), F.sum("lb")), ("f1", 2 * F.sum("k"), F.sum("la") + F.sum("lb")), ("mean_length", F.sum("n"), F.sum("la")))])


@query(sql(PAIR + """, e AS (SELECT id, unnest(a) AS w, 1 AS x, 0 AS y FROM p UNION ALL SELECT id, unnest(b), 0, 1 FROM p), c AS (SELECT id, w, sum(x) AS x, sum(y) AS y FROM e GROUP BY id, w)
, v AS (SELECT id, x * i AS x, y * i AS y FROM (SELECT *, CASE WHEN x > 0 AND y > 0 THEN 1.0 ELSE ln(1.5) + 1 END AS i FROM c))
SELECT id, round(sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))), 6) AS cosine FROM v GROUP BY id HAVING sum(x) > 0 AND sum(y) > 0""", "t"))  # fmt: skip
def tfidf_cosine(s, d):
    p = _word_pairs(s, d)
    e = p.select("id", F.explode("a").alias("w"), F.lit(1).alias("x"), F.lit(0).alias("y")).union(p.select("id", F.explode("b"), F.lit(0), F.lit(1)))
    c = e.groupBy("id", "w").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    idf = F.when((F.col("x") > 0) & (F.col("y") > 0), 1.0).otherwise(F.log(F.lit(1.5)) + 1)
    v = c.select("id", (F.col("x") * idf).alias("x"), (F.col("y") * idf).alias("y"))
    dot, a, b = (F.sum(F.col(i) * F.col(j)) for i, j in (("x", "y"), ("x", "x"), ("y", "y")))
    return v.groupBy("id").agg(F.round(dot / (F.sqrt(a) * F.sqrt(b)), 6).alias("cosine"), F.sum("x").alias("_x"), F.sum("y").alias("_y")).where("_x > 0 AND _y > 0").drop("_x", "_y")


FULLTEXT = "(id % 11) / 10.0 * 0.6 + CASE WHEN id % 5 = 0 THEN 0.3 ELSE 0 END + (id % 7) / 10.0 * 0.2"


@query(sql(f"SELECT id, round(least(1.0, ({FULLTEXT}) * CASE entity WHEN 'click' THEN 1.0 WHEN 'view' THEN 0.9 WHEN 'error' THEN 0.7 ELSE 0.5 END), 6) AS score FROM m", "m"))
def fulltext_score(s, d):
    kind = F.when(F.col("entity") == "click", "exact").when(F.col("entity") == "view", "phrase").when(F.col("entity") == "error", "fuzzy").otherwise(F.col("entity"))
    return memories(s, d).select("id", F.round(answers.fulltext_score(F.col("id") % 11 / 10, F.col("id") % 5 == 0, F.col("id") % 7 / 10, kind), 6).alias("score"))


@query(sql("""SELECT session, turn, round(CASE WHEN session % 6 = 0 OR coalesce(length(text), 0) = 0 THEN 0 ELSE greatest(0.1, least(1.0, ((turn % 5) / 10.0 + 0.5) * 0.4 + least(1.0, session % 6 / 5.0) * 0.2
 + CASE WHEN length(text) < 10 THEN 0.5 WHEN length(text) > 500 THEN 0.9 ELSE 1.0 END * 0.1 + least(1.0, session % 4 / 3.0) * 0.15 + least(1.0, turn % 3 / 2.0) * 0.15)) END, 6) AS confidence FROM t""", "t"))  # fmt: skip
def answer_confidence(s, d):
    top = F.array(*[F.col("turn") % 5 / 10 + 0.5] * 3)
    return turns(s, d).select("session", "turn", F.round(answers.confidence(top, F.col("session") % 6, F.col("text"), F.col("session") % 4, F.col("turn") % 3), 6).alias("confidence"))


@query(sql("""SELECT id, id % 3 = 0 AS repeated, '{"content":"' || content || '","entity":"' || entity || '","id":' || CAST(id AS VARCHAR) || '}' AS canonical FROM m""", "m"))
def json_keys(s, d):
    raw = F.concat(F.lit('{"b":"'), "content", F.lit('",'), F.when(F.col("id") % 3 == 0, F.lit('"b"')).otherwise(F.lit('"a"')), F.lit(":1}"))
    return memories(s, d).select("id", answers.has_repeated_keys(raw).alias("repeated"), answers.canonical_json({c: F.col(c) for c in ("id", "entity", "content")}).alias("canonical"))


@query(sql("SELECT id, array_to_string(list_transform(list_filter(['domain:' || entity, 'by:' || speaker, 'domain:' || content], lambda x: starts_with(x, 'domain:')), lambda x: substr(x, 8)), ',') AS domains FROM m", "m"))
def tag_values(s, d):
    tags = F.array(F.concat(F.lit("domain:"), "entity"), F.concat(F.lit("by:"), "speaker"), F.concat(F.lit("domain:"), "content"))
    return memories(s, d).select("id", F.array_join(answers.tagged(tags, "domain:"), ",").alias("domains"))


@query(sql("SELECT id, 'id=' || CAST(id AS VARCHAR) || ' [' || CAST(source_date AS VARCHAR) || '] [' || type || '] (' || entity || ') ' || content || ' — ' || speaker AS line FROM m", "m"))
def row_lines(s, d):
    return memories(s, d).select("id", answers.formatted(F.col("id"), _day(), F.col("type"), F.col("entity"), F.col("content"), F.col("speaker")).alias("line"))


@query("""WITH o AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT DISTINCT strftime(d, '%G-W%V') AS period, 'week' AS kind, CAST(date_trunc('week', d) AS DATE) AS start FROM o UNION ALL SELECT DISTINCT strftime(d, '%Y-%m'), 'month', CAST(date_trunc('month', d) AS DATE) FROM o
UNION ALL SELECT DISTINCT strftime(d, '%Y'), 'year', CAST(date_trunc('year', d) AS DATE) FROM o UNION ALL SELECT * FROM (VALUES ('lifetime', 'lifetime', CAST(NULL AS DATE)), ('2024-13', NULL, NULL), ('2024-W54', NULL, NULL), ('', NULL, NULL))""")
def period_ids(s, d):
    o = table(s, d, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    forms = F.array(dates.iso_week(F.col("d")), F.date_format("d", "yyyy-MM"), F.date_format("d", "yyyy"))
    ids = o.select(F.explode(forms).alias("period")).distinct().union(s.createDataFrame([(x,) for x in ("lifetime", "2024-13", "2024-W54", "")], "period string"))
    return ids.select("period", dates.period_kind(F.col("period")).alias("kind"), dates.period_start(F.col("period")).alias("start"))


def _list(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


@query(f"""SELECT o_orderkey, {_list(dates.SEASONS)}[month(o_orderdate)] AS season, isodow(o_orderdate) < 6 AS workday, CASE o_custkey % 3 WHEN 0 THEN {_list(dates.CLIMATE['austin'])}[month(o_orderdate)] WHEN 1 THEN {_list(dates.CLIMATE['seattle'])}[month(o_orderdate)]
ELSE {_list(dates.SEASON_WEATHER[x] for x in dates.SEASONS)}[month(o_orderdate)] END AS weather FROM orders""")
def day_context(s, d):
    day = F.to_date("o_orderdate")
    city = F.when(F.col("o_custkey") % 3 == 0, "Austin, TX").when(F.col("o_custkey") % 3 == 1, " seattle").otherwise("Lima")
    return table(s, d, "orders").select("o_orderkey", dates.season(day).alias("season"), dates.is_workday(day).alias("workday"), dates.weather(day, city).alias("weather"))


@query("""SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) - DATE '1992-01-01' AS INT) + 1 AS number, CAST(o_orderdate AS DATE) AS again, CAST(date_trunc('week', o_orderdate) AS DATE) - 7 AS last_week, CAST(date_trunc('month', o_orderdate) - INTERVAL 1 MONTH AS DATE) AS last_month FROM orders""")
def day_numbers(s, d):
    day, start = F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date")
    n = dates.day_number(day, start)
    return table(s, d, "orders").select("o_orderkey", n.alias("number"), dates.day_date(n, start).alias("again"), dates.previous_week(day).alias("last_week"), dates.previous_month(day).alias("last_month"))


@query("SELECT o_orderkey, CAST(CASE o_orderkey % 3 WHEN 0 THEN CAST(o_orderdate AS DATE) WHEN 1 THEN last_day(CAST(o_orderdate AS DATE)) END AS DATE) AS latest FROM orders")
def latest_named_date(s, d):
    day = F.to_date("o_orderdate")
    prose = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("on 1990-05-06 and "), day.cast("string"), F.lit("."))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("In "), F.date_format(day, "MMMM yyyy"), F.lit(", after 1990-01-01"))).otherwise("no date")
    return table(s, d, "orders").select("o_orderkey", dates.latest_named(prose).alias("latest"))


RULES = {
    "constant": {"type": "constant", "value": "tea"},
    "weeks": {"type": "weekly_alternate", "values": ["run", "swim"]},
    "cycle": {"type": "n_day_cycle", "segments": [{"value": "a", "days": 2}, {"value": "b", "days": 1}, {"value": "a", "days": 1}]},
}


@query("""SELECT * FROM (VALUES ('constant', 'tea', 'always tea'), ('weeks', 'run,swim', 'a week each of run, swim'), ('cycle', 'a,b', 'in turn a for 2 days, b for 1 days, a for 1 days')) AS v(rule, "values", described)""")
def rule_catalogue(s, d):
    return s.createDataFrame([(k, ",".join(dates.rule_values(r)), dates.rule_text(r)) for k, r in RULES.items()], "rule string, values string, described string")


@query("SELECT o_orderkey, CASE WHEN n >= 0 THEN n // 7 % 2 END AS week_phase, CASE WHEN n >= 0 THEN CASE WHEN n % 4 < 2 THEN 0 WHEN n % 4 < 3 THEN 1 ELSE 2 END END AS cycle_phase FROM (SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) - DATE '1993-01-01' AS BIGINT) AS n FROM orders)")
def phase_keys(s, d):
    n = F.datediff(F.to_date("o_orderdate"), F.lit("1993-01-01").cast("date"))
    return table(s, d, "orders").select("o_orderkey", dates.phase_weekly(n, 2).alias("week_phase"), dates.phase_cycle(n, [("a", 2), ("b", 1), ("a", 1)]).alias("cycle_phase"))


@query(f"SELECT vec_id, round(score, 6) AS score FROM (SELECT vec_id, {COS} AS score FROM embeddings, {QV} WHERE vec_id % 3 = 0) WHERE score >= 0.1 ORDER BY score DESC, vec_id LIMIT 50")
def filtered_search(s, d):
    found = vectors.knn(table(s, d, "embeddings").where("vec_id % 3 = 0"), _vector(s, d), 50, vectors.cosine, "desc").where("score >= 0.1")
    return found.select("vec_id", F.round("score", 6).alias("score"))


@query(f"SELECT vec_id, round(greatest(0.0, least(1.0, {COS})), 6) AS similarity FROM embeddings JOIN (SELECT vec_id - 1 AS vec_id, embedding AS q FROM embeddings) USING (vec_id)")
def pair_similarity(s, d):
    e = table(s, d, "embeddings").select("vec_id", "embedding")
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("q")), "vec_id")
    return pairs.select("vec_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), vectors.cosine(F.col("embedding"), F.col("q")))), 6).alias("similarity"))


@query(f"""WITH h AS (SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN 'L2' ELSE 'L1' END AS level, {COS} AS score FROM embeddings, {QV})
SELECT vec_id, level, round(score * CASE level WHEN 'L1' THEN 1.0 ELSE 0.8 END, 6) AS weighted FROM (SELECT *, row_number() OVER (PARTITION BY level ORDER BY score DESC, vec_id) AS n FROM h) WHERE n <= CASE level WHEN 'L1' THEN 10 ELSE 3 END""")
def level_search(s, d):
    e = table(s, d, "embeddings").withColumn("level", F.when(F.col("vec_id") % 4 == 0, "L2").otherwise("L1"))
    q, out = _vector(s, d), None
    for level, k in (("L1", 10), ("L2", 3)):
        best = vectors.knn(e.where(F.col("level") == level), q, k, vectors.cosine, "desc").select("vec_id", F.lit(level).alias("level"), F.round(F.col("score") * queries.LEVEL_WEIGHTS[level], 6).alias("weighted"))
        out = best if out is None else out.unionByName(best)
    return out


@query(sql("SELECT id FROM m WHERE id % 4 <> 0 AND id % 5 <> 0", "m"))
def valid_hits(s, d):
    hits = memories(s, d).select("id", F.when(F.col("id") % 4 != 0, F.col("content")).alias("content"), F.when(F.col("id") % 5 == 0, -0.1).otherwise(0.5).alias("score"))
    return selection.valid_hits(hits).select("id")


@query("WITH v AS (SELECT event_type, user_id % 3 AS trigger, CAST(event_id % 97 AS BIGINT) AS tokens FROM events) SELECT event_type, trigger, CAST(sum(tokens) AS BIGINT) AS total, round(avg(tokens), 4) AS mean, median(tokens) AS median, min(tokens) AS least, max(tokens) AS most, round(stddev_samp(tokens), 4) AS deviation FROM v GROUP BY CUBE (event_type, trigger)")
def token_stats(s, d):
    e = table(s, d, "events").select("event_type", (F.col("user_id") % 3).alias("trigger"), (F.col("event_id") % 97).cast("long").alias("tokens"))
    return metrics.token_stats(e, ["event_type", "trigger"], "tokens")


RANKED = "WITH r AS (SELECT {k}, {v} AS v, row_number() OVER (PARTITION BY {k} ORDER BY {v}) - 1 AS i, count(*) OVER (PARTITION BY {k}) AS n FROM {t})"
AT = "max(CASE WHEN i = least(CAST(floor(n * {0}) AS BIGINT), n - 1) THEN v END)"


@query(RANKED.format(k="user_id", v="value", t="events WHERE value IS NOT NULL") + f" SELECT user_id, count(*) AS n, round(sum(v), 4) AS total, round(avg(v), 4) AS mean, {AT.format(0.95)} AS p95, {AT.format(0.99)} AS p99, max(v) AS max FROM r GROUP BY user_id")
def latency_tail(s, d):
    return metrics.floor_percentiles(table(s, d, "events").where("value IS NOT NULL"), ["user_id"], "value", {"p95": 0.95, "p99": 0.99})


@query(RANKED.format(k="o_orderpriority", v="o_totalprice", t="orders") + f", c AS (SELECT o_orderpriority, CAST(sum(o_custkey) AS BIGINT) AS tokens FROM orders GROUP BY 1) SELECT o_orderpriority AS step, n, mean, p50, p95, tokens, CAST(round(tokens / n) AS BIGINT) AS tokens_per_item FROM (SELECT o_orderpriority, count(*) AS n, round(avg(v), 2) AS mean, {AT.format(0.5)} AS p50, {AT.format(0.95)} AS p95 FROM r GROUP BY 1) JOIN c USING (o_orderpriority)")
def cost_summary(s, d):
    o = table(s, d, "orders")
    p = metrics.floor_percentiles(o, ["o_orderpriority"], "o_totalprice", {"p50": 0.5, "p95": 0.95}).withColumn("mean", F.round("mean", 2))
    tokens = o.groupBy("o_orderpriority").agg(F.sum("o_custkey").alias("tokens"))
    return p.join(tokens, "o_orderpriority").select(F.col("o_orderpriority").alias("step"), "n", "mean", "p50", "p95", "tokens", F.round(F.col("tokens") / F.col("n")).cast("long").alias("tokens_per_item"))


@query(sql(", c AS (SELECT parent, count(*) AS n FROM l WHERE parent IS NOT NULL GROUP BY parent) SELECT level, count(*) AS nodes, round(avg(coalesce(n, 0)), 6) AS mean_fan_in, CAST(max(coalesce(n, 0)) AS BIGINT) AS most, round(avg(CASE WHEN n IS NULL THEN 1.0 ELSE 0 END), 6) AS childless FROM l LEFT JOIN c ON c.parent = l.id GROUP BY level", "l"))
def fan_in(s, d):
    l = levels(s, d)  # noqa: E741
    below = l.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    return l.join(below, "id", "left").groupBy("level").agg(F.count(F.lit(1)).alias("nodes"), F.round(F.avg(n), 6).alias("mean_fan_in"), F.max(n).cast("long").alias("most"), F.round(F.avg(F.when(F.col("n").isNull(), 1.0).otherwise(0.0)), 6).alias("childless"))


@query(sql("SELECT entity, type, count(*) AS n, round(avg(CAST(id % 101 AS DOUBLE)), 4) AS mean_score FROM m GROUP BY GROUPING SETS ((entity), (entity, type), ())", "m"))
def scores_at_levels(s, d):
    m = memories(s, d).withColumn("score", (F.col("id") % 101).cast("double"))
    g = m.groupingSets([[F.col("entity")], [F.col("entity"), F.col("type")], []], F.col("entity"), F.col("type"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 4).alias("mean_score"))


@query(sql(", c AS (SELECT id, unnest(CASE WHEN id % 3 = 0 THEN [] ELSE [entity, type] END) AS tool FROM m) SELECT tool, count(*) AS calls, count(DISTINCT id) AS questions, round(count(*) / (SELECT count(*) FROM m), 6) AS per_question FROM c GROUP BY tool", "m"))
def tool_calls(s, d):
    m = memories(s, d)
    calls = F.when(F.col("id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("entity", "type"))
    total = m.agg(F.count(F.lit(1)).alias("total"))
    g = m.select("id", F.explode(calls).alias("tool")).groupBy("tool").agg(F.count(F.lit(1)).alias("calls"), F.countDistinct("id").alias("questions"))
    return g.crossJoin(F.broadcast(total)).select("tool", "calls", "questions", F.round(F.col("calls") / F.col("total"), 6).alias("per_question"))  # one row


@query(sql("SELECT type, entity, count(*) AS n, round(avg(CASE WHEN (id % 3 = 0) = (id % 2 = 0) THEN 1.0 ELSE 0 END), 6) AS agreement FROM m GROUP BY type, entity", "m"))
def agreement_by_kind(s, d):
    same = ((F.col("id") % 3 == 0) == (F.col("id") % 2 == 0)).cast("double")
    return memories(s, d).groupBy("type", "entity").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(same), 6).alias("agreement"))


@query(sql("SELECT entity, count(*) AS n, round(count(*) / (SELECT count(*) FROM m WHERE entity <> 'error'), 6) AS share FROM m WHERE entity <> 'error' GROUP BY entity", "m"))
def category_shares(s, d):
    return metrics.share_of_total(memories(s, d).where("entity <> 'error'").withColumn("one", F.lit(1)), "entity", "one").select("entity", F.col("part").cast("long").alias("n"), "share")


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey) AS INT) AS place FROM orders")
def events_by_parsed_date(s, d):
    day = F.to_date("o_orderdate")
    o = table(s, d, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 2 == 0, F.date_format(day, "dd MMMM, yyyy")).otherwise(F.date_format(day, "MMMM dd, yyyy")).alias("named"))
    parsed = F.coalesce(F.try_to_date("named", "dd MMMM, yyyy"), F.try_to_date("named", "MMMM dd, yyyy"))
    return o.select("o_orderkey", "o_custkey", parsed.alias("day")).select("o_orderkey", "day", F.row_number().over(Window.partitionBy("o_custkey").orderBy("day", "o_orderkey")).alias("place"))


# Prices of a million tokens (input, output).
PRICES = {"small": (0.15, 0.6), "large": (2.5, 10.0)}


@query(sql("SELECT id, round(CASE id % 3 WHEN 0 THEN (id * 0.15 + id % 50 * 0.6) / 1000000 WHEN 1 THEN (id * 2.5 + id % 50 * 10.0) / 1000000 END, 9) AS cost FROM m", "m"))
def model_cost(s, d):
    model = F.when(F.col("id") % 3 == 0, "small").when(F.col("id") % 3 == 1, "large").otherwise("other")
    return memories(s, d).select("id", F.round(queries.cost(model, F.col("id"), F.col("id") % 50, PRICES), 9).alias("cost"))


@query(sql("""SELECT id, round(greatest(0.0, least(1.0, (id % 10) / 10.0 * (1 + CASE WHEN content = 'v1' THEN 0.05 ELSE 0 END + CASE WHEN type = 'fact' THEN 0.08 ELSE 0 END + CASE WHEN id % 4 >= 3 THEN 0.08 WHEN id % 4 = 2 THEN 0.05 ELSE 0 END + 0.02) * (1 - id % 5 / 10.0))), 6) AS score FROM m""", "m"))
def final_ranking(s, d):
    category = F.when(F.col("type") == "fact", "factual").otherwise("detailed")
    score = queries.final_rank_score(F.col("id") % 10 / 10, F.lit("was v1"), F.col("content"), F.lit("L2"), category, F.col("id") % 4, F.lit(0.02), F.col("id") % 5 / 10)
    return memories(s, d).select("id", F.round(score, 6).alias("score"))


PLAIN = r"regexp_replace(lower({0}), '[^a-z0-9 ]', '{1}', 'g')"


@query(sql("SELECT id, content || ' s of ' || entity AS lower_first, content || ' s of and ' || entity AS spaced FROM m", "m"))
def normalised_variants(s, d):
    prose = F.concat(F.lit("The "), "content", F.lit("'s of, AND  "), "entity", F.lit("!"))
    # Without the apostrophe the first joins the s, so a blank stands before it here.
    spaced = F.regexp_replace(prose, "'s", " 's")
    return memories(s, d).select("id", text.normalize_answer_lower_first(spaced).alias("lower_first"), text.normalize_answer_spaced(prose).alias("spaced"))


@query(sql("SELECT id, id % 2 = 0 AS dated, CAST(CASE WHEN id % 2 = 0 THEN 1.0 ELSE 0.5 END AS DOUBLE) AS mean_of_best FROM m", "m"))
def graded_answers(s, d):
    """The date branch of the strict check, and the score of answers with several parts (category 1)."""
    prose = F.concat(F.lit("On "), F.date_format(_day(), "MMM d, yyyy"), F.lit("."))
    accept = F.array(F.when(F.col("id") % 2 == 0, _day()).otherwise(F.date_add(_day(), 1)).cast("string"))
    given = F.when(F.col("id") % 2 == 0, F.concat("entity", F.lit(", "), "content")).otherwise(F.col("content"))
    wanted = F.concat("content", F.lit(", "), "entity")
    return memories(s, d).select("id", text.strict_check(prose, accept, F.lit("date_exact")).alias("dated"), F.round(text.score_answer(given, wanted, F.lit(1)), 6).alias("mean_of_best"))
