"""Queries on question families, probes, checks, incremental runs and joins of evidence."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates
from ..operators import hierarchy, metrics, questions, selection, timeline
from ..sources import loaders
from ..sources.tables import levels, memories, sql, table, turns
from .registry import query
from .timelines import KEYS

FOUND = """, tr AS (SELECT *, row_number() OVER w AS rn, lag(content) OVER w AS before FROM m WINDOW w AS (PARTITION BY speaker, entity ORDER BY source_date, id))
, ph AS (SELECT speaker, entity, CAST(row_number() OVER w AS INT) AS n, content AS value, source_date AS start, coalesce(CAST(lead(source_date) OVER w - 1 AS DATE), DATE '2024-01-31') AS stop FROM tr WHERE rn = 1 OR content IS DISTINCT FROM before WINDOW w AS (PARTITION BY speaker, entity ORDER BY source_date, id))
"""


def _end():
    return F.lit("2024-01-31").cast("date")


def _phases(s, d):
    return questions.phases(memories(s, d), KEYS, _end())


@query(sql(", q AS (SELECT DISTINCT a.id, a.source_date AS day, b.source_date AS near FROM m a JOIN m b ON a.speaker = b.speaker AND a.entity = b.entity AND a.content = b.content AND b.source_date <= a.source_date) SELECT id, day, near FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY day - near, near) AS k FROM q) WHERE k <= 3", "m"))
def nearest_mentions(s, d):
    m = memories(s, d)
    keys = [*KEYS, "content"]
    return questions.nearest_mentions(m.select("id", *keys, F.col("source_date").alias("day")), m.select(*keys, F.col("source_date").alias("day")), keys)


@query(sql(FOUND + "SELECT speaker, entity, n, value, count(DISTINCT source_date) AS evidence FROM ph JOIN (SELECT speaker, entity, content, source_date FROM m) e USING (speaker, entity) WHERE source_date BETWEEN start AND stop AND content = value GROUP BY ALL", "m"))
def recall_questions(s, d):
    """What the value was in each phase, with the number of days that give evidence."""
    return questions.phase_evidence(memories(s, d), KEYS)


@query(sql(FOUND + "SELECT speaker, entity, n, old, value AS new, start AS changed_on FROM (SELECT *, lag(value) OVER (PARTITION BY speaker, entity ORDER BY n) AS old FROM ph) WHERE n > 1", "m"))
def change_questions(s, d):
    return questions.change_questions(_phases(s, d), KEYS)


@query(sql(FOUND + "SELECT speaker, entity, n, value, CAST(stop - start AS INT) + 1 AS days FROM ph WHERE stop < DATE '2024-01-31'", "m"))
def duration_questions(s, d):
    return questions.duration_questions(_phases(s, d), KEYS, _end())


@query(sql(FOUND + """, x AS (SELECT *, lag(value) OVER w AS a, lead(value) OVER w AS b FROM ph WINDOW w AS (PARTITION BY speaker, entity ORDER BY n))
SELECT speaker, entity, n, value, CASE WHEN b IS NOT NULL AND a IS NOT DISTINCT FROM b AND CAST(stop - start AS INT) + 1 <= 2 THEN 'exception' ELSE 'shift' END AS kind FROM x WHERE n > 1""", "m"))
def shift_or_exception(s, d):
    return questions.shift_or_exception(_phases(s, d), KEYS, 2)


@query(sql(FOUND + ", q AS (SELECT id, speaker, entity, CAST(source_date + 5 AS DATE) AS viewpoint FROM m) SELECT id, viewpoint, value FROM q JOIN ph USING (speaker, entity) WHERE viewpoint BETWEEN start AND stop", "m"))
def at_viewpoint(s, d):
    asked = memories(s, d).select("id", *KEYS, F.date_add("source_date", 5).alias("viewpoint"))
    return questions.at_viewpoint(asked, _phases(s, d), KEYS)


PROBES = """, q AS (SELECT o_orderkey AS id, o_orderpriority AS family, CAST(o_orderdate AS DATE) + 10 AS available FROM orders)
, pr AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS probe, last_day(CAST(o_orderdate AS DATE)) AS day FROM orders)
, i AS (SELECT id, min(probe) AS probe FROM q JOIN pr ON day >= available GROUP BY id)
"""


def _probe_tables(s, d):
    o = table(s, d, "orders")
    day = F.to_date("o_orderdate")
    asked = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("family"), F.date_add(day, 10).alias("available"))
    return asked, o.select(F.trunc(day, "month").alias("probe"), F.last_day(day).alias("day")).distinct()


@query("WITH " + PROBES[2:] + "SELECT id, probe FROM i")
def probe_introduction(s, d):
    return questions.introduced(*_probe_tables(s, d))


@query("WITH " + PROBES[2:] + """, c AS (SELECT probe, count(*) AS c FROM i GROUP BY probe), sh AS (SELECT probe, c, 200 * c / CAST(sum(c) OVER () AS DOUBLE) AS q FROM c), fl AS (SELECT probe, c, q, floor(q) AS f FROM sh)
, qu AS (SELECT probe, least(c, f + CASE WHEN row_number() OVER (ORDER BY q - f DESC, probe) <= 200 - (SELECT sum(f) FROM fl) THEN 1 ELSE 0 END) AS quota FROM fl)
, t AS (SELECT i.probe, i.id, family, row_number() OVER (PARTITION BY i.probe, family ORDER BY i.id) AS t FROM i JOIN q ON q.id = i.id), r AS (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY t, family, id) AS n FROM t)
SELECT r.probe, r.id FROM r JOIN qu ON qu.probe = r.probe WHERE n <= quota""")
def monthly_probes(s, d):
    asked, probes = _probe_tables(s, d)
    found = questions.introduced(asked, probes).join(asked.select("id", "family"), "id")
    return questions.probe_budget(found, 200)


@query(sql(""", q AS (SELECT speaker AS "user", source_date AS day, id, row_number() OVER (PARTITION BY speaker ORDER BY source_date, id) AS n FROM m), d AS (SELECT "user", day, (SELECT count(*) FROM q b WHERE b."user" = a."user" AND b.day < a.day) AS size FROM (SELECT DISTINCT "user", day FROM q) a)
SELECT d."user", d.day, q.id FROM d JOIN q ON q."user" = d."user" AND q.n = 1 + CAST(('0x' || substr(sha256('7|' || d."user" || '|' || CAST(d.day AS VARCHAR)), 1, 12)) AS HUGEINT) % d.size WHERE size > 0""", "m"))  # fmt: skip
def daily_question(s, d):
    m = memories(s, d).select(F.col("speaker").alias("user"), F.col("source_date").alias("day"), "id")
    return questions.daily_question(m.select("user", "day").distinct(), m.select("user", "id", F.col("day").alias("available")), "7")


@query(sql("SELECT id, unnest(list_filter([CASE WHEN source_date NOT BETWEEN DATE '2024-01-03' AND DATE '2024-01-28' THEN 'date in range' END, CASE WHEN content = 'v2' THEN 'known value' END, CASE WHEN entity = 'error' AND id % 2 = 0 THEN 'odd errors' END], lambda x: x IS NOT NULL)) AS rule FROM m", "m"))
def invariant_checks(s, d):
    ok = {"date in range": F.col("source_date").between("2024-01-03", "2024-01-28"), "known value": F.col("content").isin("v0", "v1"), "odd errors": (F.col("entity") != "error") | (F.col("id") % 2 == 1)}
    return questions.rule_violations(memories(s, d), ok)


@query()
def diverse_questions(s, d):
    m = memories(s, d).select("entity", "id", "type", "content", "speaker")
    return questions.diverse_pick(m, "entity", 12, ["content", "speaker"])


@query(sql(", log AS (SELECT source_date AS month, id, CASE id % 4 WHEN 0 THEN 'build_started' WHEN 1 THEN 'build_ended' WHEN 2 THEN 'evaluated' ELSE 'failed' END AS event FROM m) SELECT month, CASE arg_max(event, id) WHEN 'build_started' THEN 'building' WHEN 'build_ended' THEN 'evaluating' WHEN 'evaluated' THEN 'done' ELSE 'idle' END AS state FROM log GROUP BY month", "m"))
def run_states(s, d):
    event = F.element_at(F.array(*map(F.lit, ("build_started", "build_ended", "evaluated", "failed"))), (F.col("id") % 4 + 1).cast("int"))
    return questions.barrier_states(memories(s, d).select(F.col("source_date").alias("month"), event.alias("event"), F.col("id").alias("at")))


@query(sql(", b AS (SELECT id, CASE WHEN id % 10 = 0 THEN content || '!' ELSE content END AS payload FROM m WHERE id % 3 <> 0) SELECT id, CASE WHEN id % 4 <> 0 THEN 'new' WHEN id % 10 = 0 THEN 'conflict' ELSE 'known' END AS state FROM b", "m"))
def session_adds(s, d):
    """What adding sessions again does: rows of an unknown key are new, of a known one known, or in conflict with another payload."""
    m = memories(s, d)
    batch = m.where("id % 3 <> 0").select("id", F.when(F.col("id") % 10 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")).alias("payload"))
    return loaders.add_states(batch, m.where("id % 4 = 0").select("id", F.col("content").alias("payload")), "id", "payload")


@query(sql(", x AS (SELECT source_date AS day FROM m WHERE id % 7 = 0) SELECT DISTINCT 1 AS layer, 'week:' || CAST(CAST(date_trunc('week', day) AS DATE) AS VARCHAR) AS period FROM x UNION SELECT 2, 'month:' || strftime(day, '%Y-%m') FROM x UNION SELECT 3, 'year:' || strftime(day, '%Y') FROM x UNION SELECT 4, 'lifetime' FROM x", "m"))
def dirty_cascade(s, d):
    return hierarchy.cascade(memories(s, d).where("id % 7 = 0"), "source_date")


HASHED = "substr(sha256(CAST(count(*) AS VARCHAR) || ':' || CAST(sum(CAST(('0x' || substr(h, 1, 12)) AS HUGEINT)) AS VARCHAR) || ':' || CAST(sum(CAST(('0x' || substr(h, 13, 12)) AS HUGEINT)) AS VARCHAR)), 1, 16)"


@query("WITH h AS (SELECT strftime(o_orderdate, '%Y-%m') AS period, sha256(concat_ws(chr(31), CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR))) AS h FROM orders) SELECT period, " + HASHED + " AS source_hash, count(*) AS n FROM h GROUP BY period")
def run_identity(s, d):
    """The hash of each month's input, by which a run knows whether it goes on with the same one."""
    return metrics.source_hash(table(s, d, "orders"), F.date_format("o_orderdate", "yyyy-MM"), ["o_custkey"], ["o_orderkey"])


@query(sql("SELECT source_date AS day, count(*) AS n, CAST(sum(count(*)) OVER (ORDER BY source_date) AS BIGINT) AS stored, CAST(row_number() OVER (ORDER BY source_date) AS INT) AS batch FROM m GROUP BY source_date", "m"))
def day_batches(s, d):
    """Batches of one day each in the order of their dates, and what the store holds behind each."""
    g = memories(s, d).groupBy(F.col("source_date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("day")  # a row for each day
    return g.select("day", "n", F.sum("n").over(w).alias("stored"), F.row_number().over(w).alias("batch"))


@query(sql(", b AS (SELECT *, row_number() OVER (PARTITION BY entity, lower(content), source_date ORDER BY id) AS k FROM m WHERE id % 2 = 1), s AS (SELECT DISTINCT entity, lower(content) AS c, source_date FROM m WHERE id % 2 = 0) SELECT count(*) AS received, count(*) FILTER (WHERE k > 1) AS repeated, count(*) FILTER (WHERE k = 1 AND s.c IS NOT NULL) AS stored_before, count(*) FILTER (WHERE k = 1 AND s.c IS NULL) AS added FROM b LEFT JOIN s ON s.entity = b.entity AND s.c = lower(b.content) AND s.source_date = b.source_date", "m"))
def ingest_report(s, d):
    m = memories(s, d)
    keys = ["entity", "_c", "source_date"]
    lower = m.withColumn("_c", F.lower("content"))
    return timeline.ingest_report(lower.where("id % 2 = 1"), lower.where("id % 2 = 0"), keys)


@query(sql("SELECT entity, content, source_date, count(*) AS copies FROM m GROUP BY ALL HAVING count(*) > 1", "m"))
def plain_append(s, d):
    """What appending without a check leaves more than once."""
    return memories(s, d).groupBy("entity", "content", "source_date").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


@query(sql("SELECT a.id, b.content AS earlier, b.source_date AS earlier_date FROM m a JOIN m b ON b.id = a.id - 7", "m"))
def historical_join(s, d):
    m = memories(s, d)
    return hierarchy.historical(m.select("id", (F.col("id") - 7).alias("earlier_id")), m)


@query(sql(", p AS (SELECT speaker, row_number() OVER (PARTITION BY speaker ORDER BY id) - 1 AS i, id FROM m), s AS (SELECT speaker, row_number() OVER (PARTITION BY speaker ORDER BY id) - 1 AS i, CAST(id % 101 AS DOUBLE) / 100 AS f1 FROM m WHERE id % 3 <> 0) SELECT p.id, f1 FROM p JOIN s USING (speaker, i)", "m"))
def stored_scores(s, d):
    """Predictions with the scores stored under the same sample and place."""
    m = memories(s, d)
    place = lambda x: x.withColumn("i", F.row_number().over(Window.partitionBy("speaker").orderBy("id")))
    stored = place(m.where("id % 3 <> 0")).select("speaker", "i", (F.col("id") % 101 / 100).alias("f1"))
    return place(m.select("id", "speaker")).join(stored, ["speaker", "i"]).select("id", "f1")


@query(sql("SELECT q.id, c.period AS checkpoint FROM (SELECT id, period FROM l WHERE level = 'L4') q JOIN (SELECT period FROM l WHERE level = 'L5') c ON date_trunc('month', q.period) <= c.period", "l"))
def question_checkpoints(s, d):
    l = levels(s, d)  # noqa: E741
    months = l.where("level = 'L5'").select(F.col("period").alias("checkpoint"))
    asked = l.where("level = 'L4'").select("id", F.trunc("period", "month").alias("month"))
    return asked.join(F.broadcast(months), F.col("month") <= F.col("checkpoint")).select("id", "checkpoint")  # months: a few for each year


@query(sql("SELECT speaker, source_date, array_to_string(list(CAST(n AS VARCHAR)) OVER (PARTITION BY speaker ORDER BY source_date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), ',') AS earlier FROM (SELECT speaker, source_date, count(*) AS n FROM m GROUP BY ALL) QUALIFY earlier IS NOT NULL", "m"))
def latest_three(s, d):
    g = memories(s, d).groupBy("speaker", "source_date").agg(F.count(F.lit(1)).cast("string").alias("n"))
    w = Window.partitionBy("speaker").orderBy("source_date").rowsBetween(-3, -1)
    return g.select("speaker", "source_date", F.array_join(F.collect_list("n").over(w), ",").alias("earlier")).where("earlier <> ''")


@query(sql("SELECT speaker, content, source_date, id, score FROM (SELECT *, (id % 13) / 10.0 + (id % 5) / 100.0 AS score, row_number() OVER (PARTITION BY speaker, content, source_date ORDER BY (id % 13) / 10.0 + (id % 5) / 100.0 DESC, id) AS n FROM m) WHERE n = 1", "m"))
def best_of_each(s, d):
    m = memories(s, d).withColumn("score", F.col("id") % 13 / 10 + F.col("id") % 5 / 100)
    best = m.groupBy("speaker", "content", "source_date").agg(F.max_by(F.struct("id", "score"), F.struct("score", (-F.col("id")).alias("i"))).alias("b"))
    return best.select("speaker", "content", "source_date", "b.id", "b.score")


@query(sql("SELECT entity, id FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY sha256(CAST(id AS VARCHAR)), id) AS n, count(*) OVER (PARTITION BY entity) AS c FROM m) WHERE n <= ceil(c * 0.05)", "m"))
def proportional_sample(s, d):
    return selection.proportional(memories(s, d).select("entity", "id"), "entity", 0.05, F.conv(F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 13), 16, 10).cast("long"))


@query(sql("SELECT id, entity FROM m WHERE entity IN ('click', 'signup')", "m"))
def categories_by_id(s, d):
    return memories(s, d).where(F.col("entity").isin("click", "signup")).select("id", "entity")


@query(sql("SELECT id FROM m WHERE speaker = 'user_3'", "m"))
def tenant_rows(s, d):
    m = memories(s, d).withColumn("user_id", F.col("speaker"))
    return selection.of_tenant(m, "user_3").select("id").unionByName(selection.of_tenant(m, None).select("id"))


@query(sql("SELECT id FROM m WHERE source_date > DATE '2024-01-03' AND id % 5 <> 0", "m"))
def eligible_questions(s, d):
    named = F.when(F.col("id") % 5 == 0, F.array(F.lit("2024-03-01").cast("date"))).otherwise(F.array().cast("array<date>"))
    asked = memories(s, d).withColumn("evidence_days", F.array(F.lit(1), F.lit(3)))
    return selection.eligible(asked, dates.day_number(F.col("source_date"), F.lit("2024-01-01").cast("date")), F.lit("2024-02-01").cast("date"), named).select("id")


@query(sql("SELECT session, turn FROM t WHERE NOT contains('the first words of a context', substr(text, 1, 4))", "t"))
def outside_context(s, d):
    return selection.not_in_context(turns(s, d).withColumn("content", F.col("text")), "the first words of a context", 4).select("session", "turn")


@query(sql(", k AS (SELECT entity AS layer, source_date AS start, id % 7 = 0 AS force_update, id AS arrival FROM m) SELECT layer, start, force_update, arrival FROM (SELECT *, row_number() OVER (PARTITION BY layer, start ORDER BY force_update DESC, arrival) AS n FROM k) WHERE n = 1", "m"))
def tasks_once(s, d):
    tasks = memories(s, d).select(F.col("entity").alias("layer"), F.col("source_date").alias("start"), (F.col("id") % 7 == 0).alias("force_update"), F.col("id").alias("arrival"))
    return selection.tasks_once(tasks)


@query(sql("SELECT id, level, CAST(CASE level WHEN 'L4' THEN period + 6 WHEN 'L5' THEN last_day(period) ELSE period END AS DATE) AS fin FROM l WHERE level IN ('L3', 'L4', 'L5') ORDER BY fin, level, id LIMIT 500", "l"))
def interleaved_tasks(s, d):
    l = levels(s, d).where("level IN ('L3', 'L4', 'L5')")  # noqa: E741
    return selection.interleaved(l.select("id", "level", hierarchy.period_end(F.col("level"), F.col("period")).alias("fin"))).limit(500)


@query(sql(", h AS (SELECT id, entity AS level, speaker AS session, CAST(id % 89 AS DOUBLE) AS score FROM m), r AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY score DESC, id) AS a, row_number() OVER (PARTITION BY session ORDER BY score DESC, id) AS b FROM h) SELECT id, CASE WHEN a = 1 THEN 1 WHEN b = 1 THEN 2 ELSE 3 END AS round FROM r ORDER BY round, score DESC, id LIMIT 40", "m"))
def diversity_rounds(s, d):
    h = memories(s, d).select("id", F.col("entity").alias("level"), F.col("speaker").alias("session"), (F.col("id") % 89).cast("double").alias("score"))
    return selection.level_then_session(h, 40).select("id", "round")


@query(sql(", r AS (SELECT 'fact:' || CAST(id AS VARCHAR) AS ref, 'fact' AS kind FROM m WHERE type = 'fact' UNION ALL SELECT DISTINCT 'speaker:' || speaker, 'speaker' FROM m UNION ALL SELECT DISTINCT 'domain:' || entity, 'domain' FROM m), c AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'fact:' || CAST(id AS VARCHAR) ELSE 'domain:' || entity END AS cause FROM m) SELECT id, cause FROM c WHERE cause NOT IN (SELECT ref FROM r)", "m"))
def unknown_causes(s, d):
    """Causes that no reference of any kind stands for."""
    m = memories(s, d)
    named = lambda kind, c: F.concat(F.lit(f"{kind}:"), c).alias("ref")
    registry = {"fact": m.where("type = 'fact'").select(named("fact", F.col("id").cast("string"))), "speaker": m.select(named("speaker", F.col("speaker"))).distinct(), "domain": m.select(named("domain", F.col("entity"))).distinct()}
    causes = m.select("id", F.when(F.col("id") % 3 == 0, F.concat(F.lit("fact:"), F.col("id").cast("string"))).otherwise(F.concat(F.lit("domain:"), "entity")).alias("cause"))
    return causes.join(timeline.registry(registry), causes["cause"] == F.col("ref"), "left_anti")


EDGES = ", e AS (SELECT id AS src, parent AS dst, level AS kind FROM l WHERE parent IS NOT NULL)\n"


def _edges(s, d):
    return levels(s, d).where("parent IS NOT NULL").select(F.col("id").alias("src"), F.col("parent").alias("dst"), F.col("level").alias("kind"))


@query(sql(EDGES + "SELECT src, dst FROM e WHERE kind = 'L3'", "l"))
def edges_of_kind(s, d):
    return hierarchy.edges_where(_edges(s, d), kind="L3").select("src", "dst")


@query(sql(EDGES + "SELECT id, CAST(sum(o) AS BIGINT) AS outgoing, CAST(sum(i) AS BIGINT) AS incoming FROM (SELECT src AS id, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY id", "l"))
def node_degrees(s, d):
    return hierarchy.degrees(_edges(s, d))


@query(sql(", x AS (SELECT session, 1 + session % 3 AS attempts, session % 4 <> 0 AS passed, count(*) AS turns FROM t GROUP BY session) SELECT count(*) AS sessions, count(*) FILTER (WHERE passed AND attempts = 1) AS first_try, count(*) FILTER (WHERE passed) AS passed, round(avg(attempts), 2) AS mean_attempts, round(avg(turns), 1) AS mean_turns FROM x", "t"))
def fidelity(s, d):
    x = turns(s, d).groupBy("session").agg(F.count(F.lit(1)).alias("turns")).withColumns({"attempts": 1 + F.col("session") % 3, "passed": F.col("session") % 4 != 0})
    return metrics.fidelity(x)


@query(sql(", x AS (SELECT DISTINCT session, unnest(CASE session % 3 WHEN 0 THEN [] WHEN 1 THEN ['leak: v1'] ELSE ['leak: v2', 'absent: v0'] END) AS f FROM t) SELECT split_part(f, ':', 1) AS failure, count(*) AS n FROM x GROUP BY 1", "t"))
def failure_kinds(s, d):
    sessions = turns(s, d).select("session").distinct()
    f = F.when(F.col("session") % 3 == 1, F.array(F.lit("leak: v1"))).when(F.col("session") % 3 == 2, F.array(F.lit("leak: v2"), F.lit("absent: v0"))).otherwise(F.array().cast("array<string>"))
    return sessions.select(F.explode(f).alias("f")).groupBy(F.split_part("f", F.lit(":"), F.lit(1)).alias("failure")).agg(F.count(F.lit(1)).alias("n"))


@query(sql(", s AS (SELECT DISTINCT session FROM t UNION SELECT session + 1000000 FROM t) SELECT s.session, CAST(coalesce(max(turn), 0) AS BIGINT) AS last_turn FROM s LEFT JOIN t USING (session) GROUP BY s.session", "t"))
def last_turn_or_none(s, d):
    t = turns(s, d)
    sessions = t.select("session").union(t.select(F.col("session") + 1000000)).distinct()
    return sessions.join(t.groupBy("session").agg(F.max("turn").alias("last")), "session", "left").select("session", F.coalesce("last", F.lit(0)).cast("long").alias("last_turn"))


@query(sql(", f AS (SELECT speaker, entity, count(*) AS n, count(DISTINCT source_date) AS days FROM m GROUP BY ALL HAVING count(DISTINCT source_date) >= 2) SELECT speaker, entity, source_date, id FROM m JOIN f USING (speaker, entity)", "m"))
def trajectory_points(s, d):
    """The points of what was seen on two days or more."""
    m = memories(s, d)
    often = m.groupBy(*KEYS).agg(F.countDistinct("source_date").alias("days")).where("days >= 2").select(*KEYS)
    return m.join(often, KEYS, "left_semi").select(*KEYS, "source_date", "id")


@query(sql("SELECT level, CASE level WHEN 'L1' THEN parent WHEN 'L2' THEN parent WHEN 'L3' THEN 'w:' || CAST(CAST(date_trunc('week', period) AS DATE) AS VARCHAR) ELSE 'm:' || CAST(CAST(date_trunc('month', period) AS DATE) AS VARCHAR) END AS up, count(*) AS children FROM l WHERE level <> 'L5' GROUP BY ALL", "l"))
def children_of_periods(s, d):
    """How many children each session, day, week and month has, by their own times."""
    week, month = dates.week_start(F.col("period")).cast("string"), F.trunc("period", "month").cast("string")
    up = F.when(F.col("level").isin("L1", "L2"), F.col("parent")).when(F.col("level") == "L3", F.concat(F.lit("w:"), week)).otherwise(F.concat(F.lit("m:"), month))
    return levels(s, d).where("level <> 'L5'").groupBy("level", up.alias("up")).agg(F.count(F.lit(1)).alias("children"))


@query(sql(", x AS (SELECT id, speaker, source_date FROM m WHERE exp(-CAST(DATE '2024-02-01' - source_date AS DOUBLE) / (5 * (1 + id % 3))) >= 0.2) SELECT speaker, source_date, count(*) AS kept FROM x GROUP BY ALL", "m"))
def surviving_dates(s, d):
    """Dates with a memory that survives, of which alone summaries are kept; dates that lost all are gone."""
    m = memories(s, d)
    alive = m.where(dates.retention(F.datediff(F.lit("2024-02-01").cast("date"), "source_date"), 1 + F.col("id") % 3) >= 0.2)
    kept = alive.groupBy("speaker", "source_date").agg(F.count(F.lit(1)).alias("kept"))
    summaries = m.select("speaker", "source_date").distinct()
    return summaries.join(kept, ["speaker", "source_date"])


@query(sql("SELECT 'chunk' AS part, CAST(session * 100 + turn AS VARCHAR) AS ref FROM t WHERE contains(lower(text), 'river') UNION ALL SELECT 'summary', id FROM l WHERE level = 'L5' UNION ALL SELECT 'row', CAST(id AS VARCHAR) FROM m WHERE entity = 'signup'", "t", "l", "m"))
def one_pass(s, d):
    """Chunks, summaries and rows that one retrieval brings together."""
    chunks = turns(s, d).where(F.lower("text").contains("river")).select(F.lit("chunk").alias("part"), (F.col("session") * 100 + F.col("turn")).cast("string").alias("ref"))
    summaries = levels(s, d).where("level = 'L5'").select(F.lit("summary"), "id")
    rows = memories(s, d).where("entity = 'signup'").select(F.lit("row"), F.col("id").cast("string"))
    return chunks.union(summaries).union(rows)


@query(sql(", v AS (SELECT vec_id, embedding FROM embeddings), c AS (SELECT session * 100 + turn AS id, text, session AS vec_id FROM t) SELECT c.id, length(text) AS size, CAST(len(embedding) AS INT) AS dimensions FROM c JOIN v USING (vec_id)", "t"))
def chunk_vectors(s, d):
    """Chunks with the vectors that are stored beside them, one for each session."""
    t = turns(s, d)
    chunks = t.select((F.col("session") * 100 + F.col("turn")).alias("id"), F.length("text").alias("size"), F.col("session").alias("vec_id"))
    return chunks.join(table(s, d, "embeddings"), "vec_id").select("id", "size", F.size("embedding").alias("dimensions"))


@query("SELECT * FROM (VALUES ('simple', 'L1', 40, 20), ('simple', 'L2', 2, 1), ('hybrid', 'L1', 40, 20), ('hybrid', 'L2', 2, 2), ('hybrid', 'L3', 1, 1), ('hybrid', 'L4', 1, 1), ('complex', 'L1', 40, 20), ('complex', 'L3', 2, 2), ('complex', 'L4', 2, 1), ('complex', 'L5', 1, 1)) AS v(strategy, layer, coarse, final)")
def strategy_table(s, d):
    return s.createDataFrame([(k, layer, *n) for k, v in selection.STRATEGIES.items() for layer, n in v.items()], "strategy string, layer string, coarse int, final int")
