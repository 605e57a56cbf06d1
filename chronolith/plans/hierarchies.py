"""Queries on the memory hierarchy, incremental refresh and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates
from ..operators import hierarchy, metrics, selection, timeline
from ..sources.tables import levels, memories, sql, table, turns
from .registry import query


def _details(s, d):
    l = levels(s, d)  # noqa: E741
    return {x: l.where(F.col("level") == x).select("id", F.concat(F.lit(f"{x} "), F.col("period").cast("string")).alias("note")) for x in hierarchy.LEVELS}


@query(sql("SELECT id, level, level || ' ' || CAST(period AS VARCHAR) AS note FROM l", "l"))
def level_left_join(s, d):
    return hierarchy.level_left_join(levels(s, d), _details(s, d), "note").select("id", "level", "note")


@query(sql(", k AS MATERIALIZED (SELECT id, level, parent FROM l) SELECT c.parent, c.id AS child FROM (SELECT parent, id FROM k WHERE parent IS NOT NULL) c JOIN (SELECT id FROM k WHERE level = 'L3') p ON p.id = c.parent", "l"))
def child_join(s, d):
    return hierarchy.children(levels(s, d), "L3")


@query(sql(""", k AS MATERIALIZED (SELECT id, level, parent FROM l), k1 AS (SELECT id, parent FROM k WHERE level = 'L1'), k2 AS (SELECT id, parent FROM k WHERE level = 'L2'), k3 AS (SELECT id, parent FROM k WHERE level = 'L3'), k4 AS (SELECT id, parent FROM k WHERE level = 'L4'), k5 AS (SELECT id FROM k WHERE level = 'L5')
SELECT a.id AS "L1", b.id AS "L2", c.id AS "L3", e.id AS "L4", f.id AS "L5" FROM k1 a LEFT JOIN k2 b ON b.id = a.parent LEFT JOIN k3 c ON c.id = b.parent LEFT JOIN k4 e ON e.id = c.parent LEFT JOIN k5 f ON f.id = e.parent""", "l"))  # fmt: skip
def parent_chain(s, d):
    return hierarchy.parent_chain(levels(s, d))


def _missing(level, up):
    return sql(f"SELECT parent AS id, count(*) AS n FROM l c WHERE level = '{level}' AND parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM l p WHERE p.id = c.parent AND p.level = '{up}') GROUP BY parent", "l")


@query(_missing("L1", "L2"))
def missing_sessions(s, d):
    return hierarchy.missing_parents(levels(s, d), "L1")


@query(_missing("L2", "L3"))
def missing_daily(s, d):
    return hierarchy.missing_parents(levels(s, d), "L2")


@query(_missing("L3", "L4"))
def missing_weekly(s, d):
    return hierarchy.missing_parents(levels(s, d), "L3")


@query(_missing("L4", "L5"))
def missing_monthly(s, d):
    return hierarchy.missing_parents(levels(s, d), "L4")


CASCADE = """, pend AS (SELECT DISTINCT c.parent AS id, 'd:' || split_part(c.parent, ':', 3) AS parent FROM l c WHERE level = 'L1' AND NOT EXISTS (SELECT 1 FROM l p WHERE p.id = c.parent AND p.level = 'L2'))
, below AS (SELECT parent FROM l WHERE level = 'L2' UNION ALL SELECT parent FROM pend)
SELECT parent AS id, count(*) AS n FROM below b WHERE NOT EXISTS (SELECT 1 FROM l p WHERE p.id = b.parent AND p.level = 'L3') GROUP BY parent"""


@query(sql(CASCADE, "l"))
def missing_cascaded(s, d):
    l = levels(s, d)  # noqa: E741
    pending = hierarchy.missing_parents(l, "L1").select(F.concat(F.lit("d:"), F.split_part("id", F.lit(":"), F.lit(3))).alias("parent"))
    return hierarchy.missing_parents(l, "L2", pending)


PLAN = """, x AS (SELECT DISTINCT parent AS id, 'L3' AS level, CAST(substr(parent, 3) AS DATE) AS start, CAST(substr(parent, 3) AS DATE) AS fin FROM l c WHERE level = 'L2' AND NOT EXISTS (SELECT 1 FROM l p WHERE p.id = c.parent AND p.level = 'L3')
 UNION ALL SELECT DISTINCT parent, 'L4', CAST(substr(parent, 3) AS DATE), CAST(CAST(substr(parent, 3) AS DATE) + 6 AS DATE) FROM l c WHERE level = 'L3' AND NOT EXISTS (SELECT 1 FROM l p WHERE p.id = c.parent AND p.level = 'L4'))
SELECT id, level, start, fin, CAST(row_number() OVER (ORDER BY start, level, fin, id) AS INT) AS priority FROM x"""


@query(sql(PLAN, "l"))
def backfill_plan(s, d):
    l = levels(s, d)  # noqa: E741
    date = F.substring("id", 3, 10).cast("date")
    tasks = None
    for below, level in (("L2", "L3"), ("L3", "L4")):
        t = hierarchy.missing_parents(l, below).select("id", F.lit(level).alias("level"), date.alias("start"), hierarchy.period_end(F.lit(level), date).alias("fin"))
        tasks = t if tasks is None else tasks.unionByName(t)
    return tasks.withColumn("priority", F.row_number().over(Window.orderBy("start", "level", "fin", "id")))  # a row for each missing period


@query(sql("SELECT level, id, period, row_number() OVER (ORDER BY level, period, id) AS place FROM l", "l"))
def level_time_sort(s, d):
    l = levels(s, d)  # noqa: E741
    key = F.concat_ws("|", "level", F.col("period").cast("string"), "id")
    return timeline.ranked(l.select(F.struct("level", "id", "period").alias("id"), key.alias("key")), F.col("key").asc(), F.col("key").asc()).select("id.level", "id.id", "id.period", F.col("rank").alias("place"))


@query(sql(", e AS MATERIALIZED (SELECT id AS src, parent AS dst, level FROM l WHERE parent IS NOT NULL), r1 AS (SELECT src AS start, dst AS node, 1 AS hops FROM e WHERE level = 'L1'), r2 AS (SELECT DISTINCT start, dst AS node, 2 AS hops FROM r1 JOIN e ON src = node), r3 AS (SELECT DISTINCT start, dst AS node, 3 AS hops FROM r2 JOIN e ON src = node) SELECT start, node, min(hops) AS hops FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3) GROUP BY start, node", "l"))
def hierarchy_reach(s, d):
    l = levels(s, d)  # noqa: E741
    return hierarchy.reach(l.where("parent IS NOT NULL").select(F.col("id").alias("src"), F.col("parent").alias("dst")), l.where("level = 'L1'").select("id"), 3)


BETWEEN = """, d AS (SELECT id AS a, lead(id) OVER (ORDER BY period) AS b FROM l WHERE level = 'L3'), u AS (SELECT c.id, p.id AS up, p.parent FROM l c JOIN l p ON p.id = c.parent WHERE c.level = 'L3')
, x AS (SELECT id, id AS up, 0 AS hops FROM l WHERE level = 'L3' UNION ALL SELECT id, up, 1 FROM u UNION ALL SELECT u.id, l.id, 2 FROM u JOIN l ON l.id = u.parent)
SELECT a, b, min(y.hops + z.hops) AS hops FROM d JOIN x y ON y.id = a JOIN x z ON z.id = b AND z.up = y.up WHERE a <> b GROUP BY a, b HAVING min(y.hops + z.hops) <= 4"""


@query(sql(BETWEEN, "l"))
def paths_between(s, d):
    """How each day is connected with the next one through weeks and months, on a path of four edges at most."""
    l = levels(s, d).where("level IN ('L3', 'L4', 'L5')")  # noqa: E741
    edges = l.where("parent IS NOT NULL").join(l.select(F.col("id").alias("parent")), "parent", "left_semi").select(F.xxhash64("id").alias("id"), F.col("id").alias("src"), F.col("parent").alias("dst"))
    days = l.where("level = 'L3'").select("id", "period")  # a row for each day
    pairs = days.withColumn("b", F.lead("id").over(Window.orderBy("period"))).select(F.col("id").alias("a"), "b").where("b IS NOT NULL")
    return selection.paths_between(edges, pairs, 4).select("a", "b", F.col("hops").cast("int").alias("hops"))


@query(sql(", k AS MATERIALIZED (SELECT id, level, period, parent FROM l), e AS (SELECT id, level, CASE WHEN length(id) % 5 = 0 AND level = 'L2' THEN 'm:' || strftime(period, '%Y-%m') || '-01' ELSE parent END AS parent FROM k) SELECT e.id, e.level, e.parent, p.level AS parent_level FROM (SELECT * FROM e WHERE parent IS NOT NULL) e JOIN k p ON p.id = e.parent WHERE CAST(substr(p.level, 2, 1) AS INT) <> CAST(substr(e.level, 2, 1) AS INT) + 1", "l"))
def level_validity(s, d):
    l = levels(s, d)  # noqa: E741
    wrong = (F.length("id") % 5 == 0) & (F.col("level") == "L2")
    bent = l.withColumn("parent", F.when(wrong, F.concat(F.lit("m:"), F.date_format("period", "yyyy-MM"), F.lit("-01"))).otherwise(F.col("parent")))
    return hierarchy.level_violations(bent)


@query(sql("SELECT CAST(date_trunc('week', period) AS DATE) AS week, count(*) AS n, string_agg(id, ',' ORDER BY id) AS children FROM l WHERE level = 'L3' GROUP BY 1", "l"))
def period_children(s, d):
    l = levels(s, d).where("level = 'L3'")  # noqa: E741
    return l.groupBy(dates.week_start(F.col("period")).alias("week")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("id")), ",").alias("children"))


GRADES = ", a AS (SELECT id, entity AS category, speaker, id % 3 = 0 AS ok, CAST(id % 101 AS DOUBLE) / 100 AS f1 FROM m)\n"


def _answers(s, d):
    m = memories(s, d)
    return m.select("id", F.col("entity").alias("category"), "speaker", (F.col("id") % 3 == 0).cast("int").alias("judge"), ((F.col("id") % 101).cast("double") / 100).alias("f1"), "source_date")


@query(sql("SELECT id, CASE WHEN id % 7 = 0 AND id % 5 <> 0 THEN 'no_grade' WHEN id % 7 = 0 THEN 'graded' ELSE 'graded' END AS state FROM m WHERE id % 7 = 0 UNION ALL SELECT id, 'no_answer' FROM m WHERE id % 5 = 0 AND id % 7 <> 0", "m"))
def grade_join(s, d):
    m = memories(s, d)
    return metrics.grade_join(m.where("id % 7 = 0").select("id"), m.where("id % 5 = 0").select("id"), "id")


@query(sql(GRADES + "SELECT category, count(*) AS n, round(avg(CAST(ok AS INT)), 4) AS mean_judge, round(avg(f1), 4) AS mean_f1 FROM a GROUP BY category", "m"))
def scores_by_category(s, d):
    return metrics.scores_by(_answers(s, d), ["category"], ["judge", "f1"])


@query(sql(GRADES + ", b AS (SELECT speaker, category, count(*) AS n, avg(f1) AS f1 FROM a GROUP BY speaker, category) SELECT speaker, category, CAST(sum(n) AS BIGINT) AS n, round(sum(f1 * n) / sum(n), 6) AS mean FROM b GROUP BY ROLLUP (speaker, category)", "m"))
def micro_average(s, d):
    blocks = _answers(s, d).groupBy("speaker", "category").agg(F.count(F.lit(1)).alias("n"), F.avg("f1").alias("f1"))
    return metrics.micro_average(blocks, ["speaker", "category"], "f1")


@query(""", r AS (SELECT event_type, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, count(*) AS n, round(sum(v), 4) AS total, round(avg(v), 4) AS mean, max(CASE WHEN i = least(CAST(floor(n * 0.5) AS BIGINT), n - 1) THEN v END) AS p50, max(CASE WHEN i = least(CAST(floor(n * 0.95) AS BIGINT), n - 1) THEN v END) AS p95, max(v) AS max FROM r GROUP BY event_type""".replace(", r", "WITH r", 1))  # fmt: skip
def latency_percentiles(s, d):
    return metrics.floor_percentiles(table(s, d, "events").where("value IS NOT NULL"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


@query("SELECT event_type AS tool, count(*) AS n, round(count(*) / (SELECT CAST(count(DISTINCT user_id) AS DOUBLE) FROM events), 6) AS per_user FROM events GROUP BY event_type")
def tool_stats(s, d):
    e = table(s, d, "events")
    users = e.agg(F.countDistinct("user_id").alias("users"))
    return e.groupBy(F.col("event_type").alias("tool")).agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(users)).select("tool", "n", F.round(F.col("n") / F.col("users"), 6).alias("per_user"))  # one row


@query("SELECT event_type, round(sum(value), 2) AS part, round(sum(value) / sum(sum(value)) OVER (), 6) AS share FROM events GROUP BY event_type")
def share_of_total(s, d):
    return metrics.share_of_total(table(s, d, "events"), "event_type", "value")


DIST = """, c AS (SELECT entity, type, content, count(*) AS c FROM m GROUP BY ALL), t AS (SELECT *, sum(c) OVER (PARTITION BY entity, type) AS t FROM c)
SELECT entity, type, CAST(max(t) AS BIGINT) AS n, count(*) AS n_answers, arg_min(content, (-c, content)) AS top, round(max(c / t), 6) AS share, round(-sum(c / t * log2(c / t)), 6) AS entropy FROM t GROUP BY entity, type"""


@query(sql(DIST, "m"))
def answer_distribution(s, d):
    return metrics.answer_distribution(memories(s, d), ["entity", "type"], "content")


@query(sql(", c AS (SELECT speaker, content, count(*) AS c FROM m GROUP BY ALL), t AS (SELECT *, sum(c) OVER (PARTITION BY speaker) AS t FROM c) SELECT speaker, round(-sum(c / t * log2(c / t)), 6) AS entropy FROM t GROUP BY speaker", "m"))
def entropy(s, d):
    return metrics.answer_distribution(memories(s, d), ["speaker"], "content").select("speaker", "entropy")


@query(sql(DIST.replace("SELECT entity, type, CAST", ", g AS (SELECT entity, type, CAST") + ") SELECT entity, type, top, share FROM g WHERE share > 0.34 AND n >= 4", "m"))
def dominance_guard(s, d):
    return metrics.answer_distribution(memories(s, d), ["entity", "type"], "content").where("share > 0.34 AND n >= 4").select("entity", "type", "top", "share")


KNOBS = """, tr AS (SELECT *, row_number() OVER w AS rn, lag(content) OVER w AS before FROM m WINDOW w AS (PARTITION BY speaker, entity ORDER BY source_date, id))
, g AS (SELECT speaker, entity, count(*) FILTER (WHERE rn > 1 AND content IS DISTINCT FROM before) AS shifts, avg(CASE WHEN type = 'fact' THEN 1.0 ELSE 0 END) AS facts FROM tr GROUP BY speaker, entity)
SELECT speaker, min(shifts) AS min_shifts, max(shifts) AS max_shifts, round(avg(facts), 6) AS fact_rate, count(*) AS domains FROM g GROUP BY speaker"""


@query(sql(KNOBS, "m"))
def knob_measures(s, d):
    w = timeline.sequence(["speaker", "entity"])
    shift = (F.row_number().over(w) > 1) & ~F.col("content").eqNullSafe(F.lag("content").over(w))
    g = memories(s, d).withColumn("_s", shift.cast("long")).groupBy("speaker", "entity").agg(F.sum("_s").alias("shifts"), F.avg(F.when(F.col("type") == "fact", 1.0).otherwise(0.0)).alias("facts"))
    return g.groupBy("speaker").agg(F.min("shifts").alias("min_shifts"), F.max("shifts").alias("max_shifts"), F.round(F.avg("facts"), 6).alias("fact_rate"), F.count(F.lit(1)).alias("domains"))


@query(sql(GRADES + "SELECT category, " + ", ".join(f"round(avg(CASE WHEN content = '{v}' THEN f1 END), 4) AS {v}_mean, round(stddev_pop(CASE WHEN content = '{v}' THEN f1 END), 4) AS {v}_sd" for v in ("v0", "v1", "v2")) + " FROM a JOIN (SELECT id, content FROM m) USING (id) GROUP BY category", "m"))
def report_pivot(s, d):
    a = _answers(s, d).join(memories(s, d).select("id", "content"), "id")
    return metrics.pivoted(a, "category", "content", ["v0", "v1", "v2"], "f1")


@query(sql(""", r AS (SELECT session, turn, CAST(sum(length(text)) OVER (PARTITION BY session ORDER BY turn) AS BIGINT) AS far, turn % 2 AS ok FROM t)
SELECT CAST(ceil(far / 500) AS BIGINT) AS bucket, count(*) AS n, round(avg(ok), 6) AS accuracy FROM r GROUP BY 1""", "t"))  # fmt: skip
def distance_buckets(s, d):
    far = F.sum(F.length("text").cast("long")).over(Window.partitionBy("session").orderBy("turn"))
    r = turns(s, d).select(F.ceil(far / 500).alias("bucket"), (F.col("turn") % 2).alias("ok"))
    return r.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ok"), 6).alias("accuracy"))


@query(sql(", r AS (SELECT id, CASE WHEN id % 9 < 7 THEN id % 40 + 1 END AS rank FROM m) SELECT " + ", ".join(f"round(avg(CASE WHEN rank <= {k} THEN 1.0 ELSE 0 END), 6) AS recall_{k}, round(avg(CASE WHEN rank <= {k} THEN 1 / log2(rank + 1) ELSE 0 END), 6) AS ndcg_{k}" for k in (5, 10)) + " FROM r", "m"))
def recall_ndcg(s, d):
    return metrics.recall_ndcg(memories(s, d).select(F.when(F.col("id") % 9 < 7, F.col("id") % 40 + 1).alias("rank")), [5, 10])


@query("SELECT event_type, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, round(min(value), 4) AS min, round(max(value), 4) AS max, round(median(value), 4) AS median, count(value) AS n FROM events GROUP BY event_type")
def metric_stats(s, d):
    return metrics.metric_stats(table(s, d, "events"), ["event_type"], "value")


CLAIMS = """, e AS (SELECT id, CASE WHEN id % 4 = 0 THEN 'not mentioned' ELSE content END AS e FROM m WHERE id % 2 = 0), x AS (SELECT id, CASE WHEN id % 6 = 0 THEN 'V1' WHEN id % 10 = 0 THEN 'not mentioned' ELSE content END AS x FROM m WHERE id % 3 = 0)
, d AS (SELECT id, CASE WHEN e IS NULL THEN 'invention' WHEN e <> 'not mentioned' AND coalesce(x, 'not mentioned') = 'not mentioned' THEN 'absent' WHEN e = 'not mentioned' AND coalesce(x, 'not mentioned') <> 'not mentioned' THEN 'leak' WHEN lower(e) <> lower(x) THEN 'wrong' END AS kind FROM e FULL JOIN x USING (id))
SELECT id, kind FROM d WHERE kind IS NOT NULL"""


@query(sql(CLAIMS, "m"))
def claim_diff(s, d):
    m = memories(s, d)
    e = m.where("id % 2 = 0").select("id", F.when(F.col("id") % 4 == 0, "not mentioned").otherwise(F.col("content")).alias("value"))
    x = m.where("id % 3 = 0").select("id", F.when(F.col("id") % 6 == 0, "V1").when(F.col("id") % 10 == 0, "not mentioned").otherwise(F.col("content")).alias("value"))
    return metrics.claim_diff(e, x, ["id"])


HASH = """substr(sha256(CAST(count(*) AS VARCHAR) || ':' || CAST(sum(CAST(('0x' || substr(h, 1, 12)) AS HUGEINT)) AS VARCHAR) || ':' || CAST(sum(CAST(('0x' || substr(h, 13, 12)) AS HUGEINT)) AS VARCHAR)), 1, 16)"""
DIRTY = f""", h AS (SELECT CAST(date_trunc('week', source_date) AS DATE) AS period, sha256(concat_ws(chr(31), CAST(source_date AS VARCHAR), CAST(id AS VARCHAR), speaker, entity, content)) AS h, source_date FROM m)
, now AS (SELECT period, {HASH} AS source_hash, count(*) AS n FROM h GROUP BY period), old AS (SELECT period, {HASH} AS source_hash FROM h WHERE source_date <> DATE '2024-01-17' GROUP BY period)
SELECT now.period, now.source_hash, now.n FROM now LEFT JOIN old USING (period) WHERE now.source_hash IS DISTINCT FROM old.source_hash"""


@query(sql(DIRTY, "m"))
def dirty_periods(s, d):
    m = memories(s, d)
    args = (dates.week_start(F.col("source_date")), ["speaker", "entity", "content"], ["source_date", "id"])
    return metrics.dirty_periods(metrics.source_hash(m, *args), metrics.source_hash(m.where("source_date <> DATE '2024-01-17'"), *args))


GATED = """, f AS (SELECT *, row_number() OVER (PARTITION BY speaker ORDER BY id) AS k, CAST(substr(speaker, 6) AS BIGINT) % 3 AS u FROM m)
, a AS (SELECT -id AS id, CASE WHEN u = 1 THEN 'v9' ELSE content END AS content, CASE WHEN u = 2 THEN 'hobby' ELSE entity END AS entity, CASE WHEN u = 2 THEN 'habit' ELSE type END AS type, speaker, source_date FROM f WHERE k = 1)
, p AS (SELECT *, date_trunc('week', source_date) AS w, date_trunc('month', date_trunc('week', source_date)) AS mo, year(date_trunc('week', source_date)) AS y FROM a)
, q AS (SELECT *, date_trunc('week', source_date) AS w, date_trunc('month', date_trunc('week', source_date)) AS mo, year(date_trunc('week', source_date)) AS y FROM m)
, wk AS (SELECT p.* FROM p ANTI JOIN q ON p.speaker = q.speaker AND p.w = q.w AND p.entity = q.entity AND p.content = q.content)
, mn AS (SELECT wk.* FROM wk ANTI JOIN q ON wk.speaker = q.speaker AND wk.mo = q.mo AND wk.entity = q.entity)
, yr AS (SELECT mn.* FROM mn ANTI JOIN q ON mn.speaker = q.speaker AND mn.y = q.y AND mn.type = q.type)
SELECT speaker, 1 AS layer, strftime(w, '%Y-%m-%d') AS period FROM p UNION SELECT speaker, 2, strftime(mo, '%Y-%m') FROM wk UNION SELECT speaker, 3, CAST(y AS VARCHAR) FROM mn UNION SELECT speaker, 4, 'lifetime' FROM yr"""


@query(sql(GATED, "m"))
def gated_cascade(s, d):
    """One row more of each speaker: a repetition stops at its week, a new value at the month, a new kind of record reaches the lifetime."""
    m = memories(s, d)
    week = dates.week_start(F.col("source_date")).cast("date")
    layers = [("week", week.cast("string"), ["entity", "content"]), ("month", F.date_format(week, "yyyy-MM"), ["entity"]), ("year", F.date_format(week, "yyyy"), ["type"]), ("lifetime", F.lit("lifetime"), ["type"])]
    source = ["source_date", "id", "entity", "content"]
    first = m.groupBy("speaker").agg(F.min_by(F.struct("id", "content", "entity", "type", "source_date"), "id").alias("r")).select("speaker", "r.*")
    third = F.substring("speaker", 6, 20).cast("long") % 3
    more = first.select((-F.col("id")).alias("id"), F.when(third == 1, "v9").otherwise(F.col("content")).alias("content"), F.when(third == 2, "hobby").otherwise(F.col("entity")).alias("entity"), F.when(third == 2, "habit").otherwise(F.col("type")).alias("type"), "speaker", "source_date")
    touched = more.select("speaker", week.cast("string").alias("period"))
    return hierarchy.gated_cascade(m.unionByName(more), touched, hierarchy.rollup(m, ["speaker"], layers, source), ["speaker"], layers, source)


@query(sql(", e AS (SELECT id, CASE WHEN id % 3 = 0 THEN id - 3 END AS cause FROM m WHERE id % 2 = 0) SELECT id FROM e a WHERE NOT (cause IS NOT NULL AND EXISTS (SELECT 1 FROM e p WHERE p.id = a.cause)) AND NOT EXISTS (SELECT 1 FROM e c WHERE c.cause = a.id)", "m"))
def standalone_events(s, d):
    e = memories(s, d).where("id % 2 = 0").select("id", F.when(F.col("id") % 3 == 0, F.col("id") - 3).alias("cause"))
    links = e.where("cause IS NOT NULL").join(e.select(F.col("id").alias("cause")), "cause", "left_semi")
    linked = links.select("id").unionByName(links.select(F.col("cause").alias("id")))
    return e.join(linked.distinct(), "id", "left_anti").select("id")


@query(sql("SELECT speaker, source_date, lag(source_date) OVER (PARTITION BY speaker ORDER BY source_date) AS previous FROM (SELECT DISTINCT speaker, source_date FROM m)", "m"))
def session_tracker(s, d):
    days = memories(s, d).select("speaker", "source_date").distinct()
    return days.withColumn("previous", F.lag("source_date").over(Window.partitionBy("speaker").orderBy("source_date")))


@query(sql("SELECT m.id FROM m WHERE exp(-CAST(DATE '2024-02-01' - source_date AS DOUBLE) / (5 * (1 + id % 3))) >= 0.2", "m"))
def surviving_memories(s, d):
    days = F.datediff(F.lit("2024-02-01").cast("date"), "source_date")
    return memories(s, d).where(dates.retention(days, 1 + F.col("id") % 3) >= 0.2).select("id")


@query(sql("SELECT speaker, source_date, list_reduce([CAST(n AS VARCHAR)], lambda a, b: a || b) AS n, CAST(count(*) OVER (PARTITION BY speaker ORDER BY source_date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS BIGINT) AS earlier FROM (SELECT speaker, source_date, count(*) AS n FROM m GROUP BY ALL)", "m"))
def earlier_three(s, d):
    g = memories(s, d).groupBy("speaker", "source_date").agg(F.count(F.lit(1)).cast("string").alias("n"))
    return g.withColumn("earlier", F.count(F.lit(1)).over(Window.partitionBy("speaker").orderBy("source_date").rowsBetween(-3, -1)))
