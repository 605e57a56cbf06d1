"""Queries on dated rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates
from ..operators import metrics, timeline
from ..sources.tables import levels, memories, sql, table, turns
from .registry import query

KEYS = ["speaker", "entity"]
SEQ = "PARTITION BY speaker, entity ORDER BY source_date, id"
CHANGES = f", tr AS (SELECT * FROM (SELECT *, row_number() OVER w AS rn, lag(content) OVER w AS before FROM m WINDOW w AS ({SEQ})) WHERE rn = 1 OR content IS DISTINCT FROM before)\n"
PHASES = CHANGES + f", ph AS (SELECT speaker, entity, content, source_date AS start, coalesce(CAST(lead(source_date) OVER ({SEQ}) - 1 AS DATE), DATE '2024-01-31') AS stop FROM tr)\n"


@query(sql("SELECT id, content, entity, type, speaker, source_date FROM m WHERE entity = 'click' AND source_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' ORDER BY source_date, id LIMIT 100", "m"))
def memory_timeline(s, d):
    return timeline.query_memories(memories(s, d), entity=" Click ", start="2024-01-05", end="2024-01-20", limit=100)


@query(sql("SELECT session, turn, speaker, date FROM t WHERE date BETWEEN DATE '2024-01-10' AND DATE '2024-02-20'", "t"))
def conv_date_range(s, d):
    return turns(s, d).where(F.col("date").between("2024-01-10", "2024-02-20")).select("session", "turn", "speaker", "date").orderBy("date", "session", "turn")


@query(sql("SELECT session, turn, text FROM t WHERE date BETWEEN DATE '2024-01-13' AND DATE '2024-01-17'", "t"))
def read_day_window(s, d):
    return timeline.day_window(turns(s, d), "2024-01-15", 2).select("session", "turn", "text")


@query(sql("SELECT id, source_date, (SELECT count(*) FROM m WHERE entity = 'signup') > 50 AS truncated FROM m WHERE entity = 'signup' ORDER BY source_date, id LIMIT 50", "m"))
def limit_plus_one(s, d):
    return timeline.limit_plus_one(timeline.filtered(memories(s, d), entity="signup"), 50, "source_date", "id").select("id", "source_date", "truncated")


@query(sql("SELECT content, source_date, id FROM m WHERE speaker = 'user_7' AND entity = 'view' AND source_date <= DATE '2024-01-31'", "m"))
def preference_sequence(s, d):
    return timeline.query_memories(memories(s, d), entity="view", speaker="user_7", end="2024-01").select("content", "source_date", "id")


@query(sql(CHANGES + "SELECT speaker, entity, id, content, source_date FROM tr", "m"))
def transitions(s, d):
    return timeline.transitions(memories(s, d), KEYS).select(*KEYS, "id", "content", "source_date")


@query(sql(CHANGES + f"SELECT speaker, entity, content, source_date AS start, CAST(lead(source_date) OVER ({SEQ}) - source_date AS BIGINT) AS days, lead(source_date) OVER ({SEQ}) IS NULL AS current FROM tr", "m"))
def phase_durations(s, d):
    return timeline.phase_durations(memories(s, d), KEYS)


@query(sql(f""", f AS (SELECT *, CASE WHEN row_number() OVER w > 1 AND content IS NOT DISTINCT FROM lag(content) OVER w THEN 0 ELSE 1 END AS c FROM m WINDOW w AS ({SEQ}))
, g AS (SELECT *, CAST(sum(c) OVER ({SEQ}) AS BIGINT) AS run FROM f)
SELECT speaker, entity, run, min(content) AS content, count(*) AS n, min(source_date) AS start FROM g GROUP BY ALL""", "m"))  # fmt: skip
def run_lengths(s, d):
    return timeline.run_lengths(memories(s, d), KEYS)


@query(sql("SELECT speaker, entity, source_date, content, id FROM (SELECT *, row_number() OVER (PARTITION BY speaker, entity, source_date ORDER BY id) AS n FROM m WHERE length(content) >= 2 AND content <> 'v0') WHERE n = 1", "m"))
def first_per_day(s, d):
    return timeline.first_per_day(memories(s, d), KEYS, ["v0"]).select(*KEYS, "source_date", "content", "id")


ISLANDS = ", x AS (SELECT DISTINCT speaker, entity, content, source_date AS day FROM m), y AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY speaker, entity, content ORDER BY day) AS INT) AS g FROM x)\n"


@query(sql(ISLANDS + "SELECT speaker, entity, content, min(day) AS start, max(day) AS \"end\", count(*) AS days FROM y GROUP BY speaker, entity, content, g", "m"))
def validity_intervals(s, d):
    return timeline.validity_intervals(memories(s, d), KEYS)


@query(sql(", x AS (SELECT DISTINCT entity, id FROM m), y AS (SELECT *, id - row_number() OVER (PARTITION BY entity ORDER BY id) AS g FROM x) SELECT entity, min(id) AS first, max(id) AS last, count(*) AS n FROM y GROUP BY entity, g", "m"))
def islands(s, d):
    return timeline.islands(memories(s, d), ["entity"], F.col("id"))


def _phases(s, d):
    p = timeline.phase_durations(memories(s, d), KEYS)
    return p.select(*KEYS, "content", "start", F.coalesce(F.date_add("start", F.col("days").cast("int") - 1), F.lit("2024-01-31").cast("date")).alias("stop"))


@query(sql(PHASES + ", dd AS (SELECT DISTINCT source_date AS day FROM m) SELECT day, speaker, entity, content FROM dd JOIN ph ON day BETWEEN start AND stop WHERE start <= stop", "m"))
def regime_on_day(s, d):
    days = memories(s, d).select(F.col("source_date").alias("day")).distinct()
    return timeline.interval_join(days, _phases(s, d).where("start <= stop"), "day", "start", "stop", 1).select("day", *KEYS, "content")


@query(sql(""", p AS (SELECT id, speaker, source_date FROM m WHERE entity = 'purchase'), c AS (SELECT id AS cid, speaker, source_date AS cdate, content FROM m WHERE entity = 'click')
SELECT p.id, p.speaker, p.source_date, max(cdate) AS as_of_source_date, arg_max(content, (cdate, cid)) AS as_of_content FROM p LEFT JOIN c ON c.speaker = p.speaker AND cdate <= source_date GROUP BY ALL""", "m"))  # fmt: skip
def fact_at_time_asof(s, d):
    m = memories(s, d)
    probes = m.where("entity = 'purchase'").select("id", "speaker", "source_date")
    return timeline.as_of(probes, m.where("entity = 'click'").select("id", "speaker", "source_date", "content"), ["speaker"], "source_date", "source_date", ["content"], "id")


@query(sql("SELECT speaker, entity, id, content, effective FROM (SELECT *, CAST(source_date - CAST(id % 5 AS INT) AS DATE) AS effective, row_number() OVER (PARTITION BY speaker, entity ORDER BY source_date - CAST(id % 5 AS INT) DESC, source_date DESC, id DESC) AS n FROM m WHERE source_date <= DATE '2024-01-15') WHERE n = 1", "m"))
def known_at_date(s, d):
    log = memories(s, d).withColumn("effective", F.date_sub("source_date", (F.col("id") % 5).cast("int")))
    return timeline.known_at(log, "2024-01-15", KEYS, "source_date", "effective").select(*KEYS, "id", "content", "effective")


@query(sql(", s AS (SELECT DISTINCT speaker, source_date AS day FROM m WHERE entity = 'signup') SELECT id, m.speaker, source_date, min(day) AS next_session FROM m LEFT JOIN s ON s.speaker = m.speaker AND day >= source_date WHERE entity = 'error' GROUP BY ALL", "m"))
def next_session(s, d):
    m = memories(s, d)
    return timeline.next_session(m.where("entity = 'error'").select("id", "speaker", "source_date"), m.where("entity = 'signup'").select("speaker", "source_date").distinct(), ["speaker"], "source_date", "source_date")


@query(sql("SELECT a.id AS error_id, b.id AS purchase_id FROM m a JOIN m b ON a.speaker = b.speaker AND abs(a.source_date - b.source_date) <= 1 WHERE a.entity = 'error' AND b.entity = 'purchase'", "m"))
def near_change(s, d):
    m = memories(s, d)
    a = m.where("entity = 'error'").select("speaker", F.col("id").alias("error_id"), F.col("source_date").alias("e"))
    b = m.where("entity = 'purchase'").select("speaker", F.col("id").alias("purchase_id"), F.col("source_date").alias("p"))
    return timeline.band_join(a, b, ["speaker"], "e", "p", 1).select("error_id", "purchase_id")


REGIMES = """, r AS (SELECT CAST(o_custkey AS VARCHAR) AS domain, o_orderkey AS id, CAST(o_orderdate AS DATE) AS start, o_orderkey % 3 = 0 AS temporary, CASE WHEN o_orderkey % 3 = 0 THEN CAST(CAST(o_orderdate AS DATE) + 5 AS DATE) END AS stop, o_orderpriority AS label FROM orders)
, s AS (SELECT *, coalesce(lead(start) OVER w, DATE '2001-12-31' + 1) AS nxt, CASE WHEN row_number() OVER w = 1 THEN 'initial' WHEN temporary THEN 'temporary' ELSE 'shift' END AS kind FROM r WINDOW w AS (PARTITION BY domain ORDER BY start, id))
, b AS (SELECT *, last_value(CASE WHEN kind <> 'temporary' THEN label END IGNORE NULLS) OVER (PARTITION BY domain ORDER BY start, id ROWS UNBOUNDED PRECEDING) AS base, CASE WHEN temporary THEN stop ELSE CAST(nxt - 1 AS DATE) END AS fin FROM s)
SELECT domain, CAST(id AS VARCHAR) AS id, kind, start, fin AS "end", label FROM b
UNION ALL SELECT domain, CAST(id AS VARCHAR) || '.revert', 'reversion', CAST(fin + 1 AS DATE), CAST(nxt - 1 AS DATE), base FROM b WHERE kind = 'temporary' AND base IS NOT NULL AND fin + 1 <= nxt - 1"""


def _regimes(s, d):
    o = table(s, d, "orders")
    start, temporary = F.to_date("o_orderdate"), F.col("o_orderkey") % 3 == 0
    rows = o.select(F.col("o_custkey").cast("string").alias("domain"), F.col("o_orderkey").alias("_k"), start.alias("start"), temporary.alias("temporary"), F.when(temporary, F.date_add(start, 5)).alias("end"), F.col("o_orderpriority").alias("label"))
    return rows.withColumnRenamed("_k", "id")


@query("WITH " + REGIMES.removeprefix(", "))
def resolve_regimes(s, d):
    return timeline.resolve_regimes(_regimes(s, d), "2001-12-31")


@query(sql(f"SELECT speaker, entity, id, source_date, CAST(gap AS BIGINT) AS gap FROM (SELECT *, source_date - lag(source_date) OVER ({SEQ}) AS gap FROM m WHERE entity = 'signup') WHERE gap < 3", "m"))
def spacing_violations(s, d):
    return timeline.spacing_violations(memories(s, d).where("entity = 'signup'"), KEYS, 3).select(*KEYS, "id", "source_date", "gap")


@query(sql(PHASES + """, g AS (SELECT speaker, entity, CAST(unnest(generate_series(start, stop, INTERVAL 1 DAY)) AS DATE) AS day FROM ph WHERE start <= stop)
, c AS (SELECT speaker, entity, day, count(*) AS n FROM g GROUP BY ALL)
, sp AS (SELECT DISTINCT speaker, entity, CAST(day AS DATE) AS day FROM ph, generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY) AS t(day) WHERE start <= stop)
SELECT sp.speaker, sp.entity, sp.day, coalesce(n, 0) AS n FROM sp LEFT JOIN c USING (speaker, entity, day) WHERE coalesce(n, 0) <> 1""", "m"))  # fmt: skip
def coverage_check(s, d):
    p = _phases(s, d).where("start <= stop").withColumnRenamed("stop", "end")
    return timeline.coverage_violations(p, KEYS, "2024-01-01", "2024-01-31")


@query(sql("SELECT session, turn, date, text FROM t ORDER BY date DESC, session DESC, turn DESC LIMIT 20", "t"))
def recent_k(s, d):
    return turns(s, d).orderBy(F.desc("date"), F.desc("session"), F.desc("turn")).limit(20).orderBy("date", "session", "turn").select("session", "turn", "date", "text")


@query(sql("SELECT session, turn, running FROM (SELECT session, turn, CAST(sum(length(text)) OVER (PARTITION BY session ORDER BY turn DESC) AS BIGINT) AS running FROM t) WHERE running <= 600", "t"))
def token_budget(s, d):
    return timeline.token_budget(turns(s, d), ["session"], F.length("text"), 600, F.desc("turn")).select("session", "turn", "running")


@query(sql("SELECT level, id, period, rank FROM (SELECT level, id, period, row_number() OVER (PARTITION BY level ORDER BY period DESC, id) AS rank FROM l) WHERE rank <= CASE level WHEN 'L1' THEN 5 WHEN 'L2' THEN 3 ELSE 2 END", "l"))
def topk_per_layer(s, d):
    k = F.when(F.col("level") == "L1", 5).when(F.col("level") == "L2", 3).otherwise(2)
    return timeline.top_k_per(levels(s, d), ["level"], k, F.desc("period"), "id", most=5).select("level", "id", "period", F.col("rank").cast("long").alias("rank"))


@query(sql("SELECT level, arg_max(id, (period, id)) AS id, max(period) AS period FROM l GROUP BY level", "l"))
def latest_per_layer(s, d):
    return levels(s, d).groupBy("level").agg(F.max_by("id", F.struct("period", "id")).alias("id"), F.max("period").alias("period"))


@query(sql("SELECT DISTINCT speaker, entity, lower(content) AS content, source_date, min(id) AS id FROM m GROUP BY ALL", "m"))
def dedupe_batch(s, d):
    m = memories(s, d)
    key = [F.col("speaker"), F.col("entity"), F.lower("content"), F.col("source_date")]
    return timeline.dedupe_batch(m, key, "id").select("speaker", "entity", F.lower("content").alias("content"), "source_date", "id")


@query(sql("SELECT id FROM m WHERE source_date >= DATE '2024-01-15' AND NOT EXISTS (SELECT 1 FROM m s WHERE s.id % 2 = 0 AND s.entity = m.entity AND lower(s.content) = lower(m.content) AND s.source_date = m.source_date AND s.speaker = m.speaker)", "m"))
def dedupe_anti_join(s, d):
    m = memories(s, d)
    return timeline.not_stored(m.where("source_date >= DATE '2024-01-15'"), m.where("id % 2 = 0")).select("id")


@query(sql("SELECT DISTINCT entity, content FROM m", "m"))
def unique_preferences(s, d):
    return memories(s, d).select("entity", "content").distinct().orderBy("entity", "content")


@query(sql("SELECT min(source_date) AS first, max(source_date) AS last FROM m", "m"))
def date_range(s, d):
    return memories(s, d).agg(F.min("source_date").alias("first"), F.max("source_date").alias("last"))


@query(sql("SELECT entity, count(*) AS n FROM m GROUP BY entity", "m"))
def entity_counts(s, d):
    return memories(s, d).groupBy("entity").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "entity")


@query(sql("SELECT speaker, entity, count(*) AS n, array_to_string(list_sort(list(DISTINCT content))[1:2], ',') AS \"values\" FROM m GROUP BY speaker, entity HAVING count(DISTINCT content) >= 2", "m"))
def recurring_domains(s, d):
    return metrics.recurring(memories(s, d), KEYS, "content", 2, 2)


@query(sql("SELECT entity, string_agg(content, ',' ORDER BY first) AS \"values\" FROM (SELECT entity, content, min(id) AS first, row_number() OVER (PARTITION BY entity ORDER BY min(id)) AS n FROM m GROUP BY entity, content) WHERE n <= 2 GROUP BY entity", "m"))
def known_values(s, d):
    return metrics.known_values(memories(s, d), 2)


@query(sql("SELECT source_date, CAST(isoyear(source_date) AS VARCHAR) || '-W' || lpad(CAST(weekofyear(source_date) AS VARCHAR), 2, '0') AS week, count(*) AS n FROM (SELECT CAST(o_orderdate AS DATE) AS source_date FROM orders) GROUP BY ALL", "m"))
def iso_week(s, d):
    return table(s, d, "orders").select(F.to_date("o_orderdate").alias("source_date")).groupBy("source_date", dates.iso_week(F.col("source_date")).alias("week")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CAST(day AS DATE) AS day, CAST(isoyear(day) AS VARCHAR) || '-W' || lpad(CAST(weekofyear(day) AS VARCHAR), 2, '0') AS week, strftime(day, '%Y-%m') AS month, CAST(year(day) AS INT) AS year
FROM generate_series(DATE '2026-12-20', DATE '2027-02-10', INTERVAL 1 DAY) AS t(day)""")  # fmt: skip
def calendar_spine(s, d):
    return dates.calendar_spine(s, "2026-12-20", "2027-02-10")


@query("SELECT DISTINCT least(last_day(CAST(o_orderdate AS DATE)), (SELECT max(CAST(o_orderdate AS DATE)) FROM orders)) AS checkpoint FROM orders")
def month_boundaries(s, d):
    o = table(s, d, "orders").select(F.to_date("o_orderdate").alias("d"))
    ends = o.agg(F.max("d").alias("end"))
    return o.select(F.last_day("d").alias("m")).distinct().crossJoin(F.broadcast(ends)).select(F.least("m", "end").alias("checkpoint")).distinct()  # one row of ends


@query("""WITH q AS (SELECT last_day(CAST(o_orderdate AS DATE)) AS checkpoint, count(*) AS fresh FROM orders GROUP BY 1)
SELECT checkpoint, fresh, CAST(sum(fresh) OVER (ORDER BY checkpoint) AS BIGINT) AS cumulative FROM q""")  # fmt: skip
def cumulative_checkpoints(s, d):
    from pyspark.sql import Window

    months = table(s, d, "orders").groupBy(F.last_day(F.to_date("o_orderdate")).alias("checkpoint")).agg(F.count(F.lit(1)).alias("fresh"))
    return months.withColumn("cumulative", F.sum("fresh").over(Window.orderBy("checkpoint")))  # a row for each month


@query(sql("""SELECT id, round(CASE WHEN source_date BETWEEN DATE '2024-01-10' AND DATE '2024-01-20' THEN greatest(0.7, least(1.0, 1.0 - abs((source_date - DATE '2024-01-10') - 5.0) / 5.0))
 WHEN greatest(DATE '2024-01-10' - source_date, source_date - DATE '2024-01-20') <= 1 THEN 0.6 WHEN greatest(DATE '2024-01-10' - source_date, source_date - DATE '2024-01-20') <= 7 THEN 0.4
 WHEN greatest(DATE '2024-01-10' - source_date, source_date - DATE '2024-01-20') <= 30 THEN 0.2 ELSE 0.1 END, 6) AS relevance FROM m""", "m"))  # fmt: skip
def temporal_relevance(s, d):
    window = [F.lit(x).cast("date") for x in ("2024-01-10", "2024-01-20")]
    return memories(s, d).select("id", F.round(dates.temporal_relevance(F.col("source_date"), *window), 6).alias("relevance"))


@query(sql("SELECT id, round(exp(-CAST(DATE '2024-02-01' - source_date AS DOUBLE) / (5 * (1 + id % 3))), 6) AS kept FROM m", "m"))
def retention(s, d):
    days = F.datediff(F.lit("2024-02-01").cast("date"), "source_date")
    return memories(s, d).select("id", F.round(dates.retention(days, 1 + F.col("id") % 3), 6).alias("kept"))


DAYS = "CAST(o_orderdate AS DATE) AS d, CAST(o_orderdate AS DATE) - DATE '1995-01-02' AS o FROM orders"


def _days(s, d):
    return table(s, d, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()


ANCHOR = "1995-01-02"


def _offset():
    return F.datediff("d", F.lit(ANCHOR).cast("date"))


@query(f"SELECT DISTINCT d, CASE WHEN o >= 0 THEN (['gym', 'run', 'swim'])[(o // 7) % 3 + 1] END AS value FROM (SELECT {DAYS})")
def rule_weekly_alternate(s, d):
    return _days(s, d).select("d", dates.rule_weekly_alternate(_offset(), ["gym", "run", "swim"]).alias("value"))


@query(f"SELECT DISTINCT d, CASE WHEN o < 0 THEN NULL WHEN o % 7 < 2 THEN 'tea' WHEN o % 7 < 5 THEN 'coffee' ELSE 'juice' END AS value FROM (SELECT {DAYS})")
def rule_n_day_cycle(s, d):
    return _days(s, d).select("d", dates.rule_n_day_cycle(_offset(), [("tea", 2), ("coffee", 3), ("juice", 2)]).alias("value"))


@query(f"SELECT DISTINCT d, (['a', 'b', 'c', 'd', 'e', 'f', 'g'])[CAST(isodow(d) AS INT)] AS value FROM (SELECT {DAYS})")
def rule_day_of_week(s, d):
    return _days(s, d).select("d", dates.rule_day_of_week(F.col("d"), dict(zip(dates.WEEKDAYS, "abcdefg"))).alias("value"))


@query(f"SELECT DISTINCT d, CASE WHEN o < 0 THEN NULL WHEN (o // 14) % 2 = 0 THEN (['x', 'y'])[(o // 7) % 2 + 1] ELSE (CASE WHEN isodow(d) >= 6 THEN 'rest' ELSE 'work' END) END AS value FROM (SELECT {DAYS})")
def rule_nested(s, d):
    week = dict(zip(dates.WEEKDAYS, ["work"] * 5 + ["rest"] * 2))
    rule = {"type": "nested", "block_days": 14, "blocks": [{"type": "weekly_alternate", "values": ["x", "y"]}, {"type": "day_of_week", "map": week}]}
    return _days(s, d).select("d", dates.rule_value(rule, F.col("d"), F.lit(ANCHOR).cast("date")).alias("value"))
