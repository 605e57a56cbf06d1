"""Queries that select, sample, rank and analyse."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, queries, text
from ..operators import hierarchy, retrieval, selection, timeline
from ..sources import loaders
from ..sources.tables import levels, memories, sql, table, turns
from .registry import query
from .texts import E, _pairs, _texts
from .timelines import KEYS


@query(sql("SELECT id FROM m WHERE (speaker = 'user_3' AND entity = 'click') OR (speaker = 'click' AND entity = 'user_3')", "m"))
def pair_isolation(s, d):
    return selection.of_pair(memories(s, d), "user_3", "click", "speaker", "entity").select("id")


@query(sql("SELECT id FROM m WHERE entity IN ('click', 'error') AND id BETWEEN 100 AND 900 AND source_date >= DATE '2024-01-03' AND (content = 'v1' OR type = 'v1')", "m"))
def payload_filter(s, d):
    return selection.payload_filter(memories(s, d), any_of={"entity": ["click", "error"]}, between={"id": (100, 900), "source_date": (F.lit("2024-01-03").cast("date"), None)}, either=[("content", "type", "v1")]).select("id")


@query("SELECT event_id FROM events WHERE abs(epoch_us(ts) - epoch_us((SELECT ts FROM events WHERE event_id = 5))) <= 1000000")
def near_timestamp(s, d):
    e = table(s, d, "events")
    at = e.where("event_id = 5").select(F.col("ts").cast("string")).first()[0]
    return selection.at_time(e, "ts", at).select("event_id")


@query(sql("SELECT id, source_date FROM m ORDER BY source_date DESC, id LIMIT 20 OFFSET 40", "m"))
def list_page(s, d):
    return selection.paged(memories(s, d).select("id", "source_date"), 3, 20, F.desc("source_date"), "id")[0]


@query(sql(", g AS (SELECT entity, count(*) AS c FROM m GROUP BY entity), q AS (SELECT entity, 100.0 * c / sum(c) OVER () AS q FROM g), f AS (SELECT entity, floor(q) AS f, q - floor(q) AS r FROM q), s AS (SELECT entity, f + CASE WHEN row_number() OVER (ORDER BY r DESC, entity) <= 100 - sum(f) OVER () THEN 1 ELSE 0 END AS seats FROM f), n AS (SELECT id, entity, row_number() OVER (PARTITION BY entity ORDER BY id) AS n FROM m) SELECT n.id, n.entity FROM n JOIN s USING (entity) WHERE n <= seats", "m"))
def stratified_sample(s, d):
    return selection.largest_remainder(memories(s, d).select("id", "entity"), "entity", 100, F.col("id"))


@query(sql("SELECT id, entity FROM (SELECT id, entity, row_number() OVER (PARTITION BY entity ORDER BY id) AS n FROM m WHERE id % 3 <> 0) WHERE n <= 4", "m"))
def first_per_type(s, d):
    m = memories(s, d)
    return selection.first_per_type(m.select("id", "entity"), m.where("id % 3 = 0"), "id", "entity", 4)


@query(sql(", u AS (SELECT id, 1 AS ord, 'a' AS source, CAST(id % 5 AS DOUBLE) AS score, content FROM m WHERE id % 2 = 0 UNION ALL SELECT id, 2, 'b', CAST(id % 7 AS DOUBLE), entity FROM m WHERE id % 3 = 0) SELECT id, arg_min(content, ord) AS content, max(score) AS score, string_agg(source, ',' ORDER BY source) AS sources FROM u GROUP BY id", "m"))
def merged_by_id(s, d):
    m = memories(s, d)
    a = m.where("id % 2 = 0").select("id", F.lit(1).alias("ord"), F.lit("a").alias("source"), (F.col("id") % 5).cast("double").alias("score"), "content")
    b = m.where("id % 3 = 0").select("id", F.lit(2).alias("ord"), F.lit("b").alias("source"), (F.col("id") % 7).cast("double").alias("score"), F.col("entity").alias("content"))
    return selection.merged_by_id(a.unionByName(b))


@query(sql("SELECT id, CASE WHEN id % 2 = 0 THEN 1 ELSE 2 END AS priority FROM m WHERE id % 2 = 0 OR id % 3 = 0", "m"))
def priority_union(s, d):
    m = memories(s, d).select("id")
    return selection.priority_union(m.where("id % 2 = 0"), m.where("id % 3 = 0"))


@query(sql(", r AS (SELECT DISTINCT speaker, entity FROM m), o AS (SELECT DISTINCT speaker, entity FROM m WHERE content = 'v1' AND source_date < DATE '2024-01-05') SELECT * FROM r EXCEPT SELECT * FROM o", "m"))
def missing_phases(s, d):
    m = memories(s, d)
    return selection.missing_required(m, m.where("content = 'v1' AND source_date < DATE '2024-01-05'"), KEYS)


@query(sql(", n AS (SELECT speaker, id, row_number() OVER (PARTITION BY speaker ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY speaker) AS n FROM m) SELECT speaker, id FROM n WHERE list_contains([CAST(CASE WHEN least(4, n) <= 1 THEN 0 ELSE round_even(j * (n - 1) / (least(4, n) - 1), 0) END AS BIGINT) for j in range(0, least(4, n))], i)", "m"))
def evenly_spread(s, d):
    return selection.evenly_spread(memories(s, d).select("speaker", "id"), ["speaker"], 4, "id")


@query(sql(", x AS (SELECT id, speaker, row_number() OVER (PARTITION BY speaker ORDER BY id) AS n FROM m), p AS (SELECT a.id, b.id AS related, row_number() OVER (PARTITION BY a.id ORDER BY abs(a.n - b.n), b.id) AS k FROM x a JOIN x b ON a.speaker = b.speaker AND a.id <> b.id AND abs(a.n - b.n) <= 3) SELECT id, related FROM p WHERE k <= 3", "m"))
def related_memories(s, d):
    return selection.related(memories(s, d).select("id", F.col("speaker").alias("session")))


@query(sql(", h AS (SELECT id AS hit, speaker FROM m WHERE id % 100 = 0), x AS (SELECT hit, m.id, sum(length(m.content || m.entity)) OVER (PARTITION BY hit ORDER BY abs(m.id - hit), m.id) AS running FROM h JOIN m ON m.id BETWEEN hit - 4 AND hit + 4 AND m.type = (SELECT type FROM m z WHERE z.id = hit)) SELECT hit, id, CAST(running AS BIGINT) AS running FROM x WHERE running <= 30", "m"))
def expanded_hits(s, d):
    index = memories(s, d).select("id", F.col("type").alias("source"), (F.length("content") + F.length("entity")).cast("long").alias("size"))
    return selection.expanded_hits(index.where("id % 100 = 0"), index, 4, 30)


def _any(words):
    return " OR ".join(f"contains(lower(text), '{w}')" for w in words)


@query(sql(E + f"SELECT id, CASE WHEN regexp_matches(text, '[\\x{{4e00}}-\\x{{9fff}}]') THEN 'detailed' WHEN {_any(queries.TEMPORAL)} THEN 'temporal' WHEN {_any(queries.FACTUAL)} THEN 'factual' WHEN {_any(queries.INFERENTIAL)} THEN 'inferential' ELSE 'detailed' END AS category FROM e", "t"))
def query_category(s, d):
    return _texts(s, d).select("id", queries.category(F.col("text")).alias("category"))


@query(sql(E + "SELECT id, CASE WHEN contains(lower(text), 'when') THEN 'temporal_query' WHEN contains(lower(text), 'what') THEN 'factual_query' WHEN contains(lower(text), 'who') THEN 'entity_query' WHEN contains(lower(text), 'where') THEN 'location_query' WHEN contains(lower(text), 'why') OR contains(lower(text), 'how') THEN 'causal_query' ELSE 'general_query' END AS intent FROM e", "t"))
def query_intent(s, d):
    return _texts(s, d).select("id", queries.intent(F.col("text")).alias("intent"))


@query(sql("SELECT id, round(greatest(0, least(1, CAST(id % 11 AS DOUBLE) / 10 * CASE entity WHEN 'click' THEN 0.9 ELSE 0.6 END * 1.0 * least(1.2, 1.0 + (id % 3) * 0.1))), 6) AS fused FROM m", "m"))
def fused_scores(s, d):
    strategy = F.when(F.col("entity") == "click", 0.9).otherwise(0.6)
    return memories(s, d).select("id", F.round(retrieval.fused_score((F.col("id") % 11).cast("double") / 10, strategy, F.lit(None).cast("double"), F.col("id") % 3), 6).alias("fused"))


@query(sql("SELECT level, id, round(CAST(length(id) % 7 AS DOUBLE) / 7 * CASE level WHEN 'L1' THEN 1.0 WHEN 'L2' THEN 0.8 WHEN 'L3' THEN 0.3 WHEN 'L4' THEN 0.2 ELSE 0.15 END, 6) AS weighted FROM l", "l"))
def level_weighted(s, d):
    return levels(s, d).select("level", "id", F.round((F.length("id") % 7).cast("double") / 7 * queries.level_weight(F.col("level")), 6).alias("weighted"))


@query(sql("SELECT id, CASE WHEN DATE '2024-01-31' - source_date <= 1 THEN 0.1 WHEN DATE '2024-01-31' - source_date <= 7 THEN 0.05 WHEN DATE '2024-01-31' - source_date <= 30 THEN 0.02 ELSE 0.0 END AS bonus FROM m", "m"))
def freshness(s, d):
    return memories(s, d).select("id", dates.freshness_bonus(F.col("source_date"), F.lit("2024-01-31").cast("date")).alias("bonus"))


@query(sql(", c AS (SELECT entity, content, row_number() OVER (PARTITION BY entity ORDER BY source_date, id) AS n FROM m WHERE type = 'preference'), r AS (SELECT entity, content, source_date, row_number() OVER (PARTITION BY entity ORDER BY source_date DESC, id DESC) AS n FROM m) SELECT 1 AS section, entity, content FROM c WHERE n <= 3 UNION ALL SELECT 2, entity, content FROM r WHERE n <= 2", "m"))
def context_assembly(s, d):
    m = memories(s, d)
    first = timeline.top_k_per(m.where("type = 'preference'"), ["entity"], 3, "source_date", "id").select(F.lit(1).alias("section"), "entity", "content")
    recent = timeline.top_k_per(m, ["entity"], 2, F.desc("source_date"), F.desc("id")).select(F.lit(2).alias("section"), "entity", "content")
    return first.unionByName(recent)


@query(sql(", s AS (SELECT * FROM m WHERE id % 4 <> 0), n AS (SELECT id + 4 AS id, 'new' AS content, entity, type, speaker, source_date FROM m WHERE id % 4 = 0) SELECT id, content FROM s WHERE id NOT IN (SELECT id FROM n) UNION ALL SELECT id, content FROM n", "m"))
def upsert(s, d):
    m = memories(s, d)
    new = m.where("id % 4 = 0").withColumn("id", F.col("id") + 4).withColumn("content", F.lit("new"))
    return loaders.upserted(m.where("id % 4 <> 0"), new, ["id"]).select("id", "content")


@query(sql("SELECT id, CASE entity WHEN 'click' THEN 'tap' WHEN 'view' THEN 'look' ELSE entity END AS entity FROM m", "m"))
def renamed_entities(s, d):
    mapping = s.createDataFrame([("click", "tap"), ("view", "look")], "old string, new string")
    return loaders.renamed_entities(memories(s, d), mapping).select("id", "entity")


@query(sql("SELECT id FROM m WHERE id % 10 <> 3", "m"))
def delete_by_ids(s, d):
    m = memories(s, d)
    return loaders.without_ids(m, m.where("id % 10 = 3").select("id")).select("id")


@query(sql(", r AS (SELECT speaker, entity, id, content, source_date, lag(content) OVER w AS previous, row_number() OVER w AS change_number FROM m WINDOW w AS (PARTITION BY speaker, entity ORDER BY source_date, id)) SELECT speaker, entity, id, previous, CAST(change_number AS INT) AS change_number FROM r", "m"))
def previous_value(s, d):
    w = timeline.sequence(KEYS)
    return memories(s, d).select(*KEYS, "id", F.lag("content").over(w).alias("previous"), F.row_number().over(w).alias("change_number"))


@query(sql("SELECT speaker, entity, min(source_date) AS first_mention, string_agg(DISTINCT CAST(source_date AS VARCHAR), ',' ORDER BY CAST(source_date AS VARCHAR)) AS mention_days FROM m GROUP BY speaker, entity", "m"))
def mention_days(s, d):
    days = F.array_join(F.array_sort(F.collect_set(F.col("source_date").cast("string"))), ",")
    return memories(s, d).groupBy(*KEYS).agg(F.min("source_date").alias("first_mention"), days.alias("mention_days"))


@query(sql(E + ", p AS (SELECT x.id, x.text AS a, y.text AS b FROM e x JOIN e y ON y.id = x.id + 100) SELECT id, round(CASE WHEN c = 0 THEN 0 ELSE 2.0 * c / (lx + ly) END, 6) AS f1 FROM (SELECT id, len(x) AS lx, len(y) AS ly, len(list_intersect(x, y)) AS c FROM (SELECT id, list_distinct(list_filter(string_split(lower(a), ' '), lambda v: v <> '')) AS x, list_distinct(list_filter(string_split(lower(b), ' '), lambda v: v <> '')) AS y FROM p))", "t"))
def set_f1(s, d):
    return _pairs(s, d).select("id", F.round(text.set_f1(F.lower("a"), F.lower("b")), 6).alias("f1"))


@query(sql(", x AS (SELECT DISTINCT c.id FROM l c WHERE c.level = 'L2' AND EXISTS (SELECT 1 FROM l p WHERE p.id = c.parent AND p.level = 'L3')) SELECT id FROM x", "l"))
def sessions_in_built_days(s, d):
    l = levels(s, d)  # noqa: E741
    built = hierarchy.of_level(l, "L3").select(F.col("id").alias("parent"))
    return hierarchy.of_level(l, "L2").join(built, "parent", "left_semi").select("id").distinct()


@query(sql("SELECT session, min(date) AS date, max(turn) AS last_turn, count(*) FILTER (WHERE turn > 2) AS fresh FROM t GROUP BY session", "t"))
def session_last_turn(s, d):
    return turns(s, d).groupBy("session").agg(F.min("date").alias("date"), F.max("turn").alias("last_turn"), F.sum(F.when(F.col("turn") > 2, 1).otherwise(0)).alias("fresh"))


@query()
def sequence_similarity(s, d):
    """Ratcliff/Obershelp similarity of neighbouring turns; Python's definition, so no SQL."""
    return _pairs(s, d).select("id", F.round(text.sequence_ratio(F.col("a"), F.col("b")), 6).alias("ratio"))


@query()
def stemmed_f1(s, d):
    """Token F1 on Porter stems."""
    p = _pairs(s, d).select("id", *[text.stems(F.filter(F.split(text.normalize_answer(F.col(c)), " "), lambda t: t != "")).alias(c) for c in "ab"])
    return p.select("id", text.f1_of_tokens(F.col("a"), F.col("b")).alias("f1"))


@query()
def rouge_l(s, d):
    """F of the longest common subsequence of whole neighbouring turns."""
    words = lambda c: F.filter(F.split(F.lower(F.col(c)), r"\s+"), lambda t: t != "")
    return _pairs(s, d).select("id", F.round(text.rouge_l(words("a"), words("b")), 6).alias("rouge"))


@query()
def greedy_sample(s, d):
    items = memories(s, d).select("speaker", "id", F.col("content").alias("answer"), F.col("entity").alias("stratum"), (F.col("id") % 13 + 1).cast("double").alias("weight"))
    return selection.greedy_sample(items, "speaker", 5)


@query()
def diverse_rerank(s, d):
    e = _texts(s, d).select((F.col("id") / 100).cast("long").alias("query"), "id", (F.length("text") % 50 / 50).alias("score"), text.tokens(F.col("text")).alias("tokens"))
    return selection.diversified(e, "query", 3)


SLOTS = """, st AS (SELECT speaker AS u, id, CAST(source_date - DATE '2024-01-01' AS BIGINT) AS e FROM m WHERE entity = 'error'), se AS (SELECT u, day, row_number() OVER (PARTITION BY u ORDER BY day) - 1 AS k FROM (SELECT DISTINCT speaker AS u, CAST(source_date - DATE '2024-01-01' AS BIGINT) AS day FROM m WHERE entity = 'signup'))
, n AS (SELECT u, id, row_number() OVER (PARTITION BY u ORDER BY e, id) - 1 AS i, 2 * (SELECT count(*) FROM se WHERE se.u = st.u AND se.day < st.e) AS s FROM st)
, f AS (SELECT u, id, i + max(s - i) OVER (PARTITION BY u ORDER BY i) AS slot FROM n)
SELECT f.u AS "user", f.id, se.day AS stated_day FROM f LEFT JOIN se ON se.u = f.u AND se.k = f.slot // 2"""


@query(sql(SLOTS, "m"))
def capped_schedule(s, d):
    m = memories(s, d)
    start = F.lit("2024-01-01").cast("date")
    day = F.datediff("source_date", start).cast("long")
    statements = m.where("entity = 'error'").select(F.col("speaker").alias("user"), "id", day.alias("effective_day"))
    sessions = m.where("entity = 'signup'").select(F.col("speaker").alias("user"), day.alias("day")).distinct()
    return selection.scheduled(statements, sessions, 2)


STARTS = """, o AS (SELECT speaker, entity, CAST(source_date - DATE '2024-01-01' AS INT) AS day, content, list_position(['v0', 'v1', 'v2'], content) - 1 AS j FROM m)
, old AS (SELECT speaker, entity, arg_min(content, (day, content)) AS old FROM o GROUP BY ALL), c AS (SELECT s.s, r.r FROM range(3, 25) s(s), range(3) r(r))
SELECT speaker, entity, CAST(s AS INT) AS start, CAST(r AS INT) AS rotation, count(*) FILTER (WHERE day >= s) AS n FROM o JOIN old USING (speaker, entity), c GROUP BY speaker, entity, s, r
HAVING bool_and(CASE WHEN day >= s THEN j = (((day - s) // 7) + r) % 3 ELSE content = old END) AND count(*) FILTER (WHERE day >= s) > 0"""


@query(sql(STARTS, "m"))
def change_dates(s, d):
    """For each speaker and entity the days on which, and the rotations with which, a weekly alternation may have begun."""
    o = memories(s, d).select(*KEYS, F.datediff("source_date", F.lit("2024-01-01").cast("date")).alias("day"), F.col("content").alias("value"))
    return selection.change_dates(o, 3, 24, ["v0", "v1", "v2"], keys=KEYS, before=True)
