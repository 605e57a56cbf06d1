"""Queries on stored rows as they are cleaned and named, on neighbours, parents and periods, and on forms of text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..api import MemoryStore
from ..functions import dates, queries, text, vectors
from ..operators import hierarchy, retrieval, selection, timeline
from ..sources import loaders
from ..sources.tables import levels, memories, sql, table, turns
from .registry import query
from .texts import E, QV, _texts, _vector


@query(sql("""SELECT content, trim(lower(' ' || upper(entity) || ' ')) AS entity, CASE WHEN id % 5 = 0 THEN 'preference' ELSE type END AS type, CASE WHEN id % 3 = 0 THEN 'user' ELSE speaker END AS speaker, CASE WHEN id % 2 = 0 THEN source_date ELSE DATE '2024-02-02' END AS source_date, id FROM m""", "m"))
def cleaned_rows(s, d):
    """Records with odd names and missing fields as they are stored."""
    m = memories(s, d)
    raw = m.select("content", F.concat(F.lit(" "), F.upper("entity"), F.lit(" ")).alias("entity"), F.when(F.col("id") % 5 == 0, " ").otherwise(F.col("type")).alias("type"), F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.upper("speaker")).alias("speaker"), F.when(F.col("id") % 2 == 0, F.col("source_date").cast("string")).otherwise("").alias("date"), "id")
    return loaders.cleaned_records(raw.withColumn("content", F.struct("content", "id")), "2024-02-02").select("content.content", "entity", "type", "speaker", "source_date", "content.id")


@query(sql("SELECT DISTINCT entity FROM m WHERE entity <> ''", "m"))
def listed_entities(s, d):
    return MemoryStore(memories(s, d), None, None).list_entities()


@query(sql("SELECT DISTINCT 'user_' || CAST(user_id * 2 AS VARCHAR) AS name FROM events WHERE 'user_' || CAST(user_id * 2 AS VARCHAR) NOT IN (SELECT speaker FROM m)", "m"))
def names_without_rows(s, d):
    asked = table(s, d, "events").select(F.concat(F.lit(" User_"), (F.col("user_id") * 2).cast("string")).alias("name"))
    return MemoryStore(memories(s, d), None, None).unknown_names(asked, "speaker")


@query(sql(", w AS (SELECT DISTINCT CAST(date_trunc('week', source_date) AS DATE) AS w FROM m WHERE id % 11 = 0) SELECT 'week:' || CAST(w AS VARCHAR) AS period FROM w UNION SELECT 'month:' || strftime(w, '%Y-%m') FROM w UNION SELECT 'month:' || strftime(w + 6, '%Y-%m') FROM w", "m"))
def touched_periods(s, d):
    """The weeks and months of late rows, a week that reaches into a second month with both."""
    return MemoryStore(memories(s, d), None, None).affected_periods(memories(s, d).where("id % 11 = 0"))


@query(sql("SELECT DISTINCT id, 'repeated id' AS rule FROM (SELECT id % 4000 AS id FROM m) GROUP BY id HAVING count(*) > 1 UNION ALL SELECT id % 4000, 'date out of range' FROM m WHERE source_date NOT BETWEEN DATE '2024-01-02' AND DATE '2024-01-25'", "m"))
def question_violations(s, d):
    asked = memories(s, d).select((F.col("id") % 4000).alias("id"), F.col("source_date").alias("asked_on"))
    return loaders.violations(asked, F.lit("2024-01-02").cast("date"), F.lit("2024-01-25").cast("date"))


@query("SELECT p_brand AS category, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) AS items FROM part GROUP BY p_brand")
def items_by_category(s, d):
    """Items grouped by category; a group's list is as long as the category."""
    p = table(s, d, "part").select(F.col("p_brand").alias("category"), F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"))
    return loaders.grouped_items(p).select("category", F.array_join(F.transform("items", lambda x: x["item_id"].cast("string")), ",").alias("items"))


@query("SELECT l_orderkey, l_linenumber, p_brand AS category FROM lineitem LEFT JOIN part ON p_partkey = l_partkey")
def category_lookup(s, d):
    """Each line's category: a dimension lookup that keeps lines without one; whether it is broadcast follows from the dimension's size."""
    lines = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"))
    return lines.join(table(s, d, "part").select("p_partkey", F.col("p_brand").alias("category")), "p_partkey", "left").drop("p_partkey")


@query(sql("SELECT DISTINCT id FROM l WHERE parent = 'w:1996-01-08' AND level = 'L3'", "l"))
def neighbours_of_kind(s, d):
    """Nodes with an edge of a kind into one week."""
    l = levels(s, d).where("parent IS NOT NULL")  # noqa: E741
    return hierarchy.neighbours(l.select(F.col("id").alias("src"), F.col("parent").alias("dst"), F.col("level").alias("kind")), "w:1996-01-08", "in", "L3")


CAPS = {"L2": 4, "L3": 3, "L4": 2, "L5": 1}
CAPPED = """, h AS (SELECT o_custkey % 50 AS query, o_orderkey, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey % 101, o_orderkey) AS rank, 's:' || CAST(o_custkey AS VARCHAR) || ':' || CAST(d AS VARCHAR) AS l2, 'd:' || CAST(d AS VARCHAR) AS l3, 'w:' || CAST(w AS VARCHAR) AS l4, 'm:' || CAST(mo AS VARCHAR) AS l5 FROM o)
, x AS (SELECT query, rank, 'L2' AS level, l2 AS id FROM h WHERE rank <= 20 UNION ALL SELECT query, rank, 'L3', l3 FROM h WHERE rank <= 20 UNION ALL SELECT query, rank, 'L4', l4 FROM h WHERE rank <= 20 UNION ALL SELECT query, rank, 'L5', l5 FROM h WHERE rank <= 20)
, f AS (SELECT query, x.level, x.id, min(rank) AS first_rank FROM x JOIN (SELECT level, id FROM l) n ON n.level = x.level AND n.id = x.id GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query, level ORDER BY first_rank, id) AS n FROM f)
SELECT query, level, id, first_rank FROM r WHERE n <= CASE level WHEN 'L2' THEN 4 WHEN 'L3' THEN 3 WHEN 'L4' THEN 2 ELSE 1 END"""


@query(sql(CAPPED, "l"))
def capped_parents(s, d):
    """The sessions, days, weeks and months that each query's 20 best orders lead to, some of each level, by their first order."""
    o = table(s, d, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("d"))
    hits = selection.first_of_each(o.withColumn("query", F.col("o_custkey") % 50), ["query"], 20, F.col("o_orderkey") % 101, "o_orderkey")
    rank = F.row_number().over(timeline.Window.partitionBy("query").orderBy(F.col("o_orderkey") % 101, "o_orderkey"))
    day, week, month = (c.cast("date").cast("string") for c in (F.col("d"), F.date_trunc("week", "d"), F.trunc("d", "month")))
    chain = {"L2": F.concat_ws(":", F.lit("s"), F.col("o_custkey").cast("string"), day), "L3": F.concat(F.lit("d:"), day), "L4": F.concat(F.lit("w:"), week), "L5": F.concat(F.lit("m:"), month)}
    return hierarchy.capped_parents(hits.select("query", rank.alias("rank"), *[c.alias(k) for k, c in chain.items()]), levels(s, d), CAPS)


@query(sql(""", x AS (SELECT speaker, source_date AS day, lag(source_date) OVER (PARTITION BY speaker ORDER BY source_date) AS previous FROM (SELECT DISTINCT speaker, source_date FROM m))
SELECT speaker, day, previous, coalesce(date_trunc('week', day) <> date_trunc('week', previous), true) AS new_week, coalesce(date_trunc('month', day) <> date_trunc('month', previous), true) AS new_month, CAST(day - previous AS INT) AS days,
  CAST((CAST(date_trunc('week', day) AS DATE) - CAST(date_trunc('week', previous) AS DATE)) // 7 AS INT) AS weeks, CAST((year(day) * 12 + month(day)) - (year(previous) * 12 + month(previous)) AS INT) AS months FROM x""", "m"))  # fmt: skip
def period_steps(s, d):
    return timeline.period_steps(memories(s, d).select("speaker", F.col("source_date").alias("day")), ["speaker"], "day")


@query(sql(", p AS (SELECT date, count(*) AS n FROM (SELECT DISTINCT session, date FROM t) GROUP BY date) SELECT date, n AS in_day, CAST(sum(n) OVER (PARTITION BY date_trunc('week', date)) AS BIGINT) AS in_week, CAST(sum(n) OVER (PARTITION BY date_trunc('month', date)) AS BIGINT) AS in_month FROM p", "t"))
def sessions_of_periods(s, d):
    return timeline.sessions_of_periods(turns(s, d).select("session", "date").distinct(), "date")


@query(sql(""", a AS (SELECT DISTINCT speaker, entity, source_date <= DATE '2024-01-15' AS early FROM m), b AS (SELECT speaker, entity, bool_or(early) AS e, bool_or(NOT early) AS l FROM a GROUP BY ALL)
SELECT speaker, count(*) FILTER (e AND NOT l) AS dropped, count(*) FILTER (l AND NOT e) AS added, count(*) FILTER (e AND NOT l) = 0 AS kept_all, count(*) FILTER (l AND NOT e) = 0 AS subset FROM b GROUP BY speaker""", "m"))  # fmt: skip
def entity_sets(s, d):
    """Which speakers' later entities hold all earlier ones, or nothing but them: set differences by one aggregate."""
    seen = memories(s, d).groupBy("speaker", "entity").agg(F.bool_or(F.col("source_date") <= "2024-01-15").alias("e"), F.bool_or(F.col("source_date") > "2024-01-15").alias("l"))
    dropped, added = F.count_if(F.col("e") & ~F.col("l")), F.count_if(F.col("l") & ~F.col("e"))
    return seen.groupBy("speaker").agg(dropped.alias("dropped"), added.alias("added"), (dropped == 0).alias("kept_all"), (added == 0).alias("subset"))


DOT = "list_sum(list_transform(list_zip(embedding, q), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE)))"


@query(f"SELECT vec_id, round({DOT}, 6) AS score FROM embeddings, {QV} ORDER BY {DOT} DESC, vec_id LIMIT 10")
def dot_search(s, d):
    return vectors.knn(table(s, d, "embeddings"), _vector(s, d), 10, vectors.dot, "desc").select("vec_id", F.round("score", 6).alias("score"))


@query(sql(E + "SELECT id, round(CASE WHEN length(text) BETWEEN 100 AND 800 THEN 0.02 ELSE 0 END + CASE WHEN regexp_matches(text, '[0-9]') THEN 0.01 ELSE 0 END + CASE WHEN regexp_matches(text, '[:：•-]') THEN 0.01 ELSE 0 END, 6) AS bonus FROM e", "t"))
def completeness(s, d):
    return _texts(s, d).select("id", F.round(retrieval.completeness_bonus(F.col("text")), 6).alias("bonus"))


@query("WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?;。！？；\n]'), lambda x: trim(x, ' ')), lambda x: x <> '') AS s FROM documents) SELECT doc_id, len(s) AS n, coalesce(list_max(list_transform(s, lambda x: length(x))), 0) AS longest FROM p")
def sentence_counts(s, d):
    """How many sentences every document has, by Latin and CJK ends, and how long the longest is."""
    found = table(s, d, "documents").select("doc_id", text.split_any_sentences(F.col("text")).alias("s"))
    return found.select("doc_id", F.size("s").alias("n"), F.coalesce(F.array_max(F.transform("s", lambda x: F.length(x))), F.lit(0)).alias("longest"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9]+|[一-鿿]')) AS words FROM documents")
def cjk_words(s, d):
    return table(s, d, "documents").select("doc_id", text.cjk_estimate(F.col("text")).alias("words"))


@query(sql(E + "SELECT id, contains(lower(text), 'tina the') OR contains(lower(text), 't.') OR contains(lower(text), 'tina') OR contains(lower(text), 'the') AS named FROM e", "t"))
def names_in_texts(s, d):
    """Whether a turn names a person: the whole name, its initial, or a part of it."""
    return _texts(s, d).select("id", queries.named_in(F.col("text"), F.lit("Tina The")).alias("named"))


SYNONYMS = {"click": ["press", "tap"], "view": ["see", "press"], "v1": ["first"]}


@query(sql(""", x AS (SELECT id, entity, content, [entity, content] AS terms FROM m), y AS (SELECT id, terms || CASE entity WHEN 'click' THEN ['press', 'tap'] WHEN 'view' THEN ['see', 'press'] ELSE [] END || CASE content WHEN 'v1' THEN ['first'] ELSE [] END AS terms FROM x) SELECT id, array_to_string(terms, ' ') AS terms FROM y""", "m"))
def expanded_terms(s, d):
    return memories(s, d).select("id", F.array_join(queries.expanded(F.array("entity", "content"), SYNONYMS), " ").alias("terms"))


@query("SELECT event_id, CAST(CASE event_id % 4 WHEN 0 THEN date_trunc('second', ts) WHEN 3 THEN date_trunc('day', ts) ELSE date_trunc('minute', ts) END AS TIMESTAMP) AS at FROM events")
def parsed_times(s, d):
    """Times written in four notations, read back."""
    ts, k = F.col("ts").cast("timestamp"), F.col("event_id") % 4
    said = F.when(k == 0, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).when(k == 1, F.date_format(ts, "h:mm a 'on' d MMMM, yyyy")).when(k == 2, F.date_format(ts, "yyyy/MM/dd (EEE) HH:mm")).otherwise(F.date_format(ts, "yyyy-MM-dd"))
    return table(s, d, "events").select("event_id", dates.parsed_time(said).cast("timestamp_ntz").alias("at"))


@query("SELECT event_id, CAST(CASE event_id % 3 WHEN 0 THEN date_trunc('year', ts) WHEN 1 THEN date_trunc('month', ts) ELSE ts END AS DATE) AS first, CAST(CASE event_id % 3 WHEN 0 THEN date_trunc('year', ts) + INTERVAL 1 YEAR - INTERVAL 1 DAY WHEN 1 THEN last_day(CAST(ts AS DATE)) ELSE ts END AS DATE) AS last FROM events")
def widened_dates(s, d):
    """Years, months and days as their first and last day."""
    k, ts = F.col("event_id") % 3, F.col("ts")
    said = F.when(k == 0, F.date_format(ts, "yyyy")).when(k == 1, F.date_format(ts, "yyyy-MM")).otherwise(F.date_format(ts, "yyyy-MM-dd"))
    return table(s, d, "events").select("event_id", dates.widened(said).alias("first"), dates.widened(said, True).alias("last"))
