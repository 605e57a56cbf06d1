"""Queries on evaluation, statistics and visibility."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import hierarchy, metrics, retrieval, timeline
from ..sources.tables import levels, memories, sql, table, turns
from .registry import query
from .texts import LETTERS, WORD_LIST, STOP, E, _texts, _pairs
from .timelines import KEYS


@query(sql(E + f""", w AS (SELECT id, {WORD_LIST} AS w FROM e), b AS (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w WHERE len(w) > 1), u AS (SELECT unnest(w) AS g FROM w)
SELECT 1 AS n, count(DISTINCT g) AS kinds, count(*) AS total, round(count(DISTINCT g) / count(*), 6) AS share FROM u UNION ALL SELECT 2, count(DISTINCT g), count(*), round(count(DISTINCT g) / count(*), 6) FROM b""", "t"))  # fmt: skip
def distinct_n(s, d):
    w = _texts(s, d).select(text.words(F.col("text")).alias("w"))
    two = w.where(F.size("w") > 1).select(F.explode(F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1), lambda a, b: F.concat_ws(" ", a, b))).alias("g"))
    count = lambda df, n: df.agg(F.lit(n).alias("n"), F.countDistinct("g").alias("kinds"), F.count(F.lit(1)).alias("total"), F.round(F.countDistinct("g") / F.count(F.lit(1)), 6).alias("share"))
    return count(w.select(F.explode("w").alias("g")), 1).unionByName(count(two, 2))


@query(sql(E + f""", w AS (SELECT id, unnest(list_filter({WORD_LIST}, lambda x: length(x) > 2 AND NOT list_contains({STOP}, x))) AS w FROM e), tf AS (SELECT id, w, count(*) AS tf FROM w GROUP BY id, w)
, df AS (SELECT w, count(*) AS df FROM tf GROUP BY w), x AS (SELECT id, w, tf * (ln((1.0 + (SELECT count(*) FROM e)) / (1 + df)) + 1) AS v FROM tf JOIN df USING (w))
, y AS (SELECT id, w, round(v / sqrt(sum(v * v) OVER (PARTITION BY id)), 6) AS weight FROM x), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY weight DESC, w) AS n FROM y)
SELECT id, w AS word, weight FROM r WHERE n <= 5""", "t"))  # fmt: skip
def tfidf_keywords(s, d):
    e = _texts(s, d)
    tf = e.select("id", F.explode(text.tokens(F.col("text"))).alias("word")).groupBy("id", "word").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    total = e.agg(F.count(F.lit(1)).alias("n"))
    x = tf.join(df, "word").crossJoin(F.broadcast(total)).withColumn("v", F.col("tf") * (F.log((1.0 + F.col("n")) / (1 + F.col("df"))) + 1))  # one row of totals
    y = x.withColumn("weight", F.round(F.col("v") / F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("id"))), 6))
    return timeline.top_k_per(y, ["id"], 5, F.desc("weight"), "word").select("id", "word", "weight")


PAIR_WORDS = ", p AS (SELECT x.id, x.text AS a, y.text AS b FROM e x JOIN e y ON y.id = x.id + 100), a AS (SELECT id, w, count(*) AS c FROM (SELECT id, unnest(regexp_extract_all(lower(a), '" + LETTERS + "')) AS w FROM p) GROUP BY ALL), b AS (SELECT id, w, count(*) AS c FROM (SELECT id, unnest(regexp_extract_all(lower(b), '" + LETTERS + "')) AS w FROM p) GROUP BY ALL)" + "\n"


@query(sql(E + PAIR_WORDS + ", k AS (SELECT id, sum(least(a.c, b.c)) AS k FROM a JOIN b USING (id, w) GROUP BY id), la AS (SELECT id, sum(c) AS n FROM a GROUP BY id), lb AS (SELECT id, sum(c) AS n FROM b GROUP BY id) SELECT p.id, round(coalesce(2.0 * k / (la.n + lb.n), 0), 6) AS f FROM p LEFT JOIN k USING (id) LEFT JOIN la USING (id) LEFT JOIN lb USING (id)", "t"))
def rouge_1(s, d):
    p = _pairs(s, d).select("id", text.words(F.col("a")).alias("a"), text.words(F.col("b")).alias("b"))
    total = F.size("a") + F.size("b")
    return p.select("id", F.round(F.when(total > 0, 2 * text.multiset_common(F.col("a"), F.col("b")) / total).otherwise(0.0), 6).alias("f"))


@query(r"""SELECT doc_id, len(list_distinct(regexp_extract_all(text, '[0-9]+'))) AS numbers, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b'))), ',') AS addresses FROM documents WHERE text IS NOT NULL""")
def entity_patterns(s, d):
    found = lambda p: F.array_distinct(F.regexp_extract_all("text", F.lit(p), F.lit(0)))
    docs = table(s, d, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", F.size(found("[0-9]+")).cast("long").alias("numbers"), F.array_join(F.array_sort(found(r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b")), ",").alias("addresses"))


@query(sql("SELECT entity, type, count(*) AS n, round(avg(id % 100), 4) AS mean, round(coalesce(stddev_samp(id % 100), 0), 4) AS sd FROM m GROUP BY CUBE (entity, type)", "m"))
def token_stats_cube(s, d):
    v = F.col("id") % 100
    return memories(s, d).cube("entity", "type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(v), 4).alias("mean"), F.round(F.coalesce(F.stddev_samp(v), F.lit(0.0)), 4).alias("sd"))


@query("SELECT lang, count(*) AS n, round(1 - count(DISTINCT text) / CAST(count(*) AS DOUBLE), 6) AS repeated, round(avg(length(text)), 4) AS mean_chars, max(length(text)) AS max_chars FROM documents GROUP BY lang")
def content_quality(s, d):
    h = F.sha2("text", 256)
    return table(s, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(1 - F.countDistinct(h) / F.count(F.lit(1)), 6).alias("repeated"), F.round(F.avg(F.length("text")), 4).alias("mean_chars"), F.max(F.length("text")).cast("long").alias("max_chars"))


@query(sql("SELECT speaker, round(coalesce(sum(CASE WHEN type = 'fact' THEN 1 ELSE 0 END) / nullif(CAST(sum(CASE WHEN entity = 'purchase' THEN 1 ELSE 0 END) AS DOUBLE), 0), 0), 6) AS errors_per_purchase FROM m GROUP BY speaker", "m"))
def guarded_ratio(s, d):
    of = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return memories(s, d).groupBy("speaker").agg(F.round(metrics.ratio(of(F.col("type") == "fact"), of(F.col("entity") == "purchase")), 6).alias("errors_per_purchase"))


@query(sql(", g AS (SELECT entity, avg(CASE WHEN content = 'v1' THEN 1.0 ELSE 0 END) AS rate FROM m GROUP BY entity), t AS (SELECT * FROM (VALUES ('click', 0.33, 0.02), ('view', 0.5, 0.1), ('error', 0.3, 0.05)) v(entity, target, tolerance)) SELECT t.entity, round(rate, 6) AS measured, abs(rate - target) <= tolerance AS ok FROM t LEFT JOIN g USING (entity)", "m"))
def knob_comparison(s, d):
    rate = memories(s, d).groupBy("entity").agg(F.avg(F.when(F.col("content") == "v1", 1.0).otherwise(0.0)).alias("rate"))
    target = s.createDataFrame([("click", 0.33, 0.02), ("view", 0.5, 0.1), ("error", 0.3, 0.05)], "entity string, target double, tolerance double")
    return target.join(rate, "entity", "left").select("entity", F.round("rate", 6).alias("measured"), (F.abs(F.col("rate") - F.col("target")) <= F.col("tolerance")).alias("ok"))


@query("SELECT quality, round(avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0 END), 6) AS agreement, count(*) AS n FROM labels GROUP BY quality")
def judge_agreement(s, d):
    return table(s, d, "labels").groupBy("quality").agg(F.round(F.avg((F.col("quality") == F.col("toxic")).cast("int")), 6).alias("agreement"), F.count(F.lit(1)).alias("n"))


@query(sql("SELECT speaker, string_agg(entity || '=' || content, ',' ORDER BY source_date, id) AS history FROM m GROUP BY speaker", "m"))
def user_history(s, d):
    rows = F.array_sort(F.collect_list(F.struct("source_date", "id", F.concat_ws("=", "entity", "content").alias("x"))))
    return memories(s, d).groupBy("speaker").agg(F.array_join(F.transform(rows, lambda r: r["x"]), ",").alias("history"))


@query(sql(", w AS (SELECT speaker, entity, id, content, source_date, lag(content) OVER (PARTITION BY speaker, entity ORDER BY source_date, id) AS before FROM m) SELECT speaker, entity, min(source_date) AS first_change FROM w WHERE before IS NOT NULL AND before <> content GROUP BY speaker, entity", "m"))
def distinguishing_day(s, d):
    w = timeline.sequence(KEYS)
    return memories(s, d).withColumn("before", F.lag("content").over(w)).where("before <> content").groupBy(*KEYS).agg(F.min("source_date").alias("first_change"))


@query(sql(E + f""", w AS (SELECT id, {WORD_LIST} AS w FROM e), p AS (SELECT id, len(w) AS dl, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w), h AS (SELECT * FROM p WHERE x IN ('the', 'and'))
, c AS (SELECT id, dl, x, i, lag(x) OVER v AS y, lag(i) OVER v AS j FROM h WINDOW v AS (PARTITION BY id ORDER BY i)), f AS (SELECT id, dl, sum(0.1 / (i - j)) AS tf FROM c WHERE x <> y GROUP BY ALL)
SELECT id, round(tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / 100.0)), 6) AS score FROM f""", "t"))  # fmt: skip
def bm25_fixed_length(s, d):
    """The store function's form: cover density of all terms, no idf, k1 1.2, an average length of 100."""
    return retrieval.bm25_fixed(_texts(s, d), ["the", "and"]).select("id", F.round("score", 6).alias("score"))


@query(sql("SELECT speaker, count(*) AS visible, max(source_date) AS latest FROM m WHERE source_date <= DATE '2024-01-15' GROUP BY speaker", "m"))
def visible_at_cutoff(s, d):
    return memories(s, d).where("source_date <= DATE '2024-01-15'").groupBy("speaker").agg(F.count(F.lit(1)).alias("visible"), F.max("source_date").alias("latest"))


@query(sql("SELECT speaker, count(*) AS fresh FROM t WHERE date > DATE '2024-02-01' GROUP BY speaker", "t"))
def turns_since(s, d):
    return turns(s, d).where("date > DATE '2024-02-01'").groupBy("speaker").agg(F.count(F.lit(1)).alias("fresh"))


@query(sql(", c AS (SELECT * FROM (VALUES ('L1', 4), ('L2', 3), ('L3', 1)) v(level, cap)), r AS (SELECT l.level, id, cap, row_number() OVER (PARTITION BY l.level ORDER BY length(id) DESC, id) AS n FROM l JOIN c ON c.level = l.level) SELECT level, id FROM r WHERE n <= cap", "l"))
def strategy_caps(s, d):
    caps = s.createDataFrame([("L1", 4), ("L2", 3), ("L3", 1)], "level string, cap int")
    return timeline.top_k_per(levels(s, d).join(F.broadcast(caps), "level"), ["level"], F.col("cap"), F.desc(F.length("id")), "id", most=4).select("level", "id")


@query("SELECT DISTINCT CAST(o_orderdate AS DATE) AS d, strftime(o_orderdate, '%Y-%m') || '/' || CAST(isoyear(o_orderdate) AS VARCHAR) || '-W' || lpad(CAST(weekofyear(o_orderdate) AS VARCHAR), 2, '0') AS week, CAST(date_trunc('week', o_orderdate) AS DATE) AS first, CAST(CAST(date_trunc('week', o_orderdate) AS DATE) + 6 AS DATE) AS last FROM orders")
def clipped_weeks(s, d):
    day = F.col("d")
    return table(s, d, "orders").select(F.to_date("o_orderdate").alias("d")).distinct().select("d", dates.clipped_week(day).alias("week"), dates.week_start(day).alias("first"), dates.week_end(day).alias("last"))


@query(sql("SELECT id, level, period, CAST(CASE level WHEN 'L4' THEN period + 6 WHEN 'L5' THEN last_day(period) ELSE period END AS DATE) AS fin, round(least(1.0, (CASE level WHEN 'L4' THEN 7 WHEN 'L5' THEN 28 ELSE 1 END) / 7.0), 6) AS ratio FROM l WHERE level IN ('L3', 'L4', 'L5')", "l"))
def window_completeness(s, d):
    l = levels(s, d).where("level IN ('L3', 'L4', 'L5')")  # noqa: E741
    days = F.when(F.col("level") == "L4", 7).when(F.col("level") == "L5", 28).otherwise(1)
    return l.select("id", "level", "period", hierarchy.period_end(F.col("level"), F.col("period")).alias("fin"), F.round(F.least(F.lit(1.0), days / 7), 6).alias("ratio"))


@query(sql("SELECT fresh, count(*) AS n, round(avg(f1), 6) AS mean_f1 FROM (SELECT source_date >= DATE '2024-01-20' AS fresh, CAST(id % 101 AS DOUBLE) / 100 AS f1 FROM m) GROUP BY fresh", "m"))
def new_and_repeated(s, d):
    m = memories(s, d).select((F.col("source_date") >= F.lit("2024-01-20").cast("date")).alias("fresh"), ((F.col("id") % 101).cast("double") / 100).alias("f1"))
    return m.groupBy("fresh").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("f1"), 6).alias("mean_f1"))


@query(sql("SELECT entity, count(*) AS n, count(DISTINCT speaker) AS covered, round(avg(CAST(id % 11 AS DOUBLE) / 10), 6) AS mean FROM m GROUP BY entity", "m"))
def strategy_coverage(s, d):
    return memories(s, d).groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("speaker").alias("covered"), F.round(F.avg((F.col("id") % 11).cast("double") / 10), 6).alias("mean"))


@query(sql("SELECT 'memories' AS name, count(*) AS n FROM m UNION ALL SELECT 'turns', count(*) FROM t UNION ALL SELECT 'nodes', count(*) FROM l", "m", "t", "l"))
def table_counts(s, d):
    parts = {"memories": memories(s, d), "turns": turns(s, d), "nodes": levels(s, d)}
    out = None
    for name, df in parts.items():
        c = df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
        out = c if out is None else out.unionByName(c)
    return out


@query(sql("SELECT a.id AS day, b.id AS week FROM l a JOIN l b ON a.level = 'L3' AND b.level = 'L4' AND a.period BETWEEN b.period AND b.period + 6", "l"))
def calendar_parents(s, d):
    l = levels(s, d)  # noqa: E741
    days = hierarchy.of_level(l, "L3").select(F.col("id").alias("day"), dates.week_start(F.col("period")).alias("period"))
    return days.join(hierarchy.of_level(l, "L4").select(F.col("id").alias("week"), "period"), "period").select("day", "week")
