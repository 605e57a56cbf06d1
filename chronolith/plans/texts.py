"""Queries on texts: functions, retrieval and scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text, vectors
from ..operators import consolidation, retrieval, timeline
from ..sources.tables import memories, sql, table, turns
from .registry import query

STOP, KEY_STOP = ("[" + ", ".join(f"'{w}'" for w in x) + "]" for x in (text.STOPWORDS, text.KEY_STOPWORDS))
WORDS = r"regexp_extract_all(lower(text), '\b\w+\b')"
LETTERS = r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]+"
WORD_LIST = f"regexp_extract_all(lower(text), '{LETTERS}')"


def _docs(s, d):
    return table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("title"), "text", "lang")


def _texts(s, d):
    """Turns with their texts as they are."""
    return turns(s, d).select((F.col("session") * 100 + F.col("turn")).alias("id"), "text")


E = ", e AS (SELECT session * 100 + turn AS id, text FROM t)\n"
# DuckDB's classes are of ASCII alone, so that letters and word ends are spelled out.
EDGE = r"[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Nl}}\p{{Pc}}]"
ARTICLES = rf"(^|{EDGE})(a|an|the|and)({EDGE}|$)"
N = rf"trim(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace({{0}}, ',', '', 'g'), '{ARTICLES}', '\1 \3', 'gi'), '{ARTICLES}', '\1 \3', 'gi'), '[!-/:-@\[-`{{{{-~]', '', 'g')), '[\s\x0B\x{{{{85}}}}\p{{{{Z}}}}]+', ' ', 'g'))"


@query(sql(E + f"SELECT id, {N.format('text')} AS answer FROM e", "t"))
def normalize_answer(s, d):
    return _texts(s, d).select("id", text.normalize_answer(F.col("text")).alias("answer"))


@query(sql(E + f"SELECT id, array_to_string(list_filter({WORD_LIST}, lambda x: length(x) > 2 AND NOT list_contains({STOP}, x)), ' ') AS tokens FROM e", "t"))
def tokenize(s, d):
    return _texts(s, d).select("id", F.array_join(text.tokens(F.col("text")), " ").alias("tokens"))


@query(sql(E + f""", w AS (SELECT id, unnest({WORD_LIST}) AS w, generate_subscripts({WORD_LIST}, 1) AS i FROM e), f AS (SELECT id, w, min(i) AS i FROM w WHERE length(w) > 2 AND NOT list_contains({KEY_STOP}, w) GROUP BY id, w)
, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) AS n FROM f) SELECT id, string_agg(w, ' ' ORDER BY i) AS terms FROM r WHERE n <= 15 GROUP BY id""", "t"))  # fmt: skip
def key_terms(s, d):
    terms = _texts(s, d).select("id", F.array_join(text.key_terms(F.col("text")), " ").alias("terms"))
    return terms.where("terms <> ''")


@query(sql(E + f""", w AS (SELECT unnest({WORD_LIST}) AS w FROM e) SELECT w AS word, count(*) AS n FROM w WHERE length(w) > 2 AND NOT list_contains({STOP}, w) GROUP BY w ORDER BY n DESC, w LIMIT 20""", "t"))
def top_keywords(s, d):
    words = _texts(s, d).select(F.explode(text.tokens(F.col("text"))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(20)


@query(sql(E + r""", s AS (SELECT id, unnest(list_filter(list_transform(regexp_split_to_array(text, '[.!?;]'), lambda x: trim(x)), lambda x: x <> '')) AS sentence, generate_subscripts(list_filter(list_transform(regexp_split_to_array(text, '[.!?;]'), lambda x: trim(x)), lambda x: x <> ''), 1) AS pos FROM e)
, w AS (SELECT id, pos, unnest(list_filter(regexp_extract_all(lower(sentence), '""" + LETTERS + r"""'), lambda x: length(x) > 2 AND NOT list_contains(""" + STOP + r""", x))) AS w FROM s)
, f AS (SELECT id, w, count(*) AS c FROM w GROUP BY id, w), v AS (SELECT id, pos, avg(c) AS score FROM w JOIN f USING (id, w) GROUP BY id, pos)
, r AS (SELECT s.id, pos, sentence, row_number() OVER (PARTITION BY s.id ORDER BY round(coalesce(score, 0), 6) DESC, pos) AS n FROM s LEFT JOIN v USING (id, pos))
SELECT id, string_agg(sentence, ' ' ORDER BY pos) AS summary FROM r WHERE n <= 3 GROUP BY id""", "t"))  # fmt: skip
def extractive_summary(s, d):
    sentences = _texts(s, d).select("id", F.posexplode(text.split_sentences(F.col("text"))).alias("pos", "sentence"))
    words = sentences.select("id", "pos", F.explode(text.tokens(F.col("sentence"))).alias("w"))
    freq = words.withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("id", "w"))).groupBy("id", "pos").agg(F.avg("c").alias("score"))
    ranked = sentences.join(freq, ["id", "pos"], "left").withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc(F.round(F.coalesce("score", F.lit(0.0)), 6)), "pos")))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "sentence")))
    return ranked.where("n <= 3").groupBy("id").agg(F.array_join(F.transform(ordered, lambda x: x["sentence"]), " ").alias("summary"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), 'https?://[^\s<>"]+', '', 'g'), '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b', '', 'g'), '\b\d{3}[-.]?\d{3}[-.]?\d{4}\b', '', 'g'), '\s+', ' ', 'g'), '[^A-Za-z0-9 ]', '', 'g')) AS clean FROM (SELECT page_id, regexp_replace(html, '[^\x00-\x7F]', '', 'g') AS html FROM pages)""")
def clean_text(s, d):
    return table(s, d, "pages").select("page_id", text.clean_text(F.regexp_replace("html", "[^\\x00-\\x7F]", "")).alias("clean"))


@query("SELECT doc_id, CASE WHEN coalesce(length(text), 0) = 0 THEN 'unknown' WHEN length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) / length(text) > 0.5 THEN 'english' ELSE 'mixed' END AS kind FROM documents")
def detect_language(s, d):
    return table(s, d, "documents").select("doc_id", text.detect_language(F.col("text")).alias("kind"))


@query("SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN '' ELSE substr(sha256(text), 1, 16) END AS hash FROM documents")
def content_hash(s, d):
    return table(s, d, "documents").select("doc_id", text.content_hash(F.col("text"), 16).alias("hash"))


@query(sql(E + r""", k AS (SELECT id, lower(text) AS c, (length(text) - length(replace(lower(text), 'the', ''))) / 3.0 AS n, len(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS size FROM e)
SELECT id, round(CASE WHEN n = 0 THEN 0.1 ELSE least(1.0, greatest(0.1, least(1.0, n / size * 20) * 0.6 + (1.0 - (instr(c, 'the') - 1) / length(c) * 0.3) * 0.3 + CASE WHEN contains(' ' || c || ' ', ' the ') THEN 0.2 ELSE 0 END)) END, 6) AS relevance FROM k""", "t"))  # fmt: skip
def keyword_relevance(s, d):
    return _texts(s, d).select("id", F.round(text.keyword_relevance(F.col("text"), "the"), 6).alias("relevance"))


@query(sql(""", c AS (SELECT session, turn // 5 AS chunk, min(date) AS date, string_agg(speaker || ': ' || text, chr(10) ORDER BY turn) AS lines, array_to_string(list_sort(list(DISTINCT lower(speaker))), ',') AS speakers FROM t GROUP BY 1, 2)
SELECT session, chunk, 'Date: ' || CAST(date AS VARCHAR) || chr(10) || lines AS content, speakers FROM c""", "t"))  # fmt: skip
def chunk_turns(s, d):
    ordered = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "speaker", "text").alias("line"))))
    g = turns(s, d).groupBy("session", F.floor(F.col("turn") / 5).alias("chunk")).agg(F.min("date").alias("date"), ordered.alias("l"), F.array_join(F.array_sort(F.collect_set(F.lower("speaker"))), ",").alias("speakers"))
    return g.select("session", "chunk", F.concat(F.lit("Date: "), F.col("date").cast("string"), F.lit("\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("content"), "speakers")


def _pairs(s, d):
    """Each turn with the next session's at the same turn."""
    return _neighbours(_texts(s, d))


def _neighbours(e):
    e = e.select("id", F.col("text").alias("a"))
    return e.join(e.select((F.col("id") - 100).alias("id"), F.col("a").alias("b")), "id")


PAIRS = ", p AS (SELECT x.id, x.text AS a, y.text AS b FROM e x JOIN e y ON y.id = x.id + 100)\n"
SETS = r", s AS (SELECT id, list_distinct(list_filter(regexp_split_to_array(lower(a), '\s+'), lambda x: x <> '')) AS x, list_distinct(list_filter(regexp_split_to_array(lower(b), '\s+'), lambda x: x <> '')) AS y FROM p), n AS (SELECT id, len(x) AS lx, len(y) AS ly, len(list_intersect(x, y)) AS c FROM s)" + "\n"


@query(sql(E + PAIRS + SETS + "SELECT id, round(CASE WHEN lx = 0 OR ly = 0 THEN 0 WHEN c = least(lx, ly) THEN greatest(c / (lx + ly - c), 0.85) ELSE c / (lx + ly - c) END, 6) AS score FROM n", "t"))
def token_jaccard(s, d):
    return _pairs(s, d).select("id", F.round(text.token_jaccard(F.col("a"), F.col("b")), 6).alias("score"))


BAGS = f", q AS (SELECT id, {N.format('a')} AS a, {N.format('b')} AS b FROM p), ta AS (SELECT id, w, count(*) AS c FROM (SELECT id, unnest(string_split(a, ' ')) AS w FROM q) WHERE w <> '' GROUP BY ALL), tb AS (SELECT id, w, count(*) AS c FROM (SELECT id, unnest(string_split(b, ' ')) AS w FROM q) WHERE w <> '' GROUP BY ALL)\n"
F1 = ", k AS (SELECT id, sum(least(ta.c, tb.c)) AS k FROM ta JOIN tb USING (id, w) GROUP BY id), la AS (SELECT id, sum(c) AS n FROM ta GROUP BY id), lb AS (SELECT id, sum(c) AS n FROM tb GROUP BY id), f1 AS (SELECT q.id, CASE WHEN k IS NULL THEN 0 ELSE 2.0 * k / (la.n + lb.n) END AS f FROM q LEFT JOIN k USING (id) LEFT JOIN la USING (id) LEFT JOIN lb USING (id))\n"


@query(sql(E + PAIRS + BAGS + F1 + "SELECT id, round(f, 6) AS f1 FROM f1", "t"))
def token_f1(s, d):
    return _pairs(s, d).select("id", F.round(text.token_f1(F.col("a"), F.col("b")), 6).alias("f1"))


@query(sql(E + PAIRS + BAGS + F1 + "SELECT id, round(CASE WHEN id % 2 = 0 THEN f WHEN lower(a) LIKE '%no record%' THEN 1.0 ELSE 0.0 END, 6) AS score FROM f1 JOIN p USING (id)", "t"))
def score_answer(s, d):
    category = F.when(F.col("id") % 2 == 0, 2).otherwise(5)
    return _pairs(s, d).select("id", F.round(text.score_answer(F.col("a"), F.col("b"), category), 6).alias("score"))


@query(sql(E + f"SELECT id, list_contains({WORD_LIST}, 'the') OR list_contains({WORD_LIST}, 'and') AS strict FROM e", "t"))
def strict_check(s, d):
    return _texts(s, d).select("id", text.strict_check(F.col("text"), F.array(F.lit("The"), F.lit("and")), F.lit("exact")).alias("strict"))


@query(sql(", x AS (SELECT id, 'on ' || strftime(source_date, '%Y-%m-%d') || ' and ' || strftime(source_date + 1, '%b %-d, %Y') || ' or ' || strftime(source_date + 2, '%-d %B %Y') AS text, source_date AS a FROM m) SELECT id, CAST(a AS VARCHAR) || ',' || CAST(CAST(a + 1 AS DATE) AS VARCHAR) || ',' || CAST(CAST(a + 2 AS DATE) AS VARCHAR) AS dates FROM x", "m"))
def dates_in_text(s, d):
    day = F.col("source_date")
    prose = F.concat(F.lit("on "), day.cast("string"), F.lit(" and "), F.date_format(F.date_add(day, 1), "MMM d, yyyy"), F.lit(" or "), F.date_format(F.date_add(day, 2), "d MMMM yyyy"))
    return memories(s, d).select("id", F.array_join(F.transform(text.dates_in_text(prose), lambda x: x.cast("string")), ",").alias("dates"))


@query(sql(E + PAIRS + "SELECT id, lower(trim(a)) = lower(trim(b)) AS same FROM p", "t"))
def exact_match(s, d):
    return _pairs(s, d).select("id", (F.lower(F.trim("a")) == F.lower(F.trim("b"))).alias("same"))


QUERY = ["the", "that", "the"]


@query(sql(E + f""", w AS (SELECT id, {WORD_LIST} AS w FROM e), f AS (SELECT id, len(w) AS dl, len(list_filter(w, lambda x: x = 'the')) AS a, len(list_filter(w, lambda x: x = 'that')) AS b FROM w)
, g AS (SELECT count(*) AS n, avg(dl) AS avgdl, sum(CASE WHEN a > 0 THEN 1 END) AS da, sum(CASE WHEN b > 0 THEN 1 END) AS db FROM f)
SELECT id, round(CASE WHEN a > 0 THEN 2 * ln(n / da) * a * 2.5 / (a + 1.5 * (0.25 + 0.75 * dl / avgdl)) ELSE 0 END + CASE WHEN b > 0 THEN ln(n / db) * b * 2.5 / (b + 1.5 * (0.25 + 0.75 * dl / avgdl)) ELSE 0 END, 6) AS score FROM f, g WHERE a > 0 OR b > 0""", "t"))  # fmt: skip
def bm25(s, d):
    return retrieval.bm25(_texts(s, d), QUERY).select("id", F.round("score", 6).alias("score"))


@query(sql(E + f"SELECT id FROM e WHERE list_contains({WORD_LIST}, 'the') AND list_contains({WORD_LIST}, 'that')", "t"))
def fts_and(s, d):
    return retrieval.fts_and(_texts(s, d), ["the", "That"]).select("id")


@query("SELECT doc_id AS id, 1.0 + CASE WHEN contains(lower(source), 'src1') THEN 0.5 ELSE 0 END + CASE WHEN contains(lower(text), 'src1') THEN 0.3 ELSE 0 END AS score FROM documents WHERE contains(lower(source), 'src1') OR contains(lower(text), 'src1') ORDER BY score DESC, id LIMIT 20")
def like_search(s, d):
    return retrieval.like_search(_docs(s, d), "SRC1").select("id", F.col("score"))


@query(sql(E + ", f AS (SELECT id, text FROM e WHERE contains(lower(text), 'the')) SELECT id, (SELECT CAST(ceil(count(*) / 10) AS BIGINT) FROM f) AS pages FROM f ORDER BY id LIMIT 10 OFFSET 20", "t"))
def recall_page(s, d):
    return retrieval.recall_page(_texts(s, d), "The", 2, 10, "id").select("id", "pages")


COS = "list_sum(list_transform(list_zip(embedding, q), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE))) / (sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) * sqrt(list_sum(list_transform(q, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))))"
QV = "(SELECT embedding AS q FROM embeddings WHERE vec_id = 0)"


def _vector(s, d):
    return table(s, d, "embeddings").where("vec_id = 0").select("embedding").first()[0]


@query(f"SELECT vec_id, round(list_sum(list_transform(list_zip(embedding, q), lambda x: (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE)) * (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE)))), 6) AS score FROM embeddings, {QV} ORDER BY score, vec_id LIMIT 10")
def knn_l2(s, d):
    return vectors.knn(table(s, d, "embeddings"), _vector(s, d), 10, vectors.l2, "asc").select("vec_id", F.round("score", 6).alias("score"))


@query(f"SELECT vec_id, round({COS}, 6) AS score FROM embeddings, {QV} ORDER BY score DESC, vec_id LIMIT 10")
def knn_cosine(s, d):
    return vectors.knn(table(s, d, "embeddings"), _vector(s, d), 10, vectors.cosine, "desc").select("vec_id", F.round("score", 6).alias("score"))


@query(f"SELECT query_id, CAST(rank AS INT) AS rank, vec_id, round(score, 6) AS score FROM (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (SELECT query_id, vec_id, {COS} AS score FROM embeddings JOIN (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0) ON vec_id <> query_id)) WHERE rank <= 5")
def knn_batch(s, d):
    items = table(s, d, "embeddings")
    return vectors.knn_batch(items, items.where("vec_id % 100 = 0"), 5)


HITS = ", k AS (SELECT id, CAST(id % 17 AS DOUBLE) AS score FROM m WHERE id % 3 = 0), v AS (SELECT id, CAST(id % 11 AS DOUBLE) / 10 AS score FROM m WHERE id % 2 = 0)\n"


def _hits(s, d):
    m = memories(s, d)
    return m.where("id % 3 = 0").select("id", (F.col("id") % 17).cast("double").alias("score")), m.where("id % 2 = 0").select("id", ((F.col("id") % 11).cast("double") / 10).alias("score"))


@query(sql(HITS + "SELECT id, round(coalesce(k.score, 0) / (SELECT max(score) FROM k) * 0.9 + coalesce(v.score, 0) / (SELECT max(score) FROM v) * 0.1, 6) AS fused, CASE WHEN v.score IS NULL THEN 'keyword' WHEN k.score IS NULL THEN 'semantic' ELSE 'both' END AS strategy FROM k FULL JOIN v USING (id)", "m"))
def hybrid_fusion(s, d):
    return retrieval.fuse(*_hits(s, d)).withColumn("fused", F.round("fused", 6))


@query(sql(HITS + ", u AS (SELECT *, 'keyword' AS source FROM k UNION ALL SELECT *, 'vector' FROM v) SELECT id, max(score) AS score, string_agg(source, ',' ORDER BY source) AS sources, count(*) AS n_sources FROM u GROUP BY id", "m"))
def union_sources(s, d):
    k, v = _hits(s, d)
    return retrieval.union_sources({"keyword": k, "vector": v})


@query(sql(HITS + ", r AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM k UNION ALL SELECT id, row_number() OVER (ORDER BY score DESC, id) FROM v) SELECT id, round(sum(1 / (60 + rank)), 9) AS score FROM r GROUP BY id", "m"))
def reciprocal_rank_fusion(s, d):
    ranked = [timeline.ranked(x, F.desc("score"), F.col("id")) for x in _hits(s, d)]
    return retrieval.reciprocal_ranks(ranked).withColumn("score", F.round("score", 9))


@query(sql(HITS + ", f AS (SELECT k.id, score, source_date FROM k JOIN m USING (id) ORDER BY score DESC, id LIMIT 40) SELECT id, score, source_date FROM f", "m"))
def coarse_fine(s, d):
    k, _ = _hits(s, d)
    return retrieval.coarse_fine(k.join(memories(s, d).select("id", "source_date"), "id"), 40, "source_date").select("id", "score", "source_date")


@query(sql(", h AS (SELECT speaker AS session, id, source_date, CAST(id % 13 AS DOUBLE) AS score FROM m) SELECT session, sum(score) AS score, count(*) AS n FROM h GROUP BY session", "m"))
def session_scores(s, d):
    return retrieval.session_scores(_session_hits(s, d))


def _session_hits(s, d):
    return memories(s, d).select(F.col("speaker").alias("session"), "id", "source_date", (F.col("id") % 13).cast("double").alias("score"))


@query(sql(", h AS (SELECT speaker AS session, id, source_date, CAST(id % 13 AS DOUBLE) AS score FROM m) SELECT session, id, max(score) OVER (PARTITION BY session) AS session_best, CAST(row_number() OVER (PARTITION BY session ORDER BY source_date, id) AS INT) AS position FROM h", "m"))
def session_ordering(s, d):
    return retrieval.session_ordering(_session_hits(s, d), "source_date").select("session", "id", "session_best", "position")


@query(sql(", w AS (SELECT entity AS type, CAST(count(*) AS DOUBLE) AS weight FROM m GROUP BY entity), b AS (SELECT type, i, weight / i AS bid FROM w, generate_series(1, 25) AS t(i) ORDER BY bid DESC, type, i LIMIT 25) SELECT type, count(*) AS seats FROM b GROUP BY type", "m"))
def curate_quota(s, d):
    weights = memories(s, d).groupBy(F.col("entity").alias("type")).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return retrieval.apportioned(weights, 25)


CAND = ", c AS (SELECT DISTINCT entity, content FROM m), i AS (SELECT id, entity, content || ' of ' || entity AS content FROM m)\n"


@query(sql(CAND + ", x AS (SELECT id, i.entity, i.content, c.content AS canon, greatest(1.0 / (length(i.content) - length(replace(i.content, ' ', '')) + 1), 0.85) AS score FROM i JOIN c ON c.entity = i.entity AND starts_with(i.content, c.content || ' ')) SELECT id, entity, canon FROM x WHERE score >= 0.75", "m"))
def consolidate(s, d):
    m = memories(s, d)
    canon = m.select("entity", F.col("content").alias("canon")).distinct()
    items = m.select("id", "entity", F.concat("content", F.lit(" of "), "entity").alias("content"))
    return consolidation.consolidated(items, canon, ["entity"]).where("canon IS NOT NULL").select("id", "entity", "canon")


@query(sql(E + ", x AS (SELECT id, text FROM e), y AS (SELECT id + 100 AS id, substr(text, 1, 12) AS want FROM e WHERE length(text) >= 12) SELECT id, contains(text, want) AS found FROM y JOIN x USING (id)", "t"))
def verify_extraction(s, d):
    e = _texts(s, d)
    want = e.where(F.length("text") >= 12).select((F.col("id") + 100).alias("id"), F.substring("text", 1, 12).alias("want"))
    return want.join(e, "id").select("id", F.col("text").contains(F.col("want")).alias("found"))
