"""Keyword, substring and fused retrieval over documents (columns id, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words


def bm25(docs: DataFrame, query: list[str], k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(id, score) of documents that hold a query term: idf is ln(N / df), a term asked twice counts twice.

    Only postings of the query's terms leave the scan; the corpus figures are one small aggregate.
    """
    times: dict[str, int] = {}
    for term in query:
        times[term.lower()] = times.get(term.lower(), 0) + 1
    d = docs.select("id", words(F.col("text")).alias("w"))
    held = lambda t: F.size(F.filter("w", lambda x: x == F.lit(t)))
    tf = d.select("id", F.size("w").alias("dl"), *[held(t).alias(f"t{i}") for i, t in enumerate(times)])
    names = [f"t{i}" for i in range(len(times))]
    figures = tf.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *[F.sum(F.when(F.col(c) > 0, 1).otherwise(0)).alias(f"df_{c}") for c in names])
    score = F.lit(0.0)
    for c, q in zip(names, times.values()):
        part = F.log(F.col("n") / F.col(f"df_{c}")) * F.col(c) * (k1 + 1) / (F.col(c) + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
        score = score + F.when(F.col(c) > 0, part * q).otherwise(0.0)
    found = tf.where(" OR ".join(f"{c} > 0" for c in names))
    return found.crossJoin(F.broadcast(figures)).select("id", score.alias("score"))  # figures: one row


def cover_density(w: Column, terms: list[str], weight: float = 0.1) -> Column:
    """Cover density of a list of words: each smallest span that holds every term adds ``weight`` over one more than its other words; 0 without any.

    One sweep over the positional postings: the last place of each term is kept, and a span that ends here begins at the least of them.
    """
    n = len(terms)
    term_of = lambda x: F.array_position(F.array(*map(F.lit, terms)), x).cast("int")
    postings = F.filter(F.transform(w, lambda x, i: F.struct(i.alias("pos"), term_of(x).alias("t"))), lambda p: p["t"] > 0)
    none = F.array(*[F.lit(-1)] * n)
    start = F.struct(none.alias("last"), none.alias("at"), F.lit(0).alias("k"), F.lit(-1).alias("begin"), F.lit(0.0).alias("sum"))

    def step(s: Column, p: Column) -> Column:
        put = lambda name, v: F.transform(s[name], lambda x, i: F.when(i == p["t"] - 1, v).otherwise(x))
        last, at = put("last", p["pos"]), put("at", s["k"])
        begin = F.array_min(last)
        held = s["k"] - F.array_min(at) + 1  # postings in the span
        fresh = begin > s["begin"]  # every term has a place, and the span that ended before doesn't lie in this one
        others = p["pos"] - begin + 1 - held
        return F.struct(last.alias("last"), at.alias("at"), (s["k"] + 1).alias("k"), F.when(fresh, begin).otherwise(s["begin"]).alias("begin"), (s["sum"] + F.when(fresh, F.lit(weight) / (1 + others)).otherwise(0.0)).alias("sum"))

    return F.aggregate(postings, start, step, lambda s: s["sum"])


def bm25_fixed(docs: DataFrame, terms: list[str], k1: float = 1.2, b: float = 0.75, average: float = 100.0) -> DataFrame:
    """(id, score) of documents that hold every term: cover density in place of a count, no idf and a fixed average length."""
    terms = sorted({t.lower() for t in terms})
    d = docs.select("id", words(F.col("text")).alias("w"))
    d = d.where(F.size(F.array_intersect(F.array(*map(F.lit, terms)), "w")) == len(terms))
    d = d.select("id", F.size("w").alias("dl"), cover_density(F.col("w"), terms).alias("tf"))
    return d.select("id", (F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 + b * (F.col("dl") / average - 1)))).alias("score"))


def fts_and(docs: DataFrame, terms: list[str]) -> DataFrame:
    """Documents that hold every term."""
    wanted = sorted({t.lower() for t in terms})
    return docs.where(F.size(F.array_intersect(F.array(*map(F.lit, wanted)), words(F.col("text")))) == len(wanted))


def like_search(docs: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Substring search on title and text: 1, and 0.5 more for the title, 0.3 for the text."""
    q = query.lower()
    title, text = F.lower("title").contains(q), F.lower("text").contains(q)
    score = 1.0 + F.when(title, 0.5).otherwise(0.0) + F.when(text, 0.3).otherwise(0.0)
    return docs.where(title | text).select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def recall_page(docs: DataFrame, query: str, page: int, size: int, *order: str) -> DataFrame:
    """One page of the rows whose text holds the query, with the number of pages."""
    found = docs.where(F.lower("text").contains(query.lower()))
    pages = found.agg(F.ceil(F.count(F.lit(1)) / size).cast("long").alias("pages"))
    return found.orderBy(*order).offset(page * size).limit(size).crossJoin(F.broadcast(pages))  # one row


def fuse(keyword: DataFrame, vector: DataFrame, keyword_weight: float = 0.9, vector_weight: float = 0.1) -> DataFrame:
    """Keyword and vector hits (id, score) merged: scores over their greatest, weighted; which of the two found a row."""
    tops = keyword.agg(F.max("score").alias("kt")).crossJoin(vector.agg(F.max("score").alias("vt")))  # one row each
    k, v = keyword.select(F.col("id"), F.col("score").alias("k")), vector.select(F.col("id"), F.col("score").alias("v"))
    both = k.join(v, "id", "full_outer").crossJoin(F.broadcast(tops))
    part = lambda s, t: F.when(F.col(t) > 0, F.coalesce(s, F.lit(0.0)) / F.col(t)).otherwise(0.0)
    strategy = F.when(F.col("k").isNotNull() & F.col("v").isNotNull(), "both").when(F.col("k").isNotNull(), "keyword").otherwise("semantic")
    return both.select("id", (part(F.col("k"), "kt") * keyword_weight + part(F.col("v"), "vt") * vector_weight).alias("fused"), strategy.alias("strategy"))


def reciprocal_ranks(lists: list[DataFrame], k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked hits (id, rank)."""
    out = lists[0]
    for x in lists[1:]:
        out = out.unionByName(x)
    return out.groupBy("id").agg(F.sum(1 / (k + F.col("rank"))).alias("score"))


def union_sources(lists: dict[str, DataFrame]) -> DataFrame:
    """Hits (id, score) of several sources as one row each: the greatest score, and the sources in order."""
    out = None
    for name, x in lists.items():
        x = x.select("id", "score", F.lit(name).alias("source"))
        out = x if out is None else out.unionByName(x)
    return out.groupBy("id").agg(F.max("score").alias("score"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.countDistinct("source").alias("n_sources"))


def fused_score(base: Column, strategy: Column, layer: Column, sources: Column) -> Column:
    """Base, strategy and layer weights with a bonus for several sources; from 0 to 1."""
    raw = F.coalesce(base, F.lit(0.5)) * strategy * F.coalesce(layer, F.lit(1.0)) * F.least(F.lit(1.2), 1.0 + sources * 0.1)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw))


def completeness_bonus(content: Column) -> Column:
    size = F.length(content)
    return F.when(size.between(100, 800), 0.02).otherwise(0.0) + F.when(content.rlike("[0-9]"), 0.01).otherwise(0.0) + F.when(content.rlike("[:：•-]"), 0.01).otherwise(0.0)


def coarse_fine(hits: DataFrame, n: int, time_col: str) -> DataFrame:
    """The best ``n`` by score, then in the order of time."""
    return hits.orderBy(F.desc("score"), "id").limit(n).orderBy(time_col, "id")


def session_scores(hits: DataFrame) -> DataFrame:
    """Sessions by the sum of their hits' scores."""
    return hits.groupBy("session").agg(F.sum("score").alias("score"), F.count(F.lit(1)).alias("n"))


def session_ordering(hits: DataFrame, time_col: str) -> DataFrame:
    """Sessions by their best hit, hits by time within: ``position`` in each session and the session's best."""
    best = F.max("score").over(Window.partitionBy("session"))
    place = F.row_number().over(Window.partitionBy("session").orderBy(time_col, "id"))
    return hits.withColumn("session_best", best).withColumn("position", place)


def apportioned(weights: DataFrame, n: int) -> DataFrame:
    """Seats by highest averages: (type, weight) rows bid weight / i for their i-th seat, the ``n`` best bids win.

    A type gets a row in the result only if it wins a seat; ``n`` bounds the bids of each type.
    """
    bids = weights.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("bid", F.col("weight") / F.col("i"))
    return bids.orderBy(F.desc("bid"), "type", "i").limit(n).groupBy("type").agg(F.count(F.lit(1)).alias("seats"))
