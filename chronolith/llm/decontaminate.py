"""Benchmark decontamination with DataFrame and SQL functions only.

Texts are normalised (A-Z lowered, words are runs of digits, a-z and non-ASCII characters).  Every
13-word window of a benchmark item (an item of fewer words: all of them) enters a hash set under its
*anchor*, its longest word (ties: the lesser, then the first).  The set is broadcast while its
measured size stays within ``BROADCAST_BYTES``; beyond that the same join is left to a shuffle on the
anchor, to which only the words around each anchor go.  Scanning a document's words against the
set finds the places at which a window could stand, and comparing the words verifies each hit.

Defined results: null texts have no words; items with no words match nothing; an item repeated
under one id counts once, and all items without an id are one item; a row's hits are its own: rows that repeat an
id, or have none, are told apart by 128 bits of their texts, so that only rows equal in both share them.
Other columns of the inputs are ignored by the report and kept by the filters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 13
BROADCAST_BYTES = 32 << 20
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """The text with A-Z lowered; others keep their case."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_list(text: Column) -> Column:
    """The normalised words; none for null."""
    return F.array_remove(F.split(F.coalesce(normalised(text.cast("string")), F.lit("")), NOT_WORD), "")


def windows(items: DataFrame, item_col: str, text_col: str, size: int) -> DataFrame:
    """(item, window, length, anchor, at) of every distinct window; ``at`` is the anchor's place from 0."""
    w = (
        items.select(F.col(item_col).cast("string").alias("item"), word_list(F.col(text_col)).alias("w"))
        .where(F.size("w") > 0)
        .withColumn("s", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (size - 1)))))
        .select("item", F.slice("w", F.col("s"), size).alias("window"))
        .distinct()
    )
    best = F.array_min(F.transform("window", lambda x, i: F.struct((-F.length(x)).alias("l"), x.alias("x"), i.alias("i"))))
    return w.withColumn("a", best).select("item", "window", F.size("window").alias("length"), F.col("a.x").alias("anchor"), F.col("a.i").alias("at"))


def _mark(documents: DataFrame, text_col: str) -> Column:
    """What tells rows of one id apart: equal texts have equal hits."""
    text = F.coalesce(documents[text_col].cast("string"), F.lit(""))
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


def hits(documents: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = SIZE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(id, mark, item, start, length): each place, counted in words from 0, at which a window of an item stands."""
    known = windows(items, item_col, item_text_col, size)
    weight = known.agg(F.coalesce(F.sum(F.length(F.array_join("window", " ")) + 16 * F.col("length") + 64), F.lit(0))).first()[0]
    words = documents.select(F.col(id_col).alias("id"), _mark(documents, text_col).alias("mark"), word_list(F.col(text_col)).alias("w"))
    places = words.select("id", "mark", "w", F.posexplode("w").alias("pos", "word"))
    start = F.col("pos") - F.col("at")
    if weight <= broadcast_bytes:
        same = (F.col("word") == F.col("anchor")) & (start >= 0) & (F.slice("w", F.greatest(start, F.lit(0)) + 1, F.col("length")) == F.col("window"))
        found = places.join(F.broadcast(known), same)
    else:
        from_ = F.greatest(F.col("pos") - (size - 1), F.lit(0))
        near = places.select("id", "mark", "pos", "word", from_.alias("from"), F.slice("w", from_ + 1, 2 * size - 1).alias("near"))
        same = (F.col("word") == F.col("anchor")) & (start >= 0) & (F.slice("near", F.greatest(start - F.col("from"), F.lit(0)) + 1, F.col("length")) == F.col("window"))
        found = near.join(known.hint("shuffle_hash"), same)
    return found.select("id", "mark", "item", start.alias("start"), "length")


def _report(documents: DataFrame, items: DataFrame, *, id_col: str, text_col: str, **options) -> DataFrame:
    """The rows of ``contamination``, with ``mark``."""
    found = hits(documents, items, id_col=id_col, text_col=text_col, **options)
    spans = F.sort_array(F.collect_set(F.struct(F.col("start").cast("long").alias("s"), (F.col("start") + F.col("length")).cast("long").alias("e"))))
    per = found.groupBy("id", "mark").agg(spans.alias("spans"), F.sort_array(F.collect_set("item")).alias("items"), F.max(F.col("item").isNull().cast("long")).alias("nameless"))
    nothing = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    covered = F.aggregate(
        "spans", nothing,
        lambda a, x: F.struct((a["n"] + F.greatest(x["e"] - F.greatest(x["s"], a["to"]), F.lit(0))).alias("n"), F.greatest(a["to"], x["e"]).alias("to")),
        lambda a: a["n"],
    )
    per = per.select("id", "mark", covered.alias("n_hit"), "items", "nameless", "spans")
    counts = documents.select(F.col(id_col).alias("doc"), _mark(documents, text_col).alias("_mark"), F.size(word_list(F.col(text_col))).cast("long").alias("n_words"))
    rows = counts.join(per, F.col("doc").eqNullSafe(F.col("id")) & F.col("_mark").eqNullSafe(F.col("mark")), "left")
    hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return rows.select(
        F.col("doc").alias(id_col),
        "n_words",
        hit.alias("n_hit"),
        F.coalesce(F.size("items") + F.col("nameless"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        ((hit > 0) & (20 * hit >= F.col("n_words"))).alias("contaminated"),
        F.coalesce("spans", F.array().cast("array<struct<s:bigint,e:bigint>>")).alias("spans"),
        F.col("_mark").alias("mark"),
    )


def contamination(documents: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """A row for each document: n_words, n_hit, n_items, items_sha256, contaminated, and the hit ``spans`` as [start, end) in words.

    A document is contaminated if a twentieth of its words or more lie in windows of items.
    """
    return _report(documents, items, id_col=id_col, text_col=text_col, **options).drop("mark")


def remove_contaminated(documents: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``documents`` that aren't contaminated, with all their columns."""
    found = _report(documents, items, id_col=id_col, text_col=text_col, **options)
    bad = found.where("contaminated").select(F.col(id_col).alias("_bad"), F.col("mark").alias("_mark")).distinct()
    same = documents[id_col].eqNullSafe(bad["_bad"]) & _mark(documents, text_col).eqNullSafe(bad["_mark"])
    return documents.join(bad, same, "left_anti")


def remove_spans(documents: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """All rows; texts with hits are the normalised words outside of them, joined by blanks."""
    found = hits(documents, items, id_col=id_col, text_col=text_col, **options)
    per = found.groupBy(F.col("id").alias("_id"), F.col("mark").alias("_mark")).agg(F.array_distinct(F.flatten(F.collect_set(F.sequence("start", F.col("start") + F.col("length") - 1)))).alias("_hit"))
    same = documents[id_col].eqNullSafe(per["_id"]) & _mark(documents, text_col).eqNullSafe(per["_mark"])
    rows = documents.join(per, same, "left").select(word_list(documents[text_col]).alias("_words"), per["_hit"].alias("_hit"), documents[text_col].alias("_text"), F.struct(*[documents[c].alias(f"c{i}") for i, c in enumerate(documents.columns)]).alias("_row"))
    rows = rows.withColumn("_stay", F.when(F.col("_hit").isNotNull(), F.array_except(F.sequence(F.lit(0), F.size("_words") - 1), "_hit")))
    text = F.when(F.col("_hit").isNull(), F.col("_text")).otherwise(F.array_join(F.transform("_stay", lambda i: F.get("_words", i)), " "))
    return rows.select(*[text.alias(c) if c == text_col else F.col("_row")[f"c{i}"].alias(c) for i, c in enumerate(documents.columns)])


ORACLE_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), v AS (
  SELECT DISTINCT item, w[s:s + least(len(w), {SIZE}) - 1] AS win, least(len(w), {SIZE}) AS n
  FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - {SIZE - 1}))) AS s FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM v),
p AS (
  SELECT r, s, n, w[s:s + n - 1] AS win
  FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, sizes WHERE len(w) >= n)
), h AS (SELECT r, item, s, v.n AS n FROM p JOIN v ON p.win = v.win AND p.n = v.n),
c AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(generate_series(s, s + n - 1)) AS pos FROM h) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN i USING (r)
"""
