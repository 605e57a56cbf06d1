"""Line dedup: lines that very many documents share stay in one of them only.

Texts are split at line feeds and the lines exploded.  A line's key is the line without blanks and
control characters at its ends, A-Z lowered; keys of at least ``min_length`` code points are hashed
(two XXH64 values, 128 bits).  The distinct documents of each hash are counted, and a hash of
``min_docs`` or more is *frequent*: its lines go from all documents but that with the largest id.  The
lines that stay are put together by position.

Counting aggregates in the scanning tasks first, so that a very common line meets as few rows as there are
tasks.  To find the lines again, frequent hashes are joined with the lines of the texts; the few that more
than ``heavy`` documents hold (no more than ``MOST`` can be, whatever the input) are known to every task and
dealt over as many keys as they have times so many documents.

Defined results: a null or empty text is one empty line (``drop_lines`` leaves a null null); rows that repeat an id
are one document to the counts and are put together each by itself; a row without an id counts as
no document and keeps no frequent line; ids are compared as their type compares; other columns are ignored by the report and
kept by ``drop_lines``; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import cut
from .decontaminate import LOWER, UPPER, normalised

MIN_LENGTH, MIN_DOCS = 40, 5
BLANK = " \t\n\x0b\x0c\r"
#: Documents of a hash from which on it is dealt over several keys, and hashes that may be known to every task.
HEAVY, MOST = 1 << 13, 1 << 16


def _marks(text):
    """A text's 128 bits, which tell rows of one id apart."""
    return F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")


def _lines(documents: DataFrame, id_col: str, text_col: str, min_length: int) -> DataFrame:
    """(id, t1, t2, pos, h1, h2) of every line whose key is long enough."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = documents.select(F.col(id_col).alias("id"), text.alias("text"))
    # The marks before the explosion, else they are worked out again for each line.
    rows = rows.select("id", *_marks(F.col("text")), F.split("text", "\n").alias("lines"))
    rows = rows.select("id", "t1", "t2", F.posexplode("lines").alias("pos", "line")).where(F.octet_length("line") >= min_length)
    rows = rows.select("id", "t1", "t2", "pos", normalised(F.btrim("line", F.lit(BLANK))).alias("key")).where(F.char_length("key") >= min_length)
    return rows.select("id", "t1", "t2", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def frequent_lines(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_docs: int = MIN_DOCS) -> DataFrame:
    """(h1, h2, docs, last) of the hashes that ``min_docs`` documents or more hold, with the largest id among them."""
    held = _lines(documents, id_col, text_col, min_length).where(F.col("id").isNotNull()).select("h1", "h2", "id").distinct()
    return held.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("docs"), F.max("id").alias("last")).where(F.col("docs") >= min_docs)


def _with_gone(documents: DataFrame, *, id_col: str, text_col: str, min_length: int = MIN_LENGTH, min_docs: int = MIN_DOCS, heavy: int = HEAVY) -> DataFrame:
    """``documents`` with ``_gone``, the ascending positions of each row's lines that go (null: none)."""
    frequent = cut(frequent_lines(documents, id_col=id_col, text_col=text_col, min_length=min_length, min_docs=min_docs))
    total = frequent.agg(F.coalesce(F.sum("docs"), F.lit(0))).first()[0]
    share = max(heavy, -(-total // MOST))
    dealt = F.ceil(F.col("docs") / share).cast("int")
    lines = _lines(documents, id_col, text_col, min_length)
    hot = frequent.where(F.col("docs") > share).select("h1", "h2", dealt.alias("dealt"))
    salt = F.when(F.col("dealt").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("id", "t1", "pos"), F.col("dealt").cast("long")).cast("int"))
    lines = lines.join(F.broadcast(hot), ["h1", "h2"], "left").withColumn("salt", salt).drop("dealt")
    known = frequent.select("h1", "h2", "last", F.explode(F.sequence(F.lit(0), dealt - 1)).alias("salt"))
    found = lines.join(known, ["h1", "h2", "salt"]).where(~F.col("id").eqNullSafe(F.col("last")))
    per = found.groupBy(F.col("id").alias("_i"), F.col("t1").alias("_t1"), F.col("t2").alias("_t2")).agg(F.sort_array(F.collect_set("pos")).alias("_gone"))
    t1, t2 = _marks(F.coalesce(documents[text_col].cast("string"), F.lit("")))
    same = documents[id_col].eqNullSafe(per["_i"]) & (t1 == per["_t1"]) & (t2 == per["_t2"])
    return documents.join(per, same, "left").drop("_i", "_t1", "_t2")


def _kept(rows: DataFrame, text_col: str) -> DataFrame:
    """``rows`` with ``_lines``, all lines of the text, and ``_kept``, those that stay joined by line feeds.

    The positions that stay are a difference of sets, so that the work follows the number of lines.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = rows.withColumn("_lines", F.split(text, "\n")).withColumn("_stay", F.when(F.col("_gone").isNotNull(), F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_gone")))
    kept = F.array_join(F.transform("_stay", lambda i: F.get("_lines", i)), "\n")
    return rows.withColumn("_kept", F.coalesce(kept, text))


def line_report(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, n_lines, n_dropped, kept_sha256) of each row."""
    rows = documents.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    rows = _kept(_with_gone(rows, id_col="_id", text_col="_text", **options), "_text")
    return rows.select(F.col("_id").alias(id_col), F.size("_lines").cast("long").alias("n_lines"), F.coalesce(F.size("_lines") - F.size("_stay"), F.lit(0)).cast("long").alias("n_dropped"), F.sha2("_kept", 256).alias("kept_sha256"))


def drop_lines(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """All rows with all their columns, the texts without the lines that go."""
    rows = documents.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.struct(*documents.columns).alias("_row"))
    rows = _kept(_with_gone(rows, id_col="_id", text_col="_text", **options), "_text")
    text = F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(F.col("_kept"))
    return rows.select(*[text.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in documents.columns])


ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT n, doc_id, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(1, len(string_split(text, chr(10))))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= {MIN_LENGTH} GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
r AS (SELECT k.*, f.key IS NOT NULL AND k.doc_id IS DISTINCT FROM f.last AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM r GROUP BY n, doc_id
"""
