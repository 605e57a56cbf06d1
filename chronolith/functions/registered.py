"""Functions for SQL: scalar ones as SQL functions, the overlapping splitter as a table function for lateral joins."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

#: Name and definition of each scalar function.
SCALAR = {
    "iso_week(d DATE)": "STRING RETURN format_string('%04d-W%02d', extract(YEAROFWEEK FROM d), weekofyear(d))",
    "week_start(d DATE)": "DATE RETURN CAST(date_trunc('WEEK', d) AS DATE)",
    "retention(days DOUBLE, strength DOUBLE)": "DOUBLE RETURN exp(-days / (5 * strength))",
    "pair_key(a STRING, b STRING)": "STRING RETURN concat_ws('|', least(a, b), greatest(a, b))",
    "guarded_ratio(a DOUBLE, b DOUBLE)": "DOUBLE RETURN CASE WHEN b = 0 THEN 0 ELSE a / b END",
}


def sentence_windows(text: str | None, size: int, overlap: int) -> Iterator[tuple[int, str]]:
    """(number, piece) of a text cut at sentence ends into windows of up to ``size`` characters, each beginning ``overlap`` before the last one's end.

    Only the last sentence end of a window's second half is looked for; a window without one is cut at its size.  Empty and null
    texts have no window, and pieces of white space alone are left out.
    """
    start, number = 0, 0
    while text and start < len(text):
        end = min(len(text), start + size)
        if end < len(text):
            last = max(text.rfind(c, start + size // 2, end) for c in ".!?")
            end = last + 1 if last > 0 else end
        if piece := text[start:end].strip():
            yield number, piece
            number += 1
        if end >= len(text):
            return
        start = max(end - overlap, start + 1)


@udtf(returnType="position int, piece string", useArrow=True)
class SentenceWindows:
    def eval(self, text: str, size: int, overlap: int):
        yield from sentence_windows(text, size, overlap)


def register(spark: SparkSession) -> SparkSession:
    """Makes the functions known to the session's SQL: those of ``SCALAR``, and ``sentence_windows(text, size, overlap)`` as a table."""
    for head, body in SCALAR.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {body}")
    spark.udtf.register("sentence_windows", SentenceWindows)
    return spark
