"""Measures of answers and their confidence, and forms of answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text

# The weight of each way of searching, and of anything else.
SEARCH_WEIGHTS = {"exact": 1.0, "phrase": 0.9, "semantic_fulltext": 0.8, "fuzzy": 0.7}
OTHER_SEARCH = 0.5


def date_aware(c: Column) -> Column:
    """A normalised answer in which a leading ISO date is spelled "march 1 2026"."""
    day = F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd")
    return text.normalize_answer(F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}"), F.coalesce(F.date_format(day, "MMMM d yyyy"), c)).otherwise(c))


def token_set(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.split(text.normalize_answer_lower_first(c), " "), lambda x: x != "")))


def set_exact(a: Column, b: Column) -> Column:
    """Whether two answers have the same set of words."""
    return token_set(a) == token_set(b)


def single_tokens(c: Column) -> Column:
    """Runs of letters, digits and marks, and each other visible character by itself, lower-cased."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}\p{M}]+|[^\p{L}\p{N}\p{M}\p{Z}\p{C}]"), F.lit(0))


def holds_tokens(c: Column, answer: Column) -> Column:
    """Whether the answer's tokens stand in the text one behind the other; both are decomposed (NFD) before."""
    padded = lambda x: F.concat(F.lit("\n"), F.array_join(single_tokens(text.nfd(x)), "\n"), F.lit("\n"))
    return F.contains(padded(c), padded(answer))


def without_header(c: Column) -> Column:
    """What stands behind the first empty line; all, where there is none."""
    at = F.instr(c, "\n\n")
    return F.when(at > 0, F.substring(c, at + 2, F.length(c))).otherwise(c)


def ngrams(tokens: Column, n: int) -> Column:
    """Every n tokens in a row, joined by blanks."""
    starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))


def bleu(candidate: Column, reference: Column, n: int) -> Column:
    """Sentence BLEU up to n-grams with equal weights; a precision of none counts 0.1 hits (0 without n-grams at all)."""

    def score(p: Column) -> Column:
        a, b, logs = p["a"], p["b"], None
        for k in range(1, n + 1):
            hits = text.multiset_common(ngrams(a, k), ngrams(b, k))
            log = F.log(F.greatest(hits.cast("double"), F.lit(0.1)) / F.greatest(F.size(a) - (k - 1), F.lit(1)))
            logs = log if logs is None else logs + log
        brief = F.when(F.size(a) > F.size(b), 1.0).otherwise(F.exp(1 - F.size(b) / F.size(a)))
        return F.when((F.size(a) == 0) | ~F.arrays_overlap(a, b), 0.0).otherwise(brief * F.exp(logs / n))

    return text.once({"a": candidate, "b": reference}, score)


def fulltext_score(bm25: Column, exact: Column, rank: Column, kind: Column) -> Column:
    """Keyword score, exact-match bonus and rank score, weighted by the way of searching; 1 at most."""
    weight = F.lit(OTHER_SEARCH)
    for name, value in SEARCH_WEIGHTS.items():
        weight = F.when(kind == name, value).otherwise(weight)
    positive = lambda c: F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0))
    base = positive(bm25) * 0.6 + F.when(exact, 0.3).otherwise(0.0) + positive(rank) * 0.2
    return F.least(F.lit(1.0), base * weight)


def confidence(top_scores: Column, results: Column, answer: Column, levels: Column, strategies: Column, least: float = 0.1) -> Column:
    """Confidence in an answer: mean of the top scores, numbers of results, levels and strategies, and the answer's length."""
    mean = F.when(F.size(top_scores) > 0, F.aggregate(top_scores, F.lit(0.0), lambda a, x: a + x) / F.size(top_scores)).otherwise(0.0)
    length = F.when(F.length(answer) < 10, 0.5).when(F.length(answer) > 500, 0.9).otherwise(1.0)
    up_to_one = lambda c, n: F.least(F.lit(1.0), c / n)
    score = mean * 0.4 + up_to_one(results, 5) * 0.2 + length * 0.1 + up_to_one(levels, 3) * 0.15 + up_to_one(strategies, 2) * 0.15
    return F.when((results == 0) | (F.coalesce(F.length(answer), F.lit(0)) == 0), 0.0).otherwise(F.greatest(F.lit(least), F.least(F.lit(1.0), score)))


def has_repeated_keys(json: Column) -> Column:
    """Whether a JSON object names a key twice; null for what isn't an object."""
    keys = F.json_object_keys(json)
    return F.size(keys) != F.size(F.array_distinct(keys))


def canonical_json(row: dict[str, Column]) -> Column:
    """An object's JSON with its keys in order."""
    return F.to_json(F.struct(*[row[k].alias(k) for k in sorted(row)]))


def tagged(tags: Column, prefix: str) -> Column:
    """What stands behind a prefix in the tags that have it."""
    return F.transform(F.filter(tags, lambda t: F.startswith(t, F.lit(prefix))), lambda t: F.substring(t, len(prefix) + 1, 1 << 30))


def formatted(row_id: Column, date: Column, kind: Column, entity: Column, content: Column, speaker: Column) -> Column:
    """A row as a line: id=7 [2024-01-02] [fact] (entity) content - speaker."""
    return F.format_string("id=%d [%s] [%s] (%s) %s — %s", row_id, date.cast("string"), kind, entity, content, speaker)
