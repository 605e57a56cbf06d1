"""Question analysis and ranking arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a question of each kind holds, anywhere in its text.
TEMPORAL = ("when", "what time", "date", "year", "month", "day", "ago", "before", "after", "during", "since")
FACTUAL = ("what", "who", "where", "which", "how many", "is", "are", "did", "does")
INFERENTIAL = ("why", "how", "would", "could", "should", "likely", "probably", "might")


def category(question: Column) -> Column:
    """temporal, factual, inferential or detailed, the first whose keywords the question holds; detailed with Chinese characters."""
    out, text = F.lit("detailed"), F.lower(question)
    for kind, words in (("inferential", INFERENTIAL), ("factual", FACTUAL), ("temporal", TEMPORAL)):
        held = F.lit(False)
        for w in words:
            held = held | text.contains(w)
        out = F.when(held, kind).otherwise(out)
    return F.when(question.rlike("[\u4e00-\u9fff]"), "detailed").otherwise(out)


def intent(question: Column) -> Column:
    q = F.lower(question)
    out = F.when(q.contains("when"), "temporal_query").when(q.contains("what"), "factual_query").when(q.contains("who"), "entity_query")
    return out.when(q.contains("where"), "location_query").when(q.contains("why") | q.contains("how"), "causal_query").otherwise("general_query")


def time_entities(question: Column) -> Column:
    """Sorted distinct (start, text) of time phrases: years, dates in figures and words, days and spans named; start counts from 1."""
    month = "(?:january|february|march|april|may|june|july|august|september|october|november|december)"
    patterns = (r"\d{4}", r"\d{1,2}/\d{1,2}/\d{4}", r"\d{4}-\d{1,2}-\d{1,2}", rf"{month}\s+\d{{1,2}},?\s+\d{{4}}", rf"\d{{1,2}}\s+{month}\s+\d{{4}}", r"(?:today|yesterday|tomorrow|(?:last|next) (?:week|month|year))", r"\d+ (?:days?|weeks?|months?) ago")
    q = F.lower(question)

    def spans(p: str) -> Column:
        """Each match with its place: behind the texts between the matches before it, and behind these."""
        found, between = F.regexp_extract_all(q, F.lit(rf"\b{p}\b"), F.lit(0)), F.split(q, rf"\b{p}\b")
        length = lambda parts: F.aggregate(parts, F.lit(0), lambda n, x: n + F.length(x))
        return F.transform(found, lambda x, i: F.struct((length(F.slice(between, F.lit(1), i + 1)) + length(F.slice(found, F.lit(1), i)) + 1).alias("start"), x.alias("text")))

    return F.array_sort(F.array_distinct(F.flatten(F.array(*[spans(p) for p in patterns]))))


def named_in(text: Column, name: Column) -> Column:
    """Whether a text holds the full name, its initial and a dot, or a part of three letters or more."""
    t, n = F.lower(text), F.lower(name)
    return t.contains(n) | t.contains(F.concat(F.substring(n, 1, 1), F.lit("."))) | F.exists(F.split(n, r"\s+"), lambda p: (F.length(p) > 2) & F.contains(t, p))


def expanded(terms: Column, synonyms: dict[str, list[str]]) -> Column:
    """Terms with their synonyms behind them."""
    if not synonyms:
        return terms
    table = F.create_map(*[x for k, v in synonyms.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.array_distinct(F.concat(terms, F.flatten(F.transform(terms, lambda t: F.coalesce(F.try_element_at(table, t), F.array().cast("array<string>"))))))


# The weight of each level's rows.
LEVEL_WEIGHTS = {"L1": 1.0, "L2": 0.8, "L3": 0.3, "L4": 0.2, "L5": 0.15}


def level_weight(level: Column, weights: dict[str, float] = LEVEL_WEIGHTS) -> Column:
    out = F.lit(0.1)
    for k, v in weights.items():
        out = F.when(level == k, v).otherwise(out)
    return out


def final_rank_score(fused: Column, question: Column, content: Column, level: Column, category: Column, sources: Column, completeness: Column, penalty: Column) -> Column:
    """The fused score raised by word overlap, level, agreement and completeness, less the penalty; from 0 to 1."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda x: x != ""))
    q = words(question)
    overlap = F.when(F.size(q) > 0, F.size(F.array_intersect(q, words(content))) / F.size(q) * 0.1).otherwise(0.0)
    by_level = F.when((category == "temporal") & level.isin("L1", "L2"), 0.05).when((category == "inferential") & level.isin("L3", "L4", "L5"), 0.05).when((category == "factual") & (level == "L2"), 0.08).otherwise(0.0)
    agreement = F.when(sources >= 3, 0.08).when(sources == 2, 0.05).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(fused, F.lit(0.5)) * (1 + overlap + by_level + agreement + completeness) * (1 - penalty)))


def cost(model: Column, tokens_in: Column, tokens_out: Column, prices: dict[str, tuple[float, float]]) -> Column:
    """Cost by a price table of (input, output) for a million tokens; null for models without a price."""
    out = None
    for name, (a, b) in prices.items():
        value = (tokens_in * a + tokens_out * b) / 1_000_000
        out = F.when(model == name, value) if out is None else out.when(model == name, value)
    return out if out is not None else F.lit(None).cast("double")
