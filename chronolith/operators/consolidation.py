"""Near-duplicate values: canonical spellings found without comparing every value with every other."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

THRESHOLD = 0.75
#: Shorter values than this are compared by single characters, longer ones by pairs; between both they are compared by either.
SINGLE, PAIRS = 9, 6


def _tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda t: t != ""))


def _characters(n: int):
    """A function of texts that gives every ``n`` characters in a row, each with how often it occurred before, so that sets of them compare as multisets."""

    @F.pandas_udf("array<string>")
    def grams(texts: pd.Series) -> pd.Series:
        def of(t):
            seen, out = {}, []
            for i in range(len(t) - n + 1):
                g = t[i : i + n]
                seen[g] = seen.get(g, 0) + 1
                out.append(f"{g}#{seen[g]}")
            return out

        return texts.map(lambda t: None if t is None else of(t.lower()))

    return grams


def _keys(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, size, gram, place, least): a row for each gram of each value, the rarest of the key's grams first.

    ``least``: how many grams of a kind values that reach the threshold have in common at least.  Tokens (kind t): three quarters of all;
    one where the tokens of either are among the other's, which the rarest one finds.  Matching characters are 3/8 of both lengths
    at least and the others at most 1/4, each of which ends a matching block: pairs of characters (kind 2) in common are 1/8 of both
    lengths less one, and the other value has 3/5 of the length at least.
    """
    c = F.col(value)
    size = F.length(F.lower(c))
    single, pairs = _characters(1)(F.when(size <= SINGLE, c)), _characters(2)(F.when(size >= PAIRS, c))
    kinds = {"t": (_tokens(c), F.ceil(F.size(_tokens(c)) * THRESHOLD)), "1": (single, F.ceil(size * 0.6)), "2": (pairs, F.greatest(F.lit(1), F.ceil(size * 0.2 - 1)))}
    one = F.array_compact(F.array(*[F.when(g.isNotNull(), F.struct(F.lit(k).alias("kind"), g.alias("grams"), n.cast("int").alias("least"))) for k, (g, n) in kinds.items()]))
    rows = values.select(*keys, value, size.alias("size"), F.explode(one).alias("o")).select(*keys, value, "size", "o.kind", F.size("o.grams").alias("n"), "o.least", F.explode("o.grams").alias("gram"))
    seen = rows.withColumn("_df", F.count(F.lit(1)).over(Window.partitionBy(*keys, "kind", "gram")))
    return seen.withColumn("place", F.row_number().over(Window.partitionBy(*keys, value, "kind").orderBy("_df", "gram"))).drop("_df")


def candidates(values: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, value, canon): pairs that may reach the threshold, by a gram that is among the first of one of them.

    Two values that have ``least`` grams in common share one of the first (grams - least + 1) of either, in whatever order.
    """
    both = values.select(*keys, F.col("value"), F.lit(0).alias("side")).unionByName(known.select(*keys, F.col("canon").alias("value"), F.lit(1).alias("side"))).distinct()
    names = both.select(*keys, "value").distinct()
    # Grams are ranked once for the values of both sides.
    grams = _keys(names, keys, "value").join(both, [*keys, "value"])
    first = F.col("place") <= F.col("n") - F.col("least") + 1
    left = grams.where("side = 0").select(*keys, "kind", "gram", "value", F.col("size").alias("a"), first.alias("first"))
    right = grams.where("side = 1").select(*keys, "kind", "gram", F.col("value").alias("canon"), F.col("size").alias("b"), first.alias("first2"))
    met = left.join(right, [*keys, "kind", "gram"]).where((F.col("first") & F.col("first2")) | ((F.col("kind") == "t") & (F.col("first") | F.col("first2"))))
    near = F.least("a", "b") * 2 >= (F.col("a") + F.col("b")) * THRESHOLD
    return met.where((F.col("kind") == "t") | near).select(*keys, "value", "canon").distinct()


def canonical(values: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, value, canon, score): the known spelling most like each value, if it is like enough (ties: the least).

    ``values`` (keys, value) and ``known`` (keys, canon) are compared once however often they occur: alike but for case is 1, else the
    greater of token and character likeness.  The exact character ratio is worked out only for pairs whose tokens don't
    reach the threshold and whose letters could.
    """
    pairs = candidates(values, known, keys)
    token = text.token_jaccard(F.col("value"), F.col("canon"))
    letters = text.multiset_common(F.split(F.lower("value"), ""), F.split(F.lower("canon"), ""))
    bound = 2 * letters / (F.length(F.lower("value")) + F.length(F.lower("canon")))
    scored = pairs.withColumns({"_token": F.when(F.lower("value") == F.lower("canon"), 1.0).otherwise(token), "_bound": bound})
    done = scored.where((F.col("_token") >= THRESHOLD) & (F.col("_token") >= F.col("_bound"))).select(*keys, "value", "canon", F.col("_token").alias("score"))
    open_ = scored.where((F.col("_bound") >= THRESHOLD) & (F.col("_token") < F.col("_bound")))
    exact = open_.select(*keys, "value", "canon", F.greatest("_token", text.sequence_ratio(F.col("value"), F.col("canon"))).alias("score"))
    every = done.unionByName(exact).where(F.col("score") >= THRESHOLD)
    order = Window.partitionBy(*keys, "value").orderBy(F.desc("score"), "canon")
    return every.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def consolidated(items: DataFrame, known: DataFrame, keys: list[str], column: str = "content") -> DataFrame:
    """``items`` with ``canon``, the known spelling of their value; null where none is like enough."""
    values = items.select(*keys, F.col(column).alias("value")).where(F.col("value").isNotNull()).distinct()
    found = canonical(values, known, keys).select(*keys, F.col("value").alias(column), "canon")
    return items.join(found, [*keys, column], "left")
