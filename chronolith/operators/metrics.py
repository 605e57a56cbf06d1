"""Aggregates of answers, grades, latencies and distributions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def recurring(rows: DataFrame, keys: list[str], value: str, least: int = 2, sample: int = 5) -> DataFrame:
    """Groups with ``least`` different values or more, and the first few of these."""
    each = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    first = each.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(value))).where(F.col("_r") <= sample)
    shown = first.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list(value)), ",").alias("values"))
    total = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    often = each.groupBy(*keys).agg(F.count(F.lit(1)).alias("_d")).where(F.col("_d") >= least)
    return total.join(often, keys).join(shown, keys).select(*keys, "n", "values")


def known_values(rows: DataFrame, most: int = 12) -> DataFrame:
    """Each entity's values in the order first seen, at most ``most``, joined."""
    first = rows.groupBy("entity", "content").agg(F.min("id").alias("first"))
    ranked = first.withColumn("_n", F.row_number().over(Window.partitionBy("entity").orderBy("first"))).where(F.col("_n") <= most)
    ordered = F.array_sort(F.collect_list(F.struct("first", "content")))
    return ranked.groupBy("entity").agg(F.array_join(F.transform(ordered, lambda x: x["content"]), ",").alias("values"))


def _same_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[f"_{k}"])
    return out


def values_at(rows: DataFrame, keys: list[str], value: str, at: dict[str, tuple[float, Callable[[Column], Column]]], near: float = 0.001) -> DataFrame:
    """For each group the values at some indices of its sorted values, without sorting groups whole; nulls take no part.

    ``at`` gives each name a share and the index (from 0) as a function of the group's size; the index must lie about that share.
    A first pass bounds each value by approximate quantiles (error 1 / 10,000) a little below and above, a second counts
    what lies below the bounds, and only the rows between them are ranked.
    """
    v = rows.select(*keys, F.col(value).alias("_v")).where(F.col("_v").isNotNull())
    edges = [x for p, _ in at.values() for x in (max(0.0, p - near), min(1.0, p + near))]
    bounds = v.groupBy(*keys).agg(F.percentile_approx("_v", edges, 10_000).alias("_e")).withColumnsRenamed({k: f"_{k}" for k in keys})
    wide = v.join(bounds, _same_keys(v, bounds, keys)) if keys else v.crossJoin(F.broadcast(bounds))
    below = [F.count_if(F.col("_v") < F.col("_e")[2 * i]).alias(f"_b{i}") for i in range(len(at))]
    figures = wide.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *below)
    inside = F.array_compact(F.array(*[F.when(F.col("_v").between(F.col("_e")[2 * i], F.col("_e")[2 * i + 1]), F.lit(i)) for i in range(len(at))]))
    ranked = wide.select(*keys, "_v", F.explode(inside).alias("_i")).withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_i").orderBy("_v")) - 1)
    figures = figures.withColumnsRenamed({k: f"_{k}" for k in keys})
    both = ranked.join(figures, _same_keys(ranked, figures, keys)) if keys else ranked.crossJoin(F.broadcast(figures))
    picks = [F.max(F.when((F.col("_i") == i) & (F.col("_r") + F.col(f"_b{i}") == index(F.col("_n"))), F.col("_v"))).alias(name) for i, (name, (_, index)) in enumerate(at.items())]
    return both.groupBy(*keys).agg(*picks)


def floor_percentiles(rows: DataFrame, keys: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """n, total, mean, max and, by name, the value at index floor(p n) of the sorted values (from 0)."""
    v = F.col(value)
    index = lambda p: lambda n: F.least(F.floor(n * p), n - 1)
    picks = values_at(rows, keys, value, {name: (p, index(p)) for name, p in at.items()})
    g = rows.groupBy(*keys).agg(F.count(v).alias("n"), F.round(F.sum(v), 4).alias("total"), F.round(F.avg(v), 4).alias("mean"), F.max(v).alias("max"))
    renamed = picks.withColumnsRenamed({k: f"_{k}" for k in keys})
    return g.join(renamed, _same_keys(g, renamed, keys)).select(*keys, "n", "total", "mean", *at, "max")


def scores_by(rows: DataFrame, keys: list[str], scores: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(s), 4).alias(f"mean_{s}") for s in scores])


def micro_average(blocks: DataFrame, keys: list[str], score: str, n: str = "n") -> DataFrame:
    """Means weighted by size at every level of the keys' hierarchy; a null key means all."""
    return blocks.rollup(*keys).agg(F.sum(n).alias("n"), F.round(F.sum(F.col(score) * F.col(n)) / F.sum(n), 6).alias("mean"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is."""
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def share_of_total(rows: DataFrame, key: str, value: str) -> DataFrame:
    g = rows.groupBy(key).agg(F.sum(value).alias("part"))
    return g.withColumn("share", F.round(ratio(F.col("part"), F.sum("part").over(Window.partitionBy())), 6)).withColumn("part", F.round("part", 2))


def answer_distribution(rows: DataFrame, keys: list[str], answer: str) -> DataFrame:
    """n, distinct answers, the top answer (ties: the least) and its share, and the entropy in bits."""
    counts = rows.groupBy(*keys, answer).agg(F.count(F.lit(1)).alias("c"))
    total = F.sum("c").over(Window.partitionBy(*keys))
    p = F.col("c") / F.col("t")
    g = counts.withColumn("t", total).groupBy(*keys).agg(
        F.max("t").cast("long").alias("n"),
        F.count(F.lit(1)).alias("n_answers"),
        F.min(F.struct((-F.col("c")).alias("c"), F.col(answer).alias("a")))["a"].alias("top"),
        F.round(F.max(p), 6).alias("share"),
        F.round(-F.sum(p * F.log2(p)), 6).alias("entropy"),
    )
    return g


def metric_stats(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, population deviation, least, greatest, median and number of the values."""
    v = F.col(value)
    g = rows.groupBy(*keys).agg(
        F.round(F.avg(v), 4).alias("mean"), F.round(F.stddev_pop(v), 4).alias("std"), F.round(F.min(v), 4).alias("min"), F.round(F.max(v), 4).alias("max"), F.count(v).alias("n")
    )
    halves = values_at(rows, keys, value, {"_low": (0.5, lambda n: F.floor((n - 1) / 2)), "_high": (0.5, lambda n: F.floor(n / 2))})
    halves = halves.withColumnsRenamed({k: f"_{k}" for k in keys})
    median = F.round((F.col("_low") + F.col("_high")) / 2, 4).alias("median")
    return g.join(halves, _same_keys(g, halves, keys), "left").select(*keys, "mean", "std", "min", "max", median, "n")


def recall_ndcg(results: DataFrame, ks: list[int]) -> DataFrame:
    """Means over queries of recall@k and NDCG@k from (query, rank of the one right item, null if absent)."""
    out = []
    for k in ks:
        hit = F.col("rank") <= k
        out += [F.round(F.avg(F.when(hit, 1.0).otherwise(0.0)), 6).alias(f"recall_{k}"), F.round(F.avg(F.when(hit, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)), 6).alias(f"ndcg_{k}")]
    return results.agg(*out)


def pivoted(rows: DataFrame, row: str, column: str, values: list[str], score: str) -> DataFrame:
    """Mean and population deviation for each row, a column for each of ``values``."""
    return rows.groupBy(row).pivot(column, values).agg(F.round(F.avg(score), 4).alias("mean"), F.round(F.stddev_pop(score), 4).alias("sd"))


def claim_diff(expected: DataFrame, extracted: DataFrame, keys: list[str]) -> DataFrame:
    """What differs between expected and extracted values: absent, leak, wrong or invention."""
    e, x = expected.select(*keys, F.col("value").alias("e")), extracted.select(*keys, F.col("value").alias("x"))
    none = "not mentioned"
    kind = (
        F.when(F.col("e").isNull(), "invention")
        .when((F.col("e") != none) & (F.coalesce("x", F.lit(none)) == none), "absent")
        .when((F.col("e") == none) & (F.coalesce("x", F.lit(none)) != none), "leak")
        .when(F.lower("e") != F.lower("x"), "wrong")
    )
    return e.join(x, keys, "full_outer").withColumn("kind", kind).where(F.col("kind").isNotNull()).select(*keys, "kind")


def grade_join(answers: DataFrame, grades: DataFrame, key: str) -> DataFrame:
    """Answers with their grades, and strays of both sides: (key, state)."""
    both = answers.select(F.col(key), F.lit(1).alias("_a")).join(grades.select(F.col(key), F.lit(1).alias("_g")), key, "full_outer")
    state = F.when(F.col("_a").isNull(), "no_answer").when(F.col("_g").isNull(), "no_grade").otherwise("graded")
    return both.select(key, state.alias("state"))


def dirty_periods(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Periods (period, source_hash) whose hash is new or differs from the stored one."""
    return current.join(stored.select("period", F.col("source_hash").alias("_h")), "period", "left").where(~F.col("source_hash").eqNullSafe(F.col("_h"))).drop("_h")


def source_hash(rows: DataFrame, period: Column, parts: list[str], order: list[str]) -> DataFrame:
    """(period, source_hash, n): 16 hex digits over a period's rows.

    Rows are hashed where they lie and a period's row hashes meet as 64-bit sums of both halves, so
    that no period's texts come together in one task.
    """
    row = F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in [*order, *parts]]), 256)
    half = lambda i: F.conv(F.substring(row, i, 12), 16, 10).cast("decimal(20,0)")
    g = rows.groupBy(period.alias("period")).agg(F.count(F.lit(1)).alias("n"), F.sum(half(1)).alias("a"), F.sum(half(13)).alias("b"))
    return g.select("period", F.substring(F.sha2(F.concat_ws(":", F.col("n").cast("string"), F.col("a").cast("string"), F.col("b").cast("string")), 256), 1, 16).alias("source_hash"), "n")


def token_stats(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Sum, mean, median, least, most and sample deviation at every combination of the keys; a null key means all.

    Each row is dealt to the combinations it belongs to, and the two middle values of each are found by ``values_at``,
    so that no task holds a combination's values.
    """
    v, here = F.col(value), ["_set", *keys]
    sets = F.array(*[F.struct(F.lit(i).alias("_set"), *[(F.col(k) if not i >> j & 1 else F.lit(None).cast(rows.schema[k].dataType)).alias(k) for j, k in enumerate(keys)]) for i in range(1 << len(keys))])
    dealt = rows.select(v, F.explode(sets).alias("_s")).select(value, "_s.*")
    figures = dealt.groupBy(*here).agg(F.sum(v).alias("total"), F.round(F.avg(v), 4).alias("mean"), F.min(v).alias("least"), F.max(v).alias("most"), F.round(F.stddev_samp(v), 4).alias("deviation"))
    middle = values_at(dealt, here, value, {"_low": (0.5, lambda n: F.floor((n - 1) / 2)), "_high": (0.5, lambda n: F.floor(n / 2))}).withColumnsRenamed({k: f"_{k}" for k in here})
    both = figures.join(middle, _same_keys(figures, middle, here), "left")
    return both.select(*keys, "total", "mean", ((F.col("_low") + F.col("_high")) / 2).alias("median"), "least", "most", "deviation")


def fidelity(sessions: DataFrame) -> DataFrame:
    """How many of the sessions (attempts, passed, turns) passed, at once and at all, and their mean attempts and turns."""
    passed = F.col("passed")
    return sessions.agg(
        F.count(F.lit(1)).alias("sessions"), F.count_if(passed & (F.col("attempts") == 1)).alias("first_try"), F.count_if(passed).alias("passed"), F.round(F.avg("attempts"), 2).alias("mean_attempts"), F.round(F.avg("turns"), 1).alias("mean_turns")
    )
