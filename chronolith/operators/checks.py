"""Rules that a user's facts, events, regimes and distractors have to keep, each broken one as a row (user, id, rule)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The least days of a regime, and the most days between a cause and its effect.
MIN_REGIME_DAYS, MAX_LAG = 14, 10


def _broken(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(user, id, rule) of the rules whose condition for a breach holds; null counts as kept."""
    said = F.array_compact(F.array(*[F.when(breach, F.lit(name)) for name, breach in rules.items()]))
    return rows.select("user", "id", F.explode(said).alias("rule"))


def repeated_ids(rows: DataFrame) -> DataFrame:
    return rows.groupBy("user", "id").count().where("count > 1").select("user", "id", F.lit("repeated id").alias("rule"))


def fact_rules(changes: DataFrame, days: int) -> DataFrame:
    """``changes`` (user, entity, cardinality, id, day, op, value, cause_day): a single-valued fact is set on day 1 and only ever set; of others values are added and removed,
    added while they aren't active and removed while they are; a cause lies before its change."""
    single, op = F.col("cardinality") == "single", F.col("op")
    first = F.row_number().over(Window.partitionBy("user", "entity").orderBy("day", "id")) == 1
    # Whether the value was active: what was last done to it.
    before = F.last(F.when(op != "set", op), ignorenulls=True).over(Window.partitionBy("user", "entity", "value").orderBy("day", "id").rowsBetween(Window.unboundedPreceding, -1))
    rows = changes.withColumns({"_first": first, "_active": F.coalesce(before == "add", F.lit(False))})
    return _broken(rows, {
        "day out of range": ~F.col("day").between(1, days),
        "single fact doesn't start with a set on day 1": single & F.col("_first") & ((F.col("day") != 1) | (op != "set")),
        "single fact isn't set": single & (op != "set"),
        "other fact is set": ~single & (op == "set"),
        "removes what isn't active": ~single & (op == "remove") & ~F.col("_active"),
        "adds what is active": ~single & (op == "add") & F.col("_active"),
        "cause after the change": F.col("cause_day") > F.col("day"),
    })


def event_rules(states: DataFrame, days: int) -> DataFrame:
    """``states`` (user, event, n, id, day, status): days in order and in range, and no planned state at the end behind one that happened or was cancelled."""
    w = Window.partitionBy("user", "event").orderBy("n")
    ended = F.max(F.col("status").isin("happened", "cancelled").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1
    last = F.lead("n").over(w).isNull()
    rows = states.withColumns({"_before": F.lag("day").over(w), "_ended": ended, "_last": last})
    return _broken(rows, {
        "day out of range": ~F.col("day").between(1, days),
        "states out of order": F.col("day") < F.col("_before"),
        "planned behind the end": F.col("_last") & F.col("_ended") & (F.col("status") == "planned"),
    })


def regime_rules(regimes: DataFrame, days: int, least: int = MIN_REGIME_DAYS) -> DataFrame:
    """``regimes`` (user, domain, id, start, stop, temporary, rule, cause_day, lag): the first one starts on day 1 without a cause, starts increase, only temporary ones stop and leave room to
    revert, all last ``least`` days, none repeats the rule before it, and a cause lies its lag before the start."""
    w = Window.partitionBy("user", "domain").orderBy("start", "id")
    lasting = F.last(F.when(~F.col("temporary"), F.col("rule")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = regimes.withColumns({"_n": F.row_number().over(w), "_next": F.coalesce(F.lead("start").over(w), F.lit(days + 1)), "_prev": F.lag("start").over(w), "_rule": lasting})
    t, stop, nxt = F.col("temporary"), F.col("stop"), F.col("_next")
    fits = (F.col("start") <= stop) & (stop < nxt - 1)
    length = F.when(t, stop - F.col("start") + 1).otherwise(nxt - F.col("start"))
    return _broken(rows, {
        "first regime isn't plain": (F.col("_n") == 1) & ((F.col("start") != 1) | F.col("cause_day").isNotNull() | t),
        "start isn't later": F.col("start") <= F.col("_prev"),
        "temporary without an end": t & stop.isNull(),
        "no room to revert": t & ~fits,
        "reversion too short": t & fits & (nxt - 1 - stop < least),
        "end of a lasting regime": ~t & stop.isNotNull(),
        "too short": length < least,
        "same rule as before": F.col("rule") == F.col("_rule"),
        "cause after the start": F.col("cause_day") > F.col("start"),
        "start isn't cause and lag": F.col("cause_day") + F.col("lag") != F.col("start"),
    })


def distractor_rules(distractors: DataFrame, regimes: DataFrame, lag: int = MAX_LAG) -> DataFrame:
    """``distractors`` (user, domain, id, day, confounder): of a known domain, and within ``lag`` days of an uncaused shift only as a stated confounder.

    The days around each shift, ``2 lag + 1`` of them, are met by an equi-join.
    """
    known = regimes.select("user", "domain").distinct()
    unknown = distractors.join(known, ["user", "domain"], "left_anti").select("user", "id", F.lit("unknown domain").alias("rule"))
    n = F.row_number().over(Window.partitionBy("user", "domain").orderBy("start", "id"))
    shifts = regimes.withColumn("_n", n).where((F.col("_n") > 1) & F.col("cause_day").isNull())
    near = shifts.select("user", "domain", F.explode(F.sequence(F.col("start") - lag, F.col("start") + lag)).alias("day")).distinct()
    close = distractors.where(~F.coalesce("confounder", F.lit(False))).join(near, ["user", "domain", "day"], "left_semi").select("user", "id", F.lit("near an uncaused shift").alias("rule"))
    return unknown.unionByName(close)
