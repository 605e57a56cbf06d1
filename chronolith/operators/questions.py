"""Families of questions over dated values, their evidence, and the monthly probes that ask them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import selection, timeline


def phases(rows: DataFrame, keys: list[str], end: Column) -> DataFrame:
    """(keys, n, value, start, stop): each key's phases of one value by (source_date, id), numbered from 1."""
    w = Window.partitionBy(*keys).orderBy("source_date", "id")
    before = F.lag("content").over(w)
    starts = rows.withColumn("_new", (F.row_number().over(w) == 1) | ~F.col("content").eqNullSafe(before)).where("_new")
    nxt = F.lead("source_date").over(w)
    return starts.select(*keys, F.row_number().over(w).cast("int").alias("n"), F.col("content").alias("value"), F.col("source_date").alias("start"), F.coalesce(F.date_sub(nxt, 1), end).alias("stop"))


def phase_evidence(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, value, evidence): each phase that a later one doesn't take over on its first day, with the number of its days before the next.

    Phases are numbered by a running sum over the records themselves.
    """
    w = Window.partitionBy(*keys).orderBy("source_date", "id")
    new = (F.row_number().over(w) == 1) | ~F.col("content").eqNullSafe(F.lag("content").over(w))
    numbered = rows.withColumn("_new", new).withColumn("n", F.sum(F.col("_new").cast("int")).over(w).cast("int"))
    per = numbered.groupBy(*keys, "n").agg(F.min_by("content", F.struct("source_date", "id")).alias("value"), F.countDistinct("source_date").alias("days"), F.min("source_date").alias("start"), F.max("source_date").alias("last"))
    taken = F.coalesce(F.lead("start").over(Window.partitionBy(*keys).orderBy("n")) == F.col("last"), F.lit(False)).cast("long")
    return per.withColumn("evidence", F.col("days") - taken).where("evidence > 0").select(*keys, "n", "value", "evidence")


def nearest_mentions(asked: DataFrame, mentions: DataFrame, keys: list[str], k: int = 3) -> DataFrame:
    """(id, day, near): the ``k`` mention days nearest to each question's day, none behind it.

    Each mention day carries the ones before it, and a question takes those of the last day up to its own.
    """
    w = Window.partitionBy(*keys).orderBy("day")
    m = mentions.select(*keys, "day").distinct()
    days = F.array_compact(F.array("day", *[F.lag("day", i).over(w) for i in range(1, k)]))
    found = timeline.as_of(asked, m.withColumns({"near": days, "tie": F.lit(0)}), keys, "day", "day", ["near"], "tie")
    return found.select("id", "day", F.explode("as_of_near").alias("near"))


def change_questions(found: DataFrame, keys: list[str]) -> DataFrame:
    """A question for each phase but the first: from which value to which, and when; (keys, n, old, new, changed_on)."""
    w = Window.partitionBy(*keys).orderBy("n")
    return found.withColumn("old", F.lag("value").over(w)).where("n > 1").select(*keys, "n", "old", F.col("value").alias("new"), F.col("start").alias("changed_on"))


def duration_questions(found: DataFrame, keys: list[str], end: Column) -> DataFrame:
    """How long each ended phase lasted, in days."""
    return found.where(F.col("stop") < end).select(*keys, "n", "value", (F.datediff("stop", "start") + 1).alias("days"))


def shift_or_exception(found: DataFrame, keys: list[str], days: int) -> DataFrame:
    """Phases of up to ``days`` that return to the value before them are exceptions, other changes are shifts."""
    w = Window.partitionBy(*keys).orderBy("n")
    back = F.lag("value").over(w).eqNullSafe(F.lead("value").over(w)) & F.lead("value").over(w).isNotNull()
    short = F.datediff("stop", "start") + 1 <= days
    return found.withColumn("kind", F.when(back & short, "exception").otherwise("shift")).where("n > 1").select(*keys, "n", "value", "kind")


def at_viewpoint(questions: DataFrame, states: DataFrame, keys: list[str]) -> DataFrame:
    """Each question (id, keys, viewpoint) with the value of the last phase (n, value, start, stop) that began by its viewpoint day, if it still held; none if nothing was known."""
    found = timeline.as_of(questions, states.select(*keys, "start", "stop", "value", "n"), keys, "viewpoint", "start", ["stop", "value"], "n")
    return found.where(F.col("viewpoint") <= F.col("as_of_stop")).select("id", "viewpoint", F.col("as_of_value").alias("value"))


def introduced(questions: DataFrame, probes: DataFrame) -> DataFrame:
    """The first probe (probe, day) on or after the day from which a question (id, available) can be asked."""
    return questions.join(F.broadcast(probes.withColumnRenamed("day", "_day")), F.col("_day") >= F.col("available")).groupBy("id").agg(F.min("probe").alias("probe"))  # probes: a row for each month


def probe_budget(candidates: DataFrame, budget: int) -> DataFrame:
    """``budget`` questions dealt to the probes by their shares, in each probe by family in turn: (probe, id).

    Quotas come from the probes' counts, the greatest remainders rounded up; within a probe the first of
    every family precede the second ones.
    """
    counts = candidates.groupBy("probe").agg(F.count(F.lit(1)).alias("c"))
    total = F.sum("c").over(Window.partitionBy())
    share = counts.withColumn("q", F.lit(budget) * F.col("c") / total).withColumn("s", F.floor("q"))
    left = F.lit(budget) - F.sum("s").over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy(F.desc(F.col("q") - F.col("s")), "probe"))  # a row for each month
    quota = share.withColumn("quota", F.least(F.col("c"), F.col("s") + F.when(rank <= left, 1).otherwise(0))).select("probe", "quota")
    turn = candidates.withColumn("_t", F.row_number().over(Window.partitionBy("probe", "family").orderBy("id"))).where(F.col("_t") <= budget)  # no probe gives more
    placed = turn.withColumn("_n", F.row_number().over(Window.partitionBy("probe").orderBy("_t", "family", "id"))).where(F.col("_n") <= budget)
    return placed.join(F.broadcast(quota), "probe").where(F.col("_n") <= F.col("quota")).select("probe", "id")


def rule_violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(id, rule) of every row that breaks a rule; a rule is a condition that must hold, and null counts as broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return rows.select("id", F.explode(broken).alias("rule"))


def diverse_pick(items: DataFrame, group: str, k: int, traits: list[str]) -> DataFrame:
    """``k`` picks of each group: each time the item whose traits were picked least often, in the order of ``traits``, then the least id.

    Items of one combination of traits are alike but for their ids, so that only its first ``k`` can be picked; these go to one
    Python call for each group, combinations x k rows however many it has.
    """

    def pick(g: pd.DataFrame) -> pd.DataFrame:
        rest = list(g.sort_values("id").itertuples(index=False))
        seen: dict = {}
        chosen = []
        while rest and len(chosen) < k:
            i = min(range(len(rest)), key=lambda i: (*[seen.get((t, getattr(rest[i], t)), 0) for t in traits], i))
            best = rest.pop(i)
            chosen.append((getattr(best, group), best.id, len(chosen) + 1))
            for t in traits:
                seen[t, getattr(best, t)] = seen.get((t, getattr(best, t)), 0) + 1
        return pd.DataFrame(chosen, columns=[group, "id", "pick"])

    kinds = {f.name: f.dataType.simpleString() for f in items.schema}
    few = selection.first_of_each(items.select(group, "id", *traits), [group, *traits], k, "id")
    return few.groupBy(group).applyInPandas(pick, f"{group} {kinds[group]}, id {kinds['id']}, pick long")


def daily_question(days: DataFrame, pool: DataFrame, seed: str) -> DataFrame:
    """For each day (user, day) one of the user's questions (user, id, available) that can be asked by then.

    The pool is numbered by (available, id); a hash of user and day, modulo the number of questions available before the day,
    draws one of these numbers, so that no day is paired with its whole pool.
    """
    both = pool.select("user", F.col("available").alias("at"), F.lit(1).alias("side"), "id").unionByName(days.select("user", F.col("day").alias("at"), F.lit(0).alias("side"), F.lit(None).cast(pool.schema["id"].dataType).alias("id")))
    number = F.sum("side").over(Window.partitionBy("user").orderBy("at", "side", "id").rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumn("number", number)
    draw = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(seed), "user", F.col("at").cast("string")), 256), 1, 12), 16, 10).cast("long")
    drawn = both.where("side = 0 and number > 0").select("user", F.col("at").alias("day"), (F.pmod(draw, F.col("number")) + 1).alias("number"))
    return drawn.join(both.where("side = 1").select("user", "number", "id"), ["user", "number"]).select("user", "day", "id")


def barrier_states(months: DataFrame) -> DataFrame:
    """The state of a monthly run from its log (month, event, at): idle, building, evaluating or done; a failed one starts anew.

    The last event decides, so that a run that was interrupted goes on from there.
    """
    last = months.groupBy("month").agg(F.max_by("event", F.struct("at", "event")).alias("event"))
    state = F.when(F.col("event") == "build_started", "building").when(F.col("event") == "build_ended", "evaluating").when(F.col("event") == "evaluated", "done").otherwise("idle")
    return last.select("month", state.alias("state"))


def resume_plan(months: DataFrame, log: DataFrame) -> DataFrame:
    """(user, month, action) where each user's run goes on: the first of its ``months`` (user, month) that the log doesn't end.

    ``log`` (user, month, event, at) holds build_started, build_ended and evaluated.  A month whose build was broken off is rolled back and
    built anew ('restore'), one that is built is evaluated, one that wasn't begun is built; an event of a month behind the first open one
    is 'mismatch', and a user with no month left is 'done'.
    """
    last = log.groupBy("user", "month").agg(F.max_by("event", F.struct("at", "event")).alias("event"))
    state = months.select("user", "month").distinct().join(last, ["user", "month"], "left")
    open_ = F.when(F.coalesce(F.col("event"), F.lit("")) != "evaluated", F.struct("month", "event"))
    per = state.groupBy("user").agg(F.min(open_).alias("at"), F.max("month").alias("final"), F.max(F.when(F.col("event").isNotNull(), F.col("month"))).alias("reached"))
    action = (
        F.when(F.col("at").isNull(), "done")
        .when(F.col("reached") > F.col("at.month"), "mismatch")
        .when(F.col("at.event") == "build_started", "restore")
        .when(F.col("at.event") == "build_ended", "evaluate")
        .otherwise("build")
    )
    return per.select("user", F.coalesce("at.month", "final").alias("month"), action.alias("action"))


def rolled_back(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Stored rows (user, month, ..) without those of a month whose build was broken off."""
    return rows.join(plan.where("action = 'restore'").select("user", "month"), ["user", "month"], "left_anti")


# Families of questions.  ``found`` are phases (keys, n, value, start, stop) as ``phases`` gives them.


def history_questions(found: DataFrame, keys: list[str], end: Column) -> DataFrame:
    """How each key's value changed: its phases in order, as "value (start to stop)" with "now" for the last; keys that never changed have none."""
    said = F.concat("value", F.lit(" ("), F.col("start").cast("string"), F.lit(" to "), F.when(F.col("stop") >= end, "now").otherwise(F.col("stop").cast("string")), F.lit(")"))
    held = found.where("start <= stop")  # a phase that another one replaced on its first day held on none
    parts = F.array_sort(F.collect_list(F.struct("n", said.alias("said"))))
    return held.groupBy(*keys).agg(parts.alias("p"), F.count(F.lit(1)).alias("phases")).where("phases > 1").select(*keys, "phases", F.array_join(F.transform("p", lambda x: x["said"]), "; ").alias("answer"))


def prediction_questions(found: DataFrame, keys: list[str], end: Column, horizon: int, cycle_days: int = 7) -> DataFrame:
    """What the value will be on each of ``horizon`` days from ``end`` on, if the last two values go on taking turns of ``cycle_days`` days from the last phase's start.

    A key with one value has a small answer space and is asked for the first two days only.
    """
    last = F.max_by(F.struct("value", "start"), "n").alias("l")
    other = F.max_by("value", F.when(F.col("value") != F.col("_final"), F.col("n"))).alias("other")
    final = found.groupBy(*keys).agg(last)
    per = found.join(final.select(*keys, F.col("l.value").alias("_final"), F.col("l.start").alias("_start")), keys).groupBy(*keys, "_final", "_start").agg(other)
    days = F.sequence(F.lit(0), F.when(F.col("other").isNull(), F.lit(min(2, horizon) - 1)).otherwise(F.lit(horizon - 1)))
    asked = per.select(*keys, "_final", "_start", "other", F.explode(days).alias("ahead")).withColumn("day", F.date_add(end, F.col("ahead")))
    turn = F.pmod(F.floor(F.datediff("day", "_start") / cycle_days), F.lit(2))
    return asked.select(*keys, "day", F.when((turn == 1) & F.col("other").isNotNull(), F.col("other")).otherwise(F.col("_final")).alias("answer"))


def pattern_questions(found: DataFrame, keys: list[str], least_days: int) -> DataFrame:
    """What held in each phase of ``least_days`` days or more, asked at the middle of it, or "in" the first calendar month that lies in it whole."""
    held = found.withColumn("days", F.datediff("stop", "start") + 1).where(F.col("days") >= least_days)
    month = F.when(F.day("start") == 1, F.col("start")).otherwise(F.add_months(F.trunc("start", "month"), 1))
    when = F.when(F.last_day(month) <= F.col("stop"), F.concat(F.lit("in "), F.date_format(month, "yyyy-MM"))).otherwise(F.concat(F.lit("around "), F.date_add("start", F.floor(F.datediff("stop", "start") / 2).cast("int")).cast("string")))
    return held.select(*keys, "n", when.alias("asked"), F.col("value").alias("answer"))


def event_questions(states: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, day, answer): how an event (states: keys, n, day, stated, status) stood between two of its states, and (n null) how it ended.

    A state is asked for at the middle of its days, not before it was stated, if that is before the next state.
    """
    w = Window.partitionBy(*keys).orderBy("n")
    nxt = F.lead("day").over(w)
    middle = F.date_add("day", F.floor(F.datediff(nxt, F.col("day")) / 2).cast("int"))
    asked = states.withColumns({"_next": nxt, "_middle": middle}).where(F.col("_middle") > F.col("day")).withColumn("_at", F.greatest("_middle", "stated")).where(F.col("_at") < F.col("_next"))
    ended = states.groupBy(*keys).agg(F.max_by(F.struct("day", "status"), "n").alias("l")).select(*keys, F.lit(None).cast("int").alias("n"), F.col("l.day").alias("day"), F.col("l.status").alias("answer"))
    return asked.select(*keys, F.col("n").cast("int"), F.col("_at").alias("day"), F.col("status").alias("answer")).unionByName(ended)


def other_person_questions(current: DataFrame, relations: DataFrame) -> DataFrame:
    """(user, entity, value, answer): whether the value of a relation (user, other) is the user's own, over current values (user, entity, value).

    Another's value that isn't one's own is answered by no, one's own (the control) by yes.
    """
    theirs = relations.join(current.select(F.col("user").alias("other"), "entity", F.col("value").alias("asked")), "other")
    both = theirs.join(current, ["user", "entity"])
    no = both.where("asked <> value").select("user", "entity", F.col("asked").alias("value"), F.lit("no").alias("answer"))
    yes = both.select("user", "entity", "value", F.lit("yes").alias("answer"))
    return no.unionByName(yes).distinct()


def abstention_questions(current: DataFrame, askable: list[str]) -> DataFrame:
    """(user, entity, answer): entities of the stated list that a user never mentioned are 'not known'; those mentioned are the controls, with their value."""
    every = current.select("user").distinct().select("user", F.explode(F.array(*map(F.lit, askable))).alias("entity"))
    return every.join(current, ["user", "entity"], "left").select("user", "entity", F.coalesce("value", F.lit("not known")).alias("answer"))


def retrospectives(asked: DataFrame, probes: int, first: int = 2, last: int = 6) -> DataFrame:
    """(id, n, again): the later probe at which each question (id, n: its probe's number from 1) is asked once more, ``first`` to ``last`` probes on, drawn by a hash of its id.

    Questions too near the last of the ``probes`` aren't asked again.
    """
    width = F.least(F.col("n") + last, F.lit(probes)) - (F.col("n") + first) + 1
    draw = F.conv(F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 12), 16, 10).cast("long")
    return asked.where(width > 0).select("id", "n", (F.col("n") + first + F.pmod(draw, width)).cast("int").alias("again"))
