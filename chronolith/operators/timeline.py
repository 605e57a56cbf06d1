"""Dated rows: filters, sequences, runs, intervals, states as of a date.

Operators take rows with the columns of ``sources.tables.memories`` unless they say otherwise.
Ties on a date are broken by id.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import settled


def widened(value: str, end: bool = False) -> str:
    """A partial date (YYYY, YYYY-MM) as its first or last day; anything but these and YYYY-MM-DD is refused."""
    if not re.fullmatch(r"\d{4}(-\d{2}(-\d{2})?)?", value):
        raise ValueError(f"{value!r} isn't a date")
    if re.fullmatch(r"\d{4}", value):
        return f"{value}-12-31" if end else f"{value}-01-01"
    if re.fullmatch(r"\d{4}-\d{2}", value):
        first = dt.date.fromisoformat(f"{value}-01")
        return ((first + dt.timedelta(days=31)).replace(day=1) - dt.timedelta(days=1)).isoformat() if end else first.isoformat()
    return dt.date.fromisoformat(value).isoformat()


def filtered(rows: DataFrame, entity: str | None = None, speaker: str | None = None, start: str | None = None, end: str | None = None, type: str | None = None) -> DataFrame:
    """A conjunction of the conditions that are given; names are lowered and stripped, partial dates widened."""
    if start and end and widened(start) > widened(end, True):
        raise ValueError("start lies after end")
    for column, value in (("entity", entity), ("speaker", speaker), ("type", type)):
        if value is not None:
            rows = rows.where(F.col(column) == value.strip().lower())
    if start:
        rows = rows.where(F.col("source_date") >= F.lit(widened(start)).cast("date"))
    if end:
        rows = rows.where(F.col("source_date") <= F.lit(widened(end, True)).cast("date"))
    return rows


def query_memories(rows: DataFrame, limit: int | None = None, **conditions) -> DataFrame:
    out = filtered(rows, **conditions).orderBy("source_date", "id")
    if limit is not None:
        if not 1 <= limit <= 200:
            raise ValueError("limit is from 1 to 200")
        out = out.limit(limit)
    return out


def day_window(rows: DataFrame, day: str, around: int, date_col: str = "date") -> DataFrame:
    if not 0 <= around <= 7:
        raise ValueError("days around are from 0 to 7")
    centre = F.lit(day).cast("date")
    return rows.where(F.col(date_col).between(F.date_sub(centre, around), F.date_add(centre, around)))


def limit_plus_one(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows, with ``truncated`` telling whether there are more."""
    few = rows.orderBy(*order).limit(n + 1)
    numbered = few.withColumn("_n", F.row_number().over(Window.orderBy(*order)))  # n + 1 rows at most
    return numbered.withColumn("truncated", F.max("_n").over(Window.partitionBy()) > n).where(F.col("_n") <= n).drop("_n")


def sequence(keys: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy("source_date", "id")


def transitions(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose content differs from the one before in their group."""
    before = F.lag("content").over(sequence(keys))
    first = F.row_number().over(sequence(keys)) == 1
    return rows.withColumn("_b", before).withColumn("_f", first).where(F.col("_f") | ~F.col("content").eqNullSafe(F.col("_b"))).drop("_b", "_f")


def phase_durations(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Each phase's start and its days to the next transition; none for the current one."""
    t = transitions(rows, keys)
    after = F.lead("source_date").over(sequence(keys))
    return t.select(*keys, "content", F.col("source_date").alias("start"), F.datediff(after, "source_date").cast("long").alias("days"), after.isNull().alias("current"))


def run_lengths(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(run number, content, length) of runs of equal contents."""
    w = sequence(keys)
    change = F.when(F.col("content").eqNullSafe(F.lag("content").over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return (
        rows.withColumn("_c", change)
        .withColumn("run", F.sum("_c").over(w))
        .groupBy(*keys, "run")
        .agg(F.min("content").alias("content"), F.count(F.lit(1)).alias("n"), F.min("source_date").alias("start"))
    )


def first_per_day(rows: DataFrame, keys: list[str], noise: list[str] = ()) -> DataFrame:
    """The first clean content of each group and day: two characters at least, and not noise."""
    clean = rows.where((F.length("content") >= 2) & ~F.lower("content").isin(list(noise)) if noise else F.length("content") >= 2)
    w = Window.partitionBy(*keys, "source_date").orderBy("id")
    return clean.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def islands(rows: DataFrame, keys: list[str], number: Column, width: int = 1 << 16) -> DataFrame:
    """(first, last, n) of maximal runs of consecutive distinct numbers.

    Runs are found within buckets of ``width`` numbers; those that touch a bucket's border, two for a bucket at most, are then joined.
    """
    x = F.col("_x")
    distinct = rows.select(*keys, number.cast("long").alias("_x")).distinct().withColumn("_b", F.floor(x / width))
    group = x - F.row_number().over(Window.partitionBy(*keys, "_b").orderBy("_x"))
    runs = distinct.withColumn("_g", group).groupBy(*keys, "_b", "_g").agg(F.min("_x").alias("first"), F.max("_x").alias("last"), F.count(F.lit(1)).alias("n"))
    at_border = (F.col("first") == F.col("_b") * width) | (F.col("last") == (F.col("_b") + 1) * width - 1)
    w = Window.partitionBy(*keys).orderBy("first")
    new = F.coalesce((F.lag("last").over(w) + 1 != F.col("first")).cast("int"), F.lit(1))
    border = runs.where(at_border).withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
    joined = border.groupBy(*keys, "_run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))
    return runs.where(~at_border).select(*keys, "first", "last", "n").unionByName(joined.drop("_run"))


def validity_intervals(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Maximal runs of days on which a content was seen: (content, start, end, days)."""
    epoch = F.lit("1970-01-01").cast("date")
    runs = islands(rows, [*keys, "content"], F.datediff("source_date", epoch))
    return runs.select(*keys, "content", F.date_add(epoch, F.col("first").cast("int")).alias("start"), F.date_add(epoch, F.col("last").cast("int")).alias("end"), F.col("n").alias("days"))


def as_of(probes: DataFrame, log: DataFrame, keys: list[str], probe_date: str, log_date: str, values: list[str], tie: str) -> DataFrame:
    """For each probe the log's latest row of its keys at or before its date (ties: the greatest ``tie``).

    One sort-based pass over both, no join of pairs: a window carries the last log row forward.
    """
    entry = F.struct(F.col(log_date).alias("at"), *[F.col(v) for v in values])
    both = log.select(*keys, F.col(log_date).alias("_d"), F.lit(0).alias("_k"), F.col(tie).alias("_t"), entry.alias("_e"), *[F.lit(None).cast(probes.schema[c].dataType).alias(f"_p_{c}") for c in probes.columns])
    asked = probes.select(*keys, F.col(probe_date).alias("_d"), F.lit(1).alias("_k"), F.lit(None).cast(log.schema[tie].dataType).alias("_t"), F.lit(None).cast(both.schema["_e"].dataType).alias("_e"), *[F.col(c).alias(f"_p_{c}") for c in probes.columns])
    w = Window.partitionBy(*keys).orderBy("_d", "_k", "_t").rowsBetween(Window.unboundedPreceding, 0)
    found = both.unionByName(asked).withColumn("_e", F.last("_e", ignorenulls=True).over(w)).where("_k = 1")
    return found.select(*[F.col(f"_p_{c}").alias(c) for c in probes.columns], F.col("_e.at").alias(f"as_of_{log_date}"), *[F.col(f"_e.{v}").alias(f"as_of_{v}") for v in values])


def known_at(log: DataFrame, day: str, keys: list[str], stated: str, effective: str) -> DataFrame:
    """The last state of each group among rows stated by ``day``: by effective date, then stated date, then id."""
    w = Window.partitionBy(*keys).orderBy(F.desc(effective), F.desc(stated), F.desc("id"))
    return log.where(F.col(stated) <= F.lit(day).cast("date")).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def next_session(effects: DataFrame, sessions: DataFrame, keys: list[str], effect_date: str, session_date: str) -> DataFrame:
    """For each effect the first session date of its keys on or after its own."""
    both = effects.select(*keys, F.col(effect_date).alias("_d"), F.lit(1).alias("_k"), F.lit(None).cast("date").alias("_s"), *[F.col(c).alias(f"_p_{c}") for c in effects.columns]).unionByName(
        sessions.select(*keys, F.col(session_date).alias("_d"), F.lit(0).alias("_k"), F.col(session_date).alias("_s"), *[F.lit(None).cast(effects.schema[c].dataType).alias(f"_p_{c}") for c in effects.columns])
    )
    w = Window.partitionBy(*keys).orderBy(F.col("_d").desc(), F.col("_k").asc()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_s", F.last("_s", ignorenulls=True).over(w)).where("_k = 1").select(*[F.col(f"_p_{c}").alias(c) for c in effects.columns], F.col("_s").alias("next_session"))


def interval_join(points: DataFrame, intervals: DataFrame, point: str, start: str, end: str, width: int, keys: list[str] = ()) -> DataFrame:
    """Points within closed date intervals; both fall into buckets of ``width`` days, and buckets join by hash.

    An interval enters every bucket that it touches, so choose a width near the usual length.
    """
    epoch = F.lit("1970-01-01").cast("date")
    bucket = lambda c: F.floor(F.datediff(c, epoch) / width).cast("long")
    left = points.withColumn("_b", bucket(F.col(point)))
    right = intervals.withColumn("_b", F.explode(F.sequence(bucket(F.col(start)), bucket(F.col(end)))))
    return left.join(right, ["_b", *keys]).where(F.col(point).between(F.col(start), F.col(end))).drop("_b")


def band_join(a: DataFrame, b: DataFrame, keys: list[str], a_date: str, b_date: str, days: int) -> DataFrame:
    """Pairs of equal keys whose dates lie at most ``days`` apart."""
    wide = a.withColumn("_from", F.date_sub(a_date, days)).withColumn("_to", F.date_add(a_date, days))
    return interval_join(b, wide, b_date, "_from", "_to", max(1, 2 * days + 1), keys).drop("_from", "_to")


def resolve_regimes(regimes: DataFrame, horizon: str) -> DataFrame:
    """(domain, id, kind, start, end, label) with each regime's end, and reversions behind temporary ones.

    ``regimes``: domain, id, start, temporary, end (null but for temporary ones), label.
    """
    w = Window.partitionBy("domain").orderBy("start", "id")
    after = F.coalesce(F.lead("start").over(w), F.date_add(F.lit(horizon).cast("date"), 1))
    first = F.row_number().over(w) == 1
    kind = F.when(first, "initial").when(F.col("temporary"), "temporary").otherwise("shift")
    r = regimes.withColumn("next", after).withColumn("kind", kind)
    r = r.withColumn("base", F.last(F.when(F.col("kind") != "temporary", F.col("label")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.date_sub("next", 1)
    own = r.select("domain", F.col("id").cast("string").alias("id"), "kind", "start", F.when(F.col("temporary") & F.col("end").isNotNull(), F.col("end")).otherwise(last).alias("end"), "label", "base", "next")
    back = own.where((F.col("kind") == "temporary") & F.col("base").isNotNull() & (F.date_add("end", 1) <= F.date_sub("next", 1))).select(
        "domain", F.concat("id", F.lit(".revert")).alias("id"), F.lit("reversion").alias("kind"), F.date_add("end", 1).alias("start"), F.date_sub("next", 1).alias("end"), F.col("base").alias("label")
    )
    return own.drop("base", "next").unionByName(back)


def coverage_violations(intervals: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Days of the horizon that the intervals of a group don't cover exactly once, with their number."""
    covered = intervals.select(*keys, F.explode(F.sequence("start", "end")).alias("day")).groupBy(*keys, "day").agg(F.count(F.lit(1)).alias("n"))
    spine = intervals.select(*keys).distinct().withColumn("day", F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))))
    return spine.join(covered, [*keys, "day"], "left").select(*keys, "day", F.coalesce("n", F.lit(0).cast("long")).alias("n")).where("n <> 1")


def spacing_violations(rows: DataFrame, keys: list[str], days: int) -> DataFrame:
    """Rows fewer than ``days`` after the one before in their group."""
    gap = F.datediff("source_date", F.lag("source_date").over(sequence(keys)))
    return rows.withColumn("gap", gap.cast("long")).where(F.col("gap") < days)


def recent_k(rows: DataFrame, k: int, date_col: str, id_col: str) -> DataFrame:
    """The latest ``k`` rows, in the order of their dates."""
    return rows.orderBy(F.desc(date_col), F.desc(id_col)).limit(k).orderBy(date_col, id_col)


def top_k_per(rows: DataFrame, keys: list[str], k: int | Column, *order, most: int | None = None) -> DataFrame:
    """The first ``k`` rows of each group; with a column ``k``, ``most`` bounds it, so that groups are cut before they are sorted whole."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    if most is not None:
        ranked = ranked.where(F.col("rank") <= most)
    return ranked.where(F.col("rank") <= k)


def token_budget(rows: DataFrame, keys: list[str], size: Column, budget: int, *order: Column) -> DataFrame:
    """The longest run of rows, from the first in ``order``, whose sizes sum to no more than the budget."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum(size.cast("long")).over(w)).where(F.col("running") <= budget)


def dedupe_batch(batch: DataFrame, keys: list[Column], *order: str) -> DataFrame:
    """The first row of each key."""
    named = batch.select("*", *[k.alias(f"_k{i}") for i, k in enumerate(keys)])
    w = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))]).orderBy(*order)
    return named.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", *[f"_k{i}" for i in range(len(keys))])


def not_stored(batch: DataFrame, store: DataFrame) -> DataFrame:
    """Rows whose (entity, lower-cased content, date, speaker) the store doesn't hold; other dates are new history."""
    key = lambda df: [df["entity"], F.lower(df["content"]), df["source_date"], df["speaker"]]
    held = store.select(*[k.alias(f"_s{i}") for i, k in enumerate(key(store))]).distinct()
    on = None
    for i, k in enumerate(key(batch)):
        same = k.eqNullSafe(held[f"_s{i}"])
        on = same if on is None else on & same
    return batch.join(held, on, "left_anti")


def ingest_report(batch: DataFrame, store: DataFrame, keys: list[str]) -> DataFrame:
    """Rows received, repeated within the batch, stored before, and added (the first of each key that the store lacks)."""
    known = store.select(*keys).distinct().withColumn("_known", F.lit(True))
    groups = batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(known, keys, "left")
    old = F.coalesce("_known", F.lit(False))
    return groups.agg(F.sum("n").alias("received"), F.sum(F.col("n") - 1).alias("repeated"), F.count_if(old).alias("stored_before"), F.count_if(~old).alias("added"))


def registry(references: dict[str, DataFrame]) -> DataFrame:
    """(ref, kind) of all that may be referred to."""
    out = None
    for kind, rows in references.items():
        rows = rows.select("ref", F.lit(kind).alias("kind"))
        out = rows if out is None else out.unionByName(rows)
    return out


def ranked(rows: DataFrame, score: Column, tie: Column) -> DataFrame:
    """(id, rank) over all rows without bringing them together: rows are ranged by ``score``, then ``tie``, and each range counts on from those before."""
    parts = rows.repartitionByRange(score, tie).sortWithinPartitions(score, tie).select("id", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_m"))
    held = settled(parts)  # ranges are sampled, so that a lost executor must not range anew
    place = F.col("_m") - F.shiftleft(F.col("_p").cast("long"), 33) + 1
    sizes = held.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    before = sizes.select("_p", (F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).alias("_b"))  # a row for each range
    return held.join(F.broadcast(before), "_p").select("id", (place + F.col("_b")).alias("rank"))


def period_steps(days: DataFrame, keys: list[str], day: str) -> DataFrame:
    """Each key's days (distinct) with the one before: whether a new week and month begin, and how many days, weeks and months lie between (null for the first, which begins both)."""
    before = F.lag(day).over(Window.partitionBy(*keys).orderBy(day))
    week = lambda c: F.date_trunc("week", c).cast("date")
    month = lambda c: F.year(c) * 12 + F.month(c)
    d, b = F.col(day), F.col("previous")
    rows = days.select(*keys, day).distinct().withColumn("previous", before)
    return rows.select(*keys, day, "previous", F.coalesce(week(d) != week(b), F.lit(True)).alias("new_week"), F.coalesce(month(d) != month(b), F.lit(True)).alias("new_month"), F.datediff(d, b).alias("days"), (F.datediff(week(d), week(b)) / 7).cast("int").alias("weeks"), (month(d) - month(b)).alias("months"))


def sessions_of_periods(days: DataFrame, day: str) -> DataFrame:
    """(day, in_day, in_week, in_month): how many sessions (a row each) lie in each day, and in its week and month."""
    per = days.groupBy(day).agg(F.count(F.lit(1)).alias("in_day"))  # a row for each day
    total = lambda period: F.sum("in_day").over(Window.partitionBy(period))
    return per.select(day, "in_day", total(F.date_trunc("week", day)).alias("in_week"), total(F.date_trunc("month", day)).alias("in_month"))
