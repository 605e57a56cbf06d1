"""Predicates, sampling, greedy picks and set operations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import settled
from . import metrics


def of_pair(rows: DataFrame, a: str, b: str, first: str = "user_id", second: str = "expert_id") -> DataFrame:
    """Rows of a pair, whichever way round it stands."""
    return rows.where(((F.col(first) == a) & (F.col(second) == b)) | ((F.col(first) == b) & (F.col(second) == a)))


def payload_filter(rows: DataFrame, equals: dict | None = None, any_of: dict | None = None, between: dict | None = None, either: list[tuple[str, str, object]] = ()) -> DataFrame:
    """Equality, membership, closed ranges (None: open), and a value in either of two columns."""
    for c, v in (equals or {}).items():
        rows = rows.where(F.col(c) == v)
    for c, v in (any_of or {}).items():
        rows = rows.where(F.col(c).isin(*v))
    for c, (low, high) in (between or {}).items():
        rows = rows.where(F.col(c) >= low) if low is not None else rows
        rows = rows.where(F.col(c) <= high) if high is not None else rows
    for a, b, v in either:
        rows = rows.where((F.col(a) == v) | (F.col(b) == v))
    return rows


def of_tenant(rows: DataFrame, user_id: str | None) -> DataFrame:
    """A tenant's rows; none without a tenant."""
    return rows.where(F.col("user_id") == user_id) if user_id else rows.limit(0)


def at_time(rows: DataFrame, column: str, time: str, seconds: int = 1) -> DataFrame:
    t = F.lit(time).cast("timestamp")
    return rows.where(F.abs(F.unix_micros(F.col(column).cast("timestamp")) - F.unix_micros(t)) <= seconds * 1_000_000)


def paged(rows: DataFrame, page: int, size: int, *order) -> tuple[DataFrame, DataFrame]:
    """(one page from 1 on, the true total)."""
    return rows.orderBy(*order).offset((page - 1) * size).limit(size), rows.agg(F.count(F.lit(1)).alias("total"))


def eligible(questions: DataFrame, day: Column, date: Column, named_dates: Column) -> DataFrame:
    """Questions whose evidence days, and dates named in their text, all lie before the day asked."""
    return questions.where(F.forall("evidence_days", lambda e: e < day) & F.forall(named_dates, lambda d: d < date))


def not_in_context(chunks: DataFrame, context: str, size: int = 100) -> DataFrame:
    """Chunks whose first characters the context doesn't hold yet."""
    return chunks.where(~F.lit(context).contains(F.substring("content", 1, size)))


def largest_remainder(rows: DataFrame, key: str, n: int, order: Column) -> DataFrame:
    """``n`` rows dealt to the groups by their shares, the greatest remainders rounded up; in a group by ``order``."""
    g = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_c"))
    total = F.sum("_c").over(Window.partitionBy())
    g = g.withColumn("_q", n * F.col("_c") / total).withColumn("_s", F.floor("_q")).withColumn("_r", F.col("_q") - F.col("_s"))
    left = n - F.sum("_s").over(Window.partitionBy())
    g = g.withColumn("_s", F.col("_s") + F.when(F.row_number().over(Window.orderBy(F.desc("_r"), key)) <= left, 1).otherwise(0)).select(key, "_s")  # a row for each group
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("_n") <= n)  # no group gives more
    return ranked.join(F.broadcast(g), key).where(F.col("_n") <= F.col("_s")).drop("_n", "_s")


def first_per_type(rows: DataFrame, excluded: DataFrame, key: str, kind: str, n: int) -> DataFrame:
    """The first ``n`` of each type, those excluded left out."""
    rest = rows.join(excluded.select(key), key, "left_anti")
    return rest.withColumn("_n", F.row_number().over(Window.partitionBy(kind).orderBy(key))).where(F.col("_n") <= n).drop("_n")


def first_of_each(items: DataFrame, keys: list[str], n: int, *order) -> DataFrame:
    """The first ``n`` rows of each combination of ``keys``; each task passes on no more than that many of one combination."""
    return items.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def greedy_sample(items: DataFrame, group: str, n: int, decay: float = 0.5, cap: float = 0.4) -> DataFrame:
    """Weighted greedy picks in each group: a pick's stratum loses weight, an answer may fill ``cap`` of the picks.

    Where only capped answers are left, all that remain are open again.  Of the rows of one stratum and answer none is
    picked before a heavier one (ties: the least id), so only the first ``n`` of each can be picked; and
    of one stratum only its first rows can be, as many as the picks and ``n`` for each answer that may be full.
    What is left, at most strata x n x (1 + n / cap) rows of a group however many it has, goes to one Python call.
    """
    full = max(1, int(cap * n))
    order = (F.desc("weight"), "id")
    few = first_of_each(items, [group, "stratum", "answer"], n, *order)
    few = first_of_each(few, [group, "stratum"], n + n * (n // full), *order)

    def pick(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("id").reset_index(drop=True)
        answer, weight, chosen, answers = g["answer"].to_numpy(), g["weight"].to_numpy(float).copy(), [], {}
        stratum, left = g["stratum"].to_numpy(), list(range(len(g)))
        while left and len(chosen) < n:
            open_ = [i for i in left if answers.get(answer[i], 0) < full] or left
            best = max(open_, key=lambda i: (weight[i], -i))
            chosen.append(best)
            left.remove(best)
            answers[answer[best]] = answers.get(answer[best], 0) + 1
            weight[stratum == stratum[best]] *= decay
        return g.loc[chosen].assign(pick=range(1, len(chosen) + 1))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.schema)
    return few.groupBy(group).applyInPandas(pick, f"{fields}, pick long")


def diversified(hits: DataFrame, group: str, k: int, relevance: float = 0.7) -> DataFrame:
    """Maximal marginal relevance among each query's hits (id, score, tokens): relevance against likeness to what is chosen.

    Likeness lies between 0 and 1, so that a hit whose score is below the k-th best by more than the whole
    penalty is never chosen; hits above that go to one Python call for each query.
    """
    best = first_of_each(hits.select(group, "id", "score"), [group], k, F.desc("score"), "id").groupBy(group).agg(F.min("score").alias("_least"))
    near = hits.join(best, group).where(F.col("score") >= F.col("_least") - (1 - relevance) / relevance - 1e-9).drop("_least")

    def pick(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
        sets, score, chosen = [set(t) for t in g["tokens"]], g["score"].to_numpy(float), []
        like = lambda a, b: len(a & b) / len(a | b) if a | b else 0.0
        left, likest = list(range(len(g))), [0.0] * len(g)
        while left and len(chosen) < k:
            best = max(left, key=lambda i: (relevance * score[i] - (1 - relevance) * likest[i], -i))
            chosen.append(best)
            left.remove(best)
            for i in left:
                likest[i] = max(likest[i], like(sets[i], sets[best]))
        return g.loc[chosen, [group, "id", "score"]].assign(rank=range(1, len(chosen) + 1))

    kinds = {f.name: f.dataType.simpleString() for f in hits.schema}
    return near.groupBy(group).applyInPandas(pick, f"{group} {kinds[group]}, id {kinds['id']}, score double, rank long")


def level_then_session(hits: DataFrame, n: int) -> DataFrame:
    """Rounds of diversity: each level's best, then each session's best, then the best of the rest.

    The best of a level or session are found by an aggregate.  Of the rest only the best ``2 n`` hits can be wanted: where they hold fewer than ``n``
    of it, the first rounds fill the result.
    """
    order = [F.desc("score"), "id"]
    every = F.struct(*hits.columns)
    best = lambda key: hits.groupBy(key).agg(F.max_by(every, F.struct("score", -F.col("id"))).alias("r")).select("r.*")
    rounds = [df.orderBy(*order).limit(m).withColumn("round", F.lit(i)) for i, (df, m) in enumerate(((best("level"), n), (best("session"), 2 * n), (hits, 2 * n)), 1)]
    found = rounds[0].unionByName(rounds[1]).unionByName(rounds[2])
    one = found.groupBy("id").agg(F.min_by(F.struct(*hits.columns, "round"), "round").alias("r")).select("r.*")
    return one.orderBy("round", *order).limit(n)


def merged_by_id(rows: DataFrame) -> DataFrame:
    """Hits (id, ord, source, score, content) by id: the first one's content, all sources, the greatest score."""
    return rows.groupBy("id").agg(F.min_by("content", "ord").alias("content"), F.max("score").alias("score"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


def priority_union(first: DataFrame, second: DataFrame, key: str = "id") -> DataFrame:
    """All of ``first``, and of ``second`` what isn't there."""
    return first.withColumn("priority", F.lit(1)).unionByName(second.join(first.select(key), key, "left_anti").withColumn("priority", F.lit(2)))


def missing_required(required: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Required combinations that were never observed."""
    return required.select(*keys).distinct().join(observed.select(*keys).distinct(), keys, "left_anti")


def evenly_spread(rows: DataFrame, keys: list[str], k: int, order: str) -> DataFrame:
    """``k`` of each group's rows, spread evenly over their order (banker's rounding)."""
    w = Window.partitionBy(*keys)
    r = rows.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    places = F.transform(F.sequence(F.lit(0), F.least(F.lit(k), F.col("_n").cast("int")) - 1), lambda i: F.when(F.least(F.lit(k), F.col("_n")) <= 1, 0).otherwise(F.bround(i * (F.col("_n") - 1) / (F.least(F.lit(k), F.col("_n")) - 1))).cast("int"))
    return r.where(F.array_contains(places, F.col("_i"))).drop("_i", "_n")


def tasks_once(tasks: DataFrame) -> DataFrame:
    """One task for each (layer, start): a forced one wins, then the first to arrive."""
    w = Window.partitionBy("layer", "start").orderBy(F.desc("force_update"), "arrival")
    return tasks.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def interleaved(tasks: DataFrame, fin: str = "fin") -> DataFrame:
    """Tasks in an order in which parents follow their children."""
    return tasks.orderBy(fin, "level", "id")


def expanded_hits(hits: DataFrame, index: DataFrame, reach: int, budget: int) -> DataFrame:
    """Each hit (id) with its neighbours of the same source in the index (id, source, size), nearest first while they fit the budget."""
    h = hits.select(F.col("id").alias("hit")).join(index.select(F.col("id").alias("hit"), F.col("source").alias("_s")), "hit")
    near = h.withColumn("id", F.explode(F.sequence(F.col("hit") - reach, F.col("hit") + reach))).join(index, "id").where(F.col("source") == F.col("_s"))
    w = Window.partitionBy("hit").orderBy(F.abs(F.col("id") - F.col("hit")), "id").rowsBetween(Window.unboundedPreceding, 0)
    return near.withColumn("running", F.sum("size").over(w)).where(F.col("running") <= budget).select("hit", "id", "running")


def change_dates(observed: DataFrame, first: int, last: int, values: list[str], cycle_days: int = 7, keys: list[str] = (), before: bool = False) -> DataFrame:
    """(keys, start, rotation, n): start days from ``first`` to ``last``, and rotations, of an alternation that agree with every observation.

    ``observed`` (keys, day, value): from the start on, ``values`` take turns of ``cycle_days`` days, beginning with that of the rotation's
    number; with ``before`` the key's first value held up to it.  ``n`` counts the observations from the start on, one at least.

    What an observation rules out depends on its day within a whole turn of all values and on its value alone, so of each such pair
    only the latest day counts (it rules out starts up to itself), and of each value the earliest.
    These are gathered in the scanning tasks, and each start and rotation is judged by them, without pairing.
    """
    if not keys:
        return change_dates(observed.withColumn("_all", F.lit(0)), first, last, values, cycle_days, ["_all"], before).drop("_all")
    turn = cycle_days * len(values)
    place = F.array_position(F.array(*map(F.lit, values)), F.col("value")).cast("int") - 1  # -1: none of the values
    rows = observed.where(F.col("day").isNotNull() & F.col("value").isNotNull())
    cells = rows.groupBy(*keys, F.pmod(F.col("day"), F.lit(turn)).alias("at"), "value", place.alias("j")).agg(F.max("day").alias("latest"), F.min("day").alias("earliest"))
    per = cells.groupBy(*keys).agg(F.collect_list(F.struct("at", "j", "latest", "value", "earliest")).alias("cells"), F.min_by("value", F.struct("earliest", "value")).alias("old"))
    # Observations of each day that can be a start, and of all later ones.
    days = rows.groupBy(*keys, F.least(F.greatest(F.col("day"), F.lit(first - 1)), F.lit(last + 1)).alias("d")).agg(F.count(F.lit(1)).alias("c"))
    per = per.join(days.groupBy(*keys).agg(F.collect_list(F.struct("d", "c")).alias("days")), keys)
    other = F.array_min(F.transform(F.filter("cells", lambda c: c["value"] != F.col("old")), lambda c: c["earliest"]))
    upto = per.withColumn("until", F.least(F.lit(last), F.coalesce(other, F.lit(last))) if before else F.lit(last)).where(F.col("until") >= first)
    starts = upto.withColumn("start", F.explode(F.sequence(F.lit(first), F.col("until").cast("int")))).withColumn("rotation", F.explode(F.sequence(F.lit(0), F.lit(len(values) - 1))))
    wanted = lambda at: F.pmod(F.floor(F.pmod(at - F.col("start"), F.lit(turn)) / cycle_days) + F.col("rotation"), F.lit(len(values)))
    agrees = F.forall("cells", lambda c: (c["latest"] < F.col("start")) | (c["j"] == wanted(c["at"])))
    n = F.aggregate(F.filter("days", lambda x: x["d"] >= F.col("start")), F.lit(0).cast("long"), lambda s, x: s + x["c"])
    return starts.where(agrees).select(*keys, "start", "rotation", n.alias("n")).where("n > 0")


def scheduled(statements: DataFrame, sessions: DataFrame, cap: int) -> DataFrame:
    """Each user's statements (user, id, effective_day) dealt to session days (user, day) on or after them, at most ``cap`` a day.

    A day that is full passes its statement on to the next.  A user's sessions hold ``cap`` numbered slots each.  In order of day and
    id a statement takes the first free slot from its own first one on, so that the i-th stands in slot i plus the greatest of
    (own first slot - number) up to it: a running maximum, in one window over statements and sessions.
    """
    days = sessions.select("user", "day").distinct()
    both = statements.select("user", "id", F.col("effective_day").alias("day"), F.lit(0).alias("side")).unionByName(days.select("user", F.lit(None).cast("long").alias("id"), "day", F.lit(1).alias("side")))
    w = Window.partitionBy("user").orderBy("day", "side", "id")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    numbered = both.withColumns({"number": F.sum(1 - F.col("side")).over(so_far) - 1, "before": F.sum("side").over(so_far)})
    slots = numbered.withColumn("free", F.max(F.when(F.col("side") == 0, F.col("before") * cap - F.col("number"))).over(so_far))
    taken = slots.where("side = 0").select("user", "id", F.floor((F.col("number") + F.col("free")) / cap).alias("session"))
    named = slots.where("side = 1").select("user", (F.col("before") - 1).alias("session"), F.col("day").alias("stated_day"))
    return taken.join(named, ["user", "session"], "left").select("user", "id", "stated_day")


def paths(edges: DataFrame, start, end, depth: int, limit: int = 10) -> DataFrame:
    """Undirected paths between two nodes over distinct edges (id, src, dst), the shortest first."""
    both = edges.select("id", "src", "dst").unionByName(edges.select("id", F.col("dst").alias("src"), F.col("src").alias("dst")))
    front = both.where(F.col("src") == start).select(F.col("dst").alias("at"), F.array("id").alias("edges"))
    found = front.where(F.col("at") == end)
    for _ in range(1, depth):
        front = front.where(F.col("at") != end).join(both, F.col("at") == F.col("src")).where(~F.array_contains("edges", F.col("id"))).select(F.col("dst").alias("at"), F.array_append("edges", F.col("id")).alias("edges"))
        found = found.unionByName(front.where(F.col("at") == end))
    return found.select("edges", F.size("edges").alias("hops")).orderBy("hops", "edges").limit(limit)


def paths_between(edges: DataFrame, pairs: DataFrame, depth: int, limit: int = 10) -> DataFrame:
    """(a, b, edges, hops): for each pair (a, b) its undirected paths of distinct edges (id, src, dst), at most ``depth`` long, the ``limit`` shortest.

    Frontiers grow from both ends for half of the depth each and meet in the middle, for all pairs at once, so that no frontier is
    longer than half a path; a path ends where it first comes to its end.
    """
    both = edges.select("id", "src", "dst").unionByName(edges.where("src <> dst").select("id", F.col("dst").alias("src"), F.col("src").alias("dst")))
    asked = pairs.select("a", "b").where("a <> b").distinct()

    def grown(start: str, steps: int) -> list[DataFrame]:
        """By length: (a, b, at, edges) of walks from one end that don't come to ``b`` before they are over."""
        out = [asked.select("a", "b", F.col(start).alias("at"), F.array().cast("array<long>").alias("edges"))]
        for _ in range(steps):
            front = out[-1].where(F.col("at") != F.col("b")) if start == "a" else out[-1]
            step = front.join(both, F.col("at") == F.col("src")).where(~F.array_contains("edges", F.col("id")))
            step = step.where(F.col("dst") != F.col("b")) if start == "b" else step
            out.append(settled(step.select("a", "b", F.col("dst").alias("at"), (F.array_append("edges", F.col("id")) if start == "a" else F.array_prepend("edges", F.col("id"))).alias("edges"))))
        return out

    there, back, found = grown("a", -(-depth // 2)), grown("b", depth // 2), None
    for hops in range(1, depth + 1):
        left, right = there[-(-hops // 2)], back[hops // 2].withColumnRenamed("edges", "rest")
        whole = left.join(right, ["a", "b", "at"]).where(~F.arrays_overlap("edges", "rest")).select("a", "b", F.concat("edges", "rest").alias("edges"), F.lit(hops).alias("hops"))
        found = whole if found is None else found.unionByName(whole)
    return first_of_each(found, ["a", "b"], limit, "hops", "edges")


def related(rows: DataFrame, n: int = 3) -> DataFrame:
    """Each row's nearest others of its session by id, ``n`` at most (columns id, session)."""
    w = Window.partitionBy("session").orderBy("id")
    parts = [F.when(F.lead("id", i).over(w).isNotNull(), F.struct(F.lit(i).alias("gap"), F.lead("id", i).over(w).alias("id"))) for i in range(1, n + 1)]
    parts += [F.when(F.lag("id", i).over(w).isNotNull(), F.struct(F.lit(i).alias("gap"), F.lag("id", i).over(w).alias("id"))) for i in range(1, n + 1)]
    named = rows.select("id", *[x.alias(f"_{i}") for i, x in enumerate(parts)])
    near = F.slice(F.array_sort(F.array_compact(F.array(*[f"_{i}" for i in range(len(parts))]))), 1, n)
    return named.select("id", F.explode(F.transform(near, lambda x: x["id"])).alias("related"))




def valid_hits(hits: DataFrame) -> DataFrame:
    """Hits with an id, some content and a score that isn't negative."""
    return hits.where(F.col("id").isNotNull() & (F.coalesce(F.length("content"), F.lit(0)) > 0) & (F.col("score") >= 0))


def proportional(rows: DataFrame, key: str, share: float, order: Column) -> DataFrame:
    """That share of each category's rows, rounded up, the first by ``order``, a number below 2 ** 53 that hardly any two rows have in common.

    The last number taken is found for each category without sorting it whole; rows that have it in common are all taken.
    """
    numbered = rows.withColumn("_o", order)
    cuts = metrics.values_at(numbered, [key], "_o", {"_cut": (share, lambda n: F.ceil(n * share) - 1)})
    return numbered.join(cuts, key).where(F.col("_o") <= F.col("_cut")).drop("_o", "_cut")  # cuts: a row for each category


# For each retrieval strategy its layers, with the hits of the first and of the last ranking.
STRATEGIES = {
    "simple": {"L1": (40, 20), "L2": (2, 1)},
    "hybrid": {"L1": (40, 20), "L2": (2, 2), "L3": (1, 1), "L4": (1, 1)},
    "complex": {"L1": (40, 20), "L3": (2, 2), "L4": (2, 1), "L5": (1, 1)},
}
