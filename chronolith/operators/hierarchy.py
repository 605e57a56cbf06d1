"""The five-level memory hierarchy: nodes (id, level, period, parent)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import settled

LEVELS = ("L1", "L2", "L3", "L4", "L5")


def of_level(nodes: DataFrame, level: str) -> DataFrame:
    return nodes.where(F.col("level") == level)


def level_left_join(core: DataFrame, details: dict[str, DataFrame], column: str) -> DataFrame:
    """Core rows with the level's own detail (id, ``column``); the levels' details are joined at once, on id and level."""
    every = None
    for level, rows in details.items():
        rows = rows.select(F.col("id").alias("_id"), F.lit(level).alias("_l"), F.col(column))
        every = rows if every is None else every.unionByName(rows)
    return core.join(every, (core["id"] == every["_id"]) & (core["level"] == every["_l"]), "left").drop("_id", "_l")


def children(nodes: DataFrame, parent_level: str) -> DataFrame:
    """(parent, child) pairs below the nodes of a level."""
    up = of_level(nodes, parent_level).select(F.col("id").alias("parent"))
    return nodes.where(F.col("parent").isNotNull()).select("parent", F.col("id").alias("child")).join(up, "parent", "left_semi")


def parent_chain(nodes: DataFrame) -> DataFrame:
    """Each L1 node with its ancestors; the first gap stops the chain."""
    out = of_level(nodes, "L1").select(F.col("id").alias("L1"), F.col("parent").alias("_up"))
    for level in LEVELS[1:]:
        up = of_level(nodes, level).select(F.col("id").alias(level), F.col("parent").alias("_next"))
        out = out.join(up, F.col("_up") == F.col(level), "left").drop("_up").withColumnRenamed("_next", "_up")
    return out.drop("_up")


def missing_parents(nodes: DataFrame, level: str, pending: DataFrame | None = None) -> DataFrame:
    """(id, n): nodes of the next level that ``level`` asks for and that don't exist; ``pending`` ids count as children."""
    below = of_level(nodes, level).select("parent")
    if pending is not None:
        below = below.unionByName(pending.select("parent"))
    built = of_level(nodes, LEVELS[LEVELS.index(level) + 1]).select(F.col("id").alias("parent"))
    return below.where(F.col("parent").isNotNull()).join(built, "parent", "left_anti").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("n"))


def level_violations(nodes: DataFrame) -> DataFrame:
    """Edges whose parent isn't one level up."""
    rank = lambda c: F.substring(c, 2, 1).cast("int")
    up = nodes.select(F.col("id").alias("_p"), F.col("level").alias("parent_level"))
    edges = nodes.join(up, F.col("parent") == F.col("_p"))
    return edges.where(rank(F.col("parent_level")) != rank(F.col("level")) + 1).select("id", "level", "parent", "parent_level")


def reach(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, node, hops): what can be reached from each start (id) over directed edges (src, dst), by least hops.

    A fixed number of equi-joins, each on distinct frontiers.
    """
    seen = frontier = starts.select(F.col("id").alias("start"), F.col("id").alias("node"), F.lit(0).alias("hops"))
    for i in range(1, depth + 1):
        frontier = frontier.join(edges, frontier["node"] == edges["src"]).select("start", F.col("dst").alias("node"), F.lit(i).alias("hops")).distinct()
        seen = seen.unionByName(frontier)
    return seen.groupBy("start", "node").agg(F.min("hops").alias("hops")).where("hops > 0")


def neighbours(edges: DataFrame, node, direction: str = "both", kind: str | None = None) -> DataFrame:
    """Distinct neighbours of a node over (src, dst), of one kind of edge if it is named."""
    edges = edges.where(F.col("kind") == kind) if kind is not None else edges
    out = edges.where(F.col("src") == node).select(F.col("dst").alias("id"))
    into = edges.where(F.col("dst") == node).select(F.col("src").alias("id"))
    return {"out": out, "in": into, "both": out.unionByName(into)}[direction].distinct()


def period_end(level: Column, period: Column) -> Column:
    return F.when(level == "L4", F.date_add(period, 6)).when(level == "L5", F.last_day(period)).otherwise(period)


def edges_where(edges: DataFrame, kind: str | None = None, src: str | None = None, dst: str | None = None) -> DataFrame:
    """Edges (src, dst, kind) of a kind, from a node or to one."""
    for column, value in (("kind", kind), ("src", src), ("dst", dst)):
        edges = edges.where(F.col(column) == value) if value is not None else edges
    return edges


def degrees(edges: DataFrame) -> DataFrame:
    """(id, outgoing, incoming) of every node with an edge."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(edges.select(F.col("dst"), F.lit(0), F.lit(1)))
    return ends.groupBy("id").agg(F.sum("o").alias("outgoing"), F.sum("i").alias("incoming"))


def cascade(dirty_days: DataFrame, day: str) -> DataFrame:
    """(layer, period, start) of every week, month and year that a dirty day lies in, and the lifetime: what has to be built anew, lower layers first."""
    d = F.col(day)
    layers = F.array(
        F.struct(F.lit(1).alias("layer"), F.concat(F.lit("week:"), F.date_trunc("week", d).cast("date").cast("string")).alias("period")),
        F.struct(F.lit(2).alias("layer"), F.concat(F.lit("month:"), F.date_format(d, "yyyy-MM")).alias("period")),
        F.struct(F.lit(3).alias("layer"), F.concat(F.lit("year:"), F.date_format(d, "yyyy")).alias("period")),
        F.struct(F.lit(4).alias("layer"), F.lit("lifetime").alias("period")),
    )
    return dirty_days.select(F.explode(layers).alias("x")).select("x.layer", "x.period").distinct()


def historical(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each edge (id, earlier_id) with the content and date of the earlier node."""
    earlier = nodes.select(F.col("id").alias("earlier_id"), F.col("content").alias("earlier"), F.col("source_date").alias("earlier_date"))
    return edges.join(earlier, "earlier_id").select("id", "earlier", "earlier_date")


def _digest(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, hash): a hash of each key's distinct rows of ``columns``, added up in the scanning tasks in whatever order."""
    bits = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns], F.lit("")), 256)
    part = lambda i: F.sum(F.conv(F.substring(bits, i, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    distinct = rows.select(*keys, *columns).distinct()
    return distinct.groupBy(*keys).agg(F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), part(1), part(16)), 256).alias("hash"))


def _periods(layers: list[tuple[str, Column, list[str]]], rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.select("*", *[period.alias(f"_{name}") for name, period, _ in layers])


def rollup(rows: DataFrame, keys: list[str], layers: list[tuple[str, Column, list[str]]], source: list[str]) -> dict[str, DataFrame]:
    """For each layer (name, period, what its summary keeps): (keys, period, parent, built_from, hash).

    ``built_from`` of the lowest layer is a hash of its rows' ``source`` columns, above it one of the hashes of the periods below; ``hash`` is
    that of the distinct rows of what the layer's summary keeps.
    """
    rows = _periods(layers, rows, keys)
    out, below = {}, None
    for i, (name, _, kept) in enumerate(layers):
        here = [*keys, f"_{name}"]
        built_from = _digest(rows, here, source) if below is None else _digest(below.select(*keys, F.col("parent").alias(f"_{name}"), "period", "hash"), here, ["period", "hash"])
        up = f"_{layers[i + 1][0]}" if i + 1 < len(layers) else None
        parent = rows.groupBy(*here).agg((F.min(up) if up else F.lit(None).cast("string")).alias("parent"))
        both = _digest(rows, here, kept).join(built_from.withColumnRenamed("hash", "built_from"), here).join(parent, here)
        out[name] = below = settled(both.select(*keys, F.col(f"_{name}").alias("period"), "parent", "built_from", "hash"))
    return out


def gated_cascade(rows: DataFrame, touched: DataFrame, stored: dict[str, DataFrame], keys: list[str], layers: list[tuple[str, Column, list[str]]], source: list[str]) -> DataFrame:
    """(keys, layer, period): the periods to build anew after rows were added, lower layers first by number.

    ``touched`` (keys, period) names the lowest layer's periods of the new rows and ``stored`` what ``rollup`` gave at the last build.  A
    period whose sources hash as they did stays; one that differs is built, and only if its summary's hash changes is the
    period above it looked at: a hash of the stored hashes below it, the new ones in place of the old.  Rows are
    read for the periods that are built and no others, and a layer without a change ends the climb.  Each layer's few rows are written
    to the shared folder before the next one is looked at.
    """
    rows = _periods(layers, rows, keys)
    out, changed = None, None
    for i, (name, _, kept) in enumerate(layers):
        here, old = [*keys, "period"], stored[name]
        named = rows.withColumn("period", F.col(f"_{name}"))
        if changed is None:
            now = _digest(named.join(touched.select(*here).distinct(), here, "left_semi"), here, source)
        else:
            above = changed.select(*keys, "parent").distinct()
            kin = stored[layers[i - 1][0]].join(above, [*keys, "parent"], "left_semi").join(changed.select(*here), here, "left_anti")
            every = kin.select(*here, "parent", "hash").unionByName(changed.select(*here, "parent", "hash"))
            now = _digest(every.select(*keys, F.col("parent").alias("above"), "period", "hash"), [*keys, "above"], ["period", "hash"]).withColumnRenamed("above", "period")
        before = old.select(*here, "built_from", F.col("hash").alias("old_hash"))
        dirty = settled(now.withColumnRenamed("hash", "now_from").join(before, here, "left").where(~F.col("now_from").eqNullSafe(F.col("built_from"))).select(*here))
        if dirty.isEmpty():
            break
        out = dirty.select(*keys, F.lit(i + 1).alias("layer"), "period") if out is None else out.unionByName(dirty.select(*keys, F.lit(i + 1).alias("layer"), "period"))
        if i + 1 < len(layers):
            read = named.join(dirty, here, "left_semi")
            built = _digest(read, here, kept).join(read.groupBy(*here).agg(F.min(f"_{layers[i + 1][0]}").alias("parent")), here)
            changed = settled(built.join(before.select(*here, "old_hash"), here, "left").where(~F.col("hash").eqNullSafe(F.col("old_hash"))).select(*here, "parent", "hash"))
    return out if out is not None else touched.select(*keys, F.lit(1).alias("layer"), "period").limit(0)


def capped_parents(hits: DataFrame, nodes: DataFrame, counts: dict[str, int]) -> DataFrame:
    """(query, level, id, first_rank): the nodes that ranked hits (query, rank, and for each level its ancestor's id) lead to, each once, by its first hit.

    Of each level the first ``counts`` that exist are kept.
    """
    chain = F.array(*[F.struct(F.lit(level).alias("level"), F.col(level).alias("id")) for level in counts])
    first = hits.select("query", "rank", F.explode(chain).alias("x")).select("query", "rank", "x.*").groupBy("query", "level", "id").agg(F.min("rank").alias("first_rank"))
    found = first.join(nodes.select("level", "id"), ["level", "id"], "left_semi")
    cap = F.element_at(F.create_map(*[F.lit(x) for kv in counts.items() for x in kv]), F.col("level"))
    place = F.row_number().over(Window.partitionBy("query", "level").orderBy("first_rank", "id"))
    return found.withColumn("_n", place).where(F.col("_n") <= max(counts.values())).where(F.col("_n") <= cap).select("query", "level", "id", "first_rank")
