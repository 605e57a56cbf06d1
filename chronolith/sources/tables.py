"""The model's tables, read from the driver's star schema; each has its SQL twin in ``SQL``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated records (id, content, entity, type, speaker, source_date) from ``events``."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type").isin("click", "view"), "preference").when(F.col("event_type") == "error", "fact").otherwise("event")
    return e.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("v"), (F.regexp_extract("props", "[0-9]+", 0).cast("int") % 3).cast("string")).alias("content"),
        F.col("event_type").alias("entity"),
        kind.alias("type"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("speaker"),
        F.to_date("ts").alias("source_date"),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns (session, turn, speaker, text, date) from ``conversations``, a day for each session."""
    c = table(spark, sf_dir, "conversations")
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("conv_id").cast("int"))
    return c.select(F.col("conv_id").alias("session"), "turn", F.col("role").alias("speaker"), "text", day.alias("date"))


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five-level hierarchy's nodes (id, level, period, parent) from ``orders``: order, customer-day, day, ISO week, month.

    Nodes whose number divides by seven were never built; what they would hold has no parent.
    """
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("d"))
    week, month = F.date_trunc("week", "d").cast("date"), F.trunc("d", "month")
    names = {
        "L1": (F.concat(F.lit("o"), F.col("o_orderkey").cast("string")), F.col("d")),
        "L2": (F.concat_ws(":", F.lit("s"), F.col("o_custkey").cast("string"), F.col("d").cast("string")), F.col("d")),
        "L3": (F.concat(F.lit("d:"), F.col("d").cast("string")), F.col("d")),
        "L4": (F.concat(F.lit("w:"), week.cast("string")), week),
        "L5": (F.concat(F.lit("m:"), month.cast("string")), month),
    }
    built = {"L1": F.lit(True), "L2": F.col("o_custkey") % 7 != 0, "L3": F.day("d") % 7 != 0, "L4": F.day(week) % 7 != 0, "L5": F.lit(True)}
    parent = {"L1": "L2", "L2": "L3", "L3": "L4"}
    up = {level: names[parent[level]][0] if level in parent else F.lit(None).cast("string") for level in names}
    up["L4"] = F.concat(F.lit("m:"), F.trunc(week, "month").cast("string"))
    # One scan: each order names its node of every level, and the nodes are told apart once.
    rows = F.array_compact(F.array(*[F.when(built[x], F.struct(names[x][0].alias("id"), F.lit(x).alias("level"), names[x][1].alias("period"), up[x].alias("parent"))) for x in names]))
    return o.select(F.explode(rows).alias("n")).select("n.*").distinct()


SQL = {
    "m": """m AS (SELECT event_id AS id, 'v' || CAST(CAST(regexp_extract(props, '[0-9]+') AS INT) % 3 AS VARCHAR) AS content, event_type AS entity,
  CASE WHEN event_type IN ('click', 'view') THEN 'preference' WHEN event_type = 'error' THEN 'fact' ELSE 'event' END AS type,
  'user_' || CAST(user_id AS VARCHAR) AS speaker, CAST(ts AS DATE) AS source_date FROM events)""",
    "t": "t AS (SELECT conv_id AS session, turn, role AS speaker, text, CAST(DATE '2024-01-01' + CAST(conv_id AS INT) AS DATE) AS date FROM conversations)",
    "l": """o AS MATERIALIZED (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS d, CAST(date_trunc('week', o_orderdate) AS DATE) AS w, CAST(date_trunc('month', o_orderdate) AS DATE) AS mo FROM orders),
l AS MATERIALIZED (SELECT DISTINCT 'o' || CAST(o_orderkey AS VARCHAR) AS id, 'L1' AS level, d AS period, 's:' || CAST(o_custkey AS VARCHAR) || ':' || CAST(d AS VARCHAR) AS parent FROM o
 UNION ALL SELECT DISTINCT 's:' || CAST(o_custkey AS VARCHAR) || ':' || CAST(d AS VARCHAR), 'L2', d, 'd:' || CAST(d AS VARCHAR) FROM o WHERE o_custkey % 7 <> 0
 UNION ALL SELECT DISTINCT 'd:' || CAST(d AS VARCHAR), 'L3', d, 'w:' || CAST(w AS VARCHAR) FROM o WHERE day(d) % 7 <> 0
 UNION ALL SELECT DISTINCT 'w:' || CAST(w AS VARCHAR), 'L4', w, 'm:' || CAST(CAST(date_trunc('month', w) AS DATE) AS VARCHAR) FROM o WHERE day(w) % 7 <> 0
 UNION ALL SELECT DISTINCT 'm:' || CAST(mo AS VARCHAR), 'L5', mo, CAST(NULL AS VARCHAR) FROM o)""",
}


def sql(text: str, *views: str) -> str:
    """``text`` with the named views in front; ``text`` may go on with further ones after a comma."""
    return "WITH " + ",\n".join(SQL[v] for v in views) + ("" if text.lstrip().startswith(",") else "\n") + text
