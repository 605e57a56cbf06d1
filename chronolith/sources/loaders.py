"""Readers and writers of the model's files and stores, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MEMORY = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("content", T.StringType()), T.StructField("entity", T.StringType()), T.StructField("type", T.StringType()), T.StructField("speaker", T.StringType()), T.StructField("source_date", T.DateType())]
)
TURN = "speaker string, text string"


def create_store(spark: SparkSession, name: str) -> None:
    """A parquet table of memories if there is none; a column ``type`` is added to an older one."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in MEMORY)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({fields}) USING parquet")
    if "type" not in spark.table(name).columns:
        spark.sql(f"ALTER TABLE {name} ADD COLUMNS (type string)")


def cleaned_records(records: DataFrame, source_date: str, speaker: str = "user") -> DataFrame:
    """Records as they are stored: names lowered and stripped, missing type, speaker and date filled."""
    name = lambda c: F.lower(F.trim(c))
    filled = lambda c, v: F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit(v))
    return records.select(
        "content", name(F.col("entity")).alias("entity"), filled("type", "preference").alias("type"), name(filled("speaker", speaker)).alias("speaker"), F.coalesce(F.to_date(F.nullif(F.col("date"), F.lit(""))), F.lit(source_date).cast("date")).alias("source_date")
    )


def append(rows: DataFrame, path: str, by_month: str | None = None) -> None:
    if by_month:
        rows.withColumn("month", F.date_format(by_month, "yyyy-MM")).write.mode("append").partitionBy("month").parquet(path)
    else:
        rows.write.mode("append").parquet(path)


def without_ids(store: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """The store's rows whose id isn't to be deleted."""
    return store.join(ids.select(F.col(id_col).alias("_gone")).distinct(), F.col(id_col) == F.col("_gone"), "left_anti")


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """``old`` with ``new``'s rows in place of those of equal keys; the last by ``order`` wins in ``new``."""
    if order:
        w = Window.partitionBy(*keys).orderBy(F.desc(order))
        new = new.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def renamed_entities(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Entities replaced by a map (old, new)."""
    m = mapping.select(F.col("old").alias("_old"), F.col("new").alias("_new"))
    return rows.join(m, F.col("entity") == F.col("_old"), "left").withColumn("entity", F.coalesce("_new", "entity")).drop("_old", "_new")


def read_day_sessions(spark: SparkSession, path: str) -> DataFrame:
    """(user_id, date, position, speaker, text) of JSON files {user_id, sessions: {date: {turns: [...]}}}."""
    schema = f"user_id string, name string, sessions map<string, struct<day:int, date:string, weekday:string, turns:array<struct<{TURN.replace(' string', ':string')}>>>>"
    raw = spark.read.schema(schema).json(path, multiLine=True)
    days = raw.select("user_id", F.explode("sessions").alias("key", "s"))
    return days.select("user_id", F.to_date("key").alias("date"), F.posexplode("s.turns").alias("position", "t")).select("user_id", "date", "position", "t.speaker", "t.text")


def numbered_sessions(conversations: DataFrame, json_col: str) -> DataFrame:
    """(session, date_text, position, speaker, text) of JSON objects with keys session_1, session_1_date_time, ...

    A turn's image caption stands behind its text in brackets.
    """
    raw = F.from_json(json_col, "map<string,string>")
    entries = conversations.select(raw.alias("m")).select("m", F.explode("m").alias("key", "value"))
    found = entries.where(F.col("key").rlike(r"^session_\d+$")).withColumn("session", F.regexp_extract("key", r"(\d+)", 1).cast("int"))
    turn = f"array<struct<dia_id:string,{TURN.replace(' string', ':string')},blip_caption:string>>"
    t = found.select("session", F.element_at("m", F.concat("key", F.lit("_date_time"))).alias("date_text"), F.posexplode(F.from_json("value", turn)).alias("position", "t"))
    caption = F.when(F.col("t.blip_caption").isNotNull(), F.concat(F.lit(" ["), F.col("t.blip_caption"), F.lit("]"))).otherwise("")
    return t.select("session", "date_text", "position", "t.speaker", F.concat(F.coalesce("t.text", F.lit("")), caption).alias("text"))


def zipped_sessions(entries: DataFrame) -> DataFrame:
    """(question_id, session_id, date, turns) of entries with three parallel arrays, in the order of dates."""
    z = F.arrays_zip("haystack_session_ids", "haystack_dates", "haystack_sessions")
    s = entries.select("question_id", F.explode(z).alias("s"))
    return s.select("question_id", F.col("s.haystack_session_ids").alias("session_id"), F.col("s.haystack_dates").alias("date"), F.col("s.haystack_sessions").alias("turns")).orderBy("question_id", "date", "session_id")


def violations(questions: DataFrame, start: Column, end: Column) -> DataFrame:
    """Rows that break the timeline's rules, with the rule: a repeated id, or a date out of range."""
    twice = questions.groupBy("id").count().where("count > 1").select("id", F.lit("repeated id").alias("rule"))
    late = questions.where(~F.col("asked_on").between(start, end) | F.col("asked_on").isNull()).select("id", F.lit("date out of range").alias("rule"))
    return twice.unionByName(late)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def read_log(spark: SparkSession, path: str, schema: str, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(good rows, lines that are torn, malformed or repeat a key) of a JSON-lines log.

    Only a file's last line can be torn, by a writer that was stopped; a malformed line before it is an error of the log.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    lines = lines.withColumn("row", F.from_json("value", schema))
    place = F.struct("_block", "_at")
    last = lines.groupBy("_file").agg(F.max(place).alias("_last"))
    bad = lines.where(F.col(f"row.{key}").isNull()).join(F.broadcast(last), "_file")  # last: a row for each file
    why = F.when(place == F.col("_last"), "torn").otherwise("malformed")
    good = lines.where(F.col(f"row.{key}").isNotNull()).select("row.*", "value")
    counted = good.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    rejected = bad.select("value", why.alias("why")).unionByName(counted.where("_n > 1").select("value", F.lit("repeated").alias("why")))
    return counted.where("_n = 1").drop("_n", "value"), rejected


def write_rows(rows: DataFrame, path: str, kind: str = "json", mode: str = "error") -> None:
    """JSON lines, CSV with a header, or parquet, by the writer's commit protocol."""
    w = rows.write.mode(mode)
    w.csv(path, header=True) if kind == "csv" else w.format(kind).save(path)


def grouped_items(items: DataFrame) -> DataFrame:
    """Items by category, in the order of their ids."""
    return items.groupBy("category").agg(F.array_sort(F.collect_list(F.struct("item_id", "title"))).alias("items"))


def summary_dump(summaries: DataFrame) -> DataFrame:
    """Summaries with their level, by identifier."""
    return summaries.withColumn("level", F.split_part("identifier", F.lit(":"), F.lit(1))).orderBy("identifier")


def stores_by_age(paths: DataFrame) -> DataFrame:
    """Store paths (path, modified), newest first and legacy ones last."""
    return paths.orderBy(F.col("path").contains("legacy"), F.desc("modified"), "path")


def memory_bank(raw: DataFrame) -> DataFrame:
    """(user, date, position, query, response, strength, last_recall) of user -> history map -> dialogs."""
    days = raw.select("user", F.explode("history").alias("date", "dialogs"))
    return days.select("user", "date", F.posexplode("dialogs").alias("position", "d")).select("user", "date", "position", "d.*")


def read_activity_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True)


def add_states(batch: DataFrame, store: DataFrame, key: str, payload: str) -> DataFrame:
    """Whether each key of a batch is new, known, or in conflict with the payload that the store holds."""
    held = store.select(key, F.sha2(payload, 256).alias("_h")).distinct()
    state = F.when(F.col("_h").isNull(), "new").when(F.col("_h") == F.sha2(payload, 256), "known").otherwise("conflict")
    return batch.join(held, key, "left").select(key, state.alias("state"))
