"""The store's public verbs, each a DataFrame (or a plan's figures) instead of text.

``MemoryStore`` holds DataFrames, not connections: memories, chunks and summaries.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import vectors
from .functions.dates import week_start
from .operators import timeline


@dataclass(frozen=True)
class MemoryStore:
    memories: DataFrame
    chunks: DataFrame
    summaries: DataFrame

    def search_memories(self, entity=None, speaker=None, start_date=None, end_date=None, type=None, limit: int = 50) -> DataFrame:
        """Matching rows with ``truncated``; see ``unknown_names`` where there are none."""
        if not 1 <= limit <= 200:
            raise ValueError("limit is from 1 to 200")
        rows = timeline.filtered(self.memories, entity=entity, speaker=speaker, start=start_date, end=end_date, type=type)
        return timeline.limit_plus_one(rows, limit, "source_date", "id")

    def unknown_names(self, names: DataFrame, column: str) -> DataFrame:
        """Requested names (name) that no row has in ``column``."""
        held = self.memories.select(F.col(column).alias("name")).distinct()
        return names.select(F.lower(F.trim("name")).alias("name")).distinct().join(held, "name", "left_anti")

    def list_entities(self) -> DataFrame:
        return self.memories.where("entity <> ''").select("entity").distinct().orderBy("entity")

    def list_speakers(self) -> DataFrame:
        return self.memories.where("speaker <> ''").select("speaker").distinct().orderBy("speaker")

    def read_conversations_on(self, date: str, days_around: int = 0) -> DataFrame:
        return timeline.day_window(self.chunks, date, days_around).orderBy("date", "id")

    def semantic_search_conversations(self, query: list[float], k: int = 5) -> DataFrame:
        if not 1 <= k <= 20:
            raise ValueError("k is from 1 to 20")
        q = F.array(*[F.lit(float(x)) for x in query])
        return self.chunks.withColumn("distance", vectors.l2(F.col("embedding"), q)).orderBy("distance", "id").limit(k)

    def get_summary(self, level: str, period: str | None = None, speaker: str | None = None) -> DataFrame:
        parts = [level] + ([period] if period else []) + ([speaker] if speaker else [])
        return self.summaries.where(F.col("identifier") == ":".join(parts))

    def search_summaries_by_layer(self, query: list[float], counts: dict[str, int]) -> DataFrame:
        """The nearest summaries of each level, as many as ``counts`` says, by one distance pass."""
        q = F.array(*[F.lit(float(x)) for x in query])
        rows = self.summaries.withColumn("level", F.split_part("identifier", F.lit(":"), F.lit(1))).withColumn("distance", vectors.l2(F.col("embedding"), q))
        k = F.lit(0)
        for level, n in counts.items():
            k = F.when(F.col("level") == level, n).otherwise(k)
        return timeline.top_k_per(rows, ["level"], k, "distance", "identifier")

    def ingest(self, records: DataFrame) -> tuple["MemoryStore", DataFrame]:
        """(the store with the new rows, these): repeats within the batch and of stored rows are left out."""
        key = [F.col("entity"), F.lower("content"), F.col("source_date"), F.col("speaker")]
        fresh = timeline.not_stored(timeline.dedupe_batch(records, key, "id"), self.memories)
        return MemoryStore(self.memories.unionByName(fresh), self.chunks, self.summaries), fresh

    def affected_periods(self, fresh: DataFrame) -> DataFrame:
        """The weeks and months that new rows touch; a week that reaches into a second month touches both."""
        week = week_start(F.col("source_date"))
        month = lambda c: F.date_format(c, "yyyy-MM")
        return fresh.select(F.concat(F.lit("week:"), week.cast("string")).alias("period"), F.concat(F.lit("month:"), month(week)).alias("a"), F.concat(F.lit("month:"), month(F.date_add(week, 6))).alias("b")).select(F.explode(F.array("period", "a", "b")).alias("period")).distinct()

    def stats(self) -> DataFrame:
        return self.memories.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.min("source_date").alias("first"), F.max("source_date").alias("last")).orderBy(F.desc("n"), "entity")
