"""A data source of append-only JSON-lines logs: ``spark.read.format("record_log")`` and ``write``.

A log is a folder of ``*.jsonl`` files, or one file, in a folder that the driver and the executors share.  Each file is read by a task of its
own, line by line.  A last line without its line feed that isn't JSON was torn by a writer that was stopped and is left out; a
malformed line before it, or an id that comes twice in a file, is an error of the log and stops the read.  (Ids that
repeat over files are found by ``loaders.read_log``, which shuffles them.)

Each task of a write fills a hidden file; when all have ended, the files are renamed into the log, and if one fails, all of them
are removed, so that a log never shows a part of a write.
"""

from __future__ import annotations

import glob
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType


@dataclass
class LogFile(InputPartition):
    path: str


@dataclass
class Written(WriterCommitMessage):
    path: str
    rows: int


def _local(path: str) -> str:
    return path.removeprefix("file://")


def records(path: str, key: str) -> Iterator[dict]:
    """The records of one file."""
    seen = set()
    with open(path, "rb") as f:
        for number, line in enumerate(f, 1):
            if not line.strip():
                continue
            try:
                record = json.loads(line)
            except ValueError:
                if not line.endswith(b"\n"):
                    return  # torn
                raise ValueError(f"line {number} of {path} is malformed") from None
            if record[key] in seen:
                raise ValueError(f"id {record[key]!r} comes twice in {path}")
            seen.add(record[key])
            yield record


class LogReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names, self.path, self.key = schema.names, _local(options["path"]), options.get("key", "id")

    def partitions(self) -> list[LogFile]:
        files = sorted(glob.glob(f"{glob.escape(self.path)}/*.jsonl")) if os.path.isdir(self.path) else [self.path]
        return [LogFile(f) for f in files]

    def read(self, partition: LogFile) -> Iterator[tuple]:
        for record in records(partition.path, self.key) if partition is not None else ():
            yield tuple(record.get(n) for n in self.names)


class LogWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.run = _local(options["path"]), overwrite, uuid.uuid4().hex

    def write(self, rows) -> Written:
        os.makedirs(self.path, exist_ok=True)
        name, count = f"{self.path}/.{self.run}-{uuid.uuid4().hex}", 0
        with open(name, "w", encoding="utf-8") as f:
            for row in rows:
                f.write(json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str) + "\n")
                count += 1
            f.flush()
            os.fsync(f.fileno())
        return Written(name, count)

    def commit(self, messages: list[Written | None]) -> None:
        old = glob.glob(f"{glob.escape(self.path)}/*.jsonl") if self.overwrite else []
        kept = {m.path for m in messages if m is not None and m.rows}
        for i, name in enumerate(sorted(kept)):
            os.replace(name, f"{self.path}/part-{self.run}-{i:05d}.jsonl")
        for name in old:
            os.remove(name)
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        """Removes what this write left behind, of tasks that failed or ran twice, too."""
        for name in glob.glob(f"{glob.escape(self.path)}/.{self.run}-*"):
            os.remove(name)


class RecordLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "record_log"

    def schema(self):
        raise ValueError("name the log's schema")

    def reader(self, schema: StructType) -> LogReader:
        return LogReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> LogWriter:
        return LogWriter(self.options, overwrite)


def register(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(RecordLog)
    return spark
