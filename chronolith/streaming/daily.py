"""Daily sessions with state and timers: turns are kept until their day is over, then given as one session."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DAY = dt.timedelta(days=1)
OUT = "user string, day date, kind string, turns long, text string, week string, month string"
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _end_ms(day: dt.date) -> int:
    return int(dt.datetime.combine(day + DAY, dt.time(), dt.timezone.utc).timestamp() * 1000)


class DailySessions(StatefulProcessor):
    """Keeps the turns of a user's current day.

    A turn of a later day flushes them as one session, and so does a timer at the day's end when no turn follows.  A turn of an
    earlier day than the current one, or than the last one flushed, is late: it isn't added, but named with the week and the month that have to be
    built anew.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turns = handle.getListState("turns", "ts timestamp, text string")
        self.day = handle.getValueState("day", "day date, open boolean")

    def _row(self, user: str, day: dt.date, kind: str, turns: int, text: str) -> Row:
        year, week, _ = day.isocalendar()
        return Row(user=user, day=day, kind=kind, turns=turns, text=text, week=f"{year:04d}-W{week:02d}", month=f"{day:%Y-%m}")

    def _flush(self, user: str, day: dt.date) -> Iterator[Row]:
        kept = sorted((ts, text or "") for ts, text in self.turns.get())
        self.turns.clear()
        self.day.update((day, False))
        if kept:
            yield self._row(user, day, "session", len(kept), "\n".join(text for _, text in kept))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        (user,) = key
        for r in sorted(rows, key=lambda r: r.ts):
            day, (current, open_) = r.ts.date(), self.day.get() if self.day.exists() else (None, False)
            if current is not None and (day < current or day == current and not open_):
                yield self._row(user, day, "late", 1, r.text or "")
                continue
            if current is not None and open_ and day > current:
                self.handle.deleteTimer(_end_ms(current))
                yield from self._flush(user, current)
            if current is None or day > current:
                self.day.update((day, True))
                self.handle.registerTimer(_end_ms(day))
            self.turns.appendValue((r.ts, r.text))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        current, open_ = self.day.get() if self.day.exists() else (None, False)
        if open_ and _end_ms(current) <= expiredTimerInfo.getExpiryTimeInMs():
            yield from self._flush(key[0], current)

    def close(self) -> None:
        pass


def daily_sessions(stream: DataFrame, delay: str = "7 days") -> DataFrame:
    """Sessions and late turns of a stream (user, ts, text); turns are named late for up to ``delay``, behind which the stream drops them, and a day that nothing follows is closed so long after its end."""
    spark: SparkSession = stream.sparkSession
    spark.conf.set(*PROVIDER)
    rows = stream.withWatermark("ts", delay).select("user", "ts", "text")
    return rows.groupBy("user").transformWithState(DailySessions(), OUT, "append", "eventTime")
