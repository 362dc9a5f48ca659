"""Keyed state on streams: the newest rows of a key, and the first row of a key."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: state of these operators lives in RocksDB, on disk and in bounded memory; set it before the stream starts
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Newest(StatefulProcessor):
    """Holds the ``keep`` newest (place, item) of a key; a timer per key moves with its last event."""

    def __init__(self, keep: int, idle_ms: int):
        self.keep, self.idle_ms = keep, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "place long, item string")
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held, latest = {tuple(x) for x in self.held.get()} if self.held.exists() else set(), 0
        gone = []
        for row in rows:  # never more than keep + 1 of them at once
            held.add((row["place"], row["item"]))
            latest = max(latest, row["at"])
            if len(held) > self.keep:
                out = min(held)
                held.remove(out)
                gone.append(out)
        self.held.put(sorted(held))
        old = self.timer.get()[0] if self.timer.exists() else None
        new = max(latest + self.idle_ms, old or 0)
        if new != old:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(new)
            self.timer.update((new,))
        for place, item in gone:
            yield Row(key=key[0], place=place, item=item, state="evicted")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        for place, item in list(self.held.get()):
            yield Row(key=key[0], place=place, item=item, state="kept")
        self.held.clear()
        self.timer.clear()

    def close(self) -> None:
        pass


def newest_of_each(stream: DataFrame, key: str, place: str, item: str, time: str, keep: int, idle: str = "1 day", delay: str = "10 minutes") -> DataFrame:
    """(key, place, item, state): rows that ``keep`` newer ones (by ``place``, then ``item``) of their key have ``evicted``.

    A key without rows for ``idle`` (in event time) is forgotten; what it held
    comes out as ``kept``. Repeats of a held row change nothing. State is at most
    ``keep`` rows for each key that is not idle.
    """
    spark = stream.sparkSession
    idle_ms = spark.sql(f"SELECT CAST(unix_millis(timestamp_millis(0) + interval {idle}) AS BIGINT)").first()[0]
    rows = stream.withWatermark(time, delay).select(
        F.col(key).cast("string").alias("key"), F.col(place).cast("long").alias("place"), F.col(item).cast("string").alias("item"), F.unix_millis(time).alias("at"), time
    )
    return rows.groupBy("key").transformWithState(_Newest(keep, idle_ms), "key string, place long, item string, state string", "Append", "EventTime")


class _First(StatefulProcessor):
    """Lets the first row of a key through; the mark that it came expires."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "yes boolean", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if self.seen.exists():
            return
        first = min(rows, key=lambda r: (r["place"], r["row"]))
        self.seen.update((True,))
        yield Row(row=first["row"])

    def close(self) -> None:
        pass


def first_of_each(stream: DataFrame, key: str, place: str, ttl_ms: int) -> DataFrame:
    """The first row of each key, by ``place`` within a micro-batch, by arrival across them; keys are forgotten ``ttl_ms`` after their first row.

    Unlike a deduplication by watermark it needs no event time. State that
    expires by the clock keeps a query going, so start it with a trigger by
    time; one that takes what is there and stops would never end.
    """
    whole = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(place).cast("long").alias("place"), whole.alias("row"))
    firsts = rows.groupBy("key").transformWithState(_First(ttl_ms), "row string", "Append", "ProcessingTime")
    return firsts.select(F.from_json("row", stream.schema).alias("row")).select("row.*")
