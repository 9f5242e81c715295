"""Stateful walks over a live stream in event-time order, on typed state and event-time timers."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, floor
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
Values = tuple[Any, ...]


def on_rocksdb(spark: SparkSession) -> None:
    """Let streaming queries of the session keep state in RocksDB, on disk and in changes, unless the user has chosen a store.
    Typed states and timers need it."""
    if not spark.conf.get(PROVIDER, "").endswith("RocksDBStateStoreProvider"):
        spark.conf.set(PROVIDER, ROCKSDB)


class Merge:
    """How rows in order become records: a row joins the open record or closes it and opens its own.

    Rows and open records are tuples, the time in seconds of a row first. Pieces are values that are kept in a list beside
    the open record, so that a long record is not written anew for each row.
    """
    fields = ""  # of a row, as a schema; the first is the time
    record = ""  # of an open record
    piece = ""  # of a piece, none if empty
    output = ""  # of a result, after the keys

    def opened(self, row: Values) -> Values:
        raise NotImplementedError

    def joins(self, record: Values, row: Values) -> bool:
        raise NotImplementedError

    def joined(self, record: Values, row: Values) -> Values:
        raise NotImplementedError

    def piece_of(self, row: Values) -> Values | None:
        return None

    def result(self, record: Values, pieces: list[Values]) -> Values:
        raise NotImplementedError

    def closes(self, record: Values) -> float:
        """No row later than this joins the record."""
        raise NotImplementedError


def _names(schema: str) -> list[str]:
    return [part.strip().split(" ")[0] for part in schema.split(",") if part.strip()]


def in_order(row: Values) -> list[tuple[bool, Any]]:
    """Sort key of a row; nulls last."""
    return [(v is None, 0 if v is None else v) for v in row]


def _ripe_at(at: float) -> int:
    """The timer, in milliseconds, that runs out once the watermark has reached `at`: timers run out below it."""
    return ceil(at * 1000) - 1


class OrderedWalk(StatefulProcessor):
    """Feeds the rows of a key to a `Merge` in order of time, then of the other fields, once the watermark has passed them.

    State of a key: `waiting`, the rows that came, appended and not rewritten; `upto`, the watermark up to which they are
    done; `record`, the open record; `pieces`, its list. Rows that are done leave `waiting` when they are half of it, so each row is
    rewritten once on average. A timer stands at the next row that waits and at the time at which the record closes, so keys without
    news are not visited.
    """

    def __init__(self, keys: list[str], merge: Merge):
        self.keys, self.merge = keys, merge
        self.names = keys + _names(merge.output)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.merge.fields)
        self.upto = handle.getValueState("upto", "mark long")
        self.record = handle.getValueState("record", self.merge.record)
        self.pieces = handle.getListState("pieces", self.merge.piece) if self.merge.piece else None

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        fields = _names(self.merge.fields)
        fresh = [tuple(row[f] for f in fields) for row in rows]
        if fresh:
            self.waiting.appendList(fresh)
            self.handle.registerTimer(_ripe_at(min(r[0] for r in fresh)))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        before = self.upto.get()[0] if self.upto.exists() else float("-inf")
        if mark <= before:
            return  # several timers of a key ran out at once
        rows = list(self.waiting.get())
        ripe = sorted((r for r in rows if before < r[0] * 1000 <= mark), key=in_order)
        later = [r for r in rows if r[0] * 1000 > mark]
        record, results = self._fold(ripe, mark)
        if not later and record is None:
            for state in (self.waiting, self.upto, self.record):
                state.clear()
        else:
            if 2 * len(later) <= len(rows):
                self.waiting.put(later) if later else self.waiting.clear()
            self.upto.update((mark,))
            if later:
                self.handle.registerTimer(_ripe_at(min(r[0] for r in later)))
            if record is not None:
                self.handle.registerTimer(max(floor(self.merge.closes(record) * 1000), mark))
        for values in results:
            yield Row(**dict(zip(self.names, (*key, *values))))

    def _fold(self, ripe: list[Values], mark: int) -> tuple[Values | None, list[Values]]:
        """The open record after these rows and the results of the closed ones. States are written once."""
        merge, results = self.merge, []
        old = record = self.record.get() if self.record.exists() else None
        fresh: list[Values] = []  # pieces that the state does not have yet
        stored = record is not None  # does the state hold pieces of the record?

        def close() -> Values:
            held = list(self.pieces.get()) if self.pieces is not None and stored else []
            return merge.result(record, held + fresh)
        for row in ripe:
            if record is not None and merge.joins(record, row):
                record = merge.joined(record, row)
            else:
                if record is not None:
                    results.append(close())
                record, fresh, stored = merge.opened(row), [], False
            if self.pieces is not None:
                fresh.append(merge.piece_of(row))
        if record is not None and merge.closes(record) * 1000 < mark:
            results.append(close())
            record, fresh, stored = None, [], False
        if record is None:
            if old is not None:
                self.record.clear()
        elif record != old:
            self.record.update(record)
        if self.pieces is not None:
            if not stored and old is not None:
                self.pieces.clear()
            if fresh:
                self.pieces.appendList(fresh)
        return record, results

class FirstTime(StatefulProcessor):
    """The least time of a key, once the watermark has passed it. The key is remembered for `life` seconds more; a later time counts
    as a first one again.

    State: the time and whether it is out, and the times that lie beyond its life."""

    def __init__(self, keys: list[str], life: float):
        self.keys, self.life = keys, life

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "at double, out boolean")
        self.later = handle.getListState("later", "at double")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        times = [row["at"] for row in rows]
        if not times:
            return iter(())
        held = self.first.get() if self.first.exists() else None
        at, out = held or (min(times), False)
        if not out and min(times) < at:
            self.handle.deleteTimer(_ripe_at(at))
            at = min(times)
        if (at, out) != held:
            self.first.update((at, out))
            self.handle.registerTimer(_ripe_at(at))
        beyond = [(t,) for t in times if t > at + self.life]
        if beyond:
            self.later.appendList(beyond)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        if not self.first.exists():
            return
        mark = timerValues.getCurrentWatermarkInMs()
        at, out = self.first.get()
        while at * 1000 <= mark:
            if not out:
                out = True
                yield Row(**dict(zip([*self.keys, "at"], (*key, at))))
            if floor((at + self.life) * 1000) >= mark:
                break
            times = [t for t, in self.later.get()]
            if not times:
                self.first.clear()
                return
            at, out = min(times), False
            rest = [(t,) for t in times if t > at + self.life]
            self.later.put(rest) if rest else self.later.clear()
        self.first.update((at, out))
        self.handle.registerTimer(floor((at + self.life) * 1000) if out else _ripe_at(at))


def timed(stream: DataFrame) -> DataFrame:
    """Rows with a time; only they can be put in order."""
    return stream.filter(F.col("ts").isNotNull() & F.col("at").isNotNull() & ~F.isnan("at"))


def untimed(stream: DataFrame) -> DataFrame:
    """The rows that live jobs leave out because they have no time, with the reason; to be written where rejects go."""
    no_time = F.col("ts").isNull() | F.col("at").isNull() | F.isnan("at")
    return stream.filter(F.coalesce(no_time, F.lit(True))).withColumn("reason", F.lit("no time"))


def walk(stream: DataFrame, *, keys: list[str], delay: str, key_schema: str, merge: Merge) -> DataFrame:
    """The results of `merge` over the rows of each key in event-time order; rows may be late by `delay`.

    The stream has the columns `ts`, its time stamp, and those of `merge.fields`, whose first, `at`, is the same time in seconds
    since the epoch. Rows without a time are left out (`untimed`). State is in RocksDB and survives a restart from the
    checkpoint of the query.
    """
    on_rocksdb(stream.sparkSession)
    rows = timed(stream).withWatermark("ts", delay)
    return rows.groupBy(*keys).transformWithState(OrderedWalk(keys, merge), f"{key_schema}, {merge.output}", "Append", "EventTime")


def first_times(stream: DataFrame, *, keys: list[str], delay: str, key_schema: str, life: float) -> DataFrame:
    """(keys, at): the first time of every key, as `FirstTime` keeps it."""
    on_rocksdb(stream.sparkSession)
    rows = timed(stream).withWatermark("ts", delay)
    return rows.groupBy(*keys).transformWithState(FirstTime(keys, life), f"{key_schema}, at double", "Append", "EventTime")
