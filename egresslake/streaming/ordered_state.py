"""Keyed state over streams whose rows come out of order: zone membership, stays, and line crossings.

Rows of a key wait in list state until the watermark has passed them; an event-time timer then hands them over in order of (time, step),
and a fold keeps what the next rows need in value state. So results are those of the batch operators
(operators/zones.py) for all rows that are not late, whatever the order of arrival, and a query that is killed goes on from its
checkpoint. Rows older than the watermark are dropped, which the batch operators never do.

State is kept in RocksDB (`state_store`), so a key's waiting rows need not fit in memory with those of other keys.
"""

from __future__ import annotations

import contextlib
import math
from collections.abc import Callable, Iterator, Sequence
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from egresslake.operators.trajectory import SLACK

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
Fold = Callable[[tuple | None, tuple], tuple[tuple, list[tuple]]]


@contextlib.contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """RocksDB as the store of state for queries started inside; the session's own setting comes back after."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


class InOrder(StatefulProcessor):
    """Calls fold(held, row) for a key's rows in order, once the watermark has passed them.

    A row is (milliseconds, step, ...); fold returns what is held next and the rows to give out, without the key.
    """

    def __init__(self, waiting: str, held: str, given: Sequence[str], fold: Fold) -> None:
        self.waiting_schema, self.held_schema, self.given, self.fold = waiting, held, list(given), fold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.waiting_schema)
        self.held = handle.getValueState("held", self.held_schema)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        new = [tuple(r)[len(key) :] for r in rows]
        self.waiting.appendList(new)
        at, timers = min(r[0] for r in new), list(self.handle.listTimers())
        if not timers or at < min(timers):
            for t in timers:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        rows = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: r[:2])
        ready = [r for r in rows if r[0] <= mark]
        rest = rows[len(ready) :]
        self.waiting.clear()
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(rest[0][0])  # the timer that fired is deleted after this
        held, out = (tuple(self.held.get()) if self.held.exists() else None), []
        for r in ready:
            held, given = self.fold(held, r)
            out += given
        if ready:
            self.held.update(held)
        named = Row(*self.given)
        return iter([named(*key, *x) for x in out])

    def close(self) -> None:
        pass


def in_order(stream: DataFrame, keys: Sequence[str], columns: Sequence[str], held: str, given: str, fold: Fold, delay: str) -> DataFrame:
    """Rows that fold gives out for each key. The stream has event_ts, step, the keys and columns; rows later than `delay` are dropped."""
    kept = stream.withWatermark("event_ts", delay).select(*keys, F.unix_millis("event_ts").alias("ms"), "step", *columns, "event_ts")
    kinds = {f.name: f.dataType.simpleString() for f in kept.schema}
    waiting = ", ".join(f"{c} {kinds[c]}" for c in ("ms", "step", *columns, "event_ts"))
    out = StructType.fromDDL(", ".join([*(f"{k} {kinds[k]}" for k in keys), given]))
    return kept.groupBy(*keys).transformWithState(InOrder(waiting, held, out.names, fold), out, "Append", "EventTime")


def membership(dt: float) -> Fold:
    """Fold of (ms, step, time_s, zone): enters and exits with the stay's length, floored at dt. Holds (zone, step of entry)."""

    def fold(held: tuple | None, row: tuple) -> tuple[tuple, list[tuple]]:
        zone, entry = held or (None, None)
        step, time_s, now = row[1], row[2], row[3]
        if now == zone:
            return (zone, entry), []
        out = []
        if zone is not None:
            out.append((step, time_s, zone, "exit", max((step - entry) * dt, dt)))
        if now is not None:
            out.append((step, time_s, now, "enter", None))
        return (now, step if now is not None else None), out

    return fold


def crossing(p1: tuple[float, float], p2: tuple[float, float]) -> Fold:
    """Fold of (ms, step, time_s, x, y): crossings of the line with their direction. Holds (side, place along the line)."""
    (ax, ay), (bx, by) = p1, p2
    length = math.hypot(bx - ax, by - ay)

    def fold(held: tuple | None, row: tuple) -> tuple[tuple, list[tuple]]:
        step, time_s, x, y = row[1:5]
        side = ((bx - ax) * (y - ay) - (by - ay) * (x - ax)) / length
        along = ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / length
        out = []
        if held is not None and held[0] * side < 0 and -SLACK <= (held[1] + along) / 2 <= length + SLACK:
            out.append((step, time_s, 1 if side > 0 else -1))
        return (side, along), out

    return fold


def zone_stream(stream: DataFrame, dt: float, keys: Sequence[str] = ("run_id", "agent_id"), zone: str = "zone_id", delay: str = "10 seconds") -> DataFrame:
    """operators.zones.zone_transitions of a stream."""
    rows = stream.withColumn("zone_id", F.col(zone).cast("string"))
    return in_order(rows, keys, ["time_s", "zone_id"], "zone string, entry long", "step long, time_s double, zone_id string, kind string, dwell_s double", membership(float(dt)), delay)


def line_stream(stream: DataFrame, p1: tuple[float, float], p2: tuple[float, float], keys: Sequence[str] = ("run_id", "agent_id"), delay: str = "10 seconds") -> DataFrame:
    """operators.zones.line_transitions of a stream."""
    return in_order(stream, keys, ["time_s", "x", "y"], "side double, along double", "step long, time_s double, direction int", crossing(p1, p2), delay)


def finished(stream: DataFrame, folder: str, name: str) -> DataFrame:
    """Runs a stream over what is there now, and the table it has written: rows of all its runs so far.

    folder is shared by the cluster; the checkpoint in it makes the next run go on where this one ended, or was killed.
    """
    with state_store(stream.sparkSession):
        query = stream.writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/{name}-checkpoint").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/{name}")
