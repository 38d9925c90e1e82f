"""Streams whose keys have a state: leases of tasks, and budgets of calls, folded in the order of event time.

Rows that have come are kept in the state until the watermark passes them, then applied in order of their time and number;
so however rows are split into batches, and whatever comes late within the watermark's delay, the result is that of folding
all rows at once. State and kept rows are checkpointed; a restarted query goes on where it was. Rows behind the watermark are
dropped, as Spark counts them. The state store must be RocksDB (settings()).
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, DataType, IntegerType, LongType, StringType, StructField, StructType, TimestampType


MOMENT = timedelta(milliseconds=1)


def _struct(**fields: type[DataType]) -> StructType:
    return StructType([StructField(name, kind()) for name, kind in fields.items()])


EVENT = _struct(at=TimestampType, number=LongType, kind=StringType, retryable=BooleanType)
LEASE = _struct(status=StringType, attempt=IntegerType, max_attempts=IntegerType, available_at=TimestampType, lease_expires_at=TimestampType, interruptions=IntegerType)
LEASE_OUT = "task_id long, number long, at timestamp, kind string, accepted boolean, status string, attempt int, lease_expires_at timestamp, interruptions int"
BUDGET_OUT = "event_id long, evaluation_id long, calls_before long, allowed boolean"


def settings(spark: SparkSession) -> None:
    """What a session needs for streams with state; to be set before the stream is started."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def millis(at: datetime) -> int:
    """As Spark counts event time; times without a zone are those of the process, as in rows."""
    return int((at if at.tzinfo else at.astimezone(timezone.utc)).timestamp() * 1000)


def lease_step(state: tuple | None, kind: str, at: datetime, retryable: bool | None, lease: timedelta, attempts: int) -> tuple[tuple, bool]:
    """(state afterwards, whether the event was accepted) of one task; state as LEASE, None before the first event.

    CREATE makes a pending task, once. CLAIM takes it if attempts are left and it is pending and due, or its lease has run out:
    the interrupted stages of the former worker are counted. COMPLETE and FAIL end a running task; a failure that may be tried
    again makes it pending while attempts are left. EXPIRE is the lease's own timer: a task with attempts left is pending again
    and due, one on its last attempt stays as it is.
    """
    if state is None:
        return ("PENDING", 0, attempts, at, None, 0), kind == "CREATE"
    status, attempt, most, due, until, interrupted = state
    if kind == "CLAIM" and attempt < most and ((status == "PENDING" and due <= at) or (status == "RUNNING" and until < at)):
        return ("RUNNING", attempt + 1, most, due, at + lease, interrupted + (status == "RUNNING")), True
    if kind == "COMPLETE" and status == "RUNNING":
        return ("COMPLETED", attempt, most, due, None, interrupted), True
    if kind == "FAIL" and status == "RUNNING":
        again = bool(retryable) and attempt < most
        return ("PENDING" if again else "FAILED", attempt, most, at if again else due, None, interrupted), True
    if kind == "EXPIRE" and status == "RUNNING" and until < at and attempt < most:
        return ("PENDING", attempt, most, at, None, interrupted + 1), True
    return state, False


class Ordered(StatefulProcessor):
    """Keeps rows until the watermark has passed them, then folds them in order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getListState("kept", EVENT)
        self.state = handle.getValueState("state", self.state_schema)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [(r.at, r.number, r.kind, r.retryable) for r in rows]
        self.kept.appendList(new)
        for at in {millis(r[0]) for r in new}:
            self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        kept = list(self.kept.get()) if self.kept.exists() else []
        due = sorted((tuple(r) for r in kept if millis(r[0]) <= now), key=lambda r: (r[0], r[1]))
        if due:
            rest = [tuple(r) for r in kept if millis(r[0]) > now]
            self.kept.put(rest) if rest else self.kept.clear()
        out = [x for row in due for x in self.apply(key, *row)] + list(self.tick(key, now))
        return iter(out)

    def tick(self, key, now: int) -> Iterator[Row]:
        return iter(())

    def close(self) -> None:
        pass


class Leases(Ordered):
    state_schema = LEASE

    def __init__(self, lease_seconds: int, attempts: int):
        self.lease, self.attempts = timedelta(seconds=lease_seconds), attempts

    def _next(self, key, at, number, kind, retryable) -> Row | None:
        before = tuple(self.state.get()) if self.state.exists() else None
        after, accepted = lease_step(before, kind, at, retryable, self.lease, self.attempts)
        if kind == "EXPIRE" and not accepted:
            return None
        self.state.update(after)
        if accepted and kind == "CLAIM":
            self.handle.registerTimer(millis(after[4]) + 1)  # the lease has run out once it lies before
        return Row(task_id=key[0], number=number, at=at, kind=kind, accepted=accepted, status=after[0], attempt=after[1], lease_expires_at=after[4], interruptions=after[5])

    def _run_out(self, key, before: datetime) -> Iterator[Row]:
        """The lease, if it ran out before this time; however late that is noticed, it was a moment after its end."""
        if self.state.exists() and (until := self.state.get()[4]) is not None and until + MOMENT < before:
            if (row := self._next(key, until + MOMENT, None, "EXPIRE", None)) is not None:
                yield row

    def apply(self, key, at, number, kind, retryable) -> Iterator[Row]:
        yield from self._run_out(key, at)
        yield self._next(key, at, number, kind, retryable)

    def tick(self, key, now: int) -> Iterator[Row]:
        if self.state.exists() and (until := self.state.get()[4]) is not None:
            yield from self._run_out(key, until + timedelta(milliseconds=now + 1 - millis(until)))


class Budget(Ordered):
    state_schema = _struct(calls=LongType)

    def __init__(self, budget: int):
        self.budget = budget

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.state.update((initialState.calls,))

    def apply(self, key, at, number, kind, retryable) -> Iterator[Row]:
        before = self.state.get()[0] if self.state.exists() else 0
        self.state.update((before + 1,))
        yield Row(event_id=number, evaluation_id=key[0], calls_before=before, allowed=before < self.budget)


def leased(events: DataFrame, lease_seconds: int, attempts: int, delay: str) -> DataFrame:
    """events (task_id, number, at, kind, retryable), a stream -> a row for each event, and for each lease that ran out with attempts left."""
    rows = events.select("task_id", "at", "number", "kind", "retryable").withWatermark("at", delay)
    return rows.groupBy("task_id").transformWithState(Leases(lease_seconds, attempts), LEASE_OUT, "Append", "EventTime")


def budgeted(calls: DataFrame, budget: int, delay: str, stored: DataFrame | None = None) -> DataFrame:
    """calls (event_id, evaluation_id, ts), a stream -> each with the calls of its evaluation before it, and whether the budget allows it.

    stored (evaluation_id, calls: long) are counts from before the stream, a batch frame; they hold from its first start.
    """
    rows = calls.selectExpr("evaluation_id", "ts AS at", "event_id AS number", "CAST(NULL AS STRING) AS kind", "CAST(NULL AS BOOLEAN) AS retryable").withWatermark("at", delay)
    initial = stored.select("evaluation_id", "calls").groupBy("evaluation_id") if stored is not None else None
    return rows.groupBy("evaluation_id").transformWithState(Budget(budget), BUDGET_OUT, "Append", "EventTime", initial)
