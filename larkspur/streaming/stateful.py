"""Streams that remember: one open request an owner, and the first row of each key.

Both keep their state by key in the stream's own store (RocksDB, checkpointed to the shared folder), so a batch reads the state of its
own keys and nothing that is stored. Rows of one key that come in one batch meet in one task; how many that can be is bounded by what
the source hands to a batch (its trigger options)."""

from __future__ import annotations

import datetime
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

#: The store that keeps state by column family, as the processors need it.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: What becomes of a request.
ACCEPTED, REFUSED, ANSWERED, TIMED_OUT = "accepted", "refused", "answered", "timed out"


def started(spark: SparkSession, writer: DataStreamWriter) -> StreamingQuery:
    """Starts a query with the store set for it alone: a query keeps the settings that it was started with."""
    before = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)
    try:
        return writer.start()
    finally:
        spark.conf.set(STORE[0], before) if before else spark.conf.unset(STORE[0])


class _Guard(StatefulProcessor):
    """State of an owner: the open request, and when it was made. A timer ends it."""

    def __init__(self, timeout: datetime.timedelta, fields: list[str]) -> None:
        self.timeout, self.fields = timeout // datetime.timedelta(microseconds=1), fields

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", StructType([StructField("id", LongType()), StructField("us", LongType())]))

    def _due(self, us: int) -> int:
        """When a request made then has timed out, in epoch milliseconds."""
        return -(-(us + self.timeout) // 1000)

    def _said(self, key: tuple, what: tuple, state: str) -> Row:
        return Row(**dict(zip(self.fields, (key[0], what[0], what[1], state), strict=True)))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        held = tuple(self.open.get()) if self.open.exists() else None
        before = held
        for row in sorted(rows, key=lambda r: (r["us"], r["id"], r["asks"])):
            if held and row["us"] >= held[1] + self.timeout:
                yield self._said(key, held, TIMED_OUT)
                held = None
            if not row["asks"]:
                if held:
                    yield self._said(key, held, ANSWERED)
                held = None
            elif held:
                yield self._said(key, (row["id"], row["us"]), REFUSED)
            else:
                held = (row["id"], row["us"])
                yield self._said(key, held, ACCEPTED)
        if held == before:
            return
        if before:
            self.handle.deleteTimer(self._due(before[1]))
        if held:
            self.open.update((held[0], held[1]))
            self.handle.registerTimer(self._due(held[1]))
        else:
            self.open.clear()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        if self.open.exists():
            held = self.open.get()
            self.open.clear()
            yield self._said(key, held, TIMED_OUT)

    def close(self) -> None:
        pass


def in_flight(rows: DataFrame, owner: str, request: str, at: str, asks: str, timeout: datetime.timedelta, delay: str) -> DataFrame:
    """What becomes of requests where an owner may have one open at a time: (owner, request, at, state), a row for each change.

    rows: a stream of requests (`asks` true) and answers (false), `at` a timestamp, `request` a whole number. A request is accepted if its owner
    has none open, refused otherwise. An answer closes the open request; one that has been open for `timeout` is timed out by the next
    row of its owner or, without one, by a timer when the watermark (the latest time less `delay`) has passed. Rows of a batch are taken in
    the order of their times (ties: by number, answers first); rows older than the watermark are left out, as in any stream with one. Rows
    without owner, time or number are no requests, and nothing is told of them; without `asks` they count as answers."""
    kinds = rows.select(owner).schema.fields[0].dataType
    asked = rows.where(F.col(owner).isNotNull() & F.col(at).isNotNull() & F.col(request).isNotNull()).select(F.col(owner).alias("owner"), F.col(request).cast("long").alias("id"), F.col(at).cast("timestamp").alias("at"), F.coalesce(F.col(asks), F.lit(False)).alias("asks"))
    if len({n.lower() for n in (owner, request, at, "state")}) < 4:
        raise ValueError("the columns for owner, request and time have to differ, and none can be named state")
    shape = StructType([StructField("owner", kinds), StructField("id", LongType()), StructField("us", LongType()), StructField("state", StringType())])
    found = asked.withColumn("us", F.unix_micros("at")).withWatermark("at", delay).groupBy("owner").transformWithState(_Guard(timeout, shape.names), shape, "Append", "EventTime")
    return found.select(F.col("owner").alias(owner), F.col("id").alias(request), F.timestamp_micros("us").alias(at), "state")


class _First(StatefulProcessor):
    """State of a key: that it is taken."""

    def __init__(self, order: str, flag: str) -> None:
        self.order, self.flag = order, flag

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.taken = handle.getValueState("taken", StructType([StructField("taken", BooleanType())]))

    def _rank(self, row: Row) -> tuple:
        """Least order first, nulls last; rows that tie by all their columns."""
        return row[self.order] is None, row[self.order], tuple((v is not None, v if isinstance(v, (int, float, str, datetime.datetime, datetime.date)) else repr(v)) for v in row)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        said = lambda row, again: Row(**row.asDict(), **{self.flag: again})
        taken = self.taken.exists()
        first = None
        for row in rows:  # one row is held, however many come
            if taken:
                yield said(row, True)
            elif first is None:
                first = row
            elif self._rank(row) < self._rank(first):
                yield said(first, True)
                first = row
            else:
                yield said(row, True)
        if first is not None:
            self.taken.update((True,))
            yield said(first, False)

    def handleInitialState(self, key: tuple, initialState, timerValues) -> None:  # noqa: N802, N803
        self.taken.update((True,))

    def close(self) -> None:
        pass


def first_of_key(rows: DataFrame, key: str, order: str, stored: DataFrame | None = None, flag: str = "duplicate") -> DataFrame:
    """A stream's rows with a column that tells whether their key was taken already: by an earlier batch, by a row of this batch that comes first
    by `order` (nulls last; ties by all columns), or by `stored` rows, which are read once, when the stream first starts. Rows with a null
    key clash with none and are left out here; the caller adds them."""
    if flag.lower() in {n.lower() for n in rows.columns}:
        raise ValueError(f"there is a column {flag} already; give another name for the result")
    shape = StructType([*rows.schema.fields, StructField(flag, BooleanType())])
    before = None if stored is None else stored.where(F.col(key).isNotNull()).select(F.col(key)).distinct().groupBy(key)
    return rows.where(F.col(key).isNotNull()).groupBy(key).transformWithState(_First(order, flag), shape, "Append", "None", before)


__all__ = ["ACCEPTED", "ANSWERED", "REFUSED", "TIMED_OUT", "first_of_key", "in_flight", "started"]
