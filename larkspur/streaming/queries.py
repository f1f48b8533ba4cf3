"""Structured Streaming forms: validated append, running counters, chat turns, the guard of open requests."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from larkspur.operators.ingest import Constraints, validate
from larkspur.operators.metrics import counts
from larkspur.operators.rules import RuleSet, classify
from larkspur.sources.storage import unused
from larkspur.streaming.stateful import first_of_key, in_flight, started


def json_stream(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def ingest_stream(requests: DataFrame, constraints: Constraints, order: str, table: str, rejects: str, checkpoint: str, stored: DataFrame | None = None) -> StreamingQuery:
    """Each micro-batch is validated, checked against all keys so far, and appended. Keys are kept in the stream's state, so a batch reads
    those that it brings and no stored row; keys of a table from before the stream are handed over as `stored`, once. A batch's files go to a folder
    named by its number and replace what an earlier, broken-off try of the same batch has left, so retries change nothing."""
    spark, key = requests.sparkSession, constraints.key
    checked = validate(requests, constraints)
    spark.createDataFrame([], requests.schema).write.mode("overwrite").parquet(f"{table}/batch=-1")  # so that there is a table
    if key:
        again = unused(checked.columns, "__again")
        good = first_of_key(checked.where("error is null"), key, order, stored, again)
        good = good.withColumn("error", F.when(F.col(again), F.lit(f"{key} exists"))).drop(again)
        checked = good.unionByName(checked.where(F.col("error").isNotNull() | F.col(key).isNull()))

    def one(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            batch.where("error is null").drop("error").write.mode("overwrite").parquet(f"{table}/batch={number}")
            batch.where("error is not null").write.mode("overwrite").parquet(f"{rejects}/batch={number}")
        finally:
            batch.unpersist()

    return started(spark, checked.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True))


def guard_stream(rows: DataFrame, owner: str, request: str, at: str, asks: str, timeout: datetime.timedelta, delay: str, table: str, checkpoint: str) -> StreamingQuery:
    """in_flight() as a table."""
    found = in_flight(rows, owner, request, at, asks, timeout, delay)
    return started(rows.sparkSession, found.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True))


def counters_stream(requests: DataFrame, conditions: dict[str, Column], name: str, checkpoint: str) -> StreamingQuery:
    """Running totals, whole after each micro-batch, as a table in memory: one row."""
    return requests.groupBy().agg(*counts(conditions)).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def chat_stream(messages: DataFrame, rules: RuleSet, branches: dict[str, Callable[[Column], Column]], text: str, table: str, checkpoint: str) -> StreamingQuery:
    """Each message is appended as the user's turn, and the reply of its label's branch as the model's."""

    def one(batch: DataFrame, number: int) -> None:
        label = classify(F.col(text), rules)
        reply = F.lit(None).cast("string")
        for name, branch in branches.items():
            reply = F.when(F.col("intent") == name, branch(F.col(text))).otherwise(reply)
        rows = batch.withColumn("intent", label)
        asked = rows.withColumn("role", F.lit("user"))
        told = rows.withColumn("role", F.lit("model")).withColumn(text, reply)
        asked.unionByName(told).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return messages.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
