"""Sessions of a stream, and a table of the rows that came too late for them.

A stream with a watermark leaves late rows out and keeps only their count. Here a first query parts them from the others by the same
rule, so that none is lost, and a second one sums the others up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def part_late(rows: DataFrame, at: str, delay: str, accepted: str, late: str, marks: str, checkpoint: str) -> StreamingQuery:
    """Rows older than the latest time of all earlier batches less `delay`, and rows without a time, go to `late`, the others to `accepted`;
    together they are all rows. Each batch's files stand in a folder named by its number and replace what a broken-off try has left.
    `marks` keeps, by batch, the latest time so far: one value, all that a batch reads of what was before."""
    spark = rows.sparkSession

    def one(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            high = None
            if number:
                high = spark.read.schema("high timestamp").parquet(f"{marks}/batch={number - 1}").collect()[0].high
            here = batch.agg(F.max(at)).collect()[0][0]
            on_time = F.col(at).isNotNull() if high is None else F.col(at) >= F.lit(high) - F.expr(f"INTERVAL {delay}")
            on_time = F.coalesce(on_time, F.lit(False))
            batch.where(on_time).write.mode("overwrite").parquet(f"{accepted}/batch={number}")
            batch.where(~on_time).write.mode("overwrite").parquet(f"{late}/batch={number}")
            so_far = max((t for t in (high, here) if t is not None), default=None)
            spark.createDataFrame([(so_far,)], "high timestamp").coalesce(1).write.mode("overwrite").parquet(f"{marks}/batch={number}")
        finally:
            batch.unpersist()

    return rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions(rows: DataFrame, key: str, at: str, gap: str, delay: str, *aggregates: Column) -> DataFrame:
    """A stream's sessions: rows of a key that follow each other within `gap`, told once the watermark has passed their end (the last row's time
    and `gap`): key, start, end, n and the aggregates. What is open is kept by key until then."""
    found = rows.withWatermark(at, delay).groupBy(key, F.session_window(at, gap).alias("session")).agg(F.count(F.lit(1)).alias("n"), *aggregates)
    return found.select(key, F.col("session.start").alias("start"), F.col("session.end").alias("end"), *[c for c in found.columns if c not in (key, "session")])


def sessions_stream(rows: DataFrame, key: str, at: str, gap: str, delay: str, table: str, checkpoint: str) -> StreamingQuery:
    return sessions(rows, key, at, gap, delay).writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions_of_table(rows: DataFrame, key: str, at: str, gap: str) -> DataFrame:
    """The same sessions of a whole table, whether closed or not, by windows."""
    by = Window.partitionBy(key).orderBy(at)
    new = F.coalesce(F.col(at) > F.lag(at).over(by) + F.expr(f"INTERVAL {gap}"), F.lit(True)).cast("int")
    marked = rows.where(F.col(at).isNotNull()).select(key, at, new.alias("__new")).withColumn("__nth", F.sum("__new").over(by))
    return marked.groupBy(key, "__nth").agg(F.min(at).alias("start"), (F.max(at) + F.expr(f"INTERVAL {gap}")).alias("end"), F.count(F.lit(1)).alias("n")).drop("__nth")
