"""The latest rows, and any page of a listing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.sources.storage import free

#: Fixed value: rows of a listing.
ROWS = 50


def latest(df: DataFrame, order: str, tie: str, n: int = ROWS) -> DataFrame:
    """The last n rows by order, then tie, latest first. One bounded heap for each task, no full sort."""
    return df.orderBy(F.desc(order), F.desc(tie)).limit(n)


def last_appended(df: DataFrame, sequence: str, n: int = ROWS) -> DataFrame:
    """The last n rows by an explicit sequence number, latest first."""
    return df.orderBy(F.desc(sequence)).limit(n)


def write_pages(df: DataFrame, order: str, tie: str, path: str, parts: int) -> None:
    """Lays df out for page(): range-partitioned into parts, latest first, and beside them how many rows lie before each part. Rows are
    sorted once, by all executors; the counts come from the files' footers. order and tie together should be a key: rows that agree in
    both stay in one part."""
    free(df, "part")
    latest_first = [F.desc(order), F.desc(tie)]
    dealt = df.repartitionByRange(parts, *latest_first).withColumn("part", F.spark_partition_id())
    dealt.sortWithinPartitions("part", *latest_first).write.mode("overwrite").partitionBy("part").parquet(f"{path}/rows")
    df.limit(0).write.mode("overwrite").parquet(f"{path}/shape")  # an empty table has no parts that tell its columns
    counted = _rows(df.sparkSession, path).groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    counted.select("part", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")).coalesce(1).write.mode("overwrite").parquet(f"{path}/index")


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(f"{path}/shape").schema.add("part", "integer")).parquet(f"{path}/rows")


def page(spark: SparkSession, path: str, order: str, tie: str, number: int, size: int = ROWS) -> DataFrame:
    """Page `number` (from 1), latest first; empty after the last. Only parts that hold rows of the page are read: one, or two at
    a border, if parts are larger than pages."""
    if number < 1 or size < 1:
        raise ValueError("pages are numbered from 1 and have a row at least")
    first = (number - 1) * size
    met = spark.read.parquet(f"{path}/index").where((F.col("before") < first + size) & (F.col("before") + F.col("n") > first)).collect()
    rows = _rows(spark, path).where(F.col("part").isin([r.part for r in met]))
    skipped = first - min((r.before for r in met), default=first)
    return rows.drop("part").orderBy(F.desc(order), F.desc(tie)).offset(skipped).limit(size)
