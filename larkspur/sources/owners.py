"""A secondary index: a table's rows by another column than its key, so that an owner's rows are found without a scan.

Rows are dealt to folders by a hash of the owner and sorted by owner in their files. A reader opens the folders of the owners it asks for
(partition pruning, at run time for a table of owners), and of their files the row groups that may hold them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.sources.storage import free, unused

#: Folders of an index, and the tasks that write it.
BUCKETS, TASKS = 64, 64


def _bucket(owner: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(owner), F.lit(buckets)).cast("int")


def write_index(df: DataFrame, owner: str, path: str, buckets: int = BUCKETS, tasks: int = TASKS) -> None:
    """Rows are range-partitioned by bucket, owner and a hash of the row, so an owner of a third of all rows is written by many tasks.
    Null owners are rows of a bucket, and owned() does not find them."""
    free(df, "bucket")
    spread = F.xxhash64(*(F.col(f"`{n}`") for n in df.columns))
    rows = df.withColumn("bucket", _bucket(F.col(owner), buckets))
    rows.repartitionByRange(tasks, "bucket", owner, spread).sortWithinPartitions("bucket", owner).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows")
    df.limit(0).write.mode("overwrite").parquet(f"{path}/shape")  # an empty table has no folders that tell its columns


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(f"{path}/shape").schema.add("bucket", "integer")).parquet(f"{path}/rows")


def owned(spark: SparkSession, path: str, owner: str, value: object, buckets: int = BUCKETS) -> DataFrame:
    """The rows of one owner: one folder is opened, and the filter reaches its files."""
    rows = _rows(spark, path)
    wanted = F.lit(value).cast(rows.schema[owner].dataType)
    return rows.where((F.col("bucket") == _bucket(wanted, buckets)) & (F.col(owner) == wanted)).drop("bucket")


def owned_by(asked: DataFrame, path: str, owner: str, buckets: int = BUCKETS) -> DataFrame:
    """The rows whose owner is among those asked for, each once however often it is asked. The folders are chosen when the owners are known."""
    rows = _rows(asked.sparkSession, path)
    key, place = unused(rows.columns, "__owner"), unused(rows.columns, "__place")
    keys = asked.select(F.col(owner).cast(rows.schema[owner].dataType).alias(key)).where(F.col(key).isNotNull()).distinct().withColumn(place, _bucket(F.col(key), buckets))
    return rows.join(keys, (F.col("bucket") == F.col(place)) & (F.col(owner) == F.col(key)), "left_semi").drop("bucket")
