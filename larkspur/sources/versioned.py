"""A table whose rows change: changes by version, the latest wins, folded bucket by bucket by a compaction that takes effect at once.

A change has a key, a version, and the columns that it sets; nulls set nothing. What is kept of each column is its greatest (version, value),
so changes may come in any order, twice, and before or after a compaction, and the answer is the same. Of equal versions the greatest value
wins; a null version is before all others; a null key is a key. Changes lie in folders by batch number and bucket of the key, so a retried batch
replaces itself. A compaction writes the buckets that changed to a new folder and then renames one small file into place, which names the
folder of each bucket. Until then readers see the old state; one that is killed leaves nothing that counts. One compaction runs at a time.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from larkspur.sources.storage import remove

#: Buckets of a new table; one task folds a bucket, so a bucket's keys have to fit.
BUCKETS = 64


@dataclass(frozen=True)
class Versioned:
    path: str
    key: str
    version: str
    schema: str
    buckets: int
    #: Which switch this is, the last batch that it holds, and the folder of each bucket.
    number: int = 0
    folded: int = -1
    places: dict[int, int] = field(default_factory=dict)

    @property
    def kinds(self) -> dict[str, DataType]:
        return {f.name: f.dataType for f in StructType.fromJson(json.loads(self.schema)).fields}

    @property
    def columns(self) -> list[str]:
        return [n for n in self.kinds if n not in (self.key, self.version)]

    def pair(self, name: str) -> StructType:
        """What is kept of a column."""
        return StructType().add("version", self.kinds[self.version]).add("value", self.kinds[name])

    def shape(self, *more: tuple[str, str]) -> StructType:
        """How rows are kept, and the folders that they lie in."""
        out = StructType().add("key", self.kinds[self.key])
        for k, name in enumerate(self.columns):
            out.add(f"c{k}", self.pair(name))
        for name, kind in more:
            out.add(name, kind)
        return out


def _files(spark: SparkSession, path: str) -> tuple:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there, there.getFileSystem(spark._jsc.hadoopConfiguration())


def _switch(spark: SparkSession, told: Versioned) -> Versioned:
    """Makes this the state that readers see: a file written aside, then renamed. Fails if there is one of its number."""
    text = json.dumps({k: v for k, v in told.__dict__.items() if k != "path"})
    aside, files = _files(spark, f"{told.path}/switch/_{uuid.uuid4().hex}")
    out = files.create(aside, True)
    out.write(bytearray(text, "utf-8"))
    out.close()
    place, _ = _files(spark, f"{told.path}/switch/{told.number:012d}")
    if files.exists(place) or not files.rename(aside, place):
        files.delete(aside, False)
        raise RuntimeError(f"another switch {told.number} of {told.path} was faster")
    return told


def create(spark: SparkSession, path: str, schema: StructType, key: str, version: str, buckets: int = BUCKETS) -> Versioned:
    """A new table without rows. The columns of the schema other than key and version have to be comparable."""
    for name in (f"{path}/changes", f"{path}/switch"):
        there, files = _files(spark, name)
        files.mkdirs(there)
    return _switch(spark, Versioned(path, key, version, schema.json(), buckets))


def opened(spark: SparkSession, path: str) -> Versioned:
    """The table as its last switch has it."""
    there, files = _files(spark, f"{path}/switch")
    number = max(int(f.getPath().getName()) for f in files.listStatus(there) if f.getPath().getName().isdigit())
    told = json.loads(spark.read.text(f"{path}/switch/{number:012d}", wholetext=True).first()[0])
    return Versioned(path, **{**told, "places": {int(k): v for k, v in told["places"].items()}})


def _bucket(table: Versioned, key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(table.buckets)).cast("int")


def change(table: Versioned, rows: DataFrame, batch: int) -> None:
    """Adds the changes of a batch, numbered from 0 in ascending order; a batch of the same number is replaced. Columns that rows lack are left
    as they are, and columns that the table lacks are ignored. Only batches after the last compaction may be replaced."""
    table = opened(rows.sparkSession, table.path)  # there may have been a compaction
    if batch <= table.folded:
        raise ValueError(f"batch {batch} is folded in already")
    kinds = table.kinds
    version = F.col(table.version).cast(kinds[table.version])
    given = [F.when(F.col(n).isNotNull(), F.struct(version.alias("version"), F.col(n).cast(kinds[n]).alias("value"))) if n in rows.columns else F.lit(None).cast(table.pair(n)) for n in table.columns]
    key = F.col(table.key).cast(kinds[table.key])
    found = rows.select(key.alias("key"), *(c.alias(f"c{k}") for k, c in enumerate(given)), _bucket(table, key).alias("bucket"))
    found.write.mode("overwrite").partitionBy("bucket").parquet(f"{table.path}/changes/batch={batch}")


def _rows(spark: SparkSession, table: Versioned, folders: dict[int, int] | None = None) -> DataFrame:
    """What is folded in and the changes since, in one form: bucket, key, and for each column the version and value."""
    folders = table.places if folders is None else folders
    wanted = ["bucket", *table.shape().names]
    new = spark.read.schema(table.shape(("batch", "long"), ("bucket", "integer"))).parquet(f"{table.path}/changes")
    rows = new.where(F.col("batch") > table.folded).select(*wanted)
    if folders:
        paths = [f"{table.path}/base/number={n}/bucket={b}" for b, n in sorted(folders.items())]
        held = spark.read.schema(table.shape(("number", "long"), ("bucket", "integer"))).option("basePath", f"{table.path}/base")
        rows = rows.unionByName(held.parquet(*paths).select(*wanted))
    return rows


def _merged(rows: DataFrame) -> DataFrame:
    """Partial maxima before the shuffle, so a key that changes often is no single task."""
    return rows.groupBy("bucket", "key").agg(*(F.max(n).alias(n) for n in rows.columns if n not in ("bucket", "key")))


def current(spark: SparkSession, table: Versioned) -> DataFrame:
    """One row a key: key and columns as they are now. No column tells the version, as each column has its own."""
    told = _merged(_rows(spark, table))
    return told.select(F.col("key").alias(table.key), *(F.col(f"c{k}.value").alias(n) for k, n in enumerate(table.columns)))


def point(spark: SparkSession, table: Versioned, value: object) -> DataFrame:
    """The row of one key: only its bucket's files are read."""
    rows = _rows(spark, table)
    wanted = F.lit(value).cast(rows.schema["key"].dataType)
    told = _merged(rows.where((F.col("bucket") == _bucket(table, wanted)) & F.col("key").eqNullSafe(wanted)))
    return told.select(F.col("key").alias(table.key), *(F.col(f"c{k}.value").alias(n) for k, n in enumerate(table.columns)))


def compact(spark: SparkSession, table: Versioned) -> Versioned:
    """Folds all changes so far into their buckets; buckets without any stay where they are. Returns the table after the switch."""
    batches = spark.read.schema("batch long").parquet(f"{table.path}/changes")
    last = batches.where(F.col("batch") > table.folded).agg(F.max("batch")).first()[0]
    if last is None:
        return table
    touched = {r.bucket for r in _rows(spark, table, {}).select("bucket").distinct().collect()}  # numbers below `buckets`
    number = table.number + 1
    rows = _rows(spark, table, {b: n for b, n in table.places.items() if b in touched})
    _merged(rows).repartition(table.buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{table.path}/base/number={number}")
    return _switch(spark, replace(table, number=number, folded=last, places={**table.places, **dict.fromkeys(sorted(touched), number)}))


def clean(spark: SparkSession, table: Versioned) -> None:
    """Removes what no reader of this or a later state needs: folded changes and buckets that have moved. Run it when no reader of an
    earlier state is left."""
    for name, keep in (("changes", lambda n: n > table.folded), ("base", lambda n: n in table.places.values() or n > table.number)):
        there, files = _files(spark, f"{table.path}/{name}")
        if files.exists(there):
            for f in files.listStatus(there):
                told = f.getPath().getName().rpartition("=")[2]
                if told.isdigit() and not keep(int(told)):
                    remove(spark, f.getPath().toString())
