"""Reading tables by key, the folder that all machines share, and JSON in and out."""

from __future__ import annotations

import logging
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Raw requests beyond this many bytes are refused.
BODY_LIMIT = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. In local mode, where there is one machine, a
    temporary folder serves if it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        found = tempfile.mkdtemp(prefix="larkspur-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
        _gone_at_exit(spark, spark.sparkContext.getCheckpointDir())
    return found


def _gone_at_exit(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(there)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for what one query writes and reads back; it goes when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _gone_at_exit(spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def unused(names: Iterable[str], wanted: str) -> str:
    """wanted, with underscores at its end until no name is equal to it, letter case aside."""
    taken = {n.lower() for n in names}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def free(df: DataFrame, *wanted: str) -> None:
    """Refuses a table that has columns named like a result's, letter case aside: they would be lost without a word."""
    if taken := sorted({n.lower() for n in df.columns} & {n.lower() for n in wanted}):
        raise ValueError(f"the table has columns {', '.join(taken)}, which the result needs; rename them first")


def repeated(rows: DataFrame, copies: str, nth: str, step: int = 1 << 12) -> DataFrame:
    """Each row as often as `copies` says, numbered from 0 in the column nth. In two steps, so that no row makes a long array."""
    block = unused([*rows.columns, nth], "__block")
    rows = rows.withColumn(block, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(copies) - 1) / step))))
    last = F.least(F.col(copies) - 1, (F.col(block) + 1) * step - 1)
    return rows.withColumn(nth, F.explode(F.sequence(F.col(block) * step, last))).drop(block)


def store(spark: SparkSession, path: str | None, fallback: DataFrame) -> tuple[DataFrame, bool]:
    """The table at path and True; the fallback rows and False if no path is given or no table can be opened there. Opening
    reads the schema only; a table that breaks later fails its query, as it must."""
    if path:
        try:
            return spark.read.parquet(path), True
        except AnalysisException as wrong:
            logging.getLogger(__name__).warning("no table at %s, the fallback rows serve: %s", path, wrong.getCondition())
    return fallback, False


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def point_read(df: DataFrame, key: str, value: object) -> DataFrame:
    """The rows with a key; the filter reaches the files."""
    return df.where(F.col(key) == F.lit(value))


def parsed(raw: DataFrame, schema: StructType | str, body: str = "value", limit: int = BODY_LIMIT) -> tuple[DataFrame, DataFrame]:
    """JSON bodies by a schema: (rows that parse, the others as body and error). A field of another type makes the whole body bad."""
    json, wrong = unused(raw.columns, "__json"), unused(raw.columns, "__error")
    if body.lower() == "error":
        free(raw, "error")
    checked = raw.withColumn(json, F.from_json(body, schema, {"mode": "PERMISSIVE"}))
    size, names = F.octet_length(body), checked.select(f"{json}.*").columns
    lost = F.lit(False)
    for name in names:  # present in the text, yet null after parsing: it did not fit the type
        told = F.get_json_object(body, f"$['{name}']")
        lost = lost | (told.isNotNull() & F.col(json).getField(name).isNull())
    whole = F.get_json_object(body, "$").isNotNull() & F.ltrim(body).startswith("{")
    error = F.when(F.col(body).isNull(), "missing body").when(size > limit, "body too large").when(~whole, "not a JSON object").when(lost, "a field has another type")
    checked = checked.withColumn(wrong, error)
    return checked.where(F.col(wrong).isNull()).select(f"{json}.*"), checked.where(F.col(wrong).isNotNull()).select(body, F.col(wrong).alias("error"))


def query_parameter(url: Column, name: str) -> Column:
    """A parameter's value, percent-decoded, a plus being a blank; as it stands but for that if it can't be decoded."""
    raw = F.try_parse_url(url, F.lit("QUERY"), F.lit(name))
    return F.coalesce(F.try_url_decode(raw), F.replace(raw, F.lit("+"), F.lit(" ")))


def to_json_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
