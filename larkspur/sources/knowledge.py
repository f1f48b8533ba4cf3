"""Knowledge bases: entries with keywords, in an order that breaks ties."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "id string, category string, source string, keywords array<string>, question string, answer string"


#: Entries of one file.
ENTRIES = 1000


def load(spark: SparkSession, path: str) -> DataFrame:
    """JSON arrays of entries with ord, their place. One file is one array, so it is read whole; fails if it can't be. Of several
    files, as write() makes them, places go on from the folder's number."""
    text = spark.read.text(path, wholetext=True)
    before = F.col("part").cast("int") * ENTRIES if "part" in text.columns else F.lit(0)
    found = text.select(before.alias("before"), F.posexplode(F.from_json("value", f"array<struct<{ENTRY.replace(' ', ':').replace(',:', ',')}>>", {"mode": "FAILFAST"})).alias("place", "e"))
    return validated(found.select((F.col("before") + F.col("place")).alias("ord"), "e.*"))


def write(kb: DataFrame, path: str) -> None:
    """A base whose ord runs from 0 without gaps, as JSON arrays of ENTRIES entries at most."""
    names = [f.split()[0] for f in ENTRY.split(", ")]
    entry = F.struct("ord", *(n for n in names if n in kb.columns))
    parts = kb.groupBy(F.floor(F.col("ord") / ENTRIES).alias("part")).agg(F.array_sort(F.collect_list(entry)).alias("e"))
    parts.select("part", F.to_json(F.transform("e", lambda e: e.dropFields("ord"))).alias("value")).repartition("part").write.partitionBy("part").mode("overwrite").text(path)


def entries(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """From (ord, id, category, keywords, source, answer) tuples."""
    return validated(spark.createDataFrame(rows, "ord int, id string, category string, keywords array<string>, source string, answer string"))


def validated(kb: DataFrame) -> DataFrame:
    """Without what would match everything: empty keywords and categories."""
    return kb.withColumn("category", F.nullif("category", F.lit(""))).withColumn("keywords", F.filter(F.coalesce("keywords", F.array().cast("array<string>")), lambda k: k.isNotNull() & (k != "")))


def count(kb: DataFrame) -> int:
    return kb.count()
