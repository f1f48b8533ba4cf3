"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from pyspark.sql import functions as F

from larkspur.sources.storage import free, remove, repeated, scratch, shared_dir, unused

__all__ = ["attach", "cut", "free", "remove", "repeated", "row_key", "scratch", "shared_dir", "unused"]
#: A key is common if more than this share of all rows has it, so there are fewer common keys than COMMON.
COMMON = 1024


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that no later loss of an executor asks for it again."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def attach(rows: DataFrame, told: DataFrame, on: str, count: str) -> DataFrame:
    """rows joined to what is told of each key; told has one row a key, and in `count` how many rows have it.

    Rows of common keys never meet in one task: fewer than COMMON keys can have over a COMMON-th of all rows, and what is told of
    those goes to every executor. The others are joined by key."""
    told = cut(told)
    total = told.agg(F.coalesce(F.sum(count), F.lit(0))).collect()[0][0]
    common = F.col(count) > total // COMMON
    few = told.where(common)
    rare = rows.join(F.broadcast(few.select(on)), on, "left_anti").join(told.where(~common).hint("merge"), on)
    return rare.drop(count).unionByName(rows.join(F.broadcast(few), on).drop(count))


def row_key(docs: DataFrame) -> Column:
    """A hash of all columns. Rows with one key count as equal."""
    return F.xxhash64(*(F.to_json(F.col(f"`{f.name}`")) if "map" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema.fields))
