"""Quantiles from stored sketches that merge by sums: counts by bins whose width grows with the value.

A bin holds the values between two powers of g = (1 + a) / (1 - a), so its middle is within a share `a` of each of them, whatever the values
are. Sketches of days, batches or groups are added bin by bin; no row is seen again. Nulls, NaN and infinite values take no part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.sources.storage import free

#: Greatest relative error of an estimate.
ACCURACY = 0.01


def scale(accuracy: float) -> tuple[float, int]:
    """ln g, and a number above any exponent of a double."""
    step = math.log((1 + accuracy) / (1 - accuracy))
    return step, math.ceil(746 / step) + 1


def bin_of(value: Column, accuracy: float = ACCURACY) -> Column:
    """A whole number that grows with the value; 0 for 0."""
    step, above = scale(accuracy)
    x = value.cast("double")
    exponent = F.ceil(F.ln(F.abs(x)) / F.lit(step)) + above
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(finite, F.when(x == 0, 0).when(x > 0, exponent).otherwise(-exponent)).cast("long")


def middle_of(number: Column, accuracy: float = ACCURACY) -> Column:
    step, above = scale(accuracy)
    return F.signum(number.cast("double")) * F.exp((F.abs(number) - above) * F.lit(step)) * (2 / (1 + math.exp(step)))


def sketch(rows: DataFrame, groups: list[str], value: str, accuracy: float = ACCURACY) -> DataFrame:
    """groups, bin, n: a few thousand rows a group at most, however many values it has."""
    free(rows.select(*groups), "bin", "n")
    return rows.select(*groups, bin_of(F.col(value), accuracy).alias("bin")).where("bin is not null").groupBy(*groups, "bin").agg(F.count(F.lit(1)).alias("n"))


def store(rows: DataFrame, day: str, groups: list[str], value: str, path: str, batch: int, accuracy: float = ACCURACY) -> None:
    """Adds the sketches of a batch to those at path, in a folder by day and batch. A batch that is written again replaces the days that it has;
    days and batches that it lacks are not touched or read. A null day goes to a folder of its own."""
    free(rows.select(day, *groups), "batch")
    told = sketch(rows, [day, *groups], value, accuracy).withColumn("batch", F.lit(batch))
    told.repartition(day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day, "batch").parquet(path)


def estimates(sketches: DataFrame, groups: list[str], parts: list[float], accuracy: float = ACCURACY) -> DataFrame:
    """groups, part, estimate, n: of each part (0 to 1) the middle of the bin that holds the value of rank ceil(part * n), or the first. The
    running sum goes over a group's bins, not its rows."""
    if not groups:
        return estimates(sketches.withColumn("__all", F.lit(0)), ["__all"], parts, accuracy).drop("__all")
    merged = sketches.groupBy(*groups, "bin").agg(F.sum("n").alias("n"))
    each = Window.partitionBy(*groups)
    so_far = merged.withColumns({"__upto": F.sum("n").over(each.orderBy("bin")), "__all_n": F.sum("n").over(each)})
    at = [F.min(F.when(F.col("__upto") >= F.greatest(F.ceil(F.lit(float(p)) * F.col("__all_n")), F.lit(1)), F.col("bin"))) for p in parts]
    one = so_far.groupBy(*groups).agg(F.max("__all_n").alias("__all_n"), F.array(*(F.struct(F.lit(float(p)).alias("part"), a.alias("bin")) for p, a in zip(parts, at, strict=True))).alias("__told"))
    return one.select(*groups, F.inline("__told"), F.col("__all_n").alias("n")).select(*groups, "part", middle_of(F.col("bin"), accuracy).alias("estimate"), "n")
