"""Request counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def counts(conditions: dict[str, Column]) -> list[Column]:
    return [F.count(F.lit(1)).alias("requests_total"), *(F.count_if(c).alias(name) for name, c in conditions.items())]


def counters(requests: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """One row: all requests, and those for which each condition holds."""
    return requests.agg(*counts(conditions))


def observed(requests: DataFrame, conditions: dict[str, Column]) -> tuple[DataFrame, Observation]:
    """The same counters, taken while the rows are used for something else."""
    seen = Observation("requests")
    return requests.observe(seen, *counts(conditions)), seen


def snapshot(counted: DataFrame, uptime: Column, store: str) -> DataFrame:
    return counted.select(uptime.cast("long").alias("uptime_seconds"), F.struct(*counted.columns).alias("counters"), F.lit(store).alias("data_source"))


def distinct_by_levels(rows: DataFrame, levels: list[str], key: str, total: str = "n", level: str = "level") -> DataFrame:
    """Exact distinct counts of a whole-number key for all combinations of the columns in levels, as CUBE gives them: level has a bit for each column
    that is summed over, the first one the highest. Rows are read once, for the finest combination, as bitmaps of keys; coarser ones join the
    bitmaps and see no row again. Null keys count as none."""
    fixed = [*levels, "__bucket"]
    finest = rows.groupBy(*levels, F.bitmap_bucket_number(key).alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(key)).alias("__bits"))
    sets = [[c for k, c in enumerate(levels) if not mask >> k & 1] + ["__bucket"] for mask in range(1 << len(levels))]
    # the last bit is the bucket's, which is never summed over
    joined = finest.groupingSets(sets, *fixed).agg(F.shiftright(F.grouping_id(), 1).alias(level), F.bitmap_or_agg("__bits").alias("__bits"))
    return joined.groupBy(*levels, level).agg(F.sum(F.bitmap_count("__bits")).alias(total))
