"""Joins by time: the last row before, and intervals that overlap.

*As of.* Rows of both sides are dealt by key and stretch of time, so that a frequent key is many tasks. Inside a stretch the last right row is
carried forward in order of time; what a stretch begins with comes from the stretches before it, of which one row each is kept. That is carried
over in two steps, inside groups of stretches and then over groups, so no task holds all of a key there either.

*Overlap.* Each interval stands in the bins of time that it meets. Long ones take coarser bins, FAN times as wide a level, so none stands in over
FAN + 1 of them; a pair meets at the coarser one's level, and is told in the first bin that both have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows that a stretch of time holds on average, and stretches of a group.
STRETCH, GROUP = 1 << 20, 1 << 10
#: Bins that an interval may meet before a coarser level takes it; levels.
FAN, LEVELS = 32, 6


def _micros(at: str) -> Column:
    return F.unix_micros(F.col(at).cast("timestamp"))


def as_of(left: DataFrame, right: DataFrame, on: str, left_at: str, right_at: str, tie: str, values: dict[str, str], stretch: int | None = None) -> DataFrame:
    """left with columns of the last right row of the same key that isn't later: values maps right columns to their new names, all null where there
    is none. Of right rows at one time the one with the greatest `tie` (nulls least) is last. Rows of left with a null key or time have none; right
    ones with null key or time match none. stretch: microseconds; by default such that one has STRETCH rows on average."""
    if taken := {n.lower() for n in left.columns} & {n.lower() for n in values.values()}:
        raise ValueError(f"left has columns {sorted(taken)} already")
    if stretch is None:
        spans = left.select(_micros(left_at).alias("at")).unionAll(right.select(_micros(right_at).alias("at"))).agg(F.min("at"), F.max("at"), F.count("at")).collect()[0]
        stretch = max(1, (spans[1] - spans[0]) * STRETCH // max(spans[2], 1)) if spans[2] else 1
    told = F.struct(*(F.col(name).alias(f"v{k}") for k, name in enumerate(values)))
    last = F.struct(F.col("at"), F.col("tie"), F.col("told"))
    row = F.struct(*(F.col(f"`{n}`").alias(f"c{k}") for k, n in enumerate(left.columns)))
    one = left.select(F.col(on).alias("key"), _micros(left_at).alias("at"), F.lit(1).alias("side"), F.lit(None).cast(right.schema[tie].dataType).alias("tie"), row.alias("row"), F.lit(None).cast(right.select(told.alias("t")).schema["t"].dataType).alias("told"))
    other = right.where(F.col(on).isNotNull() & F.col(right_at).isNotNull()).select(F.col(on).alias("key"), _micros(right_at).alias("at"), F.lit(0).alias("side"), F.col(tie).alias("tie"), F.lit(None).cast(left.select(row.alias("r")).schema["r"].dataType).alias("row"), told.alias("told"))
    both = one.where("key is not null and at is not null").unionByName(other).withColumn("stretch", F.floor(F.col("at") / stretch))
    # right rows first, in the order of ties, so the last one before a left row is its match
    order = Window.partitionBy("key", "stretch").orderBy("at", "side", F.col("tie").asc_nulls_first())
    inside = both.withColumn("mine", F.last(F.when(F.col("side") == 0, last), ignorenulls=True).over(order)).where("side = 1").select("key", "stretch", "row", "mine")
    ends = other.withColumn("stretch", F.floor(F.col("at") / stretch)).groupBy("key", "stretch").agg(F.max_by(last, F.struct("at", F.col("tie").isNotNull(), "tie")).alias("end"))
    ends = ends.withColumn("group", F.floor(F.col("stretch") / GROUP))
    wanted = one.where("key is not null and at is not null").select("key", F.floor(F.col("at") / stretch).alias("stretch")).distinct().withColumn("group", F.floor(F.col("stretch") / GROUP))
    # what each stretch that left rows lie in begins with, by groups of stretches
    places = wanted.select("key", "group", "stretch", F.lit(0).alias("kind"), F.lit(None).cast(ends.schema["end"].dataType).alias("end")).unionByName(ends.select("key", "group", "stretch", F.lit(1).alias("kind"), "end"))
    near = Window.partitionBy("key", "group").orderBy("stretch", "kind").rowsBetween(Window.unboundedPreceding, -1)
    carried = places.withColumn("before", F.last("end", ignorenulls=True).over(near)).where("kind = 0")
    far = Window.partitionBy("key").orderBy("group", "kind").rowsBetween(Window.unboundedPreceding, -1)
    groups = ends.groupBy("key", "group").agg(F.max_by("end", "stretch").alias("end")).select("key", "group", F.lit(1).alias("kind"), "end")
    asked = wanted.select("key", "group").distinct().select("key", "group", F.lit(0).alias("kind"), F.lit(None).cast(ends.schema["end"].dataType).alias("end"))
    older = asked.unionByName(groups).withColumn("older", F.last("end", ignorenulls=True).over(far)).where("kind = 0").select("key", "group", "older")
    begins = carried.join(older, ["key", "group"], "left").select("key", "stretch", F.coalesce("before", "older").alias("begin"))
    found = inside.join(begins, ["key", "stretch"], "left").withColumn("match", F.coalesce("mine", "begin"))
    out = lambda df, match: df.select(*(F.col(f"row.c{k}").alias(n) for k, n in enumerate(left.columns)), *(match(k).alias(n) for k, n in enumerate(values.values())))
    without = one.where("key is null or at is null")
    kinds = [right.schema[n].dataType for n in values]
    return out(found, lambda k: F.col(f"match.told.v{k}")).unionByName(out(without, lambda k: F.lit(None).cast(kinds[k])))


def _binned(rows: DataFrame, on: str, first: str, last: str, bin_width: int, name: str) -> DataFrame:
    """(key, level, bin, own level, first and last time, row) for each bin of each level from the row's own upwards."""
    a, b = _micros(first), _micros(last)
    row = F.struct(*(F.col(f"`{n}`") for n in rows.columns))
    widths = [bin_width * FAN**k for k in range(LEVELS)]
    own = F.lit(LEVELS - 1)
    for level in reversed(range(LEVELS - 1)):
        own = F.when(F.col("b") - F.col("a") <= widths[level] * FAN, level).otherwise(own)
    held = rows.select(F.col(on).alias("key"), a.alias("a"), b.alias("b"), row.alias(name)).where("key is not null and a < b").withColumn("own", own)
    levels = F.sequence(F.col("own"), F.lit(LEVELS - 1))
    held = held.withColumn("level", F.explode(levels))
    wide = F.element_at(F.array(*(F.lit(w).cast("long") for w in widths)), F.col("level") + 1)
    # the last moment is not of the interval
    bins = F.sequence(F.floor(F.col("a") / wide), F.floor((F.col("b") - 1) / wide))
    return held.withColumn("first", F.floor(F.col("a") / wide)).withColumn("bin", F.explode(bins))


def overlaps(left: DataFrame, right: DataFrame, on: str, left_span: tuple[str, str], right_span: tuple[str, str], bin_width: int) -> DataFrame:
    """Pairs of rows of one key whose intervals [first, last) have a moment in common: structs `left` and `right`. bin_width: microseconds of a bin of the finest
    level; about a usual interval is right. Intervals that are empty, or lack a key or an end, meet none; those longer than the coarsest
    level's bins stand in as many as they need. A pair is told once for each pair of rows."""
    one, other = _binned(left, on, *left_span, bin_width, "left"), _binned(right, on, *right_span, bin_width, "right")
    names = lambda df, tag, row: df.select("key", "level", "bin", *(F.col(c).alias(f"{c}_{tag}") for c in ("own", "first", "a", "b")), row)
    met = names(one, "l", "left").join(names(other, "r", "right"), ["key", "level", "bin"])
    once = (F.col("level") == F.greatest("own_l", "own_r")) & (F.col("bin") == F.greatest("first_l", "first_r"))
    return met.where(once & (F.col("a_l") < F.col("b_r")) & (F.col("a_r") < F.col("b_l"))).select("left", "right")


__all__ = ["as_of", "overlaps"]
