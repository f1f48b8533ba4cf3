"""Mixing sources to target weights along a time-varying curriculum. DataFrame functions only.

A source's target is what its weight gives it of the whole mix, at most `most` times its own size (the excess goes to the
others by weight). Its weight schedule over training time 0..1 is piecewise linear; the integral, scaled to the target, is
the source's cumulative token demand. A document's place in its source's stream, a fixed pseudo-random order run through
again and again until the target is reached, is a value of that demand; inverting the demand gives the training position,
and documents are range-sorted by it.

Running sums inside a source are taken in two steps, inside buckets of about BUCKET documents and then over the buckets'
totals, so that a source with a third of all rows is no single task.

Edge cases: null and empty texts have size 0 and are taken 0 words; a null source is a source, after all others; rows that
repeat are separate documents (their order among themselves doesn't matter, they are alike); an empty table gives an empty
result; all sizes 0 give targets 0; columns other than the named ones are ignored by mix() and kept by mixed().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import cut, free, repeated, row_key, unused

#: Weights by the rank of the source, share of all sizes, and how often a source may be used.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Schedules by the rank of the source: (time, relative weight) knots. The first source class fades out, the last one in.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.2), (0.5, 0.8), (1.0, 2.2)))
BUCKET = 4096


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Of one row for each source (source, source_size, n_docs): with rank, weight and target.

    Sources that reach their limit first are those with the least limit per weight; in that order, the level at which the
    others share is what is left over the weight left, and the first source whose limit is above it ends the limited ones.
    """
    size = "source_size"
    order = Window.orderBy(F.col("source").isNull(), "source")
    found = sizes.withColumn("rank", F.row_number().over(order) - 1).withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.pmod("rank", F.lit(len(weights))) + 1))
    by_limit = Window.orderBy((F.col(size) * most / F.col("weight")), "rank")
    before, onward, whole = by_limit.rowsBetween(Window.unboundedPreceding, -1), by_limit.rowsBetween(0, Window.unboundedFollowing), by_limit.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum(size).over(whole) * share - F.coalesce(F.sum(F.col(size) * most).over(before), F.lit(0))
    found = found.withColumn("level", left / F.sum("weight").over(onward))
    found = found.withColumn("open", F.col("level") * F.col("weight") <= F.col(size) * most)
    level = F.min_by(F.when(F.col("open"), F.col("level")), F.when(F.col("open"), F.struct(F.col(size) * most / F.col("weight"), "rank"))).over(whole)
    return found.withColumn("target", F.least(F.coalesce(level * F.col("weight"), F.col(size) * most), F.col(size) * most).cast("double")).drop("level", "open")


def demand_inverse(part: Column, rank: Column, schedules: tuple = SCHEDULES) -> Column:
    """The time at which a source's schedule has integrated to a part (0..1) of its whole."""

    def one(knots: tuple) -> Column:
        areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False)]
        total, done, out = sum(areas), 0.0, None
        for (t0, w0), (t1, w1), area in zip(knots, knots[1:], areas, strict=False):
            need, slope = part * total - F.lit(done), (w1 - w0) / (t1 - t0)
            # w0 x + slope x^2 / 2 = need, in the form that stays exact where the slope is small
            root = F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * need, F.lit(0.0)))
            time = F.lit(t0) + F.try_divide(2 * need, w0 + root)
            done += area
            last = t1 == knots[-1][0]
            out = (F.when(F.lit(True), time) if last else F.when(part * total <= done, time)) if out is None else (out.otherwise(time) if last else out.when(part * total <= done, time))
        return F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0))

    at = F.pmod(rank, F.lit(len(schedules)))
    out = F.when(at == 0, one(schedules[0]))
    for k, knots in enumerate(schedules[1:], 1):
        out = out.when(at == k, one(knots))
    return out


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST, schedules: tuple = SCHEDULES, bucket: int = BUCKET) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, taken, repeats, positions (one for each time it is used), key (a hash of the row).

    In the source's order (by md5 of id and text), a document is used again in each pass whose beginning of it lies under the
    target; the one that crosses the target is used if its middle does not. Equal rows are counted first and told apart last.
    """
    ident = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), row_key(docs).alias("key"), F.md5(ident.cast("binary")).alias("spot"))
    rows = cut(rows.groupBy("source", "spot", "doc_id", "size", "key").agg(F.count(F.lit(1)).alias("copies")))
    sizes = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.sum("copies").alias("n_docs"))
    plan = targets(sizes, weights, share, most).withColumn("buckets", F.ceil(F.col("n_docs") / bucket)).withColumnRenamed("source", "named")
    held = rows.join(plan, F.col("source").eqNullSafe(F.col("named"))).drop("named")
    # the first 32 bits of the order, cut into as many buckets as the source needs
    held = held.withColumn("bucket", F.floor(F.conv(F.substring("spot", 1, 8), 16, 10).cast("long") * F.col("buckets") / (1 << 32)))
    order = [F.col("spot"), F.col("doc_id"), F.col("size"), F.col("key")]
    inside = Window.partitionBy("rank", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("before", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(inside), F.lit(0)))
    over = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = held.groupBy("rank", "bucket").agg(F.sum(F.col("size") * F.col("copies")).alias("held")).select("rank", "bucket", F.coalesce(F.sum("held").over(over), F.lit(0)).alias("base"))
    placed = repeated(held.join(totals, ["rank", "bucket"]), "copies", "nth")
    placed = placed.withColumn("start", F.col("base") + F.col("before") + F.col("nth") * F.col("size"))
    # pass p uses the document if its middle, start + p * source_size + size / 2, lies under the target
    middle = F.col("start") + F.col("size") / 2
    uses = sum((F.when((F.col("size") > 0) & (middle + p * F.col("source_size") < F.col("target")), 1).otherwise(0) for p in range(most)), F.lit(0))
    placed = placed.withColumn("repeats", uses)
    part = lambda p: F.try_divide(middle + p * F.col("source_size"), F.col("target"))
    times = F.array(*(F.when(F.col("repeats") > p, demand_inverse(part(p), F.col("rank"), schedules)) for p in range(most)))
    return placed.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"), "repeats", F.array_compact(times).alias("positions"), "key")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """docs as they are trained on: each row as often as the mix uses it, range-sorted by training position."""
    own, use = unused(docs.columns, "__key"), unused(docs.columns, "__use")
    uses = mix(docs, id_col, text_col, source_col, **how).where("repeats > 0").select(F.struct(F.struct("key", "doc_id").alias("row"), "positions").alias(use))
    # of equal rows one meets the uses of all; they become one in each task before they meet in any. The key is the row's hash and
    # its id, in which nulls are equal, so that this and the join share one shuffle
    rows = docs.withColumn(own, F.struct(row_key(docs).alias("key"), F.col(id_col).alias("doc_id"))).dropDuplicates([own])
    met = rows.join(uses, F.col(own) == F.col(f"{use}.row"))
    return met.select(*docs.columns, F.explode(f"{use}.positions").alias(use)).orderBy(use, id_col).select(*docs.columns)


def with_position(docs: DataFrame, name: str = "position") -> DataFrame:
    """docs and each row's place, from 0, in its files: part after part, row after row. Of mixed() written and read again, this is
    the order of training.

    docs has to be a table as it is read from files. What is summed up in one task and sent to all is one number a file, as many
    as the driver lists to read the table at all. An empty table gives an empty result; a column of the place's name is refused.
    """
    free(docs, name)
    meta, file, row, before = docs.metadataColumn("_metadata"), *(unused(docs.columns, n) for n in ("__file", "__row", "__before"))
    held = docs.select("*", meta["file_path"].alias(file), meta["row_index"].alias(row))
    # part numbers have five digits, or more if there are more parts
    leaf = F.element_at(F.split(file, "/"), -1)
    earlier = Window.orderBy(F.length(leaf), leaf, file).rowsBetween(Window.unboundedPreceding, -1)
    files = held.groupBy(file).agg(F.count(F.lit(1)).alias(before)).select(F.col(file), F.coalesce(F.sum(before).over(earlier), F.lit(0)).alias(before))
    return held.join(F.broadcast(files), file).select(*docs.columns, (F.col(before) + F.col(row)).alias(name))
