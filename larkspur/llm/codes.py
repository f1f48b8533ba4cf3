"""Vector codes: each vector is cut into parts, and each part is told by the index of the nearest entry of its codebook.

Components become integers (floor of SCALE times the component), so all sums are exact and no result hangs on the order of rows. A part's
codebook starts as that part of the ENTRIES rows of smallest id. In each round the codebooks, whose size is bounded by ENTRIES and the
width alone, go to all tasks; Arrow batches work out all squared distances as |x|^2 - 2 x.c + |c|^2 by an int64 matrix product, take the
first least one, and add up parts by entry; a task's sums are merged by a grouped shuffle, and the driver gets one row an entry
and position. Nothing is kept between rounds but the codebooks, so a lost executor costs its tasks of that round.

Edge cases: vectors that are null or hold null or non-finite components are dropped, as are those that are empty, that don't divide into
equal parts, or whose length isn't the most common of the rest (of equally common ones the least), and those with a component beyond
what int64 distances hold (about 10^8 over the square root of the width, as real numbers); zero vectors are like any other.
Repeated rows count as often as they come; rows that share an id start codebooks in the order of their vectors; rows
with a null id are coded, and start a codebook after all others. With fewer rows than ENTRIES codebooks are as small. An empty table gives an
empty result. Null labels are one label. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import attach, cut

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Rows that distances are worked out for at a time.
STEP = 1024
#: Sums of four squares, over all components, stay under this.
MOST = 1 << 60


def _finite(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE, parts: int = PARTS) -> tuple[DataFrame, int]:
    """(id, label, vector of integers) of the rows that take part, and the width."""
    vector = F.col(vector_col).cast("array<double>")
    rows = vectors.where(_finite(vector) & (F.size(vector) > 0) & (F.size(vector) % parts == 0)).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.transform(vector, lambda x: F.floor(x * scale)).alias("vector"))
    # a floor that doesn't fit a long is as far out as one that does and is too large
    most = lambda v: F.forall(v, lambda x: F.abs(x.cast("double")) < F.sqrt(F.lit(float(MOST)) / F.size(v)))
    rows = rows.where(most(F.col("vector")))
    widths = rows.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), "width").limit(1).collect()
    width = widths[0].width if widths else 0
    return rows.where(F.size("vector") == width), width


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def assigned(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (n, width) by codebooks (parts, entries, width / parts): indices and squared distances, (n, parts) each."""
    n, (parts, _, wide) = len(x), books.shape
    codes, errors = np.empty((n, parts), np.int64), np.empty((n, parts), np.int64)
    norms = (books**2).sum(axis=2)
    for p in range(parts):
        own = x[:, p * wide : (p + 1) * wide]
        near = norms[p] - 2 * (own @ books[p].T)
        codes[:, p] = near.argmin(axis=1)  # the first of equal ones
        errors[:, p] = near[np.arange(n), codes[:, p]] + (own**2).sum(axis=1)
    return codes, errors


def _sums(books: np.ndarray):
    """A task's rows as (part, entry, position, sum of components) and, at position -1, (part, entry, -1, number of parts)."""
    parts, entries, wide = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, wide + 1), np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), parts * wide)
            for at in range(0, len(x), STEP):
                some = x[at : at + STEP]
                codes, _ = assigned(some, books)
                for p in range(parts):
                    np.add.at(total[p, :, :wide], codes[:, p], some[:, p * wide : (p + 1) * wide])
                    total[p, :, wide] += np.bincount(codes[:, p], minlength=entries)
        part, entry = np.nonzero(total[:, :, wide])
        told = total[part, entry]
        place = np.append(np.arange(wide), -1)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part, wide + 1).astype(np.int32)), pa.array(np.repeat(entry, wide + 1).astype(np.int32)), pa.array(np.tile(place, len(part)).astype(np.int32)), pa.array(told.ravel())], names=["part", "entry", "place", "value"])

    return run


def train(rows: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts, entries, width / parts) of usable() rows."""
    wide = width // parts
    first = rows.orderBy(F.col("id").asc_nulls_last(), "vector").select("vector").limit(entries).collect()
    books = np.array([r.vector for r in first], np.int64).reshape(len(first), parts, wide).transpose(1, 0, 2).copy()
    for _ in range(rounds if len(first) else 0):
        told = rows.select("vector").mapInArrow(_sums(books), "part int, entry int, place int, value long").groupBy("part", "entry", "place").agg(F.sum("value").alias("value"))
        got = told.toPandas()  # entries x (width + parts) rows at most
        sums = np.zeros((parts, len(first), wide + 1), np.int64)
        sums[got["part"], got["entry"], got["place"]] = got["value"]  # place -1 is the last one
        used = sums[:, :, wide] > 0
        books[used] = sums[used][:, :wide] // sums[used][:, wide:]
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """usable() rows as (id, label, code, error): code has two hex digits a part."""
    parts, _, wide = books.shape
    kind = rows.select("id", "label").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                some = batch.slice(at, STEP)
                codes, errors = assigned(_matrix(some.column(2), parts * wide), books)
                text = [r.tobytes().hex() for r in codes.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(text, pa.string()), pa.array(errors.sum(axis=1))], names=["id", "label", "code", "error"])

    return rows.select("id", "label", "vector").mapInArrow(run, kind.add("code", "string").add("error", "long"))


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Per vector: vec_id, code, error, label_error (over the rows of its label) and codebooks_sha256. entries: 256 at most."""
    rows, width = usable(vectors, id_col, vector_col, label_col, scale, parts)
    books = train(rows, width or parts, parts, entries, rounds)
    key = F.to_json(F.struct(F.col("label").alias("l")))  # one text for nulls too
    coded = encode(rows, books) if books.shape[1] else rows.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    coded = cut(coded.select(F.col("id").alias("vec_id"), "code", "error", key.alias("key")))
    sums = coded.groupBy("key").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
    return attach(coded, sums, "key", "n").select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
