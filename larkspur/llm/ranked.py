"""Ranked lexical search by an index of two levels.

A term adds w * impact to a document's score, both integers: w falls with the number of documents that hold the term, impact grows with
how often the document holds it and falls with the document's length. The index keeps blocks of documents. Its first level has, by term of a
block, the documents and their impacts as bytes, rounded up to steps of STEP: so a score lies between two bounds that the bytes
alone give. Its second level has the exact counts. A search reads the first level of every block; a task drops what can't reach the
K-th lower bound of its own blocks, then the K-th lower bound over all blocks decides, and each document whose upper bound reaches it
is scored again, exactly, from the second level. Columns of the index are read apart, so the exact counts are read for those blocks only
that are left, after the bounds have done their work.

Items are taken in blocks of at most TERMS terms, which bounds what is sent to the tasks; each block of items is an index and a
search over all documents. The index holds the terms that are asked for.

Edge cases: null and empty texts have no terms, and no score; items without known terms have no rows; weights below zero (terms in over
half of all documents) count, and only scores above 0 are told; equal scores are ordered by id (nulls first), repeated rows take a rank each;
an item row that repeats with the same id and text is one item, ids that repeat with other texts are items of their own; empty
tables give an empty result; very long texts are one document; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from larkspur.llm.common import scratch

K = 10
#: Terms of the items of one block; documents of an index block; words that a task gathers before it closes a block.
TERMS, DOCUMENTS, WORDS = 1 << 18, 4096, 1 << 22
#: Impacts are below a million, so that bytes count steps of a 255th of it.
TOP, STEP = 1_000_000, 3922
#: ASCII letters lower-cased, digits and everything beyond ASCII kept, the rest blank.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    return re.findall(rb"[^ ]+", (text or "").encode("utf-8", "surrogatepass").translate(_FOLD))


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impact(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Of terms that stand tf times in documents of n terms; integers throughout."""
    m = 25 + 75 * n.astype(np.int64) * n_docs // max(n_terms, 1)
    return 1_000_000_000 * tf.astype(np.int64) // (1000 * tf.astype(np.int64) + 8 * m)


def bounds(weights: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the most that weights times impacts can be, where steps are impacts rounded up to STEP."""
    top = steps.astype(np.int64) * STEP
    low = np.where(steps > 0, top - STEP + 1, 0)
    return np.where(weights > 0, weights * low, weights * top), np.where(weights > 0, weights * top, weights * low)


class Asked:
    """A block of items: (id, text) pairs, and the counts of their terms, by number."""

    def __init__(self, items: list[tuple[object, list[bytes]]]) -> None:
        self.ids, self.number = [i for i, _ in items], {}
        self.counts = [Counter(self.number.setdefault(t, len(self.number)) for t in found) for _, found in items]


def _asked(items: DataFrame, id_col: str, text_col: str, most: int) -> Iterator[Asked]:
    """The driver holds one block at a time."""
    held: list[tuple[object, list[bytes]]] = []
    known: set[bytes] = set()
    rows = items.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).dropDuplicates(["i", "t"]).orderBy("i", "t")
    for row in rows.toLocalIterator():
        found = terms(row.t)
        if not found:
            continue
        if held and len(known | set(found)) > most:
            yield Asked(held)
            held, known = [], set()
        held.append((row.i, found))
        known |= set(found)
    if held:
        yield Asked(held)


def _counted(sent):
    """A task's documents as (term, documents that hold it); at -1 the documents with a term, at -2 all terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value.number
        df, n_docs, n_terms = np.zeros(len(number), np.int64), 0, 0
        for batch in batches:
            for text in batch.column(0):
                found = terms(text.as_py())
                n_docs += bool(found)
                n_terms += len(found)
                held = [k for k in map(number.get, set(found)) if k is not None]
                df[held] += 1
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, [-1, -2]).astype(np.int32)), pa.array(np.append(df[some], [n_docs, n_terms]))], names=["term", "n"])

    return run


def _indexed(sent, n_docs: int, n_terms: int, id_kind: pa.DataType):
    """Blocks of the index. By term, from start to the next one's: documents, steps, counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value.number
        ids: list = []
        sizes: list[int] = []
        term: list[np.ndarray] = []
        count: list[np.ndarray] = []
        held = 0

        def block() -> pa.RecordBatch:
            t, tf = np.concatenate(term), np.concatenate(count)
            doc = np.repeat(np.arange(len(ids), dtype=np.uint16), [len(x) for x in term])
            order = np.argsort(t, kind="stable")
            t, tf, doc = t[order], tf[order], doc[order]
            starts = np.flatnonzero(np.diff(t, prepend=-1)) if len(t) else np.zeros(0, np.int64)
            steps = (-(-impact(tf, np.array(sizes)[doc], n_docs, n_terms) // STEP)).astype(np.uint8)
            packed = [t[starts].astype("<i4"), starts.astype("<i4"), doc.astype("<u2"), steps, tf.astype("<u4"), np.array(sizes, "<i8")]
            return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(id_kind)), *(pa.array([x.tobytes()], pa.binary()) for x in packed)], names=["ids", "terms", "starts", "docs", "steps", "counts", "sizes"])

        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                found = terms(text.as_py())
                own = Counter(k for k in map(number.get, found) if k is not None)
                if not own:
                    continue
                ids.append(key.as_py()), sizes.append(len(found))
                term.append(np.fromiter(own.keys(), np.int64, len(own))), count.append(np.fromiter(own.values(), np.int64, len(own)))
                held += len(found)
                if len(ids) >= DOCUMENTS or held >= WORDS:
                    yield block()
                    ids, sizes, term, count, held = [], [], [], [], 0
        if ids:
            yield block()

    return run


def _arrays(batch: pa.RecordBatch, row: int, **kinds: str) -> list[np.ndarray]:
    return [np.frombuffer(batch.column(name)[row].as_py(), kind) for name, kind in kinds.items()]


def _bounded(sent, weights: np.ndarray, k: int):
    """The first level: (item, block, doc, low, high) of the documents that may be among the k best of a task's blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sent.value.counts
        found: list[tuple] = []
        best = [np.empty(0, np.int64)] * len(counts)  # of each item, the k highest lower bounds so far
        for batch in batches:
            for row in range(batch.num_rows):
                term, start, doc, steps = _arrays(batch, row, terms="<i4", starts="<i4", docs="<u2", steps="u1")
                number = batch.column("block")[row].as_py()
                ends, at, n = np.append(start[1:], len(doc)), dict(zip(term.tolist(), range(len(term)), strict=True)), int(doc.max()) + 1
                for item, asked in enumerate(counts):
                    low, high, met = np.zeros(n, np.int64), np.zeros(n, np.int64), False
                    for t, often in asked.items():
                        if (p := at.get(t)) is None:
                            continue
                        own, met = slice(start[p], ends[p]), True
                        a, b = bounds(weights[t] * often, steps[own])
                        low[doc[own]] += a  # a document stands once in a list
                        high[doc[own]] += b
                    if not met:
                        continue
                    best[item] = np.partition(joined := np.append(best[item], low), max(len(joined) - k, 0))[-k:]
                    some = np.flatnonzero((high > 0) & (high >= (best[item].min() if len(best[item]) == k else high.min())))
                    if len(some):
                        found.append((item, number, some, low[some], high[some]))
        out = []
        for item, number, some, low, high in found:
            keep = high >= best[item].min() if len(best[item]) == k else np.ones(len(some), bool)
            out.append((np.full(keep.sum(), item), np.full(keep.sum(), number), some[keep], low[keep], high[keep]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(kind)) for x, kind in zip(zip(*out, strict=True), ("i4", "i8", "i4", "i8", "i8"), strict=True)], names=["item", "block", "doc", "low", "high"])

    return run


def _exact(sent, weights: np.ndarray, n_docs: int, n_terms: int):
    """The second level: (item, id, score) of the (item, doc) pairs that each block comes with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sent.value.counts
        for batch in batches:
            for row in range(batch.num_rows):
                term, start, doc, tf, sizes = _arrays(batch, row, terms="<i4", starts="<i4", docs="<u2", counts="<u4", sizes="<i8")
                ends, at = np.append(start[1:], len(doc)), dict(zip(term.tolist(), range(len(term)), strict=True))
                pairs = batch.column("pairs")[row].values
                items, docs = pairs.field("item").to_numpy(), pairs.field("doc").to_numpy()
                ids = batch.column("ids")[row].values
                for item in np.unique(items).tolist():
                    own = docs[items == item]
                    score = np.zeros(len(sizes), np.int64)
                    for t, often in counts[item].items():
                        if (p := at.get(t)) is not None:
                            d = doc[start[p] : ends[p]]
                            score[d] += weights[t] * often * impact(tf[start[p] : ends[p]], sizes[d], n_docs, n_terms)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), item, np.int32)), ids.take(pa.array(own)), pa.array(score[own])], names=["item", "doc_id", "score"])

    return run


def _ranked(docs: DataFrame, asked: Asked, k: int, item_kind: str) -> DataFrame:
    """docs: id, text."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(asked)
    told = docs.select("text").mapInArrow(_counted(sent), "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    told = {r.term: r.n for r in told.collect()}  # a row a term asked for
    n_docs, n_terms = told.pop(-1, 0), told.pop(-2, 0)
    weights = np.array([weight(n_docs, told.get(t, 0)) for t in range(len(asked.number))], np.int64)
    kind = docs.schema["id"].dataType
    held = StructType([StructField("ids", ArrayType(kind))]).add("terms", "binary").add("starts", "binary").add("docs", "binary").add("steps", "binary").add("counts", "binary").add("sizes", "binary")
    path = scratch(spark, "ranked")
    docs.mapInArrow(_indexed(sent, n_docs, n_terms, to_arrow_type(kind)), held).withColumn("block", F.monotonically_increasing_id()).write.parquet(path)
    index = spark.read.parquet(path)
    near = index.select("block", "terms", "starts", "docs", "steps").mapInArrow(_bounded(sent, weights, k), "item int, block long, doc int, low long, high long")
    lows = near.withColumn("n", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("low")))).where(F.col("n") == k).select("item", F.col("low").alias("least"))
    near = near.join(lows, "item", "left").where(F.coalesce(F.col("high") >= F.col("least"), F.lit(True)))
    pairs = near.groupBy("block").agg(F.collect_list(F.struct("item", "doc")).alias("pairs"))
    scored = index.select("block", "ids", "terms", "starts", "docs", "counts", "sizes").join(pairs, "block").mapInArrow(_exact(sent, weights, n_docs, n_terms), StructType([StructField("item", IntegerType()), StructField("doc_id", kind), StructField("score", LongType())]))
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_first())
    scored = scored.where("score > 0").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    names = spark.createDataFrame(list(enumerate(asked.ids)), f"item int, item_id {item_kind}")
    return scored.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", most: int = TERMS) -> DataFrame:
    """For each item, its k best documents: item_id, rank, doc_id, score."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = items.schema[item_id].dataType.simpleString()
    found = None
    for asked in _asked(items, item_id, item_text, most):
        one = _ranked(rows, asked, k, kind)
        found = one if found is None else found.unionByName(one)
    none = rows.where("false").select(F.lit(None).cast(kind).alias("item_id"), F.lit(0).alias("rank"), F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    return none if found is None else found
