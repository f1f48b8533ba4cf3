"""SimHash fingerprints and exact Hamming neighbours over vantage-point trees.

Fingerprints are made in one pass. Distinct ones (classes) are then routed down a vantage-point tree: each node sends a
fingerprint to its near side (distance to the vantage point at most the cut) or its far side. By the triangle bound two
fingerprints within radius r on different sides are less than r beyond the cut, so far ones within that band go to the
near side too, and every pair meets in at least one shard. A shard searches itself by a tree of the same kind and gives
back a spanning forest of its links, never all pairs; connected components join the forests.

Dense clusters, which no vantage point parts, are linked through middles: two fingerprints differ in at most two bits just if some
value differs in at most one bit from each, so those that share one of their 65 middles are linked. Inside a shard that is a sort;
a shard that grows beyond MOST classes is left to a grouping by middle, where no group has more than 65 members.

Edge cases: null and blank texts have fingerprint zero and link like any other; repeated rows are separate rows of one
class; null document ids take part but never become a component's id unless all its ids are null; an empty table gives
an empty result; other columns are ignored. keep_one() tells rows of one id apart, so no component goes without a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from larkspur.llm.common import attach, cut, row_key, unused
from larkspur.llm.tokens import _texts

#: Words of a shingle, hash seed and linking radius.
WORDS, SEED, RADIUS = 3, 42, 2
#: The tree has leaves of about SHARD classes. It is fitted on about PER_LEAF distinct fingerprints for each leaf, picked by a
#: hash, and on SAMPLE at most; it decides speed alone, never results.
SAMPLE, PER_LEAF, SHARD, LEAF = 1 << 20, 2048, 1 << 17, 256
#: Classes of a shard at most, beyond which it is linked by middles; codes sorted at once.
MOST, CODES = 1 << 20, 1 << 22
_FLIPS = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)])

_BITS = (((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.uint8) @ (np.uint64(1) << np.arange(0, 64, 8, dtype=np.uint64)).astype(object)).astype(np.uint64)


def hashes(text: str | None, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle of a text whose ASCII letters are lower-cased; repeats stay."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    shingles = map(b" ".join, zip(*(found[k:] for k in range(words)), strict=False)) if len(found) >= words else [b" ".join(found)]
    return np.fromiter(map(xxh64_intdigest, shingles, repeat(seed)), np.uint64, max(1, len(found) - words + 1))


def majority(groups: list[np.ndarray]) -> np.ndarray:
    """Of each group of hashes, the bits that are set in over half of them."""
    sizes = np.array([len(g) for g in groups], np.int64)
    out, full = np.zeros(len(groups), np.uint64), np.flatnonzero(sizes)
    if not len(full):
        return out
    data, ends = np.concatenate([groups[k] for k in full]), np.cumsum(sizes[full])
    starts = ends - sizes[full]
    # counts in byte lanes hold for runs of up to 255
    pieces = -(-sizes[full] // 255)
    first = np.cumsum(pieces) - pieces
    cuts = np.repeat(starts, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(first, pieces))
    lanes = np.add.reduceat(_BITS[data.view(np.uint8).reshape(-1, 8)], cuts, axis=0)
    counts = np.add.reduceat(lanes.view(np.uint8).reshape(len(lanes), 64).astype(np.int64), first, axis=0)
    bits = (2 * counts > sizes[full][:, None]).astype(np.uint8)
    out[full] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def _fingerprint_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        small = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows), pa.int64()), batch.column(2)], names=["k", "text"])
        for at, texts in _texts(iter([small]), 1 << 20):
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(at[0], len(at)) for c in (0, 1)), pa.array(majority([hashes(t) for t in texts]).view(np.int64))], names=["doc_id", "key", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: Column | None = None) -> DataFrame:
    """doc_id, key (what tells rows of one id apart, if given) and fp (64 bits as a signed long)."""
    own = F.lit(None).cast("long") if key is None else key
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), own.alias("key"), F.col(text_col).alias("text")).mapInArrow(_fingerprint_rows, "doc_id long, key long, fp long")


def _split(points: np.ndarray, vantage: np.uint64, radius: int) -> tuple[np.ndarray, int]:
    far = np.bitwise_count(points ^ vantage).astype(np.int64)
    counts = np.bincount(far, minlength=65)
    below = np.cumsum(counts)
    # the cut that leaves the larger side, band included, smallest
    near = below[np.minimum(np.arange(65) + radius, 64)]
    return far, int(np.argmin(np.maximum(near, len(points) - below)))


class Tree:
    """A vantage-point tree as flat arrays. Children below zero are leaves: -1 - number of the leaf."""

    def __init__(self, sample: np.ndarray, leaves: int, radius: int = RADIUS) -> None:
        self.radius, self.vantage, self.cut, self.near, self.far, self.leaves = radius, [], [], [], [], 0
        rng = np.random.default_rng(0)
        self.root = self._grow(sample, max(8, len(sample) // max(1, leaves)), rng)

    def _grow(self, points: np.ndarray, least: int, rng: np.random.Generator) -> int:
        best = None
        if len(points) > least:
            options = np.concatenate([rng.choice(points, 8), rng.integers(0, 1 << 64, 8, np.uint64)])
            for v in options:
                d, at = _split(points, v, self.radius)
                size = max(int((d <= at + self.radius).sum()), int((d > at).sum()))
                if best is None or size < best[0]:
                    best = (size, v, d, at)
        if best is None or best[0] > 0.95 * len(points):
            self.leaves += 1
            return -self.leaves
        _, v, d, at = best
        node = len(self.vantage)
        self.vantage.append(v), self.cut.append(at), self.near.append(0), self.far.append(0)
        self.near[node] = self._grow(points[d <= at + self.radius], least, rng)
        self.far[node] = self._grow(points[d > at], least, rng)
        return node

    def route(self, points: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, points that it has to hold)."""
        stack = [(self.root, points)]
        while stack:
            node, held = stack.pop()
            if not len(held):
                continue
            if node < 0:
                yield -1 - node, held
                continue
            d = np.bitwise_count(held ^ self.vantage[node])
            stack += [(self.near[node], held[d <= self.cut[node] + self.radius]), (self.far[node], held[d > self.cut[node]])]


def _middles(points: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs that link distinct fingerprints within two bits: neighbours in the order of the middles. Codes are taken by
    parts, so that memory is bounded."""
    parts = -(-65 * len(points) // CODES)
    for part in range(parts):
        codes, owners = [], []
        for flip in _FLIPS:
            code = points ^ flip
            own = np.flatnonzero((code * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(parts) == part)
            codes.append(code[own]), owners.append(own)
        code, owner = np.concatenate(codes), np.concatenate(owners)
        order = np.argsort(code, kind="stable")
        code, owner = code[order], owner[order]
        same = code[1:] == code[:-1]
        yield owner[:-1][same], owner[1:][same]


def forest(points: np.ndarray, radius: int = RADIUS, leaf: int = LEAF) -> np.ndarray:
    """For each of some distinct fingerprints, the index of the root of its linked set within them."""
    parent = np.arange(len(points))
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def link(a: np.ndarray, b: np.ndarray, now: bool = False) -> None:
        nonlocal parent, waiting, size
        waiting.append((a, b))
        size += len(a)
        if size < len(points) and not now:
            return
        a, b = (np.concatenate(x) for x in zip(*waiting, strict=True))
        waiting, size = [], 0
        while len(a):
            a, b = parent[a], parent[b]
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
            while (parent != (up := parent[parent])).any():
                parent = up

    stack = [np.arange(len(points))]
    while stack:
        held = stack.pop()
        here = points[held]
        if len(held) > leaf:
            # the best of a few vantage points; one that hardly parts the points (a dense cluster) doesn't help
            tried = [(_split(here, here[k], radius), here[k]) for k in np.linspace(0, len(here) - 1, 4).astype(int)]
            d, at = min((t[0] for t in tried), key=lambda t: max((t[0] <= t[1] + radius).sum(), (t[0] > t[1]).sum()))
            near, far = held[d <= at + radius], held[d > at]
            if max(len(near), len(far)) < 0.9 * len(held):
                stack += [near, far]
                continue
            if radius == 2:
                for a, b in _middles(here):
                    link(held[a], held[b])
                continue
        for lo in range(0, len(held), leaf):
            # a block of rows against itself and all that follow
            close = np.bitwise_count(here[lo : lo + leaf, None] ^ here[None, lo:]) <= radius
            a, b = np.nonzero(close)
            link(held[lo + a[a < b]], held[lo + b[a < b]])
    link(np.empty(0, np.int64), np.empty(0, np.int64), now=True)
    return parent


def _forest_rows(radius: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        points = np.unique(pdf["fp"].to_numpy().view(np.uint64))
        root = forest(points, radius)
        linked = np.flatnonzero(root != np.arange(len(points)))
        return pd.DataFrame({"a": points[linked].view(np.int64), "b": points[root[linked]].view(np.int64)})

    return run


def by_middles(classes: DataFrame) -> DataFrame:
    """Edges (a, b) of radius two between distinct fingerprints (fp): each with the least that shares a middle."""
    flips = F.array(*(F.lit(int(f)) for f in _FLIPS.view(np.int64)))
    codes = classes.select("fp", F.explode(F.transform(flips, lambda f: F.col("fp").bitwiseXOR(f))).alias("code"))
    least = codes.groupBy("code").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low != high")
    return codes.join(least.hint("merge"), "code").where("fp != low").select(F.col("fp").alias("a"), F.col("low").alias("b")).distinct()


def links(classes: DataFrame, radius: int = RADIUS, sample: int = SAMPLE, shard: int = SHARD, most: int = MOST) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (fp) that connect just those that chains of links connect."""
    n = max(classes.count(), 1)
    leaves = -(-n // shard)
    part = min(1.0, min(sample, PER_LEAF * leaves) / n) if leaves > 1 else 0.0
    picked = classes.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int(part * (1 << 30))).select("fp").toPandas()
    tree = Tree(np.sort(picked["fp"].to_numpy(np.int64)).view(np.uint64), leaves, radius)

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, held in tree.route(batch.column(0).to_numpy().view(np.uint64)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), number, np.int32)), pa.array(held.view(np.int64))], names=["shard", "fp"])

    dealt = classes.select("fp").mapInArrow(routed, "shard int, fp long")
    big: list[int] = []
    if n > most and radius == 2:  # fewer classes than that are within it in any case
        dealt = cut(dealt)
        big = [r.shard for r in dealt.groupBy("shard").count().where(F.col("count") > most).collect()]
    found = dealt.where(~F.col("shard").isin(big)).groupBy("shard").applyInPandas(_forest_rows(radius), "a long, b long")
    return found.unionByName(by_middles(dealt.where(F.col("shard").isin(big)).select("fp").distinct())) if big else found


def components(edges: DataFrame) -> DataFrame:
    """node, root of all nodes in edges (a, b), roots being equal within a connected component and nowhere else.

    Contraction: each node joins its least neighbour, edges move to what their ends have joined, and so on until no edge is
    left. The order is another each round (bits flipped by a constant), so that paths halve as stars do.
    """
    edges, steps, flip = cut(edges.distinct()), [], 0
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).union(edges.select("b", "a"))
        key = lambda c: F.col(c).bitwiseXOR(F.lit(flip))  # noqa: B023, E731
        step = cut(both.groupBy("node").agg(F.min(key("to")).alias("to")).select("node", F.least(key("node"), "to").bitwiseXOR(F.lit(flip)).alias("up")))
        steps.append(step)
        moved = edges.join(step.select(F.col("node").alias("a"), F.col("up").alias("ua")), "a").join(step.select(F.col("node").alias("b"), F.col("up").alias("ub")), "b")
        edges = cut(moved.where("ua != ub").select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct())
        flip = (flip * 6364136223846793005 + 1442695040888963407) % (1 << 63)
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = steps[0].select("node", F.col("up").alias("root"))
    for step in steps[1:]:
        found = found.join(step.select(F.col("node").alias("root"), "up"), "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    return found


def _grouped(rows: DataFrame, radius: int, low: Column) -> DataFrame:
    """rows (with fp) with low, the least of all rows that links connect with each; `low` is an aggregate that finds it."""
    classes = cut(rows.groupBy("fp").agg(low.alias("low"), F.count(F.lit(1)).alias("n")))
    roots = cut(components(links(classes, radius)))
    lowest = roots.join(classes.select(F.col("fp").alias("node"), "low"), "node").groupBy("root").agg(F.min("low").alias("least"), F.count(F.lit(1)).alias("n"))
    moved = attach(roots, lowest, "root", "n").select(F.col("node").alias("fp"), "least")
    named = classes.join(moved, "fp", "left").select("fp", F.coalesce("least", "low").alias("low"), "n")
    return attach(rows, named, "fp", "n")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id: the smallest id among all documents that links connect with this one."""
    rows = cut(fingerprints(docs, id_col, text_col).select("doc_id", "fp"))
    return _grouped(rows, radius, F.min("doc_id")).select("doc_id", "fp", F.col("low").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row of each component, all columns as they were: that with the smallest id, nulls last, and of rows with one id that with
    the least hash. Equal rows are one."""
    own, once = unused(docs.columns, "__key"), unused(docs.columns, "__once")
    # equal rows become one in each task before they meet in any; the key is the row's and the id's, so that this and the join share one shuffle
    keyed = docs.withColumn(own, F.struct(row_key(docs).alias("key"), F.col(id_col).cast("long").alias("doc_id"))).dropDuplicates([own])
    rows = cut(fingerprints(docs.withColumn(own, row_key(docs)), id_col, text_col, F.col(own)))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("key").alias("key"))
    kept = _grouped(rows, radius, F.min(rank)).where(F.col("doc_id").eqNullSafe(F.col("low.id")) & (F.col("key") == F.col("low.key"))).select(F.struct("key", "doc_id").alias(once)).distinct()
    return keyed.join(kept, F.col(own) == F.col(once), "left_semi").select(*docs.columns)
