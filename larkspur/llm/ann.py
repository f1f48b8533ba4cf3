"""Nearest neighbours by largest inner product over robust-pruned directed graphs, one for each shard.

Equal vectors are one class with their least ids (as many as an answer can hold), so ties cost nothing and stay exact. Classes
are dealt to shards by hash; shards grow with the square root of the number of classes. A shard's graph grows by insertion: a greedy
beam search from the entry point proposes neighbours, robust pruning keeps a candidate only if no kept one is closer to it by the
factor ALPHA (places left go to the nearest others), and edges back are pruned the same way when a node has too many. For inner
products vectors get one more coordinate that makes all norms equal, which turns them into distances.

Graphs are built once, a task each, and written to the shared folder in chunks. A unit of the search is one shard and one block of
queries: its task reads the shard's chunks and beam searches the graph for each query. Candidates are scored again on the original
vectors in double precision, and the best of all shards win. The beam is the same however many shards there are. A shard's queries are cut into
blocks only where there are fewer shards than task slots, so a graph is sent about slots / shards times, whatever the number of queries. The cost
is queries times shards, each search growing with the logarithm of a shard.

Edge cases: vectors that are null, empty or zero, or that hold null or non-finite components, take no part, nor do rows with a
null id or with another length than the most common one; repeated rows count once; fewer candidates than k give all of them; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import cut

K, DEGREE, BUILD_BEAM, ALPHA, BLOCK = 20, 32, 64, 1.2, 256
#: Classes of a shard: GROWTH times the square root of all, within these bounds and so many bytes of vectors.
GROWTH, SHARD, SHARD_MOST, SHARD_BYTES = 16, 4096, 1 << 14, 1 << 28
#: Nodes that a search step opens; classes of a chunk; the beam.
OPEN, CHUNK, BEAM = 4, 2048, 96


class Graph:
    """A directed graph over points of equal norm. out: neighbours of each point, -1 where there is none."""

    def __init__(self, vectors: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, built: tuple[np.ndarray, int] | None = None) -> None:
        norms = (vectors.astype(np.float64) ** 2).sum(axis=1)
        lifted = np.sqrt(np.maximum(norms.max() - norms, 0))
        self.points = np.concatenate([vectors, lifted[:, None]], axis=1).astype(np.float32)
        self.norm, self.degree, self.alpha = float(norms.max()), degree, alpha
        if built:
            self.out, self.entry = built
            return
        n = len(vectors)
        self.out = np.full((n, degree), -1, np.int32)
        mean = self.points.mean(axis=0)
        self.entry = int(np.argmax(self.points @ mean))
        order = np.random.default_rng(0).permutation(n)
        order = np.concatenate([[self.entry], order[order != self.entry]])
        at, step = 1, 16
        while at < n:  # batches grow with the graph
            self._insert(order[at : at + step], beam)
            at += step
            step = min(BLOCK, at)
        for k in range(0, n, BLOCK):  # a second pass, over the whole graph
            self._insert(order[k : k + BLOCK], beam)

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and similarities of the best `beam` points found for each query, best first; id -1 where there are fewer."""
        b, rows = len(queries), np.arange(len(queries))
        ids, done = np.full((b, beam), -1, np.int32), np.ones((b, beam), bool)
        sims = np.full((b, beam), -np.inf, np.float32)
        ids[:, 0], done[:, 0], sims[:, 0] = self.entry, False, queries @ self.points[self.entry]
        seen = np.zeros((b, len(self.points)), bool)
        seen[:, self.entry] = True
        live = rows
        while len(live):
            # beams are sorted, so the first open places are the best
            pick = np.argsort(done[live], axis=1, kind="stable")[:, : min(OPEN, beam)]
            node = np.take_along_axis(ids[live], pick, 1)
            node = np.where(np.take_along_axis(done[live], pick, 1), -1, node)
            done[live[:, None], pick] = True
            near = np.where(node[:, :, None] >= 0, self.out[node], -1).reshape(len(live), -1)
            near.sort(axis=1)
            fresh = (near >= 0) & ~seen[live[:, None], near]
            fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
            r, c = np.nonzero(fresh)
            if len(r):
                found = near[r, c]
                seen[live[r], found] = True
                sim = np.full(near.shape, -np.inf, np.float32)
                sim[r, c] = np.einsum("ij,ij->i", self.points[found], queries[live[r]])
                some = np.unique(r)
                to = live[some]
                all_sims = np.concatenate([sims[to], sim[some]], axis=1)
                all_ids = np.concatenate([ids[to], near[some]], axis=1)
                all_done = np.concatenate([done[to], ~fresh[some]], axis=1)
                best = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
                sims[to], ids[to], done[to] = (np.take_along_axis(x, best, axis=1) for x in (all_sims, all_ids, all_done))
                done[to] |= np.isneginf(sims[to])
                ids[to] = np.where(np.isneginf(sims[to]), -1, ids[to])
            live = live[~done[live].all(axis=1)]
        return ids, sims

    def _prune(self, nodes: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """Robust pruning: of each node's candidates (-1: none; repeats are fine), at most `degree`, nearest first."""
        b, c = candidates.shape
        points = self.points[candidates]
        sim = np.einsum("ijk,ik->ij", points, self.points[nodes])
        far = np.maximum(2 * (self.norm - sim), 0)
        far[(candidates < 0) | (candidates == nodes[:, None])] = np.inf
        order = np.argsort(far, axis=1, kind="stable")
        candidates, far, points = np.take_along_axis(candidates, order, 1), np.take_along_axis(far, order, 1), np.take_along_axis(points, order[:, :, None], 1)
        between = np.maximum(2 * (self.norm - points @ points.transpose(0, 2, 1)), 0)
        alive, out, rows = np.isfinite(far), np.full((b, self.degree), -1, np.int32), np.arange(b)
        for k in range(self.degree):
            some = alive.any(axis=1)
            if not some.any():
                break
            pick = np.argmax(alive, axis=1)
            out[:, k] = np.where(some, candidates[rows, pick], -1)
            # distances are squared, and so is the factor; a point is never further from itself, which removes repeats
            alive &= ~((self.alpha**2 * between[rows, pick] <= far) | (candidates == candidates[rows, pick][:, None])) | ~some[:, None]
            alive[rows, pick] = False
        # free places go to the nearest candidates that were pruned
        kept = (candidates[:, :, None] == out[:, None, :]).any(axis=2) | ~np.isfinite(far)
        kept[:, 1:] |= candidates[:, 1:] == candidates[:, :-1]
        rest, free = np.argsort(kept, axis=1, kind="stable")[:, : self.degree], (out >= 0).sum(axis=1)
        r, c = np.nonzero((np.arange(rest.shape[1]) < np.minimum(self.degree - free, (~kept).sum(axis=1))[:, None]))
        out[r, free[r] + c] = candidates[r, rest[r, c]]
        return out

    def _insert(self, nodes: np.ndarray, beam: int) -> None:
        found, _ = self.search(self.points[nodes], beam)
        self.out[nodes] = self._prune(nodes, np.concatenate([found, self.out[nodes]], axis=1))
        # edges back
        src = np.repeat(nodes, self.degree).astype(np.int32)
        dst = self.out[nodes].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        to, first, size = np.unique(dst, return_index=True, return_counts=True)
        for lo in range(0, len(to), BLOCK):
            part, f, s = to[lo : lo + BLOCK], first[lo : lo + BLOCK], size[lo : lo + BLOCK]
            wide = np.full((len(part), int(s.max())), -1, np.int32)
            col = np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s)
            wide[np.repeat(np.arange(len(part)), s), col] = src[np.repeat(f, s) + col]
            old = self.out[part]
            room = (old < 0).sum(axis=1)
            new = (wide >= 0) & ~(wide[:, :, None] == old[:, None, :]).any(axis=2)
            easy = new.sum(axis=1) <= room
            for k in np.flatnonzero(easy):
                add = wide[k][new[k]]
                if len(add):
                    have = self.degree - room[k]
                    self.out[part[k], have : have + len(add)] = add
            hard = np.flatnonzero(~easy)
            if len(hard):
                self.out[part[hard]] = self._prune(part[hard], np.concatenate([old[hard], wide[hard]], axis=1))


def _stacked(column: pa.Array) -> np.ndarray:
    return np.stack(column.to_numpy(zero_copy_only=False)).astype(np.float64)


def _runs(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
    return ((lo, hi) for lo, hi in zip(cuts, cuts[1:], strict=False) if hi > lo)


_CHUNK = pa.schema([("shard", pa.int32()), ("at", pa.int32()), ("entry", pa.int32()), ("width", pa.int32()), ("vectors", pa.binary()), ("out", pa.binary()), ("ids", pa.list_(pa.list_(pa.int64())))])
_CHUNK_DDL = "shard int, at int, entry int, width int, vectors binary, out binary, ids array<array<long>>"


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of the graphs of shards, whose classes come together."""
    shard, vectors, ids = None, [], []

    def chunks() -> Iterator[pa.RecordBatch]:
        matrix = np.concatenate(vectors)
        graph = Graph(matrix)
        for at in range(0, len(matrix), CHUNK):
            part = slice(at, at + CHUNK)
            yield pa.RecordBatch.from_pylist([{"shard": shard, "at": at, "entry": graph.entry, "width": matrix.shape[1], "vectors": matrix[part].tobytes(), "out": graph.out[part].tobytes(), "ids": ids[part]}], schema=_CHUNK)

    for batch in batches:
        numbers = batch.column("shard").to_numpy()
        for lo, hi in _runs(numbers):
            if numbers[lo] != shard:
                if vectors:
                    yield from chunks()
                shard, vectors, ids = int(numbers[lo]), [], []
            vectors.append(_stacked(batch.column("vector").slice(lo, hi - lo)))
            ids += batch.column("ids").slice(lo, hi - lo).to_pylist()
    if vectors:
        yield from chunks()


def _searched(k: int, beam: int):
    """Answers of units, whose chunks (at >= 0) come together and before their queries (at -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, graph, held, ids = None, None, [], []
        matrix = np.empty((0, 0))

        def found(queries: pa.RecordBatch) -> pa.RecordBatch:
            q = _stacked(queries.column("vector"))
            own = queries.column("id").to_pylist()
            got, _ = graph.search(np.concatenate([q, np.zeros((len(q), 1))], axis=1).astype(np.float32), beam)
            safe = np.maximum(got, 0)
            score = np.where(got < 0, -np.inf, np.einsum("ijk,ik->ij", matrix[safe], q))
            best = np.argsort(-score, axis=1, kind="stable")
            out: tuple[list, list, list, list] = ([], [], [], [])
            for r, query in enumerate(own):
                rows: list[tuple[float, int]] = []
                for c in best[r]:
                    if got[r, c] < 0 or len(rows) >= k and -score[r, c] > rows[-1][0]:
                        break
                    rows += [(-float(score[r, c]), i) for i in ids[got[r, c]] if i != query]
                    if len(rows) >= k:
                        rows = sorted(rows)[:k]
                rows.sort()
                for s, i in rows:
                    out[0].append(query), out[1].append(r), out[2].append(i), out[3].append(-s)
            key = queries.column("key").to_pylist()
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array([key[r] for r in out[1]], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.float64())], names=["query_id", "key", "vec_id", "score"])

        for batch in batches:
            units, queries = batch.column("unit").to_numpy(), batch.column("at").to_numpy() < 0
            for lo, hi in _runs(2 * units + queries):
                part = batch.slice(lo, hi - lo)
                if units[lo] != unit:
                    unit, graph, held, ids = units[lo], None, [], []
                if not queries[lo]:
                    held += part.select(["entry", "width", "vectors", "out"]).to_pylist()
                    ids += [i for chunk in part.column("ids").to_pylist() for i in chunk]
                    continue
                if graph is None:
                    if not held:
                        continue
                    matrix = np.frombuffer(b"".join(c["vectors"] for c in held), np.float64).reshape(-1, held[0]["width"])
                    out = np.frombuffer(b"".join(c["out"] for c in held), np.int32).reshape(len(matrix), -1)
                    graph, held = Graph(matrix, built=(out, held[0]["entry"])), []
                for at in range(0, hi - lo, BLOCK):
                    yield found(part.slice(at, BLOCK))

    return run


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(fine, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def nearest(vectors: DataFrame, queries: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", shard: int | None = None, beam: int = BEAM, blocks: int | None = None) -> DataFrame:
    """For the rows for which `queries` holds: query_id, rank, vec_id and score of the k nearest other rows. blocks: of each shard's queries; by default
as many as give each task slot two units."""
    vector = F.col(vector_col).cast("array<double>")
    rows = vectors.where(F.col(id_col).isNotNull() & usable(vector)).select(F.col(id_col).cast("long").alias("id"), vector.alias("vector"), queries.alias("asks"))
    widths = rows.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), "width").limit(1).collect()
    width = widths[0].width if widths else 1
    rows = rows.where(F.size("vector") == width)
    # of equal vectors, no answer holds more than the k + 1 least ids
    least = Window.partitionBy("vector").orderBy("id")
    classes = rows.withColumn("n", F.dense_rank().over(least)).where(F.col("n") <= k + 1).groupBy("vector").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    classes = cut(classes)
    key = F.xxhash64("vector")
    asked = cut(rows.where("asks").select("id", key.alias("key"), "vector").dropDuplicates(["id", "key"]))
    n, n_asked = classes.count(), asked.count()
    size = shard or int(min(max(SHARD, GROWTH * math.sqrt(n)), SHARD_MOST, max(SHARD_BYTES // (8 * width), 1)))
    shards, beam = max(1, -(-n // size)), max(beam, k + 1)
    blocks = blocks or max(1, min(-(-n_asked // BLOCK), -(-2 * vectors.sparkSession.sparkContext.defaultParallelism // shards)))
    held = classes.select(F.pmod(key, F.lit(shards)).cast("int").alias("shard"), key.alias("key"), "ids", "vector")
    graphs = held.repartition(2 * shards, "shard").sortWithinPartitions("shard", "key", "vector").select("shard", "ids", "vector").mapInArrow(_built, _CHUNK_DDL)
    graphs = cut(graphs)
    unit = lambda number, part: (F.col(number).cast("long") * blocks + F.col(part)).alias("unit")
    none = {"id": F.lit(None).cast("long"), "key": F.lit(None).cast("long"), "vector": F.lit(None).cast("array<double>")}
    chunks = graphs.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(unit("shard", "part"), "at", "entry", "width", "vectors", "out", "ids", *(c.alias(name) for name, c in none.items()))
    dealt = asked.withColumn("part", F.pmod(F.xxhash64("key", "id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    blank = {"at": F.lit(-1), "entry": F.lit(None).cast("int"), "width": F.lit(None).cast("int"), "vectors": F.lit(None).cast("binary"), "out": F.lit(None).cast("binary"), "ids": F.lit(None).cast("array<array<long>>")}
    dealt = dealt.select(unit("shard", "part"), *(c.alias(name) for name, c in blank.items()), "id", "key", "vector")
    units = chunks.unionByName(dealt).repartition(2 * shards * blocks, "unit").sortWithinPartitions("unit", F.col("at") < 0, "at", "key", "id")
    found = units.mapInArrow(_searched(k, beam), "query_id long, key long, vec_id long, score double")
    best = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
