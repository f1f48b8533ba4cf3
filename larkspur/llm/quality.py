"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(b + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j); the pairwise part is half of (sum_i v_i x_i)^2 - sum_i
(v_i x_i)^2, so a document is scored in time linear in its features. Features of a whole text: word counts hashed into
BUCKETS (square roots, of unit length), and statistics of its structure and size; beside them, two for each metadata column that
the caller names: its size, and whether it is missing. The model is fitted on at most SAMPLE labelled ids, taken in the order of a
hash of the ids, one row each; the features of those rows are what comes to the driver.

Edge cases: null texts count as empty; empty texts get a score from the statistics alone; metadata that is null or no finite number
is missing; null labels or ids train nothing; of rows that share an id the one whose text and metadata have the least hash trains, and an id
with both labels counts as 1; repeated rows are scored one by one; without labels, or with one class only, every
score is the share of ones (1/2 without any); other columns, whatever their names, are ignored by score() and kept by keep().
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from larkspur.llm.common import unused

#: Labelled rows to fit on at most; hash buckets, rank of the interactions, passes over the sample and rate.
SAMPLE, BUCKETS, RANK, EPOCHS, RATE = 12_000, 1 << 14, 8, 8, 0.05
STATISTICS = ("log_chars", "log_words", "word_length", "distinct", "top_word", "upper", "digit", "marks", "odd_marks", "stops", "bars", "lines", "line_repeats", "pair_repeats", "beyond_ascii", "capitals", "long_words")


def statistics(raw: bytes, text: str, found: list[bytes], counts: Counter) -> list[float]:
    """Numbers about a text's structure and size, each of order 1."""
    n, chars = max(len(found), 1), max(len(raw), 1)
    plain = raw.translate(None, b"abcdefghijklmnopqrstuvwxyz \n")
    upper = len(plain) - len(plain.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digit = len(plain) - len(plain.translate(None, b"0123456789"))
    odd = len(plain) - len(plain.translate(None, b"#$%&*+<=>@^_`{|}~!\\"))
    marks = len(plain) - len(plain.translate(None, b".,;:'\"()-?/"))
    lines = raw.split(b"\n")
    pairs = len(set(zip(found, found[1:], strict=False)))
    return [
        math.log1p(len(text)) / 5, math.log1p(len(found)) / 4, min(chars / n, 40) / 8, len(counts) / n, max(counts.values(), default=0) / n, 10 * upper / chars, 10 * digit / chars, 10 * marks / chars, 20 * odd / chars,
        20 * (raw.count(b". ") + raw.count(b".\n") + raw.endswith(b".")) / n, 20 * raw.count(b"|") / n, 20 * len(lines) / n, 1 - len(set(lines)) / len(lines), 1 - pairs / max(len(found) - 1, 1) if len(found) > 1 else 0.0,
        5 * (len(raw) - len(text)) / chars, sum(w[:1].isupper() for w in found) / n, sum(len(w) > 14 for w in counts) / max(len(counts), 1),
    ]


def _about(metadata: Sequence[float | None]) -> list[float]:
    told = [x is not None and math.isfinite(x) for x in metadata]
    return [f for x, ok in zip(metadata, told, strict=True) for f in ((math.copysign(math.log1p(abs(x)), x) / 5, 0.0) if ok else (0.0, 1.0))]


def features(text: str | None, metadata: Sequence[float | None] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values; the first len(STATISTICS) + 2 len(metadata) indices are statistics, raw."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    found = raw.split()
    counts = Counter(found)
    folded: Counter = Counter()
    for word, k in counts.items():
        folded[zlib.crc32(word.strip(b".,").lower()) % BUCKETS] += k
    values = np.sqrt(np.fromiter(folded.values(), np.float32, len(folded)))
    values /= max(float(np.sqrt((values**2).sum())), 1.0)
    numbers = np.array(statistics(raw, text, found, counts) + _about(metadata), np.float32)
    where = np.concatenate([np.arange(len(numbers)), np.fromiter(folded.keys(), np.int64, len(folded)) + len(numbers)])
    return where, np.concatenate([numbers, values])


class Machine:
    """The fitted model. Statistics are shifted and scaled by the sample's means and deviations, and clipped."""

    def __init__(self, metadata: int = 0) -> None:
        self.raw = len(STATISTICS) + 2 * metadata
        n = self.raw + BUCKETS
        self.bias, self.linear = 0.0, np.zeros(n, np.float32)
        self.factors = np.random.default_rng(7).normal(0, 0.01, (n, RANK)).astype(np.float32)
        self.mean, self.scale = np.zeros(self.raw, np.float32), np.ones(self.raw, np.float32)

    def scaled(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Indices, values and row starts of some rows, end to end."""
        k = self.raw
        values = [np.concatenate([np.clip((v[:k] - self.mean) / self.scale, -4, 4) / 4, v[k:]]) for _, v in rows]
        sizes = np.array([len(v) for v in values])
        return np.concatenate([i for i, _ in rows]), np.concatenate(values).astype(np.float32), np.cumsum(sizes) - sizes

    def margin(self, where: np.ndarray, values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        inner = self.factors[where] * values[:, None]
        total = np.add.reduceat(inner, starts, axis=0)
        pairs = 0.5 * ((total**2).sum(axis=1) - np.add.reduceat((inner**2).sum(axis=1), starts))
        return self.bias + np.add.reduceat(self.linear[where] * values, starts) + pairs, inner, total

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE) -> Machine:
        if not len(rows):
            self.factors[:] = 0
            return self
        share = float(np.clip(labels.mean(), 1e-4, 1 - 1e-4))
        self.bias = math.log(share / (1 - share))
        if labels.min() == labels.max():
            self.factors[:] = 0
            return self
        stats = np.stack([v[: self.raw] for _, v in rows])
        self.mean, self.scale = stats.mean(axis=0), np.maximum(stats.std(axis=0), 1e-3)
        rng, seen, seen_v, seen_b = np.random.default_rng(11), np.full(len(self.linear), 1e-6, np.float32), np.full(len(self.linear), 1e-6, np.float32), 1e-6
        batch = max(16, min(256, len(rows) // 16))
        steps = max(epochs, -(-400 * batch // len(rows)))  # small samples are passed over more often
        for _ in range(steps):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), batch):
                part = order[at : at + batch]
                where, values, starts = self.scaled([rows[k] for k in part])
                z, inner, total = self.margin(where, values, starts)
                wrong = (1 / (1 + np.exp(-z)) - labels[part]) / len(part)
                each = np.repeat(wrong, np.diff(np.append(starts, len(where)))).astype(np.float32)
                own = np.repeat(np.arange(len(part)), np.diff(np.append(starts, len(where))))
                used, to = np.unique(where, return_inverse=True)
                g = np.bincount(to, each * values, len(used)).astype(np.float32) + 1e-5 * self.linear[used]
                gv = (each * values)[:, None] * (total[own] - inner)
                gv = np.stack([np.bincount(to, gv[:, f], len(used)) for f in range(RANK)], axis=1).astype(np.float32) + 1e-4 * self.factors[used]
                seen[used] += g**2
                seen_v[used] += (gv**2).mean(axis=1)
                self.linear[used] -= rate * g / np.sqrt(seen[used])
                self.factors[used] -= 0.2 * rate * gv / np.sqrt(seen_v[used])[:, None]
                seen_b += float(wrong.sum()) ** 2
                self.bias -= rate * float(wrong.sum()) / math.sqrt(seen_b)
        return self

    def scores(self, texts: list[str | None], metadata: list[tuple]) -> np.ndarray:
        z, _, _ = self.margin(*self.scaled([features(t, m) for t, m in zip(texts, metadata, strict=True)]))
        return 1 / (1 + np.exp(-z.astype(np.float64)))


def _remainder(id_col: str):
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(3))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, metadata: Sequence[str] = ()) -> Machine:
    """Fits on labelled rows with crc32(id) mod 3 other than 1. metadata: names of numeric columns."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (_remainder(id_col) != 1)).select(F.col(id_col).cast("long").alias("__id"), F.col(label_col).cast("int").alias("label"))
    known = known.groupBy("__id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("__id"), "__id").limit(sample)
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("text"), _numbers(metadata).alias("about")).join(F.broadcast(known), "__id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [features(t, m) for t, m in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([i.astype("<i4").tobytes() for i, _ in found], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in found], pa.binary())], names=["id", "label", "i", "v"])

    # one row an id, found by hashes alone, so that neither many rows of one id nor their order matter
    own = rows.withColumn("own", F.struct(F.xxhash64("text", "about").alias("a"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("b")))
    least = own.groupBy("__id").agg(F.min("own").alias("own"))
    rows = own.join(F.broadcast(least), ["__id", "own"]).groupBy("__id").agg(F.first("label").alias("label"), F.first("text").alias("text"), F.first("about").alias("about"))
    got = rows.select("__id", "label", "text", "about").mapInArrow(run, "id long, label int, i binary, v binary").toPandas()
    got = got.sort_values("id")
    return Machine(len(metadata)).fit([(np.frombuffer(i, "<i4").astype(np.int64), np.frombuffer(v, "<f4")) for i, v in zip(got["i"], got["v"], strict=True)], got["label"].to_numpy(np.float32))


def _numbers(names: Sequence[str]) -> Column:
    return F.array(*(F.col(n).try_cast("double") for n in names)).cast("array<double>")


def _scored(docs: DataFrame, machine: Machine, text_col: str, metadata: Sequence[str], score: str) -> DataFrame:
    """docs with the column named score."""
    sent, at, names = docs.sparkSession.sparkContext.broadcast(machine), docs.columns.index(text_col), docs.columns
    about = unused([*names, score], "__about")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(sent.value.scores(part.column(at).to_pylist(), part.column(len(names)).to_pylist()))], names=[*names, score])

    return docs.withColumn(about, _numbers(metadata)).mapInArrow(run, StructType([*docs.schema.fields, StructField(score, DoubleType())]))


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", metadata: Sequence[str] = ()) -> DataFrame:
    """Per document: doc_id, held_out, score and predicted."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *(F.col(n).alias(f"m{k}") for k, n in enumerate(metadata)))
    rows = _scored(rows, machine, "text", [f"m{k}" for k in range(len(metadata))], "score")
    return rows.select("doc_id", (_remainder("doc_id") == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep(docs: DataFrame, machine: Machine, text_col: str = "text", least: float = 0.5, metadata: Sequence[str] = ()) -> DataFrame:
    """The documents with a score of at least `least`, all columns as they were."""
    name = unused(docs.columns, "__score")
    return _scored(docs, machine, text_col, metadata, name).where(F.col(name) >= least).select(*docs.columns)
