"""Token-id files: encoding, Re-Pair grammar shards, flat files and separator scans.

Two on-disk forms, both Parquet containers of binary blocks, so that every store Spark can reach can hold them and
task commits make retries safe:

* *grammar shards* (``write_grammar`` / ``read_grammar``): documents in ascending id order, range-split over files; a
  row is one shard of consecutive documents whose ids were compressed by Re-Pair.
* *flat blocks* (``write_flat`` / ``scan_separators``): nothing but ids, end-of-document ids included, cut into blocks
  of equal length regardless of documents; the scan finds documents again from the ids alone, so the end id has to be one
  that no text encodes to.

Edge cases: null and empty texts encode to no ids and still get their end id; null document ids sort first; repeated
rows are separate documents, ties on the id are ordered by a hash of the text; an empty table gives an empty file set
and an empty result; columns other than the two named ones are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm.common import scratch

#: Ids per grammar shard, ids per flat block, and entries that a worker keeps of encoded words.
SHARD_TOKENS, BLOCK_TOKENS, CACHE_WORDS = 1 << 18, 1 << 16, 250_000
#: Re-Pair: pairs replaced in a round, and how often a pair must occur. A rule costs two symbols and an expansion length.
PAIRS_PER_ROUND, MIN_COUNT = 2048, 6

_ENCODERS: dict[str, WordEncoder] = {}
#: Marks that may end a word; as they stand, a set in a pattern too.
MARKS = "!#$%&*,.:;?"


#: What is white space beside the blank and the line feed, to a pre-tokenizer or to str.split(); and both of them beside each other or at an end.
_WHOLE = r"[\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n][ \n]|^[ \n]|[ \n]$"


class WordEncoder:
    """Encodes columns of texts with a tokenizers file, encoding each distinct word of a step once.

    A byte-level pre-tokenizer always cuts before a single blank, around a single line feed, and before final MARKS that follow a
    letter, so the pieces can be encoded apart. Texts with any other white space, or with blanks or line feeds side
    by side or at an end, go to the tokenizer unsplit. Words are found by Arrow's dictionary encoding. A word met in two calls is
    kept, up to CACHE_WORDS of them; others are forgotten when as many new ones have come.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        #: The id after the vocabulary's last, added tokens included: no text encodes to it.
        self.separator = max(vocabulary.values()) + 1
        self.dtype = np.uint16 if self.separator < 1 << 16 else np.uint32
        self.size = self.dtype().itemsize
        feed, blank = self.ids("\n"), self.tokenizer.id_to_token(int(self.ids(" ")[0])) if len(self.ids(" ")) == 1 else None
        #: Only where a line feed is one id of its own, and a word's first id alone begins with its blank, do words come apart again.
        self.apart = len(feed) == 1 and blank is not None and len(blank) == 1 and len(self.ids("a\nb")) == 3 and self.ids("a\nb")[1] == feed[0]
        # nor do they where marks join what stands before or after them, or stand in an added token
        joined = [self.ids(x) for x in ("a", "!.", "\n", "b", ",")]
        self.apart = self.apart and np.array_equal(self.ids("a!.\nb,"), np.concatenate(joined)) and not any(set(t.content) & set(MARKS) for t in self.tokenizer.get_added_tokens_decoder().values())
        self.feed = int(feed[0]) if self.apart else 0
        #: By id: whether a word that follows a blank begins here, and whether one that follows a line feed does.
        self.begins = np.zeros((2, self.separator), bool)
        self.begins[0, [i for t, i in vocabulary.items() if blank and t.startswith(blank)]] = True
        self.begins[1, self.feed] = True
        #: Words (after a blank; with a line feed in front, after that) to their ids as bytes, blank or line feed included.
        self.known: dict[str, bytes] = {}
        self.fresh: dict[str, bytes] = {}

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many each has; `end` is one more id after each. Nulls are empty."""
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, _WHOLE).to_numpy(zero_copy_only=False) if self.apart else np.ones(len(texts), bool)
        unsplit = texts.filter(pa.array(whole)).to_pylist() if whole.any() else []
        if unsplit:
            texts = pc.if_else(pa.array(whole), "", texts)
        # each line feed goes to the word after it, and every word but a text's first loses its blank
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        pieces = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        offsets -= offsets[0]
        place, words = pieces.indices.to_numpy().astype(np.int64), pieces.dictionary
        firsts, nth = np.unique(place[offsets[:-1]], return_inverse=True)
        after_feed = pc.binary_join_element_wise(pa.scalar("\n", words.type), words.take(pa.array(firsts)), pa.scalar("", words.type))
        found, told = self.find(pa.concat_arrays([words, after_feed]))
        place = told[place]
        # a text's first word stands after nothing, so what the line feed gave is taken off
        place[offsets[:-1]] = len(found) + nth
        found += [found[k][self.size :] for k in told[len(words) :].tolist()]
        if unsplit:
            place[offsets[:-1][whole]] = len(found) + np.arange(len(unsplit))
            found += [np.array(got.ids, self.dtype).tobytes() for got in self.tokenizer.encode_batch_fast(unsplit, add_special_tokens=False)]
        if end is not None:
            place = np.insert(place, offsets[1:], len(found))
            offsets = offsets + np.arange(len(offsets))
            found.append(np.array([end], self.dtype).tobytes())
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // self.size
        begins, sizes = (np.cumsum(sizes) - sizes)[place], sizes[place]
        to = np.concatenate(([0], np.cumsum(sizes)))
        at = np.repeat(begins - to[:-1], sizes)
        at += np.arange(len(at))
        return np.frombuffer(b"".join(found), self.dtype)[at], np.diff(to[offsets])

    def find(self, words: pa.Array) -> tuple[list[bytes], np.ndarray]:
        """Encoded pieces, and for each word which of them it is. Words that end in marks are looked up without them."""
        ended = pc.match_substring_regex(words, rf"\p{{L}}[{MARKS}]+$")
        parts = pc.extract_regex(words.filter(ended), rf"(?s)^(?P<word>.*\p{{L}})(?P<marks>[{MARKS}]+)$")
        ended = ended.to_numpy(zero_copy_only=False)
        stems = pa.concat_arrays([words.filter(pa.array(~ended)), parts.field("word")]).dictionary_encode()
        found = self.look_up(stems.dictionary.to_numpy(zero_copy_only=False).tolist())
        stem = stems.indices.to_numpy().astype(np.int64)
        plain = len(words) - int(ended.sum())
        told = np.empty(len(words), np.int64)
        told[~ended], told[ended] = stem[:plain], len(found) + np.arange(len(words) - plain)
        marks = parts.field("marks").dictionary_encode()
        last = [self.ids(m).tobytes() for m in marks.dictionary.to_pylist()]
        found += [found[k] + last[m] for k, m in zip(stem[plain:].tolist(), marks.indices.to_numpy().tolist(), strict=True)]
        return found, told

    def look_up(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words; those met a second time are kept."""
        known, fresh = self.known, self.fresh
        found = list(map(known.get, words))
        lacking = [k for k, x in enumerate(found) if x is None]
        asked = list(map(words.__getitem__, lacking))
        again = {w: x for w, x in zip(asked, map(fresh.get, asked), strict=True) if x is not None}
        if len(known) < CACHE_WORDS:
            known.update(again)
        self.learn([w for w in asked if w not in again] if again else asked)
        for k, x in zip(lacking, map(fresh.__getitem__, asked), strict=True):
            found[k] = x
        if len(fresh) > CACHE_WORDS:
            fresh.clear()
        return found

    def learn(self, missing: list[str]) -> None:
        """Encodes words by the hundred, one after another with their blanks or line feeds, whose ids then show where each begins."""
        fresh = self.fresh
        for kind in (0, 1):
            words = [w for w in missing if (w[:1] == "\n") == kind]
            parts = [words[at : at + 512] for at in range(0, len(words), 512)]
            texts = ["".join(p) if kind else " " + " ".join(p) for p in parts]
            for part, got in zip(parts, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                ids = np.array(got.ids, self.dtype)
                starts = np.flatnonzero(self.begins[kind][ids])
                if len(starts) != len(part):  # an added token that takes white space in, say
                    fresh.update((w, self.ids(w if kind else " " + w).tobytes()) for w in part)
                    continue
                raw, cuts = ids.tobytes(), [*(starts * self.size).tolist(), len(ids) * self.size]
                fresh.update(zip(part, map(raw.__getitem__, map(slice, cuts, cuts[1:])), strict=True))


def encoder(path: str) -> WordEncoder:
    """One encoder for each tokenizer file and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def repair(ids: np.ndarray, base: int, rounds: int | None = None, pairs: int = PAIRS_PER_ROUND, least: int = MIN_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair over one shard: the sequence left, the rules (symbol base + k stands for rules[k]) and all expansion lengths.

    A round counts all adjacent pairs, gives the most frequent ones a nonterminal each and replaces them from left to
    right, but for those that others leave too few places; later rounds pair nonterminals too. Without `rounds` it goes on until no
    pair occurs `least` times, or all that do stand in each other's way, or symbols of two bytes run out. expansion lengths: for rule k, how many ids base + k stands for.
    """
    seq, rules = ids.astype(np.uint32), np.empty((0, 2), np.uint32)
    for _ in count() if rounds is None else range(rounds):
        room = min(pairs, (1 << 16) - base - len(rules)) if base <= 1 << 16 else pairs
        if len(seq) < 2 or room < 1:
            break
        wide = base + len(rules) + room > 1 << 16
        key = (seq[:-1].astype(np.uint64) << np.uint64(32)) | seq[1:] if wide else (seq[:-1] << np.uint32(16)) | seq[1:]
        ordered = np.sort(key)
        starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        counts = np.diff(np.append(starts, len(ordered)))
        often = np.flatnonzero(counts >= least)
        if not len(often):
            break
        if len(often) > room:
            often = often[np.argsort(-counts[often], kind="stable")[:room]]
        chosen = ordered[starts[np.sort(often)]]
        slot = (chosen * chosen.dtype.type(2654435761)).astype(np.uint32) >> np.uint32(14)
        _, one = np.unique(slot, return_index=True)  # pairs that meet in a slot wait for the next round
        chosen, slot = chosen[np.sort(one)], slot[np.sort(one)]
        table = np.full(1 << 18, len(chosen), np.uint16 if len(chosen) < 1 << 16 else np.uint32)
        table[slot] = np.arange(len(chosen))
        rule = table[(key * key.dtype.type(2654435761)).astype(np.uint32) >> np.uint32(14)]
        at = np.flatnonzero(rule < len(chosen))
        at = _apart(at[chosen[rule[at]] == key[at]])
        good = np.bincount(rule[at], minlength=len(chosen)) >= max(least - 2, 1)
        if not good.any():
            break
        at = at[good[rule[at]]]
        number, chosen = (np.cumsum(good) - 1)[rule[at]], chosen[good]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq[at] = base + len(rules) + number.astype(np.uint32)
        seq = seq[keep]
        split = np.stack([chosen >> chosen.dtype.type(32 if wide else 16), chosen & chosen.dtype.type(0xFFFFFFFF if wide else 0xFFFF)], axis=1)
        rules = np.concatenate([rules, split.astype(np.uint32)])
    return seq, rules, expansion_lengths(rules, base)


def _apart(at: np.ndarray) -> np.ndarray:
    """Of places of pairs, those left when of pairs that overlap every second one goes, from the left of each run."""
    first = np.concatenate(([True], np.diff(at) > 1)) if len(at) else np.empty(0, bool)
    run = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0)) if len(at) else at
    return at[((np.arange(len(at)) - run) & 1) == 0]


def expansion_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """How many ids each rule stands for. A rule refers to rules of earlier rounds only, which stand before it."""
    lengths = np.zeros(len(rules), np.int64)
    todo = np.ones(len(rules), bool)
    while todo.any():
        inner = rules.astype(np.int64) - base
        each = np.where(inner < 0, 1, lengths[np.maximum(inner, 0)])
        ready = todo & (each > 0).all(axis=1)
        lengths[ready] = each[ready].sum(axis=1)
        todo &= ~ready
    return lengths


def expand(seq: np.ndarray, rules: np.ndarray, lengths: np.ndarray, base: int, start: int = 0, stop: int | None = None) -> np.ndarray:
    """The ids from start to stop of a shard. Lengths tell which symbols cover them; only those are expanded."""
    seq = seq.astype(np.int64)
    each = np.where(seq < base, 1, lengths[np.maximum(seq - base, 0)] if len(rules) else 1)
    if start or stop is not None:
        ends = np.cumsum(each)
        stop = int(ends[-1]) if stop is None and len(ends) else stop or 0
        lo, hi = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        before = int(ends[lo - 1]) if lo else 0
        return expand(seq[lo:hi], rules, lengths, base)[start - before : stop - before] if stop > start else np.empty(0, np.uint32)
    if not len(rules):
        return seq.astype(np.uint32)
    flat, at = _flatten(rules, lengths, base)
    begin = np.where(seq < base, 0, at[np.maximum(seq - base, 0)])
    ends = np.cumsum(each)
    out = np.repeat(begin - (ends - each), each)
    out += np.arange(len(out))
    single = seq < base
    out = flat[np.clip(out, 0, len(flat) - 1, out=out)]
    out[(ends - 1)[single]] = seq[single]
    return out


def _flatten(rules: np.ndarray, lengths: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """The expansions of all rules, one after another, and where each begins."""
    seq = base + np.arange(len(rules), dtype=np.int64)
    at = np.cumsum(lengths) - lengths
    while len(seq) and seq.max() >= base:
        inner = seq >= base
        to = np.cumsum(1 + inner) - (1 + inner)
        out = np.empty(len(seq) + int(inner.sum()), np.int64)
        out[to[~inner]] = seq[~inner]
        out[to[inner]], out[to[inner] + 1] = rules[seq[inner] - base].T
        seq = out
    return seq.astype(np.uint32), at


_SHARD = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("position", pa.list_(pa.int64())), ("length", pa.list_(pa.int32())), ("base", pa.int32()), ("width", pa.int32()), ("sequence", pa.binary()), ("rules", pa.binary()), ("expansions", pa.binary())])
_SHARD_DDL = "part int, shard int, start long, n_tokens long, doc_id array<long>, position array<long>, length array<int>, base int, width int, sequence binary, rules binary, expansions binary"


def _steps(batches: Iterator[pa.RecordBatch], most: int = 1 << 22) -> Iterator[tuple[pa.Array, ...]]:
    """The columns, ids and texts before others, in steps of about `most` bytes, so that memory follows the step and not the batch."""
    for batch in batches:
        step = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)) // most
        cuts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if hi > lo:
                yield tuple(column.slice(lo, hi - lo) for column in batch.columns)


def _texts(batches: Iterator[pa.RecordBatch], most: int = 1 << 21) -> Iterator[tuple[list, list]]:
    return ((ids.to_pylist(), texts.to_pylist()) for ids, texts, *_ in _steps(batches, most))


def _grammar_rows(path: str, end_id: int, rounds: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, shard, start = encoder(path), TaskContext.get().partitionId(), 0, 0
        base = max(enc.tokenizer.get_vocab_size(), end_id + 1)
        docs: list = []
        places: list = []
        lengths: list[np.ndarray] = []
        held: list[np.ndarray] = []
        size = 0

        def row() -> pa.RecordBatch:
            ids = np.concatenate(held)
            seq, rules, expansions = repair(ids, base, rounds)
            width = 2 if base + len(rules) <= 1 << 16 else 4
            return pa.RecordBatch.from_pylist([{"part": part, "shard": shard, "start": start, "n_tokens": len(ids), "doc_id": docs, "position": places, "length": np.concatenate(lengths), "base": base, "width": width, "sequence": seq.astype(f"<u{width}").tobytes(), "rules": rules.astype(f"<u{width}").tobytes(), "expansions": expansions.astype("<u4").tobytes()}], schema=_SHARD)

        for names, texts, spots in _steps(batches):
            ids, sizes = enc.encode(texts, end_id)
            ends, names, spots = np.cumsum(sizes), names.to_pylist(), spots.to_pylist()
            at, done = 0, 0
            while at < len(sizes):
                # up to the document that fills the shard
                to = min(int(np.searchsorted(ends, done + SHARD_TOKENS - size)) + 1, len(sizes))
                docs += names[at:to]
                places += spots[at:to]
                lengths.append(sizes[at:to])
                held.append(ids[done : ends[to - 1]])
                size += int(ends[to - 1]) - done
                at, done = to, int(ends[to - 1])
                if size >= SHARD_TOKENS:
                    yield row()
                    docs, places, lengths, held, shard, start, size = [], [], [], [], shard + 1, start + size, 0
        if docs:
            yield row()

    return run


def write_grammar(docs: DataFrame, path: str, tokenizer: str, end_id: int, rounds: int | None = None, id_col: str = "doc_id", text_col: str = "text", position_col: str | None = None) -> None:
    """Encodes every whole text, appends end_id to each and writes grammar shards in ascending id order to path.

    With position_col, a number that tells where in the order of training a row stands, each document's is kept beside its length.
    """
    position = F.col(position_col).cast("long") if position_col else F.lit(None).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), position.alias("position"))
    tie = (F.xxhash64("text"), *(("position",) if position_col else ()))
    rows = rows.repartitionByRange("doc_id", *tie).sortWithinPartitions("doc_id", *tie)
    rows.mapInArrow(_grammar_rows(tokenizer, end_id, rounds), _SHARD_DDL).write.parquet(path)


def _decode(row: dict) -> np.ndarray:
    seq = np.frombuffer(row["sequence"], f"<u{row['width']}")
    rules = np.frombuffer(row["rules"], f"<u{row['width']}").reshape(-1, 2)
    return expand(seq, rules, np.frombuffer(row["expansions"], "<u4").astype(np.int64), row["base"])


def _document_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
            ids, n = _decode(row).astype("<u4"), np.array(row["length"], np.int64)
            ends = np.cumsum(n)
            buf = memoryview(ids).cast("B")
            crc = [zlib.crc32(buf[4 * (e - m) : 4 * e]) for e, m in zip(ends.tolist(), n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_id"], pa.int64()), pa.array([row["part"]] * len(n), pa.int32()), pa.array(row["start"] + ends - n), pa.array(n), pa.array(crc, pa.int64()), pa.array(row["position"], pa.int64())], names=["doc_id", "part", "local", "n_tokens", "ids_crc32", "position"])


def read_grammar(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens and ids_crc32, decoded from the files, and position, null
    if the files were written without.

    Files hold consecutive ranges; one row for each file is summed up in front of it to place its documents.
    """
    shards = spark.read.schema(_SHARD_DDL).parquet(path)
    docs = shards.select("part", "start", "doc_id", "position", "length", "base", "width", "sequence", "rules", "expansions").mapInArrow(_document_rows, "doc_id long, part int, local long, n_tokens long, ids_crc32 long, position long")
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("held"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("part").alias("file"), F.coalesce(F.sum("held").over(before), F.lit(0)).alias("before"))
    return docs.join(parts, docs.part == parts.file).select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", "position")


def read_span(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    """Random access: the ids at positions start to stop of the whole stream, from the shards that hold them alone."""
    shards = spark.read.schema(_SHARD_DDL).parquet(path)
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("held"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("part").alias("file"), F.coalesce(F.sum("held").over(before), F.lit(0)).alias("before"))
    at = F.col("before") + F.col("start")
    wanted = shards.join(parts, shards.part == parts.file).withColumn("at", at).where((F.col("at") < stop) & (F.col("at") + F.col("n_tokens") > start))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lo, hi = max(start - row["at"], 0), min(stop - row["at"], row["n_tokens"])
                rules = np.frombuffer(row["rules"], f"<u{row['width']}").reshape(-1, 2)
                got = expand(np.frombuffer(row["sequence"], f"<u{row['width']}"), rules, np.frombuffer(row["expansions"], "<u4").astype(np.int64), row["base"], lo, hi)
                yield pa.RecordBatch.from_arrays([pa.array(row["at"] + lo + np.arange(len(got))), pa.array(got.astype(np.int64))], names=["position", "token"])

    return wanted.select("at", "n_tokens", "base", "width", "sequence", "rules", "expansions").mapInArrow(run, "position long, token long")


def token_file(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int, position_col: str | None = None) -> DataFrame:
    """Writes grammar shards to the shared folder and returns what read_grammar() finds in them, position only if it was given."""
    path = scratch(spark, "token-grammar")
    write_grammar(docs, path, tokenizer, end_id, position_col=position_col)
    found = read_grammar(spark, path)
    return found if position_col else found.drop("position")


# Flat files and the separator scan

_FLAT = pa.schema([("kind", pa.string()), ("file", pa.int32()), ("block", pa.int64()), ("payload", pa.binary()), ("doc_id", pa.list_(pa.int64()))])
_FLAT_DDL = "kind string, file int, block long, payload binary, doc_id array<long>"


def _flat_rows(path: str, end_id: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, file, at, seen = encoder(path), TaskContext.get().partitionId(), 0, 0
        held, size = bytearray(), block * enc.size

        def row(kind: str, number: int, payload: bytes | None, ids: list | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"kind": kind, "file": file, "block": number, "payload": payload, "doc_id": ids}], schema=_FLAT)

        for names, texts in _steps(batches):
            held += enc.encode(texts, end_id)[0].tobytes()
            yield row("names", seen, None, names.to_pylist())
            seen += len(names)
            full = len(held) // size
            for k in range(full):
                yield row("ids", at + k, bytes(held[k * size : (k + 1) * size]), None)
            del held[: full * size]
            at += full
        if held:
            yield row("ids", at, bytes(held), None)

    return run


def write_flat(docs: DataFrame, path: str, tokenizer: str, end_id: int, block: int = BLOCK_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes every text's ids and an end id, one after another, as flat blocks without any index (kind=ids), and apart
    from them which document is which (kind=names). No shuffle: the rows of a scan task make up one file."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows.mapInArrow(_flat_rows(tokenizer, end_id, block), _FLAT_DDL).write.partitionBy("kind").option("compression", "zstd").parquet(path)


def _ends(end_id: int, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(x.as_buffer(), dtype) if x.is_valid else np.empty(0, dtype) for x in batch.column(2)]
            ends = [np.flatnonzero(x == end_id) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) for x in ids], pa.int64()), pa.array(ends, pa.list_(pa.int64()))], names=["file", "block", "n", "ends"])

    return run


def scan_separators(blocks: DataFrame, end_id: int, dtype: str = "<u2", group: int = 4096) -> DataFrame:
    """Documents of flat blocks (file, block, payload): file, ordinal in the file, start in the file and n_tokens, end id included.

    Every block is searched by itself, vectorised. Prefix scans over one small row for each block then give what stands
    before it: ids, end ids, and the place of the last end id, which is where a document open at the block's beginning
    began. The scans run inside groups of consecutive blocks first, then over the groups' totals, so that one large file
    doesn't make one large task. A document may span any number of blocks; ids after a file's last end id are none.
    """
    found = blocks.select("file", "block", "payload").mapInArrow(_ends(end_id, dtype), "file int, block long, n long, ends array<long>")
    found = found.withColumns({"part": F.floor(F.col("block") / group), "docs": F.size("ends").cast("long"), "last": F.try_element_at("ends", F.lit(-1))})
    earlier = Window.partitionBy("file", "part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumns({"ids_to": F.coalesce(F.sum("n").over(earlier), F.lit(0)), "docs_to": F.coalesce(F.sum("docs").over(earlier), F.lit(0))})
    found = found.withColumn("open_to", F.max(F.col("ids_to") + F.col("last")).over(earlier))
    across = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    groups = found.groupBy("file", "part").agg(F.sum("n").alias("ids"), F.sum("docs").alias("docs"), F.max(F.col("ids_to") + F.col("last")).alias("last"))
    groups = groups.withColumns({"base_ids": F.coalesce(F.sum("ids").over(across), F.lit(0)), "base_docs": F.coalesce(F.sum("docs").over(across), F.lit(0))})
    groups = groups.withColumn("base_open", F.max(F.col("base_ids") + F.col("last")).over(across)).select("file", "part", "base_ids", "base_docs", "base_open")
    each = found.join(groups, ["file", "part"]).select("file", "base_ids", "base_docs", "base_open", "ids_to", "docs_to", "open_to", "ends", F.posexplode("ends").alias("k", "end"))
    begin = F.col("base_ids") + F.col("ids_to")
    before = F.when(F.col("k") > 0, begin + F.get("ends", F.col("k") - 1)).otherwise(F.coalesce(F.col("base_ids") + F.col("open_to"), "base_open", F.lit(-1)))
    return each.select("file", (F.col("base_docs") + F.col("docs_to") + F.col("k")).alias("ordinal"), (before + 1).alias("start"), (begin + F.col("end") - before).alias("n_tokens"))


def token_counts(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int | None = None, block: int = BLOCK_TOKENS) -> DataFrame:
    """Writes flat blocks to the shared folder, scans them, and names the documents found: doc_id, file, ordinal, start, n_tokens.

    Without end_id the id after the vocabulary ends documents. A given one must be an id that no text here encodes to.
    """
    end_id = encoder(tokenizer).separator if end_id is None else end_id
    path = scratch(spark, "token-flat")
    write_flat(docs, path, tokenizer, end_id, block)
    rows = spark.read.schema(_FLAT_DDL).parquet(path)
    names = rows.where("kind = 'names'").select("file", "block", F.posexplode("doc_id").alias("k", "doc_id")).select("file", (F.col("block") + F.col("k")).alias("ordinal"), "doc_id")
    dtype = "<u2" if encoder(tokenizer).dtype == np.uint16 else "<u4"
    return scan_separators(rows.where("kind = 'ids'"), end_id, dtype).join(names, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens")
