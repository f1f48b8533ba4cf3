"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

Documents stream through the automaton word by word; the longest suffix matched at each word tells whether a window (10
consecutive words of an item, or a whole shorter item) ends there. Words that no item has reset the automaton, so only runs
of words known to it that are long enough for a window are walked.

Windows end in states of the automaton; each state knows the nearest of them among its suffixes, so a word costs what it matches
(one window of full length and the shorter items), however often words repeat, and a window's items are taken once a document.

Items are taken in blocks of at most BLOCK_WORDS words; the automata of TOGETHER blocks (at most two states a word) are what is sent
to the executors for one pass over the documents, so its size doesn't depend on how many items or documents there are. A pass that isn't
the last leaves what it found, by a digest of the text, never the texts; the last one takes it up.

Edge cases: null, empty and wordless texts have no words and no hits; items without words never match; item ids that repeat
count once, a null one as the empty text; rows that repeat get equal results; an empty item or document table is fine;
other columns pass through clean() untouched and are ignored by mark().
"""

from __future__ import annotations

import hashlib
import itertools
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StringType, StructField, StructType

from larkspur.llm.common import cut, unused

#: Words of a window, and words of the items in one automaton.
WINDOW, BLOCK_WORDS = 10, 1 << 18
#: Blocks of items that one pass over the documents looks for.
TOGETHER = 2
#: ASCII letters lower-cased, digits and everything beyond ASCII kept, the rest blank.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Automaton:
    """Suffix automaton of several word sequences. Per state: suffix link, longest length, and transitions, the first of which
    stands in flat arrays; most states have no other. Measured: 450 bytes a word, of 200,000 random
    words by a Zipf law."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> None:
        self.window, self.ids = window, sorted({name for name, got in items if got})
        self.word, self.to = array("i", [-1]), array("i", [0])
        self.more: dict[int, dict[int, int]] = {}
        self.link, self.length = array("i", [-1]), array("i", [0])
        self.vocabulary: dict[bytes, int] = {}
        number = {name: k for k, name in enumerate(self.ids)}
        runs = [(number[name], [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in got]) for name, got in items if got]
        for _, run in runs:
            last = 0
            for w in run:
                last = self._extend(last, w)
        #: Per state: items whose window of full length ends there; whole shorter items, by length.
        self.full: dict[int, set[int]] = {}
        self.short: dict[int, dict[int, set[int]]] = {}
        for k, run in runs:
            size, state, held = min(window, len(run)), 0, 0
            for w in run:
                state, held = self.next(state, held, w)
                while held > size:  # to the state of the last `size` words
                    if self.length[self.link[state]] < size:
                        held = size
                    else:
                        state = self.link[state]
                        held = self.length[state]
                if held == size:
                    if len(run) >= window:
                        self.full.setdefault(state, set()).add(k)
                    else:
                        self.short.setdefault(state, {}).setdefault(size, set()).add(k)
        #: Per state: the longest suffix, itself included, where a window ends.
        self.near = array("i", bytes(4 * len(self.link)))
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.near[state] = state if state in self.full or state in self.short else self.near[self.link[state]]
        self.least = min((min(window, len(run)) for _, run in runs), default=0)

    def _go(self, state: int, w: int) -> int:
        """The state that a word leads to; -1 if there is none."""
        if self.word[state] == w:
            return self.to[state]
        rest = self.more.get(state)
        return -1 if rest is None else rest.get(w, -1)

    def _set(self, state: int, w: int, to: int) -> None:
        if self.word[state] in (w, -1):
            self.word[state], self.to[state] = w, to
        else:
            self.more.setdefault(state, {})[w] = to

    def _new(self, link: int, length: int) -> int:
        self.word.append(-1), self.to.append(0), self.link.append(link), self.length.append(length)
        return len(self.link) - 1

    def _extend(self, last: int, w: int) -> int:
        link, length = self.link, self.length

        def split(p: int, q: int) -> int:
            new = self._new(link[q], length[p] + 1)
            self.word[new], self.to[new] = self.word[q], self.to[q]
            if q in self.more:
                self.more[new] = dict(self.more[q])
            link[q] = new
            while p >= 0 and self._go(p, w) == q:
                self._set(p, w, new)
                p = link[p]
            return new

        if (q := self._go(last, w)) >= 0:
            return q if length[q] == length[last] + 1 else split(last, q)
        new, p = self._new(0, length[last] + 1), last
        while p >= 0 and self._go(p, w) < 0:
            self._set(p, w, new)
            p = link[p]
        if p >= 0:
            q = self._go(p, w)
            link[new] = q if length[q] == length[p] + 1 else split(p, q)
        return new

    def next(self, state: int, held: int, w: int) -> tuple[int, int]:
        """The state and length of the longest suffix of what was read, and w, that an item contains."""
        while (to := self._go(state, w)) < 0:
            if not state:
                return 0, 0
            state = self.link[state]
            held = self.length[state]
        return to, held + 1

    def marks(self, found: list[bytes]) -> tuple[bytearray | None, set[str]]:
        """A flag for each word inside an occurrence of a window (None: no word is), and the ids of the items concerned."""
        known = list(map(self.vocabulary.get, found))
        flags: bytearray | None = None
        items: set[int] = set()
        told: set[tuple[int, int]] = set()
        at, n, least = 0, len(known), self.least
        while self.least and at <= n - least:
            # a window's words are all known: look for an unknown one from the far end
            skip = next((k for k in range(at + least - 1, at - 1, -1) if known[k] is None), None)
            if skip is not None:
                at = skip + 1
                continue
            state = held = 0
            while at < n and (w := known[at]) is not None:
                state, held = self.next(state, held, w)
                at += 1
                if held >= least and (size := self._match(state, held, items, told)):
                    flags = bytearray(n) if flags is None else flags
                    flags[at - size : at] = b"\x01" * size
        return flags, {self.ids[k] for k in items}

    def _match(self, state: int, held: int, items: set[int], told: set[tuple[int, int]]) -> int:
        """Adds the items with a window that ends here, but for those of (state, length) pairs told before; the length of the longest
        such window, or 0."""
        most, state = 0, self.near[state]
        while state > 0:
            sizes = self.short.get(state, {})
            if held >= self.window and state in self.full:
                sizes = {**sizes, self.window: self.full[state]}
            for size, found in sizes.items():
                if size <= held:
                    most = max(most, size)
                    if (state, size) not in told:
                        told.add((state, size))
                        items |= found
            state = self.near[self.link[state]]
            held = min(held, self.length[state])
        return most


def _blocks(items: DataFrame, id_col: str, text_col: str, window: int, most: int) -> Iterator[Automaton]:
    """One automaton for each block of items; the driver holds one block at a time. The first may be empty. An item longer than a
    block comes in parts that overlap by all but one word of a window, so that each of its windows is whole in one of them."""
    held, size, made, most = [], 0, False, max(most, 2 * window)
    for row in items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        whole = words(row.t)
        for at in range(0, max(len(whole) - window + 1, 1), most - window + 1) if len(whole) > most else (0,):
            got = whole[at : at + most]
            if held and size + len(got) > most:
                yield Automaton(held, window)
                held, size, made = [], 0, True
            held.append((row.i, got))
            size += len(got)
    if held or not made:
        yield Automaton(held, window)


def _passes(found: Iterator[Automaton], together: int) -> Iterator[tuple[list[Automaton], bool]]:
    """Automata by pass; and whether it is the last pass."""
    held = list(itertools.islice(found, together))
    while held:
        after = list(itertools.islice(found, together))
        yield held, not after
        held = after


def _joined(one: bytes | None, other: bytes | None) -> bytes | None:
    return other if one is None else one if other is None else (int.from_bytes(one, "little") | int.from_bytes(other, "little")).to_bytes(len(one), "little")


def _looked(sent, at: int, added: list[str]):
    """Adds to the texts of column `at` what all automata and, in the last two columns, earlier passes have found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                sizes, hits, names = [], [], []
                for text, flagged, ids in zip(part.column(at), *part.columns[-2:], strict=True):
                    got = words(text.as_py())
                    flags, found = None, set(ids.as_py() or ())
                    for old in flagged.as_py() or ():
                        flags = _joined(flags, old)
                    for automaton in sent.value:
                        new, more = automaton.marks(got)
                        flags, found = _joined(flags, None if new is None else bytes(new)), found | more
                    sizes.append(len(got)), hits.append(flags), names.append(sorted(found))
                yield pa.RecordBatch.from_arrays([*part.columns[:-2], pa.array(sizes, pa.int32()), pa.array(hits, pa.binary()), pa.array(names, pa.list_(pa.string()))], names=[*part.schema.names[:-2], *added])

    return run


def _marked(docs: DataFrame, items: DataFrame, text_col: str, item_id: str, item_text: str, window: int, block: int) -> tuple[DataFrame, list[str]]:
    """docs with a flag for each hit word and the ids of the items, for all blocks of items; and the names of the three columns."""
    spark, columns, at = docs.sparkSession, docs.columns, docs.columns.index(text_col)
    added = [unused(columns, n) for n in ("__n_words", "__hits", "__items")]
    key = unused([*columns, *added], "__key")
    digest = F.md5(F.col(text_col).cast("binary"))
    before: DataFrame | None = None  # (key, flags of each pass, items)
    for automata, last in _passes(_blocks(items, item_id, item_text, window, block), TOGETHER):
        sent = spark.sparkContext.broadcast(automata)
        told = StructType([StructField(added[0], IntegerType()), StructField(added[1], BinaryType()), StructField(added[2], ArrayType(StringType()))])
        none = F.lit(None).cast("array<binary>").alias(added[1]), F.lit(None).cast("array<string>").alias(added[2])
        if not last:
            rows = docs.select(F.col(text_col), digest.alias(key))
            shape = StructType([StructField(text_col, docs.schema[text_col].dataType), StructField(key, StringType()), *told])
            mine = rows.select(text_col, key, *none).mapInArrow(_looked(sent, 0, added), shape).where(F.col(added[1]).isNotNull())
            mine = cut(mine.groupBy(key).agg(F.first(added[1]).alias(added[1]), F.first(added[2]).alias(added[2])))
            before = mine if before is None else before.unionByName(mine)
            sent.destroy()
            continue
        if before is None:
            rows = docs.select("*", *none)
        else:
            merged = before.groupBy(key).agg(F.collect_list(added[1]).alias(added[1]), F.flatten(F.collect_list(added[2])).alias(added[2]))
            rows = docs.withColumn(key, digest).join(merged, key, "left").select(*columns, added[1], added[2])
        return rows.mapInArrow(_looked(sent, at, added), StructType([*docs.schema.fields, *told])), added
    raise AssertionError("there is a last pass")


def _spans(flags: bytes) -> Iterator[tuple[int, int]]:
    return (m.span() for m in re.finditer(rb"\x01+", flags))


def mark(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block: int = BLOCK_WORDS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, items (sorted ids) and spans (of hit words, [first, last))."""
    rows, added = _marked(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), items, "text", item_id, item_text, window, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [x.as_py() for x in batch.column(2)]
            spans = [[{"first": a, "last": b} for a, b in _spans(h)] if h else [] for h in hits]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int64()), pa.array([h.count(1) if h else 0 for h in hits], pa.int64()), batch.column(3), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))], names=["doc_id", "n_words", "n_hit", "items", "spans"])

    rows = rows.select("doc_id", *added)
    return rows.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_words long, n_hit long, items array<string>, spans array<struct<first:long,last:long>>")


def without(text: str, flags: bytes, longest: int) -> str:
    """The text without those hit spans that have over `longest` words."""
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in _WORD.finditer(raw.translate(_FOLD))]
    out, last = [], 0
    for a, b in _spans(flags):
        if b - a > longest:
            out.append(raw[last : at[a][0]])
            last = at[b - 1][1]
    return b"\n".join([*out, raw[last:]]).decode("utf-8", "surrogatepass")


def clean(docs: DataFrame, items: DataFrame, longest: int = 0, coverage: float = 0.0, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block: int = BLOCK_WORDS) -> DataFrame:
    """docs without contamination, all columns kept: documents whose share of hit words is over `coverage` go; from the
    others, hit spans of over `longest` words are cut out. With coverage 0 every document with a hit goes."""
    rows, (n_words, hits, found) = _marked(docs, items, text_col, item_id, item_text, window, block)
    if not coverage:
        return rows.where(F.col(hits).isNull()).select(*docs.columns)
    n_hit = F.length(F.regexp_replace(F.hex(hits), "00", "")) / 2
    share = F.coalesce(n_hit / F.greatest(F.col(n_words), F.lit(1)), F.lit(0.0))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marked = zip(batch.column(at), batch.column(batch.num_columns - 1), strict=True)
            texts = pa.array([without(t.as_py(), h.as_py(), longest) if h.is_valid else t.as_py() for t, h in marked], batch.column(at).type)
            yield pa.RecordBatch.from_arrays([texts if k == at else c for k, c in enumerate(batch.columns[:-1])], names=batch.schema.names[:-1])

    return rows.where(share <= coverage).select(*docs.columns, hits).mapInArrow(run, docs.schema)


def items_digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(ids).encode()).hexdigest()
