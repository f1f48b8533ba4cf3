"""Removes bytes that an earlier string of LENGTH bytes covers, by a distributed merge sort of sampled suffixes that never compares a
known common prefix again.

*Sampling.* Of the GRAM-byte strings in a window of LENGTH bytes, that with the least hash (the leftmost of equal ones) is its anchor. Equal
windows have equal anchors at equal places, so all occurrences of a window are found by comparing suffixes that begin at anchors, about one for
36 bytes. Windows in a row with one anchor are a run; a run is told by the suffix that begins at its anchor, as far as its windows reach,
and by the bytes before it.

*Counting.* A run whose anchor occurs once in the corpus repeats nothing. Tasks tell each anchor's hash once for some MB of text, so a common one is
no large group; the texts are not moved for this.

*Sorting.* The suffixes of the other runs are sorted in each task. Of equal ones only the earliest goes on: the others are covered, whatever
comes. What is left is front-coded (length of the prefix shared with the one before, and the rest), dealt to buckets by the anchor's gram, and
merged there by a loser tree whose nodes know how much of each suffix agrees with the last one put out: a comparison starts there, and most
need none. In the merged order suffixes of one anchor stand together; shared prefixes after it and shared ends of what is before it tell which
windows two runs share, and all but the earliest are covered.

*Common anchors.* An anchor with over HOT runs (a line that much of the corpus holds, in ever new surroundings) would make a large group. Its
windows are told by 128-bit digests instead, the earliest of each task, and compared by digest. There are fewer such anchors than runs / HOT.

Equal texts are found by SHA-256 first: those after the first are covered whole if they have LENGTH bytes. Texts are shuffled once, for both joins.

Edge cases: null and empty texts have no bytes; texts under LENGTH bytes lose none; matches never cross rows. Ids are whole numbers of any
type, null the least. Rows that share an id are one document by position: of two equal strings in them only that with the later start is covered, and
rows that repeat whole get equal results. Texts of any length are taken in pieces, whole. An empty table gives an empty result. Other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from larkspur.llm.common import attach, cut, scratch

LENGTH, GRAM = 100, 32
#: Runs of an anchor that are compared by sorting; suffixes of a bucket; runs of an anchor that are compared pair by pair.
HOT, BUCKET, PAIRS = 1 << 17, 1 << 18, 8
#: Text that one telling of anchors covers, suffixes that a task sorts at a time, and bytes whose anchors are worked out at a time.
FLUSH, SUFFIXES, PIECE = 1 << 25, 1 << 18, 1 << 22
#: Documents of one telling, as bits of a document's number.
DOCS = 20
_LEAST = -(1 << 63)

Owner = tuple[int, int, int]  # id, place, hash of the text


# Anchors


def _mixed(k: int) -> np.ndarray:
    """k odd 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31)) | np.uint64(1)


_BYTE, _FACTOR = _mixed(256), _mixed(300)[-1]


def _hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """Of each gram, a polynomial of its bytes, put together from parts whose sizes are powers of two."""
    one, factor = _BYTE[raw], _FACTOR
    found: np.ndarray | None = None
    done, size = 0, 1
    with np.errstate(over="ignore"):
        while True:
            if gram & size:  # the part of this size comes after what is found so far
                found = one if found is None else found[: len(found) - size] * factor + one[done:]
                done += size
            if size * 2 > gram:
                break
            one, size = one[:-size] * factor + one[size:], size * 2
            factor = factor * factor
        found ^= found >> np.uint64(29)
        found *= np.uint64(0xBF58476D1CE4E5B9)
        found ^= found >> np.uint64(32)
    return found


def _least(values: np.ndarray, size: int) -> np.ndarray:
    """The least of each `size` values in a row."""
    step = 1
    while step * 2 <= size:
        values, step = np.minimum(values[:-step], values[step:]), step * 2
    return np.minimum(values[: len(values) - (size - step)], values[size - step :]) if step < size else values


def runs(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each run: its first window's place, from there to the anchor, how many windows it has, and the anchor's hash."""
    wide, out = length - gram + 1, []
    whole = np.frombuffer(raw, np.uint8)
    for lo in range(0, len(raw) - length + 1, PIECE):
        h = _hashes(whole[lo : lo + PIECE + length - 1], gram)
        least = _least(h, wide)
        first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
        last = np.append(first[1:], len(least)) - 1
        anchor = np.concatenate([first[k : k + 65536] + h[first[k : k + 65536, None] + np.arange(wide)].argmin(axis=1) for k in range(0, len(first), 65536)])
        easy = last <= anchor
        parts = [(first[easy], anchor[easy], last[easy])]
        for f, e in zip(first[~easy].tolist(), last[~easy].tolist(), strict=True):  # the least gram repeats: another anchor takes over
            at = f + np.flatnonzero(h[f : e + wide] == least[f])
            start, end = np.maximum(np.append(f, at[:-1] + 1), f), np.minimum(at, e)
            parts.append((start[start <= end], at[start <= end], end[start <= end]))
        start, at, end = (np.concatenate(x) for x in zip(*parts, strict=True))
        out.append((start + lo, at - start, end - start + 1, least[start]))
    if not out:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


# Which anchors repeat

_TELL = pa.schema([("bucket", pa.int32()), ("flush", pa.int64()), ("hash", pa.binary()), ("doc", pa.binary()), ("at", pa.binary()), ("often", pa.binary()), ("ids", pa.binary()), ("keys", pa.binary())])
_TELL_DDL = "bucket int, flush long, hash binary, doc binary, at binary, often binary, ids binary, keys binary"
_TOLD = pa.schema([("doc", pa.int64()), ("id", pa.int64()), ("key", pa.int64()), ("at", pa.int64()), ("hash", pa.int64()), ("often", pa.int64())])
_TOLD_DDL = "doc long, id long, key long, at long, hash long, often long"


def _packed(schema: pa.Schema, **values) -> pa.RecordBatch:
    """A batch of one row; arrays as bytes, what isn't given as null."""
    return pa.RecordBatch.from_arrays([pa.array([v.tobytes() if isinstance(v := values.get(f.name), np.ndarray) else v], f.type) for f in schema], schema=schema)


def _tell(buckets: int, length: int, gram: int):
    """Anchors by bucket: each once a flush, with its run if it has but one there, with how many it has otherwise. Runs of the latter are
    known to repeat, and come by themselves (bucket -1 - n), as do the documents, whose numbers stand for their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        ids: list[int] = []
        keys: list[int] = []
        found: list[tuple] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            mark = task << 20 | number
            doc = np.repeat(np.arange(len(ids), dtype=np.uint32), [len(x[0]) for x in found])
            start, left, size, h = (np.concatenate(x) for x in zip(*found, strict=True))
            at = start << 16 | left << 8 | size
            order = np.argsort(h, kind="stable")
            h, doc, at = h[order], doc[order], at[order]
            new = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            often = np.diff(np.append(new, len(h)))
            many = np.repeat(often > 1, often)
            yield _packed(_TELL, bucket=-1 - mark % buckets, flush=mark, hash=h[many], doc=doc[many], at=at[many], ids=np.array(ids, np.int64), keys=np.array(keys, np.int64))
            h, doc, at = h[new], doc[new], at[new]
            bucket = h % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            h, doc, at, often, bucket = h[order], doc[order], at[order], often[order], bucket[order]
            cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])).tolist()
            for lo, hi in zip(cuts, [*cuts[1:], len(h)], strict=True):
                yield _packed(_TELL, bucket=int(bucket[lo]), flush=mark, hash=h[lo:hi], doc=doc[lo:hi], at=at[lo:hi], often=often[lo:hi].astype(np.uint32))

        for batch in batches:
            for id_, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                raw = text.as_py()
                if len(raw) < length:
                    continue
                ids.append(id_), keys.append(key), found.append(runs(raw, length, gram))
                held += len(raw)
                if held >= FLUSH or len(ids) >= 1 << DOCS:
                    yield from flush()
                    ids, keys, found, held, number = [], [], [], 0, number + 1
        if ids:
            yield from flush()

    return run


def _by(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows, as dicts, in groups of equal keys that come in a row."""
    now, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if (key := tuple(row[k] for k in keys)) != now:
                if held:
                    yield now, held
                now, held = key, []
            held.append(row)
    if held:
        yield now, held


def _array(rows: list[dict], name: str, kind: str) -> np.ndarray:
    return np.concatenate([np.frombuffer(r[name], kind) for r in rows])


def _told(hot: int):
    """Documents (id), runs whose anchors repeat (at), and anchors with over `hot` runs (often)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def some(n: int, **columns: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(columns[f.name].astype(np.int64)) if f.name in columns else pa.nulls(n, f.type) for f in _TOLD], schema=_TOLD)

        for (bucket,), rows in _by(batches, "bucket"):
            base = np.repeat([r["flush"] << DOCS for r in rows], [len(r["hash"]) // 8 for r in rows])
            h, doc, at = _array(rows, "hash", "<u8"), _array(rows, "doc", "<u4").astype(np.int64) + base.astype(np.int64), _array(rows, "at", "<i8")
            if bucket < 0:
                yield some(len(h), doc=doc, at=at, hash=h.view(np.int64))
                for r in rows:
                    ids = np.frombuffer(r["ids"], "<i8")
                    yield some(len(ids), doc=(r["flush"] << DOCS) + np.arange(len(ids)), id=ids, key=np.frombuffer(r["keys"], "<i8"))
                continue
            often = _array(rows, "often", "<u4").astype(np.int64)
            order = np.argsort(h, kind="stable")
            h, doc, at, often = h[order], doc[order], at[order], often[order]
            new = np.append(True, h[1:] != h[:-1])
            total = np.add.reduceat(often, np.flatnonzero(new))
            mine = total[np.cumsum(new) - 1]
            keep = (mine > 1) & (often == 1)
            yield some(int(keep.sum()), doc=doc[keep], at=at[keep], hash=h[keep].view(np.int64))
            large = np.flatnonzero(new)[total > hot]
            yield some(len(large), hash=h[large].view(np.int64), often=mine[large])

    return run


# Sorting

_WORK = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("shared", pa.binary()), ("sizes", pa.binary()), ("rights", pa.binary()), ("rest", pa.binary()), ("ids", pa.binary()), ("at", pa.binary()), ("keys", pa.binary())])
_WORK_DDL = "kind int, bucket int, shared binary, sizes binary, rights binary, rest binary, ids binary, at binary, keys binary"
_SORTED, _DIGESTS, _MARKS = 0, 1, 2


class Marks:
    """Covered stretches by (id, hash of the text)."""

    def __init__(self) -> None:
        self.held: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.size = 0

    def add(self, owner: Owner, first: int, last: int) -> None:
        held = self.held.setdefault((owner[0], owner[2]), [])
        if held and held[-1][0] <= first <= held[-1][1]:
            held[-1] = (held[-1][0], max(held[-1][1], last))
        else:
            held.append((first, last))
            self.size += 1

    def arrays(self) -> tuple[np.ndarray, ...]:
        """ids, keys, firsts and lasts, joined where they touch; and none is left."""
        flat = [(i, k, f, e) for (i, k), spans in self.held.items() for f, e in union(spans)]
        self.held, self.size = {}, 0
        return tuple(np.array(x, np.int64) for x in zip(*flat, strict=True)) if flat else (np.empty(0, np.int64),) * 4


def union(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def shared(a: bytes, b: bytes, known: int = 0) -> int:
    """How long the common prefix is; the first `known` bytes are known to be common, and not looked at."""
    most = min(len(a), len(b))
    while known + 16 <= most and a[known : known + 16] == b[known : known + 16]:
        known += 16
    while known < most and a[known] == b[known]:
        known += 1
    return known


def front_coded(rows: list[tuple[bytes, int, Owner]]) -> dict[str, np.ndarray | bytes]:
    """Sorted (suffix, bytes of it that are after the anchor's start, owner) as columns."""
    lengths, rest, before = [], [], b""
    for text, _, _ in rows:
        n = shared(before, text)
        lengths.append(n), rest.append(text[n:])
        before = text
    u1 = lambda x: np.array(x, np.uint8)
    i8 = lambda x: np.array(x, np.int64)
    return {"shared": u1(lengths), "sizes": u1([len(r[0]) for r in rows]), "rights": u1([r[1] for r in rows]), "rest": b"".join(rest), "ids": i8([r[2][0] for r in rows]), "at": i8([r[2][1] for r in rows]), "keys": i8([r[2][2] for r in rows])}


def decoded(row: dict) -> Iterator[tuple[int, bytes, int, Owner]]:
    """What front_coded() took, each with the length of the prefix that it shares with the one before."""
    text, at = b"", 0
    arrays = [np.frombuffer(row[name], kind).tolist() for name, kind in (("shared", "u1"), ("sizes", "u1"), ("rights", "u1"), ("ids", "<i8"), ("at", "<i8"), ("keys", "<i8"))]
    for n, size, right, id_, place, key in zip(*arrays, strict=True):
        text = text[:n] + row["rest"][at : at + size - n]
        at += size - n
        yield n, text, right, (id_, place, key)


def merged(sources: list[Iterator[tuple[int, bytes, int, Owner]]]) -> Iterator[tuple[int, bytes, int, Owner]]:
    """Sorted sources as one, each suffix with the length of the prefix that it shares with the one put out before.

    A loser tree. `same` of a source's head is how much it shares with the last suffix put out (or with what beat it, until that is put out). Of two
    heads the one that shares more is less; only if they share equally much are bytes compared, from there on."""
    k = len(sources)
    heads = [next(s, None) for s in sources]
    same = [0 if h else -1 for h in heads]  # an ended source shares less than any, and so comes last

    def play(i: int, j: int) -> tuple[int, int]:
        """(winner, loser)"""
        if same[i] != same[j]:
            return (i, j) if same[i] > same[j] else (j, i)
        if same[i] < 0:
            return i, j
        a, b = heads[i][1], heads[j][1]
        n = shared(a, b, same[i])
        if n == len(a) or n < len(b) and a[n] < b[n]:
            same[j] = n
            return i, j
        same[i] = n
        return j, i

    losers = [0] * k
    winner = [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        winner[node], losers[node] = play(winner[2 * node], winner[2 * node + 1])
    best = winner[1]
    while k and same[best] >= 0:
        _, text, right, owner = heads[best]
        yield same[best], text, right, owner
        heads[best] = head = next(sources[best], None)
        same[best] = head[0] if head else -1
        node = (k + best) // 2
        while node:
            best, losers[node] = play(best, losers[node])
            node //= 2


def _later(a: Owner, b: Owner) -> bool:
    return a[:2] > b[:2]


def earliest(rows: Iterable[tuple[int, bytes, int, Owner]], marks: Marks, length: int) -> Iterator[tuple[int, bytes, int, Owner]]:
    """Sorted rows without those that are equal to one with an earlier owner, whose windows are all covered."""
    kept: dict[int, list[Owner]] = {}
    before, least = None, 0

    def put() -> Iterator[tuple[int, bytes, int, Owner]]:
        n = least
        for right, owners in kept.items():
            first = min(owners)
            for o in owners:
                if _later(o, first):
                    marks.add(o, o[1], o[1] + len(before))
                else:
                    yield n, before, right, o
                    n = len(before)

    for n, text, right, owner in rows:
        if text != before:
            if before is not None:
                yield from put()
            before, least, kept = text, n, {}
        kept.setdefault(right, []).append(owner)
    if before is not None:
        yield from put()


def compared(group: list[tuple[int, bytes, int, Owner]], marks: Marks, length: int) -> None:
    """Marks the windows of suffixes at one anchor's gram that an earlier one of the group has too."""
    if len(group) <= PAIRS:
        for i, (_, a, right, x) in enumerate(group):
            same = len(a)
            for n, b, other, y in group[i + 1 :]:
                same = min(same, n)
                r = min(same, right, other)
                back, most = 0, min(len(a) - right, len(b) - other)
                if r + most < length:
                    continue
                while back < most and a[-1 - back] == b[-1 - back]:
                    back += 1
                # anchors, not first windows, stand at equal places
                p, q = (x[0], x[1] + len(a) - right, x[2]), (y[0], y[1] + len(b) - other, y[2])
                if r + back >= length and p[:2] != q[:2]:
                    late = max(p, q)
                    marks.add(late, late[1] - back, late[1] + r)
        return
    near = [max(n, after) for (n, *_), after in zip(group, [*(g[0] for g in group[1:]), 0], strict=True)]
    near[0] = group[1][0]
    for back in range(length):  # windows that begin so far before their anchors
        some = [(a, o, len(a) - right) for (_, a, right, o), n in zip(group, near, strict=True) if back <= len(a) - right and length - back <= min(n, right)]
        if len(some) < 2:
            continue
        first: dict[bytes, tuple[int, int]] = {}
        windows = [(a[: length - back] + a[len(a) - back :], (o[0], o[1] + left - back, o[2])) for a, o, left in some]
        for window, o in windows:
            if (old := first.get(window)) is None or o[:2] < old:
                first[window] = o[:2]
        for window, o in windows:
            if o[:2] > first[window]:
                marks.add(o, o[1], o[1] + length)


def _marked(marks: Marks, spread: int) -> pa.RecordBatch:
    ids, keys, first, last = marks.arrays()
    return _packed(_WORK, kind=_MARKS, bucket=spread, ids=ids, keys=keys, at=first, sizes=last)


def _sorted_runs(buckets: int, length: int, gram: int):
    """From (id, key, text, runs): front-coded sorted suffixes by bucket, digests of windows of common anchors by bucket, and marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        dealt: dict[int, list[tuple[bytes, int, Owner]]] = {}
        digests: dict[bytes, list[Owner]] = {}  # the earliest, more than one only where rows share an id
        marks, held = Marks(), 0

        def flush() -> Iterator[pa.RecordBatch]:
            for bucket, rows in dealt.items():
                rows.sort()
                kept = [(text, right, o) for _, text, right, o in earliest(((0, *r) for r in rows), marks, length)]
                yield _packed(_WORK, kind=_SORTED, bucket=bucket, **front_coded(kept))
            dealt.clear()
            by: dict[int, list[tuple[bytes, Owner]]] = {}
            for d, owners in digests.items():
                by.setdefault(int.from_bytes(d[:8], "little") % buckets, []).extend((d, o) for o in owners)
            for bucket, rows in by.items():
                yield _packed(_WORK, kind=_DIGESTS, bucket=bucket, rest=b"".join(d for d, _ in rows), ids=np.array([o[0] for _, o in rows]), at=np.array([o[1] for _, o in rows]), keys=np.array([o[2] for _, o in rows]))
            digests.clear()
            if marks.size:
                yield _marked(marks, task % buckets)

        for batch in batches:
            for row in range(batch.num_rows):
                id_, key, raw = (batch.column(c)[row].as_py() for c in range(3))
                for told in batch.column(3)[row].as_py():
                    start, left, size = told >> 17, told >> 9 & 255, told >> 1 & 255
                    anchor, end = start + left, start + size + length - 1
                    if told & 1:
                        for p in range(start, start + size):
                            d = hashlib.blake2b(raw[p : p + length], digest_size=16).digest()
                            o = (id_, p, key)
                            owners = digests.setdefault(d, [o])
                            if _later(o, owners[0]):
                                marks.add(o, p, p + length)
                            elif _later(owners[0], o):
                                for old in owners:
                                    marks.add(old, old[1], old[1] + length)
                                digests[d] = [o]
                            elif o not in owners:
                                owners.append(o)
                        held += size
                    else:
                        dealt.setdefault(zlib.crc32(raw[anchor : anchor + gram]) % buckets, []).append((raw[anchor:end] + raw[start:anchor], end - anchor, (id_, start, key)))
                        held += 1
                if held >= SUFFIXES:
                    yield from flush()
                    held = 0
        yield from flush()

    return run


def _merged_buckets(length: int, gram: int):
    """Marks of buckets, as (id, key, spans)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = Marks()

        def told() -> pa.RecordBatch:
            pairs = list(marks.held.items())
            spans = [[{"first": f, "last": e} for f, e in union(s)] for _, s in pairs]
            marks.held, marks.size = {}, 0
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in pairs], pa.int64()), pa.array([k[1] for k, _ in pairs], pa.int64()), pa.array(spans, _SPANS)], names=["id", "key", "spans"])

        for (kind, _), rows in _by(batches, "kind", "bucket"):
            if kind == _MARKS:
                for i, k, f, e in zip(*(_array(rows, name, "<i8").tolist() for name in ("ids", "keys", "at", "sizes")), strict=True):
                    marks.add((i, 0, k), f, e)
            elif kind == _DIGESTS:
                _digested(rows, marks, length)
            else:
                group: list[tuple[int, bytes, int, Owner]] = []
                for one in earliest(merged([decoded(r) for r in rows]), marks, length):
                    if one[0] < gram and group:
                        compared(group, marks, length)
                        group = []
                    group.append(one)
                compared(group, marks, length)
            if marks.size >= 1 << 16:
                yield told()
        if marks.size:
            yield told()

    return run


_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
_SPANS_DDL = "array<struct<first:long,last:long>>"


def _digested(rows: list[dict], marks: Marks, length: int) -> None:
    ids, at, keys = (_array(rows, name, "<i8") for name in ("ids", "at", "keys"))
    high, low = _array(rows, "rest", "<u8").reshape(-1, 2).T
    order = np.lexsort((at, ids, low, high))
    first = None
    for k in order.tolist():
        d, o = (high[k], low[k]), (int(ids[k]), int(at[k]), int(keys[k]))
        if first is None or first[0] != d:
            first = (d, o)
        elif _later(o, first[1]):
            marks.add(o, o[1], o[1] + length)


# The whole


def _cleared(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                spans, kept = [], []
                for text, told, whole in zip(part.column(1), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    raw = text.as_py()
                    found = [(0, len(raw))] if whole and len(raw) >= length else union((s["first"], s["last"]) for s in told or ())
                    edges = [0, *(x for s in found for x in s), len(raw)]
                    kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                    spans.append([{"first": a, "last": b} for a, b in found])
                sizes = [len(x.as_py()) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(spans, _SPANS), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    return run


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT, bucket: int = BUCKET) -> DataFrame:
    """Per document: doc_id, n_bytes, spans (of covered bytes, [first, last), as long as can be) and kept (the other bytes). length: up to 120."""
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise ValueError(f"{id_col} has to be a whole number")
    if not gram < length <= 120:
        raise ValueError("length has to be over gram, and 120 at most")
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("own"), text.alias("text")).select("own", F.coalesce(F.col("own").cast("long"), F.lit(_LEAST)).alias("id"), F.xxhash64("text").alias("key"), "text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # texts that an earlier document is equal to
    texts = cut(rows.select("id", "key", F.unhex(F.sha2("text", 256)).alias("sha")))
    first = texts.groupBy("sha").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = cut(attach(texts, first, "sha", "n").where("id > first").select("id", "key").distinct().withColumn("whole", F.lit(True)))
    # anchors that repeat
    path = scratch(spark, "repeats")
    tell = rows.select("id", "key", "text").mapInArrow(_tell(4 * parts, length, gram), _TELL_DDL)
    tell.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_told(hot), _TOLD_DDL).write.parquet(path)
    told = spark.read.parquet(path)
    common = {r.hash for r in told.where("often is not null").select("hash").collect()}  # fewer than runs / hot
    n = told.where("at is not null").count()
    marked = spark.createDataFrame([(h, 1) for h in common], "hash long, common int")
    # a number a run: its place, and in the last bit whether its anchor is common
    found = told.where("at is not null").select("doc", "at", "hash").join(F.broadcast(marked), "hash", "left").select("doc", (F.col("at") * 2 + F.coalesce("common", F.lit(0))).alias("run"))
    found = found.groupBy("doc").agg(F.collect_set("run").alias("runs"))
    own = told.where("id is not null").select("doc", "id", "key").join(copies, ["id", "key"], "left_anti").groupBy("id", "key").agg(F.min("doc").alias("doc"))
    found = own.join(found, "doc").select("id", "key", "runs")
    # sorting; the shuffle of texts serves both joins
    dealt = rows.repartition(parts, "id", "key")
    buckets = max(-(-n // bucket), min(4 * parts, -(-n // 4096)), 1)
    work = dealt.join(found, ["id", "key"]).select("id", "key", "text", "runs").mapInArrow(_sorted_runs(buckets, length, gram), _WORK_DDL)
    marks = work.repartition("kind", "bucket").sortWithinPartitions("kind", "bucket").mapInArrow(_merged_buckets(length, gram), f"id long, key long, spans {_SPANS_DDL}")
    marks = marks.groupBy("id", "key").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    marks = marks.join(copies, ["id", "key"], "full_outer")
    whole = dealt.join(marks, ["id", "key"], "left").select("own", "text", "spans", "whole")
    return whole.mapInArrow(_cleared(length), f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, spans {_SPANS_DDL}, kept binary")


def digest(found: DataFrame) -> DataFrame:
    """Of repeated(): doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
