"""Plain versions of the operators, for comparison on small tables."""

import hashlib
import re
import zlib
from collections import defaultdict

import xxhash


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def token_rows(rows, tokenizer, end_id):
    out, at = [], 0
    for doc_id, text in sorted(rows):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end_id]
        out.append((doc_id, at, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        at += len(ids)
    return out


def decontaminated(rows, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for item, text in items:
        got = word.findall(fold(text))
        n = min(10, len(got))
        for k in range(len(got) - n + 1 if got else 0):
            windows[tuple(got[k : k + n])].add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc_id, text in rows:
        got = word.findall(fold(text))
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(got) - n + 1):
                if tuple(got[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(got[k : k + n])]
        out.append((doc_id, len(got), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def fingerprint(text):
    got = re.findall(r"[^\x20\x09-\x0D]+", fold(text))
    shingles = [" ".join(got[k : k + 3]) for k in range(max(1, len(got) - 2))] if got else []
    hashed = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


def near_duplicates(rows):
    prints = [(d, fingerprint(t)) for d, t in rows]
    names = sorted({f for _, f in prints})
    root = {f: f for f in names}

    def up(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[up(b)] = up(a)
    low = defaultdict(list)
    for d, f in prints:
        low[up(f)].append(d)
    return [(d, f"{f:016x}", min(low[up(f)])) for d, f in prints]


def targets(sizes):
    """{source: (weight, size)} by filling up and resharing."""
    total, out, open_ = 1.5 * sum(s for _, s in sizes.values()), {}, dict(sizes)
    while open_:
        level = (total - sum(out.values())) / sum(w for w, _ in open_.values())
        over = {k for k, (w, s) in open_.items() if level * w > 2 * s}
        if not over:
            return out | {k: level * w for k, (w, _) in open_.items()}
        for k in over:
            out[k] = 2.0 * open_.pop(k)[1]
    return out
