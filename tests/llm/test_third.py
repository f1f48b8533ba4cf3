import hashlib
import math
import random
import time
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from larkspur.llm import codes, credentials, decontam, pii, quality, ranked, registry, repeats


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# Vector codes


def coded(found, entries=256, rounds=4):
    """(id, label, vector) rows by the letter of the contract."""
    vectors = [(i, lab, [math.floor(1024 * x) for x in v]) for i, lab, v in found]
    wide = len(vectors[0][2]) // 4
    first = sorted(vectors, key=lambda r: (r[0] is None, r[0], r[2]))[:entries]
    books = [[r[2][p * wide : (p + 1) * wide] for r in first] for p in range(4)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, c, strict=True)), k) for k, c in enumerate(book))

    for _ in range(rounds):
        for p in range(4):
            groups = {}
            for _, _, v in vectors:
                part = v[p * wide : (p + 1) * wide]
                groups.setdefault(nearest(part, books[p])[1], []).append(part)
            for k, parts in groups.items():
                books[p][k] = [sum(x) // len(parts) for x in zip(*parts, strict=True)]
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    out = []
    for i, lab, v in vectors:
        best = [nearest(v[p * wide : (p + 1) * wide], books[p]) for p in range(4)]
        out.append((i, lab, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best)))
    total = Counter()
    for _, lab, _, e in out:
        total[lab] += e
    return sorted(((i, code, e, total[lab], sha) for i, lab, code, e in out), key=str)


ODD_VECTORS = [(1, None), (2, []), (3, [1.0] * 7 + [None]), (4, [1.0] * 7 + [float("nan")]), (5, [float("inf")] * 8), (6, [1.0] * 4), (7, [1.0] * 6), (8, [3e38] * 8)]


def test_codes_against_the_contract(spark):
    rng = random.Random(3)
    found = [(k, rng.choice([None, 1, 2]), [rng.gauss(0, 1) for _ in range(8)]) for k in range(60)]
    found += [(100, 1, [0.0] * 8), (101, 1, [0.0] * 8), (7, 2, found[7][2]), (7, 2, [-1e-9] * 8), (None, 1, [0.5] * 8), found[3]]
    df = spark.createDataFrame([(*r, "clash", 0) for r in found] + [(i, 1, v, "x", 1) for i, v in ODD_VECTORS], "vec_id long, label int, embedding array<double>, vector string, error int")
    assert rows(codes.compress(df.repartition(7), entries=5)) == coded(found, 5)
    assert rows(codes.compress(df.repartition(2), entries=5)) == coded(found, 5)
    assert codes.compress(df.where("embedding is null")).count() == 0 and codes.compress(df.where("false")).count() == 0


def test_codes_of_fewer_rows_than_entries(spark):
    found = [(k, 1, [float(k), -k / 3, 0.25, 1.0]) for k in range(9)]
    got = rows(codes.compress(spark.createDataFrame(found, "vec_id long, label int, embedding array<float>")))
    assert all(r[2] == 0 for r in got) and {r[1][:2] for r in got} == {f"{k:02x}" for k in range(9)}


# Suffixes


def covered(docs, length=100):
    key = lambda d: -(1 << 63) if d is None else d
    first, out = {}, []
    for d, t in docs:
        raw = (t or "").encode()
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            first[w] = min(first.get(w, (1 << 63, 0)), (key(d), p))
    for d, t in docs:
        raw = (t or "").encode()
        hit = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if first[raw[p : p + length]] < (key(d), p):
                hit[p : p + length] = b"\1" * length
        spans = sum(hit[k] and not (k and hit[k - 1]) for k in range(len(hit)))
        out.append((d, len(raw), sum(hit), spans, hashlib.sha256(bytes(b for b, h in zip(raw, hit, strict=True) if not h)).hexdigest()))
    return sorted(out, key=str)


def made(seed, n=120):
    rng = random.Random(seed)
    lines = ["".join(rng.choice("abcdefghijkl ") for _ in range(k)) for k in (60, 99, 100, 101, 150, 400)]

    def text():
        parts = []
        for _ in range(rng.randrange(0, 10)):
            c = rng.random()
            if c < 0.3:
                parts.append(rng.choice(lines))
            elif c < 0.5:
                parts.append(rng.choice(["a", "é", "0 ", "ab "]) * rng.randrange(1, 200))
            else:
                parts.append("".join(rng.choice("abcdefgh \n") for _ in range(rng.randrange(200))))
        return "".join(parts)

    docs = [(rng.choice([None, k, k, k // 3, -k]), text()) for k in range(n)]
    docs += docs[:20] + [(1000 + k, docs[k][1]) for k in range(30)]
    return docs + [(5, None), (6, ""), (7, "x" * 99), (8, "x" * 100), (9, "xyz" * 5000)]


def test_repeats_of_a_table(spark, small):
    docs = [tuple(r) for r in registry.table(spark, small, "documents").select("doc_id", "text").collect()]
    got = rows(registry.op12_repeats(spark, small))
    assert got == covered(docs) and sum(r[2] for r in got) > 10_000


@pytest.mark.parametrize("settings", [{}, {"hot": 3}, {"hot": 10, "bucket": 30}])
def test_repeats_of_odd_texts(spark, settings):
    docs = made(4)
    df = spark.createDataFrame([(d, t, 1, "c") for d, t in docs], "doc_id int, text string, id int, spans string")
    assert rows(repeats.digest(repeats.repeated(df.repartition(5), **settings))) == covered(docs)


def test_repeats_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.repeated(df).count() == 0
    with pytest.raises(ValueError):
        repeats.repeated(spark.createDataFrame([], "doc_id string, text string"))


def test_what_is_kept_and_covered_is_the_text(spark):
    line = "a line of text that stands in two documents, and is somewhat longer than a hundred bytes, as it has to be here"
    df = spark.createDataFrame([(1, f"one: {line} two"), (2, f"ten {line} four")], "doc_id long, text string")
    got = {r.doc_id: r for r in repeats.repeated(df).collect()}
    assert got[1].spans == [] and bytes(got[1].kept).decode() == f"one: {line} two"
    assert bytes(got[2].kept) == b"tenfour" and [tuple(s) for s in got[2].spans] == [(3, 3 + len(line) + 2)]


def test_runs_cover_each_window_once(monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 1000)
    for _, text in made(8, 40):
        raw = (text or "").encode()
        start, left, size, _ = repeats.runs(raw)
        places = [p for s, n in zip(start.tolist(), size.tolist(), strict=True) for p in range(s, s + n)]
        assert sorted(places) == list(range(max(len(raw) - 99, 0)))
        assert ((left >= size - 1) & (left <= 68)).all()


def test_anchors_are_the_same_wherever_a_window_stands():
    rng = random.Random(1)
    window = "".join(rng.choice("ab") for _ in range(100)).encode()
    places = set()
    for k in range(50):
        before = bytes(rng.choice(b"ab") for _ in range(k))
        start, left, size, _ = repeats.runs(before + window + before)
        at = int(np.flatnonzero((start <= k) & (k < start + size))[0])
        places.add(int(start[at] + left[at]) - k)
    assert len(places) == 1


def test_loser_tree_sorts_and_never_looks_at_known_prefixes(monkeypatch):
    rng = random.Random(2)
    whole = [("".join(rng.choice("ab") for _ in range(rng.randrange(1, 60))).encode(), 1, (k, 0, 0)) for k in range(400)]
    parts = [sorted(whole[k::7]) for k in range(7)] + [[]]
    packed = [{k: v.tobytes() if isinstance(v, np.ndarray) else v for k, v in repeats.front_coded(p).items()} for p in parts]
    looked, plain = [], repeats.shared
    monkeypatch.setattr(repeats, "shared", lambda a, b, known=0: looked.append(plain(a, b, known) - known) or plain(a, b, known))
    got = list(repeats.merged([repeats.decoded(p) for p in packed]))
    assert [g[1] for g in got] == sorted(w[0] for w in whole)
    assert [g[0] for g in got[1:]] == [plain(a[1], b[1]) for a, b in zip(got, got[1:], strict=False)]
    # each byte of a suffix is found equal once on its way up at most
    assert sum(looked) <= sum(len(w[0]) for w in whole)


# Ranked search


def best(docs, items, k=10):
    found = [(d, Counter(ranked.terms(t))) for d, t in docs]
    n_docs, n_terms, df = sum(bool(c) for _, c in found), sum(c.total() for _, c in found), Counter()
    for _, c in found:
        df.update(c.keys())
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for d, c in found:
            m = 25 + 75 * c.total() * n_docs // n_terms if n_terms else 0
            s = sum(ranked.weight(n_docs, df[t]) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in ranked.terms(text) if c[t])
            if s > 0:
                scores.append((-s, d is not None, d))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [ranked.TERMS, 4])
def test_ranked_against_all_scores(spark, monkeypatch, most):
    monkeypatch.setattr(ranked, "DOCUMENTS", 16)
    rng = random.Random(6)
    words = ["the", "The", "rare", "é", "É", "x1", "word", "common", "a", "b2"] + [f"w{k}" for k in range(30)]
    text = lambda n: " ".join(rng.choice(words[: rng.randrange(2, len(words))]) for _ in range(n))
    docs = [(k, text(rng.randrange(60))) for k in range(150)] + [(None, "rare word"), (900, None), (901, "-- !"), (902, "common " * 5000), (3, "rare rare")]
    docs += [(k, "rare é word the") for k in range(1000, 1040)] + [(1000, "rare é word the")]
    items = [(1, "rare"), (2, "the the The word"), (3, ""), (4, None), (5, "zzz"), (None, "é w3 w4"), (1, "rare"), (1, "b2 w7"), (6, "common a"), (7, " ".join(words))]
    df = spark.createDataFrame([(*d, 0, "c") for d in docs], "doc_id int, text string, rank int, item string").repartition(6)
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert rows(ranked.search(df, asked, most=most)) == best(docs, items)
    assert ranked.search(df.where("false"), asked).count() == 0 and ranked.search(df, asked.where("false")).count() == 0


def test_bytes_bound_impacts():
    rng = np.random.default_rng(1)
    tf, n = rng.integers(1, 1000, 5000), rng.integers(1, 10**9, 5000)
    real = ranked.impact(tf, n, 10_000, 3_000_000)
    steps = (-(-real // ranked.STEP)).astype(np.uint8)
    for w in (7, -7):
        low, high = ranked.bounds(np.full(5000, w), steps)
        assert (low <= w * real).all() and (w * real <= high).all() and ranked.TOP <= 255 * ranked.STEP


# What stands in several blocks, or repeats


@pytest.mark.parametrize("block", [20, 45])
def test_decontamination_in_several_passes(spark, small, block):
    docs = registry.table(spark, small, "documents").select("doc_id", "text", F.lit(1).alias("__hits"))
    items = registry.table(spark, small, "benchmark")
    same = lambda df: sorted((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), tuple(map(tuple, r.spans))) for r in df.collect())
    assert same(decontam.mark(docs, items, block=block)) == same(decontam.mark(docs, items))
    whole = lambda df: sorted((r.doc_id, r.text) for r in df.collect())
    assert whole(decontam.clean(docs, items, block=block)) == whole(decontam.clean(docs, items))
    assert whole(decontam.clean(docs, items, 12, 0.3, block=block)) == whole(decontam.clean(docs, items, 12, 0.3))


def test_decontamination_of_equal_words_takes_linear_time():
    took = []
    for n in (20_000, 80_000):
        automaton = decontam.Automaton([("a", [b"0"] * n), ("b", [b"0"] * 7), ("c", [b"0", b"1"] * (n // 2))])
        began = time.process_time()
        flags, found = automaton.marks([b"0"] * n)
        took.append(time.process_time() - began)
        assert sum(flags) == n and found == {"a", "b"}
    assert took[1] < 3 and took[1] < 12 * max(took[0], 0.02)


def test_decontamination_of_periodic_items_against_windows():
    rng = random.Random(9)
    some = lambda n: [rng.choice([b"a", b"b"]) for _ in range(n)]
    for _ in range(60):
        items = [(str(k), some(rng.choice([1, 2, 3, 5, 9, 10, 11, 14]))) for k in range(rng.randrange(1, 6))]
        text = [w if rng.random() < 0.97 else b"z" for w in some(60)]
        want, hit = set(), set()
        for k, item in items:
            n = min(10, len(item))
            windows = {tuple(item[i : i + n]) for i in range(len(item) - n + 1)}
            for i in range(len(text) - n + 1):
                if tuple(text[i : i + n]) in windows:
                    want.add(k), hit.update(range(i, i + n))
        flags, found = decontam.Automaton(items).marks(text)
        assert found == want and {i for i in range(len(text)) if flags and flags[i]} == hit


def test_training_takes_one_row_an_id(spark):
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    docs = [(k, f"word{k % 2} " * (k + 3)) for k in range(60)] + [(6, f"copy {k}") for k in range(500)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    one, other = (quality.train(df.repartition(k), labels) for k in (1, 9))
    assert np.array_equal(one.linear, other.linear) and np.array_equal(one.factors, other.factors) and one.bias == other.bias


# Methods that show in the results


def test_owners_decide_on_a_table(spark):
    small = "/root/testdata/sf0.01"
    docs = registry.table(spark, small, "documents")
    got = registry.op10_secrets(spark, small).where("ownership != ''").collect()
    seen = [tuple(x.split(":")) for r in got for x in r.ownership.split(",")]
    assert seen and all(int(reps) >= 1 and int(own) >= 1 for _, _, _, reps, own in seen)
    # the same values under one owner, and each document its own
    find = lambda owner: credentials.digest(credentials.secrets(docs, owner=owner)).agg(F.sum("n_live")).collect()[0][0]
    shared = docs.where(F.col("doc_id").isin([r.doc_id for r in got]))
    many = shared.unionByName(shared.withColumn("source", F.lit("x"))).unionByName(shared.withColumn("source", F.lit("y")))
    alive = lambda df: credentials.digest(credentials.secrets(df, owner=F.col("source"))).agg(F.sum("n_live")).collect()[0][0]
    assert alive(shared) > 0 and alive(many) < 3 * alive(shared) and find(F.lit("one")) >= find(F.col("source"))


def test_labelers_vote_on_base_kinds(spark):
    texts = ["pay 4111 1111 1111 1111 now", "pay 9111 1111 1111 1111 now", "from 192.168.0.1 on", "from 8.8.8.8 on", "call +1 (826) 555-4081 190.137.223.204 now", "call +839 826 555 4081 now"]
    rows = pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    vote = lambda k, kind: [j.gazetteer for j in rows[k].judged if j.kind == kind]
    assert vote(0, "card") == [1] and vote(1, "card") == [-1] and vote(2, "ip") == [-1] and vote(3, "ip") == [1] and vote(5, "phone") == [-1]
    # the whole number, with its country code; what a base span covers is judged once
    found = [texts[4][j.start : j.end] for j in rows[4].judged if j.kind == "national_phone"]
    assert found == ["+1 (826) 555-4081"] and not [j for j in rows[0].judged if j.order > 3]


def test_reliabilities_show_on_a_table(spark, small, monkeypatch):
    before = registry.op7_personal_data(spark, small).orderBy("doc_id").collect()
    monkeypatch.setattr(pii, "reliabilities", lambda patterns, rounds=0: (0.5, [({1: 0.6, 0: 0.35, -1: 0.05}, {1: 0.05, 0: 0.6, -1: 0.35})] * len(pii.LABELERS)))
    after = registry.op7_personal_data(spark, small).orderBy("doc_id").collect()
    assert [r.base_sha256 for r in before] == [r.base_sha256 for r in after] and [r.judged for r in before] != [r.judged for r in after]
