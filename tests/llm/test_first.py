import math
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from larkspur.llm import common as common_
from larkspur.llm import decontam, mixing, quality, registry, simhash, tokens
from tests.llm import brute

ODD = [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "One two three four", "b"), (4, "One two three four", "b"), (None, "no id here", "b"), (7, "x " * 30_000, "c"), (8, "<|endoftext|> tab\tand  two é 　 spaces ", "")]


def read(folder, name):
    return duckdb.sql(f"select * from '{folder}/{name}.parquet'").df()


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "clash") for r in ODD], "doc_id long, text string, source string, fp string")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


def rows(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


NAMES = ("doc_id", "start", "n_tokens", "ids_crc32")


def test_token_files_round_trip(spark, small):
    docs = read(small, "documents")
    want = brute.token_rows(list(zip(docs.doc_id, docs.text, strict=True)), tokens.encoder(registry.vocabulary()).tokenizer, 2)
    assert sorted(rows(registry.op3_token_ids(spark, small), *NAMES)) == want


def test_token_files_odd_rows(spark, odd, empty):
    path = registry.vocabulary()
    tk = tokens.encoder(path).tokenizer
    got = sorted(rows(tokens.token_file(spark, odd, path, 2), *NAMES), key=lambda r: (r[1]))
    want = [zlib.crc32(b"".join(i.to_bytes(4, "little") for i in [*tk.encode(t or "", add_special_tokens=False).ids, 2])) for d, t, _ in sorted(ODD, key=lambda r: (r[0] is not None, r[0]))]
    assert [r[3] for r in got] == want and got[0][0] is None
    assert tokens.token_file(spark, empty, path, 2).count() == 0 and tokens.token_counts(spark, empty, path).count() == 0


def test_words_apart_with_balanced_white_space():
    enc = tokens.WordEncoder(registry.vocabulary())
    texts = ["a\tb\n", "a\tb\n\nc", "a\u00a0b ", " the\tthe", "\u3000 a b", "a\rb  c", "a \t b\u00a0c", " ", "a b\nc"]
    ids, sizes = enc.encode(pa.array(texts))
    assert [x.tobytes() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [enc.ids(t).tobytes() for t in texts]


def test_repair_random_access():
    rng = np.random.default_rng(3)
    for base in (20, 70_000):
        ids = rng.integers(0, 12, 5000).astype(np.uint32)
        seq, rules, lengths = tokens.repair(ids, base)
        assert len(seq) < len(ids) and (tokens.expand(seq, rules, lengths, base) == ids).all()
        for a, b in ((0, 10), (17, 18), (4000, 5000), (30, 30)):
            assert (tokens.expand(seq, rules, lengths, base, a, b) == ids[a:b]).all()
    # copies shrink to a handful of symbols: rounds go on until nothing repeats
    copies = np.tile(rng.integers(0, 40_000, 64).astype(np.uint32), 4096)
    seq, rules, lengths = tokens.repair(copies, 50_000)
    assert len(seq) < 10 and len(rules) < 100 and (tokens.expand(seq, rules, lengths, 50_000) == copies).all()
    same = np.full(1001, 5, np.uint32)
    seq, rules, lengths = tokens.repair(same, 20)
    assert (tokens.expand(seq, rules, lengths, 20) == same).all()


def test_read_span(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    path = registry.vocabulary()
    tokens.write_grammar(docs, str(tmp_path / "g"), path, 2)
    tk = tokens.encoder(path).tokenizer
    stream = [i for _, t in sorted(rows(docs, "doc_id", "text")) for i in [*tk.encode(t, add_special_tokens=False).ids, 2]]
    got = sorted(rows(tokens.read_span(spark, str(tmp_path / "g"), 1000, 9000), "position", "token"))
    assert got == list(enumerate(stream))[1000:9000]


@pytest.mark.parametrize("block", [3, 64, 1 << 16])
def test_separator_scan(spark, odd, small, block):
    path = registry.vocabulary()
    tk = tokens.encoder(path).tokenizer
    docs = odd.select("doc_id", "text").union(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").where("doc_id < 40")).coalesce(2) if block < 1000 else odd.select("doc_id", "text")
    got = tokens.token_counts(spark, docs, path, 2, block).collect()
    want = sorted((d if d is not None else -1, len(tk.encode(t or "", add_special_tokens=False).ids) + 1) for d, t in rows(docs, "doc_id", "text"))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens) for r in got) == want
    by_file = defaultdict(list)
    for r in got:
        by_file[r.file].append((r.ordinal, r.start, r.n_tokens))
    for found in by_file.values():
        found.sort()
        assert [o for o, _, _ in found] == list(range(len(found)))
        assert all(a[1] + a[2] == b[1] for a, b in zip(found, found[1:], strict=False)) and found[0][1] == 0


@pytest.mark.parametrize("block", [3, 1 << 16])
def test_separator_scan_of_texts_with_any_id(spark, tmp_path, block):
    texts = ["# Title\nC# code, #1", "plain words", "<|endoftext|> and #", "", None, "#", "the last one"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    tk = tokens.encoder(registry.vocabulary()).tokenizer
    n = [len(tk.encode(t or "", add_special_tokens=False).ids) + 1 for t in texts]
    got = tokens.token_counts(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), registry.vocabulary(), block=block)
    assert sorted(rows(got, "doc_id", "start", "n_tokens")) == [(k, sum(n[:k]), n[k]) for k in range(len(n))]
    assert sorted(rows(registry.op5_token_counts(spark, str(tmp_path)), "doc_id", "n_tokens")) == list(enumerate(n))


def test_separator_scan_groups(spark):
    rng = np.random.default_rng(5)
    ids = rng.integers(0, 9, 4000).astype("<u2")
    ids[500:1500] = 3
    ids[-5:] = 4  # open at the end: no document
    blocks = spark.createDataFrame([(f, k, bytes(ids[at : at + 16].tobytes())) for f in (0, 1) for k, at in enumerate(range(0, 4000, 16))], "file int, block long, payload binary")
    ends = np.flatnonzero(ids == 2)
    want = [(f, k, int(s), int(e - s + 1)) for f in (0, 1) for k, (s, e) in enumerate(zip([0, *(ends[:-1] + 1)], ends, strict=True))]
    for group in (1, 7, 4096):
        assert tokens.scan_separators(blocks.where("false"), 2, "<u2", group).count() == 0
        assert sorted(rows(tokens.scan_separators(blocks, 2, "<u2", group), "file", "ordinal", "start", "n_tokens")) == want


DECON = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def test_capitals_are_those_of_the_whole_text():
    at = quality.STATISTICS.index("capitals")
    shares = [quality.features("word " * 5000 + tail * 5000)[1][at] for tail in ("word ", "Word ")]
    assert shares == [0.0, 0.5]


def test_decontamination(spark, small):
    docs, items = read(small, "documents"), read(small, "benchmark")
    want = brute.decontaminated(zip(docs.doc_id, docs.text, strict=True), zip(items.item_id, items.text, strict=True))
    got = rows(registry.op4_decontaminate(spark, small), *DECON)
    assert sorted(got) == sorted(want) and any(r[5] for r in want)


def test_decontamination_short_items_and_blocks(spark, odd, empty):
    texts = [(1, "a b c a b c a b c a b d"), (2, "b c a"), (2, "b c a"), (3, None), (4, "d"), (None, "b c a b c a b c a b"), (5, "!!")]
    items = spark.createDataFrame(texts, "item_id long, text string")
    docs = [(1, "x a b c a b c a b c a B! c a b d y"), (2, "c a b"), (3, "b, c; a"), (4, None), (5, "d d"), (5, "d d"), (6, "a b c a b c a b c"), (None, "b c a b c a b c a b c a b")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute.decontaminated(docs, [("" if i is None else i, t) for i, t in texts])
    for block in (1 << 20, 4):
        found = decontam.mark(df, items, block=block).collect()
        assert sorted((r.doc_id or 0, r.n_words, r.n_hit, len(r["items"]), decontam.items_digest(r["items"])) for r in found) == sorted((r[0] or 0, *r[1:5]) for r in want)
    assert decontam.mark(df, items.where("false")).where("n_hit > 0").count() == 0
    assert decontam.mark(empty, items).count() == 0
    kept = decontam.clean(df, items, longest=3, coverage=0.99).collect()
    assert {r.doc_id: r.text for r in kept}[6] == "a \n b c"
    assert sorted(r.doc_id for r in decontam.clean(df.withColumn("items", df.text), items).collect()) == [2, 4]


def test_long_items_come_in_parts(spark):
    rng = np.random.default_rng(6)
    words = [f"w{k}" for k in rng.integers(0, 400, 900)]
    items = spark.createDataFrame([(1, " ".join(words[:700])), (2, "w1 w2"), (3, " ".join(words[650:]))], "item_id long, text string")
    docs = [(k, " ".join([f"y{k}", *words[a : a + n], "z"])) for k, (a, n) in enumerate((int(a), int(n)) for a, n in zip(rng.integers(0, 880, 80), rng.integers(5, 25, 80), strict=True))]
    want = brute.decontaminated(docs, [(r.item_id, r.text) for r in items.collect()])
    for block in (40, 300):
        got = decontam.mark(spark.createDataFrame(docs, "doc_id long, text string"), items, block=block).collect()
        assert sorted((r.doc_id, r.n_words, r.n_hit, len(r["items"]), decontam.items_digest(r["items"])) for r in got) == sorted(r[:5] for r in want)
    assert sum(r[2] > 0 for r in want) > 20


def test_cleaning_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j and so on and on", "x", 5), (2, None, None, 6), (3, "clean", "y", 7)], "__n_words long, text string, __hits string, __items int")
    items = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    assert sorted(decontam.clean(docs, items).collect()) == sorted(docs.where("__n_words > 1").collect())
    cut_out = decontam.clean(docs, items, longest=5, coverage=0.9)
    assert cut_out.columns == docs.columns and sorted(r.text or "" for r in cut_out.collect()) == ["", "\n and so on and on", "clean"]


def test_near_duplicates(spark, small):
    docs = read(small, "documents")
    want = brute.near_duplicates(list(zip(docs.doc_id, docs.text, strict=True)))
    assert sorted(rows(registry.op6_near_duplicates(spark, small), "doc_id", "fingerprint", "component_id")) == sorted(want)
    assert any(d != c for d, _, c in want)


def test_near_duplicate_links_dense(spark):
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 1 << 64, 30, np.uint64)
    prints = {int(c) for c in centre}
    for c in centre[:6].tolist():  # dense clusters and chains
        for _ in range(150):
            c ^= 1 << int(rng.integers(64))
            prints.add(c)
        prints |= {c ^ (1 << int(a)) ^ (1 << int(b)) for a in range(0, 64, 3) for b in range(0, 64, 5)}
    points = np.array(sorted(prints), np.uint64)
    root = list(range(len(points)))

    def up(x):
        while root[x] != x:
            x = root[x]
        return x

    close = np.bitwise_count(points[:, None] ^ points[None, :]) <= 2
    for a, b in zip(*np.nonzero(np.triu(close, 1)), strict=True):
        root[max(up(a), up(b))] = min(up(a), up(b))
    want = [int(points[up(k)]) for k in range(len(points))]
    assert [int(points[k]) for k in simhash.forest(points, leaf=16)] == want
    df = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp long")
    expected = defaultdict(set)
    for p, w in zip(points.view(np.int64).tolist(), want, strict=True):
        expected[w].add(p)
    for edges in (simhash.links(df, sample=200, shard=64), simhash.links(df, sample=200, shard=64, most=300), simhash.by_middles(df)):
        found, groups = {r.node: r.root for r in simhash.components(edges).collect()}, defaultdict(set)
        for p in points.view(np.int64).tolist():
            groups[found.get(p, p)].add(p)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_a_ball_of_fingerprints_is_one_set(monkeypatch):
    centre, bits = 0x5A5A_1234_DEAD_BEEF, [1 << k for k in range(64)]
    ball = np.unique(np.array([centre ^ a ^ b ^ c for a in bits[:40] for b in bits for c in bits[:12]], np.uint64))
    for codes in (simhash.CODES, 1 << 16):
        monkeypatch.setattr(simhash, "CODES", codes)
        assert len(ball) > 8000 and (simhash.forest(ball) == 0).all()


@pytest.mark.parametrize("common", [1024, 2])
def test_one_row_of_each_component_stays(spark, monkeypatch, common):
    monkeypatch.setattr(common_, "COMMON", common)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    texts = [" ".join(words[k:] + words[:k]) * (k + 1) for k in range(6)] + [None, ""]
    rows = [(i, texts[t], f"x{t}") for i, t in ((4, 0), (4, 1), (4, 0), (None, 2), (None, 3), (None, 3), (None, 0), (5, 4), (6, 4), (7, 4), (9, 5), (8, 6), (8, 7), (4, 7))] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, __key string")
    got = [(r.doc_id, r.text, r["__key"]) for r in simhash.keep_one(df).collect()]
    want = {}
    for i, t, x in rows:
        f = brute.fingerprint(t)
        want[f] = min(want.get(f, (i, t)), (i, t), key=lambda r: (r[0] is None, r[0] or 0))
    assert sorted(f"{brute.fingerprint(t):x} {i}" for i, t, _ in got) == sorted(f"{f:x} {i}" for f, (i, _) in want.items())
    assert all((i, t, x) in rows for i, t, x in got)


def test_near_duplicates_odd_rows(spark, odd, empty):
    got = sorted((r.doc_id or 0, r.fp, r.component_id) for r in simhash.near_duplicates(odd).collect())
    assert [r for r in got if r[0] in (1, 2, 3)] == [(1, 0, 1), (2, 0, 1), (3, 0, 1)] and len(got) == len(ODD)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 7, 8]
    clash = odd.withColumnsRenamed({"fp": "key"}).withColumn("low", odd.text)
    assert simhash.keep_one(clash).columns == clash.columns and simhash.keep_one(clash).count() == 5


def test_mixing(spark, small):
    got = registry.op8_mixing(spark, small).collect()
    again = registry.op8_mixing(spark, small).collect()
    assert sorted(got) == sorted(again)
    docs = read(small, "documents").set_index("doc_id")
    sizes = defaultdict(int)
    for s, t in zip(docs.source, docs.text, strict=True):
        sizes[s] += len(t.split())
    want = brute.targets({s: ((5, 2, 1)[k % 3], sizes[s]) for k, s in enumerate(sorted(sizes))})
    taken, most = defaultdict(int), defaultdict(int)
    for r in got:
        s = docs.source[r.doc_id]
        assert r.size == len(docs.text[r.doc_id].split()) and r.source_size == sizes[s]
        assert math.isclose(r.target, want[s], rel_tol=1e-9) and r.taken in (0, r.size, 2 * r.size)
        taken[s] += r.taken
        most[s] = max(most[s], r.size)
    assert all(abs(taken[s] - want[s]) <= most[s] for s in sizes)
    at = [r.position for r in got if r.position is not None]
    assert at == sorted(at) and all(0 <= p <= 1 for p in at)


def test_mixing_buckets_and_schedule(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "repeat('w ', cast(1 + id % 5 as int)) as text", "case when id % 3 = 0 then 'hot' when id % 7 = 0 then null else concat('s', id % 4) end as source")
    one, two = (sorted((r.doc_id, r.taken, tuple(round(p, 9) for p in r.positions)) for r in mixing.mix(docs, bucket=b).collect()) for b in (50, 4096))
    assert one == two
    # a source's demand up to a time is the integral of its schedule
    found = mixing.mix(docs).where("source = 'hot' and repeats > 0").select("size", "target", "positions").collect()
    target = found[0].target
    for t in (0.25, 0.5, 0.9):
        used = sum(r["size"] for r in found for p in r.positions if p <= t)
        assert abs(used / target - (1.5 * t - 0.5 * t * t)) < 0.02


def test_mixing_of_equal_rows_and_ids(spark):
    """One id, or none, may hold most rows: places still differ, and equal rows share what the source is given."""
    rows = [(1, "w " * 3, "a", "x")] * 300 + [(None, f"w w{k}", "a", "x") for k in range(300)] + [(2, f"v{k}", "b", None) for k in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, __use string")
    got = mixing.mix(df, bucket=50).collect()
    sizes = {"a": 1500, "b": 100}
    want = brute.targets({"a": (5, 1500), "b": (2, 100)})
    assert len(got) == 700 and {r.source: r.source_size for r in got} == sizes
    for s in sizes:
        assert abs(sum(r.taken for r in got if r.source == s) - want[s]) <= 3
    out = mixing.mixed(df, bucket=50)
    assert out.columns == df.columns and out.count() == sum(r.repeats for r in got)
    spots = df.where("doc_id is null").select("doc_id", "text", "source")
    assert spots.count() == len({p for r in mixing.mix(spots).collect() for p in r.positions[:1]})


def test_mixing_odd_rows(spark, odd, empty):
    got = mixing.mix(odd).collect()
    assert len(got) == len(ODD) and all(r.taken <= 2 * r["size"] for r in got)
    assert {r.source: r.source_size for r in got} == {"a": 0, None: 0, "b": 11, "c": 30_000, "": 7}
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0
    out = mixing.mixed(odd)
    assert out.columns == odd.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(str(r.doc_id) for r in got for _ in range(r.repeats))


def auc(score, label):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    ones = label == 1
    return (rank[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())


def test_quality_held_out(spark):
    folder = "/root/testdata/sf0.01"
    got = registry.op2_quality(spark, folder).toPandas().merge(read(folder, "labels"), on="doc_id")
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 3 == 1 for d in got.doc_id]).all()
    held = got[got.held_out]
    assert auc(held.score.to_numpy(), held.quality.to_numpy()) > 0.9
    assert ((held.score >= 0.5) == (held.predicted == 1)).all()


def test_quality_reads_marks_lines_and_metadata(spark):
    def told(text, name):
        return quality.features(text)[1][quality.STATISTICS.index(name)]

    assert told("a\\b c", "odd_marks") > 0 == told("ab\nnn", "odd_marks")
    assert quality.features("x", (None, float("nan"), 9.0))[1][len(quality.STATISTICS) :][:6].tolist()[:4] == [0, 1, 0, 1]
    texts = spark.createDataFrame([(k, "same words here", 10 ** (1 + 5 * (k % 2)), "c") for k in range(400)] + [(500, None, None, None)], "doc_id long, text string, n_chars long, __score string")
    labels = texts.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality")
    machine = quality.train(texts, labels, metadata=("n_chars",))
    got = quality.score(texts, machine, metadata=("n_chars",)).collect()
    assert len(got) == 401 and all(r.predicted == r.doc_id % 2 for r in got if r.doc_id < 400)
    kept = quality.keep(texts, machine, metadata=("n_chars",))
    assert kept.columns == texts.columns and {r.doc_id for r in kept.collect()} - {500} == set(range(1, 400, 2))


def test_quality_pairwise_identity():
    m = quality.Machine()
    m.factors = np.random.default_rng(0).normal(size=m.factors.shape).astype(np.float32)
    where, values = quality.features("some words and some more words")
    i, v, starts = m.scaled([(where, values)])
    z = float(m.margin(i, v, starts)[0][0])
    want = sum(float(m.factors[a] @ m.factors[b]) * x * y for k, (a, x) in enumerate(zip(i, v, strict=True)) for b, y in zip(i[k + 1 :], v[k + 1 :], strict=True))
    assert math.isclose(z, want, rel_tol=1e-3)


def test_quality_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1, "x"), (4, 1, "x"), (8, 0, "y"), (None, 1, "z"), (7, None, "t")], "doc_id long, quality int, text string")
    got = quality.score(odd, quality.train(odd, labels)).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert all(r.score == 0.5 for r in quality.score(odd, quality.train(odd, labels.where("false"))).collect())
    assert quality.score(empty, quality.train(empty, labels)).count() == 0
    assert quality.keep(odd, quality.train(odd, labels)).columns == odd.columns
