from itertools import product

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspur.llm import decontam, maintext, pii, quality, registry, simhash, tokens
from tests.llm import brute

PIECES = st.sampled_from(["the", "The", "tion", "é", "ß", "word,", "end.", "..", "it's", "'s", " ", "  ", "\n", "\n\n", "\t", "\r\n", " ", "　", "\x1c", "\x01", "<|endoftext|>", "12", "7", "###", "&&&", "$$$", "!!", "?", ";", "#", "-", "_", "a.b", "汉字", "😀"])
TEXTS = st.one_of(st.lists(PIECES, max_size=30).map("".join), st.lists(PIECES, max_size=30).map(" ".join), st.text(max_size=60))


def encoded(enc, texts):
    ids, sizes = enc.encode(pa.array(texts, pa.string()))
    assert sum(sizes) == len(ids)
    return [x.tobytes() for x in np.split(ids, np.cumsum(sizes)[:-1])] if texts else []


@settings(max_examples=400, deadline=None)
@given(st.lists(TEXTS, max_size=5))
def test_words_apart_encode_as_whole_texts(texts):
    enc = tokens.encoder(registry.vocabulary())
    want = [np.array(enc.tokenizer.encode(t, add_special_tokens=False).ids, enc.dtype).tobytes() for t in texts]
    assert encoded(enc, texts) == want


def test_every_short_text_encodes_as_the_tokenizer_does():
    enc = tokens.encoder(registry.vocabulary())
    texts = ["".join(t) for n in range(6) for t in product(" \t\n\r\u00a0a,1", repeat=n)]
    want = [np.array(x.ids, enc.dtype).tobytes() for x in enc.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert encoded(enc, texts) == want
    ids, sizes = enc.encode(pa.array([None, *texts], pa.string()), 2)
    assert sizes[0] == 1 and (ids[np.cumsum(sizes) - 1] == 2).all() and len(sizes) == len(texts) + 1


def test_words_that_end_in_marks():
    enc = tokens.WordEncoder(registry.vocabulary())
    ends = ["", ".", ",", "!?", "$$$", "&*", "'", "'s", ").", ".%%%", "<|endoftext|>", "<|endoftext|>."]
    texts = [b + w + e + t for b in ("", "of ", "of\n") for w in ("word", "1", "\u00e9", "a.b", "\u0301") for e in ends for t in ("", " x", "\nx")]
    want = [np.array(x.ids, enc.dtype).tobytes() for x in enc.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert encoded(enc, texts) == want == encoded(enc, texts)


def test_the_cache_stays_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 50)
    enc = tokens.WordEncoder(registry.vocabulary())
    for k in range(0, 400, 20):
        texts = [f"word{k + j}, again{k + j}. the the" for j in range(20)]
        assert encoded(enc, texts) == [enc.ids(t).tobytes() for t in texts]
    assert len(enc.known) < 250 and len(enc.fresh) < 250


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=400), st.integers(0, 6))
def test_repair_expands_to_what_it_compressed(ids, rounds):
    ids = np.array(ids, np.uint32)
    seq, rules, lengths = tokens.repair(ids, 6, rounds or None, least=2)
    assert (tokens.expand(seq, rules, lengths, 6) == ids).all()
    for a in range(0, len(ids), 37):
        assert (tokens.expand(seq, rules, lengths, 6, a, min(a + 11, len(ids))) == ids[a : a + 11]).all()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=14), max_size=6), st.lists(st.sampled_from("abcd"), max_size=60), st.integers(1, 5))
def test_automaton_marks_what_brute_force_marks(items, doc, window):
    named = [(str(k), [w.encode() for w in item]) for k, item in enumerate(items)]
    flags, found = decontam.Automaton(named, window).marks([w.encode() for w in doc])
    hit, ids = set(), set()
    for k, item in enumerate(items):
        n = min(window, len(item))
        wins = {tuple(item[j : j + n]) for j in range(len(item) - n + 1)} if item else set()
        for j in range(len(doc) - n + 1):
            if tuple(doc[j : j + n]) in wins:
                hit |= set(range(j, j + n))
                ids.add(str(k))
    assert found == ids and {k for k, f in enumerate(flags or b"") if f} == hit


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=4))
def test_fingerprints(texts):
    assert simhash.majority([simhash.hashes(t) for t in texts]).tolist() == [brute.fingerprint(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=40, unique=True), st.integers(0, 3))
def test_tree_brings_all_pairs_together(seeds, leaves):
    points = np.unique(np.array([s ^ f for s in seeds for f in (0, 1, 6, 1 << 63)], np.uint64))
    tree = simhash.Tree(points, 4 * leaves + 1)
    held = [set(p.tolist()) for _, p in tree.route(points)]
    assert set().union(*held, set()) == set(points.tolist())
    for k, a in enumerate(points.tolist()):
        for b in points.tolist()[k + 1 :]:
            if (a ^ b).bit_count() <= 2:
                assert any(a in h and b in h for h in held)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/!-\"'= pdivbrscticle&;amx \n", max_size=200))
def test_pages_never_crash(page):
    text = maintext.main_text(page)
    assert text == " ".join(text.split())


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_features_are_finite(text):
    where, values = quality.features(text)
    assert np.isfinite(values).all() and len(where) == len(values) and where.max() < len(quality.STATISTICS) + quality.BUCKETS


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.tuples(*(st.sampled_from((-1, 0, 1)) for _ in range(4))), st.floats(0, 1e6)), max_size=20))
def test_reliabilities_are_probabilities(patterns):
    share, tables = pii.reliabilities(patterns)
    assert 0 < share < 1 and all(0 < p < 1 for pair in tables for side in pair for p in side.values())
    assert all(0 <= pii.posterior(v, share, tables) <= 1 for v, _ in patterns)
