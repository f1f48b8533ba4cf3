import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.functions import calendar
from larkspur.operators import fulltext, metrics, temporal
from larkspur.plans import catalogue
from larkspur.sources import storage

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def moment(k):
    return None if k is None else datetime.datetime.fromtimestamp(k, datetime.UTC)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("stretch", [None, 1_000_000, 7_000_000, 10**12])
def test_as_of_against_a_search(spark, monkeypatch, stretch):
    monkeypatch.setattr(temporal, "GROUP", 3)
    rng = random.Random(3)
    keys = [None, 1, 1, 1, 1, 2, 3]
    left = [(rng.choice(keys), rng.choice([None, *range(-20, 60)]), k) for k in range(150)] + [(1, 5, 1007)] * 3
    right = [(rng.choice(keys), rng.choice([None, *range(-20, 60, 2)]), rng.choice([None, 1, 2]), k) for k in range(80)]
    want = []
    for key, at, k in left:
        near = [(t, tie is not None, tie, v) for key2, t, tie, v in right if key is not None and key2 == key and t is not None and at is not None and t <= at]
        best = max(((t, b, tie or 0) for t, b, tie, _ in near), default=None)
        want.append((key, k, {v for t, b, tie, v in near if (t, b, tie or 0) == best} or {None}))
    one = spark.createDataFrame([(a, moment(b), c, "clash") for a, b, c in left], "k int, at timestamp, n int, side string")
    other = spark.createDataFrame([(a, moment(b), c, d) for a, b, c, d in right], "k int, t timestamp, tie int, v int")
    got = temporal.as_of(one, other, "k", "at", "t", "tie", {"v": "told"}, stretch)
    assert got.columns == ["k", "at", "n", "side", "told"]
    found = sorted(((r.k, r.n, r.told) for r in got.collect()), key=str)
    assert len(found) == len(want)
    for (k, n, told), (k2, n2, options) in zip(found, sorted(want, key=lambda r: str((r[0], r[1]))), strict=True):
        assert (k, n) == (k2, n2) and told in options
    assert temporal.as_of(one.where("false"), other, "k", "at", "t", "tie", {"v": "told"}, stretch).count() == 0
    assert rows(temporal.as_of(one, other.where("false"), "k", "at", "t", "tie", {"v": "told"}, stretch).select("told").distinct()) == [(None,)]
    with pytest.raises(ValueError):
        temporal.as_of(one, other, "k", "at", "t", "tie", {"v": "SIDE"}, stretch)


def test_no_task_of_an_as_of_join_holds_a_key(spark):
    # one key with all rows: each stretch of time is a group of its own
    one = spark.range(20_000).select(F.lit(1).alias("k"), F.timestamp_seconds(F.col("id") * 60).alias("at"), "id")
    other = spark.range(5_000).select(F.lit(1).alias("k"), F.timestamp_seconds(F.col("id") * 240).alias("t"), F.col("id").alias("v"))
    got = temporal.as_of(one, other, "k", "at", "t", "v", {"v": "v"}, 3_600_000_000)
    assert got.where("v != id div 4").count() == 0 and got.count() == 20_000
    text = plan(got)
    assert "windowspecdefinition(key" in text and text.count("hashpartitioning(key") and "stretch" in text.split("Window")[1]
    assert "BroadcastNestedLoopJoin" not in text and "CartesianProduct" not in text


def test_overlaps_against_all_pairs(spark):
    rng = random.Random(4)

    def some(n):
        out = []
        for k in range(n):
            a = rng.choice([None, *range(-50, 200)])
            length = rng.choice([0, 1, 3, 10, 80, 5000, 10**7, -2])
            out.append((rng.choice([None, 1, 1, 2]), moment(a), None if a is None or rng.random() < 0.05 else moment(a + length), k))
        return out

    left, right = some(90), some(90)
    want = sorted((x[3], y[3]) for x in left for y in right if x[0] is not None and x[0] == y[0] and None not in (*x[1:3], *y[1:3]) and x[1] < x[2] and y[1] < y[2] and x[1] < y[2] and y[1] < x[2])
    one, other = (spark.createDataFrame(r, "k int, a timestamp, b timestamp, bin int") for r in (left, right))
    for width in (1_000_000, 60_000_000):
        found = temporal.overlaps(one, other, "k", ("a", "b"), ("a", "b"), width)
        assert sorted((r.left.bin, r.right.bin) for r in found.collect()) == want
    text = plan(found)
    assert "BroadcastNestedLoopJoin" not in text and "CartesianProduct" not in text


# Full text


def test_blocks_are_skipped_and_nothing_is_lost(spark, monkeypatch):
    monkeypatch.setattr(fulltext, "SHARDS", 4)
    docs = storage.table(spark, FOLDER, "documents").select("doc_id", "text")
    asked = storage.table(spark, FOLDER, "benchmark").select("item_id", "text")
    index = fulltext.build(docs, "doc_id", "text", storage.scratch(spark, "t"), 4, 4)
    top, effort = fulltext.search(index, asked, "item_id", "text", 3, 2)
    whole, all_of_it = fulltext.search(index, asked, "item_id", "text", 3, 1 << 30)
    assert rows(top) == rows(whole) and top.count() > 100
    told, full = effort.agg(F.sum("blocks"), F.sum("scored")).collect()[0], all_of_it.agg(F.sum("blocks"), F.sum("scored")).collect()[0]
    assert full[0] == full[1] == told[0] and told[1] < 0.7 * told[0]


def test_full_text_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, "rare word"), (1, "rare again"), (2, None), (3, ""), (None, "rare"), (4, "Word " * 3000), (5, "word"), (6, "word"), (7, "É é")], "id int, text string").withColumn("block", F.lit("clash"))
    asked = spark.createDataFrame([("a", "RARE"), ("b", "word word"), ("b", "é"), ("c", None), (None, "rare"), ("d", "unheard")], "q string, text string")
    index = fulltext.build(docs, "id", "text", storage.scratch(spark, "t"), 2, 1)
    top, _ = fulltext.search(index, asked, "q", "text", 3, 1)
    got = {}
    for r in sorted(top.collect(), key=lambda r: (r.query, r["rank"])):
        got.setdefault(r.query, []).append((r.doc, r.score))
    assert index.documents == 5 and set(got) == {"a", "b"} and [d for d, _ in got["a"]] == [1]
    # É is another word than é, and equal scores go by document
    assert [d for d, _ in got["b"]] == [7, 4, 5] and [s for _, s in got["b"]] == sorted((s for _, s in got["b"]), reverse=True)
    empty = fulltext.build(docs.where("false"), "id", "text", storage.scratch(spark, "t"))
    assert fulltext.search(empty, asked, "q", "text")[0].count() == 0


def test_a_search_opens_the_folders_of_its_words(spark):
    index = fulltext.build(storage.table(spark, FOLDER, "documents"), "doc_id", "text", storage.scratch(spark, "t"), 64, 32)
    top, _ = fulltext.search(index, spark.createDataFrame([(1, "the")], "q int, text string"), "q", "text")
    text = plan(top)
    assert "PartitionFilters: [isnotnull(shard" in text or "shard#" in text.split("PartitionFilters")[1][:80]
    assert top.count() == 10


def test_many_queries_make_no_row_for_a_pair(spark, monkeypatch):
    """fulltext_ranked over 0.1 GB made a row of each word asked for and each document that holds it."""
    monkeypatch.setattr(fulltext, "QUERIES", 7), monkeypatch.setattr(fulltext, "DOCUMENTS", 16)
    docs = storage.table(spark, FOLDER, "documents").select("doc_id", "text")
    asked = storage.table(spark, FOLDER, "benchmark").select("item_id", "text")
    index = fulltext.build(docs, "doc_id", "text", storage.scratch(spark, "t"), 4, 64)
    for k in (1, 3, 10):
        assert rows(fulltext.search_all(docs, "doc_id", "text", asked, "item_id", "text", k)) == rows(fulltext.search(index, asked, "item_id", "text", k)[0])
    # as many equal scores as there are documents, shared ids, empty rows
    odd = spark.createDataFrame([*((f"d{n:03}", "same Words") for n in range(90)), ("a", "rare word"), ("a", "rare again"), ("b", None), ("c", ""), (None, "rare"), ("e", "É é")], "id string, text string")
    few = spark.createDataFrame([("a", "RARE"), ("b", "word words"), ("b", "é"), ("c", None), (None, "rare"), ("d", "unheard"), ("e", "same")], "q string, text string")
    found = fulltext.search_all(odd, "id", "text", few, "q", "text", 3)
    assert rows(found) == rows(fulltext.search(fulltext.build(odd, "id", "text", storage.scratch(spark, "t"), 2, 1), few, "q", "text", 3)[0])
    assert [r.doc for r in sorted(found.where("query = 'e'").collect(), key=lambda r: r["rank"])] == ["d000", "d001", "d002"]
    assert fulltext.search_all(odd.where("false"), "id", "text", few, "q", "text").count() == fulltext.search_all(odd, "id", "text", few.where("false"), "q", "text").count() == 0
    text = plan(catalogue.queries()["fulltext_ranked"](spark, FOLDER))
    assert "MapInArrow" in text and "postings" not in text


def test_a_matrix_holds_all_pairs(monkeypatch):
    rng = np.random.default_rng(3)
    for dense, pairs in ((0, 5), (4, 50), (1 << 40, 1 << 20)):
        monkeypatch.setattr(fulltext, "DENSE", dense), monkeypatch.setattr(fulltext, "PAIRS", pairs), monkeypatch.setattr(fulltext, "SLAB", 3)
        sides = [np.where(rng.random((n, 40)) < rng.random(40), rng.integers(1, 1 << 20, (n, 40)), 0) for n in (9, 13)]
        packed = []
        for side in sides:
            word, row = np.nonzero(side.T)
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            packed.append((word[starts], starts.astype("<i4"), row.astype("<i4"), side[row, word]))
        assert (fulltext._matrix(*packed, (9, 13)) == sides[0] @ sides[1].T).all()


def test_only_what_reaches_the_k_th_score_is_made_exactly(monkeypatch):
    """fulltext_ranked over 6 GB made all scores in double precision and looked through them all again."""
    rng = np.random.default_rng(5)
    monkeypatch.setattr(fulltext, "SLAB", 4)
    for dense, common in ((0, 512), (1 << 40, 512), (1 << 40, 7), (4, 512)):
        monkeypatch.setattr(fulltext, "DENSE", dense), monkeypatch.setattr(fulltext, "COMMON", common)
        # sums beyond 2^24 that differ by one, equal ones, and rows of nothing
        asked, held = np.where(rng.random((9, 30)) < 0.5, rng.integers(1 << 18, 1 << 20, (9, 30)), 0), np.where(rng.random((90, 30)) < 0.5, rng.integers(2000, 2003, (90, 30)), 0)
        asked[4], held[30:60] = 0, held[0]
        row, word = np.nonzero(asked)
        queries = np.arange(30), np.cumsum((asked > 0).sum(axis=1)), word, asked[row, word]
        word, row = np.nonzero(held.T)
        docs = np.unique(word), np.flatnonzero(np.diff(word, prepend=-1)), row.astype("<i4"), held[row, word]
        scores = asked @ held.T
        for least in (np.zeros(9), np.sort(scores, axis=1)[:, -3].astype(float), np.where(np.arange(9) % 2, 0.0, scores.max(axis=1) + 1)):
            found = sorted(zip(*(x.tolist() for x in fulltext._reached(queries, docs, 90, least, 3)), strict=True))
            assert all(scores[q, d] == s and s >= max(least[q], 1) for q, d, s in found)
            want = [sorted((-int(s), d) for d, s in enumerate(line) if s >= max(least[q], 1))[:3] for q, line in enumerate(scores)]
            assert [sorted((-s, d) for p, d, s in found if p == q)[:3] for q in range(9)] == want


def test_words_of_one_number_are_numbered_anew(spark, monkeypatch):
    docs = spark.createDataFrame([(n, t) for n, t in enumerate(("ab cd", "cd ef", "ab gh", "ef"))], "id int, text string")
    asked = spark.createDataFrame([(n, t) for n, t in enumerate(("ab ef", "cd gh"))], "q int, text string")
    want = rows(fulltext.search_all(docs, "id", "text", asked, "q", "text"))
    clashes = [len(set(fulltext._numbers(str(salt), 1, [b"ab", b"cd", b"ef", b"gh"])[0].tolist())) < 4 for salt in range(20)]
    assert not all(clashes)
    salts, once = [], fulltext._number
    monkeypatch.setattr(fulltext, "DIGITS", 1), monkeypatch.setattr(fulltext, "_number", lambda salt, digits: (salts.append(salt), once(salt, digits))[1])
    assert rows(fulltext.search_all(docs, "id", "text", asked, "q", "text")) == want and len(want) == 7
    assert len(salts) == clashes.index(False) + 1


def test_new_queries_split_their_rows(spark):
    for name, column in (("late_rows", "late"), ("in_flight_by_stream", "state"), ("asof_last_click", "click_id"), ("knowledge_matched", "score"), ("answer_offline", "answer")):
        assert catalogue.queries()[name](spark, FOLDER).select(column).distinct().count() > 1, name


# Calendar and levels


def test_working_days_day_by_day(spark):
    holidays = [datetime.date(2024, 1, 1), datetime.date(2024, 1, 6), datetime.date(2024, 1, 10), datetime.date(2024, 1, 10)]
    start = datetime.date(2023, 12, 20)
    pairs = [(start + datetime.timedelta(a), start + datetime.timedelta(b)) for a in range(0, 30, 3) for b in range(0, 40, 3)] + [(datetime.date(1969, 12, 25), datetime.date(1970, 1, 9)), (None, start), (start, None)]
    free = lambda d: d.weekday() > 4 or d in holidays
    want = [None if None in p else sum(not free(p[0] + datetime.timedelta(k)) for k in range((p[1] - p[0]).days + 1)) for p in pairs]
    rows = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, a date, b date")
    got = rows.select("k", calendar.working_days(F.col("a"), F.col("b"), holidays).alias("n"), calendar.working_days(F.col("a"), F.col("b")).alias("plain"))
    assert [r.n for r in got.orderBy("k").collect()] == want
    assert "Generate" not in plan(got)


def test_levels_read_rows_once(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 1, 5), ("a", 2, -7), ("b", None, 10**12), (None, 2, None), ("b", 2, 40_000)], "x string, y int, k long")
    got = metrics.distinct_by_levels(rows, ["x", "y"], "k")
    want = rows.cube("x", "y").agg(F.count_distinct("k").alias("n"), F.grouping_id().alias("level")).select("x", "y", "level", "n")
    assert sorted(map(str, map(tuple, got.select("x", "y", "level", "n").collect()))) == sorted(map(str, map(tuple, want.collect())))
    text = plan(got)
    # the finest bitmaps are made before rows are multiplied by level
    assert text.index("Expand") < text.index("bitmap_construct_agg") or "Expand" in text.split("bitmap_construct_agg")[0]
