import random
import re

import pytest
from pyspark.sql import functions as F

from larkspur.operators import listing, quantiles
from larkspur.operators.rules import Rule, RuleSet, classify
from larkspur.plans import catalogue
from larkspur.plans.functions import create_router
from larkspur.sources import owners, storage, versioned

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# Rows that change


def table(spark, buckets=4):
    schema = spark.createDataFrame([], "k int, v long, a string, b int").schema
    return versioned.create(spark, storage.scratch(spark, "t"), schema, "k", "v", buckets)


def latest(changes):
    """What each key has of each column: that of the greatest version, then the greatest value."""
    out = {}
    for k, v, a, b in changes:
        held = out.setdefault(k, [None, None])
        for at, value in enumerate((a, b)):
            if value is not None and (held[at] is None or ((v is not None, v or 0), value) > held[at]):
                held[at] = ((v is not None, v or 0), value)
    return sorted(((k, *(h and h[1] for h in held)) for k, held in out.items()), key=str)


def some(rng, n):
    keys = [None, *range(12), *[3] * 12]
    return [(rng.choice(keys), rng.choice([None, *range(8)]), rng.choice([None, "x", "y", ""]), rng.choice([None, 1, 2])) for _ in range(n)]


def test_latest_change_wins_whenever_it_comes_and_is_folded(spark):
    rng = random.Random(7)
    held, seen = table(spark), []
    assert versioned.current(spark, held).count() == 0 and versioned.compact(spark, held).number == 0
    for batch in range(5):
        new = some(rng, 60)
        seen += new
        df = spark.createDataFrame(new, "k int, v long, a string, b int").withColumns({"key": F.lit("clash"), "batch": F.lit("clash"), "bucket": F.lit("clash"), "c0": F.lit(1)})
        versioned.change(held, df, batch)
        versioned.change(held, df, batch)  # a batch that is tried again
        assert rows(versioned.current(spark, held)) == latest(seen)
        if batch in (1, 3):
            held = versioned.compact(spark, held)
            assert held.folded == batch and rows(versioned.current(spark, held)) == latest(seen)
    with pytest.raises(ValueError, match="folded"):
        versioned.change(held, df, 3)
    held = versioned.opened(spark, held.path)
    assert held.number == 2
    versioned.clean(spark, held)
    assert rows(versioned.current(spark, held)) == latest(seen)
    assert [(r.k, r.a) for r in versioned.point(spark, held, 3).collect()] == [(k, a) for k, a, _ in latest(seen) if k == 3]
    assert [r.a for r in versioned.point(spark, held, None).collect()] == [a for k, a, _ in latest(seen) if k is None]


def test_a_killed_compaction_changes_no_answer(spark, monkeypatch):
    rng = random.Random(8)
    held, seen = table(spark), some(rng, 50)
    put = lambda batch, found: versioned.change(held, spark.createDataFrame(found, "k int, v long, a string, b int"), batch)
    put(0, seen)

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as broken:
        broken.setattr(versioned, "_switch", killed)  # the new buckets are written, and then the driver is lost
        with pytest.raises(KeyboardInterrupt):
            versioned.compact(spark, held)
    again = versioned.opened(spark, held.path)
    assert again.number == 0 and rows(versioned.current(spark, again)) == latest(seen)
    more = some(rng, 50)
    put(1, more)
    done = versioned.compact(spark, again)
    assert done.number == 1 and rows(versioned.current(spark, done)) == latest(seen + more)
    # a reader of the state before is not disturbed until clean(), and a second compactor of it is refused
    assert rows(versioned.current(spark, again)) == latest(seen + more)
    with pytest.raises(RuntimeError, match="faster"):
        versioned.compact(spark, again)


def test_buckets_without_changes_stay_and_one_key_opens_one_bucket(spark):
    held = table(spark, 8)
    versioned.change(held, spark.range(200).select(F.col("id").alias("k"), F.lit(1).alias("v"), F.lit("x").alias("a")), 0)
    held = versioned.compact(spark, held)
    versioned.change(held, spark.createDataFrame([(5, 2, "y")], "k int, v long, a string"), 1)
    after = versioned.compact(spark, held)
    assert len(held.places) == 8 and sorted(after.places.values()) == [1] * 7 + [2]
    versioned.clean(spark, after)
    assert versioned.current(spark, after).where("a = 'y'").collect() == [(5, "y", None)] and versioned.current(spark, after).count() == 200
    text = plan(versioned.point(spark, after, 5))
    assert "PartitionFilters: [isnotnull(bucket" in text and "EqualNullSafe(key,5)" in text
    # partial maxima come before the shuffle
    assert plan(versioned.current(spark, after)).count("Aggregate") >= 2


# Pages


def test_any_page_of_a_listing(spark, tmp_path):
    rng = random.Random(9)
    found = [(rng.choice([None, *range(40)]), k, "clash") for k in range(1003)]
    df = spark.createDataFrame(found, "at int, id int, before string")
    listing.write_pages(df, "at", "id", str(tmp_path), 7)
    want = sorted(found, key=lambda r: (r[0] is None, -(r[0] or 0), -r[1]))
    for number, size in ((1, 50), (3, 50), (21, 50), (22, 50), (1, 2000), (10**6, 50), (1003, 1)):
        got = [tuple(r) for r in listing.page(spark, str(tmp_path), "at", "id", number, size).collect()]
        assert got == want[(number - 1) * size : number * size]
    listing.write_pages(df.where("false"), "at", "id", f"{tmp_path}/none", 3)
    assert listing.page(spark, f"{tmp_path}/none", "at", "id", 1).count() == 0
    with pytest.raises(ValueError):
        listing.page(spark, str(tmp_path), "at", "id", 0)
    with pytest.raises(ValueError, match="rename"):
        listing.write_pages(df.withColumnRenamed("before", "part"), "at", "id", str(tmp_path), 7)


def test_page_1000_opens_two_files_at_most(spark, tmp_path):
    df = storage.table(spark, "/root/testdata/sf0.1", "orders")
    listing.write_pages(df, "o_orderdate", "o_orderkey", str(tmp_path), 32)
    got = listing.page(spark, str(tmp_path), "o_orderdate", "o_orderkey", 1000)
    parts = re.search(r"PartitionFilters: \[(?:isnotnull\(part#\d+\), )?\(?part#\d+ (?:IN|=) \(?([\d,]+)\)", plan(got)).group(1).split(",")
    assert 1 <= len(parts) <= 2
    want = df.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).offset(999 * 50).limit(50)
    assert [r.o_orderkey for r in got.collect()] == [r.o_orderkey for r in want.collect()]


# Quantiles


def test_estimates_are_within_the_accuracy(spark):
    rng = random.Random(10)
    values = [rng.choice([1, -1]) * 10 ** rng.uniform(-9, 9) for _ in range(4000)] + [0.0] * 50 + [7.25] * 500
    parts = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    df = spark.createDataFrame([(k % 2 or None, v) for k, v in enumerate(values)] + [(1, None), (1, float("nan")), (1, float("inf")), (1, float("-inf"))], "g int, x double")
    for accuracy in (0.01, 0.05):
        for r in quantiles.estimates(quantiles.sketch(df, ["g"], "x", accuracy), ["g"], parts, accuracy).collect():
            mine = sorted(v for k, v in enumerate(values) if (k % 2 or None) == r.g)
            exact = mine[max(-(-r.part * len(mine) // 1), 1).__int__() - 1]
            assert r.n == len(mine) and abs(r.estimate - exact) <= accuracy * abs(exact) * (1 + 1e-9)
    whole = quantiles.estimates(quantiles.sketch(df, [], "x"), [], [0.5])
    assert whole.columns == ["part", "estimate", "n"] and whole.first().n == len(values)
    assert quantiles.estimates(quantiles.sketch(df.where("false"), ["g"], "x"), ["g"], parts).count() == 0


def test_sketches_by_day_are_kept_up_to_date(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    df = storage.table(spark, FOLDER, "events").select(F.to_date("ts").alias("day"), "event_type", "value", "event_id")
    quantiles.store(df.where("event_id % 3 = 0"), "day", ["event_type"], "value", path, 0)
    before = set(map(str, (tmp_path / "s").rglob("*.parquet")))
    for _ in range(2):  # tried twice, counted once
        quantiles.store(df.where("event_id % 3 > 0"), "day", ["event_type"], "value", path, 1)
    assert before <= set(map(str, (tmp_path / "s").rglob("*.parquet")))
    stored = spark.read.parquet(path)
    once = quantiles.sketch(df, ["event_type"], "value")
    assert rows(quantiles.estimates(stored, ["event_type"], [0.1, 0.5, 0.9])) == rows(quantiles.estimates(once, ["event_type"], [0.1, 0.5, 0.9]))
    day = stored.agg(F.max("day")).first()[0]
    assert "PartitionFilters: [isnotnull(day" in plan(quantiles.estimates(stored.where(F.col("day") == day), ["event_type"], [0.5]))
    exact = {r.event_type: r.m for r in df.groupBy("event_type").agg(F.expr("percentile_disc(0.9) within group (order by value)").alias("m")).collect()}
    for r in quantiles.estimates(stored, ["event_type"], [0.9]).collect():
        assert abs(r.estimate - exact[r.event_type]) <= 0.01 * exact[r.event_type]


# Owners


def test_rows_of_an_owner(spark, tmp_path):
    found = [(k % 17 if k % 3 else 0, k, "clash") for k in range(900)] + [(None, k, None) for k in range(5)]
    df = spark.createDataFrame(found, "owner int, id int, __bucket string")
    owners.write_index(df, "owner", str(tmp_path), 8, 6)
    got = owners.owned(spark, str(tmp_path), "owner", 5, 8)
    assert rows(got) == sorted((r for r in found if r[0] == 5), key=str)
    assert "PartitionFilters: [isnotnull(bucket" in plan(got) and "EqualTo(owner,5)" in plan(got)
    assert owners.owned(spark, str(tmp_path), "owner", 99, 8).count() == 0
    asked = spark.createDataFrame([(5,), (5,), (0,), (None,), (99,)], "owner int")
    many = owners.owned_by(asked, str(tmp_path), "owner", 8)
    assert many.columns == df.columns and rows(many) == sorted((r for r in found if r[0] in (0, 5)), key=str)
    owners.write_index(df.where("false"), "owner", f"{tmp_path}/none", 8, 6)
    assert owners.owned(spark, f"{tmp_path}/none", "owner", 5, 8).count() == owners.owned_by(asked, f"{tmp_path}/none", "owner", 8).count() == 0
    # the hot owner's rows were written by more than one task
    files = {r.f for r in spark.read.parquet(f"{tmp_path}/rows").where("owner = 0").select(F.input_file_name().alias("f")).collect()}
    assert len(files) > 1


def test_folders_are_chosen_at_run_time(spark, tmp_path):
    owners.write_index(storage.table(spark, FOLDER, "orders"), "o_custkey", str(tmp_path), 8, 4)
    asked = storage.table(spark, FOLDER, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    assert "dynamicpruning" in plan(owners.owned_by(asked, str(tmp_path), "o_custkey", 8))


# SQL


def test_sql_is_planned_like_the_data_frame_form(spark):
    plain = lambda df: "".join(ch for ch in optimized(df) if not ch.isdigit())
    assert plain(catalogue.sql_route(spark, FOLDER)) == plain(catalogue.intent_route(spark, FOLDER))
    text = optimized(catalogue.sql_lookup(spark, FOLDER))
    # orders are read once and not made distinct
    assert text.count("o_orderkey#") and text.count("Relation [o_orderkey") == 1 and "Aggregate" not in text and text.count("Join LeftOuter") == 1
    assert rows(catalogue.sql_lookup(spark, FOLDER)) == rows(catalogue.lookup_customers(spark, FOLDER))


def test_rules_of_any_text_as_sql(spark):
    df = spark.createDataFrame([("it's A\\b",), ("two  words and WORDS",), (None,), ("",), ("x",)], "text string")
    for rules in (RuleSet((Rule("q'\\", ("It's a\\B",)), Rule("both", (), (("two", "words"), ("zz",))), Rule("none")), "it's"), RuleSet((), "all"), RuleSet((Rule("every", (), ((),)),), "none")):
        create_router(spark, "odd name`", rules)
        df.createOrReplaceTempView("odd_rows")
        assert rows(spark.sql("SELECT text, `odd name```(text) AS label FROM odd_rows")) == rows(df.select("text", classify(F.col("text"), rules).alias("label")))
