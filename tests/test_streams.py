import datetime
import random

import pytest
from pyspark.sql import functions as F

from larkspur.operators import ingest, retrieval, service
from larkspur.sources import knowledge, storage
from larkspur.streaming import queries as streams
from larkspur.streaming import sessions

HOUR = datetime.timedelta(hours=1)


def moment(hours):
    return datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC) + hours * HOUR


def put(spark, rows, schema, path):
    storage.to_json_rows(spark.createDataFrame(rows, schema)).coalesce(1).write.mode("append").text(path)


def guarded(batches, timeout, delay):
    """What becomes of (owner, id, hour, asks) rows, batch by batch."""
    held, out, high = {}, [], None
    for batch in batches:
        fresh = [r for r in batch if high is None or r[2] >= high - delay]
        for owner, k, at, asks in sorted(fresh, key=lambda r: (r[2], r[1], r[3])):
            if owner in held and at >= held[owner][1] + timeout:
                out.append((owner, held.pop(owner)[0], "timed out"))
            if not asks:
                if owner in held:
                    out.append((owner, held.pop(owner)[0], "answered"))
            elif owner in held:
                out.append((owner, k, "refused"))
            else:
                held[owner] = (k, at)
                out.append((owner, k, "accepted"))
        high = max([r[2] for r in batch] + ([] if high is None else [high]))
        for owner in [o for o, (_, at) in held.items() if at + timeout <= high - delay]:
            out.append((owner, held.pop(owner)[0], "timed out"))
    return sorted(out)


def test_guard_of_open_requests_goes_on_after_a_restart(spark, tmp_path):
    rng = random.Random(5)
    batches = [[(rng.randrange(6), 100 * b + k, 20.0 * b + rng.random() * 20, rng.random() < 0.7) for k in range(60)] for b in range(3)]
    batches[1].append((3, 900, -500.0, True))  # far too late for the watermark
    for batch in batches:
        put(spark, [(o, k, moment(h), a) for o, k, h, a in batch], "owner int, id long, at timestamp, asks boolean", f"{tmp_path}/in")
        stream = streams.json_stream(spark, f"{tmp_path}/in", "owner int, id long, at timestamp, asks boolean")
        # each time a new query on the same state
        streams.guard_stream(stream, "owner", "id", "at", "asks", 3 * HOUR, "2 hours", f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    found = sorted((r.owner, r.id, r.state) for r in got.collect())
    assert found == guarded(batches, 3, 2) and {s for _, _, s in found} == {"accepted", "refused", "answered", "timed out"}
    # one open request an owner: each accepted one ends once at most
    ends = got.where("state in ('answered', 'timed out')").groupBy("owner", "id").count()
    assert ends.where("count > 1").count() == 0


def test_guard_leaves_out_what_is_no_request(spark, tmp_path):
    rows = [(None, 1, moment(0), True), (1, None, moment(0), True), (1, 2, None, True), (1, 3, moment(1), None), (1, 4, moment(2), True)]
    put(spark, rows, "owner int, id long, at timestamp, asks boolean", f"{tmp_path}/in")
    stream = streams.json_stream(spark, f"{tmp_path}/in", "owner int, id long, at timestamp, asks boolean")
    streams.guard_stream(stream, "owner", "id", "at", "asks", HOUR, "1 hour", f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert [(r.owner, r.id, r.state) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [(1, 4, "accepted")]
    with pytest.raises(ValueError):
        streams.guard_stream(stream.withColumnRenamed("owner", "state"), "state", "id", "at", "asks", HOUR, "1 hour", "x", "y")


def test_keys_are_kept_by_the_stream_and_stored_rows_are_read_once(spark, tmp_path):
    rules = ingest.Constraints(("key",), key="key")
    stored = spark.createDataFrame([("old",), (None,)], "key string")
    schema = "key string, n int, note string, error_ string"
    first = [("a", 2, "second", ""), ("a", 1, "first", ""), ("a", None, "no order", ""), ("old", 1, "", ""), ("", 1, "", ""), (None, 1, "", ""), ("b", 1, "x", ""), ("b", 1, "x", "")]
    second = [("a", 0, "too late", ""), ("c", 1, "", ""), ("old", 5, "", ""), ("b", 1, "x", "")]
    for number, rows in enumerate((first, second)):
        put(spark, rows, schema, f"{tmp_path}/in")
        stream = streams.json_stream(spark, f"{tmp_path}/in", schema)
        streams.ingest_stream(stream, rules, "n", f"{tmp_path}/t", f"{tmp_path}/r", f"{tmp_path}/c", stored if not number else spark.createDataFrame([], "key string")).awaitTermination()
    table, rejects = spark.read.parquet(f"{tmp_path}/t"), spark.read.parquet(f"{tmp_path}/r")
    assert sorted((r.key, r.n, r.note) for r in table.collect()) == [("a", 1, "first"), ("b", 1, "x"), ("c", 1, "")]
    assert table.count() + rejects.count() == len(first) + len(second)
    assert {r.error for r in rejects.collect()} == {"key is required", "key exists"}


def test_late_rows_are_kept_apart_batch_by_batch(spark, tmp_path):
    batches = [[(1, 10.0), (2, 12.0)], [(3, 9.0), (4, 11.5), (5, None), (6, 30.0)], [(7, 12.0), (8, 29.5), (9, 28.0)]]
    for batch in batches:
        put(spark, [(k, None if h is None else moment(h)) for k, h in batch], "id int, at timestamp", f"{tmp_path}/in")
        stream = streams.json_stream(spark, f"{tmp_path}/in", "id int, at timestamp")
        sessions.part_late(stream, "at", "2 hours", f"{tmp_path}/a", f"{tmp_path}/l", f"{tmp_path}/m", f"{tmp_path}/c").awaitTermination()
    ids = lambda name: sorted(r.id for r in spark.read.parquet(f"{tmp_path}/{name}").collect())
    assert ids("l") == [3, 5, 7] and ids("a") == [1, 2, 4, 6, 8, 9]


def test_sessions_of_a_table(spark):
    rows = [("a", 0.0), ("a", 0.5), ("a", 1.5), ("a", 2.6), ("b", 0.0), ("b", None), (None, 1.0)]
    df = spark.createDataFrame([(k, None if h is None else moment(h)) for k, h in rows], "k string, at timestamp")
    got = sorted((str(r.k), r.n) for r in sessions.sessions_of_table(df, "k", "at", "1 hour").collect())
    assert got == [("None", 1), ("a", 1), ("a", 3), ("b", 1)]


def test_tables_with_a_result_s_column_are_refused(spark):
    kb = knowledge.entries(spark, [(0, "a", "x", ["y"], "s", "t")])
    row = lambda *names: spark.createDataFrame([("1",) * len(names)], ", ".join(f"{n} string" for n in names))
    for call in (
        lambda: retrieval.retrieve(row("text", "MATCHES"), kb),
        lambda: ingest.validate(row("a", "error"), ingest.Constraints()),
        lambda: ingest.enforce_unique(row("a", "duplicate"), "a", "a"),
        lambda: service.chat(row("message", "sources"), kb, "none"),
        lambda: storage.parsed(row("error"), "n int", "error"),
    ):
        with pytest.raises(ValueError, match="rename"):
            call()
    good, bad = storage.parsed(row("value", "error"), "n int")
    assert (good.count(), bad.count()) == (0, 1)


def test_client_context(spark):
    kb = knowledge.entries(spark, [(0, "a", "x", ["trip"], "one", "first\npart\n\nrest"), (1, "b", "trip", ["pay"], "two", "second"), (2, "c", None, ["trip"], "three", None)])
    found = retrieval.any_keyword(spark.createDataFrame([(1, "a TRIP"), (2, "pay"), (3, "none"), (4, None)], "id int, text string"), kb)
    context = retrieval.trailing_context()
    got = {r.id: (r.c, r.a) for r in found.select("id", context.alias("c"), retrieval.answer_of_context(context, "nothing found").alias("a")).collect()}
    assert got[1] == ("Source: one\nPolicy Details: first\npart\n\nrest\n\nSource: three\nPolicy Details: \n\n", "first\npart\n\nSource: one")
    assert got[2] == ("Source: two\nPolicy Details: second\n\n", "second\n\nSource: two")
    assert got[3] == got[4] == (retrieval.NO_POLICY, "nothing found")


def test_knowledge_in_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(knowledge, "ENTRIES", 3)
    rows = [(k, f"id{k}", "c", [f"word{k}", ""], "s", "é\n") for k in range(8)]
    knowledge.write(knowledge.entries(spark, rows), f"{tmp_path}/kb")
    got = knowledge.load(spark, f"{tmp_path}/kb")
    assert sorted((r.ord, r.id, r.keywords[0], r.answer) for r in got.collect()) == [(k, f"id{k}", f"word{k}", "é\n") for k in range(8)]


def test_full_text_and_sessions_need_no_python(spark):
    df = sessions.sessions_of_table(spark.range(3).select("id", F.current_timestamp().alias("at")), "id", "at", "1 hour")
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
