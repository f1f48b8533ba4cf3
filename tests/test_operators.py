import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.operators import conversation, ingest, listing, lookup, metrics, retrieval
from larkspur.operators.rules import Rule, RuleSet, classify, dispatch
from larkspur.sources import knowledge, storage
from larkspur.streaming import queries as streams

ROUTER = RuleSet((Rule("balance", ("days left", "remaining days")), Rule("apply", ("book time",), (("take", "days"), ("request", "days")))), "question")


def col(spark, values, kind="string"):
    return spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")


def answers(df, column):
    return [r[0] for r in df.orderBy("k").select(column).collect()]


@pytest.mark.parametrize(
    ("text", "label"),
    [("How many DAYS LEFT?", "balance"), ("I want to book time", "apply"), ("may I take a few days", "apply"), ("request 2 days", "apply"), ("take days left", "balance"), ("take a request", "question"), ("", "question"), (None, "question")],
)
def test_first_rule_wins(spark, text, label):
    assert answers(col(spark, [text]), classify(F.col("v"), ROUTER)) == [label]


def test_rule_set_without_rules(spark):
    assert answers(col(spark, ["x"]), classify(F.col("v"), RuleSet((), "z"))) == ["z"]


KB = [(0, "a", "Travel", ["trip", "cl"], "doc a", "answer a"), (1, "b", "Pay", ["salary", "pay day", "pay"], "doc b", "answer b"), (2, "c", None, ["trip", "", None], "doc c", "answer c"), (3, "d", "", ["claim form", "claim"], "doc d", "answer d"), (4, "e", "Other", None, "doc e", "answer e")]
MESSAGES = ["A TRIP please", "pay day pay pay", "claim", "nothing", None, "travel only", "claim form for a trip"]


@pytest.mark.parametrize("fits", [True, False])
def test_retrieval(spark, fits):
    kb = knowledge.entries(spark, KB)
    found = retrieval.retrieve(spark.createDataFrame(list(enumerate(MESSAGES)), "id long, text string"), kb, fits=fits)
    got = {r.id: [(m.id, m.score) for m in r.matches] for r in found.collect()}
    # keywords count once, nested phrases each; substrings count; the category adds two; ties go by place
    assert got[1] == [("b", 4)] and got[3] == [] and got[4] == []
    assert got[0] == [("a", 1), ("c", 1)] and got[2] == [("a", 1), ("d", 1)] and got[5] == [("a", 2)]
    assert got[6] == [("a", 2), ("d", 2), ("c", 1)]
    told = {r.id: r.t for r in found.select("id", retrieval.answer("none").alias("t")).collect()}
    assert told[3] == "none" and told[2] == "answer a\n\nSource: doc a"
    assert {r.id for r in retrieval.unmatched(found).collect()} == {3, 4}


ODD_MESSAGES = [(1, "a trip"), (1, "pay day"), (None, "a trip"), (None, None), (2, "travel TRIP"), (2, "travel trip"), (3, ""), (4, "xx")]


@pytest.mark.parametrize("phrases", [10, 0])
def test_both_forms_agree_on_repeated_and_missing_ids(spark, monkeypatch, phrases):
    kb = knowledge.entries(spark, [*KB, (5, "f", "trip", ["trip", "trip", "x"], None, None)])
    rows = spark.createDataFrame([(*m, "clash") for m in ODD_MESSAGES], "id long, text string, key string")
    monkeypatch.setattr(retrieval, "PHRASES", phrases)
    one, two = (sorted((str(r.id), str(r.text), [(m.id, m.score) for m in r.matches]) for r in retrieval.retrieve(rows, kb, fits=fits).collect()) for fits in (True, False))
    assert one == two and len(one) == len(ODD_MESSAGES)
    assert ("None", "a trip", [("f", 4), ("a", 1), ("c", 1)]) in one  # repeated keywords count each time
    assert retrieval.retrieve(rows, kb.where("false"), fits=False).where("size(matches) > 0").count() == 0
    assert retrieval.retrieve(rows.where("false"), kb, fits=False).count() == 0


@pytest.mark.parametrize("known", [64, 2, 0])
def test_grams_of_any_letters(spark, monkeypatch, known):
    monkeypatch.setattr(retrieval, "KNOWN", known)
    words = ["a.b", "a+", "\\\\E x", "^x", "]-z", "[", "&&a", "line\nbreak", "\U0001f600\U0001f601", "été en", "(?s)", "-", "longer than a gram", "longer", "aa", "aaa", "aaaaaaa"]
    kb = knowledge.entries(spark, [(n, str(n), "c" if n % 2 else None, [w, words[n - 1]], "s", "a") for n, w in enumerate(words)])
    rows = spark.createDataFrame([(n, t) for n, t in enumerate([*words, "axb", "x" + "".join(words), "aaaaaa", "LONGER THAN a gram", "", None])], "id long, text string")
    one, two = (sorted((r.id, [(m.id, m.score) for m in r.matches]) for r in retrieval.retrieve(rows, kb, fits=fits).collect()) for fits in (True, False))
    assert one == two and sum(bool(m) for _, m in one) > len(words)


def test_texts_stay_where_they_are(spark):
    """retrieve_by_grams sent each text through a shuffle, to find its matches again."""
    found = retrieval.retrieve(spark.createDataFrame([(1, "a trip")], "id long, text string"), knowledge.entries(spark, KB), fits=False)
    text = retrieval.scored(found, "id")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(__key" in text and "hashpartitioning(sha2" not in text


def test_many_keywords_are_not_tried_one_by_one(spark):
    """knowledge_matched tried each of thousands of keywords on each message."""
    kb = knowledge.entries(spark, [(n, str(n), None, [f"word {n} {m}" for m in range(60)], "s", "a") for n in range(6)])
    rows = spark.createDataFrame([(1, "word 3 7 and word 5 0"), (2, "word")], "id long, text string")
    found = retrieval.retrieve(rows, kb)
    assert "regexp_extract_all" in found._jdf.queryExecution().executedPlan().toString()
    assert {r.id: [(m.id, m.score) for m in r.matches] for r in found.collect()} == {1: [("3", 1), ("5", 1)], 2: []}
    assert "regexp_extract_all" not in retrieval.retrieve(rows, kb.where("ord = 0"))._jdf.queryExecution().executedPlan().toString()


def test_context_and_prompt(spark):
    found = retrieval.retrieve(spark.createDataFrame([(1, "trip claim")], "id long, text string"), knowledge.entries(spark, KB[:4]))
    got = found.select(retrieval.context().alias("c"), T.prompt(("One.", "Two."), retrieval.context(), F.col("text")).alias("p")).collect()[0]
    assert got.c == "Source: doc a\nPolicy Details: answer a\n\nSource: doc c\nPolicy Details: answer c\n\nSource: doc d\nPolicy Details: answer d"
    assert got.p == f"One.\n\nTwo.\n\nContext:\n{got.c}\n\nQuestion: trip claim"


def test_any_keyword_ignores_categories(spark):
    rows = spark.createDataFrame(list(enumerate(MESSAGES)), "id long, text string")
    found = retrieval.any_keyword(rows, knowledge.entries(spark, KB))
    got = {r.id: [m.id for m in r.matches] for r in found.collect()}
    assert got[5] == [] and got[6] == ["a", "c", "d"]
    assert {r.id: r.t for r in found.select("id", retrieval.trailing_context("|").alias("t")).collect()}[6] == "".join(f"Source: doc {k}\nPolicy Details: answer {k}|" for k in "acd")


def test_score_equals_exploded_hits(spark, small):
    from larkspur.plans import catalogue

    docs, kb = catalogue.documents(spark, small), catalogue.base(spark)
    found = retrieval.scored(retrieval.retrieve(docs, kb), "doc_id").select("doc_id", "ord", "score")
    low = docs.select("doc_id", F.lower("text").alias("l"))
    phrases = kb.select("ord", F.explode("keywords").alias("p"), F.lit(1).alias("n")).union(kb.select("ord", "category", F.lit(2)))
    want = low.join(phrases, F.contains("l", "p")).groupBy("doc_id", "ord").agg(F.sum("n").alias("score"))
    assert sorted(found.collect()) == sorted(want.collect())


def test_tiers(spark):
    keys, one, two = (spark.createDataFrame(rows, s) for rows, s in (([(1,), (2,), (3,), (None,)], "k int"), ([(1, None, 7)], "k int, a int, b int"), ([(1, 5, 5), (2, 6, None)], "k int, a int, b int")))
    got = lookup.lookup_tiered(keys, one, two, "k")
    assert sorted(map(str, got.collect())) == sorted(map(str, [type(got.collect()[0])(**d) for d in ({"k": 1, "a": None, "b": 7, "tier": "primary"}, {"k": 2, "a": 6, "b": None, "tier": "fallback"}, {"k": 3, "a": None, "b": None, "tier": "none"}, {"k": None, "a": None, "b": None, "tier": "none"})]))
    assert {r.k for r in lookup.found_or_error(got, "no").where("error = 'no'").collect()} == {3, None}
    assert [(r.a, r.b) for r in lookup.with_defaults(one, 0, "a", "b").collect()] == [(0, 7)]
    assert [(r.k, r.kind, r.balance) for r in lookup.to_long(one, ["k"], {"a": "A", "b": "B"}).collect()] == [(1, "A", None), (1, "B", "7")]


def test_latest_is_a_prefix_of_the_sort(spark):
    rows = spark.createDataFrame([(k, k // 3) for k in range(200)], "id int, at int")
    whole = [r.id for r in rows.orderBy(F.desc("at"), F.desc("id")).collect()]
    assert [r.id for r in listing.latest(rows, "at", "id", 7).collect()] == whole[:7]
    assert "TakeOrderedAndProject" in listing.latest(rows, "at", "id")._jdf.queryExecution().executedPlan().toString()


def test_ingest_accounts_for_every_row(spark):
    rules = ingest.Constraints(("who", "text"), {"status": "new"}, {"status": ("new", "done")}, "key")
    rows = spark.createDataFrame([(1, "a", "x", None, "k1"), (2, "a", " ", "done", "k1"), (3, "", "x", None, "k2"), (4, "a", None, None, "k3"), (5, "a", "x", "odd", "k4"), (6, "a", "x", None, "k5"), (7, "a", "x", None, None), (8, "a", "x", None, None)], "n int, who string, text string, status string, key string")
    stored = spark.createDataFrame([("k5",), (None,)], "key string")
    good, bad = ingest.accept_reject(rows, rules, "n", stored)
    assert sorted(r.n for r in good.collect()) == [1, 7, 8] and {r.status for r in good.collect()} == {"new"}
    assert sorted((r.n, r.error) for r in bad.collect()) == [(2, "key exists"), (3, "who is required"), (4, "text is required"), (5, "status is not allowed"), (6, "key exists")]


ROWS = st.lists(st.tuples(st.sampled_from(["k1", "k2", "k3", None]), st.sampled_from([1, 2, None]), st.sampled_from(["a", "b", None])), max_size=12)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=ROWS)
def test_one_row_of_a_key_is_taken(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], "key string, n int, v string, rank string").coalesce(1)
    got = [(r.key, r.n, r.v) for r in ingest.enforce_unique(df, "key", "n").where("not duplicate").collect()]
    want = [min((r for r in rows if r[0] == k), key=lambda r: (r[1] is None, r[1] or 0, r[2] is not None, r[2] or "")) for k in {r[0] for r in rows} - {None}]
    assert sorted(got, key=str) == sorted(want + [r for r in rows if r[0] is None], key=str)


def test_keys_need_an_order(spark):
    rows = spark.createDataFrame([("k1", 1)] * 3 + [("k2", None)] * 2, "key string, n int")
    rules = ingest.Constraints(key="key")
    with pytest.raises(ValueError, match="order"):
        ingest.accept_reject(rows, rules)
    good, bad = ingest.accept_reject(rows, rules, "n")
    assert (good.count(), bad.count()) == (2, 3)


def test_dispatch_keeps_every_row(spark):
    rows = col(spark, ["a", "b", "x", None])
    plain, full = ({r.k: (r.reply, r.n) for r in dispatch(rows, "v", {"a": {"reply": F.lit("one")}, "b": {"n": F.col("k") * 10}}, other).collect()} for other in (None, {"reply": F.lit("what?")}))
    assert plain == {0: ("one", None), 1: (None, 10), 2: (None, None), 3: (None, None)}
    assert full[2] == full[3] == ("what?", None) and full[0] == ("one", None)


def test_applications(spark):
    at = datetime.datetime(2026, 1, 2, 3, 4, 5, 678000, datetime.UTC)
    rows = spark.createDataFrame([("e1", "Take 2 days"), ("e2", "   ")], "employee_id string, request_text string")
    got = {r.employee_id: r for r in ingest.applications(rows, ROUTER, at).collect()}
    assert got["e1"].leave_type == "apply" and got["e2"].leave_type == "question" and got["e1"].status == "submitted"
    ms = str(int(at.timestamp() * 1000))
    assert got["e1"].reference_id == "LMS-" + ms[-6:] and got["e1"].message == "Success! Your request for **apply** has been submitted for approval."
    assert got["e1"].created_at == got["e1"].updated_at == at.replace(tzinfo=None)


def test_scalars(spark):
    df = spark.createDataFrame([(0, None), (1, ""), (2, " \t\n"), (3, " "), (4, "﻿"), (5, "a//"), (6, "a")], "k int, v string")
    v = F.col("v")
    assert answers(df, T.blank(v)) == [None, True, True, True, True, False, False]
    assert answers(df, T.or_empty(v))[:2] == ["", ""]
    assert answers(df, T.strip_slash(v))[5:] == ["a/", "a"]
    assert answers(df, T.first_group(v, "(a)/"))[4:] == [None, "a", None]
    assert answers(df, T.allowed(v, "a")) == [False] * 6 + [True] and all(answers(df, T.allowed(v, None)))
    ids = answers(df, T.request_id(v))
    assert ids[6] == "a" and len(ids[0]) == len(ids[1]) == 36
    one = col(spark, [0])
    assert answers(one, T.uptime_seconds(F.lit(12_500), F.lit(0))) == [13]
    assert answers(one, T.iso(F.lit(datetime.datetime(2026, 1, 2, 3, 4, 5, 6000, datetime.UTC)))) == ["2026-01-02T03:04:05.006Z"]
    assert answers(one, T.short_reference_id(F.lit(1_700_000_012_345))) == ["LMS-12345"]


@pytest.mark.parametrize("zone", ["Europe/Paris", "America/Sao_Paulo", "UTC"])
def test_iso_is_utc_in_any_zone(spark, zone):
    times = [datetime.datetime(y, m, d, h, 30, 5, 7000, datetime.UTC) for y, m, d, h in ((2026, 3, 29, 1), (2026, 10, 25, 0), (2026, 10, 25, 1), (1969, 12, 31, 23), (2018, 11, 4, 3))]
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        df = spark.createDataFrame([(k, int(t.timestamp() * 1000)) for k, t in enumerate(times)], "k int, v long")
        assert answers(df, T.iso(F.timestamp_millis("v"))) == [t.strftime("%Y-%m-%dT%H:%M:%S.007Z") for t in times]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_query_parameters(spark):
    urls = ["http://h/p?id=a%20b%2Bc&x=1", "http://h/p?id=a+b", "http://h/p?x=1", "http://h/p?id=", "http://h/p?id=%E4%B8%AD", None]
    assert answers(col(spark, urls), storage.query_parameter(F.col("v"), "id")) == ["a b+c", "a b", None, "", "中", None]


def test_store_with_fallback(spark, small):
    rows = spark.range(3)
    assert storage.store(spark, None, rows) == (rows, False) and storage.store(spark, f"{small}/none.parquet", rows) == (rows, False)
    there, ready = storage.store(spark, f"{small}/nation.parquet", rows)
    assert ready and there.count() == 25


def test_scratch_folders_go(spark):
    path = storage.scratch(spark, "x")
    spark.range(1).write.parquet(path)
    storage.remove(spark, path)
    with pytest.raises(AnalysisException):
        spark.read.parquet(path)
    assert storage.unused(["a", "A_"], "a") == "a__"


def test_json_bodies(spark):
    raw = spark.createDataFrame([('{"id": 1001, "n": 5}',), ('{"id": "x", "n": null}',), ('{"n": 5.5}',), ("[1]",), (None,), ("x" * 50,)], "value string")
    good, bad = storage.parsed(raw, "id string, n int", limit=40)
    assert sorted(map(tuple, good.collect()), key=str) == [("1001", 5), ("x", None)]
    assert sorted(r.error for r in bad.collect()) == ["a field has another type", "body too large", "missing body", "not a JSON object"]


def test_conversation(spark):
    rows = spark.createDataFrame([(1, 2, "b", None), (1, 10, None, 5), (1, 1, "a", 3), (2, 1, None, None)], "c int, t int, x string, y int")
    assert {r.c: r.last_message for r in conversation.last_message(rows, "c", "t", "x").collect()} == {1: "", 2: ""}
    assert {r.c: r.transcript for r in conversation.transcript(rows, "c", "t", "x").collect()} == {1: ["a", "b", None], 2: [None]}
    good, bad = conversation.checked(rows, "x", "y")
    assert (good.count(), bad.count()) == (2, 2)


def test_counters(spark):
    rows = col(spark, ["a", "b", None, "a"])
    when = {"n_a": F.col("v") == "a"}
    assert [tuple(r) for r in metrics.counters(rows, when).collect()] == [(4, 2)]
    seen_rows, seen = metrics.observed(rows, when)
    seen_rows.count()
    seen_rows.collect()
    assert seen.get == {"requests_total": 4, "n_a": 2}
    r = metrics.snapshot(metrics.counters(rows, when), F.lit(3), "memory").collect()[0]
    assert r.uptime_seconds == 3 and r.counters.n_a == 2 and r.data_source == "memory"


def test_streams(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    rules = ingest.Constraints(("who", "text"), key="text")

    def feed(name, *rows):
        src.mkdir(exist_ok=True)
        (src / name).write_text("".join(f"{r}\n" for r in rows))
        stream = streams.json_stream(spark, str(src), "n long, who string, text string")
        streams.ingest_stream(stream, rules, "n", str(out / "t"), str(out / "r"), str(out / "c")).awaitTermination()

    feed("1.json", '{"n": 1, "who": "a", "text": "x"}', '{"n": 2, "who": "a", "text": "x"}', '{"n": 3, "who": "", "text": "y"}')
    feed("2.json", '{"n": 4, "who": "b", "text": "x"}', '{"n": 5, "who": "b", "text": "y"}')
    assert sorted(r.n for r in spark.read.parquet(str(out / "t")).collect()) == [1, 5]
    feed("3.json", '{"n": 6, "who": "c", "text": "y"}', '{"n": 7, "who": "c", "text": "z"}')
    assert sorted(r.n for r in spark.read.parquet(str(out / "t")).collect()) == [1, 5, 7]
    assert sorted(r.n for r in spark.read.parquet(str(out / "r")).collect()) == [2, 3, 4, 6]
    stream = streams.json_stream(spark, str(src), "n long, who string, text string")
    streams.chat_stream(stream, ROUTER, {"question": lambda t: F.concat(F.lit("on "), t), "apply": lambda t: F.lit("done")}, "text", str(out / "chat"), str(out / "chat_c")).awaitTermination()
    got = spark.read.parquet(str(out / "chat")).collect()
    assert len(got) == 14 and {r.text for r in got if r.role == "model"} == {"on x", "on y", "on z"}


def test_knowledge_file(spark, tmp_path):
    (tmp_path / "kb.json").write_text('[\n {"id": "b", "category": "C", "source": "s", "keywords": ["k", ""], "answer": "one"},\n {"id": "a", "keywords": null}\n]')
    got = knowledge.load(spark, str(tmp_path / "kb.json")).orderBy("ord").collect()
    assert [(r.ord, r.id, r["keywords"], r.question) for r in got] == [(0, "b", ["k"], None), (1, "a", [], None)] and knowledge.count(knowledge.load(spark, str(tmp_path / "kb.json"))) == 2
    (tmp_path / "bad.json").write_text("[{]")
    with pytest.raises(Exception, match="MALFORMED|malformed|Malformed"):
        knowledge.load(spark, str(tmp_path / "bad.json")).collect()


def test_rows_are_repeated(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 9), ("c", 8)], "__block string, n long")
    got = [tuple(r) for r in storage.repeated(rows, "n", "k", step=4).collect()]
    assert sorted(got) == sorted((name, n, k) for name, n in (("a", 1), ("b", 9), ("c", 8)) for k in range(n))
