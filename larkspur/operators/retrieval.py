"""Keyword-scored retrieval from a knowledge base.

An entry scores one for each of its keywords, repeats included, that occurs in the message as a substring, and BOOST if its category
does; letter case aside. Entries that score are ordered by score, then by their place in the base.

A base within ENTRIES, BYTES and KEYWORDS is one array that every message row is matched against, without any join or shuffle: matches are
ranked inside the row. A larger one is searched by grams: keywords are found by an equi-join on their first letters, as many as GRAMS
has for their length, inside the scan if the phrases are within PHRASES and PHRASE_BYTES, and then tested. Of up to KNOWN grams of a
length only these are taken from a message, else all of that length. Both forms give the same rows, whatever ids the messages have:
the second works matches out once for each distinct text, by a hash of 256 bits, and joins them back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.sources.storage import free, unused

#: What a category adds to a score, and how a match stands in a context.
BOOST = 2
SOURCE_LINE, DETAIL_LINE = "Source: ", "\nPolicy Details: "
#: Fixed value: the context where nothing matches.
NO_POLICY = "No specific company policy information was found for this query. Answer based on general knowledge."
ENTRIES, BYTES, KEYWORDS = 2000, 1 << 20, 256
GRAMS, KNOWN = (1, 2, 3, 6), 64
#: Phrases and their bytes that are sent to every executor at most.
PHRASES, PHRASE_BYTES = 200_000, 1 << 23
MATCH = "array<struct<rank:long,ord:int,id:string,source:string,answer:string,score:long>>"


def _fits(kb: DataFrame) -> bool:
    size = F.sum(F.length(F.concat_ws("", "keywords")) + F.coalesce(F.length("answer"), F.lit(0)))
    found = kb.agg(F.count(F.lit(1)).alias("n"), size.alias("size"), F.sum(F.greatest(F.size("keywords"), F.lit(0))).alias("keywords")).collect()[0]
    return found.n <= ENTRIES and (found.size or 0) <= BYTES and (found.keywords or 0) <= KEYWORDS


def _ordered(score: Column, e: Column) -> Column:
    return F.struct((-score).alias("rank"), e["ord"].alias("ord"), e["id"].alias("id"), e["source"].alias("source"), e["answer"].alias("answer"), score.alias("score"))


def _folded(kb: DataFrame) -> DataFrame:
    return kb.select("ord", "id", "source", "answer", F.lower("category").alias("category"), F.transform("keywords", F.lower).alias("keywords"))


def retrieve(messages: DataFrame, kb: DataFrame, text_col: str = "text", boost: int = BOOST, fits: bool | None = None) -> DataFrame:
    """messages with matches, best first: (rank, ord, id, source, answer, score). A column of that name is refused, not overwritten."""
    free(messages, "matches")
    folded = unused(messages.columns, "__folded")
    rows = messages.withColumn(folded, F.lower(F.coalesce(F.col(text_col), F.lit(""))))
    found = _in_rows(rows, _folded(kb), folded, boost) if (_fits(kb) if fits is None else fits) else _by_grams(rows, _folded(kb), folded, boost)
    return found.drop(folded)


def _in_rows(rows: DataFrame, kb: DataFrame, folded: str, boost: int) -> DataFrame:
    base = kb.agg(F.array_sort(F.collect_list(F.struct("ord", "id", "source", "answer", "category", "keywords"))).alias("kb"))
    held = unused(rows.columns, "__kb")
    rows = rows.withColumn(held, base.scalar())

    def scored(e: Column) -> Column:
        hits = F.size(F.filter(e["keywords"], lambda k: F.contains(F.col(folded), k))).cast("long")
        return _ordered(hits + F.when(F.contains(F.col(folded), e["category"]), boost).otherwise(0), e)

    found = F.array_sort(F.filter(F.transform(held, scored), lambda m: m["score"] > 0)).cast(MATCH)
    # a generator of one element: what comes after reads the column and doesn't work it out again for each use
    return rows.select("*", F.explode(F.array(found)).alias("matches")).drop(held)


def _grams(text: Column, n: int, known: list[str] | None) -> Column:
    """The runs of n characters, overlapping, in one linear pass: all, or those known."""
    told = f".{{{n}}}"
    if known:
        literal = lambda t: "".join(c if c.isalnum() or ord(c) > 127 else f"\\{c}" for c in t)
        heads = "".join(sorted({literal(g[0]) for g in known}))
        told = f"(?=[{heads}])(?:{'|'.join(map(literal, sorted(known)))})"
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=({told}))"), F.lit(1))


def _by_grams(rows: DataFrame, kb: DataFrame, folded: str, boost: int) -> DataFrame:
    words = kb.select("ord", F.explode("keywords").alias("phrase"), F.lit(1).cast("long").alias("worth"))
    phrases = words.union(kb.where("category is not null and category != ''").select("ord", "category", F.lit(boost).cast("long")))
    # repeated keywords count each time and are looked for once
    phrases = phrases.groupBy("ord", "phrase").agg(F.sum("worth").alias("worth"))
    size = F.greatest(*(F.when(F.length("phrase") >= n, n).otherwise(0) for n in GRAMS))
    phrases = phrases.withColumn("gram", F.substring("phrase", F.lit(1), size))
    # GRAMS rows at most
    held = phrases.groupBy(F.length("gram").alias("size")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("phrase")).alias("bytes"), F.count_distinct("gram").alias("grams")).orderBy("size").collect()
    few = phrases.where(F.length("gram").isin([h.size for h in held if h.grams <= KNOWN])).select("gram").distinct().collect()  # KNOWN a size at most
    known = {h.size: [r.gram for r in few if len(r.gram) == h.size] for h in held}
    grams = F.array_distinct(F.flatten(F.array(F.array().cast("array<string>"), *(_grams(F.col("text"), n, known[n]) for n in known))))
    key = unused(rows.columns, "__key")
    rows = rows.withColumn(key, F.sha2(F.col(folded).cast("binary"), 256))
    texts = rows.select(F.col(folded).alias("text"), F.col(key).alias("key"))
    if sum(h.n for h in held) <= PHRASES and sum(h.bytes for h in held) <= PHRASE_BYTES:
        near = texts.select("key", "text", F.explode(grams).alias("gram")).join(F.broadcast(phrases), "gram").where(F.contains("text", F.col("phrase")))
    else:
        # the estimates know nothing of what explode() makes, so no side may be broadcast on their word
        met = texts.select("key", F.explode(grams).alias("gram")).join(phrases.hint("merge"), "gram").select("key", "ord", "phrase", "worth").distinct()
        near = met.join(texts.dropDuplicates(["key"]).hint("merge"), "key").where(F.contains("text", F.col("phrase")))
    # dealt out by key once, before the entries come in
    hits = near.select("key", "ord", "phrase", "worth").distinct().repartition("key").groupBy("key", "ord").agg(F.sum("worth").alias("score"))
    entry = F.struct("ord", "id", "source", "answer")
    best = hits.join(kb.select(F.col("ord").alias("o"), entry.alias("e")), F.col("ord") == F.col("o")).groupBy("key").agg(F.array_sort(F.collect_list(_ordered(F.col("score"), F.col("e")))).cast(MATCH).alias("matches"))
    matches = unused(rows.columns, "__best")
    found = rows.join(best.select(F.struct("key", "matches").alias(matches)).hint("merge"), F.col(key) == F.col(f"{matches}.key"), "left")
    return found.select(*(c for c in rows.columns if c != key), F.coalesce(F.col(f"{matches}.matches"), F.array().cast(MATCH)).alias("matches"))


def scored(found: DataFrame, *keys: str) -> DataFrame:
    """A row for each match: keys, ord, entry_id, score."""
    return found.select(*keys, F.explode("matches").alias("m")).select(*keys, F.col("m.ord").alias("ord"), F.col("m.id").alias("entry_id"), F.col("m.score").alias("score"))


def best(found: DataFrame, *keys: str) -> DataFrame:
    """The best entry of each message that has one."""
    return found.where(F.size("matches") > 0).select(*keys, F.get("matches", F.lit(0)).alias("m")).select(*keys, F.col("m.id").alias("entry_id"), F.col("m.score").alias("score"))


def sources() -> Column:
    return F.transform("matches", lambda m: m["source"])


def context(separator: str = "\n\n", source: str = SOURCE_LINE, detail: str = DETAIL_LINE) -> Column:
    """All matches, best first, each with its source and its answer."""
    told = lambda m: F.concat(F.lit(source), F.coalesce(m["source"], F.lit("")), F.lit(detail), F.coalesce(m["answer"], F.lit("")))
    return F.array_join(F.transform("matches", told), separator)


def answer(no_match: str) -> Column:
    """The best entry's answer with its source, or the sentence for no match."""
    first = F.get("matches", F.lit(0))
    told = F.concat(F.coalesce(first["answer"], F.lit("")), F.lit("\n\nSource: "), F.coalesce(first["source"], F.lit("")))
    return F.when(F.size("matches") > 0, told).otherwise(F.lit(no_match))


def unmatched(found: DataFrame) -> DataFrame:
    return found.where(F.size("matches") == 0)


def any_keyword(messages: DataFrame, kb: DataFrame, text_col: str = "text", fits: bool | None = None) -> DataFrame:
    """The simpler rule: entries with any keyword in the message, in the base's order; categories don't count."""
    found = retrieve(messages, kb.withColumn("category", F.lit(None).cast("string")), text_col, 0, fits)
    by_ord = F.array_sort(F.transform("matches", lambda m: F.struct(m["ord"].cast("long").alias("rank"), m["ord"].alias("ord"), m["id"].alias("id"), m["source"].alias("source"), m["answer"].alias("answer"), m["score"].alias("score"))))
    return found.withColumn("matches", by_ord)


def trailing_context(separator: str = "\n\n", nothing: str = NO_POLICY, source: str = SOURCE_LINE, detail: str = DETAIL_LINE) -> Column:
    """Each match with its source and its answer, the separator after each; the sentence for none."""
    told = lambda m: F.concat(F.lit(source), F.coalesce(m["source"], F.lit("")), F.lit(detail), F.coalesce(m["answer"], F.lit("")), F.lit(separator))
    return F.when(F.size("matches") > 0, F.array_join(F.transform("matches", told), "")).otherwise(F.lit(nothing))


def answer_of_context(context: Column, no_match: str, nothing: str = NO_POLICY, source: str = SOURCE_LINE, detail: str = DETAIL_LINE.lstrip()) -> Column:
    """What is answered from a trailing_context() alone: its first details, up to a blank line, with its first source; no_match where there are none."""
    details = F.nullif(F.regexp_extract(context, rf"\Q{detail}\E([\s\S]+?)(?:\n\n|\z)", 1), F.lit(""))
    cited = F.nullif(F.regexp_extract(context, rf"\Q{source}\E(.+)", 1), F.lit(""))
    told = F.concat(details, F.coalesce(F.concat(F.lit("\n\n" + source), cited), F.lit("")))
    return F.when(context.startswith(nothing) | details.isNull(), F.lit(no_match)).otherwise(told)
