"""The queries of this subpackage over a folder of tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import ann, codes, credentials, decontam, maintext, mixing, pii, quality, ranked, repeats, simhash, tokens

Query = Callable[[SparkSession, str], DataFrame]
#: Of op3's files, where stored lengths delimit documents; '#' encodes to it too.
END_ID = 2
#: What of a document beside its text the quality classifier reads.
METADATA = ("n_chars",)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return ann.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "n_chars")
    return quality.score(docs, quality.train(docs, table(spark, folder, "labels"), metadata=METADATA), metadata=METADATA)


def op3_token_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.token_file(spark, table(spark, folder, "documents").select("doc_id", "text"), vocabulary(), END_ID)


def op4_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontam.mark(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))
    ids = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), ids.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.token_counts(spark, table(spark, folder, "documents").select("doc_id", "text"), vocabulary())


def op6_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return pii.digest(pii.personal_data(table(spark, folder, "documents").select("doc_id", "text")))


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    found = mixing.mix(table(spark, folder, "documents").select("doc_id", "text", "source"))
    first = F.round(F.try_element_at("positions", F.lit(1)), 9)
    return found.select("doc_id", "size", "source_size", "target", "taken", first.alias("position")).orderBy(F.col("position").asc_nulls_last(), "doc_id")


def op9_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return maintext.extract(table(spark, folder, "pages"))


def op10_secrets(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source", "lang")
    return credentials.digest(credentials.secrets(docs, repository=F.to_json(F.struct("source", "lang")), owner=F.col("source")))


def op11_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return codes.compress(table(spark, folder, "embeddings"))


def op12_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.digest(repeats.repeated(table(spark, folder, "documents").select("doc_id", "text")))


def op13_ranked(spark: SparkSession, folder: str) -> DataFrame:
    return ranked.search(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))


def queries() -> dict[str, Query]:
    first = (op1_nearest, op2_quality, op3_token_ids, op4_decontaminate, op5_token_counts, op6_near_duplicates, op7_personal_data, op8_mixing, op9_main_text, op10_secrets)
    return {f.__name__: f for f in (*first, op11_vector_codes, op12_repeats, op13_ranked)}


#: Only those that SQL can express on whole tables; the others are tested against brute force, round trips or held-out labels.
WORDS_SQL = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
DECONTAMINATE_SQL = f"""
WITH items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {WORDS_SQL} AS w FROM benchmark),
windows AS (SELECT DISTINCT item, n, array_to_string(w[k : k + n - 1], ' ') AS win FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
places AS (SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM docs, (SELECT DISTINCT n FROM windows))),
found AS (SELECT doc_id, p.n, k, item FROM places p JOIN windows USING (n, win)),
hits AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS word FROM found) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN ids USING (doc_id)"""
MIXING_SQL = """
WITH docs AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS spot FROM documents),
sources AS (SELECT *, [5e0, 2e0, 1e0][rank % 3 + 1] AS weight FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank FROM docs GROUP BY source)),
levels AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5e0 - CAST(coalesce(sum(source_size * 2) OVER (ORDER BY source_size * 2 / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)) / sum(weight) OVER (ORDER BY source_size * 2 / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM sources),
level AS (SELECT arg_min(level, (source_size * 2 / weight, rank)) AS level FROM levels WHERE level * weight <= source_size * 2),
targets AS (SELECT s.*, least(coalesce(l.level * weight, CAST(source_size * 2 AS DOUBLE)), CAST(source_size * 2 AS DOUBLE)) AS target FROM sources s, level l),
placed AS (SELECT d.*, t.source_size, t.rank, t.target, CAST(coalesce(sum(size) OVER (PARTITION BY t.rank ORDER BY spot, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) + size / 2e0 AS middle FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
used AS (SELECT *, CAST(size > 0 AND middle < target AS BIGINT) + CAST(size > 0 AND middle + source_size < target AS BIGINT) AS repeats, middle / nullif(target, 0) AS part FROM placed)
SELECT doc_id, size, source_size, target, size * repeats AS taken,
  CASE WHEN repeats = 0 THEN NULL ELSE round(CASE rank % 3
    WHEN 0 THEN 2 * part / (1.5e0 + sqrt(2.25e0 - 2 * part))
    WHEN 1 THEN part
    ELSE CASE WHEN part <= 0.25e0 THEN 2 * part / (0.2e0 + sqrt(0.04e0 + 2.4e0 * part)) ELSE 0.5e0 + 2 * (part - 0.25e0) / (0.8e0 + sqrt(0.64e0 + 5.6e0 * (part - 0.25e0))) END END, 9) END AS position
FROM used"""


def _codes_sql() -> str:
    """A round of assignment and one of means, written out as often as there are rounds."""
    steps = ["kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"]
    steps += ["parts AS MATERIALIZED (SELECT vec_id, p, v[p * (len(v) // 4) + 1 : (p + 1) * (len(v) // 4)] AS x FROM kept, range(4) r(p))"]
    steps += ["first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT 256)"]
    steps += ["book0 AS MATERIALIZED (SELECT p, entry, x AS c FROM parts JOIN first USING (vec_id))"]
    for k in range(5):
        far = "CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
        steps.append(f"near{k} AS MATERIALIZED (SELECT vec_id, p, any_value(x) AS x, min((far, entry)) AS best FROM (SELECT vec_id, p, x, entry, {far} AS far FROM parts JOIN book{k} USING (p)) GROUP BY vec_id, p)")
        if k < 4:
            told = f"SELECT p, best[2] AS entry, place, CAST(sum(x[place]) AS BIGINT) AS total, count(*) AS n FROM near{k}, (SELECT unnest(range(1, (SELECT max(len(x)) FROM parts) + 1)) AS place) GROUP BY ALL"
            steps.append(f"mean{k} AS (SELECT p, entry, list((total - ((total % n) + n) % n) // n ORDER BY place) AS c FROM ({told}) GROUP BY p, entry)")
            steps.append(f"book{k + 1} AS MATERIALIZED (SELECT p, entry, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN mean{k} m USING (p, entry))")
    steps.append("coded AS (SELECT vec_id, string_agg(format('{:02x}', best[2]), '' ORDER BY p) AS code, CAST(sum(best[1]) AS BIGINT) AS error FROM near4 GROUP BY vec_id)")
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, entry)) FROM book4) AS codebooks_sha256 FROM coded JOIN kept USING (vec_id)"


RANKED_WORDS_SQL = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
RANKED_SQL = f"""
WITH docs AS (SELECT doc_id, {RANKED_WORDS_SQL} AS w FROM documents),
whole AS (SELECT CAST(count(*) AS BIGINT) AS total_docs, CAST(sum(len(w)) AS BIGINT) AS total_terms FROM docs WHERE len(w) > 0),
held AS (SELECT doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS term FROM docs) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * total_docs + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS weight FROM held, whole GROUP BY term, total_docs),
asked AS (SELECT item_id, unnest({RANKED_WORDS_SQL}) AS term FROM benchmark),
scored AS (SELECT item_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * total_docs) // total_terms)))) AS BIGINT) AS score FROM asked JOIN held USING (term) JOIN weights USING (term), whole GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 10"""


def oracle_sql() -> dict[str, str]:
    return {"op4_decontaminate": DECONTAMINATE_SQL, "op8_mixing": MIXING_SQL, "op11_vector_codes": _codes_sql(), "op13_ranked": RANKED_SQL}
