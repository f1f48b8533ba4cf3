"""Secrets, and how widely each is copied. DataFrame functions only.

Base spans (assign, access, hex) are found by pattern and length, and stay. Further forms (tokens of known services, signed
web tokens, bearer tokens, passwords in addresses, key blocks) are candidates. Every candidate's value is hashed; over the whole
corpus a hash's distinct repositories and owners are counted. Few owners: it looks live. Many: it is a widely copied example. Further forms are
added where they look live and overlap no base span; `verdicts` says for every span what was found.

Edge cases: null texts count as empty; null repositories and owners count as one each; repeated rows get equal results and add no
owner; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import attach, cut
from larkspur.llm.spans import apart_from, in_order, listed, matches, n_of

BASE = ("assign", "access", "hex")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS, HEX = r"AKIA[A-Z0-9]++", r"(?:\G|(?<![0-9a-f]))[0-9a-f]{24,}+"
#: Further forms: kind, pattern, a cheap test for the text. No repeat is capped, but for a short scheme that may follow a plus.
MORE = (
    ("service", r"(?<![A-Za-z0-9_])(?:gh[pousr]_[A-Za-z0-9]{36,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|AIza[0-9A-Za-z_-]{35}|sk_live_[0-9A-Za-z]{16,}+|glpat-[0-9A-Za-z_-]{20,}+|npm_[A-Za-z0-9]{36})(?![A-Za-z0-9])", "[_-]|AIza"),
    ("web_token", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{16,}+", "eyJ"),
    ("bearer", r"(?i:bearer)\x20[A-Za-z0-9._~+/-]{20,}+={0,2}", "(?i:bearer)"),
    ("address_password", r"(?:(?<![A-Za-z0-9])[a-z][a-z0-9+]{1,15}+|(?<![A-Za-z0-9+])[a-z][a-z0-9+]{16,}+)://[^\s:/@]++:[^\s:/@]{6,}+@", "://"),
    ("key_block", r"-----BEGIN [A-Z ]*+(?<=PRIVATE KEY)-----[A-Za-z0-9+/=\s]{32,}+-----END", "-----BEGIN"),
)
#: A value is live-looking with at most so many distinct owners and repositories; and, where there are few of them, at most this part of all, but
#: for one owner and two repositories.
OWNERS, REPOSITORIES, PART = 3, 6, 20


def _base(text: Column) -> Column:
    assign = F.filter(matches(text, "assign", 0, ASSIGN, text.rlike("[:=]")), lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 1)) >= 6)
    access = F.filter(matches(text, "access", 1, ACCESS, F.contains(text, F.lit("AKIA"))), lambda s: F.length(s["match"]) >= 20)
    return in_order(assign, access, matches(text, "hex", 2, HEX))


def _hashed(spans: Column) -> Column:
    """Spans with the hash of the value, which for an assignment is what is assigned."""
    value = lambda s: F.when(s["kind"] == "assign", F.regexp_extract(s["match"], ASSIGN, 1)).otherwise(s["match"])
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["order"].alias("order"), s["end"].alias("end"), s["kind"].alias("kind"), F.sha2(value(s).cast("binary"), 256).alias("value")))


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository: Column | None = None, owner: Column | None = None, owners: int | None = None, repositories: int | None = None) -> DataFrame:
    """owners, repositories: how many a live-looking value has at most; by default from OWNERS, REPOSITORIES and PART. Per document: doc_id, base and spans (start, order, end, kind, value), and verdicts (start, end, kind, n_repositories, n_owners, live)."""
    owner = F.col("source") if owner is None else owner
    repository = owner if repository is None else repository
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), repository.cast("string").alias("repository"), owner.cast("string").alias("owner"), text.alias("text"), F.xxhash64(text).alias("key"))
    more = F.concat(*(matches(F.col("text"), kind, len(BASE) + k, pattern, F.col("text").rlike(test)) for k, (kind, pattern, test) in enumerate(MORE)))
    rows = rows.withColumns({"base": _base(F.col("text")), "more": more})
    rows = cut(rows.select("doc_id", "repository", "owner", "key", _hashed(F.col("base")).alias("base"), _hashed(F.col("more")).alias("more")))
    each = rows.where(F.size("base") + F.size("more") > 0).select("doc_id", "key", "repository", "owner", F.explode(F.concat("base", "more")).alias("s"))
    distinct = lambda name: F.count_distinct(name) + F.max(F.col(name).isNull().cast("long"))
    spread = each.groupBy("s.value", "repository", "owner").agg(F.count(F.lit(1)).alias("n")).groupBy("value").agg(distinct("repository").alias("n_repositories"), distinct("owner").alias("n_owners"), F.sum("n").alias("n"))
    told = attach(each.select("doc_id", "key", "s.*").distinct(), spread, "value", "n")
    whole = rows.agg(distinct("repository").alias("repositories"), distinct("owner").alias("owners")).collect()[0]
    owners = min(OWNERS, max(1, (whole.owners or 0) // PART)) if owners is None else owners
    repositories = min(REPOSITORIES, max(2, (whole.repositories or 0) // PART)) if repositories is None else repositories
    verdict = F.struct("start", "order", "end", "kind", "value", "n_repositories", "n_owners", ((F.col("n_owners") <= owners) & (F.col("n_repositories") <= repositories)).alias("live"))
    by_doc = told.groupBy(F.col("doc_id").alias("own_id"), F.col("key").alias("own_key")).agg(F.array_sort(F.collect_set(verdict)).alias("verdicts"))
    found = rows.join(by_doc, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("key") == F.col("own_key")), "left")
    bare = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["order"].alias("order"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value")))
    live = bare(F.filter(F.col("verdicts"), lambda s: s["live"] & (s["order"] >= len(BASE))))
    added = F.when(F.size("more") > 0, apart_from(live, F.col("base"))).otherwise(F.filter("more", lambda s: F.lit(False)))
    return found.select("doc_id", "base", in_order(F.col("base"), added).alias("spans"), "verdicts")


def digest(found: DataFrame) -> DataFrame:
    base = F.col("base")
    n_live = F.size(F.filter("verdicts", lambda s: s["live"]))
    spread = F.array_join(F.transform("verdicts", lambda s: F.concat_ws(":", s["kind"], *(s[name].cast("string") for name in ("start", "end", "n_repositories", "n_owners")))), ",")
    return found.select("doc_id", *(n_of(base, k).alias(f"n_{k}") for k in BASE), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), F.coalesce(F.when(F.col("verdicts").isNotNull(), n_live), F.lit(0)).cast("long").alias("n_live"), F.coalesce(spread, F.lit("")).alias("ownership"))
