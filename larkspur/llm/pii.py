"""Personal data by weak supervision. DataFrame functions only; the driver sees nothing but counts by vote pattern.

Base spans (email, ip, card, phone) are found by pattern and check, and stay. Further candidates (national phone numbers,
social security numbers, account numbers, named persons, street addresses, spelled-out mail addresses) and base matches, good
or failed, are voted on by labelers: the exactness of the form, gazetteers (names, mail domains, card issuers, reserved addresses, country codes), and words
before them for or against. Expectation
maximisation over the counts of each pattern of votes, of which there are at most len(KINDS) * 3^4, estimates how reliable each
labeler is; the posteriors train a logistic span classifier on votes, kind and length. Candidates that overlap a base span are
left out before the votes are counted; of the others those that it accepts are added.

Edge cases: null texts count as empty; empty texts have no spans; repeated rows are treated one by one; an empty table gives an
empty result, and the labelers' starting reliabilities hold; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import cut
from larkspur.llm.spans import apart_from, bound, in_order, listed, matches, n_of

BASE = ("email", "ip", "card", "phone")
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$"

#: A further part of a spelled-out domain; after a bare full stop no blank, which would end a sentence.
DOT_PART = r"(?:\x20?[\[(]dot[\])]\x20?[A-Za-z0-9-]++|\.[a-z0-9-]++(?![A-Za-z]))(?:(?<=[A-Za-z]{2})|(?=\x20?[\[(]dot|\.[a-z]))"
STREET = r"(?:Street|Avenue|Road|Lane|Drive|Boulevard|Court|St|Ave|Rd|Ln|Dr|Blvd)(?![A-Za-z])"
#: Candidates beyond the base: kind, pattern, exact form, and a cheap test for the text.
MORE = (
    ("national_phone", r"(?<![0-9+().-])(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9-])", r"^(?:\+[0-9]{1,3}[ .-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[-.])[2-9][0-9]{2}[-.][0-9]{4}$", "[0-9]"),
    ("social_security", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$", "[0-9]"),
    ("account", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,}+(?:\x20?[A-Z0-9]{1,3}+)?+(?![A-Za-z0-9])", r"^[A-Z]{2}[0-9]{2}(?: ?[0-9]{4}){3,}+(?: ?[0-9]{1,3})?$", "[0-9]"),
    ("person", r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20\p{Lu}[\p{L}'-]*+(?:\x20\p{Lu}[\p{L}'-]*+)*+", r"^(?:Mr|Mrs|Ms|Dr|Prof)\. \p{Lu}\S++ \p{Lu}\S++$", "(?:Mr|Ms|Dr|Prof)"),
    ("address", rf"(?<![0-9A-Za-z])[0-9]++\x20[A-Z][a-z]++(?:\x20(?!{STREET})[A-Z][a-z]++)*+\x20{STREET}", r"^[1-9][0-9]{0,4} .*(?:Street|Avenue|Road|Lane|Drive|Boulevard|Court)$", "[0-9]"),
    ("spelled_email", rf"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:(?:{DOT_PART})++(?<=[A-Za-z]{{2}})|\x20?(?:\.|[\[(]dot[\])])\x20?[a-z]{{2,}}+(?:{DOT_PART})*+)(?![A-Za-z])", r"\[at\].*\[dot\]", "[\\[(]at[\\])]"),
)
KINDS = (*BASE, *(m[0] for m in MORE))
#: Gazetteers: given names, mail domains, and towns' streets.
NAMES = "James|Mary|John|Patricia|Robert|Jennifer|Michael|Linda|David|Elizabeth|William|Barbara|Richard|Susan|Joseph|Jessica|Thomas|Sarah|Charles|Karen|Anna|Peter|Paul|Maria|Hans|Pierre|Marie|Carlos|Sofia"
PLACES = "gmail|yahoo|outlook|hotmail|icloud|proton|Main|Oak|Park|Elm|Maple|Cedar|Church|High|Station|Washington"
#: First digits of card issuers; addresses that no one has to himself (loopback, private, reserved, documentation); country codes.
ISSUERS = r"^(?:4|5[1-5]|2(?:2[2-9]|[3-6]|7[01]|720)|3[47]|3(?:0[0-5]|[689])|6(?:011|4[4-9]|5)|35)"
RESERVED = r"^(?:0|10|127|2(?:2[4-9]|[345][0-9]))\.|^192\.168\.|^172\.(?:1[6-9]|2[0-9]|3[01])\.|^169\.254\.|^192\.0\.[02]\.|^198\.51\.100\.|^203\.0\.113\."
COUNTRIES = r"^\+(?:1|7|2(?:[07]|[1-6][0-9]|9[01789])|3(?:[0-469]|[578][0-9])|4(?:[013-9]|2[013])|5(?:[1-8]|0[0-9]|9[0-9])|6(?:[0-6]|[789][0-9])|8(?:[1246]|[05][0-9]|8[06])|9(?:[0-58]|[679][0-9]))"
#: Words shortly before a span that speak for personal data, and against.
FOR = r"(?:call|phone|tel|mobile|fax|contact|reach|write|mail|e-mail|ssn|social security|iban|account|card|name is|named|dear|signed|lives? at|address|resid|born|patient|customer)\W{0,3}(?:\w+\W{1,3}){0,2}$"
AGAINST = r"(?:version|release|isbn|page|chapter|section|order|invoice|item|model|serial|build|figure|table|example|sample|part no)\W{0,3}(?:\w+\W{1,3}){0,1}$"
LABELERS = ("form", "gazetteer", "for", "against")


def _found(text: Column) -> dict[str, Column]:
    """All base matches, unchecked, by kind."""
    digit = text.rlike("[0-9]")
    return {"email": matches(text, "email", 0, EMAIL, F.contains(text, F.lit("@"))), "ip": matches(text, "ip", 1, IP, digit), "card": matches(text, "card", 2, CARD, digit), "phone": matches(text, "phone", 3, PHONE, F.contains(text, F.lit("+")))}


def _checked() -> tuple[Column, Column]:
    """Of the columns email, ip, card and phone: the good spans in order, and those that look right but fail."""
    figures = lambda s: F.regexp_replace(s["match"], "[^0-9]", "")
    sized = lambda s: F.length(figures(s)).between(14, 19)
    is_ip, is_phone = lambda s: s["match"].rlike(OCTETS), lambda s: F.length(figures(s)).between(10, 15)
    is_card = lambda s: F.when(sized(s), F.call_function("luhn_check", figures(s))).otherwise(False)
    good = in_order(F.col("email"), F.filter("ip", is_ip), F.filter("card", is_card), F.filter("phone", is_phone))
    return good, F.concat(F.filter("ip", lambda s: ~is_ip(s)), F.filter("card", lambda s: sized(s) & ~is_card(s)), F.filter("phone", lambda s: ~is_phone(s)))


def _more(text: Column) -> Column:
    return F.concat(*(matches(text, kind, len(BASE) + k, pattern, text.rlike(test)) for k, (kind, pattern, _, test) in enumerate(MORE)))


def _voted(spans: Column, state: str) -> Column:
    """Spans with the votes of the labelers: 1 personal, -1 not, 0 no vote. state: base (checked), failed or more."""

    def votes(s: Column) -> Column:
        before = F.lower(s["before"])
        if state == "more":
            form = F.lit(0)
            for kind, _, exact, _ in MORE:
                form = F.when((s["kind"] == kind) & s["match"].rlike(exact), 1).otherwise(form)
        else:
            form = F.lit(1 if state == "base" else -1)
        known = lambda pattern, yes, no: F.when(figures.rlike(pattern), yes).otherwise(no)
        figures = F.regexp_replace(s["match"], "[^0-9.+]", "")
        gazetteer = F.when(s["kind"] == "card", known(ISSUERS, 1, -1)).when(s["kind"] == "ip", known(RESERVED, -1, 1)).when(s["kind"] == "phone", known(COUNTRIES, 1, -1))
        gazetteer = gazetteer.when(s["match"].rlike(rf"(?:{NAMES}|{PLACES})"), 1).otherwise(0)
        speaks, denies = F.when(before.rlike(FOR), 1).otherwise(0), F.when(before.rlike(AGAINST), -1).otherwise(0)
        wide = F.when(F.length(s["match"]) < 9, 0).when(F.length(s["match"]) < 16, 1).otherwise(2)
        return F.struct(s["start"].alias("start"), s["order"].alias("order"), s["end"].alias("end"), s["kind"].alias("kind"), form.alias("form"), gazetteer.alias("gazetteer"), speaks.alias("for"), denies.alias("against"), wide.alias("wide"))

    return F.transform(spans, votes)


def reliabilities(patterns: list[tuple[tuple[int, ...], float]], rounds: int = 40) -> tuple[float, list[tuple[dict, dict]]]:
    """Expectation maximisation over (votes, count): the share of personal data, and for each labeler how likely each vote is
    on personal data and off it. Starting beliefs count as PRIOR observations, so sparse corpora stay near them."""
    prior, starts = 20.0, ({1: 0.6, 0: 0.35, -1: 0.05}, {1: 0.05, 0: 0.6, -1: 0.35})
    share, tables = 0.5, [(dict(starts[0]), dict(starts[1])) for _ in LABELERS]
    for _ in range(rounds):
        sums = [[{v: prior * p for v, p in start.items()} for start in starts] for _ in LABELERS]
        ones, total = prior / 2, prior
        for votes, n in patterns:
            p = posterior(votes, share, tables)
            ones, total = ones + n * p, total + n
            for k, v in enumerate(votes):
                sums[k][0][v] += n * p
                sums[k][1][v] += n * (1 - p)
        share = min(max(ones / total, 0.02), 0.98)
        tables = [tuple({v: x / sum(side.values()) for v, x in side.items()} for side in pair) for pair in sums]
    return share, tables


def posterior(votes: tuple[int, ...], share: float, tables: list) -> float:
    yes, no = math.log(share), math.log(1 - share)
    for v, (on, off) in zip(votes, tables, strict=True):
        yes, no = yes + math.log(on[v]), no + math.log(off[v])
    return 1 / (1 + math.exp(min(max(no - yes, -50), 50)))


def classifier(rows: list[tuple[tuple[int, ...], int, int, float, float]], rounds: int = 300) -> list[float]:
    """Logistic regression by gradient steps on (votes, kind number, width, count, posterior); weights of features()."""
    n_features = len(_features((0,) * len(LABELERS), 0, 0))
    # where there is nothing to learn from: two votes for and none against make personal data
    weights = [-1.5, 2.0, 1.0, 1.5, -2.0] + [0.0] * (n_features - 5)
    seen = [1e-3] * n_features
    total = sum(r[3] for r in rows) + 20.0
    for _ in range(rounds if rows else 0):
        slopes = [1e-3 * (w - (-1.5, 2.0, 1.0, 1.5, -2.0)[k] if k < 5 else w) for k, w in enumerate(weights)]
        for votes, kind, wide, n, target in rows:
            x = _features(votes, kind, wide)
            z = sum(w * v for w, v in zip(weights, x, strict=True))
            wrong = n / total * (1 / (1 + math.exp(min(max(-z, -50), 50))) - target)
            for k, v in enumerate(x):
                slopes[k] += wrong * v
        for k, g in enumerate(slopes):
            seen[k] += g * g
            weights[k] -= 0.1 * g / math.sqrt(seen[k])
    return weights


def _features(votes: tuple, kind: int, wide: int) -> list[float]:
    form, gazetteer, speaks, denies = votes
    return [1.0, float(form), float(gazetteer), float(speaks), float(-denies), *(float(wide == k) for k in range(1, 3)), *(float(kind == k) for k in range(len(KINDS)))]


def _margin(s: Column, weights: list[float]) -> Column:
    x = [F.lit(1.0), s["form"], s["gazetteer"], s["for"], -s["against"], (s["wide"] == 1).cast("double"), (s["wide"] == 2).cast("double"), *((s["order"] == k).cast("double") for k in range(len(KINDS)))]
    return sum((F.lit(w) * v for w, v in zip(weights[1:], x[1:], strict=True)), F.lit(weights[0]))


def _log_odds(s: Column, share: float, tables: list) -> Column:
    """posterior() as a column, before the last step."""
    out = F.lit(math.log(share) - math.log(1 - share))
    for name, (on, off) in zip(LABELERS, tables, strict=True):
        ratio = {v: math.log(on[v]) - math.log(off[v]) for v in on}
        out = out + F.when(s[name] == 1, ratio[1]).when(s[name] == -1, ratio[-1]).otherwise(ratio[0])
    return out


def _place(s: Column) -> list[Column]:
    return [s["start"].alias("start"), s["order"].alias("order"), s["end"].alias("end"), s["kind"].alias("kind")]


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, base (spans by pattern) and spans (all), as arrays of (start, order, end, kind), and judged: for each
    candidate its place, the labelers' votes, the posterior by their reliabilities, the classifier's probability, and whether the method added it."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", *(c.alias(k) for k, c in _found(F.col("text")).items()), _more(F.col("text")).alias("more"))
    good, failed = _checked()
    rows = rows.select("doc_id", good.alias("base"), failed.alias("failed"), "more")
    # what lies in a base span is found already, and would count a second time
    rows = rows.withColumn("more", F.when(F.size("more") > 0, apart_from(F.col("more"), F.col("base"))).otherwise(F.col("more")))
    bare = lambda c: F.transform(c, lambda s: F.struct(*_place(s)))
    rows = rows.select("doc_id", bare(F.col("base")).alias("base"), _voted(F.col("base"), "base").alias("checked"), _voted(F.col("failed"), "failed").alias("failed"), _voted(F.col("more"), "more").alias("more"))
    rows = cut(rows)
    counts = rows.where(F.size("checked") + F.size("failed") + F.size("more") > 0).select(F.explode(F.concat("checked", "failed", "more")).alias("s")).groupBy("s.kind", "s.form", "s.gazetteer", "s.for", "s.against", "s.wide").count().collect()
    patterns = [((r["form"], r["gazetteer"], r["for"], r["against"]), KINDS.index(r["kind"]), r["wide"], float(r["count"])) for r in sorted(counts)]
    share, tables = reliabilities([(votes, n) for votes, _, _, n in patterns])
    weights = classifier([(votes, kind, wide, n, posterior(votes, share, tables)) for votes, kind, wide, n in patterns])
    sure = lambda z: 1 / (1 + F.exp(-z))
    judge = lambda s, added: F.struct(*_place(s), *(s[name].alias(name) for name in LABELERS), sure(_log_odds(s, share, tables)).alias("posterior"), sure(_margin(s, weights)).alias("probability"), added.alias("added"))
    accepted = F.filter("more", lambda s: _margin(s, weights) >= 0.0)
    rows = rows.select("doc_id", "base", "checked", "failed", "more", bare(accepted).alias("added"))
    # places added are few and in order for each kind, so a look-up by place is one in a map
    taken = F.map_from_arrays(F.transform("added", lambda s: F.concat_ws(":", s["order"], s["start"])), F.transform("added", lambda s: F.lit(True)))
    judged = bound(taken, lambda t: F.array_sort(F.concat(F.transform(F.concat("checked", "failed"), lambda s: judge(s, F.lit(False))), F.transform("more", lambda s: judge(s, F.try_element_at(t, F.concat_ws(":", s["order"], s["start"])).isNotNull())))))
    return rows.select("doc_id", "base", in_order(F.col("base"), F.col("added")).alias("spans"), judged.alias("judged"))


def digest(found: DataFrame) -> DataFrame:
    """Counts and lists as one line a document; judged: kind:start:end:posterior (both in hundredths):probability:votes of all candidates."""
    base = F.col("base")
    hundredths = lambda c: F.round(c * 100).cast("int").cast("string")
    judged = F.array_join(F.transform("judged", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"), hundredths(s["posterior"]), hundredths(s["probability"]), *(s[name].cast("string") for name in LABELERS))), ",")
    return found.select("doc_id", *(n_of(base, k).alias(f"n_{k}") for k in BASE), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added"), judged.alias("judged"))
