"""Scalar expressions on text, ids and time."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The prefix of reference ids, the digits kept by the long form, and those dropped by the short one.
PREFIX, KEPT_DIGITS, DROPPED_DIGITS = "LMS-", 6, 8
#: The sentence that confirms an application, and what the client adds to it.
CONFIRMED, REFERENCE = "Success! Your request for **%s** has been submitted for approval.", " Reference ID: %s"


def blank(text: Column) -> Column:
    """Nothing but white space, byte order marks included; null for null."""
    return text.rlike(r"^(?U)[\s\x{FEFF}]*$")


def or_empty(text: Column) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(""))


def strip_slash(url: Column) -> Column:
    """Without one slash at the end."""
    return F.regexp_replace(url, "/$", "")


def first_group(text: Column, pattern: str) -> Column:
    """Group 1 of the first match; null if there is none, or it is empty."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def reference_id(ms: Column, prefix: str = PREFIX, digits: int = KEPT_DIGITS) -> Column:
    """A display value from epoch milliseconds: the last digits. It repeats, so it is no key."""
    return F.concat(F.lit(prefix), F.right(ms.cast("string"), F.lit(digits)))


def short_reference_id(ms: Column, prefix: str = PREFIX, drop: int = DROPPED_DIGITS) -> Column:
    return F.concat(F.lit(prefix), F.substring(ms.cast("string"), drop + 1, 1 << 20))


def confirmation(kind: Column, reference: Column | None = None) -> Column:
    """The service's sentence; with a reference, the client's."""
    return F.format_string(CONFIRMED, kind) if reference is None else F.format_string(CONFIRMED + REFERENCE, kind, reference)


def cited(answer: Column, source: Column) -> Column:
    return F.concat(answer, F.lit("\n\nSource: "), source)


def prompt(instructions: Sequence[str], context: Column, message: Column) -> Column:
    """Instructions, context and question as paragraphs. Labels and the order are fixed values."""
    return F.concat_ws("\n\n", *map(F.lit, instructions), F.concat(F.lit("Context:\n"), context), F.concat(F.lit("Question: "), message))


def uptime_seconds(now_ms: Column, start_ms: Column) -> Column:
    return F.round((now_ms - start_ms) / 1000).cast("long")


def iso(ts: Column) -> Column:
    """UTC, to the millisecond, whatever the session's zone: worked out from the milliseconds since 1970."""
    ms = millis(ts)
    part = lambda unit, most, width: F.lpad(F.floor(F.pmod(ms, F.lit(unit * most)) / unit).cast("string"), width, "0")
    date = F.date_from_unix_date(F.floor(ms / 86_400_000).cast("int")).cast("string")
    return F.concat(date, F.lit("T"), part(3_600_000, 24, 2), F.lit(":"), part(60_000, 60, 2), F.lit(":"), part(1000, 60, 2), F.lit("."), part(1, 1000, 3), F.lit("Z"))


def millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def request_id(supplied: Column) -> Column:
    """What was supplied, or a random id; the latter differs from run to run."""
    return F.coalesce(F.nullif(supplied, F.lit("")), F.uuid())


def field(body: Column, path: str) -> Column:
    return F.get_json_object(body, path)


def allowed(given: Column, expected: str | None) -> Column:
    """A gate by key: without an expected key everyone passes."""
    return F.lit(True) if not expected else F.coalesce(given == F.lit(expected), F.lit(False))


def as_text_or(value: Column, ok: Column, fallback: Column) -> Column:
    """The value if the reply is well-formed, else the fallback."""
    return F.when(ok & value.isNotNull(), value.cast("string")).otherwise(fallback)


def clock(now: datetime.datetime | None) -> Column:
    """A fixed time if one is given, else the time of the query."""
    return F.lit(now).cast("timestamp") if now else F.current_timestamp()


def store_label(ready: Column) -> Column:
    return F.when(ready, "table").otherwise("memory")
