"""Regex matches with their places, as column expressions.

regexp_extract_all gives matches without places; splitting by the same pattern gives the text between them, and the running
sums of the two sets of lengths are code-point offsets. A pattern runs once over a text without a match and twice over others.
Patterns are written so that Java neither backtracks quadratically nor recurses on long runs: repeats are possessive where nothing
they could give back would matter, and a match may begin only where a run begins or the last match has ended (\\G).

All is of the order of n log n for n matches: running sums and maxima are taken by doubling steps (sums over 1, 2, 4, ... elements),
never by an array that grows by an element, and what an inner function reads is bound to a name first, so that it is not worked out again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:long,order:int,end:long,kind:string,match:string,before:string>>"
#: Code points before a match that are kept with it, and doubling steps, enough for any array.
BEFORE, STEPS = 47, 31


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), value being worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """At each place, all values up to it combined; combine is associative."""

    def step(held: Column, back: Column) -> Column:
        return F.transform(held, lambda v, i: F.when(i >= back, combine(F.get(held, i - back), v)).otherwise(v))

    def all_steps(held: Column) -> Column:
        return F.aggregate(F.filter(F.array(*(F.lit(1 << k) for k in range(STEPS))), lambda back: back < F.size(held)), held, step)

    return bound(values, all_steps)


def matches(text: Column, kind: str, order: int, pattern: str, needs: Column | None = None) -> Column:
    """An array of (start, order, end, kind, match, before) in text order; empty where `needs`, a cheap test, does not hold.
    before: the last BEFORE code points between this match and the one of the same kind before it."""
    none = F.array().cast(SPAN)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(got: Column, between: Column) -> Column:
        sizes = F.zip_with(between, got, lambda b, m: F.length(b).cast("long") + F.coalesce(F.length(m), F.lit(0)))
        one = lambda m, i, ends: F.struct((F.get(ends, i) - F.length(m)).alias("start"), F.lit(order).alias("order"), F.get(ends, i).alias("end"), F.lit(kind).alias("kind"), m.alias("match"), F.right(F.get(between, i), F.lit(BEFORE)).alias("before"))
        return bound(running(sizes, lambda a, b: a + b), lambda ends: F.transform(got, lambda m, i: one(m, i, ends)))

    spans = bound(found, lambda got: F.when(F.size(got) > 0, bound(F.split(text, pattern, -1), lambda between: placed(got, between))).otherwise(none))
    return spans if needs is None else F.when(needs, spans).otherwise(none)


def in_order(*arrays: Column) -> Column:
    """All spans by start, then by the order of their kinds."""
    return F.array_sort(F.concat(*arrays))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def n_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def apart_from(spans: Column, others: Column) -> Column:
    """The spans that overlap none of the others: of those that begin before a span ends, the furthest end tells."""
    begun = F.transform(others, lambda o: F.struct(o["start"].alias("at"), F.lit(1).alias("told"), o["end"].alias("reach"), F.lit(None).cast("int").alias("i")))
    asked = F.transform(spans, lambda s, i: F.struct(s["end"].alias("at"), F.lit(0).alias("told"), F.lit(-1).cast("long").alias("reach"), i.alias("i")))

    def kept(own: Column) -> Column:
        def told(events: Column) -> Column:
            reach = running(F.transform(events, lambda e: e["reach"]), lambda a, b: F.greatest(a, b))
            pairs = F.filter(F.arrays_zip(events.alias("e"), reach.alias("r")), lambda p: p["e"]["i"].isNotNull())
            free = F.filter(pairs, lambda p: F.get(own, p["e"]["i"])["start"] >= p["r"])
            return F.transform(free, lambda p: F.get(own, p["e"]["i"]))

        return bound(F.array_sort(F.concat(begun, asked)), told)

    return F.when((F.size(spans) == 0) | (F.size(others) == 0), spans).otherwise(bound(spans, kept))
