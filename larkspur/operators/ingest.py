"""Validated append: required fields, defaults, allowed values, unique keys."""

from __future__ import annotations

import datetime
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.operators.rules import RuleSet, classify
from larkspur.sources.storage import free, repeated, unused


@dataclass(frozen=True)
class Constraints:
    """Fields that may not be null or empty, values for nulls, allowed values, and the key."""

    required: tuple[str, ...] = ()
    defaults: dict[str, str] = field(default_factory=dict)
    allowed: dict[str, tuple[str, ...]] = field(default_factory=dict)
    key: str | None = None


def violation(constraints: Constraints) -> Column:
    """The first constraint on a row that does not hold, as text; null if all do."""
    found = F.lit(None).cast("string")
    for name, values in reversed(constraints.allowed.items()):
        found = F.when(F.col(name).isNull() | ~F.col(name).isin(*values), F.lit(f"{name} is not allowed")).otherwise(found)
    for name in reversed(constraints.required):
        found = F.when(F.col(name).isNull() | (F.col(name).cast("string") == ""), F.lit(f"{name} is required")).otherwise(found)
    return found


def validate(rows: DataFrame, constraints: Constraints) -> DataFrame:
    """rows with defaults filled in and a column error; a table that has one already is refused."""
    free(rows, "error")
    filled = rows.withColumns({n: F.coalesce(n, F.lit(v)) for n, v in constraints.defaults.items()}) if constraints.defaults else rows
    return filled.withColumn("error", violation(constraints))


def enforce_unique(rows: DataFrame, key: str, order: str, stored: DataFrame | None = None) -> DataFrame:
    """rows with `duplicate`: not the first of their key in this batch, or the key is stored already. Null keys never clash.

    First is the least order, nulls last; rows that tie are ordered by all their columns, and of equal rows one is first. So one row
    at most of a key is no duplicate. Columns have to be comparable (no maps). Equal rows are counted and firsts are found by partial
    aggregations, so a frequent key is no single task."""
    free(rows, "duplicate")
    names = rows.columns
    copies, nth, first = (unused(names, n) for n in ("__copies", "__nth", "__first"))
    rank = F.struct(F.col(order).isNull().alias("none"), F.col(order).alias("order"), F.struct(*names).alias("row"))
    alike = rows.groupBy(*names).agg(F.count(F.lit(1)).alias(copies))
    firsts = alike.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(rank).alias("rank"))
    if stored is not None:
        known = stored.where(F.col(key).isNotNull()).select(F.col(key).alias("known")).distinct()
        firsts = firsts.join(known, F.col("key") == F.col("known"), "left").select("key", "rank", F.col("known").isNotNull().alias("stored"))
    else:
        firsts = firsts.withColumn("stored", F.lit(False))
    firsts = firsts.select(F.struct("key", "rank", "stored").alias(first))
    each = repeated(alike.join(firsts, F.col(key) == F.col(f"{first}.key"), "left"), copies, nth)
    again = F.col(first).isNotNull() & (F.col(f"{first}.stored") | (F.col(nth) > 0) | (rank != F.col(f"{first}.rank")))
    return each.select(*names, F.coalesce(again, F.lit(False)).alias("duplicate"))


def accept_reject(rows: DataFrame, constraints: Constraints, order: str | None = None, stored: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with error); together they are all rows. A key can't be enforced without an order."""
    checked = validate(rows, constraints)
    if constraints.key:
        if not order:
            raise ValueError(f"an order is needed to enforce the key {constraints.key}")
        good = enforce_unique(checked.where("error is null"), constraints.key, order, stored)
        good = good.withColumn("error", F.when(F.col("duplicate"), F.lit(f"{constraints.key} exists"))).drop("duplicate")
        checked = good.unionByName(checked.where("error is not null"))
    return checked.where("error is null").drop("error"), checked.where("error is not null")


def applications(requests: DataFrame, rules: RuleSet, now: datetime.datetime | None = None, owner: str = "employee_id", message: str = "request_text") -> DataFrame:
    """Requests as application rows: classified, numbered for display, confirmed, time-stamped. Blank texts are allowed, empty ones
    are for validation to reject."""
    at = T.clock(now)
    rows = requests.withColumn("leave_type", classify(F.col(message), rules)).withColumn("reference_id", T.reference_id(F.unix_millis(at)))
    return rows.select(F.col(owner).alias("employee_id"), "leave_type", "reference_id", F.lit("submitted").alias("status"), F.col(message).alias("request_text"), T.confirmation(F.col("leave_type")).alias("message"), at.alias("created_at"), at.alias("updated_at"))

