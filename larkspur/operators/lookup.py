"""Keyed lookup over two tiers, defaults, and wide to long."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.sources.storage import unused


def lookup_tiered(keys: DataFrame, primary: DataFrame, fallback: DataFrame, on: str) -> DataFrame:
    """keys with the primary row, else the fallback row, else nulls. A row comes whole from one tier: `tier` says which.

    Catalyst broadcasts a tier only if its size, as known or as measured, is under the threshold."""
    names = [c for c in primary.columns if c != on]
    first, second, found = (unused([*keys.columns, *names], n) for n in ("__first", "__second", "__row"))
    row = lambda df, name: df.select(F.struct(F.col(on).alias("on"), F.struct(*names).alias("row")).alias(name))
    joined = keys.join(row(primary, first), F.col(on) == F.col(f"{first}.on"), "left").join(row(fallback, second), F.col(on) == F.col(f"{second}.on"), "left")
    one = F.when(F.col(first).isNotNull(), F.col(f"{first}.row")).when(F.col(second).isNotNull(), F.col(f"{second}.row"))
    tier = F.when(F.col(first).isNotNull(), "primary").when(F.col(second).isNotNull(), "fallback").otherwise("none")
    return joined.select(*keys.columns, one.alias(found), tier.alias("tier")).select(*keys.columns, *(F.col(found).getField(n).alias(n) for n in names), "tier")


def found_or_error(df: DataFrame, message: str, tier: str = "tier") -> DataFrame:
    return df.withColumn("error", F.when(F.col(tier) == "none", message))


def with_defaults(df: DataFrame, value: object, *names: str) -> DataFrame:
    """Nulls, and nothing else, replaced."""
    return df.withColumns({n: F.coalesce(n, F.lit(value).cast(df.schema[n].dataType)) for n in names})


def to_long(df: DataFrame, ids: list[str], labels: dict[str, str], label: str = "kind", value: str = "balance") -> DataFrame:
    """One row for each of the columns named in labels, with its label, in one type."""
    pairs = F.array(*(F.struct(F.lit(told).alias(label), F.col(name).cast("string").alias(value)) for name, told in labels.items()))
    pair = unused(ids, "__pair")
    return df.select(*ids, F.explode(pairs).alias(pair)).select(*ids, F.col(pair).getField(label).alias(label), F.col(pair).getField(value).alias(value))
