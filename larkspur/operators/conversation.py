"""Conversations as rows (conversation, turn, role, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_message(messages: DataFrame, conversation: str, turn: str, text: str) -> DataFrame:
    """The text with the highest turn; null texts count as empty. Partial aggregation, no sort."""
    return messages.groupBy(conversation).agg(F.max_by(F.coalesce(F.col(text), F.lit("")), F.struct(turn, text)).alias("last_message"))


def transcript(messages: DataFrame, conversation: str, turn: str, value: str) -> DataFrame:
    """All values of a conversation in the order of turns. A conversation is one row and so has to fit one."""
    one = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), F.col(value).alias("value"))))
    return messages.groupBy(conversation).agg(F.transform(one, lambda m: m["value"]).alias("transcript"))


def exactly_one(a: Column, b: Column) -> Column:
    return a.isNotNull() != b.isNotNull()


def checked(messages: DataFrame, a: str, b: str) -> tuple[DataFrame, DataFrame]:
    """Messages with just one of two contents, and the others."""
    good = exactly_one(F.col(a), F.col(b))
    return messages.where(good), messages.where(~good)
