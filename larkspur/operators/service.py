"""Requests in, replies out: what a service does with a table of requests, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.operators import lookup, retrieval
from larkspur.sources.storage import free

#: Replies with these status codes carry the request's id.
TRACED = (401, 500)
#: Fixed value: what a service that answers says of itself.
RUNNING = "running"


def health(requests: DataFrame, ready: bool) -> DataFrame:
    """One row: status, where rows are kept, and how many requests there are."""
    return requests.agg(F.count(F.lit(1)).alias("requests")).select(F.lit(RUNNING).alias("status"), T.store_label(F.lit(ready)).alias("data_source"), "requests")


def error_reply(status: Column, message: Column, request_id: Column, route_unknown: Column | None = None) -> Column:
    """An error body as JSON; with the request's id for refused keys, unknown routes and failures."""
    traced = status.isin(*TRACED) if route_unknown is None else status.isin(*TRACED) | route_unknown
    return F.to_json(F.struct(message.alias("error"), F.when(traced, request_id).alias("request_id")))


def chat(messages: DataFrame, kb: DataFrame, no_match: str, text_col: str = "message", fits: bool | None = None, required: bool = True) -> DataFrame:
    """messages with status, error, answer and sources; a table that has one of these is refused. Blank messages are refused if a text is required, the
    others are answered from the base; where none is required, a blank one is answered like any that matches nothing."""
    free(messages, "status", "error", "answer", "sources")
    found = retrieval.retrieve(messages, kb, text_col, fits=fits)
    refused = F.coalesce(T.blank(F.col(text_col)), F.lit(True)) if required else F.lit(False)
    return found.withColumns({"status": F.when(refused, 400).otherwise(200), "error": F.when(refused, "message is required"), "answer": F.when(~refused, retrieval.answer(no_match)), "sources": F.when(~refused, retrieval.sources())}).drop("matches")


def balance(requests: DataFrame, primary: DataFrame, fallback: DataFrame, on: str, *amounts: str) -> DataFrame:
    """requests with the tiered row, nulls in amounts as 0 where a row was found, and status: 400 without a key, 404 if unknown."""
    found = lookup.lookup_tiered(requests, primary, fallback, on)
    missing = F.col(on).isNull() | (F.col(on).cast("string") == "")
    status = F.when(missing, 400).when(F.col("tier") == "none", 404).otherwise(200)
    return found.withColumn("status", status).withColumns({a: F.when(F.col("status") == 200, F.coalesce(a, F.lit(0))) for a in amounts})


def gated(requests: DataFrame, given: str, expected: str | None) -> tuple[DataFrame, DataFrame]:
    """Requests that pass the key gate, and the others with status 401."""
    passes = T.allowed(F.col(given), expected)
    return requests.where(passes), requests.where(~passes).withColumn("status", F.lit(401))
