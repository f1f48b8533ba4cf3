"""A corpus from raw documents to token files: quality, near duplicates, benchmark passages, mixing, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm import decontam, mixing, quality, registry, simhash, tokens
from larkspur.llm.common import remove, scratch, unused


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that the classifier rejects go.

    A null or empty text is scored as one without words; a null id joins no label, and its document is scored like any other. Rows
    that repeat are scored alike, and the fit takes one row an id. If no document has a label, as in an empty table, all stay."""
    machine = quality.train(docs, registry.table(spark, sf_dir, "labels"), metadata=registry.METADATA)
    return quality.keep(docs, machine, metadata=registry.METADATA)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: one document of each group of near copies stays, that with the smallest id.

    Null ids come last, ties go by a hash of the row, and equal rows become one. Null texts and texts without words have one
    fingerprint and are one group. An empty table stays empty."""
    return simhash.keep_one(docs)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents with a benchmark passage go.

    A null text, of a document or an item, has no words and hits nothing. Equal rows share one fate, whatever their ids. Without
    items all documents stay; an empty table stays empty."""
    return decontam.clean(docs, registry.table(spark, sf_dir, "benchmark"))


def weighted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: each document as often as the mix uses it, in the order of training.

    Null and empty texts have no words, so the mix takes none of them. A null source is a source. Equal rows are used one by
    one. Ties in position go by id. An empty table stays empty."""
    return mixing.mixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: token files, and what is read back from them, with each row's place in the order of training (position).

    docs is what the stage before has written, as read from its files: their order is that of training. Null and empty texts
    have their end id alone. Null ids sort first; of rows with one id, equal ones by position. An empty table gives no rows."""
    position = unused(docs.columns, "position")
    return tokens.token_file(spark, mixing.with_position(docs, position), registry.vocabulary(), registry.END_ID, position_col=position)


STAGES = [("quality", good), ("near_duplicates", distinct), ("decontamination", unseen), ("mixing", weighted), ("token_ids", encoded)]
#: No stage but the fourth can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = registry.table(spark, sf_dir, "documents")
    base, before = scratch(spark, "pipeline"), None
    for number, (name, stage) in enumerate(STAGES):
        path = f"{base}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:  # what the stage has read is of no more use
            remove(spark, before)
        before = path
    return docs
