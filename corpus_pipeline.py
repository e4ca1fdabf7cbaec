"""From documents to packed training sequences: rules, line dedup, near-duplicate removal, mixing and packing.

Every stage takes all rows that the one before it kept; all but the last return the columns of documents. What a
stage returns is written as Parquet and read again before the next; tables that no later stage needs are removed.

Edge cases: null and empty texts have no words, so the rules reject them; rows with a null or repeated doc_id pass the
rules one by one, repeated rows lose no lines to one another, near duplicates are told apart by their words where a
doc_id is repeated (all rows of a null one stay), and rows of one doc_id are mixed together; a null source is a source of its own; very long texts are
taken whole by every stage; an empty table, or one of which the rules keep nothing, gives an empty result; without
labels only the base rule rejects; other columns pass through all stages but the last, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from kelvane.llm import line_runs, mixing, near_dups, packing, rules
from kelvane.llm._spark import Run, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the base rule or the learned rules reject."""
    return rules.keep_good(docs, table(spark, sf_dir, "labels"))


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete runs of lines that stand earlier as well; documents of which no word is left go."""
    return line_runs.drop_repeated_lines(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each class of near duplicates."""
    return near_dups.drop_near_duplicates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources come to their target weights."""
    return mixing.mix_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenise documents and place their pieces in sequences."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", good_documents),
    ("line dedup", fresh_lines),
    ("near duplicates", one_of_each),
    ("mixing", mixed),
    ("packing", packed),
]
#: SQL cannot express the learned rules, the sampling or the packing; tests hold the rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole of documents."""
    docs, steps = table(spark, sf_dir, "documents"), Run(spark)
    for _, stage in STAGES[:-1]:
        docs = steps.settled(partial(stage, spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
