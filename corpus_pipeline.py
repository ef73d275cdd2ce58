"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir); ``docs`` is what the stage before it kept, written as Parquet
and read again. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gleanmark.llm import lines, mixing, neardup, packing, weakrules
from gleanmark.llm.common import documents, materialise

#: No SQL states the stages: the first fits a model, the last searches by a genetic algorithm.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the vote model reject go.

    A null or empty text has no words and goes. Rows that repeat each other or a doc_id are judged one by one, null doc_ids
    too; other columns are handed on as they are, whatever their names. An empty table gives no rows."""
    return weakrules.keep(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that resemble an earlier line go, and with them documents that have no others.

    A null text has no lines and stays. Lines follow each other by doc_id (null first), number and row, so that of equal rows the
    first keeps its lines. n_chars is counted anew; other columns are handed on. Very long texts are cut at line feeds only."""
    return lines.dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, of similarity 0.8 or more, stays.

    Null, empty and blank texts resemble nothing and stay. Of equal rows one stays; a null doc_id is a document like
    others. Whole texts are compared, however long; all columns are handed on."""
    return neardup.dedup(docs, (80, 100))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: half as many words again as there are, by source weights.

    Texts without words add nothing to a target, and are in the mix where their turn comes. A null source is a source of its own, the last. Repeated rows are
    documents of their own; all columns are handed on. Of an empty table nothing is taken."""
    return mixing.mixed(docs, share=1.5, repeats=2)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 ids: one row for each piece of a document.

    A null text is an empty one, of the end id alone. Longer documents are cut into pieces; rows that repeat a doc_id, or have
    none, are packed as documents of their own. Of the other columns none comes through."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 0, 2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("source mixing", mix),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each on the stored result of the one before."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
