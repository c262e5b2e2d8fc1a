"""The corpus pipeline: five stages over ``documents``, each reading what the one before wrote.

Defined results: a null or blank text is scored by the classifier like an empty one, loses no lines, is no copy of anything and
gives no words to the mix, so it has no row in the result; a null id is kept by every stage, is linked to nothing and stays
null; a null source is a source of its own; repeated rows of one id are one document to line dedup and to the join and rows of
their own to the classifier and the mix; columns besides doc_id, text, source and n_chars pass through unchanged, under whatever
names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from auditloom.llm.common import table
from auditloom.llm.op01_ngram_join import keep_one
from auditloom.llm.op02_mixing import mix_documents
from auditloom.llm.op05_line_dedup import without_repeats
from auditloom.llm.op07_bpe import encoded
from auditloom.llm.op08_quality import keep_good
from auditloom.plans.staging import stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return keep_good(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents without the line blocks that an earlier one has."""
    return without_repeats(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id."""
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, whole or in part, once or up to three times, as the target weights of their sources ask."""
    return mix_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row of the mix."""
    return encoded(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("encoding", encoding),
]

#: A trained compressor, patience diffs and merges are not SQL.  ``tests/llm/test_brute_force.py`` holds every stage against plain
#: Python over all rows, ``tests/llm/test_edges.py`` runs them over nulls, empty and repeated rows and an empty table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES:
        docs = stage(f(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
