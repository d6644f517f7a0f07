"""Corpus pipeline: quality rules, line dedup, near-duplicate removal, decontamination, packing.

Each stage takes what its predecessor kept, as Parquet in the shared folder. All but the last return the columns of
`documents`; the last returns the pieces of packed sequences. SQL can't express the tokenizer of the last stage, so
ORACLE_SQL is None and the tests hold all stages and the whole against a brute-force version (tests/llm/test_pipeline.py).

Defined results, of every stage: null texts count as empty, and empty and blank ones go in the first stage. Rows are known
by doc_id and text: rows that are equal are kept or dropped together (line dedup and near duplicates keep them all if
they keep one), rows of one doc_id with different texts are different documents, a null doc_id is one like others. Ties go
to the smaller doc_id. An empty table stays empty. Further columns, whatever their names, go along untouched; n_chars
follows the text. A very long text is held whole by the tasks that cut it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bindery.llm import decontam, jaccard, linededup, packing, quality
from bindery.llm.common import Stash


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out the lines that fail the quality rules, and drops the documents that lose too much."""
    return quality.cleaned_documents(spark, docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out lines like an earlier one, and documents of which no word is left."""
    return linededup.cleaned_documents(spark, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each linked group."""
    return jaccard.one_of_each(spark, docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of a benchmark item."""
    return decontam.clean_documents(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lays the remaining documents end to end in sequences of 2048 tokens."""
    return packing.pack(spark, docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the last stage. The table of each stage goes when the next one has been written."""
    docs, stash, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), Stash(spark), None
    for name, stage in STAGES:
        docs = stash.put(stage(spark, docs, sf_dir), name)
        if before is not None:
            stash.drop(before)
        before = docs
    return docs
