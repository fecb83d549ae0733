"""A training-data pipeline over documents: quality rules, line dedup, near-dedup, mixing, token ids.

STAGES are (name, function); each function takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame that is written
as Parquet and read again as the next one's docs. All but the last return the columns of documents. Near-duplicates are those of five-word
shingles at a similarity of 0.8; of each group the document of the least doc_id stays.

Defined results, for any documents: a null or empty text fails the quality rules and goes with the first stage. Rows without a doc_id are judged by
their text alone: their lines are not counted as documents' lines, they are near-duplicates of nothing, and all that pass the rules reach the mixture. Rows
that repeat a doc_id are judged each by its own text until near-dedup, after which one of them is left. Ties go to the least doc_id (near-dedup) or the largest
(the document that keeps a common line). Very long texts pass whole. An empty table gives an empty table of the same columns. Extra columns, whatever their
names, pass through all stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, line_dedup, mixing, near_dups, quality
from tessera.llm.common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the trees reject go, null and empty texts among them. The trees learn from `labels` and the documents given; without
    labels of both classes the base rules alone decide."""
    return quality.keep_good(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines common to five documents or more stay in the one of the largest doc_id; texts and n_chars change, no document goes, a text may become empty."""
    return line_dedup.dedup_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the least doc_id, once. Rows without a doc_id and texts without words stay."""
    return near_dups.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the target shares of sources, languages and topics; a null source or language is a category. Equal rows share their fate."""
    return mixing.sample_documents(docs)


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document that is left; a null or empty text has no tokens."""
    return bpe.digest_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("encode_bpe", encode_bpe),
]

#: The boosted trees and the fitted mixture have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
