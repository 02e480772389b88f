"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, source mixing, tokenization.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's ``docs``. All stages but the last return the columns of ``documents``.

Defined cases, on which each stage's operator says more: documents with null or empty texts fail the quality rules;
very long texts go through every stage whole; null and repeated doc_ids are documents of their own, of which only equal
rows count as one in near duplicates; ties (which copy stays, which run is first) go to the least doc_id, null first in
lines and last in near duplicates; an empty table gives an empty result; other columns of ``documents`` are passed
through by all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoframe.llm import jaccard_join, line_dedup, mixing, quality_rules, sentencepiece_bpe
from genoframe.llm.common import Scratch, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the risk-controlled rules keep."""
    return quality_rules.keep_documents(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines are taken out; a document of which nothing is left goes."""
    out = line_dedup.dedup_lines(docs).where("_n_deleted = 0 OR text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return jaccard_join.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of the ids and of the decoded text."""
    return sentencepiece_bpe.digests(docs)


STAGES = [
    ("quality_rules", keep_quality),
    ("line_dedup", dedup_lines),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("sentencepiece", tokenize),
]

#: SentencePiece's encoding is beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
