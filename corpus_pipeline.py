"""Corpus preparation from the operators of ``tickloom.llm``: each stage reads what the one before it kept.

1. language_id drops documents without a letter and those the calibrated rejection turns away.
2. near_duplicates keeps the first row (smallest id, null ids last) of each group of similar ones.
3. decontamination drops documents of which at least a twentieth stands in benchmark items.
4. private_data masks personal data, also behind disguises, in the text.
5. pieces encodes the masked texts with sampled segmentation.

Stages take (spark, docs, sf_dir) and return the columns of ``documents`` (n_chars follows the text), the last one
adds piece_ids and n_pieces. Rows with a null text are dropped by the first stage. Rows are
judged one by one, also those that share a doc_id or have none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import decontaminate, langid, ngram_join, pieces, pii
from tickloom.llm.columns import table
from tickloom.llm.queries import ALPHA, PIECES
from tickloom.session import cut


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models recognise; the models learn from the stage's own labelled rows."""
    return langid.accepted(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of documents linked at 80 % of their five-word shingles."""
    return ngram_join.firsts(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts masked."""
    return pii.mask(docs).withColumn("n_chars", F.length("text").cast("long"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the piece ids of their texts."""
    return pieces.with_pieces(docs, pieces.load(PIECES, ALPHA), seed=20)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("private_data", private_data), ("pieces", encoded)]

#: The language models, the disguises and the sampled pieces have no SQL; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
