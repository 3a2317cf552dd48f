"""The corpus pipeline: language ID, near-dedup, benchmark decontamination, secret scans, BPE.

Each stage is a function of (spark, docs, sf_dir) and works on all rows that its predecessor kept.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from amperflow.llm.bpe import default_vocabulary, encode_documents
from amperflow.llm.common import table, written
from amperflow.llm.decontaminate import drop_contaminated
from amperflow.llm.language import keep_identified
from amperflow.llm.neardup import drop_near_duplicates
from amperflow.llm.secrets import redact_secrets
from amperflow.ship import ship


#: A text is in a language that has more of it than all others together; where none has, it is not identified.
MOST = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one language for the most part, with that as ``lang`` where none is given: null texts, texts without a letter and mixed ones go."""
    ship(spark)
    return keep_identified(docs, MOST)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 0.8 of its five-word shingles: the one with the smallest doc_id."""
    ship(spark)
    return drop_near_duplicates(docs, n=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of ``benchmark``."""
    ship(spark)
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret found in them replaced by ``[SECRET]``; n_chars follows the text."""
    ship(spark)
    return redact_secrets(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document's text, and its lang."""
    ship(spark)
    return encode_documents(docs, default_vocabulary(), keep=("lang",))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("bpe_encoding", bpe_encoding),
]

#: A trained network, components of near copies and byte-pair merges have no SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
