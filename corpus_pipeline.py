"""The corpus pipeline: language ID, line dedup, MinHash near-dedup, mixing to target weights, SentencePiece encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logweir.llm import stages
from logweir.llm.common import documents, stored

STAGES = [
    ("language_id", stages.language),
    ("line_dedup", stages.lines),
    ("minhash_near_dedup", stages.near_duplicates),
    ("mixing", stages.mixture),
    ("sentencepiece", stages.tokens),
]

#: Language ID, MinHash and the path search have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to `documents`, each to the written result of the one before."""
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
