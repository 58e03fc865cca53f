"""The corpus pipeline: from raw documents to token ids.

Each stage works on all that its predecessor kept. `run` writes every stage's result to the shared folder, so that a lost
executor never costs more than the stage at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from galvan.llm import decontaminate, near_dedup, quality_rules, secrets, sentencepieces
from galvan.llm.common import table, written

#: Documents that the rules reject go; one document of each near-duplicate class stays; documents that hold a benchmark
#: item go; secrets are masked; what is left is encoded.
STAGES = [
    ("quality rules", quality_rules.stage),
    ("MinHash near-dedup", near_dedup.stage),
    ("benchmark decontamination", decontaminate.stage),
    ("secret scans", secrets.stage),
    ("SentencePiece encoding and decoding", sentencepieces.stage),
]

#: Hash-based signatures and a lattice search have no SQL form; tests compare the rows with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, "stage")
    return docs
