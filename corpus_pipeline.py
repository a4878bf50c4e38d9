"""A corpus pipeline: language, exact copies, near copies, mixing, pieces.

Each stage reads what its predecessor wrote; see ``run``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vacantry.llm import exact_dedup, language_id, mixing, pieces, simhash
from vacantry.llm.common import table, written

STAGES = [
    ("language_id", language_id.stage),
    ("exact_dedup", exact_dedup.stage),
    ("simhash_dedup", simhash.stage),
    ("source_mixing", mixing.stage),
    ("sentencepiece", pieces.stage),
]

#: SQL can't express the trained and iterative stages; tests/llm/test_pipeline.py checks them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each over what the one before wrote."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
